"""Chroma audio fingerprints for media columns, and alignment of recordings.

A recording (16-bit PCM) becomes frames of energy by pitch class; an integral image of the frames
gives any rectangle's sum in four reads, so sixteen rectangle filters, two bits each, make one
packed 32-bit code a frame.  Alike stretches of two recordings have alike codes.

*Alignment.*  Pairs of neighbouring codes of the queries join the index; each match votes for
an offset, the votes of a pair of recordings form a histogram, and its peak is verified by the
bit errors of all overlapping codes.

Equal recordings form a class (one index entry, however many copies) and every row carries its
class, so copies are never paired with each other.

Defined cases: null, empty or short audio has no codes, is a class with its likes, and aligns with nothing; a
silent frame has code 0 and is no index key; equal peaks go to the smaller offset; repeated
rows each get a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, written

RATE = 4000
FRAME = 1024
HOP = 256
LOW, HIGH = 100.0, 1900.0
#: Filters as (kind, first pitch class, pitch classes, frames): halves in time, in pitch, crossed, and middle against sides.
FILTERS = [(("time", "pitch", "cross", "middle")[i % 4], (5 * i) % 12, (3, 4, 6)[i % 3], (4, 6, 8, 12)[i // 4]) for i in range(16)]
#: Log ratios at which a filter's two bits change.
STEPS = (-0.25, 0.0, 0.25)
GRAY = np.array([0, 1, 3, 2], np.uint32)
MOST_ERRORS = 0.2
LEAST_VOTES = 4


def _pitch_classes() -> np.ndarray:
    """(12, bins): which bins of a frame's spectrum belong to which pitch class."""
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((12, len(f)), np.float32)
    use = np.flatnonzero((f >= LOW) & (f <= HIGH))
    out[np.round(12 * np.log2(f[use] / 440)).astype(int) % 12, use] = 1
    return out


def frames(pcm: np.ndarray) -> np.ndarray:
    """(frames, 12) energies by pitch class, each frame summing to 1 (0 if silent)."""
    if len(pcm) < FRAME:
        return np.zeros((0, 12))
    cut = np.lib.stride_tricks.sliding_window_view(pcm.astype(np.float32), FRAME)[::HOP] * np.hanning(FRAME).astype(np.float32)
    power = np.abs(np.fft.rfft(cut)).astype(np.float32) ** 2 @ _pitch_classes().T
    total = power.sum(1, keepdims=True)
    return np.divide(power, total, out=np.zeros_like(power), where=total > 1e3).astype(np.float64)


def codes(energy: np.ndarray) -> np.ndarray:
    """Packed codes of frames; pitch classes wrap around."""
    width = max(f[3] for f in FILTERS)
    n = len(energy) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(energy) + 1, 25))
    image[1:, 1:] = np.concatenate([energy, energy], axis=1).cumsum(0).cumsum(1)
    at = np.arange(n)

    def box(t0, t1, p0, p1):
        return image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]

    out = np.zeros(n, np.uint32)
    for i, (kind, p, high, wide) in enumerate(FILTERS):
        if kind == "time":
            a, b = box(0, wide // 2, p, p + high), box(wide // 2, wide, p, p + high)
        elif kind == "pitch":
            a, b = box(0, wide, p, p + high // 2), box(0, wide, p + high // 2, p + high)
        elif kind == "cross":
            a = box(0, wide // 2, p, p + high // 2) + box(wide // 2, wide, p + high // 2, p + high)
            b = box(0, wide // 2, p + high // 2, p + high) + box(wide // 2, wide, p, p + high // 2)
        else:
            b = box(wide // 4, wide - wide // 4, p, p + high)
            a = box(0, wide, p, p + high) - b
        ratio = np.log((a + 1e-2) / (b + 1e-2))
        out |= GRAY[np.searchsorted(STEPS, ratio)] << np.uint32(2 * i)
    quiet = box(0, width, 0, 12) == 0
    out[quiet] = 0
    return out


def fingerprint(pcm: bytes | None) -> list[int]:
    """Codes of 16-bit little-endian PCM, as signed 32-bit integers."""
    pcm = pcm or b""
    return codes(frames(np.frombuffer(pcm[: len(pcm) // 2 * 2], "<i2"))).view(np.int32).tolist()


def fingerprints(media: DataFrame, *, key: str = "media_id", column: str = "audio") -> DataFrame:
    """``media_id, codes`` of a table with a PCM column."""
    return map_rows(media.select(F.col(key).alias("media_id"), column), lambda: lambda i, pcm: (i, fingerprint(pcm)), "media_id long, codes array<int>")


def _keys(rows: DataFrame, name: str) -> DataFrame:
    """``name, place, key``: neighbouring codes at each place; a held tone counts once."""
    pair = F.transform(F.sequence(F.lit(0), F.size("codes") - 2), lambda i: F.when((F.get("codes", i) != 0) & (F.get("codes", i) != F.get("codes", i + 1)), F.shiftleft(F.get("codes", i).cast("long"), 32).bitwiseOR(F.get("codes", i + 1).cast("long").bitwiseAND(0xFFFFFFFF))))
    return rows.where(F.size("codes") >= 2).select(name, F.posexplode(pair).alias("place", "key")).where("key IS NOT NULL")


def align(clips: DataFrame, recordings: DataFrame, *, least_votes: int = LEAST_VOTES, most_errors: float = MOST_ERRORS) -> DataFrame:
    """Alignments of ``clips(media_id, codes)`` in ``recordings(media_id, codes)``.

    ``query_class, class_id, offset, votes, bit_errors``: ``offset`` is the place in the
    recording where the clip begins, in frames; the classes are the smallest ids of equal codes.
    """
    queries = clips.groupBy("codes").agg(F.min("media_id").alias("query_class")).where(F.size("codes") >= 2)
    index = recordings.groupBy("codes").agg(F.min("media_id").alias("class_id")).where(F.size("codes") >= 2)
    left = _keys(queries, "query_class").withColumnRenamed("place", "q")
    votes = left.join(_keys(index, "class_id"), "key").groupBy("query_class", "class_id", (F.col("place") - F.col("q")).alias("offset")).agg(F.count(F.lit(1)).alias("votes"))
    peak = votes.groupBy("query_class", "class_id").agg(F.min(F.struct((-F.col("votes")).alias("v"), F.abs("offset").alias("a"), "offset")).alias("p"))
    peak = peak.select("query_class", "class_id", "p.offset", (-F.col("p.v")).alias("votes")).where(F.col("votes") >= least_votes)
    pairs = peak.join(queries.withColumnRenamed("codes", "clip"), "query_class").join(index, "class_id")
    first, last = F.greatest(F.lit(0), -F.col("offset")), F.least(F.size("clip"), F.size("codes") - F.col("offset")) - 1
    errors = F.aggregate(F.sequence(first, last), F.lit(0), lambda acc, i: acc + F.bit_count(F.get("clip", i).bitwiseXOR(F.get("codes", i + F.col("offset"))).cast("long").bitwiseAND(0xFFFFFFFF)))
    return pairs.withColumn("bit_errors", errors / (32 * (last - first + 1))).where(F.col("bit_errors") <= most_errors).select("query_class", "class_id", "offset", "votes", F.round("bit_errors", 6).alias("bit_errors"))


def search(recordings: DataFrame, clips: DataFrame, **options) -> DataFrame:
    """Every recording with its class; those with a clip also with the clip's alignments.

    ``media_id, class_id, n_codes, matches``: ``matches`` is a sorted array of
    ``class_id, offset, votes, bit_errors`` and null for rows without a clip.
    """
    recordings, clips = written(recordings), written(clips)
    found = align(clips, recordings, **options)
    found = found.groupBy("query_class").agg(F.sort_array(F.collect_list(F.struct("class_id", "offset", "votes", "bit_errors"))).alias("matches"))
    classes = clips.groupBy("codes").agg(F.min("media_id").alias("query_class")).join(found, "query_class", "left")
    asked = clips.join(classes, "codes").select("media_id", F.coalesce("matches", F.array().cast("array<struct<class_id:bigint,offset:int,votes:bigint,bit_errors:double>>")).alias("matches"))
    own = recordings.groupBy("codes").agg(F.min("media_id").alias("class_id"))
    rows = recordings.join(own, "codes").select("media_id", "class_id", F.size("codes").alias("n_codes"))
    return rows.join(asked, "media_id", "left")


def melody(vector: list[float] | None, *, note: int = 400, skip: int = 0, noise: float = 0.0, seed: int = 0) -> bytes:
    """A vector played as notes, one for each number: the audio of the supplied tables.

    ``skip`` leaves out samples at the start and end; ``noise`` is its share of the amplitude.
    """
    if not vector:
        return b""
    x = np.nan_to_num(np.asarray([v if v is not None else 0.0 for v in vector], np.float64))
    pitch = 220 * 2 ** (np.clip(np.floor(x * 60), -12, 24) / 12)
    phase = np.cumsum(np.repeat(2 * np.pi * pitch / RATE, note))
    sound = np.sin(phase) + 0.4 * np.sin(2 * phase)
    if noise:
        sound += noise * np.random.default_rng(seed).standard_normal(len(sound))
    return (sound[skip : len(sound) - skip] * 8000).astype("<i2").tobytes()
