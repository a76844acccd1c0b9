"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary texts.  A text is cut
into windows of whole words; each window is compressed with either dictionary, and what the toxic
one saves is the window's gain.  A text's score is a calibrated logistic function
of its total gain and of its gain per window, so a long text isn't toxic for one chance match.

*Training the dictionaries.*  zstandard's own trainer keeps what is frequent in its samples.  As toxic texts differ
from ordinary ones in few words, two dictionaries trained so differ by chance more than by toxicity: over sf0.1 their
gains find 0.01 to 0.05 of the held-out toxic texts, also when trained again on the windows that gain most.
So what goes into a dictionary is chosen by contrast.  Substrings of words are chosen by how much more often (capped counts
per text, Welch's statistic) they occur in toxic than in ordinary texts, each for words that none before it explains.  The toxic dictionary
holds the segments that speak for toxic text behind a common base of frequent words; the ordinary
one holds the same base and the segments that speak against.  With a shared base the
lengths differ only where a window has something typical of one side.

The fit uses at most ``max_toxic`` and ``max_ordinary`` labelled texts of at most ``max_chars``
characters each, the ones of the smallest hash of the id: a documented bound.  Scoring covers
all whole texts and uses nothing but the text.

Defined cases: null and empty texts get the score of no gain; without both labels among the
training rows every score is the share of toxic training rows (0 without any); repeated rows
each get a row; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, docs_only, map_rows

FOLDS = 5
WINDOW = 120
WORD = re.compile(r"[^\W\d_]+")
#: Characters of the shortest segment, and bytes of the shortest match.
SHORTEST = 5
#: Bytes of one value before a dictionary: zstandard sizes its tables by the dictionary, and in
#: small tables the segments of one side would displace matches that both sides have.
PADDING = 1 << 15
#: Compression made to find short matches in short windows.
_PARAMETERS = {"window_log": 18, "hash_log": 17, "chain_log": 17, "search_log": 1, "min_match": SHORTEST, "target_length": 1, "strategy": zstandard.STRATEGY_FAST}


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """Lower-cased stretches of whole words of at most about ``size`` bytes; longer words are cut."""
    data = b" " + " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")
    out, at, n = [], 0, len(data)
    while at < n:
        end = at + size
        if end < n:
            cut = data.rfind(b" ", at + 1, end)
            end = cut if cut > 0 else end
        out.append(data[at:end])
        at = end
    return out


class Compressor:
    """Compressed lengths of windows under one dictionary."""

    def __init__(self, dictionary: bytes) -> None:
        parameters = zstandard.ZstdCompressionParameters(**_PARAMETERS, write_content_size=False, write_checksum=False, write_dict_id=False)
        data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
        if data:
            data.precompute_compress(compression_params=parameters)
        self.compress = zstandard.ZstdCompressor(dict_data=data, compression_params=parameters).compress

    def lengths(self, parts: list[bytes]) -> np.ndarray:
        compress = self.compress
        return np.fromiter((len(compress(p)) for p in parts), np.int64, len(parts))


def segments(word: str, low: int = SHORTEST, high: int = 10) -> set[str]:
    """Substrings of a word with a space before it."""
    word = f" {word}"
    return {word[i : i + k] for k in range(low, min(high, len(word)) + 1) for i in range(len(word) - k + 1)}


def different(texts: list[str], words: int = 5, hashes: int = 4) -> list[str]:
    """The texts without near copies: none shares a least shingle hash with one before it."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text in texts:
        w = text.lower().split()
        shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
        least = {(k, min(xxhash.xxh64_intdigest(s, k) for s in shingles)) for k in range(hashes)}
        if not least & seen:
            out.append(text)
        seen |= least
    return out


def telling(own: list[Counter], other: list[Counter], *, least: float, most: int, candidates: int = 400) -> list[str]:
    """Segments that speak for the texts ``own`` (as word counts) against ``other``.

    The best by Welch's statistic of capped counts goes first; the words that it explains are then
    taken away, so that no other part of the same words is chosen for what it shares with them.
    """
    texts = own + other
    n, m = max(1, len(own)), max(1, len(other))

    def statistic(counts: dict[int, int]) -> float:
        a1 = a2 = b1 = b2 = 0.0
        for t, k in counts.items():
            k = min(k, 3)
            if t < len(own):
                a1, a2 = a1 + k, a2 + k * k
            else:
                b1, b2 = b1 + k, b2 + k * k
        am, bm = a1 / n, b1 / m
        return (am - bm) / math.sqrt((a2 / n - am * am + 1 / n) / n + (b2 / m - bm * bm + 1 / m) / m)

    uses: dict[str, list[tuple[int, int]]] = {}
    for t, words in enumerate(texts):
        for word, k in words.items():
            uses.setdefault(word, []).append((t, k))
    # How much more a segment occurs in own texts picks candidates; only they get exact counts.
    lead: Counter = Counter()
    for word, found in uses.items():
        weight = sum(min(k, 3) / n if t < len(own) else -min(k, 3) / m for t, k in found)
        for s in segments(word):
            lead[s] += weight
    top = {s for s, _ in lead.most_common(candidates)}
    holds = {word: hit for word in uses if (hit := segments(word) & top)}
    counts: dict[str, dict[int, int]] = {s: {} for s in top}
    for word, hit in holds.items():
        for s in hit:
            for t, k in uses[word]:
                counts[s][t] = counts[s].get(t, 0) + k
    score = {s: statistic(c) for s, c in counts.items()}

    def own_only(s: str) -> bool:
        """Ten times as frequent in own texts: then a part of a segment says as much as the whole."""
        sides = [0.0, 0.0]
        for t, k in counts[s].items():
            sides[t >= len(own)] += min(k, 3)
        return sides[0] / n >= 10 * sides[1] / m

    links = [s for s in sorted(score, key=lambda s: (-score[s], s)) if len(s) == SHORTEST and score[s] >= least and own_only(s)]

    def grown(s: str, longest: int = 16) -> str:
        """``s`` with telling characters around it: a match may begin at any of them."""
        while len(s) < longest and (more := next((x for x in links if x not in s and x[:-1] == s[1 - SHORTEST :]), None)):
            s += more[-1]
        while len(s) < longest and (more := next((x for x in links if x not in s and x[1:] == s[: SHORTEST - 1]), None)):
            s = more[0] + s
        return s

    chosen: list[str] = []
    while score and len(chosen) < most:
        best = min(score, key=lambda s: (-round(score[s], 6), len(s), s))
        if score[best] < least:
            break
        chosen.append(grown(best))
        changed = set()
        for word in [w for w, hit in holds.items() if best in hit]:
            for s in holds.pop(word):
                changed.add(s)
                for t, k in uses[word]:
                    counts[s][t] -= k
        score.update({s: statistic(counts[s]) for s in changed})
        del score[best]
    return chosen


def contrast(toxic: list[str], ordinary: list[str], size: int) -> tuple[bytes, bytes]:
    """Contents of the toxic and the ordinary dictionary, each of at most ``size`` bytes."""
    own, other = ([Counter(WORD.findall(t.lower())) for t in side] for side in (toxic, ordinary))
    base = " ".join(w for w, _ in Counter(w for words in other for w in words).most_common(200))[: size // 2]
    # The most telling segments stand last, nearest to the window.
    halves = ["".join(f"\n{s}" for s in reversed(found)).encode() for found in (telling(own, other, least=4.5, most=size // 24), telling(other, own, least=8.0, most=size // 24))]
    # Equal sizes put the base at equal distances, so its matches cost the same on either side;
    # the last bytes of a dictionary aren't indexed, so they are filler.
    longest = max(map(len, halves))
    return tuple(b"\n" * PADDING + base.encode() + b"\n" * (longest - len(half)) + half + b"\n" * 16 for half in halves)


class Model:
    """Two dictionaries and a calibrated logistic function of the gains."""

    def __init__(self, toxic: bytes, ordinary: bytes, weights: list[float]) -> None:
        self.toxic, self.ordinary, self.weights = toxic, ordinary, weights
        self._pair: tuple[Compressor, Compressor] | None = None

    def __getstate__(self):
        return self.toxic, self.ordinary, self.weights

    def __setstate__(self, state):
        self.__init__(*state)

    def features(self, text: str | None) -> list[float]:
        if self._pair is None:
            self._pair = Compressor(self.ordinary), Compressor(self.toxic)
        parts = windows(text)
        if not parts:
            return [0.0, 0.0]
        gain = np.maximum(self._pair[0].lengths(parts) - self._pair[1].lengths(parts), 0).sum()
        size = sum(map(len, parts)) / WINDOW
        return [math.log1p(gain), 4 * math.log1p(2 * gain / (size + 1))]

    def score(self, text: str | None) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Weights (the constant first) by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def train(rows: list[tuple[str, int]], *, size: int = 4096) -> Model:
    """A model of labelled texts: two thirds train the dictionaries, the rest calibrates."""
    sides = [different([t for t, y in rows if y == k]) for k in (1, 0)]
    if not all(len(s) >= 3 for s in sides):
        share = sum(y for _, y in rows) / len(rows) if rows else 0.0
        return Model(b"", b"", [math.log(max(share, 1e-13) / max(1 - share, 1e-13)), 0.0, 0.0])
    cut = lambda s, held: [t for i, t in enumerate(s) if (i % 3 == 0) == held]
    toxic, ordinary = contrast(cut(sides[0], False), cut(sides[1], False), size)
    model = Model(toxic, ordinary, [])
    held = [(model.features(t), y) for s, y in zip(sides, (1, 0), strict=True) for t in cut(s, True)]
    model.weights = logistic(np.array([x for x, _ in held]), np.array([y for _, y in held], float))
    return model


def fit(docs: DataFrame, labels: DataFrame, *, max_toxic: int = 1500, max_ordinary: int = 3000, max_chars: int = 20_000) -> Model:
    """A model of the labelled rows outside the held-out fold; labels come once a document."""
    known = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # The bounds apply to ids before any text moves.
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    sides = [bounded_sample(known.where(F.col("toxic") == k), n) for k, n in ((1, max_toxic), (0, max_ordinary))]
    ids = sides[0].unionByName(sides[1])
    short = docs_only(docs, "doc_id", "text").where(F.length("text") <= max_chars)
    # Rows that repeat an id count once, so the bounds on ids hold for texts too.
    rows = short.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    return train([(r.text, r.toxic) for r in sorted(rows, key=lambda r: (xxhash.xxh64_intdigest(str(r.doc_id)), r.text))])


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""

    def make():
        return lambda doc_id, held_out, text: (doc_id, held_out, s := model.score(text), int(s >= 0.5))

    picked = docs_only(docs, "doc_id", "text")
    picked = picked.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0).alias("held_out"), "text")
    return map_rows(picked, make, "doc_id long, held_out boolean, score double, predicted int")
