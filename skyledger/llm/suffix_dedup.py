"""Exact substring dedup with a logarithmic family of sparse suffix indexes.

A byte is removed when a string of ``length`` bytes that covers it also starts earlier (smaller
doc_id, or the same document and an earlier offset).

*Sampled suffixes.*  Every string of ``length`` bytes marks the suffix whose leading ``LEAD``
bytes have the smallest fingerprint in it (leftmost of equals).  Equal strings mark equal places,
so every repeat is seen at a marked suffix; about one suffix in forty is marked.  An entry of
the index is a marked suffix with the run of strings that marked it (its *reach*): fingerprints
of its leading bytes (``lead``) and of all bytes of its reach (``whole``).

*Suffix arrays and levels.*  Documents come in batches of rising doc_id.  Each batch's entries are
sorted by ``lead, whole, doc_id, place``: a suffix array in fingerprint order (only equality of
long prefixes matters here, so the order need not be alphabetical).  One sorted scan merges the
batch with the existing levels: an entry whose neighbour before it has the same ``lead`` and
``whole`` repeats, with all of its reach; entries of one ``lead`` but different ``whole`` are
*open*.  What is new forms a level; levels that have merged equally often merge again, so an entry is
rewritten a logarithmic number of times, and a repeated passage is stored once.

*Open entries.*  Their bytes are fetched from the texts, and each string of the reach is compared by
its own fingerprint with the others of the same ``lead``.  A ``lead`` with more than ``HOT`` open
entries is dealt by string instead, with partial minima, so that none meets whole in one task.

Repeats within one input split are found before the shuffle (the split's own suffix array), so
a passage in a third of all rows leaves each split once.  A first, small batch shows which leading
bytes are common to many different passages; from then on such a ``lead`` is dealt to tasks by
``whole`` and its entries count as open.

Defined cases: null text is empty; texts shorter than ``length`` lose nothing; an empty table gives
an empty result; extra columns are ignored; rows that repeat a doc_id are documents of their own, in the
order of a hash of their text, so of equal rows one keeps its bytes; rows without a doc_id are
neither sources nor repeats and lose nothing.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import docs_only, drop_written, scratch

LENGTH = 100
LEAD = 24
#: Bytes of text that are indexed at once; places within a chunk must fit 24 bits.
CHUNK = 1 << 21
#: Open entries of one ``lead`` from which on they are dealt by string.
HOT = 10_000
#: Open entries that a task compares at once.
STEP = 4096
#: Share of the first batch, and of a level's entries from which on a ``lead`` is dealt by ``whole``.
PILOT, COMMON = 1 / 64, 1 / 2000
#: Entries of a level that are counted for that, and parts that a common ``lead`` is dealt to.
LOOK, SALTS = 200_000, 64

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_COLUMNS = ["lead", "whole", "doc_id", "place", "until"]
_SCHEMA = ", ".join(f"{c} long" for c in _COLUMNS)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base, of its inverse (mod 2**64), and a random value of each byte."""
    n = max(CHUNK, (HOT + STEP) * 2 * 127) + 1
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    values = np.random.default_rng(7).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.cumprod(up), np.cumprod(down), values


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Prefixes:
    """Fingerprints of any stretch of a buffer (a chunk, or what a step compares)."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down, values = _powers()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def each(self, n: int) -> np.ndarray:
        """Of the ``n`` bytes from each place on."""
        x = self.sums[n:] - self.sums[:-n]
        return _mixed(x * self.down[: len(x)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.down[start]
        return _mixed(x + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def _marks(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Entries of the concatenated texts in ``data``; ``ends`` has each byte's text end.

    Gives ``lead, whole, place, first, last``: strings that start at ``first`` to ``last``
    marked the suffix at ``place``.
    """
    prefixes = Prefixes(data)
    lead = prefixes.each(LEAD)
    key = (lead & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(lead), dtype=np.uint64)
    width, low = 1, key
    want = length - LEAD + 1
    while width * 2 <= want:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < want:
        low = np.minimum(low[: len(low) - (want - width)], low[want - width :])
    mark = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    start = np.arange(len(mark))
    inside = start + length <= ends[: len(mark)]
    start, mark = start[inside], mark[inside]
    if not len(mark):
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 3
    new = np.flatnonzero(np.concatenate(([True], (mark[1:] != mark[:-1]) | (start[1:] != start[:-1] + 1))))
    place, first = mark[new], start[new]
    last = np.concatenate((start[new[1:] - 1], start[-1:]))
    whole = prefixes.of(first, last + length) + (place - first).astype(np.uint64)
    return lead[place], whole, place, first, last


def _chunks(rows, length: int):
    """Groups of (doc_id, offset, bytes) with at most CHUNK bytes; long texts come in pieces."""
    group, size = [], 0
    for doc_id, text in rows:
        text = text or b""
        for at in range(0, max(1, len(text) - length + 1), CHUNK - length):
            piece = text[at : at + CHUNK - 1]
            if len(piece) < length:
                continue
            if size + len(piece) > CHUNK:
                yield group
                group, size = [], 0
            group.append((doc_id, at, piece))
            size += len(piece)
    if group:
        yield group


def _split_entries(batches, length: int):
    """Entries of one input split; what repeats within the split comes as removed stretches."""
    found: list[tuple[np.ndarray, ...]] = []

    def rows():
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py()

    for group in _chunks(rows(), length):
        data = np.frombuffer(b"".join(x[2] for x in group), np.uint8)
        sizes = np.array([len(x[2]) for x in group])
        ends = np.cumsum(sizes)
        lead, whole, place, first, last = _marks(data, np.repeat(ends, sizes), length)
        which = np.searchsorted(ends, place, side="right")
        doc = np.array([x[0] for x in group], np.int64)[which]
        shift = np.array([x[1] for x in group], np.int64)[which] - (ends - sizes)[which]
        # The pieces of a long text overlap by ``length`` - 1 bytes, so each string is in one piece.
        found.append((lead, whole, doc, place + shift, place - first, last - place + length))
    if not found:
        return
    lead, whole, doc, place, back, ahead = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((place, doc, whole, lead))
    again = np.zeros(len(order), bool)
    again[order[1:]] = (lead[order[1:]] == lead[order[:-1]]) & (whole[order[1:]] == whole[order[:-1]])
    new = ~again
    packed = (place << 14) | (back << 7) | ahead
    step = 50_000
    for at in range(0, int(new.sum()), step):
        part = np.flatnonzero(new)[at : at + step]
        yield pa.RecordBatch.from_pydict({"lead": lead[part].view(np.int64), "whole": whole[part].view(np.int64), "doc_id": doc[part], "place": packed[part], "until": pa.nulls(len(part), pa.int64())})
    starts, stops = (place - back)[again], (place + ahead)[again]
    docs = doc[again]
    if len(docs):
        docs, starts, stops = _merged(docs, starts, stops)
        yield pa.RecordBatch.from_pydict({"lead": _mixed(docs.astype(np.uint64) * np.uint64(3) + starts.astype(np.uint64)).view(np.int64), "whole": np.zeros(len(docs), np.int64), "doc_id": docs, "place": starts, "until": stops})


def _merged(docs: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping and touching stretches of a document become one."""
    order = np.lexsort((starts, docs))
    docs, starts, stops = docs[order], starts[order], stops[order]
    change = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
    # Running maxima of ends within each document: lift each document above the one before.
    lift = np.repeat(np.arange(len(change)), np.diff(np.append(change, len(docs)))) * (int(stops.max()) + 2)
    reach = np.maximum.accumulate(stops + lift)
    new = np.concatenate(([True], (starts + lift)[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return docs[at], starts[at], (reach - lift)[np.append(at[1:] - 1, len(docs) - 1)]


def entries(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """Of binary texts: ``lead, whole, doc_id, place, until``: entries (``until`` null) and removed stretches."""
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _split_entries(batches, length), _SCHEMA)


class SuffixIndex:
    """Levels of sorted entries in the shared folder; the k-th has merged k times."""

    def __init__(self) -> None:
        self.levels: dict[int, str] = {}
        self.scans: set[str] = set()
        self.common: set[int] = set()

    def scan(self, spark, batch: DataFrame) -> DataFrame:
        """Merge-scan of a batch with all levels: the batch's entries, and open older ones.

        ``kind`` is ``again`` (all of the reach repeats), ``open`` or ``new``; ``fresh`` marks the
        batch's own.
        """
        rows = batch.withColumn("fresh", F.lit(1))
        for path in self.levels.values():
            rows = rows.unionByName(self.read(spark, path).withColumn("fresh", F.lit(0)))
        common = F.col("lead").isin(*self.common) if self.common else F.lit(False)
        rows = rows.withColumn("common", common).withColumn("salt", F.when(F.col("common"), F.pmod("whole", F.lit(SALTS))).otherwise(0))
        every = W.partitionBy("lead", "salt")
        ordered = every.orderBy("whole", "doc_id", "place")
        rows = rows.withColumn("before", F.lag("whole").over(ordered))
        several, touched = F.min("whole").over(every) < F.max("whole").over(every), F.max("fresh").over(every) == 1
        rows = rows.withColumn("several", F.col("common") | several).withColumn("touched", F.col("common") | touched)
        kind = F.when(F.col("until").isNotNull() | (F.col("before") == F.col("whole")), "again").when(F.col("several"), "open").otherwise("new")
        rows = rows.withColumn("kind", kind).where("fresh = 1 OR (touched AND kind = 'open')")
        return rows.select("lead", "whole", "doc_id", "place", "until", "fresh", "kind")

    def look(self, rows: DataFrame) -> None:
        """Learn which leads are common; only where entries go depends on it, so a bounded sample will do."""
        n = rows.count()
        seen = rows.sample(min(1.0, LOOK / n), seed=7) if n else rows
        often = seen.groupBy("lead").count().where(F.col("count") > max(20, min(n, LOOK) * COMMON)).orderBy(F.desc("count")).limit(int(1 / COMMON))
        self.common |= {r.lead for r in often.collect()}

    def add(self, batch: DataFrame, *, keep: bool = True) -> DataFrame:
        """Scan a batch and keep what is new as a level; gives the scan's ``again`` and ``open`` rows.

        A scan is written by kind, and its fresh rows are the new level as they stand.
        """
        spark, path = batch.sparkSession, scratch(batch.sparkSession)
        rows = self.scan(spark, batch)
        if not keep:
            rows = rows.where("kind <> 'new'")
        rows.write.partitionBy("kind").parquet(path)
        scanned = spark.read.schema(rows.schema).parquet(path)
        if keep:
            self.scans.add(path)
            fresh = scanned.where("fresh = 1 AND kind IN ('new', 'open')").select(*_COLUMNS)
            self.look(fresh)
            self._store(path, fresh)
        return scanned.where("kind <> 'new'")

    def _store(self, path: str, rows: DataFrame) -> None:
        """Levels as full as the new one merge with it, from the smallest on."""
        spark, level, old = rows.sparkSession, 0, []
        while level in self.levels:
            old.append(self.levels.pop(level))
            rows = rows.unionByName(self.read(spark, old[-1]))
            level += 1
        self.levels[level] = path
        if old:
            self.levels[level] = scratch(spark)
            rows.repartition("lead").sortWithinPartitions("lead", "whole", "doc_id", "place").write.parquet(self.levels[level])
            for x in [path, *old]:
                self._forget(spark, x)

    def read(self, spark, path: str) -> DataFrame:
        if path not in self.scans:
            return spark.read.schema(_SCHEMA).parquet(path)
        rows = spark.read.schema(f"{_SCHEMA}, fresh int, kind string").parquet(path)
        return rows.where("fresh = 1 AND kind IN ('new', 'open')").select(*_COLUMNS)

    def _forget(self, spark, path: str) -> None:
        """Of a scan, its ``again`` and ``open`` rows stay: they are the result."""
        drop_written(spark, f"{path}/kind=new" if path in self.scans else path)

    def drop(self, spark) -> None:
        for path in self.levels.values():
            self._forget(spark, path)
        self.levels = {}


def _fetch(batches, length: int):
    """Bytes of the reach of open entries; for hot leads one row for each string."""
    for batch in batches:
        out = {"lead": [], "doc_id": [], "place": [], "bytes": []}
        for i in range(batch.num_rows):
            text, doc_id = batch.column(1)[i].as_py(), batch.column(0)[i].as_py()
            for entry in batch.column(2)[i].as_py():
                place, back, ahead = entry["place"] >> 14, entry["place"] >> 7 & 127, entry["place"] & 127
                reach = text[place - back : place + ahead]
                if entry["hot"]:
                    for at in range(len(reach) - length + 1):
                        out["lead"].append(entry["lead"])
                        out["doc_id"].append(doc_id)
                        out["place"].append(-1 - (place - back + at))
                        out["bytes"].append(hashlib.blake2b(reach[at : at + length], digest_size=16).digest())
                else:
                    out["lead"].append(entry["lead"])
                    out["doc_id"].append(doc_id)
                    out["place"].append(place - back)
                    out["bytes"].append(reach)
        if out["lead"]:
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("lead", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("bytes", pa.binary())]))


def _compare(batches, length: int):
    """Repeated strings among open entries sorted by lead, doc_id and place."""
    held: list[tuple] = []

    def repeats(rows):
        sizes = np.fromiter((len(r[3]) for r in rows), np.int64, len(rows))
        at = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        n = sizes - length + 1
        row = np.repeat(np.arange(len(rows)), n)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        marks = Prefixes(data).each(length)[at[row] + inner]
        doc = np.fromiter((r[1] for r in rows), np.int64, len(rows))[row]
        start = np.fromiter((r[2] for r in rows), np.int64, len(rows))[row] + inner
        group = np.fromiter((r[0] for r in rows), np.int64, len(rows))[row]
        order = np.lexsort((start, doc, marks, group))
        same = (marks[order[1:]] == marks[order[:-1]]) & (group[order[1:]] == group[order[:-1]])
        again = order[1:][same]
        if len(again):
            d, s, e = _merged(doc[again], start[again], start[again] + length)
            yield pa.RecordBatch.from_pydict({"doc_id": d, "start": s, "end": e})

    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(held) >= STEP and r[0] != held[-1][0]:
                yield from repeats(held)
                held = []
            held.append(r)
    if held:
        yield from repeats(held)


def _cut(batches):
    """Documents without their removed stretches: sizes and the hash of what is left."""
    for batch in batches:
        out = {"doc_id": batch.column(3).to_pylist(), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for i in range(batch.num_rows):
            text = batch.column(1)[i].as_py()
            spans = batch.column(2)[i].as_py() or []
            digest, end, removed, runs = hashlib.sha256(), 0, 0, 0
            for s in sorted((s["start"], s["end"]) for s in spans):
                if s[0] > end or not runs:
                    digest.update(text[end : s[0]])
                    runs += 1
                    removed += s[1] - s[0]
                else:
                    removed += max(0, s[1] - end)
                end = max(end, s[1])
            digest.update(text[end:])
            for k, v in (("n_bytes", len(text)), ("n_removed", removed), ("n_spans", runs), ("kept_sha256", digest.hexdigest())):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict(out)


def _documents(docs: DataFrame) -> DataFrame:
    """``doc_id, text, own``: bytes under a unique ``doc_id`` in the order of the rows' ``own`` ids."""
    texts = docs_only(docs, "doc_id", "text").select("doc_id", F.encode("text", "UTF-8").alias("text"), F.col("doc_id").alias("own"))
    if texts.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return texts
    digest = F.xxhash64("text")
    dealt = texts.repartitionByRange("own", digest).sortWithinPartitions("own", digest)
    path = scratch(docs.sparkSession)
    dealt.withColumn("doc_id", F.when(F.col("own").isNotNull(), F.monotonically_increasing_id())).write.parquet(path)
    return docs.sparkSession.read.schema(texts.schema).parquet(path)


def repeated_spans(texts: DataFrame, *, length: int = LENGTH, batches: int = 4) -> DataFrame:
    """``found`` rows of all batches' scans (written) of ``texts(doc_id, text)`` with unique ids."""
    spark = texts.sparkSession
    shares = [PILOT + (1 - PILOT) * i / (batches - 1) for i in range(batches - 1)] if batches > 1 else []
    bounds = sorted({int(x) for x in texts.approxQuantile("doc_id", shares, PILOT / 4)}) if shares else []
    index, found = SuffixIndex(), None
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        batch = texts.where("doc_id IS NOT NULL")
        if low is not None:
            batch = batch.where(F.col("doc_id") > low)
        if high is not None:
            batch = batch.where(F.col("doc_id") <= high)
        scanned = index.add(entries(batch, length=length), keep=high is not None)
        found = scanned if found is None else found.unionByName(scanned)
    index.drop(spark)
    return found


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, batches: int = 4, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    if not LEAD < length <= 127:
        raise ValueError(f"length must be over {LEAD} and at most 127")
    texts = _documents(docs)
    found = repeated_spans(texts, length=length, batches=batches)
    again = found.where("kind = 'again'")
    place, back, ahead = F.shiftright("place", 14), F.shiftright("place", 7).bitwiseAND(127), F.col("place").bitwiseAND(127)
    sure = again.select("doc_id", F.coalesce(F.when(F.col("until").isNotNull(), F.col("place")), place - back).alias("start"), F.coalesce("until", place + ahead).alias("end"))

    pending = found.where("kind = 'open'").select("lead", "doc_id", "place").distinct()
    often = pending.groupBy("lead").count().where(F.col("count") > hot).select("lead", F.lit(True).alias("hot"))
    pending = pending.join(often, "lead", "left").select("doc_id", F.struct("lead", "place", F.coalesce("hot", F.lit(False)).alias("hot")).alias("entry"))
    wanted = pending.groupBy("doc_id").agg(F.collect_list("entry").alias("entries"))
    fetched = texts.select("doc_id", "text").join(wanted, "doc_id").mapInArrow(lambda b: _fetch(b, length), "lead long, doc_id long, place long, bytes binary")
    by_lead = fetched.where("place >= 0").repartition("lead").sortWithinPartitions("lead", "doc_id", "place")
    compared = by_lead.mapInArrow(lambda b: _compare(b, length), "doc_id long, start long, end long")
    strings = fetched.where("place < 0").select("lead", "bytes", "doc_id", (-1 - F.col("place")).alias("start"))
    first = strings.groupBy("lead", "bytes").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hot_again = strings.join(first, ["lead", "bytes"]).where("struct(doc_id, start) <> first").select("doc_id", "start", (F.col("start") + length).alias("end"))

    spans = sure.unionByName(compared).unionByName(hot_again)
    per_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return texts.join(per_doc, "doc_id", "left").select("doc_id", "text", "spans", "own").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
