"""SimHash near-duplicates by multi-index hashing.

Every document gets a 64-bit fingerprint of its word shingles.  Two fingerprints with at most
three differing bits differ by at most one bit in one of their two 32-bit halves.  So each
half is a table; a search enumerates the Hamming ball of radius one around a half, fetches
the table's matches and verifies the whole distance.  Work is on *distinct* fingerprints: copies
share one row, so no group of copies is ever paired with itself.

Of the two directions of a pair whose halves differ in one bit only the one that holds a 0
there probes, so a pair is met once for each matching half and a ball has 17 keys on average.

Defined cases: null text is empty text; a text without words has fingerprint zero and links like
any other; fewer words than a shingle give one shingle of all words; repeated rows keep their
rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_only, drop_written, map_rows, scratch, written
from .components import components, labels

SEED = 42
DISTANCE = 3
#: Shingles whose bits are counted at once, so that a long text needs little memory.
CHUNK = 1 << 14


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text, as an unsigned integer."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    count = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)), ">u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > len(starts)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, *, words: int = 3) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed 64-bit integer."""
    return map_rows(docs_only(docs, "doc_id", "text"), lambda: lambda doc_id, text: (doc_id, signed(fingerprint(text, words))), "doc_id long, fp long")


def links(distinct: DataFrame, *, distance: int = DISTANCE) -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints ``fp`` with at most ``distance`` <= 3 bits apart."""
    if not 0 <= distance <= 3:
        raise ValueError("two halves with balls of radius one hold for distances up to 3")
    halves = F.array(F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    table = distinct.select("fp", F.posexplode(halves).alias("half", "key"))
    bits = F.array(*(F.lit(1 << i).cast("long") for i in range(32)))
    flips = F.filter(bits, lambda b: F.col("key").bitwiseAND(b) == 0)
    ball = F.concat(F.array("key"), F.transform(flips, lambda b: F.col("key").bitwiseOR(b)))
    probes = table.select(F.col("fp").alias("probe"), "half", F.col("key").alias("own"), F.explode(ball).alias("key"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("probe"))) <= distance
    once = (F.col("key") != F.col("own")) | (F.col("probe") < F.col("fp"))  # equal halves meet twice
    met = probes.join(table, ["half", "key"]).where((F.col("fp") != F.col("probe")) & near & once)
    return met.select(F.least("fp", "probe").alias("a"), F.greatest("fp", "probe").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, words: int = 3, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fingerprint, component_id, n_links`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links; ``n_links`` counts other
    fingerprints linked to the row's own.
    """
    fps = written(fingerprints(docs, words=words))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    edges = written(links(distinct.select("fp"), distance=distance))
    found = components(edges)
    degree = edges.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    linked = distinct.join(found, distinct.fp == found.node, "left").join(degree, "fp", "left")
    linked = linked.select("fp", "first", F.coalesce("component", "fp").alias("component"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    smallest = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    known = linked.join(smallest, "component").select("fp", "component_id", "n_links")
    return fps.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


#: Near copies: words of an index shingle, index segments of 32 bits, 64-bit words to verify.
INDEX_WORDS, SEGMENTS, VERIFY = 2, 24, 32
#: Least certain bits of a segment that a probe may flip, all subsets of them.
FLIPS = 2
#: Members of the largest group under its keys that a text meets before it meets all of them.
MEMBERS = 8
#: Texts of a group that is large: it asks as a whole, and whoever it asks meets all of its texts.
LARGE = 64
#: Members of a key that meet as many others at once (70 KB), and blocks of a key that one task meets.
BLOCK, DEAL = 256, 16
#: Texts of either side whose shingles meet at once: a few MB, as most texts are.
MET = 64
#: Texts to compare by their shingles whose ids may be broadcast: 24 bytes each.
BROADCAST_ROWS = 1_000_000


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """(k, len(h)): ``k`` independent 64-bit hashes made of each hash."""
    x = h + np.arange(1, k + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bits of each byte, the highest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32)


def _counted(x: np.ndarray) -> np.ndarray:
    """(k, 64): how many of the 64-bit words of each row of ``x`` have each bit, the highest first."""
    k, n = x.shape
    if n <= 500:
        lanes = np.arange(8 * k).reshape(k, 1, 8) * 256
        seen = np.bincount((x.astype(">u8").view(np.uint8).reshape(k, n, 8) + lanes).ravel(), minlength=k * 2048)
        return (seen.reshape(8 * k, 256).astype(np.float32) @ _BITS).reshape(k, 64).astype(np.int64)
    # Three words of one weight become one of it and one of twice that, until two words are left.
    total, weight = np.zeros((k, 64), np.int64), 1
    while x.shape[1]:
        twice = [x[:, :0]]
        while (m := x.shape[1] // 3) > 0:
            a, b, c = x[:, :m], x[:, m : 2 * m], x[:, 2 * m : 3 * m]
            odd = a ^ b
            twice.append((a & b) | (odd & c))
            x = np.concatenate([odd ^ c, x[:, 3 * m :]], axis=1)
        bits = np.unpackbits(x.astype(">u8").view(np.uint8).reshape(k, -1, 8), axis=2)
        total += weight * bits.sum(axis=1, dtype=np.int64)
        x, weight = np.concatenate(twice, axis=1), 2 * weight
    return total


def _balance(h: np.ndarray, k: int) -> np.ndarray:
    """Of 64 * k bits of distinct shingles: how many more ones than zeros, by bit."""
    return 2 * sum(_counted(_mixed(h[at : at + CHUNK], k)) for at in range(0, len(h), CHUNK)).ravel() - len(h)


def _shingles(tokens: list[bytes], words: int) -> np.ndarray:
    """Hashes of the distinct shingles; fewer words make one shingle."""
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(b" ".join(tokens), SEED)], np.uint64)
    grams = {b" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)}
    return np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(grams))


def wide(text: str | None, words: int) -> tuple[list[int], list[int], bytes]:
    """Key of each segment, the places of its least certain bits (five bits each) and the bits to verify."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    index = _balance(_shingles(tokens, INDEX_WORDS), SEGMENTS // 2).reshape(SEGMENTS, 32)
    keys = ((index > 0) << np.arange(32)).sum(axis=1) + (np.arange(SEGMENTS) << 32)
    doubtful = np.argsort(np.abs(index), axis=1, kind="stable")[:, :FLIPS]
    packed = (doubtful << 5 * np.arange(FLIPS)).sum(axis=1)
    return keys.tolist(), packed.tolist(), np.packbits(_balance(_shingles(tokens, words), VERIFY) > 0).tobytes()


def _balls(entries: DataFrame) -> DataFrame:
    """``node, key``: of ``entries(node, key, flips)``, all keys that flip some of the least certain bits."""
    flipped = " | ".join(f"shiftleft(CAST(shiftright(c, {i}) & 1 AS BIGINT), shiftright(flips, {5 * i}) & 31)" for i in range(FLIPS))
    subsets = F.array(*(F.lit(c) for c in range(1 << FLIPS)))
    return entries.withColumn("c", F.explode(subsets)).select("node", F.expr(f"key ^ ({flipped})").alias("key"))


def _near(a: pa.Array, b: pa.Array, far: np.ndarray, most: int) -> pa.RecordBatch:
    at = pa.array(np.flatnonzero(far <= most))
    return pa.RecordBatch.from_arrays([a.take(at), b.take(at), pa.array(far, pa.int32()).take(at)], ["a", "b", "distance"])


def _across(table: DataFrame, asks: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """``a, b, component, distance``: of each text that asks and each other group under a key the nearest pair, if at most ``most`` bits apart.

    Both sides have ``key, node, component``.  Under each key they meet in blocks of about ``BLOCK`` members, and
    ``table``'s blocks are dealt by ``DEAL``, each deal to a task of its own; so no row is made for a pair that is far
    apart, a hot key is met by many tasks, and only the blocks of keys over ``BLOCK * DEAL`` members are repeated.
    """
    keys = table.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("n"))
    asked = written(asks.join(keys, "key").where("component <> least OR component <> most").select("key", "node", "component"))

    def blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
        block = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK))
        rows = rows.join(sizes.select("key", "n"), "key").withColumn("block", block).join(classes.select("node", "bits"), "node")
        return rows.groupBy("key", "block").agg(F.collect_list(F.struct("node", "component", "bits")).alias("rows"))

    counts = asked.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    deals = keys.select("key", F.explode(F.sequence(F.lit(0), F.expr(f"CAST((n - 1) div {BLOCK * DEAL} AS INT)"))).alias("deal"))
    one = blocks(asked, counts).select("key", F.col("rows").alias("one")).join(deals, "key")
    two = blocks(table.join(counts.select("key"), "key", "left_semi"), keys).select("key", F.expr(f"CAST(block div {DEAL} AS INT)").alias("deal"), F.col("rows").alias("two"))
    met = one.join(two, ["key", "deal"]).select("one", "two")

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                sides = []
                for c in (0, 1):
                    rows = batch.column(c)[i].values
                    bits = np.frombuffer(b"".join(rows.field(2).to_pylist()), np.uint64).reshape(-1, VERIFY)
                    sides.append((rows.field(0).to_numpy(), rows.field(1).to_numpy(), bits))
                (a, a_group, a_bits), (b, b_group, b_bits) = sides
                for k in range(len(a)):
                    other = np.flatnonzero(b_group != a_group[k])
                    far = np.bitwise_count(b_bits[other] ^ a_bits[k]).sum(axis=1, dtype=np.int32)
                    at = np.flatnonzero(far <= most)
                    if len(at):
                        # The nearest of each group.
                        at = at[np.lexsort((far[at], b_group[other[at]]))]
                        groups, first = np.unique(b_group[other[at]], return_index=True)
                        yield pa.RecordBatch.from_pydict({"a": np.full(len(first), a[k]), "b": b[other[at[first]]], "component": groups, "distance": far[at[first]]})

    return met.mapInArrow(compare, "a long, b long, component long, distance int")


def _sets(texts: DataFrame, classes: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``node, shingles`` (distinct, sorted) of the texts of ``nodes(node)``."""
    wanted = written(nodes.distinct().join(classes.select("node", F.col("doc_id").alias("id"), F.col("digest").alias("d")), "node"))
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = texts.join(few, texts.doc_id.eqNullSafe(few.id) & (texts.digest == few.d)).select("node", "text")

    def one(node, text):
        return node, np.sort(_shingles(text.encode("utf-8", "surrogatepass").lower().split(), words).view(np.int64)).tolist()

    return written(map_rows(texts, lambda: one, "node long, shingles array<long>").dropDuplicates(["node"]))


def _any_of_group(asked: DataFrame, members: DataFrame, texts: DataFrame, classes: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links ``a, b``: of each ``asked(a, component)`` and some text of the group that shares enough of its shingles, if one does.

    ``members`` has ``node, component``.  Both sides meet in blocks, so no row is made for a pair, and no group meets in one task.
    """
    members = members.join(asked.select("component").distinct(), "component", "left_semi")
    sets = _sets(texts, classes, asked.select(F.col("a").alias("node")).unionByName(members.select("node")), words)

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        rows = rows.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / MET))).join(sets, "node")
        return rows.groupBy("component", "block").agg(F.collect_list(F.struct("node", "shingles")).alias(name)).drop("block")

    met = blocks(asked.select(F.col("a").alias("node"), "component"), "one").join(blocks(members, "two"), "component").select("one", "two")

    def check(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one, two = (batch.column(c)[i].values for c in (0, 1))
                flat, ends = two.field(1).flatten().to_numpy(), two.field(1).offsets.to_numpy()
                sizes, starts, nodes = np.diff(ends), ends[:-1] - ends[0], two.field(0).to_numpy()
                for a, own in zip(one.field(0).to_pylist(), one.field(1), strict=True):
                    own = own.values.to_numpy()
                    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                    both = np.add.reduceat((own[at] == flat).astype(np.int64), starts)
                    hit = np.flatnonzero((both >= similarity * (sizes + len(own) - both)) & (nodes != a))
                    if len(hit):
                        yield pa.RecordBatch.from_pydict({"a": [a], "b": [int(nodes[hit[0]])]})

    return met.mapInArrow(check, "a long, b long")


def _rows(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """``doc_id, digest, copies, first``: each row's group, as the struct ``none, doc_id, digest`` of its first row.

    ``none`` marks a null id and sorts it last; ``digest`` is a hash of the text and ``copies`` how many rows
    have both.
    """
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    most, doubt = round(64 * VERIFY * share), round(3 * (64 * VERIFY * share * (1 - share)) ** 0.5)
    texts = docs_only(docs, "doc_id", "text").withColumn("digest", F.xxhash64("text"))
    path = scratch(docs.sparkSession)
    seen = written(map_rows(texts, lambda: lambda doc_id, text, digest: (doc_id, digest, *wide(text, words)), "doc_id long, digest long, keys array<long>, flips array<int>, bits binary"), path)
    whole = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "keys", "flips")
    classes = seen.groupBy("bits").agg(F.min(whole).alias("x"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "bits", "x.*"))
    # Behind this the rows need no more than 128 bits to find their class.
    short = [F.xxhash64("bits").alias("h1"), F.xxhash64("bits", F.lit(1)).alias("h2")]
    seen = written(seen.select("doc_id", "digest", *short))
    drop_written(docs.sparkSession, path)
    entries = classes.select("node", F.explode(F.arrays_zip("keys", "flips")).alias("e")).select("node", "e.keys", "e.flips").withColumnRenamed("keys", "key")

    def compared(met: DataFrame) -> DataFrame:
        """Those pairs ``met(a, b)`` that may be near, with their ``distance``."""
        sides = [classes.select(F.col("node").alias(c), F.col("bits").alias(f"{c}_bits")) for c in ("a", "b")]
        rows = met.join(sides[0], "a").join(sides[1], "b").select("a", "b", "a_bits", "b_bits")

        def distances(batches):
            for batch in batches:
                one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, VERIFY) for i in (2, 3))
                far = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int32)
                yield _near(batch.column(0), batch.column(1), far, most + doubt)

        return rows.mapInArrow(distances, "a long, b long, distance int")

    links: list[DataFrame] = []

    def joined(near: DataFrame, whole: bool = True) -> DataFrame | None:
        """Labels of groups from all pairs so far and those of ``near`` that are near; unless ``whole``, a group may have several."""
        near = written(near)
        if not near.isEmpty():
            more = similar(texts, classes, near.where(F.col("distance") >= most - doubt), words, similarity)
            links.append(written(near.where(F.col("distance") < most - doubt).select("a", "b").unionByName(more)))
        if not links:
            return None
        every = reduce(DataFrame.unionByName, links)
        return written(components(every) if whole else labels(every)).where("node <> component")

    def of(rows: DataFrame, known: DataFrame | None) -> DataFrame:
        """``rows`` with the component of ``node``."""
        return rows.join(known, "node", "left").withColumn("component", F.coalesce("component", "node")) if known else rows.withColumn("component", F.col("node"))

    # A key's least node first: a group of near copies becomes one in proportion to its size.
    keys = entries.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("last"))
    known = joined(compared(entries.join(keys, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()), whole=False)
    # Balls are looked up once; a key that only its own node has is of no use to it.
    hits = written(_balls(entries).join(keys, "key").where("node <> b OR node <> last").select("key", "node"))

    # What is left of a group then meets some members of the largest group under its keys.
    asking = of(hits, known)
    if known:
        asking = asking.join(known.groupBy("component").count().where(F.col("count") >= LARGE).select("component"), "component", "left_anti")
    table = of(entries.select("key", "node"), known)
    salts = table.groupBy("key", "component", F.pmod(F.xxhash64("node"), F.lit(MEMBERS)).alias("salt")).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("b"))
    groups = salts.groupBy("key", "component").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("b")).alias("b"))
    largest = groups.groupBy("key").agg(F.max(F.struct("n", "component", "b")).alias("x")).select("key", F.col("x.component").alias("other"), "x.b")
    member = F.get("b", F.pmod(F.xxhash64("node", "key"), F.size("b")).cast("int"))
    asks = asking.join(largest, "key").where("component <> other").select(F.col("node").alias("a"), member.alias("b"), "other")
    some = asks.groupBy("a", "other", F.pmod(F.xxhash64("b"), F.lit(MEMBERS))).agg(F.min("b").alias("b")).select("a", "b").distinct()
    known = joined(compared(some))
    # At last each text meets all under its keys that are in another group.  A large group asks once a key, for all its texts:
    # whoever it meets there is compared with every one of them.
    table, before = of(entries.select("key", "node"), known), of(classes.select("node"), known)
    if known:
        large = written(known.groupBy("component").count().where(F.col("count") >= LARGE - 1).select("component"))
        asks = of(hits, known)
        met = _across(table, asks.join(large, "component", "left_anti"), classes, most + doubt)
        whole = asks.join(large, "component", "left_semi").select("key", F.col("component").alias("group")).distinct()
        asked = whole.join(table, "key").where("component <> group").select(F.col("group").alias("key"), "node", "component").distinct()
        groups = before.join(large, "component", "left_semi").select(F.col("component").alias("key"), "node", "component")
        met = met.unionByName(_across(groups, asked, classes, most + doubt))
    else:
        met = _across(table, of(hits, None), classes, most + doubt)
    # Of each text and other group the nearest pair is checked first; where it isn't near, the whole group.
    met = written(met.groupBy("a", "component").agg(F.min(F.struct("distance", "b")).alias("x")).select("a", "x.b", "component", "x.distance"))
    known = joined(met.select("a", "b", "distance"))
    doubtful = met.where(F.col("distance") >= most - doubt)
    if not doubtful.isEmpty():
        many = before.groupBy("component").count().where("count > 1").select("component")
        ends = [of(classes.select("node"), known).select(F.col("node").alias(c), F.col("component").alias(f"{c}_now")) for c in ("a", "b")]
        rest = doubtful.join(many, "component", "left_semi").join(ends[0], "a").join(ends[1], "b").where("a_now <> b_now").select("a", "component")
        links.append(written(_any_of_group(written(rest), before, texts, classes, words, similarity)))
        known = written(components(reduce(DataFrame.unionByName, links))).where("node <> component")

    linked = of(classes.select("node", *short, "none", "doc_id", "digest"), known)
    first = linked.groupBy("component").agg(F.min(F.struct("none", "doc_id", "digest")).alias("first"))
    rows = seen.groupBy("h1", "h2", "doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    return rows.join(linked.select("h1", "h2", "component"), ["h1", "h2"]).join(first, "component").select("doc_id", "digest", "copies", "first")


def near_copies(docs: DataFrame, *, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id, component_id`` of texts that share a part ``similarity`` of their word shingles.

    Jaccard similarity ``s`` of shingle sets is cosine ``2s / (1 + s)``, an angle that SimHash measures as
    a share of differing bits.  At 0.8 that is 15 %, too many for a short fingerprint, so the
    complete fingerprint has 2,048 bits and the index has 24 32-bit segments of shorter shingles,
    which a change of one word disturbs less.  A probe enumerates, in each segment, the ball of
    keys that flip its ``FLIPS`` least certain bits.

    Every text is compared with all others under its keys, or is in one group with them already.  Groups are
    contracted in between: own keys meet the least member of a key, then balls some members of
    the largest group under a key, and at last all members that are in another group by then.  There a group of ``LARGE`` texts or more
    asks as a whole, and whoever has one of its texts' keys meets all of them.  Of a text and a group that it meets only
    the nearest pair becomes a row; where that one is in doubt and turns out not to be near, the text's shingles are compared
    with those of the whole group.  So a large group of near copies costs comparisons in proportion to its size; only texts of one
    template that are no near copies of each other meet pairwise, in blocks.  Complete distances decide, but for those within three standard deviations of the limit: there
    the shingles themselves are compared.

    Rows of one id and text are one row; ``component_id`` is null where no row of a group has an id.
    """
    return _rows(docs, words, similarity).select("doc_id", F.col("first.doc_id").alias("component_id"))


def similar(texts: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` of nodes whose texts share enough of their distinct shingles."""
    sets_of = _sets(texts, classes, pairs.select(F.explode(F.array("a", "b")).alias("node")), words)
    sides = [sets_of.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set")) for c in ("a", "b")]
    both = F.size(F.array_intersect("a_set", "b_set"))
    rows = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b")
    return rows.where(both >= similarity * (F.size("a_set") + F.size("b_set") - both)).select("a", "b")


def keep_one(docs: DataFrame, *, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each group of near copies.

    Rows that repeat an id and a text are copies like any other: one of them stays.  A row without an id stays
    only where its group has none with one.
    """
    rows = written(_rows(docs, words, similarity))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest").eqNullSafe(F.col("first"))
    keyed = docs.withColumn("__digest", F.xxhash64(F.coalesce("text", F.lit(""))))

    def same(ids: DataFrame):
        return keyed["doc_id"].eqNullSafe(ids["id"]) & (keyed["__digest"] == ids["digest"])

    # The dropped are fewer than the kept, so their list is the cheaper one to join.
    dropped = written(rows.where(~first).select(F.col("doc_id").alias("id"), "digest"))
    repeated = written(rows.where(first & (F.col("copies") > 1)).select(F.col("doc_id").alias("id"), "digest"))
    kept = keyed.join(dropped, same(dropped), "left_anti")
    if not repeated.isEmpty():
        once = keyed.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "__digest"])
        kept = kept.join(repeated, same(repeated), "left_anti").unionByName(once)
    return kept.drop("__digest")
