"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts become lists of lower-cased words (letters and digits).  A mask picks words of a short
stretch and ignores the others, so a replaced word under an ignored place doesn't hide a copy.
Hashes of all stretches of the benchmark under the mask join those of the documents; hits give
alignments (item, document, shift).  The mask is chosen with a number of hits that every
overlap within the limits has (:func:`seeding`), so no overlap is lost.  Each alignment is then
verified word by word: its longest stretch that begins and ends with equal words, has at least
``min_words`` words and agrees in ``similarity`` of them.  An item of fewer than ``min_words`` words matches
where all of it stands, word for word.

Defined cases: null and empty texts have no words and never match; equal items are reported each; several
alignments of one pair give the one with the most equal words (then the earliest in the document); rows
that repeat an id are matched each by itself, and the id is reported once with each item; rows without an id are not reported, but
``decontaminate`` drops them like any other; an empty table on either side gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import docs_only, written

MIN_WORDS = 10
SIMILARITY = 0.8
#: Words looked at within a stretch, and the hits that any overlap within the default limits has at least.
MASK, HITS = "1101", 2
#: Benchmark hashes that may be broadcast: 24 bytes each, so some 50 MB at most.
BROADCAST_ROWS = 2_000_000


def words(text: Column) -> Column:
    """The words of a text."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def seeding(min_words: int, similarity: float) -> tuple[str, int]:
    """A mask, and how often it hits in any stretch of ``min_words`` words or more that agrees in ``similarity``.

    A stretch cut into parts of 10 to 19 words has a part that agrees in as large a share, and of all
    patterns of such a part none has fewer than ``HITS`` hits (tested).  Looser limits take the
    run of equal words that the misses must leave somewhere.
    """
    if min_words >= MIN_WORDS and similarity >= SIMILARITY:
        return MASK, HITS
    runs = []
    for n in range(max(min_words, 1), max(min_words, 1) + 1000):
        same = max(1, math.ceil(n * similarity - 1e-9))
        runs.append(-(-same // (n - same + 1)))
    return "1" * min(runs), 1


def seed_rows(texts: DataFrame, mask: str, *keys: str) -> DataFrame:
    """``keys, place, seed`` of ``texts(keys, words)``: one row for each stretch under the mask.

    Shifted copies of the words stand side by side before the rows are made, which stays in generated
    code; a function called for each place would not.
    """
    picked = [i for i, c in enumerate(mask) if c == "1"]
    shifted = F.arrays_zip(*(F.slice("words", F.lit(i + 1), F.size("words")).alias(f"w{i}") for i in picked))
    found = texts.where(F.size("words") >= len(mask)).select(*keys, F.posexplode(shifted).alias("place", "w"))
    # The last places lack words.
    return found.where(F.col(f"w.w{picked[-1]}").isNotNull()).select(*keys, "place", F.xxhash64(*(f"w.w{i}" for i in picked)).alias("seed"))


def _longest(hits: Column, similarity: float) -> Column:
    """The longest stretch of an array of booleans that begins and ends with a hit and has ``similarity`` hits: struct ``start, end``.

    With ``p`` the sums of (hit - similarity), in millionths, it is the longest with ``p[start] <= p[end]``:
    the least ``p`` of starts so far and the largest of ends yet to come meet in one walk.
    """
    part = round(similarity * 1_000_000)
    none = 1 << 62

    def sums(hits: Column, gain: Column, lose: Column) -> Column:
        """For each place: its sum if the word there is equal, and the running bound."""
        zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(none).alias("bound"), F.array().cast("array<bigint>").alias("all"))

        def step(acc: Column, hit: Column) -> Column:
            bound = F.when(hit & (acc["sum"] < acc.bound), acc["sum"]).otherwise(acc.bound)
            return F.struct((acc["sum"] + F.when(hit, gain).otherwise(lose)).alias("sum"), bound.alias("bound"), F.concat(acc["all"], F.array(bound)).alias("all"))

        return F.aggregate(hits, zero, step)

    # From the other end the sums of what is left, so that p[end] = total - rest: its least is p's largest.
    gain, lose = F.lit(1_000_000 - part).cast("long"), F.lit(-part).cast("long")
    left, right = sums(hits, gain, lose), sums(F.reverse(hits), gain, lose)
    zero = F.struct(left["all"].alias("low"), F.reverse(right["all"]).alias("rest"), left["sum"].alias("total"), *(F.lit(0).alias(c) for c in ("i", "j", "start", "end")))

    def walk(acc: Column, _: Column) -> Column:
        low, rest = F.get(acc.low, acc.i), F.get(acc.rest, acc.j)
        # Past the end either is null and nothing moves.
        fits = (low < none) & (rest < none) & (low <= acc.total - rest)
        longer = fits & (acc.j + 1 - acc.i > acc.end - acc.start)
        return F.struct(
            acc.low.alias("low"),
            acc.rest.alias("rest"),
            acc.total.alias("total"),
            F.when(fits, acc.i).otherwise(acc.i + 1).alias("i"),
            F.when(fits, acc.j + 1).otherwise(acc.j).alias("j"),
            F.when(longer, acc.i).otherwise(acc.start).alias("start"),
            F.when(longer, acc.j + 1).otherwise(acc.end).alias("end"),
        )

    return F.aggregate(F.sequence(F.lit(1), 2 * F.size(hits)), zero, walk, lambda acc: F.struct(acc.start.alias("start"), acc.end.alias("end")))


def _overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """``doc_id, digest, item_id, doc_start, item_start, n_words, n_same``: the best verified overlap of each text with each item.

    ``digest`` is a hash of the text, which tells apart the rows of one id.
    """
    mask, least = seeding(min_words, similarity)
    items = docs_only(benchmark, "item_id", "text").select("item_id", words(F.col("text")).alias("words"))
    items = written(items.where(F.size("words") > 0).select(F.monotonically_increasing_id().alias("item"), "item_id", "words"))
    texts = docs_only(docs, "doc_id", "text").withColumn("digest", F.xxhash64("text"))
    cut = texts.select("doc_id", "digest", words(F.col("text")).alias("words"))

    # Items shorter than the mask have masks of their own, as long as they are.
    short = sorted(r.n for r in items.where(F.size("words") < len(mask)).select(F.size("words").alias("n")).distinct().collect())
    found = None
    for m, some in [(mask, items.where(F.size("words") >= len(mask))), *(("1" * n, items.where(F.size("words") == n)) for n in short)]:
        tests = written(seed_rows(some, m, "item").select("seed", "item", F.col("place").alias("item_place")))
        met = seed_rows(cut, m, "doc_id", "digest").join(F.broadcast(tests) if tests.count() <= BROADCAST_ROWS else tests, "seed")
        hits = met.groupBy("doc_id", "digest", "item", (F.col("place") - F.col("item_place")).alias("shift")).agg(F.count(F.lit(1)).alias("hits"))
        found = hits if found is None else found.unionByName(hits)
    whole = F.size("words") < min_words
    need = F.when(whole, F.least(F.lit(least), F.greatest(F.lit(1), F.size("words") - len(mask) + 1))).otherwise(least)
    sizes = items.select("item", need.alias("need"), F.when(whole, F.size("words")).alias("all"))
    aligned = written(found.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes, "item").where("hits >= need").select("doc_id", "digest", "item", "shift", "all"))

    wanted = written(aligned.select(F.col("doc_id").alias("id"), F.col("digest").alias("d")).distinct())
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    # Equal rows are one text.
    same = texts.join(few, texts.doc_id.eqNullSafe(few.id) & (texts.digest == few.d), "left_semi").groupBy("doc_id", "digest").agg(F.min("text").alias("text"))
    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    doc_words = same.select(F.col("doc_id").alias("id"), F.col("digest").alias("d"), hashed(words(F.col("text"))).alias("doc_words"))
    pairs = aligned.join(items.select("item", "item_id", hashed(F.col("words")).alias("item_words")), "item")
    pairs = pairs.join(doc_words, pairs.doc_id.eqNullSafe(doc_words.id) & (pairs.digest == doc_words.d))
    first = F.greatest(F.lit(0), -F.col("shift"))
    last = F.least(F.size("item_words"), F.size("doc_words") - F.col("shift")) - 1
    pairs = pairs.withColumn("first", first).withColumn("last", last).where("first <= last")
    hits = F.transform(F.sequence("first", "last"), lambda i: F.get("item_words", i) == F.get("doc_words", i + F.col("shift")))
    run = pairs.select("doc_id", "digest", "item_id", "shift", "all", "first", hits.alias("hits")).withColumn("run", _longest(F.col("hits"), similarity))
    start, size = F.col("first") + F.col("run.start"), F.col("run.end") - F.col("run.start")
    equal = F.size(F.filter(F.slice("hits", F.col("run.start") + 1, size), lambda hit: hit))
    run = run.select("doc_id", "digest", "item_id", "all", (start + F.col("shift")).alias("doc_start"), start.alias("item_start"), size.alias("n_words"), equal.alias("n_same"))
    run = run.where((F.col("n_words") >= max(min_words, 1)) | (F.col("n_same") == F.col("all")))
    best = run.groupBy("doc_id", "digest", "item_id").agg(F.max(F.struct("n_same", (-F.col("doc_start")).alias("early"), "item_start", "n_words")).alias("x"))
    return best.select("doc_id", "digest", "item_id", (-F.col("x.early")).alias("doc_start"), "x.item_start", "x.n_words", "x.n_same")


def contaminated(docs: DataFrame, benchmark: DataFrame, *, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, item_id, doc_start, item_start, n_words, n_same``: the best verified overlap of a pair of ids."""
    found = _overlaps(docs, benchmark, min_words, similarity).where("doc_id IS NOT NULL AND item_id IS NOT NULL")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_same", (-F.col("doc_start")).alias("early"), "item_start", "n_words")).alias("x"))
    return best.select("doc_id", "item_id", (-F.col("x.early")).alias("doc_start"), "x.item_start", "x.n_words", "x.n_same")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that hold a passage of the benchmark."""
    found = written(_overlaps(docs, benchmark, min_words, similarity).select(F.col("doc_id").alias("id"), F.col("digest").alias("d")).distinct())
    keyed = docs.withColumn("__digest", F.xxhash64(F.coalesce("text", F.lit(""))))
    return keyed.join(found, keyed["doc_id"].eqNullSafe(found["id"]) & (keyed["__digest"] == found["d"]), "left_anti").drop("__digest")
