"""Mixing sources to target weights by a Pfair schedule.

Each source's documents form blocks in doc_id order.  Block ``j`` of a source with weight ``w`` has
release time ``floor(j / w)`` and deadline ``ceil((j + 1) / w)``; in each slot the released
block with the earliest deadline goes next.  At any slot each source is then less than one
block away from its share.

Weights are exact fractions of their sum, whatever their size.  Stretches of slots are scheduled side by side,
each in a task: a schedule that keeps all deadlines has the same state as any other once all windows open at
its start are over, so a task starts one longest window before its stretch, from a state of its own
(:func:`state`), and has the state of the schedule from slot zero when the stretch begins.  (Count the waiting blocks of
a deadline up to any limit: two such schedules agree where the limit is past those windows, and have
none within.)  A weight so small that its window is longer than the whole schedule leaves one stretch, in one task.  The
driver sees one row for each weight.

When sources run dry their slots stay empty; ``position`` numbers the blocks that exist, so
all documents are kept, and ``full`` marks the blocks before the first dry slot, to which the deviation
bound applies.  Behind it a block has the last slot before its deadline, and equal slots go by name.

Defined cases: a null source is a source of its own (named ``null_source``, empty by default); sources
without a weight follow after all others, in name order; sources of weight zero likewise; an
empty table gives an empty result; rows of one source and doc_id share one place; extra columns
pass through unless they have the name of a new one; a slot past the range of a long (weights of one in 10^18)
is given as the greatest long, while ``position`` still goes by the true one.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, numbered, written

BLOCK = 64
#: Slots that one task schedules at least.
STRETCH = 100_000
#: Slots of a schedule handed on at once.
HANDED = 10_000
GREATEST = (1 << 63) - 1


def shares(weights: dict[str, float | Fraction]) -> dict[str, int]:
    """The positive weights as the smallest integers of exactly the same proportions."""
    exact = {s: Fraction(w) for s, w in weights.items() if w and w > 0}
    common = math.lcm(*(w.denominator for w in exact.values())) if exact else 1
    whole = {s: int(w * common) for s, w in exact.items()}
    divisor = math.gcd(*whole.values()) if whole else 1
    return {s: w // divisor for s, w in whole.items()}


def deadline(block: int, weight: int, period: int) -> int:
    return -(-(block + 1) * period // weight)


def schedule(parts: dict[str, int], start: int = 0, done: dict[str, int] | None = None) -> Iterator[tuple[str, int]]:
    """``source, block`` of each slot from ``start`` on, without end; ties go to the smaller name.

    ``done`` is how many blocks each source had before ``start``.
    """
    period, done = sum(parts.values()), done or {}
    waiting = [(done.get(s, 0) * period // w, s, done.get(s, 0)) for s, w in parts.items()]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    now = start
    while True:
        while waiting and waiting[0][0] <= now:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(j, parts[s], period), s, j))
        due, s, j = heapq.heappop(ready)
        assert due > now
        yield s, j
        heapq.heappush(waiting, ((j + 1) * period // parts[s], s, j + 1))
        now += 1


def state(parts: dict[str, int], at: int) -> dict[str, int]:
    """How many blocks each source may have had before slot ``at``, so that no deadline is missed from there on.

    Each has its whole share, and those with the earliest deadlines the block that is in progress.
    """
    period = sum(parts.values())
    done = {s: w * at // period for s, w in parts.items()}
    begun = sorted((deadline(done[s], w, period), s) for s, w in parts.items() if w * at % period)
    for _, s in begun[: at - sum(done.values())]:
        done[s] += 1
    return done


def longest_window(parts: dict[str, int]) -> int:
    return -(-sum(parts.values()) // min(parts.values())) + 1 if parts else 1


def stretch(parts: dict[str, int], start: int, end: int) -> Iterator[tuple[str, int]]:
    """The slots from ``start`` to ``end`` of the schedule that begins at slot zero."""
    early = max(0, start - longest_window(parts))
    slots = schedule(parts, early, state(parts, early))
    for at, slot in zip(range(early, end), slots, strict=False):
        if at >= start:
            yield slot


def _plan(spark: SparkSession, parts: dict[str, int], end: int, least: int) -> DataFrame:
    """``source_key, block, at`` of every slot before ``end``."""
    size = max(least, 2 * longest_window(parts))
    n = max(1, -(-end // size))

    def walk(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                first, last = i * size, min(end, (i + 1) * size)
                slots = stretch(parts, first, last)
                for at in range(first, last, HANDED):
                    rows = [s for s, _ in zip(slots, range(at, min(last, at + HANDED)), strict=False)]
                    yield pa.RecordBatch.from_pydict({"source_key": [s for s, _ in rows], "block": [j for _, j in rows], "at": list(range(at, at + len(rows)))})

    return spark.range(0, n, 1, n).mapInArrow(walk, "source_key string, block long, at long")


def _ordered(slot: int) -> bytes:
    """A key that sorts as the number does, of any size."""
    digits = slot.to_bytes((slot.bit_length() + 7) // 8, "big")
    return len(digits).to_bytes(4, "big") + digits


def mix(docs: DataFrame, weights: dict[str, float | Fraction], *, block: int = BLOCK, null_source: str = "") -> DataFrame:
    """``docs`` with ``number, block, slot, position, full``.

    ``weights`` are relative target weights by source.  Order by ``position`` and then
    ``number`` (the place within the source) to read the mixture.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.drop("source_key", "number", "block", "slot", "position", "full")
    keyed = docs.withColumn("source_key", F.coalesce("source", F.lit(null_source)))
    rows = numbered(keyed.select("source_key", "doc_id").distinct(), ["source_key"], ["doc_id"]).withColumnRenamed("place", "number").drop("n").withColumn("block", F.expr(f"number div {block}"))
    blocks = written(rows.select("source_key", "block").distinct())

    parts = shares(weights)
    period = sum(parts.values())
    named = spark.createDataFrame([(s,) for s in parts], "source_key string")  # one row a weight
    weighted = blocks.join(F.broadcast(named), "source_key")
    ends = dict.fromkeys(parts, 0) | {r.source_key: r.n for r in weighted.groupBy("source_key").agg((F.max("block") + 1).alias("n")).collect()}
    # The first block that a source lacks leaves the first dry slot, before its deadline.
    plan = written(_plan(spark, parts, min((deadline(n, parts[s], period) for s, n in ends.items()), default=0), STRETCH))
    lacking = F.create_map(*(F.lit(x) for pair in ends.items() for x in pair))[F.col("source_key")] if ends else F.lit(0)
    first_dry = plan.where(F.col("block") >= lacking).agg(F.min("at")).first()[0] or 0

    def slots():
        def one(source, block, at):
            late = max(deadline(block, parts[source], period) - 1, first_dry)
            slot = late if at is None or at >= first_dry else at
            return source, block, min(slot, GREATEST), _ordered(slot)

        return one

    real = map_rows(weighted.join(plan, ["source_key", "block"], "left"), slots, "source_key string, block long, slot long, due binary")
    real = numbered(real, [], ["due", "source_key", "block"]).select("source_key", "block", "slot", F.col("place").alias("position"), (F.col("slot") < first_dry).alias("full"))
    other = numbered(blocks.join(F.broadcast(named), "source_key", "left_anti"), [], ["source_key", "block"])
    other = other.select("source_key", "block", F.lit(None).cast("long").alias("slot"), (F.lit(sum(ends.values())) + F.col("place")).alias("position"), F.lit(False).alias("full"))
    placed = rows.join(real.unionByName(other), ["source_key", "block"])
    # Null-safe on doc_id: a null id is a row like any other.
    same = (keyed.source_key == placed.source_key) & keyed.doc_id.eqNullSafe(placed.doc_id)
    return keyed.join(placed, same).select(*(keyed[c] for c in docs.columns), "number", "block", "slot", "position", "full")
