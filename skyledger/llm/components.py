"""Connected components by large-star / small-star rounds on DataFrames.

Each round points every node at the smallest node near it; the number of rounds grows with
the logarithm of a component's diameter.  Each round is written to the shared folder, which
cuts lineage and survives a lost executor; only two numbers a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, scratch, written

ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # Repeated links go in the small star.
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def labels(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """``node, component`` of nodes that a few rounds link to a smaller one; equal labels mean one component.

    A component may still have several labels: enough where only fewer comparisons depend on it.
    """
    now, paths = edges.where("a <> b").select("a", "b"), []
    for _ in range(rounds):
        paths.append(scratch(edges.sparkSession))
        now = written(_small_star(_large_star(now)), paths[-1])
    for path in paths[:-1]:
        drop_written(edges.sparkSession, path)
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its least node) of every node in ``edges(a, b)``; loops are ignored."""
    spark = edges.sparkSession
    now, path, before = edges.where("a <> b").select("a", "b"), None, None
    for _ in range(ROUNDS):
        new = scratch(spark)
        now = written(_small_star(_large_star(now)), new)
        if path:
            drop_written(spark, path)
        path = new
        # A star forest is its own image, so equal sums of two rounds in a row end the search.
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
