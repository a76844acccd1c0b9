"""Joins by covers: no side is sent whole, and what is asked many times is answered once."""

import math

import pytest
from pyspark.sql import functions as F
from skyledger.operators import ranges
from skyledger.plans import registry

JOINED = [
    "memory_pages", "memory_search", "memory_search_as_of", "pair_reasons", "run_summary", "aligned_pairs", "best_pairs", "catalog_search", "temporal_answers", "temporal_scores",
]


@pytest.mark.parametrize("name", JOINED)
def test_no_side_of_a_cover_join_is_broadcast(spark, data, name):
    plan = registry.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString().splitlines()
    joins = [line for line in plan if "_key#" in line and "Join" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_equal_rows_share_an_answer(spark):
    rows = [(3, 1.0, "a"), (1, 1.0, "a"), (2, None, "a"), (5, None, "a"), (4, math.nan, None), (6, math.nan, None), (7, 2.0, "a")]
    one, members = ranges.alike(spark.createDataFrame(rows, "k long, x double, y string"), "k")
    assert sorted(r.k for r in one.collect()) == [1, 2, 4, 7]
    assert {r.k: r._one for r in members.collect()} == {1: 1, 3: 1, 2: 2, 5: 2, 4: 4, 6: 4, 7: 7}
    answers = one.where("k <> 7").select("k", (F.col("k") * 10).alias("n"))
    assert {r.k: r.n for r in ranges.shared(answers, members, "k").collect()} == {1: 10, 3: 10, 2: 20, 5: 20, 4: 40, 6: 40}
