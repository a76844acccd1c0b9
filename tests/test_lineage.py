"""Rounds of the lineage search are dealt by the pairs known."""

from skyledger.operators import admission as A


def test_a_round_has_the_tasks_it_is_given(spark):
    steps = spark.createDataFrame([(k, k // 2) for k in range(1, 200)], "child long, ancestor long")
    two = A._joined(steps, steps, parts=9)
    assert two.rdd.getNumPartitions() == 9
    assert sorted(tuple(r) for r in two.collect()) == sorted((k, k // 4) for k in range(2, 200))
