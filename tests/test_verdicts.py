"""Verdicts of a stream of actions as a table."""

import datetime

from pyspark.sql import functions as F
from skyledger.plans import registry
from skyledger.streaming import actions

SENT = "episode_id long, client_action_id long, request string, created_at timestamp"


def test_verdicts_over_batches(spark, tmp_path):
    """The first of a batch by time and content is new, unless a batch before has the action."""
    at = lambda s: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)
    batches = [[(1, 1, "b", at(5)), (1, 1, "a", at(2)), (1, 1, "a", at(2)), (2, 1, "x", at(3))], [(1, 1, "b", at(1)), (1, 1, "a", at(9)), (3, 1, None, at(4)), (3, 1, None, at(6)), (3, 1, "q", at(7))]]
    stream = spark.readStream.schema(SENT).parquet(str(tmp_path / "in*"))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SENT).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
        actions.record_verdicts(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).groupBy("episode_id", "batch", "verdict").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {tuple(r) for r in rows} == {(1, 0, "new", 1), (1, 0, "repeat", 1), (1, 0, "conflict", 1), (2, 0, "new", 1), (1, 1, "conflict", 1), (1, 1, "repeat", 1), (3, 1, "new", 1), (3, 1, "repeat", 1), (3, 1, "conflict", 1)}


def test_conflicts_call_no_python_for_each_action(spark, data, monkeypatch):
    def refuse(*_):
        raise AssertionError("a Python call for each action")

    monkeypatch.setattr("skyledger.plans.stream_queries._drain", refuse)
    assert registry.QUERIES["action_conflicts"](spark, data).count() > 0
