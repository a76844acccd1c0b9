"""Chained logs, streams to two tables, leases, nested images, lineage and scratch folders."""

import datetime
import hashlib
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from skyledger.functions import hashing
from skyledger.operators import admission as A
from skyledger.operators import log as L
from skyledger.operators import memory as M
from skyledger.sources import chained
from skyledger.streaming import actions

EVENTS = "scope string, n long, body string"


def send(spark, path, rows, name, **more):
    frame = spark.createDataFrame(rows, EVENTS)
    return {r.scope: r.code for r in chained.append(frame, path, scope="scope", order="n", content=F.col("body"), batch_id=name, **more).collect()}


def log_of(spark, path):
    return {(r.scope, r.sequence): r.body for r in chained.read(spark, path).collect()}


def clean(spark, path):
    return {r.scope: r.code for r in L.verify_chain(chained.read(spark, path), "scope", "sequence", F.col("body")).collect()}


def test_two_writers(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert chained.read(spark, path, EVENTS).count() == 0 and chained.heads(spark, path, "scope").count() == 0
    assert send(spark, path, [("x", 2, "b"), ("x", 1, "a"), ("y", 1, "c")], "one") == {"x": None, "y": None}
    seen = spark.createDataFrame([tuple(r) for r in chained.heads(spark, path, "scope").select("scope", "event_sha256").collect()], "scope string, event_sha256 string")
    assert send(spark, path, [("x", 1, "d")], "two", expected=seen) == {"x": None}
    # The other writer saw the same heads: x has moved on, y has not, z is new to both.
    assert send(spark, path, [("x", 1, "lost"), ("y", 1, "e"), ("z", 1, "f")], "other", expected=seen) == {"x": "stale_head", "y": None, "z": None}
    assert send(spark, path, [("z", 1, "g")], "empty", expected=seen) == {"z": "stale_head"}
    assert send(spark, path, [("y", 1, "e"), ("z", 1, "f"), ("x", 1, "lost")], "other") == dict.fromkeys("xyz", "repeated_batch")
    assert send(spark, path, [("x", 1, "y" * 99), ("y", 1, "h")], "large", most_bytes=50) == {"x": "event_too_large", "y": None}
    assert log_of(spark, path) == {("x", 1): "a", ("x", 2): "b", ("x", 3): "d", ("y", 1): "c", ("y", 2): "e", ("y", 3): "h", ("z", 1): "f"}
    assert clean(spark, path) == dict.fromkeys("xyz")
    # By hand: the hash of content and previous hash.
    last = "0" * 64
    for body in ("a", "b", "d"):
        last = hashlib.sha256(f"{body}|{last}".encode()).hexdigest()
    assert {r.scope: (r.sequence, r.event_sha256) for r in chained.heads(spark, path, "scope").collect()}["x"] == (3, last)


def test_a_lost_race_is_tried_again(spark, tmp_path, monkeypatch):
    """Another writer takes the number while this one writes: the batch is chained to the new head, or refused."""
    path, claim, other = f"file://{tmp_path}/log", chained._claim, []

    def late(session, where, number, entry):
        if not other:
            other.append(1)
            send(spark, path, [("x", 1, "first")], "rival")
        return claim(session, where, number, entry)

    monkeypatch.setattr(chained, "_claim", late)
    assert send(spark, path, [("x", 1, "second")], "mine") == {"x": None}
    assert log_of(spark, path) == {("x", 1): "first", ("x", 2): "second"}
    other.clear()
    head = chained.heads(spark, path, "scope")
    expected = spark.createDataFrame([tuple(r) for r in head.select("scope", "event_sha256").collect()], "scope string, event_sha256 string")
    monkeypatch.setattr(chained, "_claim", lambda *a: (other or other.append(1) or send(spark, path, [("x", 1, "third")], "rival 2")) and claim(*a))
    assert send(spark, path, [("x", 1, "refused")], "mine 2", expected=expected) == {"x": "stale_head"}
    assert log_of(spark, path)["x", 3] == "third" and clean(spark, path) == {"x": None}
    assert len(chained.batches(spark, path)) == 4


def test_heads_over_snapshots(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chained, "SNAPSHOT", 2)
    path = f"file://{tmp_path}/log"
    for i, scope in enumerate("abcab"):
        send(spark, path, [(scope, 1, f"{i}")], f"{i}")
    assert {r.scope: r.sequence for r in chained.heads(spark, path, "scope").collect()} == {"a": 2, "b": 2, "c": 1}
    assert [b["all_heads"] for b in chained.batches(spark, path)] == [False, True, False, True, False]


def test_streamed_batches_count_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    path, args = f"file://{tmp_path}/log", {"name": "s", "scope": "scope", "order": "n", "content": F.col("body")}
    for i in range(2):
        spark.createDataFrame([("x", i, f"e{i}")], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        chained.append_stream(stream, path, str(tmp_path / "ck"), **args).awaitTermination()
    # A lost checkpoint sends the first batch again, under its number.
    spark.createDataFrame([("x", 9, "again")], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    chained.append_stream(stream, path, str(tmp_path / "ck2"), **args).awaitTermination()
    assert log_of(spark, path) == {("x", 1): "e0", ("x", 2): "e1"}


SENT = "episode_id long, client_action_id long, request string, created_at timestamp, note string"
at = lambda s: datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=s)


def test_two_tables_after_a_restart(spark, tmp_path, monkeypatch):
    """A failure between the two tables, and a restart from the checkpoint, leave what one run leaves."""
    batches = [[(1, 1, "a", at(5), "later"), (1, 1, "b", at(1), "first"), (1, 1, "b", at(9), "same"), (2, 1, "x", at(2), "first")], [(1, 1, "c", at(20), "other"), (2, 1, "x", at(21), "same"), (3, 1, "q", at(22), "first"), (3, 1, "q", at(22), "first")]]

    def run(name, fail):
        (tmp_path / name / "in").mkdir(parents=True)
        stream = spark.readStream.schema(SENT).parquet(str(tmp_path / name / "in"))
        out = [str(tmp_path / name / t) for t in ("accepted", "conflicts", "checkpoint")]
        for rows in batches:
            spark.createDataFrame(rows, SENT).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
            if fail:
                with monkeypatch.context() as m:
                    writer = type(spark.range(1).write)
                    whole = writer.parquet

                    def broken(self, path, *a, **k):
                        if "conflicts" in path:
                            raise RuntimeError("lost")
                        return whole(self, path, *a, **k)

                    m.setattr(writer, "parquet", broken)
                    with pytest.raises(Exception, match="lost"):
                        actions.ingest_actions(stream, *out).awaitTermination()
            actions.ingest_actions(stream, *out).awaitTermination()
        return [sorted(tuple(r) for r in spark.read.parquet(p).select("episode_id", "client_action_id", "request", "note", "batch").collect()) for p in out[:2]]

    assert run("whole", False) == run("failing", True) == [[(1, 1, "b", "first", 0), (2, 1, "x", "first", 0), (3, 1, "q", "first", 1)], [(1, 1, "a", "later", 0), (1, 1, "c", "other", 1)]]


def test_verdicts_don_t_depend_on_arrow_batches(spark, tmp_path):
    """A key's rows in many batches, the earliest last."""
    rows = [(1, 7, "late", at(1000 - i), "") for i in range(500)] + [(1, 7, "first", at(0), "")]
    spark.createDataFrame(rows, SENT).coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        stream = spark.readStream.schema(SENT).parquet(str(tmp_path / "in"))
        actions.action_verdicts(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r.verdict, r.n) for r in spark.read.parquet(str(tmp_path / "out")).groupBy("verdict").agg(F.count("*").alias("n")).collect()} == {("new", 1), ("conflict", 500)}


def test_state_of_a_finished_episode_is_dropped(spark, tmp_path):
    schema = "episode_id long, event_type string, created_at timestamp"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for rows in [[(1, "tool_started", at(3)), (1, "terminal", at(5)), (2, "tool_finished", at(4)), (2, "tool_started", at(2))], [(3, "other", at(10_000))], [(3, "other", at(10_001))], [(1, "other", at(10_002)), (2, "tool_started", at(10_003))]]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        actions.episode_state(stream, delay="10 seconds", keep="1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    rows = {(r.episode_id, r.version, r.events, r.status, r.open_since is not None) for r in spark.read.parquet(str(tmp_path / "out")).where("episode_id < 3").collect()}
    assert rows == {(1, 1, 2, "finished", False), (1, 1, 1, "running", False), (2, 1, 2, "running", False), (2, 2, 3, "running", True)}


def walked(value, depth=0, most=16, size=64):
    """The rules item by item, for lists, dicts and bytes."""
    if depth > 3:
        raise ValueError("image_nesting_limit")
    if isinstance(value, list):
        if len(value) > most:
            raise ValueError("image_sequence_limit")
        out = []
        for item in value:
            out += walked(item, depth + 1)
            if len(out) > most:
                raise ValueError("image_sequence_limit")
        return out
    if isinstance(value, dict):
        if value["bytes"] is None:
            raise ValueError("external_image_reference_not_allowed")
        return walked(value["bytes"], depth + 1)
    if not value:
        raise ValueError("missing_embedded_image")
    if len(value) > size:
        raise ValueError("image_size_limit")
    return [value]


def test_nested_images_by_hand(spark):
    def nested(value):
        """A column of one shape; lists hold items of one kind here."""
        if isinstance(value, list):
            return F.array(*map(nested, value)) if value else F.array().cast("array<binary>")
        if isinstance(value, dict):
            return F.struct(nested(value["bytes"]).alias("bytes"), F.lit("p").alias("path"))
        return F.lit(None).cast("binary") if value is None else F.lit(value)

    a, big = b"\x89PNG\r\n\x1a\n", b"x" * 99
    values = [a, b"", None, [], [a, a], [[a] * 9, [a] * 9], [[a] * 15, [a, a, b""]], [[a] * 15, [a, big]], [[a] * 8] * 2, [[a] * 16, [a], [b""]], {"bytes": [a, b""]}, {"bytes": {"bytes": [a]}}, {"bytes": {"bytes": [[a]]}}, [a, b"", big], [[[a, a]]], [[[[a]]]], [a] * 17, {"bytes": None}, [{"bytes": None}, {"bytes": a}], [[[a] * 9, [a] * 9], [[b""]]]]
    frames = [spark.range(1).select(F.lit(i).alias("k"), (F.to_variant_object(nested(v)) if isinstance(v, (list, dict)) else nested(v).cast("variant")).alias("v")) for i, v in enumerate(values)]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionAll(f)
    found = {r.k: (r.code, [x.sha256 for x in r.images]) for r in A.nested_images(rows, "v", "k", most_bytes=64).collect()}
    for i, value in enumerate(values):
        try:
            want = (None, [hashlib.sha256(x).hexdigest() for x in walked(value)])
        except ValueError as error:
            want = (str(error), [])
        assert found[i] == want, value


def test_long_chain_of_artifacts(spark, monkeypatch):
    """Ten thousand generations in at most fifteen rounds; diamonds and cycles beside it."""
    rounds = []
    real = A.written
    monkeypatch.setattr(A, "written", lambda df: rounds.append(1) or real(df))
    edges = spark.range(10_000).select((F.col("id") + 1).alias("child"), F.col("id").alias("parent"))
    more = spark.createDataFrame([(20_001, 20_002), (20_001, 20_003), (20_002, 20_004), (20_003, 20_004), (20_003, 20_005), (30_001, 30_002), (30_002, 30_001), (30_003, 30_001), (30_003, 20_004)], "child long, parent long")
    out = A.lineage_roots(edges.unionAll(more))
    assert len(rounds) <= 2 + 15
    assert out.where("node <= 10000").select("root").distinct().collect()[0].root == 0 and out.where("node <= 10000").count() == 10_001
    assert {(r.node, r.root, r.is_root) for r in out.where("node > 10000").collect()} == {(20_001, 20_004, False), (20_001, 20_005, False), (20_002, 20_004, False), (20_003, 20_004, False), (20_003, 20_005, False), (20_004, 20_004, True), (20_005, 20_005, True), (30_003, 20_004, False)}
    rounds.clear()
    closure = A.lineage_closure(spark.range(300).select((F.col("id") + 1).alias("child"), F.col("id").alias("parent")))
    assert closure.count() == 300 * 301 // 2 and closure.where("depth <> child - ancestor").count() == 0 and len(rounds) <= 2 * 11


def test_damaged_records(spark):
    source = ("t", 1, "m", "e1", "s", "h")
    sources = [source, ("t", 1, "m", "e2", "s", "h"), ("t", 2, "m", "e2", "s", "h")]
    columns = ["scope_id", "policy_id", "object_type", "summary", "west", "south", "east", "north", "start", "end", "platform", "instrument", "updated_at", "expires_at"]
    provenance = hashlib.sha256("\0".join(map(str, source)).encode()).hexdigest()
    body = [f"v{c}" for c in columns]
    memory = "mem-" + hashlib.sha256("\0".join([*body, provenance]).encode()).hexdigest()
    rows = [(memory, "e1", *body, provenance), ("mem-x", "e1", *body, provenance), (memory[:-1], "e1", *body, "p"), ("a", "e2", *body, provenance), ("b", "e3", *body, provenance), ("c", None, *body, provenance)]
    stored = spark.createDataFrame(rows, ["memory_id", "evidence_id", *columns, "provenance_sha256"])
    found = M.verify_records(stored, spark.createDataFrame(sources, "task_id string, task_version long, manifest_sha string, evidence_id string, source_id string, source_sha string"))
    assert {r.memory_id: r.code for r in found.collect()} == {memory: None, "mem-x": "id_mismatch", memory[:-1]: "provenance_mismatch", "a": "ambiguous_source", "b": "missing_source", "c": "missing_source"}
    twice = M.verify_records(stored.limit(1).unionAll(stored.limit(1)), spark.createDataFrame([source], "task_id string, task_version long, manifest_sha string, evidence_id string, source_id string, source_sha string"))
    assert [r.code for r in twice.collect()] == ["repeated_id"] * 2


def test_malformed_payloads(spark):
    rows = spark.createDataFrame([('{"a":1}',), ("{bad",), (None,), ("[" * 5000,)], "p string").withColumn("s", hashing.semantic(F.col("p")))
    assert [(r.s, r.c) for r in rows.select("s", hashing.payload_code(F.col("p"), F.col("s")).alias("c")).collect()] == [('{"a":1}', None), (None, "malformed_payload"), (None, None), (None, "malformed_payload")]


SCRIPT = """
from pyspark.sql import SparkSession
import os, sys
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from skyledger.sources import scratch
assert scratch.written(spark.range(3)).count() == 3
one, two = scratch.folder(spark), scratch.folder(spark)
assert os.path.dirname(one) == os.path.dirname(two)
root = os.path.dirname(one).removeprefix("file://")
assert os.listdir(root)
scratch.clear(spark)
assert not [x for x in os.listdir(root) if not x.startswith(".")]
print("fine")
"""


def test_scratch_without_the_setting(tmp_path):
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", SCRIPT], env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}, capture_output=True, text=True, timeout=240)
    assert "fine" in done.stdout, done.stderr[-2000:]
