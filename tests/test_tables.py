"""Hand-made rows for admission, logs, memory, evaluation, sources, sinks and streams."""

import datetime
import io
import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from skyledger.functions import hashing, paths
from skyledger.operators import admission as A
from skyledger.operators import evaluate as E
from skyledger.operators import log as L
from skyledger.operators import memory as M
from skyledger.plans import registry
from skyledger.plans import views as V
from skyledger.sources import readers, sinks
from skyledger.streaming import actions


@pytest.mark.parametrize(
    ("path", "code"),
    [
        (None, "invalid_image_path"),
        ("", "invalid_image_path"),
        ("a" * 4097, "invalid_image_path"),
        ("a\\b", "external_image_reference_not_allowed"),
        ("https://x/y", "external_image_reference_not_allowed"),
        ("/abs", "external_image_reference_not_allowed"),
        ("c:/x", "external_image_reference_not_allowed"),
        ("a/../b", "image_path_not_normalized"),
        ("a//b", "image_path_not_normalized"),
        ("a/b.png", None),
    ],
)
def test_path_codes(spark, path, code):
    assert spark.createDataFrame([(path,)], "p string").select(paths.path_code(F.col("p"))).first()[0] == code


def test_prefix_is_by_component(spark):
    rows = spark.createDataFrame([("train/images2/a",), ("train/images/a",), ("train",)], "p string")
    assert [r[0] for r in rows.select(paths.under(F.col("p"), ["train/images"])).collect()] == [False, True, False]


def test_coverage_adds_up(spark, data):
    from skyledger.plans import registry

    rows = {(r.kind, r.outcome): r["rows"] for r in registry.QUERIES["path_coverage"](spark, data).collect()}
    total = rows[None, None]
    assert sum(n for (k, o), n in rows.items() if k and not o) == total == sum(n for (k, o), n in rows.items() if o)


def test_greedy_cap_skips(spark):
    rows = spark.createDataFrame([("a", i, n) for i, n in enumerate([5, 9, 4, 1])], "k string, i long, size long")
    assert sorted(r.i for r in A.greedy_cap(rows, "k", ["i"], "size", 10).collect()) == [0, 2, 3]
    assert sorted(r.i for r in A.running_cap(rows, "k", ["i"], "size", 10).collect()) == [0]


def test_greedy_byte_cap_reads_all_rows(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("source", F.lit("src0"))
    assert docs.count() > 50
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want, used = set(), 0
    for r in V.assets(spark, str(tmp_path)).orderBy("doc_id").collect():
        if used + r.size_bytes <= 20_000:
            want.add(r.asset_id)
            used += r.size_bytes
    assert {r.asset_id for r in registry.QUERIES["greedy_byte_cap"](spark, str(tmp_path)).collect()} == want


def test_overlapping_scopes(spark):
    rows = spark.createDataFrame([("a",), ("a/b",), ("ab",), ("a/b/c",)], "scope string")
    found = {(r.outer_scope, r.inner_scope) for r in A.overlapping_scopes(rows).collect()}
    assert found == {("a", "a/b"), ("a", "a/b/c"), ("a/b", "a/b/c")}


def test_jpeg_header():
    head = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + (480).to_bytes(2, "big") + (640).to_bytes(2, "big") + b"\x03"
    assert A.jpeg_size(head) == (640, 480, 3)
    assert A.jpeg_size(b"\x89PNG") is None and A.jpeg_size(None) is None


def test_lineage(spark):
    edges = spark.createDataFrame([(3, 2), (2, 1), (3, 1)], "child long, parent long")
    assert {(r.child, r.ancestor, r.depth) for r in A.lineage_closure(edges).collect()} == {(3, 2, 1), (2, 1, 1), (3, 1, 1)}


def test_lineage_of_any_depth(spark):
    """A long chain, a row of diamonds (a way doubles at each) and a cycle."""
    chain = [(i + 1, i) for i in range(20)]
    diamonds = [e for i in range(100, 118, 2) for e in ((i + 2, i), (i + 2, i + 1), (i + 3, i), (i + 3, i + 1))]
    edges = spark.createDataFrame([*chain, *diamonds, (900, 901), (901, 902), (902, 900), (None, 1)], "child long, parent long")
    found = {(r.child, r.ancestor): r.depth for r in A.lineage_closure(edges).collect()}
    assert {k: v for k, v in found.items() if k[0] <= 20} == {(i, j): i - j for i in range(1, 21) for j in range(i)}
    assert sum(k[0] in (118, 119) for k in found) == 2 * 18 and found[118, 100] == 9
    assert found[900, 900] == 3 and found[900, 902] == 2


def test_chain_round_trip_and_tampering(spark):
    rows = spark.createDataFrame([(s, i, f"e{i}") for s in ("x", "y") for i in range(1, 6)], "scope string, seq long, body string")
    made = L.build_chain(rows, "scope", "seq", F.col("body"))
    both = rows.join(made, ["scope", "seq"])
    assert {(r.scope, r.first_bad) for r in L.verify_chain(both, "scope", "seq", F.col("body")).collect()} == {("x", None), ("y", None)}
    changed = both.withColumn("body", F.when((F.col("scope") == "y") & (F.col("seq") == 3), "other").otherwise(F.col("body")))
    assert {(r.scope, r.first_bad, r.code) for r in L.verify_chain(changed, "scope", "seq", F.col("body")).collect()} == {("x", None, None), ("y", 3, "hash_mismatch")}
    gone = both.where("NOT (scope = 'x' AND seq = 2)")
    assert {(r.scope, r.code) for r in L.verify_chain(gone, "scope", "seq", F.col("body")).collect()} == {("x", "sequence_gap"), ("y", None)}


def test_semantic_payload(spark):
    value = {"b": [{"event_id": "1", "x": 1}], "wall_time_ms": {"limit": 5, "used": 3}, "answer": {"event_id": "k"}, "a": "é"}
    row = spark.createDataFrame([(json.dumps(value),), (None,)], "p string").select(hashing.semantic(F.col("p")).alias("s"), hashing.semantic(F.col("p"), replay=True).alias("r")).collect()
    assert row[0].s == '{"a":"é","answer":{},"b":[{"x":1}],"wall_time_ms":{"limit":5}}'
    assert '"answer":{"event_id":"k"}' in row[0].r
    assert row[1].s is None
    cited = {"evidence_ids": ["e1"], "client_action_id": "c", "observation_id": "o", "inline": {"created_at": 1}, "list": [[{"request_id": 2}]]}
    row = spark.createDataFrame([(json.dumps(cited),)], "p string").select(hashing.semantic(F.col("p")).alias("s"), hashing.semantic(F.col("p"), replay=True).alias("r")).first()
    assert row.s == '{"inline":{},"list":[[{}]]}'
    assert row.r == '{"client_action_id":"c","evidence_ids":["e1"],"inline":{"created_at":1},"list":[[{"request_id":2}]]}'


def test_ids_dont_collide(spark):
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c")], "x string, y string")
    assert rows.select(hashing.digest(F.col("x"), F.col("y")).alias("h")).distinct().count() == 2


def test_guarded_columns():
    for name in ("bbox", "gt", "image_gt", "ANSWER_text", "true_mask"):
        with pytest.raises(ValueError, match="answer_column_not_allowed"):
            readers.guard([name], name)
    for name in ("unmasked", "image_path", "gtin", "relabelled"):
        assert readers.guard([name], name) == name
    for name in ("_x", "a b", "é", "x;y", "1x"):
        with pytest.raises(ValueError, match="column_name_not_allowed"):
            readers.guard([name], name)


def test_parquet_shards(spark, tmp_path):
    for name in ("b", "a", "c"):
        pq.write_table(pa.table({"x": [1]}), tmp_path / f"{name}.parquet")
    (tmp_path / "note.txt").write_text("x")
    rows = readers.shards(spark, str(tmp_path), glob="*.parquet").collect()
    assert sorted(r.path.rsplit("/", 1)[-1] for r in rows) == ["a.parquet", "b.parquet", "c.parquet"]
    assert [r.path.rsplit("/", 1)[-1] for r in readers.shards(spark, str(tmp_path), glob="*.parquet", max_shards=2).orderBy("path").collect()] == ["a.parquet", "b.parquet"]


def test_lease_expiry(spark, tmp_path):
    """A tool that is started and never ends is reported when the watermark passes its lease."""
    schema = "episode_id long, event_type string, created_at timestamp"
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, tzinfo=datetime.UTC) + datetime.timedelta(seconds=s)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for i, rows in enumerate([[(1, "tool_started", at(0)), (2, "tool_started", at(0)), (2, "tool_finished", at(5))], [(3, "other", at(3600))], [(3, "other", at(3700))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        running = actions.episode_state(stream, lease="90 seconds", delay="10 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        running.awaitTermination()
    states = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.episode_id for r in states if r.status == "tool_interrupted"} == {1}


def test_memory_commands_against_a_loop(spark):
    r = random.Random(6)
    rows = [(f"s{s}", i, f"a{r.randrange(4)}", r.choice(["publish", "publish", "invalidate"]), r.randrange(12), r.randrange(5) == 0, r.randrange(2), r.choice([None, r.randrange(12)])) for s in range(3) for i in range(150)]
    writers = [(f"s{s}", f"a{a}") for s in range(3) for a in range(3)] * 2
    want = {}
    for s in range(3):
        active, all_, gone = set(), {}, {}
        for scope, i, actor, kind, m, content, reason, other in rows:
            if scope != f"s{s}":
                continue
            if actor == "a3":
                v = "not_authorized"
            elif kind == "publish" and m in all_:
                v = "repeat" if all_[m] == content else "content_conflict"
            elif kind == "publish":
                v = "cap_reached" if len(active) == 5 else "published"
                if v == "published":
                    all_[m] = content
                    active.add(m)
            elif m not in all_:
                v = "unknown_memory"
            elif m in gone:
                v = "repeat" if gone[m] == (reason, other, actor) else "invalidation_conflict"
            elif other is not None and other not in active:
                v = "replacement_inactive"
            else:
                v = "invalidated"
                gone[m] = (reason, other, actor)
                active.discard(m)
            want[scope, i] = v
    frame = spark.createDataFrame(rows, "scope_id string, sequence long, actor_id string, kind string, memory_id long, content boolean, reason long, replacement_id long")
    out = {(x.scope_id, x.sequence): x.verdict for x in M.judge_commands(frame.repartition(7), spark.createDataFrame(writers, "scope_id string, actor_id string"), cap=5).collect()}
    assert out == want and len(set(out.values())) == 9


def test_case_matrix_finds_what_it_should(spark, data):
    rows = registry.QUERIES["case_checks"](spark, data)
    assert rows.where("found <> expected").count() == 0
    assert rows.where("expected AND NOT says_same").select("case_name").distinct().collect()[0].case_name == "conflict"


def test_reward_ignores_null_weights(spark):
    rows = spark.createDataFrame([(1, "task.a", 1.0, 0.6), (1, "b", 0.0, None), (1, "c", 0.5, 0.4), (2, "b", 1.0, None)], "k long, name string, value double, weight double")
    assert {r.k: r.reward for r in E.reward(rows, "k").collect()} == {1: 0.8, 2: None}
    assert {r.k: r.outcome for r in E.semantic_outcome(rows, "k").collect()} == {1: "correct", 2: "unscored"}


def test_published_landcover_score(spark):
    rows = spark.createDataFrame([(1, 1.0, 1.0, 0.840972)], "k long, a double, f double, e double")
    metrics = E.to_metrics(rows, "k", {"a": 0.6, "f": 0.3, "e": 0.1})
    assert E.reward(metrics, "k", 7).first().reward == pytest.approx(0.9840972)


def test_arrow_shards(spark, tmp_path):
    table = pa.table({"image_path": ["a", "b"], "answer": ["x", "y"]})
    for name, maker in (("1.arrow", pa.ipc.new_file), ("2.arrow", pa.ipc.new_stream)):
        sink = io.BytesIO()
        with maker(sink, table.schema) as writer:
            writer.write_table(table)
        (tmp_path / name).write_bytes(sink.getvalue())
    rows = readers.arrow_column(spark, str(tmp_path), "image_path", "string").collect()
    assert sorted(r.image_path for r in rows) == ["a", "a", "b", "b"]
    with pytest.raises(ValueError, match="answer_column_not_allowed"):
        readers.arrow_column(spark, str(tmp_path), "answer", "string")


def test_parquet_column_reads_one_column(spark, data):
    rows = readers.parquet_column(spark, f"{data}/pages.parquet", "url", max_rows=3)
    assert rows.count() == 3
    plan = readers.parquet_column(spark, f"{data}/pages.parquet", "url")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<url:string>" in plan
    with pytest.raises(ValueError, match="column_missing"):
        readers.parquet_column(spark, f"{data}/pages.parquet", "nothing")


def test_json_lines_and_documents(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text('{"seq":1,"kind":"x"}\n{bad\n' + '{"seq":2,"kind":"' + "y" * 100 + '"}\n')
    good, bad = readers.json_lines(spark, str(tmp_path / "log"), "seq long, kind string", max_bytes=60)
    assert [r.seq for r in good.collect()] == [1]
    assert sorted(r.code for r in bad.collect()) == ["invalid_json", "line_too_long"]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text('{\n"id": "q"\n}')
    (tmp_path / "docs" / "b.json").write_text('{"id": "' + "z" * 500 + '"}')
    rows = {r.path.rsplit("/", 1)[-1]: (r.document and r.document.id, r.code) for r in readers.json_documents(spark, str(tmp_path / "docs"), "id string", max_bytes=100).collect()}
    assert rows == {"a.json": ("q", None), "b.json": (None, "document_too_long")}


def test_listing(spark, tmp_path):
    for name in ("a.PNG", "x/b.zip", "logs/c.png", "x/DOWNLOAD_FAILED.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    rows = {r.relative_path: (r.is_image, r.is_archive, r.is_marker) for r in readers.listing(spark, str(tmp_path)).collect()}
    assert rows == {"a.PNG": (True, False, False), "x/b.zip": (False, True, False), "x/DOWNLOAD_FAILED.txt": (False, False, True)}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "content string")
    assert sinks.content_addressed(rows, str(tmp_path / "cas")).count() == 2
    assert sinks.content_addressed(rows, str(tmp_path / "cas")).count() == 2
    sinks.report(rows, str(tmp_path / "report"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        sinks.report(rows, str(tmp_path / "report"))
    events = spark.createDataFrame([("s", 1)], "scope_id string, sequence long")
    sinks.append_events(events, str(tmp_path / "log"))
    sinks.append_events(events.withColumn("sequence", F.lit(2).cast("long")), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_report_maps_are_in_order(spark, data):
    rows = [tuple(r) for r in registry.QUERIES["coverage_maps"](spark, data).collect()]
    assert rows == sorted(rows) and {m for m, *_ in rows} == {"all", "failures", "duplicates", "outcomes", "driver", "reference"}
    total = {m: sum(n for k, _, n in rows if k == m) for m, *_ in rows}
    assert total["all"] == total["failures"] + total["duplicates"] + total["outcomes"] and total["outcomes"] == total["driver"] == total["reference"]


def test_published_temporal_groups(spark):
    """Four of four right, none of three falsely confident, one counterfactual found: passed; else failed."""
    right = [("valid-pair", False, True, True), ("cloudy", False, True, False), ("date", False, True, False), ("sensor", False, True, False), ("valid-pair", True, True, True)]
    unsure = [*right[:3], ("sensor", False, True, None), right[4]]
    rows = [(name, *r) for name, runs in (("a", right), ("b", right[:4]), ("c", unsure), ("d", [*right, right[4]])) for r in runs]
    found = {r.k: r for r in E.group_summary(spark.createDataFrame(rows, "k string, case_id string, counterfactual boolean, passed boolean, false_confidence boolean"), "k").collect()}
    assert {k: r.status for k, r in found.items()} == {"a": "passed", "b": "failed", "c": "failed", "d": "failed"}
    assert (found["a"].correct_passed, found["a"].rejection_false, found["a"].rejection_total, found["a"].counterfactual_passed) == (4, 0, 3, 1)


def test_usage_of_links_and_devices(spark):
    entries = [("a", "file", 1, 1, 8), ("b", "file", 1, 1, 8), ("c.log", "file", 1, 2, 4), ("l", "symlink", 1, 3, 0), ("d", "directory", 1, 4, 8)]
    frame = lambda rows: spark.createDataFrame(rows, "path string, kind string, dev long, inode long, blocks long")
    whole = {r.category: r for r in A.usage_report(frame(entries), root_device=1).collect()}
    assert (whole[None].files, whole[None].aliases, whole[None].allocated_bytes, whole[None].symlinks, whole[None].complete) == (3, 1, 12 * 512, 1, True)
    for more in (("e", "error", 1, 5, 0), ("f", "file", 2, 6, 1)):
        assert not {r.category: r for r in A.usage_report(frame([*entries, more]), root_device=1).collect()}[None].complete
