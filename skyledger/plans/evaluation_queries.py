"""Queries that score recorded episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import evaluate as E
from ..operators import raster as P
from . import views as V
from .registry import query

LAND = {"task.accuracy": 0.6, "evidence.faithfulness": 0.3, "process.efficiency": 0.1}
LAND_SQL = """dc AS (SELECT raster_id, scl, count(*) AS n FROM v_pixels WHERE mask GROUP BY 1,2), dt AS (SELECT *, sum(n) OVER (PARTITION BY raster_id) AS total, row_number() OVER (PARTITION BY raster_id ORDER BY n DESC, scl) AS k FROM dc),
dm AS (SELECT raster_id, scl AS dominant, n::DOUBLE/total AS fraction FROM dt WHERE k=1), sc AS (SELECT raster_id, (raster_id%12=dominant)::INT::DOUBLE AS acc, (raster_id%12=dominant AND round(fraction,6)>=0.05 AND raster_id%2=0 AND raster_id%3<>1)::INT::DOUBLE AS faith,
 round(least(1.0,5.0/(4+raster_id%7))*(CASE WHEN raster_id%4>0 THEN least(1.0,2.0/(raster_id%4)) ELSE 0.0 END)*least(1.0,1000.0/(500+raster_id*100))/(1+raster_id%3),6) AS eff FROM dm)"""


def landcover(spark, d):
    """Episodes made of rasters: the answer, the evidence and the counts follow from the raster's number."""
    k = F.col("raster_id")
    truth = P.dominant_class(V.pixels(spark, d).where("mask"), ["raster_id"], "scl")
    evidence = truth.select("raster_id", F.explode(F.array(F.lit("source"), F.lit("rendered"))).alias("kind"))
    evidence = evidence.withColumns({"same_box": F.lit(True), "contains_box": k % 3 != 1, "hash_ok": k % 2 == 0})
    rows = truth.join(E.faithful(evidence, "raster_id"), "raster_id")
    right = (k % 12) == F.col("dominant")
    eff = E.efficiency(steps=4 + k % 7, ideal_steps=F.lit(5), calls=k % 4, ideal_calls=F.lit(2), wall=500 + k * 100, wall_limit=F.lit(1000), failed=k % 3)
    rows = rows.select("raster_id", right.cast("int").alias("task.accuracy"), (right & (F.col("fraction") >= 0.05) & F.col("source_valid") & F.col("rendered_valid")).cast("int").alias("evidence.faithfulness"), eff.alias("process.efficiency"))
    return E.to_metrics(rows, "raster_id", LAND)


@query(f"WITH {LAND_SQL} SELECT raster_id, 'task.accuracy' AS name, acc AS value, 0.6::DOUBLE AS weight FROM sc UNION ALL SELECT raster_id, 'evidence.faithfulness', faith, 0.3::DOUBLE FROM sc UNION ALL SELECT raster_id, 'process.efficiency', eff::DOUBLE, 0.1::DOUBLE FROM sc")
def landcover_metrics(spark, d):
    """Accuracy, faithfulness and efficiency."""
    return landcover(spark, d)


@query(f"WITH {LAND_SQL} SELECT raster_id, round((acc*0.6+faith*0.3+eff*0.1)/(0.6+0.3+0.1),6)::DOUBLE AS reward FROM sc")
def landcover_reward(spark, d):
    """Weighted mean of an episode's metrics."""
    return E.reward(landcover(spark, d), "raster_id")


@query(f"WITH {LAND_SQL} SELECT raster_id, CASE WHEN acc>=1 THEN 'correct' ELSE 'wrong' END AS outcome FROM sc")
def semantic_outcomes(spark, d):
    """Episodes whose task metrics are all 1."""
    return E.semantic_outcome(landcover(spark, d), "raster_id")


@query(f'WITH {LAND_SQL} SELECT raster_id, acc AS "task.accuracy", faith AS "evidence.faithfulness", eff::DOUBLE AS "process.efficiency" FROM sc')
def metric_pivot(spark, d):
    """A column for each metric."""
    return E.pivot_metrics(landcover(spark, d), ["raster_id"], list(LAND))


@query("""WITH x AS (SELECT *, greatest(0,least(east,a_east)-greatest(west,a_west))*greatest(0,least(north,a_north)-greatest(south,a_south)) AS shared, west-0.1<=a_west AND south-0.1<=a_south AND east+0.1>=a_east AND north+0.1>=a_north AS hit FROM v_boxes),
s AS (SELECT doc_id, round(shared/((east-west)*(north-south)+(a_east-a_west)*(a_north-a_south)-shared),6) AS iou, hit::INT::DOUBLE AS h FROM x)
SELECT doc_id, 'task.iou' AS name, iou AS value, 0.6::DOUBLE AS weight FROM s UNION ALL SELECT doc_id, 'evidence.crop_contains_truth', h, NULL FROM s UNION ALL SELECT doc_id, 'evidence.faithfulness', h, 0.3::DOUBLE FROM s
UNION ALL SELECT doc_id, 'process.efficiency', round(least(1.0,5.0/(4+doc_id%7))*(CASE WHEN doc_id%4>0 THEN least(1.0,2.0/(doc_id%4)) ELSE 0.0 END)*least(1.0,1000.0/(500+doc_id%900))/(1+doc_id%3),6)::DOUBLE, 0.1::DOUBLE FROM s""")
def grounding_metrics(spark, d):
    """Answered boxes against true ones."""
    rows, k = V.boxes(spark, d), F.col("doc_id")
    process = E.efficiency(steps=4 + k % 7, ideal_steps=F.lit(5), calls=k % 4, ideal_calls=F.lit(2), wall=500 + k % 900, wall_limit=F.lit(1000), failed=k % 3)
    crop = {f"crop_{s}": F.col(s) + (-0.1 if s in ("west", "south") else 0.1) for s in geo.SIDES}
    scored = E.score_grounding(rows.withColumns(crop), "doc_id", said="", truth="a_", crop="crop_", process=process)
    return E.to_metrics(scored, "doc_id", {"task.iou": 0.6, "evidence.crop_contains_truth": None, "evidence.faithfulness": 0.3, "process.efficiency": 0.1})


def temporal(spark, d):
    """Answers to pair requests: each seventh customer answers wrongly, each fifth abstains."""
    from .catalog_queries import best_pairs

    k = F.col("request_id")
    truth = best_pairs(spark, d)
    said = F.when(k % 5 == 0, "abstained").otherwise("submitted")
    should = F.when(F.col("status") == "selected", "submitted").otherwise("abstained")
    right, confident, needless = E.abstention(F.col("said"), F.col("should"))
    rows = truth.withColumns({"said": said, "should": should})
    status_ok = (F.col("status") == "selected") == (k % 7 != 0)
    eff = E.tool_efficiency(steps=3 + k % 5, ideal_steps=F.lit(4), calls=1 + k % 2, ideal_calls=F.lit(1), wall=900 + k % 300, wall_limit=F.lit(1000), failed=k % 2, renders=k % 3, expected_renders=F.lit(0))
    coverage = F.when(F.col("reason") == "wrong_date", "not_evaluated").when(F.col("reason") == "insufficient_coverage", "fail").otherwise("pass")
    return rows.select("request_id", status_ok.cast("int").cast("double").alias("validity"), coverage.alias("coverage_decision"), right, confident, needless, (status_ok & (F.col("said") == F.col("should"))).cast("int").cast("double").alias("faithfulness"), eff.alias("efficiency"))


def _pair_sql() -> str:
    from .catalog_queries import PAIR

    return PAIR


@query(f"""{_pair_sql()}, t AS (SELECT request_id, reason, reason='selected' AS sel, request_id%5=0 AS abst, (reason='selected')=(request_id%7<>0) AS ok FROM sel)
SELECT request_id, ok::INT::DOUBLE AS validity, CASE reason WHEN 'wrong_date' THEN 'not_evaluated' WHEN 'insufficient_coverage' THEN 'fail' ELSE 'pass' END AS coverage_decision, (sel<>abst)::INT::DOUBLE AS correct, NOT sel AND NOT abst AS false_confidence, sel AND abst AS unnecessary,
 (ok AND sel<>abst)::INT::DOUBLE AS faithfulness, round(least(1.0,4.0/(3+request_id%5))*least(1.0,1.0/(1+request_id%2))/(1+request_id%3)*least(1.0,1000.0/(900+request_id%300))/(1+request_id%2),6)::DOUBLE AS efficiency FROM t""")
def temporal_scores(spark, d):
    """Answers to pair requests, scored."""
    return temporal(spark, d)


@query(f"""{_pair_sql()}, an AS (SELECT request_id, CASE WHEN request_id%5=0 OR reason<>'selected' AND request_id%4<>0 THEN 'abstained' ELSE 'submitted' END AS said, before_id+(request_id%7=0)::INT AS said_before, after_id AS said_after, CASE WHEN request_id%10=0 THEN 'cloudy' ELSE reason END AS said_reason,
 CASE WHEN reason='selected' AND request_id%3=0 THEN [before_id] WHEN reason='selected' THEN [before_id,after_id] ELSE [] END AS cited FROM sel WHERE request_id%11<>0),
t AS (SELECT sel.*, coalesce(said,'abstained') AS said, CASE WHEN sel.reason='selected' THEN 'submitted' ELSE 'abstained' END AS should, said_before, said_after, said_reason, cited FROM sel LEFT JOIN an USING (request_id)),
v AS (SELECT *, coalesce(said=should AND CASE WHEN said='submitted' THEN said_before=before_id AND said_after=after_id ELSE said_reason=reason END,false) AS ok FROM t)
SELECT request_id, ok::INT::DOUBLE AS validity, (said=should)::INT::DOUBLE AS correct, should='abstained' AND said='submitted' AS false_confidence, should='submitted' AND said='abstained' AS unnecessary,
 coalesce(ok AND CASE WHEN said='submitted' THEN list_contains(cited,before_id) AND list_contains(cited,after_id) ELSE len(cited)=0 END,false)::INT::DOUBLE AS faithfulness FROM v""")
def temporal_answers(spark, d):
    """Recorded answers to pair requests against the best pairs."""
    from .catalog_queries import best_pairs

    truth, k = best_pairs(spark, d), F.col("request_id")
    chosen = F.col("status") == "selected"
    none = F.array().cast("array<bigint>")
    answers = truth.where("request_id % 11 <> 0").select(
        "request_id", F.when((k % 5 == 0) | (~chosen & (k % 4 != 0)), "abstained").otherwise("submitted").alias("said"), (F.col("before_id") + (k % 7 == 0).cast("int")).alias("said_before"), F.col("after_id").alias("said_after"),
        F.when(k % 10 == 0, "cloudy").otherwise(F.col("reason")).alias("said_reason"), F.when(chosen & (k % 3 == 0), F.array("before_id")).when(chosen, F.array("before_id", "after_id")).otherwise(none).alias("cited"),
    )
    return E.score_temporal(truth, answers, "request_id")


@query(f"""{_pair_sql()}, t AS (SELECT reason, reason='selected' AS sel, request_id%5=0 AS abst, request_id FROM sel), r AS (SELECT CASE WHEN sel THEN 'selected' ELSE 'rejected' END AS truth, sel<>abst AS passed, abst, request_id%900 AS tokens, 900+request_id%300 AS ms FROM t)
SELECT truth, count(*) AS episodes, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE abst) AS abstained, count(*) FILTER (WHERE passed AND abst) AS right_abstentions, count(*) FILTER (WHERE NOT passed AND NOT abst) AS false_confidence, count(*) FILTER (WHERE NOT passed AND abst) AS unnecessary_abstentions, sum(tokens)::BIGINT AS tokens, max(ms) AS longest_ms FROM r GROUP BY ROLLUP (truth)""")
def run_summary(spark, d):
    """Counts by truth and in all."""
    from .catalog_queries import best_pairs

    k = F.col("request_id")
    rows = best_pairs(spark, d)
    abstained = k % 5 == 0
    rows = rows.select(F.col("status").alias("truth"), ((F.col("status") == "selected") != abstained).alias("passed"), abstained.alias("abstained"), (k % 900).alias("tokens"), (900 + k % 300).alias("elapsed_ms"))
    return E.run_summary(rows, "truth")


@query("SELECT conv_id, count(*) FILTER (WHERE role='assistant') AS calls, coalesce(sum(length(text)) FILTER (WHERE role='assistant'),0)::BIGINT AS input_tokens, coalesce(sum(length(text)//4) FILTER (WHERE role='assistant'),0)::BIGINT AS output_tokens FROM conversations GROUP BY 1")
def transcript_costs(spark, d):
    """Calls and tokens; turns without usage are skipped."""
    n = F.length("text").cast("long")
    usage = F.when(F.col("role") == "assistant", F.struct(n.alias("input_tokens"), F.expr("cast(length(text) div 4 AS long)").alias("output_tokens")))
    return E.transcript_cost(V.read(spark, d, "conversations").select("conv_id", usage.alias("usage")), "conv_id")


@query("""WITH s AS (SELECT o_custkey AS episode_id, o_orderkey%50 AS evidence_id FROM orders), c AS (SELECT DISTINCT c_custkey AS episode_id, unnest([c_custkey%50, (c_custkey*3)%50, (c_custkey*7)%50]) AS evidence_id FROM customer)
SELECT episode_id, evidence_id FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.episode_id=c.episode_id AND s.evidence_id=c.evidence_id)""")
def unknown_citations(spark, d):
    """Cited evidence that an episode doesn't have."""
    k = F.col("c_custkey")
    answers = V.read(spark, d, "customer").select(k.alias("episode_id"), F.array(k % 50, (k * 3) % 50, (k * 7) % 50).alias("evidence_ids"))
    evidence = V.read(spark, d, "orders").select(F.col("o_custkey").alias("episode_id"), (F.col("o_orderkey") % 50).alias("evidence_id"))
    return E.unknown_citations(answers, evidence, "episode_id")


@query("""SELECT event_id, CASE WHEN event_id%11=0 THEN 'invalid_json' WHEN event_id%7=0 THEN 'missing_field' WHEN event_id%5=0 THEN 'wrong_type' WHEN event_type NOT IN ('click','view') THEN 'not_allowed' WHEN value<2 THEN 'below_minimum' WHEN value>100 THEN 'above_maximum' END AS code FROM events""")
def answer_checks(spark, d):
    """JSON answers against a table of rules; the first that fails wins."""
    k = F.col("event_id")
    number = F.when(k % 5 == 0, F.lit('"x"')).otherwise(F.col("value").cast("string"))
    text = F.when(k % 11 == 0, "{not json").when(k % 7 == 0, F.concat(F.lit('{"label":"'), F.col("event_type"), F.lit('"}'))).otherwise(F.concat(F.lit('{"score":'), number, F.lit(',"label":"'), F.col("event_type"), F.lit('"}')))
    answers = V.read(spark, d, "events").select("event_id", F.lit("s").alias("schema_id"), text.alias("answer"))
    rules = spark.createDataFrame(
        [("s", 1, "score", "number", True, None, None, None), ("s", 2, "label", "string", True, ["click", "view"], None, None), ("s", 3, "score", "number", False, None, 2.0, 100.0)],
        "schema_id string, rule_order int, field string, kind string, required boolean, allowed array<string>, low double, high double",
    )
    return E.validate_answers(answers, F.broadcast(rules), "event_id")


@query("SELECT coalesce(c_custkey,o_custkey) AS k, CASE WHEN o_custkey IS NULL THEN 'missing' WHEN c_custkey IS NULL THEN 'unexpected' ELSE 'matched' END AS status FROM (SELECT c_custkey FROM customer WHERE c_custkey%4<>0) c FULL JOIN (SELECT DISTINCT o_custkey FROM orders) o ON c_custkey=o_custkey")
def sample_status(spark, d):
    """Expected and actual samples."""
    return E.match_status(V.read(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k")), V.read(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("""WITH l AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_partkey)) AS a FROM lineitem GROUP BY 1), r AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_partkey)) AS b FROM lineitem WHERE l_linenumber<5 GROUP BY 1) SELECT k, a IS NOT DISTINCT FROM b AS equal FROM l FULL JOIN r USING (k)""")
def input_sets(spark, d):
    """Equal sets of inputs."""
    rows = V.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey", "l_linenumber")
    return E.same_sets(rows, rows.where("l_linenumber < 5"), "k", "l_partkey")


MANIFEST = """ex AS (SELECT c_custkey AS sample_id, c_nationkey AS want FROM customer WHERE c_custkey%50<>0), rp AS (SELECT c_custkey AS sample_id, CASE WHEN c_custkey%13=0 THEN -1 ELSE c_nationkey END AS task, c_custkey%17=0 AS bad_input, c_custkey%19=0 AS open_, 1+c_custkey%4 AS actions, c_custkey%23<>0 AS runs_ok, c_custkey%29<>0 AS rendered, CASE WHEN c_custkey%31=0 THEN 0 ELSE 10+c_custkey END AS tokens, c_acctbal/10000 AS reward FROM customer WHERE c_custkey%37<>0),
mf AS (SELECT coalesce(ex.sample_id,rp.sample_id) AS sample_id, list_sort(list_filter([CASE WHEN want IS NULL THEN 'expected' END, CASE WHEN rp.sample_id IS NULL THEN 'reported_once' END, CASE WHEN NOT coalesce(task=want,false) THEN 'task' END, CASE WHEN NOT coalesce(NOT bad_input AND want IS NOT NULL,false) THEN 'inputs' END,
 CASE WHEN coalesce(open_,true) THEN 'terminal' END, CASE WHEN rp.sample_id IS NULL THEN 'has_actions' END, CASE WHEN NOT coalesce(runs_ok,false) THEN 'one_run_each' END, CASE WHEN NOT coalesce(rendered,false) THEN 'rendered' END, CASE WHEN NOT coalesce(tokens BETWEEN 1 AND 100000,false) THEN 'tokens' END, CASE WHEN NOT coalesce(reward BETWEEN 0 AND 1,false) THEN 'reward' END], lambda x: x IS NOT NULL)) AS f, coalesce(tokens,0) AS tokens FROM ex FULL JOIN rp ON ex.sample_id=rp.sample_id)"""


def manifest(spark, d):
    k = F.col("c_custkey")
    customer = V.read(spark, d, "customer")
    inputs = F.array(F.concat(F.lit("a"), k.cast("string")), F.concat(F.lit("b"), k.cast("string")))
    expected = customer.where("c_custkey % 50 <> 0").select(k.alias("sample_id"), F.col("c_nationkey").alias("task_id"), inputs.alias("inputs"))
    actions = 1 + k % 4
    reports = customer.where("c_custkey % 37 <> 0").select(
        k.alias("sample_id"), F.when(k % 13 == 0, -1).otherwise(F.col("c_nationkey")).alias("task_id"), F.when(k % 17 == 0, F.array(F.lit("x"))).otherwise(F.reverse(inputs)).alias("inputs"), F.when(k % 19 == 0, "running").otherwise("submitted").alias("terminal"),
        actions.alias("actions"), F.when(k % 23 == 0, actions + 1).otherwise(actions).alias("tool_runs"), (k % 29 != 0).alias("rendered"), F.when(k % 31 == 0, 0).otherwise(10 + k).alias("tokens"), (F.col("c_acctbal") / 10000).alias("reward"),
    )
    return E.result_manifest(expected, reports)


@query(f"WITH {MANIFEST} SELECT sample_id, len(f)=0 AS passed, array_to_string(f,',') AS failed, tokens FROM mf")
def result_manifest(spark, d):
    """Ten named checks of each sample."""
    return manifest(spark, d)


@query(f"WITH {MANIFEST} SELECT count(*) AS samples, count(*) FILTER (WHERE len(f)=0) AS passed, sum(tokens)::BIGINT AS tokens, (SELECT array_to_string(list_sort(list(DISTINCT n)),',') FROM (SELECT unnest(f) AS n FROM mf)) AS failed_checks FROM mf")
def manifest_totals(spark, d):
    """Totals of the manifest."""
    return E.manifest_totals(manifest(spark, d))


#: Records of episodes, one a customer, made of orders and line items; the rules below are the operator's.
RECORDS = """ar AS (SELECT concat('ep2-',o_custkey) AS episode_id, o_orderkey AS artifact_id, concat('h',o_orderkey%400) AS sha256, concat(CASE WHEN o_orderkey%2=0 THEN 'a' ELSE 'b' END,o_custkey) AS input FROM orders),
ev AS (SELECT DISTINCT concat('ep2-',o_custkey) AS episode_id, CASE WHEN l_partkey%90=0 THEN -1 ELSE l_orderkey END AS artifact_id FROM lineitem JOIN orders ON l_orderkey=o_orderkey WHERE l_quantity>30),
ru AS (SELECT concat('ep2-',o_custkey) AS episode_id, o_orderkey//CASE WHEN o_custkey%6=0 THEN 64 ELSE 1 END AS action_id, o_orderstatus<>'P' OR o_custkey%3<>0 AS completed FROM orders),
ex AS (SELECT c_custkey AS sample_id, c_nationkey AS task_id, 1 AS task_version, concat('m',c_nationkey) AS manifest_sha, [concat('a',c_custkey),concat('b',c_custkey)] AS assets, [concat('c',c_custkey)] AS contents FROM customer WHERE c_custkey%50<>0),
ep AS (SELECT concat('ep2-',c_custkey) AS episode_id, CASE WHEN c_acctbal<-800 THEN 'running' ELSE 'terminated' END AS status, CASE WHEN c_custkey%13=0 THEN -1 ELSE c_nationkey END AS task_id, 1+(c_custkey%41=0)::INT AS task_version, concat('m',CASE WHEN c_custkey%43=0 THEN -1 ELSE c_nationkey END) AS manifest_sha,
 c_custkey%47 AS state_version, [concat('b',c_custkey),concat('a',c_custkey-(c_custkey%17=0)::INT)] AS assets, [concat('c',c_custkey-(c_custkey%19=0)::INT)] AS contents FROM customer WHERE c_custkey%23<>0),
rp AS (SELECT c_custkey AS sample_id, CASE WHEN c_custkey%29=0 THEN concat('old-',c_custkey) WHEN c_custkey%31=0 THEN concat('ep2-',c_custkey+1) ELSE concat('ep2-',c_custkey) END AS episode_id, CASE WHEN c_custkey%37=0 THEN 'failed' ELSE 'passed' END AS status, c_custkey%11 AS tool_calls,
 CASE WHEN c_custkey%7=0 THEN [] WHEN c_custkey%7=1 THEN ['other'] ELSE coalesce(hs,[]) END AS image_hashes, c_custkey%53<>0 AS has_metadata, c_custkey%59<>0 AS has_receipt, c_custkey%61<>0 AS adapter_bound, c_custkey%67<>0 AS resumable FROM customer LEFT JOIN (SELECT episode_id, list(DISTINCT sha256) AS hs FROM ar GROUP BY 1) h ON h.episode_id=concat('ep2-',c_custkey)),
am AS (SELECT episode_id, count(*) AS n_artifacts, list(DISTINCT sha256) AS made, list_sort(list(DISTINCT input)) AS used FROM ar GROUP BY 1), em AS (SELECT episode_id, count(*) AS n_evidence, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM ar WHERE ar.episode_id=ev.episode_id AND ar.artifact_id=ev.artifact_id)) AS unknown FROM ev GROUP BY 1),
rm AS (SELECT episode_id, sum(n) AS n_runs, count(*) FILTER (WHERE n<>1 OR done<>1) AS odd FROM (SELECT episode_id, action_id, count(*) AS n, count(*) FILTER (WHERE completed) AS done FROM ru GROUP BY 1,2) GROUP BY 1), tm AS (SELECT concat('ep2-',user_id) AS episode_id, count(*) AS n_events FROM events GROUP BY 1),
jo AS (SELECT rp.*, ex.task_id AS wt, ex.task_version AS wv, ex.manifest_sha AS wm, ex.assets AS wa, ex.contents AS wc, ep.status AS es, ep.task_id AS et, ep.task_version AS ev_, ep.manifest_sha AS em_, ep.state_version, ep.assets AS ea, ep.contents AS ec, n_events, n_artifacts, made, used, n_evidence, unknown, n_runs, odd
 FROM rp LEFT JOIN ex USING (sample_id) LEFT JOIN ep USING (episode_id) LEFT JOIN tm USING (episode_id) LEFT JOIN am USING (episode_id) LEFT JOIN em USING (episode_id) LEFT JOIN rm USING (episode_id)),
ck AS (SELECT sample_id, episode_id, list_sort(list_filter([CASE WHEN status<>'passed' THEN 'report_passed' END, CASE WHEN tool_calls<=0 THEN 'tool_called' END, CASE WHEN len(image_hashes)=0 THEN 'image_sent' END, CASE WHEN NOT has_metadata THEN 'response_metadata' END, CASE WHEN NOT has_receipt THEN 'image_receipt' END,
 CASE WHEN NOT adapter_bound THEN 'adapter_bound' END, CASE WHEN NOT resumable THEN 'resumable' END, CASE WHEN NOT starts_with(episode_id,'ep2-') THEN 'episode_named' END, CASE WHEN NOT coalesce(es='terminated',false) THEN 'episode_ended' END, CASE WHEN NOT coalesce(et=wt AND ev_=wv,false) THEN 'same_task' END,
 CASE WHEN NOT coalesce(em_=wm,false) THEN 'same_manifest' END, CASE WHEN es IS NULL OR n_events IS NULL THEN 'has_events' END, CASE WHEN es IS NULL OR n_evidence IS NULL THEN 'has_evidence' END, CASE WHEN es IS NULL OR n_artifacts IS NULL THEN 'has_artifacts' END, CASE WHEN es IS NULL OR n_runs IS NULL THEN 'has_runs' END,
 CASE WHEN es IS NULL OR coalesce(odd,0)>0 THEN 'one_run_each' END, CASE WHEN es IS NULL OR coalesce(unknown,0)>0 THEN 'evidence_known' END, CASE WHEN coalesce(state_version,0)<=0 THEN 'state_counted' END, CASE WHEN es IS NULL OR len(image_hashes)=0 OR len(list_filter(image_hashes, lambda x: NOT coalesce(list_contains(made,x),false)))>0 THEN 'images_of_episode' END,
 CASE WHEN NOT coalesce(list_sort(ea)=list_sort(wa),false) THEN 'same_assets' END, CASE WHEN NOT coalesce(ec=wc,false) THEN 'same_contents' END, CASE WHEN NOT coalesce(used=list_sort(wa),false) THEN 'all_inputs_used' END], lambda x: x IS NOT NULL)) AS f FROM jo)"""


def records(spark, d):
    """The same tables: expected, reports, episodes, events, artifacts, evidence, runs."""
    k, n, o, c = F.col("c_custkey"), F.col("c_nationkey"), F.col("o_orderkey"), F.col("o_custkey")
    customer, orders = V.read(spark, d, "customer"), V.read(spark, d, "orders")
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    at = lambda m: (k % m == 0).cast("int")
    artifacts = orders.select(text("ep2-", c).alias("episode_id"), o.alias("artifact_id"), text("h", o % 400).alias("sha256"), F.concat(F.when(o % 2 == 0, "a").otherwise("b"), c.cast("string")).alias("input"))
    lines = V.read(spark, d, "lineitem").where("l_quantity > 30").join(orders, F.col("l_orderkey") == o)
    evidence = lines.select(text("ep2-", c).alias("episode_id"), F.when(F.col("l_partkey") % 90 == 0, -1).otherwise(F.col("l_orderkey")).alias("artifact_id")).distinct()
    runs = orders.select(text("ep2-", c).alias("episode_id"), F.when(c % 6 == 0, F.expr("o_orderkey div 64")).otherwise(o).alias("action_id"), ((F.col("o_orderstatus") != "P") | (c % 3 != 0)).alias("completed"))
    expected = customer.where("c_custkey % 50 <> 0").select(k.alias("sample_id"), n.alias("task_id"), F.lit(1).alias("task_version"), text("m", n).alias("manifest_sha"), F.array(text("a", k), text("b", k)).alias("assets"), F.array(text("c", k)).alias("contents"))
    episodes = customer.where("c_custkey % 23 <> 0").select(
        text("ep2-", k).alias("episode_id"), F.when(F.col("c_acctbal") < -800, "running").otherwise("terminated").alias("status"), F.when(k % 13 == 0, -1).otherwise(n).alias("task_id"), (1 + at(41)).alias("task_version"), text("m", F.when(k % 43 == 0, -1).otherwise(n)).alias("manifest_sha"),
        (k % 47).alias("state_version"), F.array(text("b", k), text("a", k - at(17))).alias("assets"), F.array(text("c", k - at(19))).alias("contents"),
    )
    hashes = artifacts.groupBy("episode_id").agg(F.collect_set("sha256").alias("hs"))
    nothing = F.array().cast("array<string>")
    reports = customer.join(hashes, F.col("episode_id") == text("ep2-", k), "left").select(
        k.alias("sample_id"), F.when(k % 29 == 0, text("old-", k)).when(k % 31 == 0, text("ep2-", k + 1)).otherwise(text("ep2-", k)).alias("episode_id"), F.when(k % 37 == 0, "failed").otherwise("passed").alias("status"), (k % 11).alias("tool_calls"),
        F.when(k % 7 == 0, nothing).when(k % 7 == 1, F.array(F.lit("other"))).otherwise(F.coalesce("hs", nothing)).alias("image_hashes"), (k % 53 != 0).alias("has_metadata"), (k % 59 != 0).alias("has_receipt"), (k % 61 != 0).alias("adapter_bound"), (k % 67 != 0).alias("resumable"),
    )
    events = V.read(spark, d, "events").select(text("ep2-", F.col("user_id")).alias("episode_id"))
    return expected, reports, episodes, events, artifacts, evidence, runs


@query(f"WITH {RECORDS} SELECT sample_id, episode_id, len(f)=0 AS passed, array_to_string(f,',') AS failed FROM ck")
def report_checks(spark, d):
    """22 named checks of each report against its episode's records."""
    return E.report_checks(*records(spark, d))


@query(f"""WITH {RECORDS} SELECT (SELECT count(*) FROM ex) AS samples, count(*) AS reported, count(*) FILTER (WHERE len(f)=0) AS passed, count(DISTINCT episode_id)=count(*) AS episodes_unique,
 (SELECT array_to_string(list_sort(list(concat(n,'=',c))),',') FROM (SELECT n, count(*) AS c FROM (SELECT unnest(f) AS n FROM ck) GROUP BY 1)) AS failed_checks FROM ck""")
def report_totals(spark, d):
    """Totals of the 22 checks."""
    made = records(spark, d)
    return E.report_totals(E.report_checks(*made), made[0])


@query("""WITH h AS (SELECT o_custkey AS episode_id, o_orderkey AS memory_id, o_orderstatus AS found FROM orders WHERE o_orderstatus<>'P'), f AS (SELECT episode_id, count(*) AS n, min(memory_id) AS first, arg_min(found,memory_id) AS found FROM h GROUP BY 1),
a AS (SELECT c_custkey AS episode_id, CASE WHEN c_custkey%2=0 THEN 'with' ELSE 'without' END AS treatment, CASE WHEN c_nationkey%2=0 THEN 'F' ELSE 'O' END AS truth, coalesce(CASE WHEN c_custkey%2=0 THEN found END,'unknown') AS said, CASE WHEN c_custkey%9=0 THEN [first,-1] WHEN c_custkey%2=0 AND first IS NOT NULL THEN [first] ELSE [] END AS cited, (CASE WHEN c_custkey%2=0 THEN c_custkey%4 ELSE (c_custkey%7=0)::INT END) AS searches FROM customer LEFT JOIN f ON f.episode_id=c_custkey),
s AS (SELECT episode_id, treatment, (said=truth)::INT::DOUBLE AS accuracy, (len(cited)>0 AND NOT list_contains(cited,-1))::INT::DOUBLE AS faithfulness, CASE WHEN treatment='with' AND searches>0 THEN round(least(1.0,1.0/searches),6) WHEN treatment='without' AND searches=0 THEN 1.0 ELSE 0.0 END::DOUBLE AS efficiency FROM a)
SELECT *, round(0.6*accuracy+0.3*faithfulness+0.1*efficiency,6)::DOUBLE AS reward FROM s""")
def memory_scores(spark, d):
    """Answers with and without memory: accuracy, faithfulness to what was found, efficiency."""
    k, o = F.col("c_custkey"), V.read(spark, d, "orders").where("o_orderstatus <> 'P'")
    hits = o.select(F.col("o_custkey").alias("episode_id"), F.col("o_orderkey").alias("memory_id"), F.col("o_orderstatus").alias("found"))
    first = hits.groupBy("episode_id").agg(F.min("memory_id").alias("first"), F.min_by("found", "memory_id").alias("found"))
    rows = V.read(spark, d, "customer").join(first, k == F.col("episode_id"), "left").drop("episode_id")
    even = k % 2 == 0
    answers = rows.select(
        k.alias("episode_id"), F.when(even, "with").otherwise("without").alias("treatment"), F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("O").alias("truth"), F.coalesce(F.when(even, F.col("found")), F.lit("unknown")).alias("said"),
        F.when(k % 9 == 0, F.array(F.col("first"), F.lit(-1))).when(even & F.col("first").isNotNull(), F.array("first")).otherwise(F.array().cast("array<bigint>")).alias("cited"), F.when(even, k % 4).otherwise((k % 7 == 0).cast("int")).alias("searches"),
    )
    return E.score_memory(answers, hits, "episode_id")


@query("""SELECT l.doc_id%20 AS "window", count(*) FILTER (WHERE quality=1 AND toxic=0) AS tn, count(*) FILTER (WHERE quality=1 AND toxic=1) AS fp, count(*) FILTER (WHERE quality=0 AND toxic=0) AS fn, count(*) FILTER (WHERE quality=0 AND toxic=1) AS tp FROM labels l GROUP BY 1""")
def label_confusion(spark, d):
    """A07 on labels: one kind of label against another."""
    from ..operators import confusion as C

    return C.confusion(V.read(spark, d, "labels").withColumn("window", F.col("doc_id") % 20), F.col("quality") == 0, F.col("toxic") == 1, ["window"])


@query("""WITH r AS (SELECT o_custkey AS benchmark_id, o_orderkey%4 AS c, o_orderkey%5=0 AS counterfactual, o_orderkey%11<>0 AS passed, CASE WHEN o_orderkey%5=0 THEN o_orderkey%3<>0 WHEN o_orderkey%13=0 THEN NULL ELSE o_orderkey%17=0 END AS fc FROM orders),
g AS (SELECT benchmark_id, count(*) FILTER (WHERE NOT counterfactual) AS correct_total, count(*) FILTER (WHERE NOT counterfactual AND passed) AS correct_passed, count(*) FILTER (WHERE NOT counterfactual AND c<>0) AS rejection_total, count(*) FILTER (WHERE NOT counterfactual AND c<>0 AND fc) AS rejection_false,
 count(*) FILTER (WHERE NOT counterfactual AND c<>0 AND NOT fc) AS sure, count(*) FILTER (WHERE counterfactual) AS counterfactual_total, count(*) FILTER (WHERE counterfactual AND passed AND fc) AS counterfactual_passed FROM r GROUP BY 1)
SELECT * EXCLUDE (sure), CASE WHEN correct_total=4 AND correct_passed=4 AND rejection_total=3 AND sure=3 AND counterfactual_total=1 AND counterfactual_passed=1 THEN 'passed' ELSE 'failed' END AS status FROM g""")
def benchmark_groups(spark, d):
    """Right runs, rejections and counterfactuals of each benchmark."""
    k = F.col("o_orderkey")
    sure = F.when(k % 5 == 0, k % 3 != 0).when(k % 13 != 0, k % 17 == 0)
    runs = V.read(spark, d, "orders").select(F.col("o_custkey").alias("benchmark_id"), F.when(k % 4 == 0, "valid-pair").otherwise("other").alias("case_id"), (k % 5 == 0).alias("counterfactual"), (k % 11 != 0).alias("passed"), sure.alias("false_confidence"))
    return E.group_summary(runs, "benchmark_id")
