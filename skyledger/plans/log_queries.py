"""Queries over event logs and evidence memory."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import log as L
from ..operators import memory as M
from ..sources import chained
from ..sources.scratch import folder, written
from . import views as V
from .registry import query

LIMITS = {"steps": 150, "tool_calls": 40, "input_bytes": 1500, "wall_time_ms": 90}


TRACE = "WITH h AS (SELECT episode_id, sequence, sha256({one}) AS h FROM v_log), b AS (SELECT episode_id, sequence//16 AS b, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY sequence)) AS h FROM h GROUP BY 1,2) SELECT episode_id, sum(n)::BIGINT AS events, sha256(string_agg(h, chr(10) ORDER BY b)) AS trace_hash FROM b GROUP BY 1"


@query(TRACE.format(one="concat(event_id,chr(0),event_type,chr(0),props)"))
def trace_hashes(spark, d):
    """One hash of each episode's events in order, by blocks of sixteen."""
    return L.trace_hash(V.log(spark, d), "episode_id", "sequence", ["event_id", "event_type", "props"], block=16)


@query(TRACE.format(one="""concat(event_type,chr(0),'{"k":',CAST(json_extract(props,'$.k') AS BIGINT),'}')"""))
def semantic_trace_hashes(spark, d):
    """The same of what the events mean, without ids and times."""
    payload = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"created_at":"x","k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    return L.trace_hash(V.log(spark, d), "episode_id", "sequence", ["event_type", hashing.semantic(payload)], block=16)


@query("SELECT episode_id, count(*) AS events, count(DISTINCT event_type) AS kinds, min(sequence) AS first_sequence, max(sequence) AS last_sequence, arg_max(event_id,sequence) AS head, max(sequence)+1 AS next_sequence FROM v_log GROUP BY 1")
def event_counts(spark, d):
    """Counts, ends and the next sequence of each log."""
    return L.event_counts(V.log(spark, d), "episode_id", "sequence", "event_type", "event_id")


def chain_log(spark, d):
    return V.log(spark, d).select("episode_id", (F.col("sequence") + 1).alias("sequence"), "event_id", "event_type")


CONTENT = ["event_id", "event_type"]
CHAIN = """c AS (SELECT episode_id, sequence+1 AS sequence, concat(event_id,'|',event_type) AS content FROM v_log), k AS (SELECT episode_id, sequence, repeat('0',64) AS p, sha256(concat(content,'|',repeat('0',64))) AS h FROM c WHERE sequence=1
 UNION ALL SELECT c.episode_id, c.sequence, k.h, sha256(concat(c.content,'|',k.h)) FROM k JOIN c ON c.episode_id=k.episode_id AND c.sequence=k.sequence+1)"""


def content():
    return F.concat_ws("|", *(F.col(c).cast("string") for c in CONTENT))


@query(f"WITH RECURSIVE {CHAIN} SELECT episode_id, sequence, p AS previous_event_sha256, h AS event_sha256 FROM k")
def build_chain(spark, d):
    """A hash chain of each scope."""
    return L.build_chain(chain_log(spark, d), "episode_id", "sequence", content())


@query(f"WITH RECURSIVE {CHAIN}, n AS (SELECT episode_id, count(*) AS n FROM v_log GROUP BY 1) SELECT episode_id, sequence, p AS previous_event_sha256, h AS event_sha256, greatest(0, least(n, 8) - 3) AS refused FROM k JOIN n USING (episode_id)")
def chained_append(spark, d):
    """Three batches of one writer, a batch of another whose heads are stale, and a batch that comes twice."""
    path, rows = folder(spark), chain_log(spark, d)

    def send(batch, name, expected=None):
        return chained.append(batch, path, scope="episode_id", order="n", content=content(), batch_id=name, expected=expected)

    rows = rows.withColumnRenamed("sequence", "n")
    send(rows.where("n <= 3"), "a")
    seen = written(chained.heads(spark, path, "episode_id", "long"))
    middle = rows.where("n BETWEEN 4 AND 8")
    send(middle, "b", seen)
    late = send(middle.withColumn("event_type", F.lit("late")), "other writer", seen)
    send(middle, "b", seen)
    send(rows.where("n > 8"), "c")
    refused = late.where("code = 'stale_head'").select("episode_id", F.col("events").alias("refused"))
    return chained.read(spark, path).join(refused, "episode_id", "left").select("episode_id", "sequence", "previous_event_sha256", "event_sha256", F.coalesce("refused", F.lit(0)).cast("long").alias("refused"))


@query("SELECT episode_id, count(*) AS events, CASE WHEN episode_id%3=0 AND count(*)>=5 THEN 5::BIGINT END AS first_bad, CASE WHEN episode_id%3=0 AND count(*)>=5 THEN 'hash_mismatch' END AS code FROM v_log GROUP BY 1")
def verify_chain(spark, d):
    """A changed event in each third scope is found at its place."""
    rows = chain_log(spark, d)
    made = L.build_chain(rows, "episode_id", "sequence", content())
    both = rows.join(made, ["episode_id", "sequence"])
    hit = (F.col("episode_id") % 3 == 0) & (F.col("sequence") == 5)
    damaged = both.withColumn("event_type", F.when(hit, "changed").otherwise(F.col("event_type")))
    return L.verify_chain(damaged, "episode_id", "sequence", content())


@query("WITH w AS (SELECT episode_id, sequence, event_type, event_id, lag(event_id) OVER (PARTITION BY episode_id ORDER BY sequence) AS b FROM v_log) SELECT episode_id, true AS contiguous, true AS unique_ids, bool_and(coalesce(b<=event_id,true)) AS monotone_version, arg_min(event_type,sequence)='view' AS starts_right FROM w GROUP BY 1")
def trace_checks(spark, d):
    """Structural checks of each episode (event ids stand for state versions)."""
    return L.trace_checks(V.log(spark, d), "episode_id", "sequence", "event_id", "event_id", "view", "event_type")


@query("WITH w AS (SELECT episode_id, sequence, event_type, event_id, lag(event_id) OVER (PARTITION BY episode_id ORDER BY sequence) AS b FROM v_log), c AS (SELECT episode_id, bool_and(coalesce(b<=event_id,true)) AS m, arg_min(event_type,sequence)='view' AS s FROM w GROUP BY 1) SELECT episode_id, m AND s AS passed, concat_ws(',', CASE WHEN NOT m THEN 'monotone_version' END, CASE WHEN NOT s THEN 'starts_right' END) AS failed FROM c")
def trace_report(spark, d):
    """All checks, and the names of those that failed."""
    return L.all_passed(trace_checks(spark, d), "episode_id", ["contiguous", "unique_ids", "monotone_version", "starts_right"])


@query("""SELECT episode_id, count(*) FILTER (WHERE sequence%10<>3 AND sequence%10<>4 AND sequence%10<>5)+count(*) FILTER (WHERE sequence%10=5 AND false) AS equal, count(*) FILTER (WHERE sequence%10=3) AS missing, count(*) FILTER (WHERE sequence%10=4) AS unexpected, count(*) FILTER (WHERE sequence%10=5) AS changed,
 min(sequence) FILTER (WHERE sequence%10 BETWEEN 3 AND 5) AS first_difference FROM v_log GROUP BY 1""")
def trace_diff(spark, d):
    """Recorded against replayed events."""
    rows = V.log(spark, d).withColumn("h", hashing.digest(F.col("event_id"), F.col("event_type")))
    k = F.col("sequence") % 10
    expected = rows.where(k != 4)
    actual = rows.where(k != 3).withColumn("h", F.when(k == 5, "changed").otherwise(F.col("h")))
    return L.diff_traces(expected, actual, "episode_id", "sequence", "h")


@query("""WITH e AS (SELECT DISTINCT episode_id FROM v_log), o AS (SELECT o_custkey AS episode_id, o_orderkey%9 AS sha256, o_orderkey%40=0 AS lost, o_orderkey%50=0 AS twice FROM orders),
a AS (SELECT episode_id, sha256, count(*) AS n, count(*) FILTER (WHERE NOT lost)+count(*) FILTER (WHERE NOT lost AND twice) AS m FROM o GROUP BY 1,2), s AS (SELECT episode_id, sum(greatest(0,n-m))::BIGINT AS artifacts_missing, sum(greatest(0,m-n))::BIGINT AS artifacts_unexpected FROM a GROUP BY 1),
j AS (SELECT coalesce(e.episode_id,s.episode_id) AS episode_id, e.episode_id IS NULL OR e.episode_id%4<>1 AS events_equal, e.episode_id IS NULL OR e.episode_id%5<>2 AS state_equal, coalesce(artifacts_missing,0) AS artifacts_missing, coalesce(artifacts_unexpected,0) AS artifacts_unexpected FROM e FULL JOIN s ON s.episode_id=e.episode_id)
SELECT *, events_equal AND state_equal AND artifacts_missing+artifacts_unexpected=0 AS reproduced FROM j""")
def replay_report(spark, d):
    """Events, states and artifacts of a recording against its replay."""
    log = V.log(spark, d).withColumn("h", hashing.digest(F.col("event_id"), F.col("event_type")))
    e = F.col("episode_id")
    events = L.diff_traces(log, log.withColumn("h", F.when((e % 4 == 1) & (F.col("sequence") == 0), "other").otherwise(F.col("h"))), "episode_id", "sequence", "h")
    states = log.groupBy("episode_id").agg(F.max("event_id").cast("string").alias("state_hash"))
    o = V.read(spark, d, "orders").select(F.col("o_custkey").alias("episode_id"), (F.col("o_orderkey") % 9).alias("sha256"), F.col("o_orderkey").alias("k"))
    kept = o.where("k % 40 <> 0")
    return L.replay_report(events, (states, states.withColumn("state_hash", F.when(e % 5 == 2, "other").otherwise(F.col("state_hash")))), (o, kept.unionByName(kept.where("k % 50 = 0"))), "episode_id")


@query("""WITH p AS (SELECT l.*, row_number() OVER (PARTITION BY episode_id ORDER BY sequence) AS n, count(*) OVER (PARTITION BY episode_id) AS m FROM v_log l WHERE sequence>episode_id%50)
SELECT episode_id, sequence, event_id, m>7 AS has_more, max(sequence) OVER (PARTITION BY episode_id) AS next_cursor FROM p WHERE n<=7""")
def trace_pages(spark, d):
    """A page of seven events behind a cursor of each episode."""
    rows = V.log(spark, d)
    cursors = rows.select("episode_id").distinct().withColumns({"cursor": F.col("episode_id") % 50, "limit": F.lit(7)})
    return L.trace_page(rows, cursors, "episode_id", "sequence").select("episode_id", "sequence", "event_id", "has_more", "next_cursor")


@query("""WITH r AS (SELECT episode_id, event_id%20 AS action, event_type AS body, sequence, first_value(event_type) OVER (PARTITION BY episode_id, event_id%20 ORDER BY sequence) AS f, row_number() OVER (PARTITION BY episode_id, event_id%20 ORDER BY sequence) AS n FROM v_log)
SELECT episode_id, action, sequence, CASE WHEN n=1 THEN 'accepted' WHEN body=f THEN 'replay' ELSE 'conflict' END AS verdict FROM r""")
def idempotency(spark, d):
    """Repeated actions are replays or conflicts."""
    rows = V.log(spark, d).select("episode_id", (F.col("event_id") % 20).alias("action"), F.col("event_type").alias("body"), "sequence")
    return L.idempotency(rows, ["episode_id", "action"], "body", "sequence").drop("body")


@query("""WITH a AS (SELECT episode_id, event_id%10 AS k, count(*) AS accepted FROM v_log WHERE event_type='click' GROUP BY 1,2), r AS (SELECT episode_id, event_id%10 AS k, count(*) AS results FROM v_log WHERE event_type='view' GROUP BY 1,2)
SELECT episode_id, k, coalesce(accepted,0) AS accepted, coalesce(results,0) AS results, CASE WHEN accepted IS NULL THEN 'unexpected_result' WHEN results IS NULL THEN 'missing_result' WHEN results>accepted THEN 'duplicate_result' WHEN results<accepted THEN 'missing_result' END AS code FROM a FULL JOIN r USING (episode_id,k)""")
def action_results(spark, d):
    """Accepted actions and results, both ways."""
    rows = V.log(spark, d).withColumn("k", F.col("event_id") % 10)
    return L.action_coverage(rows.where("event_type = 'click'"), rows.where("event_type = 'view'"), ["episode_id", "k"])


@query("SELECT episode_id, k, event_id FROM (SELECT episode_id, event_id%10 AS k, event_id FROM v_log WHERE event_type='signup') s WHERE NOT EXISTS (SELECT 1 FROM v_log l WHERE l.event_type='purchase' AND l.episode_id=s.episode_id AND l.event_id%10=s.k)")
def unmatched_starts(spark, d):
    """Started and never completed."""
    rows = V.log(spark, d).select("episode_id", (F.col("event_id") % 10).alias("k"), "event_id", "event_type")
    return L.unmatched_starts(rows, ["episode_id", "k"], "event_type", "signup", "purchase").drop("event_type")


@query("SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey%3<>0 UNION ALL SELECT o_custkey, 'backfill' FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey%3<>0)")
def backfill(spark, d):
    """Rows that aren't there yet."""
    old = V.read(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    new = V.read(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("name", F.lit("backfill"))
    return L.backfill(old, new, ["k"])


def _counter_sql(name, limit, used):
    return f"least({used},{limit}) AS {name}_used, greatest({limit}-least({used},{limit}),0) AS {name}_remaining"


@query(f"""WITH g AS (SELECT episode_id, count(*) AS s, count(*) FILTER (WHERE event_type='click') AS t, sum(length(props))::BIGINT AS b, max(sequence)::BIGINT AS w FROM v_log GROUP BY 1)
SELECT episode_id, {_counter_sql('steps', 150, 's')}, {_counter_sql('tool_calls', 40, 't')}, {_counter_sql('input_bytes', 1500, 'b')}, {_counter_sql('wall_time_ms', 90, 'w')}, s>=150 OR w>=90 AS exhausted FROM g""")
def budget_use(spark, d):
    """Counters of each episode, held within limits."""
    return L.budget_use(V.log(spark, d), "episode_id", steps=F.lit(1), tools=(F.col("event_type") == "click").cast("int"), size=F.length("props"), wall=F.col("sequence"), limits=LIMITS)


@query("SELECT episode_id, count(*) AS events, sum(octet_length(encode(props)))::BIGINT AS bytes, count(*)<=100 AND sum(octet_length(encode(props)))<=1000 AS within FROM v_log GROUP BY 1")
def size_guard(spark, d):
    """Rows and bytes before anything is parsed."""
    return L.size_guard(V.log(spark, d), "episode_id", "props", most_rows=100, most_bytes=1000)


@query("""WITH a AS (SELECT event_id AS k, user_id AS episode_id, event_id%9 AS req FROM events WHERE event_type='click'), r AS (SELECT k, CASE WHEN k%11=0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN k%13=0 THEN req+1 ELSE req END AS req FROM a WHERE k%5<>0 UNION ALL SELECT k, 'completed', req FROM a WHERE k%7=0 AND k%5<>0)
SELECT a.episode_id, a.k AS client_action_id, CASE WHEN g.n IS NULL THEN 'missing_run' WHEN g.n>1 THEN 'duplicate_run' WHEN g.status<>'completed' THEN 'not_completed' WHEN g.req<>a.req THEN 'request_mismatch' END AS code FROM a LEFT JOIN (SELECT k, count(*) AS n, min(status) AS status, min(req) AS req FROM r GROUP BY 1) g ON g.k=a.k""")
def action_runs(spark, d):
    """Each tool action has one completed run of the same request."""
    k = F.col("client_action_id")
    request = lambda n: F.sha2(hashing.canonical(F.concat(F.lit('{"tool":"x","n":'), n.cast("string"), F.lit("}"))), 256)
    acts = V.read(spark, d, "events").where("event_type = 'click'").select(F.col("user_id").alias("episode_id"), F.col("event_id").alias("client_action_id"), (F.col("event_id") % 9).alias("n"))
    once = acts.where(k % 5 != 0).select("episode_id", "client_action_id", F.when(k % 11 == 0, "failed").otherwise("completed").alias("status"), request(F.when(k % 13 == 0, F.col("n") + 1).otherwise(F.col("n"))).alias("request"))
    again = acts.where((k % 7 == 0) & (k % 5 != 0)).select("episode_id", "client_action_id", F.lit("completed").alias("status"), request(F.col("n")).alias("request"))
    return L.run_codes(acts.withColumn("request", request(F.col("n"))), once.unionByName(again), ["episode_id", "client_action_id"], "request", "status")


@query("""WITH f AS (SELECT episode_id, arg_min(event_type, sequence) AS first FROM v_log WHERE NOT (episode_id%10=3 AND sequence=0) GROUP BY 1) SELECT c_custkey AS episode_id, CASE WHEN f.episode_id IS NULL THEN 'no_events' WHEN c_custkey%10=3 THEN 'not_from_zero' WHEN first='view' THEN 'pin_missing' WHEN first<>'click' THEN 'pin_mismatch' END AS code FROM customer LEFT JOIN f ON f.episode_id=c_custkey""")
def pinned_traces(spark, d):
    """The first event of an episode holds the hash of its manifest."""
    sha = lambda c: F.sha2(c, 256)
    rows = V.log(spark, d).where("NOT (episode_id % 10 = 3 AND sequence = 0)").withColumn("manifest", F.when(F.col("event_type") != "view", sha(F.col("event_type"))))
    pins = V.read(spark, d, "customer").select(F.col("c_custkey").alias("episode_id"), sha(F.lit("click")).alias("manifest"))
    return L.pinned(rows, pins, "episode_id", "sequence", "manifest")


@query("""WITH r AS (SELECT episode_id, sequence, concat('mem-',event_id) AS a, concat('mem-',event_id+1) AS b, event_id%4 AS n FROM v_log WHERE event_type='view' AND event_id%5<>0), i AS (SELECT episode_id, sequence, 0 AS p, a AS id FROM r WHERE n>0 UNION ALL SELECT episode_id, sequence, 1, b FROM r WHERE n>1)
SELECT episode_id, count(id) AS count, coalesce(string_agg(id, ',' ORDER BY sequence, p), '') AS ids FROM (SELECT DISTINCT episode_id FROM r) LEFT JOIN i USING (episode_id) GROUP BY 1""")
def returned_memories(spark, d):
    """How many memories a tool returned to each episode, and which."""
    e = F.col("event_id")
    one = lambda x: F.concat(F.lit('{"memory_id":"mem-'), x.cast("string"), F.lit('"}'))
    records = F.when(e % 4 == 0, "").when(e % 4 == 1, one(e)).otherwise(F.concat(one(e), F.lit(","), one(e + 1)))
    payload = F.when(e % 5 == 0, F.lit('{"error":"x"}')).otherwise(F.concat(F.lit('{"matched_count":9,"records":['), records, F.lit("]}")))
    found = L.returned_ids(V.log(spark, d).withColumn("payload", payload), "episode_id", "event_type", "view", "payload", "sequence")
    return found.withColumn("ids", F.array_join("ids", ","))


@query("SELECT episode_id, event_type, arg_max(value,sequence) AS last_result, max(sequence) AS last_sequence FROM v_log GROUP BY 1,2")
def last_results(spark, d):
    """The last result of each tool."""
    return L.last_result(V.log(spark, d), ["episode_id", "event_type"], "sequence", "value")


@query("SELECT event_id, CAST(json_extract(props,'$.k') AS BIGINT) AS k, sha256(concat('{\"k\":',CAST(json_extract(props,'$.k') AS BIGINT),'}')) AS h FROM events")
def canonical_payloads(spark, d):
    """Payloads parsed once, hashed in canonical form."""
    v = F.parse_json("props")
    return V.read(spark, d, "events").select("event_id", F.variant_get(v, "$.k", "bigint").alias("k"), F.sha2(hashing.canonical(F.col("props")), 256).alias("h"))


@query("SELECT event_id, concat('{\"inner\":{\"k\":',CAST(json_extract(props,'$.k') AS BIGINT),'},\"wall_time_ms\":{\"limit\":9}}') AS meaning FROM events")
def semantic_payloads(spark, d):
    """nested payloads without what differs between runs."""
    text = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"inner":{"created_at":"x","k":'), F.get_json_object("props", "$.k"), F.lit('},"wall_time_ms":{"limit":9,"used":4}}'))
    return V.read(spark, d, "events").select("event_id", hashing.semantic(text).alias("meaning"))


@query("""SELECT event_id, concat('{"answer":{"created_at":"x"},"evidence_ids":["e',event_id,'"],"inner":{"client_action_id":',event_id,',"k":',CAST(json_extract(props,'$.k') AS BIGINT),'},"wall_time_ms":{"limit":9}}') AS meaning FROM events""")
def replay_payloads(spark, d):
    """as a replay compares them: cited evidence, actions and answers stay."""
    e = F.col("event_id").cast("string")
    text = F.concat(F.lit('{"event_id":'), e, F.lit(',"evidence_ids":["e'), e, F.lit('"],"answer":{"created_at":"x"},"inner":{"created_at":"x","client_action_id":'), e, F.lit(',"k":'), F.get_json_object("props", "$.k"), F.lit('},"wall_time_ms":{"limit":9,"used":4}}'))
    return V.read(spark, d, "events").select("event_id", hashing.semantic(text, replay=True).alias("meaning"))


MEM = """e AS (SELECT episode_id AS scope_id, sequence, CASE WHEN event_type IN ('error','signup') THEN 'invalidate' ELSE 'publish' END AS event_type, event_id*13%101 AS memory_id FROM v_log)"""


def memory_events(spark, d):
    kind = F.when(F.col("event_type").isin("error", "signup"), "invalidate").otherwise("publish")
    return V.log(spark, d).select(F.col("episode_id").alias("scope_id"), "sequence", kind.alias("event_type"), (F.col("event_id") * 13 % 101).alias("memory_id"))


@query(f"""WITH {MEM}, g AS (SELECT scope_id, memory_id, count(*) FILTER (WHERE event_type='publish') AS n, min(sequence) FILTER (WHERE event_type='publish') AS published_at, min(sequence) FILTER (WHERE event_type='invalidate') AS invalidated_at FROM e WHERE sequence<=60 GROUP BY 1,2)
SELECT scope_id, memory_id, published_at, invalidated_at, n>0 AND invalidated_at IS NULL AS active, CASE WHEN n=0 THEN 'invalidate_without_publish' WHEN n>1 THEN 'published_twice' WHEN invalidated_at<published_at THEN 'invalidate_before_publish' END AS code FROM g""")
def memory_snapshot(spark, d):
    """What is active as of sequence 60."""
    rows = memory_events(spark, d)
    return M.snapshot(rows, rows.select("scope_id").distinct().withColumn("as_of", F.lit(60)))


@query("""WITH e AS (SELECT user_id AS scope_id, row_number() OVER (PARTITION BY user_id ORDER BY ts,event_id)-1 AS sequence, event_type IN ('error','signup') AS gone, event_id AS memory_id, CASE WHEN event_id%3=0 THEN lag(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts,event_id) ELSE event_id+1 END AS other FROM events),
f AS (SELECT scope_id, sequence, gone, CASE WHEN gone THEN lag(memory_id) OVER (PARTITION BY scope_id ORDER BY sequence) ELSE memory_id END AS memory_id, CASE WHEN gone AND sequence%4>0 THEN other END AS replacement_id FROM e), k AS (SELECT * FROM f WHERE sequence<=60 AND memory_id IS NOT NULL),
g AS (SELECT scope_id, memory_id, count(*) FILTER (WHERE NOT gone) AS n, min(sequence) FILTER (WHERE NOT gone) AS p, min(sequence) FILTER (WHERE gone) AS w FROM k GROUP BY 1,2), l AS (SELECT DISTINCT k.scope_id, k.memory_id FROM k LEFT JOIN g r ON r.scope_id=k.scope_id AND r.memory_id=k.replacement_id WHERE gone AND replacement_id IS NOT NULL AND (r.p IS NULL OR r.p>k.sequence))
SELECT scope_id, memory_id, n>0 AND w IS NULL AS active, CASE WHEN n=0 THEN 'invalidate_without_publish' WHEN n>1 THEN 'published_twice' WHEN w<p THEN 'invalidate_before_publish' WHEN l.memory_id IS NOT NULL THEN 'missing_replacement' END AS code FROM g LEFT JOIN l USING (scope_id, memory_id)""")
def memory_replacements(spark, d):
    """Withdrawals that name a record which wasn't published by then."""
    w = W.partitionBy("episode_id").orderBy("sequence")
    gone, e = F.col("event_type").isin("error", "signup"), F.col("event_id")
    rows = V.log(spark, d).withColumns({"gone": gone, "own": F.lag(e).over(w), "other": F.when(e % 3 == 0, F.lag(e, 2).over(w)).otherwise(e + 1)})
    rows = rows.select(F.col("episode_id").alias("scope_id"), "sequence", F.when(F.col("gone"), "invalidate").otherwise("publish").alias("event_type"), F.when(F.col("gone"), F.col("own")).otherwise(e).alias("memory_id"), F.when(F.col("gone") & (F.col("sequence") % 4 > 0), F.col("other")).alias("replacement_id")).where("memory_id IS NOT NULL")
    return M.snapshot(rows, rows.select("scope_id").distinct().withColumn("as_of", F.lit(60))).select("scope_id", "memory_id", "active", "code")


@query(f"""WITH {MEM}, p AS (SELECT *, row_number() OVER (PARTITION BY scope_id, memory_id ORDER BY sequence) AS n FROM e WHERE event_type='publish'), a AS (SELECT *, sum((n=1)::INT) OVER (PARTITION BY scope_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS active FROM p)
SELECT scope_id, sequence, memory_id, CASE WHEN n>1 THEN 'repeat' WHEN active>30 THEN 'cap_reached' ELSE 'published' END AS verdict FROM a""")
def memory_publish(spark, d):
    """Publications under a cap of active records."""
    return M.publish_batch(memory_events(spark, d).where("event_type = 'publish'").drop("event_type"), cap=30)


@query("""WITH g AS (SELECT n_nationkey AS task_id, n_regionkey AS version FROM nation UNION ALL SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey%6=0), h AS (SELECT task_id, version, count(*) AS n FROM g GROUP BY 1,2)
SELECT c_custkey AS request_id, CASE WHEN n IS NULL THEN 'not_granted' WHEN n>1 THEN 'ambiguous_grant' WHEN c_custkey%7=0 THEN 'outside_validity' WHEN c_acctbal<1000 THEN 'reward_below_threshold' WHEN c_custkey%11=0 THEN 'lifetime_too_long' WHEN c_custkey%5>=4 THEN 'too_many_sessions' END AS code
FROM customer LEFT JOIN h ON h.task_id=c_nationkey AND h.version=c_custkey%5""")
def grant_checks(spark, d):
    """Requests against grants, the first rule broken."""
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    nation = V.read(spark, d, "nation")
    one = nation.select(F.col("n_nationkey").alias("task_id"), F.col("n_regionkey").cast("long").alias("version"), F.lit(1000.0).alias("min_reward"), t("2024-01-01").alias("valid_from"), t("2025-01-01").alias("expires_at"), F.lit(60).alias("max_ttl"), F.lit(4).alias("max_sessions"))
    k = F.col("c_custkey")
    requests = V.read(spark, d, "customer").select(k.alias("request_id"), F.col("c_nationkey").alias("task_id"), (k % 5).alias("version"), F.col("c_acctbal").alias("reward"), F.when(k % 7 == 0, t("2025-01-01")).otherwise(t("2024-06-01")).alias("at"), F.when(k % 11 == 0, 90).otherwise(30).alias("ttl"), (k % 5).cast("int").alias("sessions"))
    return M.authorize(requests, one.unionByName(one.where("task_id % 6 = 0")))


CANDIDATES = """ca AS (SELECT o.*, o_orderkey AS candidate_id, concat('p',o_custkey%5) AS policy_id, o_orderkey%29<>0 AS granted, o_orderstatus<>'P' AS ended, o_orderkey%31<>0 AS pinned, o_orderkey%37<>0 AS cited, o_orderkey%41<>0 AS own_source, o_orderkey%43<>0 AS unchanged, o_orderkey%47=0 AS no_box,
 CASE WHEN o_orderkey%53=0 THEN 'EPSG:3857' WHEN o_orderkey%2=0 THEN 'ogc:crs84' ELSE 'EPSG:4326' END AS source_crs, (o_custkey%20)/10.0 AS west, (o_custkey%20)/10.0+(o_custkey%9)/10.0 AS east, 30+o_orderkey%4000 AS ttl FROM orders o),
co AS (SELECT *, CASE WHEN policy_id='p4' THEN 'no_policy' WHEN NOT granted THEN 'not_authorized' WHEN NOT ended THEN 'episode_unanswered' WHEN NOT pinned THEN 'task_pin_mismatch' WHEN NOT cited THEN 'evidence_not_cited' WHEN NOT own_source THEN 'source_mismatch' WHEN NOT unchanged THEN 'source_changed' WHEN no_box THEN 'selector_incomplete'
 WHEN east>(o_custkey%20)/10.0+0.7 THEN 'selector_outside_source' WHEN source_crs='EPSG:3857' THEN 'source_not_wgs84' WHEN ttl<60 OR ttl>3600 THEN 'lifetime_outside_policy' WHEN o_orderdate+to_seconds(ttl)>TIMESTAMP '1998-01-01' THEN 'outlives_policy' END AS code FROM ca)"""


def candidates(spark, d):
    """Evidence of orders that may become memory, and four policies."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    odd = lambda n, x, y: F.when(k % n == 0, x).otherwise(y)
    west = (c % 20) / 10.0
    at = F.col("o_orderdate")
    rows = V.read(spark, d, "orders").select(
        k.alias("candidate_id"), text("p", c % 5).alias("policy_id"), (k % 29 != 0).alias("granted"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("terminated").alias("episode_status"), F.lit(True).alias("answered"),
        c.alias("task_id"), F.lit(1).alias("task_version"), text("m", c).alias("manifest_sha"), odd(31, F.lit(-1), c).alias("pinned_task_id"), F.lit(1).alias("pinned_task_version"), text("m", c).alias("pinned_manifest_sha"),
        odd(37, F.array(F.lit("other")), F.array(text("e", k), F.lit("e"))).alias("cited"), text("e", k).alias("evidence_id"), text("s", k).alias("evidence_source"), text("h", k).alias("frozen_sha"), odd(41, F.lit("x"), text("s", k)).alias("source_id"), odd(43, F.lit("x"), text("h", k)).alias("source_sha"),
        F.when(k % 53 == 0, "EPSG:3857").when(k % 2 == 0, "ogc:crs84").otherwise("EPSG:4326").alias("source_crs"), odd(47, F.lit(None), west).alias("west"), F.lit(0.0).alias("south"), (west + (c % 9) / 10.0).alias("east"), F.lit(1.0).alias("north"), at.alias("start"), at.alias("end"),
        west.alias("s_west"), F.lit(0.0).alias("s_south"), (west + 0.7).alias("s_east"), F.lit(1.0).alias("s_north"), at.alias("s_start"), at.alias("s_end"), F.lit("dominant").alias("summary"), F.lit("cropland").alias("object_type"), F.col("o_orderpriority").alias("platform"), F.lit("msi").alias("instrument"), at.alias("updated_at"), (30 + k % 4000).alias("ttl"),
    )
    policies = V.read(spark, d, "region").where("r_regionkey < 4").select(text("p", F.col("r_regionkey")).alias("policy_id"), text("scope", F.col("r_regionkey")).alias("scope_id"), F.lit(3600).alias("max_ttl"), F.lit("1998-01-01").cast("timestamp_ntz").alias("policy_expires_at"))
    return rows, policies


@query(f"""WITH {CANDIDATES} SELECT candidate_id, code, code IS NULL AS has_id, CASE WHEN code IS NULL THEN sha256(concat(o_custkey,chr(0),1,chr(0),'m',o_custkey,chr(0),'e',candidate_id,chr(0),'s',candidate_id,chr(0),'h',candidate_id)) END AS provenance_sha256, CASE WHEN code IS NULL THEN o_orderdate+to_seconds(ttl) END AS expires_at FROM co""")
def memory_records(spark, d):
    """Evidence becomes a record, or the first of twelve rules refuses it."""
    return M.build_records(*candidates(spark, d)).select("candidate_id", "code", F.col("memory_id").rlike("^mem-[0-9a-f]{64}$").alias("has_id"), "provenance_sha256", "expires_at").withColumn("has_id", F.coalesce("has_id", F.lit(False)))


@query(f"""WITH {CANDIDATES}, good AS (SELECT candidate_id AS k, o_custkey AS c, o_orderdate AS t0, o_orderdate+to_seconds(ttl) AS x, o_orderpriority AS platform FROM co WHERE code IS NULL), made AS (SELECT *, sha256(concat_ws(chr(0),c,1,concat('m',c),concat('e',k),concat('s',k),concat('h',k))) AS p FROM good),
body AS (SELECT *, concat_ws(chr(0),concat('scope',c%5),concat('p',c%5),'cropland') AS b1, concat_ws(chr(0),(c%20)/10.0::DOUBLE,0.0::DOUBLE,(c%20)/10.0::DOUBLE+(c%9)/10.0::DOUBLE,1.0::DOUBLE) AS b2, concat_ws(chr(0),t0,t0,platform,'msi',t0,x) AS b3 FROM made),
stored AS (SELECT k, concat('mem-',sha256(concat_ws(chr(0),b1,'dominant',b2,b3,p))) AS id, CASE WHEN k%7=1 THEN 'changed' ELSE 'dominant' END AS summary, CASE WHEN k%7=2 THEN sha256(p) ELSE p END AS p, p AS source_p, k%11=4 AS lost, b1, b2, b3 FROM body)
SELECT id AS memory_id, concat('e',k) AS evidence_id, CASE WHEN lost THEN 'missing_source' WHEN p<>source_p THEN 'provenance_mismatch' WHEN id<>concat('mem-',sha256(concat_ws(chr(0),b1,summary,b2,b3,p))) THEN 'id_mismatch' END AS code FROM stored""")
def memory_integrity(spark, d):
    """Ids and provenance of stored records computed again, where summaries, provenance and sources were damaged."""
    rows, policies = candidates(spark, d)
    k = F.col("candidate_id")
    stored = M.build_records(rows, policies, stored=True).where("code IS NULL").withColumns({"summary": F.when(k % 7 == 1, "changed").otherwise(F.col("summary")), "provenance_sha256": F.when(k % 7 == 2, F.sha2("provenance_sha256", 256)).otherwise(F.col("provenance_sha256"))})
    return M.verify_records(stored, rows.where(k % 11 != 4))


@query()
def memory_commands(spark, d):
    """Publications and invalidations in order (no SQL: each verdict depends on those before; a test holds them against a loop)."""
    k = F.col("event_id")
    rows = memory_events(spark, d).join(V.log(spark, d).select(F.col("episode_id").alias("scope_id"), "sequence", "event_id"), ["scope_id", "sequence"])
    rows = rows.select("scope_id", "sequence", (k % 7).alias("actor_id"), F.col("event_type").alias("kind"), "memory_id", (k % 11 == 0).alias("content"), (k % 3).alias("reason"), F.when(k % 5 == 0, F.col("memory_id") + 1).alias("replacement_id"))
    writers = rows.select("scope_id", "actor_id").distinct().where("actor_id <> 6")
    return M.judge_commands(rows, writers, cap=30)


PINNED = """r AS (SELECT o_orderkey AS memory_id, o_custkey%50 AS scope_id, o_orderpriority AS platform, o_orderstatus AS instrument, concat('t',o_orderkey%3) AS object_type, o_custkey%20/10.0 AS west, o_custkey%15/10.0 AS south, o_orderdate AS a, o_orderdate+INTERVAL 900 DAY AS x, o_orderdate+INTERVAL 60 DAY AS e, o_orderkey//20 AS published_at, CASE WHEN o_orderkey%4=0 THEN o_orderkey//20+100 END AS invalidated_at, o_orderkey%500 AS bytes FROM orders),
q AS (SELECT c_custkey AS query_id, c_custkey%50 AS scope_id, CASE c_custkey%3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' ELSE '5-LOW' END AS platform, CASE WHEN c_custkey%2=0 THEN 'F' END AS q_instrument, CASE WHEN c_custkey%3=0 THEN 't1' END AS q_object_type, c_custkey*7%4000 AS snapshot_sequence, c_custkey%20/10.0 AS w, TIMESTAMP '1996-06-01'+to_days(CAST(c_custkey%300 AS INT)) AS t FROM customer)"""


def pinned(spark, d):
    """Records with the sequences at which they were published and invalidated, and searches as of one."""
    o, k, c, at = F.col("o_orderkey"), F.col("c_custkey"), F.col("o_custkey"), F.col("o_orderdate")
    days = lambda n: F.expr(f"INTERVAL {n} DAY")
    x, y = (c % 20) / 10.0, (c % 15) / 10.0
    records = V.read(spark, d, "orders").select(o.alias("memory_id"), (c % 50).alias("scope_id"), F.col("o_orderpriority").alias("platform"), F.col("o_orderstatus").alias("instrument"), F.concat(F.lit("t"), (o % 3).cast("string")).alias("object_type"), x.alias("west"), y.alias("south"), (x + 2.0).alias("east"), (y + 2.0).alias("north"), at.alias("available_at"), (at + days(900)).alias("expires_at"), at.alias("start"), (at + days(60)).alias("end"), F.expr("o_orderkey div 20").alias("published_at"), F.expr("CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey div 20 + 100 END").alias("invalidated_at"), (o % 500).alias("bytes"))
    t, qx = F.lit("1996-06-01").cast("timestamp_ntz") + F.make_dt_interval((k % 300).cast("int")), (k % 20) / 10.0
    name = F.when(k % 3 == 0, "1-URGENT").when(k % 3 == 1, "2-HIGH").otherwise("5-LOW")
    queries = V.read(spark, d, "customer").select(k.alias("query_id"), (k % 50).alias("scope_id"), name.alias("platform"), F.when(k % 2 == 0, "F").alias("q_instrument"), F.when(k % 3 == 0, "t1").alias("q_object_type"), (k * 7 % 4000).alias("snapshot_sequence"), qx.alias("q_west"), F.lit(0.5).alias("q_south"), (qx + 0.3).alias("q_east"), F.lit(1.0).alias("q_north"), t.alias("as_of"), (t - days(500)).alias("q_start"), t.alias("q_end"))
    return records, queries


@query(f"""WITH {PINNED}, m AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY memory_id) AS position, count(*) OVER (PARTITION BY query_id) AS matched_count FROM q JOIN r USING (scope_id, platform)
 WHERE west<=w+0.3 AND west+2.0>=w AND south<=1.0 AND south+2.0>=0.5 AND t>=a AND t<x AND a<=t AND e>=t-INTERVAL 500 DAY AND (q_instrument IS NULL OR instrument=q_instrument) AND (q_object_type IS NULL OR object_type=q_object_type) AND published_at<=snapshot_sequence AND (invalidated_at IS NULL OR invalidated_at>snapshot_sequence)) SELECT * FROM m WHERE position<=5""")
def memory_search_as_of(spark, d):
    """Searches of a scope as of a sequence, by instrument and object type."""
    return M.memory_search(*pinned(spark, d), limit=5)


@query(f"WITH {PINNED} SELECT query_id, count(memory_id) AS records_scanned, coalesce(sum(bytes),0)::BIGINT AS input_bytes FROM q LEFT JOIN r ON r.scope_id=q.scope_id AND published_at<=snapshot_sequence GROUP BY 1")
def memory_search_costs(spark, d):
    """What each search scans."""
    return M.scan_costs(*pinned(spark, d))


@query("""WITH r AS (SELECT item_id AS memory_id, platform, west, south, east, north, acquired AS available_at, acquired+INTERVAL 300 DAY AS expires_at, acquired AS s, acquired+INTERVAL 60 DAY AS e FROM v_scenes),
q AS (SELECT c_custkey AS query_id, CASE c_custkey%5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END AS platform, c_custkey%20/10.0 AS w, c_custkey%15/10.0 AS so, TIMESTAMP '1996-01-01'+to_days(CAST(c_custkey%700 AS INT)) AS t FROM customer),
m AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY memory_id) AS position, count(*) OVER (PARTITION BY query_id) AS matched_count FROM q JOIN r USING (platform) WHERE west<=w+0.3 AND east>=w AND south<=so+0.3 AND north>=so AND t>=available_at AND t<expires_at AND s<=t AND e>=t-INTERVAL 5 DAY)
SELECT * FROM m WHERE position<=10""")
def memory_search(spark, d):
    """Searches of many queries at once, by place, time, validity and platform."""
    at = F.col("acquired")
    records = V.scenes(spark, d).select(F.col("item_id").alias("memory_id"), "platform", "west", "south", "east", "north", at.alias("available_at"), (at + F.expr("INTERVAL 300 DAY")).alias("expires_at"), at.alias("start"), (at + F.expr("INTERVAL 60 DAY")).alias("end"))
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, "1-URGENT").when(k % 5 == 1, "2-HIGH").when(k % 5 == 2, "3-MEDIUM").when(k % 5 == 3, "4-NOT SPECIFIED").otherwise("5-LOW")
    x, y, t = (k % 20) / 10.0, (k % 15) / 10.0, F.lit("1996-01-01").cast("timestamp_ntz") + F.make_dt_interval((k % 700).cast("int"))
    queries = V.read(spark, d, "customer").select(k.alias("query_id"), name.alias("platform"), x.alias("q_west"), y.alias("q_south"), (x + 0.3).alias("q_east"), (y + 0.3).alias("q_north"), t.alias("as_of"), (t - F.expr("INTERVAL 5 DAY")).alias("q_start"), t.alias("q_end"))
    return M.memory_search(records, queries, limit=10)


@query(f"""WITH {PINNED}, p AS (SELECT *, (query_id%4)*3+CASE WHEN query_id%50=0 THEN 996 ELSE 0 END AS o FROM q), m AS (SELECT query_id, memory_id, o, row_number() OVER (PARTITION BY query_id ORDER BY memory_id) AS position, count(*) OVER (PARTITION BY query_id) AS matched_count FROM p JOIN r ON r.platform=p.platform
 WHERE west<=w+0.3 AND west+2.0>=w AND south<=1.0 AND south+2.0>=0.5 AND t>=a AND t<x AND a<=t AND e>=t-INTERVAL 500 DAY) SELECT query_id, memory_id, position, matched_count, CASE WHEN o+3<matched_count AND o+3<=1000 THEN o+3 END AS next_offset FROM m WHERE position>o AND position<=o+3""")
def memory_pages(spark, d):
    """Pages of three, with the offset of the next; none at the end, and none behind the last offset."""
    records, queries = pinned(spark, d)
    k = F.col("query_id")
    queries = queries.drop("scope_id", "snapshot_sequence", "q_instrument", "q_object_type").withColumn("offset", k % 4 * 3 + F.when(k % 50 == 0, 996).otherwise(0))
    return M.memory_search(records.drop("scope_id"), queries, limit=3)


CASES = """cs AS (SELECT item_id, acquired AS available_at, concat('summary of ',item_id) AS summary, west, east, platform, acquired, k.case_name, k.expected, CASE WHEN k.case_name='neighbour' THEN east+0.1 ELSE west END AS case_west, CASE WHEN k.case_name='neighbour' THEN 2*east-west+0.1 ELSE east END AS case_east,
 CASE WHEN k.case_name='sensor' THEN concat('other than ',platform) ELSE platform END AS case_platform, CASE WHEN k.case_name='date' THEN acquired+INTERVAL 400 DAY ELSE acquired END AS case_acquired, CASE WHEN k.case_name='expired' THEN acquired+INTERVAL 1 SECOND ELSE acquired+INTERVAL 300 DAY END AS case_expires_at,
 CASE WHEN k.case_name='conflict' THEN concat('not: summary of ',item_id) ELSE concat('summary of ',item_id) END AS case_summary FROM v_scenes CROSS JOIN (VALUES ('correct',true),('conflict',true),('neighbour',false),('expired',false),('date',false),('sensor',false)) k(case_name,expected))"""


def case_records(spark, d):
    at = F.col("acquired")
    return V.scenes(spark, d).withColumns({"available_at": at, "expires_at": at + F.expr("INTERVAL 300 DAY"), "summary": F.concat(F.lit("summary of "), F.col("item_id").cast("string"))})


@query(f"WITH {CASES} SELECT item_id, case_name, expected, case_west, case_east, case_platform, case_acquired, case_expires_at, case_summary FROM cs")
def case_matrix(spark, d):
    """Six variants of each record."""
    return M.case_matrix(case_records(spark, d))


@query(f"""WITH {CASES} SELECT item_id, case_name, expected, case_west<=east AND case_east>=west AND case_platform=platform AND case_acquired=acquired AND available_at+INTERVAL 1 HOUR>=available_at AND available_at+INTERVAL 1 HOUR<case_expires_at AS found, case_summary=summary AS says_same FROM cs""")
def case_checks(spark, d):
    """Each variant under its record's own search."""
    records = case_records(spark, d)
    return M.check_cases(records, M.case_matrix(records))


@query("WITH w AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)-1 AS n FROM conversations) SELECT conv_id, bool_and(n=turn) AS contiguous, count(*) AS turns FROM w GROUP BY 1")
def contiguous_turns(spark, d):
    """W03 on conversations: turns without gaps."""
    rows = V.read(spark, d, "conversations").withColumn("n", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1)
    return rows.groupBy("conv_id").agg(F.bool_and(F.col("n") == F.col("turn")).alias("contiguous"), F.count(F.lit(1)).alias("turns"))
