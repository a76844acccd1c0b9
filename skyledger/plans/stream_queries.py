"""Queries that run a stream to the end of what is there and return its sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import folder
from ..streaming.actions import dedup_actions, episode_state, ingest_actions, record_verdicts
from .registry import query


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    # A table may be one file or a folder of files.
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/events.parque[t]")


def _drain(spark: SparkSession, stream: DataFrame) -> DataFrame:
    out = folder(spark)
    running = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@query("SELECT user_id AS episode_id, event_id AS client_action_id, event_type FROM events")
def deduplicated_actions(spark, d):
    """A stream in which every action comes twice keeps each once."""
    rows = _events(spark, d).select(F.col("user_id").alias("episode_id"), F.col("event_id").alias("client_action_id"), "event_type", F.col("ts").alias("created_at"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return _drain(spark, dedup_actions(rows)).select("episode_id", "client_action_id", "event_type")


@query("""WITH r AS (SELECT user_id AS episode_id, event_id//3 AS client_action_id, event_type AS request, ts, event_id FROM events), f AS (SELECT episode_id, client_action_id, min(struct_pack(ts:=ts, request:=request)).request AS first FROM r GROUP BY 1,2),
v AS (SELECT r.*, CASE WHEN request<>first THEN 'conflict' ELSE 'same' END AS c FROM r JOIN f USING (episode_id, client_action_id)) SELECT episode_id, client_action_id, 1::BIGINT AS new, count(*) FILTER (WHERE c='same')-1 AS repeats, count(*) FILTER (WHERE c='conflict') AS conflicts FROM v GROUP BY 1,2""")
def action_conflicts(spark, d):
    """An action that comes again with another request is a conflict."""
    rows = _events(spark, d).select(F.col("user_id").alias("episode_id"), F.expr("event_id div 3").alias("client_action_id"), F.col("event_type").alias("request"), F.col("ts").alias("created_at"))
    out = folder(spark)
    record_verdicts(rows, f"{out}/verdicts", f"{out}/checkpoint", horizon="1000 days").awaitTermination()
    verdicts = spark.read.parquet(f"{out}/verdicts")
    count = lambda v: F.count_if(F.col("verdict") == v)
    return verdicts.groupBy("episode_id", "client_action_id").agg(count("new").alias("new"), count("repeat").alias("repeats"), count("conflict").alias("conflicts"))


@query("SELECT user_id AS episode_id, count(*) AS events, count(*) FILTER (WHERE event_type='click') AS tool_calls, bool_or(event_type='signup') AS finished FROM events GROUP BY 1")
def live_episode_state(spark, d):
    """Counters and end of each episode, by state; the last state of each."""
    kind = F.when(F.col("event_type") == "click", "tool_started").when(F.col("event_type") == "signup", "terminal").otherwise("tool_finished")
    rows = _events(spark, d).select(F.col("user_id").alias("episode_id"), kind.alias("event_type"), F.col("ts").alias("created_at"))
    states = _drain(spark, episode_state(rows))
    return states.groupBy("episode_id").agg(F.max("events").alias("events"), F.max("tool_calls").alias("tool_calls"), F.max("finished").alias("finished"))


@query("""WITH r AS (SELECT user_id AS episode_id, event_id//3 AS client_action_id, event_type AS request, event_id, ts FROM events), f AS (SELECT episode_id, client_action_id, min(struct_pack(ts:=ts, request:=request)).request AS first FROM r GROUP BY 1,2)
SELECT episode_id, client_action_id, first AS request, 'accepted' AS kept_in, 1::BIGINT AS n FROM f UNION ALL SELECT episode_id, client_action_id, request, 'conflicts', count(*) FROM r JOIN f USING (episode_id, client_action_id) WHERE request<>first GROUP BY 1,2,3""")
def action_tables(spark, d):
    """One stream to the table of accepted actions and the table of conflicting ones."""
    out = folder(spark)
    rows = _events(spark, d).select(F.col("user_id").alias("episode_id"), F.expr("event_id div 3").alias("client_action_id"), F.col("event_type").alias("request"), F.col("ts").alias("created_at"), "event_id")
    ingest_actions(rows, f"{out}/accepted", f"{out}/conflicts", f"{out}/checkpoint", horizon="1000 days").awaitTermination()
    kept = [spark.read.parquet(f"{out}/{t}").groupBy("episode_id", "client_action_id", "request").agg(F.count(F.lit(1)).alias("n")).withColumn("kept_in", F.lit(t)) for t in ("accepted", "conflicts")]
    return kept[0].unionByName(kept[1])


@query("""WITH s AS (SELECT user_id AS episode_id, bool_or(event_type='signup') AS finished, max(epoch_ms(ts)) FILTER (WHERE event_type='click') AS started, max(epoch_ms(ts)) FILTER (WHERE event_type<>'click') AS closed FROM events GROUP BY 1), w AS (SELECT max(epoch_ms(ts))-600000 AS mark FROM events),
o AS (SELECT *, NOT finished AND started IS NOT NULL AND (closed IS NULL OR started>closed) AS open FROM s) SELECT episode_id, CASE WHEN finished THEN 'finished' WHEN open AND started+90000<=mark THEN 'tool_interrupted' ELSE 'running' END AS status, open AND started+90000>mark AS still_open FROM o, w""")
def episode_leases(spark, d):
    """How each episode stands as the watermark ends: finished, running, or interrupted as a tool outlived its lease."""
    kind = F.when(F.col("event_type") == "click", "tool_started").when(F.col("event_type") == "signup", "terminal").otherwise("tool_finished")
    rows = _events(spark, d).select(F.col("user_id").alias("episode_id"), kind.alias("event_type"), F.col("ts").alias("created_at"))
    states = _drain(spark, episode_state(rows))
    last = states.groupBy("episode_id").agg(F.max_by(F.struct("status", "open_since"), "version").alias("x"))
    return last.select("episode_id", "x.status", F.col("x.open_since").isNotNull().alias("still_open"))
