"""Streams of actions and of episode state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dedup_actions(stream: DataFrame, *, delay: str = "1 hour", keys: tuple[str, ...] = ("episode_id", "client_action_id"), at: str = "created_at") -> DataFrame:
    """A stream without repeats of an action within the watermark."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def action_verdicts(stream: DataFrame, *, delay: str = "1 hour", keys: tuple[str, ...] = ("episode_id", "client_action_id"), content: str = "request", at: str = "created_at") -> DataFrame:
    """``keys, created_at, verdict``: ``new``, ``repeat`` or, with another ``content`` than the first, ``conflict``.

    The state of an action is a hash of its first content, dropped as the watermark leaves it behind.
    :func:`ingest_actions` sends ``conflict`` rows to a table of their own.  Python is called for each action of a batch, so millions
    of them are for :func:`record_verdicts`.
    """
    kept = pd.Timedelta(delay).total_seconds() * 1000

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # A key's rows may come in several Arrow batches in any order: only times and hashes are kept for the whole.
        parts = [(rows[at].to_numpy(), rows["_content"].to_numpy()) for rows in frames]
        first, least = (state.get[0], None) if state.exists else (None, None)
        if first is None:
            least = min((t.min(), c[t == t.min()].min()) for t, c in parts)
            first = least[1]
        new = least is not None
        for times, contents in parts:
            verdicts = np.where(contents == first, "repeat", "conflict").astype(object)
            hit = np.flatnonzero((times == least[0]) & (contents == first)) if new else []
            if len(hit):
                verdicts[hit[0]], new = "new", False
            yield pd.DataFrame({**{k: [v] * len(times) for k, v in zip(keys, key, strict=True)}, at: times, "verdict": verdicts})
        state.update((int(first),))
        state.setTimeoutTimestamp(int(state.getCurrentWatermarkMs() + kept) + 1)

    rows = stream.select(*keys, F.col(at).cast("timestamp").alias(at), F.xxhash64(content).alias("_content")).withWatermark(at, delay)
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {at} timestamp, verdict string"
    return rows.groupBy(*keys).applyInPandasWithState(judge, schema, "first long", "append", GroupStateTimeout.EventTimeTimeout)


def ingest_actions(stream: DataFrame, accepted: str, conflicts: str, checkpoint: str, *, keys: tuple[str, ...] = ("episode_id", "client_action_id"), content: str = "request", at: str = "created_at", horizon: str = "1 day", trigger: dict | None = None):
    """One stream to two tables, each exactly once: first requests of an action, and requests that differ from the first.

    Equal repeats are dropped.  The first of an action is the earliest of its micro-batch (equal times: the smaller content), unless the
    accepted table has it from a batch before; that table is looked at as far back as ``horizon`` before the batch.  Each batch
    replaces the folder of its own number in both tables and never reads its own or later numbers, so a batch sent again
    after a failure leaves the same two tables.  The tables belong to one checkpoint.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn(at, F.col(at).cast("timestamp"))
        firsts = rows.groupBy(*keys).agg(F.min(F.struct(at, content)).alias("_first"))
        judged = rows.join(firsts, list(keys))
        if number:
            since = rows.agg(F.min(at)).first()[0]
            before = spark.read.parquet(accepted).where((F.col("batch") < number) & (F.col(at) >= F.lit(since) - F.expr(f"INTERVAL {horizon}")))
            judged = judged.join(before.groupBy(*keys).agg(F.min_by(content, at).alias("_known")), list(keys), "left")
        else:
            judged = judged.withColumn("_known", F.lit(None).cast(dict(rows.dtypes)[content]))
        judged = judged.persist()
        new = judged.where(F.col("_known").isNull() & (F.struct(at, content) == F.col("_first"))).dropDuplicates(list(keys))
        other = judged.where(~F.col(content).eqNullSafe(F.coalesce("_known", F.col("_first")[content])))
        for rows_, path in ((new, accepted), (other, conflicts)):
            rows_.drop("_first", "_known").write.mode("overwrite").parquet(f"{path}/batch={number}")
        judged.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def record_verdicts(stream: DataFrame, verdicts: str, checkpoint: str, *, keys: tuple[str, ...] = ("episode_id", "client_action_id"), content: str = "request", at: str = "created_at", horizon: str = "1 day", trigger: dict | None = None):
    """One stream to a table of the verdicts of :func:`action_verdicts`, a row each, without a Python call for each action.

    The first of an action is found as in :func:`ingest_actions`, from its micro-batch or from the ``new`` rows of batches before, and
    each batch replaces the folder of its own number.  The table belongs to one checkpoint.
    """

    def one(batch: DataFrame, number: int) -> None:
        rows = batch.select(*keys, F.col(at).cast("timestamp").alias(at), F.xxhash64(content).alias("content"))
        known = F.lit(None).cast("long")
        if number:
            since = rows.agg(F.min(at)).first()[0]
            before = batch.sparkSession.read.parquet(verdicts).where((F.col("batch") < number) & (F.col("verdict") == "new") & (F.col(at) >= F.lit(since) - F.expr(f"INTERVAL {horizon}")))
            rows = rows.join(before.groupBy(*keys).agg(F.min_by("content", at).alias("_known")), list(keys), "left")
            known = F.col("_known")
        w = W.partitionBy(*keys).orderBy(at, "content")
        rows = rows.withColumns({"_first": F.coalesce(known, F.first("content").over(w)), "_new": known.isNull() & (F.row_number().over(w) == 1)})
        verdict = F.when(F.col("_new"), "new").when(F.col("content") == F.col("_first"), "repeat").otherwise("conflict")
        rows.select(*keys, at, "content", verdict.alias("verdict")).write.mode("overwrite").parquet(f"{verdicts}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


STATE = "episode_id long, events long, tool_calls long, finished boolean, open_since timestamp, status string, version long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Episode(StatefulProcessor):
    """Sums and latest times of an episode's events, which don't depend on the order that rows arrive in.

    A tool is open if it started after all that closes one, and after the last start that was given up.  Timers end leases, and
    drop the state of a finished episode.
    """

    def __init__(self, lease_ms: int, keep_ms: int) -> None:
        self.lease_ms, self.keep_ms = lease_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("episode", "events long, tools long, finished boolean, started long, closed long, given_up long, version long")

    def row(self, key: tuple, status: str, events, tools, finished, started, closed, given_up, version) -> pd.DataFrame:
        opened = pd.NaT if finished or started <= max(closed, given_up) else pd.Timestamp(started, unit="ms")
        return pd.DataFrame({"episode_id": [key[0]], "events": [events], "tool_calls": [tools], "finished": [finished], "open_since": [opened], "status": [status], "version": [version]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        events, tools, finished, started, closed, given_up, version = self.state.get() if self.state.exists() else (0, 0, False, -1, -1, -1, 0)
        last = lambda ms, these: int(ms[these].max()) if these.any() else -1
        for frame in rows:
            kind, ms = frame["event_type"], frame["at_ms"]
            events, tools = events + len(frame), tools + int((kind == "tool_started").sum())
            started = max(started, last(ms, kind == "tool_started"))
            closed = max(closed, last(ms, kind.isin(["tool_finished", "terminal"])))
            finished = finished or bool((kind == "terminal").any())
        whole = (events, tools, finished, started, closed, given_up, version + 1)
        self.state.update(whole)
        soon = timerValues.getCurrentWatermarkInMs() + 1
        if finished:
            self.handle.registerTimer(max(closed + self.keep_ms, soon))
        elif started > max(closed, given_up):
            self.handle.registerTimer(max(started + self.lease_ms, soon))
        yield self.row(key, "finished" if finished else "running", *whole)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if not self.state.exists():
            return
        events, tools, finished, started, closed, given_up, version = self.state.get()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if finished:
            if closed + self.keep_ms <= now:
                self.state.clear()
        elif started > max(closed, given_up) and started + self.lease_ms <= now:
            whole = (events, tools, finished, started, closed, started, version + 1)
            self.state.update(whole)
            yield self.row(key, "tool_interrupted", *whole)

    def close(self) -> None:
        pass


def episode_state(stream: DataFrame, *, lease: str = "90 seconds", delay: str = "10 minutes", keep: str = "30 days", at: str = "created_at") -> DataFrame:
    """Live counters of each episode, and ``tool_interrupted`` when a started tool outlives its lease.

    Events: ``episode_id, event_type, created_at``; ``tool_started`` opens a lease, ``tool_finished``
    closes it, ``terminal`` ends the episode.  A timer in event time fires as the watermark passes the lease; another drops
    what is kept of an episode ``keep`` after its end.  ``version`` numbers the rows of an episode.  Timers need the RocksDB state
    store, which is set in the session.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    milliseconds = lambda x: int(pd.Timedelta(x).total_seconds() * 1000)
    keyed = stream.select("episode_id", "event_type", F.col(at).cast("timestamp").alias(at)).withWatermark(at, delay).withColumn("at_ms", F.unix_millis(at))
    return keyed.groupBy("episode_id").transformWithStateInPandas(_Episode(milliseconds(lease), milliseconds(keep)), STATE, "append", "eventtime")
