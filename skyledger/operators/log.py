"""Operators on event logs: hashes, chains, structural checks, differences, paging, budgets."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing

#: Hash before the first of a chain.
GENESIS = "0" * 64


#: Events whose hashes are hashed together, so that no row holds an episode whole.
BLOCK = 1024


def trace_hash(log: DataFrame, key: str, sequence: str, fields: list[str | Column], *, block: int = BLOCK) -> DataFrame:
    """One hash of each episode's events in order: of the hashes of blocks of ``block`` sequence numbers."""
    one = hashing.digest(*(F.col(c) if isinstance(c, str) else c for c in fields))
    rows = log.select(key, F.expr(f"`{sequence}` div {block}").alias("b"), F.struct(F.col(sequence).alias("s"), one.alias("h")).alias("e"))
    lines = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda e: e["h"]), "\n"), 256)
    blocks = rows.groupBy(key, "b").agg(F.count(F.lit(1)).alias("n"), lines("e").alias("h"))
    blocks = blocks.select(key, "n", F.struct(F.col("b").alias("s"), "h").alias("e"))
    return blocks.groupBy(key).agg(F.sum("n").alias("events"), lines("e").alias("trace_hash"))


def event_counts(log: DataFrame, key: str, sequence: str, kind: str, head: str) -> DataFrame:
    """Events, kinds, first and last sequence and the last event's ``head``."""
    return log.groupBy(key).agg(F.count(F.lit(1)).alias("events"), F.count_distinct(kind).alias("kinds"), F.min(sequence).alias("first_sequence"), F.max(sequence).alias("last_sequence"), F.max_by(head, sequence).alias("head"), (F.max(sequence) + 1).alias("next_sequence"))


def _links(chain: DataFrame, scope: str, order: str) -> DataFrame:
    w = W.partitionBy(scope).orderBy(order)
    return chain.withColumns({"_n": F.row_number().over(w), "_before": F.coalesce(F.lag("event_sha256").over(w), F.lit(GENESIS))})


def verify_chain(chain: DataFrame, scope: str, order: str, content: Column) -> DataFrame:
    """The first bad place of each scope (null if clean): ``scope, events, first_bad, code``.

    Each event holds ``previous_event_sha256`` and ``event_sha256`` = hash of content and
    previous; every event is checked by itself, so no fold is needed.
    """
    rows = _links(chain, scope, order)
    own = F.sha2(F.concat_ws("|", content, F.col("previous_event_sha256")), 256)
    code = F.when(F.col(order) != F.col("_n"), "sequence_gap").when(F.col("previous_event_sha256") != F.col("_before"), "broken_link").when(F.col("event_sha256") != own, "hash_mismatch")
    rows = rows.withColumn("_code", code)
    bad = F.min(F.when(F.col("_code").isNotNull(), F.struct(F.col(order).alias("at"), F.col("_code").alias("code"))))
    return rows.groupBy(scope).agg(F.count(F.lit(1)).alias("events"), bad.alias("_bad")).select(scope, "events", F.col("_bad.at").alias("first_bad"), F.col("_bad.code").alias("code"))


def build_chain(events: DataFrame, scope: str, order: str, content: Column, *, after: tuple[str, str] | None = None) -> DataFrame:
    """``scope, order, previous_event_sha256, event_sha256`` of each event.

    A chain is sequential by nature; each scope is a stream of sorted batches, so that a long one
    needs no memory in proportion to its length.  ``after`` names columns with the sequence and the hash of
    the event that a scope's chain goes on from (null: none); then all columns of ``events`` stay, with ``sequence``.
    """
    place, head = after or (None, None)
    rows = events.select(
        F.col(scope).alias("scope"), F.col(order).alias("seq"), content.alias("content"),
        (F.col(place).cast("long") if place else F.lit(0).cast("long")).alias("place"), (F.col(head) if head else F.lit(None).cast("string")).alias("head"),
        F.struct(*(c for c in events.columns if c not in (place, head))).alias("row") if after else F.lit(0).alias("row"),
    )
    rows = rows.repartition("scope").sortWithinPartitions("scope", "seq", "content")
    # What a task's function sees of a row is its content; the rest passes by as Arrow columns.
    kind = dict(rows.dtypes)

    def run(batches):
        started, scope_now, last, n = False, None, GENESIS, 0
        for batch in batches:
            before, own, at = [], [], []
            for s, c, p, h in zip(*(batch.column(k).to_pylist() for k in ("scope", "content", "place", "head")), strict=True):
                if not started or s != scope_now:
                    started, scope_now, last, n = True, s, h or GENESIS, p or 0
                before.append(last)
                last, n = hashlib.sha256(f"{c}|{last}".encode()).hexdigest(), n + 1
                own.append(last)
                at.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("scope"), batch.column("seq"), batch.column("row"), pa.array(at, pa.int64()), pa.array(before, pa.string()), pa.array(own, pa.string())], ["scope", "seq", "row", "sequence", "previous_event_sha256", "event_sha256"])

    made = rows.mapInArrow(run, f"scope {kind['scope']}, seq {kind['seq']}, row {kind['row']}, sequence long, previous_event_sha256 string, event_sha256 string")
    if after:
        return made.select("row.*", "sequence", "previous_event_sha256", "event_sha256")
    return made.select(F.col("scope").alias(scope), F.col("seq").cast("long").alias(order), "previous_event_sha256", "event_sha256")


def trace_checks(log: DataFrame, key: str, sequence: str, identity: str, version: str, first_kind: str, kind: str) -> DataFrame:
    """Structural checks of each episode: contiguous, unique ids, versions that never fall, first kind."""
    w = W.partitionBy(key).orderBy(sequence)
    rows = log.withColumns({"_n": F.row_number().over(w) - 1, "_v": F.lag(version).over(w)})
    return rows.groupBy(key).agg(
        F.bool_and(F.col("_n") == F.col(sequence)).alias("contiguous"),
        (F.count_distinct(identity) == F.count(F.lit(1))).alias("unique_ids"),
        F.bool_and(F.coalesce(F.col("_v") <= F.col(version), F.lit(True))).alias("monotone_version"),
        (F.min_by(kind, sequence) == first_kind).alias("starts_right"),
    )


def all_passed(checks: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Whether all checks passed, and the sorted names of those that failed."""
    failed = F.filter(F.array(*(F.when(~F.coalesce(F.col(n), F.lit(False)), F.lit(n)) for n in names)), lambda x: x.isNotNull())
    return checks.select(key, (F.size(failed) == 0).alias("passed"), F.array_join(F.sort_array(failed), ",").alias("failed"))


def diff_traces(expected: DataFrame, actual: DataFrame, key: str, sequence: str, digest: str) -> DataFrame:
    """Per episode: equal, missing, unexpected and changed events, and the first difference."""
    a = expected.select(key, sequence, F.col(digest).alias("_a"))
    b = actual.select(key, sequence, F.col(digest).alias("_b"))
    rows = a.join(b, [key, sequence], "full_outer")
    differs = ~F.col("_a").eqNullSafe(F.col("_b"))
    return rows.groupBy(key).agg(
        F.count_if(~differs).alias("equal"),
        F.count_if(F.col("_b").isNull()).alias("missing"),
        F.count_if(F.col("_a").isNull()).alias("unexpected"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & differs).alias("changed"),
        F.min(F.when(differs, F.col(sequence))).alias("first_difference"),
    )


def replay_report(events: DataFrame, states: tuple[DataFrame, DataFrame], artifacts: tuple[DataFrame, DataFrame], key: str) -> DataFrame:
    """``key, events_equal, state_equal, artifacts_missing, artifacts_unexpected, reproduced`` of each episode.

    ``events`` is :func:`diff_traces`; ``states`` are the recorded and the replayed ``key, state_hash``;
    ``artifacts`` likewise ``key, sha256``: contents with their counts, as ids are made anew.
    """
    want, got = (t.select(key, F.col("state_hash").alias(n)) for t, n in zip(states, ("_want", "_got"), strict=True))
    state = want.join(got, key, "full_outer").select(key, F.col("_want").eqNullSafe(F.col("_got")).alias("state_equal"))
    one, two = (t.groupBy(key, "sha256").agg(F.count(F.lit(1)).alias(n)) for t, n in zip(artifacts, ("_one", "_two"), strict=True))
    both = one.join(two, [key, "sha256"], "full_outer").fillna(0, ["_one", "_two"])
    more = lambda a, b: F.sum(F.greatest(F.lit(0).cast("long"), F.col(a) - F.col(b)))
    made = both.groupBy(key).agg(more("_one", "_two").alias("artifacts_missing"), more("_two", "_one").alias("artifacts_unexpected"))
    rows = events.select(key, (F.col("missing") + F.col("unexpected") + F.col("changed") == 0).alias("events_equal")).join(state, key, "full_outer").join(made, key, "full_outer")
    rows = rows.fillna(0, ["artifacts_missing", "artifacts_unexpected"]).fillna(True, ["events_equal", "state_equal"])
    same = F.col("events_equal") & F.col("state_equal") & (F.col("artifacts_missing") + F.col("artifacts_unexpected") == 0)
    return rows.withColumn("reproduced", same)


def trace_page(log: DataFrame, cursors: DataFrame, key: str, sequence: str) -> DataFrame:
    """Pages behind exclusive cursors ``key, cursor, limit``: rows with ``has_more, next_cursor``."""
    rows = log.join(cursors, key).where(F.col(sequence) > F.col("cursor"))
    w = W.partitionBy(key).orderBy(sequence)
    rows = rows.withColumns({"_n": F.row_number().over(w), "_after": F.lead(sequence).over(w)}).where(F.col("_n") <= F.col("limit"))
    last = W.partitionBy(key)
    rows = rows.withColumn("has_more", F.max(F.when(F.col("_n") == F.col("limit"), F.col("_after"))).over(last).isNotNull())
    return rows.withColumn("next_cursor", F.max(sequence).over(last)).drop("_n", "_after", "cursor", "limit")


def idempotency(requests: DataFrame, keys: list[str], body: str, order: str) -> DataFrame:
    """Requests by key: the first is accepted, equal ones are replays, others conflict."""
    w = W.partitionBy(*keys).orderBy(order)
    rows = requests.withColumns({"_n": F.row_number().over(w), "_first": F.first_value(F.col(body)).over(w)})
    verdict = F.when(F.col("_n") == 1, "accepted").when(F.col(body).eqNullSafe(F.col("_first")), "replay").otherwise("conflict")
    return rows.withColumn("verdict", verdict).drop("_n", "_first")


def action_coverage(accepted: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Accepted actions against their results, both ways: exactly one result each."""
    n = lambda t, c: t.groupBy(*keys).agg(F.count(F.lit(1)).alias(c))
    rows = n(accepted, "accepted").join(n(results, "results"), keys, "full_outer").fillna(0, ["accepted", "results"])
    code = F.when(F.col("accepted") == 0, "unexpected_result").when(F.col("results") == 0, "missing_result").when(F.col("results") > F.col("accepted"), "duplicate_result").when(F.col("results") < F.col("accepted"), "missing_result")
    return rows.withColumn("code", code)


def run_codes(actions: DataFrame, runs: DataFrame, keys: list[str], request: str, status: str) -> DataFrame:
    """``keys, code`` of each tool action against its runs: ``missing_run, duplicate_run, not_completed, request_mismatch``, or null.

    An action has exactly one run, which is completed and was asked for the same request (as canonical text or hash).
    """
    own = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(F.col(status).alias("s"), F.col(request).alias("r"))).alias("_run"))
    rows = actions.select(*keys, F.col(request).alias("_want")).join(own, keys, "left")
    code = F.when(F.col("_n").isNull(), "missing_run").when(F.col("_n") > 1, "duplicate_run").when(~F.col("_run.s").eqNullSafe(F.lit("completed")), "not_completed").when(~F.col("_run.r").eqNullSafe(F.col("_want")), "request_mismatch")
    return rows.select(*keys, code.alias("code"))


def pinned(log: DataFrame, pins: DataFrame, key: str, sequence: str, pin: str) -> DataFrame:
    """``key, code``: whether each episode's first event holds the ``pin`` of ``pins(key, pin)``: ``no_events, not_from_zero, pin_missing, pin_mismatch``, or null."""
    first = log.groupBy(key).agg(F.min(F.struct(F.col(sequence).alias("n"), F.col(pin).alias("pin"))).alias("_first"))
    rows = pins.select(key, F.col(pin).alias("_want")).join(first, key, "left")
    code = F.when(F.col("_first").isNull(), "no_events").when(F.col("_first.n") != 0, "not_from_zero").when(F.col("_first.pin").isNull(), "pin_missing").when(F.col("_first.pin") != F.col("_want"), "pin_mismatch")
    return rows.select(key, code.alias("code"))


def returned_ids(results: DataFrame, key: str, tool: str, name: str, payload: str, order: str) -> DataFrame:
    """``key, count, ids``: what the results of one tool returned to each episode, in order, from JSON ``payload``.

    A payload counts if it has ``matched_count``; its ``records`` give their ``memory_id``.  Episodes without such a result
    have no row.
    """
    found = F.from_json(payload, "matched_count long, records array<struct<memory_id:string>>")
    rows = results.where(F.col(tool) == name).select(key, F.col(order).alias("_at"), found.alias("x")).where("x.matched_count IS NOT NULL")
    ids = rows.select(key, "_at", F.posexplode_outer("x.records").alias("i", "r")).select(key, F.struct("_at", "i", F.col("r.memory_id").alias("id")).alias("e"))
    inside = F.array_sort(F.collect_list(F.when(F.col("e.id").isNotNull(), F.col("e"))))
    return ids.groupBy(key).agg(F.transform(inside, lambda e: e["id"]).alias("ids")).select(key, F.size("ids").cast("long").alias("count"), "ids")


def unmatched_starts(events: DataFrame, keys: list[str], kind: str, start: str, done: str) -> DataFrame:
    """Starts without a completion of the same key."""
    return events.where(F.col(kind) == start).join(events.where(F.col(kind) == done).select(*keys).distinct(), keys, "left_anti")


def backfill(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows and those new ones whose key is not there."""
    return existing.unionByName(new.join(existing.select(*keys).distinct(), keys, "left_anti"))


def budget_use(log: DataFrame, key: str, *, steps: Column, tools: Column, size: Column, wall: Column, limits: dict[str, int]) -> DataFrame:
    """Counters of each episode; wall time is replaced by the last value, the rest adds up."""
    rows = log.groupBy(key).agg(F.sum(steps.cast("long")).alias("steps"), F.sum(tools.cast("long")).alias("tool_calls"), F.sum(size.cast("long")).alias("input_bytes"), F.max(wall.cast("long")).alias("wall_time_ms"))
    counters = {n: hashing.counter(F.lit(v).cast("long"), F.col(n)) for n, v in limits.items()}
    rows = rows.select(key, *(c.alias(n) for n, c in counters.items()))
    flat = [F.col(f"{n}.{f}").alias(f"{n}_{f}") for n in limits for f in ("used", "remaining")]
    return rows.select(key, *flat, ((F.col("steps.remaining") == 0) | (F.col("wall_time_ms.remaining") == 0)).alias("exhausted"))


def size_guard(log: DataFrame, key: str, payload: str, *, most_rows: int, most_bytes: int) -> DataFrame:
    """Rows and bytes of each episode against limits, before any payload is parsed."""
    rows = log.groupBy(key).agg(F.count(F.lit(1)).alias("events"), F.sum(F.octet_length(payload).cast("long")).alias("bytes"))
    return rows.withColumn("within", (F.col("events") <= most_rows) & (F.col("bytes") <= most_bytes))


def last_result(log: DataFrame, keys: list[str], sequence: str, result: str) -> DataFrame:
    """The last result of each key."""
    return log.groupBy(*keys).agg(F.max_by(result, sequence).alias("last_result"), F.max(sequence).alias("last_sequence"))
