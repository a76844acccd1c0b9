"""Evidence memory: snapshots as of a sequence, grants, search and case matrices."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo, hashing, times
from . import ranges

#: A fixed limit: no page of a search begins behind this offset.
LAST_OFFSET = 1000


def snapshot(events: DataFrame, as_of: DataFrame) -> DataFrame:
    """What is published and not withdrawn in each scope as of a sequence, and rule violations.

    ``events``: ``scope_id, sequence, event_type, memory_id`` and, if withdrawals name one, ``replacement_id``; ``as_of``: ``scope_id, as_of``.
    """
    rows = events.join(as_of, "scope_id").where(F.col("sequence") <= F.col("as_of"))
    publish, withdraw = F.col("event_type") == "publish", F.col("event_type") == "invalidate"
    one = rows.groupBy("scope_id", "memory_id").agg(F.count_if(publish).alias("published"), F.min(F.when(publish, F.col("sequence"))).alias("published_at"), F.min(F.when(withdraw, F.col("sequence"))).alias("invalidated_at"))
    code = F.when(F.col("published") == 0, "invalidate_without_publish").when(F.col("published") > 1, "published_twice").when(F.col("invalidated_at") < F.col("published_at"), "invalidate_before_publish")
    if "replacement_id" in events.columns:
        # The record that takes the place of a withdrawn one was published before.
        named = rows.where(withdraw & F.col("replacement_id").isNotNull()).select("scope_id", "memory_id", "replacement_id", F.col("sequence").alias("_at"))
        known = one.select("scope_id", F.col("memory_id").alias("replacement_id"), F.col("published_at").alias("_there"))
        lacking = named.join(known, ["scope_id", "replacement_id"], "left").where(F.col("_there").isNull() | (F.col("_there") > F.col("_at"))).select("scope_id", "memory_id").distinct()
        one = one.join(lacking.withColumn("_lacking", F.lit(True)), ["scope_id", "memory_id"], "left")
        code = F.coalesce(code, F.when(F.col("_lacking"), "missing_replacement"))
    return one.select("scope_id", "memory_id", "published_at", "invalidated_at", ((F.col("published") > 0) & F.col("invalidated_at").isNull()).alias("active"), code.alias("code"))


def authorize(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """The first rule against each request, or null: exactly one grant, reward, time, lifetime, sessions.

    ``requests``: ``request_id, task_id, version, reward, at, ttl, sessions``; ``grants``:
    ``task_id, version, min_reward, valid_from, expires_at, max_ttl, max_sessions``.
    """
    held = grants.groupBy("task_id", "version").agg(F.count(F.lit(1)).alias("grants"), *(F.min(c).alias(c) for c in ("min_reward", "valid_from", "expires_at", "max_ttl", "max_sessions")))
    rows = requests.join(held, ["task_id", "version"], "left")
    code = (
        F.when(F.col("grants").isNull(), "not_granted")
        .when(F.col("grants") > 1, "ambiguous_grant")
        .when(~times.current(F.col("at"), F.col("valid_from"), F.col("expires_at")), "outside_validity")
        .when(~F.coalesce(F.col("reward") >= F.col("min_reward"), F.lit(False)), "reward_below_threshold")
        .when(F.col("ttl") > F.col("max_ttl"), "lifetime_too_long")
        .when(F.col("sessions") >= F.col("max_sessions"), "too_many_sessions")
    )
    return rows.select("request_id", code.alias("code"))


#: Seconds that a record must last at least, and the coordinate systems a source may have.
LEAST_TTL, WGS84 = 60, ("EPSG:4326", "OGC:CRS84")


def build_records(candidates: DataFrame, policies: DataFrame, *, stored: bool = False) -> DataFrame:
    """``candidate_id, code, memory_id, provenance_sha256, available_at, expires_at``: records of evidence, or the first rule against them.

    ``candidates``: ``candidate_id, policy_id, granted`` (by :func:`authorize`), ``episode_status,
    answered, task_id, task_version, manifest_sha, pinned_task_id, pinned_task_version, pinned_manifest_sha,
    cited`` (array), ``evidence_id, evidence_source, frozen_sha, source_id, source_sha, source_crs``, the
    selector's box (null: none) and ``start, end``, the source's box ``s_*`` and ``s_start, s_end``,
    ``summary, object_type, platform, instrument, updated_at, ttl``; ``policies``: ``policy_id,
    scope_id, max_ttl, policy_expires_at``.  Ids are hashes of the whole record, so equal evidence gives equal ids.
    """
    rows = candidates.join(policies, "policy_id", "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    equal = lambda *pairs: [F.col(a) == F.col(b) for a, b in pairs]
    pin = equal(("task_id", "pinned_task_id"), ("task_version", "pinned_task_version"), ("manifest_sha", "pinned_manifest_sha"))
    complete = F.col("start").isNotNull() & F.col("end").isNotNull()
    for side in geo.SIDES:
        complete = complete & F.col(side).isNotNull()
    inside = (F.col("west") >= F.col("s_west")) & (F.col("east") <= F.col("s_east")) & (F.col("south") >= F.col("s_south")) & (F.col("north") <= F.col("s_north")) & (F.col("start") >= F.col("s_start")) & (F.col("end") <= F.col("s_end"))
    expires = F.timestamp_seconds(F.unix_seconds(F.col("updated_at").cast("timestamp")) + F.col("ttl")).cast("timestamp_ntz")
    rows = rows.withColumn("expires_at", expires)
    rules = (
        ("no_policy", F.col("scope_id").isNull()),
        ("not_authorized", no(F.col("granted"))),
        ("episode_unanswered", no((F.col("episode_status") == "terminated") & F.col("answered"))),
        ("task_pin_mismatch", no(pin[0] & pin[1] & pin[2])),
        ("evidence_not_cited", no(F.array_contains("cited", F.col("evidence_id")))),
        ("source_mismatch", no(F.col("evidence_source") == F.col("source_id"))),
        ("source_changed", no(F.col("frozen_sha") == F.col("source_sha"))),
        ("selector_incomplete", no(complete)),
        ("selector_outside_source", no(inside)),
        ("source_not_wgs84", no(F.upper("source_crs").isin(*WGS84))),
        ("lifetime_outside_policy", no(F.col("ttl").between(F.lit(LEAST_TTL), F.col("max_ttl")))),
        ("outlives_policy", no(F.col("expires_at") <= F.col("policy_expires_at"))),
    )
    code = F.coalesce(*(F.when(broken, F.lit(name)) for name, broken in rules))
    rows = rows.withColumn("code", code)
    rows = rows.withColumn("provenance_sha256", hashing.digest(*map(F.col, PROVENANCE)))
    good = F.col("code").isNull()
    made = [(c, F.col(c)) for c in BODY] if stored else [("provenance_sha256", F.col("provenance_sha256")), ("available_at", F.col("updated_at")), ("expires_at", F.col("expires_at"))]
    return rows.select("candidate_id", "code", *(F.when(good, v).alias(n) for n, v in (("memory_id", _memory_id()), *made)), *(["evidence_id"] if stored else []))


#: What a record's provenance and its id are hashes of, in this order.
PROVENANCE = ("task_id", "task_version", "manifest_sha", "evidence_id", "source_id", "source_sha")
BODY = ("scope_id", "policy_id", "object_type", "summary", *geo.SIDES, "start", "end", "platform", "instrument", "updated_at", "expires_at", "provenance_sha256")


def _memory_id() -> Column:
    return F.concat(F.lit("mem-"), hashing.digest(*map(F.col, BODY)))


def verify_records(stored: DataFrame, sources: DataFrame) -> DataFrame:
    """``memory_id, code`` of stored records against what their sources and their own columns give (null: sound).

    ``stored``: ``memory_id, evidence_id`` and the columns of ``BODY``; ``sources``: the columns of ``PROVENANCE``, by ``evidence_id``.
    The provenance is hashed anew from the joined sources, the id from the stored record: ``missing_source``,
    ``ambiguous_source`` (two that differ), ``provenance_mismatch``, ``id_mismatch``, ``repeated_id``, the first of them.
    """
    known = sources.select("evidence_id", hashing.digest(*map(F.col, PROVENANCE)).alias("_p")).groupBy("evidence_id").agg(F.min("_p").alias("_p"), F.max("_p").alias("_q"))
    times = stored.groupBy("memory_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = stored.withColumn("_id", _memory_id()).join(known, "evidence_id", "left").join(times, "memory_id", "left")
    code = (
        F.when(F.col("_p").isNull(), "missing_source")
        .when(F.col("_p") != F.col("_q"), "ambiguous_source")
        .when(~F.col("provenance_sha256").eqNullSafe(F.col("_p")), "provenance_mismatch")
        .when(~F.col("memory_id").eqNullSafe(F.col("_id")), "id_mismatch")
        .when(F.col("_n") > 1, "repeated_id")
    )
    return rows.select("memory_id", "evidence_id", code.alias("code"))


def judge_commands(commands: DataFrame, writers: DataFrame, *, cap: int) -> DataFrame:
    """``scope_id, sequence, verdict`` of publications and invalidations, each judged by what stood before it.

    ``commands``: ``scope_id, sequence, actor_id, kind, memory_id, content, reason, replacement_id``;
    ``writers``: ``scope_id, actor_id``.  ``published`` and ``invalidated`` take effect; ``repeat`` says the
    same again; all others are refused and change nothing: ``not_authorized``, ``content_conflict``,
    ``cap_reached`` (of active records), ``unknown_memory``, ``invalidation_conflict``,
    ``replacement_inactive``.  Each verdict depends on the ones before, so a scope is a stream of sorted batches;
    its state is the ids it has seen.
    """
    fields = ("scope_id", "sequence", "kind", "memory_id", "content", "reason", "replacement_id", "actor_id")
    allowed = writers.select("scope_id", "actor_id").distinct().withColumn("allowed", F.lit(True))
    rows = commands.join(allowed, ["scope_id", "actor_id"], "left").select(*fields, F.coalesce("allowed", F.lit(False)).alias("allowed"))
    kinds = dict(rows.dtypes)
    rows = rows.repartition("scope_id").sortWithinPartitions("scope_id", "sequence")

    def run(batches):
        scope, contents, gone = None, {}, {}

        def verdict(kind, memory, content, reason, replacement, actor, allowed):
            if not allowed:
                return "not_authorized"
            if kind == "publish":
                if memory in contents:
                    return "repeat" if contents[memory] == content else "content_conflict"
                if len(contents) - len(gone) >= cap:
                    return "cap_reached"
                contents[memory] = content
                return "published"
            if memory not in contents:
                return "unknown_memory"
            if memory in gone:
                return "repeat" if gone[memory] == (reason, replacement, actor) else "invalidation_conflict"
            if replacement is not None and (replacement not in contents or replacement in gone):
                return "replacement_inactive"
            gone[memory] = (reason, replacement, actor)
            return "invalidated"

        for batch in batches:
            columns, out = [c.to_pylist() for c in batch.columns], []
            for own, _, *command in zip(*columns, strict=True):
                if own != scope:
                    scope, contents, gone = own, {}, {}
                out.append(verdict(*command))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["scope_id", "sequence", "verdict"])

    return rows.mapInArrow(run, f"scope_id {kinds['scope_id']}, sequence {kinds['sequence']}, verdict string")


def publish_batch(records: DataFrame, *, cap: int) -> DataFrame:
    """Publications ``scope_id, sequence, memory_id`` under a cap of active records.

    A repeat of a memory is idempotent; beyond the cap new ones are refused.
    """
    first = F.row_number().over(W.partitionBy("scope_id", "memory_id").orderBy("sequence"))
    rows = records.withColumn("_first", (first == 1).cast("int"))
    active = F.sum("_first").over(W.partitionBy("scope_id").orderBy("sequence").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("_active", active)
    verdict = F.when(F.col("_first") == 0, "repeat").when(F.col("_active") > cap, "cap_reached").otherwise("published")
    return rows.withColumn("verdict", verdict).drop("_first", "_active")


def memory_search(records: DataFrame, queries: DataFrame, *, limit: int = 20) -> DataFrame:
    """Pages of records for many searches at once, joined by platform and by covers of boxes and of intervals.

    ``records``: ``memory_id, platform``, a box, ``available_at, expires_at``, ``start, end``;
    ``queries``: ``query_id, platform, as_of``, a box ``q_*`` and ``q_start, q_end``.  Where queries have
    them, ``q_instrument`` and ``q_object_type`` must be the record's (null: any), and with ``scope_id,
    snapshot_sequence`` a record counts only if it was published, and not yet invalidated, at that sequence
    of its scope (records then have ``scope_id, published_at, invalidated_at``).  With ``offset`` a page of
    ``limit`` starts there, and rows have ``next_offset``: null at the end, and past ``LAST_OFFSET``.
    Equal queries are searched once.
    """
    pinned, paged = "snapshot_sequence" in queries.columns, "offset" in queries.columns
    queries, members = ranges.alike(queries, "query_id")
    held = records.withColumns({"_start": ranges.micros(F.col("start")), "_end": ranges.micros(F.col("end"))})
    asked = queries.withColumns({"_from": ranges.micros(F.col("q_start")), "_until": ranges.micros(F.col("q_end"))})
    box = [("west", "east", "q_west", "q_east"), ("south", "north", "q_south", "q_north")]
    met = ranges.meeting(held, asked, [(ranges.DEGREES, 2, box), (ranges.HOUR, 8, [("_start", "_end", "_from", "_until")])], on=("platform", *(["scope_id"] if pinned else [])))
    met = met.where(times.current(F.col("as_of"), F.col("available_at"), F.col("expires_at")))
    for c in ("instrument", "object_type"):
        if f"q_{c}" in queries.columns:
            met = met.where(F.col(f"q_{c}").isNull() | (F.col(c) == F.col(f"q_{c}")))
    if pinned:
        seen = F.col("snapshot_sequence")
        met = met.where((F.col("published_at") <= seen) & (F.col("invalidated_at").isNull() | (F.col("invalidated_at") > seen)))
    w = W.partitionBy("query_id")
    met = met.withColumns({"position": F.row_number().over(w.orderBy("memory_id")).cast("long"), "matched_count": F.count(F.lit(1)).over(w)})
    shown = ["query_id", "memory_id", "position", "matched_count"]
    if not paged:
        return ranges.shared(met.where(F.col("position") <= limit).select(*shown), members, "query_id").select(*shown)
    after = F.col("offset") + limit
    following = F.when((after < F.col("matched_count")) & (after <= LAST_OFFSET), after)
    met = met.where((F.col("position") > F.col("offset")) & (F.col("position") <= after)).select(*shown, following.alias("next_offset"))
    return ranges.shared(met, members, "query_id").select(*shown, "next_offset")


def scan_costs(records: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, records_scanned, input_bytes``: what a search reads, the records of its scope published by its sequence.

    ``records``: ``scope_id, published_at, bytes``; ``queries``: ``query_id, scope_id, snapshot_sequence``.
    Records are summed by sequence before they meet the queries of their scope.
    """
    steps = records.groupBy("scope_id", F.col("published_at").alias("at")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    none = F.lit(None).cast("long")
    asked = queries.select("scope_id", F.col("snapshot_sequence").alias("at"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bytes"), "query_id")
    # A range frame takes in all steps at the query's own sequence.
    w = W.partitionBy("scope_id").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    rows = steps.withColumn("query_id", none).unionByName(asked)
    return rows.select("query_id", F.sum("n").over(w).alias("records_scanned"), F.sum("bytes").over(w).alias("input_bytes")).where("query_id IS NOT NULL")


def case_matrix(records: DataFrame) -> DataFrame:
    """Six variants of each record for tests of retrieval: what is changed, and whether a search for the record finds it.

    ``records``: ``item_id, west, east, platform, acquired, available_at, expires_at, summary``.  A
    conflicting record is found like the right one, but says something else; an expired one was
    available for a second only.
    """
    columns = ("west", "east", "platform", "acquired", "expires_at", "summary")
    changes = {
        "correct": (True, {}),
        "conflict": (True, {"summary": F.concat(F.lit("not: "), "summary")}),
        "neighbour": (False, {"west": F.col("east") + 0.1, "east": 2 * F.col("east") - F.col("west") + 0.1}),
        "expired": (False, {"expires_at": F.col("available_at") + F.expr("INTERVAL 1 SECOND")}),
        "date": (False, {"acquired": F.col("acquired") + F.expr("INTERVAL 400 DAY")}),
        "sensor": (False, {"platform": F.concat(F.lit("other than "), "platform")}),
    }
    cases = [F.struct(F.lit(name).alias("case_name"), F.lit(found).alias("expected"), *(change.get(c, F.col(c)).alias(f"case_{c}") for c in columns)) for name, (found, change) in changes.items()]
    return records.select("item_id", F.explode(F.array(*cases)).alias("c")).select("item_id", "c.*")


def check_cases(records: DataFrame, cases: DataFrame) -> DataFrame:
    """``item_id, case_name, expected, found, says_same``: each variant under the search that its record answers.

    The search asks for the record's box, platform and date, an hour after it became available.
    """
    asked = records.select("item_id", F.col("west").alias("q_west"), F.col("east").alias("q_east"), F.col("platform").alias("q_platform"), F.col("acquired").alias("q_acquired"), F.col("summary").alias("q_summary"), "available_at")
    rows = cases.join(asked, "item_id")
    current = times.current(F.col("available_at") + F.expr("INTERVAL 1 HOUR"), F.col("available_at"), F.col("case_expires_at"))
    found = (F.col("case_west") <= F.col("q_east")) & (F.col("case_east") >= F.col("q_west")) & (F.col("case_platform") == F.col("q_platform")) & (F.col("case_acquired") == F.col("q_acquired")) & current
    return rows.select("item_id", "case_name", "expected", F.coalesce(found, F.lit(False)).alias("found"), (F.col("case_summary") == F.col("q_summary")).alias("says_same"))
