"""Scores of recorded episodes: metrics as a long table ``key, name, value, weight``, rewards, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def share(ideal: Column, used: Column) -> Column:
    """``ideal / used`` up to 1; 0 where nothing was used."""
    return F.when(used > 0, F.least(F.lit(1.0), ideal / used)).otherwise(0.0)


def efficiency(*, steps: Column, ideal_steps: Column, calls: Column, ideal_calls: Column, wall: Column, wall_limit: Column, failed: Column) -> Column:
    """Product of step, call and time shares, halved and so on by failures."""
    at_least = lambda c: F.greatest(c, F.lit(1))
    product = F.least(F.lit(1.0), at_least(ideal_steps) / at_least(steps)) * share(at_least(ideal_calls), calls) * F.least(F.lit(1.0), at_least(wall_limit) / at_least(wall)) / (1 + F.greatest(failed, F.lit(0)))
    return F.round(product, 6)


def tool_efficiency(*, renders: Column, expected_renders: Column, **rest: Column) -> Column:
    """The same for tool calls, and less for every render more or fewer than expected."""
    plain = {k: v for k, v in rest.items()}
    at_least = lambda c: F.greatest(c, F.lit(1))
    product = F.least(F.lit(1.0), at_least(plain["ideal_steps"]) / at_least(plain["steps"])) * share(at_least(plain["ideal_calls"]), plain["calls"]) / (1 + F.abs(renders - expected_renders)) * F.least(F.lit(1.0), at_least(plain["wall_limit"]) / at_least(plain["wall"])) / (1 + F.greatest(plain["failed"], F.lit(0)))
    return F.round(product, 6)


def to_metrics(rows: DataFrame, key: str, weights: dict[str, float | None]) -> DataFrame:
    """Columns named as metrics become rows ``key, name, value, weight``."""
    cells = F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").cast("double").alias("value"), F.lit(w).cast("double").alias("weight")) for n, w in weights.items()))
    return rows.select(key, F.explode(cells).alias("m")).select(key, "m.*")


def reward(metrics: DataFrame, key: str, digits: int = 6) -> DataFrame:
    """Weighted mean of the metrics with a weight; null if the weights add up to 0."""
    w = F.when(F.col("value").isNotNull(), F.col("weight"))
    return metrics.groupBy(key).agg(F.round(F.try_divide(F.sum(F.col("value") * w), F.sum(w)), digits).alias("reward"))


def semantic_outcome(metrics: DataFrame, key: str) -> DataFrame:
    """``correct`` if all ``task.*`` metrics are 1 or more, ``unscored`` without any."""
    task = F.col("name").startswith("task.")
    rows = metrics.groupBy(key).agg(F.count_if(task).alias("scored"), F.bool_and(F.when(task, F.col("value") >= 1)).alias("all_right"))
    return rows.select(key, F.when(F.col("scored") == 0, "unscored").when(F.col("all_right"), "correct").otherwise("wrong").alias("outcome"))


def faithful(evidence: DataFrame, key: str) -> DataFrame:
    """Per episode: source and rendered evidence both valid.

    ``evidence``: key, ``kind`` (source or rendered), ``same_box``, ``hash_ok``, ``contains_box``.
    """
    source = F.bool_or((F.col("kind") == "source") & F.col("same_box") & F.col("hash_ok"))
    rendered = F.bool_or((F.col("kind") == "rendered") & F.col("same_box") & F.col("contains_box") & F.col("hash_ok"))
    return evidence.groupBy(key).agg(F.coalesce(source, F.lit(False)).alias("source_valid"), F.coalesce(rendered, F.lit(False)).alias("rendered_valid"))


def score_grounding(rows: DataFrame, key: str, *, said: str, truth: str, crop: str, process: Column | None = None) -> DataFrame:
    """IoU of the answered box, whether the crop held the truth, faithfulness (both), and efficiency where ``process`` gives it."""
    more = [] if process is None else [process.alias("process.efficiency")]
    hit = geo.contains(geo.box(crop), geo.box(truth))
    value = F.round(geo.iou(geo.box(said), geo.box(truth)), 6)
    return rows.select(key, value.alias("task.iou"), hit.cast("int").alias("evidence.crop_contains_truth"), (hit & geo.valid_unit_box(geo.box(said))).cast("int").alias("evidence.faithfulness"), *more)


def abstention(said: Column, should: Column) -> list[Column]:
    """Correctness, false confidence and unnecessary abstention."""
    return [(said == should).cast("int").cast("double").alias("correct"), ((should == "abstained") & (said == "submitted")).alias("false_confidence"), ((should == "submitted") & (said == "abstained")).alias("unnecessary")]


def score_temporal(truth: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """``key, validity, correct, false_confidence, unnecessary, faithfulness`` of answers to requests for two dates.

    ``truth``: key, ``status, reason, before_id, after_id`` (best pairs); ``answers``: key, ``said`` (submitted or
    abstained), ``said_before, said_after, said_reason, cited`` (array of scenes).  A submitted answer is valid
    with the best pair, an abstention with the right reason; it is faithful if it is valid and cites both
    scenes, or none when it abstains.  A request without an answer counts as an invalid abstention.
    """
    rows = truth.join(answers, key, "left").withColumn("said", F.coalesce("said", F.lit("abstained")))
    should = F.when(F.col("status") == "selected", "submitted").otherwise("abstained")
    right, confident, needless = abstention(F.col("said"), should)
    pair = (F.col("said_before") == F.col("before_id")) & (F.col("said_after") == F.col("after_id"))
    submitted = F.col("said") == "submitted"
    valid = F.coalesce((F.col("said") == should) & F.when(submitted, pair).otherwise(F.col("said_reason") == F.col("reason")), F.lit(False))
    cites = F.when(submitted, F.array_contains("cited", F.col("before_id")) & F.array_contains("cited", F.col("after_id"))).otherwise(F.size("cited") == 0)
    number = lambda c: F.coalesce(c, F.lit(False)).cast("int").cast("double")
    return rows.select(key, number(valid).alias("validity"), right, confident, needless, number(valid & cites).alias("faithfulness"))


def score_memory(answers: DataFrame, hits: DataFrame, key: str, *, ideal_calls: int = 1) -> DataFrame:
    """``key, treatment, accuracy, faithfulness, efficiency, reward`` of answers with and without memory.

    ``answers``: key, ``treatment`` (with or without), ``said, truth, cited`` (array of memory ids),
    ``searches``; ``hits``: key, ``memory_id`` of what the searches returned.  An answer is faithful if it
    cites something, and nothing that its searches didn't return.  Efficiency counts where the
    protocol was kept: searches with memory, none without.
    """
    cited = answers.select(key, F.explode(F.array_distinct("cited")).alias("memory_id"))
    found = hits.select(key, "memory_id").distinct().withColumn("_hit", F.lit(True))
    seen = cited.join(found, [key, "memory_id"], "left").groupBy(key).agg(F.bool_and(F.col("_hit").isNotNull()).alias("_known"))
    rows = answers.join(seen, key, "left")
    number = lambda c: F.coalesce(c, F.lit(False)).cast("int").cast("double")
    with_memory = F.col("treatment") == "with"
    process = F.when(with_memory & (F.col("searches") > 0), F.round(share(F.lit(float(ideal_calls)), F.col("searches")), 6)).when(~with_memory & (F.col("searches") == 0), 1.0).otherwise(0.0)
    rows = rows.select(key, "treatment", number(F.col("said") == F.col("truth")).alias("accuracy"), number(F.col("_known")).alias("faithfulness"), process.alias("efficiency"))
    return rows.withColumn("reward", F.round(0.6 * F.col("accuracy") + 0.3 * F.col("faithfulness") + 0.1 * F.col("efficiency"), 6))


def unknown_citations(answers: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Cited evidence ids that the episode doesn't have."""
    cited = answers.select(key, F.explode("evidence_ids").alias("evidence_id")).distinct()
    return cited.join(evidence.select(key, "evidence_id").distinct(), [key, "evidence_id"], "left_anti")


def validate_answers(answers: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """The first broken rule of each JSON answer, or null.

    ``answers``: key, ``schema_id``, ``answer`` (JSON text); ``rules``: ``schema_id, rule_order, field,
    kind, required, allowed, low, high``.  Rules are joined by schema, and the first that fails wins.
    """
    rows = answers.withColumn("_v", F.try_parse_json("answer")).join(rules, "schema_id", "left")
    value = F.expr("get_json_object(answer, concat('$.', field))")
    number = F.expr("try_cast(get_json_object(answer, concat('$.', field)) AS double)")
    kind = F.expr("schema_of_variant(try_parse_json(coalesce(get_json_object(answer, concat('$.', field)), 'null')))")
    code = (
        F.when(F.col("_v").isNull(), "invalid_json")
        .when(F.col("required") & value.isNull(), "missing_field")
        .when(value.isNull(), None)
        .when((F.col("kind") == "number") & number.isNull(), "wrong_type")
        .when((F.col("kind") == "string") & kind.isin("BIGINT", "BOOLEAN"), "wrong_type")
        .when(F.col("allowed").isNotNull() & ~F.array_contains("allowed", value), "not_allowed")
        .when(number.isNotNull() & (F.isnan(number) | (F.abs(number) == float("inf"))), "not_finite")
        .when(number < F.col("low"), "below_minimum")
        .when(number > F.col("high"), "above_maximum")
    )
    rows = rows.withColumn("_code", code)
    return rows.groupBy(key).agg(F.min_by(F.col("_code"), F.when(F.col("_code").isNotNull(), F.col("rule_order"))).alias("code"))


def transcript_cost(items: DataFrame, key: str) -> DataFrame:
    """Calls and tokens of each run; items without usage are skipped."""
    used = F.col("usage").isNotNull()
    total = lambda f: F.coalesce(F.sum(F.col(f"usage.{f}")), F.lit(0)).alias(f)
    return items.groupBy(key).agg(F.count_if(used).alias("calls"), total("input_tokens"), total("output_tokens"))


def run_summary(runs: DataFrame, by: str) -> DataFrame:
    """Counts by truth and in all (rollup)."""
    return runs.rollup(by).agg(
        F.count(F.lit(1)).alias("episodes"),
        F.count_if("passed").alias("passed"),
        F.count_if("abstained").alias("abstained"),
        F.count_if(F.col("passed") & F.col("abstained")).alias("right_abstentions"),
        F.count_if(~F.col("passed") & ~F.col("abstained")).alias("false_confidence"),
        F.count_if(~F.col("passed") & F.col("abstained")).alias("unnecessary_abstentions"),
        F.sum("tokens").cast("long").alias("tokens"),
        F.max("elapsed_ms").alias("longest_ms"),
    )


def pivot_metrics(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One row a key with a column for each named metric."""
    return metrics.groupBy(*keys).pivot("name", names).agg(F.first("value"))


def match_status(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that match, are missing or are unexpected."""
    a = expected.select(*keys).distinct().withColumn("_e", F.lit(True))
    b = actual.select(*keys).distinct().withColumn("_a", F.lit(True))
    rows = a.join(b, keys, "full_outer")
    return rows.select(*keys, F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").otherwise("matched").alias("status"))


def same_sets(left: DataFrame, right: DataFrame, key: str, item: str) -> DataFrame:
    """Whether both sides have the same set of items of each key."""
    pack = lambda t, c: t.groupBy(key).agg(F.sort_array(F.collect_set(item)).alias(c))
    rows = pack(left, "_l").join(pack(right, "_r"), key, "full_outer")
    return rows.select(key, F.col("_l").eqNullSafe(F.col("_r")).alias("equal"))


def result_manifest(expected: DataFrame, reports: DataFrame, *, most_tokens: int = 100_000) -> DataFrame:
    """One row for each expected or reported sample with its failed checks.

    ``expected``: ``sample_id, task_id, inputs`` (array); ``reports``: ``sample_id, task_id, inputs,
    terminal, actions, tool_runs, rendered, tokens, reward``.
    """
    # Of a sample reported twice the whole of one report, the least, is judged.
    least = F.min(F.struct("task_id", "inputs", "terminal", "actions", "tool_runs", "rendered", "tokens", "reward"))
    n = reports.groupBy("sample_id").agg(F.count(F.lit(1)).alias("reports"), least.alias("x")).select("sample_id", "reports", "x.*")
    want = expected.select("sample_id", F.col("task_id").alias("want_task"), F.array_sort("inputs").alias("want_inputs"))
    rows = want.join(n, "sample_id", "full_outer")
    checks = {
        "expected": F.col("want_task").isNotNull(),
        "reported_once": F.col("reports") == 1,
        "task": F.col("task_id") == F.col("want_task"),
        "inputs": F.array_sort("inputs") == F.col("want_inputs"),
        "terminal": F.col("terminal").isin("submitted", "abstained"),
        "has_actions": F.col("actions") > 0,
        "one_run_each": F.col("tool_runs") == F.col("actions"),
        "rendered": F.col("rendered"),
        "tokens": F.col("tokens").between(1, most_tokens),
        "reward": F.col("reward").between(0, 1),
    }
    failed = F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items())), lambda x: x.isNotNull())
    return rows.select("sample_id", (F.size(failed) == 0).alias("passed"), F.array_join(F.sort_array(failed), ",").alias("failed"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def report_checks(expected: DataFrame, reports: DataFrame, episodes: DataFrame, events: DataFrame, artifacts: DataFrame, evidence: DataFrame, runs: DataFrame) -> DataFrame:
    """Each reported sample against its episode's records: ``sample_id, episode_id, passed, failed`` (sorted names).

    ``expected``: ``sample_id, task_id, task_version, manifest_sha, assets, contents`` (arrays);
    ``reports``: ``sample_id, episode_id, status, tool_calls, image_hashes, has_metadata, has_receipt,
    adapter_bound, resumable``; ``episodes``: ``episode_id, status, task_id, task_version, manifest_sha,
    state_version, assets, contents``; ``events``: ``episode_id``; ``artifacts``: ``episode_id, artifact_id,
    sha256, input``; ``evidence``: ``episode_id, artifact_id``; ``runs``: ``episode_id, action_id, completed``.
    Records are counted by episode before they meet, so a long episode is one row of sums.
    """
    made = artifacts.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_artifacts"), F.collect_set("sha256").alias("made_hashes"), F.array_sort(F.collect_set("input")).alias("used"))
    known = artifacts.select("episode_id", "artifact_id").distinct().withColumn("known", F.lit(True))
    cited = evidence.join(known, ["episode_id", "artifact_id"], "left").groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_evidence"), F.count_if(F.col("known").isNull()).alias("unknown_evidence"))
    by_action = runs.groupBy("episode_id", "action_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("completed").alias("done"))
    ran = by_action.groupBy("episode_id").agg(F.sum("n").alias("n_runs"), F.count_if((F.col("n") != 1) | (F.col("done") != 1)).alias("odd_actions"))
    traced = events.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_events"))
    named = lambda t, prefix, key: t.select(key, *(F.col(c).alias(f"{prefix}_{c}") for c in t.columns if c != key))
    rows = reports.join(named(expected, "want", "sample_id"), "sample_id", "left").join(named(episodes, "ep", "episode_id"), "episode_id", "left")
    for t in (traced, made, cited, ran):
        rows = rows.join(t, "episode_id", "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    same = lambda a, b: F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
    episode = F.col("ep_status").isNotNull()
    checks = {
        "report_passed": F.col("status") == "passed",
        "tool_called": some("tool_calls"),
        "image_sent": F.size("image_hashes") > 0,
        "response_metadata": F.col("has_metadata"),
        "image_receipt": F.col("has_receipt"),
        "adapter_bound": F.col("adapter_bound"),
        "resumable": F.col("resumable"),
        "episode_named": F.col("episode_id").startswith("ep2-"),
        "episode_ended": F.col("ep_status") == "terminated",
        "same_task": (F.col("ep_task_id") == F.col("want_task_id")) & (F.col("ep_task_version") == F.col("want_task_version")),
        "same_manifest": F.col("ep_manifest_sha") == F.col("want_manifest_sha"),
        "has_events": episode & some("n_events"),
        "has_evidence": episode & some("n_evidence"),
        "has_artifacts": episode & some("n_artifacts"),
        "has_runs": episode & some("n_runs"),
        "one_run_each": episode & (F.coalesce("odd_actions", F.lit(0)) == 0),
        "evidence_known": episode & (F.coalesce("unknown_evidence", F.lit(0)) == 0),
        "state_counted": some("ep_state_version"),
        "images_of_episode": episode & (F.size("image_hashes") > 0) & (F.size(F.array_except("image_hashes", F.coalesce("made_hashes", F.array().cast("array<string>")))) == 0),
        "same_assets": same(F.col("ep_assets"), F.col("want_assets")),
        "same_contents": same(F.col("ep_contents"), F.col("want_contents")),
        "all_inputs_used": same(F.col("used"), F.col("want_assets")),
    }
    failed = F.array_sort(F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()))))
    return rows.select("sample_id", "episode_id", (F.size(failed) == 0).alias("passed"), F.array_join(failed, ",").alias("failed"))


def report_totals(checked: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: samples, reported, passed, whether episodes are reported once each, and how often each check failed."""
    fails = checked.select(F.explode(F.split("failed", ",")).alias("name")).where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    packed = fails.agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "name", F.col("n").cast("string")))), ",").alias("failed_checks"))
    twice = checked.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("twice"))
    totals = checked.agg(F.count(F.lit(1)).alias("reported"), F.count_if("passed").alias("passed"))
    rows = expected.agg(F.count_distinct("sample_id").alias("samples")).crossJoin(totals).crossJoin(twice).crossJoin(packed)  # one row each
    return rows.select("samples", "reported", "passed", (F.col("twice") == 0).alias("episodes_unique"), "failed_checks")


def manifest_totals(manifest: DataFrame) -> DataFrame:
    """Samples, passed, tokens, and the distinct names of failed checks."""
    names = manifest.select(F.explode(F.split("failed", ",")).alias("name")).where("name <> ''").distinct()
    packed = names.agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("failed_checks"))
    totals = manifest.agg(F.count(F.lit(1)).alias("samples"), F.count_if("passed").alias("passed"), F.sum("tokens").cast("long").alias("tokens"))
    return totals.crossJoin(packed)  # one row on either side




#: How many runs of a benchmark have to be there: right ones, those of them that reject, and counterfactuals.
GROUP_SIZES = {"correct": 4, "rejection": 3, "counterfactual": 1}


def group_summary(runs: DataFrame, key: str, *, accepted: str = "valid-pair") -> DataFrame:
    """``key, status`` and counts of a benchmark's groups of runs.

    ``runs``: ``key, case_id, counterfactual, passed, false_confidence``.  Right runs all pass, and those of another case than ``accepted``
    reject without false confidence; a counterfactual passes by being found falsely confident.
    """
    own, other = ~F.col("counterfactual"), F.col("counterfactual")
    rejects = own & (F.col("case_id") != accepted)
    counts = {
        "correct_total": own, "correct_passed": own & F.col("passed"), "rejection_total": rejects, "rejection_false": rejects & F.coalesce("false_confidence", F.lit(False)),
        "rejection_sure": rejects & F.coalesce(~F.col("false_confidence"), F.lit(False)), "counterfactual_total": other, "counterfactual_passed": other & F.col("passed") & F.coalesce("false_confidence", F.lit(False)),
    }
    rows = runs.groupBy(key).agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()))
    n = GROUP_SIZES
    good = (F.col("correct_total") == n["correct"]) & (F.col("correct_passed") == F.col("correct_total")) & (F.col("rejection_total") == n["rejection"]) & (F.col("rejection_sure") == F.col("rejection_total")) & (F.col("counterfactual_total") == n["counterfactual"]) & (F.col("counterfactual_passed") == F.col("counterfactual_total"))
    return rows.withColumn("status", F.when(good, "passed").otherwise("failed")).drop("rejection_sure")
