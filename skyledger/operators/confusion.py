"""Evaluation operators on pixels and labels: confusion, thresholds, change, image quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.raster import ratio

COUNTS = ["tn", "fp", "fn", "tp"]


def confusion(labels: DataFrame, truth: Column, predicted: Column, keys: list[str]) -> DataFrame:
    """Four counts a key."""
    p, t = F.coalesce(predicted, F.lit(False)), F.coalesce(truth, F.lit(False))
    return labels.groupBy(*keys).agg(F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(t & p).alias("tp"))


def ratios(counts: DataFrame, digits: int = 6) -> DataFrame:
    """Precision, recall, IoU, specificity and balanced accuracy; null where undefined."""
    tn, fp, fn, tp = map(F.col, COUNTS)
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    named = {"precision": ratio(tp, tp + fp), "recall": recall, "iou": ratio(tp, tp + fp + fn), "specificity": specificity, "balanced_accuracy": (recall + specificity) / 2}
    return counts.withColumns({k: F.round(v, digits) for k, v in named.items()})


def micro(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of all windows are added before any ratio is taken."""
    total = counts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in COUNTS)) if keys else counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS))
    return ratios(total)


def decisions(counts: DataFrame, thresholds: list[float], keys: list[str]) -> DataFrame:
    """For each threshold: would a window be taken by its true and by its predicted positive share."""
    tn, fp, fn, tp = map(F.col, COUNTS)
    total = tn + fp + fn + tp
    rows = counts.withColumns({"true_fraction": ratio(tp + fn, total), "predicted_fraction": ratio(tp + fp, total)})
    rows = rows.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    right, said = F.col("true_fraction") <= F.col("threshold"), F.col("predicted_fraction") <= F.col("threshold")
    outcome = F.when(right & said, "true_accept").when(~right & said, "false_accept").when(right & ~said, "false_reject").otherwise("true_reject")
    return rows.select(*keys, "threshold", F.round("true_fraction", 6).alias("true_fraction"), F.round("predicted_fraction", 6).alias("predicted_fraction"), outcome.alias("outcome"))


def decision_summary(decided: DataFrame, sample: str) -> DataFrame:
    """Outcome counts, accuracy and the ids of wrong decisions for each threshold."""
    n = lambda k: F.count_if(F.col("outcome") == k)
    ids = lambda k: F.array_join(F.sort_array(F.collect_list(F.when(F.col("outcome") == k, F.col(sample)))), ",")
    kinds = ("true_accept", "false_accept", "false_reject", "true_reject")
    return decided.groupBy("threshold").agg(*(n(k).alias(f"{k}s") for k in kinds), F.round(ratio(n("true_accept") + n("true_reject"), F.count(F.lit(1))), 6).alias("accuracy"), ids("false_accept").alias("false_accept_ids"), ids("false_reject").alias("false_reject_ids"))


def change_truth(masks: DataFrame, keys: list[str], *, minor: float = 0.1, dominance: float = 1.5) -> DataFrame:
    """Class and direction of change between two binary masks ``before, after`` (booleans)."""
    new, gone = F.count_if(~F.col("before") & F.col("after")), F.count_if(F.col("before") & ~F.col("after"))
    rows = masks.groupBy(*keys).agg(new.alias("new_pixels"), gone.alias("demolished_pixels"), F.count(F.lit(1)).alias("total_pixels"))
    n, d = F.col("new_pixels"), F.col("demolished_pixels")
    share = (n + d) / F.col("total_pixels")
    kind = F.when(n + d == 0, "none").when(share <= minor, "minor").otherwise("major")
    way = F.when(n + d == 0, "none").when(n > d * dominance, "construction").when(d > n * dominance, "demolition").otherwise("mixed")
    return rows.withColumns({"change_fraction": F.round(share, 6), "change_class": kind, "direction": way})


def fraction_score(said: Column, truth: Column, tolerance: float) -> Column:
    return F.round(F.greatest(F.lit(0.0), 1 - F.abs(said - truth) / tolerance), 6)


def image_quality(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Luminance mean and sample variance, shares of opaque and grey pixels, distinct colours, verdict."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    light = 0.2126 * r + 0.7152 * g + 0.0722 * b
    opaque = F.col("a") == 255
    grey = (F.abs(r - g) <= 2) & (F.abs(g - b) <= 2)
    rows = pixels.groupBy(*keys).agg(
        F.round(F.avg(light), 8).alias("luminance_mean"),
        F.round(F.coalesce(F.var_samp(light), F.lit(0.0)), 5).alias("luminance_variance"),
        F.round(F.avg(opaque.cast("double")), 6).alias("opaque_fraction"),
        F.round(F.avg(grey.cast("double")), 6).alias("grey_fraction"),
        F.least(F.count_distinct(r * 65536 + g * 256 + b), F.lit(4096)).alias("colours"),
    )
    return rows.withColumn("passed", (F.col("luminance_variance") > 1) & (F.col("opaque_fraction") > 0.99) & (F.col("colours") >= 8))
