"""Zone and global summary tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberline.operators.metrics import density_grid, probability_histogram
from emberline.operators.quantiles import exact_quantiles

# Metrics shown in the range table and columns of the correlation table.
RANGE_METRICS = ["pr_auc", "f2", "accuracy", "recall", "precision"]
META_COLUMNS = ["total_samples", "fire_rate", "latitude", "pr_auc", "f2", "cv_std"]


def performance_summary(registry: DataFrame, centroids: DataFrame) -> DataFrame:
    """One row per zone with metrics, confusion counts and centroid."""
    c = {n: F.coalesce(F.col(n), F.lit(0)).cast("long") for n in ("tn", "fp", "fn", "tp")}
    total = c["tn"] + c["fp"] + c["fn"] + c["tp"]
    at = centroids.select("ecozone", F.col("latitude").alias("latitude"), F.col("longitude").alias("longitude"))
    return registry.join(at, "ecozone", "left").select(
        F.col("ecozone").alias("zone"), total.alias("total_samples"),
        ((c["tp"] + c["fn"]) / F.greatest(F.lit(1), total)).alias("fire_rate"), "latitude", "longitude",
        "pr_auc", "f2", "accuracy", "precision", "recall", F.col("rmse_raw").alias("rmse"),
        F.col("r2_log_space").alias("r2"), F.col("cv_pr_auc_mean").alias("cv_mean"),
        F.col("cv_pr_auc_std").alias("cv_std"), *[v.alias(n) for n, v in c.items()])


def melt_metrics(summary: DataFrame, metrics: list[str] = RANGE_METRICS) -> DataFrame:
    return summary.unpivot(["zone"], metrics, "metric", "score")


def metric_ranges(summary: DataFrame, metrics: list[str] = RANGE_METRICS) -> DataFrame:
    """Five-number summary per metric."""
    q = exact_quantiles(melt_metrics(summary, metrics), ["score"], [0.0, 0.25, 0.5, 0.75, 1.0], ["metric"])
    names = ("low", "q1", "median", "q3", "high")
    return q.select("metric", *[F.col(f"q{i}").alias(n) for i, n in enumerate(names)])


def meta_correlation(summary: DataFrame, cols: list[str] = META_COLUMNS) -> DataFrame:
    """Pearson correlation of zone figures, rows with a NULL left out; ``(a, b, corr)``."""
    full = summary.select(*[F.col(c).cast("double") for c in cols]).dropna("any")
    pairs = [(a, b) for a in cols for b in cols]
    # A figure without spread has no correlation: NULL.
    wide = full.agg(*[F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"c{i}")
                      for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr"))
                     for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(rows).alias("_r")).select("_r.*")


def global_confusion(summary: DataFrame) -> DataFrame:
    """2 x 2 counts over all zones, safe ones included."""
    s = summary.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tn", "fp", "fn", "tp")])
    rows = F.array(F.struct(F.lit("Actual 0").alias("actual"), F.col("tn").alias("pred_0"), F.col("fp").alias("pred_1")),
                   F.struct(F.lit("Actual 1").alias("actual"), F.col("fn").alias("pred_0"), F.col("tp").alias("pred_1")))
    return s.select(F.explode(rows).alias("_r")).select("_r.*")


def global_reports(registry: DataFrame, centroids: DataFrame, holdout: DataFrame, samples: DataFrame,
                   cell: float = 0.5) -> dict[str, DataFrame]:
    """All global tables by name."""
    summary = performance_summary(registry, centroids)
    return {
        "performance_summary": summary, "metric_ranges": metric_ranges(summary),
        "meta_correlation": meta_correlation(summary), "global_confusion_matrix": global_confusion(summary),
        "probability_histogram": probability_histogram(holdout), "sample_density": density_grid(samples, cell, ["ecozone"]),
        "zone_report": zone_report(summary),
    }


def zone_metadata(registry: DataFrame) -> dict[str, DataFrame]:
    """What is known of each zone's classifier and regressor, one row per zone that has one."""
    clf = ["thr", "pr_auc", "auc", "f2", "f1", "accuracy", "precision", "recall", "tn", "fp", "fn", "tp", "cv_pr_auc_mean", "cv_pr_auc_std", "clf_params", "message"]
    reg = ["best_model", "reg_params", "r2_log_space", "mse_raw", "rmse_raw", "mae_raw", "asymmetric_underestimation_cost", "catastrophic_rate", "catastrophic_miss_count"]
    return {kind: registry.filter(flag).select("ecozone", *[c for c in cols if c in registry.columns])
            for kind, flag, cols in (("classifier", "has_clf", clf), ("regressor", "has_reg", reg))}


# The figures of a zone's report, by section.
REPORT = {"classifier": ["pr_auc", "f2", "accuracy", "precision", "recall", "cv_mean", "cv_std", "tn", "fp", "fn", "tp"], "regressor": ["rmse", "r2"]}


def zone_report(summary: DataFrame) -> DataFrame:
    """``(zone, section, field, value)``: the figures of each zone's classifier and regressor, missing ones left out."""
    parts = [F.struct(F.lit(s).alias("section"), F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for s, cols in REPORT.items() for c in cols]
    return summary.select("zone", F.explode(F.array(*parts)).alias("_r")).select("zone", "_r.*").filter("value is not null")
