"""Exact evaluation metrics, always grouped: one job covers every zone.

Input is a scored table with ``by`` columns, a 0/1 label ``y_true`` and a probability ``y_prob``.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.operators.scan import HOT_ROWS, running_totals

# The evaluation and the search thresholds.
EVAL_THRESHOLDS = [float(t) for t in np.linspace(0.05, 0.95, 19)]
TUNE_THRESHOLDS = [float(t) for t in np.linspace(0.1, 0.9, 7)]


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def fbeta(beta: float, tp="tp", fp="fp", fn="fn") -> Column:
    b2 = float(beta * beta)
    hit = F.col(tp) * (1 + b2)
    return ratio(hit, hit + F.col(fn) * b2 + F.col(fp))


def score_curve(scored: DataFrame, by: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per distinct score with running positives and rows, highest score first."""
    g = scored.groupBy(*by, "y_prob").agg(
        F.sum(F.col("y_true").cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    return running_totals(g, by, [F.desc("y_prob")], {"cum_pos": F.col("pos"), "cum_n": F.col("n")}, hot_rows,
                          bound=scored)


def class_totals(scored: DataFrame, by: list[str]) -> DataFrame:
    return scored.groupBy(*by).agg(
        F.sum(F.col("y_true").cast("long")).alias("positives"), F.count(F.lit(1)).alias("rows"))


def average_precision(scored: DataFrame, by: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Step-wise average precision; rows with equal scores count as one step."""
    curve = score_curve(scored, by, hot_rows)
    steps = F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n"))
    return curve.groupBy(*by).agg(ratio(steps, F.sum("pos")).alias("pr_auc"))


def roc_points(scored: DataFrame, by: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """False and true positive counts at every distinct score."""
    c = score_curve(scored, by, hot_rows)
    return c.select(*by, "y_prob", "pos", (F.col("n") - F.col("pos")).alias("neg"), F.col("cum_pos").alias("tp"),
                    (F.col("cum_n") - F.col("cum_pos")).alias("fp"))


def roc_auc(scored: DataFrame, by: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Trapezoid area; NULL when a class is missing."""
    p = roc_points(scored, by, hot_rows)
    area = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2.0)
    return p.groupBy(*by).agg(
        F.try_divide(area, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def confusion(scored: DataFrame, by: list[str], threshold: Column | float = 0.5) -> DataFrame:
    """Counts tn, fp, fn, tp; always four numbers."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit, true = F.col("y_prob") >= t, F.col("y_true") == 1
    return scored.groupBy(*by).agg(
        F.count_if(~hit & ~true).alias("tn"), F.count_if(hit & ~true).alias("fp"),
        F.count_if(~hit & true).alias("fn"), F.count_if(hit & true).alias("tp"))


def with_class_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and F2 from confusion counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({
        "accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "f1": fbeta(1), "f2": fbeta(2)})


def sweep_counts(scored: DataFrame, by: list[str], thresholds: list[float]) -> DataFrame:
    """Confusion counts for each threshold from one grouped pass."""
    true = F.col("y_true") == 1
    aggs = [F.count_if(true).alias("_p"), F.count(F.lit(1)).alias("_n")]
    for i, t in enumerate(thresholds):
        aggs += [F.count_if((F.col("y_prob") >= t) & true).alias(f"_tp{i}"),
                 F.count_if(F.col("y_prob") >= t).alias(f"_hit{i}")]
    wide = scored.groupBy(*by).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"_tp{i}").alias("tp"), F.col(f"_hit{i}").alias("hit"))
                     for i, t in enumerate(thresholds)])
    s = wide.select(*by, "_p", "_n", F.explode(rows).alias("_s")).select(*by, "_p", "_n", "_s.*")
    fp, fn = F.col("hit") - F.col("tp"), F.col("_p") - F.col("tp")
    return s.select(*by, "threshold", (F.col("_n") - F.col("_p") - fp).alias("tn"), fp.alias("fp"), fn.alias("fn"), "tp")


def threshold_sweep(scored: DataFrame, by: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Best threshold by 0.6 F2 + 0.3 F1 + 0.1 AP (first maximum), with the best F1 and F2 seen."""
    s = with_class_metrics(sweep_counts(scored, by, EVAL_THRESHOLDS))
    ap = average_precision(scored, by, hot_rows)
    s = s.join(ap, by) if by else s.join(F.broadcast(ap))
    s = s.withColumn("score", 0.6 * F.col("f2") + 0.3 * F.col("f1") + 0.1 * F.col("pr_auc"))
    best = F.min(F.struct((-F.col("score")).alias("neg"), "threshold", "tn", "fp", "fn", "tp",
                          "accuracy", "precision", "recall"))
    out = s.groupBy(*by).agg(best.alias("_b"), F.max("f1").alias("f1"), F.max("f2").alias("f2"),
                             F.max("pr_auc").alias("pr_auc"))
    b = F.col("_b")
    return out.select(*by, b["threshold"].alias("best_threshold"), (-b["neg"]).alias("best_score"), "pr_auc", "f1", "f2",
                      *[b[c].alias(c) for c in ("tn", "fp", "fn", "tp", "accuracy", "precision", "recall")])


def tuning_sweep(scored: DataFrame, by: list[str]) -> DataFrame:
    """Best recall and best F2 over the search thresholds."""
    s = with_class_metrics(sweep_counts(scored, by, TUNE_THRESHOLDS))
    return s.groupBy(*by).agg(F.max("recall").alias("best_recall"), F.max("f2").alias("best_f2"))


def evaluate_classifier(scored: DataFrame, by: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """All classifier metrics, one row per group."""
    sweep, auc = threshold_sweep(scored, by, hot_rows), roc_auc(scored, by, hot_rows)
    return sweep.join(auc, by) if by else sweep.join(F.broadcast(auc))


def catastrophic(true: Column, pred: Column) -> Column:
    # More than 500 raw units, under-predicted by more than 30 percent.
    return (true > 500) & ((true - pred) > 0.3 * true)


def asymmetric_loss(true: Column, pred: Column) -> Column:
    under, over = F.greatest(true - pred, F.lit(0.0)), F.greatest(pred - true, F.lit(0.0))
    return F.avg(under * under + 0.1 * over * over)


def search_loss(true: Column, pred: Column) -> Column:
    """Loss minimised by the regressor search: asymmetric loss plus a charge for catastrophic misses."""
    return asymmetric_loss(true, pred) + 10.0 * F.count_if(catastrophic(true, pred)) / F.greatest(
        F.count(F.lit(1)), F.lit(1))


def evaluate_regressor(scored: DataFrame, by: list[str]) -> DataFrame:
    """Regression metrics of ``y_log`` / ``pred_log``: R2 in log space, the rest in raw units."""
    t, p = F.expm1("y_log"), F.expm1("pred_log")
    n, cat = F.count(F.lit(1)), F.count_if(catastrophic(t, p))
    res, tot = F.sum(F.pow(F.col("y_log") - F.col("pred_log"), 2)), F.var_pop("y_log") * n
    under = F.greatest(t - p, F.lit(0.0))
    mse = F.avg(F.pow(t - p, 2))
    return scored.groupBy(*by).agg(
        F.when(tot > 0, 1 - F.try_divide(res, tot)).otherwise(F.when(res == 0, 1.0).otherwise(0.0)).alias("r2_log_space"),
        mse.alias("mse_raw"), F.sqrt(mse).alias("rmse_raw"), F.avg(F.abs(t - p)).alias("mae_raw"),
        F.avg(under * under).alias("asymmetric_underestimation_cost"), cat.alias("catastrophic_miss_count"),
        ratio(cat, F.greatest(n, F.lit(1))).alias("catastrophic_rate"), asymmetric_loss(t, p).alias("asymmetric_loss"))


def cv_summary(folds: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    return folds.groupBy(*by).agg(F.avg(score).alias("cv_mean"), F.stddev_pop(score).alias("cv_std"))


def selection_scores(candidates: DataFrame, budget_seconds: float = 2.0) -> DataFrame:
    """Add ``selection`` to candidates ``(full_pr, cv_mean, cv_std, full_seconds)``."""
    cv = F.coalesce(F.col("cv_mean"), F.lit(0.0))
    penalty = F.when(cv == 0, 1.0).otherwise(F.col("cv_std") / (cv + 1e-6))
    return candidates.withColumn("selection", (
        0.55 * F.col("full_pr") + 0.30 * cv + 0.10 * (1 - penalty) - 0.05 * (F.col("full_seconds") / budget_seconds)))


def best_candidate(candidates: DataFrame, by: list[str], order: str = "candidate") -> DataFrame:
    """Highest selection score per group; the first one in ``order`` wins a tie."""
    top = F.min(F.struct((-F.col("selection")).alias("neg"), F.col(order)))
    return selection_scores(candidates).groupBy(*by).agg(top.alias("_b")).select(
        *by, F.col("_b")[order].alias(order), (-F.col("_b.neg")).alias("selection"))


def probability_histogram(scored: DataFrame, bins: int = 50, value: str = "y_prob") -> DataFrame:
    """Equal-width bins between the smallest and largest value; the last bin is closed."""
    lo, hi = scored.agg(F.min(value), F.max(value)).first()
    if lo is None:
        return scored.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("int")
    return scored.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select(
        "bin", (lo + F.col("bin") * width).alias("low"), (lo + (F.col("bin") + 1) * width).alias("high"), "n")


def density_grid(points: DataFrame, cell: float, by: list[str] | None = None) -> DataFrame:
    """Sample counts per latitude/longitude cell."""
    return points.groupBy(*(by or []), F.floor(F.col("latitude") / cell).alias("cell_y"),
                          F.floor(F.col("longitude") / cell).alias("cell_x")).agg(F.count(F.lit(1)).alias("n"))
