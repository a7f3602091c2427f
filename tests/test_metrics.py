import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import metrics, reports


def scored(spark, rows):
    return spark.createDataFrame(rows, "ecozone int, row_id long, y_true int, y_prob double")


def brute_ap(rows):
    total, out, last = sum(y for y, _ in rows), 0.0, 0.0
    if not total:
        return 0.0
    for t in sorted({p for _, p in rows}, reverse=True):
        tp, n = sum(y for y, p in rows if p >= t), sum(1 for _, p in rows if p >= t)
        out += (tp / total - last) * tp / n
        last = tp / total
    return out


def brute_auc(rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(1)
    rows = [(0 if rnd.random() < 0.5 else rnd.randint(1, 3), i, int(rnd.random() < 0.3), rnd.randint(0, 60) / 60) for i in range(1500)]
    rows += [(9, 5000 + i, 0, i / 10) for i in range(5)]
    return rows, scored(spark, rows)


@pytest.mark.parametrize("hot", [1_000_000, 100])
def test_ranking_metrics(data, hot):
    rows, df = data
    ap = {r["ecozone"]: r["pr_auc"] for r in metrics.average_precision(df, ["ecozone"], hot).collect()}
    auc = {r["ecozone"]: r["auc"] for r in metrics.roc_auc(df, ["ecozone"], hot).collect()}
    for z in {r[0] for r in rows}:
        part = [(r[2], r[3]) for r in rows if r[0] == z]
        assert abs(ap[z] - brute_ap(part)) < 1e-12
        want = brute_auc(part)
        assert auc[z] is None if want is None else abs(auc[z] - want) < 1e-12


def test_zero_denominators(spark):
    df = metrics.with_class_metrics(metrics.confusion(scored(spark, [(0, 1, 0, 0.1)]), ["ecozone"]))
    r = df.first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"], r["accuracy"], r["precision"], r["recall"], r["f2"]) == (1, 0, 0, 0, 1.0, 0.0, 0.0, 0.0)


def test_sweep_takes_first_maximum(spark):
    r = metrics.threshold_sweep(scored(spark, [(0, 1, 1, 0.9), (0, 2, 0, 0.02)]), ["ecozone"]).first()
    assert r["best_threshold"] == 0.05 and r["f1"] == 1.0 and r["tp"] == 1


def test_ungrouped(data):
    rows, df = data
    got = metrics.evaluate_classifier(df, []).first()
    assert abs(got["pr_auc"] - brute_ap([(r[2], r[3]) for r in rows])) < 1e-12


def test_selection(spark):
    c = spark.createDataFrame([(0, "a", 0.5, None, None, 1.0), (1, "b", 0.6, 0.5, 0.05, 1.0), (2, "c", 0.6, 0.5, 0.05, 1.0)],
                              "ord int, candidate string, full_pr double, cv_mean double, cv_std double, full_seconds double")
    s = {r["candidate"]: r["selection"] for r in metrics.selection_scores(c).collect()}
    assert abs(s["a"] - (0.275 + 0 + 0 - 0.025)) < 1e-12
    assert metrics.best_candidate(c, [], "ord").first()["ord"] == 1


def test_regression_constant_truth(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, 1.0, 2.0)], "ecozone int, y_log double, pred_log double")
    assert metrics.evaluate_regressor(df, ["ecozone"]).first()["r2_log_space"] == 0.0


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([(0.5,), (0.5,)], "y_prob double")
    assert [(r["bin"], r["n"]) for r in metrics.probability_histogram(df).collect()] == [(0, 2)]


def test_meta_correlation_drops_rows_with_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (4.0, 8.0)], "a double, b double")
    got = {(r["a"], r["b"]): r["corr"] for r in reports.meta_correlation(df, ["a", "b"]).collect()}
    assert abs(got["a", "b"] - 1.0) < 1e-12


def test_global_confusion(spark):
    df = spark.createDataFrame([(1, 2, 3, 4), (10, 0, 0, 0)], "tn long, fp long, fn long, tp long")
    assert [tuple(r) for r in reports.global_confusion(df).collect()] == [("Actual 0", 11, 2), ("Actual 1", 3, 4)]
    assert df.filter(F.lit(False)).count() == 0
