"""Plans of the row-sized queries: no cross products, no single-task windows, pruned scans."""
import pytest

from emberline.plans import catalogue

SF = "/root/testdata/sf0.001"
LAZY = ["fire_zone_profile", "daily_composite", "causal_ndvi", "band_stack", "region_sample", "avg_precision", "threshold_sweep",
        "stratified_split", "zone_profile", "quantiles", "daily_fire", "period_samples", "regression_metrics", "top_drivers"]


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_products(spark, name):
    plan = physical(catalogue.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan
    if name in ("region_sample", "period_samples", "daily_composite", "avg_precision", "stratified_split", "fire_zone_profile"):
        assert "BroadcastNestedLoopJoin" not in plan


def test_one_scan_for_the_daily_composite(spark):
    plan = physical(catalogue.QUERIES["daily_composite"](spark, SF))
    assert plan.count("FileScan") == 1 and "props" not in plan.split("ReadSchema")[1]
    assert "partial_" in plan


def test_python_only_where_needed(spark):
    for name in LAZY:
        assert "Python" not in physical(catalogue.QUERIES[name](spark, SF)), name
