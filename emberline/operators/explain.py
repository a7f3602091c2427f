"""Feature importances, exact tree attributions, drivers and risk per row."""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from emberline.operators.trees import read_trees


def importance_table(spark, importances: list[float], names: list[str]) -> DataFrame:
    """``(feature, importance)``; surplus names are cut, missing ones are called ``f_i``."""
    names = list(names)[:len(importances)] + [f"f_{i}" for i in range(len(names), len(importances))]
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, importances)],
                                 "feature string, importance double").orderBy(F.desc("importance"), "feature")


def model_importance(model, names: list[str], spark) -> DataFrame:
    return importance_table(spark, list(model.featureImportances.toArray()), names)


def top_features(importance: DataFrame, n: int = 40) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def leaf_paths(model) -> tuple[list, float]:
    """Every leaf as ``(value, [(feature, low, high, cover share)])`` and the expected output.

    Steps on the same feature are merged to one interval (low, high]; the cover share of a feature is the product of
    the training shares that follow the path at its splits.
    """
    t, paths = read_trees(model), []
    stack = [(int(r), {}) for r in t.roots]
    while stack:
        n, steps = stack.pop()
        if t.left[n] < 0:
            paths.append((t.value[n], [(f, *steps[f]) for f in sorted(steps)]))
            continue
        f, cut = int(t.feature[n]), t.threshold[n]
        low, high, share = steps.get(f, (-math.inf, math.inf, 1.0))
        for child, inside in ((t.left[n], (low, min(high, cut))), (t.right[n], (max(low, cut), high))):
            stack.append((int(child), steps | {f: (*inside, share * t.cover[child] / t.cover[n])}))
    return paths, t.base


def tree_attributions(model, df: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, float]:
    """Path-dependent Shapley values of all rows: ``(row_id, keep..., phi array)`` and the expected output.

    The attributions of a row plus the expected output equal the model output (margin of boosted models before the
    logistic step, probability of forests). The model's node arrays are broadcast once.
    """
    trees = read_trees(model)
    shared = df.sparkSession.sparkContext.broadcast(trees)
    keep = ["row_id", *(keep or [])]
    rows = df.select(*keep, vector_to_array("features").alias("_x"))

    def run(batches):
        for b in batches:
            x = b.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, shared.value.width)
            phi = shared.value.shapley(x)
            ends = pa.array(np.arange(b.num_rows + 1) * shared.value.width, pa.int32())
            yield pa.record_batch([*[b.column(c) for c in keep], pa.ListArray.from_arrays(ends, pa.array(phi.reshape(-1)))], [*keep, "phi"])
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", phi array<double>"
    return rows.mapInArrow(run, schema), trees.base


def long_attributions(wide: DataFrame, names: list[str], keep: list[str] | None = None) -> DataFrame:
    """``(row_id, keep..., feature, phi)``."""
    cols = ["row_id", *(keep or [])]
    labels = F.array(*[F.lit(n) for n in names])
    return wide.select(*cols, F.posexplode("phi").alias("_i", "phi")).select(
        *cols, F.get(labels, F.col("_i")).alias("feature"), "phi")


def approximate_attributions(rows: DataFrame, importance: DataFrame, features: list[str]) -> DataFrame:
    """Fallback: the normalised importance of each feature, the same for every row."""
    known = {r["feature"]: abs(r["importance"]) for r in importance.collect()}
    used = [f for f in features if f in known]
    total = sum(known[f] for f in used) + 1e-9
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(known[f] / total).alias("phi")) for f in used])
    return rows.select("row_id", F.explode(pairs).alias("_p")).select("row_id", "_p.*")


def top_drivers(attributions: DataFrame, by: list[str], n: int = 10) -> DataFrame:
    """Features with the largest mean absolute attribution."""
    g = attributions.groupBy(*by, "feature").agg(F.avg(F.abs("phi")).alias("strength"))
    if not by:
        return g.orderBy(F.desc("strength"), "feature").limit(n).withColumn(
            "place", F.row_number().over(Window.orderBy(F.desc("strength"), "feature")))
    w = Window.partitionBy(*by).orderBy(F.desc("strength"), "feature")
    return g.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def row_risk(attributions: DataFrame, by: list[str] | None = None) -> DataFrame:
    return attributions.groupBy(*(by or []), "row_id").agg(F.sum(F.abs("phi")).alias("risk"))


def risk_of_array(wide: DataFrame) -> DataFrame:
    """Row risk from the array form, without a shuffle."""
    return wide.withColumn("risk", F.aggregate("phi", F.lit(0.0), lambda a, x: a + F.abs(x)))


def narrative(drivers: DataFrame, zone: str = "ecozone") -> DataFrame:
    """One text per zone: a headline and one line per driver, strongest first."""
    lines = F.sort_array(F.collect_list(F.struct("place", "feature")))
    return drivers.groupBy(zone).agg(lines.alias("_l")).select(zone, F.concat_ws(
        "\n", F.concat(F.lit("Top wildfire drivers in zone "), F.col(zone).cast("string"), F.lit(":")),
        F.transform("_l", lambda x: F.concat(F.lit("* "), x["feature"], F.lit(": major driver of risk")))).alias("narrative"))
