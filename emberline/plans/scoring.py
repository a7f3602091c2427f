"""Scoring of new rows with the stored router, registry and zone models."""
from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.config import Settings
from emberline.functions.columns import fire_label, fire_severity
from emberline.operators.clean import engineer_features
from emberline.operators.joins import is_small
from emberline.operators.trees import flat_trees
from emberline.operators.zoning import assign_zones
from emberline.sources import registry as store
from emberline.sources.tables import load_samples, write_predictions
from emberline.storage import materialize

# Rows of one zone that are scored together.
CHUNK_ROWS = 50_000


def with_outputs(df: DataFrame) -> DataFrame:
    """Severity and label from ``fire_prob``, ``pred_intensity`` and ``thr``."""
    return df.withColumns({
        "soft_severity": fire_severity(F.col("fire_prob"), F.col("pred_intensity")),
        "fire_label": fire_label(F.col("fire_prob"), F.col("thr"))}).drop("thr")


def predict_zone(rows: DataFrame, out: str, zone: int, entry) -> DataFrame:
    """Rows of one zone with ``fire_prob``, ``pred_intensity``, ``soft_severity`` and ``fire_label``.

    ``entry`` has ``thr``, ``has_clf`` and ``has_reg``; the saved pipelines pick the feature columns themselves, so
    the targets play no part. A missing model gives 0.
    """
    keep = rows.columns
    if entry["has_clf"]:
        rows = store.load_model(out, zone, "classifier").transform(rows).select(
            *keep, F.get(vector_to_array("probability"), F.lit(1)).alias("fire_prob"))
    else:
        rows = rows.withColumn("fire_prob", F.lit(0.0))
    if entry["has_reg"]:
        rows = store.load_model(out, zone, "regressor").transform(rows).select(
            *keep, "fire_prob", F.expm1("prediction").alias("pred_intensity"))
    else:
        rows = rows.withColumn("pred_intensity", F.lit(0.0))
    return with_outputs(rows.withColumn("thr", F.lit(float(entry["thr"]))))


def _apply_models(rows: pa.Table, model: pa.Table, kinds: tuple[str, ...] = ("classifier", "regressor")) -> list[np.ndarray]:
    """Outputs of a zone's models for some of its rows, 0 where it has none; only features that the trees ask for are built."""
    m, out = model.to_pandas(), []
    for kind in kinds:
        nodes = m[m["kind"] == kind]
        if not len(nodes):
            out.append(np.zeros(rows.num_rows))
            continue
        trees = flat_trees(nodes, 0)
        asked = np.unique(trees.feature[trees.left >= 0])
        prep = m[m["kind"] == "prep"].set_index("place").loc[asked]
        x = np.zeros((rows.num_rows, len(asked)))
        for i, p in enumerate(prep.itertuples()):
            c = rows.column(p.column)
            if p.category is None:
                v = c.cast(pa.float64()).fill_null(p.median).to_numpy()
                x[:, i] = (v - p.mean) / p.std
            else:
                x[:, i] = pc.equal(c.cast(pa.string()).fill_null(p.mode), p.category).to_numpy()
        places = np.searchsorted(asked, trees.feature)
        total = replace(trees, feature=np.where(trees.left >= 0, places, 0)).outputs(x)
        out.append(1 / (1 + np.exp(-2 * total)) if nodes["logistic"].iloc[0] else total)
    return out


def score_zones(routed: DataFrame, out: str, settings: Settings = Settings(), chunk: int = CHUNK_ROWS) -> DataFrame:
    """Input columns plus predictions; zones without a model get probability and intensity 0, threshold 0.5.

    One stage for all zones: rows meet the nodes and the preparation of their zone by key, in shares of about ``chunk`` rows, so
    neither the plan nor a task grows with the number of zones or with one zone's rows.
    """
    spark, cols = routed.sparkSession, routed.columns
    registry = materialize(store.load_registry(spark, out).select("ecozone", "thr", "has_clf", "has_reg"), "registry")
    if registry.filter("has_clf OR has_reg").isEmpty():
        blank = store.model_lookup(routed, registry).withColumns({"fire_prob": F.lit(0.0), "pred_intensity": F.lit(0.0)})
        return with_outputs(blank.select(*cols, "fire_prob", "pred_intensity", "thr"))
    flags = registry.select("ecozone", F.explode(F.map_filter(F.create_map(
        F.lit("classifier"), "has_clf", F.lit("regressor"), "has_reg"), lambda _, v: v)).alias("kind", "_on")).drop("_on")
    nodes = store.load_nodes(spark, out).drop("cover").withColumn("cover", F.lit(1.0)).join(flags, ["ecozone", "kind"], "left_semi")
    prep = store.load_prep(spark, out).withColumn("kind", F.lit("prep")).join(flags.select("ecozone").distinct(), "ecozone", "left_semi")
    model = nodes.unionByName(prep, allowMissingColumns=True)
    rows = materialize(store.model_lookup(routed, registry).select(*cols, "thr"), "routed")
    shares = rows.groupBy("ecozone").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("_shares"))
    shares = F.broadcast(shares) if is_small(shares) else shares
    key = F.xxhash64("row_id") if "row_id" in cols else F.xxhash64(*[F.col(f"`{c}`") for c in cols])
    rows = rows.join(shares, rows.ecozone.eqNullSafe(shares.ecozone)).drop(shares.ecozone).withColumn("_share", F.pmod(key, F.col("_shares"))).drop("_shares")
    model = model.join(shares, "ecozone").withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1))).drop("_shares")
    found = rows.drop("_share").withColumns({"fire_prob": F.lit(0.0), "pred_intensity": F.lit(0.0)})

    def run(rows: pa.Table, model: pa.Table) -> pa.Table:
        prob, log = _apply_models(rows, model)
        return rows.drop_columns(["_share"]).append_column("fire_prob", pa.array(prob)).append_column("pred_intensity", pa.array(np.expm1(log)))
    scored = rows.groupBy("ecozone", "_share").cogroup(model.groupBy("ecozone", "_share")).applyInArrow(run, found.schema)
    return with_outputs(scored.select(*cols, "fire_prob", "pred_intensity", "thr"))


def predict(samples: DataFrame, out: str, settings: Settings = Settings()) -> DataFrame:
    """Features, routing and scoring of a sample table."""
    clean = engineer_features(samples, settings)
    return score_zones(assign_zones(clean, store.load_router(samples.sparkSession, out)), out, settings)


def predict_file(spark: SparkSession, path: str, out: str, target: str, settings: Settings = Settings()) -> DataFrame:
    """Score a CSV file and write the predictions as CSV."""
    scored = predict(load_samples(spark, path, settings), out, settings)
    write_predictions(scored, target)
    return scored
