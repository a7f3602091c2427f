"""Model registry, router points and fitted pipelines in one output folder.

``<out>/registry``  one row per zone, partitioned by zone, so that one zone can be replaced on its own
``<out>/models``    fitted pipelines per zone
``<out>/nodes``     the tree nodes of all models, by zone and kind
``<out>/prep``      the preparation of all models: one row per feature, by zone
``<out>/router``    labelled points for routing new rows
"""
from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from emberline.operators.joins import is_small
from emberline.operators.prep import Prep
from emberline.operators.trees import node_table

METRIC_FIELDS = ("pr_auc", "auc", "f2", "f1", "accuracy", "precision", "recall")
COUNT_FIELDS = ("tn", "fp", "fn", "tp")
REG_FIELDS = ("r2_log_space", "mse_raw", "rmse_raw", "mae_raw", "asymmetric_underestimation_cost", "catastrophic_rate")

REGISTRY_SCHEMA = ", ".join(
    ["ecozone int", "status string", "samples long", "thr double", "has_clf boolean", "has_reg boolean"]
    + [f"{c} double" for c in METRIC_FIELDS] + [f"{c} long" for c in COUNT_FIELDS]
    + ["cv_pr_auc_mean double", "cv_pr_auc_std double", "clf_params map<string,string>", "reg_params map<string,string>"]
    + [f"{c} double" for c in REG_FIELDS]
    + ["catastrophic_miss_count long", "best_model string", "message string"])


def save_registry(entries: DataFrame, out: str, fresh: bool = False) -> None:
    """Upsert: zones in ``entries`` are replaced, others stay; ``fresh`` starts over."""
    w = entries.write.mode("overwrite").partitionBy("ecozone")
    w.option("partitionOverwriteMode", "static" if fresh else "dynamic").parquet(f"{out}/registry")


# Folders that a training run writes per zone, besides the registry.
RUN_FOLDERS = ("models", "nodes", "prep", "holdout", "holdout_reg", "oof", "importance", "drivers", "narrative", "risk", "zone_status", "zone_metadata")


def clear_run(spark: SparkSession, out: str) -> None:
    """Delete the zone folders of an earlier run below ``out``: its zone numbers mean nothing to the next one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in RUN_FOLDERS:
        path = jvm.org.apache.hadoop.fs.Path(f"{out}/{name}")
        path.getFileSystem(conf).delete(path, True)


def load_registry(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(REGISTRY_SCHEMA).parquet(f"{out}/registry")


def load_registry_or_empty(spark: SparkSession, out: str) -> DataFrame:
    """The registry; an empty table before the first run."""
    try:
        return load_registry(spark, out)
    except AnalysisException:
        return spark.createDataFrame([], REGISTRY_SCHEMA)


def completed_zones(spark: SparkSession, out: str) -> DataFrame:
    """Zones with an entry that did not fail."""
    return load_registry_or_empty(spark, out).filter("status <> 'FAILED'").select("ecozone").distinct()


def save_router(df: DataFrame, out: str) -> None:
    df.select("row_id", "latitude", "longitude", "ecozone").write.mode("overwrite").parquet(f"{out}/router")


def load_router(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("row_id long, latitude double, longitude double, ecozone int").parquet(f"{out}/router")


def model_path(out: str, zone: int, kind: str) -> str:
    return f"{out}/models/ecozone={zone}/{kind}"


def save_model(model: PipelineModel, out: str, zone: int, kind: str) -> None:
    model.write().overwrite().save(model_path(out, zone, kind))


NODE_SCHEMA = ("tree int, node int, feature int, threshold double, categories int, left int, right int, cover double, value double, logistic boolean, "
               "kind string, ecozone int")
PREP_SCHEMA = "place long, column string, median double, mean double, std double, mode string, category string, ecozone int"


def save_nodes(spark: SparkSession, model: PipelineModel, out: str, zone: int, kind: str) -> None:
    """The tree nodes of a saved pipeline's last stage, next to those of the other zones."""
    last = len(model.stages) - 1
    stage = f"{model_path(out, zone, kind)}/stages/{last:0{len(str(len(model.stages)))}d}_{model.stages[last].uid}"
    node_table(spark, stage).coalesce(1).write.mode("overwrite").parquet(f"{out}/nodes/kind={kind}/ecozone={zone}")


def save_prep(spark: SparkSession, fitted: Prep, out: str, zone: int) -> None:
    rows = [(c, *v, None, None) for c, v in fitted.numeric.items()]
    rows += [(c, None, None, None, fitted.modes[c], v) for c, vals in fitted.categories.items() for v in vals]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], PREP_SCHEMA.rsplit(",", 1)[0])
    table.write.mode("overwrite").parquet(f"{out}/prep/ecozone={zone}")


def load_nodes(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(NODE_SCHEMA).parquet(f"{out}/nodes")


def load_prep(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(PREP_SCHEMA).parquet(f"{out}/prep")


def load_model(out: str, zone: int, kind: str) -> PipelineModel:
    return PipelineModel.load(model_path(out, zone, kind))


def model_lookup(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Threshold and model flags next to each row; a zone without entry gets 0.5 and no models."""
    small = registry.select("ecozone", "thr", "has_clf", "has_reg")
    small = F.broadcast(small) if is_small(small) else small
    return rows.join(small, "ecozone", "left").withColumns({
        "thr": F.coalesce("thr", F.lit(0.5)), "has_clf": F.coalesce("has_clf", F.lit(False)),
        "has_reg": F.coalesce("has_reg", F.lit(False))})
