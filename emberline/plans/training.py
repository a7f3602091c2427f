"""Training of all zones: screening, split, preparation, models, evaluation, explanations, registry."""
from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.config import Settings
from emberline.operators import explain, metrics, models, prep, reports, resample, zoning
from emberline.operators.clean import drop_configured, engineer_features
from emberline.operators.split import stratified_holdout
from emberline.sources import registry as store
from emberline.sources.tables import load_samples, write_csv, write_zone_json
from emberline.storage import by_partition, materialize, new_path


def prepare_zones(zoned: DataFrame, settings: Settings) -> tuple[DataFrame, dict]:
    """Split rows of the given zones and the fitted preparation per zone; all zones in the same few jobs."""
    spark = zoned.sparkSession
    numeric, texts = prep.feature_columns(zoned, settings)
    split = stratified_holdout(zoned, ["ecozone"], settings.target_class, settings.test_size, settings.seed)
    path = new_path(spark, "split")
    # A folder per zone: training a zone reads that zone only.
    by_partition(split, "ecozone").write.partitionBy("ecozone").parquet(path)
    split = spark.read.schema(split.schema).parquet(path)
    fitted = prep.fit_prep(split.filter("NOT is_test"), ["ecozone"], numeric, texts, settings.max_null_share)
    return split, {z[0]: p for z, p in fitted.items()}


def featurise(rows: DataFrame, fitted: prep.Prep, target: str) -> DataFrame:
    for stage in fitted.stages():
        rows = stage.transform(rows)
    return rows.select("row_id", "features", F.col(target).cast("double").alias("label"))


def training_rows(rows: DataFrame, settings: Settings, balance: bool) -> tuple[DataFrame, str]:
    """Written ``row_id, features, label`` rows to fit on, and the rebalancing method; one that loses a class is not used."""
    method = "none"
    if balance:
        arrays = rows.select("row_id", vector_to_array("features").alias("features"), F.col("label").cast("int").alias("label"))
        balanced, method = resample.rebalance(arrays, settings.seed)
        if balanced.select("label").distinct().count() == 2:
            rows = balanced.select("row_id", array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
        else:
            method = f"none ({method} left one class)"
    return materialize(rows.select("row_id", "features", "label"), "fit"), method


def train_zone(split: DataFrame, zone: int, fitted: prep.Prep, out: str, settings: Settings, candidates: dict | None = None,
               reg_candidates: dict | None = None, search: bool = False, spaces: tuple | None = None, balance: bool = True,
               oof: bool = True, attributions: bool = True) -> dict:
    """Train, save and explain one zone; returns its registry row without the metrics of the test rows."""
    spark = split.sparkSession
    rows = split.filter(F.col("ecozone") == zone)
    train, test = rows.filter("NOT is_test"), rows.filter("is_test")
    spaces = spaces or (None, None)
    y = settings.target_class
    train_x, test_x = materialize(featurise(train, fitted, y), "train"), materialize(featurise(test, fitted, y), "test")

    # Choice and search use a validation part of the training rows; the chosen model is then fitted on all of them, and the
    # test rows are scored once, at the end.
    part = materialize(stratified_holdout(train_x, [], "label", settings.test_size, settings.seed + 1), "valid")
    fit_rows, _ = training_rows(part.filter("NOT is_test"), settings, balance)
    choice = models.select_classifier(fit_rows, part.filter("is_test"), settings, candidates, search, spaces[0])
    all_rows, method = training_rows(train_x, settings, balance)
    classifier = models.refit(choice.params, all_rows, settings)
    notes = [f"rebalancing: {method}"] * balance + choice.notes
    stages = fitted.stages()
    store.save_prep(spark, fitted, out, zone)
    save_pipeline(PipelineModel(stages + [classifier]), out, zone, "classifier")
    scored = models.scored_by(classifier, test_x).withColumn("ecozone", F.lit(zone))
    scored.write.mode("overwrite").parquet(f"{out}/holdout/ecozone={zone}")
    if oof:
        models.out_of_fold(choice.params, all_rows, settings).write.mode("overwrite").parquet(f"{out}/oof/ecozone={zone}")

    fires = featurise(train.filter(F.col(y) == 1).withColumn("_log", F.log1p(settings.target_reg)), fitted, "_log")
    test_fires = featurise(test.filter(F.col(y) == 1).withColumn("_log", F.log1p(settings.target_reg)), fitted, "_log")
    reg = models.select_regressor(materialize(fires, "fires"), materialize(test_fires, "tfires"), settings,
                                  reg_candidates, search, spaces[1], notes)
    if reg:
        save_pipeline(PipelineModel(stages + [reg[0]]), out, zone, "regressor")
        models.regression_scored(reg[0], test_fires).withColumn("ecozone", F.lit(zone)).write.mode("overwrite").parquet(
            f"{out}/holdout_reg/ecozone={zone}")
    explain_zone(classifier, reg[0] if reg else None, test_x, fitted.names, zone, out, attributions)
    text = lambda p: {k: str(v) for k, v in p.items()}
    return {"ecozone": zone, "cv_pr_auc_mean": choice.cv_mean, "cv_pr_auc_std": choice.cv_std, "has_clf": True,
            "has_reg": reg is not None, "clf_params": text(choice.params), "reg_params": text(reg[1]) if reg else None,
            "best_model": reg[1]["family"] if reg else None, "message": "; ".join(notes) or None}


def save_pipeline(model: PipelineModel, out: str, zone: int, kind: str) -> None:
    """The pipeline by itself, and its nodes in the table that all zones are scored by."""
    store.save_model(model, out, zone, kind)
    store.save_nodes(SparkSession.active(), model, out, zone, kind)


def explain_zone(classifier, regressor, test_x: DataFrame, names: list[str], zone: int, out: str, attributions: bool) -> None:
    """Importance tables, and attributions, drivers, narrative and risk of the test rows."""
    spark = test_x.sparkSession
    for kind, model in (("classifier", classifier), ("regressor", regressor)):
        if model is not None:
            write_csv(explain.model_importance(model, names, spark), f"{out}/importance/{kind}/ecozone={zone}")
    if not attributions:
        return
    wide, _ = explain.tree_attributions(classifier, test_x)
    wide = materialize(wide.withColumn("ecozone", F.lit(zone)), "phi")
    drivers = explain.top_drivers(explain.long_attributions(wide, names, ["ecozone"]), ["ecozone"])
    drivers.drop("ecozone").write.mode("overwrite").parquet(f"{out}/drivers/ecozone={zone}")
    explain.narrative(drivers).select(F.col("narrative").alias("value")).write.mode("overwrite").text(
        f"{out}/narrative/ecozone={zone}")
    explain.risk_of_array(wide).select("row_id", "risk").write.mode("overwrite").parquet(f"{out}/risk/ecozone={zone}")


def _read_zones(spark, path: str, zones: list[int], schema: str) -> DataFrame:
    return spark.read.schema(schema + ", ecozone int").parquet(path).filter(F.col("ecozone").isin(*zones))


def registry_rows(spark, trained: list[dict], failed: list[tuple], screened: DataFrame, out: str) -> DataFrame:
    """Registry rows of trained, safe, micro and failed zones; test metrics of all zones come from grouped jobs."""
    zones = [t["ecozone"] for t in trained]
    base = spark.createDataFrame(
        [(t["ecozone"], t["has_clf"], t["has_reg"], t["cv_pr_auc_mean"], t["cv_pr_auc_std"], t["clf_params"],
          t["reg_params"], t["best_model"], t["message"]) for t in trained],
        "ecozone int, has_clf boolean, has_reg boolean, cv_pr_auc_mean double, cv_pr_auc_std double, "
        "clf_params map<string,string>, reg_params map<string,string>, best_model string, message string")
    if zones:
        clf = metrics.evaluate_classifier(
            _read_zones(spark, f"{out}/holdout", zones, "row_id long, y_prob double, y_true int"), ["ecozone"])
        base = base.join(clf.withColumnRenamed("best_threshold", "thr"), "ecozone", "left")
    with_reg = [t["ecozone"] for t in trained if t["has_reg"]]
    if with_reg:
        reg = metrics.evaluate_regressor(
            _read_zones(spark, f"{out}/holdout_reg", with_reg, "row_id long, y_log double, pred_log double"), ["ecozone"])
        base = base.join(reg, "ecozone", "left")
    sizes = screened.select("ecozone", "samples")
    rows = base.join(sizes, "ecozone", "left").withColumn("status", F.lit("TRAINED"))
    idle = screened.filter(F.col("status").isin(zoning.STATUS["safe"], zoning.STATUS["micro"])).withColumn(
        "message", F.col("recommendation"))
    broken = spark.createDataFrame(failed, "ecozone int, message string").join(sizes, "ecozone", "left").withColumn(
        "status", F.lit("FAILED"))
    parts = []
    for part in (rows, idle, broken):
        have = set(part.columns)
        parts.append(part.select(*[
            (F.col(n) if n in have else F.lit(False) if n in ("has_clf", "has_reg") else F.lit(None)).cast(t).alias(n)
            for n, t in (f.split(" ", 1) for f in store.REGISTRY_SCHEMA.split(", "))]))
    out_rows = reduce(DataFrame.unionByName, parts)
    return out_rows.withColumn("thr", F.coalesce("thr", F.lit(0.5)))


def train_zones(zoned: DataFrame, out: str, settings: Settings = Settings(), fresh: bool = True,
                zones: list[int] | None = None, **options) -> DataFrame:
    """Train every eligible zone (or the given ones) and commit the registry.

    ``fresh`` starts over and deletes the zone folders of the run before; otherwise zones that have an entry are left alone unless named in ``zones``.
    A zone whose training fails gets a FAILED entry and does not stop the others.
    """
    spark = zoned.sparkSession
    zoned = zoning.without_noise(zoned)
    screened = materialize(zoning.screen_zones(zoning.zone_profile(zoned, settings), settings), "screened")
    if zones is not None:
        screened = screened.filter(F.col("ecozone").isin(*zones))
    elif not fresh:
        screened = zoning.remaining_zones(screened, store.completed_zones(spark, out))
    todo = sorted(r["ecozone"] for r in screened.filter(F.col("status") == zoning.STATUS["train"]).collect())
    trained, failed = [], []
    if fresh and zones is None:
        store.clear_run(spark, out)
    if todo:
        split, fitted = prepare_zones(zoned.filter(F.col("ecozone").isin(*todo)), settings)
        jobs = [lambda z=z: train_zone(split, z, fitted[z], out, settings, **options) for z in todo]
        for z, got in zip(todo, models.run_parallel(jobs, settings.zone_workers, [f"zone-{z}" for z in todo])):
            failed.append((z, str(got)[:500])) if isinstance(got, Exception) else trained.append(got)
    entries = materialize(registry_rows(spark, trained, failed, screened, out), "entries")
    store.save_registry(entries, out, fresh=fresh and zones is None)
    write_zone_json(zoning.screen_zones(zoning.zone_profile(zoned, settings), settings).join(
        entries.select("ecozone"), "ecozone", "left_semi"), f"{out}/zone_status")
    for kind, table in reports.zone_metadata(entries).items():
        write_zone_json(table, f"{out}/zone_metadata/{kind}")
    return store.load_registry(spark, out)


def remaining_after(zoned: DataFrame, out: str, settings: Settings = Settings()) -> list[int]:
    """Zones a resumed run would still train."""
    profile = zoning.screen_zones(zoning.zone_profile(zoned, settings), settings).filter(
        F.col("status") == zoning.STATUS["train"])
    left = zoning.remaining_zones(profile, store.completed_zones(zoned.sparkSession, out))
    return sorted(r["ecozone"] for r in left.select("ecozone").collect())


def train_all(samples: DataFrame, out: str, settings: Settings = Settings(), fresh: bool = True, k: int | None = None,
              **options) -> DataFrame:
    """Features, zones, router, models, registry and global tables from a sample table."""
    spark = samples.sparkSession
    clean = materialize(engineer_features(drop_configured(samples, settings), settings), "clean")
    zoned = materialize(zoning.extract_zones(clean, settings, k), "zoned")
    table = train_zones(zoned, out, settings, fresh, **options)
    store.save_router(zoned, out)
    write_reports(zoned, table, out)
    return table


def train_one(samples: DataFrame, zone: int, out: str, settings: Settings = Settings(), k: int | None = None,
              **options) -> DataFrame:
    """Retrain a single zone and replace its registry entry."""
    clean = materialize(engineer_features(drop_configured(samples, settings), settings), "clean")
    zoned = materialize(zoning.extract_zones(clean, settings, k), "zoned")
    return train_zones(zoned, out, settings, fresh=False, zones=[zone], **options)


def resume(samples: DataFrame, out: str, settings: Settings = Settings(), k: int | None = None, **options) -> DataFrame:
    """Train the zones that have no entry yet."""
    return train_all(samples, out, settings, fresh=False, k=k, **options)


def write_reports(zoned: DataFrame, registry: DataFrame, out: str) -> None:
    spark = zoned.sparkSession
    zones = [r["ecozone"] for r in registry.filter("has_clf").select("ecozone").collect()]
    holdout = (_read_zones(spark, f"{out}/holdout", zones, "row_id long, y_prob double, y_true int") if zones
               else spark.createDataFrame([], "row_id long, y_prob double, y_true int, ecozone int"))
    tables = reports.global_reports(registry, zoning.zone_centroids(zoned), holdout, zoned)
    for name, table in tables.items():
        write_csv(table, f"{out}/global/{name}")


def train_file(spark, path: str, out: str, settings: Settings = Settings(), **options) -> DataFrame:
    return train_all(load_samples(spark, path, settings), out, settings, **options)
