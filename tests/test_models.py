import itertools
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from emberline import Settings
from emberline.operators import explain, models
from emberline.plans import scoring, training
from emberline.sources import registry as store
from emberline.sources.tables import write_csv

FAST = Settings(eps_km=12, min_samples=8, min_macro_rows=50, min_cluster_rows=30, min_zone_rows=60, boost_rounds=3, boost_depth=3,
                cv_folds=2, cv_repeats=1, warmup_gate=0.0, trials=2)


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(0)
    rows = []
    for i in range(600):
        x = [rnd.random() for _ in range(4)]
        rows.append((i, x, float(x[0] + x[1] * x[2] + 0.2 * rnd.random() > 0.9)))
    return spark.createDataFrame(rows, "row_id long, x array<double>, label double").withColumn(
        "features", array_to_vector("x")).drop("x").cache()


@pytest.mark.parametrize("params", [{"family": "leafwise", "rounds": 4, "depth": 3, "rate": 0.2}, {"family": "forest", "rounds": 5, "depth": 4}])
def test_attributions_equal_enumeration(table, params):
    model = models.estimator(params, True, 1).fit(table)
    paths, base = explain.leaf_paths(model)
    wide, base2 = explain.tree_attributions(model, table)
    got = {r["row_id"]: np.array(r["phi"]) for r in wide.collect()}
    assert base == base2 and len(got) == 600

    def value(x, known):
        return sum(v * math.prod((lo < x[f] <= hi) if f in known else c for f, lo, hi, c in steps) for v, steps in paths)
    for r in table.limit(15).collect():
        x, d = r["features"].toArray(), 4
        phi = np.zeros(d)
        for j in range(d):
            for s in itertools.chain.from_iterable(itertools.combinations([i for i in range(d) if i != j], n) for n in range(d)):
                w = math.factorial(len(s)) * math.factorial(d - len(s) - 1) / math.factorial(d)
                phi[j] += w * (value(x, {*s, j}) - value(x, set(s)))
        assert np.allclose(phi, got[r["row_id"]], atol=1e-10)
    # Attributions plus the expected output give the model output.
    out = {r["row_id"]: r for r in model.transform(table).collect()}
    for i, phi in got.items():
        p = out[i]["probability"][1]
        want = p if params["family"] == "forest" else 0.5 * math.log(p / (1 - p))
        assert abs(base + phi.sum() - want) < 1e-8


def test_importance_names(spark):
    assert [tuple(r) for r in explain.importance_table(spark, [0.1, 0.9, 0.3], ["a", "b"]).collect()] == [
        ("b", 0.9), ("f_2", 0.3), ("a", 0.1)]
    assert explain.importance_table(spark, [0.1], ["a", "b"]).count() == 1


def test_oof_covers_every_row_once(table):
    out = models.out_of_fold({"family": "forest", "rounds": 3, "depth": 3}, table, FAST).toPandas()
    assert len(out) == 600 and out.row_id.is_unique and set(out.fold) == {0, 1}


def test_gate_and_fallback(table):
    choice = models.select_classifier(table, table, replace(FAST, warmup_gate=1.1))
    assert choice.params["rate"] == 0.05 and choice.cv_mean is None and choice.pr_auc > 0.5
    assert "below 1.1" in choice.notes[0] and choice.notes[-1] == "fallback classifier"


def test_default_candidate_passes_the_gate_on_rebalanced_rows(spark):
    rows = spark.range(800).select(F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("double").alias("label"))
    x = F.array(F.col("label") + F.rand(1) * 0.5, F.rand(2))
    rows = rows.withColumn("features", array_to_vector(x)).cache()
    settings = replace(FAST, warmup_gate=0.3, warmup_rows=100)
    fit, method = training.training_rows(rows, settings, True)
    assert method == "SMOTEENN" and fit.filter("row_id < 0").count() > settings.warmup_rows
    choice = models.select_classifier(fit, rows, settings)
    assert choice.params == models.base_candidates(settings)["boosted"]
    assert choice.cv_mean > 0.9 and choice.notes == []


def test_reasons_are_kept(table):
    broken = {"bad": {"family": "leafwise", "rounds": -1}}
    choice = models.select_classifier(table, table, FAST, broken)
    assert choice.notes[0].startswith("bad: ") and choice.notes[1] == "fallback classifier"
    assert models.cross_validate(broken["bad"], table, FAST)[2].startswith("cross-validation: ")


def test_search_stops_and_improves(table):
    space = {"forest": {"rounds": (2, 3), "depth": (1, 3)}}
    got = models.search_classifier(table, table, replace(FAST, trials=3), space)
    scores = [models.precision_of(models.estimator(models.draw_params(space, i, 42), True, 42).fit(table), table) for i in range(3)]
    assert got.tuned and abs(got.pr_auc - max(scores)) < 1e-9
    assert models.search_classifier(table, table, FAST, {"bad": {"rounds": (-5, -5)}}) is None


@pytest.mark.parametrize("workers", [1, 4])
def test_trials_side_by_side_end_like_one_after_the_other(spark, workers):
    import time
    rnd = random.Random(5)
    for case in range(4):
        scores = [rnd.randint(0, 3 + 4 * case) if rnd.random() < 0.8 else ValueError() for _ in range(24)]
        best, stale, place = None, 0, -1
        while stale < 6 and place < 23:
            place += 1
            gain = isinstance(scores[place], int) and (best is None or scores[place] > best[1])
            best, stale = ((place, scores[place]), 0) if gain else (best, stale + 1)
        started = []

        def trial(i):
            started.append(i)
            time.sleep(0.3 if i == 0 and workers > 1 else 0.01 * (i % 3))
            return scores[i] if isinstance(scores[i], Exception) else (i, scores[i])
        assert models._search(trial, lambda a, b: a[1] > b[1], replace(FAST, trials=24), workers) == best
        assert set(started) >= set(range(place + 1)) and (workers > 1 or len(started) == place + 1)


def test_a_trial_out_of_reach_is_cancelled(spark):
    import time
    ended = []

    def trial(i):
        time.sleep(1 if i == 0 else 0)
        try:
            if i == 6:  # would take hours
                spark.range(0, 10 ** 14, 1, 2).selectExpr("sum(hash(id))").collect()
        except Exception as e:
            ended.append(i)
            return e
        return -i
    # The first trial stays the best, so the sixth is the last one.
    assert models._search(trial, lambda a, b: a > b, replace(FAST, trials=20), 8) == 0 and ended == [6]


def test_search_with_several_workers_gives_the_same_model(table):
    space, settings = {"forest": {"rounds": (2, 3), "depth": (1, 3)}}, replace(FAST, trials=4)
    one, four = (models.search_classifier(table, table, replace(settings, trial_workers=n), space) for n in (1, 4))
    assert one.params == four.params and abs(one.pr_auc - four.pr_auc) < 1e-9 and four.model is not None


def test_the_registered_search_runs_all_trials_over_all_families(spark, table, monkeypatch):
    from emberline.plans import catalogue

    class Fit:
        def __init__(self, params):
            self.params = params

        def fit(self, df):
            return self.params
    want = [models.draw_params(models.CLASSIFIER_SPACE, i, 42) for i in range(Settings().trials)]
    seen = []
    monkeypatch.setattr(catalogue, "_feature_rows", lambda spark, sf: (table, None))
    monkeypatch.setattr(models, "estimator", lambda params, classifier, seed: seen.append(params) or Fit(params))
    # Every trial is better than the one before, so none is left out.
    monkeypatch.setattr(models, "precision_of", lambda model, df: want.index(model) / 100 if model in want else 0.0)
    monkeypatch.setattr(models, "scored_by", lambda model, df: (model, df))
    model, rows = catalogue.QUERIES["classifier_search"](spark, "")
    assert sorted(map(str, seen)) == sorted(map(str, want)) and {p["family"] for p in seen} == set(models.CLASSIFIER_SPACE)
    assert model == want[-1] and rows.count() == 120


def test_too_few_fires(table):
    assert models.select_regressor(table.limit(9), table, FAST) is None
    assert models.select_regressor(table, table.limit(4), FAST) is None


@pytest.fixture(scope="module")
def samples(spark):
    """Two separate areas that burn and one that never does."""
    rnd = random.Random(8)
    rows = []
    for i in range(900):
        z = i % 3
        dry = rnd.random()
        fire = int(z < 2 and dry + 0.2 * rnd.random() > 0.6)
        rows.append((i, 10.0 + 5 * z + rnd.gauss(0, 0.05), 70.0 + rnd.gauss(0, 0.05), str(int(dry * 9000)) if i % 9 else f"[{int(dry * 9000)}]",
                     300 + 10 * dry if i % 10 else 0.0, fire, rnd.randint(1, 900) if fire else 0, rnd.choice(["a", "b"])))
    return spark.createDataFrame(rows, "row_id long, latitude double, longitude double, NDVI string, temperature_2m double, "
                                       "fire_detected int, fire_intensity int, cover string")


@pytest.fixture(scope="module")
def trained(spark, samples, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("run"))
    registry = training.train_all(samples, out, FAST, k=3)
    return out, registry


def test_training_writes_everything(spark, trained):
    out, registry = trained
    r = {x["ecozone"]: x for x in registry.collect()}
    assert len(r) == 3 and sorted(x["status"] for x in r.values()) == ["SAFE_ZONE", "TRAINED", "TRAINED"]
    good = [x for x in r.values() if x["status"] == "TRAINED"]
    assert all(x["pr_auc"] > 0.7 and x["has_reg"] and x["rmse_raw"] > 0 and 0 < x["thr"] < 1 for x in good)
    assert all(x["tn"] + x["fp"] + x["fn"] + x["tp"] == 60 for x in good)
    assert all(x["message"].startswith("rebalancing: ") for x in good)
    safe = next(x for x in r.values() if x["status"] == "SAFE_ZONE")
    assert (safe["pr_auc"], safe["tn"], safe["thr"], safe["has_clf"]) == (1.0, 300, 0.5, False)
    summary = spark.read.option("header", True).csv(f"{out}/global/performance_summary")
    assert summary.count() == 3 and summary.filter("latitude IS NULL").count() == 0
    assert spark.read.text(f"{out}/narrative").filter(F.col("value").startswith("* ")).count() >= 2
    assert spark.read.parquet(f"{out}/oof").select("prob").filter("prob between 0 and 1").count() > 0
    assert spark.read.parquet(f"{out}/risk").count() == 120
    assert spark.read.json(f"{out}/zone_status").count() == 3
    meta = {k: spark.read.json(f"{out}/zone_metadata/{k}").collect() for k in ("classifier", "regressor")}
    assert {x["ecozone"]: x["pr_auc"] for x in meta["classifier"]} == {x["ecozone"]: x["pr_auc"] for x in good}
    assert {x["ecozone"]: x["rmse_raw"] for x in meta["regressor"]} == {x["ecozone"]: x["rmse_raw"] for x in good}
    report = spark.read.option("header", True).csv(f"{out}/global/zone_report")
    assert report.filter("section = 'regressor' AND field = 'rmse'").count() == 2 and report.filter("field = 'tn'").count() == 3


def test_prediction(spark, trained, samples, tmp_path):
    out, _ = trained
    write_csv(samples, str(tmp_path / "in"))
    scored = scoring.predict_file(spark, str(tmp_path / "in"), out, str(tmp_path / "out"), FAST).toPandas()
    assert len(scored) == 900 and scored.row_id.is_unique
    assert np.allclose(scored.soft_severity, scored.fire_prob * scored.pred_intensity)
    north = scored[scored.latitude > 17.5]
    assert (north.fire_prob == 0).all() and (north.fire_label == 0).all()
    south = scored[scored.latitude < 17.5]
    assert south[south.fire_detected == 1].fire_prob.mean() > south[south.fire_detected == 0].fire_prob.mean() + 0.1
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 900


def test_keyed_scoring_equals_the_saved_pipelines(spark, trained, samples):
    out, registry = trained
    zones = spark.read.parquet(f"{out}/router").select("row_id", "ecozone")
    rows = training.engineer_features(zones.join(samples, "row_id"), FAST).withColumn("day", F.to_date(F.lit("2020-01-02"))).withColumn("count", F.lit(None).cast("int"))
    rows = rows.unionByName(rows.limit(5).withColumns({"ecozone": F.lit(None).cast("int"), "row_id": F.col("row_id") + 10_000})).cache()
    plans = {}
    for chunk in (40, 50_000):
        scored = scoring.score_zones(rows, out, FAST, chunk)
        plans[chunk] = scored._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroups")
        assert scored.columns == [*rows.columns, "fire_prob", "pred_intensity", "soft_severity", "fire_label"] and dict(scored.dtypes)["count"] == "int"
        got = {r["row_id"]: r for r in scored.collect()}
        assert len(got) == 905 and all(got[i]["fire_prob"] == 0 for i in got if i >= 10_000)
        for entry in registry.collect():
            for want in scoring.predict_zone(rows.filter(F.col("ecozone") == entry["ecozone"]), out, entry["ecozone"], entry).collect():
                r = got[want["row_id"]]
                assert abs(r["fire_prob"] - want["fire_prob"]) < 1e-12 and abs(r["pred_intensity"] - want["pred_intensity"]) < 1e-6 * (1 + want["pred_intensity"])
                assert r["fire_label"] == want["fire_label"] and r["day"] == want["day"]
    assert set(plans.values()) == {1}


def test_jobs_of_a_pool_run_under_its_name(spark):
    import time

    def names():
        time.sleep(0.3)
        return spark.sparkContext.getLocalProperty("spark.scheduler.pool")
    assert models.run_parallel([names, lambda: 1 / 0, names], 2, ["a", "b", "c"])[::2] == ["a", "c"]
    assert models.run_parallel([names], 1) == [None]


def test_partitioned_writes_make_few_files(spark, tmp_path):
    from emberline.sources.tables import write_yearly
    df = spark.range(4000).select(F.col("id").alias("row_id"), (F.col("id") % 5 + 2018).cast("int").alias("year")).repartition(40)
    write_yearly(df, str(tmp_path / "y"), "parquet")
    files = list((tmp_path / "y").rglob("part-*.parquet"))
    assert len(files) <= 10 and spark.read.parquet(str(tmp_path / "y")).count() == 4000


def test_resume_and_retrain(spark, trained, samples):
    out, registry = trained
    zone = next(r["ecozone"] for r in registry.filter("has_clf").collect())
    before = {r["ecozone"]: r for r in store.load_registry(spark, out).collect()}
    zoned = spark.read.parquet(f"{out}/router").select("row_id", "ecozone").join(samples, "row_id")
    assert training.remaining_after(zoned, out, FAST) == []
    options = dict(balance=False, oof=False, attributions=False)
    training.train_zones(training.engineer_features(zoned, FAST), out, FAST, fresh=False, zones=[zone], **options)
    after = {r["ecozone"]: r for r in store.load_registry(spark, out).collect()}
    assert set(after) == set(before) and all(after[z] == before[z] for z in before if z != zone)


def test_final_model_sees_all_training_rows(spark, samples, tmp_path, monkeypatch):
    seen, fit = [], models.refit
    monkeypatch.setattr(models, "refit", lambda params, rows, settings: seen.append(rows) or fit(params, rows, settings))
    zoned = training.engineer_features(samples.filter("latitude < 12").withColumn("ecozone", F.lit(0)), FAST)
    split, fitted = training.prepare_zones(zoned, FAST)
    got = training.train_zone(split, 0, fitted[0], str(tmp_path / "o"), FAST, balance=False, attributions=False)
    wanted = {r[0] for r in split.filter("NOT is_test").select("row_id").collect()}
    assert {r[0] for r in seen[0].select("row_id").collect()} == wanted and got["message"] is None
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "o" / "oof")).select("row_id").collect()} == wanted


def test_failing_zone_does_not_stop_others(spark, samples, tmp_path):
    zoned = samples.withColumn("ecozone", (F.col("row_id") % 3).cast("int")).withColumn(
        "fire_intensity", F.when(F.col("ecozone") == 1, None).otherwise(F.col("fire_intensity")).cast("double"))
    zoned = training.engineer_features(zoned.drop("NDVI").withColumn("NDVI", F.lit(1.0) * F.col("row_id")), FAST)
    got = training.train_zones(zoned, str(tmp_path / "o"), FAST, candidates={"x": {"family": "leafwise", "rounds": -1}},
                               balance=False, oof=False, attributions=False)
    assert got.filter("status = 'TRAINED' AND message LIKE '%fallback classifier%'").count() == 2


def test_missing_zone_lookup(spark):
    reg = spark.createDataFrame([(1, 0.3, True, False)], "ecozone int, thr double, has_clf boolean, has_reg boolean")
    rows = spark.createDataFrame([(5, 1), (6, 2)], "row_id long, ecozone int")
    got = {r["row_id"]: (r["thr"], r["has_clf"], r["has_reg"]) for r in store.model_lookup(rows, reg).collect()}
    assert got == {5: (0.3, True, False), 6: (0.5, False, False)}
