"""Zone models: candidates, warm-up gate, cross-validation, seeded search, out-of-fold scores.

Training tables hold ``row_id, features (vector), label``. Every fit is a distributed ML job; independent fits are
submitted from a small thread pool.
"""
from __future__ import annotations

import random
import time
import uuid
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.config import Settings
from emberline.operators import metrics
from emberline.operators.split import class_sample, random_holdout, stratified_folds
from emberline.storage import materialize

# Search ranges per model family (whole or real numbers, both ends included).
CLASSIFIER_SPACE = {
    "leafwise": {"rounds": (50, 400), "rate": (0.01, 0.3), "depth": (2, 12), "leaves": (16, 128)},
    "levelwise": {"rounds": (50, 400), "rate": (0.01, 0.3), "depth": (2, 12), "rows": (0.6, 1.0), "columns": (0.6, 1.0)},
    "symmetric": {"rounds": (50, 400), "rate": (0.02, 0.4), "depth": (4, 10)},
    "forest": {"rounds": (50, 300), "depth": (2, 20)},
}
REGRESSOR_SPACE = {
    "leafwise": {"rounds": (100, 400), "rate": (0.01, 0.3), "depth": (1, 14), "leaves": (20, 200)},
    "levelwise": {"rounds": (100, 400), "rate": (0.01, 0.3), "depth": (3, 10), "rows": (0.6, 1.0), "columns": (0.6, 1.0)},
    "symmetric": {"rounds": (200, 500), "rate": (0.01, 0.3), "depth": (4, 10)},
    "forest": {"rounds": (200, 600), "depth": (6, 14)},
}


def draw_params(space: dict, trial: int, seed: int) -> dict:
    """Parameters of one trial; the same trial always draws the same ones."""
    rnd = random.Random(seed * 1_000_003 + trial)
    family = rnd.choice(sorted(space))
    out = {"family": family}
    for name, (lo, hi) in space[family].items():
        out[name] = rnd.randint(lo, hi) if isinstance(lo, int) else rnd.uniform(lo, hi)
    return out


def estimator(params: dict, classifier: bool, seed: int):
    """ML estimator for a family and its parameters."""
    depth = params.get("depth", 5)
    if "leaves" in params:
        depth = min(depth, max(1, (params["leaves"] - 1).bit_length()))
    if params["family"] == "forest":
        kind = RandomForestClassifier if classifier else RandomForestRegressor
        return kind(numTrees=params["rounds"], maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed)
    kind = GBTClassifier if classifier else GBTRegressor
    return kind(maxIter=params["rounds"], stepSize=params.get("rate", 0.1), maxDepth=depth, seed=seed,
                subsamplingRate=params.get("rows", 1.0), featureSubsetStrategy=str(params.get("columns", "all")))


def base_candidates(settings: Settings) -> dict[str, dict]:
    return {"boosted": {"family": "leafwise", "rounds": settings.boost_rounds, "rate": settings.boost_rate,
                        "depth": settings.boost_depth}}


def probabilities(model, df: DataFrame, keep: list[str]) -> DataFrame:
    p = vector_to_array(F.col("probability"))
    return model.transform(df).select(*keep, F.get(p, F.lit(1)).alias("y_prob"))


def scored_by(model, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    out = probabilities(model, df, ["row_id", "label", *(keep or [])])
    return out.withColumn("y_true", F.col("label").cast("int")).drop("label")


def precision_of(model, df: DataFrame) -> float:
    return metrics.average_precision(scored_by(model, df), []).first()["pr_auc"]


def run_parallel(jobs: list, workers: int, pools: list[str] | None = None) -> list:
    """Run thunks from a bounded pool of threads; a failure is returned in place of its result.

    With ``pools`` every job gets its own scheduler pool: where the session schedules fairly (``spark.scheduler.mode`` FAIR) tasks
    of all running jobs take turns, so a long job does not hold back short ones. Jobs started inside inherit the pool.
    """
    spark = SparkSession.active()

    def guarded(job, pool):
        if pool:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        try:
            return job()
        except Exception as e:  # one failing job must not stop the others
            return e
        finally:
            if pool:
                spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
    # A target of its own for every job: threads of one target would share, and overwrite, one set of properties.
    with ThreadPoolExecutor(max(1, workers)) as threads:
        running = [threads.submit(inheritable_thread_target(spark)(guarded), j, p) for j, p in zip(jobs, pools or [None] * len(jobs))]
        return [r.result() for r in running]


def fold_scores(params: dict, train: DataFrame, folds: int, repeats: int, seed: int, workers: int = 4) -> DataFrame:
    """Score of every row by the model that did not see it: ``(row_id, repeat, fold, y_true, y_prob)``."""
    table = materialize(stratified_folds(train, [], "label", folds, repeats, seed), "folds")

    def one(repeat: int, fold: int):
        part = table.filter(F.col("repeat") == repeat)
        model = estimator(params, True, seed).fit(part.filter(F.col("fold") != fold))
        return scored_by(model, part.filter(F.col("fold") == fold), ["repeat", "fold"])

    out = run_parallel([lambda r=r, f=f: one(r, f) for r in range(repeats) for f in range(folds)], workers)
    for o in out:
        if isinstance(o, Exception):
            raise o
    return materialize(reduce(DataFrame.unionByName, out), "oof")


def reason(what: str, e: Exception) -> str:
    return f"{what}: {type(e).__name__}: {str(e)[:200]}"


def cross_validate(params: dict, train: DataFrame, settings: Settings) -> tuple[float | None, float | None, str | None]:
    """Mean and population deviation of the fold scores; when a fold cannot be fitted, None twice and the reason."""
    try:
        s = fold_scores(params, train, settings.cv_folds, settings.cv_repeats, settings.seed)
        r = metrics.cv_summary(metrics.average_precision(s, ["repeat", "fold"]), [], "pr_auc").first()
        return r["cv_mean"], r["cv_std"], None
    except Exception as e:
        return None, None, reason("cross-validation", e)


def out_of_fold(params: dict, train: DataFrame, settings: Settings) -> DataFrame:
    """``(row_id, fold, prob)`` with one probability per training row."""
    s = fold_scores(params, train, settings.cv_folds, 1, settings.seed)
    return s.select("row_id", "fold", F.col("y_prob").alias("prob"))


def warm_up(params: dict, train: DataFrame, settings: Settings):
    """Model fitted on a bounded choice of the original rows, in their class shares."""
    return estimator(params, True, settings.seed).fit(class_sample(train, "label", settings.warmup_rows, settings.seed))


@dataclass
class Choice:
    model: object
    params: dict
    pr_auc: float
    cv_mean: float | None = None
    cv_std: float | None = None
    tuned: bool = False
    # What was left out or failed on the way, for the registry.
    notes: list[str] = field(default_factory=list)


def select_classifier(train: DataFrame, valid: DataFrame, settings: Settings, candidates: dict | None = None,
                      search: bool = False, space: dict | None = None, clock=time.monotonic) -> Choice:
    """Best candidate by the selection score, replaced by the search result when that is better.

    ``valid`` is a validation split of the training rows; the test rows play no part in the choice. A candidate that fails or
    stays below the gate is left out; ``notes`` says why.
    """
    spark, rows, fitted, notes = train.sparkSession, [], {}, []
    for i, (name, params) in enumerate((candidates or base_candidates(settings)).items()):
        try:
            gate = precision_of(warm_up(params, train, settings), valid)
            if gate < settings.warmup_gate:
                notes.append(f"{name}: warm-up average precision {gate:.3f} below {settings.warmup_gate}")
                continue
            t0 = clock()
            model = estimator(params, True, settings.seed).fit(train)
            seconds = clock() - t0
            full = precision_of(model, valid)
        except Exception as e:
            notes.append(reason(name, e))
            continue
        mean, std, why = cross_validate(params, train, settings)
        notes += [f"{name}: {why}"] if why else []
        rows.append((i, name, full, mean, std, seconds))
        fitted[name] = Choice(model, params, full, mean, std)
    if rows:
        table = spark.createDataFrame(
            rows, "ord int, candidate string, full_pr double, cv_mean double, cv_std double, full_seconds double")
        order = metrics.best_candidate(table, [], "ord").first()["ord"]
        best = fitted[next(r[1] for r in rows if r[0] == order)]
    else:
        params = base_candidates(settings)["boosted"] | {"rate": 0.05}
        model = estimator(params, True, settings.seed).fit(train)
        best = Choice(model, params, precision_of(model, valid))
        notes.append("fallback classifier")
    if search:
        found = search_classifier(train, valid, settings, space)
        if found is not None and found.pr_auc > best.pr_auc:
            found.cv_mean, found.cv_std = best.cv_mean, best.cv_std
            best = found
    best.notes = notes
    return best


def refit(params: dict, rows: DataFrame, settings: Settings):
    """The chosen classifier on all training rows, the validation part included."""
    return estimator(params, True, settings.seed).fit(rows)


# Rows of all trials that are fitted at the same time: a fit holds its rows in memory.
TRIAL_ROWS = 4_000_000


def _search(trial, better, settings: Settings, workers: int = 1) -> object | None:
    """Best trial; the search ends where so many trials in a row bring no gain as patience allows.

    ``workers`` trials run at a time. They are judged in their order, so the outcome is that of one after the other. A trial that
    others, already known, leave no chance to be reached is not started, and cancelled if it runs.
    """
    known, running, following, patience = {}, {}, 0, max(5, settings.trials // 4)
    spark, tag = SparkSession.active(), f"trial-{uuid.uuid4().hex}"

    def gains(i):
        return not isinstance(known[i], Exception) and all(
            isinstance(known[j], Exception) or better(known[i], known[j]) for j in list(known) if j < i)

    def last():
        """The last trial that may still be reached: what is not known yet counts as a gain."""
        stale = 0
        for i in range(settings.trials):
            stale = stale + 1 if i in known and not gains(i) else 0
            if stale >= patience:
                return i
        return settings.trials - 1

    def tagged(i):
        spark.sparkContext.addJobTag(f"{tag}-{i}")
        return trial(i)
    with ThreadPoolExecutor(workers) as threads:
        end = last()
        try:
            while following <= end or any(i <= end for i in running):
                while following <= end and len(running) < workers:
                    # A target of its own for every trial, as in run_parallel.
                    running[following] = threads.submit(inheritable_thread_target(spark)(tagged), following)
                    following += 1
                wait(running.values(), 0.5 if any(i > end for i in running) else None, FIRST_COMPLETED)
                for i in [i for i, r in running.items() if r.done()]:
                    got = running.pop(i).result()
                    if i <= end:
                        known[i] = got
                end = last()
                for i in [i for i in running if i > end]:
                    spark.sparkContext.cancelJobsWithTag(f"{tag}-{i}")
        finally:
            # Again and again, as a fit may be about to start its next job.
            while not all(r.done() for r in running.values()):
                for i in running:
                    spark.sparkContext.cancelJobsWithTag(f"{tag}-{i}")
                time.sleep(0.1)
    return next((known[i] for i in range(end, -1, -1) if gains(i)), None)


def search_classifier(train: DataFrame, valid: DataFrame, settings: Settings, space: dict | None = None) -> Choice | None:
    """Seeded random search for average precision; stops after a quarter of the trials without gain."""
    scores = {}

    def trial(i):
        params = draw_params(space or CLASSIFIER_SPACE, i, settings.seed)
        try:
            model = estimator(params, True, settings.seed).fit(train)
            score = scores[i] = precision_of(model, valid)
        except Exception as e:
            return e
        # A trial that does not beat all known ones before it cannot be chosen, so its model need not be kept.
        beaten = any(s >= score for j, s in list(scores.items()) if j < i)
        return Choice(None if beaten else model, params, score, tuned=True)
    workers = 1 if settings.trial_workers <= 1 else max(1, min(settings.trial_workers, TRIAL_ROWS // max(1, train.count())))
    return _search(trial, lambda a, b: a.pr_auc > b.pr_auc, settings, workers)


def regression_scored(model, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return model.transform(df).select("row_id", *(keep or []), F.col("label").alias("y_log"),
                                      F.col("prediction").alias("pred_log"))


def regression_loss(scored: DataFrame, with_charge: bool) -> float:
    t, p = F.expm1("y_log"), F.expm1("pred_log")
    return scored.agg((metrics.search_loss if with_charge else metrics.asymmetric_loss)(t, p).alias("l")).first()["l"]


def search_regressor(fires: DataFrame, settings: Settings, space: dict | None = None) -> dict | None:
    """Parameters with the smallest risk-aware loss on a held-out quarter of the fire rows."""
    split = materialize(random_holdout(fires, [], 0.25, settings.seed), "tune")
    train, valid = split.filter("NOT is_test"), split.filter("is_test")

    def trial(i):
        params = draw_params(space or REGRESSOR_SPACE, i, settings.seed)
        try:
            model = estimator(params, False, settings.seed).fit(train)
            return params, regression_loss(regression_scored(model, valid), True)
        except Exception as e:
            return e
    best = _search(trial, lambda a, b: a[1] < b[1], settings)
    return best[0] if best else None


def select_regressor(fires: DataFrame, test_fires: DataFrame, settings: Settings, candidates: dict | None = None,
                     search: bool = False, space: dict | None = None, notes: list[str] | None = None):
    """``(model, params)`` of the chosen intensity model, or None when there are too few fires or nothing fits.

    Reasons of failed candidates are added to ``notes``.
    """
    if (fires.limit(settings.min_fire_train).count() < settings.min_fire_train
            or test_fires.limit(settings.min_fire_test).count() < settings.min_fire_test):
        return None
    if search:
        params = search_regressor(fires, settings, space)
        if params:
            return estimator(params, False, settings.seed).fit(fires), params
    best, options = None, list((candidates or base_candidates(settings)).values())
    for params in options:
        try:
            model = estimator(params, False, settings.seed).fit(fires)
            # The loss only ranks candidates; a single one needs none.
            loss = regression_loss(regression_scored(model, test_fires), False) if len(options) > 1 else 0.0
        except Exception as e:
            if notes is not None:
                notes.append(reason("intensity", e))
            continue
        if best is None or loss < best[2]:
            best = (model, params, loss)
    return best[:2] if best else None
