import math
import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import prep, split


@pytest.fixture(scope="module")
def labelled(spark):
    """Zone 0 holds most rows; zone 7 has a class with a single row."""
    return spark.range(2000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 4 + 1).cast("int").alias("z"),
        ((F.col("id") * 37) % 11 < 3).cast("int").alias("y")).unionByName(
        spark.range(5000, 5009).select(F.col("id").alias("row_id"), F.lit(7).alias("z"), (F.col("id") == 5000).cast("int").alias("y")))


@pytest.mark.parametrize("hot", [1_000_000, 100])
def test_holdout_sizes(labelled, hot):
    p = split.stratified_holdout(labelled, ["z"], "y", 0.2, hot_rows=hot).toPandas()
    assert len(p) == 2009 and p.row_id.is_unique
    for z, part in p.groupby("z"):
        sizes, n = part.groupby("y").size(), len(part)
        test = part[part.is_test].groupby("y").size()
        if z == 7:
            assert test.get(1, 0) == 0 and 1 <= test.get(0, 0) <= 2
            continue
        assert part.is_test.sum() == math.ceil(0.2 * n)
        assert all(abs(test[c] - sizes[c] * math.ceil(0.2 * n) / n) < 1 for c in sizes.index)


def test_split_does_not_depend_on_partitions(labelled):
    a, b = (sorted(map(tuple, split.stratified_holdout(labelled.repartition(n), ["z"], "y").collect())) for n in (1, 13))
    assert a == b


@pytest.mark.parametrize("hot", [1_000_000, 100])
def test_folds(labelled, hot):
    p = split.stratified_folds(labelled, ["z"], "y", 5, 2, hot_rows=hot).toPandas()
    assert len(p) == 2 * 2009
    for _, part in p[p.z != 7].groupby(["z", "repeat", "y"]):
        n = part.groupby("fold").size()
        assert n.max() - n.min() <= 1
    both = p.pivot(index="row_id", columns="repeat", values="fold")
    assert (both[0] != both[1]).mean() > 0.5


def test_samples(labelled):
    assert split.first_rows(labelled, ["z"], 3).filter("z = 7").count() == 3
    a = {r[0] for r in split.seeded_sample(labelled, [], 50).select("row_id").collect()}
    assert len(a) == 50 and a == {r[0] for r in split.seeded_sample(labelled.repartition(3), [], 50).select("row_id").collect()}
    assert split.random_holdout(labelled, [], 0.25).filter("is_test").count() == math.ceil(0.25 * 2009)


def test_ordered_holdout(spark):
    df = spark.range(10).select(F.col("id").alias("row_id"), (F.lit(2020) + F.col("id") % 5).alias("year"))
    assert {r["year"] for r in split.ordered_holdout(df, [], "year", 0.2).filter("is_test").collect()} == {2024}


def test_prep_per_zone(spark):
    rnd = random.Random(2)
    rows = [(i, i % 2, rnd.gauss(5, 2) if i % 7 else None, 4.0 if i % 2 else rnd.random(), rnd.choice("ab") if i % 5 else None)
            for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, ecozone int, x double, flat double, c string")
    fitted = prep.fit_prep(df, ["ecozone"], ["x", "flat"], ["c"])
    assert fitted[(1,)].names == ["x", "c=a", "c=b"] and fitted[(0,)].names == ["x", "flat", "c=a", "c=b"]
    part = df.filter("ecozone = 0").toPandas()
    x = part.x.fillna(part.x.median())
    med, mean, std = fitted[(0,)].numeric["x"]
    assert abs(med - part.x.median()) < 1e-12 and abs(mean - x.mean()) < 1e-12 and abs(std - x.std(ddof=0)) < 1e-12
    new = spark.createDataFrame([(1, 0, None, 0.5, "never seen"), (2, 0, mean, 0.5, None)], df.schema)
    out = {r["row_id"]: r for r in fitted[(0,)].apply(new, ["row_id"]).collect()}
    assert out[1]["c=a"] == out[1]["c=b"] == 0.0 and abs(out[1]["x"] - (med - mean) / std) < 1e-9
    mode = part.c.value_counts().sort_index().idxmax()
    assert out[2][f"c={mode}"] == 1.0 and out[2]["x"] == 0.0
    staged = new
    for s in fitted[(0,)].stages():
        staged = s.transform(staged)
    assert [list(r["features"]) for r in staged.orderBy("row_id").collect()] == [
        [out[i][n] for n in fitted[(0,)].names] for i in (1, 2)]


def test_first_rows_sort_no_whole_group(spark):
    df = spark.range(20_000).select(((F.col("id") * 7919) % 20_000).alias("row_id"), F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 50).alias("g")).repartition(7)
    rows = [(r.g, r.row_id) for r in df.collect()]
    want = sorted(x for g in {g for g, _ in rows} for x in sorted(r for r in rows if r[0] == g)[:4000])
    got = split.first_rows(df, ["g"], 4000)
    assert sorted((r.g, r.row_id) for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # The window of whole groups stands above one of salted shares and its filter.
    whole = plan.index("Window [row_number()")
    second = plan.index("Window [row_number()", whole + 1)
    assert "_salt" in plan[second:plan.index("\n", second)] and "Filter (_rn" in plan[whole:second]
    few = split.seeded_sample(df, ["g"], 5, seed=3, salts=4)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, split.seeded_sample(df, ["g"], 5, seed=3, salts=64).collect()))
    assert {r["count"] for r in few.groupBy("g").count().collect()} == {5}


def test_a_column_of_very_many_values_trains(spark):
    n = 50_000
    df = spark.range(n + 2000).select(F.col("id").alias("row_id"), F.lit(0).alias("ecozone"), (F.col("id") % 97).cast("double").alias("x"),
                                      F.concat(F.lit("it's \\ "), (F.col("id") % n).cast("string")).alias("c"),
                                      F.when(F.col("id") % 5 > 0, F.lit("a")).alias("d"), (F.col("id") % 97 > 60).cast("double").alias("label"))
    fitted = prep.fit_prep(df, ["ecozone"], ["x"], ["c", "d"])[(0,)]
    assert len(fitted.names) == n + 2 and fitted.names[:1] == ["x"] and fitted.names[-1] == "d=a"
    from pyspark.ml import Pipeline
    from emberline.operators import models
    rows = df.limit(4000)
    model = Pipeline(stages=[*fitted.stages(), models.estimator({"family": "leafwise", "rounds": 1, "depth": 2}, True, 1)]).fit(rows)
    new = spark.createDataFrame([(1, 0, 80.0, "unknown", None, 1.0), (2, 0, 3.0, "it's \\ 7", "b", 0.0)], df.schema)
    got = {r.row_id: r for r in model.transform(new).collect()}
    assert [got[i].prediction for i in (1, 2)] == [1.0, 0.0] and got[1].features.size == n + 2
    assert list(got[1].features.indices) == [0, n + 1] and fitted.names[got[2].features.indices[1]] == "c=it's \\ 7"


def test_holdout_finds_the_last_rows_without_shuffling_the_table(spark):
    d = spark.range(30_000).select(F.col("id").alias("row_id"), (F.col("id") % 3 % 2).alias("y"), F.repeat(F.lit("x"), 100).alias("wide"))
    out = split.stratified_holdout(d, [], "y")
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    order = lambda i: (((i % 2147483648) * 2654435761 + 42) % 4294967296, i)
    want = {i for y, n in ((0, 4000), (1, 2000)) for i in sorted((i for i in range(30_000) if i % 3 % 2 == y), key=order)[:n]}
    assert {r.row_id for r in out.filter("is_test").collect()} == want
    # Repeated row ids keep the quota.
    twice = d.withColumn("row_id", F.lit(7))
    assert split.stratified_holdout(twice, [], "y").filter("is_test").count() == 6000
