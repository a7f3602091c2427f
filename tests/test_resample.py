import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline import storage
from emberline.operators import neighbours, resample


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    out = [(i, [rnd.gauss(0, 1) for _ in range(3)], 0) for i in range(150)]
    out += [(1000 + i, [rnd.gauss(2, 1) for _ in range(3)], 1) for i in range(40)]
    out += [(2000 + i, [0.5, 0.5, 0.5], i % 2) for i in range(60)]
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "row_id long, features array<double>, label int")


def brute(rows, k):
    x, ids = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    out = {}
    for i, r in enumerate(rows):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        out[r[0]] = [j for j in np.lexsort((ids, d)) if j != i][:k]
    return out


@pytest.mark.parametrize("block", [16])
def test_nearest_rows(df, rows, block):
    got = resample.nearest_rows(df, df, 3, block_rows=block).toPandas().sort_values(["row_id", "place"])
    near = got.groupby("row_id").neighbour.apply(list)
    assert {r: [rows[j][0] for j in js] for r, js in brute(rows, 3).items()} == near.to_dict()


def cloud(seed, n, width):
    """Dense and thin places, a line, and rows of equal distance from their middle."""
    rng = np.random.default_rng(seed)
    ring = rng.normal(0, 1, (n // 5, width))
    parts = [rng.normal(0, 0.01, (n // 5, width)) + 3, rng.normal(0, 5, (n // 5, width)), ring / np.linalg.norm(ring, axis=1)[:, None] - 7,
             np.linspace(0, 1, n // 5)[:, None] * np.ones(width), np.round(rng.normal(0, 1, (n - 4 * (n // 5), width)))]
    return np.concatenate(parts)


@pytest.mark.parametrize("n,width,block", [(2500, 2, 40), (1500, 6, 25), (400, 3, 2048), (1, 2, 5), (3, 2, 5)])
def test_nearest_rows_of_uneven_places(spark, n, width, block):
    x = cloud(n, n, width)
    refs = spark.createDataFrame([(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)], "row_id long, features array<double>, label int")
    y = np.concatenate([x[::7], cloud(n + 1, 60, width), np.full((1, width), 1e6)])
    asked = [(-1 - i, [float(v) for v in r]) for i, r in enumerate(y)]
    queries = spark.createDataFrame(asked, "row_id long, features array<double>")
    got = {}
    for r in neighbours.nearest_rows(queries, refs, 4, block_rows=block).collect():
        got.setdefault(r.row_id, {})[r.place] = (r.neighbour, r.neighbour_label)
    for i, f in asked:
        d = np.sqrt(((x - np.array(f)) ** 2).sum(1))
        want = np.lexsort((np.arange(n), d))[:4]
        assert [got[i][p] for p in range(len(want))] == [(j, j % 3) for j in want]


def test_compared_pairs_grow_less_than_squared(spark):
    pairs = {}
    for n in (2000, 20_000):
        x = np.random.default_rng(1).normal(0, 1, (n, 2))
        df = spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], "row_id long, features array<double>, label int")
        stats = {}
        assert neighbours.nearest_rows(df, df, 3, block_rows=64, stats=stats).count() == 3 * n
        pairs[n] = stats["pairs"] / n
    assert pairs[2000] < 500 and pairs[20_000] < 2 * pairs[2000]


def test_edited(df, rows):
    want = {r[0] for r in rows if all(rows[j][2] == r[2] for j in brute(rows, 3)[r[0]])}
    assert {r["row_id"] for r in resample.edited_neighbours(df).collect()} == want


def test_smote_points_lie_on_segments(df, rows):
    out = resample.smote(df).toPandas()
    sizes = out.label.value_counts()
    assert sizes[0] == sizes[1] and out.row_id.is_unique
    small = [r for r in rows if r[2] == 1]
    ends = [(np.array(r[1]), np.array(small[j][1])) for r in small for j in brute(small, 5)[r[0]]]
    for v in out[out.row_id < 0].features:
        v = np.array(v)
        assert min(abs(np.linalg.norm(v - a) + np.linalg.norm(v - b) - np.linalg.norm(a - b)) for a, b in ends) < 1e-9


def test_draws_repeat(df):
    a, b = (sorted((r["row_id"], tuple(r["features"])) for r in resample.smote(d).collect()) for d in (df, df.repartition(11)))
    assert a == b


def test_adasyn_favours_hard_rows(df):
    out = resample.adasyn(df)
    assert abs(out.filter("label = 0").count() - out.filter("label = 1").count()) < 60
    assert out.select("row_id").distinct().count() == out.count()


def test_fallbacks(spark, df):
    few = df.filter("label = 0 OR row_id = 1001")
    got, name = resample.rebalance(few)
    assert name == "none" and got.count() == few.count()
    assert resample.rebalance(df)[1] == "SMOTEENN"


def test_large_quota_is_spread(spark):
    base = spark.createDataFrame([(1, 25_000), (2, 3)], "row_id long, quota long")
    got = resample._fan_out(base, 1000).groupBy("row_id").agg(F.count("_j"), F.countDistinct("_j"), F.max("_j")).orderBy("row_id").collect()
    assert [tuple(r) for r in got] == [(1, 25_000, 25_000, 24_999), (2, 3, 3, 2)]


def test_extreme_noise(spark):
    d = spark.range(200).select(F.col("id").alias("row_id"), (F.col("id") * 1.5).alias("x"), F.concat(F.lit("t"), F.col("id")).alias("s"),
                                F.col("id").cast("double").alias("y"))
    out = resample.extreme_noise(d, "y")
    added = out.filter("row_id < 0").toPandas()
    rare = {float(i) for i in range(200) if i >= 179.1 or i <= 19.9}
    assert len(added) == len(rare) and set(added.y) <= rare and {float(s[1:]) for s in added.s} <= rare
    assert (added.y != added.s.str[1:].astype(float)).any()
    assert resample.extreme_noise(d.limit(49), "y").count() == 49


def test_target_rebalance(spark):
    d = spark.range(400).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("double")).alias("features"),
                                F.when(F.col("id") < 10, 1000.0 + F.col("id")).otherwise(F.col("id") % 20).cast("double").alias("y_log"))
    out = resample.rebalance_target(d)
    assert out.count() == 400 and out.filter("y_log >= 1000").count() == 200
    assert out.select("row_id").distinct().count() == 400
    same = d.filter("row_id >= 10")
    assert resample.rebalance_target(same).count() == same.count()


def test_many_dimensions_write_in_proportion_to_the_rows(spark, tmp_path, monkeypatch):
    """Nothing is written per row and visited block where pruning is weak, and the nearest rows are the same."""
    n, width = 6000, 64
    x = np.random.default_rng(3).normal(0, 1, (n, width))
    x[-200:] = x[:200]
    df = spark.createDataFrame([(i, [float(v) for v in r], i % 2) for i, r in enumerate(x)], "row_id long, features array<double>, label int")
    monkeypatch.setattr(storage, "scratch_root", lambda spark: str(tmp_path))
    got = {}
    for r in neighbours.nearest_rows(df, df, 3, block_rows=256).collect():
        got.setdefault(r.row_id, {})[r.place] = r.neighbour
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 8 * 8 * n * width
    for i in [*range(0, n, 37), *range(n - 200, n, 7)]:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        assert [got[i][p] for p in range(3)] == list(np.lexsort((np.arange(n), d))[:3])


def test_features_are_written_few_times(spark, tmp_path, monkeypatch):
    """Two tables of the features, in single precision where it is enough."""
    n, width = 6000, 64
    x = np.random.default_rng(5).normal(0, 1, (n, width)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r], i % 2) for i, r in enumerate(x)], "row_id long, features array<double>, label int")
    monkeypatch.setattr(storage, "scratch_root", lambda spark: str(tmp_path))
    assert neighbours.nearest_rows(df, df, 3, block_rows=256).count() == 3 * n
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 2.5 * 4 * n * width


def test_loose_bounds_do_not_swell_a_task():
    import tracemalloc

    import pyarrow as pa
    rng, n, width = np.random.default_rng(6), 2048, 64
    x, y = rng.normal(0, 1, (n, width)), rng.normal(0, 1, (n, width))
    cols = {"names": np.arange(n), "bounds": np.full(n, 1e6), "rows": x, "ids": np.arange(n), "kinds": np.zeros(n, np.int32), "refs": y}
    batch = pa.record_batch([pa.array([c.tobytes()], pa.binary()) for c in cols.values()], list(cols))
    tracemalloc.start()
    got = pa.Table.from_batches(neighbours._packs_met(width, 4)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6 and got.num_rows == 4 * n
