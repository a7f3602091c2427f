import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import components, joins, quantiles, scan


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in group 0; values with gaps."""
    return spark.range(3000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("g"),
        ((F.col("id") * 7919) % 1009).alias("v"),
        F.when((F.col("id") * 31) % 11 < 9, None).otherwise(F.col("id").cast("double")).alias("a"),
        F.when(F.col("id") < 700, None).when(F.col("id") % 13 > 0, None).otherwise(F.col("id") * 2.0).alias("b"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("hot", [10_000, 100])
def test_running_totals(skewed, hot):
    got = scan.running_totals(skewed.select("row_id", "g", "v"), ["g"], [F.desc("v"), F.col("row_id")],
                              {"s": F.col("v"), "n": F.lit(1)}, hot).toPandas().sort_values(["g", "v", "row_id"], ascending=[True, False, True])
    assert (got.s == got.groupby("g").v.cumsum()).all()
    assert (got.n == got.groupby("g").cumcount() + 1).all()
    assert len(got) == 3000


@pytest.mark.parametrize("hot", [10_000, 100])
def test_carry_forward(skewed, hot, parts=7):
    p = skewed.toPandas().sort_values("row_id")
    got = scan.carry_forward(skewed.repartition(parts), "row_id", ["a", "b"], hot_rows=hot).toPandas().sort_values("row_id")
    for c in ("a", "b"):
        assert np.array_equal(got[c].to_numpy(float), p[c].ffill().to_numpy(float), equal_nan=True)
    assert got.b.isna().any()


@pytest.mark.parametrize("hot,chunk", [(10_000, 100), (100, 3)])
def test_trailing_rows(skewed, hot, chunk):
    got = scan.padded_sequences(skewed.select("row_id", "g", "v"), ["g"], "row_id", F.col("v"), 7, F.lit(0).cast("long"),
                                chunk=chunk, hot_rows=hot).toPandas()
    assert len(got) == 3000
    for g, part in got.sort_values("row_id").groupby("g"):
        v, n = part.v.tolist(), len(part)
        length = min(7, n)
        for i, seq in enumerate(part["sequence"]):
            want = v[max(0, i - length + 1):i + 1]
            assert list(seq) == [0] * (length - len(want)) + want


@pytest.mark.parametrize("hot", [10_000, 50])
def test_exact_quantiles(skewed, hot):
    p = skewed.toPandas()
    q = quantiles.exact_quantiles(skewed, ["v", "a"], [0.0, 0.1, 0.5, 0.9, 1.0], ["g"], hot_rows=hot).collect()
    assert len(q) > 40
    for r in q:
        x = p[p.g == r["g"]][r["column"]].dropna()
        assert np.allclose([r[f"q{i}"] for i in range(5)], x.quantile([0.0, 0.1, 0.5, 0.9, 1.0]))


def test_median_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "row_id int, x double")
    assert quantiles.medians(df, ["x"]) == {"x": None}


def test_modes_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "x string")
    assert quantiles.modes(df, ["x"]).first()["value"] == "a"


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_lookup_hot(skewed, spark, how):
    look = spark.range(20).select(F.col("id").alias("g"), (F.col("id") * 10).alias("z"))
    want = rows(skewed.select("row_id", "g").join(look, "g", how))
    got = joins.join_lookup(skewed.select("row_id", "g"), look, ["g"], how=how, hot_rows=100)
    assert rows(got.select("g", "row_id", "z")) == want


@pytest.mark.parametrize("hot", [5])
def test_components(spark, hot):
    n = 60
    edges = [(i, i + 1) for i in range(0, 29)] + [(40, i) for i in range(41, 55)]
    v = spark.range(n).select(F.col("id").alias("v"))
    got = dict(map(tuple, components.connected_components(
        v, spark.createDataFrame(edges, "src long, dst long"), hot_rows=hot).collect()))
    assert got == {i: 0 if i <= 29 else 40 if 40 <= i < 55 else i for i in range(n)}


@pytest.mark.parametrize("accuracy", [20, 100, 10_000, None])
def test_quantiles_rank_only_what_the_brackets_hold(spark, accuracy):
    import numpy as np
    n, probs = 6000, [0.0, 0.1, 0.101, 0.5, 0.9, 1.0]
    rng = np.random.default_rng(3)
    data = {"flat": rng.random(n), "heavy": np.exp(rng.normal(0, 40, n)), "same": np.full(n, 7.5), "few": rng.integers(0, 3, n) * 1.0,
            "hot": np.where(rng.random(n) < 0.4, 0.25, rng.random(n)), "gone": np.full(n, np.nan)}
    rows = [(i % 2, *[None if np.isnan(v[i]) else float(v[i]) for v in data.values()]) for i in range(n)] + [(5, 1.0, None, 2.0, 3.0, 4.0, None)]
    df = spark.createDataFrame(rows, "g int, " + ", ".join(f"{c} double" for c in data)).repartition(5)
    for by, groups in ((["g"], [0, 1]), ([], [None])):
        got = {((r.g if by else None), r.column): r for r in quantiles.exact_quantiles(df, list(data), probs, by, accuracy=accuracy).collect()}
        for g in groups:
            for c, v in data.items():
                own = [r[1 + list(data).index(c)] for r in rows if (g is None or r[0] == g) and r[1 + list(data).index(c)] is not None]
                if not own:
                    assert (g, c) not in got
                    continue
                want = np.quantile(own, probs)
                assert np.allclose([got[g, c][f"q{i}"] for i in range(len(probs))], want, rtol=1e-12), (g, c)
    if accuracy != 100:
        return
    wide = df.agg(*[x for i, c in enumerate(data) for x in (F.count(c).alias(f"_{i}"), F.percentile_approx(c, [0.5 - 2 / accuracy, 0.5 + 2 / accuracy], accuracy).alias(f"_b{i}"))])
    counts = quantiles._bucket_counts(df, list(data), [F.col(c) for c in data], wide, [], 1)
    assert counts.filter("column = 'flat'").count() < n * 8 / accuracy
