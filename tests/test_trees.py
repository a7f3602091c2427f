"""Flat tree arrays against enumeration of feature subsets and the models' own outputs."""
import itertools
import math
import time

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from emberline.operators import models, trees


def grow(rng, width, depth, n, full=True):
    """Random trees in preorder; features may repeat on a path."""
    f, t, left, right, cover, value, roots = [], [], [], [], [], [], []

    def add(d, weight):
        i = len(f)
        for column, v in ((f, int(rng.integers(width))), (t, rng.random()), (left, -1), (right, -1), (cover, weight), (value, rng.normal())):
            column.append(v)
        if d < depth and (full or rng.random() < 0.8):
            p = rng.uniform(0.02, 0.98)
            left[i] = add(d + 1, weight * p)
            right[i] = add(d + 1, weight * (1 - p))
        return i
    for _ in range(n):
        roots.append(add(0, 1000.0))
    return trees.Trees(*(np.array(a) for a in (f, t, left, right, cover, value, roots)), width)


def expectation(t, x, known, node):
    if t.left[node] < 0:
        return t.value[node]
    f = t.feature[node]
    if f in known:
        return expectation(t, x, known, t.left[node] if x[f] <= t.threshold[node] else t.right[node])
    return sum(t.cover[c] / t.cover[node] * expectation(t, x, known, c) for c in (t.left[node], t.right[node]))


@pytest.mark.parametrize("width,depth,n", [(1, 3, 2), (3, 5, 3), (4, 6, 2), (5, 0, 2)])
def test_values_equal_enumeration(width, depth, n):
    rng = np.random.default_rng(width * 10 + depth)
    t = grow(rng, width, depth, n, full=False)
    x = rng.random((6, width))
    got = t.shapley(x)
    for row, phi in zip(x, got):
        whole = lambda s: sum(expectation(t, row, s, r) for r in t.roots)
        for j in range(width):
            rest = [i for i in range(width) if i != j]
            want = sum(math.factorial(len(s)) * math.factorial(width - len(s) - 1) / math.factorial(width) * (whole({*s, j}) - whole(set(s)))
                       for k in range(width) for s in itertools.combinations(rest, k))
            assert phi[j] == pytest.approx(want, abs=1e-10)
        assert t.base == pytest.approx(whole(set()))
    assert np.allclose(got.sum(axis=1) + t.base, t.outputs(x), atol=1e-10)


def test_many_deep_trees_add_up_in_seconds():
    rng = np.random.default_rng(1)
    t = grow(rng, 12, 8, 200)
    x = rng.random((300, 12))
    start = time.monotonic()
    phi = t.shapley(x)
    assert np.allclose(phi.sum(axis=1) + t.base, t.outputs(x), atol=1e-9) and time.monotonic() - start < 60
    assert t.depth == 8 and t.shapley(x[:0]).shape == (0, 12)


@pytest.mark.parametrize("params,classifier", [({"family": "leafwise", "rounds": 4, "depth": 4, "rate": 0.2}, True), ({"family": "forest", "rounds": 5, "depth": 5}, True),
                                               ({"family": "leafwise", "rounds": 4, "depth": 4, "rate": 0.2}, False), ({"family": "forest", "rounds": 5, "depth": 5}, False)])
def test_arrays_give_the_models_outputs(spark, params, classifier):
    x = F.array(*[F.rand(i) for i in range(4)])
    df = spark.range(500).select(F.col("id").alias("row_id"), x.alias("x")).withColumn("features", array_to_vector("x"))
    df = df.withColumn("label", (F.col("x")[0] + F.col("x")[1] > 1).cast("double") if classifier else F.col("x")[0] * F.col("x")[2]).cache()
    model = models.estimator(params, classifier, 3).fit(df)
    t = trees.read_trees(model)
    out = model.transform(df)
    if not classifier:
        want = F.col("prediction")
    else:
        p = vector_to_array("probability")[1]
        want = p if params["family"] == "forest" else 0.5 * F.log(p / (1 - p))
    rows = out.select("x", want.alias("want")).collect()
    assert np.allclose(t.outputs(np.array([r.x for r in rows])), [r.want for r in rows], atol=1e-9)
    assert t.base == pytest.approx(np.mean([r.want for r in rows]), abs=0.05)


def test_splits_on_indicators(spark):
    from pyspark.ml import Pipeline
    from emberline.operators import prep
    df = spark.range(600).select(F.col("id").alias("row_id"), F.element_at(F.array(*[F.lit(c) for c in "abc"]), (F.col("id") % 3 + 1).cast("int")).alias("c"),
                                 (F.rand(3) * 5).alias("x"))
    df = df.withColumn("label", ((F.col("c") == "b") | (F.col("x") > 4)).cast("double")).cache()
    fitted = prep.fit_prep(df, [], ["x"], ["c"])[()]
    model = Pipeline(stages=fitted.stages()).fit(df).transform(df)
    for params in ({"family": "leafwise", "rounds": 3, "depth": 3}, {"family": "forest", "rounds": 6, "depth": 4}):
        fit = models.estimator(params, True, 5).fit(model)
        t = trees.read_trees(fit)
        p = vector_to_array("probability")[1]
        rows = fit.transform(model).select(vector_to_array("features").alias("f"), (p if params["family"] == "forest" else 0.5 * F.log(p / (1 - p))).alias("want")).collect()
        x = np.array([r.f for r in rows])
        assert np.allclose(t.outputs(x), [r.want for r in rows], atol=1e-9) and {1, 2, 3} & set(t.feature.tolist())
        assert np.allclose(t.shapley(x).sum(axis=1) + t.base, t.outputs(x), atol=1e-9)
