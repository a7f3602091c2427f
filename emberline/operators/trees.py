"""Tree models as flat node arrays, read from the table that a saved model keeps its nodes in.

One array per node attribute serves all trees of a model, so a task gets a model as a few arrays, whatever its depth, and
walks the trees for all rows of a batch at once.
"""
from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.storage import new_path

# Rows that one walk takes: the state of every level stays in a processor's cache.
WALK_ROWS = 2048


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees; children are places in the arrays, a leaf has -1. ``value`` is what a leaf adds to the output."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cover: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    width: int

    @cached_property
    def depth(self) -> int:
        level, depth = self.roots, 0
        while len(level := np.concatenate([self.left[level], self.right[level]])[np.tile(self.left[level] >= 0, 2)]):
            depth += 1
        return depth

    @cached_property
    def base(self) -> float:
        """Expected output over the training rows."""
        share = np.zeros(len(self.cover))
        share[self.roots] = 1.0
        # A node stands before its children, so one pass hands the shares down.
        for n in range(len(share)):
            for c in (self.left[n], self.right[n]):
                if c >= 0:
                    share[c] = share[n] * self.cover[c] / self.cover[n]
        return float((share * self.value)[self.left < 0].sum())

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row falls in: the margin of boosted trees, the mean vote of forests."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while len(open_ := rows[self.left[at] >= 0]):
                n = at[open_]
                at[open_] = np.where(x[open_, self.feature[n]] <= self.threshold[n], self.left[n], self.right[n])
            total += self.value[at]
        return total

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """Path-dependent Shapley values of every row and feature."""
        if not len(x):
            return np.zeros((0, self.width))
        return np.concatenate([self._shapley(x[i:i + WALK_ROWS]) for i in range(0, len(x), WALK_ROWS)])

    def _shapley(self, x: np.ndarray) -> np.ndarray:
        """One walk down and up every tree.

        With each feature on the path either followed (1) or replaced by its cover share, the Shapley weights of a leaf are the
        integral over s in (0, 1) of the product of s * followed + (1 - s) * share. Points of a Gauss rule give it exactly.
        A walk carries these products down; what the leaves below an edge add up to comes back, and the edge's feature gets
        the difference that the edge makes to its own factor. The work is linear in the nodes.
        """
        points = max(1, -(-min(self.depth, self.width) // 2))
        s, w = np.polynomial.legendre.leggauss(points)
        s, w = (s + 1) / 2, w / 2
        out, columns = np.zeros((self.width, len(x))), np.ascontiguousarray(x.T)

        def walk(node: int, product: np.ndarray, seen: dict) -> np.ndarray:
            if self.left[node] < 0:
                return self.value[node] * product
            f, total = int(self.feature[node]), None
            was, share0 = seen.get(f, (1, 1.0))
            low = columns[f] <= self.threshold[node]
            on0 = s + (1 - s) * share0
            for child, here in ((self.left[node], low), (self.right[node], ~low)):
                share = share0 * max(self.cover[child] / self.cover[node], 1e-300)
                on = here & was if f in seen else here
                # 0: left before, 1: left at this edge, 2: still followed.
                state = on.astype(np.intp) + (was if f in seen else 1)
                off1, on1 = (1 - s) * share, s + (1 - s) * share
                factor = np.stack([np.full(points, share / share0), off1 / on0, on1 / on0], axis=1)
                below = walk(int(child), factor.take(state, axis=1) * product, seen | {f: (on, share)})
                before = (1 - share0) / on0
                gain = np.stack([w * (-1 / (1 - s) - before), w * ((1 - share) / on1 - before)]) @ below
                out[f] += np.where(state == 2, gain[1], np.where(state == 1, gain[0], 0.0))
                total = below if total is None else total + below
            return total

        for root in self.roots:
            walk(int(root), np.ones((points, len(x))), {})
        return out.T


def node_table(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of the tree model saved at ``path``: tree, node, feature, threshold, categories, left, right, cover, value, logistic.

    ``value`` holds what a leaf adds to the output: its weighted prediction, or a forest's share of class 1 over its trees.
    ``logistic`` says that the output is half the log odds of class 1.
    """
    kind = json.loads(spark.read.text(f"{path}/metadata").first()[0])["class"].rsplit(".", 1)[1]
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    weights = spark.read.parquet(f"{path}/treesMetadata").select(F.col("_1").alias("treeID"), F.col("_3").alias("weight"))
    shares = kind.startswith("RandomForestClass")
    cover = F.aggregate("impurityStats", F.lit(0.0), lambda a, b: a + b) if shares else F.col("impurityStats")[0]
    value = F.col("impurityStats")[1] / cover if shares else F.col("prediction")
    scale = F.lit(1.0 / weights.count()) if kind.startswith("RandomForest") else F.col("weight")
    # An indicator splits by its two values: below and above a half, with the sides swapped where 1 goes left.
    pair, first = F.col("split.numCategories") == 2, F.get("split.leftCategoriesOrThreshold", F.lit(0))
    swap = pair & (first == 1.0)
    # One row per tree: the weights are shorter than the nodes of the model itself.
    return nodes.join(F.broadcast(weights), "treeID").select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"), F.col("split.featureIndex").alias("feature"),
        F.when(pair, 0.5).otherwise(first).alias("threshold"), F.when(pair, -1).otherwise(F.col("split.numCategories")).alias("categories"),
        F.when(swap, F.col("rightChild")).otherwise(F.col("leftChild")).alias("left"),
        F.when(swap, F.col("leftChild")).otherwise(F.col("rightChild")).alias("right"), cover.alias("cover"), (value * scale).alias("value"),
        F.lit(kind.startswith("GBTClass")).alias("logistic"))


def flat_trees(t: pd.DataFrame, width: int) -> Trees:
    """Arrays of a node table; their size is the model's, not the data's."""
    t = t.sort_values(["tree", "node"], ignore_index=True)
    if (t.categories >= 0).any():
        raise ValueError("splits on more than two categories are not supported")
    size = t.groupby("tree").size()
    first = (size.cumsum() - size).to_numpy()
    start = np.repeat(first, size)
    place = lambda c: np.where(c >= 0, c + start, -1)
    return Trees(t.feature.to_numpy(np.int64), t.threshold.fillna(math.nan).to_numpy(float), place(t.left.to_numpy(np.int64)),
                 place(t.right.to_numpy(np.int64)), t.cover.to_numpy(float), t.value.to_numpy(float), first, width)


def read_trees(model) -> Trees:
    """The node arrays of a fitted boosted or forest model, through its saved form."""
    spark = SparkSession.active()
    path = new_path(spark, "model")
    model.write().save(path)
    return flat_trees(node_table(spark, path).toPandas(), model.numFeatures)
