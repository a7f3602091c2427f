"""Connected components of an undirected edge table."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberline.operators.joins import HOT_ROWS, join_lookup
from emberline.storage import materialize


def connected_components(vertices: DataFrame, edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(v, root)`` with the smallest vertex of each component; edges are ``(src, dst)``, one direction is enough.

    Rounds of neighbour minimum, hooking of the old root and pointer jumping; every round is written out.
    Roots gather many vertices, so lookups by root go through the hot-key join.
    """
    both = materialize(edges.select("src", "dst").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct(), "edges")
    if both.isEmpty():
        return vertices.select("v", F.col("v").alias("root"))
    labels = materialize(vertices.select("v", F.col("v").alias("root"), F.lit(True).alias("changed")), "labels")
    while True:
        near = (both.join(labels.select(F.col("v").alias("dst"), "root"), "dst")
                .groupBy("src").agg(F.min("root").alias("m")).withColumnRenamed("src", "v"))
        mine = labels.select("v", "root").join(near, "v", "left").select(
            "v", "root", F.least("root", F.coalesce("m", "root")).alias("m"))
        # A vertex and its old root both learn the smallest root seen.
        learnt = (mine.select("v", "m").unionByName(mine.select(F.col("root").alias("v"), "m"))
                  .groupBy("v").agg(F.min("m").alias("root")))
        learnt = materialize(learnt, "hooked")
        jump = learnt.select(F.col("v").alias("root"), F.col("root").alias("next"))
        new = join_lookup(learnt, jump, ["root"], hot_rows=hot_rows).select("v", F.col("next").alias("new"))
        labels = materialize(labels.select("v", F.col("root").alias("old")).join(new, "v").select(
            "v", F.col("new").alias("root"), (F.col("new") != F.col("old")).alias("changed")), "labels")
        if labels.filter("changed").limit(1).isEmpty():
            return labels.select("v", "root")
