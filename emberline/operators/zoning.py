"""Zones: coarse k-means, density clusters inside, numbering, routing, profiles and screening."""
from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from emberline.config import Settings
from emberline.operators.joins import HOT_ROWS, join_lookup, join_small
from emberline.operators.scan import row_rank
from emberline.operators.spatial import cluster_points, route
from emberline.storage import materialize


def macro_k(n: int) -> int:
    return max(9, min(15, int(math.sqrt(n / 40000))))


def router_k(n: int) -> int:
    return max(20, int(math.sqrt(n) / 3))


def fit_macro_centres(df: DataFrame, k: int | None = None, seed: int = 42) -> list[tuple[float, float]]:
    """k-means centres on raw degrees; equal coordinates are one weighted point."""
    folded = df.groupBy("latitude", "longitude").agg(F.count(F.lit(1)).cast("double").alias("w"))
    pts = materialize(VectorAssembler(inputCols=["latitude", "longitude"], outputCol="features").transform(folded), "pts")
    k = k or macro_k(int(pts.agg(F.sum("w")).first()[0]))
    model = KMeans(k=k, seed=seed, weightCol="w").fit(pts)
    return [(float(a), float(b)) for a, b in model.clusterCenters()]


def nearest_centre(centres: list[tuple[float, float]]) -> Column:
    """Index of the closest centre; the first one on a tie."""
    options = [F.struct(((F.col("latitude") - a) * (F.col("latitude") - a)
                         + (F.col("longitude") - b) * (F.col("longitude") - b)).alias("d"), F.lit(i).alias("i"))
               for i, (a, b) in enumerate(centres)]
    return (F.least(*options) if len(options) > 1 else options[0])["i"]


def number_zones(clustered: DataFrame, min_rows: int, part: str = "part", hot_rows: int = HOT_ROWS,
                 weight: str | None = None) -> DataFrame:
    """``(part, cluster, n, zone)`` of the clusters with enough rows, counted through by part, then cluster."""
    kept = (clustered.filter(F.col("cluster").isNotNull()).groupBy(part, "cluster")
            .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n")).filter(F.col("n") >= min_rows))
    ranked = row_rank(kept, [], [F.col(part), F.col("cluster")], "zone", hot_rows)
    return ranked.withColumn("zone", (F.col("zone") - 1).cast("int"))


def extract_zones(df: DataFrame, settings: Settings = Settings(), k: int | None = None,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``macro_zone`` and ``ecozone`` to rows with ``row_id, latitude, longitude``."""
    centres = fit_macro_centres(df, k, settings.seed)
    df = df.withColumn("macro_zone", nearest_centre(centres))
    slim = materialize(df.select("row_id", "latitude", "longitude", "macro_zone"), "macro")
    large = slim.groupBy("macro_zone").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= settings.min_macro_rows)
    eligible = slim.join(F.broadcast(large.select("macro_zone")), "macro_zone", "left_semi")
    clusters = cluster_points(eligible, settings.eps_km, settings.min_samples, "macro_zone", hot_rows=hot_rows)
    zones = materialize(number_zones(clusters, settings.min_cluster_rows, hot_rows=hot_rows, weight="w"), "zones")
    if zones.isEmpty():
        return df.withColumn("ecozone", F.col("macro_zone"))
    refs = join_small(clusters, zones, ["part", "cluster"]).select(
        "latitude", "longitude", F.col("zone").alias("ecozone"), "w")
    return route(df, refs, settings.route_k, "ecozone", shrink=True, hot_rows=hot_rows, weight="w")


def assign_zones(df: DataFrame, router_points: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Route new rows by the stored labelled points: raw degrees, k from the number of points."""
    return route(df, router_points, router_k(router_points.count()), "ecozone", hot_rows=hot_rows)


def zone_rows(df: DataFrame, zone: int) -> DataFrame:
    return df.filter(F.col("ecozone") == zone)


def without_noise(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ecozone") != -1)


def zone_list(df: DataFrame) -> DataFrame:
    return without_noise(df).select("ecozone").distinct()


def zone_centroids(df: DataFrame) -> DataFrame:
    return without_noise(df).groupBy("ecozone").agg(
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))


def zone_profile(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows, classes, fires and dryness means of all zones in one pass; an absent column gives NULL."""
    y = F.col(settings.target_class)
    means = {"drought_index": "drought_index_mean", "vegetation_dryness": "vegetation_dryness_mean",
             "population_density": "population_density_mean"}
    return without_noise(df).groupBy("ecozone").agg(
        F.count(F.lit(1)).alias("samples"),
        (F.max((y == 1).cast("int")) + F.max((y != 1).cast("int"))).alias("classes"),
        F.count_if(y == 1).alias("fires"), F.avg((y == 1).cast("double")).alias("historical_fire_probability"),
        *[(F.avg(c) if c in df.columns else F.lit(None).cast("double")).alias(n) for c, n in means.items()])


# Zone status names and advice texts.
STATUS = {
    "small": "SKIPPED_SMALL_ZONE",
    "safe": "SAFE_ZONE",
    "mono": "no_fire_variation_detected",
    "micro": "micro_zone_insufficient_samples",
    "empty": "empty_zone_no_samples",
    "train": "TRAINABLE",
}
ADVICE = {
    "mono": "Zone lacks variability. Merge into ecologically nearest region.",
    "micro": "Merge this zone with nearest ecological match (similar dryness + population).",
}


def screen_zones(profile: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Status of every zone and the registry numbers of zones that need no model."""
    n, fires = F.col("samples"), F.col("fires")
    mono = F.col("classes") < 2
    status = (F.when(n == 0, STATUS["empty"]).when(n < settings.min_zone_rows, STATUS["small"])
              .when(mono, STATUS["safe"]).when(n < settings.min_train_rows, STATUS["micro"]).otherwise(STATUS["train"]))
    safe = F.col("status") == STATUS["safe"]
    advice = F.when(safe, ADVICE["mono"]).when(F.col("status") == STATUS["micro"], ADVICE["micro"])
    zero = F.when(safe, 0.0)
    return profile.withColumn("status", status).withColumns({
        "recommendation": advice, "pr_auc": F.when(safe, 1.0), "accuracy": F.when(safe, 1.0), "f2": zero,
        "precision": zero, "recall": zero, "tn": F.when(safe, F.when(fires == 0, n).otherwise(0)),
        "fp": F.when(safe, 0).cast("long"), "fn": F.when(safe, 0).cast("long"),
        "tp": F.when(safe, F.when(fires > 0, n).otherwise(0)), "thr": F.lit(0.5)})


def eligible_zones(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Zones with enough rows; smaller ones get neither a model nor a registry entry."""
    return zone_profile(df, settings).filter(F.col("samples") >= settings.min_zone_rows)


def remaining_zones(zones: DataFrame, done: DataFrame) -> DataFrame:
    return zones.join(done, "ecozone", "left_anti")


def with_centroids(zone_table: DataFrame, centroids: DataFrame) -> DataFrame:
    return zone_table.join(centroids, "ecozone", "left")


def reattach(rows: DataFrame, parts: list[DataFrame], key: str = "row_id") -> DataFrame:
    """Per-zone prediction tables put back next to their rows by ``row_id``."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rows.join(out, key, "left")
