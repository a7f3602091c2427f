"""Raster observation tables: composites, calendars, band stacks, region sampling."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.functions.climate import is_forest, relative_humidity, wind_speed
from emberline.operators.joins import BROADCAST_ROWS, join_small
from emberline.operators.scan import row_rank
from emberline.storage import materialize


def between_dates(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Half-open ``[start, end)``; a plain range predicate that reaches the scan."""
    return df.filter((F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(end).cast("timestamp")))


def calendar(spark, start: str, end: str) -> DataFrame:
    """One row per day of ``[start, end)``."""
    days = F.sequence(F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 1))
    return spark.range(1).select(F.explode(days).alias("obs_date"))


def of_band(band: str, value: str = "value") -> Column:
    return F.when(F.col("band") == band, F.col(value))


def daily_bands(obs: DataFrame) -> DataFrame:
    """One row per pixel and day with every daily reduction, in one pass over the observations."""
    return obs.groupBy("pixel_id", F.to_date("ts").alias("obs_date")).agg(
        F.avg(of_band("temperature_2m")).alias("temperature_2m"),
        F.avg(of_band("dewpoint_temperature_2m")).alias("dewpoint"),
        F.sum(of_band("total_precipitation")).alias("total_precipitation"),
        F.avg(of_band("volumetric_soil_water_layer_1")).alias("soil_moisture"),
        F.avg(of_band("u_component_of_wind_10m")).alias("mean_u"),
        F.avg(of_band("v_component_of_wind_10m")).alias("mean_v"),
        F.sum(of_band("NDVI")).alias("ndvi_sum"),
        F.count(of_band("NDVI")).alias("ndvi_n"),
        F.coalesce(F.sum((of_band("BurnDate") > 0).cast("long")), F.lit(0)).alias("fire_count"),
    )


def with_causal_ndvi(daily: DataFrame, days: int = 16, scale: float = 10000.0) -> DataFrame:
    """Mean NDVI of the ``days`` days before each date, the date itself excluded.

    Works on the pixel-day table, where a pixel has at most one row per calendar day, so the window stays small
    however many raw observations a pixel has.
    """
    day = F.datediff(F.col("obs_date"), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy("pixel_id").orderBy("_day").rangeBetween(-days, -1)
    return (daily.withColumn("_day", day)
            .withColumn("NDVI", F.try_divide(F.sum("ndvi_sum").over(w), F.sum("ndvi_n").over(w) * F.lit(float(scale))))
            .drop("_day"))


def daily_composite(obs: DataFrame, days: int = 16, ndvi_scale: float = 10000.0) -> DataFrame:
    """Daily weather, humidity, wind, fire and causal NDVI per pixel."""
    d = with_causal_ndvi(daily_bands(obs), days, ndvi_scale)
    return d.select(
        "pixel_id", "obs_date", "temperature_2m", "total_precipitation", "soil_moisture",
        wind_speed(F.col("mean_u"), F.col("mean_v")).alias("wind_speed"),
        relative_humidity(F.col("temperature_2m"), F.col("dewpoint")).alias("relative_humidity"),
        "NDVI", "fire_count", (F.col("fire_count") > 0).cast("int").alias("fire_detected"))


def daily_fire(obs: DataFrame, start: str, end: str) -> DataFrame:
    """Fire count and flag for every day and pixel of the period, 0 where nothing was seen."""
    fires = (between_dates(obs.filter(F.col("band") == "BurnDate"), start, end)
             .groupBy("pixel_id", F.to_date("ts").alias("obs_date"))
             .agg(F.sum((F.col("value") > 0).cast("long")).alias("fire_count")))
    # Every pixel of the region gets every date; the calendar is a short sequence exploded in place, not a join.
    days = F.sequence(F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 1))
    grid = obs.select("pixel_id").distinct().withColumn("obs_date", F.explode(days))
    n = F.coalesce(F.col("fire_count"), F.lit(0))
    return (grid.join(fires, ["pixel_id", "obs_date"], "left")
            .withColumns({"fire_count": n, "fire_detected": (n > 0).cast("int")}))


def period_composite(obs: DataFrame, start: str, end: str) -> DataFrame:
    """Whole-period weather means, unmasked NDVI mean and fire sum per pixel."""
    fire = F.coalesce(F.sum((of_band("BurnDate") > 0).cast("long")), F.lit(0))
    masked_ndvi = F.when(F.col("band") == "NDVI", F.coalesce(F.col("value"), F.lit(0.0)))
    unmasked = {n: F.coalesce(F.avg(of_band(n)), F.lit(0.0)) for n in (
        "temperature_2m", "dewpoint_temperature_2m", "total_precipitation", "volumetric_soil_water_layer_1",
        "u_component_of_wind_10m", "v_component_of_wind_10m")}
    return between_dates(obs, start, end).groupBy("pixel_id").agg(
        *[c.alias(n) for n, c in unmasked.items()], F.avg(masked_ndvi).alias("NDVI"),
        fire.alias("fire_intensity"), (fire > 0).cast("int").alias("fire_detected"))


def grid_downsample(pixels: DataFrame, cell: float, values: list[str]) -> DataFrame:
    """Mean of the fine pixels inside each coarse latitude/longitude cell."""
    return pixels.groupBy(
        F.floor(F.col("latitude") / cell).alias("cell_y"), F.floor(F.col("longitude") / cell).alias("cell_x"),
    ).agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("n"))


def forest_fraction(pixels: DataFrame, cell: float, land_class: str = "land_class") -> DataFrame:
    share = pixels.withColumn("forest_fraction", is_forest(F.col(land_class)).cast("double"))
    return grid_downsample(share, cell, ["forest_fraction"])


def first_image(obs: DataFrame, start: str, end: str, keys: list[str] | None = None) -> DataFrame:
    """Earliest value in the period."""
    keys = keys or ["pixel_id", "band"]
    return between_dates(obs, start, end).groupBy(*keys).agg(
        F.min("ts").alias("ts"), F.min_by("value", F.struct("ts", "value")).alias("value"))


def stack_bands(static: DataFrame, daily: DataFrame, key: str = "pixel_id") -> DataFrame:
    """Static layers next to the daily ones; a pixel without one of the layers is lost."""
    return join_small(daily, static, key)


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def polygon_edges(vertices: DataFrame) -> DataFrame:
    """Closed rings ``(region, ring, seq, lon, lat)`` as edges."""
    ring = ["region", "ring"]
    v = row_rank(vertices.select(*ring, "seq", "lon", "lat"), ring, [F.col("seq")], "_i").drop("seq")
    v = join_small(v, vertices.groupBy(*ring).agg(F.count(F.lit(1)).alias("_n")), ring)
    here = v.select(*ring, (F.col("_i") % F.col("_n") + 1).alias("_i"), F.col("lon").alias("x1"), F.col("lat").alias("y1"))
    there = v.select(*ring, "_i", F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    return here.join(there, [*ring, "_i"]).select("region", "x1", "y1", "x2", "y2")


def cell_cover(vertices: DataFrame, size: float) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Square cells of the regions: ``inside`` (whole cells), ``open`` cells with the parity of the edges that cross all of the cell's
    latitudes further east, and the other ``edges`` that a point of an open cell has to be held against.

    The last value bounds the rows of each table. A cell without edges is settled as a whole unless an edge that ends inside its band lies to the east. A cell is
    ``(region, band, col)``; the number of edges of a cell does not depend on how many other cells the region has.
    """
    cell, slack = ["region", "band", "col"], 1e-6
    e = polygon_edges(vertices).filter(F.col("y1") != F.col("y2"))
    south, north = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = e.withColumn("band", F.explode(F.sequence(F.floor(south / size), F.floor(north / size))))
    low, high = F.col("band") * size, (F.col("band") + 1) * size
    at = lambda y: (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    ends = at(F.greatest(south, low)), at(F.least(north, high))
    # A little more than what the edge touches, so that rounding never settles a cell that a point may see otherwise.
    e = e.withColumns({"spans": (south <= low - slack) & (north >= high + slack), "west": F.floor((F.least(*ends) - slack) / size),
                       "east": F.floor((F.greatest(*ends) + slack) / size)})
    e = materialize(e, "edges")
    line = ["x1", "y1", "x2", "y2"]
    own = e.select("region", "band", F.explode(F.sequence("west", "east")).alias("col"), *line)
    touched = own.select(*cell).distinct()
    starts = e.groupBy("region", "band", F.col("west").alias("col")).agg(F.count_if("spans").alias("_s"), F.count_if(~F.col("spans")).alias("_p"))
    further = Window.partitionBy("region", "band").orderBy(F.desc("col"))
    beyond = further.rowsBetween(Window.unboundedPreceding, -1)
    # Every edge starts in a touched cell; sums over the cells east of each one.
    cells = touched.join(starts, cell, "left").select(*cell, F.lead("col").over(Window.partitionBy("region", "band").orderBy("col")).alias("_next"),
                                                      F.coalesce(F.sum("_s").over(beyond), F.lit(0)).alias("base"), F.coalesce(F.sum("_p").over(beyond), F.lit(0)).alias("_ending"))
    cells = materialize(cells, "cells")
    gaps = cells.filter(F.col("_next") > F.col("col") + 1).withColumn("col", F.explode(F.sequence(F.col("col") + 1, F.col("_next") - 1)))
    inside = gaps.filter((F.col("_ending") == 0) & (F.col("base") % 2 == 1)).select(*cell)
    open_ = cells.unionByName(gaps.filter(F.col("_ending") > 0)).select(*cell, "base", "_ending")
    # Edges that end inside the band count or not by a point's latitude, for all open cells west of them.
    ending = e.filter("NOT spans").select("region", "band", F.col("west").alias("_west"), *line)
    more = open_.filter("_ending > 0").select(*cell).join(ending, ["region", "band"]).filter("_west > col").drop("_west")
    columns = F.greatest(F.coalesce(F.col("_next"), F.col("col") + 1) - F.col("col"), F.lit(1))
    rows = (e.agg(F.sum(F.col("east") - F.col("west") + 1)).first()[0] or 0) + (cells.agg(F.sum(columns * (1 + F.col("_ending")))).first()[0] or 0)
    return inside, open_.drop("_ending"), own.unionByName(more.select(*own.columns)), rows


def points_in_regions(points: DataFrame, vertices: DataFrame, band_degrees: float = 0.25,
                      key: str = "row_id") -> DataFrame:
    """``(row_id, region)`` pairs by ray-crossing parity.

    Points of a cell inside a region need no edge; those of an open cell meet the edges of their cell only.
    """
    inside, open_, edges, rows = cell_cover(vertices, band_degrees)
    inside, open_, edges = (F.broadcast(t) if rows <= BROADCAST_ROWS else t for t in (inside, open_, edges))
    p = points.select(key, "latitude", "longitude", F.floor(F.col("latitude") / band_degrees).alias("band"), F.floor(F.col("longitude") / band_degrees).alias("col"))
    straddles = (F.col("y1") > F.col("latitude")) != (F.col("y2") > F.col("latitude"))
    x_at = (F.col("x2") - F.col("x1")) * (F.col("latitude") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    asked = p.join(open_, ["band", "col"])
    met = asked.join(edges.withColumnsRenamed({"region": "_r", "band": "_b", "col": "_c"}), (F.col("region") == F.col("_r")) & (F.col("band") == F.col("_b"))
                     & (F.col("col") == F.col("_c")) & straddles & (F.col("longitude") < x_at), "left")
    odd = met.groupBy(key, "region").agg(((F.max("base") + F.count("_r")) % 2 == 1).alias("_in")).filter("_in").select(key, "region")
    return p.join(inside, ["band", "col"]).select(key, "region").unionByName(odd)


def sample_region(pixels: DataFrame, vertices: DataFrame, key: str = "row_id") -> DataFrame:
    """Complete pixels that lie in some region; ``region`` is added."""
    return drop_incomplete(pixels.join(points_in_regions(pixels, vertices, key=key), key))
