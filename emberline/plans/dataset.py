"""Sample tables built from raster observations."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberline.functions.climate import relative_humidity, vapour_pressure_deficit, wind_speed
from emberline.functions.columns import calendar_fields, point_geojson
from emberline.operators.composites import (between_dates, daily_composite, drop_incomplete, period_composite,
                                            points_in_regions, stack_bands)
from emberline.operators.scan import row_rank


def daily_samples(obs: DataFrame, static: DataFrame, region: DataFrame, start: str, end: str,
                  ndvi_days: int = 16) -> DataFrame:
    """One row per pixel and day inside the region with all bands present.

    ``static`` holds ``pixel_id, latitude, longitude`` and the static layers. The observation scan starts
    ``ndvi_days`` early so that the first days see their past NDVI.
    """
    early = F.date_sub(F.lit(start).cast("date"), ndvi_days)
    inside = points_in_regions(static, region, key="pixel_id").select("pixel_id").distinct()
    static = static.join(inside, "pixel_id", "left_semi")
    daily = daily_composite(between_dates(obs, early, end), ndvi_days).filter(F.col("obs_date") >= F.lit(start).cast("date"))
    return drop_incomplete(stack_bands(static, daily).withColumns(calendar_fields(F.col("obs_date"))).drop("obs_date"))


def period_samples(obs: DataFrame, pixels: DataFrame, region: DataFrame, start: str, end: str,
                   tag: str | None = None) -> DataFrame:
    """One row per pixel for a whole period (``end`` exclusive)."""
    p = period_composite(obs, start, end)
    t, dew = F.col("temperature_2m"), F.col("dewpoint_temperature_2m")
    out = p.join(pixels.select("pixel_id", "latitude", "longitude"), "pixel_id").select(
        "pixel_id", "latitude", "longitude", "temperature_2m", F.col("total_precipitation").alias("total_precipitation_sum"),
        "volumetric_soil_water_layer_1", "NDVI",
        wind_speed(F.col("u_component_of_wind_10m"), F.col("v_component_of_wind_10m")).alias("wind_speed"),
        relative_humidity(t, dew).alias("relative_humidity"), vapour_pressure_deficit(t, dew).alias("vapor_pressure_deficit"),
        "fire_intensity", "fire_detected")
    inside = points_in_regions(pixels, region, key="pixel_id").select("pixel_id").distinct()
    out = drop_incomplete(out.join(inside, "pixel_id", "left_semi"))
    return out.withColumns({"geometry_json": point_geojson(F.col("latitude"), F.col("longitude")),
                            "date": F.lit(tag or f"{start[:4]}_{end[:4]}_aggregated")})




def with_row_ids(samples: DataFrame) -> DataFrame:
    """Add the ``row_id`` that training needs: 0, 1, 2, ... by pixel and, for daily rows, by year and day of year."""
    keys = [F.col(c) for c in ("pixel_id", "year", "doy") if c in samples.columns]
    return row_rank(samples, [], keys, "_n").withColumn("row_id", F.col("_n") - 1).drop("_n")
