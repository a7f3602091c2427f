"""Scalar column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def number_or_null(c: Column) -> Column:
    """Text or number as double; unparsable text and NaN become NULL."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v), v)


def kelvin_to_celsius(c: Column) -> Column:
    return c - F.lit(273.15)


def zero_is_missing(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def unmask(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def shrink_longitude(lat: Column, lon: Column) -> Column:
    """East-west degrees shortened to the length they have at that latitude."""
    return lon * F.cos(F.radians(lat))


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance on a sphere of 6371 km."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = (F.pow(F.sin((p2 - p1) / 2), 2)
         + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2))
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def fire_severity(prob: Column, intensity: Column) -> Column:
    return prob * intensity


def fire_label(prob: Column, threshold: Column) -> Column:
    return (prob >= threshold).cast("int")


def clip_probability(p: Column, margin: float = 1e-6) -> Column:
    return F.greatest(F.lit(margin), F.least(p, F.lit(1 - margin)))


def smooth_label(y: Column, amount: float) -> Column:
    return y * (1 - amount) + amount / 2


def focal_loss(p: Column, y: Column, gamma: float = 2.0) -> Column:
    """Aggregate: mean focal loss of probabilities against (smoothed) labels."""
    bce = -(y * F.ln(p) + (1 - y) * F.ln(1 - p))
    return F.avg(F.pow(1 - F.exp(-bce), F.lit(float(gamma))) * bce)


def calendar_fields(ts: Column) -> dict[str, Column]:
    """Date text, year and zero-based day of year."""
    return {"date": F.date_format(ts, "yyyy-MM-dd"), "year": F.year(ts), "doy": F.dayofyear(ts) - 1}


def point_geojson(lat: Column, lon: Column) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))


def point_lat_lon(geojson: Column) -> dict[str, Column]:
    xy = F.from_json(geojson, "type string, coordinates array<double>")["coordinates"]
    return {"latitude": F.get(xy, F.lit(1)), "longitude": F.get(xy, F.lit(0))}


def title_label(file_name: Column) -> Column:
    """``roc_curve.csv`` -> ``Roc Curve``."""
    return F.initcap(F.regexp_replace(F.regexp_replace(file_name, r"\.[^.]*$", ""), "_", " "))


def zone_of_name(folder: Column) -> Column:
    """``zone_7`` -> 7, anything else NULL."""
    return F.when(folder.startswith("zone_"), F.get(F.split(folder, "_"), F.lit(1)).try_cast("int"))
