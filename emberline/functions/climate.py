"""Derived weather variables."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Magnus formula constants (kPa, degrees C).
MAGNUS_E0, MAGNUS_A, MAGNUS_B = 0.61094, 17.625, 243.04


def vapour_pressure(kelvin: Column) -> Column:
    t = kelvin - F.lit(273.15)
    return F.lit(MAGNUS_E0) * F.exp(t * MAGNUS_A / (t + MAGNUS_B))


def relative_humidity(temp_k: Column, dew_k: Column) -> Column:
    return 100 * vapour_pressure(dew_k) / vapour_pressure(temp_k)


def vapour_pressure_deficit(temp_k: Column, dew_k: Column) -> Column:
    return vapour_pressure(temp_k) - vapour_pressure(dew_k)


def wind_speed(mean_u: Column, mean_v: Column) -> Column:
    """Speed of the mean vector: average the components first, then call this."""
    return F.hypot(mean_u, mean_v)


def mean_temperature(tmax: Column, tmin: Column) -> Column:
    return (tmax + tmin) / 2


def is_forest(land_class: Column) -> Column:
    # Forest classes 1 to 5.
    return land_class.isin(1, 2, 3, 4, 5)
