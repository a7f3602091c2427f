"""Cleaning and feature engineering of the sample table."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from emberline.config import Settings
from emberline.functions.columns import kelvin_to_celsius, number_or_null, zero_is_missing
from emberline.operators.quantiles import medians
from emberline.operators.scan import HOT_ROWS, carry_forward


def q(name: str) -> str:
    return f"`{name}`"


def drop_configured(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return df.drop(*[c for c in settings.drop_cols if c in df.columns])


def drop_leakage(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return df.drop(*[c for c in settings.leakage_cols if c in df.columns])


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, StringType)]


def clean_brackets(df: DataFrame, keep_text: bool = False) -> DataFrame:
    """Strip ``[`` and ``]`` and parse numbers, column by column.

    Default: only columns where some value holds a bracket pair; what does not parse becomes NULL.
    ``keep_text``: every text column, kept as (stripped) text when any value does not parse.
    """
    cols = string_columns(df)
    if not cols:
        return df
    bare = {c: F.regexp_replace(q(c), r"[\[\]]", "") for c in cols}
    if keep_text:
        tests = [F.coalesce(F.bool_and(F.col(q(c)).isNull() | bare[c].try_cast("double").isNotNull()), F.lit(True))
                 for c in cols]
    else:
        tests = [F.coalesce(F.bool_or(F.col(q(c)).rlike(r"\[.*\]")), F.lit(False)) for c in cols]
    flags = df.select(*[t.alias(str(i)) for i, t in enumerate(tests)]).first()
    numeric = [c for c, hit in zip(cols, flags) if hit]
    out = {c: number_or_null(bare[c]) for c in numeric}
    if keep_text:
        out |= {c: bare[c] for c in cols if c not in numeric}
    return df.select(*[out[c].alias(c) if c in out else F.col(q(c)) for c in df.columns])


def fill_medians(df: DataFrame, cols: dict) -> DataFrame:
    """Replace columns by expressions whose NULLs take the exact median; one pass serves all columns."""
    if not cols:
        return df
    df = df.withColumns(cols)
    mids = medians(df, list(cols))
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(mids[c]).cast("double")) for c in cols})


def _target(df: DataFrame, target: str) -> dict:
    return {target: number_or_null(F.col(target))} if target in df.columns else {}


def _temperature(df: DataFrame) -> dict:
    name = "temperature_2m"
    return {name: zero_is_missing(number_or_null(F.col(name)))} if name in df.columns else {}


def fill_target(df: DataFrame, target: str = "fire_intensity") -> DataFrame:
    """Numeric-or-NULL target, NULL replaced by the exact median."""
    return fill_medians(df, _target(df, target))


def add_celsius(df: DataFrame) -> DataFrame:
    return df.withColumn("temp_c", kelvin_to_celsius(F.col("temperature_2m"))) if "temperature_2m" in df.columns else df


def fill_temperature(df: DataFrame) -> DataFrame:
    """Zero Kelvin means missing; missing takes the median of the rest. Adds ``temp_c``."""
    return add_celsius(fill_medians(df, _temperature(df)))


def scale_ndvi(df: DataFrame, scale: float = 10000.0) -> DataFrame:
    if "NDVI" not in df.columns:
        return df
    return (df.withColumn("NDVI", F.coalesce(number_or_null(F.col("NDVI")), F.lit(0.0)))
            .withColumn("ndvi_scaled", F.col("NDVI") / F.lit(float(scale))))


def vpd_wind(df: DataFrame) -> DataFrame:
    pair = ("vapor_pressure_deficit", "wind_speed")
    if not set(pair) <= set(df.columns):
        return df
    df = df.withColumns({c: F.coalesce(number_or_null(F.col(c)), F.lit(0.0)) for c in pair})
    return df.withColumn("vpd_wind_idx", F.col(pair[0]) * F.col(pair[1]))


def fill_coordinates(df: DataFrame, order: str = "row_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Latitude and longitude each carry their last value forward, then 0."""
    pair = ["latitude", "longitude"]
    if not set(pair) <= set(df.columns):
        return df
    df = df.withColumns({c: number_or_null(F.col(c)) for c in pair})
    gaps = df.filter(F.col("latitude").isNull() | F.col("longitude").isNull()).limit(1)
    if gaps.isEmpty():
        return df
    df = carry_forward(df, order, pair, hot_rows=hot_rows)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in pair})


def engineer_features(df: DataFrame, settings: Settings = Settings(), hot_rows: int = HOT_ROWS) -> DataFrame:
    """All cleaning steps in order; a step is skipped when its columns are absent."""
    df = clean_brackets(df)
    df = add_celsius(fill_medians(df, _target(df, settings.target_reg) | _temperature(df)))
    df = scale_ndvi(df, settings.ndvi_scale)
    df = vpd_wind(df)
    return fill_coordinates(df, hot_rows=hot_rows)


def null_shares(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Long table ``(column, null_share)``; one pass over the data."""
    cols = cols or df.columns
    wide = df.select(*[F.avg(F.col(q(c)).isNull().cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("null_share"))
                      for i, c in enumerate(cols)])
    return wide.select(F.explode(pairs).alias("_p")).select("_p.*")


def drop_mostly_null(df: DataFrame, limit: float = 0.8, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop columns whose share of NULLs is above ``limit``."""
    cols = [c for c in df.columns if c not in keep]
    bad = [r["column"] for r in null_shares(df, cols).filter(F.col("null_share") > limit).collect()]
    return df.drop(*bad)


def numeric_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> list[str]:
    return [n for n, t in df.dtypes if t in ("bigint", "double") and n not in keep]


def value_spans(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long table ``(column, low, high)``."""
    wide = df.select(*[f(q(c)).cast("double").alias(f"{n}{i}") for i, c in enumerate(cols)
                       for n, f in (("lo", F.min), ("hi", F.max))])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"lo{i}").alias("low"), F.col(f"hi{i}").alias("high"))
                      for i, c in enumerate(cols)])
    return wide.select(F.explode(pairs).alias("_p")).select("_p.*")


def drop_constant(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop integer and floating columns that hold a single value."""
    cols = numeric_columns(df, keep)
    if not cols:
        return df
    same = value_spans(df, cols).filter(F.col("low") == F.col("high")).collect()
    return df.drop(*[r["column"] for r in same])


def split_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """Numeric and categorical feature columns; other types take no part."""
    return numeric_columns(df, keep), [c for c in string_columns(df) if c not in keep]


def feature_matrix(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return df.drop(settings.target_class, settings.target_reg)


def clean_attribution_sample(df: DataFrame, keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Numbers only: coerce, drop all-NULL columns, fill the rest with the median."""
    cols = [c for c in df.columns if c not in keep]
    df = df.select(*keep, *[number_or_null(F.col(q(c))).alias(c) for c in cols])
    empty = {r["column"] for r in null_shares(df, cols).filter(F.col("null_share") >= 1.0).collect()}
    cols = [c for c in cols if c not in empty]
    mids = medians(df, cols) if cols else {}
    return df.select(*keep, *[F.coalesce(q(c), F.lit(mids[c])).alias(c) for c in cols])


def clean_map_frame(df: DataFrame, value: str | None = None) -> DataFrame:
    """Numeric coordinates (and value); rows where one is missing are dropped."""
    need = ["latitude", "longitude"] + ([value] if value else [])
    return df.withColumns({c: number_or_null(F.col(c)) for c in need}).dropna("any", subset=need)
