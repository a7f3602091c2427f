"""Readers and writers of sample, observation, prediction and report tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from emberline.config import Settings
from emberline.operators.clean import drop_configured
from emberline.operators.joins import is_small
from emberline.operators.scan import HOT_ROWS, row_rank, running_totals
from emberline.storage import by_partition, materialize

OBS_SCHEMA = "dataset string, pixel_id long, lat double, lon double, ts timestamp, band string, value double"

# Text columns hold JSON, whose quotes the exports double inside a quoted field.
CSV = {"header": True, "quote": '"', "escape": '"'}


# What texts of whole numbers look like, and how texts of any number begin. A cast that fails makes an error with its message, row by row, so
# only texts of this look are cast.
WHOLE, NUMBER_START = r"\A[\x00-\x20\x7f]*[+-]?[0-9]+[\x00-\x20\x7f]*\z", r"\A[\x00-\x20\x7f]*[+-]?[0-9.NnIi]"


def origin() -> list[Column]:
    """Where a row of a scan comes from: file, input split, and its place among the rows of its task."""
    return [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at")]


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the first line; raises when the path does not exist."""
    return spark.read.options(**CSV).csv(path).columns


def with_found_types(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Text columns as integers or numbers where every value parses, in one pass; all others stay text."""
    cols = [n for n, t in df.dtypes if t == "string" and n not in skip]
    if not cols:
        return df

    def kind(c: str) -> Column:
        v = F.col(f"`{c}`")
        whole = v.rlike(WHOLE) & v.try_cast("bigint").isNotNull()
        number = v.rlike(NUMBER_START) & v.try_cast("double").isNotNull()
        return F.max(F.when(v.isNull() | whole, 0).when(number, 1).otherwise(2))
    found = df.agg(*[kind(c).alias(str(i)) for i, c in enumerate(cols)]).first()
    kinds = {c: ("bigint", "double")[k] for c, k in zip(cols, found) if k in (0, 1)}  # no kind without a row
    return df.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns])


def load_samples(spark: SparkSession, path: str, settings: Settings = Settings(),
                 schema: StructType | str | None = None) -> DataFrame:
    """Sample CSV with header; configured columns dropped, a ``row_id`` added when absent, NaN read as NULL.

    Doubled quotes inside quoted fields are read as quotes. With a ``schema`` the file is read once, and files whose header
    differs from it are refused. Without, columns are typed by their values, so that dirty numbers such as ``[0.5]`` stay text
    for the cleaning step. Added ids number the rows 0, 1, 2, ... through the files in path order, however they are split.
    """
    names = csv_header(spark, path)
    reader = spark.read.options(**CSV, enforceSchema=False)
    df = reader.schema(schema or ", ".join(f"`{n}` string" for n in names)).csv(path)
    if "row_id" in df.columns:
        df = drop_configured(df, settings)
        return nan_to_null(with_found_types(df) if schema is None else df)
    df = drop_configured(df.select("*", *origin()), settings)
    if schema is None:
        df = with_found_types(df, skip=("__file",))
    return nan_to_null(file_order_ids(df))


def file_order_ids(df: DataFrame) -> DataFrame:
    """``row_id`` by file and line, from the ``origin`` columns of a scan. A first pass counts the rows of every input split; a row's id
    is the number of rows in the splits before its own plus its place there."""
    splits = df.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    splits = materialize(splits, "splits")
    before = running_totals(splits, [], [F.col("__file"), F.col("__block")], {"__upto": F.col("__n")}, bound=splits)
    before = before.select("__file", "__block", (F.col("__upto") - F.col("__n") - F.col("__first")).alias("__shift"))
    before = materialize(before, "shifts")
    out = df.join(F.broadcast(before) if is_small(before) else before, ["__file", "__block"])
    return out.select((F.col("__at") + F.col("__shift")).alias("row_id"), *[F.col(f"`{c}`") for c in df.columns if c not in ("__file", "__block", "__at")])


def dense_row_ids(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Renumber 0, 1, 2, ... in ``row_id`` order."""
    return row_rank(df, [], [F.col("row_id")], "_n", hot_rows).withColumn("row_id", F.col("_n") - 1).drop("_n")


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.select(*[F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`")
                       for c in df.columns])


def scan_observations(spark: SparkSession, path: str, dataset: str, bands: list[str], fmt: str = "parquet") -> DataFrame:
    """Observations of one collection and some bands; both choices are pushed to the scan."""
    reader = spark.read.schema(OBS_SCHEMA)
    df = reader.options(**CSV).csv(path) if fmt == "csv" else reader.parquet(path)
    return df.filter((F.col("dataset") == dataset) & F.col("band").isin(*bands))


def write_observations(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Observation store partitioned by dataset and day, so collection and date choices prune folders."""
    by_partition(df.withColumn("obs_date", F.to_date("ts")), "dataset", "obs_date").write.mode(mode).partitionBy("dataset", "obs_date").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**CSV).csv(path)


def write_yearly(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """One folder per year."""
    w = by_partition(df, "year").write.mode(mode).partitionBy("year")
    w.options(**CSV).csv(path) if fmt == "csv" else w.parquet(path)


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    write_csv(df, path, mode)


def write_zone_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Zone metadata, one folder per zone; other zones of an existing table stay."""
    by_partition(df, "ecozone").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("ecozone").json(path)


def write_text(df: DataFrame, path: str, column: str = "narrative", zone: str = "ecozone", mode: str = "overwrite") -> None:
    by_partition(df.select(F.col(column).alias("value"), zone), zone).write.mode(mode).partitionBy(zone).text(path)

