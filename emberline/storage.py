"""Durable intermediate tables in the folder the cluster names.

Iterative operators cut their lineage by writing a table and reading it back, so a lost
executor re-reads files instead of replaying every round.
"""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_local_roots: dict[str, str] = {}
_tables: dict[str, list[str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application below ``spark.checkpoint.dir``."""
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return f"{root.rstrip('/')}/emberline-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_roots.setdefault(app, tempfile.mkdtemp(prefix="emberline-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; call it once the results are written."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    for table in _tables.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def materialize(df: DataFrame, name: str = "step", codec: str = "snappy") -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, *cols: str) -> DataFrame:
    """Write ``df`` once in buckets of the columns and return a scan of it: grouping or joining by them does not move its rows.

    The files lie with the other intermediate tables; the catalogue has the table until ``clear_scratch``.
    """
    spark = df.sparkSession
    table = f"`{spark.catalog.currentDatabase()}`.`emberline_{name}_{uuid.uuid4().hex}`"
    _tables.setdefault(spark.sparkContext.applicationId, []).append(table)
    buckets = max(1, min(buckets, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))))
    df.write.bucketBy(buckets, *cols).option("path", new_path(spark, name)).saveAsTable(table, format="parquet")
    return spark.table(table)


def by_partition(df: DataFrame, *cols: str) -> DataFrame:
    """Rows gathered by the columns a table is about to be partitioned by: its files follow the size of the data, not the number
    of tasks times partitions. Large partitions stay split over tasks, as the hint leaves their size to the adaptive planner."""
    return df.hint("rebalance", *[F.col(c) for c in cols])
