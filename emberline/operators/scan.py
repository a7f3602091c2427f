"""Ordered scans (running totals, ranks, carries, trailing rows) that split large groups.

A plain window puts a whole group in one task. When some group is larger than ``hot_rows`` the rows are
range-partitioned by (keys, order) instead, the part numbers are pinned by writing the table once, every part
is scanned on its own and the parts are stitched together with their (tiny) totals.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.operators.joins import join_lookup
from emberline.storage import materialize

HOT_ROWS = 1_000_000


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows of the largest group and of the whole table; counts are combined before the shuffle."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    r = sizes.agg(F.max("_n"), F.sum("_n")).first()
    return r[0] or 0, r[1] or 0


Bound = DataFrame | tuple[int, int] | None


def _split_hot(df: DataFrame, keys: list[str], order: list[Column], hot_rows: int, bound: Bound) -> DataFrame | None:
    """The table cut into pinned ranges (column ``_part``), or None when every group fits one task.

    ``bound`` may give the sizes (largest group, whole table), or a cheaper table whose groups are at least as large.
    """
    largest, total = bound if isinstance(bound, tuple) else group_sizes(df if bound is None else bound, keys)
    if largest <= hot_rows:
        return None
    spark = df.sparkSession
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // hot_rows))
    ranged = df.repartitionByRange(wanted, *[F.col(f"`{k}`") for k in keys], *order)
    return materialize(ranged.withColumn("_part", F.spark_partition_id()), "ranged")


def _same(a: DataFrame, b: DataFrame, names: list[str]):
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(f"a.`{n}`").eqNullSafe(F.col(f"b.`{n}`"))
    return a.alias("a").join(b.alias("b"), cond, "left")


def running_totals(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column],
                   hot_rows: int = HOT_ROWS, bound: Bound = None) -> DataFrame:
    """Add inclusive running sums per ``keys`` in ``order``; ``order`` must be unique inside a group."""
    parts = _split_hot(df, keys, order, hot_rows, bound)
    if parts is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})
    w = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (parts.groupBy(*keys, "_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
             .select(*keys, "_part", *[F.sum(n).over(before).alias(f"_base_{n}") for n in sums]))
    cols = df.columns + [n for n in sums if n not in df.columns]
    out = _same(local, bases, [*keys, "_part"])
    return out.select(*[
        (F.col(f"a.`{c}`") + F.coalesce(F.col(f"b.`_base_{c}`"), F.lit(0))).alias(c) if c in sums
        else F.col(f"a.`{c}`") for c in cols])


def row_rank(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank",
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """1-based row number per ``keys``."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("long")}, hot_rows)


def carry_forward(df: DataFrame, order: str, cols: list[str], keys: list[str] | None = None,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """Replace each NULL by the last non-null value before it; columns are carried on their own."""
    keys = keys or []
    parts = _split_hot(df, keys, [F.col(order)], hot_rows, None)
    if parts is None:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    w = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tails = (parts.groupBy(*keys, "_part")
             .agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols])
             .select(*keys, "_part", *[F.last(c, ignorenulls=True).over(before).alias(f"_tail_{c}") for c in cols]))
    out = _same(local, tails, [*keys, "_part"])
    return out.select(*[
        F.coalesce(F.col(f"a.`{c}`"), F.col(f"b.`_tail_{c}`")).alias(c) if c in cols else F.col(f"a.`{c}`")
        for c in df.columns])


def trailing_rows(df: DataFrame, keys: list[str], order: str, value: Column, length: int, name: str = "sequence",
                  chunk: int = 100_000, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the array of ``value`` over the last ``length`` rows, oldest first.

    A large group is cut in chunks of consecutive rows; each chunk also gets the last ``length - 1`` rows of
    the one before it, so no task needs the whole group.
    """
    halo = length - 1
    if group_sizes(df, keys)[0] <= hot_rows:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-halo, 0)
        return df.withColumn(name, F.collect_list(value).over(w))
    chunk = max(chunk, length)
    ranked = row_rank(df, keys, [F.col(order)], "_rn", hot_rows)
    home = F.floor((F.col("_rn") - 1) / chunk)
    place = (F.col("_rn") - 1) % chunk
    spread = ranked.withColumn("_chunk", F.explode(
        F.when(place >= chunk - halo, F.array(home, home + 1)).otherwise(F.array(home))))
    w = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(-halo, 0)
    return (spread.withColumn(name, F.collect_list(value).over(w))
            .filter(F.col("_chunk") == home).drop("_rn", "_chunk"))


def padded_sequences(df: DataFrame, keys: list[str], order: str, value: Column, length: int, zero: Column,
                     name: str = "sequence", chunk: int = 100_000, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Trailing windows brought to min(``length``, rows of the group) by ``zero`` on the left."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    seq = trailing_rows(df, keys, order, value, length, name, chunk, hot_rows)
    seq = join_lookup(seq, sizes, keys, "_size", hot_rows=hot_rows)
    pad = F.array_repeat(zero, (F.least(F.lit(length), F.col("_size")) - F.size(name)).cast("int"))
    return seq.withColumn(name, F.concat(pad, F.col(name))).select(*df.columns, name)
