"""Joins that stay balanced when one key holds a large share of the rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A side is broadcast only after counting that it has at most this many rows.
BROADCAST_ROWS = 200_000
# Keys with more rows than this are joined apart; at most HOT_KEYS of them, the heaviest first.
HOT_ROWS = 1_000_000
HOT_KEYS = 1024


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``small`` when its counted size allows; else a shuffle join left to AQE."""
    return big.join(F.broadcast(small) if is_small(small, rows) else small, on, how)


def join_lookup(big: DataFrame, lookup: DataFrame, keys: list[str], weight: str | None = None,
                how: str = "inner", hot_rows: int = HOT_ROWS, sizes: DataFrame | None = None) -> DataFrame:
    """Join rows to a table that is unique per ``keys``; keys with many rows never meet in one task.

    The heaviest keys are found by counting and their few lookup rows are broadcast; all other keys take
    the shuffle join. ``weight`` names a column of ``sizes`` (by default of the lookup) that already
    holds the rows per key.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    if weight:
        heavy = (lookup if sizes is None else sizes).select(*keys, F.col(weight).alias("_n"))
    else:
        heavy = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = heavy.filter(F.col("_n") > hot_rows).orderBy(F.desc("_n")).limit(HOT_KEYS).collect()
    if not rows:
        return big.join(lookup, keys, how)
    schema = heavy.select(*keys).schema
    hot = F.broadcast(big.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in rows], schema))
    # A null key never matches, so a null-holding hot key simply stays on the shuffle side.
    hot_side = big.join(hot, keys, "left_semi").join(
        F.broadcast(lookup.join(hot, keys, "left_semi")), keys, how)
    rest = big.join(hot, keys, "left_anti").join(lookup.join(hot, keys, "left_anti"), keys, how)
    return rest.unionByName(hot_side.select(rest.columns))
