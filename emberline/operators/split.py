"""Hold-outs, folds and seeded samples; random order is a hash of ``row_id``, so reruns and retries agree."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.operators.joins import join_small
from emberline.operators.scan import HOT_ROWS, row_rank
from emberline.storage import materialize

# Shares that a group is cut in when its first rows are sought.
SALTS = 256
# A slice of the 32-bit hash has so many bits.
SLICE_BITS = 20


def shuffle_key(seed: int, key: str = "row_id") -> Column:
    """Multiplicative hash of the row id in 64-bit arithmetic."""
    return (F.pmod(F.col(key), F.lit(2147483648)) * F.lit(2654435761) + F.lit(seed)) % F.lit(4294967296)


def test_quotas(df: DataFrame, by: list[str], label: str, share: float) -> DataFrame:
    """Test rows per class: ceil(share * n) in all, classes by largest remainder; a class of one row gets none."""
    sizes = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by)
    total = F.sum("_n").over(w)
    sizes = sizes.withColumn("_test", F.ceil(total * F.lit(share))).withColumn("_total", total)
    exact = F.col("_n") * F.col("_test") / F.col("_total")
    sizes = sizes.withColumn("_base", F.floor(exact)).withColumn("_rest", exact - F.col("_base"))
    sizes = sizes.withColumn("_short", F.col("_test") - F.sum("_base").over(w))
    place = F.row_number().over(w.orderBy(F.desc("_rest"), label))
    quota = F.col("_base") + F.when(place <= F.col("_short"), 1).otherwise(0)
    return sizes.withColumn("_quota", F.when(F.col("_n") > 1, quota).otherwise(0)).select(*by, label, "_quota")


def stratified_holdout(df: DataFrame, by: list[str], label: str, share: float = 0.2, seed: int = 42,
                       key: str = "row_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``is_test``; exact class quotas inside every group. The last test row of each class is sought, so rows are not shuffled."""
    keys = [*by, label]
    quotas = materialize(test_quotas(df, by, label, share), "quotas")
    last = _last_rows(df, keys, quotas, seed, key)
    if last is None:
        ranked = row_rank(df.withColumn("_h", shuffle_key(seed, key)), keys, [F.col("_h"), F.col(key)], "_rn", hot_rows)
        out = join_small(ranked, quotas, keys)
        return out.withColumn("is_test", F.col("_rn") <= F.col("_quota")).select(*df.columns, "is_test")
    out = join_small(df.withColumns(_place(seed, key)), last, keys)
    inside = (F.col("_h") < F.col("_last_h")) | ((F.col("_h") == F.col("_last_h")) & (F.col("_k") <= F.col("_last_k")))
    return out.withColumn("is_test", F.coalesce(inside, F.lit(False))).select(*df.columns, "is_test")


def _place(seed: int, key: str) -> dict[str, Column]:
    """Hash and row id, by which rows are ordered; nulls come first."""
    return {"_h": F.coalesce(shuffle_key(seed, key), F.lit(-1)), "_k": F.coalesce(F.col(key), F.lit(-(2 ** 63)))}


def _last_rows(df: DataFrame, keys: list[str], quotas: DataFrame, seed: int, key: str) -> DataFrame | None:
    """``(keys, _last_h, _last_k)``: the place of each group's last row within its quota, nulls for a quota of none.

    Slices of the hash are counted, and only the slice that holds the row is ranked. None if a row id that repeats straddles a quota.
    """
    rows = df.select(*keys, *[c.alias(n) for n, c in _place(seed, key).items()]).withColumn("_slice", F.shiftright("_h", SLICE_BITS))
    counts = join_small(rows.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n")), quotas, keys)
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("_rest", F.col("_quota") - upto + F.col("_n")).filter((F.col("_rest") > 0) & (F.col("_rest") <= F.col("_n")))
    edge = materialize(counts.select(*keys, "_slice", "_rest"), "edge")
    w = Window.partitionBy(*keys).orderBy("_h", "_k")
    again = (F.lead("_h").over(w) == F.col("_h")) & (F.lead("_k").over(w) == F.col("_k"))
    ranked = join_small(rows, edge, [*keys, "_slice"]).withColumns({"_rn": F.row_number().over(w), "_again": F.coalesce(again, F.lit(False))})
    last = materialize(ranked.filter("_rn = _rest").select(*keys, F.col("_h").alias("_last_h"), F.col("_k").alias("_last_k"), "_again"), "last")
    if not last.filter("_again").isEmpty():
        return None
    return quotas.join(last, keys, "left").drop("_quota", "_again")


def random_holdout(df: DataFrame, by: list[str], share: float = 0.25, seed: int = 42, key: str = "row_id",
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    one = df.withColumn("_all", F.lit(0))
    return stratified_holdout(one, by, "_all", share, seed, key, hot_rows).drop("_all")


def ordered_holdout(df: DataFrame, by: list[str], order: str = "year", share: float = 0.2, key: str = "row_id",
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """Temporal variant: the latest rows by ``order`` are the test rows."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    ranked = row_rank(df, by, [F.desc(order), F.desc(key)], "_rn", hot_rows)
    out = join_small(ranked, sizes, by) if by else ranked.join(F.broadcast(sizes))
    return out.withColumn("is_test", F.col("_rn") <= F.ceil(F.col("_n") * F.lit(share))).select(*df.columns, "is_test")


def stratified_folds(df: DataFrame, by: list[str], label: str, folds: int = 5, repeats: int = 1, seed: int = 42,
                     key: str = "row_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per input row and repeat with its ``fold``; class shares are equal in all folds."""
    spread = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    mixed = (F.pmod(F.col(key), F.lit(2147483648)) * F.lit(2654435761) + (F.col("repeat") + 1) * F.lit(seed * 7919)
             ) % F.lit(4294967296)
    # Another multiplier per repeat, so that repeats order the rows differently.
    mixed = (mixed * (F.lit(40503) + 2 * F.col("repeat"))) % F.lit(4294967296)
    ranked = row_rank(spread.withColumn("_h", mixed), [*by, "repeat", label], [F.col("_h"), F.col(key)], "_rn", hot_rows)
    return ranked.withColumn("fold", ((F.col("_rn") - 1) % folds).cast("int")).drop("_rn", "_h")


def _smallest(df: DataFrame, by: list[str], n: int, order: list[Column], key: str, salts: int) -> DataFrame:
    """The first ``n`` rows per group in ``order``, in two steps: those of every salted share of a group, then of the shares' first
    rows. No task sorts a whole group, whatever ``n`` is."""
    share = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)))
    part = share.withColumn("_rn", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))).filter(F.col("_rn") <= n)
    return part.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn", "_salt")


def first_rows(df: DataFrame, by: list[str], n: int, key: str = "row_id", salts: int = SALTS) -> DataFrame:
    """The first ``n`` rows per group; at most ``n`` rows of each share of a group meet."""
    return _smallest(df, by, n, [F.col(key)], key, salts)


def seeded_sample(df: DataFrame, by: list[str], n: int, seed: int = 42, key: str = "row_id", salts: int = SALTS) -> DataFrame:
    """``n`` rows per group without replacement."""
    return _smallest(df, by, n, [shuffle_key(seed, key), F.col(key)], key, salts)


def class_sample(df: DataFrame, label: str, n: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """About ``n`` original rows in their class shares, by the seeded hash; at least one row of every class.

    Rows with a negative id are synthetic: they neither count nor enter, unless a class has no other row.
    """
    original = F.col(key) >= 0
    sizes = df.groupBy(label).agg(F.count(F.when(original, 1)).alias("n")).orderBy(label).collect()
    total = max(1, sum(r["n"] for r in sizes))
    # Every task keeps its first rows only; a plain window would sort a whole class in one task.
    parts = [df.filter(F.col(label).eqNullSafe(F.lit(r[label]))).orderBy(~original, shuffle_key(seed, key), key)
             .limit(max(1, min(r["n"], n * r["n"] // total))) for r in sizes]
    return reduce(DataFrame.unionByName, parts, df.limit(0))


def yearly_order(df: DataFrame, key: str = "row_id") -> DataFrame:
    return df.orderBy("year", key)
