"""Class rebalancing: synthetic minority rows, edited neighbours, density-weighted synthesis, target rebalancing.

Input rows are ``row_id, features array<double>, label``. Random draws are hashes of row ids and counters, so a
recomputed task draws the same numbers.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.operators.clean import numeric_columns
from emberline.operators.joins import join_lookup
from emberline.operators.neighbours import nearest_rows
from emberline.operators.quantiles import exact_quantiles, medians
from emberline.operators.scan import HOT_ROWS, row_rank, running_totals
from emberline.operators.split import shuffle_key
from emberline.storage import materialize


def uniform(*parts: Column, seed: int) -> Column:
    """Repeatable draw in [0, 1)."""
    return F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(2 ** 52)) / float(2 ** 52)


def normal(*parts: Column, seed: int) -> Column:
    u = F.greatest(uniform(*parts, seed=seed), F.lit(1e-15))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * uniform(*parts, seed=seed + 1))


def class_sizes(df: DataFrame) -> dict[int, int]:
    return {int(r["label"]): r["n"] for r in df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}


def _fan_out(df: DataFrame, chunk: int = 10_000) -> DataFrame:
    """``quota`` numbered copies (``_j``) of each row; a large quota is spread over tasks chunk by chunk."""
    last = F.floor((F.col("quota") - 1) / chunk)
    parts = df.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition("row_id", "_c")
    end = F.least(F.col("quota"), (F.col("_c") + 1) * chunk) - 1
    return parts.withColumn("_j", F.explode(F.sequence(F.col("_c") * chunk, end))).drop("_c")


def _synthesise(df: DataFrame, near: DataFrame, quota: DataFrame, total: int, k: int, minority: int, seed: int) -> DataFrame:
    """``quota`` rows per minority ``row_id`` (column ``upto``: running end) on the line to a random neighbour."""
    spread = _fan_out(quota).withColumn("place", F.pmod(F.xxhash64("row_id", "_j", F.lit(seed)), F.lit(k)).cast("int"))
    u = uniform(F.col("row_id"), F.col("_j"), seed=seed + 1)
    ident = -(F.col("upto") - F.col("quota") + F.col("_j") + 1)
    # Ends are chosen before features are fetched. A few minority rows may be asked for most of the new ones: theirs are then broadcast.
    new = join_lookup(spread, near.select("row_id", "place", "neighbour"), ["row_id", "place"]).select("row_id", "neighbour", ident.alias("_id"), u.alias("_u"))
    new = materialize(new, "ends")
    new = join_lookup(new, df.select("row_id", "features"), ["row_id"])
    new = join_lookup(new, df.select(F.col("row_id").alias("neighbour"), F.col("features").alias("to")), ["neighbour"])
    mixed = F.zip_with("features", "to", lambda x, y: x + (y - x) * F.col("_u"))
    return new.select(F.col("_id").alias("row_id"), mixed.alias("features"), F.lit(minority).cast("int").alias("label"))


def _even_quota(rows: DataFrame, total: int, size: int, seed: int, hot_rows: int) -> DataFrame:
    ranked = row_rank(rows.select("row_id", shuffle_key(seed).alias("_h")), [], [F.col("_h"), F.col("row_id")], "_rn", hot_rows)
    extra = F.when(F.col("_rn") <= total % size, 1).otherwise(0)
    upto = F.col("_rn") * F.lit(total // size) + F.least(F.col("_rn"), F.lit(total % size))
    return ranked.select("row_id", (F.lit(total // size) + extra).cast("long").alias("quota"), upto.cast("long").alias("upto")
                         ).filter(F.col("quota") > 0)


def smote(df: DataFrame, k: int = 5, seed: int = 42, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Minority rows synthesised up to the size of the majority; raises when the minority has at most ``k`` rows."""
    df = df.select("row_id", "features", F.col("label").cast("int").alias("label"))
    sizes = class_sizes(df)
    if len(sizes) < 2:
        raise ValueError("two classes are needed")
    low = min(sizes, key=lambda c: (sizes[c], c))
    total = max(sizes.values()) - sizes[low]
    if total == 0:
        return df
    if sizes[low] <= k:
        raise ValueError("too few minority rows")
    small = materialize(df.filter(F.col("label") == low), "minority", "zstd")
    quota = _even_quota(small, total, sizes[low], seed, hot_rows)
    near = materialize(nearest_rows(small, small, k), "near")
    return df.unionByName(_synthesise(small, near, quota, total, k, low, seed))


def edited_neighbours(df: DataFrame, k: int = 3) -> DataFrame:
    """Keep a row only when its ``k`` nearest rows all have its class."""
    df = df.select("row_id", "features", F.col("label").cast("int").alias("label"))
    near = nearest_rows(df, df, k).groupBy("row_id").agg(
        F.min("neighbour_label").alias("_lo"), F.max("neighbour_label").alias("_hi"))
    return (df.join(near, "row_id").filter((F.col("_lo") == F.col("label")) & (F.col("_hi") == F.col("label")))
            .drop("_lo", "_hi"))


def smote_edited(df: DataFrame, seed: int = 42) -> DataFrame:
    return edited_neighbours(materialize(smote(df, seed=seed), "smote", "zstd"))


def adasyn(df: DataFrame, k: int = 5, seed: int = 42, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Synthetic minority rows in proportion to the majority share among each row's neighbours."""
    df = df.select("row_id", "features", F.col("label").cast("int").alias("label"))
    sizes = class_sizes(df)
    if len(sizes) < 2:
        raise ValueError("two classes are needed")
    low = min(sizes, key=lambda c: (sizes[c], c))
    total = max(sizes.values()) - sizes[low]
    if total == 0:
        return df
    if sizes[low] <= k:
        raise ValueError("too few minority rows")
    small = materialize(df.filter(F.col("label") == low), "minority", "zstd")
    hard = materialize(nearest_rows(small, df, k).groupBy("row_id").agg(
        F.avg((F.col("neighbour_label") != low).cast("double")).alias("r")), "hard")
    weight = hard.agg(F.sum("r")).first()[0]
    if not weight:
        raise ValueError("no minority row has majority neighbours")
    quota = hard.withColumn("quota", F.rint(F.col("r") / weight * total).cast("long")).filter(F.col("quota") > 0)
    quota = materialize(running_totals(quota, [], [F.col("row_id")], {"upto": F.col("quota")}, hot_rows), "quota")
    near = materialize(nearest_rows(small, small, k), "near")
    return df.unionByName(_synthesise(small, near, quota.select("row_id", "quota", "upto"), total, k, low, seed))


def rebalance(df: DataFrame, seed: int = 42) -> tuple[DataFrame, str]:
    """Synthetic rows plus editing; else density-weighted synthesis; else the input. Returns the method used."""
    for name, method in (("SMOTEENN", smote_edited), ("ADASYN", adasyn)):
        try:
            return materialize(method(df, seed=seed), "balanced"), name
        except ValueError:
            continue
    return df, "none"


def extreme_rows(df: DataFrame, target: str) -> DataFrame:
    """Rows at or beyond the 0.1 and 0.9 quantiles of the target."""
    r = exact_quantiles(df, [target], [0.1, 0.9]).first()
    return df.filter((F.col(target) >= r["q1"]) | (F.col(target) <= r["q0"]))


def extreme_noise(df: DataFrame, target: str, seed: int = 42, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add as many noisy rows as there are extreme rows; under 50 rows or under 5 extreme ones: unchanged.

    Numbers, texts and the target of an added row are drawn (with replacement) from independent extreme rows;
    numbers are multiplied by 1 + 0.05 N(0, 1).
    """
    if df.limit(50).count() < 50:
        return df
    rare = materialize(extreme_rows(df, target), "rare")
    n = rare.count()
    if n < 5:
        return df
    nums = [c for c in numeric_columns(df, keep=("row_id", target))]
    texts = [c for c in df.columns if c not in nums and c not in ("row_id", target)]
    pool = materialize(row_rank(rare, [], [F.col("row_id")], "_i", hot_rows), "pool")
    draw = df.sparkSession.range(n).select(F.col("id"), *[
        (F.floor(uniform(F.col("id"), seed=seed + s) * n) + 1).alias(f"_{p}") for s, p in ((0, "n"), (10, "t"), (20, "y"))])
    noisy = [(F.col(f"`{c}`") * (1 + 0.05 * normal(F.col("id"), F.lit(c), seed=seed + 30))).alias(c) for c in nums]
    # A drawn row may be asked for several times; the pool is unique per index, so the joins are balanced.
    out = draw.join(pool.select(F.col("_i").alias("_n"), *[f"`{c}`" for c in nums]), "_n").select("id", "_t", "_y", *noisy)
    out = out.join(pool.select(F.col("_i").alias("_t"), *[f"`{c}`" for c in texts]), "_t")
    out = out.join(pool.select(F.col("_i").alias("_y"), target), "_y").withColumn("row_id", -(F.col("id") + 1))
    kinds = dict(df.dtypes)
    return df.select(*[F.col(f"`{c}`").cast("double") if c in nums else F.col(f"`{c}`") for c in df.columns]).unionByName(
        out.select(*[F.col(f"`{c}`").cast("double" if c in nums else kinds[c]).alias(c) for c in df.columns]))


def rebalance_target(df: DataFrame, target: str = "y_log", seed: int = 42, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Regression rebalancing of ``row_id, features, target``: rows beyond the quartile fences and the rest come to
    equal shares; rare rows are repeated with small noise, common ones thinned. No rare rows: unchanged."""
    mid = medians(df, [target])[target]
    if mid is None:
        return df
    df = df.withColumn(target, F.coalesce(F.col(target).cast("double"), F.lit(mid)))
    r = exact_quantiles(df, [target], [0.25, 0.75]).first()
    reach = 1.5 * (r["q1"] - r["q0"])
    rare = (F.col(target) < r["q0"] - reach) | (F.col(target) > r["q1"] + reach)
    marked = materialize(df.withColumn("_rare", rare), "marked")
    sizes = {x["_rare"]: x["n"] for x in marked.groupBy("_rare").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_rare, n = sizes.get(True, 0), sum(sizes.values())
    if n_rare == 0 or n_rare * 2 >= n:
        return df
    few = marked.filter("_rare").drop("_rare")
    ranked = row_rank(marked.filter("NOT _rare").drop("_rare").withColumn("_h", shuffle_key(seed)), [],
                      [F.col("_h"), F.col("row_id")], "_rn", hot_rows)
    common = ranked.filter(F.col("_rn") <= n // 2).drop("_h", "_rn")
    quota = _even_quota(few, n - n // 2 - n_rare, n_rare, seed, hot_rows)
    copies = _fan_out(few.join(quota, "row_id"))
    noise = F.transform("features", lambda x, i: x + 0.02 * normal(F.col("row_id"), F.col("_j"), i, seed=seed))
    copies = copies.withColumn("features", noise).withColumn(
        "row_id", -(F.col("upto") - F.col("quota") + F.col("_j") + 1)).select(df.columns)
    return common.select(df.columns).unionByName(few.select(df.columns)).unionByName(copies)
