"""Exact quantiles (linear interpolation) and most frequent values, per group and column."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from emberline.operators.joins import join_small
from emberline.operators.scan import HOT_ROWS, running_totals
from emberline.storage import materialize

# A sketch places a rank within one in so many.
ACCURACY = 10_000


def value_counts(df: DataFrame, cols: list[str], by: list[str], kind: str) -> DataFrame:
    """``(by, column, value, n)`` for the non-null values of ``cols``; repeated values are combined map-side."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(kind).alias("value")) for c in cols]))
    return (df.select(*by, pairs.alias("_p")).select(*by, "_p.column", "_p.value")
            .filter(F.col("value").isNotNull()).groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n")))


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], by: list[str] | None = None,
                    hot_rows: int = HOT_ROWS, accuracy: int | None = ACCURACY) -> DataFrame:
    """Long table ``(by, column, q0, q1, ...)`` with the exact quantile of each column for each probability.

    A first pass counts the values and brackets every wanted rank between two values of a sketch, whose rank error is at
    most one in ``accuracy``. A second pass counts the values between brackets as one bucket each, before the shuffle; only
    values inside a bracket, a few in ``accuracy`` of the rows, are shuffled and ranked. Groups too small for the sketch's
    margin are ranked whole, and all of them without an ``accuracy``, which is what brackets that miss a rank lead to.
    """
    by, ends = by or [], sorted({float(p) for p in probs})
    keys = [*by, "column"]
    margin = 2 / (accuracy or 1)
    share = [min(1.0, max(0.0, p + d)) for p in ends for d in (-margin, margin)]
    values = [F.col(f"`{c}`").cast("double") for c in cols]
    # One row per group: for each column the number of values, and the brackets where there are many.
    wide = df.groupBy(*by).agg(*[F.count(v).alias(f"_{i}") for i, v in enumerate(values)],
                               *[
        F.percentile_approx(v, share, accuracy).alias(f"_b{i}") for i, v in enumerate(values) if accuracy])
    bracket = [F.when(F.col(f"_{i}") > 10 * accuracy, F.col(f"_b{i}")) if accuracy else F.lit(None).cast("array<double>") for i in range(len(cols))]
    wide = materialize(wide.select(*by, *[F.col(f"_{i}") for i in range(len(cols))], *[b.alias(f"_b{i}") for i, b in enumerate(bracket)]), "sizes")
    sizes = wide.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("_size"), F.col(f"_b{i}").isNotNull().alias("_cut")) for i, c in enumerate(cols)])).alias("_s"))
    sizes = sizes.select(*by, "_s.*")
    # A bracket spans at most six in ``accuracy`` of the ranks: a bound on the values left to rank.
    left = F.when(F.col("_cut"), F.col("_size") * 3 * margin * len(ends) + len(ends) + 1).otherwise(F.col("_size"))
    largest, total, cut = sizes.agg(F.max(left), F.sum(left), F.bool_or("_cut")).first()
    counts = _bucket_counts(df, cols, values, wide, by, len(ends))
    run = running_totals(counts, keys, [F.col("bucket"), F.col("value")], {"upto": F.col("n")}, hot_rows, (int(largest or 0), int(total or 0)))
    ranked = join_small(run, sizes, keys) if by else run.join(F.broadcast(sizes), keys)
    picks = []
    for i, p in enumerate(probs):
        place = (F.col("_size") - 1) * F.lit(float(p))
        for edge, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            holds = (F.col("upto") > at) & (F.col("upto") - F.col("n") <= at)
            picks.append(F.max(F.when(holds, F.col("value"))).alias(f"_{edge}{i}"))
        picks.append(F.max(place - F.floor(place)).alias(f"_f{i}"))
    found = ranked.groupBy(*keys).agg(*picks)
    if cut:
        found = materialize(found, "picked")
        if not found.filter(reduce(Column.__or__, [F.col(f"_{e}{i}").isNull() for i in range(len(probs)) for e in ("lo", "hi")])).isEmpty():
            return exact_quantiles(df, cols, probs, by, hot_rows, None)
    return found.select(*keys, *[
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(f"q{i}")
        for i in range(len(probs))])


def _bucket_counts(df: DataFrame, cols: list[str], values: list, wide: DataFrame, by: list[str], brackets: int) -> DataFrame:
    """``(by, column, bucket, value, n)``: inside bracket ``bucket`` every value by itself, between brackets all of them as a null value
    before the next bracket; values above the last bracket are of no use."""
    slim = df.select(*by, *[v.alias(f"_c{i}") for i, v in enumerate(values)])
    cuts = wide.select(*by, *[f"_b{i}" for i in range(len(cols))])
    joined = join_small(slim, cuts, by) if by else slim.join(F.broadcast(cuts))
    pairs = []
    for i, c in enumerate(cols):
        v, b = F.col(f"_c{i}"), F.col(f"_b{i}")
        bucket = F.when(b.isNull(), 0)
        for k in range(brackets):
            bucket = bucket.when(v <= b[2 * k + 1], k)
        pairs.append(F.struct(F.lit(c).alias("column"), bucket.alias("bucket"), v.alias("value"), b.alias("b")))
    rows = joined.select(*by, F.explode(F.array(*pairs)).alias("_p")).filter("_p.value is not null and _p.bucket is not null")
    inside = F.col("_p.b").isNull() | (F.col("_p.value") >= F.get("_p.b", 2 * F.col("_p.bucket")))
    return rows.select(*by, "_p.column", "_p.bucket", F.when(inside, F.col("_p.value")).alias("value")).groupBy(
        *by, "column", "bucket", "value").agg(F.count(F.lit(1)).alias("n"))


def medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Driver dictionary of whole-table medians, one number per column."""
    found = {r["column"]: r["q0"] for r in exact_quantiles(df, cols, [0.5]).collect()}
    return {c: found.get(c) for c in cols}


def most_frequent(counts: DataFrame, by: list[str]) -> DataFrame:
    """``(by, column, value, n)`` of the most frequent value of counted values; ties take the smallest value."""
    best = counts.groupBy(*by, "column").agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("value"))).alias("_b"))
    return best.select(*by, "column", F.col("_b.value").alias("value"), (-F.col("_b.neg")).alias("n"))


def modes(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """The most frequent value of each column."""
    return most_frequent(value_counts(df, cols, by or [], "string"), by or [])
