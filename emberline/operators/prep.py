"""Screening, imputation, scaling and one-hot encoding, fitted on training rows for all zones at once."""
from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberline.operators.clean import split_columns
from emberline.operators.joins import join_small
from emberline.operators.quantiles import exact_quantiles, most_frequent, value_counts
from emberline.storage import materialize


@dataclass(frozen=True)
class Prep:
    """Fitted numbers of one group. Its categories stay in ``index``, a table ``(column, value)`` of all groups that is only
    read, for this group, when its indicator columns are built."""
    numeric: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    index: DataFrame | None = None

    @cached_property
    def categories(self) -> dict[str, list[str]]:
        """Sorted values of each categorical column; a value's place is its indicator's place."""
        out: dict[str, list] = {c: [] for c in self.modes}
        if self.modes:
            for r in self.index.filter(F.col("column").isin(*self.modes)).select("column", "value").collect():
                out[r["column"]].append(r["value"])
        return {c: sorted(v) for c, v in out.items()}

    @property
    def names(self) -> list[str]:
        return list(self.numeric) + [f"{c}={v}" for c, vals in self.categories.items() for v in vals]

    def columns(self) -> list[Column]:
        out = []
        for c, (mid, mean, std) in self.numeric.items():
            out.append(((F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(mid)) - mean) / std).alias(c))
        for c, vals in self.categories.items():
            filled = F.coalesce(F.col(f"`{c}`"), F.lit(self.modes[c]))
            out += [(filled == v).cast("double").alias(f"{c}={v}") for v in vals]
        return out

    def apply(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Wide prepared columns next to ``keep``, one expression per category: for a few categories."""
        return df.select(*keep, *self.columns())

    def stages(self, out: str = "features") -> list:
        """The same as persistable ML stages, so the saved model takes raw rows.

        Categories are looked up in their index and become sparse vectors, however many they are; unknown ones are all zero.
        """
        items = [f"(coalesce(cast(`{c}` as double), {mid!r}D) - {mean!r}D) / {std!r}D AS __x{i}" for i, (c, (mid, mean, std)) in enumerate(self.numeric.items())]
        items += [f"coalesce(cast(`{c}` as string), {_text(mode)}) AS __c{i}" for i, (c, mode) in enumerate(self.modes.items())]
        fill = SQLTransformer(statement=f"SELECT *, {', '.join(items)} FROM __THIS__")
        numbers, texts = [f"__x{i}" for i in range(len(self.numeric))], range(len(self.modes))
        if not self.modes:
            return [fill, VectorAssembler(inputCols=numbers, outputCol=out)]
        place, vector = [f"__i{i}" for i in texts], [f"__v{i}" for i in texts]
        index = [StringIndexerModel.from_labels(self.categories[c], f"__c{i}", place[i], "keep") for i, c in enumerate(self.modes)]
        # The encoder reads the numbers of categories from the index; the last one, for unknown values, has no column.
        known = SparkSession.active().createDataFrame([], ", ".join(f"__c{i} string" for i in texts))
        for stage in index:
            known = stage.transform(known)
        encode = OneHotEncoder(inputCols=place, outputCols=vector, dropLast=True).fit(known)
        return [fill, *index, encode, VectorAssembler(inputCols=numbers + vector, outputCol=out)]


def _text(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def screen_columns(df: DataFrame, by: list[str], numeric: list[str], categorical: list[str],
                   max_null: float = 0.8) -> dict[tuple, tuple[list[str], list[str]]]:
    """Usable columns per group: not mostly NULL, numeric ones not constant. One grouped pass."""
    cols = numeric + categorical
    aggs = [F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"n{i}") for i, c in enumerate(cols)]
    aggs += [(F.min(f"`{c}`") < F.max(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(numeric)]
    out = {}
    for r in df.groupBy(*by).agg(*aggs).collect():
        ok = {c for i, c in enumerate(cols) if r[f"n{i}"] <= max_null}
        out[tuple(r[b] for b in by)] = (
            [c for i, c in enumerate(numeric) if c in ok and r[f"v{i}"]], [c for c in categorical if c in ok])
    return out


def scale_stats(df: DataFrame, by: list[str], numeric: list[str]) -> DataFrame:
    """Long table ``(by, column, median, mean, std)``; mean and population deviation after filling."""
    mids = exact_quantiles(df, numeric, [0.5], by)
    wide = (mids.groupBy(*by).pivot("column", numeric).agg(F.first("q0")))
    wide = materialize(wide.select(*by, *[F.col(f"`{c}`").alias(f"_m{i}") for i, c in enumerate(numeric)]), "medians")
    slim = df.select(*by, *[F.col(f"`{c}`").cast("double").alias(f"_c{i}") for i, c in enumerate(numeric)])
    # Without groups the medians are a single row.
    j = join_small(slim, wide, by) if by else slim.join(F.broadcast(wide))
    aggs = []
    for i in range(len(numeric)):
        filled = F.coalesce(f"_c{i}", f"_m{i}")
        aggs += [F.first(f"_m{i}").alias(f"_m{i}"), F.avg(filled).alias(f"_a{i}"), F.stddev_pop(filled).alias(f"_s{i}")]
    g = j.groupBy(*by).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("median"), F.col(f"_a{i}").alias("mean"),
                              F.col(f"_s{i}").alias("std")) for i, c in enumerate(numeric)])
    return g.select(*by, F.explode(rows).alias("_r")).select(*by, "_r.*")


def fit_prep(train: DataFrame, by: list[str], numeric: list[str], categorical: list[str],
             max_null: float = 0.8) -> dict[tuple, Prep]:
    """Fitted preparation per group, keyed by the tuple of group values."""
    usable = screen_columns(train, by, numeric, categorical, max_null)
    stats: dict[tuple, dict] = {}
    if numeric:
        for r in scale_stats(train, by, numeric).collect():
            stats.setdefault(tuple(r[b] for b in by), {})[r["column"]] = (r["median"], r["mean"], r["std"] or 1.0)
    modes: dict[tuple, dict] = {}
    index = None
    if categorical:
        index = materialize(value_counts(train, categorical, by, "string"), "categories")
        for r in most_frequent(index, by).collect():
            modes.setdefault(tuple(r[b] for b in by), {})[r["column"]] = r["value"]
    out = {}
    for z, (nums, kinds) in usable.items():
        own = index
        for b, v in zip(by, z):
            own = own.filter(F.col(b).eqNullSafe(F.lit(v))) if own is not None else None
        out[z] = Prep({c: stats[z][c] for c in nums}, {c: modes[z][c] for c in kinds if c in modes.get(z, {})}, own)
    return out


def feature_columns(df: DataFrame, settings) -> tuple[list[str], list[str]]:
    """Feature columns of a sample table: targets, ids and leakage columns left out."""
    out = (settings.target_class, settings.target_reg, *settings.non_features, *settings.leakage_cols, "is_test")
    return split_columns(df, keep=out)
