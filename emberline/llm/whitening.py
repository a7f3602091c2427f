"""Embedding whitening: components of the covariance by FEAST contour integration, then one projection of every row.

Spark adds up the moments and the covariance of the distinct vectors (one small matrix a task, summed by cell) and projects
the rows. The driver holds one matrix of the dimension's size, whatever the number of rows. Its eigenvalues are counted
by the inertia of shifted matrices; the spectrum is cut in its gaps; inside each cut a quadrature of shifted complex solves
projects on the eigenspace, Rayleigh-Ritz extracts the components, and the counts prove that none is missing.
"""
from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberline.llm.words import bounded_batches, column
from emberline.storage import materialize

SCALE = 256
# Points on the upper half of a contour, components sought in one interval, refinements of one interval.
NODES, SLICE, ROUNDS = 8, 8, 40
BATCH_ROWS = 4096


def steps(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, x)`` of the rows without null or non-finite entries: x is floor(256 * entry) as long, at the long range's ends
    where it would go beyond."""
    c = F.transform(F.col(vector), lambda e: e.cast("double"))
    bad = F.exists("_c", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), c.alias("_c")).filter(F.col("_c").isNotNull()).filter(~bad)
    return rows.select("vec_id", F.transform("_c", lambda e: F.floor(e * SCALE).cast("long")).alias("x"))


def _matrix(b: pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors of a batch as rows; shorter ones end in zeros."""
    x = column(pa.Table.from_batches([b]), "x")
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(x.offsets.to_numpy()).astype(np.int64)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _exact_sum(x: np.ndarray) -> list[int]:
    if x.size and float(np.abs(x.astype(float)).max()) * len(x) >= 2 ** 62:
        x = x.astype(object)
    return [int(v) for v in x.sum(axis=0)]


def moments(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and their exact sum in every dimension."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for b in batches:
            n += b.num_rows
            total = [s + t for s, t in zip(total, _exact_sum(_matrix(b, width)))]
        yield pa.record_batch([pa.array(range(-1, width), pa.int32()), pa.array([Decimal(v) for v in [n, *total]], pa.decimal128(38, 0))], ["i", "s"])
    got = fit.mapInArrow(add, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").cast("string").alias("s")).collect()
    found = {r.i: int(r.s) for r in got}
    return found.get(-1, 0), [found.get(i, 0) for i in range(width)]


def covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor n; rows are centred before they are multiplied, every task sends one matrix."""
    width, mean = len(sums), np.array([s / n for s in sums])
    upper = np.triu_indices(width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            z = _matrix(b, width) - mean
            total += z.T @ z
        cells = total[upper]
        for k in range(0, len(cells), 1 << 16):
            part = cells[k:k + (1 << 16)]
            yield pa.record_batch([pa.array(np.arange(k, k + len(part), dtype=np.int32)), pa.array(part)], ["cell", "v"])
    cells = fit.mapInArrow(add, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((width, width))
    out[upper[0][cells.cell], upper[1][cells.cell]] = cells.v / n
    return np.triu(out) + np.triu(out, 1).T


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and side diagonal of a tridiagonal matrix congruent to ``a`` by reflections."""
    a, n = a.copy(), len(a)
    side = np.zeros(max(n - 1, 0))
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        length = np.linalg.norm(x)
        side[k] = -np.copysign(length, x[0])
        x[0] -= side[k]
        if not length or not x.any():
            continue
        v = x / np.linalg.norm(x)
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        q = 2 * p - 2 * (v @ p) * v
        rest -= np.outer(v, q) + np.outer(q, v)
    if n > 1:
        side[n - 2] = a[n - 1, n - 2]
    return np.diag(a).copy(), side


class Inertia:
    """Counts of eigenvalues by the signs of the pivots of shifted matrices, and eigenvalues bracketed by these counts."""

    def __init__(self, a: np.ndarray):
        self.diagonal, side = tridiagonal(a)
        self.square = np.concatenate([[0.0], side * side])
        reach = np.abs(np.concatenate([[0.0], side])) + np.abs(np.concatenate([side, [0.0]]))
        self.low, self.high = float((self.diagonal - reach).min()), float((self.diagonal + reach).max())
        self.tiny = np.finfo(float).eps * max(abs(self.low), abs(self.high))

    def above(self, shift: float) -> int:
        """Number of eigenvalues that are not below ``shift``."""
        negative, pivot = 0, 1.0
        for d, s in zip(self.diagonal - shift, self.square):
            pivot = d - s / pivot
            if abs(pivot) < self.tiny * np.finfo(float).eps:
                pivot = -self.tiny * np.finfo(float).eps or -np.finfo(float).tiny
            negative += pivot < 0
        return len(self.diagonal) - negative

    def eigenvalue(self, k: int) -> float:
        """The k-th largest, by halving."""
        lo, hi = self.low - 2 * self.tiny, self.high + 2 * self.tiny
        while hi - lo > self.tiny:
            mid = (lo + hi) / 2
            if mid in (lo, hi):
                break
            lo, hi = (mid, hi) if self.above(mid) >= k else (lo, mid)
        return (lo + hi) / 2

    def cut(self, k: int) -> tuple[float, int]:
        """A shift in the gap after the k-th largest eigenvalue and those equal to it, and how many lie above it."""
        last, near = self.eigenvalue(k), 64 * len(self.diagonal) * self.tiny
        m = self.above(last - near)
        if m >= len(self.diagonal):
            return last - max(near, abs(last)) - self.tiny, m
        return (last + self.eigenvalue(m + 1)) / 2, m


def interval(a: np.ndarray, lo: float, hi: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues inside (lo, hi), falling, and their unit eigenvectors as columns.

    Contour integration by Gauss-Legendre points on a circle over the interval; solves at conjugate points are conjugate, so
    the upper half is enough. Rounds go on until the residuals are those of double precision.
    """
    n, centre, radius = len(a), (lo + hi) / 2, (hi - lo) / 2
    size = min(n, count + max(4, count // 2))
    y = np.random.default_rng(count).standard_normal((n, size))
    t, w = np.polynomial.legendre.leggauss(NODES)
    turn = radius * np.exp(1j * np.pi / 2 * (1 + t))
    norm, eye, best, found = np.abs(a).sum(axis=1).max(), np.eye(n), np.inf, None
    for _ in range(ROUNDS):
        q = sum(wj / 2 * (zj * np.linalg.solve((centre + zj) * eye - a, y.astype(complex))).real for zj, wj in zip(turn, w))
        basis, s, _ = np.linalg.svd(q, full_matrices=False)
        basis = basis[:, s > s[0] * 1e-14]
        # A second pass against the projected matrix is Rayleigh-Ritz: a dense problem of the subspace's size.
        value, mixed = np.linalg.eigh(basis.T @ a @ basis)
        y = basis @ mixed
        inside = np.flatnonzero((value > lo) & (value < hi))
        if len(inside) != count:
            continue
        x, e = y[:, inside], value[inside]
        residual = np.linalg.norm(a @ x - x * e, axis=0).max() / norm
        if residual < best:
            found = e[::-1], x[:, ::-1] / np.linalg.norm(x[:, ::-1], axis=0)
        if residual <= 4 * np.finfo(float).eps or (residual < 1e-12 and residual > best / 2):
            break
        best = min(best, residual)
    if found is None:
        raise ArithmeticError(f"{count} eigenvalues counted in ({lo}, {hi}) were not found")
    return found


def components(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a covariance, falling, with unit eigenvectors as columns; fewer where its rank is lower."""
    n = len(a)
    if not n or not a.any():
        return np.zeros(0), np.zeros((n, 0))
    counts = Inertia(a)
    floor = 8 * n * counts.tiny
    k = min(k, counts.above(floor))
    top, seen, values, vectors = counts.high + max(abs(counts.high) * 1e-3, counts.tiny), 0, [], []
    while seen < k:
        shift, upto = counts.cut(min(k, seen + SLICE))
        e, x = interval(a, shift, top, upto - seen)
        values.append(e)
        vectors.append(x)
        top, seen = shift, upto
    if not values:
        return np.zeros(0), np.zeros((n, 0))
    return np.concatenate(values)[:k], np.concatenate(vectors, axis=1)[:, :k]


def _projected(rows: DataFrame, n: int, sums: list[int], e: np.ndarray, u: np.ndarray) -> DataFrame:
    """Adds ``deviation`` and ``whitened`` (an array, one entry per component) to rows with ``x``."""
    width, mean, map_to = len(sums), np.array([s / n for s in sums]), u / np.sqrt(e)
    big = max(map(abs, sums), default=0)
    total = sum(s * s for s in sums)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b, width)
            largest = float(np.abs(x.astype(float)).max()) if x.size else 0.0
            exact = x if max(largest, 1) * max(largest, big, 1) * max(width, 1) < 2 ** 62 else x.astype(object)
            kind = exact.dtype
            own, cross = (exact * exact).sum(axis=1), exact @ np.array(sums, dtype=kind)
            # The square of n x - S, added up: whole numbers of any size.
            far = [n * n * int(p) - 2 * n * int(q) + total for p, q in zip(own, cross)]
            w = (x - mean) @ map_to
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), pa.array(w.reshape(-1)))
            yield pa.record_batch([b.column(0), pa.array([f if f < 2 ** 63 else None for f in far], pa.int64()), lists],
                                  ["vec_id", "deviation", "whitened"])
    kind = dict(rows.dtypes)["vec_id"]
    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(projected: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity."""
    cells = [(i, j) for i in range(k) for j in range(i + 1)]
    got = projected.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in cells]).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in cells)


def whiten(vectors: DataFrame, k: int = 4, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per remaining row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries are dropped. Equal vectors count once for the mean and the
    covariance, and every row is projected. Vectors shorter than the longest one end in zeros. Components without variance
    (to double precision) are left out, so one distinct vector, an empty table or empty vectors give no row. A deviation
    beyond a long is null. Null and repeated ids stay as they are; other columns are not read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, BATCH_ROWS)
    rows = steps(vectors, vec_id, vector)
    fit = materialize(rows.select("x").distinct(), "fit")
    width = fit.agg(F.max(F.size("x"))).first()[0] or 0
    n, sums = moments(fit, width)
    v = covariance(fit, n, sums) if n else np.zeros((0, 0))
    e, u = components(v, k)
    if not len(e):
        kind = dict(rows.dtypes)["vec_id"]
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(_projected(fit.withColumn("vec_id", F.lit(0)), n, sums, e, u), len(e))
    explained = F.array(*[F.lit(float(x)) for x in e / np.trace(v)])
    out = _projected(rows, n, sums, e, u).select("vec_id", "deviation", F.posexplode("whitened").alias("_i", "whitened"))
    return out.select("vec_id", (F.col("_i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      F.get(explained, F.col("_i")).alias("explained"), F.lit(error).alias("identity_error"))
