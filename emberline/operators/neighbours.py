"""Exact nearest rows in feature space: a two-level pivot index, a bound for every row, blocks compared by matrix products.

Rows belong to the nearest pivot of the nearest group of pivots; both numbers grow with roots of the row count, so placing a
row is cheap at any size. A pivot's rows are cut in rings of distance, rings in parts, so a block holds few rows however
dense a place is. Every row first meets the block it lies in, which bounds its k-th distance; then it visits only blocks that
the triangle inequality leaves within this bound. In many dimensions the inequality leaves nearly all of them: rows are then packed
by the thousand and packs meet packs, so that nothing is written per row and block.

Features travel as bytes, in single precision where that loses nothing. Copies are told apart by hashes, so features of rows that
are alone with theirs are not shuffled for it.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from emberline.operators.joins import BROADCAST_ROWS, join_lookup
from emberline.storage import materialize

BLOCK_ROWS = 2048
# A pivot's rows beyond one block are cut in so many rings of about equal size; their bounds come from a sketch.
RINGS = 16
# The index has at most about so many blocks; beyond, blocks grow.
BLOCKS = 2_000_000
# Visits are written out as rows while they take at most so many bytes for each asking row; beyond, packs meet packs.
VISIT_BYTES = 4096
# Features of a pack take about so many bytes.
PACK_BYTES = 1 << 20
# Reference packs are read in parts of about so many bytes, which a task holds while its asking packs meet them.
PART_BYTES = 64 << 20
# So many asking rows tell whether pruning is weak.
PROBES = 256
# So many rows at a time meet pivots or a pack, which bounds the matrices that a task holds; fewer meet the rings of a group.
STEP, RING_STEP = 512, 64
# Distances by matrix products are inexact by this share of the lengths involved.
FUZZ = 1e-6


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances by one matrix product; inexact for rows that nearly coincide."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None], 0))


@dataclass(frozen=True)
class Pivots:
    """Fine pivots by coarse group."""
    coarse: np.ndarray
    fine: np.ndarray
    group: np.ndarray

    @staticmethod
    def choose(sample: np.ndarray) -> Pivots:
        sample = sample[np.sort(np.unique(sample, axis=0, return_index=True)[1])]
        coarse = sample[:max(1, math.isqrt(len(sample)))]
        group = np.concatenate([distances(sample[i:i + 4096], coarse).argmin(1) for i in range(0, len(sample), 4096)])
        order = np.argsort(group, kind="stable")
        return Pivots(coarse, sample[order], group[order])

    def members(self, g: int) -> slice:
        return slice(*np.searchsorted(self.group, [g, g + 1]))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each row and its distance to the cell's pivot."""
        near, cell = distances(x, self.coarse).argmin(1), np.zeros(len(x), np.int64)
        for g in np.unique(near):
            own, at = near == g, self.members(g)
            cell[own] = at.start + distances(x[own], self.fine[at]).argmin(1)
        return cell, np.sqrt(((x - self.fine[cell]) ** 2).sum(1))


@dataclass(frozen=True)
class Index:
    """Row counts of the cells, bounds of their rings (RINGS + 1 each) and the blocks of every ring (0: no row)."""
    pivots: Pivots
    count: np.ndarray
    bounds: np.ndarray
    parts: np.ndarray

    def ring(self, cell: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Ring of each row: the number of inner bounds below its distance; rows further out belong to the last ring with rows."""
        last = RINGS - 1 - (self.parts[cell, ::-1] > 0).argmax(1)
        return np.minimum((self.bounds[cell, 1:-1] < d[:, None]).sum(1), last)

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of each coarse group and how far from its centre they can be."""
        p, n = self.pivots, len(self.pivots.coarse)
        rows, reach = np.zeros(n, np.int64), np.full(n, -np.inf)
        np.add.at(rows, p.group, self.count)
        far = np.sqrt(((p.fine - p.coarse[p.group]) ** 2).sum(1)) + self.bounds[:, -1]
        np.maximum.at(reach, p.group, np.where(self.count > 0, far, -np.inf))
        return rows, reach

    def first_bound(self, x: np.ndarray, cell: np.ndarray, need: int) -> np.ndarray:
        """A distance within which each row has ``need`` rows, by the sizes of the cells of its group, or of the groups."""
        rows, reach = self.groups()
        out, own_group = np.full(len(x), np.inf), self.pivots.group[cell]
        for g in np.unique(own_group):
            own, at = own_group == g, self.pivots.members(g)
            centre, spread, size = (self.pivots.fine[at], self.bounds[at, -1], self.count[at]) if rows[g] >= need else (self.pivots.coarse, reach, rows)
            far = distances(x[own], centre) + np.where(size > 0, spread, np.inf)
            order = np.argsort(far, axis=1)
            enough = np.cumsum(size[order], axis=1) >= need
            last = np.take_along_axis(far, order, axis=1)[np.arange(len(far)), enough.argmax(1)]
            out[own] = np.where(enough.any(1), last, np.inf)
        return out * (1 + FUZZ)

    def visits(self, x: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, cell, ring) of every ring that can hold a row within the bound, one coarse group after the other."""
        reach = self.groups()[1]
        limit = bound + FUZZ * (np.sqrt((x * x).sum(1)) + np.sqrt((self.pivots.fine ** 2).sum(1)).max())
        close = distances(x, self.pivots.coarse) - reach <= limit[:, None]
        for g in np.flatnonzero(close.any(0)):
            rows, at = np.flatnonzero(close[:, g]), self.pivots.members(g)
            d, b = distances(x[rows], self.pivots.fine[at]), self.bounds[at]
            r, c = np.nonzero((self.count[at] > 0) & (d - b[:, -1] <= limit[rows, None]) & (b[:, 0] - d <= limit[rows, None]))
            # A ring reaches from its inner to its outer bound.
            near = (d[r, c, None] - b[c, 1:] <= limit[rows[r], None]) & (b[c, :-1] - d[r, c, None] <= limit[rows[r], None])
            i, k = np.nonzero(near & (self.parts[at][c] > 0))
            yield rows[r[i]], at.start + c[i], k


def _features(b: pa.RecordBatch, width: int) -> np.ndarray:
    return b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)


def _encode(x: np.ndarray) -> np.ndarray:
    """The rows in single precision if that loses nothing."""
    small = x.astype(np.float32)
    return small if (small == x).all() else np.ascontiguousarray(x)


def _decode(rows: list[bytes], width: int) -> np.ndarray:
    """The rows of as many byte strings, each in the precision that its length tells."""
    sizes, out = np.fromiter(map(len, rows), np.int64, len(rows)), np.empty((len(rows), width))
    for kind in (np.float32, np.float64):
        at = np.flatnonzero(sizes == width * np.dtype(kind).itemsize)
        out[at] = np.frombuffer(b"".join(rows[i] for i in at), kind).reshape(-1, width)
    return out


def _place(pivots, width: int):
    def run(batches):
        for b in batches:
            x = _features(b, width)
            cell, d = (np.concatenate(v) for v in zip(*[pivots.value.place(x[s:s + STEP]) for s in range(0, len(x), STEP)]))
            cols = {n: b.column(n) for n in b.schema.names} | {"features": pa.array([r.tobytes() for r in _encode(x)], pa.binary())}
            yield pa.record_batch([*cols.values(), pa.array(cell, pa.int64()), pa.array(d)], [*cols, "cell", "d"])
    return run


def build_index(refs: DataFrame, pivots: Pivots, block_rows: int) -> tuple[DataFrame, Index]:
    """Reference rows with ``ring`` and ``part`` next to ``cell`` and ``d``, and their index."""
    spark, n = refs.sparkSession, len(pivots.fine)
    inner = F.percentile_approx("d", [i / RINGS for i in range(1, RINGS)], 20 * RINGS)
    # One row per pivot: twice the root of the row count.
    cells = refs.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("low"), F.max("d").alias("high"), inner.alias("inner"))
    stats = materialize(cells.withColumn("inner", F.when(F.col("n") > block_rows, F.col("inner")).otherwise(F.array_repeat("high", RINGS - 1))), "cells")
    ringed = refs.join(F.broadcast(stats.select("cell", "inner")), "cell").withColumn(
        "ring", F.size(F.filter("inner", lambda b: b < F.col("d"))).cast("long")).drop("inner")
    sizes = ringed.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / block_rows))
    sizes = materialize(sizes, "rings")
    count, bounds, parts = np.zeros(n, np.int64), np.zeros((n, RINGS + 1)), np.zeros((n, RINGS), np.int64)
    for r in stats.toPandas().itertuples():
        count[r.cell], bounds[r.cell] = r.n, [r.low, *r.inner, r.high]
    rings = sizes.toPandas()
    parts[rings.cell, rings.ring] = rings.parts
    placed = ringed.join(F.broadcast(sizes.select("cell", "ring", "parts")), ["cell", "ring"])
    return placed.withColumn("part", F.pmod(F.xxhash64("row_id"), F.col("parts"))).drop("parts"), Index(pivots, count, bounds, parts)


def _block_nearest(width: int, need: int):
    def run(queries: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"vid": np.zeros(0, np.int64), "d": np.zeros(0), "row_id": np.zeros(0, np.int64), "label": np.zeros(0, np.int32)})]
        if not len(queries) or not len(refs):
            return out[0]
        r, ids, labels = _decode(refs["features"].tolist(), width), refs["row_id"].to_numpy(), refs["label"].to_numpy()
        longest = np.sqrt((r * r).sum(1)).max()
        for start in range(0, len(queries), 1024):
            part = queries.iloc[start:start + 1024]
            q, vid = _decode(part["features"].tolist(), width), part["vid"].to_numpy()
            d = distances(q, r)
            kth = np.partition(d, need - 1, axis=1)[:, need - 1] if len(r) > need else np.full(len(q), np.inf)
            limit = np.minimum(kth, part["bound"].to_numpy()) + FUZZ * (np.sqrt((q * q).sum(1)) + longest)
            i, j = np.nonzero(d <= limit[:, None])
            diff = q[i] - r[j]
            exact = np.sqrt((diff * diff).sum(1))
            order = np.lexsort((ids[j], exact, i))
            i, j, exact = i[order], j[order], exact[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < need
            out.append(pd.DataFrame({"vid": vid[i[keep]], "d": exact[keep], "row_id": ids[j[keep]], "label": labels[j[keep]]}))
        return pd.concat(out)
    return run


def compare(visits: DataFrame, refs: DataFrame, width: int, need: int, block_rows: int, small: bool) -> DataFrame:
    """``(vid, d, row_id, label)``: the nearest rows of each visited block. Blocks with many visitors are met in several tasks."""
    block = ["cell", "ring", "part"]
    crowd = visits.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / (4 * block_rows)).alias("salts"))
    crowd = F.broadcast(crowd) if small else crowd
    a = visits.join(crowd, block).withColumn("salt", F.pmod(F.xxhash64("vid"), F.col("salts"))).drop("salts")
    b = refs.select(*block, "row_id", "features", "label").join(crowd, block).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    return a.groupBy(*block, "salt").cogroup(b.groupBy(*block, "salt")).applyInPandas(_block_nearest(width, need), "vid long, d double, row_id long, label int")


def _packed(width: int, need: int, alike: bool):
    """Rows gathered in packs: names, bounds, labels and features, all as bytes."""
    size = max(256, min(BLOCK_ROWS, PACK_BYTES // (8 * width)))

    def run(batches):
        held, n = [], 0
        for b in batches:
            for start in range(0, b.num_rows, size):
                held.append(b.slice(start, size))
                n += held[-1].num_rows
                while n >= size:
                    t = pa.Table.from_batches(held)
                    yield _pack(t.slice(0, size), width, need, alike)
                    held, n = t.slice(size).to_batches(), n - size
        if n:
            yield _pack(pa.Table.from_batches(held), width, need, alike)
    return run


def _pack(t: pa.Table, width: int, need: int, alike: bool) -> pa.RecordBatch:
    names, bound, labels = (t.column(c).to_numpy().astype(kind) for c, kind in (("name", np.int64), ("bound", float), ("label", np.int32)))
    x = _decode(t.column("features").to_pylist(), width)
    if alike and len(x) >= need:  # the pack's own rows bound the distances that are looked for
        length = np.sqrt((x * x).sum(1))
        near = [np.partition(distances(x[s:s + STEP], x), need - 1, axis=1)[:, need - 1] for s in range(0, len(x), STEP)]
        near = np.concatenate(near) + FUZZ * (length + length.max())
        bound = np.where(bound >= 0, np.minimum(bound, near), bound)
    return pa.record_batch([pa.array([c.tobytes()], pa.binary()) for c in (names, bound, labels, _encode(x))], ["names", "bounds", "labels", "rows"])


def _unpack(rows: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(rows, np.float32 if len(rows) == 4 * n * width else np.float64).reshape(n, width).astype(float)


class _Pack:
    """Asking rows with the nearest rows found so far; ``bound`` falls as better ones come."""

    def __init__(self, vid: np.ndarray, bound: np.ndarray, x: np.ndarray, need: int):
        self.vid, self.bound, self.x, self.need = vid, bound.copy(), x, need
        self.square = (self.x * self.x).sum(1)
        self.length = np.sqrt(self.square)
        self.found = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def meet(self, ids: np.ndarray, labels: np.ndarray, r: np.ndarray) -> None:
        square = (r * r).sum(1)
        fuzz = FUZZ * (self.length + math.sqrt(square.max()))
        # Rows that all of the pack is too far from are left out.
        centre = r.mean(0)
        reach = np.sqrt(((r - centre) ** 2).sum(1).max())
        on = np.flatnonzero(np.sqrt(((self.x - centre) ** 2).sum(1)) - reach <= self.bound + fuzz)
        if not len(on):
            return
        d = self.x[on] @ (-2 * r.T)
        d += square
        # Distances are compared squared and without the asking row's own part.
        limit = self.bound[on]
        if len(r) > self.need and not (len(self.found[0]) and np.isfinite(limit).all()):
            kth = np.partition(d, self.need - 1, axis=1)[:, self.need - 1] + self.square[on]
            limit = np.minimum(limit, np.sqrt(np.maximum(kth, 0)) + fuzz[on])
        i, j = np.nonzero(d <= ((limit + fuzz[on]) ** 2 + fuzz[on] ** 2 - self.square[on])[:, None])
        i = on[i]
        exact = np.zeros(len(i))
        for s in range(0, len(i), 1 << 15):
            diff = self.x[i[s:s + (1 << 15)]] - r[j[s:s + (1 << 15)]]
            exact[s:s + (1 << 15)] = np.sqrt((diff * diff).sum(1))
        keep = exact <= self.bound[i] * (1 + 1e-12)
        i, j, exact = i[keep], j[keep], exact[keep]
        if not len(i):
            return
        i, exact, name, label = (np.concatenate(p) for p in zip(self.found, (i, exact, ids[j], labels[j])))
        order = np.lexsort((name, exact, i))
        order = order[np.arange(len(i)) - np.searchsorted(i[order], i[order]) < self.need]
        self.found = i, exact, _, _ = i[order], exact[order], name[order], label[order]
        last = np.flatnonzero(np.arange(len(i)) - np.searchsorted(i, i) == self.need - 1)
        self.bound[i[last]] = np.minimum(self.bound[i[last]], exact[last])

    def batch(self) -> pa.RecordBatch:
        i, exact, name, label = self.found
        return pa.record_batch([pa.array(self.vid[i]), pa.array(exact), pa.array(name), pa.array(label)], ["vid", "d", "row_id", "label"])


def _asking(names: bytes, bounds: bytes, rows: bytes, width: int, need: int) -> list[_Pack]:
    """The pack's rows that ask, in small packs; those of a negative bound do not."""
    bound = np.frombuffer(bounds)
    asks = np.flatnonzero(bound >= 0)
    vid, x = np.frombuffer(names, np.int64), _unpack(rows, len(bound), width)
    return [_Pack(vid[at], bound[at], x[at], need) for at in (asks[s:s + STEP] for s in range(0, len(asks), STEP))]


def _packs_met(width: int, need: int):
    """Pairs come with the same asking pack one after the other, so its bounds fall from one to the next."""
    def run(batches):
        key, asking = None, []
        for b in batches:
            for names, bounds, rows, ids, labels, refs in zip(*[b.column(c) for c in ("names", "bounds", "rows", "ids", "kinds", "refs")]):
                if names.as_py() != key:
                    yield from (p.batch() for p in asking)
                    key = names.as_py()
                    asking = _asking(key, bounds.as_py(), rows.as_py(), width, need)
                ids = np.frombuffer(ids.as_py(), np.int64)
                met = ids, np.frombuffer(labels.as_py(), np.int32), _unpack(refs.as_py(), len(ids), width)
                for p in asking:
                    p.meet(*met)
        yield from (p.batch() for p in asking)
    return run


def packs(df: DataFrame, rows: int, width: int, need: int, alike: bool) -> DataFrame:
    """Rows ``name, bound, label, features, cell, ring, part`` in written packs; rows of one place meet in one pack."""
    place = ["cell", "ring", "part"]
    df = df.repartitionByRange(max(1, -(-rows // (2 * BLOCK_ROWS))), *place, F.xxhash64("name")).sortWithinPartitions(*place)
    kind = "names binary, bounds binary, labels binary, rows binary"
    return materialize(df.select("name", "bound", "label", "features").mapInArrow(_packed(width, need, alike), kind), "packs", "zstd")


def compare_packs(asking: DataFrame, refs: DataFrame, n: int, width: int, need: int) -> DataFrame:
    """``(vid, d, row_id, label)``: the nearest rows of every asking row among each part of the reference packs.

    Every asking pack meets every reference pack. Both sides are read where they lie. A part of the reference packs has a bounded
    size, and for each an asking row has at most the rows that are looked for.
    """
    b = refs.select(F.col("names").alias("ids"), F.col("labels").alias("kinds"), F.col("rows").alias("refs")).coalesce(max(1, -(-8 * n * width // PART_BYTES)))
    return asking.drop("labels").crossJoin(b.hint("shuffle_replicate_nl")).mapInArrow(_packs_met(width, need), "vid long, d double, row_id long, label int")


def best_of(found: DataFrame, need: int) -> DataFrame:
    w = Window.partitionBy("vid").orderBy("d", "row_id")
    return found.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= need).drop("_rn")


def _without_copies(df: DataFrame, need: int) -> tuple[DataFrame, DataFrame | None]:
    """``(row_id, features, label, asks)`` with at most ``need`` rows of equal features, the first of which asks for all of them.

    Also ``(row_id, vid, n)`` of rows with copies: the row that asks for them and how many there are; None if there are none.
    Features are compared where hashes are equal, so only these are shuffled with their features.
    """
    hashed = df.withColumn("_h", F.xxhash64("features"))
    often = materialize(hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_h"), "often")
    count = often.count()
    if not count:
        return df.withColumn("asks", F.lit(True)), None
    often = F.broadcast(often) if count <= BROADCAST_ROWS else often
    same = Window.partitionBy("features")
    copies = hashed.join(often, "_h", "left_semi").select(
        "row_id", "features", "label", F.row_number().over(same.orderBy("row_id")).alias("_rn"), F.min("row_id").over(same).alias("vid"),
        F.count(F.lit(1)).over(same).alias("n"))
    copies = materialize(copies.withColumn("features", F.when(F.col("_rn") <= need, F.col("features"))), "copies", "zstd")
    first = copies.filter(F.col("_rn") <= need).select("row_id", "features", "label", (F.col("_rn") == 1).alias("asks"))
    alone = hashed.join(often, "_h", "left_anti").drop("_h").withColumn("asks", F.lit(True))
    return alone.unionByName(first), copies.select("row_id", "vid", "n")


def _probe(probes: list, refs: DataFrame, width: int, need: int) -> np.ndarray:
    """For each probing row the ``need``-th distance within the block it lies in."""
    x, keys = np.array([p["x"] for p in probes]).reshape(-1, width), np.array([p["block"] for p in probes], np.int64)
    asked = refs.sparkSession.sparkContext.broadcast((x, keys))

    def run(batches):
        x, keys = asked.value
        best = np.full((len(x), need), np.inf)
        for b in batches:
            own = (np.stack([b.column(c).to_numpy() for c in ("cell", "ring", "part")], 1)[None] == keys[:, None]).all(2)
            at = np.flatnonzero(own.any(0))
            if len(at):
                r = _decode(b.column("features").take(pa.array(at)).to_pylist(), width)
                best = np.partition(np.hstack([best, np.where(own[:, at], distances(x, r), np.inf)]), need - 1, axis=1)[:, :need]
        i, j = np.nonzero(np.isfinite(best))
        yield pa.record_batch([pa.array(i, pa.int64()), pa.array(best[i, j])], ["i", "d"])
    found = refs.select("features", "cell", "ring", "part").mapInArrow(run, "i long, d double").groupBy("i").agg(
        F.slice(F.sort_array(F.collect_list("d")), 1, need).alias("d")).collect()
    out = np.full(len(x), np.inf)
    for r in found:
        out[r.i] = r.d[need - 1] if len(r.d) >= need else np.inf
    return out


def nearest_rows(queries: DataFrame, refs: DataFrame, k: int, block_rows: int = BLOCK_ROWS, stats: dict | None = None) -> DataFrame:
    """The ``k`` nearest reference rows of every query row (itself excluded), by (distance, row_id).

    Returns ``(row_id, place, neighbour, d, neighbour_label)``. ``stats`` is given the number of compared pairs. A table that is
    asked about itself is passed as both.
    """
    spark, need, alike = queries.sparkSession, k + 1, queries is refs
    # Of rows with equal features only the first k + 1 can be among the k nearest of any row.
    refs, copies = _without_copies(refs.select("row_id", "features", F.col("label").cast("int").alias("label")), need)
    asked = refs
    if not alike:
        asked, copies = _without_copies(queries.select("row_id", "features", F.lit(0).alias("label")), 1)
    n = refs.count()
    block_rows = max(block_rows, n // BLOCKS)
    wanted = 2 * math.isqrt(n) if n > block_rows else 1
    sample = [r[0] for r in refs.orderBy(F.xxhash64("row_id"), "row_id").limit(wanted).select("features").collect()]
    if not sample:
        return spark.createDataFrame([], "row_id long, place int, neighbour long, d double, neighbour_label int")
    width = len(sample[0])
    pivots = Pivots.choose(np.array(sample, dtype=float))
    shared = spark.sparkContext.broadcast(pivots)

    def put(df: DataFrame) -> DataFrame:
        return materialize(df.mapInArrow(_place(shared, width), "row_id long, features binary, label int, asks boolean, cell long, d double"), "placed", "zstd")
    placed = put(refs)
    asked = placed if alike else put(asked)
    placed, index = build_index(placed, pivots, block_rows)
    blocks, known = int(index.parts.sum()), spark.sparkContext.broadcast(index)
    small = blocks <= BROADCAST_ROWS

    def home(batches):
        for b in batches:
            x, at = _decode(b.column("features").to_pylist(), width), known.value
            cell, d = b.column("cell").to_numpy(), b.column("d").to_numpy()
            ring = at.ring(cell, d)
            bound = np.concatenate([at.first_bound(x[s:s + STEP], cell[s:s + STEP], need) for s in range(0, len(x), STEP)])
            cols = [ring, np.maximum(at.parts[cell, ring], 1), bound]
            yield pa.record_batch([*[b.column(c) for c in ("vid", "features", "cell")], *[pa.array(c) for c in cols]], ["vid", "features", "cell", "ring", "parts", "bound"])
    q = asked.filter("asks").select(F.col("row_id").alias("vid"), "features", "cell", "d").mapInArrow(
        home, "vid long, features binary, cell long, ring long, parts long, bound double")
    q = q.withColumn("part", F.pmod(F.xxhash64("vid"), F.col("parts"))).drop("parts")
    weak = False
    if blocks > 1 and stats is None:
        # Some asking rows tell which way is shorter; both compare all of them and find the same.
        probes = q.orderBy(F.xxhash64("vid"), "vid").limit(PROBES).collect()
        x = _decode([bytes(p.features) for p in probes], width)
        near = _probe([{"x": v, "block": (p.cell, p.ring, p.part)} for v, p in zip(x, probes)], placed, width, need)
        near = np.minimum(near, [p.bound for p in probes])
        met = sum(int(index.parts[c, r].sum()) for s in range(0, len(x), RING_STEP) for _, c, r in index.visits(x[s:s + RING_STEP], near[s:s + RING_STEP]))
        weak = met * (8 * width + 64) > VISIT_BYTES * len(probes)
    if weak:
        bound = F.when(F.col("asks"), F.lit(math.inf)).otherwise(-1.0) if alike else F.lit(-1.0)
        b = packs(placed.withColumnRenamed("row_id", "name").withColumn("bound", bound), n, width, need, alike)
        a = b if alike else packs(q.withColumnRenamed("vid", "name").withColumn("label", F.lit(0)), q.count(), width, need, False)
        best = compare_packs(a, b, n, width, need)
    else:
        visit = ["vid", "features", "bound", "cell", "ring", "part"]
        best = best_of(compare(q.select(*visit), placed, width, need, block_rows, small), need)
    if not weak and (blocks > 1 or stats is not None):
        best = materialize(best, "home")
        closer = best.groupBy("vid").agg(F.when(F.count(F.lit(1)) >= need, F.max("d")).alias("_b"))
        near = q.join(closer, "vid", "left").withColumn("bound", F.least("bound", F.coalesce("_b", F.lit(math.inf)))).drop("_b")

        def travel(batches):
            for b in batches:
                x, at = _decode(b.column("features").to_pylist(), width), known.value
                for start in range(0, b.num_rows, RING_STEP):
                    part = b.slice(start, RING_STEP)
                    for found in at.visits(x[start:start + RING_STEP], part.column("bound").to_numpy()):
                        for s in range(0, len(found[0]), 4096):
                            row, cell, ring = (v[s:s + 4096] for v in found)
                            kept = part.take(pa.array(row))
                            yield pa.record_batch([*[kept.column(c) for c in ("vid", "features", "bound")], *[pa.array(c) for c in (cell, ring, at.parts[cell, ring])],
                                                   *[kept.column(c) for c in ("cell", "ring", "part")]], ["vid", "features", "bound", "cell", "ring", "parts", "c0", "r0", "p0"])
        trips = near.select(*visit).mapInArrow(travel, "vid long, features binary, bound double, cell long, ring long, parts long, c0 long, r0 long, p0 long")
        trips = trips.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        trips = trips.filter("NOT (cell = c0 AND ring = r0 AND part = p0)").select(*visit)
        trips = materialize(trips, "trips", "zstd")
        if stats is not None:
            sizes = placed.groupBy("cell", "ring", "part").agg(F.count(F.lit(1)).alias("_n"))
            met = trips.select("cell", "ring", "part").unionByName(q.select("cell", "ring", "part")).join(sizes, ["cell", "ring", "part"])
            stats |= {"pairs": met.agg(F.sum("_n")).first()[0], "queries": q.count(), "refs": n}
        best = best_of(best.unionByName(compare(trips, placed, width, need, block_rows, small)), need)
    found = F.sort_array(F.collect_list(F.struct("d", F.col("row_id").alias("neighbour"), F.col("label").alias("neighbour_label"))))
    lists = materialize(best.groupBy("vid").agg(F.slice(found, 1, need).alias("near")), "best", "zstd")
    # Rows with equal features share one list; each leaves itself out.
    rows = lists.select(F.col("vid").alias("row_id"), "near")
    if copies is not None:
        firsts = copies.filter("row_id = vid").select("vid", "n")
        others = join_lookup(copies.filter("row_id <> vid").select("row_id", "vid"), lists, ["vid"], sizes=firsts, weight="n")
        rows = rows.unionByName(others.select("row_id", "near"))
    mine = F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("row_id")), 1, k)
    rows = rows.select("row_id", F.posexplode(mine).alias("place", "_x"))
    return rows.select("row_id", "place", "_x.neighbour", "_x.d", "_x.neighbour_label")
