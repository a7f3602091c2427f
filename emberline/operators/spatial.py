"""Radius neighbours, density clusters and weighted nearest-neighbour votes over coordinates.

Rows with equal coordinates are folded into one weighted point first, so copies never multiply. Points are
placed in square cells; a cell with too many points is halved along every axis again, so a leaf cell holds few points
however dense a place is. Pairs of cells are then judged by the boxes around their points: clearly near and clearly
far pairs are settled as a whole, only the unclear ones are opened. No step lists all pairs of a dense place.
"""
from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.functions.columns import great_circle_km, shrink_longitude
from emberline.operators.components import connected_components
from emberline.operators.joins import BROADCAST_ROWS, HOT_ROWS, join_lookup
from emberline.storage import materialize

EARTH_KM = 6371.0
LEAF_POINTS = 64
VOTE_LEAF_POINTS = 24
MAX_DEPTH = 28
# Levels whose cells are counted in one pass, and the level that votes start from: at most 4**3 cells a side.
COUNTED_LEVELS = 4
FIRST_LEVEL = 3
SLACK = 1e-9


@dataclass(frozen=True)
class Grid:
    """Cells of side ``size`` at level 0, side ``size / 2**level`` below."""
    origin: tuple[float, ...]
    size: float

    @property
    def axes(self) -> range:
        return range(len(self.origin))

    def cell(self, level: int) -> Column:
        scale = float(2 ** level)
        return F.struct(F.lit(level).alias("lvl"), *[
            F.floor((F.col(f"c{i}") - self.origin[i]) / self.size * scale).alias(f"i{i}") for i in self.axes])

    def ancestor(self, cell: str, level: Column) -> Column:
        up = F.col(f"{cell}.lvl") - level
        return F.struct(level.cast("int").alias("lvl"), *[
            F.call_function("shiftright", F.col(f"{cell}.i{i}"), up.cast("int")).alias(f"i{i}") for i in self.axes])


def on_sphere(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Unit vector of each coordinate; great-circle order equals chord order."""
    p, l = F.radians(lat), F.radians(lon)
    return df.withColumns({"c0": F.cos(p) * F.cos(l), "c1": F.cos(p) * F.sin(l), "c2": F.sin(p)})


def place_points(points: DataFrame, grid: Grid, leaf_points: int = LEAF_POINTS,
                 start: int = 0) -> tuple[DataFrame, list[int]]:
    """Add ``leaf`` (cell id) to distinct points; returns the table and the levels that cells are opened at.

    A leaf is the largest cell, from level ``start`` on, with at most ``leaf_points`` points. A few levels are counted in one
    pass, combined before the shuffle; only the points of cells that are too full on all of them go on to deeper ones.
    """
    left, placed, first, used = points, [], start, {0}
    while True:
        last = min(MAX_DEPTH, first + COUNTED_LEVELS - 1)
        spread = left.withColumn("leaf", F.explode(F.array(*[grid.cell(l) for l in range(first, last + 1)])))
        counts = materialize(spread.groupBy("part", "leaf").agg(F.count(F.lit(1)).alias("_n")), "counts")
        few = (F.col("_n") <= leaf_points) | (F.col("leaf.lvl") == MAX_DEPTH)
        full = counts.filter(~few).select("part", "leaf")
        deepest = F.col("leaf.lvl") == last
        levels, cells, go_on = counts.agg(F.collect_set(F.when(few, F.col("leaf.lvl"))), F.count_if(few), F.count_if(~few & deepest)).first()
        above = counts.filter(few & (F.col("leaf.lvl") > first)).select("part", "leaf", grid.ancestor("leaf", F.col("leaf.lvl") - 1).alias("_up"))
        leaves = counts.filter(few & (F.col("leaf.lvl") == first)).select("part", "leaf").unionByName(
            above.join(full.withColumnRenamed("leaf", "_up"), ["part", "_up"], "left_semi").select("part", "leaf"))
        leaves = F.broadcast(leaves) if cells <= BROADCAST_ROWS else leaves
        placed.append(spread.join(leaves, ["part", "leaf"], "left_semi"))
        used |= set(levels) if levels or go_on else {first}
        if not go_on:
            break
        rest = full.filter(deepest)
        left = left.withColumn("leaf", grid.cell(last)).join(F.broadcast(rest) if go_on <= BROADCAST_ROWS else rest, ["part", "leaf"], "left_semi").drop("leaf")
        first = last + 1
    # Cells are opened by at most two levels at once.
    levels = sorted(used)
    levels += [l for low, high in zip(levels, levels[1:]) for l in range(low + 2, high, 2)]
    placed = reduce(DataFrame.unionByName, placed).select(*points.columns, "leaf")
    return materialize(placed, "placed"), sorted(levels)


def node_table(placed: DataFrame, grid: Grid, levels: list[int], labelled: bool = False) -> DataFrame:
    """Every cell on the way from level 0 to the leaves: weight, box of its points, parent, and the smallest and largest
    label of its points if they have one."""
    box = [f(f"c{i}").alias(f"{n}{i}") for i in grid.axes for n, f in (("lo", F.min), ("hi", F.max))]
    box += [F.min("label").alias("label0"), F.max("label").alias("label1")] if labelled else []
    leaves = placed.groupBy("part", "leaf").agg(F.sum("w").alias("w"), *box)
    used = F.array(*[F.lit(l) for l in levels])
    spread = leaves.withColumn("_l", F.explode(F.filter(used, lambda l: l <= F.col("leaf.lvl"))))
    spread = spread.withColumn("id", grid.ancestor("leaf", F.col("_l")))
    up = [f(f"{n}{i}").alias(f"{n}{i}") for i in grid.axes for n, f in (("lo", F.min), ("hi", F.max))]
    up += [F.min("label0").alias("label0"), F.max("label1").alias("label1")] if labelled else []
    nodes = spread.groupBy("part", "id").agg(
        F.sum("w").alias("w"), F.bool_or(F.col("_l") == F.col("leaf.lvl")).alias("is_leaf"), *up)
    fields = ["id", "w", "is_leaf"] + [f"{n}{i}" for i in grid.axes for n in ("lo", "hi")] + ["label0", "label1"] * labelled
    above = F.coalesce(F.array_max(F.filter(used, lambda l: l < F.col("id.lvl"))), F.lit(-1))
    nodes = nodes.withColumn("parent", F.when(above >= 0, grid.ancestor("id", F.greatest(above, F.lit(0)))))
    return materialize(nodes.select("part", "id", "parent", F.struct(*fields).alias("node")), "nodes")


def _bounds(grid: Grid) -> dict[str, Column]:
    near, far = F.lit(0.0), F.lit(0.0)
    for i in grid.axes:
        alo, ahi, blo, bhi = (F.col(f"{s}.{n}{i}") for s in "ab" for n in ("lo", "hi"))
        gap = F.greatest(alo - bhi, blo - ahi, F.lit(0.0))
        reach = F.greatest(ahi - blo, bhi - alo)
        near, far = near + gap * gap, far + reach * reach
    return {"near2": near, "far2": far}


def _open(pairs: DataFrame, nodes: DataFrame, side: str) -> DataFrame:
    """Replace the non-leaf cells of one side by their children."""
    kids = nodes.select(F.col("part").alias("_part"), F.col("parent").alias("_parent"), F.col("node").alias("_kid"))
    cols = pairs.columns
    moved = (pairs.filter(~F.col(f"{side}.is_leaf"))
             .join(kids, (F.col("part") == F.col("_part")) & (F.col(f"{side}.id") == F.col("_parent")))
             .withColumn(side, F.col("_kid")).select(cols))
    return pairs.filter(f"{side}.is_leaf").unionByName(moved)


def _neighbour_cells(a: DataFrame, b: DataFrame, grid: Grid, radius: float, half: bool) -> DataFrame:
    """Level-0 cell pairs that can hold points within ``radius``."""
    r = math.ceil(radius / grid.size)
    near = a.filter("id.lvl = 0").select("part", F.col("node").alias("a"))
    gap2, later = F.lit(0.0), F.lit(False)
    for i in reversed(grid.axes):
        near = near.withColumn(f"s{i}", F.explode(F.sequence(F.lit(-r), F.lit(r))))
        step = F.col(f"s{i}")
        gap2 = gap2 + F.pow(F.greatest(F.abs(step) - 1, F.lit(0)) * grid.size, F.lit(2.0))
        later = (step > 0) | ((step == 0) & later)
    near = near.filter(gap2 <= radius ** 2 * (1 + SLACK))
    if half:
        near = near.filter(later)
    near = near.select("part", "a", F.struct(F.lit(0).alias("lvl"), *[
        (F.col(f"a.id.i{i}") + F.col(f"s{i}")).alias(f"i{i}") for i in grid.axes]).alias("id"))
    pairs = near.join(b.filter("id.lvl = 0").select("part", "id", F.col("node").alias("b")), ["part", "id"])
    return pairs.select("part", "a", "b", F.col("a.id").alias("root_a"), F.col("b.id").alias("root_b"))


def radius_pairs(a: DataFrame, b: DataFrame, grid: Grid, radius: float, starts: DataFrame | None = None,
                 once: bool = False) -> tuple[DataFrame, DataFrame]:
    """Settle cell pairs against a radius: ``(whole, unclear)``.

    ``whole``: every point pair of the two cells is within the radius. ``unclear``: leaf pairs whose points must be
    compared. With ``once`` a level-0 pair is dropped as soon as it is known to touch.
    """
    pairs = _neighbour_cells(starts if starts is not None else a, b, grid, radius, half=once)
    r2, whole, unclear = radius * radius, None, None
    for _ in range(MAX_DEPTH + 2):
        judged = pairs.withColumns(_bounds(grid)).filter(F.col("near2") <= r2 * (1 + SLACK))
        judged = materialize(judged, "judged")
        sure = judged.filter(F.col("far2") <= r2 * (1 - SLACK)).drop("near2", "far2")
        rest = judged.filter(F.col("far2") > r2 * (1 - SLACK)).drop("near2", "far2")
        if once:
            met = sure.select("part", "root_a", "root_b").distinct()
            rest = rest.join(met, ["part", "root_a", "root_b"], "left_anti")
        final = F.col("a.is_leaf") & F.col("b.is_leaf")
        whole = sure if whole is None else whole.unionByName(sure)
        ended = rest.filter(final)
        unclear = ended if unclear is None else unclear.unionByName(ended)
        rest = rest.filter(~final)
        if rest.limit(1).isEmpty():
            break
        half_open = _open(rest, a, "a").withColumns(_bounds(grid)).filter(F.col("near2") <= r2 * (1 + SLACK))
        pairs = _open(half_open.drop("near2", "far2"), b, "b")
    return whole, unclear


def point_pairs(unclear: DataFrame, a: DataFrame, b: DataFrame, eps_km: float) -> DataFrame:
    """Points of unclear leaf pairs within ``eps_km``; both sides hold at most a leaf of points."""
    left = a.select("part", F.col("leaf").alias("_la"), F.struct("latitude", "longitude", "w", "first_row").alias("p"))
    right = b.select("part", F.col("leaf").alias("_lb"), F.struct("latitude", "longitude", "w", "first_row").alias("q"))
    pairs = unclear.select("part", F.col("a.id").alias("_la"), F.col("b.id").alias("_lb"), "root_a", "root_b")
    return (pairs.join(left, ["part", "_la"]).join(right, ["part", "_lb"])
            .filter(great_circle_km(F.col("p.latitude"), F.col("p.longitude"),
                                    F.col("q.latitude"), F.col("q.longitude")) <= eps_km))


def fold_points(rows: DataFrame, part: str | None, key: str = "row_id") -> DataFrame:
    p = F.col(part).cast("long") if part else F.lit(0).cast("long")
    return materialize(rows.groupBy(p.alias("part"), "latitude", "longitude").agg(
        F.count(F.lit(1)).alias("w"), F.min(key).alias("first_row")), "folded")


def _eps_grid(eps_km: float) -> tuple[Grid, float]:
    chord = 2 * math.sin(min(eps_km / EARTH_KM, math.pi) / 2)
    # Side chosen so that any two points of one level-0 cell are within eps of each other.
    return Grid((-1.0, -1.0, -1.0), chord / math.sqrt(3) * (1 - 1e-6)), chord


def _reach_counts(whole: DataFrame, unclear: DataFrame, pts: DataFrame, asked: DataFrame, grid: Grid,
                  eps_km: float) -> DataFrame:
    """``(part, latitude, longitude, neighbours)`` of the asked points."""
    keys = ["part", "latitude", "longitude"]
    near = whole.groupBy("part", F.col("a.id").alias("id")).agg(F.sum("b.w").alias("w"))
    leaves = asked.select("part", "leaf").distinct().withColumn(
        "id", F.explode(F.transform(F.sequence(F.lit(0), F.col("leaf.lvl")), lambda l: grid.ancestor("leaf", l))))
    per_leaf = leaves.join(near, ["part", "id"]).groupBy("part", "leaf").agg(F.sum("w").alias("_whole"))
    compared = point_pairs(unclear, asked, pts, eps_km).groupBy(
        "part", F.col("p.latitude").alias("latitude"), F.col("p.longitude").alias("longitude")
    ).agg(F.sum("q.w").alias("_compared"))
    return (asked.join(per_leaf, ["part", "leaf"], "left").join(compared, keys, "left")
            .select(*keys, (F.coalesce("_whole", F.lit(0)) + F.coalesce("_compared", F.lit(0))).alias("neighbours")))


def neighbour_counts(rows: DataFrame, eps_km: float, part: str | None = None, key: str = "row_id",
                     leaf_points: int = LEAF_POINTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows within ``eps_km`` (the row itself included) for every row, inside ``part``."""
    grid, radius = _eps_grid(eps_km)
    pts, levels = place_points(on_sphere(fold_points(rows, part, key)), grid, leaf_points)
    nodes = node_table(pts, grid, levels)
    whole, unclear = radius_pairs(nodes, nodes, grid, radius)
    counts = _reach_counts(whole, unclear, pts, pts, grid, eps_km)
    slim = rows.select(key, (F.col(part).cast("long") if part else F.lit(0).cast("long")).alias("part"),
                       "latitude", "longitude")
    return join_lookup(slim, counts, ["part", "latitude", "longitude"], "w", hot_rows=hot_rows, sizes=pts).select(
        key, "neighbours")


def cluster_points(rows: DataFrame, eps_km: float, min_points: int, part: str | None = None, key: str = "row_id",
                   leaf_points: int = LEAF_POINTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Density clusters per ``part``, one row per coordinate: ``(part, latitude, longitude, w, is_core, cluster)``.

    A core row has ``min_points`` rows (itself included) within ``eps_km``; core rows within reach share a cluster,
    named by its smallest core ``row_id``; a border row joins the reachable cluster with the smallest name;
    noise has a NULL cluster.
    """
    grid, radius = _eps_grid(eps_km)
    pts, levels = place_points(on_sphere(fold_points(rows, part, key)), grid, leaf_points)
    root = grid.ancestor("leaf", F.lit(0))
    nodes = node_table(pts, grid, levels)
    thin = nodes.filter("id.lvl = 0").filter(F.col("node.w") < min_points)
    pts = pts.withColumn("root", root).join(
        thin.select("part", F.col("id").alias("root"), F.lit(True).alias("_thin")), ["part", "root"], "left")

    # 1. Points of a full cell are core; only the points of thin cells need their neighbours counted.
    whole, unclear = radius_pairs(nodes, nodes, grid, radius, starts=thin)
    asked = pts.filter("_thin")
    counts = _reach_counts(whole, unclear, pts, asked, grid, eps_km)
    pts = materialize(pts.join(counts, ["part", "latitude", "longitude"], "left").withColumn(
        "is_core", F.col("_thin").isNull() | (F.col("neighbours") >= min_points)).drop("_thin", "neighbours"), "cored")
    core = pts.filter("is_core")

    # 2. Cells of core points are the vertices; cells that touch are joined.
    cells = materialize(core.groupBy("part", "root").agg(F.min("first_row").alias("v")), "cells")
    core_nodes = node_table(core, grid, levels)
    met, check = radius_pairs(core_nodes, core_nodes, grid, radius, once=True)
    touching = met.select("part", "root_a", "root_b").unionByName(
        point_pairs(check, core, core, eps_km).select("part", "root_a", "root_b")).distinct()
    edges = (touching.join(cells.select("part", F.col("root").alias("root_a"), F.col("v").alias("src")), ["part", "root_a"])
             .join(cells.select("part", F.col("root").alias("root_b"), F.col("v").alias("dst")), ["part", "root_b"]))
    named = connected_components(cells, edges, hot_rows).withColumnRenamed("root", "cluster")
    cells = materialize(cells.join(named, "v").select("part", "root", "cluster"), "named")

    # 3. Border points take the smallest cluster within reach.
    edge_pts = pts.filter("NOT is_core")
    reach = cells.select("part", F.col("root").alias("root_b"), "cluster")
    with_core = core_nodes.select("part", F.col("id").alias("_b"))
    by_cell = (whole.select("part", F.col("a.id").alias("id"), F.col("b.id").alias("_b"), "root_b")
               .join(with_core, ["part", "_b"], "left_semi").join(reach, ["part", "root_b"])
               .groupBy("part", "id").agg(F.min("cluster").alias("cluster")))
    tops = edge_pts.withColumn("id", F.explode(
        F.transform(F.sequence(F.lit(0), F.col("leaf.lvl")), lambda l: grid.ancestor("leaf", l))))
    keys = ["part", "latitude", "longitude"]
    found = tops.join(by_cell, ["part", "id"]).select(*keys, "cluster").unionByName(
        point_pairs(unclear, edge_pts, core, eps_km).join(reach, ["part", "root_b"])
        .select("part", F.col("p.latitude").alias("latitude"), F.col("p.longitude").alias("longitude"), "cluster"))
    border = found.groupBy(*keys).agg(F.min("cluster").alias("cluster"))
    labelled = core.join(cells, ["part", "root"]).select(*keys, "w", "is_core", "cluster").unionByName(
        edge_pts.join(border, keys, "left").select(*keys, "w", "is_core", "cluster"))
    return materialize(labelled, "labelled")


def density_clusters(rows: DataFrame, eps_km: float, min_points: int, part: str | None = None, key: str = "row_id",
                     leaf_points: int = LEAF_POINTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``cluster_points`` for every row: ``(row_id, part, is_core, cluster)``."""
    points = cluster_points(rows, eps_km, min_points, part, key, leaf_points, hot_rows)
    slim = rows.select(key, (F.col(part).cast("long") if part else F.lit(0).cast("long")).alias("part"),
                       "latitude", "longitude")
    return join_lookup(slim, points, ["part", "latitude", "longitude"], "w", hot_rows=hot_rows).select(
        key, "part", "is_core", "cluster")


def _plane(df: DataFrame, shrink: bool) -> DataFrame:
    x = shrink_longitude(F.col("latitude"), F.col("longitude")) if shrink else F.col("longitude")
    return df.withColumns({"c0": F.col("latitude"), "c1": x})


def _start_level(n: int, leaf_points: int) -> int:
    return max(0, math.ceil(math.log(max(n / leaf_points, 1), 4)))


def vote_cells(qn: DataFrame, rn: DataFrame, levels_q: list[int], levels_r: list[int], grid: Grid, k: int) -> tuple[DataFrame, DataFrame]:
    """Query cells whose ``k`` nearest reference rows all have one label, ``(id, label)``, and the leaf pairs of the others.

    Only cells near a border between labels are opened down to their points.
    """
    # The few cells of a high level on each side; cells are opened level by level and far ones dropped.
    def top(nodes: DataFrame, levels: list[int], side: str) -> tuple[DataFrame, int]:
        at = max(l for l in levels if l <= FIRST_LEVEL)
        cells = nodes.filter((F.col("id.lvl") == at) | (F.col("node.is_leaf") & (F.col("id.lvl") < at)))
        return cells.select("part", F.col("node").alias(side)), sum(l > at for l in levels)

    (tops_q, left_q), (tops_r, left_r) = top(qn, levels_q, "a"), top(rn, levels_r, "b")
    pairs = tops_q.join(tops_r, "part")
    by_cell = Window.partitionBy("part", "a.id")
    near_first = by_cell.orderBy("far2", "b.id").rowsBetween(Window.unboundedPreceding, 0)

    def near_enough(pairs: DataFrame) -> DataFrame:
        """Drop reference cells that lie beyond the farthest place the k-th neighbour can be."""
        judged = pairs.withColumns(_bounds(grid)).withColumn("_cum", F.sum("b.w").over(near_first))
        judged = judged.withColumn("reach2", F.min(F.when(F.col("_cum") >= k, F.col("far2"))).over(by_cell))
        kept = judged.filter(F.col("reach2").isNull() | (F.col("near2") <= F.col("reach2") * (1 + SLACK)))
        return kept.select("part", "a", "b", "reach2")

    # A query cell whose kept reference cells hold one label has its votes: every neighbour of its points is in them.
    settled, rounds = [], max(left_q, left_r) + 1
    for i in range(rounds):
        # One side at a time, so that the children of both are never listed together before the far ones are gone.
        kept = near_enough(pairs) if i == rounds - 1 else near_enough(_open(near_enough(pairs).drop("reach2"), qn, "a"))
        kept = materialize(kept.withColumns({"_l0": F.min("b.label0").over(by_cell), "_l1": F.max("b.label1").over(by_cell)}), "kept")
        settled.append(kept.filter("_l0 = _l1").select(F.col("a.id").alias("id"), F.col("_l0").alias("label")).distinct())
        kept = kept.filter("_l0 <> _l1").drop("_l0", "_l1")
        if i == rounds - 1 or kept.isEmpty():
            break
        pairs = _open(kept.drop("reach2"), rn, "b")
    return reduce(DataFrame.unionByName, settled), kept


def nearest_vote(queries: DataFrame, refs: DataFrame, k: int, label: str, shrink: bool = False,
                 leaf_points: int = VOTE_LEAF_POINTS, weight: str | None = None) -> DataFrame:
    """Distance-weighted vote of the ``k`` nearest reference rows for every distinct query coordinate.

    Weights are 1/d; when some of the k are at distance 0 only those vote; the largest weight wins, the smallest
    label on a tie. Equal distances at the k-th place are taken in (latitude, x, label) order. Returns
    ``(latitude, longitude, w, label)`` with ``w`` query rows per coordinate. ``weight`` names a reference column that
    says how many rows a reference row stands for.
    """
    q = _plane(queries.groupBy("latitude", "longitude").agg(F.count(F.lit(1)).alias("w"))
               .withColumn("part", F.lit(0).cast("long")), shrink)
    r = _plane(refs.groupBy("latitude", "longitude", F.col(label).alias("label"))
               .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("w")).withColumn("part", F.lit(0).cast("long")), shrink)
    q, r = materialize(q, "queries"), materialize(r, "refs")
    ends = [F.min("c0"), F.max("c0"), F.min("c1"), F.max("c1"), F.count(F.lit(1))]
    (*qs, n_q), (*rs, n_r) = q.agg(*ends).first(), r.agg(*ends).first()
    # An empty side has no ends.
    low, high = [[f([s[i] for s in (qs, rs) if s[i] is not None], default=0.0) for i in at] for f, at in ((min, (0, 2)), (max, (1, 3)))]
    size = max(high[0] - low[0], high[1] - low[1], 1e-9) * (1 + 1e-6)
    grid = Grid(tuple(low), size)
    q, levels_q = place_points(q, grid, leaf_points, _start_level(n_q, leaf_points))
    r, levels_r = place_points(r, grid, leaf_points, _start_level(n_r, leaf_points))
    qn, rn = node_table(q, grid, levels_q), node_table(r, grid, levels_r, labelled=True)

    settled, kept = vote_cells(qn, rn, levels_q, levels_r, grid, k)
    above = F.array(*[F.lit(l) for l in levels_q])
    cells = q.withColumn("id", F.explode(F.transform(F.filter(above, lambda l: l <= F.col("leaf.lvl")), lambda l: grid.ancestor("leaf", l))))
    clear = cells.join(settled, "id").select("latitude", "longitude", "w", F.col("label").alias(label))
    leafs = kept.select(F.col("a.id").alias("_q"), F.col("b.id").alias("_r"), "reach2")
    qs = q.select(F.col("leaf").alias("_q"), "latitude", "longitude", F.col("c0").alias("q0"), F.col("c1").alias("q1"))
    rs = r.select(F.col("leaf").alias("_r"), F.col("c0").alias("r0"), F.col("c1").alias("r1"), "label", "w")
    dy, dx = F.col("q0") - F.col("r0"), F.col("q1") - F.col("r1")
    cand = leafs.join(qs, "_q").join(rs, "_r").withColumn("d2", dy * dy + dx * dx)
    cand = cand.filter(F.col("reach2").isNull() | (F.col("d2") <= F.col("reach2") * (1 + SLACK)))
    cand = cand.select("latitude", "longitude", F.sqrt("d2").alias("d"), "r0", "r1", "label", "w")
    order = Window.partitionBy("latitude", "longitude").orderBy("d", "r0", "r1", "label")
    top = cand.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= k)
    before = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1))
    top = top.withColumn("_left", F.lit(k) - F.coalesce(before, F.lit(0))).filter(F.col("_left") > 0)
    take = F.least("w", "_left")
    votes = top.groupBy("latitude", "longitude", "label").agg(
        F.sum(F.when(F.col("d") == 0, take).otherwise(0)).alias("same"),
        F.sum(F.when(F.col("d") > 0, take / F.col("d")).otherwise(0.0)).alias("vote"))
    rank = F.struct((-F.col("same")).alias("s"), F.when(F.col("same") > 0, 0.0).otherwise(-F.col("vote")).alias("v"), "label")
    best = votes.groupBy("latitude", "longitude").agg(F.min(rank)["label"].alias(label))
    return clear.unionByName(best.join(q.select("latitude", "longitude", "w"), ["latitude", "longitude"]).select("latitude", "longitude", "w", label))


def route(rows: DataFrame, refs: DataFrame, k: int, label: str = "ecozone", shrink: bool = False,
          leaf_points: int = VOTE_LEAF_POINTS, hot_rows: int = HOT_ROWS, weight: str | None = None) -> DataFrame:
    """Rows with the voted ``label`` added (an existing one is replaced)."""
    voted = materialize(nearest_vote(rows, refs, k, label, shrink, leaf_points, weight), "voted")
    out = join_lookup(rows.drop(label), voted, ["latitude", "longitude"], "w", hot_rows=hot_rows)
    return out.drop("w")
