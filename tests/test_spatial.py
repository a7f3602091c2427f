import math
import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import spatial, zoning


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((math.radians(b[1]) - math.radians(a[1])) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1, h)))


def brute_clusters(pts, eps, k):
    near = [[j for j in range(len(pts)) if km(pts[i], pts[j]) <= eps] for i in range(len(pts))]
    core, lab = [len(n) >= k for n in near], [None] * len(pts)
    for i in range(len(pts)):
        if core[i] and lab[i] is None:
            lab[i], todo = i, [i]
            while todo:
                for j in near[todo.pop()]:
                    if lab[j] is None:
                        lab[j] = i
                        if core[j]:
                            todo.append(j)
    return [len(n) for n in near], core, lab


@pytest.fixture(scope="module")
def points():
    """A dense town with a third of the points, copies of one coordinate, loose points, the date line and a pole."""
    rnd = random.Random(3)
    pts = [(10 + rnd.gauss(0, 0.01), 20 + rnd.gauss(0, 0.01)) for _ in range(200)]
    pts += [(10.4, 20.4)] * 80
    pts += [(10 + rnd.uniform(-0.6, 0.6), 20 + rnd.uniform(-0.6, 0.6)) for _ in range(220)]
    pts += [(5 + rnd.gauss(0, 0.05), (179.95 + rnd.gauss(0, 0.1) + 180) % 360 - 180) for _ in range(60)]
    pts += [(89.9 + rnd.uniform(0, 0.09), rnd.uniform(-180, 180)) for _ in range(30)]
    rnd.shuffle(pts)
    return pts


def frame(spark, pts, parts=5):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pts)],
                                 "row_id long, latitude double, longitude double").repartition(parts)


@pytest.mark.parametrize("leaf,hot", [(3, 20)])
def test_radius(spark, points, leaf, hot):
    counts, core, lab = brute_clusters(points, 8.0, 12)
    df = frame(spark, points)
    got = dict(map(tuple, spatial.neighbour_counts(df, 8.0, leaf_points=leaf, hot_rows=hot).collect()))
    assert [got[i] for i in range(len(points))] == counts
    out = {r["row_id"]: r for r in spatial.density_clusters(df, 8.0, 12, leaf_points=leaf, hot_rows=hot).collect()}
    assert [out[i]["is_core"] for i in range(len(points))] == core
    assert [out[i]["cluster"] for i in range(len(points))] == lab
    assert any(l is not None and not c for l, c in zip(lab, core)) and None in lab


def test_parts_do_not_mix(spark, points):
    df = frame(spark, points).withColumn("macro", F.col("row_id") % 2)
    out = spatial.density_clusters(df, 8.0, 12, "macro").collect()
    for m in (0, 1):
        ids = [i for i in range(len(points)) if i % 2 == m]
        want = brute_clusters([points[i] for i in ids], 8.0, 12)[2]
        got = {r["row_id"]: r["cluster"] for r in out if r["part"] == m}
        assert [got[i] for i in ids] == [None if w is None else ids[w] for w in want]


def test_border_between_two_clusters(spark):
    """A row near two clusters joins the one whose first core row comes first."""
    step = 1 / 111.195
    left, right = [(0.0, -i * 0.1 * step) for i in range(5)], [(0.0, 1.9 * step + i * 0.1 * step) for i in range(5)]
    pts = right + [(0.0, 0.95 * step)] + left
    got = {r["row_id"]: (r["is_core"], r["cluster"]) for r in spatial.density_clusters(frame(spark, pts), 1.0, 5).collect()}
    assert got[5] == (False, 0) and got[0] == (True, 0) and got[6] == (True, 6)


def brute_vote(q, refs, k):
    near = sorted((math.sqrt((q[0] - a) ** 2 + (q[1] - b) ** 2), a, b, l) for a, b, l in refs)[:k]
    zero = any(d == 0 for d, *_ in near)
    w = {}
    for d, _, _, l in near:
        w[l] = w.get(l, 0) + ((d == 0) if zero else 1 / d)
    return min(w, key=lambda l: (-w[l], l))


@pytest.mark.parametrize("k,leaf", [(7, 16), (5000, 64)])
def test_vote(spark, points, k, leaf):
    rnd = random.Random(5)
    refs = [(a, b, rnd.randint(0, 4)) for a, b in points[::2]] + [(10.4, 20.4, 1)] * 30
    rdf = spark.createDataFrame(refs, "latitude double, longitude double, ecozone int")
    got = {r["row_id"]: r["ecozone"] for r in spatial.route(frame(spark, points), rdf, k, leaf_points=leaf, hot_rows=50).collect()}
    assert len(got) == len(points)
    assert [got[i] for i in range(len(points))] == [brute_vote(p, refs, k) for p in points]


def test_vote_zero_distance_and_tie(spark):
    refs = spark.createDataFrame([(0.0, 0.0, 3), (0.0, 1e-9, 2), (0.0, 2e-9, 2), (5.0, 1.0, 9), (5.0, -1.0, 4)],
                                 "latitude double, longitude double, ecozone int")
    q = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 0.0)], "row_id long, latitude double, longitude double")
    got = {r["row_id"]: r["ecozone"] for r in spatial.route(q, refs, 2).collect()}
    assert got == {1: 3, 2: 4}


def test_numbering_and_screen(spark):
    c = spark.createDataFrame([(1, 7)] * 3 + [(0, 9)] * 3 + [(0, 2)] * 3 + [(0, 5)] + [(0, None)] * 9, "part long, cluster long")
    got = [(r["part"], r["cluster"], r["zone"]) for r in zoning.number_zones(c, 2).orderBy("zone").collect()]
    assert got == [(0, 2, 0), (0, 9, 1), (1, 7, 2)]
    df = spark.createDataFrame([(0, 0)] * 300 + [(1, 1)] * 300 + [(2, i % 2) for i in range(300)] + [(3, 0)] * 5 + [(-1, 1)] * 400,
                               "ecozone int, fire_detected int")
    s = {r["ecozone"]: r for r in zoning.screen_zones(zoning.zone_profile(df)).collect()}
    assert {z: r["status"] for z, r in s.items()} == {0: "SAFE_ZONE", 1: "SAFE_ZONE", 2: "TRAINABLE", 3: "SKIPPED_SMALL_ZONE"}
    assert (s[0]["tn"], s[0]["tp"], s[1]["tn"], s[1]["tp"], s[0]["pr_auc"], s[0]["recall"]) == (300, 0, 0, 300, 1.0, 0.0)


def test_no_clusters_falls_back_to_macro_zones(spark, points):
    from emberline import Settings
    out = zoning.extract_zones(frame(spark, points), Settings(min_macro_rows=10_000), k=3)
    assert out.filter("ecozone <> macro_zone").count() == 0 and out.count() == len(points)


def test_k_rules():
    assert zoning.macro_k(100) == 9 and zoning.macro_k(40000 * 144) == 12 and zoning.macro_k(10 ** 9) == 15
    assert zoning.router_k(100) == 20 and zoning.router_k(807_897) == 299


def test_only_cells_at_a_border_are_opened(spark):
    """Two zones that meet in a line: the cells left for points grow with the line, not with the area."""
    import random
    rnd, left = random.Random(4), {}
    for n in (1500, 6000):
        pts = spark.createDataFrame([(rnd.random(), rnd.random()) for _ in range(n)], "c0 double, c1 double").selectExpr(
            "c0", "c1", "0L as part", "1L as w", "int(c1 > 0.5) as label")
        grid = spatial.Grid((0.0, 0.0), 1.0)
        placed, levels = spatial.place_points(pts, grid, 16, spatial._start_level(n, 16))
        qn, rn = spatial.node_table(placed, grid, levels), spatial.node_table(placed, grid, levels, labelled=True)
        settled, kept = spatial.vote_cells(qn, rn, levels, levels, grid, 12)
        clear = {r.id for r in settled.collect()}
        still = {r.id for r in kept.select("a.id").distinct().collect()}
        leaves = {r.leaf for r in placed.select("leaf").distinct().collect()}
        assert still <= leaves and clear and all(0.25 < (i.i1 + 0.5) / 2 ** i.lvl < 0.75 for i in still)
        left[n] = len(still) / len(leaves)
    assert left[6000] < 0.75 * left[1500]


def test_leaves_hold_few_points_at_any_depth(spark):
    pts = spark.createDataFrame([(0.3 + 1e-7 * i, 0.3, 0, 1) for i in range(200)] + [(i / 50, 0.9, 0, 1) for i in range(50)], "c0 double, c1 double, part long, w long")
    placed, levels = spatial.place_points(pts, spatial.Grid((0.0, 0.0), 1.0), 5)
    assert placed.count() == 250 and placed.select("c0", "c1").distinct().count() == 250
    sizes = placed.groupBy("leaf").count().collect()
    assert all(r["count"] <= 5 for r in sizes) and max(r.leaf.lvl for r in sizes) > 8
    assert {r.leaf.lvl for r in sizes} <= set(levels) and all(b - a <= 2 for a, b in zip(levels, levels[1:]))
