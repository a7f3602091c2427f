import datetime as dt
import random

from pyspark.sql import functions as F

from emberline.operators import composites


def obs(spark, rows):
    return spark.createDataFrame([(p, dt.datetime.fromisoformat(t), b, v) for p, t, b, v in rows],
                                 "pixel_id long, ts timestamp, band string, value double")


def test_causal_ndvi_excludes_the_day(spark):
    o = obs(spark, [(1, "2024-01-01T00:00:00", "NDVI", 1000.0), (1, "2024-01-10T05:00:00", "NDVI", 3000.0),
                    (1, "2024-01-17T00:00:00", "NDVI", 9000.0), (1, "2024-01-18T00:00:00", "NDVI", 9000.0),
                    (2, "2024-03-01T00:00:00", "NDVI", 5.0)])
    got = {(r["pixel_id"], r["obs_date"].isoformat()): r["NDVI"] for r in
           composites.with_causal_ndvi(composites.daily_bands(o)).collect()}
    assert got[1, "2024-01-01"] is None and got[2, "2024-03-01"] is None
    assert abs(got[1, "2024-01-17"] - 0.2) < 1e-12
    assert abs(got[1, "2024-01-18"] - (3000 + 9000) / 2 / 10000) < 1e-12


def test_daily_fire_fills_the_calendar(spark):
    o = obs(spark, [(1, "2024-01-02T00:00:00", "BurnDate", 2.0), (1, "2024-01-02T03:00:00", "BurnDate", 0.0),
                    (2, "2024-01-05T00:00:00", "NDVI", 1.0)])
    got = {(r["pixel_id"], r["obs_date"].day): (r["fire_count"], r["fire_detected"]) for r in
           composites.daily_fire(o, "2024-01-01", "2024-01-04").collect()}
    assert got == {(p, d): (1, 1) if (p, d) == (1, 2) else (0, 0) for p in (1, 2) for d in (1, 2, 3)}


def test_date_range_is_half_open_and_pushed(spark, tmp_path):
    o = obs(spark, [(1, "2024-01-01T00:00:00", "NDVI", 1.0), (1, "2024-01-02T00:00:00", "NDVI", 2.0)])
    assert composites.between_dates(o, "2024-01-01", "2024-01-02").count() == 1
    o.write.parquet(str(tmp_path / "o"))
    d = composites.between_dates(spark.read.parquet(str(tmp_path / "o")), "2024-01-01", "2024-01-02").select("value")
    plan = d._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan and "band" not in plan.split("ReadSchema")[1]


def test_region_is_concave_with_hole(spark):
    ring = [(0, 0, 0), (0, 10, 0), (0, 10, 10), (0, 5, 4), (0, 0, 10), (1, 1, 1), (1, 2, 1), (1, 2, 2), (1, 1, 2)]
    v = spark.createDataFrame([("r", k, i, float(x), float(y)) for i, (k, x, y) in enumerate(ring)],
                              "region string, ring int, seq int, lon double, lat double")
    pts = spark.createDataFrame([(1, 3.0, 3.0), (2, 8.0, 5.0), (3, 1.5, 1.5), (4, 9.0, 5.0), (5, 11.0, 5.0), (6, 3.0, 8.9)],
                                "row_id long, latitude double, longitude double")
    got = sorted(r["row_id"] for r in composites.points_in_regions(pts, v).collect())
    assert got == [1, 6]
    nulls = pts.withColumn("band_value", F.when(F.col("row_id") == 6, None).otherwise(1.0))
    assert [r["row_id"] for r in composites.sample_region(nulls, v).collect()] == [1]


def test_stack_loses_pixels_without_layer(spark):
    daily = spark.createDataFrame([(1, 1.0), (2, 2.0)], "pixel_id long, t double")
    static = spark.createDataFrame([(1, 5.0)], "pixel_id long, e double")
    assert [tuple(r) for r in composites.stack_bands(static, daily).collect()] == [(1, 1.0, 5.0)]


def test_first_image(spark):
    o = obs(spark, [(1, "2024-01-02T00:00:00", "p", 2.0), (1, "2024-01-01T00:00:00", "p", 7.0), (1, "2023-01-01T00:00:00", "p", 9.0)])
    assert composites.first_image(o, "2024-01-01", "2025-01-01").first()["value"] == 7.0


def test_cells_give_the_parity_of_all_edges(spark):
    """Ragged rings with holes, a ring smaller than a cell, points on and off the grid lines."""
    import math
    rnd = random.Random(6)

    def ring(region, k, x, y, r, n, rough=0.3):
        return [(region, k, i, x + r * (1 + rough * rnd.uniform(-1, 1)) * math.cos(2 * math.pi * i / n), y + r * (1 + rough * rnd.uniform(-1, 1)) * math.sin(2 * math.pi * i / n))
                for i in range(n)]
    rings = ring("a", 0, 0.0, 0.0, 3.0, 60) + ring("a", 1, 0.2, -0.3, 1.0, 12) + ring("b", 0, 2.0, 1.0, 1.5, 300, 0.05) + ring("c", 0, 0.11, 0.12, 0.05, 5)
    rings += [("d", 0, i, x, y) for i, (x, y) in enumerate([(-4.0, -1.0), (4.0, -1.0), (4.0, 0.5), (-4.0, 0.5)])]
    pts = [(i, rnd.uniform(-4, 4), rnd.uniform(-5, 5)) for i in range(3000)] + [(5000 + i, 0.25 * (i % 20) - 2.5, 0.25 * (i // 20) - 2.5) for i in range(400)]
    edges = []
    for name, k in {(r[0], r[1]) for r in rings}:
        own = [(r[3], r[4]) for r in rings if (r[0], r[1]) == (name, k)]
        edges += [(name, *a, *b) for a, b in zip(own, own[1:] + own[:1])]
    want = set()
    for i, lat, lon in pts:
        for name in "abcd":
            hits = sum(1 for r, x1, y1, x2, y2 in edges if r == name and (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
            want |= {(i, name)} if hits % 2 else set()
    vertices = spark.createDataFrame(rings, "region string, ring int, seq int, lon double, lat double")
    points = spark.createDataFrame(pts, "row_id long, latitude double, longitude double")
    for size in (0.25, 1.0):
        assert {tuple(r) for r in composites.points_in_regions(points, vertices, size).collect()} == want
    inside, open_, edges, rows = composites.cell_cover(vertices, 0.25)
    assert max(t.count() for t in (inside, open_, edges)) <= rows
    assert inside.count() > 100 and edges.groupBy("region", "band", "col").count().agg({"count": "max"}).first()[0] < 120
