"""Sample files as the exports write them, and the warm-up's choice of rows."""
import time
from dataclasses import replace

from pyspark.sql import functions as F

from emberline.config import Settings
from emberline.operators import models
from emberline.plans import catalogue, dataset, training
from emberline.sources import registry, tables

LINES = ['id,geometry_json,latitude,longitude,note', '1,"{""type"":""Point"",""coordinates"":[77.1,20.5]}",20.5,77.1,"a ""b"", c"',
         '2,"{""type"":""Point"",""coordinates"":[78.1,21.5]}",21.5,78.1,plain']


def test_doubled_quotes(spark, tmp_path):
    (tmp_path / "in.csv").write_text("\n".join(LINES) + "\n")
    rows = tables.load_samples(spark, str(tmp_path / "in.csv")).orderBy("id").collect()
    assert [(r.latitude, r.longitude, r.note) for r in rows] == [(20.5, 77.1, 'a "b", c'), (21.5, 78.1, "plain")]


def test_written_text_is_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "x", y'), (2, "back\\slash")], "id long, note string")
    tables.write_csv(df, str(tmp_path / "out"))
    assert sorted((r.id, r.note) for r in tables.load_samples(spark, str(tmp_path / "out")).collect()) == [(1, 'say "x", y'), (2, "back\\slash")]


def test_warm_up_sees_original_rows_of_both_classes(spark, monkeypatch):
    seen = {}

    class Fits:
        def fit(self, df):
            seen["rows"] = df.collect()

    monkeypatch.setattr(models, "estimator", lambda *a: Fits())
    rows = spark.range(400).select("id", (F.col("id") % 4 == 0).cast("int").alias("label"))
    table = rows.select(F.col("id").alias("row_id"), "label").unionByName(
        rows.select((-1 - F.col("id")).alias("row_id"), F.lit(1).alias("label")))
    models.warm_up({}, table, replace(Settings(), warmup_rows=200))
    assert len(seen["rows"]) == 200 and all(r.row_id >= 0 for r in seen["rows"])
    assert sum(r.label for r in seen["rows"]) == 50


def test_fresh_run_leaves_no_old_zone(spark, tmp_path):
    for name in (*registry.RUN_FOLDERS, "global"):
        (tmp_path / name / "ecozone=7").mkdir(parents=True)
        (tmp_path / name / "ecozone=7" / "part").write_text("x")
    registry.clear_run(spark, str(tmp_path))
    registry.clear_run(spark, str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["global"]


def test_period_samples_go_into_training(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    views = [catalogue.view(spark, sf, v) for v in ("obs", "static", "rings")]
    rows = dataset.with_row_ids(dataset.period_samples(*views, catalogue.START, catalogue.END))
    ids = [r[0] for r in rows.orderBy("pixel_id").select("row_id").collect()]
    assert ids == list(range(len(ids))) and ids
    settings = replace(Settings(), eps_km=3000.0, min_samples=1, min_macro_rows=1, min_cluster_rows=1, min_zone_rows=1)
    got = training.train_all(rows, str(tmp_path / "run"), settings, k=2, balance=False, oof=False, attributions=False)
    assert got.count() >= 1 and got.filter("status = 'FAILED'").count() == 0


def test_row_ids_follow_file_order_at_any_split_size(spark, tmp_path):
    want, n = [], 0
    for name, rows in (("a.csv", 700), ("b.csv", 0), ("c.csv", 1), ("d.csv", 900)):
        lines = [f"{name}-{i},{i}" for i in range(rows)]
        (tmp_path / name).write_text("\n".join(["place,v", *lines]) + "\n")
        want += [line.split(",")[0] for line in lines]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size, cost in (("1000", "10"), ("3777", "4000000"), ("128m", "4m")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            df = tables.load_samples(spark, str(tmp_path))
            assert df.columns[0] == "row_id" and [r.place for r in df.orderBy("row_id").collect()] == want
            assert [r.row_id for r in df.orderBy("row_id").collect()] == list(range(len(want)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_types_of_odd_texts(spark):
    cases = {"bigint": ["12", " -7 ", "+3\t", None], "double": ["12", "2.5", ".5", "-1e3", " nan ", "Infinity", "inf", "9223372036854775808", "1d"],
             "string": ["12", "1 2"], "none": [None, None], "dirty": ["[0.5]", "1"], "word": ["Never"], "blank": ["1", ""]}
    n = max(map(len, cases.values()))
    rows = list(zip(*[(v * n)[:n] for v in cases.values()]))
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cases))
    want = {"bigint": "bigint", "double": "double", "none": "bigint"}
    assert dict(tables.with_found_types(df).dtypes) == {c: want.get(c, "string") for c in cases}
    assert {t for _, t in tables.with_found_types(df.limit(0)).dtypes} == {"string"}


def test_texts_that_are_no_whole_numbers_are_typed_as_fast(spark, tmp_path):
    def seconds(text):
        path = f"{tmp_path}/{len(text)}"
        spark.range(1_500_000).select(*[F.concat(F.lit(text), F.col("id").cast("string")).alias(f"c{i}") for i in range(6)]).write.parquet(path)
        df = spark.read.parquet(path)
        tables.with_found_types(df.limit(1000))
        t0 = time.monotonic()
        tables.with_found_types(df)
        return time.monotonic() - t0
    whole, real, word = seconds("1"), seconds("1."), seconds("abc")
    assert max(real, word) < 2 * whole + 1
