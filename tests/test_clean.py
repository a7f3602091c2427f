import pytest
from pyspark.sql import functions as F

from emberline import Settings
from emberline.functions import columns
from emberline.operators import clean
from emberline.sources import tables


def col(df, c):
    return [r[c] for r in df.orderBy("row_id").collect()]


def test_brackets(spark):
    df = spark.createDataFrame([(1, "[0.5]", "1", "x"), (2, "['12.3']", "2", "[y"), (3, "7", None, "z")],
                               "row_id int, a string, b string, c string")
    out = clean.clean_brackets(df)
    assert col(out, "a") == [0.5, None, 7.0]
    assert col(out, "b") == ["1", "2", None] and col(out, "c") == ["x", "[y", "z"]
    text = clean.clean_brackets(df, keep_text=True)
    assert col(text, "a") == ["0.5", "'12.3'", "7"] and col(text, "b") == [1.0, 2.0, None] and col(text, "c") == ["x", "y", "z"]


def test_temperature_all_zero(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.0)], "row_id int, temperature_2m double")
    assert col(clean.fill_temperature(df), "temp_c") == [None, None]


def test_temperature_nan_is_missing(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 280.0), (3, 290.0)], "row_id int, temperature_2m double")
    assert col(clean.fill_temperature(df), "temperature_2m") == [285.0, 280.0, 290.0]


@pytest.mark.parametrize("hot", [1, 1000])
def test_coordinates_filled_apart(spark, hot):
    df = spark.createDataFrame([(1, None, 5.0), (2, 1.0, None), (3, None, 6.0), (4, None, None)],
                               "row_id int, latitude double, longitude double")
    out = clean.fill_coordinates(df, hot_rows=hot)
    assert col(out, "latitude") == [0.0, 1.0, 1.0, 1.0] and col(out, "longitude") == [5.0, 5.0, 6.0, 6.0]


def test_null_screen_limits(spark):
    df = spark.range(100).select(F.col("id").alias("row_id"), *[
        F.when(F.col("id") >= n, 1.0).alias(f"c{n}") for n in (80, 81)], F.lit(3.0).alias("flat"), F.col("id").cast("double").alias("x"))
    kept = clean.drop_mostly_null(df, 0.8).columns
    assert "c80" in kept and "c81" not in kept
    assert "flat" not in clean.drop_constant(df).columns and "x" in clean.drop_constant(df).columns


def test_split_columns(spark):
    df = spark.createDataFrame([(1, 2, 3.0, "a", True)], "row_id long, i int, d double, s string, b boolean")
    assert clean.split_columns(df, keep=("row_id",)) == (["d"], ["s"])


def test_steps_without_their_columns(spark):
    df = spark.createDataFrame([(1, 2.0)], "row_id long, other double")
    assert clean.engineer_features(df).columns == ["row_id", "other"]


def test_load_samples(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text('system:index,NDVI,latitude,n,.geo,date\na,[0.5],1.5,1,g,d\nb,3,nan,2,g,d\n')
    df = tables.load_samples(spark, str(p))
    assert df.columns == ["row_id", "NDVI", "latitude", "n"]
    assert dict(df.dtypes)["n"] == "bigint" and dict(df.dtypes)["NDVI"] == "string"
    assert col(df, "latitude") == [1.5, None]
    with pytest.raises(Exception):
        tables.load_samples(spark, str(tmp_path / "absent.csv"))


def test_dense_row_ids(spark):
    df = spark.createDataFrame([(5, "a"), (100, "b"), (7, "c")], "row_id long, x string")
    assert [tuple(r) for r in tables.dense_row_ids(df, hot_rows=1).orderBy("row_id").select("row_id", "x").collect()] == [
        (0, "a"), (1, "c"), (2, "b")]


def test_names(spark):
    df = spark.createDataFrame([("roc_curve.csv", "zone_7"), ("a.txt", "global")], "f string, z string")
    got = df.select(columns.title_label(F.col("f")).alias("t"), columns.zone_of_name(F.col("z")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("Roc Curve", 7), ("A", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 3, "x\ny")], "row_id long, ecozone int, narrative string")
    tables.write_zone_json(df, str(tmp_path / "j"))
    tables.write_zone_json(df.withColumn("ecozone", F.lit(4)), str(tmp_path / "j"))
    assert sorted(r["ecozone"] for r in spark.read.json(str(tmp_path / "j")).collect()) == [3, 4]
    tables.write_text(df, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t"), wholetext=True).first()["value"].strip() == "x\ny"


def test_settings_are_frozen():
    with pytest.raises(Exception):
        Settings().seed = 1
