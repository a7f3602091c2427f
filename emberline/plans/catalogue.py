"""Registered queries: a Spark callable each and, where SQL can say the same, its text for a SQL engine.

In the SQL texts ``$name`` stands for a derived view of ``emberline.sources.views``. Floating results are rounded
on both sides, because engines may differ in the last bit.
"""
from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.config import Settings
from emberline.functions import climate, columns
from emberline.operators import (clean, composites, explain, metrics, models, prep, quantiles, reports, resample, scan,
                                 spatial, split, zoning)
from emberline.plans import dataset, scoring, training
from emberline.sources import registry as store, tables
from emberline.sources.views import VIEWS, duckdb_view, load, view
from emberline.storage import materialize, new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = re.sub(r"\$(\w+)", lambda m: duckdb_view(m.group(1)) if m.group(1) in VIEWS else m.group(0), sql)
        return fn
    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


SMALL = Settings(eps_km=12.0, min_samples=8, min_macro_rows=50, min_cluster_rows=10, min_zone_rows=200, boost_rounds=3,
                 boost_depth=3, cv_repeats=1, cv_folds=2, zone_workers=8, warmup_gate=0.0)
START, END = "2024-01-01", "2024-02-01"

# --------------------------------------------------------------------------------------------------------------
# SQL pieces shared by several texts
# --------------------------------------------------------------------------------------------------------------
HAVERSINE = ("2*6371.0*asin(sqrt(least(1.0, pow(sin((radians({b}.latitude)-radians({a}.latitude))/2),2)"
             "+cos(radians({a}.latitude))*cos(radians({b}.latitude))"
             "*pow(sin((radians({b}.longitude)-radians({a}.longitude))/2),2))))")
AP_CTE = """g as (select ecozone, y_prob, sum(y_true)::bigint as pos, count(*) as n from $scored group by 1, 2),
  c as (select *, sum(pos) over w as cp, sum(n) over w as cn from g
        window w as (partition by ecozone order by y_prob desc)),
  ap as (select ecozone, coalesce(sum(pos * (cp::double / cn)) / nullif(sum(pos), 0), 0) as pr_auc from c group by 1)"""


def sweep_cte(thresholds: list[float]) -> str:
    rows = ", ".join(f"({t!r}::double)" for t in thresholds)
    return f"""t(threshold) as (values {rows}),
  k as (select ecozone, threshold, count(*) filter (y_prob >= threshold and y_true = 1) as tp,
        count(*) filter (y_prob >= threshold and y_true = 0) as fp,
        count(*) filter (y_prob < threshold and y_true = 1) as fn,
        count(*) filter (y_prob < threshold and y_true = 0) as tn from $scored, t group by 1, 2),
  m as (select *, coalesce((tp + tn)::double / nullif(tp + tn + fp + fn, 0), 0) as accuracy,
        coalesce(tp::double / nullif(tp + fp, 0), 0) as precision, coalesce(tp::double / nullif(tp + fn, 0), 0) as recall,
        coalesce(2.0::double * tp / nullif(2.0::double * tp + fn + fp, 0), 0) as f1,
        coalesce(5.0::double * tp / nullif(5.0::double * tp + 4.0 * fn + fp, 0), 0) as f2 from k)"""


SWEEP_SQL = f"""with {AP_CTE}, {sweep_cte(metrics.EVAL_THRESHOLDS)},
  s as (select m.*, ap.pr_auc, 0.6::double * f2 + 0.3::double * f1 + 0.1::double * pr_auc as score from m join ap using (ecozone)),
  r as (select *, row_number() over (partition by ecozone order by score desc, threshold) as rn,
        max(f1) over (partition by ecozone) as bf1, max(f2) over (partition by ecozone) as bf2 from s)
  select ecozone, round(threshold, 6) as best_threshold, round(score, 6) as best_score, round(pr_auc, 6) as pr_auc,
    round(bf1, 6) as f1, round(bf2, 6) as f2, tn, fp, fn, tp, round(accuracy, 6) as accuracy,
    round(precision, 6) as precision, round(recall, 6) as recall from r where rn = 1"""
ROC_SQL = """with g as (select ecozone, y_prob, sum(y_true)::bigint as pos, count(*) as n from $scored group by 1, 2),
  c as (select *, sum(pos) over w as tp, sum(n - pos) over w as fp from g
        window w as (partition by ecozone order by y_prob desc)),
  l as (select *, lag(tp, 1, 0) over w as tp0, lag(fp, 1, 0) over w as fp0 from c
        window w as (partition by ecozone order by y_prob desc))
  select ecozone, round(sum((fp - fp0) * (tp + tp0) / 2.0::double) / (sum(pos)::double * sum(n - pos)), 6) as auc from l group by 1"""
REG_SQL = """with r as (select *, exp(y_log) - 1 as t, exp(pred_log) - 1 as p from $reg)
  select ecozone, round(1 - sum(pow(y_log - pred_log, 2)) / (var_pop(y_log) * count(*)), 6) as r2_log_space,
    round(avg(pow(t - p, 2)), 4) as mse_raw, round(sqrt(avg(pow(t - p, 2))), 6) as rmse_raw, round(avg(abs(t - p)), 6) as mae_raw,
    round(avg(pow(greatest(t - p, 0), 2)), 4) as asymmetric_underestimation_cost,
    count(*) filter (t > 500 and t - p > 0.3::double * t) as catastrophic_miss_count,
    round(count(*) filter (t > 500 and t - p > 0.3::double * t)::double / count(*), 6) as catastrophic_rate,
    round(avg(pow(greatest(t - p, 0), 2) + 0.1::double * pow(greatest(p - t, 0), 2)), 4) as asymmetric_loss from r group by 1"""
# Cleaned samples: brackets, target, temperature, NDVI, wind index.
NDVI_NUM = "try_cast(regexp_replace(NDVI, '[\\[\\]]', '', 'g') as double)"
CLEAN_SQL = f"""(select * exclude (NDVI, temperature_2m, fire_intensity, vapor_pressure_deficit, wind_speed, "system:index", "date"),
   coalesce({NDVI_NUM}, 0) as NDVI, coalesce({NDVI_NUM}, 0) / 10000.0::double as ndvi_scaled,
   coalesce(try_cast(fire_intensity as double),
            (select median(try_cast(fire_intensity as double)) from $samples)) as fire_intensity,
   coalesce(nullif(temperature_2m, 0), (select median(nullif(temperature_2m, 0)) from $samples)) as temperature_2m,
   coalesce(nullif(temperature_2m, 0), (select median(nullif(temperature_2m, 0)) from $samples)) - 273.15::double as temp_c,
   coalesce(try_cast(vapor_pressure_deficit as double), 0) as vapor_pressure_deficit, coalesce(wind_speed, 0) as wind_speed,
   coalesce(try_cast(vapor_pressure_deficit as double), 0) * coalesce(wind_speed, 0) as vpd_wind_idx from $samples)"""


# --------------------------------------------------------------------------------------------------------------
# Sources, cleaning and scalar features
# --------------------------------------------------------------------------------------------------------------
@query("load_clean", f"""select row_id, latitude, longitude, {NDVI_NUM} as NDVI, temperature_2m, relative_humidity,
  try_cast(vapor_pressure_deficit as double) as vapor_pressure_deficit, wind_speed, total_precipitation_sum, volumetric_soil_water_layer_1, flat_layer, land_class,
  fire_detected::bigint as fire_detected, fire_intensity, ecozone::bigint as ecozone, year::bigint as year from $samples""")
def load_clean(spark, sf):
    path = new_path(spark, "samples")
    tables.write_csv(view(spark, sf, "samples"), path)
    return clean.clean_brackets(tables.load_samples(spark, path))


@query("predictions_sink", """select row_id, ecozone, y_true, round(y_prob, 6) as fire_prob,
  case when y_prob >= 0.5 then 1 else 0 end as fire_label from $scored""")
def predictions_sink(spark, sf):
    path = new_path(spark, "predictions")
    s = view(spark, sf, "scored").withColumnRenamed("y_prob", "fire_prob")
    tables.write_predictions(s.withColumn("fire_label", columns.fire_label(F.col("fire_prob"), F.lit(0.5))), path)
    back = spark.read.option("header", True).schema(
        "row_id long, ecozone int, y_true int, fire_prob double, fire_label int").csv(path)
    return rounded(back)


@query("observation_scan", """select pixel_id, band, count(*) as n, round(sum(value), 6) as total from $obs
  where band in ('temperature_2m', 'NDVI') group by 1, 2""")
def observation_scan(spark, sf):
    path = new_path(spark, "obs")
    o = view(spark, sf, "obs").select(F.lit("weather").alias("dataset"), "pixel_id", F.lit(0.0).alias("lat"),
                                      F.lit(0.0).alias("lon"), "ts", "band", "value")
    tables.write_observations(o, path)
    got = tables.scan_observations(spark, path, "weather", ["temperature_2m", "NDVI"])
    return rounded(got.groupBy("pixel_id", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


@query("yearly_export", """select year, count(*) as n, sum(row_id)::bigint as id_sum from $samples group by 1""")
def yearly_export(spark, sf):
    path = new_path(spark, "yearly")
    tables.write_yearly(view(spark, sf, "samples").select("row_id", "year", "fire_detected"), path)
    back = spark.read.option("header", True).schema("row_id long, fire_detected int, year int").csv(path)
    return back.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("id_sum"))


@query("drop_columns", "select row_id, latitude, longitude, ecozone from $samples")
def drop_columns(spark, sf):
    s = view(spark, sf, "samples").select("row_id", "system:index", "date", "latitude", "longitude", "ecozone",
                                          F.lit(1).alias("zone_id"), F.lit(2).alias("fire_size_after"))
    return clean.drop_leakage(clean.drop_configured(s))


@query("bracket_text", """select row_id, regexp_replace(NDVI, '[\\[\\]]', '', 'g') as NDVI,
  try_cast(vapor_pressure_deficit as double) as vapor_pressure_deficit, land_class from $samples""")
def bracket_text(spark, sf):
    s = view(spark, sf, "samples").select("row_id", "NDVI", "vapor_pressure_deficit", "land_class")
    return clean.clean_brackets(s, keep_text=True)


@query("target_median_fill", """select row_id, round(coalesce(try_cast(fire_intensity as double),
  (select median(try_cast(fire_intensity as double)) from $samples)), 6) as fire_intensity from $samples""")
def target_median_fill(spark, sf):
    return rounded(clean.fill_target(view(spark, sf, "samples").select("row_id", "fire_intensity")))


@query("temperature_impute", """select row_id, round(t, 6) as temperature_2m, round(t - 273.15, 6) as temp_c from (
  select row_id, coalesce(nullif(temperature_2m, 0), (select median(nullif(temperature_2m, 0)) from $samples)) as t from $samples)""")
def temperature_impute(spark, sf):
    return rounded(clean.fill_temperature(view(spark, sf, "samples").select("row_id", "temperature_2m")))


@query("ndvi_scale", """select row_id, coalesce(try_cast(NDVI as double), 0) as NDVI,
  round(coalesce(try_cast(NDVI as double), 0) / 10000, 8) as ndvi_scaled from $samples""")
def ndvi_scale(spark, sf):
    return rounded(clean.scale_ndvi(view(spark, sf, "samples").select("row_id", "NDVI")), 8)


@query("vpd_wind", """select row_id, v as vapor_pressure_deficit, w as wind_speed, round(v * w, 6) as vpd_wind_idx from (
  select row_id, coalesce(try_cast(vapor_pressure_deficit as double), 0) as v, coalesce(wind_speed, 0) as w from $samples)""")
def vpd_wind(spark, sf):
    return rounded(clean.vpd_wind(view(spark, sf, "samples").select("row_id", "vapor_pressure_deficit", "wind_speed")))


@query("coord_ffill", """select row_id, round(coalesce(last_value(latitude ignore nulls) over w, 0), 6) as latitude,
  round(coalesce(last_value(longitude ignore nulls) over w, 0), 6) as longitude from $samples
  window w as (order by row_id rows between unbounded preceding and current row)""")
def coord_ffill(spark, sf):
    s = view(spark, sf, "samples").select("row_id", "latitude", "longitude")
    return rounded(clean.fill_coordinates(s, hot_rows=100_000))


@query("engineer_features", f"""select row_id, round(NDVI, 6) as NDVI, round(ndvi_scaled, 6) as ndvi_scaled,
  round(fire_intensity, 6) as fire_intensity, round(temp_c, 6) as temp_c, round(vpd_wind_idx, 6) as vpd_wind_idx,
  round(coalesce(last_value(latitude ignore nulls) over w, 0), 6) as latitude,
  round(coalesce(last_value(longitude ignore nulls) over w, 0), 6) as longitude from {CLEAN_SQL}
  window w as (order by row_id rows between unbounded preceding and current row)""")
def engineer_features(spark, sf):
    df = clean.engineer_features(clean.drop_configured(view(spark, sf, "samples")))
    return rounded(df.select("row_id", "NDVI", "ndvi_scaled", "fire_intensity", "temp_c", "vpd_wind_idx", "latitude", "longitude"))


@query("log_target", """select row_id, round(ln(1 + v), 6) as y_log, round(exp(ln(1 + v)) - 1, 4) as back from (
  select row_id, coalesce(try_cast(fire_intensity as double), 0) as v from $samples)""")
def log_target(spark, sf):
    v = F.coalesce(columns.number_or_null(F.col("fire_intensity")), F.lit(0.0))
    return view(spark, sf, "samples").select("row_id", F.round(F.log1p(v), 6).alias("y_log"),
                                             F.round(F.expm1(F.log1p(v)), 4).alias("back"))


NULL_COLS = ["latitude", "longitude", "NDVI", "temperature_2m", "wind_speed", "total_precipitation_sum",
             "volumetric_soil_water_layer_1", "land_class"]


@query("null_share", " union all ".join(
    f"select '{c}' as \"column\", round(avg(case when {c} is null then 1.0 else 0.0 end), 6) as null_share from $samples"
    for c in NULL_COLS))
def null_share(spark, sf):
    return rounded(clean.null_shares(view(spark, sf, "samples"), NULL_COLS))


@query("screened_columns", """select row_id, latitude, longitude, temperature_2m, wind_speed, volumetric_soil_water_layer_1
  from $samples""")
def screened_columns(spark, sf):
    s = view(spark, sf, "samples").select("row_id", "latitude", "longitude", "temperature_2m", "wind_speed",
                                          "total_precipitation_sum", "volumetric_soil_water_layer_1", "flat_layer")
    return clean.drop_constant(clean.drop_mostly_null(s, 0.8, keep=("row_id",)), keep=("row_id",))


@query("constant_columns", " union all ".join(
    f"select '{c}' as \"column\", min({c})::double as low, max({c})::double as high from $samples"
    for c in ("relative_humidity", "wind_speed", "flat_layer", "volumetric_soil_water_layer_1")))
def constant_columns(spark, sf):
    return clean.value_spans(view(spark, sf, "samples"),
                             ["relative_humidity", "wind_speed", "flat_layer", "volumetric_soil_water_layer_1"])


@query("shrink_projection", """select row_id, round(longitude * cos(radians(latitude)), 6) as x, round(latitude, 6) as y,
  round(radians(latitude), 6) as lat_rad, round(radians(longitude), 6) as lon_rad from $geo""")
def shrink_projection(spark, sf):
    lat, lon = F.col("latitude"), F.col("longitude")
    return rounded(view(spark, sf, "geo").select("row_id", columns.shrink_longitude(lat, lon).alias("x"), lat.alias("y"),
                                                 F.radians(lat).alias("lat_rad"), F.radians(lon).alias("lon_rad")))


@query("attribution_sample", """select row_id, round(coalesce(try_cast(NDVI as double),
    (select median(try_cast(NDVI as double)) from $samples)), 6) as NDVI,
  round(coalesce(wind_speed, (select median(wind_speed) from $samples)), 6) as wind_speed,
  round(coalesce(volumetric_soil_water_layer_1, (select median(volumetric_soil_water_layer_1) from $samples)), 6)
    as volumetric_soil_water_layer_1 from $samples""")
def attribution_sample(spark, sf):
    s = view(spark, sf, "samples").select("row_id", "NDVI", "wind_speed", "volumetric_soil_water_layer_1", "land_class")
    return rounded(clean.clean_attribution_sample(s))


@query("scoring_matrix", "select row_id, NDVI, ecozone from $samples")
def scoring_matrix(spark, sf):
    return clean.feature_matrix(view(spark, sf, "samples").select(
        "row_id", "NDVI", "ecozone", "fire_detected", "fire_intensity"))


@query("severity_label", """select row_id, round(y_prob * 100 * (1 + row_id % 7), 6) as soft_severity,
  case when y_prob >= 0.4 then 1 else 0 end as fire_label from $scored""")
def severity_label(spark, sf):
    s = view(spark, sf, "scored").select("row_id", F.col("y_prob").alias("fire_prob"), F.lit(0.4).alias("thr"),
                                         (100.0 * (1 + F.col("row_id") % 7)).alias("pred_intensity"))
    return rounded(scoring.with_outputs(s).select("row_id", "soft_severity", "fire_label"))


@query("prob_clip_focal", """select ecozone, round(avg(pow(1 - exp(-bce), 2) * bce), 6) as loss, round(min(p), 8) as p_min from (
  select ecozone, p, -(y * ln(p) + (1 - y) * ln(1 - p)) as bce from (
    select ecozone, greatest(1e-6::double, least(y_prob, 1 - 1e-6::double)) as p, y_true * 0.95::double + 0.05::double / 2 as y from $scored))
  group by 1""")
def prob_clip_focal(spark, sf):
    s = view(spark, sf, "scored").select("ecozone", columns.clip_probability(F.col("y_prob")).alias("p"),
                                         columns.smooth_label(F.col("y_true"), 0.05).alias("y"))
    g = s.groupBy("ecozone").agg(columns.focal_loss(F.col("p"), F.col("y")).alias("loss"), F.min("p").alias("p_min"))
    return g.select("ecozone", F.round("loss", 6).alias("loss"), F.round("p_min", 8).alias("p_min"))


@query("map_frame", """select row_id, round(latitude, 6) as latitude, round(longitude, 6) as longitude,
  try_cast(NDVI as double) as NDVI from $samples
  where latitude is not null and longitude is not null and try_cast(NDVI as double) is not null""")
def map_frame(spark, sf):
    return rounded(clean.clean_map_frame(view(spark, sf, "samples").select("row_id", "latitude", "longitude", "NDVI"), "NDVI"))


@query("sequence_window", """select event_id as row_id, user_id as pixel_id, len(s) as steps, round(s[1], 6) as oldest,
  round(s[len(s)], 6) as newest, round(list_sum(s), 4) as total from (
  select *, list_concat(list_transform(range(least(7, n) - len(l)), lambda x: 0.0::double), l) as s from (
    select event_id, user_id, list(value) over (partition by user_id order by event_id rows between 6 preceding and current row) as l,
      count(*) over (partition by user_id) as n from events))""")
def sequence_window(spark, sf):
    e = load(spark, sf, "events").select(F.col("event_id").alias("row_id"), F.col("user_id").alias("pixel_id"), "value")
    s = scan.padded_sequences(e, ["pixel_id"], "row_id", F.col("value"), 7, F.lit(0.0))
    seq = F.col("sequence")
    return s.select("row_id", "pixel_id", F.size(seq).cast("long").alias("steps"), F.round(F.element_at(seq, 1), 6).alias("oldest"),
                    F.round(F.element_at(seq, -1), 6).alias("newest"),
                    F.round(F.aggregate(seq, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("calendar_fields", """select event_id, strftime(ts, '%Y-%m-%d') as date, year(ts)::int as year,
  (dayofyear(ts) - 1)::int as doy from events""")
def calendar_fields(spark, sf):
    return load(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in columns.calendar_fields(F.col("ts")).items()])


@query("geojson_point", """select row_id, round(latitude, 6) as latitude, round(longitude, 6) as longitude,
  '2018_2024_aggregated' as date, true as is_point from $geo""")
def geojson_point(spark, sf):
    g = view(spark, sf, "geo").select("row_id", columns.point_geojson(F.col("latitude"), F.col("longitude")).alias("geometry_json"),
                                      F.lit("2018_2024_aggregated").alias("date"))
    return rounded(g.select("row_id", "date", *[c.alias(n) for n, c in columns.point_lat_lon(F.col("geometry_json")).items()],
                            F.col("geometry_json").contains('"Point"').alias("is_point")))


# --------------------------------------------------------------------------------------------------------------
# Climate and composites
# --------------------------------------------------------------------------------------------------------------
@query("wind_speed", """select l_suppkey as pixel_id, round(sqrt(pow(avg(l_discount * 100 - 5), 2) + pow(avg(l_tax * 100 - 4), 2)), 6)
  as wind_speed from lineitem group by 1""")
def wind_speed(spark, sf):
    li = load(spark, sf, "lineitem")
    return rounded(li.groupBy(F.col("l_suppkey").alias("pixel_id")).agg(climate.wind_speed(
        F.avg(F.col("l_discount") * 100 - 5), F.avg(F.col("l_tax") * 100 - 4)).alias("wind_speed")))


MAGNUS = "0.61094::double * exp(({t} - 273.15::double) * 17.625::double / (({t} - 273.15::double) + 243.04::double))"


@query("humidity_vpd", f"""select pixel_id, obs_date, round(100 * ed / es, 5) as relative_humidity,
  round(es - ed, 6) as vapor_pressure_deficit from (
  select pixel_id, obs_date, {MAGNUS.format(t='t')} as es, {MAGNUS.format(t='d')} as ed from (
    select pixel_id, obs_date, avg(value) filter (band = 'temperature_2m') as t,
      avg(value) filter (band = 'dewpoint_temperature_2m') as d from $obs group by 1, 2))""")
def humidity_vpd(spark, sf):
    d = composites.daily_bands(view(spark, sf, "obs"))
    t, dew = F.col("temperature_2m"), F.col("dewpoint")
    return d.select("pixel_id", "obs_date", F.round(climate.relative_humidity(t, dew), 5).alias("relative_humidity"),
                    F.round(climate.vapour_pressure_deficit(t, dew), 6).alias("vapor_pressure_deficit"))


@query("mean_temperature", """select o_custkey as pixel_id, round((avg(o_totalprice) + avg(sqrt(o_totalprice))) / 2, 4) as temperature_2m
  from orders group by 1""")
def mean_temperature(spark, sf):
    o = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("pixel_id")).agg(
        F.avg("o_totalprice").alias("hi"), F.avg(F.sqrt("o_totalprice")).alias("lo"))
    return rounded(o.select("pixel_id", climate.mean_temperature(F.col("hi"), F.col("lo")).alias("temperature_2m")), 4)


@query("landcover_fraction", """select floor(latitude / 0.1)::bigint as cell_y, floor(longitude / 0.1)::bigint as cell_x,
  round(avg(case when land_class in (1,2,3,4,5) then 1.0 else 0.0 end), 6) as forest_fraction, count(*) as n
  from $static group by 1, 2""")
def landcover_fraction(spark, sf):
    return rounded(composites.forest_fraction(view(spark, sf, "static"), 0.1))


@query("unmask", "select row_id, coalesce(wind_speed, 0) as wind_speed from $samples")
def unmask(spark, sf):
    return view(spark, sf, "samples").select("row_id", columns.unmask(F.col("wind_speed")).alias("wind_speed"))


@query("date_filter", """select band, count(*) as n, round(sum(value), 4) as total from $obs
  where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20' group by 1""")
def date_filter(spark, sf):
    o = composites.between_dates(view(spark, sf, "obs"), "2024-01-05", "2024-01-20")
    return rounded(o.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 4)


@query("attribute_filter", "select c_custkey, c_nationkey from customer where c_mktsegment = 'BUILDING'")
def attribute_filter(spark, sf):
    return load(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_nationkey")


REGION_SQL = """with v as (select *, row_number() over (partition by region, ring order by seq) as i,
    count(*) over (partition by region, ring) as n from $rings),
  e as (select a.region, a.lon as x1, a.lat as y1, b.lon as x2, b.lat as y2 from v a join v b
        on a.region = b.region and a.ring = b.ring and b.i = a.i % a.n + 1)
  select p.row_id, e.region from $geo p join e on (e.y1 > p.latitude) <> (e.y2 > p.latitude)
    and p.longitude < (e.x2 - e.x1) * (p.latitude - e.y1) / (e.y2 - e.y1) + e.x1
  group by 1, 2 having count(*) % 2 = 1"""


@query("region_sample", REGION_SQL)
def region_sample(spark, sf):
    return composites.sample_region(view(spark, sf, "geo"), view(spark, sf, "rings")).select("row_id", "region")


DAILY_SQL = f"""d as (select pixel_id, obs_date, avg(value) filter (band = 'temperature_2m') as t,
    avg(value) filter (band = 'dewpoint_temperature_2m') as dew, sum(value) filter (band = 'total_precipitation') as rain,
    avg(value) filter (band = 'volumetric_soil_water_layer_1') as soil,
    avg(value) filter (band = 'u_component_of_wind_10m') as u, avg(value) filter (band = 'v_component_of_wind_10m') as v,
    coalesce(count(*) filter (band = 'BurnDate' and value > 0), 0) as fire_count from $obs group by 1, 2),
  nd as (select d.pixel_id, d.obs_date, avg(o.value) / 10000 as NDVI from d join $obs o on o.pixel_id = d.pixel_id
    and o.band = 'NDVI' and o.ts >= d.obs_date - interval 16 day and o.ts < d.obs_date group by 1, 2),
  daily as (select d.pixel_id, d.obs_date, t as temperature_2m, rain as total_precipitation, soil as soil_moisture,
    sqrt(u * u + v * v) as wind_speed, 100 * ({MAGNUS.format(t='dew')}) / ({MAGNUS.format(t='t')}) as relative_humidity,
    nd.NDVI, fire_count, (fire_count > 0)::int as fire_detected from d left join nd using (pixel_id, obs_date))"""


@query("daily_composite", f"""with {DAILY_SQL} select pixel_id, obs_date, round(temperature_2m, 5) as temperature_2m,
  round(total_precipitation, 5) as total_precipitation, round(soil_moisture, 5) as soil_moisture,
  round(wind_speed, 5) as wind_speed, round(relative_humidity, 5) as relative_humidity, round(NDVI, 12) as NDVI,
  fire_count, fire_detected from daily""")
def daily_composite(spark, sf):
    d = composites.daily_composite(view(spark, sf, "obs"))
    return d.select("pixel_id", "obs_date", *[F.round(c, 5).alias(c) for c in d.columns[2:7]], F.round("NDVI", 12).alias("NDVI"),
                    "fire_count", "fire_detected")


@query("causal_ndvi", f"with {DAILY_SQL} select pixel_id, obs_date, round(NDVI, 12) as NDVI from daily where NDVI is not null")
def causal_ndvi(spark, sf):
    d = composites.with_causal_ndvi(composites.daily_bands(view(spark, sf, "obs")))
    return rounded(d.filter(F.col("NDVI").isNotNull()).select("pixel_id", "obs_date", "NDVI"), 12)


@query("daily_fire", f"""with cal as (select unnest(generate_series(date '{START}', date '{END}' - 1, interval 1 day))::date as obs_date),
  px as (select distinct pixel_id from $obs),
  f as (select pixel_id, obs_date, count(*) filter (value > 0) as n from $obs where band = 'BurnDate' group by 1, 2)
  select pixel_id, obs_date, coalesce(n, 0) as fire_count, (coalesce(n, 0) > 0)::int as fire_detected
  from px cross join cal left join f using (pixel_id, obs_date)""")
def daily_fire(spark, sf):
    return composites.daily_fire(view(spark, sf, "obs"), START, END)


@query("calendar", """select unnest(generate_series((select min(ts)::date from events), (select max(ts)::date from events), interval 1 day))::date
  as obs_date""")
def calendar(spark, sf):
    lo, hi = load(spark, sf, "events").agg(F.min(F.to_date("ts")), F.date_add(F.max(F.to_date("ts")), 1)).first()
    return composites.calendar(spark, str(lo), str(hi))


@query("period_composite", f"""select pixel_id, round(coalesce(avg(value) filter (band = 'temperature_2m'), 0), 5) as temperature_2m,
  round(coalesce(avg(value) filter (band = 'dewpoint_temperature_2m'), 0), 5) as dewpoint_temperature_2m,
  round(coalesce(avg(value) filter (band = 'total_precipitation'), 0), 5) as total_precipitation,
  round(coalesce(avg(value) filter (band = 'volumetric_soil_water_layer_1'), 0), 5) as volumetric_soil_water_layer_1,
  round(coalesce(avg(value) filter (band = 'u_component_of_wind_10m'), 0), 5) as u_component_of_wind_10m,
  round(coalesce(avg(value) filter (band = 'v_component_of_wind_10m'), 0), 5) as v_component_of_wind_10m,
  round(avg(coalesce(value, 0)) filter (band = 'NDVI'), 7) as NDVI,
  count(*) filter (band = 'BurnDate' and value > 0) as fire_intensity,
  (count(*) filter (band = 'BurnDate' and value > 0) > 0)::int as fire_detected
  from $obs where ts >= timestamp '{START}' and ts < timestamp '{END}' group by 1""")
def period_composite(spark, sf):
    p = composites.period_composite(view(spark, sf, "obs"), START, END)
    return p.select(*[F.round(n, 7 if n == "NDVI" else 5).alias(n) if t == "double" else F.col(n) for n, t in p.dtypes])


@query("grid_downsample", """select floor(latitude / 0.25)::bigint as cell_y, floor(longitude / 0.25)::bigint as cell_x,
  round(avg(elevation), 4) as elevation, round(avg(population_density), 4) as population_density, count(*) as n
  from $static group by 1, 2""")
def grid_downsample(spark, sf):
    return rounded(composites.grid_downsample(view(spark, sf, "static"), 0.25, ["elevation", "population_density"]), 4)


@query("first_image", """select pixel_id, band, ts, value from (select *, row_number() over (
    partition by pixel_id, band order by ts, value nulls first) as rn from $obs
    where ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-25') where rn = 1""")
def first_image(spark, sf):
    return composites.first_image(view(spark, sf, "obs"), "2024-01-03", "2024-01-25").select("pixel_id", "band", "ts", "value")


STACK_COLS = {"elevation": 4, "population_density": 4, "relative_humidity": 5, "NDVI": 12}


@query("band_stack", f"""with {DAILY_SQL} select d.pixel_id, d.obs_date, {', '.join(f'round({c}, {n}) as {c}' for c, n in STACK_COLS.items())},
  fire_count from daily d join $static s on s.pixel_id = d.pixel_id where relative_humidity is not null and NDVI is not null""")
def band_stack(spark, sf):
    d = composites.daily_composite(view(spark, sf, "obs")).select("pixel_id", "obs_date", "relative_humidity", "NDVI", "fire_count")
    s = composites.stack_bands(view(spark, sf, "static").select("pixel_id", "elevation", "population_density"), d)
    s = composites.drop_incomplete(s)
    return s.select("pixel_id", "obs_date", *[F.round(c, n).alias(c) for c, n in STACK_COLS.items()], "fire_count")


@query("fire_zone_profile", f"""with {DAILY_SQL}, s as (select s.ecozone, d.fire_detected, s.population_density, d.NDVI, d.relative_humidity,
    d.temperature_2m - 273.15::double as temp_c from daily d join $static s on s.pixel_id = d.pixel_id
    where d.NDVI is not null and d.relative_humidity is not null)
  select ecozone, count(*) as samples, count(*) filter (fire_detected = 1) as fires,
    round(avg(fire_detected), 6) as fire_rate, round(avg(population_density), 4) as population_density_mean,
    round(avg(NDVI), 6) as ndvi, round(avg(relative_humidity), 4) as humidity, round(avg(temp_c), 4) as temp_c from s group by 1""")
def fire_zone_profile(spark, sf):
    """Flagship: observations to daily composite, causal NDVI, static layers and a profile per zone."""
    daily = composites.daily_composite(view(spark, sf, "obs")).select(
        "pixel_id", "temperature_2m", "relative_humidity", "NDVI", "fire_detected")
    s = composites.stack_bands(view(spark, sf, "static").select("pixel_id", "ecozone", "population_density"), daily)
    s = composites.drop_incomplete(s).withColumn("temp_c", columns.kelvin_to_celsius(F.col("temperature_2m")))
    return s.groupBy("ecozone").agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(F.col("fire_detected") == 1).alias("fires"),
        F.round(F.avg("fire_detected"), 6).alias("fire_rate"), F.round(F.avg("population_density"), 4).alias("population_density_mean"),
        F.round(F.avg("NDVI"), 6).alias("ndvi"), F.round(F.avg("relative_humidity"), 4).alias("humidity"),
        F.round(F.avg("temp_c"), 4).alias("temp_c"))


@query("period_samples", f"""with inside as ({REGION_SQL.replace('p.row_id, e.region', 'p.pixel_id as pixel_id, e.region').replace('$geo p', '$static p')}),
  p as (select pixel_id, coalesce(avg(value) filter (band = 'temperature_2m'), 0) as t,
    coalesce(avg(value) filter (band = 'dewpoint_temperature_2m'), 0) as dew,
    avg(coalesce(value, 0)) filter (band = 'NDVI') as NDVI, count(*) filter (band = 'BurnDate' and value > 0) as fire_intensity
    from $obs where ts >= timestamp '{START}' and ts < timestamp '{END}' group by 1)
  select p.pixel_id, round(s.latitude, 6) as latitude, round(100 * ({MAGNUS.format(t='dew')}) / ({MAGNUS.format(t='t')}), 4) as relative_humidity,
    round(NDVI, 7) as NDVI, fire_intensity, '2024_2024_aggregated' as date
  from p join $static s using (pixel_id) where NDVI is not null and pixel_id in (select pixel_id from inside)""")
def period_samples(spark, sf):
    s = dataset.period_samples(view(spark, sf, "obs"), view(spark, sf, "static"), view(spark, sf, "rings"), START, END)
    return s.select("pixel_id", F.round("latitude", 6).alias("latitude"), F.round("relative_humidity", 4).alias("relative_humidity"),
                    F.round("NDVI", 7).alias("NDVI"), "fire_intensity", "date")


@query("daily_samples", f"""with inside as ({REGION_SQL.replace('p.row_id, e.region', 'p.pixel_id as pixel_id, e.region').replace('$geo p', '$static p')}),
  {DAILY_SQL} select d.pixel_id, strftime(obs_date, '%Y-%m-%d') as date, (dayofyear(obs_date) - 1)::int as doy, year(obs_date)::int as year,
    round(temperature_2m, 4) as temperature_2m, round(wind_speed, 4) as wind_speed, round(NDVI, 12) as NDVI, fire_count
  from daily d join $static s on s.pixel_id = d.pixel_id where d.pixel_id in (select pixel_id from inside)
    and temperature_2m is not null and total_precipitation is not null and soil_moisture is not null and wind_speed is not null
    and relative_humidity is not null and NDVI is not null""")
def daily_samples(spark, sf):
    s = dataset.daily_samples(view(spark, sf, "obs"), view(spark, sf, "static"), view(spark, sf, "rings"), START, END)
    return s.select("pixel_id", "date", "doy", "year", F.round("temperature_2m", 4).alias("temperature_2m"),
                    F.round("wind_speed", 4).alias("wind_speed"), F.round("NDVI", 12).alias("NDVI"), "fire_count")


# --------------------------------------------------------------------------------------------------------------
# Row filters
# --------------------------------------------------------------------------------------------------------------
@query("zone_subset", "select row_id, ecozone from $samples where ecozone = 3")
def zone_subset(spark, sf):
    return zoning.zone_rows(view(spark, sf, "samples").select("row_id", "ecozone"), 3)


@query("small_zone_skip", "select ecozone, count(*) as samples from $samples group by 1 having count(*) >= 200")
def small_zone_skip(spark, sf):
    return zoning.eligible_zones(view(spark, sf, "samples")).select("ecozone", "samples")


@query("fire_only", "select row_id, ecozone from $samples where fire_detected = 1")
def fire_only(spark, sf):
    return view(spark, sf, "samples").filter(F.col("fire_detected") == 1).select("row_id", "ecozone")


@query("rare_extremes", """select row_id, round(y_log, 6) as y_log from $reg
  where y_log >= (select quantile_cont(y_log, 0.9) from $reg) or y_log <= (select quantile_cont(y_log, 0.1) from $reg)""")
def rare_extremes(spark, sf):
    return rounded(resample.extreme_rows(view(spark, sf, "reg").select("row_id", "y_log"), "y_log"))


@query("catastrophic_misses", """select row_id, ecozone from (select *, exp(y_log) - 1 as t, exp(pred_log) - 1 as p from $reg)
  where t > 500 and t - p > 0.3::double * t""")
def catastrophic_misses(spark, sf):
    r = view(spark, sf, "reg")
    return r.filter(metrics.catastrophic(F.expm1("y_log"), F.expm1("pred_log"))).select("row_id", "ecozone")


# --------------------------------------------------------------------------------------------------------------
# Spatial
# --------------------------------------------------------------------------------------------------------------
EPS_PAIRS = f"""pairs as (select a.row_id as a, b.row_id as b from $geo a join $geo b on a.region_id = b.region_id
  where {HAVERSINE.format(a='a', b='b')} <= 12)"""


@query("eps_neighbours", f"with {EPS_PAIRS.replace('on a.region_id = b.region_id', 'on true')} select a as row_id, count(*) as neighbours from pairs group by 1")
def eps_neighbours(spark, sf):
    return spatial.neighbour_counts(view(spark, sf, "geo"), 12.0)


DBSCAN_CTE = f"""{EPS_PAIRS},
  core as (select a from pairs group by a having count(*) >= 8),
  cc as (select p.a, p.b from pairs p join core c on p.a = c.a join core d on p.b = d.a),
  reach(root, node) as (select a, a from core union select r.root, cc.b from reach r join cc on r.node = cc.a where r.root < cc.b),
  comp as (select node, min(root) as root from reach group by 1),
  border as (select p.a as node, min(comp.root) as root from pairs p join comp on comp.node = p.b
             where p.a not in (select a from core) group by 1),
  lab as (select node, root, true as is_core from comp union all select node, root, false from border),
  clusters as (select g.row_id, g.region_id::bigint as part, coalesce(lab.is_core, false) as is_core, lab.root as cluster
               from $geo g left join lab on lab.node = g.row_id)"""


@query("dbscan", f"with recursive {DBSCAN_CTE} select row_id, part, is_core, coalesce(cluster, -1) as cluster from clusters")
def dbscan(spark, sf):
    c = spatial.density_clusters(view(spark, sf, "geo"), 12.0, 8, "region_id")
    return c.withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


ZONES_CTE = """zones as (select part, cluster, n, (row_number() over (order by part, cluster) - 1)::int as zone from (
    select part, cluster, count(*) as n from clusters where cluster is not null group by 1, 2 having count(*) >= 10))"""


@query("zone_numbering", f"with recursive {DBSCAN_CTE}, {ZONES_CTE} select * from zones")
def zone_numbering(spark, sf):
    return zoning.number_zones(spatial.density_clusters(view(spark, sf, "geo"), 12.0, 8, "region_id"), 10)


def _vote_sql(refs: str, k: str, x: str, label: str) -> str:
    return f"""q as (select row_id, latitude as y, {x} as x from $geo), r as (select latitude as y, {x} as x, {label} as label, row_id from {refs}),
  d as (select q.row_id, r.label, sqrt((q.y - r.y) * (q.y - r.y) + (q.x - r.x) * (q.x - r.x)) as d, r.y, r.x, r.row_id as rid from q, r),
  t as (select * from (select *, row_number() over (partition by row_id order by d, y, x, label, rid) as rn from d) where rn <= {k}),
  v as (select row_id, label, count(*) filter (d = 0) as same, sum(case when d > 0 then 1 / d else 0 end) as vote from t group by 1, 2),
  best as (select row_id, label, row_number() over (partition by row_id
           order by same desc, case when same > 0 then 0 else vote end desc, label) as rn from v)
  select row_id, label as ecozone from best where rn = 1"""


SHRINK_X = "longitude * cos(radians(latitude))"


@query("knn_zone", f"""with recursive {DBSCAN_CTE}, {ZONES_CTE},
  refs as (select g.row_id, g.latitude, g.longitude, z.zone from clusters c join zones z using (part, cluster) join $geo g using (row_id)),
  {_vote_sql('refs', '40', SHRINK_X, 'zone')}""")
def knn_zone(spark, sf):
    g = view(spark, sf, "geo")
    c = materialize(spatial.density_clusters(g, 12.0, 8, "region_id"), "clusters")
    z = zoning.number_zones(c, 10)
    refs = g.join(c.join(z, ["part", "cluster"]).select("row_id", F.col("zone").alias("ecozone")), "row_id")
    return spatial.route(g.drop("region_id"), refs, 40, "ecozone", shrink=True).select("row_id", "ecozone")


@query("knn_router", f"""with {_vote_sql('$geo', "(select greatest(20, floor(sqrt(count(*)) / 3)) from $geo)", 'longitude', 'region_id')}""")
def knn_router(spark, sf):
    g = view(spark, sf, "geo").withColumnRenamed("region_id", "ecozone")
    return zoning.assign_zones(g.drop("ecozone"), g).select("row_id", "ecozone")


@query("zone_centroids", """select s.ecozone, count(*) as n, round(avg(c.latitude), 6) as latitude, round(avg(c.longitude), 6) as longitude
  from (select ecozone, latitude, longitude from $static) c join (select distinct ecozone from $static) s using (ecozone) group by 1""")
def zone_centroids(spark, sf):
    s = view(spark, sf, "static")
    sizes = s.groupBy("ecozone").agg(F.count(F.lit(1)).alias("n"))
    return rounded(zoning.with_centroids(sizes, zoning.zone_centroids(s)))


@query("centre_assign", """with c as (select region_id, avg(latitude) as y, avg(longitude) as x from $geo group by 1)
  select row_id, macro_zone from (select g.row_id, c.region_id as macro_zone, row_number() over (partition by g.row_id
    order by (g.latitude - c.y) * (g.latitude - c.y) + (g.longitude - c.x) * (g.longitude - c.x), c.region_id) as rn from $geo g, c) where rn = 1""")
def centre_assign(spark, sf):
    g = view(spark, sf, "geo")
    # One centre per region.
    centres = g.groupBy("region_id").agg(F.avg("latitude").alias("y"), F.avg("longitude").alias("x")).orderBy("region_id").collect()
    ids = F.array(*[F.lit(r["region_id"]) for r in centres])
    i = zoning.nearest_centre([(r["y"], r["x"]) for r in centres])
    return g.select("row_id", F.get(ids, i).alias("macro_zone"))


@query("kmeans_zones")
def kmeans_zones(spark, sf):
    g = view(spark, sf, "geo")
    return g.withColumn("macro_zone", zoning.nearest_centre(zoning.fit_macro_centres(g)))


@query("extract_zones")
def extract_zones(spark, sf):
    return zoning.extract_zones(view(spark, sf, "geo"), SMALL)


# --------------------------------------------------------------------------------------------------------------
# Zone tables and lookups
# --------------------------------------------------------------------------------------------------------------
@query("zone_profile", """select ecozone, count(*) as samples, count(distinct fire_detected)::int as classes,
  count(*) filter (fire_detected = 1) as fires, round(avg(fire_detected), 6) as historical_fire_probability,
  null::double as drought_index_mean, null::double as vegetation_dryness_mean, round(avg(wind_speed), 6) as population_density_mean
  from $samples group by 1""")
def zone_profile(spark, sf):
    s = view(spark, sf, "samples").withColumnRenamed("wind_speed", "population_density")
    return rounded(zoning.zone_profile(s))


@query("zone_list", "select distinct ecozone from $samples order by 1")
def zone_list(spark, sf):
    return zoning.zone_list(view(spark, sf, "samples")).orderBy("ecozone")


@query("safe_zones", """select ecozone, samples, status, case when status = 'SAFE_ZONE' then 1.0 end::double as pr_auc,
  case when status = 'SAFE_ZONE' and fires = 0 then samples else 0 end as tn,
  case when status = 'SAFE_ZONE' and fires > 0 then samples else 0 end as tp from (
  select ecozone, count(*) as samples, count(*) filter (fire_detected = 1) as fires,
    case when count(*) < 200 then 'SKIPPED_SMALL_ZONE' when count(distinct fire_detected) < 2 then 'SAFE_ZONE' else 'TRAINABLE' end as status
  from $samples group by 1)""")
def safe_zones(spark, sf):
    return zoning.screen_zones(zoning.zone_profile(view(spark, sf, "samples"))).select(
        "ecozone", "samples", "status", "pr_auc", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tn", "tp")])


def _registry(spark, sf) -> DataFrame:
    """Registry-like table from the scored views: zones 0 to 6 with thresholds and metrics."""
    sweep = metrics.evaluate_classifier(view(spark, sf, "scored"), ["ecozone"])
    reg = metrics.evaluate_regressor(view(spark, sf, "reg"), ["ecozone"])
    folds = metrics.average_precision(view(spark, sf, "scored").withColumn("fold", F.col("row_id") % 5), ["ecozone", "fold"])
    cv = metrics.cv_summary(folds, ["ecozone"], "pr_auc").select(
        "ecozone", F.col("cv_mean").alias("cv_pr_auc_mean"), F.col("cv_std").alias("cv_pr_auc_std"))
    return (sweep.join(reg, "ecozone").join(cv, "ecozone").withColumnRenamed("best_threshold", "thr")
            .withColumns({"has_clf": F.lit(True), "has_reg": F.lit(True)}))


@query("model_lookup", f"""select s.row_id, s.ecozone, round(coalesce(t.best_threshold, 0.5), 6) as thr, (t.ecozone is not null) as has_clf
  from $samples s left join ({SWEEP_SQL}) t on t.ecozone = s.ecozone""")
def model_lookup(spark, sf):
    reg = metrics.threshold_sweep(view(spark, sf, "scored"), ["ecozone"]).select(
        "ecozone", F.col("best_threshold").alias("thr"), F.lit(True).alias("has_clf"), F.lit(True).alias("has_reg"))
    return rounded(store.model_lookup(view(spark, sf, "samples").select("row_id", "ecozone"), reg).drop("has_reg"))


@query("remaining_zones", """select distinct ecozone from $samples where ecozone not in (select ecozone from $scored)""")
def remaining_zones(spark, sf):
    return zoning.remaining_zones(zoning.zone_list(view(spark, sf, "samples")), view(spark, sf, "scored").select("ecozone").distinct())


@query("prediction_reattach", """select row_id, ecozone, round(y_prob, 6) as fire_prob from $scored order by row_id""")
def prediction_reattach(spark, sf):
    s = view(spark, sf, "scored")
    parts = [zoning.zone_rows(s, z).select("row_id", F.col("y_prob").alias("fire_prob")) for z in range(7)]
    return rounded(zoning.reattach(s.select("row_id", "ecozone"), parts)).orderBy("row_id")


@query("collection_union", """select pixel_id, obs_date, count(*) as n from $obs group by 1, 2""")
def collection_union(spark, sf):
    o = view(spark, sf, "obs")
    bands = [r["band"] for r in o.select("band").distinct().collect()]
    parts = [o.filter(F.col("band") == b).select("obs_date", "pixel_id") for b in bands]
    return reduce(DataFrame.unionByName, parts).groupBy("pixel_id", "obs_date").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------------------------------------------
# Metrics
# --------------------------------------------------------------------------------------------------------------
@query("confusion", """select ecozone, count(*) filter (y_prob < 0.5 and y_true = 0) as tn, count(*) filter (y_prob >= 0.5 and y_true = 0) as fp,
  count(*) filter (y_prob < 0.5 and y_true = 1) as fn, count(*) filter (y_prob >= 0.5 and y_true = 1) as tp from $scored group by 1""")
def confusion(spark, sf):
    return metrics.confusion(view(spark, sf, "scored"), ["ecozone"], 0.5)


@query("class_metrics", f"""with {sweep_cte([0.5])} select ecozone, tn, fp, fn, tp, round(accuracy, 6) as accuracy,
  round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, round(f2, 6) as f2 from m""")
def class_metrics(spark, sf):
    return rounded(metrics.with_class_metrics(metrics.confusion(view(spark, sf, "scored"), ["ecozone"], 0.5)))


@query("avg_precision", f"with {AP_CTE} select ecozone, round(pr_auc, 6) as pr_auc from ap")
def avg_precision(spark, sf):
    return rounded(metrics.average_precision(view(spark, sf, "scored"), ["ecozone"]))


@query("roc_auc", ROC_SQL)
def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(view(spark, sf, "scored"), ["ecozone"]))


@query("roc_curve", """with g as (select ecozone, y_prob, sum(y_true)::bigint as pos, count(*) as n from $scored group by 1, 2)
  select ecozone, round(y_prob, 6) as y_prob, cast(sum(pos) over w as bigint) as tp, cast(sum(n - pos) over w as bigint) as fp from g
  window w as (partition by ecozone order by y_prob desc)""")
def roc_curve(spark, sf):
    return rounded(metrics.roc_points(view(spark, sf, "scored"), ["ecozone"]).select("ecozone", "y_prob", "tp", "fp"))


@query("threshold_sweep", SWEEP_SQL)
def threshold_sweep(spark, sf):
    return rounded(metrics.threshold_sweep(view(spark, sf, "scored"), ["ecozone"]))


@query("tuning_sweep", f"""with {sweep_cte(metrics.TUNE_THRESHOLDS)} select ecozone, round(max(recall), 6) as best_recall,
  round(max(f2), 6) as best_f2 from m group by 1""")
def tuning_sweep(spark, sf):
    return rounded(metrics.tuning_sweep(view(spark, sf, "scored"), ["ecozone"]))


@query("classifier_evaluation", f"select s.*, r.auc from ({SWEEP_SQL}) s join ({ROC_SQL}) r using (ecozone)")
def classifier_evaluation(spark, sf):
    return rounded(metrics.evaluate_classifier(view(spark, sf, "scored"), ["ecozone"]))


def _reg_rounded(df):
    four = ("mse_raw", "asymmetric_underestimation_cost", "asymmetric_loss")
    return df.select(*[F.round(n, 4 if n in four else 6).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


@query("regression_metrics", REG_SQL)
def regression_metrics(spark, sf):
    return _reg_rounded(metrics.evaluate_regressor(view(spark, sf, "reg"), ["ecozone"]))


@query("asymmetric_cost", """with r as (select *, exp(y_log) - 1 as t, exp(pred_log) - 1 as p from $reg)
  select ecozone, round(avg(pow(greatest(t - p, 0), 2) + 0.1::double * pow(greatest(p - t, 0), 2))
    + 10.0::double * count(*) filter (t > 500 and t - p > 0.3::double * t) / count(*), 4) as loss from r group by 1""")
def asymmetric_cost(spark, sf):
    loss = metrics.search_loss(F.expm1("y_log"), F.expm1("pred_log"))
    return rounded(view(spark, sf, "reg").groupBy("ecozone").agg(loss.alias("loss")), 4)


FOLD_CTE = """fg as (select ecozone, row_id % 5 as fold, y_prob, sum(y_true)::bigint as pos, count(*) as n from $scored group by 1, 2, 3),
  fc as (select *, sum(pos) over w as cp, sum(n) over w as cn from fg window w as (partition by ecozone, fold order by y_prob desc)),
  fap as (select ecozone, fold, coalesce(sum(pos * (cp::double / cn)) / nullif(sum(pos), 0), 0) as score from fc group by 1, 2),
  cv as (select ecozone, avg(score) as cv_mean, stddev_pop(score) as cv_std from fap group by 1)"""


@query("cv_summary", f"with {FOLD_CTE} select ecozone, round(cv_mean, 6) as cv_mean, round(cv_std, 6) as cv_std from cv")
def cv_summary(spark, sf):
    s = view(spark, sf, "scored").withColumn("fold", F.col("row_id") % 5)
    return rounded(metrics.cv_summary(metrics.average_precision(s, ["ecozone", "fold"]), ["ecozone"], "pr_auc"))


@query("selection_score", f"""with {AP_CTE}, {FOLD_CTE}, n as (select ecozone, count(*) / 100.0::double as s from $scored group by 1)
  select ecozone as candidate, round(0.55::double * pr_auc + 0.30::double * cv_mean + 0.10::double * (1 - case when cv_mean = 0 then 1 else
    cv_std / (cv_mean + 1e-6::double) end) - 0.05::double * (s / 2.0), 6) as selection from ap join cv using (ecozone) join n using (ecozone)""")
def selection_score(spark, sf):
    s = view(spark, sf, "scored")
    folds = metrics.average_precision(s.withColumn("fold", F.col("row_id") % 5), ["ecozone", "fold"])
    c = (metrics.average_precision(s, ["ecozone"]).withColumnRenamed("pr_auc", "full_pr")
         .join(metrics.cv_summary(folds, ["ecozone"], "pr_auc"), "ecozone")
         .join(s.groupBy("ecozone").agg((F.count(F.lit(1)) / 100.0).alias("full_seconds")), "ecozone"))
    return metrics.selection_scores(c).select(F.col("ecozone").alias("candidate"), F.round("selection", 6).alias("selection"))


@query("prob_hist", """with b as (select min(y_prob) as lo, (max(y_prob) - min(y_prob)) / 50 as w from $scored)
  select bin, round(lo + bin * w, 6) as low, round(lo + (bin + 1) * w, 6) as high, n from (
  select least(floor((y_prob - lo) / w), 49)::int as bin, lo, w, count(*) as n from $scored, b group by 1, 2, 3)""")
def prob_hist(spark, sf):
    return rounded(metrics.probability_histogram(view(spark, sf, "scored")))


@query("density_grid", """select floor(latitude / 0.2)::bigint as cell_y, floor(longitude / 0.2)::bigint as cell_x, count(*) as n from $geo group by 1, 2""")
def density_grid(spark, sf):
    return metrics.density_grid(view(spark, sf, "geo"), 0.2)


@query("quantiles", """select l_returnflag, 'l_extendedprice' as "column", round(quantile_cont(l_extendedprice, 0.1), 4) as q0,
    round(quantile_cont(l_extendedprice, 0.5), 4) as q1, round(quantile_cont(l_extendedprice, 0.9), 4) as q2 from lineitem group by 1
  union all select l_returnflag, 'l_quantity', round(quantile_cont(l_quantity, 0.1), 4), round(quantile_cont(l_quantity, 0.5), 4),
    round(quantile_cont(l_quantity, 0.9), 4) from lineitem group by 1""")
def exact_quantiles(spark, sf):
    return rounded(quantiles.exact_quantiles(load(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"], [0.1, 0.5, 0.9],
                                             ["l_returnflag"]), 4)


@query("mode_impute", """select ecozone, 'land_class' as "column", value, n from (select ecozone, land_class as value, count(*) as n,
  row_number() over (partition by ecozone order by count(*) desc, land_class) as rn from $samples where land_class is not null group by 1, 2) where rn = 1""")
def mode_impute(spark, sf):
    return quantiles.modes(view(spark, sf, "samples"), ["land_class"], ["ecozone"])


def _scale_sql(c: str) -> str:
    return f"""select s.ecozone, '{c}' as "column", round(any_value(m), 6) as median, round(avg(coalesce({c}, m)), 6) as mean,
      round(stddev_pop(coalesce({c}, m)), 6) as std from $samples s join (select ecozone, median({c}) as m from $samples group by 1) z
      on z.ecozone = s.ecozone group by 1"""


@query("scale_stats", _scale_sql("wind_speed") + " union all " + _scale_sql("temperature_2m"))
def scale_stats(spark, sf):
    return rounded(prep.scale_stats(view(spark, sf, "samples"), ["ecozone"], ["wind_speed", "temperature_2m"]))


# --------------------------------------------------------------------------------------------------------------
# Reports
# --------------------------------------------------------------------------------------------------------------
SUMMARY_CTE = f"""s as ({SWEEP_SQL}), r as ({REG_SQL}), cen as (select ecozone, avg(latitude) as latitude, avg(longitude) as longitude
    from $static group by 1), {FOLD_CTE},
  summary as (select s.ecozone as zone, tn + fp + fn + tp as total_samples,
    (tp + fn)::double / greatest(1, tn + fp + fn + tp) as fire_rate, cen.latitude, cen.longitude, pr_auc, f2, accuracy, precision, recall,
    rmse_raw as rmse, r2_log_space as r2, cv_mean, cv_std, tn, fp, fn, tp
    from s join r using (ecozone) join cv using (ecozone) left join cen using (ecozone))"""


def _summary(spark, sf):
    return reports.performance_summary(_registry(spark, sf), zoning.zone_centroids(view(spark, sf, "static")))


@query("zone_summary", f"""with {SUMMARY_CTE} select zone, total_samples, round(fire_rate, 6) as fire_rate, round(latitude, 6) as latitude,
  round(longitude, 6) as longitude, pr_auc, f2, accuracy, precision, recall, rmse, r2, round(cv_mean, 6) as cv_mean,
  round(cv_std, 6) as cv_std, tn, fp, fn, tp from summary""")
def zone_summary(spark, sf):
    return rounded(_summary(spark, sf))


REPORT_SQL = " union all ".join(f"select zone, '{s}' as section, '{c}' as field, round({c}::double, 6) as value from summary where {c} is not null"
                                for s, cols in reports.REPORT.items() for c in cols)


@query("zone_report", f"with {SUMMARY_CTE} {REPORT_SQL}")
def zone_report(spark, sf):
    return rounded(reports.zone_report(_summary(spark, sf)))


@query("global_confusion", f"""with k as (select tn, fp, fn, tp from ({SWEEP_SQL}))
  select 'Actual 0' as actual, sum(tn)::bigint as pred_0, sum(fp)::bigint as pred_1 from k
  union all select 'Actual 1', sum(fn)::bigint, sum(tp)::bigint from k""")
def global_confusion(spark, sf):
    return reports.global_confusion(metrics.threshold_sweep(view(spark, sf, "scored"), ["ecozone"]))


META_SQL = [f"select '{a}' as a, '{b}' as b, round(corr({a}::double, {b}::double), 4) as corr from f"
            for a in reports.META_COLUMNS for b in reports.META_COLUMNS]


@query("meta_corr", f"with {SUMMARY_CTE}, f as (select * from summary where latitude is not null and cv_std is not null) "
       + " union all ".join(META_SQL))
def meta_corr(spark, sf):
    return rounded(reports.meta_correlation(_summary(spark, sf)), 4)


@query("metric_range", f"""with w as ({SWEEP_SQL}) select metric, round(min(score), 5) as low, round(quantile_cont(score, 0.25), 5) as q1,
  round(quantile_cont(score, 0.5), 5) as median, round(quantile_cont(score, 0.75), 5) as q3, round(max(score), 5) as high from (
  {' union all '.join(f"select '{m}' as metric, {m} as score from w" for m in reports.RANGE_METRICS)}) group by 1""")
def metric_range(spark, sf):
    s = rounded(metrics.threshold_sweep(view(spark, sf, "scored"), ["ecozone"]).withColumnRenamed("ecozone", "zone"))
    return rounded(reports.metric_ranges(s), 5)


@query("metric_melt", f"""with w as ({SWEEP_SQL}) {' union all '.join(
    f"select ecozone as zone, '{m}' as metric, {m} as score from w" for m in reports.RANGE_METRICS)}""")
def metric_melt(spark, sf):
    return reports.melt_metrics(rounded(metrics.threshold_sweep(view(spark, sf, "scored"), ["ecozone"])).withColumnRenamed(
        "ecozone", "zone"))


# --------------------------------------------------------------------------------------------------------------
# Splits, preparation, resampling
# --------------------------------------------------------------------------------------------------------------
HASH = "((row_id % 2147483648) * 2654435761 + {seed}) % 4294967296"
SPLIT_CTE = f"""n as (select ecozone, fire_detected, count(*) as n from $samples group by 1, 2),
  t as (select *, ceil(sum(n) over (partition by ecozone) * 0.2::double) as test, sum(n) over (partition by ecozone) as total from n),
  b as (select *, floor(n * test / total) as base, n * test / total - floor(n * test / total) as rest from t),
  qt as (select *, base + case when row_number() over (partition by ecozone order by rest desc, fire_detected)
      <= test - sum(base) over (partition by ecozone) then 1 else 0 end as quota from b),
  sp as (select s.row_id, s.ecozone, s.fire_detected, row_number() over (partition by s.ecozone, s.fire_detected
      order by {HASH.format(seed=42)}, s.row_id) <= case when qt.n > 1 then qt.quota else 0 end as is_test
    from $samples s join qt using (ecozone, fire_detected))"""


@query("stratified_split", f"with {SPLIT_CTE} select row_id, ecozone, fire_detected, is_test from sp")
def stratified_split(spark, sf):
    s = view(spark, sf, "samples").select("row_id", "ecozone", "fire_detected")
    return split.stratified_holdout(s, ["ecozone"], "fire_detected")


@query("random_split", f"""select row_id, row_number() over (order by {HASH.format(seed=42)}, row_id)
  <= ceil(0.25::double * count(*) over ()) as is_test from $samples""")
def random_split(spark, sf):
    return split.random_holdout(view(spark, sf, "samples").select("row_id"), [], 0.25)


@query("year_ordered_split", """select row_id, year, row_number() over (order by year desc, row_id desc)
  <= ceil(0.2::double * count(*) over ()) as is_test from $samples order by year, row_id""")
def year_ordered_split(spark, sf):
    return split.yearly_order(split.ordered_holdout(view(spark, sf, "samples").select("row_id", "year"), [], "year", 0.2))


@query("kfold", """select row_id, ecozone, repeat, ((row_number() over (partition by ecozone, repeat, fire_detected
    order by (((row_id % 2147483648) * 2654435761 + (repeat + 1) * 332598) % 4294967296 * (40503 + 2 * repeat)) % 4294967296, row_id) - 1) % 5)::int as fold
  from $samples, (values (0), (1)) r(repeat)""")
def kfold(spark, sf):
    s = view(spark, sf, "samples").select("row_id", "ecozone", "fire_detected")
    return split.stratified_folds(s, ["ecozone"], "fire_detected", 5, 2).select("row_id", "ecozone", "repeat", "fold")


@query("first_rows", """select row_id, ecozone from (select row_id, ecozone, row_number() over (partition by ecozone order by row_id) as rn
  from $samples) where rn <= 4000""")
def first_rows(spark, sf):
    return split.first_rows(view(spark, sf, "samples").select("row_id", "ecozone"), ["ecozone"], 4000)


@query("seeded_sample", f"""select row_id, ecozone from (select row_id, ecozone, row_number() over (partition by ecozone
  order by {HASH.format(seed=42)}, row_id) as rn from $samples) where rn <= 50""")
def seeded_sample(spark, sf):
    return split.seeded_sample(view(spark, sf, "samples").select("row_id", "ecozone"), ["ecozone"], 50)


@query("warmup_rows", f"""select row_id, fire_detected from (select row_id, fire_detected, count(*) over (partition by fire_detected) as n,
    count(*) over () as total, row_number() over (partition by fire_detected order by {HASH.format(seed=42)}, row_id) as rn from $samples)
  where rn <= greatest(1, least(n, 500 * n // total))""")
def warmup_rows(spark, sf):
    """Original rows of both classes, although as many synthetic fires lie before them."""
    s = view(spark, sf, "samples").select("row_id", "fire_detected")
    made = s.select((-F.col("row_id") - 1).alias("row_id"), F.lit(1).cast(s.schema["fire_detected"].dataType).alias("fire_detected"))
    return split.class_sample(s.unionByName(made), "fire_detected", 500)


def _z(c: str) -> str:
    return f"""round((coalesce({c}, (select median({c}) from tr)) - (select avg(coalesce({c}, (select median({c}) from tr))) from tr))
      / (select stddev_pop(coalesce({c}, (select median({c}) from tr))) from tr), 5) as {c}"""


@query("prep_apply", f"""with {SPLIT_CTE}, x as (select s.*, sp.is_test from $samples s join sp using (row_id)),
  tr as (select * from x where not is_test), mo as (select land_class as m from tr where land_class is not null
    group by 1 order by count(*) desc, 1 limit 1)
  select row_id, {_z('temperature_2m')}, {_z('wind_speed')},
    {', '.join(f"(coalesce(land_class, (select m from mo)) = '{v}')::int::double as land_class_{v}" for v in 'FOP')} from x""")
def prep_apply(spark, sf):
    s = view(spark, sf, "samples").select("row_id", "ecozone", "fire_detected", "temperature_2m", "wind_speed", "land_class")
    s = materialize(split.stratified_holdout(s, ["ecozone"], "fire_detected"), "split")
    fitted = prep.fit_prep(s.filter("NOT is_test"), [], ["temperature_2m", "wind_speed"], ["land_class"])[()]
    out = fitted.apply(s, ["row_id"])
    return rounded(out.toDF(*[c.replace("=", "_") for c in out.columns]), 5)


def _vectors(spark, sf) -> DataFrame:
    return load(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"),
        (F.col("label") < 3).cast("int").alias("label"))


NEAR_CTE = """e as (select vec_id as row_id, embedding::double[] as v, (label < 3)::int as label from embeddings),
  nn as (select * from (select a.row_id, a.label, b.row_id as neighbour, b.label as nl, list_distance(a.v, b.v) as d,
    row_number() over (partition by a.row_id order by list_distance(a.v, b.v), b.row_id) as rn
    from e a join e b on a.row_id <> b.row_id) where rn <= 3)"""


@query("nearest_rows", f"with {NEAR_CTE} select row_id, (rn - 1)::int as place, neighbour, round(d, 6) as d from nn")
def nearest_rows(spark, sf):
    v = _vectors(spark, sf)
    return rounded(resample.nearest_rows(v, v, 3).select("row_id", "place", "neighbour", "d"))


@query("enn", f"with {NEAR_CTE} select row_id, label from nn group by 1, 2 having min(nl) = label and max(nl) = label")
def enn(spark, sf):
    return resample.edited_neighbours(_vectors(spark, sf)).select("row_id", "label")


@query("smote")
def smote(spark, sf):
    return resample.smote(_vectors(spark, sf))


@query("smote_edited")
def smote_edited(spark, sf):
    return resample.smote_edited(_vectors(spark, sf))


@query("adasyn")
def adasyn(spark, sf):
    return resample.adasyn(_vectors(spark, sf))


@query("extreme_noise")
def extreme_noise(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_custkey", "o_orderpriority", "o_totalprice")
    return resample.extreme_noise(o, "o_totalprice")


@query("target_rebalance")
def target_rebalance(spark, sf):
    r = view(spark, sf, "reg").select("row_id", F.array("pred_log").alias("features"), "y_log")
    return resample.rebalance_target(r)


# --------------------------------------------------------------------------------------------------------------
# Models and explanations
# --------------------------------------------------------------------------------------------------------------
def _zoned(spark, sf) -> DataFrame:
    s = clean.drop_configured(view(spark, sf, "samples"))
    return materialize(clean.engineer_features(s.drop("flat_layer", "total_precipitation_sum")), "zoned")


@query("zone_train_score")
def zone_train_score(spark, sf):
    """Train a classifier and a regressor per zone, then score every row with the stored models."""
    out, zoned = new_path(spark, "run"), _zoned(spark, sf)
    training.train_zones(zoned, out, SMALL, balance=False, oof=False, attributions=False)
    return scoring.score_zones(zoned, out).select("row_id", "ecozone", "fire_prob", "pred_intensity", "soft_severity", "fire_label")


def _feature_rows(spark, sf) -> tuple[DataFrame, prep.Prep]:
    z = _zoned(spark, sf)
    fitted = prep.fit_prep(z, [], ["temperature_2m", "ndvi_scaled", "relative_humidity", "wind_speed", "vpd_wind_idx"],
                           ["land_class"])[()]
    return materialize(training.featurise(z, fitted, "fire_detected"), "features"), fitted


TREES = {"family": "leafwise", "rounds": 5, "rate": 0.1, "depth": 3}


@query("oof")
def oof(spark, sf):
    return models.out_of_fold(TREES, _feature_rows(spark, sf)[0], SMALL)


@query("classifier_search")
def classifier_search(spark, sf):
    """All trials of the default settings, over all families and their whole ranges."""
    rows, _ = _feature_rows(spark, sf)
    # A boosted fit starts thousands of jobs: small tables dealt over all cores took longer, probably by the start-up of tasks.
    part = split.stratified_holdout(rows, [], "label").repartition(max(1, rows.count() // 250_000), "row_id")
    part = materialize(part.sortWithinPartitions("row_id"), "part")
    got = models.search_classifier(part.filter("NOT is_test"), part.filter("is_test"), Settings(trial_workers=8))
    return models.scored_by(got.model, part.filter("is_test"))


@query("regressor_search")
def regressor_search(spark, sf):
    z = _zoned(spark, sf)
    fitted = prep.fit_prep(z, [], ["temperature_2m", "ndvi_scaled", "relative_humidity", "wind_speed"], [])[()]
    fires = materialize(training.featurise(z.filter("fire_detected = 1").withColumn("_log", F.log1p("fire_intensity")), fitted, "_log"), "fires")
    space = {"leafwise": {"rounds": (2, 4), "rate": (0.05, 0.3), "depth": (2, 3)}, "forest": {"rounds": (4, 8), "depth": (2, 4)}}
    model, _ = models.select_regressor(fires, fires, replace(SMALL, trials=3), search=True, space=space)
    return models.regression_scored(model, fires)


@query("importance")
def importance(spark, sf):
    rows, fitted = _feature_rows(spark, sf)
    model = models.estimator(TREES, True, 42).fit(rows)
    return explain.top_features(explain.model_importance(model, fitted.names, spark), 40)


@query("tree_shap")
def tree_shap(spark, sf):
    rows, fitted = _feature_rows(spark, sf)
    model = models.estimator(TREES, True, 42).fit(rows)
    wide, _ = explain.tree_attributions(model, rows)
    return explain.long_attributions(wide, fitted.names)


LONG_CTE = """l as (select vec_id as row_id, label as ecozone, 'f_' || (i - 1) as feature, embedding[i]::double as phi
  from embeddings, unnest(generate_series(1, len(embedding))) u(i))"""


def _attributions(spark, sf) -> DataFrame:
    return load(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("label").alias("ecozone"), F.posexplode("embedding").alias("i", "phi")).select(
        "row_id", "ecozone", F.concat(F.lit("f_"), F.col("i").cast("string")).alias("feature"), F.col("phi").cast("double").alias("phi"))


DRIVER_CTE = f"""{LONG_CTE}, g as (select ecozone, feature, avg(abs(phi)) as strength from l group by 1, 2),
  dr as (select *, row_number() over (partition by ecozone order by strength desc, feature) as place from g)"""


@query("top_drivers", f"with {DRIVER_CTE} select ecozone, feature, round(strength, 6) as strength, place::int as place from dr where place <= 10")
def top_drivers(spark, sf):
    return rounded(explain.top_drivers(_attributions(spark, sf), ["ecozone"]))


@query("row_risk", f"with {LONG_CTE} select row_id, round(sum(abs(phi)), 5) as risk from l group by 1")
def row_risk(spark, sf):
    return rounded(explain.row_risk(_attributions(spark, sf)), 5)


@query("narrative", f"""with {DRIVER_CTE} select ecozone, 'Top wildfire drivers in zone ' || ecozone || ':' || chr(10) ||
  string_agg('* ' || feature || ': major driver of risk', chr(10) order by place) as narrative from dr where place <= 10 group by 1""")
def narrative(spark, sf):
    return explain.narrative(explain.top_drivers(_attributions(spark, sf), ["ecozone"]))


@query("approx_attribution", f"""with {LONG_CTE}, im as (select feature, stddev_pop(phi) as w from l group by 1)
  select v.vec_id as row_id, im.feature, round(w / ((select sum(w) from im) + 1e-9::double), 6) as phi from embeddings v, im""")
def approx_attribution(spark, sf):
    imp = _attributions(spark, sf).groupBy("feature").agg(F.stddev_pop("phi").alias("importance"))
    names = [f"f_{i}" for i in range(64)]
    return rounded(explain.approximate_attributions(load(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id")), imp, names))


@query("feature_ranking", f"""with {LONG_CTE} select feature, round(stddev_pop(phi), 6) as importance from l group by 1
  order by stddev_pop(phi) desc, 1 limit 40""")
def feature_ranking(spark, sf):
    imp = _attributions(spark, sf).groupBy("feature").agg(F.stddev_pop("phi").alias("importance"))
    return rounded(explain.top_features(imp, 40))
