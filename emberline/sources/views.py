"""Input tables of the registered queries, derived from the driver tables.

One SQL text per view serves both engines: ``{table}`` names a driver table and ``//`` is integer division.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_RING = [(0, -0.25, -0.25), (0, 0.25, -0.25), (0, 0.25, 0.25), (0, 0.0, 0.05), (0, -0.25, 0.25),
         (1, -0.18, -0.18), (1, -0.02, -0.18), (1, -0.02, -0.02), (1, -0.18, -0.02)]
_LAT = "cast(8.0 as double) + 5*({k} // 5) + ((({id}*7919) % 1000) - 500) * cast(0.0006 as double)"
_LON = "cast(70.0 as double) + 4*({k} % 5) + ((({id}*104729) % 1000) - 500) * cast(0.0006 as double)"


def _at(text: str, k: str, row: str) -> str:
    return text.replace("{k}", k).replace("{id}", row)


VIEWS = {
    # Clustered coordinates around 25 centres.
    "geo": f"""select c_custkey as row_id, c_nationkey as region_id,
      {_at(_LAT, 'c_nationkey', 'c_custkey')} as latitude, {_at(_LON, 'c_nationkey', 'c_custkey')} as longitude
      from {{customer}}""",
    # Long observations: ten bands over 30 days, ten users to a pixel.
    "obs": """select user_id // 10 as pixel_id, ts, cast(ts as date) as obs_date,
      case event_type
        when 'view' then case when event_id % 3 = 0 then 'u_component_of_wind_10m' else 'temperature_2m' end
        when 'click' then case when event_id % 3 = 0 then 'v_component_of_wind_10m' else 'dewpoint_temperature_2m' end
        when 'purchase' then case when event_id % 2 = 0 then 'volumetric_soil_water_layer_1' else 'total_precipitation' end
        when 'signup' then 'NDVI' else 'BurnDate' end as band,
      case event_type
        when 'view' then case when event_id % 3 = 0 then (event_id % 70) * cast(0.1 as double) - 3
                              else cast(283.15 as double) + (event_id % 300) * cast(0.1 as double) end
        when 'click' then case when event_id % 3 = 0 then (event_id % 50) * cast(0.1 as double) - 2
                               else cast(278.15 as double) + (event_id % 150) * cast(0.1 as double) end
        when 'purchase' then case when event_id % 2 = 0 then (event_id % 40) * cast(0.01 as double) else value end
        when 'signup' then case when event_id % 17 = 0 then null else cast(event_id % 9000 as double) end
        else cast(event_id % 3 as double) end as value
      from {events}""",
    # Hold-out predictions with tied scores in 7 zones.
    "scored": """select doc_id as row_id, cast(doc_id % 7 as int) as ecozone, cast(quality as int) as y_true,
      cast((doc_id * 7919) % 97 as double) / 97 as y_prob from {labels}""",
    # True and predicted fire intensity in 7 zones.
    "reg": """select o_orderkey as row_id, cast(o_custkey % 7 as int) as ecozone,
      ln(1 + o_totalprice / 400) as y_log,
      ln(1 + o_totalprice / 400 * (cast(0.5 as double) + cast((o_orderkey * 7919) % 97 as double) / 97 * cast(0.7 as double))) as pred_log
      from {orders}""",
    # Dirty sample table.
    "samples": f"""select o_orderkey as row_id, cast(o_orderkey as string) as "system:index",
      case when o_orderkey % 7 < 2 then null else {_at(_LAT, '(o_custkey % 25)', 'o_orderkey')} end as latitude,
      case when o_orderkey % 5 = 0 then null else {_at(_LON, '(o_custkey % 25)', 'o_orderkey')} end as longitude,
      case when o_orderkey % 11 = 0 then concat('[', cast(o_orderkey % 9000 as string), '.5]')
           when o_orderkey % 13 = 0 then concat('[''', cast(o_orderkey % 90 as string), '.3'']')
           when o_orderkey % 17 = 0 then null else cast(o_orderkey % 9000 as string) end as NDVI,
      case when o_orderkey % 10 = 0 then cast(0 as double) when o_orderkey % 19 = 0 then null
           else cast(273.15 as double) + (o_orderkey % 400) * cast(0.1 as double) end as temperature_2m,
      cast(20 as double) + (o_custkey % 600) * cast(0.1 as double) as relative_humidity,
      case when o_orderkey % 37 = 0 then null else concat(cast(o_orderkey % 3 as string), '.25') end as vapor_pressure_deficit,
      case when o_orderkey % 41 = 0 then null else cast(o_custkey % 80 as double) / 8 end as wind_speed,
      case when o_orderkey % 100 < 81 then null else cast(o_orderkey % 50 as double) end as total_precipitation_sum,
      case when o_orderkey % 100 < 80 then null else cast(o_orderkey % 30 as double) end as volumetric_soil_water_layer_1,
      cast(7 as double) as flat_layer,
      case when o_orderkey % 29 = 0 then null else o_orderstatus end as land_class,
      '2018_2024_aggregated' as "date",
      cast(case when o_custkey % 12 = 5 and o_orderkey % 1000 <> 7 then 0
           when o_orderkey % 400 > 250 and o_custkey % 600 < 420 and (o_orderkey * 7919) % 97 < 80 then 1
           when (o_orderkey * 7919) % 97 < 6 then 1 else 0 end as int) as fire_detected,
      case when o_orderkey % 23 = 0 then 'bad' when o_orderkey % 31 = 0 then null
           else cast(cast(floor(o_totalprice / 400) as bigint) as string) end as fire_intensity,
      cast(case when o_orderkey % 1000 = 7 then 12 else o_custkey % 12 end as int) as ecozone,
      cast(year(o_orderdate) as int) as year
      from {{orders}}""",
    # Static layers per pixel.
    "static": f"""select c_custkey as pixel_id, {_at(_LAT, 'c_nationkey', 'c_custkey')} as latitude,
      {_at(_LON, 'c_nationkey', 'c_custkey')} as longitude, c_acctbal as elevation,
      cast(c_custkey % 500 as double) as population_density, cast(c_custkey % 17 as int) as land_class,
      cast(c_custkey % 6 as int) as ecozone from {{customer}}""",
    # One concave region with a hole per nation.
    "rings": " union all ".join(
        f"""select n_name as region, {ring} as ring, {seq} as seq,
        cast(70.0 as double) + 4*(n_nationkey % 5) + cast({dx} as double) as lon,
        cast(8.0 as double) + 5*(n_nationkey // 5) + cast({dy} as double) as lat from {{nation}}"""
        for seq, (ring, dx, dy) in enumerate(_RING)),
}
_TABLE = re.compile(r"\{(\w+)\}")


def duckdb_view(name: str) -> str:
    return "(" + _TABLE.sub(r"\1", VIEWS[name]) + ")"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name].replace("//", "div").replace('"', "`").replace("''", "\\'")
    tables = {t: load(spark, sf_dir, t) for t in set(_TABLE.findall(text))}
    return spark.sql(text, **tables)
