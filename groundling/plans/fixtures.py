"""Layers derived from the test tables by integer arithmetic that Spark and DuckDB agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: view: (base tables, SQL text with {table} for each)
VIEWS = {
    "ping": (("supplier",), "SELECT s_suppkey AS qid, 3600101 + (s_suppkey * 15485863) % 20011 AS lat_micro, -8690203 + (s_suppkey * 32452843) % 25013 AS lon_micro FROM {supplier}"),
    "ping_stream": (("events",), "SELECT event_id, ts, user_id, event_type, value, 3600307 + (event_id * 48611 + user_id * 7) % 20011 AS lat_micro, -8690409 + (event_id * 91193 + user_id * 13) % 25013 AS lon_micro FROM {events}"),
    "business": (("customer",), """SELECT c_custkey AS osm_id, c_name AS name, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE lower(c_mktsegment) END AS category,
  CASE WHEN c_custkey % 20 = 0 THEN 'closed' WHEN c_custkey % 20 = 1 THEN 'temporarily_closed' ELSE 'open' END AS operating_status,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('https://b', CAST(c_custkey AS VARCHAR(20))) END AS website,
  3600511 + (c_custkey * 7919) % 20011 AS lat_micro, -8690617 + (c_custkey * 104729) % 25013 AS lon_micro FROM {customer}"""),
    "building": (("part",), """SELECT p_partkey AS osm_id, CASE p_partkey % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'house' WHEN 2 THEN 'retail' WHEN 3 THEN 'industrial' WHEN 4 THEN 'school' ELSE 'barn' END AS building_type,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS name, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 2 END AS height_m FROM {part}"""),
    "building_vertex": (("part",), """SELECT p_partkey AS id, v.pos AS pos, -8690823 + (p_partkey * 104729) % 25013 + v.sx * (50 + p_partkey % 300) AS lon_micro,
  3600719 + (p_partkey * 7919) % 20011 + v.sy * (50 + p_partkey % 300) AS lat_micro FROM {part} CROSS JOIN (VALUES (0,-1,-1),(1,1,-1),(2,1,1),(3,0,0),(4,-1,1)) AS v(pos, sx, sy)"""),
    "park_vertex": (("part",), """SELECT p_partkey AS id, v.pos AS pos, -8691627 + (p_partkey * 104729) % 25013 + v.sx * (200 + p_partkey % 500) AS lon_micro,
  3601523 + (p_partkey * 7919) % 20011 + v.sy * (200 + p_partkey % 500) AS lat_micro FROM (SELECT p_partkey FROM {part} WHERE p_partkey % 4 = 0) AS q CROSS JOIN (VALUES (0,-1,-1),(1,1,-1),(2,1,1),(3,-1,1)) AS v(pos, sx, sy)"""),
    "road": (("orders",), """SELECT o_orderkey AS piece_id, CAST(floor(o_orderkey / 2) AS BIGINT) AS osm_id,
  CASE o_orderkey % 8 WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary' WHEN 3 THEN 'tertiary' WHEN 4 THEN 'residential' WHEN 5 THEN 'service' WHEN 6 THEN 'footway' ELSE 'cycleway' END AS road_class,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('Road ', CAST(o_custkey AS VARCHAR(20))) END AS name FROM {orders}"""),
    "road_vertex": (("orders",), """SELECT o_orderkey AS id, v.pos AS pos, -8691027 + (o_orderkey * 104729) % 25013 + v.pos * ((o_orderkey * 37) % 401 - 200) AS lon_micro,
  3600929 + (o_orderkey * 7919) % 20011 + v.pos * v.pos * ((o_orderkey * 31) % 101 - 50) AS lat_micro FROM {orders} CROSS JOIN (VALUES (0),(1),(2),(3)) AS v(pos)"""),
    "way_tags": (("orders",), """SELECT o_orderkey AS osm_id, CASE o_orderkey % 5 WHEN 0 THEN '35 mph' WHEN 1 THEN '50' WHEN 2 THEN 'walk' WHEN 3 THEN NULL ELSE '300' END AS maxspeed,
  CASE o_orderkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' WHEN 2 THEN 'no' ELSE NULL END AS oneway, CASE o_orderkey % 3 WHEN 0 THEN '2' WHEN 1 THEN '2;3' ELSE NULL END AS lanes,
  CASE o_orderkey % 6 WHEN 0 THEN 'asphalt' WHEN 1 THEN 'cobblestone' ELSE NULL END AS surface, CASE o_orderkey % 9 WHEN 0 THEN 'yes' WHEN 3 THEN 'viaduct' WHEN 6 THEN 'aqueduct' END AS bridge,
  CASE o_orderkey % 10 WHEN 0 THEN 'building_passage' WHEN 5 THEN 'yes' WHEN 7 THEN 'culvert' END AS tunnel FROM {orders}"""),
    "place": (("nation",), """SELECT n_nationkey AS osm_id, n_name AS name, (n_nationkey * 7919) % 250000 AS population,
  CASE n_nationkey % 5 WHEN 0 THEN 'city' WHEN 1 THEN 'town' WHEN 2 THEN 'village' WHEN 3 THEN 'hamlet' ELSE 'neighborhood' END AS place_type,
  3601139 + (n_nationkey * 6007) % 20011 AS lat_micro, -8691231 + (n_nationkey * 9001) % 25013 AS lon_micro FROM {nation}"""),
    "water": (("part",), """SELECT p_partkey AS osm_id, p_partkey % 3 AS geom_type, CASE WHEN p_partkey % 3 = 2 THEN p_partkey % 7 END AS ref_feature_id,
  CASE p_partkey % 4 WHEN 0 THEN 'lake' WHEN 1 THEN 'river' WHEN 2 THEN 'stream' ELSE 'pond' END AS water_type,
  3601349 + (p_partkey * 12289) % 20011 AS lat_micro, -8691433 + (p_partkey * 24593) % 25013 AS lon_micro FROM {part}"""),
    "large_body": (("region",), "SELECT r_regionkey AS feature_id, r_name AS name, 'lake' AS water_type, 3603000 + r_regionkey * 3001 AS lat_micro, -8688000 + r_regionkey * 4001 AS lon_micro, 900 AS half_micro FROM {region}"),
    "admin_grid": (("customer", "nation", "region"), """SELECT g.cy, g.cx, r.r_name AS country, n.n_name AS state, concat('County ', CAST((g.cy + g.cx) % 40 AS VARCHAR(20))) AS county, CAST(37000 + (g.cy * 3 - g.cx) % 500 AS VARCHAR(20)) AS zip, concat('Zone/', CAST(g.cx % 3 AS VARCHAR(20))) AS timezone FROM (SELECT DISTINCT CAST(floor((3600511 + (c_custkey * 7919) % 20011) / 2000) AS BIGINT) AS cy,
  CAST(floor((-8690617 + (c_custkey * 104729) % 25013) / 2000) AS BIGINT) AS cx FROM {customer}) AS g JOIN {nation} AS n ON n.n_nationkey = (g.cy * 31 - g.cx * 17) % 25
  JOIN {region} AS r ON r.r_regionkey = n.n_regionkey WHERE (g.cy * 7 - g.cx * 3) % 17 <> 0"""),
    # near 47, 60, 70 and 80 degrees, half of it across the date line
    "far_ping": (("supplier",), """SELECT s_suppkey AS qid, CASE s_suppkey % 4 WHEN 0 THEN 4700000 WHEN 1 THEN 6000000 WHEN 2 THEN 7000000 ELSE 8000000 END + (s_suppkey * 15485863) % 20011 AS lat_micro,
  CASE WHEN x >= 18000000 THEN x - 36000000 ELSE x END AS lon_micro FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 8 < 4 THEN 17970000 ELSE 1000000 END + (s_suppkey * 32452843) % 60013 AS x FROM {supplier}) AS q"""),
    "far_business": (("customer",), """SELECT c_custkey AS osm_id, CASE c_custkey % 4 WHEN 0 THEN 4700000 WHEN 1 THEN 6000000 WHEN 2 THEN 7000000 ELSE 8000000 END + (c_custkey * 7919) % 20011 AS lat_micro,
  CASE WHEN x >= 18000000 THEN x - 36000000 ELSE x END AS lon_micro FROM (SELECT c_custkey, CASE WHEN c_custkey % 8 < 4 THEN 17970000 ELSE 1000000 END + (c_custkey * 104729) % 60013 AS x FROM {customer}) AS q"""),
    "far_vertex": (("customer",), """SELECT c_custkey AS id, v.pos AS pos, 1000000 + (c_custkey * 104729) % 60013 + v.pos * ((c_custkey * 37) % 4001 - 2000) AS lon_micro,
  CASE c_custkey % 4 WHEN 0 THEN 4700000 WHEN 1 THEN 6000000 WHEN 2 THEN 7000000 ELSE 8000000 END + (c_custkey * 7919) % 20011 + v.pos * ((c_custkey * 31) % 801 - 400) AS lat_micro FROM {customer} CROSS JOIN (VALUES (0),(1),(2)) AS v(pos)"""),
}
VIEWS["rail_vertex"] = (("orders",), VIEWS["road_vertex"][1] + " WHERE o_orderkey % 50 = 0")
VIEWS["intersection"] = (("orders",), "SELECT o_orderkey AS id, 1 + o_orderkey % 4 AS kind, -8691027 + (o_orderkey * 104729) % 25013 AS lon_micro, 3600929 + (o_orderkey * 7919) % 20011 AS lat_micro FROM {orders} WHERE o_orderkey % 10 = 0")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, sql = VIEWS[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def shape(vertices: DataFrame, key: str = "osm_id") -> DataFrame:
    """(key, coords): vertex rows as one array of struct<lon,lat> a feature, in order."""
    rows = vertices.groupBy(F.col("id").alias(key)).agg(F.array_sort(F.collect_list(F.struct("pos", "lon_micro", "lat_micro"))).alias("v"))
    return rows.select(key, F.transform("v", lambda p: F.struct((p["lon_micro"] / 100000.0).alias("lon"), (p["lat_micro"] / 100000.0).alias("lat"))).alias("coords"))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "building").join(shape(view(spark, sf_dir, "building_vertex")), "osm_id")


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "road").join(shape(view(spark, sf_dir, "road_vertex"), "piece_id"), "piece_id")


def oracle(sql: str, *names: str) -> str:
    """SQL text over the named views, as DuckDB runs it."""
    parts = [f"{n} AS ({VIEWS[n][1].format(**{t: t for t in VIEWS[n][0]})})" for n in names]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql
