"""Lookup queries and their SQL. The SQL joins every pair, so that a cell forgotten in the cell join shows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import geo, grid
from ..operators import lookup as L
from .fixtures import buildings, oracle, roads, shape, view

BOX = (36.08, -86.84, 36.14, -86.76)
PATH = [(-86.88, 36.05), (-86.80, 36.10), (-86.72, 36.18)]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = oracle(sql, *views)
        return f

    return keep


HAV = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({f}.lat_micro / 100000.0 - p.lat_micro / 100000.0) / 2), 2) + cos(radians(p.lat_micro / 100000.0)) * cos(radians({f}.lat_micro / 100000.0)) * pow(sin(radians({f}.lon_micro / 100000.0 - p.lon_micro / 100000.0) / 2), 2))))"
#: Distance of p to every segment of a vertex table v, in steps.
SEGMENT = """seg AS MATERIALIZED (SELECT id, pos AS i, lon_micro / 100000.0 AS ax, lat_micro / 100000.0 AS ay, lead(lon_micro / 100000.0) OVER w AS bx, lead(lat_micro / 100000.0) OVER w AS by_ FROM {v} WINDOW w AS (PARTITION BY id ORDER BY pos)),
 m AS (SELECT p.qid, s.id, s.i, s.ax AS lon0, s.ay AS lat0, s.bx - s.ax AS wx, s.by_ - s.ay AS wy, (s.ax - p.lon_micro / 100000.0) * 111320.0 * greatest(cos(radians(p.lat_micro / 100000.0)), 0.001) AS x, (s.ay - p.lat_micro / 100000.0) * 111320.0 AS y,
  (s.bx - s.ax) * 111320.0 * greatest(cos(radians(p.lat_micro / 100000.0)), 0.001) AS dx, (s.by_ - s.ay) * 111320.0 AS dy FROM ping p CROSS JOIN {seg} s WHERE s.bx IS NOT NULL),
 n AS (SELECT *, CASE WHEN dx * dx + dy * dy < 1e-12 THEN 0.0 ELSE greatest(0.0, least(1.0, -(x * dx + y * dy) / (dx * dx + dy * dy))) END AS t FROM m),
 d AS (SELECT qid, id, i, t, lon0 + t * wx AS snap_lon, lat0 + t * wy AS snap_lat, sqrt((x + t * dx) * (x + t * dx) + (y + t * dy) * (y + t * dy)) AS dist FROM n)"""
CLOSED = """seg2 AS MATERIALIZED (SELECT * FROM seg WHERE bx IS NOT NULL UNION ALL SELECT s.id, s.i, s.ax, s.ay, f.ax, f.ay FROM seg s JOIN seg f ON f.id = s.id AND f.i = 0 WHERE s.bx IS NULL),"""


def steps(v: str, closed: bool = False) -> str:
    first, rest = SEGMENT.format(v=v, seg="seg2" if closed else "seg").split(",\n m AS", 1)
    return first + ",\n " + (CLOSED if closed else "") + " m AS" + rest


INSIDE = """inside AS (SELECT p.qid, e.id FROM ping p CROSS JOIN seg2 e WHERE (e.ay > p.lat_micro / 100000.0) <> (e.by_ > p.lat_micro / 100000.0)
 AND p.lon_micro / 100000.0 < (e.bx - e.ax) * (p.lat_micro / 100000.0 - e.ay) / (e.by_ - e.ay) + e.ax GROUP BY p.qid, e.id HAVING count(*) % 2 = 1)"""


def prefixed(sql: str, p: str) -> str:
    """The same steps under names of their own, beside others."""
    sql = re.sub(r"\bseg(2?)\b", p + r"seg\1", sql)
    sql = re.sub(r"\b([mnd]) AS \(", p + r"\1 AS (", sql)
    return re.sub(r"FROM ([mn])\)", rf"FROM {p}\1)", sql).replace("inside AS", f"{p}inside AS")


def with_views(sql: str, *names: str) -> str:
    return oracle("", *names).rstrip() + ", " + sql


def _near(filters: str = "true", radius: float = 500, limit: int = 10) -> str:
    return f"""SELECT qid, osm_id, rank, round(d, 1) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, osm_id) AS rank
 FROM (SELECT p.qid, b.osm_id, {HAV.format(f="b")} AS d FROM ping p CROSS JOIN business b WHERE {filters}) WHERE d <= {radius}) WHERE rank <= {limit}"""


def _near_columns(df):
    return df.select("qid", "osm_id", "rank", F.round("distance", 1).alias("distance"))


@query("nearby_topk", _near(), "ping", "business")
def nearby_topk(s, d):
    return _near_columns(L.nearby(view(s, d, "ping"), view(s, d, "business")))


@query("nearby_category_prefix", _near("b.category LIKE 'auto%'", 2000, 20), "ping", "business")
def nearby_category_prefix(s, d):
    return _near_columns(L.nearby(view(s, d, "ping"), view(s, d, "business"), 2000, 20, prefix="auto"))


@query("nearby_exclude_closed", _near("b.operating_status <> 'closed'", 3000), "ping", "business")
def nearby_exclude_closed(s, d):
    return _near_columns(L.nearby(view(s, d, "ping"), view(s, d, "business"), 3000, 10, exclude_closed=True))


@query("features_in_cell", "SELECT osm_id, name FROM business WHERE floor(lat_micro / 2000) = 1808 AND floor(lon_micro / 2000) = -4342", "business")
def features_in_cell(s, d):
    keyed = view(s, d, "business").withColumn("cell", grid.cell(F.col("lat_micro"), F.col("lon_micro")))
    return L.in_cell(keyed, (1808 + grid.OFFSET) * grid.WRAP - 4342 + grid.OFFSET).select("osm_id", "name")


@query("cell_stats", "SELECT (CAST(floor(lat_micro / 2000) AS BIGINT) + 8388608) * 16777216 + CAST(floor(lon_micro / 2000) AS BIGINT) + 8388608 AS cell, count(*) AS n, min(lat_micro) AS min_lat_micro, max(lat_micro) AS max_lat_micro, min(lon_micro) AS min_lon_micro, max(lon_micro) AS max_lon_micro FROM business GROUP BY 1", "business")
def cell_stats(s, d):
    return L.cell_stats(view(s, d, "business"))


IN_BOX = "{lat} BETWEEN 36.08 AND 36.14 AND {lon} BETWEEN -86.84 AND -86.76"


@query("bounds_places", "SELECT osm_id, name, place_type FROM place WHERE " + IN_BOX.format(lat="lat_micro / 100000.0", lon="lon_micro / 100000.0") + " ORDER BY osm_id LIMIT 1000", "place")
def bounds_places(s, d):
    return L.points_in_box(view(s, d, "place"), *BOX).select("osm_id", "name", "place_type")


@query("bounds_buildings", "SELECT osm_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM (SELECT id AS osm_id, avg(lat_micro / 100000.0) AS lat, avg(lon_micro / 100000.0) AS lon FROM building_vertex GROUP BY id) WHERE " + IN_BOX.format(lat="lat", lon="lon") + " ORDER BY osm_id LIMIT 50", "building_vertex")
def bounds_buildings(s, d):
    c = geo.centroid(F.col("coords"))
    mid = buildings(s, d).select("osm_id", c["lat"].alias("lat"), c["lon"].alias("lon"))
    return L.points_in_box(mid, *BOX, 50, F.col("lat"), F.col("lon")).select("osm_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("bounds_parks_first_vertex", "SELECT id AS osm_id FROM park_vertex WHERE pos = 0 AND " + IN_BOX.format(lat="lat_micro / 100000.0", lon="lon_micro / 100000.0"), "park_vertex")
def bounds_parks_first_vertex(s, d):
    v = F.get("coords", F.lit(0))
    return L.points_in_box(shape(view(s, d, "park_vertex")), *BOX, None, v["lat"], v["lon"]).select("osm_id")


OVERLAP = "SELECT {key} AS osm_id, count(*) AS n FROM (SELECT id, min(lat_micro / 100000.0) AS a, max(lat_micro / 100000.0) AS b, min(lon_micro / 100000.0) AS c, max(lon_micro / 100000.0) AS e FROM {v} GROUP BY id) x {join} WHERE a <= 36.14 AND b >= 36.08 AND c <= -86.76 AND e >= -86.84 GROUP BY 1"


@query("bounds_roads_dedup", "SELECT osm_id FROM (" + OVERLAP.format(key="r.osm_id", v="road_vertex", join="JOIN road r ON r.piece_id = x.id") + ") ORDER BY osm_id LIMIT 1000", "road", "road_vertex")
def bounds_roads_dedup(s, d):
    return L.shapes_in_box(roads(s, d), *BOX).select("osm_id")


@query("bounds_rail", "SELECT osm_id FROM (" + OVERLAP.format(key="x.id", v="rail_vertex", join="") + ")", "rail_vertex")
def bounds_rail(s, d):
    return L.shapes_in_box(shape(view(s, d, "rail_vertex")), *BOX, None).select("osm_id")


@query("cells_only_roads", "SELECT DISTINCT r.osm_id FROM road r JOIN road_vertex v ON v.id = r.piece_id WHERE floor(v.lat_micro / 2000) BETWEEN 1804 AND 1806 AND floor(v.lon_micro / 2000) BETWEEN -4342 AND -4338", "road", "road_vertex")
def cells_only_roads(s, d):
    v = view(s, d, "road_vertex")
    cells = v.where(grid.cell_y(F.col("lat_micro")).between(1804, 1806) & grid.cell_x(F.col("lon_micro")).between(-4342, -4338)).select(F.col("id").alias("piece_id")).distinct()
    return view(s, d, "road").join(cells, "piece_id", "left_semi").select("osm_id").distinct()


def _roads(n: int, radius: float, cls: str = "true") -> str:
    return with_views(
        steps("road_vertex")
        + f""", best AS (SELECT *, row_number() OVER (PARTITION BY qid, osm_id ORDER BY dist, piece_id, i) AS k FROM (SELECT d.*, r.osm_id, r.piece_id, r.road_class FROM d JOIN road r ON r.piece_id = d.id WHERE d.dist <= {radius} AND {cls})),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, osm_id) AS rank FROM best WHERE k = 1)
 SELECT qid, osm_id, rank, piece_id, road_class, round(dist, 1) AS distance, round(snap_lat, 6) AS snap_lat, round(snap_lon, 6) AS snap_lon FROM ranked WHERE rank <= {n}""",
        "ping", "road", "road_vertex",
    )


def _road_columns(df):
    return df.select("qid", "osm_id", "rank", "piece_id", "road_class", F.round("distance", 1).alias("distance"), *[F.round(c, 6).alias(c) for c in ("snap_lat", "snap_lon")])


def _road(name: str, n: int, radius: float, profile: str | None = None, cls: str = "true"):
    QUERIES[name] = lambda s, d: _road_columns(L.nearest_roads(view(s, d, "ping"), roads(s, d).withColumn("name", F.lit(None).cast("string")), n, radius, profile))  # names are not returned, and not sent either
    SQL[name] = _roads(n, radius, cls)


_road("nearest_road", 1, 100.0)
_road("nearest_n_roads", 5, 150.0)
_road("nearest_road_driving", 1, 200.0, "driving", "road_class IN ('motorway', 'motorway_link', 'trunk', 'trunk_link', 'primary', 'primary_link', 'secondary', 'tertiary', 'tertiary_link')")
_road("nearest_road_walking", 3, 200.0, "walking")
_road("nearest_road_cycling", 2, 200.0, "cycling", "road_class IN ('motorway', 'motorway_link', 'trunk', 'trunk_link', 'primary', 'primary_link', 'secondary', 'tertiary', 'tertiary_link', 'cycleway')")

RINGS = steps("building_vertex", True) + ", " + INSIDE


@query("building_at_point", None)
def building_at_point(s, d):
    return L.building_at(view(s, d, "ping"), buildings(s, d)).select("qid", "osm_id")


SQL["building_at_point"] = with_views(RINGS + " SELECT qid, min(id) AS osm_id FROM inside GROUP BY qid", "ping", "building_vertex")


@query("building_at_point_or_nearest50", None)
def building_or_nearest(s, d):
    return L.building_at(view(s, d, "ping"), buildings(s, d), 50.0).select("qid", "osm_id", "inside", F.round("distance", 1).alias("distance"))


SQL["building_at_point_or_nearest50"] = with_views(
    RINGS
    + """, a AS (SELECT qid, min(id) AS osm_id FROM inside GROUP BY qid), b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS k FROM d WHERE dist <= 50 AND qid NOT IN (SELECT qid FROM a))
 SELECT qid, osm_id, true AS inside, 0.0 AS distance FROM a UNION ALL SELECT qid, id, false, round(dist, 1) FROM b WHERE k = 1""",
    "ping", "building_vertex",
)


@query("buildings_within", None)
def buildings_within(s, d):
    return L.buildings_within(view(s, d, "ping"), buildings(s, d), 200.0).select("qid", "osm_id", F.round("distance", 1).alias("distance"))


SQL["buildings_within"] = with_views(
    RINGS + " SELECT d.qid, d.id AS osm_id, round(CASE WHEN max(CASE WHEN n.id IS NULL THEN 0 ELSE 1 END) = 1 THEN 0.0 ELSE min(d.dist) END, 1) AS distance FROM d LEFT JOIN inside n ON n.qid = d.qid AND n.id = d.id GROUP BY d.qid, d.id HAVING max(CASE WHEN n.id IS NULL THEN 0 ELSE 1 END) = 1 OR min(d.dist) <= 200",
    "ping", "building_vertex",
)


@query(
    "building_nearest_centroid",
    "SELECT qid, osm_id, round(sqrt(d2), 6) AS degrees FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, osm_id) AS k FROM (SELECT p.qid, c.osm_id, (c.lat - p.lat_micro / 100000.0) * (c.lat - p.lat_micro / 100000.0) + (c.lon - p.lon_micro / 100000.0) * (c.lon - p.lon_micro / 100000.0) AS d2 FROM ping p JOIN (SELECT id AS osm_id, avg(lat_micro / 100000.0) AS lat, avg(lon_micro / 100000.0) AS lon FROM building_vertex GROUP BY id) c ON abs(c.lat - p.lat_micro / 100000.0) <= 0.003 AND abs(c.lon - p.lon_micro / 100000.0) <= 0.003)) WHERE k = 1",
    "ping", "building_vertex",
)
def building_nearest_centroid(s, d):
    return L.nearest_centroid(view(s, d, "ping"), buildings(s, d)).select("qid", "osm_id", F.round("degrees", 6).alias("degrees"))


@query("parks_containing", None)
def parks_containing(s, d):
    return L.containing(view(s, d, "ping"), shape(view(s, d, "park_vertex"))).select("qid", "osm_id")


SQL["parks_containing"] = with_views(steps("park_vertex", True) + ", " + INSIDE + " SELECT qid, id AS osm_id FROM inside", "ping", "park_vertex")


@query("rail_nearest", None)
def rail_nearest(s, d):
    lines = shape(view(s, d, "rail_vertex")).withColumns({"piece_id": F.col("osm_id"), "road_class": F.lit("rail"), "name": F.lit(None).cast("string")})
    return L.nearest_roads(view(s, d, "ping"), lines, 1, 3000.0).select("qid", "osm_id", F.round("distance", 1).alias("distance"))


SQL["rail_nearest"] = with_views(
    steps("rail_vertex") + " SELECT qid, id AS osm_id, round(dist, 1) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id, i) AS k FROM d WHERE dist <= 3000) WHERE k = 1", "ping", "rail_vertex"
)


@query("segment_distance_compat", None)
def segment_distance_compat(s, d):
    return L.within_compat(view(s, d, "ping"), buildings(s, d), 300.0).select("qid", "osm_id", F.round("distance", 1).alias("distance"))


_DEG = RINGS.replace("111320.0 * greatest(cos(radians(p.lat_micro / 100000.0)), 0.001)", "1.0").replace("111320.0", "1.0").replace("1e-12", "1e-12")
SQL["segment_distance_compat"] = with_views(_DEG + " SELECT qid, id AS osm_id, round(min(dist) * 111000.0, 1) AS distance FROM d GROUP BY qid, id HAVING min(dist) * 111000.0 <= 300", "ping", "building_vertex")


@query("admin_lookup", "SELECT p.qid, g.country, g.state FROM ping p LEFT JOIN admin_grid g ON g.cy = floor(p.lat_micro / 2000) AND g.cx = floor(p.lon_micro / 2000)", "ping", "admin_grid")
def admin_lookup(s, d):
    return L.admin_at(view(s, d, "ping"), view(s, d, "admin_grid")).select("qid", "country", "state")


BOXES = [(0, "west", 36.0, -86.92, 36.25, -86.80), (1, "north", 36.12, -87.0, 36.25, -86.6), (2, "all", 36.0, -87.0, 36.21, -86.70)]


@query(
    "state_of_point",
    f"SELECT p.qid, min_by(b.name, b.ordinal) AS name FROM ping p LEFT JOIN (VALUES {', '.join(map(str, BOXES))}) AS b(ordinal, name, a, c, e, g) ON p.lat_micro / 100000.0 BETWEEN b.a AND b.e AND p.lon_micro / 100000.0 BETWEEN b.c AND b.g GROUP BY p.qid",
    "ping",
)
def state_of_point(s, d):
    boxes = s.createDataFrame(BOXES, "ordinal int, name string, min_lat double, min_lon double, max_lat double, max_lon double")
    return L.first_matching_box(view(s, d, "ping"), boxes)


WATER = "SELECT w.osm_id, w.geom_type, w.water_type, w.ref_feature_id, b.name AS body_name, coalesce(b.lat_micro, w.lat_micro) AS lat_micro, coalesce(b.lon_micro, w.lon_micro) AS lon_micro FROM water w LEFT JOIN large_body b ON b.feature_id = w.ref_feature_id"


@query("water_resolve_refs", WATER, "water", "large_body")
def water_resolve_refs(s, d):
    return L.resolve_references(view(s, d, "water"), view(s, d, "large_body"))


@query("water_near_point", f"SELECT qid, osm_id, round(d, 1) AS distance FROM (SELECT p.qid, b.osm_id, {HAV.format(f='b')} AS d FROM ping p CROSS JOIN ({WATER}) b) WHERE d <= 400", "ping", "water", "large_body")
def water_near_point(s, d):
    water = L.resolve_references(view(s, d, "water"), view(s, d, "large_body"))
    return L.nearby(view(s, d, "ping"), water, 400.0, None).select("qid", "osm_id", F.round("distance", 1).alias("distance"))


@query("places_near", f"SELECT qid, osm_id, rank, round(d, 1) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, osm_id) AS rank FROM (SELECT p.qid, b.osm_id, {HAV.format(f='b')} AS d FROM ping p CROSS JOIN place b) WHERE d <= 6000) WHERE rank <= 20", "ping", "place")
def places_near(s, d):
    return _near_columns(L.nearby(view(s, d, "ping"), view(s, d, "place"), 6000.0, 20))


@query(
    "place_best_match",
    f"SELECT qid, osm_id, name, place_type, round(d, 1) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sp, d, osm_id) AS k FROM (SELECT p.qid, b.osm_id, b.name, b.place_type, CASE b.place_type WHEN 'city' THEN 5 WHEN 'town' THEN 4 WHEN 'village' THEN 3 WHEN 'hamlet' THEN 2 ELSE 0 END AS sp, CASE b.place_type WHEN 'city' THEN 15000 WHEN 'town' THEN 5000 WHEN 'village' THEN 2000 WHEN 'hamlet' THEN 500 ELSE 1000 END AS reach, {HAV.format(f='b')} AS d FROM ping p CROSS JOIN place b) WHERE d <= reach) WHERE k = 1",
    "ping", "place",
)
def place_best_match(s, d):
    return L.place_of(view(s, d, "ping"), view(s, d, "place")).select("qid", "osm_id", "name", "place_type", F.round("distance", 1).alias("distance"))


@query("corridor_bbox", f"SELECT osm_id FROM business WHERE lat_micro / 100000.0 BETWEEN {36.05} - 500 / 111320.0 AND {36.18} + 500 / 111320.0 AND lon_micro / 100000.0 BETWEEN -86.88 - 500 / (111320.0 * 0.76) AND -86.72 + 500 / (111320.0 * 0.76)", "business")
def corridor_bbox(s, d):
    return L.within_corridor(view(s, d, "business"), PATH, 500.0, exact=False).select("osm_id")


@query("corridor_exact", None)
def corridor_exact(s, d):
    return L.within_corridor(view(s, d, "business"), PATH, 500.0).select("osm_id", F.round("distance", 1).alias("distance"))


SQL["corridor_exact"] = oracle(
    ", ping AS (SELECT osm_id AS qid, lat_micro, lon_micro FROM business), path_vertex AS (SELECT * FROM (VALUES (0, 0, -8688000, 3605000), (0, 1, -8680000, 3610000), (0, 2, -8672000, 3618000)) AS v(id, pos, lon_micro, lat_micro)), "
    + steps("path_vertex") + " SELECT qid AS osm_id, round(min(dist), 1) AS distance FROM d GROUP BY qid HAVING min(dist) <= 500", "business",
).replace(") , ping", "), ping")


@query("reverse_geocode", None)
def reverse_geocode(s, d):
    ranges = view(s, d, "road").where("piece_id % 3 = 0").select("piece_id", (F.col("piece_id") % 90 + 1).alias("from_no"), (F.col("piece_id") % 90 + 41).alias("to_no"))
    return L.reverse_geocode(view(s, d, "ping"), roads(s, d), ranges).select("qid", "osm_id", "piece_id", "side", "house_number", F.round("distance", 1).alias("distance"))


SQL["reverse_geocode"] = with_views(
    steps("road_vertex")
    + """, best AS (SELECT d.*, r.osm_id, row_number() OVER (PARTITION BY d.qid ORDER BY d.dist, r.osm_id, r.piece_id, d.i) AS k FROM d JOIN road r ON r.piece_id = d.id WHERE d.dist <= 50 AND r.piece_id % 3 = 0),
 x AS (SELECT b.*, (s.bx - s.ax) * (p.lat_micro / 100000.0 - s.ay) - (s.by_ - s.ay) * (p.lon_micro / 100000.0 - s.ax) AS c, b.id % 90 + 1 + CAST(floor((b.i + b.t) / 3 * 40 / 2) AS BIGINT) * 2 AS base FROM best b JOIN seg s ON s.id = b.id AND s.i = b.i JOIN ping p ON p.qid = b.qid WHERE b.k = 1)
 SELECT qid, osm_id, id AS piece_id, CASE WHEN c > 0 THEN 'left' WHEN c < 0 THEN 'right' ELSE 'on' END AS side, CASE WHEN (c > 0) = (base % 2 = 1) THEN base ELSE base + 1 END AS house_number, round(dist, 1) AS distance FROM x""",
    "ping", "road", "road_vertex",
)


@query("point_report", None)
def point_report(s, d):
    r = L.point_report(view(s, d, "ping"), buildings(s, d), roads(s, d), view(s, d, "business"), view(s, d, "place"), view(s, d, "admin_grid"))
    return r.withColumn("road_distance", F.round("road_distance", 1))


REPORT_STEPS = (
    steps("road_vertex").replace("seg AS MATERIALIZED", "rseg AS MATERIALIZED").replace("CROSS JOIN seg s", "CROSS JOIN rseg s").replace(" m AS", " rm AS").replace("FROM m)", "FROM rm)").replace(" n AS", " rn AS").replace("FROM n)", "FROM rn)").replace(" d AS", " rd AS")
    + ", " + RINGS
    + f""", bl AS (SELECT qid, min(id) AS building_id FROM inside GROUP BY qid), rr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, osm_id) AS k FROM (SELECT rd.qid, r.osm_id, min(rd.dist) AS dist FROM rd JOIN road r ON r.piece_id = rd.id WHERE rd.dist <= 300 GROUP BY rd.qid, r.osm_id)),
 bs AS (SELECT qid, count(*) AS n, min_by(osm_id, struct_pack(a := dd, b := osm_id)) AS nb FROM (SELECT p.qid, b.osm_id, {HAV.format(f='b')} AS dd FROM ping p CROSS JOIN business b) WHERE dd <= 300 GROUP BY qid),
 pl AS (SELECT qid, name FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sp, dd, osm_id) AS k FROM (SELECT p.qid, b.osm_id, b.name, CASE b.place_type WHEN 'city' THEN 5 WHEN 'town' THEN 4 WHEN 'village' THEN 3 WHEN 'hamlet' THEN 2 ELSE 0 END AS sp, CASE b.place_type WHEN 'city' THEN 15000 WHEN 'town' THEN 5000 WHEN 'village' THEN 2000 WHEN 'hamlet' THEN 500 ELSE 1000 END AS reach, {HAV.format(f='b')} AS dd FROM ping p CROSS JOIN place b) WHERE dd <= reach) WHERE k = 1)"""
)
REPORT_COLUMNS = "p.qid, bl.building_id, rr.osm_id AS road_id, round(rr.dist, 1) AS road_distance, coalesce(bs.n, 0) AS n_businesses, bs.nb AS nearest_business, pl.name AS place, g.country, g.state, g.county, g.zip, g.timezone"
REPORT_JOINS = "ping p LEFT JOIN bl ON bl.qid = p.qid LEFT JOIN rr ON rr.qid = p.qid AND rr.k = 1 LEFT JOIN bs ON bs.qid = p.qid LEFT JOIN pl ON pl.qid = p.qid LEFT JOIN admin_grid g ON g.cy = floor(p.lat_micro / 2000) AND g.cx = floor(p.lon_micro / 2000)"
SQL["point_report"] = with_views(f"{REPORT_STEPS} SELECT {REPORT_COLUMNS} FROM {REPORT_JOINS}", "ping", "road", "road_vertex", "building_vertex", "business", "place", "admin_grid")


@query("point_context", None)
def point_context(s, d):
    """Every layer at each point: the report and water, park, rail or station, and house number."""
    v = lambda n: view(s, d, n)
    areas, ranges = shape(v("park_vertex")), v("road").where("piece_id % 3 = 0").select("piece_id", (F.col("piece_id") % 90 + 1).alias("from_no"), (F.col("piece_id") % 90 + 41).alias("to_no"))
    stations = v("intersection").select(F.col("id").alias("osm_id"), "lat_micro", "lon_micro")
    r = L.point_report(v("ping"), buildings(s, d), roads(s, d), v("business"), v("place"), v("admin_grid"), water=areas, parks=areas, rail=shape(v("rail_vertex")), stations=stations, ranges=ranges)
    return r.withColumn("road_distance", F.round("road_distance", 1))


_STATIONS = f"SELECT p.qid, b.id, {HAV.format(f='b')} AS dist FROM ping p CROSS JOIN intersection b"
SQL["point_context"] = with_views(
    f"""{REPORT_STEPS}, {prefixed(steps("park_vertex", True) + ", " + INSIDE, "k")}, {prefixed(steps("rail_vertex"), "t")},
 wa AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS k FROM (SELECT qid, id, 0.0 AS dist FROM kinside UNION ALL SELECT qid, id, dist FROM kd WHERE dist <= 100 AND (qid, id) NOT IN (SELECT (qid, id) FROM kinside))),
 pk AS (SELECT qid, min(id) AS id FROM kinside GROUP BY qid),
 ra AS (SELECT qid, id, kind, row_number() OVER (PARTITION BY qid ORDER BY dist, kind, id) AS k FROM (SELECT qid, id, 'line' AS kind, min(dist) AS dist FROM td GROUP BY qid, id UNION ALL SELECT qid, id, 'station', dist FROM ({_STATIONS})) WHERE dist <= 3000),
 ad AS (SELECT rd.*, r.osm_id, row_number() OVER (PARTITION BY rd.qid ORDER BY rd.dist, r.osm_id, r.piece_id, rd.i) AS k FROM rd JOIN road r ON r.piece_id = rd.id WHERE rd.dist <= 50 AND r.piece_id % 3 = 0),
 ax AS (SELECT a.qid, (s.bx - s.ax) * (p.lat_micro / 100000.0 - s.ay) - (s.by_ - s.ay) * (p.lon_micro / 100000.0 - s.ax) AS c, a.id % 90 + 1 + CAST(floor((a.i + a.t) / 3 * 40 / 2) AS BIGINT) * 2 AS base FROM ad a JOIN rseg s ON s.id = a.id AND s.i = a.i JOIN ping p ON p.qid = a.qid WHERE a.k = 1)
 SELECT {REPORT_COLUMNS}, wa.id AS water_id, pk.id AS park_id, ra.id AS rail_id, ra.kind AS rail_kind, CASE WHEN ax.c IS NULL THEN NULL WHEN (ax.c > 0) = (ax.base % 2 = 1) THEN ax.base ELSE ax.base + 1 END AS house_number
 FROM {REPORT_JOINS} LEFT JOIN wa ON wa.qid = p.qid AND wa.k = 1 LEFT JOIN pk ON pk.qid = p.qid LEFT JOIN ra ON ra.qid = p.qid AND ra.k = 1 LEFT JOIN ax ON ax.qid = p.qid""",
    "ping", "road", "road_vertex", "building_vertex", "business", "place", "admin_grid", "park_vertex", "rail_vertex", "intersection",
)


@query("rail_or_station", None)
def rail_or_station(s, d):
    stations = view(s, d, "intersection").select(F.col("id").alias("osm_id"), "lat_micro", "lon_micro")
    return L.nearest_rail(view(s, d, "ping"), shape(view(s, d, "rail_vertex")), stations, 3000.0).select("qid", "osm_id", "kind", F.round("distance", 1).alias("distance"))


SQL["rail_or_station"] = with_views(
    steps("rail_vertex")
    + f""" SELECT qid, id AS osm_id, kind, round(dist, 1) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, kind, id) AS k FROM (SELECT qid, id, 'line' AS kind, min(dist) AS dist FROM d GROUP BY qid, id
 UNION ALL SELECT qid, id, 'station', dist FROM ({_STATIONS})) WHERE dist <= 3000) WHERE k = 1""",
    "ping", "rail_vertex", "intersection",
)


FAR = (500, 3000, 15000)


@query("nearby_far_north", " UNION ALL ".join(f"SELECT {r} AS radius, qid, osm_id, round(d, 1) AS distance FROM (SELECT p.qid, b.osm_id, {HAV.format(f='b')} AS d FROM far_ping p CROSS JOIN far_business b) WHERE d <= {r}" for r in FAR), "far_ping", "far_business")
def nearby_far_north(s, d):
    """Radius searches up to 80 degrees, half of them at the date line."""
    hit = [L.nearby(view(s, d, "far_ping"), view(s, d, "far_business"), float(r), None, dense=True).select(F.lit(r).alias("radius"), "qid", "osm_id", geo.tenths(F.col("distance")).alias("distance")) for r in FAR]
    return hit[2].union(hit[1]).union(hit[0])  # the longest tasks first


@query("nearest_road_far_north", None)
def nearest_road_far_north(s, d):
    lines = shape(view(s, d, "far_vertex")).withColumns({"piece_id": F.col("osm_id"), "road_class": F.lit("track"), "name": F.lit(None).cast("string")})
    return L.nearest_roads(view(s, d, "far_ping"), lines, 3, 5000.0).select("qid", "osm_id", "rank", F.round("distance", 1).alias("distance"))


SQL["nearest_road_far_north"] = with_views(
    steps("far_vertex").replace("FROM ping p", "FROM far_ping p") + " SELECT * FROM (SELECT qid, id AS osm_id, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank, round(dist, 1) AS distance FROM (SELECT qid, id, min(dist) AS dist FROM d GROUP BY qid, id) WHERE dist <= 5000) WHERE rank <= 3",
    "far_ping", "far_vertex",
)


@query(
    "buildings_by_centroid",
    f"SELECT qid, osm_id, round(d, 1) AS distance FROM (SELECT p.qid, b.osm_id, {HAV.format(f='b')} AS d FROM ping p CROSS JOIN (SELECT id AS osm_id, CAST(round_even(avg(lat_micro / 100000.0) * 100000.0, 0) AS INTEGER) AS lat_micro, CAST(round_even(avg(lon_micro / 100000.0) * 100000.0, 0) AS INTEGER) AS lon_micro FROM building_vertex GROUP BY id) b) WHERE d <= 300",
    "ping", "building_vertex",
)
def buildings_by_centroid(s, d):
    return L.within_centroid(view(s, d, "ping"), buildings(s, d), 300.0).select("qid", "osm_id", F.round("distance", 1).alias("distance"))


LEVELS = {"country": ("region", "r_name", 6), "state": ("nation", "n_name", 27), "county": ("nation", "n_name", 25), "zip": ("region", "r_name", 5), "timezone": ("region", "r_name", 7)}


@query(
    "admin_names",
    "SELECT (g.cy + 8388608) * 16777216 + g.cx + 8388608 AS cell, " + ", ".join(f"coalesce(t{i}.value, '') AS {k}" for i, k in enumerate(LEVELS)) + ", CAST(abs(g.cx) % 4 AS INTEGER) AS boundary_flags FROM admin_grid g"
    + "".join(f" LEFT JOIN (SELECT row_number() OVER (ORDER BY {c}) - 1 AS idx, {c} AS value FROM {t}) t{i} ON t{i}.idx = abs(g.cx + g.cy) % {n}" for i, (t, c, n) in enumerate(LEVELS.values())),
    "admin_grid",
)
def admin_names(s, d):
    """Cells with an index of each level against five string tables; some indexes lie beyond their table."""
    from ..operators.etl import string_table

    strings = None
    for level, (table, column, _) in LEVELS.items():
        one = string_table(s.read.parquet(f"{d}/{table}.parquet"), column).withColumn("level", F.lit(level))
        strings = one if strings is None else strings.unionByName(one)
    cells = view(s, d, "admin_grid").select(
        grid.cell_id(F.col("cy"), F.col("cx")).alias("cell"), (F.abs("cx") % 4).cast("int").alias("boundary_flags"), *[(F.abs(F.col("cx") + F.col("cy")) % n).cast("int").alias(f"{k}_idx") for k, (_, _, n) in LEVELS.items()]
    )
    return L.named_cells(cells, strings)


@query(
    "cell_overlay",
    """SELECT qid, (cy + dy + 8388608) * 16777216 + cx + dx + 8388608 AS cell, round((cx + dx) * 0.02, 6) AS west, round((cy + dy + 1) * 0.02, 6) AS north, round((cy - w) * 0.02, 6) AS min_lat, round((cx + w + 1) * 0.02, 6) AS max_lon
 FROM (SELECT qid, w, CAST(floor(lat_micro / 2000) AS BIGINT) AS cy, CAST(floor(lon_micro / 2000) AS BIGINT) AS cx FROM (SELECT *, CAST(least(14, greatest(6, floor(36 - qid % 20 * 2.5 + 0.5))) AS INTEGER) AS w FROM ping)) q, LATERAL (SELECT unnest(generate_series(-q.w, q.w)) AS dy) a, LATERAL (SELECT unnest(generate_series(-q.w, q.w)) AS dx) b""",
    "ping",
)
def cell_overlay(s, d):
    p = view(s, d, "ping").select(F.col("qid").alias("view"), geo.degrees(F.col("lat_micro")).alias("lat"), geo.degrees(F.col("lon_micro")).alias("lon"), (F.col("qid") % 20).alias("zoom"))
    r = grid.overlay(p)
    return r.select(F.col("view").alias("qid"), "cell", F.round(F.col("ring")[0]["lon"], 6).alias("west"), F.round(F.col("ring")[2]["lat"], 6).alias("north"), F.round("min_lat", 6).alias("min_lat"), F.round("max_lon", 6).alias("max_lon"))


@query("admin_exact", None)
def admin_exact(s, d):
    grid_ = view(s, d, "admin_grid").withColumn("boundary", (F.col("cy") + F.col("cx")) % 2 == 0)
    areas = shape(view(s, d, "park_vertex").withColumns({c: (F.col(c) - b) * 4 + b for c, b in (("lat_micro", 3610000), ("lon_micro", -8680000))}))
    areas = areas.withColumn("name", F.concat(F.lit("area "), F.col("osm_id").cast("string")))
    return L.admin_exact(view(s, d, "ping"), grid_, areas)


SQL["admin_exact"] = with_views(
    "big AS MATERIALIZED (SELECT id, pos, (lat_micro - 3610000) * 4 + 3610000 AS lat_micro, (lon_micro + 8680000) * 4 - 8680000 AS lon_micro FROM park_vertex), " + steps("big", True) + ", " + INSIDE
    + " SELECT p.qid, coalesce(CASE WHEN (g.cy + g.cx) % 2 = 0 THEN 'area ' || CAST((SELECT min(n.id) FROM inside n WHERE n.qid = p.qid) AS VARCHAR) END, g.state) AS name FROM ping p LEFT JOIN admin_grid g ON g.cy = floor(p.lat_micro / 2000) AND g.cx = floor(p.lon_micro / 2000)",
    "ping", "park_vertex", "admin_grid",
)


@query("water_nearest", None)
def water_nearest(s, d):
    lines = shape(view(s, d, "rail_vertex")).withColumn("osm_id", F.col("osm_id") + 10_000_000)
    return L.nearest_water(view(s, d, "ping"), shape(view(s, d, "park_vertex")), lines, 1500.0).select("qid", "osm_id", F.round("distance", 1).alias("distance"))


SQL["water_nearest"] = with_views(
    steps("park_vertex", True) + ", " + INSIDE + ", "
    + steps("rail_vertex").replace("seg AS MATERIALIZED", "rseg AS MATERIALIZED").replace("CROSS JOIN seg s", "CROSS JOIN rseg s").replace(" m AS", " rm AS").replace("FROM m)", "FROM rm)").replace(" n AS", " rn AS").replace("FROM n)", "FROM rn)").replace(" d AS", " rd AS")
    + """, c AS (SELECT qid, id AS osm_id, 0.0 AS dist FROM inside UNION ALL SELECT qid, id, dist FROM d WHERE dist <= 1500 UNION ALL SELECT qid, id + 10000000, dist FROM rd WHERE dist <= 1500)
 SELECT qid, osm_id, round(dist, 1) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, osm_id) AS k FROM c) WHERE k = 1""",
    "ping", "park_vertex", "rail_vertex",
)
