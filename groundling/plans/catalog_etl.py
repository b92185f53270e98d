"""Queries of layer building, codecs, tiles and routing, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, codec, geo, grid, tiles
from ..operators import etl as E
from ..operators import routing as R
from .fixtures import buildings, oracle, shape, view

QUERIES: dict = {}
#: Queries that have no form in SQL; brute force in tests holds them.
WHOLE: dict = {}
SQL: dict[str, str] = {}
CELL = "(CAST(floor({a}lat_micro / 2000) AS BIGINT) + 8388608) * 16777216 + CAST(floor({a}lon_micro / 2000) AS BIGINT) + 8388608"
CELL_V = CELL.format(a="")


def query(name: str, sql: str | None = None, *views: str):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = oracle(sql, *views)
        return f

    return keep


def _cell():
    return grid.cell(F.col("lat_micro"), F.col("lon_micro"))


@query(
    "split_ways",
    f"""SELECT id, part, pos, lon_micro, lat_micro FROM (SELECT *, count(*) OVER (PARTITION BY id, part) AS n FROM (
 SELECT id, part, pos, lon_micro, lat_micro FROM (SELECT *, sum(change) OVER (PARTITION BY id ORDER BY pos) AS part FROM (SELECT *, CASE WHEN cell <> lag(cell) OVER (PARTITION BY id ORDER BY pos) THEN 1 ELSE 0 END AS change FROM (SELECT *, {CELL_V} AS cell FROM road_vertex)))
 UNION ALL SELECT id, part - 1, pos, lon_micro, lat_micro FROM (SELECT *, sum(change) OVER (PARTITION BY id ORDER BY pos) AS part FROM (SELECT *, CASE WHEN cell <> lag(cell) OVER (PARTITION BY id ORDER BY pos) THEN 1 ELSE 0 END AS change FROM (SELECT *, {CELL_V} AS cell FROM road_vertex))) WHERE change = 1)) WHERE n >= 2""",
    "road_vertex",
)
def split_ways(s, d):
    return E.split_ways(view(s, d, "road_vertex"))


@query("delta_roundtrip", "SELECT id, pos, lon_micro, lat_micro FROM road_vertex", "road_vertex")
def delta_roundtrip(s, d):
    return E.delta_decode(E.delta_encode(view(s, d, "road_vertex")))


@query("delta_encode", "SELECT id, pos, lon_micro - coalesce(lag(lon_micro) OVER (PARTITION BY id ORDER BY pos), 0) AS d_lon_micro, lat_micro - coalesce(lag(lat_micro) OVER (PARTITION BY id ORDER BY pos), 0) AS d_lat_micro FROM road_vertex", "road_vertex")
def delta_encode(s, d):
    return E.delta_encode(view(s, d, "road_vertex"))


TOP = "SELECT row_number() OVER (ORDER BY n DESC, category) AS category_idx, category, n FROM (SELECT category, count(*) AS n FROM business WHERE category IS NOT NULL GROUP BY category) ORDER BY n DESC, category LIMIT 254"


@query("top_categories", TOP, "business")
def top_categories(s, d):
    return E.ranked_categories(view(s, d, "business"))


@query("category_resolve", f"SELECT b.osm_id, t.category FROM (SELECT osm_id, osm_id % 8 AS category_idx FROM business) b LEFT JOIN ({TOP}) t ON t.category_idx = b.category_idx", "business")
def category_resolve(s, d):
    b = view(s, d, "business")
    return E.resolve_categories(b.select("osm_id", (F.col("osm_id") % 8).cast("int").alias("category_idx")), E.ranked_categories(b)).select("osm_id", "category")


@query("string_table", "SELECT row_number() OVER (ORDER BY state) - 1 AS idx, state AS value FROM (SELECT DISTINCT state FROM admin_grid WHERE state IS NOT NULL)", "admin_grid")
def string_table(s, d):
    return E.string_table(view(s, d, "admin_grid"), "state")


IN_RING = """edge AS (SELECT v.id, v.lon_micro / 100000.0 AS ax, v.lat_micro / 100000.0 AS ay, w.lon_micro / 100000.0 AS bx, w.lat_micro / 100000.0 AS by_ FROM {v} v JOIN {v} w ON w.id = v.id AND w.pos = (v.pos + 1) % {n}),
 hit AS (SELECT p.osm_id AS pid, e.id FROM {p} p JOIN edge e ON (e.ay > p.lat_micro / 100000.0) <> (e.by_ > p.lat_micro / 100000.0) AND p.lon_micro / 100000.0 < (e.bx - e.ax) * (p.lat_micro / 100000.0 - e.ay) / (e.by_ - e.ay) + e.ax GROUP BY p.osm_id, e.id HAVING count(*) % 2 = 1)"""
PAIRS = oracle("", "business", "building_vertex").rstrip() + ", " + IN_RING.format(v="building_vertex", n=5, p="business")


@query("business_building_join")
def business_building_join(s, d):
    return E.businesses_in_buildings(view(s, d, "business"), buildings(s, d))


SQL["business_building_join"] = PAIRS + " SELECT pid AS business_id, min(id) AS building_id FROM hit GROUP BY pid"


@query("building_businesses")
def building_businesses(s, d):
    r = E.businesses_by_building(view(s, d, "business"), buildings(s, d))
    return r.select("building_id", "n", F.array_join(F.transform("business_ids", lambda x: x.cast("string")), ",").alias("business_ids"))


SQL["building_businesses"] = PAIRS + " SELECT building_id, count(*) AS n, string_agg(CAST(pid AS VARCHAR), ',' ORDER BY pid) AS business_ids FROM (SELECT pid, min(id) AS building_id FROM hit GROUP BY pid) GROUP BY building_id"


@query("unmatched_businesses")
def unmatched_businesses(s, d):
    b = view(s, d, "business")
    return E.unmatched(b, E.businesses_in_buildings(b, buildings(s, d))).select("osm_id")


SQL["unmatched_businesses"] = PAIRS + " SELECT osm_id FROM business WHERE osm_id NOT IN (SELECT pid FROM hit)"


@query("admin_grid_build")
def admin_grid_build(s, d):
    cells = view(s, d, "admin_grid").select("cy", "cx")
    areas = shape(view(s, d, "park_vertex").withColumns({c: (F.col(c) - b) * 8 + b for c, b in (("lat_micro", 3610000), ("lon_micro", -8680000))}))
    areas = areas.select("osm_id", "coords", F.when(F.col("osm_id") % 8 == 0, 4).otherwise(6).alias("level"), F.concat(F.lit("area "), F.col("osm_id").cast("string")).alias("name"))
    return E.admin_grid(cells, areas)


SQL["admin_grid_build"] = (
    oracle("", "park_vertex", "admin_grid").rstrip()
    + ", big AS (SELECT id, pos, (lat_micro - 3610000) * 8 + 3610000 AS lat_micro, (lon_micro + 8680000) * 8 - 8680000 AS lon_micro FROM park_vertex), mid AS (SELECT cy, cx, cy * 1000000 + cx AS osm_id, CAST((cy + 0.5) * 2000 AS BIGINT) AS lat_micro, CAST((cx + 0.5) * 2000 AS BIGINT) AS lon_micro FROM admin_grid), "
    + IN_RING.format(v="big", n=4, p="mid")
    + " SELECT m.cy, m.cx, CASE WHEN h.id % 8 = 0 THEN 4 ELSE 6 END AS level, concat('area ', CAST(min(h.id) AS VARCHAR)) AS name FROM hit h JOIN mid m ON m.osm_id = h.pid GROUP BY 1, 2, 3"
)


@query("state_merge_union", "SELECT osm_id, min(name) AS name FROM (SELECT osm_id, name FROM business WHERE osm_id % 3 <> 0 UNION ALL SELECT osm_id, name FROM business WHERE osm_id % 5 <> 0) GROUP BY osm_id", "business")
def state_merge_union(s, d):
    b = view(s, d, "business").select("osm_id", "name")
    return E.merge_layers(b.where("osm_id % 3 <> 0"), b.where("osm_id % 5 <> 0"))


BLOCKS = f"SELECT 'S' || CAST(osm_id % 3 AS VARCHAR) AS state, {CELL_V} AS cell, sum(octet_length(encode(name))) AS size FROM business GROUP BY 1, 2"


def _blocks(s, d):
    b = view(s, d, "business").select(F.concat(F.lit("S"), (F.col("osm_id") % 3).cast("string")).alias("state"), _cell().alias("cell"), F.octet_length("name").alias("b"))
    return b.groupBy("state", "cell").agg(F.sum("b").alias("size"))


@query("offset_running_sum", f'SELECT state, cell, size, coalesce(sum(size) OVER (PARTITION BY state ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM ({BLOCKS})', "business")
def offset_running_sum(s, d):
    return E.running_offsets(_blocks(s, d))


@query("fixed_batches", f"SELECT state, cell, size, CAST(floor((row_number() OVER (PARTITION BY state ORDER BY cell) - 1) / 8) AS BIGINT) AS batch FROM ({BLOCKS})", "business")
def fixed_batches(s, d):
    return E.batches(_blocks(s, d), "state")


@query("merge_sparse_cells", f"SELECT state, cell, size, CAST(floor(coalesce(sum(size) OVER (PARTITION BY state ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 200) AS BIGINT) AS merged FROM ({BLOCKS})", "business")
def merge_sparse_cells(s, d):
    return E.merge_sparse(_blocks(s, d), "state", 200)


@query(
    "fill_nearest_known",
    "SELECT g, osm_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY g ORDER BY osm_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (PARTITION BY g ORDER BY osm_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM (SELECT osm_id % 4 AS g, osm_id, CASE WHEN osm_id % 7 < 3 THEN lat_micro END AS v FROM business)",
    "business",
)
def fill_nearest_known(s, d):
    rows = view(s, d, "business").select((F.col("osm_id") % 4).alias("g"), "osm_id", F.expr("CASE WHEN osm_id % 7 < 3 THEN lat_micro END").alias("v"))
    return E.fill_nearest(rows, "g", "osm_id", "v")


@query("distinct_cells", f"SELECT DISTINCT id, {CELL_V} AS cell FROM road_vertex", "road_vertex")
def distinct_cells(s, d):
    return E.distinct_cells(view(s, d, "road_vertex"))


@query(
    "cell_intersections",
    f"SELECT a.cell, a.n_pieces, coalesce(b.n, 0) AS n_intersections FROM (SELECT {CELL_V} AS cell, count(*) AS n_pieces FROM road_vertex WHERE pos = 0 GROUP BY 1) a LEFT JOIN (SELECT {CELL_V} AS cell, count(*) AS n FROM intersection GROUP BY 1) b ON b.cell = a.cell",
    "road_vertex", "intersection",
)
def cell_intersections(s, d):
    return E.at_intersections(view(s, d, "road_vertex").where("pos = 0").withColumn("cell", _cell()), view(s, d, "intersection").withColumn("cell", _cell()))


@query("intersection_delay", "SELECT id, kind, CASE kind WHEN 1 THEN 20 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 2 END AS delay_s FROM intersection", "intersection")
def intersection_delay(s, d):
    return view(s, d, "intersection").select("id", "kind", classify.delay_s(F.col("kind")).alias("delay_s"))


CLASS_CODE = "(v.id % 8)"


@query("cell_class_bitmask", f"SELECT {CELL_V} AS cell, bit_or(CAST(1 AS BIGINT) << CAST(id % 8 AS INTEGER)) AS mask FROM road_vertex WHERE pos = 0 GROUP BY 1", "road_vertex")
def cell_class_bitmask(s, d):
    return E.cell_presence(view(s, d, "road_vertex").where("pos = 0").select(_cell().alias("cell"), (F.col("id") % 8).alias("code")), "code")


@query(
    "road_tag_normalize",
    """SELECT osm_id, CASE WHEN kmh > 255 THEN 255 ELSE kmh END AS speed_kmh,
 CASE WHEN oneway IN ('yes', 'true', '1') THEN 1 WHEN oneway IN ('-1', 'reverse') THEN -1 ELSE 0 END AS oneway, CASE WHEN lanes = '2' THEN 2 END AS lanes, surface,
 CASE WHEN tunnel IN ('yes', 'building_passage') THEN 'tunnel' WHEN bridge IN ('yes', 'viaduct') THEN 'bridge' END AS bridge_tunnel FROM (SELECT *, CAST(CASE WHEN maxspeed LIKE '%mph%' THEN round_even(TRY_CAST(split_part(maxspeed, ' ', 1) AS INTEGER) * 1.60934, 0) ELSE TRY_CAST(split_part(maxspeed, ' ', 1) AS INTEGER) END AS INTEGER) AS kmh FROM way_tags)""",
    "way_tags",
)
def road_tag_normalize(s, d):
    return view(s, d, "way_tags").select("osm_id", classify.speed_kmh(F.col("maxspeed")).alias("speed_kmh"), classify.oneway(F.col("oneway")).alias("oneway"), classify.lanes(F.col("lanes")).alias("lanes"), "surface", classify.bridge_tunnel(F.col("bridge"), F.col("tunnel")).alias("bridge_tunnel"))


@query(
    "height_use_class",
    """SELECT osm_id, CASE WHEN building_type IN ('house', 'residential', 'detached', 'terrace', 'apartments') THEN 'residential' WHEN building_type IN ('commercial', 'retail', 'office', 'warehouse', 'hotel') THEN 'commercial'
 WHEN building_type IN ('industrial', 'school', 'church', 'hospital', 'public') THEN 'industrial/institutional' ELSE 'unknown' END AS use_class,
 CASE WHEN h IS NULL OR h <= 0 THEN 'unknown' WHEN h <= 6 THEN '1-2' WHEN h <= 15 THEN '3-5' ELSE '6+' END AS height_tier, h AS height FROM (SELECT *, TRY_CAST(CASE WHEN height_m IS NULL THEN NULL WHEN osm_id % 10 = 0 THEN 'tall' WHEN osm_id % 10 = 1 THEN '0' WHEN osm_id % 10 = 2 THEN '-3' ELSE CAST(height_m AS VARCHAR) END AS DOUBLE) AS h FROM building)""",
    "building",
)
def height_use_class(s, d):
    b = view(s, d, "building").withColumn("h", classify.height(F.expr("CASE WHEN height_m IS NULL THEN NULL WHEN osm_id % 10 = 0 THEN 'tall' WHEN osm_id % 10 = 1 THEN '0' WHEN osm_id % 10 = 2 THEN '-3 m' ELSE concat(CAST(height_m AS STRING), ' m') END")))
    return b.select("osm_id", classify.use_class(F.col("building_type")).alias("use_class"), classify.height_tier(F.col("h")).alias("height_tier"), F.col("h").alias("height"))


_NATURAL = ("water", "wetland", "coastline", "bay")
_WATER = ("lake", "reservoir", "pond", "river", "bay", "wetland", "marsh", "swamp", "estuary", "", "lagoon")
_WATERWAY = ("river", "riverbank", "stream", "creek", "canal", "ditch", "drain", "weir")


def _choice(values: tuple, of: str) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


TAGS = f"SELECT p_partkey AS osm_id, {_choice(_NATURAL, 'p_partkey % 7')} AS natural_, {_choice(_WATER, 'p_partkey % 23')} AS water, {_choice(_WATERWAY, 'p_partkey % 17')} AS waterway FROM {{part}}"


@query(
    "classify_water",
    f"""SELECT osm_id, CASE WHEN water = 'lake' OR (natural_ = 'water' AND coalesce(water, '') = '') THEN 'lake' WHEN water = 'reservoir' THEN 'reservoir' WHEN water = 'pond' THEN 'pond'
 WHEN water = 'river' OR waterway = 'river' OR waterway = 'riverbank' THEN 'river' WHEN waterway = 'stream' THEN 'stream' WHEN waterway = 'creek' THEN 'creek' WHEN waterway = 'canal' OR waterway = 'ditch' THEN 'canal'
 WHEN waterway = 'drain' THEN 'drain' WHEN water = 'bay' THEN 'bay' WHEN natural_ = 'coastline' THEN 'ocean' WHEN natural_ = 'wetland' OR water = 'wetland' THEN 'wetland' WHEN water = 'marsh' THEN 'marsh'
 WHEN water = 'swamp' THEN 'swamp' WHEN water = 'estuary' THEN 'estuary' WHEN waterway <> '' THEN 'stream' ELSE 'lake' END AS water_type FROM ({TAGS.format(part='part')})""",
)
def classify_water(s, d):
    t = s.sql(TAGS, part=s.read.parquet(f"{d}/part.parquet"))
    return t.select("osm_id", classify.water_type(F.col("natural_"), F.col("water"), F.col("waterway")).alias("water_type"))


@query("block_cells", f"SELECT block, min_by(cell, n) AS cell FROM (SELECT b.block, b.n, CASE WHEN h.osm_id % 7 < 2 THEN {CELL.format(a='h.')} END AS cell FROM (SELECT osm_id, CAST(floor(osm_id / 10) AS BIGINT) AS block, osm_id % 10 AS n FROM business) b LEFT JOIN business h ON h.osm_id = b.osm_id AND b.n < 4) WHERE cell IS NOT NULL GROUP BY block UNION ALL SELECT CAST(floor(osm_id / 10) AS BIGINT) AS block, NULL FROM business GROUP BY 1 HAVING count(CASE WHEN osm_id % 10 < 4 AND osm_id % 7 < 2 THEN 1 END) = 0", "business")
def block_cells(s, d):
    b = view(s, d, "business")
    blocks = b.select(F.floor(F.col("osm_id") / 10).alias("block"), (F.col("osm_id") % 10).alias("n"), "osm_id")
    return E.block_cells(blocks, b.where("osm_id % 7 < 2").select("osm_id", _cell().alias("cell")))


@query("status_decode", "SELECT osm_id, CASE osm_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'temporarily_closed' ELSE 'closed' END AS status, CASE WHEN operating_status = 'closed' AND website IS NOT NULL THEN 'temporarily_closed' WHEN operating_status = 'closed' THEN 'closed' ELSE 'open' END AS compat FROM business", "business")
def status_decode(s, d):
    b = view(s, d, "business")
    return b.select("osm_id", classify.status(F.col("osm_id") % 3).alias("status"), classify.status_compat(F.col("operating_status") == "closed", F.col("website").isNotNull()).alias("compat"))


@query("viewport_roads", "SELECT piece_id FROM road WHERE road_class NOT IN ('residential', 'service', 'footway', 'cycleway', 'path', 'track', 'unclassified', 'living_street', 'tertiary')", "road")
def viewport_roads(s, d):
    return view(s, d, "road").where(classify.visible(F.col("road_class"), 10)).select("piece_id")


@query("building_centroids", "SELECT id AS osm_id, round(avg(lat_micro / 100000.0), 6) AS lat, round(avg(lon_micro / 100000.0), 6) AS lon FROM building_vertex GROUP BY id", "building_vertex")
def building_centroids(s, d):
    return E.centroids(buildings(s, d))


@query("feature_boxes", "SELECT id, min(lat_micro) AS min_lat_micro, max(lat_micro) AS max_lat_micro, min(lon_micro) AS min_lon_micro, max(lon_micro) AS max_lon_micro FROM road_vertex GROUP BY id", "road_vertex")
def feature_boxes(s, d):
    return E.box_of(view(s, d, "road_vertex"))


@query("state_summary", "SELECT osm_id % 3 AS state, count(*) AS n, count(category) AS with_category, count(DISTINCT category) AS categories, round(avg(length(name)), 4) AS mean_name FROM business GROUP BY 1", "business")
def state_summary(s, d):
    return view(s, d, "business").groupBy((F.col("osm_id") % 3).alias("state")).agg(F.count("*").alias("n"), F.count("category").alias("with_category"), F.count_distinct("category").alias("categories"), F.round(F.avg(F.length("name")), 4).alias("mean_name"))


STATES = [(0, "A", 3.0), (1, "B", 1.0), (2, "C", 4.0)]


@query("weighted_state_pick", "SELECT osm_id AS draw, CASE WHEN u < 0.375 THEN 'A' WHEN u < 0.5 THEN 'B' ELSE 'C' END AS name FROM (SELECT osm_id, ((osm_id * 7919) % 1000) / 1000.0 AS u FROM business)", "business")
def weighted_state_pick(s, d):
    draws = view(s, d, "business").select(F.col("osm_id").alias("draw"), ((F.col("osm_id") * 7919) % 1000 / 1000.0).alias("u"))
    return E.weighted_pick(s.createDataFrame(STATES, "ordinal int, name string, area double"), draws)


@query("micro_roundtrip", "SELECT osm_id, CAST(round_even(lat_micro / 100000.0 * 100000.0, 0) AS INTEGER) AS lat_micro, CAST(round_even(osm_id / 200000.0 * 100000.0, 0) AS INTEGER) AS half_even FROM business", "business")
def micro_roundtrip(s, d):
    b = view(s, d, "business")
    return b.select("osm_id", geo.micro(geo.degrees(F.col("lat_micro"))).alias("lat_micro"), geo.micro(F.col("osm_id") / 200000.0).alias("half_even"))


@query("zigzag_roundtrip", "SELECT id, pos, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS z, v AS back, greatest(1, CAST(ceil((floor(log2(greatest(CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END, 1))) + 1) / 7) AS INTEGER)) AS size FROM (SELECT id, pos, lon_micro - 8000 * (id % 3) AS v FROM road_vertex)", "road_vertex")
def zigzag_roundtrip(s, d):
    v = view(s, d, "road_vertex").select("id", "pos", (F.col("lon_micro") - 8000 * (F.col("id") % 3)).alias("v"))
    z = v.withColumn("z", codec.zigzag(F.col("v")))
    return z.select("id", "pos", "z", codec.unzigzag(F.col("z")).alias("back"), codec.varint_size(F.col("z")).alias("size"))


@query("wall_segment_decode", "SELECT osm_id, round(-86.8 + osm_id % 50 * 0.2 * sin(radians(osm_id % 256 * 360.0 / 256.0)) / (111320.0 * cos(radians(36.1))), 9) AS lon, round(36.1 + osm_id % 50 * 0.2 * cos(radians(osm_id % 256 * 360.0 / 256.0)) / 111320.0, 9) AS lat FROM building", "building")
def wall_segment_decode(s, d):
    p = codec.wall_point(F.lit(-86.8), F.lit(36.1), F.col("osm_id") % 256, F.col("osm_id") % 50)
    return view(s, d, "building").select("osm_id", F.round(p["lon"], 9).alias("lon"), F.round(p["lat"], 9).alias("lat"))


@query("vertex_codes", f"SELECT id, pos, CASE WHEN id % 22 BETWEEN 4 AND 18 THEN id % 22 - 4 ELSE 15 END AS nibble, least(greatest(lat_micro - 3610000, -32768), 32767) + 32768 AS biased, {CELL_V} AS cell FROM road_vertex", "road_vertex")
def vertex_codes(s, d):
    v = view(s, d, "road_vertex")
    return v.select("id", "pos", codec.pack_count(F.col("id") % 22).alias("nibble"), codec.cell_relative(F.col("lat_micro"), F.lit(3610000), True).alias("biased"), _cell().alias("cell"))


@query("decimate_vertices", "SELECT id AS osm_id, count(*) AS n FROM road_vertex WHERE pos % 2 = 0 GROUP BY id", "road_vertex")
def decimate_vertices(s, d):
    return shape(view(s, d, "road_vertex")).select("osm_id", F.size(codec.decimate(F.col("coords"), 3)).cast("long").alias("n"))


@query("tile_of_point", "SELECT qid, CAST(floor((lon_micro / 100000.0 + 180.0) / 360.0 * 16384) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat_micro / 100000.0)) + 1 / cos(radians(lat_micro / 100000.0))) / pi()) / 2 * 16384) AS BIGINT) AS y FROM ping", "ping")
def tile_of_point(s, d):
    p = view(s, d, "ping")
    return p.select("qid", tiles.tile_x(geo.degrees(F.col("lon_micro")), 14).alias("x"), tiles.tile_y(geo.degrees(F.col("lat_micro")), 14).alias("y"))


_X = "CAST(floor(({} + 180.0) / 360.0 * 65536) AS BIGINT)"
_Y = "CAST(floor((1 - ln(tan(radians({0})) + 1 / cos(radians({0}))) / pi()) / 2 * 65536) AS BIGINT)"


@query("tiles_for_bbox", f"SELECT id, x, y FROM (SELECT id, unnest(generate_series(x0, x1)) AS x, y0, y1 FROM (SELECT id, {_X.format('c')} AS x0, {_X.format('e')} AS x1, {_Y.format('b')} AS y0, {_Y.format('a')} AS y1 FROM (SELECT id, min(lat_micro / 100000.0) AS a, max(lat_micro / 100000.0) AS b, min(lon_micro / 100000.0) AS c, max(lon_micro / 100000.0) AS e FROM park_vertex GROUP BY id))) t, LATERAL (SELECT unnest(generate_series(t.y0, t.y1)) AS y)", "park_vertex")
def tiles_for_bbox(s, d):
    b = shape(view(s, d, "park_vertex")).select("osm_id", geo.bounds(F.col("coords")).alias("b"))
    hit = F.explode(tiles.tiles_for_box(F.col("b.min_lat"), F.col("b.min_lon"), F.col("b.max_lat"), F.col("b.max_lon"), 16))
    return b.select(F.col("osm_id").alias("id"), hit.alias("t")).select("id", "t.x", "t.y")


@query("tile_local_points", "SELECT osm_id, round(x / 16384.0 * 360.0 - 180.0 + (osm_id % 4096) / 4096.0 * (360.0 / 16384), 6) AS lon FROM (SELECT osm_id, floor((lon_micro / 100000.0 + 180.0) / 360.0 * 16384) AS x FROM business)", "business")
def tile_local_points(s, d):
    b = view(s, d, "business")
    box = tiles.tile_bounds(tiles.tile_x(geo.degrees(F.col("lon_micro")), 14), tiles.tile_y(geo.degrees(F.col("lat_micro")), 14), 14)
    return b.select("osm_id", F.round(tiles.local_to_lonlat(F.col("osm_id") % 4096, F.lit(0), box)["lon"], 6).alias("lon"))


@query("formatted_distances", "SELECT osm_id, CASE WHEN m < 1000 THEN concat(CAST(CAST(round(m) AS INTEGER) AS VARCHAR), ' m') ELSE concat(printf('%.1f', m / 1000), ' km') END AS distance FROM (SELECT osm_id, (osm_id * 37) % 5000 + 0.25 AS m FROM business)", "business")
def formatted_distances(s, d):
    return view(s, d, "business").select("osm_id", codec.format_distance(((F.col("osm_id") * 37) % 5000 + 0.25).cast("double")).alias("distance"))


# routing
_PAIR = "SELECT a.qid AS route_id, a.lat_micro / 100000.0 AS lat1, a.lon_micro / 100000.0 AS lon1, b.lat_micro / 100000.0 AS lat2, b.lon_micro / 100000.0 AS lon2 FROM ping a JOIN ping b ON b.qid = a.qid + 1"
_HAV = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"


def _pairs(s, d):
    p = view(s, d, "ping")
    a = p.select(F.col("qid").alias("route_id"), geo.degrees(F.col("lat_micro")).alias("lat1"), geo.degrees(F.col("lon_micro")).alias("lon1"))
    b = p.select((F.col("qid") - 1).alias("route_id"), geo.degrees(F.col("lat_micro")).alias("lat2"), geo.degrees(F.col("lon_micro")).alias("lon2"))
    return a.join(b, "route_id")


@query("route_estimate", f"SELECT route_id, round({_HAV}, 1) AS distance_m, round({_HAV} / 15.0, 1) AS duration_s FROM ({_PAIR})", "ping")
def route_estimate(s, d):
    return R.estimate(_pairs(s, d)).select("route_id", "distance_m", "duration_s")


@query("route_compare", f"SELECT route_id, round(round({_HAV}, 1) / (round({_HAV}, 1) * 1.25 + 10), 4) AS ratio FROM ({_PAIR})", "ping")
def route_compare(s, d):
    ours = R.estimate(_pairs(s, d))
    return R.compare_routes(ours, ours.select("route_id", (F.col("distance_m") * 1.25 + 10).alias("distance_m"))).select("route_id", "ratio")


@query(
    "corridor_cells",
    f"""SELECT DISTINCT route_id, (CAST(floor(y / 2000) AS BIGINT) + dy + 8388608) * 16777216 + CAST(floor(x / 2000) AS BIGINT) + dx + 8388608 AS cell FROM (SELECT route_id, round_even((lat1 + (lat2 - lat1) * i / n) * 100000.0, 0) AS y, round_even((lon1 + (lon2 - lon1) * i / n) * 100000.0, 0) AS x
 FROM (SELECT *, unnest(generate_series(0, n)) AS i FROM (SELECT *, greatest(2, CAST(floor({_HAV} / 500) AS INTEGER)) AS n FROM ({_PAIR})))) CROSS JOIN (VALUES (-1), (0), (1)) AS a(dy) CROSS JOIN (VALUES (-1), (0), (1)) AS b(dx)""",
    "ping",
)
def corridor_cells(s, d):
    return R.corridor_cells(_pairs(s, d))


_NODE = "(CAST(floor(lat_micro * 0.5) AS BIGINT) + 16777216) * 67108864 + CAST(floor(lon_micro * 0.5) AS BIGINT) + 33554432"
_SNAPPED = "CAST(floor({0}lat_micro / 400.0) AS INTEGER) * 400 AS lat_micro, CAST(floor({0}lon_micro / 400.0) AS INTEGER) * 400 AS lon_micro"


def _graph(s, d):
    """The road graph of all roads that may be driven, on a coarse lattice so that the test lines meet; with directions and delays."""
    snap = lambda df: df.withColumns({c: F.floor(F.col(c) / 400.0).cast("int") * 400 for c in ("lat_micro", "lon_micro")})
    tags = view(s, d, "way_tags").select(F.col("osm_id").alias("piece_id"), classify.oneway(F.col("oneway")).alias("oneway"))
    roads = view(s, d, "road").join(tags, "piece_id")
    return R.graph(snap(view(s, d, "road_vertex")), roads, "driving", snap(view(s, d, "intersection")))


_GRAPH = (
    oracle("", "road_vertex", "road", "way_tags", "intersection").replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + f""", sv AS (SELECT v.id, v.pos, t.oneway, {_SNAPPED.format("v.")} FROM road_vertex v JOIN road r ON r.piece_id = v.id JOIN way_tags t ON t.osm_id = v.id
  WHERE r.road_class IN ('motorway', 'trunk', 'primary', 'secondary', 'tertiary', 'motorway_link', 'trunk_link', 'primary_link', 'secondary_link', 'tertiary_link', 'unclassified', 'residential', 'living_street', 'service', 'road')),
 nv AS (SELECT *, {_NODE} AS node, lat_micro / 100000.0 AS lat, lon_micro / 100000.0 AS lon FROM sv),
 st AS (SELECT a.node AS src, b.node AS dst, a.oneway, CAST(round_even({_HAV.replace('lat1', 'a.lat').replace('lat2', 'b.lat').replace('lon1', 'a.lon').replace('lon2', 'b.lon')} / 15.0 * 100, 0) AS BIGINT) AS weight FROM nv a JOIN nv b ON b.id = a.id AND b.pos = a.pos + 1 WHERE a.node <> b.node),
 late AS (SELECT {_NODE} AS node, max(CASE kind WHEN 1 THEN 20 WHEN 2 THEN 4 WHEN 3 THEN 3 ELSE 2 END) AS delay FROM (SELECT kind, {_SNAPPED.format("")} FROM intersection) GROUP BY 1),
 edge AS MATERIALIZED (SELECT e.src, e.dst, min(e.weight) + 100 * coalesce(max(late.delay), 0) AS weight FROM (SELECT src, dst, weight FROM st WHERE coalesce(oneway, 'no') <> '-1' UNION ALL SELECT dst, src, weight FROM st WHERE coalesce(oneway, 'no') <> 'yes') e LEFT JOIN late ON late.node = e.dst GROUP BY e.src, e.dst)"""
)
#: A label falls to the least of its neighbours' until none falls.
_LABEL = """, both_ways AS MATERIALIZED (SELECT src, dst FROM edge UNION SELECT dst, src FROM edge),
 lab(node, component) USING KEY (node) AS (SELECT DISTINCT src, src FROM both_ways UNION SELECT b.dst, min(l.component) FROM lab l JOIN both_ways b ON b.src = l.node JOIN recurring.lab c ON c.node = b.dst WHERE l.component < c.component GROUP BY b.dst)"""


@query("road_graph")
def road_graph(s, d):
    return _graph(s, d)[1]


SQL["road_graph"] = _GRAPH + " SELECT * FROM edge"


@query("connected_components")
def connected_components(s, d):
    return R.components(R._cut(_graph(s, d)[1]))


SQL["connected_components"] = _GRAPH + _LABEL + " SELECT node, component FROM lab"


@query("shortest_path")
def shortest_path(s, d):
    """Every node that the one with most edges reaches, at whatever cost."""
    edges = R._cut(_graph(s, d)[1])
    start = edges.groupBy("src").count().agg(F.min_by("src", F.struct(-F.col("count"), "src")).alias("source"))
    return R.shortest_paths(edges, start).select("node", "cost")


SQL["shortest_path"] = (
    _GRAPH
    + """, path(node, cost) USING KEY (node) AS (SELECT * FROM (SELECT src, CAST(0 AS HUGEINT) FROM edge GROUP BY src ORDER BY count(*) DESC, src LIMIT 1) UNION SELECT e.dst, min(p.cost + e.weight) FROM path p JOIN edge e ON e.src = p.node LEFT JOIN recurring.path c ON c.node = e.dst WHERE c.node IS NULL OR p.cost + e.weight < c.cost GROUP BY e.dst)
 SELECT node, CAST(cost AS BIGINT) AS cost FROM path"""
)


@query("snap_to_component")
def snap_to_component(s, d):
    nodes, edges = _graph(s, d)
    hit = R.snap_to_largest(view(s, d, "ping"), nodes, R.components(R._cut(edges)), 3000.0)
    return hit.select("qid", "node", F.round("distance", 1).alias("distance"))


SQL["snap_to_component"] = (
    _GRAPH
    + ", "
    + oracle("", "ping").replace("WITH ", "", 1).rstrip()
    + _LABEL
    + f""", big AS (SELECT component FROM lab GROUP BY component ORDER BY count(*) DESC, component LIMIT 1), nd AS (SELECT nv.node, min(lat_micro) AS la, min(lon_micro) AS lo FROM nv GROUP BY nv.node),
 k AS (SELECT p.qid, l.node, {_HAV.replace('lat1', 'p.lat_micro / 100000.0').replace('lat2', 'n.la / 100000.0').replace('lon1', 'p.lon_micro / 100000.0').replace('lon2', 'n.lo / 100000.0')} AS dist FROM ping p CROSS JOIN lab l JOIN big ON big.component = l.component JOIN nd n ON n.node = l.node)
 SELECT qid, node, round(dist, 1) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, node) AS r FROM k WHERE dist <= 3000) WHERE r = 1"""
)


@query("merged_nodes")
def merged_nodes(s, d):
    """Vertices of all roads within 25 units of each other, directly or through others, as one."""
    v = view(s, d, "road_vertex").select(R._node(F.col("lat_micro"), F.col("lon_micro")).alias("node"), "lat_micro", "lon_micro")
    return R.merge_near(v.groupBy("node").agg(F.min("lat_micro").alias("lat_micro"), F.min("lon_micro").alias("lon_micro")), 25.0)


SQL["merged_nodes"] = (
    oracle("", "road_vertex").replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + f""", nd AS MATERIALIZED (SELECT node, min(lat_micro) * 0.5 AS y, min(lon_micro) * 0.5 AS x FROM (SELECT {_NODE} AS node, lat_micro, lon_micro FROM road_vertex) GROUP BY node),
 pr AS MATERIALIZED (SELECT a.node AS src, b.node AS dst FROM nd a JOIN nd b ON b.y BETWEEN a.y - 25 AND a.y + 25 WHERE abs(a.x - b.x) <= 25 AND a.node <> b.node AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 625),
 lab(node, merged) USING KEY (node) AS (SELECT node, node FROM nd UNION SELECT p.dst, min(l.merged) FROM lab l JOIN pr p ON p.src = l.node JOIN recurring.lab c ON c.node = p.dst WHERE l.merged < c.merged GROUP BY p.dst)
 SELECT node, merged FROM lab"""
)


def simplify_lines(s, d):
    """Vertices left of every road at two tolerances; the method has no form in SQL, tests hold it against the scalar one."""
    lines = shape(view(s, d, "road_vertex"))
    return E.simplify(lines, 0.0005).select("osm_id", F.size("coords").alias("n")).join(E.simplify(lines, 0.001).select("osm_id", F.size("coords").alias("n_coarse")), "osm_id")


WHOLE |= {"simplify_lines": simplify_lines}
