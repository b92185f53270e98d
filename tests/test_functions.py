import math
import random
import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundling.functions import classify, codec, geo, grid, tiles
from groundling.operators import etl, lookup
from groundling.sources import tables
from groundling.sources.layerfile import Cursor


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@given(st.integers(0, 2**64 - 1))
def test_varint(n):
    c = Cursor()
    c.put_varint(n)
    assert Cursor(bytes(c.out)).take_varint() == n


@given(st.integers(-(2**62), 2**62))
def test_signed(n):
    c = Cursor()
    c.put_signed(n)
    assert Cursor(bytes(c.out)).take_signed() == n


@given(st.lists(st.tuples(st.floats(-179, 179), st.floats(-85, 85)), min_size=1, max_size=20))
def test_lines(points):
    c = Cursor()
    c.put_line([{"lon": x, "lat": y} for x, y in points])
    back = Cursor(bytes(c.out)).take_line(len(points))
    assert all(abs(p["lon"] - x) < 1e-5 and abs(p["lat"] - y) < 1e-5 for p, (x, y) in zip(back, points, strict=True))


def test_text_is_cut_by_bytes():
    c = Cursor()
    c.put_text("B", "é" * 200)
    assert len(c.out) == 256


@pytest.mark.parametrize("n", [0, -1, 1, 10**6, -(10**6), 2**31 - 1, -(2**31)])
def test_zigzag(spark, n):
    z = one(spark, codec.zigzag(F.lit(n).cast("long")))
    assert z == (n << 1 if n >= 0 else -2 * n - 1)
    assert one(spark, codec.unzigzag(F.lit(z).cast("long"))) == n


def test_delta_arrays(spark):
    a = F.array(*[F.lit(v).cast("long") for v in (5, 3, 3, 10)])
    assert one(spark, codec.deltas(a)) == [5, -2, 0, 7]
    assert one(spark, codec.undelta(codec.deltas(a))) == [5, 3, 3, 10]


def test_texts(spark):
    assert one(spark, codec.parse_latlon(F.lit("36.16, -86.78"))) == (36.16, -86.78)
    assert one(spark, codec.parse_latlon(F.lit("96.16, -86.78"))) is None
    assert one(spark, codec.parse_latlon(F.lit("a, b"))) is None
    assert one(spark, codec.format_duration(F.lit(5400.0))) == "1 h 30 min"
    assert one(spark, codec.split_list(F.lit(" a@b ;; c "))) == ["a@b", "c"]
    assert one(spark, codec.feature_id(F.lit("way/1"))) >= 0


def test_grid_wraps_and_covers(spark):
    east = one(spark, grid.cell(F.lit(5_100_000), F.lit(18_000_500)))
    assert east == one(spark, grid.cell(F.lit(5_100_000), F.lit(18_000_500 - 36_000_000)))
    disk = one(spark, grid.disk(F.lit(0), F.lit(0), 5000.0))
    assert len(disk) == len(set(disk)) and one(spark, grid.cell(F.lit(0), F.lit(0))) in disk
    c = one(spark, grid.centre(grid.cell(F.lit(3_616_270), F.lit(-8_678_160))))
    assert abs(c.lat - 36.1627) < 0.011 and abs(c.lon + 86.7816) < 0.011


def ring(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in points])


def test_geometry(spark):
    square = ring((0, 0), (2, 0), (2, 2), (0, 2))
    assert one(spark, geo.contains(F.lit(1.0), F.lit(1.0), square)) is True
    assert one(spark, geo.contains(F.lit(3.0), F.lit(1.0), square)) is False
    assert one(spark, geo.contains(F.lit(1.0), F.lit(1.0), ring((0, 0), (2, 0), (2, 2), (0, 2), (0, 0)))) is True
    assert one(spark, geo.centroid(square)) == (1.0, 1.0)
    hit = one(spark, geo.to_line(F.lit(0.0), F.lit(0.5), ring((0, 0), (1, 0))))
    assert hit.d == 0 and hit.t == 0.5
    assert one(spark, geo.to_line(F.lit(0.0), F.lit(0.5), ring((0, 0)))) is None
    assert one(spark, geo.to_segment(F.lit(0.0), F.lit(1.0), ring((0, 0))[0], ring((0, 0))[0])).t == 0
    assert one(spark, geo.side_of(F.lit(1.0), F.lit(0.0), ring((0, 0))[0], ring((1, 0))[0])) == "left"


def test_tiles(spark):
    x, y = one(spark, tiles.tile_x(F.lit(-86.7816), 14)), one(spark, tiles.tile_y(F.lit(36.1627), 14))
    b = one(spark, tiles.tile_bounds(F.lit(x), F.lit(y), 14))
    assert b.min_lat <= 36.1627 < b.max_lat and b.min_lon <= -86.7816 < b.max_lon


def test_tags(spark):
    assert [one(spark, classify.speed_kmh(F.lit(t))) for t in ("35 mph", "50", "walk", "300")] == [56, 50, None, 255]
    assert one(spark, classify.height(F.lit("6.5 m"))) == 6.5
    assert one(spark, classify.place_kind(F.lit("neighbourhood"))) == "neighborhood"
    assert one(spark, classify.rail_kind(F.lit("preserved"))) == "rail"


def douglas_peucker(points, tolerance):
    """One line, stretch by stretch: the vertices kept."""
    def inner(a, b):
        (ax, ay), (bx, by) = points[a], points[b]
        size = math.hypot(bx - ax, by - ay)
        off = [math.hypot(x - ax, y - ay) if size == 0 else abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / size for x, y in points[a + 1 : b]]
        if not off or max(off) <= tolerance:
            return []
        m = a + 1 + off.index(max(off))
        return [*inner(a, m), m, *inner(m, b)]

    return [0, *inner(0, len(points) - 1), len(points) - 1] if len(points) > 1 else list(range(len(points)))


def test_simplify(spark):
    rng = random.Random(1)
    lines = [[], [(1.0, 2.0)], [(x / 100, 0.0001 * (x % 2)) for x in range(101)], [(0.0, 0.0), (1.0, 1.0), (2.0, 0.0)], [(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]
    lines += [[(rng.random(), rng.random()) for _ in range(rng.randrange(2, 60))] for _ in range(40)] + [[(i * 0.01, rng.random() * 0.01) for i in range(3000)]]
    df = spark.createDataFrame([*enumerate(lines), (999, None)], "osm_id long, coords array<struct<lon:double,lat:double>>")
    for tolerance in (0.001, 0.1):
        got = {r.osm_id: r.coords and [tuple(p) for p in r.coords] for r in etl.simplify(df, tolerance).collect()}
        assert got.pop(999) is None
        assert got == {i: [v[k] for k in douglas_peucker(v, tolerance)] for i, v in enumerate(lines)}


def test_fixed_values(spark):
    """The values that results depend on, as literals."""
    pairs = lambda f, values: [one(spark, f(*[F.lit(x) for x in (v if isinstance(v, tuple) else (v,))])) for v in values]
    assert pairs(classify.use_class, ["house", "warehouse", "school", "hospital", "barn", "bungalow", "university", None]) == ["residential", "commercial", "industrial/institutional", "industrial/institutional", "unknown", "unknown", "unknown", "unknown"]
    assert pairs(classify.height_tier, [0.0, -1.0, 0.1, 6.0, 6.1, 15.0, 15.5]) == ["unknown", "unknown", "1-2", "1-2", "3-5", "3-5", "6+"]
    assert pairs(classify.lanes, ["2", "2;3", " 4 ", "x", "300"]) == [2, None, 4, None, 255]
    assert pairs(classify.bridge_tunnel, [("yes", "yes"), ("viaduct", "no"), ("aqueduct", "culvert"), ("no", "building_passage")]) == ["tunnel", "bridge", None, "tunnel"]
    water = [("water", "", ""), ("wood", "lake", "river"), ("", "", "riverbank"), ("", "", "ditch"), ("", "", "weir"), ("coastline", "", ""), ("wetland", "marsh", ""), ("", "marsh", ""), ("", "moat", "")]
    assert pairs(classify.water_type, water) == ["lake", "lake", "river", "canal", "stream", "ocean", "wetland", "marsh", "lake"]
    assert lookup.PROFILES["walking"] is None and "secondary_link" not in lookup.PROFILES["driving"] and set(lookup.PROFILES["cycling"]) - set(lookup.PROFILES["driving"]) == {"cycleway"}
    assert lookup.INFLUENCE["hamlet"][0] == 500.0


def test_radius_at_any_latitude(spark):
    """A feature due east at 0.97 of the radius, and at the date line."""
    rows = [(i, lat, lon, r) for i, (lat, lon, r) in enumerate((lat, lon, r) for lat in (0, 47, 60, -70, 85, 89.5) for lon in (10.0, 179.99) for r in (500, 3000, 15000))]
    for radius in (500, 3000, 15000):
        mine = [x for x in rows if x[3] == radius]
        east = lambda lat, lon: (lon + math.degrees(0.97 * radius / 6_371_000 / math.cos(math.radians(lat))) + 180) % 360 - 180  # noqa: B023, E731
        points = spark.createDataFrame([(i, round(lat * 1e5), round(lon * 1e5)) for i, lat, lon, _ in mine], "qid long, lat_micro int, lon_micro int")
        found = spark.createDataFrame([(i, round(lat * 1e5), round(east(lat, lon) * 1e5)) for i, lat, lon, _ in mine], "osm_id long, lat_micro int, lon_micro int")
        assert {r.qid for r in lookup.nearby(points, found, radius, None).where("qid = osm_id").collect()} == {x[0] for x in mine}
        lines = found.selectExpr("osm_id", "osm_id AS piece_id", "'track' AS road_class", "'' AS name", "array(named_struct('lon', lon_micro / 100000.0D, 'lat', lat_micro / 100000.0D), named_struct('lon', lon_micro / 100000.0D, 'lat', lat_micro / 100000.0D + 0.01D)) AS coords")
        at_most_85 = {x[0] for x in mine if abs(x[1]) <= 85}  # the plane that lines are measured in holds near a point only
        assert at_most_85 <= {r.qid for r in lookup.nearest_roads(points, lines, 50, radius).where("qid = osm_id").collect()}


def test_large_shapes_have_few_cells(spark):
    box = lambda *b: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(b, ("min_lat", "min_lon", "max_lat", "max_lon"), strict=True)])
    for b in ((0, 0, 10, 10), (0, 0, 0.01, 0.01), (-80, -179, 80, 179), (47, 179.5, 48, 181)):
        assert 1 <= len(one(spark, grid.cover(box(*b)))) <= 162
    square = ring((0, 0), (12, 0), (12, 12), (0, 12))
    points = spark.createDataFrame([(i, round(y * 1e5), round(x * 1e5)) for i, (x, y) in enumerate([(6, 6), (0.001, 11.999), (12.5, 6), (-0.001, 3)])], "qid long, lat_micro int, lon_micro int")
    shapes = spark.range(1).select(F.lit(1).alias("osm_id"), square.alias("coords"))
    assert sorted(r.qid for r in lookup.containing(points, shapes).collect()) == [0, 1]
    assert sorted((r.qid, r.distance == 0) for r in lookup.buildings_within(points, shapes, 200.0).collect()) == [(0, True), (1, True), (3, False)]


def test_wkb(spark):
    df = spark.createDataFrame([(bytes([1, 1, 0, 0, 0]) + struct.pack("<dd", x, y),) for x, y in ((-86.7816, 36.1627), (0.0, -0.5))], "g binary")
    assert [(r.lon, r.lat) for r in tables.wkb_points(df, "g").collect()] == [(-86.7816, 36.1627), (0.0, -0.5)]


def test_edge_rows(spark):
    points = spark.createDataFrame([(1, 3_600_000, -8_600_000)], "qid long, lat_micro int, lon_micro int")
    none = spark.createDataFrame([], "osm_id long, lat_micro int, lon_micro int, category string, operating_status string")
    assert lookup.nearby(points, none).count() == 0
    edge = spark.createDataFrame([(1, 3_600_000, -8_600_001, None, "open"), (2, 3_599_999, -8_600_000, "x", "closed")], none.schema)
    assert [r.osm_id for r in lookup.nearby(points, edge).orderBy("rank").collect()] == [1, 2]
    assert [r.osm_id for r in lookup.nearby(points, edge, prefix="x").collect()] == [2]
    assert [r.osm_id for r in lookup.nearby(points, edge, exclude_closed=True).collect()] == [1]


def test_overlay_of_places_on_a_cells_edge(spark):
    edges = [v for v in range(-18_000_000, 18_000_000, grid.STEP * 7)]
    views = spark.createDataFrame([(v, (v % 9_000_000) // grid.STEP * grid.STEP / 1e5, v / 1e5, 20) for v in edges], "view long, lat double, lon double, zoom int")
    rows = grid.overlay(views).groupBy("view").agg(F.min("min_lat").alias("a"), F.min("min_lon").alias("b"), F.count("*").alias("n")).collect()
    assert len(rows) == len(edges)
    for r in rows:
        assert round(r.a / 0.02) == (r.view % 9_000_000) // grid.STEP - 6 and round(r.b / 0.02) == r.view // grid.STEP - 6 and r.n == 169


def test_nearest_are_looked_for_as_far_as_needed(spark):
    rnd = random.Random(5)
    made = [(i, 3_600_000 + rnd.randrange(5000), -8_690_000 + rnd.randrange(5000)) for i in range(8000)] + [(9000, 3_620_000, -8_690_000)]
    features = spark.createDataFrame(made, "osm_id long, lat_micro int, lon_micro int")
    points = features.where("osm_id < 20 OR osm_id = 9000").select(F.col("osm_id").alias("qid"), "lat_micro", "lon_micro")
    search = lambda p, f: lookup.nearby(p, f, 3000.0, None)
    reach = lookup.bounded(points, features, "osm_id", 3, 3000.0, lambda p, f: lookup.top_n(search(p, f), 3, F.col("distance"), F.col("osm_id")))
    assert search(reach, features).count() * 5 < search(points, features).count()
    got, want = lookup.nearby(points, features, 3000.0, 3), lookup.top_n(search(points, features), 3, F.col("distance"), F.col("osm_id"))
    assert sorted((r.qid, r["rank"], r.osm_id) for r in got.collect()) == sorted((r.qid, r["rank"], r.osm_id) for r in want.collect())
    assert {r.qid for r in got.collect()} == {*range(20), 9000}


def test_pairs_of_shapes_meet_once(spark):
    rnd = random.Random(6)
    at = [(i, rnd.choice((0, 6_000_000, 8_950_000, -8_990_000)) + rnd.randrange(-9000, 9000), rnd.choice((17_999_000, -17_999_000, 0)) + rnd.randrange(-900, 900)) for i in range(60)]
    points = spark.createDataFrame(at, "qid long, lat_micro int, lon_micro int")
    boxes = spark.createDataFrame([(i, y / 1e5, x / 1e5, y / 1e5 + s, x / 1e5 + s) for (i, y, x) in at for s in (rnd.choice((0.001, 0.05, 2.0)),)], "osm_id long, min_lat double, min_lon double, max_lat double, max_lon double")
    for p in (points, points.withColumn("_reach", F.when(F.col("qid") % 2 == 0, 900.0).otherwise(15000.0))):
        met = [(r.qid, r.osm_id) for r in grid.meet(p, boxes.withColumn("_box", F.struct("min_lat", "min_lon", "max_lat", "max_lon")), 15000.0, F.col("_box")).select("qid", "osm_id").collect()]
        assert len(met) == len(set(met))
        want = p.crossJoin(boxes).where(geo.reaches(F.struct("min_lat", "min_lon", "max_lat", "max_lon"), geo.degrees(F.col("lat_micro")), geo.degrees(F.col("lon_micro")), F.col("_reach") if "_reach" in p.columns else 14800.0))
        assert {(r.qid, r.osm_id) for r in want.where("abs(lat_micro) < 8900000").collect()} <= set(met)


def test_compat_pairs_are_tested_by_box_and_come_once(spark):
    ring = lambda y, x: [(x, y), (x + 0.03, y), (x + 0.03, y + 0.03), (x, y + 0.03)]
    rings = spark.createDataFrame([(i, ring(36.0 + 0.011 * i, -86.9)) for i in range(9)], "osm_id long, coords array<struct<lon:double,lat:double>>")
    points = spark.createDataFrame([(i, 3_600_000 + 700 * i, -8_690_100) for i in range(12)], "qid long, lat_micro int, lon_micro int")
    d = geo.to_ring_compat(geo.degrees(F.col("lat_micro")), geo.degrees(F.col("lon_micro")), F.col("coords"))
    want = points.crossJoin(rings).select("qid", "osm_id", F.round(d, 6)).where(d <= 300.0)
    got = lookup.within_compat(points, rings, 300.0).select("qid", "osm_id", F.round("distance", 6))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_segments_as_rows_equal_the_line_as_a_whole(spark):
    """Distances, segments and places of lines and rings, one of them over the date line; whole lines are not sent along (they were before)."""
    rnd = random.Random(3)
    lines = [(i, [(179.99 + rnd.random() / 50 if i % 2 else rnd.random() / 50, 60 + rnd.random() / 50) for _ in range(rnd.randrange(1, 6))]) for i in range(40)]
    lines = [(i, [(x - 360 if x > 180 else x, y) for x, y in line]) for i, line in lines]
    shapes = spark.createDataFrame(lines, "osm_id long, coords array<struct<lon:double,lat:double>>")
    points = spark.createDataFrame([(q, 6_000_000 + rnd.randrange(2000), (17_999_000 if q % 2 else 0) + rnd.randrange(1000)) for q in range(30)], "qid long, lat_micro long, lon_micro long")
    lat, lon = geo.degrees(F.col("lat_micro")), geo.degrees(F.col("lon_micro"))
    for closed in (False, True):
        rows = lookup._distances(points, shapes, 900.0, closed)
        assert "coords" not in rows.columns
        got = {tuple(r) for r in rows.groupBy("qid", "osm_id").agg(F.min("_near").alias("b")).where("b.d <= 900").select("qid", "osm_id", "b.*").collect()}
        whole = points.crossJoin(shapes.where(F.size("coords") >= 2)).withColumn("b", geo.to_line(lat, lon, F.col("coords"), closed)).where("b.d <= 900").select("qid", "osm_id", "b.*")
        want = {tuple(r) for r in whole.collect()}
        assert got == want and len(want) > 100


def test_least_ring_around_a_point(spark):
    """Many rings around one point, the least of them last; a point in none; rings with the point on neither side of a bound."""
    ring = lambda x, y, r: [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)]
    shapes = spark.createDataFrame([(900 - i, ring(10.0, 20.0, 0.001 * (i + 1))) for i in range(300)] + [(5, ring(11.0, 21.0, 0.001))], "osm_id long, coords array<struct<lon:double,lat:double>>")
    points = spark.createDataFrame([(1, 2_000_000, 1_000_000), (2, 2_000_150, 1_000_000), (3, 2_100_000, 1_100_000), (4, 0, 0)], "qid long, lat_micro long, lon_micro long")
    assert {tuple(r) for r in lookup.least_containing(points, shapes).collect()} == {(1, 601), (2, 601), (3, 5)}
    assert {tuple(r) for r in lookup.nearest_shapes(points, shapes, 50.0, area=True).collect()} == {(1, 601, 0.0), (2, 601, 0.0), (3, 5, 0.0)}


def test_dense_search_finds_the_same_pairs(spark):
    rnd = random.Random(7)
    far = [(rnd.choice((0.0, 47.0, 80.0, -89.95, 90.0)) + rnd.choice((-1, 1)) * rnd.random() / 20, rnd.choice((10.0, 180.0)) + rnd.choice((-1, 1)) * rnd.random() / 20) for _ in range(300)]
    places = [(i, round(min(max(lat, -90.0), 90.0) * 1e5), round((lon + 180) % 360 * 1e5) - 18_000_000) for i, (lat, lon) in enumerate(far)] + [(300, None, None), (301, 0, 1_000_000), (302, 0, -17_000_000)]
    features = spark.createDataFrame(places, "osm_id long, lat_micro int, lon_micro int")
    points = features.where("osm_id % 5 = 0 OR osm_id > 299").withColumnRenamed("osm_id", "qid")
    for radius in (0.0, 500.0, 15_000.0, 150_000.0, 2.1e7):
        got, want = (sorted((r.qid, r.osm_id, round(r.distance, 3)) for r in lookup.nearby(points, features, radius, None, dense=dense).collect()) for dense in (True, False))
        assert got == want and len(got) >= 60
    assert [one(spark, geo.tenths(F.lit(v))) for v in (0.0, 0.05, 0.25, 1.15, 2.5, 14999.949, 14999.95)] == [0.0, 0.1, 0.3, 1.2, 2.5, 14999.9, 15000.0]
