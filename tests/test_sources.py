import gzip
import json
import struct
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from groundling.functions import grid
from groundling.operators import etl, lookup
from groundling.plans.fixtures import roads, view
from groundling.sources import layerfile, osmpbf, tables, vectortiles
from groundling.sources.layerfile import LETTERS, LayerFile, decode_intersections, encode_block, merged_part, read_header, read_index

D = "/root/testdata/sf0.001"
LINE = [{"lon": -86.7, "lat": 36.1}, {"lon": -86.71, "lat": 36.12}]
RING = [{"lon": x, "lat": y} for x, y in ((-86.71, 36.1), (-86.7, 36.1), (-86.7, 36.11), (-86.71, 36.11))]
ROWS = {
    "roads": {"osm_id": 7, "coords": LINE, "road_class": "tertiary", "name": "Main", "ref_tag": None, "oneway": "forward", "speed_limit_kmh": 50, "lanes": 2, "surface": "cobblestone", "bridge_tunnel": "bridge"},
    "business": {"osm_id": -5, "lon": -86.7, "lat": 36.1, "name": "Café", "category_idx": 3, "phone": None, "website": "https://x", "address": None, "brand": "B", "operating_status": "open", "emails": "a@b;c@d", "socials": None},
    "places": {"osm_id": 9, "lon": -86.7, "lat": 36.1, "place_type": "town", "population": 70_000, "name": "T", "alt_name": None, "admin_level": 8},
    "address": {"osm_id": 11, "housenumber": "12b", "street": "Hauptstraße"},
    "rail": {"osm_id": 4, "geom_type": 0, "coords": LINE, "rail_type": "tram", "name": None},
    "parks": {"osm_id": 3, "coords": LINE * 150, "park_type": "garden", "name": "P"},
    "buildings": {"osm_id": 8, "building_type": "house", "centroid_lat": 36.105, "centroid_lon": -86.705, "coords": RING, "name": "Hall", "category": None, "name_source": "survey", "poi_osm_id": 77, "height_m": 6.5},
    "water": {"osm_id": 2, "geom_type": 2, "coords": [], "ref_feature_id": 6, "water_type": "lake", "name": None, "width": 12},
}


#: The cell of RING's first vertex.
CELL = (1805 + grid.OFFSET) * grid.WRAP - 4336 + grid.OFFSET


def near(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(LayerFile)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


@pytest.mark.parametrize("layer", sorted(LETTERS))
def test_round_trip(source, tmp_path, layer):
    schema = source.createDataFrame([], "cell long, " + layerfile.LAYOUTS[layer][0]).schema
    five, two = (CELL, CELL - 3) if layer == "buildings" else (5, 2)  # buildings of version 8 lie around their cell's centre
    rows = [(five, *(ROWS[layer][f.name] for f in schema[1:])), (two, *((ROWS[layer][f.name] + 10) if f.name == "osm_id" else ROWS[layer][f.name] for f in schema[1:]))]
    source.createDataFrame(rows, schema).write.format("layerfile").mode("append").option("layer", layer).save(str(tmp_path / "x"))
    back = source.read.format("layerfile").option("layer", layer).option("entries", 1).load(str(tmp_path / "x"))
    assert sorted(r.osm_id for r in back.collect()) == sorted([ROWS[layer]["osm_id"], ROWS[layer]["osm_id"] + 10])
    pushed = source.read.format("layerfile").option("layer", layer).option("pushdown", "true").load(str(tmp_path / "x"))
    assert pushed.where(f"cell > {two} AND cell IN ({five}, {two})").count() == 1 and pushed.where("cell = 9").count() == 0
    got = pushed.where(f"cell = {five}").collect()
    assert back.where(f"cell = {five}").collect() == got
    assert len(got) == 1 and {k: near(v) for k, v in got[0].asDict(True).items()} == {"cell": five} | ROWS[layer]


def test_whole_layer(source, tmp_path):
    cols = [c.split()[0] for c in layerfile._split_ddl(layerfile.LAYOUTS["roads"][0])]
    first = F.get("coords", F.lit(0))
    layer = roads(source, D).withColumn("osm_id", F.col("piece_id")).withColumn("cell", grid.cell(F.rint(first["lat"] * 100000), F.rint(first["lon"] * 100000)))
    full = layer.select("cell", *[F.col(c) if c in layer.columns else F.lit(None).cast("int" if c in ("speed_limit_kmh", "lanes") else "string").alias(c) for c in cols])
    full.repartition(3, "cell").write.format("layerfile").mode("append").option("layer", "roads").save(str(tmp_path / "r"))
    back = source.read.format("layerfile").option("layer", "roads").load(str(tmp_path / "r"))
    pick = lambda df: sorted((r.osm_id, r.road_class, r.name, tuple(map(tuple, r.coords))) for r in df.collect())
    assert pick(back) == pick(full)


def test_format_details():
    block = encode_block([ROWS["roads"]], "roads", [(1, 2, 3), (4, 5, 4)])
    assert decode_intersections(block) == [(1, 2, 3), (4, 5, 4)]
    assert [r["osm_id"] for r in layerfile.decode_block(block, "roads")] == [7]
    with pytest.raises(layerfile.BadRecord):
        list(layerfile.decode_block(block[:9], "roads"))
    merged = struct.pack("<iiI", 0, 0, 2) + struct.pack("<QI", 1, 0) + struct.pack("<QI", 2, 3) + b"abcdef"
    assert (merged_part(merged, 0), merged_part(merged, 1), merged_part(merged, 2)) == (b"abc", b"def", b"")
    wide = struct.pack("<I", 1) + struct.pack("<Qiiii", 11, 1, 2, 3, 4) + (300).to_bytes(6, "little") + struct.pack("<HBBHH", 5, 0, 1, 9, 2)
    e = read_index(wide, {"blocks_offset": 256})[0]
    assert (e.cell, e.offset, e.length, e.count, e.box, e.place) == (11, 300, 65541, 9, (1, 2, 3, 4), 2)
    assert layerfile.inflate(zstandard.compress(b"x"), b"no dictionary") == b"x"


@pytest.mark.parametrize("version", [6, 7, 8])
def test_building_versions(version):
    """Walls of version 7 are rounded to a 256th of a turn and a fifth of a metre; the others are exact."""
    ring = [{"lon": -86.7 + x / 100000, "lat": 36.1 + y / 100000} for x, y in ((0, 0), (30, 0), (30, 25), (12, 31), (0, 25))]
    rows = [
        {"osm_id": 40, "building_type": "palace", "coords": ring, "name": "Haus", "category": "museum", "name_source": "osm", "poi_osm_id": 9, "height_m": 12.0},
        {"osm_id": 12, "building_type": "school", "coords": ring[:3], "name": None, "category": None, "name_source": None, "poi_osm_id": None, "height_m": None},
        {"osm_id": 41, "building_type": "yes", "coords": [ring[i % 5] for i in range(200)] if version != 7 else ring, "name": "n" * 256, "category": None, "name_source": None, "poi_osm_id": None, "height_m": None},
    ]
    rows[2]["name"] = "n" * 200
    centre = layerfile.centre_of(CELL)
    got = list(layerfile.decode_block(layerfile.encode_buildings(rows, version, centre), "buildings", version, centre))
    assert [r["osm_id"] for r in got] == [12, 40, 41]
    for r, want in zip(got, sorted(rows, key=lambda r: r["osm_id"]), strict=True):
        assert all(r.get(k) == want[k] for k in ("building_type", "name", "category", "name_source", "poi_osm_id"))
        assert r.get("height_m") == (want["height_m"] if version == 8 else None)
        off = 1.2e-5 if version == 7 else 1e-9
        assert len(r["coords"]) == len(want["coords"]) and all(abs(p[k] - q[k]) <= off for p, q in zip(r["coords"], want["coords"], strict=True) for k in ("lon", "lat"))


def test_bytes_of_a_building():
    """Version 8 by hand: two strings, then a record of a triangle (a count below four stands on its own)."""
    record = bytes([14, 0xF1, 3]) + struct.pack("<hh", 10, -20) + bytes([2, 4, 1, 3]) + bytes([0, 1 | 16, 1, 13])
    data = b"\x02\x05house\x01N" + struct.pack("<I", len(record)) + record + bytes(4)
    (row,) = layerfile.decode_block(data, "buildings", 8, (1.0, 2.0))
    assert (row["osm_id"], row["building_type"], row["name"], row["height_m"]) == (7, "house", "N", 6.5)
    assert [(round(p["lon"] * 1e5), round(p["lat"] * 1e5)) for p in row["coords"]] == [(100010, 199980), (100011, 199982), (100010, 199980)]


def test_wide_index_and_merged_blocks(source, tmp_path):
    schema = source.createDataFrame([], "cell long, " + layerfile.LAYOUTS["roads"][0]).schema
    place = lambda i: [{"lon": -86.7 + i / 10, "lat": 36.1}, {"lon": -86.69 + i / 10, "lat": 36.12}]
    rows = [(i, *(place(i) if f.name == "coords" else i + 1 if f.name == "osm_id" else ROWS["roads"][f.name] for f in schema[1:])) for i in range(20)]
    met = source.createDataFrame([(i, 100 + i, 200, 1 + i % 4) for i in range(0, 20, 3)], "cell long, lon_micro int, lat_micro int, kind int")
    met.write.parquet(str(tmp_path / "met"))
    source.createDataFrame(rows, schema).coalesce(1).write.format("layerfile").mode("append").option("layer", "roads").option("index", 2).option("intersections", str(tmp_path / "met")).save(str(tmp_path / "w"))
    read = lambda **o: source.read.format("layerfile").options(**({"layer": "roads", "entries": 3} | o)).load(str(tmp_path / "w"))
    assert sorted((r.cell, r.osm_id) for r in read().collect()) == [(i, i + 1) for i in range(20)]
    assert sorted(r.cell for r in read(box="36.0,-86.52,36.2,-86.35").collect()) == [2, 3]
    assert sorted(tuple(r) for r in read(layer="intersections").collect()) == [(i, 100 + i, 200, 1 + i % 4) for i in range(0, 20, 3)]
    head = read(layer="header").first()
    assert (head.version, head.feature_count, head.block_count, head.error) == (2, 20, 20, None)
    (tmp_path / "w" / "bad.layer").write_bytes(b"no layer")
    assert sorted((r.error or "")[:6] for r in read(layer="header").collect()) == ["", "8 byte"]


def test_bad_records_are_counted(source, tmp_path):
    block = zstandard.compress(encode_block([ROWS["roads"], ROWS["roads"] | {"osm_id": 9}], "roads")[:-30])
    index = struct.pack("<IQ", 1, 5) + (0).to_bytes(6, "little") + len(block).to_bytes(3, "little") + struct.pack("<H", 2)
    head = layerfile.HEADER.pack(b"LAYERSR", 0, 1, 0, 0, 0, 0, 2, 1, 256, 0, 256, len(index), 256 + len(index), 0, 0)
    (tmp_path / "x.layer").write_bytes(head + index + block)
    read = lambda **o: source.read.format("layerfile").options(layer="roads", **o).load(str(tmp_path / "x.layer"))
    with pytest.raises(Exception, match="record at byte"):
        read().collect()
    assert [r.osm_id for r in read(mode="permissive").collect()] == [7]
    (bad,) = read(errors="true").collect()
    assert bad.cell == 5 and bad.at > 0 and bad.bytes_left > 0 and "record at byte" in bad.error


def test_large_water(source, tmp_path):
    bodies = source.createDataFrame([(6, "Lake", "lake", LINE), (2, None, "bay", LINE[:1])], layerfile.SIDE_TABLES["large_water"])
    bodies.write.parquet(str(tmp_path / "aux"))
    schema = source.createDataFrame([], "cell long, " + layerfile.LAYOUTS["water"][0]).schema
    source.createDataFrame([(5, *(ROWS["water"][f.name] for f in schema[1:]))], schema).write.format("layerfile").mode("append").option("layer", "water").option("aux", str(tmp_path / "aux")).save(str(tmp_path / "w"))
    back = source.read.format("layerfile").option("layer", "large_water").load(str(tmp_path / "w"))
    assert sorted((r.feature_id, r.name, r.water_type, len(r.coords)) for r in back.collect()) == [(2, "", "bay", 1), (6, "Lake", "lake", 2)]
    water = source.read.format("layerfile").option("layer", "water").load(str(tmp_path / "w"))
    (row,) = lookup.resolve_references(water, back).collect()
    assert (row.body_name, [(p.lon, p.lat) for p in row.coords]) == ("Lake", [(p["lon"], p["lat"]) for p in LINE])


def test_administrative_file(source, tmp_path):
    strings = source.createDataFrame([("country", 0, "US"), ("state", 0, "TN"), ("state", 1, "KY"), ("county", 0, "Davidson"), ("zip", 0, "37201"), ("timezone", 0, "America/Chicago")], layerfile.SIDE_TABLES["admin_strings"])
    cells = source.createDataFrame([(CELL, 0, 1, 0, 0, 0, 2), (CELL - 7, 0, 9, 0, 0, 0, 0)], layerfile.SIDE_TABLES["admin_grid"])
    shapes = source.createDataFrame([("Tennessee", 0, 4, RING)], layerfile.SIDE_TABLES["admin_polygons"])
    layerfile.write_admin(str(tmp_path / "a.layer"), strings, cells, shapes)
    read = lambda t: source.read.format("layerfile").option("layer", t).load(str(tmp_path / "a.layer"))
    for table, df in (("admin_strings", strings), ("admin_grid", cells), ("admin_polygons", shapes)):
        assert sorted(map(str, read(table).collect())) == sorted(map(str, df.collect())), table
    names = {r.cell: tuple(r)[1:] for r in lookup.named_cells(read("admin_grid"), read("admin_strings")).collect()}
    assert names == {CELL: ("US", "KY", "Davidson", "37201", "America/Chicago", 2), CELL - 7: ("US", "", "Davidson", "37201", "America/Chicago", 0)}


def test_trained_dictionary_and_lost_index(source, tmp_path):
    schema = source.createDataFrame([], "cell long, " + layerfile.LAYOUTS["business"][0]).schema
    rows = [(i // 5, *(i if f.name == "osm_id" else f"Shop number {i}" if f.name == "name" else ROWS["business"][f.name] for f in schema[1:])) for i in range(400)]
    df = source.createDataFrame(rows, schema).coalesce(1)
    for name, size in (("plain", 0), ("trained", 2000)):
        df.write.format("layerfile").mode("append").option("layer", "business").option("dictionary", size).save(str(tmp_path / name))
        back = source.read.format("layerfile").option("layer", "business").load(str(tmp_path / name))
        assert sorted((r.cell, r.osm_id, r.name) for r in back.collect()) == [(r[0], r[1], f"Shop number {r[1]}") for r in rows]
    files = [next((tmp_path / n).iterdir()) for n in ("plain", "trained")]
    assert read_header(files[1].read_bytes())["dict_length"] > 0 and files[1].stat().st_size < files[0].stat().st_size
    blocks = source.read.format("layerfile").option("layer", "blocks").load(str(files[1]))
    homes = source.createDataFrame([(r[1], r[0]) for r in rows if r[1] % 5 == 2], "osm_id long, cell long")
    found = etl.block_cells(blocks, homes)
    assert sorted((r.block, r.cell) for r in found.collect()) == [(i, i) for i in range(80)]


def test_map_extract(source, tmp_path):
    """A file made by hand: dense nodes, a plain node, ways and a relation."""
    zig = lambda v: v << 1 ^ v >> 63
    packed = lambda xs: b"".join(varint(x & (1 << 64) - 1) for x in xs)
    steps = lambda xs: packed([zig(b - a) for a, b in zip([0, *xs], xs)])
    texts = message(*[(1, t.encode()) for t in ("", "highway", "primary", "name", "Main", "natural", "water", "type", "multipolygon", "outer", "waterway", "creek")])
    xs, ys = [-860000000, -859000000, -859000000, -860000000], [360000000, 360000000, 361000000, 361000000]
    dense = message((1, steps([10, 11, 12, 13])), (8, steps(ys)), (9, steps(xs)), (10, packed([0, 3, 4, 0, 0, 0])))
    node = message((1, zig(14)), (2, packed([3])), (3, packed([4])), (8, zig(362000000)), (9, zig(-858000000)))
    way = lambda i, tags, refs: message((1, i), (2, packed(tags[::2])), (3, packed(tags[1::2])), (8, steps(refs)))
    relation = message((1, 5), (2, packed([5, 7])), (3, packed([6, 8])), (8, packed([9, 9])), (9, steps([2, 3])), (10, packed([1, 1])))
    group = message((2, dense), (1, node), (3, way(1, [1, 2, 3, 4], [10, 11, 14])), (3, way(2, [], [10, 11, 12, 13, 10])), (3, way(3, [10, 11], [12, 13])), (3, way(4, [1, 2], [10, 99])), (4, relation))
    block = message((1, texts), (2, group))
    out = b""
    for kind, data in ((b"OSMHeader", b""), (b"OSMData", block), (b"OSMData", message((1, texts)))):
        blob = message((2, len(data)), (3, zlib.compress(data)))
        head = message((1, kind), (3, len(blob)))
        out += struct.pack(">I", len(head)) + head + blob
    (tmp_path / "x.osm.pbf").write_bytes(out)
    source.dataSource.register(osmpbf.MapExtract)
    rows = source.read.format("mapextract").option("blobs", 1).load(str(tmp_path / "x.osm.pbf")).cache()
    nodes = {r.id: (round(r.lon, 7), round(r.lat, 7), r.tags) for r in rows.where("kind = 'node'").collect()}
    assert nodes == {10: (-86.0, 36.0, {}), 11: (-85.9, 36.0, {"name": "Main"}), 12: (-85.9, 36.1, {}), 13: (-86.0, 36.1, {}), 14: (-85.8, 36.2, {"name": "Main"})}
    lines = {r.id: len(r.nodes) for r in osmpbf.ways(rows).collect()}
    assert lines == {1: 3, 2: 5, 3: 2}  # a node of way 4 is not there
    assert [(r.osm_id, r.name) for r in tables.way_features(osmpbf.ways(rows), "highway", ["primary"]).collect()] == [(1, "Main")]
    assert sorted((r.osm_id, r.geom_type, r.water_type, len(r.coords)) for r in osmpbf.water(rows).collect()) == [(3, 1, "creek", 2), (5, 0, "lake", 5)]


def varint(n):
    return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])


def message(*parts):
    return b"".join(varint(n << 3 | (0 if isinstance(v, int) else 2)) + (varint(v) if isinstance(v, int) else varint(len(v)) + v) for n, v in parts)


def test_vector_tiles(source, tmp_path):
    """An archive made by hand: a root with one tile and a leaf with a run of two."""
    zig = lambda v: v << 1 ^ v >> 63
    ring = b"".join(varint(x) for x in (9, zig(0), zig(0), 26, zig(2048), zig(0), zig(0), zig(2048), zig(-2048), zig(0), 15))
    layer = message((15, 2), (1, b"building"), (2, message((1, 7), (2, varint(0) + varint(0) + varint(1) + varint(1)), (3, 3), (4, ring))), (3, b"name"), (3, b"floors"), (4, message((1, b"Hall"))), (4, message((5, 3))), (5, 4096))
    tile = gzip.compress(message((3, layer), (3, message((1, b"other")))))
    entries = lambda *rows: b"".join([varint(len(rows)), *(varint(r[0]) for r in rows), *(varint(r[1]) for r in rows), *(varint(r[2]) for r in rows), *(varint(r[3] + 1) for r in rows)])
    leaf = gzip.compress(entries((5, 2, len(tile), 0)))
    root = gzip.compress(entries((0, 1, len(tile), 0), (5, 0, len(leaf), 0)))
    at = vectortiles.HEADER.size
    head = vectortiles.HEADER.pack(b"PMTiles", 3, at, len(root), 0, 0, at + len(root), len(leaf), at + len(root) + len(leaf), len(tile), 3, 2, 1, 1, 2, 2, 1, 0, 2, 0, 0, 0, 0, 0, 0, 0)
    (tmp_path / "t.pmtiles").write_bytes(head + root + leaf + tile)
    source.dataSource.register(vectortiles.VectorTiles)
    rows = source.read.format("vectortiles").option("layer", "building").load(str(tmp_path / "t.pmtiles")).collect()
    assert sorted((r.z, r.x, r.y, r.id, r.kind, r.tags["name"], r.tags["floors"]) for r in rows) == [(0, 0, 0, 7, "polygon", "Hall", "3"), (2, 0, 0, 7, "polygon", "Hall", "3"), (2, 1, 0, 7, "polygon", "Hall", "3")]
    whole = next(r for r in rows if r.z == 0)
    assert [(round(p.lon, 6), round(p.lat, 3)) for p in whole.parts[0]] == [(-180, 85.051), (0, 85.051), (0, 0), (-180, 0), (-180, 85.051)]
    seen = [vectortiles.tile_of(i) for i in range(85)]
    assert len(set(seen)) == 85 and all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(seen, seen[1:]) if a[0] == b[0])
    assert vectortiles.tile_of(21 + 9, hilbert=False) == (3, 1, 1)
    with pytest.raises(ValueError):
        vectortiles.read_header(b"x" * 200)


@pytest.mark.parametrize("raw", [b"", b"short", bytes(256)])
def test_bad_headers(raw):
    with pytest.raises(ValueError):
        read_header(raw)


def test_tables(spark, tmp_path):
    b = view(spark, D, "business").select("osm_id", "name", F.lit("TN").alias("state"), grid.cell(F.col("lat_micro"), F.col("lon_micro")).alias("cell"), (F.col("lat_micro") / 100000).alias("lat"), (F.col("lon_micro") / 100000).alias("lon"))
    etl.write_clustered(b, str(tmp_path / "business"))
    assert tables.open_layer(spark, str(tmp_path), "business", "TN").count() == b.count()
    assert tables.open_state(spark, str(tmp_path), "TN")["rail"].count() == 0
    assert tables.describe_layer(b).first().feature_count == b.count()
    (tmp_path / "f.jsonl").write_text('{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"osm_id":1,"name":"a"}}\nnot json\n')
    assert [tuple(r) for r in tables.geojson_lines(spark, str(tmp_path / "f.jsonl"), "osm_id long, name string").collect()] == [(1, "a", "Point", "[1,2]")]
    ways = spark.createDataFrame([(1, {"highway": "primary"}, [(0.0, 0.0), (1.0, 1.0)]), (2, {"highway": "primary"}, [(0.0, 95.0), (1.0, 1.0)]), (3, {"name": "x"}, [(0.0, 0.0), (1.0, 1.0)])], "id long, tags map<string,string>, nodes array<struct<lon:double,lat:double>>")
    assert [r.osm_id for r in tables.way_features(ways, "highway", ["primary"]).collect()] == [1]
    tagged = spark.createDataFrame([(1, {"building": "yes", "addr:housenumber": "7"}, [(1.0, 2.0), (3.0, 4.0)]), (2, {"addr:housenumber": "8"}, [(1.0, 2.0)]), (3, {"building": "yes"}, [(1.0, 2.0)])], ways.schema)
    assert [tuple(r) for r in tables.addresses(tagged).collect()] == [(1, "7", "", 1.0, 2.0)]
    assert {r.road_class for r in tables.highways(roads(spark, D)).select("road_class").distinct().collect()} == {"motorway", "primary"}
    for i, text in enumerate(('["a", "b"]', '{"categories": ["a", "b"]}')):
        (tmp_path / f"c{i}.json").write_text(text)
        assert [tuple(r) for r in tables.category_names(spark, str(tmp_path / f"c{i}.json")).collect()] == [(1, "a"), (2, "b")]
    line = etl.as_geojson(roads(spark, D).select("osm_id", "coords", "road_class")).first().value
    assert line.startswith('{"type":"Feature"')
    shapes = spark.createDataFrame([(2, RING, "b"), (1, RING + RING[:1], "a")], "osm_id long, coords array<struct<lon:double,lat:double>>, name string")
    whole = json.loads(etl.feature_collection(shapes, "Polygon").first().value)
    assert whole["type"] == "FeatureCollection" and sorted((f["id"], f["properties"]["name"], len(f["geometry"]["coordinates"][0])) for f in whole["features"]) == [(1, "a", 5), (2, "b", 5)]
    point = json.loads(etl.as_geojson(spark.createDataFrame([(1, 2.0, 3.0)], "osm_id long, lon double, lat double"), "Point").first().value)
    assert point["geometry"] == {"type": "Point", "coordinates": [2.0, 3.0]}
