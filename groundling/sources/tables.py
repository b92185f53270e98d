"""Layer tables as Parquet and the raw inputs they are built from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE = "array<struct<lon:double,lat:double>>"
#: Columns of every layer.
SCHEMAS = {
    "buildings": f"osm_id long, building_type string, centroid_lat double, centroid_lon double, coords {LINE}, name string, category string, name_source string, poi_osm_id long, use_class string, height_tier string, height_m double",
    "roads": f"osm_id long, road_class string, coords {LINE}, name string, ref_tag string, oneway string, speed_limit_kmh int, lanes int, surface string, bridge_tunnel string",
    "intersections": "lon_micro int, lat_micro int, kind int",
    "water": f"osm_id long, water_type string, geom_type int, coords {LINE}, ref_feature_id long, name string, width int",
    "large_water": f"feature_id long, name string, water_type string, coords {LINE}",
    "business": "osm_id long, lat double, lon double, name string, category string, phone string, website string, address string, brand string, operating_status string, emails array<string>, socials array<string>",
    "places": "osm_id long, lat double, lon double, place_type string, population long, name string, alt_name string, admin_level int",
    "rail": f"osm_id long, rail_type string, geom_type int, coords {LINE}, name string",
    "parks": f"osm_id long, park_type string, coords {LINE}, name string",
    "admin_grid": "cell long, country string, state string, county string, zip string, timezone string, boundary_flags int",
    "admin_polygons": f"name string, admin_level int, coords {LINE}",
    "address": "osm_id long, housenumber string, street string, lat double, lon double",
}


def open_layer(spark: SparkSession, root: str, layer: str, state: str | None = None) -> DataFrame:
    """A layer's table under ``root``, one state of it if named; a layer that is not there has no rows."""
    path = f"{root.rstrip('/')}/{layer}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], T.StructType.fromDDL(SCHEMAS[layer] + ", state string"))
    df = spark.read.parquet(path)
    return df if state is None else df.where(F.col("state") == state)


def open_state(spark: SparkSession, root: str, state: str) -> dict[str, DataFrame]:
    return {layer: open_layer(spark, root, layer, state) for layer in SCHEMAS}


def describe_layer(df: DataFrame) -> DataFrame:
    """What a file's header says: features, cells and extent, from (cell, lat, lon)."""
    return df.agg(F.count("*").alias("feature_count"), F.count_distinct("cell").alias("block_count"), *[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))])


def geojson_lines(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of GeoJSON lines: ``properties`` (DDL) and geometry; lines that are no JSON are dropped."""
    schema = f"type string, geometry struct<type:string,coordinates:string>, properties struct<{', '.join(p.strip().replace(' ', ':', 1) for p in properties.split(','))}>"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.where("geometry IS NOT NULL").select("properties.*", F.col("geometry.type").alias("geometry_type"), F.col("geometry.coordinates").alias("coordinates"))


def way_features(ways: DataFrame, key: str, values: list[str] | None = None, least: int = 2) -> DataFrame:
    """Raw ways (id, tags map, nodes array<struct<lon,lat>>) that carry a tag and have enough vertices in range."""
    tag = F.element_at("tags", key)
    hit = tag.isNotNull() if values is None else tag.isin(*values)
    sound = F.forall("nodes", lambda n: n["lat"].between(-90, 90) & n["lon"].between(-180, 180))
    return ways.where(hit & (F.size("nodes") >= least) & sound).select(F.col("id").alias("osm_id"), tag.alias(key), F.element_at("tags", "name").alias("name"), F.col("nodes").alias("coords"))


def addresses(ways: DataFrame) -> DataFrame:
    """(osm_id, housenumber, street, lon, lat): buildings with a house number, at their first node."""
    tag = lambda k: F.element_at("tags", k)
    first = F.get("nodes", F.lit(0))
    hit = ways.where(tag("building").isNotNull() & (F.coalesce(tag("addr:housenumber"), F.lit("")) != "") & (F.size("nodes") > 0))
    return hit.select(F.col("id").alias("osm_id"), tag("addr:housenumber").alias("housenumber"), F.coalesce(tag("addr:street"), F.lit("")).alias("street"), first["lon"].alias("lon"), first["lat"].alias("lat"))


def highways(roads: DataFrame) -> DataFrame:
    """Roads of the long-distance classes alone."""
    return roads.where(F.col("road_class").isin("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link"))


def category_names(spark: SparkSession, path: str) -> DataFrame:
    """(category_idx, category) of a sidecar, from 1: a JSON list, or an object that has it as ``categories``."""
    text = spark.read.text(path, wholetext=True)
    names = F.coalesce(F.from_json(F.get_json_object("value", "$.categories"), "array<string>"), F.from_json("value", "array<string>"))
    return text.select(F.posexplode(names).alias("i", "category")).select((F.col("i") + 1).alias("category_idx"), "category")


def wkb_points(df: DataFrame, column: str) -> DataFrame:
    """lon and lat of little-endian WKB points, by bytes: no UDF."""

    top = F.lit("9223372036854775808").cast("decimal(20,0)")

    def number(at: int):
        order = F.concat(*[F.hex(F.substring(F.col(column), at + 8 - i, 1)) for i in range(8)])
        bits = F.conv(order, 16, 10).cast("decimal(20,0)")
        sign = F.when(bits >= top, -1.0).otherwise(1.0)
        rest = F.when(bits >= top, bits - top).otherwise(bits).cast("long")
        exponent, fraction = F.shiftright(rest, 52), rest.bitwiseAND(F.lit((1 << 52) - 1))
        return F.when(rest == 0, 0.0).otherwise(sign * (1 + fraction / F.lit(float(1 << 52))) * F.pow(F.lit(2.0), exponent - 1023))

    return df.withColumns({"lon": number(5), "lat": number(13)})
