"""Building layers from raw features: splitting, ranking, enrichment, clustering, repair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, grid
from ..functions.simplify import kept_vertices
from .lookup import containing
from .routing import _cut


def split_ways(vertices: DataFrame) -> DataFrame:
    """(id, part, pos, lon_micro, lat_micro): lines cut where their vertices change cell.

    The vertex that enters a new cell ends one part and begins the next; parts of one vertex are dropped.
    Windows run over the vertices of one line.
    """
    line = Window.partitionBy("id").orderBy("pos")
    v = vertices.withColumn("cell", grid.cell(F.col("lat_micro"), F.col("lon_micro")))
    v = v.withColumn("_new", (F.col("cell") != F.lag("cell").over(line)).cast("int"))
    v = v.withColumn("_island", F.coalesce(F.sum(F.coalesce("_new", F.lit(0))).over(line), F.lit(0)))
    own = v.select("id", F.col("_island").alias("part"), "pos", "lon_micro", "lat_micro")
    ends = v.where("_new = 1").select("id", (F.col("_island") - 1).alias("part"), "pos", "lon_micro", "lat_micro")
    rows = own.union(ends)
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy("id", "part"))).where("_n >= 2").drop("_n")


def delta_encode(vertices: DataFrame) -> DataFrame:
    line = Window.partitionBy("id").orderBy("pos")
    return vertices.select("id", "pos", *[(F.col(c) - F.lag(c, 1, 0).over(line)).alias(f"d_{c}") for c in ("lon_micro", "lat_micro")])


def delta_decode(diffs: DataFrame) -> DataFrame:
    line = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return diffs.select("id", "pos", *[F.sum(f"d_{c}").over(line).alias(c) for c in ("lon_micro", "lat_micro")])


def ranked_categories(features: DataFrame, most: int = 254) -> DataFrame:
    """(category_idx, category, n): the most frequent, from 1. Only the distinct categories, already counted, are ranked in one place."""
    counts = features.where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "category").limit(most)
    return top.withColumn("category_idx", F.row_number().over(Window.orderBy(F.desc("n"), "category"))).select("category_idx", "category", "n")


def resolve_categories(features: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Names for category_idx; 0 and numbers beyond the table give null."""
    return features.join(sidecar.select("category_idx", "category"), "category_idx", "left")


def string_table(features: DataFrame, column: str) -> DataFrame:
    """(idx, value): distinct values in order, from 0.

    Values are sorted in ranges; an index is the number of values in the ranges before and the place in its own, so only one number a
    range is summed in one place.
    """
    values = features.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    rows = _cut(values.orderBy("value").withColumn("_id", F.monotonically_increasing_id()))  # fixed, so that ranges cannot change between uses
    rows = rows.select("value", F.shiftright("_id", 33).alias("_range"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_at"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, "_range").select((F.col("_start") + F.col("_at")).cast("int").alias("idx"), "value")


def businesses_in_buildings(businesses: DataFrame, buildings: DataFrame) -> DataFrame:
    """(business_id, building_id): the building with the least id that contains each business."""
    points = businesses.select(F.col("osm_id").alias("qid"), "lat_micro", "lon_micro")
    hit = containing(points, buildings.select("osm_id", "coords"))
    return hit.groupBy(F.col("qid").alias("business_id")).agg(F.min("osm_id").alias("building_id"))


def businesses_by_building(businesses: DataFrame, buildings: DataFrame) -> DataFrame:
    """(building_id, n, business_ids): the sidecar from a building to its businesses."""
    pairs = businesses_in_buildings(businesses, buildings)
    return pairs.groupBy("building_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("business_id")).alias("business_ids"))


def unmatched(businesses: DataFrame, pairs: DataFrame) -> DataFrame:
    return businesses.join(pairs.select(F.col("business_id").alias("osm_id")), "osm_id", "left_anti")


def admin_grid(cells: DataFrame, areas: DataFrame) -> DataFrame:
    """(cell, level, name): for every cell (cy, cx) the area of each level that contains its centre, the least id of several."""
    mid = cells.select("cy", "cx", ((F.col("cy") + 0.5) * grid.STEP).cast("long").alias("lat_micro"), ((F.col("cx") + 0.5) * grid.STEP).cast("long").alias("lon_micro"))
    mid = mid.withColumn("qid", grid.cell_id(F.col("cy"), F.col("cx")))
    hit = containing(mid, areas)
    return hit.groupBy("cy", "cx", "level").agg(F.min_by("name", "osm_id").alias("name"))


def merge_layers(*layers: DataFrame) -> DataFrame:
    """Layers of several regions as one, a feature on a border once."""
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x)
    return out.dropDuplicates(["osm_id"])


def running_offsets(blocks: DataFrame) -> DataFrame:
    """(state, cell, size, offset): where each block starts in its state's file."""
    before = Window.partitionBy("state").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))


def fill_nearest(rows: DataFrame, group: str, order: str, column: str) -> DataFrame:
    """Unknown values take the last known before them, or else the first after."""
    w = Window.partitionBy(group).orderBy(order)
    back = F.last(column, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    forth = F.first(column, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn(column, F.coalesce(back, forth))


def batches(cells: DataFrame, group: str, size: int = 8) -> DataFrame:
    """Batches of a fixed number of cells in order."""
    return cells.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group).orderBy("cell")) - 1) / size).cast("long"))


def merge_sparse(cells: DataFrame, group: str, target: int) -> DataFrame:
    """Merged blocks of neighbouring cells: a new one begins where the running size passes another multiple of ``target``."""
    w = Window.partitionBy(group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("merged", F.floor(F.coalesce(F.sum("size").over(w), F.lit(0)) / target).cast("long"))


def at_intersections(pieces: DataFrame, intersections: DataFrame) -> DataFrame:
    """Road pieces with the intersections of their cell: (cell, n_pieces, n_intersections)."""
    a = pieces.groupBy("cell").agg(F.count("*").alias("n_pieces"))
    b = intersections.groupBy("cell").agg(F.count("*").alias("n_intersections"))
    return a.join(b, "cell", "left").withColumn("n_intersections", F.coalesce("n_intersections", F.lit(0)))


def distinct_cells(vertices: DataFrame) -> DataFrame:
    """(id, cell): every cell that a feature's vertices lie in."""
    return vertices.select("id", grid.cell(F.col("lat_micro"), F.col("lon_micro")).alias("cell")).distinct()


def cell_presence(features: DataFrame, code: str) -> DataFrame:
    """(cell, mask): bits of the class codes in each cell, for skipping cells without a class."""
    from ..functions.codec import presence_mask

    return features.groupBy("cell").agg(presence_mask(F.col(code)).alias("mask"))


def weighted_pick(states: DataFrame, draws: DataFrame, most_states: int = 1000) -> DataFrame:
    """(draw, name): a state for each draw u in [0,1), in proportion to its area. ``states`` is a small dimension: more than ``most_states`` are an error."""
    if states.count() > most_states:
        raise ValueError(f"more than {most_states} states")
    upto = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    bands = states.select("name", (F.sum("area").over(upto) / F.sum("area").over(whole)).alias("hi"), ((F.sum("area").over(upto) - F.col("area")) / F.sum("area").over(whole)).alias("lo"))
    return draws.join(F.broadcast(bands), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("draw", "name")


def simplify(coords: DataFrame, tolerance: float) -> DataFrame:
    """(osm_id, coords) by Douglas-Peucker: an Arrow UDF over whole batches of vertices, as the method has no expression form."""
    line = "array<struct<lon:double,lat:double>>"

    @F.arrow_udf(line)
    def reduced(lines: pa.Array) -> pa.Array:
        size = np.array([0 if n is None else n for n in pa.compute.list_value_length(lines).to_pylist()], np.int64)
        flat = lines.flatten()
        x, y = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("lon", "lat"))
        offsets = np.concatenate([[0], np.cumsum(size)])
        keep = kept_vertices(x, y, offsets, tolerance)
        left = np.concatenate([[0], np.cumsum(keep)])[offsets]
        points = pa.StructArray.from_arrays([pa.array(x[keep]), pa.array(y[keep])], names=["lon", "lat"])
        return pa.ListArray.from_arrays(pa.array(left, pa.int32()), points, mask=lines.is_null())

    return coords.select("osm_id", reduced("coords").alias("coords"))


def block_cells(blocks: DataFrame, homes: DataFrame, tries: int = 4) -> DataFrame:
    """(block, cell): the cell of each block's first feature that has one in ``homes`` (osm_id, cell), of the first ``tries`` of its features (block, n, osm_id); null for none."""
    known = blocks.where(F.col("n") < tries).join(homes, "osm_id").groupBy("block").agg(F.min_by("cell", "n").alias("cell"))
    return blocks.select("block").distinct().join(known, "block", "left")


def write_clustered(features: DataFrame, path: str, by: str = "state") -> None:
    """Parquet, one folder a state, rows of a cell together: the layout whose row-group statistics prune cells and boxes."""
    features.repartitionByRange(by, "cell").sortWithinPartitions(by, "cell", "osm_id").write.partitionBy(by).option("compression", "zstd").parquet(path)


def as_geojson(features: DataFrame, kind: str = "LineString") -> DataFrame:
    """One GeoJSON feature a row from (osm_id, coords or lon and lat, other columns as properties): kind is Point, LineString or Polygon (one ring, closed if it is not)."""
    rest = [c for c in features.columns if c not in ("coords", "osm_id", "lon", "lat")]
    if kind == "Point":
        places = F.array("lon", "lat")
    else:
        places = F.transform("coords", lambda v: F.array(v["lon"], v["lat"]))
        if kind == "Polygon":
            places = F.array(F.when(F.get(places, F.lit(0)) == F.element_at(places, -1), places).otherwise(F.concat(places, F.slice(places, 1, 1))))
    shape = F.struct(F.lit(kind).alias("type"), places.alias("coordinates"))
    return features.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("osm_id").alias("id"), shape.alias("geometry"), F.struct(*rest).alias("properties") if rest else F.lit(None).alias("properties"))).alias("value"))


def feature_collection(features: DataFrame, kind: str = "LineString", most: int = 5000) -> DataFrame:
    """One row: the FeatureCollection of the first ``most`` features by id, as a map's reply holds no more."""
    first = as_geojson(features.orderBy("osm_id").limit(most), kind)
    joined = F.array_join(F.array_sort(F.collect_list("value")), ",")
    return first.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), joined, F.lit("]}")).alias("value"))


def box_of(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("id").agg(*[f(F.col(c)).alias(f"{n}_{c}") for c in ("lat_micro", "lon_micro") for n, f in (("min", F.min), ("max", F.max))])


def centroids(shapes: DataFrame) -> DataFrame:
    c = geo.centroid(F.col("coords"))
    return shapes.select("osm_id", F.round(c["lat"], 6).alias("lat"), F.round(c["lon"], 6).alias("lon"))
