"""Map extracts in protocol buffers (.osm.pbf) as a Python data source, and lines, areas and relations built from them by joins.

``spark.dataSource.register(MapExtract)``, then ``spark.read.format("mapextract").load(path)``: one row an element. Partitions are runs of the file's
blobs, found by reading their headers alone. ``ways`` joins node places to ways; nothing is looked up on the driver.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.classify import water_type
from .layerfile import files, located
from .vectortiles import fields, numbers

SCHEMA = "kind string, id long, lon double, lat double, tags map<string,string>, refs array<long>, roles array<string>, member_kinds array<string>"
MEMBER_KINDS = ("node", "way", "relation")
NANO = 1e-9


def signed(values: list[int]) -> list[int]:
    return [v >> 1 ^ -(v & 1) for v in values]


def summed(values: list[int]) -> list[int]:
    out, total = [], 0
    for v in values:
        total += v
        out.append(total)
    return out


def inflate(blob: bytes) -> bytes:
    for n, v in fields(blob):
        if n == 1:
            return v
        if n == 3:
            return zlib.decompress(v)
        if n == 7:
            return zstandard.ZstdDecompressor().decompress(v)
        if n in (4, 5, 6):
            raise ValueError(f"blob packed by method {n} cannot be read")
    return b""


def elements(block: bytes) -> Iterator[tuple]:
    """Rows of SCHEMA of a block of elements."""
    texts, groups, step, lat0, lon0 = [], [], 100, 0, 0
    for n, v in fields(block):
        if n == 1:
            texts = [x.decode("utf-8", "replace") for k, x in fields(v) if k == 1]
        elif n == 2:
            groups.append(v)
        elif n == 17:
            step = v
        elif n == 19:
            lat0 = v - (1 << 64) if v >> 63 else v
        elif n == 20:
            lon0 = v - (1 << 64) if v >> 63 else v
    place = lambda x, y: (NANO * (lon0 + step * x), NANO * (lat0 + step * y))

    def tags(got: dict) -> dict[str, str]:
        return {texts[k]: texts[v] for k, v in zip(numbers(got.get(2, b"")), numbers(got.get(3, b"")), strict=True)}

    for group in groups:
        for n, raw in fields(group):
            got = dict(fields(raw)) if n in (1, 2, 3, 4) else {}
            if n == 1:
                i, y, x = signed([got[1], got.get(8, 0), got.get(9, 0)])
                yield "node", i, *place(x, y), tags(got), None, None, None
            elif n == 2:
                ids, ys, xs = (summed(signed(numbers(got.get(k, b"")))) for k in (1, 8, 9))
                pairs, at = numbers(got.get(10, b"")), 0
                for i, y, x in zip(ids, ys, xs, strict=True):
                    own = {}
                    while at < len(pairs) and pairs[at]:
                        own[texts[pairs[at]]] = texts[pairs[at + 1]]
                        at += 2
                    at += 1
                    yield "node", i, *place(x, y), own, None, None, None
            elif n == 3:
                yield "way", got[1], None, None, tags(got), summed(signed(numbers(got.get(8, b"")))), None, None
            elif n == 4:
                yield "relation", got[1], None, None, tags(got), summed(signed(numbers(got.get(9, b"")))), [texts[r] for r in numbers(got.get(8, b""))], [MEMBER_KINDS[k] for k in numbers(got.get(10, b""))]


@dataclass
class Blobs(InputPartition):
    path: str
    places: list = field(default_factory=list)

    def __post_init__(self):
        super().__init__(None)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.n = options["path"], int(options.get("blobs", 16))

    def partitions(self):
        out = []
        for name in files(self.path):
            fs, inner = located(name)
            places, at, size = [], 0, fs.get_file_info(inner).size
            with fs.open_input_file(inner) as f:
                while at < size:
                    f.seek(at)
                    n = struct.unpack(">I", f.read(4))[0]
                    head = dict(fields(f.read(n)))
                    if head[1] == b"OSMData":
                        places.append((at + 4 + n, head[3]))
                    at += 4 + n + head[3]
            out += [Blobs(name, places[i : i + self.n]) for i in range(0, len(places), self.n)]
        return out or [Blobs("")]

    def read(self, partition: Blobs):
        if not partition.places:
            return
        fs, inner = located(partition.path)
        with fs.open_input_file(inner) as f:
            for at, size in partition.places:
                f.seek(at)
                yield from elements(inflate(f.read(size)))


class MapExtract(DataSource):
    """Options: path, blobs (of the file a partition)."""

    @classmethod
    def name(cls) -> str:
        return "mapextract"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def ways(extract: DataFrame) -> DataFrame:
    """(id, tags, nodes array<struct<lon,lat>>) of the ways whose every node is in the extract, as ``tables.way_features`` takes them."""
    way = extract.where("kind = 'way'")
    refs = way.select("id", F.posexplode("refs").alias("pos", "node"))
    nodes = extract.where("kind = 'node'").select(F.col("id").alias("node"), "lon", "lat")
    lines = refs.join(nodes, "node").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("v"))
    lines = lines.select("id", F.transform("v", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("nodes"))
    return way.select("id", "tags", F.size("refs").alias("n")).join(lines, "id").where("n = size(nodes)").select("id", "tags", "nodes")


def areas(extract: DataFrame) -> DataFrame:
    """(osm_id, tags, coords): closed ways of four places at least, and the closed outer rings of multipolygon relations under the relation's id and tags. Rings that are
    cut into several ways are left out."""
    closed = ways(extract).where("size(nodes) >= 4 AND nodes[0] = nodes[size(nodes) - 1]")
    relation = extract.where("kind = 'relation' AND tags['type'] = 'multipolygon'")
    member = F.explode(F.arrays_zip("refs", "roles", "member_kinds"))
    outer = relation.select(F.col("id").alias("osm_id"), F.col("tags").alias("own"), member.alias("m")).where("m.member_kinds = 'way' AND m.roles IN ('outer', '')")
    rings = outer.join(closed.select(F.col("id").alias("ref"), "nodes"), F.col("m.refs") == F.col("ref")).select("osm_id", F.col("own").alias("tags"), F.col("nodes").alias("coords"))
    return closed.select(F.col("id").alias("osm_id"), "tags", F.col("nodes").alias("coords")).union(rings)


def water(extract: DataFrame) -> DataFrame:
    """(osm_id, geom_type, water_type, coords, name): water areas (0) and waterways of two places at least (1)."""
    tag = lambda k: F.coalesce(F.element_at("tags", k), F.lit(""))
    kind = water_type(tag("natural"), tag("water"), tag("waterway"))
    wet = areas(extract).where(tag("natural").isin("water", "coastline") | (tag("water") != "")).select("osm_id", F.lit(0).alias("geom_type"), kind.alias("water_type"), "coords", F.element_at("tags", "name").alias("name"))
    lines = ways(extract).where((tag("waterway") != "") & (F.size("nodes") >= 2))
    return wet.union(lines.select(F.col("id").alias("osm_id"), F.lit(1), kind, F.col("nodes"), F.element_at("tags", "name")))
