"""Archives of vector tiles (PMTiles, version 3) as a Python data source: one row a feature, in degrees.

``spark.dataSource.register(VectorTiles)``, then ``spark.read.format("vectortiles").load(path)``. Options: layer (only that layer of the tiles),
ids (hilbert, as the archive format defines tile numbers, or rowmajor, as some writers number them), entries (directory entries a partition). Tiles that
cannot be decoded are errors.
"""

from __future__ import annotations

import gzip
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import zstandard
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .layerfile import Cursor, files, section

# Fixed values of the formats.
HEADER = struct.Struct("<7sBQQQQQQQQQQQBBBBBBiiiiBii")
FIELDS = (
    "magic", "version", "root_offset", "root_length", "metadata_offset", "metadata_length", "leaf_offset", "leaf_length", "data_offset", "data_length", "addressed", "entries", "contents", "clustered", "directory_packing",
    "tile_packing", "tile_type", "min_zoom", "max_zoom", "min_lon", "min_lat", "max_lon", "max_lat", "centre_zoom", "centre_lon", "centre_lat",
)
NO_PACKING, GZIP, ZSTD = 1, 2, 4
KINDS = ("unknown", "point", "linestring", "polygon")
SCHEMA = "z int, x long, y long, layer string, id long, kind string, parts array<array<struct<lon:double,lat:double>>>, tags map<string,string>"


def unpack(raw: bytes, packing: int) -> bytes:
    if raw[:2] == b"\x1f\x8b":
        return gzip.decompress(raw)
    if packing == ZSTD:
        return zstandard.ZstdDecompressor().decompress(raw)
    if packing not in (0, NO_PACKING, GZIP):
        raise ValueError(f"tiles packed by method {packing} cannot be read")
    return raw


def read_header(raw: bytes) -> dict:
    head = dict(zip(FIELDS, HEADER.unpack_from(raw), strict=True)) if len(raw) >= HEADER.size else {}
    if head.get("magic") != b"PMTiles" or head["version"] != 3:
        raise ValueError("no tile archive of version 3")
    return head


def directory(raw: bytes) -> list[tuple[int, int, int, int]]:
    """(tile number, run length, offset, length) of each entry; run length 0: a directory further down."""
    c = Cursor(raw)
    n = c.take_varint()
    ids, last = [], 0
    for _ in range(n):
        last += c.take_varint()
        ids.append(last)
    runs, sizes = [c.take_varint() for _ in range(n)], [c.take_varint() for _ in range(n)]
    offsets: list[int] = []
    for i in range(n):
        at = c.take_varint()
        offsets.append(at - 1 if at else offsets[-1] + sizes[i - 1])
    return list(zip(ids, runs, offsets, sizes, strict=True))


def tile_of(number: int, hilbert: bool = True) -> tuple[int, int, int]:
    """(z, x, y) of a tile number: all tiles of lower zooms come first, then the place on the curve or in rows."""
    z = 0
    while number >= 1 << 2 * z:
        number -= 1 << 2 * z
        z += 1
    if not hilbert:
        return z, number % (1 << z), number >> z
    x = y = 0
    for k in range(z):
        side, quarter = 1 << k, number >> 2 * k & 3
        right, up = quarter >> 1, (quarter ^ quarter >> 1) & 1
        if not up:
            if right:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
        x, y = x + side * right, y + side * up
    return z, x, y


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message: numbers of varints and fixed values, bytes of the rest."""
    c = Cursor(raw)
    while c.at < len(raw):
        key = c.take_varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, c.take_varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"wire type {kind}")
            size = c.take_varint()
        if c.at + size > len(raw):
            raise ValueError("message ends early")
        yield key >> 3, raw[c.at : c.at + size]
        c.at += size


def numbers(raw: bytes) -> list[int]:
    c, out = Cursor(raw), []
    while c.at < len(raw):
        out.append(c.take_varint())
    return out


def _value(raw: bytes) -> str:
    for n, v in fields(raw):
        if n == 1:
            return v.decode("utf-8", "replace")
        if n in (2, 3):
            return repr(struct.unpack("<f" if n == 2 else "<d", v)[0])
        if n == 7:
            return "true" if v else "false"
        return str(v - (1 << 64) if n == 4 and v >> 63 else (v >> 1 ^ -(v & 1)) if n == 6 else v)
    return ""


def geometry(commands: list[int]) -> list[list[tuple[int, int]]]:
    """Parts of a geometry in tile units: moves begin one, lines go on, a close repeats the first place."""
    parts: list[list[tuple[int, int]]] = []
    at, x, y = 0, 0, 0
    while at < len(commands):
        what, times = commands[at] & 7, commands[at] >> 3
        at += 1
        if what == 7:
            parts[-1].append(parts[-1][0])
            continue
        for _ in range(times):
            dx, dy = commands[at], commands[at + 1]
            at, x, y = at + 2, x + (dx >> 1 ^ -(dx & 1)), y + (dy >> 1 ^ -(dy & 1))
            if what == 1:
                parts.append([])
            parts[-1].append((x, y))
    return parts


def features(raw: bytes, z: int, x: int, y: int, only: str | None = None) -> Iterator[tuple]:
    """Rows of SCHEMA of a tile; places between its edges run in the map's projection."""

    def place(p: tuple[int, int], extent: int) -> tuple[float, float]:
        u, v = (x + p[0] / extent) / (1 << z), (y + p[1] / extent) / (1 << z)
        return u * 360 - 180, math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * v))))

    for number, layer in fields(raw):
        if number != 3:
            continue
        name, extent, keys, values, found = "", 4096, [], [], []
        for n, v in fields(layer):
            if n == 1:
                name = v.decode("utf-8", "replace")
            elif n == 2:
                found.append(v)
            elif n == 3:
                keys.append(v.decode("utf-8", "replace"))
            elif n == 4:
                values.append(_value(v))
            elif n == 5:
                extent = v
        if only is not None and name != only:
            continue
        for f in found:
            got = dict(fields(f))
            tags = numbers(got.get(2, b""))
            parts = [[place(p, extent) for p in part] for part in geometry(numbers(got.get(4, b"")))]
            yield z, x, y, name, got.get(1), KINDS[got.get(3, 0)], parts, {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2], strict=True)}


@dataclass
class Tiles(InputPartition):
    path: str
    head: dict
    entries: list = field(default_factory=list)

    def __post_init__(self):
        super().__init__(None)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.layer, self.hilbert, self.n = options["path"], options.get("layer"), options.get("ids", "hilbert") == "hilbert", int(options.get("entries", 64))

    def partitions(self):
        out = []
        for name in files(self.path):
            head = read_header(section(name, 0, HEADER.size))
            root = directory(unpack(section(name, head["root_offset"], head["root_length"]), head["directory_packing"]))
            out += [Tiles(name, head, root[i : i + self.n]) for i in range(0, len(root), self.n)]
        return out or [Tiles("", {})]

    def read(self, partition: Tiles):
        head, todo = partition.head, list(reversed(partition.entries))
        while todo:
            number, run, offset, size = todo.pop()
            if not run:
                todo += reversed(directory(unpack(section(partition.path, head["leaf_offset"] + offset, size), head["directory_packing"])))
                continue
            raw = unpack(section(partition.path, head["data_offset"] + offset, size), head["tile_packing"])
            for i in range(run):  # one content for a run of tiles
                yield from features(raw, *tile_of(number + i, self.hilbert), self.layer)


class VectorTiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vectortiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))
