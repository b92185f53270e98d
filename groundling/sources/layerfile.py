"""Binary layer files: a 256-byte header, a cell index, and zstd blocks of records, as a Python data source.

``spark.dataSource.register(LayerFile)``, then ``spark.read.format("layerfile").option("layer", "roads").load(path)``. A path is a
file or a folder, local or in any store that pyarrow's file systems open (hdfs://, s3://, viewfs:// ...); partitions are ranges of index entries, so a file is decoded by many tasks. With
spark.sql.python.filterPushdown.enabled and the option pushdown=true an equality or range on ``cell`` selects index entries, and the option box
leaves out blocks that lie elsewhere. ``df.write.format("layerfile")`` writes one file a task. A record that cannot be decoded is an error; with mode=permissive it ends its
block, and with errors=true the result lists what a permissive scan leaves out.
"""

from __future__ import annotations

import math
import os
import struct
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions.classify import USE_CLASS
from ..functions.grid import OFFSET, STEP, WRAP

# Fixed values of the format.
HEADER = struct.Struct("<7sBB3xffffQIQIQIQQI172x")
HEADER_FIELDS = ("magic", "nul", "version", "min_lat", "min_lon", "max_lat", "max_lon", "feature_count", "block_count", "dict_offset", "dict_length", "index_offset", "index_length", "blocks_offset", "aux_offset", "aux_length")
ENTRY1 = 19
ENTRY2 = 38
LETTERS = {"address": "D", "buildings": "F", "roads": "R", "business": "B", "places": "P", "rail": "T", "parks": "N", "water": "W"}
ROAD_CLASSES = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "tertiary", "residential", "service", "track", "footway", "cycleway", "path", "pedestrian", "tertiary_link")
SURFACES = ("paved", "asphalt", "concrete", "unpaved", "gravel", "dirt", "sand", "grass")
WATER_TYPES = ("lake", "reservoir", "pond", "river", "stream", "creek", "canal", "drain", "bay", "ocean", "wetland", "marsh", "swamp", "estuary")
PLACE_TYPES = ("city", "town", "village", "hamlet", "neighborhood", "suburb", "borough", "quarter", "isolated_dwelling")
RAIL_TYPES = ("rail", "subway", "light_rail", "tram", "monorail", "narrow_gauge", "funicular", "station", "halt", "tram_stop", "subway_entrance")
BUILDING_TYPES = ("yes", "house", "residential", "commercial", "industrial", "retail", "garage", "apartments", "office", "warehouse", "shed", "detached", "terrace", "school", "church", "hospital", "hotel", "roof", "construction", "barn")
ADMIN_LEVELS = ("country", "state", "county", "zip", "timezone")
WALL_STEP_M, WALL_TURNS = 0.2, 256
ONEWAY = ("no", "forward", "reverse")
STRUCTURES = (None, "bridge", "tunnel")


class Cursor:
    """Reads or appends the format's primitives."""

    def __init__(self, data: bytes = b""):
        self.data, self.at, self.out = data, 0, bytearray()

    def take(self, fmt: str) -> Any:
        s = struct.Struct("<" + fmt)
        got = s.unpack_from(self.data, self.at)
        self.at += s.size
        return got[0] if len(got) == 1 else got

    def put(self, fmt: str, *values: Any) -> None:
        self.out += struct.pack("<" + fmt, *values)

    def take_varint(self) -> int:
        value = shift = 0
        more = True
        while more:
            byte = self.take("B")
            value, shift, more = value | (byte & 127) << shift, shift + 7, byte > 127
        return value

    def put_varint(self, value: int) -> None:
        groups = [value & 127]
        while value := value >> 7:
            groups.append(value & 127)
        self.out += bytes([*(g | 128 for g in groups[:-1]), groups[-1]])

    def take_signed(self) -> int:
        v = self.take_varint()
        return -(v + 1) // 2 if v & 1 else v // 2

    def put_signed(self, v: int) -> None:
        self.put_varint(2 * v if v >= 0 else -2 * v - 1)

    def take_text(self, width: str) -> str:
        n = self.take(width)
        if self.at + n > len(self.data):
            raise struct.error("text beyond the block")
        text = self.data[self.at : self.at + n].decode("utf-8", "replace")
        self.at += n
        return text

    def put_text(self, width: str, text: str) -> None:
        raw = text.encode()[: 255 if width == "B" else 65535]
        self.put(width, len(raw))
        self.out += raw

    def take_line(self, n: int) -> list[dict]:
        if not n:
            return []
        lon, lat = self.take("ii")
        line = [(lon, lat)]
        for _ in range(n - 1):
            lon, lat = lon + self.take_signed(), lat + self.take_signed()
            line.append((lon, lat))
        return [{"lon": x / 100000, "lat": y / 100000} for x, y in line]

    def put_line(self, line: list) -> None:
        micro = [(round(p["lon"] * 100000), round(p["lat"] * 100000)) for p in line]
        for i, (x, y) in enumerate(micro):
            if i:
                self.put_signed(x - micro[i - 1][0])
                self.put_signed(y - micro[i - 1][1])
            else:
                self.put("ii", x, y)

    def take_named(self, names: tuple, custom: bool) -> str | None:
        i = self.take("B")
        if custom and i == 255:
            return self.take_text("B")
        return names[i] if i < len(names) else "unknown" if custom else f"unknown({i})"

    def put_named(self, names: tuple, value: str | None, custom: bool) -> None:
        if value in names:
            self.put("B", names.index(value))
        elif custom:
            self.put("B", 255)
            self.put_text("B", value or "")
        else:
            self.put("B", 254)


LINE = "array<struct<lon:double,lat:double>>"
#: Steps of a record in order: (kind, column, argument); ("flag", column, (bit, kind, argument)) reads only if its bit is set.
LAYOUTS: dict[str, tuple[str, tuple]] = {
    "roads": (
        f"osm_id long, coords {LINE}, road_class string, name string, ref_tag string, oneway string, speed_limit_kmh int, lanes int, surface string, bridge_tunnel string",
        (("id", "osm_id", "plain"), ("line", "coords", "H"), ("flags", None, None), ("custom", "road_class", ROAD_CLASSES), ("flag", "name", (0, "text", "H")), ("flag", "ref_tag", (1, "text", "B")), ("flag", "oneway", (2, "named", ONEWAY)),
         ("flag", "speed_limit_kmh", (3, "number", "B")), ("flag", "lanes", (4, "number", "B")), ("flag", "surface", (5, "custom", SURFACES)), ("flag", "bridge_tunnel", (6, "named", STRUCTURES))),
    ),
    "business": (
        "osm_id long, lon double, lat double, name string, category_idx int, phone string, website string, address string, brand string, operating_status string, emails string, socials string",
        (("id", "osm_id", "own"), ("point", None, None), ("text", "name", "H"), ("number", "category_idx", "B"), ("flags", None, None), ("flag", "phone", (0, "text", "B")), ("flag", "website", (1, "text", "B")), ("flag", "address", (2, "text", "H")),
         ("flag", "brand", (3, "text", "B")), ("flag", "emails", (5, "text", "B")), ("flag", "socials", (6, "text", "B")), ("status", "operating_status", None)),
    ),
    "places": (
        "osm_id long, lon double, lat double, place_type string, population long, name string, alt_name string, admin_level int",
        (("id", "osm_id", "signed"), ("point", None, None), ("named", "place_type", PLACE_TYPES), ("varint", "population", None), ("text", "name", "H"), ("flags", None, None), ("flag", "alt_name", (0, "text", "H")), ("flag", "admin_level", (1, "number", "B"))),
    ),
    "rail": (
        f"osm_id long, geom_type int, coords {LINE}, rail_type string, name string",
        (("id", "osm_id", "signed"), ("number", "geom_type", "B"), ("rail", "coords", None), ("named", "rail_type", RAIL_TYPES), ("flags", None, None), ("flag", "name", (0, "text", "H"))),
    ),
    "address": (
        "osm_id long, housenumber string, street string",
        (("id", "osm_id", "signed"), ("text", "housenumber", "H"), ("text", "street", "H")),
    ),
    "parks": (
        f"osm_id long, coords {LINE}, park_type string, name string",
        (("id", "osm_id", "signed"), ("line", "coords", "B"), ("text", "park_type", "B"), ("flags", None, None), ("flag", "name", (0, "text", "H"))),
    ),
    "water": (
        f"osm_id long, geom_type int, coords {LINE}, ref_feature_id long, water_type string, name string, width int",
        (("id", "osm_id", "signed"), ("number", "geom_type", "B"), ("water", "coords", None), ("flags", None, None), ("named", "water_type", WATER_TYPES), ("flag", "name", (0, "text", "H")), ("flag", "width", (1, "number", "H")), ("flag", "_depth", (2, "number", "H"))),
    ),
}
LAYOUTS["buildings"] = (f"osm_id long, building_type string, centroid_lat double, centroid_lon double, coords {LINE}, name string, category string, name_source string, poi_osm_id long, height_m double", ())
FRAMED = ("roads", "business", "buildings")  # records with a length before each
#: Tables beside a file's records: its header, the intersections of road blocks, the large bodies of a water file, and the three tables of an administrative file.
SIDE_TABLES = {
    "header": "path string, magic string, version int, min_lat double, min_lon double, max_lat double, max_lon double, feature_count long, block_count long, error string",
    "intersections": "cell long, lon_micro int, lat_micro int, kind int",
    "blocks": "path string, block long, block_offset long, block_length long, n long, osm_id long",
    "large_water": f"feature_id long, name string, water_type string, coords {LINE}",
    "admin_strings": "level string, idx int, value string",
    "admin_grid": "cell long, country_idx int, state_idx int, county_idx int, zip_idx int, timezone_idx int, boundary_flags int",
    "admin_polygons": f"name string, state_idx int, admin_level int, coords {LINE}",
}
ERRORS = "cell long, at long, bytes_left long, error string"


def _get(c: Cursor, kind: str, arg: Any, row: dict) -> Any:
    if kind == "text":
        return c.take_text(arg)
    if kind == "number":
        return c.take(arg)
    if kind == "varint":
        return c.take_varint()
    if kind in ("named", "custom"):
        return c.take_named(arg, kind == "custom")
    if kind == "line":
        n = c.take(arg)
        return c.take_line(c.take("H") if arg == "B" and n == 255 else n)
    if kind == "rail":
        return c.take_line(1 if row["geom_type"] == 1 else c.take("H"))
    if kind == "water":
        if row["geom_type"] == 2:
            row["ref_feature_id"] = c.take("I")
            return []
        return c.take_line(c.take("H"))
    raise ValueError(kind)


def _put(c: Cursor, kind: str, arg: Any, value: Any, row: dict) -> None:
    if kind == "text":
        c.put_text(arg, value or "")
    elif kind == "number":
        c.put(arg, int(value or 0))
    elif kind == "varint":
        c.put_varint(int(value or 0))
    elif kind in ("named", "custom"):
        c.put_named(arg, value, kind == "custom")
    elif kind in ("line", "rail", "water"):
        line = value or []
        if kind == "water" and row.get("geom_type") == 2:
            c.put("I", int(row.get("ref_feature_id") or 0))
            return
        if kind == "line" and arg == "B":
            c.put("B", min(len(line), 255))
            if len(line) >= 255:
                c.put("H", len(line))
        elif not (kind == "rail" and row.get("geom_type") == 1):
            c.put("H", len(line))
        c.put_line(line[:1] if kind == "rail" and row.get("geom_type") == 1 else line)


def decode_record(c: Cursor, layer: str, before: int) -> dict:
    row: dict[str, Any] = {}
    flags = 0
    for kind, column, arg in LAYOUTS[layer][1]:
        if kind == "id":
            step = c.take_varint() if arg == "plain" else c.take_signed()
            row[column] = step if arg == "own" else before + step
        elif kind == "point":
            lon, lat = c.take("ii")
            row["lon"], row["lat"] = lon / 100000, lat / 100000
        elif kind == "flags":
            flags = c.take("B")
        elif kind == "flag":
            if flags >> arg[0] & 1:
                row[column] = _get(c, arg[1], arg[2], row)
        elif kind == "status":  # two bits are shared with the website, as the format has it
            row[column] = "open" if not flags & 16 else "temporarily_closed" if flags & 2 else "closed"
        else:
            row[column] = _get(c, kind, arg, row)
    return row


def encode_record(c: Cursor, layer: str, row: dict, before: int) -> None:
    for kind, column, arg in LAYOUTS[layer][1]:
        if kind == "id":
            step = int(row[column]) - (0 if arg == "own" else before)
            c.put_varint(step) if arg == "plain" else c.put_signed(step)
        elif kind == "point":
            c.put("ii", round(row["lon"] * 100000), round(row["lat"] * 100000))
        elif kind == "flags":
            flags = sum(1 << a[0] for k, col, a in LAYOUTS[layer][1] if k == "flag" and row.get(col) is not None)
            c.put("B", flags | (16 if row.get("operating_status") in ("closed", "temporarily_closed") else 0))
        elif kind == "flag":
            if row.get(column) is not None:
                _put(c, arg[1], arg[2], row[column], row)
        elif kind != "status":
            _put(c, kind, arg, row.get(column), row)


class BadRecord(ValueError):
    """A record that cannot be decoded, at a byte of its block."""

    def __init__(self, at: int, left: int, why: Exception):
        super().__init__(f"record at byte {at}: {why}")
        self.at, self.left = at, left


def decode_block(data: bytes, layer: str, version: int = 0, centre: tuple[float, float] = (0.0, 0.0)) -> Iterator[dict]:
    """Records of a block; buildings differ by the file's version, and from 8 on lie around their cell's centre (lon, lat)."""
    c, before = Cursor(data), 0
    table: list[str] = []
    if layer == "buildings" and version >= 8:
        table = [c.take_text("B") for _ in range(c.take("B"))]
    while c.at < len(data):
        start = c.at
        try:
            end = None
            if layer in FRAMED:
                size = c.take("I")
                if not size:
                    return
                end = c.at + size
            if layer == "buildings":
                row = decode_building(c, before, version, centre, table)
            else:
                row = decode_record(c, layer, before)
            before = row["osm_id"]
            if end is not None:
                c.at = end
        except (struct.error, IndexError, ValueError) as e:
            raise BadRecord(start, len(data) - start, e) from e
        yield row


def _steps(c: Cursor, line: list[tuple[int, int]], n: int) -> None:
    for _ in range(n):
        lon, lat = line[-1]
        line.append((lon + c.take_signed(), lat + c.take_signed()))


def decode_building(c: Cursor, before: int, version: int, centre: tuple[float, float], table: list[str]) -> dict:
    """A building of version 6 (differences), 7 (walls as bearing and length) or 8 (places in the cell, strings by number)."""
    refer = lambda: c.take_text("B") if (i := c.take("B")) == 255 else table[i] if i < len(table) else ""
    row: dict[str, Any] = {}
    if version >= 8:
        row["osm_id"] = before + c.take_signed()
        many = c.take("B") >> 4
        many = c.take("B") if many == 15 else many + 4
        line = []
        if many:
            x, y = c.take("hh")
            line.append((round(centre[0] * 100000) + x, round(centre[1] * 100000) + y))
            _steps(c, line, many - 1)
        coords = [(x / 100000, y / 100000) for x, y in line]
        i = c.take("B")
        row["building_type"] = c.take_text("B") if i == 255 else table[i] if i < len(table) else "yes"
        flags = c.take("B")
        texts = [refer, refer, refer]
    else:
        row["osm_id"] = before + c.take_varint()
        many = c.take("B")
        first = c.take("ii")
        if version == 7:
            coords = [(first[0] / 100000, first[1] / 100000)]
            for _ in range(many - 1):
                turn, length = c.take("BB")
                bearing, metres, (lon, lat) = math.radians(turn * 360 / WALL_TURNS), length * WALL_STEP_M, coords[-1]
                coords.append((lon + metres * math.sin(bearing) / (111320.0 * math.cos(math.radians(lat))), lat + metres * math.cos(bearing) / 111320.0))
        else:
            line = [first]
            _steps(c, line, many - 1)
            coords = [(x / 100000, y / 100000) for x, y in line]
        flags = c.take("B")
        row["building_type"] = c.take_named(BUILDING_TYPES, True)
        texts = [lambda: c.take_text("H"), lambda: c.take_text("B"), lambda: c.take_text("B")]
    for bit, column in enumerate(("name", "category", "name_source")):
        if flags >> bit & 1:
            row[column] = texts[bit]() or None
    if flags & 8:
        row["poi_osm_id"] = c.take("Q") or None
    if version >= 8 and flags & 16:
        row["height_m"] = c.take("B") / 2
    n = max(len(coords), 1)
    row["centroid_lon"], row["centroid_lat"] = sum(x for x, _ in coords) / n, sum(y for _, y in coords) / n
    row["coords"] = [{"lon": x, "lat": y} for x, y in coords]
    return row


def encode_building(c: Cursor, row: dict, before: int, version: int, centre: tuple[float, float], number: dict[str, int]) -> None:
    """The reverse of ``decode_building``; a ring of more than 255 vertices is an error. Walls (7) are rounded to their steps one after the other."""
    line = [(round(p["lon"] * 100000), round(p["lat"] * 100000)) for p in row["coords"] or []]
    if len(line) > 255:
        raise ValueError(f"building {row['osm_id']} has {len(line)} vertices, 255 at most")
    texts = [row.get(k) for k in ("name", "category", "name_source")]
    height = row.get("height_m") if version >= 8 else None
    flags = sum(1 << i for i, t in enumerate(texts) if t) | (8 if row.get("poi_osm_id") else 0) | (16 if height and height > 0 else 0)

    def refer(text: str) -> None:
        c.put("B", number.get(text, 255))
        if text not in number:
            c.put_text("B", text)

    kind = row.get("building_type") or "yes"
    if version >= 8:
        c.put_signed(row["osm_id"] - before)
        use = next((i for i, types in enumerate(USE_CLASS.values(), 1) if kind in types), 0)
        tall = 0 if not height or height <= 0 else 1 if height <= 6 else 2 if height <= 15 else 3
        packed = len(line) - 4 if 4 <= len(line) <= 18 else 15
        c.put("B", use | tall << 2 | packed << 4)
        if packed == 15:
            c.put("B", len(line))
        if line:
            c.put("hh", line[0][0] - round(centre[0] * 100000), line[0][1] - round(centre[1] * 100000))
    else:
        c.put_varint(row["osm_id"] - before)
        c.put("B", len(line))
        c.put("ii", *(line[0] if line else (0, 0)))
    if version == 7:
        lon, lat = (line[0][0] / 100000, line[0][1] / 100000) if line else (0.0, 0.0)
        for x, y in line[1:]:
            east, north = (x / 100000 - lon) * 111320.0 * math.cos(math.radians(lat)), (y / 100000 - lat) * 111320.0
            turn, length = round(math.degrees(math.atan2(east, north)) * WALL_TURNS / 360) % WALL_TURNS, round(math.hypot(east, north) / WALL_STEP_M)
            if length > 255:
                raise ValueError(f"building {row['osm_id']} has a wall of more than {255 * WALL_STEP_M} m")
            c.put("BB", turn, length)
            bearing, metres = math.radians(turn * 360 / WALL_TURNS), length * WALL_STEP_M
            lon, lat = lon + metres * math.sin(bearing) / (111320.0 * math.cos(math.radians(lat))), lat + metres * math.cos(bearing) / 111320.0
    else:
        for (x, y), (px, py) in zip(line[1:], line, strict=False):
            c.put_signed(x - px)
            c.put_signed(y - py)
    if version >= 8:
        refer(kind)
        c.put("B", flags)
    else:
        c.put("B", flags)
        c.put_named(BUILDING_TYPES, kind, True)
    for i, t in enumerate(texts):
        if t:
            refer(t) if version >= 8 else c.put_text("H" if i == 0 else "B", t)
    if flags & 8:
        c.put("Q", row["poi_osm_id"])
    if flags & 16:
        c.put("B", min(255, round(height * 2)))


def encode_buildings(rows: list[dict], version: int = 8, centre: tuple[float, float] = (0.0, 0.0)) -> bytes:
    c, before, number = Cursor(), 0, {}
    if version >= 8:
        texts = Counter(t for r in rows for t in (r.get("building_type") or "yes", r.get("name"), r.get("category"), r.get("name_source")) if t and len(t.encode()) <= 255)
        number = {t: i for i, (t, _) in enumerate(sorted(texts.items(), key=lambda x: (-x[1], x[0]))[:255])}
        c.put("B", len(number))
        for t in number:
            c.put_text("B", t)
    for row in sorted(rows, key=lambda r: r["osm_id"]):
        one = Cursor()
        encode_building(one, row, before, version, centre, number)
        before = row["osm_id"]
        c.put("I", len(one.out))
        c.out += one.out
    c.put("I", 0)
    return bytes(c.out)


def encode_block(rows: list[dict], layer: str, intersections: list[tuple[int, int, int]] | None = None) -> bytes:
    c, before = Cursor(), 0
    for row in sorted(rows, key=lambda r: r["osm_id"]):
        one = Cursor()
        encode_record(one, layer, row, before)
        before = row["osm_id"]
        if layer in FRAMED:
            c.put("I", len(one.out))
        c.out += one.out
    if layer in FRAMED:
        c.put("I", 0)
    if intersections is not None:
        c.put("H", len(intersections))
        for lon, lat, kind in intersections:
            c.put("iiB", lon, lat, kind)
    return bytes(c.out)


def decode_intersections(data: bytes) -> list[tuple[int, int, int]]:
    """(lon_micro, lat_micro, kind) after the records of a block of roads, version 2."""
    c = Cursor(data)
    while c.at < len(data) - 4 and (size := c.take("I")):
        c.at += size
    return [c.take("iiB") for _ in range(c.take("H"))] if c.at <= len(data) - 2 else []


@dataclass
class Entry:
    cell: int
    offset: int
    length: int
    count: int
    box: tuple | None = None
    place: int | None = None


def read_header(raw: bytes) -> dict:
    if len(raw) < HEADER.size:
        raise ValueError(f"{len(raw)} bytes are too few for a header")
    head = dict(zip(HEADER_FIELDS, HEADER.unpack(raw[: HEADER.size]), strict=True))
    if chr(head["magic"][6]) not in (*LETTERS.values(), "F", "A") or head["nul"]:
        raise ValueError(f"no layer file: magic {head['magic']!r}")
    return head


def read_index(raw: bytes, head: dict) -> list[Entry]:
    """Entries of 19 bytes, or of 38 with the cell's box; offsets as places in the file."""
    n = struct.unpack_from("<I", raw)[0]
    wide = len(raw) >= 4 + n * ENTRY2
    out = []
    for at in range(4, 4 + n * (ENTRY2 if wide else ENTRY1), ENTRY2 if wide else ENTRY1):
        cell = struct.unpack_from("<Q", raw, at)[0]
        if wide:
            box = struct.unpack_from("<iiii", raw, at + 8)
            offset = int.from_bytes(raw[at + 24 : at + 30], "little") | raw[at + 32] << 48
            length = struct.unpack_from("<H", raw, at + 30)[0] | raw[at + 33] << 16
            count, place = struct.unpack_from("<HH", raw, at + 34)
            out.append(Entry(cell, offset, length, count, box, place))
        else:
            out.append(Entry(cell, int.from_bytes(raw[at + 8 : at + 14], "little"), int.from_bytes(raw[at + 14 : at + 17], "little"), struct.unpack_from("<H", raw, at + 17)[0]))
    if out and out[0].offset < head["blocks_offset"]:
        for e in out:
            e.offset += head["blocks_offset"]
    return out


def inflate(raw: bytes, dictionary: bytes) -> bytes:
    """With the file's dictionary if it has one, else or if that fails without."""
    if dictionary:
        try:
            return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress(raw)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdDecompressor().decompress(raw)


def merged_part(data: bytes, place: int) -> bytes:
    """One cell's records out of a block that holds several cells."""
    n = struct.unpack_from("<iiI", data)[2]
    start = 12 + 12 * n
    offsets = [struct.unpack_from("<QI", data, 12 + 12 * i)[1] for i in range(n)]
    if place >= n:
        return b""
    return data[start + offsets[place] : start + offsets[place + 1] if place + 1 < n else len(data)]


def encode_merged(cells: list[tuple[int, bytes]], centre: tuple[int, int]) -> bytes:
    """A block of several cells (cell, records), of ``centre`` (lon, lat) in micro-degrees."""
    cells = sorted(cells)
    head, at = struct.pack("<iiI", *centre, len(cells)), 0
    for cell, records in cells:
        head += struct.pack("<QI", cell, at)
        at += len(records)
    return head + b"".join(records for _, records in cells)


def encode_entry(cell: int, box: tuple[int, int, int, int], offset: int, length: int, count: int, place: int) -> bytes:
    """A wide index entry: box is (min_lon, min_lat, max_lon, max_lat) in micro-degrees, place the cell's in its merged block."""
    low, high = offset & (1 << 48) - 1, offset >> 48
    return struct.pack("<Qiiii", cell, *box) + low.to_bytes(6, "little") + struct.pack("<HBBHH", length & 0xFFFF, high & 0xFF, length >> 16 & 0xFF, count, place)


def centre_of(cell: int) -> tuple[float, float]:
    """(lon, lat) of a square cell's centre; files with cells of another kind need the option centres."""
    return ((cell % WRAP - OFFSET) + 0.5) * STEP / 100000, ((cell // WRAP - OFFSET) + 0.5) * STEP / 100000


def located(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """(file system, path in it) of a URI or a local path."""
    if "://" in path:
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def files(path: str) -> list[str]:
    """The file, or those of the folder, each as it can be given to ``located`` again."""
    fs, inner = located(path)
    if fs.get_file_info(inner).type != pyarrow.fs.FileType.Directory:
        return [path]
    found = [x.path for x in fs.get_file_info(pyarrow.fs.FileSelector(inner)) if x.is_file and not x.base_name.startswith(("_", ".")) and not x.base_name.endswith(".tmp")]
    return sorted(f"{path.rstrip('/')}/{os.path.basename(x)}" for x in found)


def section(path: str, offset: int, length: int) -> bytes:
    fs, inner = located(path)
    with fs.open_input_file(inner) as f:
        f.seek(offset)
        return f.read(length)


@dataclass
class Range(InputPartition):
    path: str
    layer: str
    dictionary: bytes
    entries: list = field(default_factory=list)
    version: int = 0

    def __post_init__(self):
        super().__init__(None)


def _head(path: str) -> tuple[dict, bytes]:
    head = read_header(section(path, 0, HEADER.size))
    return head, section(path, head["dict_offset"], head["dict_length"]) if head["dict_length"] else b""


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.layer, self.path, self.n = options["layer"], options["path"], int(options.get("entries", 256))
        self.permissive, self.errors = options.get("mode", "failfast") == "permissive", options.get("errors", "false") == "true"
        self.low, self.high, self.cells = 0, 1 << 64, None
        self.box = tuple(round(float(x) * 100000) for x in options["box"].split(",")) if "box" in options else None
        self.centres = options.get("centres")

    def _wanted(self, e: Entry) -> bool:
        if not self.low <= e.cell <= self.high or (self.cells is not None and e.cell not in self.cells):
            return False
        if self.box is None or e.box is None:
            return True
        min_lat, min_lon, max_lat, max_lon = self.box
        return e.box[0] <= max_lon and e.box[2] >= min_lon and e.box[1] <= max_lat and e.box[3] >= min_lat

    def partitions(self):
        out = []
        for name in files(self.path):
            head, dictionary = _head(name)
            entries = [e for e in read_index(section(name, head["index_offset"], head["index_length"]), head) if self._wanted(e)]
            out += [Range(name, self.layer, dictionary, entries[i : i + self.n], head["version"]) for i in range(0, len(entries), self.n)]
        return out or [Range("", self.layer, b"", [])]

    def _centre(self, cells: list[int]) -> dict[int, tuple[float, float]]:
        if self.layer != "buildings":
            return {}
        if not self.centres:
            return {c: centre_of(c) for c in cells}
        import pyarrow.parquet

        fs, inner = located(self.centres)
        t = pyarrow.parquet.read_table(inner, filesystem=fs, columns=["cell", "lon", "lat"], filters=[("cell", "in", cells)])
        return {c: (x, y) for c, x, y in zip(*(t.column(k).to_pylist() for k in ("cell", "lon", "lat")), strict=True)}

    def read(self, partition: Range):
        names = [c.split()[0] for c in _split_ddl(LAYOUTS[partition.layer][0])]
        if not partition.entries:
            return
        centres = self._centre([e.cell for e in partition.entries]) if partition.version >= 8 else {}
        fs, inner = located(partition.path)
        with fs.open_input_file(inner) as f:
            for e in partition.entries:
                f.seek(e.offset)
                data = inflate(f.read(e.length), partition.dictionary)
                if e.place is not None:
                    data = merged_part(data, e.place)
                try:
                    for row in decode_block(data, partition.layer, partition.version, centres.get(e.cell, (0.0, 0.0))):
                        if not self.errors:
                            yield (e.cell, *(_plain(row.get(n)) for n in names))
                except BadRecord as bad:
                    if self.errors:
                        yield (e.cell, bad.at, bad.left, str(bad))
                    elif not self.permissive:
                        raise BadRecord(bad.at, bad.left, ValueError(f"cell {e.cell} of {partition.path}: {bad}")) from bad


class SideReader(DataSourceReader):
    """Tables of SIDE_TABLES: one partition a file, for road blocks one a range of entries."""

    def __init__(self, options: dict):
        self.table, self.path, self.n = options["layer"], options["path"], int(options.get("entries", 256))

    def partitions(self):
        if self.table == "intersections":
            return Reader({"layer": "roads", "path": self.path, "entries": self.n}).partitions()
        return [Range(name, self.table, b"") for name in files(self.path)] or [Range("", self.table, b"")]

    def read(self, partition: Range):
        if not partition.path:
            return
        if self.table == "header":
            try:
                head = read_header(section(partition.path, 0, HEADER.size))
                yield (partition.path, head["magic"].decode("latin-1"), *(head[k] for k in HEADER_FIELDS[2:9]), None)
            except (ValueError, struct.error) as e:
                yield (partition.path, *([None] * 8), str(e))
            return
        if self.table == "intersections":
            for e in partition.entries:
                data = inflate(section(partition.path, e.offset, e.length), partition.dictionary)
                for lon, lat, kind in decode_intersections(data if e.place is None else merged_part(data, e.place)):
                    yield (e.cell, lon, lat, kind)
            return
        head, dictionary = _head(partition.path)
        if self.table == "blocks":  # of a file whose index is lost: the first features of each block, to look their cells up
            fs, inner = located(partition.path)
            size = fs.get_file_info(inner).size
            layer = next(k for k, v in LETTERS.items() if v == chr(head["magic"][6]))
            for block, (at, length, data) in enumerate(frames(section(partition.path, head["blocks_offset"], size - head["blocks_offset"]), dictionary)):
                for n, row in zip(range(4), decode_block(data, layer, head["version"]), strict=False):
                    yield partition.path, block, at, length, n, row["osm_id"]
            return
        aux = section(partition.path, head["aux_offset"], head["aux_length"]) if head["aux_length"] else b""
        if self.table == "large_water":
            yield from decode_bodies(inflate(aux, dictionary) if aux[:4] == ZSTD else aux)
        elif self.table == "admin_strings":
            yield from decode_strings(inflate(dictionary, b""))
        elif self.table == "admin_grid":
            for i in range(struct.unpack_from("<I", aux)[0] if aux else 0):
                yield struct.unpack_from("<QBBHHBB", aux, 4 + 16 * i)
        else:
            yield from decode_polygons(inflate(section(partition.path, head["index_offset"], head["index_length"]), b""))


ZSTD = b"\x28\xb5\x2f\xfd"


def frames(data: bytes, dictionary: bytes = b"") -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the blocks in ``data``, found by the mark that each begins with; a mark inside a block's bytes does not cut it, as what is cut there does not unpack."""
    starts = []
    at = data.find(ZSTD)
    while at >= 0:
        starts.append(at)
        at = data.find(ZSTD, at + 1)
    i = 0
    while i < len(starts):
        for j in range(i + 1, len(starts) + 1):
            stop = starts[j] if j < len(starts) else len(data)
            try:
                yield starts[i], stop - starts[i], inflate(data[starts[i] : stop], dictionary)
            except zstandard.ZstdError:
                continue
            i = j
            break
        else:
            i += 1  # no block begins here


def decode_bodies(data: bytes) -> Iterator[tuple]:
    """(feature_id, name, water_type, coords) of a water file's large bodies."""
    c = Cursor(data)
    for _ in range(c.take("I") if data else 0):
        feature, name, kind = c.take("I"), c.take_text("H"), c.take_named(WATER_TYPES, False)
        yield feature, name, kind, _plain(c.take_line(c.take("I")))


def encode_bodies(bodies: list[dict]) -> bytes:
    c = Cursor()
    c.put("I", len(bodies))
    for b in sorted(bodies, key=lambda b: b["feature_id"]):
        c.put("I", b["feature_id"])
        c.put_text("H", b.get("name") or "")
        c.put_named(WATER_TYPES, b["water_type"], False)
        c.put("I", len(b["coords"]))
        c.put_line(b["coords"])
    return bytes(c.out)


def decode_strings(data: bytes) -> Iterator[tuple]:
    c = Cursor(data)
    for level in ADMIN_LEVELS:
        for i in range(c.take("I")):
            yield level, i, c.take_text("H")


def decode_polygons(data: bytes) -> Iterator[tuple]:
    c = Cursor(data)
    for _ in range(c.take("I")):
        state, name, n = c.take("B"), c.take_text("H"), c.take("I")
        yield name, state, 4, [(x / 100000, y / 100000) for x, y in (c.take("ii") for _ in range(n))]


def write_admin(path: str, strings: DataFrame, cells: DataFrame, polygons: DataFrame, most: int = 5_000_000) -> None:
    """One administrative file from ``strings`` (level, idx, value), ``cells`` and ``polygons`` as in SIDE_TABLES. The format is one file that is searched as a
    whole, so its tables are gathered here: more than ``most`` rows together are an error."""
    if cells.count() + strings.count() + polygons.count() > most:
        raise ValueError(f"more than {most} rows for one administrative file")
    by_level: dict[str, list[str]] = {}
    for r in sorted(strings.collect(), key=lambda r: r["idx"]):
        by_level.setdefault(r["level"], []).append(r["value"])
    names, shapes, grid = Cursor(), Cursor(), Cursor()
    for level in ADMIN_LEVELS:
        names.put("I", len(by_level.get(level, ())))
        for text in by_level.get(level, ()):
            names.put_text("H", text)
    rows = polygons.select("name", "state_idx", "coords").collect()
    shapes.put("I", len(rows))
    for r in rows:
        shapes.put("B", r["state_idx"])
        shapes.put_text("H", r["name"])
        shapes.put("I", len(r["coords"]))
        for p in r["coords"]:
            shapes.put("ii", round(p["lon"] * 100000), round(p["lat"] * 100000))
    entries = sorted(tuple(r) for r in cells.select(*[c.split()[0] for c in _split_ddl(SIDE_TABLES["admin_grid"])]).collect())
    grid.put("I", len(entries))
    for e in entries:
        grid.put("QBBHHBB", *e)
    mid = [centre_of(e[0]) for e in entries] or [(0.0, 0.0)]
    packer = zstandard.ZstdCompressor(level=19)
    a, b = packer.compress(bytes(names.out)), packer.compress(bytes(shapes.out))
    at = HEADER.size + len(a)
    head = HEADER.pack(b"LAYERSA", 0, 1, min(y for _, y in mid), min(x for x, _ in mid), max(y for _, y in mid), max(x for x, _ in mid), len(entries), 0, HEADER.size, len(a), at, len(b), at + len(b), at + len(b), len(grid.out))
    fs, inner = located(path)
    with fs.open_output_stream(inner) as f:
        f.write(head + a + b + bytes(grid.out))


class FilteringReader(Reader):
    """Reads only the blocks of the cells that a filter names."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if getattr(f, "attribute", None) != ("cell",):
                yield f
                continue
            if isinstance(f, EqualTo):
                self.cells = {f.value} if self.cells is None else self.cells & {f.value}
            elif isinstance(f, In):
                self.cells = set(f.value) if self.cells is None else self.cells & set(f.value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value)
                yield f
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value)
                yield f
            else:
                yield f


def _plain(v: Any) -> Any:
    return [(p["lon"], p["lat"]) for p in v] if isinstance(v, list) else v


def _split_ddl(ddl: str) -> list[str]:
    out, depth = [""], 0
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [x.strip() for x in out]


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    features: int


class Writer(DataSourceWriter):
    """One file a task, blocks by cell; give it rows clustered by cell.

    Options: index (1: an entry and a block a cell; 2: wide entries and merged blocks of ``cells`` cells), version (of buildings), intersections and
    aux (Parquet tables of road intersections with their cell, and of large water bodies), dictionary (bytes of one to train over the file's blocks).
    """

    def __init__(self, options: dict):
        self.layer, self.path, self.prefix = options["layer"], options["path"], options.get("prefix", "LAYERS")
        self.wide, self.cells = options.get("index", "1") == "2", int(options.get("cells", 8))
        self.version = int(options.get("version", 8 if self.layer == "buildings" else 2 if "intersections" in options else 1))
        self.intersections, self.aux, self.dictionary = options.get("intersections"), options.get("aux"), int(options.get("dictionary", 0))

    def _train(self, blocks: list[bytes]) -> bytes:
        """A dictionary of ``dictionary`` bytes over the file's blocks; none where it is not asked for or the blocks are too few for one."""
        if not self.dictionary:
            return b""
        try:
            return zstandard.train_dictionary(self.dictionary, blocks).as_bytes()
        except zstandard.ZstdError:
            return b""

    def _table(self, path: str, **how: Any) -> list[dict]:
        import pyarrow.parquet

        fs, inner = located(path)
        return pyarrow.parquet.read_table(inner, filesystem=fs, **how).to_pylist()

    def write(self, rows: Iterator) -> Written:
        cells: dict[int, list[dict]] = {}
        for r in rows:
            d = r.asDict(recursive=True)
            cells.setdefault(d.pop("cell"), []).append(d)
        if not cells:
            return Written(None, 0)
        meet: dict[int, list[tuple[int, int, int]]] | None = None
        if self.intersections:
            meet = {}
            for x in self._table(self.intersections, filters=[("cell", "in", list(cells))]):
                meet.setdefault(x["cell"], []).append((x["lon_micro"], x["lat_micro"], x["kind"]))
        records, boxes = {}, {}
        for c, v in sorted(cells.items()):
            if len(v) > 65535:
                raise ValueError(f"cell {c} has {len(v)} features; an index entry counts 65535 at most")
            if self.layer == "buildings":
                records[c] = encode_buildings(v, self.version, centre_of(c))
            else:
                records[c] = encode_block(v, self.layer, None if meet is None else meet.get(c, []))
            places = [(round(p["lon"] * 100000), round(p["lat"] * 100000)) for r in v for p in (r.get("coords") or [r]) if p.get("lat") is not None] or [(0, 0)]
            xs, ys = [p[0] for p in places], [p[1] for p in places]
            boxes[c] = (min(xs), min(ys), max(xs), max(ys))
        dictionary = self._train(list(records.values()))
        packer = zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=19)
        index, body = struct.pack("<I", len(cells)), b""
        keys = list(records)
        if self.wide:
            for i in range(0, len(keys), self.cells):
                own = keys[i : i + self.cells]
                x0, y0, x1, y1 = zip(*(boxes[c] for c in own), strict=True)
                block = packer.compress(encode_merged([(c, records[c]) for c in own], ((min(x0) + max(x1)) // 2, (min(y0) + max(y1)) // 2)))
                for place, c in enumerate(own):
                    index += encode_entry(c, boxes[c], len(body), len(block), len(cells[c]), place)
                body += block
        else:
            for c in keys:
                block = packer.compress(records[c])
                index += struct.pack("<Q", c) + len(body).to_bytes(6, "little") + len(block).to_bytes(3, "little") + struct.pack("<H", len(cells[c]))
                body += block
        plain = zstandard.ZstdCompressor(level=19)
        aux = plain.compress(encode_bodies(self._table(self.aux))) if self.aux else b""
        at = HEADER.size + len(dictionary)
        start, n = at + len(index), sum(map(len, cells.values()))
        xs0, ys0, xs1, ys1 = zip(*boxes.values(), strict=True)
        head = HEADER.pack(
            f"{self.prefix[:6]:_<6}{LETTERS[self.layer]}".encode(), 0, self.version, min(ys0) / 100000, min(xs0) / 100000, max(ys1) / 100000, max(xs1) / 100000, n, len(cells), HEADER.size, len(dictionary), at, len(index), start, start + len(body), len(aux)
        )
        name = f"{self.path.rstrip('/')}/part-{uuid.uuid4().hex}.layer"
        fs, inner = located(name)
        fs.create_dir(os.path.dirname(inner), recursive=True)
        with fs.open_output_stream(inner + ".tmp") as f:
            f.write(head + dictionary + index + body + aux)
        return Written(name, n)

    def commit(self, messages):
        for m in messages:
            if m is not None and m.path:
                fs, inner = located(m.path)
                fs.move(inner + ".tmp", inner)

    def abort(self, messages):
        for m in messages:
            if m is not None and m.path:
                fs, inner = located(m.path)
                if fs.get_file_info(inner + ".tmp").is_file:
                    fs.delete_file(inner + ".tmp")


class LayerFile(DataSource):
    """Options: path, layer (buildings, roads, business, places, rail, parks, water, or one of SIDE_TABLES), entries (index entries a partition), pushdown, box
    (min_lat,min_lon,max_lat,max_lon: blocks elsewhere are not read), mode (failfast or permissive), errors, centres (a Parquet table of cell, lon, lat for building files whose cells are no squares), and those of ``Writer``."""

    @classmethod
    def name(cls) -> str:
        return "layerfile"

    def schema(self) -> str:
        layer = self.options["layer"]
        if layer in SIDE_TABLES:
            return SIDE_TABLES[layer]
        return ERRORS if self.options.get("errors", "false") == "true" else "cell long, " + LAYOUTS[layer][0]

    def reader(self, schema) -> DataSourceReader:
        if self.options["layer"] in SIDE_TABLES:
            return SideReader(dict(self.options))
        return (FilteringReader if self.options.get("pushdown", "false") == "true" else Reader)(dict(self.options))

    def writer(self, schema, overwrite) -> Writer:
        return Writer(dict(self.options))
