"""Integer and text codecs of the layer format as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(n: Column) -> Column:
    n = n.cast("long")
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-u.bitwiseAND(F.lit(1).cast("long")))


def varint_size(n: Column) -> Column:
    """Bytes that a non-negative number takes, seven bits each."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(n)) / 7)).cast("int")


def deltas(values: Column) -> Column:
    """First value, then differences."""
    return F.transform(values, lambda v, i: v - F.when(i > 0, F.get(values, i - 1)).otherwise(0))


def undelta(diffs: Column) -> Column:
    """Running sums; vertices of one feature are few."""
    return F.transform(F.sequence(F.lit(1), F.size(diffs)), lambda i: F.aggregate(F.slice(diffs, F.lit(1), i), F.lit(0).cast("long"), lambda a, v: a + v))


def wall_point(lon: Column, lat: Column, angle: Column, length: Column) -> Column:
    """End of a wall from (lon, lat): angle in 1/256 turn from north, length in 0.2 m."""
    rad, metres = F.radians(angle * 360.0 / 256.0), length * 0.2
    return F.struct((lon + metres * F.sin(rad) / (111320.0 * F.cos(F.radians(lat)))).alias("lon"), (lat + metres * F.cos(rad) / 111320.0).alias("lat"))


def pack_count(n: Column) -> Column:
    """Vertex counts 4 to 18 in a nibble; 15 says that the count follows."""
    return F.when(n.between(4, 18), n - 4).otherwise(F.lit(15))


def decimate(coords: Column, most: int = 255) -> Column:
    """Every k-th vertex, so that at most ``most`` are left."""
    step = F.ceil(F.size(coords) / most).cast("int")
    return F.when(F.size(coords) > most, F.filter(coords, lambda v, i: i % step == 0)).otherwise(coords)


def cell_relative(micro: Column, centre_micro: Column, biased: bool = False) -> Column:
    """Offset from a cell's centre, signed 16 bits, or unsigned with a bias of 32768; clamped."""
    d = F.least(F.greatest(micro - centre_micro, F.lit(-32768)), F.lit(32767))
    return d + 32768 if biased else d


def presence_mask(code: Column) -> Column:
    """Aggregate: bits of the codes that occur."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), code.cast("int")))


def split_list(text: Column) -> Column:
    """';'-joined values, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ";"), lambda v: F.trim(v)), lambda v: v != "")


def format_distance(metres: Column) -> Column:
    return F.when(metres < 1000, F.concat(F.round(metres).cast("int").cast("string"), F.lit(" m"))).otherwise(F.concat(F.format_string("%.1f", metres / 1000), F.lit(" km")))


def format_duration(seconds: Column) -> Column:
    minutes = F.round(seconds / 60).cast("int")
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h "), (minutes % 60).cast("string"), F.lit(" min")))


def parse_latlon(text: Column) -> Column:
    """struct<lat, lon> of 'lat, lon'; null unless both are numbers in range."""
    part = lambda i: F.split(text, "[,\\s]+")[i].try_cast("double")
    lat, lon = part(0), part(1)
    return F.when((F.size(F.split(text, "[,\\s]+")) == 2) & lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def feature_id(source_id: Column) -> Column:
    """A stable positive number for a textual id."""
    return F.xxhash64(source_id).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
