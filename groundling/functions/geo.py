"""Geometry as column expressions: everything here stays in the JVM.

Coordinates are degrees (``lat``, ``lon``) or integer micro-degrees of 1/100000 degree. A
line or ring is an array of struct<lon,lat>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0
COMPAT_METRES_PER_DEGREE = 111_000.0
MICRO = 100_000


def degrees(micro: Column) -> Column:
    return micro / F.lit(float(MICRO))


def micro(deg: Column) -> Column:
    """Half-even rounding, as in the format."""
    return F.rint(deg * F.lit(float(MICRO))).cast("int")


def turned(d: Column) -> Column:
    """A difference of longitudes the short way round; those below half a turn stay as they are."""
    return F.when(F.abs(d) <= 180, d).otherwise(d - F.signum(d) * 360.0)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    return of_halves(lat1, lat2, F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2))


def of_halves(lat1: Column, lat2: Column, half_lat: Column, half_lon: Column) -> Column:
    """Great-circle metres by the sines of half the differences. Squares are products: the JVM's strict power takes many times as long."""
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * (half_lon * half_lon)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def tenths(d: Column) -> Column:
    """A distance to one decimal, halves up. F.round goes through text and takes longer than the distance itself."""
    whole = F.floor(d * 10.0)
    return (whole + F.when(d * 10.0 - whole >= 0.5, 1).otherwise(0)) / F.lit(10.0)


def metres_per_lon(lat: Column) -> Column:
    return F.lit(METRES_PER_DEGREE) * F.greatest(F.cos(F.radians(lat)), F.lit(0.001))


def to_segment(lat: Column, lon: Column, a: Column, b: Column, mlat: Column | None = None, mlon: Column | None = None) -> Column:
    """struct<d, t, lon, lat>: planar metres to the segment a-b scaled at the point, where along it, and the snapped place."""
    mlat = F.lit(METRES_PER_DEGREE) if mlat is None else mlat
    mlon = metres_per_lon(lat) if mlon is None else mlon
    ax, ay = (a["lon"] - lon) * mlon, (a["lat"] - lat) * mlat
    dx, dy = (b["lon"] - a["lon"]) * mlon, (b["lat"] - a["lat"]) * mlat
    long2 = dx * dx + dy * dy
    t = F.when(long2 < 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / long2)))
    x, y = ax + t * dx, ay + t * dy
    return F.struct(F.sqrt(x * x + y * y).alias("d"), t.alias("t"), (a["lon"] + t * (b["lon"] - a["lon"])).alias("lon"), (a["lat"] + t * (b["lat"] - a["lat"])).alias("lat"))


def segments(coords: Column, closed: bool = False) -> Column:
    """array<struct<i,a,b>> of neighbouring vertices; a ring is closed if its ends differ or not."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(coords) - 2), lambda i: F.struct(i.alias("i"), F.get(coords, i).alias("a"), F.get(coords, i + 1).alias("b")))
    open_ = F.when(F.size(coords) >= 2, pairs).otherwise(F.slice(pairs, 1, 0))
    if not closed:
        return open_
    last = F.struct((F.size(coords) - 1).alias("i"), F.element_at(coords, -1).alias("a"), F.element_at(coords, 1).alias("b"))
    return F.concat(open_, F.array(last))


def to_line(lat: Column, lon: Column, coords: Column, closed: bool = False) -> Column:
    """struct<d, i, t, lon, lat> of the nearest segment, the first of equals; null for fewer than two vertices.

    One step of values an array, so that each is computed once a segment and not again wherever it is used.
    """

    def offsets(s: Column) -> Column:
        a, b, mlon = s["a"], s["b"], metres_per_lon(lat)
        wx, wy = turned(b["lon"] - a["lon"]), b["lat"] - a["lat"]
        return F.struct(
            s["i"].alias("i"), a.alias("a"), wx.alias("wx"), wy.alias("wy"), (turned(a["lon"] - lon) * mlon).alias("ax"), ((a["lat"] - lat) * METRES_PER_DEGREE).alias("ay"), (wx * mlon).alias("dx"), (wy * METRES_PER_DEGREE).alias("dy"),
        )

    def along(s: Column) -> Column:
        long2 = s["dx"] * s["dx"] + s["dy"] * s["dy"]
        t = F.when(long2 < 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(s["ax"] * s["dx"] + s["ay"] * s["dy"]) / long2)))
        return F.struct(s.alias("s"), t.alias("t"))

    def place(p: Column) -> Column:
        s, t = p["s"], p["t"]
        x, y = s["ax"] + t * s["dx"], s["ay"] + t * s["dy"]
        return F.struct(F.sqrt(x * x + y * y).alias("d"), s["i"].alias("i"), t.alias("t"), (s["a"]["lon"] + t * s["wx"]).alias("lon"), (s["a"]["lat"] + t * s["wy"]).alias("lat"))

    return F.array_min(F.transform(F.transform(F.transform(segments(coords, closed), offsets), along), place))


def to_ring_compat(lat: Column, lon: Column, coords: Column) -> Column:
    """Metres to a ring's boundary measured in plain degrees, without the cosine."""

    def offsets(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return F.struct((a["lon"] - lon).alias("x"), (a["lat"] - lat).alias("y"), (b["lon"] - a["lon"]).alias("dx"), (b["lat"] - a["lat"]).alias("dy"))

    def along(s: Column) -> Column:
        long2 = s["dx"] * s["dx"] + s["dy"] * s["dy"]
        t = F.when(long2 < 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(s["x"] * s["dx"] + s["y"] * s["dy"]) / long2)))
        return F.struct(s.alias("s"), t.alias("t"))

    def square(p: Column) -> Column:
        s, t = p["s"], p["t"]
        return F.struct((s["x"] + t * s["dx"]).alias("x"), (s["y"] + t * s["dy"]).alias("y"))

    places = F.transform(F.transform(F.transform(segments(coords, True), offsets), along), square)
    return F.array_min(F.transform(places, lambda p: F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]))) * COMPAT_METRES_PER_DEGREE


def contains(lat: Column, lon: Column, coords: Column) -> Column:
    """Even-odd rule over the ring's edges."""

    def crosses(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"])

    return F.size(F.filter(segments(coords, True), crosses)) % 2 == 1


def centroid(coords: Column) -> Column:
    """Unweighted mean of the vertices, a closing one included."""
    total = lambda c: F.aggregate(coords, F.lit(0.0), lambda acc, v: acc + v[c]) / F.size(coords)
    return F.struct(total("lon").alias("lon"), total("lat").alias("lat"))


def bounds(coords: Column) -> Column:
    """struct<min_lat, min_lon, max_lat, max_lon>."""
    lat, lon = F.transform(coords, lambda v: v["lat"]), F.transform(coords, lambda v: v["lon"])
    return F.struct(F.array_min(lat).alias("min_lat"), F.array_min(lon).alias("min_lon"), F.array_max(lat).alias("max_lat"), F.array_max(lon).alias("max_lon"))


def overlaps(b: Column, min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> Column:
    return (b["min_lat"] <= max_lat) & (b["max_lat"] >= min_lat) & (b["min_lon"] <= max_lon) & (b["max_lon"] >= min_lon)


def reaches(b: Column, lat: Column, lon: Column, radius_m: float | Column) -> Column:
    """Whether a box, widened by the radius, holds the point: cheap, and true for every box within the radius."""
    dlat = radius_m * 1.01 / METRES_PER_DEGREE
    dlon = F.lit(radius_m) * 1.01 / metres_per_lon(F.least(F.abs(lat) + dlat, F.lit(89.9)))
    ways = [(lon + t >= b["min_lon"] - dlon) & (lon + t <= b["max_lon"] + dlon) for t in (0, 360, -360)]
    return (lat >= b["min_lat"] - dlat) & (lat <= b["max_lat"] + dlat) & (ways[0] | ways[1] | ways[2])


def side_of(lat: Column, lon: Column, a: Column, b: Column) -> Column:
    """'left', 'right' or 'on' of the directed segment a-b."""
    return side_along(lat, lon, a, b["lon"] - a["lon"], b["lat"] - a["lat"])


def side_along(lat: Column, lon: Column, a: Column, wx: Column, wy: Column) -> Column:
    """'left', 'right' or 'on' of the way (wx, wy) in degrees from a."""
    cross = wx * (lat - a["lat"]) - wy * (lon - a["lon"])
    return F.when(cross > 0, "left").when(cross < 0, "right").otherwise("on")
