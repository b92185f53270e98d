"""Slippy-map tiles as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LAT = 85.05112878


def tile_x(lon: Column, zoom: int) -> Column:
    return F.least(F.greatest(F.floor((lon + 180.0) / 360.0 * 2**zoom), F.lit(0)), F.lit(2**zoom - 1)).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    r = F.radians(F.least(F.greatest(lat, F.lit(-MAX_LAT)), F.lit(MAX_LAT)))
    return F.least(F.greatest(F.floor((1 - F.ln(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * 2**zoom), F.lit(0)), F.lit(2**zoom - 1)).cast("long")


def tile_bounds(x: Column, y: Column, zoom: int) -> Column:
    """struct<min_lat, min_lon, max_lat, max_lon>."""
    n = float(2**zoom)
    lat = lambda v: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * v / n))))
    return F.struct(lat(y + 1).alias("min_lat"), (x / n * 360.0 - 180.0).alias("min_lon"), lat(y).alias("max_lat"), ((x + 1) / n * 360.0 - 180.0).alias("max_lon"))


def tiles_for_box(min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column, zoom: int) -> Column:
    """array<struct<x,y>> that cover a box."""
    xs = F.sequence(tile_x(min_lon, zoom), tile_x(max_lon, zoom))
    return F.flatten(F.transform(xs, lambda x: F.transform(F.sequence(tile_y(max_lat, zoom), tile_y(min_lat, zoom)), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def local_to_lonlat(px: Column, py: Column, bounds: Column, extent: int = 4096) -> Column:
    """Tile-local integers to degrees, linear in both axes (the latitude only approximately)."""
    lon = bounds["min_lon"] + px / float(extent) * (bounds["max_lon"] - bounds["min_lon"])
    lat = bounds["max_lat"] - py / float(extent) * (bounds["max_lat"] - bounds["min_lat"])
    return F.struct(lon.alias("lon"), lat.alias("lat"))
