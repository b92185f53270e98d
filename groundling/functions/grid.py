"""Square cells in integer micro-degrees: the key that turns distance questions into equi-joins.

Cells come in four sizes, each ten times the one before, so that a feature of any extent has a bounded number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geo import METRES_PER_DEGREE, MICRO

STEP = 2000
WRAP = 1 << 24
OFFSET = 1 << 23
AROUND = 360 * MICRO // STEP
#: Cell sizes by level, in cells of the smallest; each divides the way round.
SIZES = (1, 10, 100, 1000)
LEVEL = 1 << 48
#: Cells a side that a feature has at its level.
MOST_CELLS = 8


def cell_y(lat_micro: Column) -> Column:
    return F.floor(lat_micro / F.lit(float(STEP))).cast("long")


def cell_x(lon_micro: Column) -> Column:
    return F.floor(lon_micro / F.lit(float(STEP))).cast("long")


def cell_id(cy: Column, cx: Column, level: int = 0) -> Column:
    """One number; columns beyond the date line come round to the other side."""
    around = AROUND // SIZES[level]
    wrapped = F.pmod(cx + around // 2, F.lit(around)) - around // 2
    return (cy + OFFSET) * WRAP + wrapped + OFFSET + level * LEVEL


def cell(lat_micro: Column, lon_micro: Column) -> Column:
    return cell_id(cell_y(lat_micro), cell_x(lon_micro))


def centre(cell_: Column) -> Column:
    cy, cx = F.shiftright(cell_, 24) - OFFSET, cell_ % WRAP - OFFSET
    return F.struct(((cx + 0.5) * STEP / MICRO).alias("lon"), ((cy + 0.5) * STEP / MICRO).alias("lat"))


def boundary(cell_: Column) -> Column:
    """Closed ring of a cell's corners, as array<struct<lon,lat>>."""
    cy, cx = F.shiftright(cell_, 24) - OFFSET, cell_ % WRAP - OFFSET
    corner = lambda dy, dx: F.struct(((cx + dx) * STEP / MICRO).alias("lon"), ((cy + dy) * STEP / MICRO).alias("lat"))
    return F.array(*[corner(dy, dx) for dy, dx in ((0, 0), (0, 1), (1, 1), (1, 0), (0, 0))])


def overlay_width(zoom: Column) -> Column:
    """Cells to show on each side of a map's centre: fewer as it is nearer, from 6 to 14."""
    return F.least(F.greatest(F.lit(6), F.floor(36 - zoom * 2.5 + 0.5)), F.lit(14)).cast("int")


def overlay(views: DataFrame) -> DataFrame:
    """(view, cell, ring) of the cells to draw for maps (view, lat, lon, zoom), and min_lat .. max_lon: the box of them all."""
    y, x = (F.floor(F.round(F.col(c) * MICRO, 3) / STEP).cast("long") for c in ("lat", "lon"))  # rounded, as in cover(): a place on a cell's edge stays there
    k = overlay_width(F.col("zoom"))
    box = [((c + d) * (STEP / MICRO)).alias(n) for c, d, n in ((y, -k, "min_lat"), (x, -k, "min_lon"), (y, k + 1, "max_lat"), (x, k + 1, "max_lon"))]
    cells = views.select("view", *box, F.explode(_box(y - k, y + k, x - k, x + k)).alias("cell"))
    return cells.withColumn("ring", boundary(F.col("cell")))


def _box(y0: Column, y1: Column, x0: Column, x1: Column, level: int = 0) -> Column:
    return F.flatten(F.transform(F.sequence(y0, y1), lambda y: F.transform(F.sequence(x0, x1), lambda x: cell_id(y, x, level))))


def disk(lat_micro: Column, lon_micro: Column, radius_m: float, levels: tuple[int, ...] = (0,)) -> Column:
    """Cells of each level that a circle can touch: as wide as the latitude asks for, the whole way round near the poles."""
    high = radius_m * 1.01 / METRES_PER_DEGREE * MICRO + 1
    far = F.least(F.abs(lat_micro) + high, F.lit(89.9 * MICRO))  # of its latitudes the one whose columns are narrowest
    wide = F.lit(high) / F.cos(F.radians(far / MICRO))
    out = []
    for level in levels:
        step, around = float(STEP * SIZES[level]), AROUND // SIZES[level]
        down = lambda c: F.floor(c / F.lit(step)).cast("long")  # noqa: B023, E731
        x0, x1 = down(lon_micro - wide), down(lon_micro + wide)
        out.append(_box(down(lat_micro - high), down(lat_micro + high), x0, F.least(x1, x0 + (around - 1)), level))
    return F.concat(*out) if len(out) > 1 else out[0]


def here(lat_micro: Column, lon_micro: Column) -> Column:
    """A point's cell of each level."""
    return F.array(*[cell_id(F.floor(lat_micro / F.lit(float(STEP * n))).cast("long"), F.floor(lon_micro / F.lit(float(STEP * n))).cast("long"), i) for i, n in enumerate(SIZES)])


def cover(bounds: Column) -> Column:
    """Cells that a bounding box in degrees touches, of the smallest size that makes them few."""
    micro = {n: F.round(bounds[n] * MICRO, 3) for n in ("min_lat", "max_lat", "min_lon", "max_lon")}
    extent = F.greatest(micro["max_lat"] - micro["min_lat"], micro["max_lon"] - micro["min_lon"])
    out = None
    for level, n in enumerate(SIZES):
        low = lambda c: F.floor(micro[c] / F.lit(float(STEP * n))).cast("long")  # noqa: B023, E731
        cells = _box(low("min_lat"), low("max_lat"), low("min_lon"), low("max_lon"), level)
        fits = extent <= MOST_CELLS * STEP * n
        out = F.when(fits, cells) if out is None else out.when(fits, cells) if level + 1 < len(SIZES) else out.otherwise(cells)
    return out


#: Cell sizes of ``meet``, in micro-degrees; each divides the way round. A shape is in at most FEW + 1 cells a side, and in none smaller than LEAST.
LADDER = (125, 500, 2000, 8000, 40_000, 200_000, 1_000_000, 4_000_000)
FEW, LEAST = 4, 1


def _reaching(radius_m: float) -> int:
    """The level of the smallest cells as wide as the radius."""
    return next((i for i, size in enumerate(LADDER) if size / MICRO * METRES_PER_DEGREE * 0.99 >= radius_m), len(LADDER) - 1)


def _cells(low: list, high: list, level: Column, around: Column, above: bool, first: Column) -> Column:
    """array<struct<_cell, _dy, _dx>> of a box of cells (y, x): how far each is from the box's first; where ``first`` is not, no column counts as the first."""
    base = (level * 2 + int(above)) * LEVEL
    one = lambda y, x: F.struct((base + (y + OFFSET) * WRAP + F.pmod(x, around)).alias("_cell"), (y - low[0]).alias("_dy"), F.when(first, x - low[1]).otherwise(1).alias("_dx"))
    return F.flatten(F.transform(F.sequence(low[0], high[0]), lambda y: F.transform(F.sequence(low[1], high[1]), lambda x: one(y, x))))


def meet(points: DataFrame, features: DataFrame, radius_m: float, box: Column | None = None, width_m: float | None = None, parts: int | None = None) -> DataFrame:
    """Every pair of a point and a feature that can be within the radius, or within the point's own ``_reach`` (metres, at most the radius)
    where there is one, once, with the ``_cell`` by which it was found.

    Features are points (lat_micro, lon_micro; renamed f_lat_micro, f_lon_micro) or have a ``box`` in degrees. Cells are about as wide as the search, so a pair is
    looked at only if it is near. A shape has the smallest cells of which it needs few; a point asks in cells as wide as its reach, where smaller
    shapes are listed too (``above``), and in all larger ones. Of the cells that a pair shares the first counts. Exploded points can be
    many times their table, so they are never broadcast on its size. ``width_m`` asks for other cells than those as wide as the radius, and ``parts`` for that
    many tasks: a search's work is its pairs, so a few megabytes of dense points that adaptive execution puts into one task can take it hours.
    """
    top = _reaching(radius_m if width_m is None else width_m)
    low, last = (0, top) if box is None else (LEAST, len(LADDER) - 1)
    varies = "_reach" in points.columns
    low, top = (low, max(low, top)) if varies else (max(low, top),) * 2
    last = max(last, top)
    reach = F.col("_reach") if varies else F.lit(float(radius_m))
    base = F.lit(top)
    for level in range(top - 1, low - 1, -1):
        base = F.when(reach <= LADDER[level] / MICRO * METRES_PER_DEGREE * 0.99, level).otherwise(base)
    points = points.withColumns({"_base": base, "_high": reach * 1.01 / METRES_PER_DEGREE * MICRO + 1})
    points = points.withColumn("_wide", F.col("_high") / F.cos(F.radians(F.least(F.abs(F.col("lat_micro")) + F.col("_high"), F.lit(89.9 * MICRO)) / MICRO)))
    asked, none = [], F.expr("CAST(array() AS array<struct<_cell: bigint, _dy: bigint, _dx: bigint>>)")
    for level in range(low, last + 1):
        around = 360 * MICRO // LADDER[level]
        least, most = ([F.floor((F.col(c) + sign * F.col(w)) / float(LADDER[level])).cast("long") for c, w in (("lat_micro", "_high"), ("lon_micro", "_wide"))] for sign in (-1, 1))
        part = most[1] - least[1] < around - FEW - 2  # else the whole way round, once
        cells = lambda above: _cells(least, [most[0], F.when(part, most[1]).otherwise(least[1] + around - 1)], F.lit(level).cast("long"), F.lit(around), above, part)  # noqa: B023, E731
        if level == low or box is not None:
            asked.append(F.when(F.col("_base") <= level, cells(False)).otherwise(none))
        if low < level <= top:
            asked.append(F.when(F.col("_base") == level, cells(True)).otherwise(none))
    left = points.withColumn("_c", F.explode(F.concat(*asked))).select("*", "_c._cell", F.col("_c._dy").alias("_py"), F.col("_c._dx").alias("_px")).drop("_c", "_base", "_high", "_wide")
    if box is None:
        key = lambda level: (2 * level + (level > low)) * LEVEL + (F.floor(F.col("lat_micro") / float(LADDER[level])) + OFFSET) * WRAP + F.pmod(F.floor(F.col("lon_micro") / float(LADDER[level])), F.lit(360 * MICRO // LADDER[level]))
        right = features.withColumn("_cell", F.explode(F.array(*[key(i).cast("long") for i in range(low, top + 1)])))
        left, right = left.drop("_py", "_px"), right.withColumnsRenamed({"lat_micro": "f_lat_micro", "lon_micro": "f_lon_micro"})
        if parts is not None:
            left, right = left.repartition(parts, "_cell"), right.repartition(parts, "_cell")
        return left.hint("merge").join(right, "_cell")
    extent = F.greatest(box["max_lat"] - box["min_lat"], box["max_lon"] - box["min_lon"]) * MICRO
    own = F.lit(last)
    for level in range(last - 1, low - 1, -1):
        own = F.when(extent <= FEW * LADDER[level], level).otherwise(own)
    features = features.withColumn("_own", own.cast("long"))  # each step in columns of its own, so that it is computed once
    features = features.withColumn("_size", F.element_at(F.array(*[F.lit(float(v)) for v in LADDER]), (F.col("_own") + 1).cast("int")))

    def cells(level: Column, size: Column, above: bool) -> Column:
        least, most = ([F.floor(box[f"{side}_{c}"] * MICRO / size).cast("long") for c in ("lat", "lon")] for side in ("min", "max"))
        return _cells(least, most, level, (F.lit(360 * MICRO) / size).cast("long"), above, F.lit(True))

    listed = [cells(F.col("_own"), F.col("_size"), False)]
    for level in range(low + 1, top + 1):
        listed.append(F.when(F.col("_own") < level, cells(F.lit(level).cast("long"), F.lit(float(LADDER[level])), True)).otherwise(none))
    right = features.withColumn("_c", F.explode(F.concat(*listed))).select("*", "_c._cell", "_c._dy", "_c._dx").drop("_c", "_own", "_size")
    return left.hint("merge").join(right, "_cell").where("least(_py, _dy) = 0 AND least(_px, _dx) = 0").drop("_py", "_px", "_dy", "_dx")


def near(points: DataFrame, features: DataFrame, radius_m: float, cells: Column | None = None) -> DataFrame:
    """Pairs of a point and a feature that share a cell of the point's disk, by an equi-join.

    ``points`` has lat_micro, lon_micro; features the same, or ``cells`` (see ``cover``) gives every cell that a feature's
    extent touches. A pair can come more than once when a feature has several cells. The join's key is hashed, so
    dense cells are split by adaptive execution and neither side is sent whole to all executors unless it is small.
    """
    levels = (0,) if cells is None else tuple(range(len(SIZES)))
    left = points.withColumn("_cell", F.explode(disk(F.col("lat_micro"), F.col("lon_micro"), radius_m, levels)))
    if cells is None:
        right = features.withColumn("_cell", cell(F.col("lat_micro"), F.col("lon_micro"))).withColumnsRenamed({"lat_micro": "f_lat_micro", "lon_micro": "f_lon_micro"})
    else:
        right = features.withColumn("_cell", F.explode(cells))
    return left.join(right, "_cell").drop("_cell")
