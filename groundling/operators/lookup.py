"""Cell and box scans, and distance lookups of points, over point layers and shapes.

Every lookup takes DataFrames of query points (qid, lat_micro, lon_micro) and returns rows by qid; a
single point is a table of one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, grid
from .cut import cut

#: Road classes of each travel profile; null: all classes.
DRIVING = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "tertiary", "tertiary_link")
PROFILES: dict[str, tuple[str, ...] | None] = {"driving": DRIVING, "walking": None, "cycling": (*DRIVING, "cycleway")}
#: Road classes that a route of each profile may use.
ROUTABLE = {
    "driving": ("motorway", "trunk", "primary", "secondary", "tertiary", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link", "unclassified", "residential", "living_street", "service", "road"),
    "walking": ("footway", "pedestrian", "path", "steps", "sidewalk", "crossing", "residential", "living_street", "service", "track"),
    "cycling": ("cycleway", "path", "residential", "living_street", "service", "track", "unclassified"),
}


def of_profile(roads: DataFrame, profile: str | None) -> DataFrame:
    """Roads of the classes of a profile; null or an unknown profile: all."""
    classes = PROFILES.get(profile) if profile else None
    return roads if classes is None else roads.where(F.col("road_class").isin(*classes))


def in_cell(features: DataFrame, cell: int) -> DataFrame:
    """Features keyed by one cell."""
    return features.where(F.col("cell") == cell)


def points_in_box(features: DataFrame, min_lat: float, min_lon: float, max_lat: float, max_lon: float, limit: int | None = 1000, lat: Column | None = None, lon: Column | None = None) -> DataFrame:
    """Features whose point lies in the box; with a limit, the first by id."""
    lat = geo.degrees(F.col("lat_micro")) if lat is None else lat
    lon = geo.degrees(F.col("lon_micro")) if lon is None else lon
    hit = features.where(lat.between(min_lat, max_lat) & lon.between(min_lon, max_lon))
    return hit if limit is None else hit.orderBy("osm_id").limit(limit)


def shapes_in_box(features: DataFrame, min_lat: float, min_lon: float, max_lat: float, max_lon: float, limit: int | None = 1000) -> DataFrame:
    """Features whose extent overlaps the box, one row an osm_id (the first piece)."""
    hit = features.where(geo.overlaps(geo.bounds(F.col("coords")), min_lat, min_lon, max_lat, max_lon))
    first = "piece_id" if "piece_id" in features.columns else "osm_id"
    hit = hit.groupBy("osm_id").agg(F.min_by(F.struct("*"), F.col(first)).alias("r")).select("r.*")
    return hit if limit is None else hit.orderBy("osm_id").limit(limit)


def cell_stats(features: DataFrame) -> DataFrame:
    """Count and extent of each cell: what an index entry holds."""
    keyed = features.withColumn("cell", grid.cell(F.col("lat_micro"), F.col("lon_micro")))
    return keyed.groupBy("cell").agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("lat_micro", "lon_micro") for n, f in (("min", F.min), ("max", F.max))])


def top_n(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of each qid, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= n)


#: Of how many features one bounds a search for the nearest, and how often that is done.
SHARE, BOUNDS = 16, 2


def bounded(points: DataFrame, features: DataFrame, key: str, n: int, radius_m: float, search, ties: bool = False) -> DataFrame:
    """Points with ``_reach``: metres within which n features are known to be, at most the radius.

    ``search`` (points, features) gives the n nearest (qid, distance). The n-th of a share of the features is no nearer than the n-th of all,
    so what lies beyond it need not be looked at; a share of the share bounds the search in it. Without n of them the reach stays the radius.
    With ``ties`` (n is 1) there is ``_least`` too: the osm_id that is known at distance 0, where there is one, as no greater one can come before it."""
    out = points.withColumn("_reach", F.lit(float(radius_m)))
    least = {"_least": F.when(F.max("distance") == 0, F.min("osm_id"))} if ties else {}
    out = out.withColumns({c: F.lit(None).cast("long") for c in least})
    for i in range(BOUNDS, 0, -1):
        found = search(out, features.where(F.pmod(F.xxhash64(key), F.lit(SHARE**i)) == 0))
        bound = found.groupBy("qid").agg(F.count("*").alias("_n"), F.max("distance").alias("_bound"), *[v.alias(c) for c, v in least.items()]).where(F.col("_n") >= n).select("qid", "_bound", *least)
        out = points.join(bound, "qid", "left").withColumn("_reach", F.least(F.coalesce(F.col("_bound") * (1 + 1e-9) + 1e-6, F.lit(float(radius_m))), F.lit(float(radius_m)))).drop("_bound")
    return out


def nearby(points: DataFrame, features: DataFrame, radius_m: float = 500.0, limit: int | None = 10, prefix: str | None = None, exclude_closed: bool = False, dense: bool = False) -> DataFrame:
    """Point features within a radius of each query point, nearest first. ``dense`` says that without a limit very many are, so that their number is the work."""
    if prefix is not None:
        features = features.where(F.col("category").startswith(prefix))
    if exclude_closed:
        features = features.where(~F.col("operating_status").eqNullSafe("closed"))
    within = lambda p, f: _metres(grid.meet(p, f, radius_m).drop("_cell")).where(F.col("distance") <= _reach(p, radius_m)).drop("_reach")
    if limit is None:
        return _dense(points, features, radius_m) if dense else within(points, features)
    first = lambda p, f: top_n(within(p, f), limit, F.col("distance"), F.col("osm_id"))
    return first(bounded(points, features, "osm_id", limit, radius_m, first), features)


def _metres(pairs: DataFrame) -> DataFrame:
    """Pairs of points with their ``distance``, computed once a pair: a filter on it would be moved below a plain column and compute it there once more, but stays above an array's row."""
    lat, lon, f_lat, f_lon = (geo.degrees(F.col(c)) for c in ("lat_micro", "lon_micro", "f_lat_micro", "f_lon_micro"))
    rows = pairs.withColumns({"_half_lat": F.sin(F.radians(f_lat - lat) / 2), "_half_lon": F.sin(F.radians(f_lon - lon) / 2)})
    distance = geo.of_halves(lat, f_lat, F.col("_half_lat"), F.col("_half_lon"))
    return rows.select("*", F.inline(F.array(F.struct(distance.alias("distance"))))).drop("_half_lat", "_half_lon")


#: Slack of a chord (radius 1) about a search's radius: far above what rounding does to it, 64 micrometres on the ground.
CHORD_SLACK = 1e-11
#: Metres up to which the series of sine and arc sine below are as exact as doubles are.
SMALL_M = 100_000.0


def _dense(points: DataFrame, features: DataFrame, radius_m: float) -> DataFrame:
    """All pairs of points within the radius, at little cost a pair: everything that belongs to one point is computed before they meet, the straight chord decides which
    are within, and only those have their distance computed; at the radius itself, within the slack, the distance decides. Cells half as wide are dealt evenly."""

    def known(df: DataFrame, p: str) -> DataFrame:
        df = df.withColumns({f"_{p}lat": geo.degrees(F.col("lat_micro")), f"_{p}lon": geo.degrees(F.col("lon_micro"))})
        df = df.withColumns({f"_{p}cos": F.cos(F.radians(f"_{p}lat")), f"_{p}z": F.sin(F.radians(f"_{p}lat"))})
        return df.withColumns({f"_{p}x": F.col(f"_{p}cos") * F.cos(F.radians(f"_{p}lon")), f"_{p}y": F.col(f"_{p}cos") * F.sin(F.radians(f"_{p}lon"))})

    parts = 4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few cells can hold most pairs; with more parts the last task is short
    rows = grid.meet(known(points, ""), known(features, "f_"), radius_m, width_m=radius_m / 2, parts=parts).drop("_cell")
    half_lat, half_lon = F.expr("radians(_f_lat - _lat) / 2"), F.expr("sin(radians(_f_lon - _lon) / 2)")
    share = lambda y, x: F.least(F.lit(1.0), y * y + F.expr("_cos * _f_cos") * (x * x))
    metres = F.lit(2 * geo.EARTH_M) * F.asin(F.sqrt(share(F.sin(half_lat), half_lon)))
    chord2 = F.expr("(_f_x - _x) * (_f_x - _x) + (_f_y - _y) * (_f_y - _y) + (_f_z - _z) * (_f_z - _z)")
    chord = 2 * math.sin(min(radius_m / (2 * geo.EARTH_M), math.pi / 2))
    surely, at_all = max(chord - CHORD_SLACK, 0.0) ** 2, (chord + CHORD_SLACK) ** 2
    rows = rows.where((chord2 < surely) | ((chord2 <= at_all) & (metres <= radius_m)))
    small = radius_m <= SMALL_M
    rows = rows.withColumns({"_half_lat": half_lat, "_half_lon": half_lon})  # each step in columns of its own, so that it is computed once
    sine = "_half_lat * (1D - _half_lat * _half_lat * (1D / 6 - _half_lat * _half_lat * (1D / 120 - _half_lat * _half_lat * (1D / 5040))))"
    rows = rows.withColumn("_half_lat", F.expr(sine) if small else F.sin("_half_lat")).withColumn("_share", share(F.col("_half_lat"), F.col("_half_lon")))
    arc = F.expr("sqrt(_share) * (1D + _share * (1D / 6 + _share * (3D / 40 + _share * (15D / 336))))") if small else F.asin(F.sqrt("_share"))
    return rows.withColumn("distance", F.lit(2 * geo.EARTH_M) * arc).drop("_half_lat", "_half_lon", "_share", *[f"_{p}{c}" for p in ("", "f_") for c in ("lat", "lon", "cos", "x", "y", "z")])


def _reach(points: DataFrame, radius_m: float) -> Column:
    return F.col("_reach") if "_reach" in points.columns else F.lit(float(radius_m))


def _boxed(points: DataFrame, shapes: DataFrame, radius_m: float) -> DataFrame:
    """Pairs whose shape's extent (_box) comes within the radius, once each: the cell join, then a test of the extent's four numbers. How far a point's
    reach goes in degrees is computed once a point: code too long for the JVM's compiler runs many times slower."""
    lat, lon, most = geo.degrees(F.col("lat_micro")), geo.degrees(F.col("lon_micro")), _reach(points, radius_m)
    dlat = most * 1.01 / geo.METRES_PER_DEGREE
    dlon = most * 1.01 / geo.metres_per_lon(F.least(F.abs(lat) + dlat, F.lit(89.9)))
    box = points.withColumns({"_south": lat - dlat, "_north": lat + dlat, "_west": lon - dlon, "_east": lon + dlon})
    rows = grid.meet(box, shapes, radius_m, F.col("_box")).where("_north >= _box.min_lat AND _south <= _box.max_lat")
    way = lambda t: (F.col("_east") + t >= F.col("_box.min_lon")) & (F.col("_west") + t <= F.col("_box.max_lon"))
    return rows.where(way(0) | way(360) | way(-360)).drop("_box", "_south", "_north", "_west", "_east")


def _reachable(points: DataFrame, shapes: DataFrame, radius_m: float) -> DataFrame:
    """Pairs whose shape's extent comes within the radius, once each."""
    return _boxed(points, shapes.withColumn("_box", geo.bounds(F.col("coords"))), radius_m)


def _distances(points: DataFrame, shapes: DataFrame, radius_m: float, closed: bool = False, ends: bool = False) -> DataFrame:
    """Pairs of a point and a segment of a shape whose extent comes within the point's reach, with ``_near`` (see ``geo.to_line``) and no ``coords``; what is beyond is
    to be filtered once it is aggregated. With ``ends`` its last field is the segment itself, see ``nearest_roads``. Segments are looked at as rows, in compiled arithmetic, where functions over arrays are interpreted."""
    lat, lon = geo.degrees(F.col("lat_micro")), geo.degrees(F.col("lon_micro"))
    known = points.withColumns({"_mlon": geo.metres_per_lon(lat), "_within": _reach(points, radius_m) + 0.001})
    parts = F.transform(geo.segments(F.col("coords"), closed), lambda s: F.struct(s["i"].alias("i"), s["a"]["lon"].alias("lon"), s["a"]["lat"].alias("lat"), s["b"]["lon"].alias("to_lon"), s["b"]["lat"].alias("to_lat")))  # as they are: the same numbers again compress well
    boxed = shapes.withColumns({"_box": geo.bounds(F.col("coords")), "_parts": F.when(F.size("coords") >= 2, parts)}).drop("coords")  # no filter: it would compute coords once more
    rows = _boxed(known, boxed, radius_m).select("*", *[F.size("_parts").alias("_n")] * ends, F.inline("_parts").alias("_i", "_lon", "_lat", "_to_lon", "_to_lat")).drop("_parts")
    rows = rows.withColumns({"_wx": geo.turned(F.col("_to_lon") - F.col("_lon")), "_wy": F.col("_to_lat") - F.col("_lat")}).drop("_to_lon", "_to_lat")
    rows = rows.withColumns({"_ax": geo.turned(F.col("_lon") - lon) * F.col("_mlon"), "_ay": (F.col("_lat") - lat) * geo.METRES_PER_DEGREE, "_dx": F.col("_wx") * F.col("_mlon"), "_dy": F.col("_wy") * geo.METRES_PER_DEGREE})
    rows = rows.where("least(_ay, _ay + _dy) <= _within AND greatest(_ay, _ay + _dy) >= -_within").where("least(_ax, _ax + _dx) <= _within AND greatest(_ax, _ax + _dx) >= -_within")
    rows = rows.withColumn("_long2", F.expr("_dx * _dx + _dy * _dy"))
    rows = rows.withColumn("_t", F.when(F.col("_long2") < 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.expr("-(_ax * _dx + _ay * _dy) / _long2")))))
    rows = rows.withColumns({"_x": F.expr("_ax + _t * _dx"), "_y": F.expr("_ay + _t * _dy")})
    own = [F.struct(*[F.col(f"_{c}").alias(c) for c in ("lon", "lat", "wx", "wy", "n")]).alias("of")] * ends
    near = F.struct(F.expr("sqrt(_x * _x + _y * _y)").alias("d"), F.col("_i").alias("i"), F.col("_t").alias("t"), F.expr("_lon + _t * _wx").alias("lon"), F.expr("_lat + _t * _wy").alias("lat"), *own)
    return rows.withColumn("_near", near).drop("_n", "_i", "_lon", "_lat", "_wx", "_wy", "_ax", "_ay", "_dx", "_dy", "_long2", "_t", "_x", "_y", "_mlon", "_within")


def _nearest(rows: DataFrame, n: int, *columns: str) -> DataFrame:
    """The n nearest features (osm_id) a qid and cell, each once by the least of (distance, columns); cells are where the rows are, so nothing is moved."""
    best = rows.groupBy("_cell", "qid", "osm_id").agg(F.min(F.struct("distance", *columns)).alias("b"), F.first("_most").alias("_most")).where(F.col("b.distance") <= F.col("_most"))
    order = Window.partitionBy("_cell", "qid").orderBy("b.distance", "osm_id")
    return best.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_cell", "_k", "_most")


def nearest_shapes(points: DataFrame, shapes: DataFrame, radius_m: float, area: bool = False) -> DataFrame:
    """(qid, osm_id, distance): the nearest line of each point within the radius, or area, whose inside is at 0."""
    lat, lon = geo.degrees(F.col("lat_micro")), geo.degrees(F.col("lon_micro"))

    def search(p: DataFrame, f: DataFrame) -> DataFrame:
        if area:
            rows = _reachable(p, f, radius_m).where("_least IS NULL OR osm_id <= _least").withColumn("distance", F.when(geo.contains(lat, lon, F.col("coords")), 0.0).otherwise(geo.to_line(lat, lon, F.col("coords"), True)["d"]))
        else:
            rows = _distances(p, f, radius_m).withColumn("distance", F.col("_near.d"))
        best = _nearest(rows.withColumn("_most", _reach(p, radius_m)), 1)
        return best.groupBy("qid").agg(F.min(F.struct("b.distance", "osm_id")).alias("b")).select("qid", "b.osm_id", "b.distance")

    return search(bounded(points, shapes, "osm_id", 1, radius_m, search, area), shapes)


def nearest_roads(points: DataFrame, roads: DataFrame, n: int = 1, radius_m: float = 100.0, profile: str | None = None, ends: bool = False) -> DataFrame:
    """The n nearest roads of each point, a split way once, at its nearest piece. With ``ends`` there is ``of`` too: start (lon, lat) and way (wx, wy) of the nearest segment in degrees,
    and the number n of the line's segments, so that no line has to be read again."""
    roads = of_profile(roads, profile)

    def search(p: DataFrame, f: DataFrame) -> DataFrame:
        rows = _distances(p, f, radius_m, ends=ends).withColumns({"distance": F.col("_near.d"), "near": F.col("_near"), "_most": _reach(p, radius_m)})
        best = _nearest(rows, n, "piece_id", "near", "road_class", "name").groupBy("qid", "osm_id").agg(F.min("b").alias("b"))
        return top_n(best.withColumn("distance", F.col("b.distance")), n, F.col("distance"), F.col("osm_id"))

    best = search(bounded(points, roads, "piece_id", n, radius_m, search), roads)
    return best.select("qid", "osm_id", "distance", "b.piece_id", "b.road_class", "b.name", F.col("b.near.i").alias("segment"), F.col("b.near.t").alias("t"), F.col("b.near.lat").alias("snap_lat"), F.col("b.near.lon").alias("snap_lon"), "rank", *["b.near.of"] * ends)


def containing(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """(qid, osm_id, ...) of every ring that contains each point."""
    boxed = shapes.withColumn("_box", geo.bounds(F.col("coords")))
    rows = grid.meet(points, boxed, 1.0, F.col("_box")).drop("_cell")
    if "_least" in points.columns:
        rows = rows.where("_least IS NULL OR osm_id <= _least")
    lat, lon = geo.degrees(F.col("lat_micro")), geo.degrees(F.col("lon_micro"))
    rows = rows.where(lat.between(F.col("_box.min_lat"), F.col("_box.max_lat")) & lon.between(F.col("_box.min_lon"), F.col("_box.max_lon"))).drop("_box")
    return rows.where(geo.contains(lat, lon, F.col("coords")))


def least_containing(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """(qid, osm_id): the least osm_id whose ring contains each point. The least of a share bounds the search among all, as a greater one is of no use."""
    share = shapes.where(F.pmod(F.xxhash64("osm_id"), F.lit(SHARE)) == 0)
    some = containing(points.select("qid", "lat_micro", "lon_micro"), share).groupBy("qid").agg(F.min("osm_id").alias("_least"))
    return containing(points.select("qid", "lat_micro", "lon_micro").join(some, "qid", "left"), shapes).groupBy("qid").agg(F.min("osm_id").alias("osm_id"))


def building_at(points: DataFrame, buildings: DataFrame, fallback_m: float | None = None) -> DataFrame:
    """One building a point: the containing one with the least id, else the nearest boundary within ``fallback_m``."""
    inside = least_containing(points, buildings).select("qid", "osm_id", F.lit(0.0).alias("distance"), F.lit(True).alias("inside"))
    if fallback_m is None:
        return inside
    rest = points.join(inside.select("qid"), "qid", "left_anti")
    near = _distances(rest, buildings, fallback_m, closed=True).groupBy("qid").agg(F.min(F.struct(F.col("_near.d").alias("d"), "osm_id")).alias("b")).where(F.col("b.d") <= fallback_m)
    return inside.union(near.select("qid", "b.osm_id", "b.d", F.lit(False)))


def buildings_within(points: DataFrame, buildings: DataFrame, radius_m: float) -> DataFrame:
    """(qid, osm_id, distance): buildings that contain the point (0) or whose boundary is within the radius."""
    lat, lon = geo.degrees(F.col("lat_micro")), geo.degrees(F.col("lon_micro"))
    rows = _reachable(points, buildings, radius_m)
    d = F.when(geo.contains(lat, lon, F.col("coords")), 0.0).otherwise(geo.to_line(lat, lon, F.col("coords"), True)["d"])
    return rows.withColumn("distance", d).groupBy("_cell", "qid", "osm_id").agg(F.min("distance").alias("distance")).where(F.col("distance") <= radius_m).drop("_cell")  # a pair comes once: this keeps it from being computed twice


def within_compat(points: DataFrame, rings: DataFrame, radius_m: float) -> DataFrame:
    """(qid, osm_id, distance): rings whose boundary is within the radius in plain degrees, without the cosine."""
    lat, lon = geo.degrees(F.col("lat_micro")), geo.degrees(F.col("lon_micro"))
    side = radius_m * 1.0001 / geo.COMPAT_METRES_PER_DEGREE
    rows = grid.meet(points, rings.withColumn("_box", geo.bounds(F.col("coords"))), radius_m * 1.1, F.col("_box"))
    rows = rows.where(lat.between(F.col("_box.min_lat") - side, F.col("_box.max_lat") + side) & lon.between(F.col("_box.min_lon") - side, F.col("_box.max_lon") + side))
    rows = rows.withColumn("distance", geo.to_ring_compat(lat, lon, F.col("coords")))
    return rows.groupBy("_cell", "qid", "osm_id").agg(F.min("distance").alias("distance")).where(F.col("distance") <= radius_m).drop("_cell")


def nearest_centroid(points: DataFrame, buildings: DataFrame, box_deg: float = 0.003) -> DataFrame:
    """(qid, osm_id): the building whose centroid is nearest in squared degrees, within a box around the point."""
    c = geo.centroid(F.col("coords"))
    mid = buildings.select("osm_id", c["lat"].alias("c_lat"), c["lon"].alias("c_lon"))
    mid = mid.withColumns({"lat_micro": geo.micro(F.col("c_lat")), "lon_micro": geo.micro(F.col("c_lon"))})
    rows = grid.near(points, mid, box_deg * geo.METRES_PER_DEGREE * 1.1)  # at least as wide as the box at any latitude
    dy, dx = F.col("c_lat") - geo.degrees(F.col("lat_micro")), F.col("c_lon") - geo.degrees(F.col("lon_micro"))
    rows = rows.where((F.abs(dy) <= box_deg) & (F.abs(dx) <= box_deg))
    return rows.groupBy("qid").agg(F.min(F.struct((dy * dy + dx * dx).alias("d2"), "osm_id")).alias("b")).select("qid", "b.osm_id", F.sqrt("b.d2").alias("degrees"))


def within_centroid(points: DataFrame, buildings: DataFrame, radius_m: float) -> DataFrame:
    """(qid, osm_id, distance): buildings whose centroid lies within the radius."""
    c = geo.centroid(F.col("coords"))
    mid = buildings.select("osm_id", geo.micro(c["lat"]).alias("lat_micro"), geo.micro(c["lon"]).alias("lon_micro"))
    return nearby(points, mid, radius_m, None).select("qid", "osm_id", "distance")


def within_corridor(features: DataFrame, path: list[tuple[float, float]], buffer_m: float, exact: bool = True) -> DataFrame:
    """Point features within a buffer of a path of (lon, lat): of the path itself, or of its box."""
    lats, lons = [p[1] for p in path], [p[0] for p in path]
    dlat = buffer_m / geo.METRES_PER_DEGREE
    narrowest = max(math.cos(math.radians(min(max(map(abs, lats)) + dlat, 89.9))), 0.001)
    dlon = dlat / (narrowest if exact else 0.76)  # the box alone is defined with one fixed width
    rows = points_in_box(features, min(lats) - dlat, min(lons) - dlon, max(lats) + dlat, max(lons) + dlon, None)
    if not exact:
        return rows
    line = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in path])
    near = geo.to_line(geo.degrees(F.col("lat_micro")), geo.degrees(F.col("lon_micro")), line)
    return rows.withColumn("distance", near["d"]).where(F.col("distance") <= buffer_m)


def admin_at(points: DataFrame, admin: DataFrame) -> DataFrame:
    """Each point with the names of its cell; nulls where no cell is listed."""
    keyed = points.withColumns({"cy": grid.cell_y(F.col("lat_micro")), "cx": grid.cell_x(F.col("lon_micro"))})
    return keyed.join(admin, ["cy", "cx"], "left")


def named_cells(cells: DataFrame, strings: DataFrame) -> DataFrame:
    """(cell, country, state, county, zip, timezone, boundary_flags): cells with an index of each level (country_idx ...) and their
    names from ``strings`` (level, idx, value). An index beyond its table names nothing (empty)."""
    out = cells
    for level in ADMIN:
        table = strings.where(F.col("level") == level).select(F.col("idx").alias(f"{level}_idx"), F.col("value").alias(level))
        out = out.join(table, f"{level}_idx", "left").withColumn(level, F.coalesce(level, F.lit("")))
    return out.select("cell", *ADMIN, "boundary_flags")


def first_matching_box(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """(qid, name): the first of the boxes (ordinal, name, bounds), in order, that holds the point. Boxes are found by cell, so there may be many."""
    lat, lon = geo.degrees(F.col("lat_micro")), geo.degrees(F.col("lon_micro"))
    keyed = boxes.withColumn("_cell", F.explode(grid.cover(F.struct("min_lat", "min_lon", "max_lat", "max_lon"))))
    hit = points.withColumn("_cell", F.explode(grid.here(F.col("lat_micro"), F.col("lon_micro")))).join(keyed, "_cell")
    hit = hit.where(lat.between(F.col("min_lat"), F.col("max_lat")) & lon.between(F.col("min_lon"), F.col("max_lon")))
    return points.select("qid").join(hit.groupBy("qid").agg(F.min_by("name", "ordinal").alias("name")), "qid", "left")


def resolve_references(water: DataFrame, bodies: DataFrame) -> DataFrame:
    """Water features; one that refers to a large body (feature_id, name, and lat_micro and lon_micro or coords) takes its place or line from it, where there is one."""
    shape = [c for c in ("lat_micro", "lon_micro", "coords") if c in water.columns]
    b = bodies.select(F.col("feature_id").alias("ref_feature_id"), F.col("name").alias("body_name"), *[F.col(c).alias(f"_b_{c}") for c in shape])
    out = water.join(b, "ref_feature_id", "left")
    return out.select("osm_id", "geom_type", "water_type", "ref_feature_id", "body_name", *[F.coalesce(f"_b_{c}", c).alias(c) for c in shape])


#: How far a place's name reaches, in metres, and how specific it is.
INFLUENCE = {"city": (15000.0, 5), "town": (5000.0, 4), "village": (2000.0, 3), "hamlet": (500.0, 2), "suburb": (3000.0, 1), "neighborhood": (1000.0, 0)}


def place_of(points: DataFrame, places: DataFrame) -> DataFrame:
    """(qid, osm_id, name, place_type, distance): of the places whose influence reaches the point the most specific, then the nearest."""
    reach = F.create_map(*[F.lit(x) for k, v in INFLUENCE.items() for x in (k, v[0])])
    rank = F.create_map(*[F.lit(x) for k, v in INFLUENCE.items() for x in (k, v[1])])
    widest = max(v[0] for v in INFLUENCE.values())
    hit = nearby(points, places.withColumns({"_reach": reach[F.col("place_type")], "_specific": rank[F.col("place_type")]}), widest, None).where(F.col("distance") <= F.col("_reach"))
    best = hit.groupBy("qid").agg(F.min(F.struct("_specific", "distance", "osm_id", "name", "place_type")).alias("b"))
    return best.select("qid", "b.osm_id", "b.name", "b.place_type", "b.distance")


def _unnamed(roads: DataFrame) -> DataFrame:
    """Roads without class and name, for searches that return neither: they would be sent with every road."""
    return roads.withColumns({c: F.lit(None).cast("string") for c in ("road_class", "name")})


def reverse_geocode(points: DataFrame, roads: DataFrame, ranges: DataFrame, cutoff_m: float = 50.0) -> DataFrame:
    """House number of each point: along the nearest road with address ranges (piece_id, from_no, to_no), odd numbers on the left."""
    near = nearest_roads(points, _unnamed(roads).join(ranges, "piece_id", "left_semi"), 1, cutoff_m, ends=True)
    rows = near.join(points, "qid").join(ranges, "piece_id")
    side = geo.side_along(geo.degrees(F.col("lat_micro")), geo.degrees(F.col("lon_micro")), F.col("of"), F.col("of.wx"), F.col("of.wy"))
    share = (F.col("segment") + F.col("t")) / F.col("of.n")
    base = F.col("from_no") + F.floor(share * (F.col("to_no") - F.col("from_no")) / 2) * 2
    number = F.when((side == "left") == (base % 2 == 1), base).otherwise(base + 1)
    return rows.select("qid", "osm_id", "piece_id", side.alias("side"), number.cast("long").alias("house_number"), "distance")


def nearest_rail(points: DataFrame, lines: DataFrame, stations: DataFrame, radius_m: float) -> DataFrame:
    """(qid, osm_id, kind, distance): the nearest of rail lines (coords) and stations (points) within the radius; a line comes before a station as near."""
    line = nearest_shapes(points, lines, radius_m)
    stop = nearby(points, stations, radius_m, 1).select("qid", "osm_id", "distance")
    both = line.withColumn("kind", F.lit("line")).unionByName(stop.withColumn("kind", F.lit("station")))
    best = both.groupBy("qid").agg(F.min(F.struct("distance", "kind", "osm_id")).alias("b"))
    return best.select("qid", "b.osm_id", "b.kind", "b.distance")


ADMIN = ("country", "state", "county", "zip", "timezone")


def point_report(
    points: DataFrame, buildings: DataFrame, roads: DataFrame, businesses: DataFrame, places: DataFrame, admin: DataFrame, radius_m: float = 300.0, water: DataFrame | None = None, parks: DataFrame | None = None,
    rail: DataFrame | None = None, stations: DataFrame | None = None, ranges: DataFrame | None = None, water_m: float = 100.0, rail_m: float = 3000.0,
) -> DataFrame:
    """One row a point over every layer given: building, nearest road, businesses in the radius, place, administrative names, water within ``water_m``,
    park, rail line or station and house number; each layer is searched on its own and a layer that is not given has no columns. Its few columns are written before they are
    joined: one plan of all searches takes the driver's time and memory, and the files of all of them lie on disk together."""
    found = [
        building_at(points, buildings).select("qid", F.col("osm_id").alias("building_id")),
        nearest_roads(points, _unnamed(roads), 1, radius_m).select("qid", F.col("osm_id").alias("road_id"), F.col("distance").alias("road_distance")),
        nearby(points, businesses, radius_m, None).groupBy("qid").agg(F.count("*").alias("n_businesses"), F.min_by("osm_id", F.struct("distance", "osm_id")).alias("nearest_business")),
        place_of(points, places).select("qid", F.col("name").alias("place")),
        admin_at(points, admin).select("qid", *[c for c in ADMIN if c in admin.columns]),
    ]
    if water is not None:
        found.append(nearest_shapes(points, water, water_m, area=True).select("qid", F.col("osm_id").alias("water_id")))
    if parks is not None:
        found.append(least_containing(points, parks).withColumnRenamed("osm_id", "park_id"))
    if rail is not None and stations is not None:
        found.append(nearest_rail(points, rail, stations, rail_m).select("qid", F.col("osm_id").alias("rail_id"), F.col("kind").alias("rail_kind")))
    if ranges is not None:
        found.append(reverse_geocode(points, roads, ranges).groupBy("qid").agg(F.min("house_number").alias("house_number")))
    out = points.select("qid")
    while found:
        out = out.join(cut(found.pop(0)), "qid", "left")
        points.sparkSession.sparkContext._jvm.System.gc()  # a search's shuffle files and compiled code go when the driver collects its garbage, which it has little cause to
    return out.withColumn("n_businesses", F.coalesce("n_businesses", F.lit(0)))


def admin_exact(points: DataFrame, admin: DataFrame, areas: DataFrame) -> DataFrame:
    """(qid, name): the cell's name, but of cells marked ``boundary`` the area that contains the point, where there is one.

    Only points in marked cells meet the polygons.
    """
    base = admin_at(points, admin)
    hit = containing(base.where("boundary").select("qid", "lat_micro", "lon_micro"), areas)
    inside = hit.groupBy("qid").agg(F.min_by("name", "osm_id").alias("area"))
    return base.join(inside, "qid", "left").select("qid", F.coalesce("area", "state").alias("name"))


def nearest_water(points: DataFrame, bodies: DataFrame, lines: DataFrame, radius_m: float) -> DataFrame:
    """(qid, osm_id, distance): the body that contains the point (0), else the nearest shore or stream within the radius."""
    shore = nearest_shapes(points, bodies, radius_m, area=True)
    bank = nearest_shapes(points, lines, radius_m)
    best = shore.unionByName(bank).groupBy("qid").agg(F.min(F.struct("distance", "osm_id")).alias("b"))
    return best.select("qid", "b.osm_id", "b.distance")
