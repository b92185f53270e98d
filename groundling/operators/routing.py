"""Route estimates, corridors, and shortest paths on a road graph by DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, geo, grid
from .cut import cut as _cut
from .lookup import ROUTABLE, nearby

NODE_SCALE = 50_000


def estimate(pairs: DataFrame, profile: str = "driving") -> DataFrame:
    """Great-circle distance and duration of (route_id, lat1, lon1, lat2, lon2), to a tenth."""
    d = geo.haversine(*(F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")))
    return pairs.withColumns({"distance_m": F.round(d, 1), "duration_s": F.round(d / classify.speed_ms(profile), 1)})


def sample_path(lat1, lon1, lat2, lon2, step_m: float = 100.0):
    """array<struct<lon,lat>> of n + 1 places from end to end, n = max(2, whole steps)."""
    n = F.greatest(F.lit(2), F.floor(geo.haversine(lat1, lon1, lat2, lon2) / step_m).cast("int"))
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((lon1 + (lon2 - lon1) * i / n).alias("lon"), (lat1 + (lat2 - lat1) * i / n).alias("lat")))


#: Fixed values: (metres up to, sampling step in metres, cells each side) by the distance of a route; nearer routes go by rings.
CORRIDORS = ((200_000.0, 3_000.0, 8), (1_000_000.0, 6_000.0, 7), (float("inf"), 12_000.0, 6))
NEAR_M, NEAR_STEP = 50_000.0, 1_800.0
#: Widths of the rings of near routes and of the last resort; the widest corridor and the step of a widened one.
RINGS, WIDEST, DENSE_STEP = (3, 6, 12, 20), 14, 2_000.0


def schedule(distance_m: float) -> list[tuple[float, int]]:
    """(sampling step, width) to try in order for a route of that length."""
    rings = [(NEAR_STEP, w) for w in RINGS]
    if distance_m < NEAR_M:
        return rings
    step, width = next((s, w) for most, s, w in CORRIDORS if distance_m <= most)
    return [(step, width), (DENSE_STEP, min(2 * width, WIDEST)), *rings]


def corridor_cells(pairs: DataFrame, step_m: float = 500.0, widen: int = 1) -> DataFrame:
    """(route_id, cell): cells within ``widen`` of the sampled straight line."""
    path = sample_path(*(F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")), step_m)
    p = pairs.select("route_id", F.explode(path).alias("p")).select("route_id", geo.micro(F.col("p.lat")).alias("lat_micro"), geo.micro(F.col("p.lon")).alias("lon_micro"))
    y, x = grid.cell_y(F.col("lat_micro")), grid.cell_x(F.col("lon_micro"))
    return p.select("route_id", F.explode(grid._box(y - widen, y + widen, x - widen, x + widen)).alias("cell")).distinct()


def _node(lat_micro, lon_micro):
    ny, nx = (F.floor(c * (NODE_SCALE / geo.MICRO)).cast("long") for c in (lat_micro, lon_micro))
    return (ny + (1 << 24)) * (1 << 26) + nx + (1 << 25)


#: The neighbours of a cell of ``merge_near`` that come after it, nearest first; the first four share a side or corner with it.
AFTER = ((0, 1), (1, 0), (1, -1), (1, 1), (0, 2), (1, -2), (1, 2), (2, -2), (2, -1), (2, 0), (2, 1), (2, 2))


def merge_near(nodes: DataFrame, units: float = 5.0) -> DataFrame:
    """(node, merged): nodes (node, lat_micro, lon_micro) within ``units`` of a 50,000th of a degree of each other, directly or through others, are one, under the least name.

    Cells are so small that all nodes of one belong together, so components are those of cells: a cell and each next to it are linked if the two nodes that stand out
    most towards each other are near; only for neighbours that this leaves in different components are all pairs of nodes looked at."""
    y, x = (F.col(c) * (NODE_SCALE / geo.MICRO) for c in ("lat_micro", "lon_micro"))
    side = units / 1.4143  # a little less than by the root of two
    near = lambda a, b: (F.col(f"{a}.y") - F.col(f"{b}.y")) ** 2 + (F.col(f"{a}.x") - F.col(f"{b}.x")) ** 2 <= units * units
    at = nodes.select("node", y.alias("y"), x.alias("x"), F.floor(y / side).cast("long").alias("cy"), F.floor(x / side).cast("long").alias("cx"))
    inside = at.where("cy IS NOT NULL AND cx IS NOT NULL").repartition("cy", "cx")  # before they are grouped, as most groups of a part would be of one
    ways = {w: F.col("y") * w[0] + F.col("x") * w[1] for w in ((0, 1), (1, 0), (1, -1), (1, 1), (0, -1), (-1, 0), (-1, 1), (-1, -1))}
    out = [F.max_by(F.struct("y", "x"), v).alias(f"o{i}") for i, v in enumerate(ways.values())]
    cells = _cut(inside.groupBy("cy", "cx").agg(F.min("node").alias("cell"), *out))

    def pairs(left: DataFrame, right: DataFrame, after: tuple) -> DataFrame:
        """Cells a with their neighbours b, both as structs."""
        steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.col("cy") + dy).alias("cy"), (F.col("cx") + dx).alias("cx")) for i, (dy, dx) in enumerate(after)]))
        a = left.select(F.struct(*left.columns).alias("a"), steps.alias("s")).select("a", "s.i", "s.cy", "s.cx")
        return a.join(right.select("cy", "cx", F.struct(*right.columns).alias("b")), ["cy", "cx"]).drop("cy", "cx")

    facing = F.lit(False)
    for i in range(4):
        facing = F.when(F.col("i") == i, near(f"a.o{i}", f"b.o{i + 4}")).otherwise(facing)
    labels = components(pairs(cells, cells, AFTER[:4]).where(facing).select(F.col("a.cell").alias("src"), F.col("b.cell").alias("dst")))
    known = cells.select("cy", "cx", "cell").join(labels.withColumnRenamed("node", "cell"), "cell", "left").select("cy", "cx", F.coalesce("component", "cell").alias("part"))
    known = _cut(known)
    open_ = pairs(known, known, AFTER).where("a.part <> b.part").select(F.explode(F.array("a", "b")).alias("c")).select("c.cy", "c.cx").distinct()
    left = _cut(inside.join(open_, ["cy", "cx"], "left_semi").join(known, ["cy", "cx"]).select("cy", "cx", "y", "x", "part"))
    links = pairs(left, left, AFTER).where((F.col("a.part") != F.col("b.part")) & near("a", "b")).select(F.col("a.part").alias("src"), F.col("b.part").alias("dst"))
    joined = components(links.distinct()).withColumnRenamed("node", "part")
    merged = known.join(joined, "part", "left").select("cy", "cx", F.coalesce("component", "part").alias("merged"))
    return at.join(merged, ["cy", "cx"], "left").select("node", F.coalesce("merged", "node").alias("merged"))


def graph(vertices: DataFrame, roads: DataFrame, profile: str = "driving", intersections: DataFrame | None = None, merge_units: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the roads (piece_id, road_class, and oneway if it is known) that a profile may use: vertices at the same
    snapped place are one node; weights are hundredths of seconds.

    A road that is oneway (1 along its vertices, -1 against them, else both ways) has edges in its direction only, but for walkers. An edge into a
    node with ``intersections`` (kind, lat_micro, lon_micro) costs the longest of their delays on top. With ``merge_units`` nodes
    as near as that are one (see ``merge_near``).
    """
    classes = ROUTABLE.get(profile)
    use = roads if classes is None else roads.where(F.col("road_class").isin(*classes))
    way = F.coalesce(F.col("oneway").cast("int"), F.lit(0)) if "oneway" in roads.columns and profile != "walking" else F.lit(0)
    use = use.select(F.col("piece_id").alias("id"), way.alias("way"))
    snapped = vertices.select("id", "pos", "lat_micro", "lon_micro", _node(F.col("lat_micro"), F.col("lon_micro")).alias("node")).join(use, "id")
    nodes = snapped.groupBy("node").agg(F.min("lat_micro").alias("lat_micro"), F.min("lon_micro").alias("lon_micro"))
    if merge_units is not None:
        one = _cut(merge_near(nodes, merge_units))
        snapped = snapped.join(one, "node").drop("node").withColumnRenamed("merged", "node")
        nodes = nodes.join(one.select(F.col("merged").alias("node")).distinct(), "node")
        if intersections is not None:
            intersections = intersections.withColumn("node", _node(F.col("lat_micro"), F.col("lon_micro"))).join(one, "node").drop("node")
    line = Window.partitionBy("id").orderBy("pos")
    after = {c: F.lead(c).over(line) for c in ("node", "lat_micro", "lon_micro", "pos")}
    steps = snapped.select("id", "pos", "way", "node", "lat_micro", "lon_micro", *[c.alias(f"to_{n}") for n, c in after.items()]).where("to_node <> node AND to_pos = pos + 1")
    d = geo.haversine(*(geo.degrees(F.col(c)) for c in ("lat_micro", "lon_micro", "to_lat_micro", "to_lon_micro")))
    steps = steps.select(F.col("node").alias("src"), F.col("to_node").alias("dst"), "way", F.rint(d / classify.speed_ms(profile) * 100).cast("long").alias("weight"))
    edges = steps.where("way >= 0").select("src", "dst", "weight").union(steps.where("way <= 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    edges = edges.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    if intersections is not None:
        where = F.col("merged") if merge_units is not None else _node(F.col("lat_micro"), F.col("lon_micro"))
        late = intersections.groupBy(where.alias("dst")).agg(F.max(classify.delay_s(F.col("kind"))).alias("delay"))
        edges = edges.join(late, "dst", "left").select("src", "dst", (F.col("weight") + 100 * F.coalesce("delay", F.lit(0))).alias("weight"))
    return nodes, edges


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, component): the least node connected whichever way its edges go.

    In every round each node goes to the neighbour that comes first in an order by hash, and on from there, and edges between the places left are kept. As the order is random,
    paths down it are short and few places are left, so rounds grow with the logarithm of the number of nodes, however long the paths of the graph."""
    links = _cut(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    labels = _cut(links.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("at", F.col("node")))
    links = links.where("src <> dst")
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    for _ in range(most_rounds):
        if links.isEmpty():
            low = labels.groupBy("at").agg(F.min("node").alias("component"))
            return labels.join(low, "at").select("node", "component")
        both = links.select(F.col("src").alias("node"), F.col("dst").alias("next")).union(links.select("dst", "src"))
        step = both.groupBy("node").agg(F.min(order("next")).alias("b")).select("node", F.least(F.col("b"), order("node"))["n"].alias("up"))
        step = _cut(step)
        step = _cut(step.join(step.select(F.col("node").alias("up"), F.col("up").alias("on")), "up").select("node", F.col("on").alias("up")))
        ends = [step.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")) for c in ("src", "dst")]
        moved = links.join(ends[0], "src").join(ends[1], "dst").where("src_up <> dst_up")
        links = _cut(moved.select(F.least("src_up", "dst_up").alias("src"), F.greatest("src_up", "dst_up").alias("dst")).distinct())
        labels = _cut(labels.join(step.select(F.col("node").alias("at"), "up"), "at", "left").select("node", F.coalesce("up", "at").alias("at")))
    raise RuntimeError(f"components have not settled in {most_rounds} rounds")


def shortest_paths(edges: DataFrame, sources: DataFrame, most_rounds: int = 1000, most_cost: int | None = None) -> DataFrame:
    """(source, node, cost, hops): least cost from each source (source), by rounds over the frontier only.

    Every round joins the nodes whose cost fell with their edges and keeps the least cost a node; negative weights are not allowed.
    """
    best = _cut(sources.select("source", F.col("source").alias("node"), F.lit(0).cast("long").alias("cost"), F.lit(0).alias("hops")))
    frontier = best
    for _ in range(most_rounds):
        step = frontier.join(edges, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"), (F.col("hops") + 1).alias("hops"))
        if most_cost is not None:
            step = step.where(F.col("cost") <= most_cost)
        step = step.groupBy("source", "node").agg(F.min(F.struct("cost", "hops")).alias("s")).select("source", "node", "s.cost", "s.hops")
        old = best.select("source", "node", F.col("cost").alias("was"))
        frontier = _cut(step.join(old, ["source", "node"], "left").where("was IS NULL OR cost < was").select("source", "node", "cost", "hops"))
        if frontier.isEmpty():
            return best
        best = _cut(best.union(frontier).groupBy("source", "node").agg(F.min(F.struct("cost", "hops")).alias("s")).select("source", "node", "s.cost", "s.hops"))
    raise RuntimeError(f"paths have not settled in {most_rounds} rounds")


def snap_to_largest(points: DataFrame, nodes: DataFrame, labels: DataFrame, radius_m: float) -> DataFrame:
    """(qid, node, distance): the nearest node of the largest component; its size is an aggregate, and ties go to the least."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    largest = sizes.agg(F.min_by("component", F.struct(-F.col("n"), "component")).alias("component"))
    inside = nodes.join(labels.join(F.broadcast(largest), "component"), "node")  # one row
    hit = nearby(points, inside.select(F.col("node").alias("osm_id"), "lat_micro", "lon_micro"), radius_m, 1)
    return hit.select("qid", F.col("osm_id").alias("node"), "distance")


def widening_corridor(spark: SparkSession, route: DataFrame, vertices: DataFrame, roads: DataFrame, src: int, dst: int, profile: str = "driving", intersections: DataFrame | None = None) -> tuple[DataFrame, int | None]:
    """Paths of one route (route_id, lat1, lon1, lat2, lon2) inside a corridor that follows ``schedule`` until its ends are connected;
    (paths from src, width). Where the widest ring is not enough the whole graph is used, and the width is null."""
    first = estimate(route).first()  # one row
    keyed = vertices.withColumn("cell", grid.cell(F.col("lat_micro"), F.col("lon_micro")))
    source = spark.createDataFrame([(src,)], "source long")
    for step, width in schedule(first["distance_m"]):
        inside = keyed.join(corridor_cells(route, step, width).select("cell"), "cell", "left_semi")
        paths = shortest_paths(_cut(graph(inside, roads, profile, intersections)[1]), source)
        if not paths.where(F.col("node") == dst).isEmpty():
            return paths, width
    return shortest_paths(_cut(graph(vertices, roads, profile, intersections)[1]), source), None


def compare_routes(ours: DataFrame, other: DataFrame) -> DataFrame:
    """(route_id, ratio): our distances against another source's."""
    return ours.join(other.select("route_id", F.col("distance_m").alias("other_m")), "route_id").withColumn("ratio", F.round(F.col("distance_m") / F.col("other_m"), 4))
