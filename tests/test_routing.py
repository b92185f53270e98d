import heapq
import random
from collections import Counter
from math import asin, cos, radians, sin, sqrt

from pyspark.sql import functions as F

from groundling.operators import routing as R
from groundling.plans import catalog
from groundling.plans.fixtures import view

D = "/root/testdata/sf0.001"


def edges(spark, rows):
    return spark.createDataFrame([(a, b, w) for a, b, w in rows] + [(b, a, w) for a, b, w in rows], "src long, dst long, weight long")


def test_paths_and_components(spark):
    e = edges(spark, [(1, 2, 5), (2, 3, 5), (1, 3, 20), (10, 11, 1)])
    got = {r.node: r.cost for r in R.shortest_paths(e, spark.createDataFrame([(1,)], "source long")).collect()}
    assert got == {1: 0, 2: 5, 3: 10}
    assert {r.node: r.component for r in R.components(e).collect()} == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10}
    assert R.components(e.limit(0)).count() == 0


def test_corridor_widens_until_connected(spark):
    # a road that leaves the straight line between its ends by six cells
    line = [(3_600_000, -8_600_000), (3_612_000, -8_600_000), (3_612_000, -8_596_000), (3_600_000, -8_596_000)]
    v = spark.createDataFrame([(1, i, lon, lat) for i, (lat, lon) in enumerate(line)], "id long, pos int, lon_micro int, lat_micro int")
    road = spark.createDataFrame([(1, "primary")], "piece_id long, road_class string")
    nodes, _ = R.graph(v, road)
    at = {(r.lat_micro, r.lon_micro): r.node for r in nodes.collect()}
    route = spark.createDataFrame([(1, 36.0, -86.0, 36.0, -85.96)], "route_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    paths, width = R.widening_corridor(spark, route, v, road, at[line[0]], at[line[3]])
    assert width == 6 and paths.where(paths.node == at[line[3]]).count() == 1


def test_schedule():
    assert R.schedule(10_000) == [(1800.0, 3), (1800.0, 6), (1800.0, 12), (1800.0, 20)]
    assert R.schedule(100_000)[:2] == [(3000.0, 8), (2000.0, 14)] and R.schedule(500_000)[:2] == [(6000.0, 7), (2000.0, 14)]
    assert R.schedule(2_000_000)[:2] == [(12000.0, 6), (2000.0, 12)] and R.schedule(2_000_000)[2:] == R.schedule(10_000)


def test_classes_directions_and_delays(spark):
    v = spark.createDataFrame([(i, p, 36 * 10**5 + 100 * i * (p % 2), -86 * 10**5 + 400 * p) for i in range(6) for p in range(2)], "id long, pos int, lat_micro int, lon_micro int")
    kinds = [("primary", 1), ("primary", -1), ("residential", 0), ("footway", 0), ("cycleway", 1), ("proposed", 0)]
    roads = spark.createDataFrame([(i, c, w) for i, (c, w) in enumerate(kinds)], "piece_id long, road_class string, oneway int")
    lights = spark.createDataFrame([(1, 36 * 10**5 + 200, -86 * 10**5 + 400), (2, 36 * 10**5 + 200, -86 * 10**5 + 400)], "kind int, lat_micro int, lon_micro int")
    name = {}
    for r in R.graph(v, roads.withColumn("road_class", F.lit("primary")))[0].collect():
        name[r.node] = "a" if r.lon_micro == -86 * 10**5 else f"b{(r.lat_micro - 36 * 10**5) // 100}"
    edges = lambda profile, x=None: {(name[r.src], name[r.dst]): r.weight for r in R.graph(v, roads, profile, x)[1].collect()}
    assert set(edges("driving")) == {("a", "b0"), ("b1", "a"), ("a", "b2"), ("b2", "a")}
    assert set(edges("walking")) == {("a", "b2"), ("b2", "a"), ("a", "b3"), ("b3", "a")}
    assert set(edges("cycling")) == {("a", "b2"), ("b2", "a"), ("a", "b4")}
    plain, late = edges("driving"), edges("driving", lights)
    assert {k: late[k] - plain[k] for k in plain} == {k: 2000 if k[1] == "b2" else 0 for k in plain}


def test_estimate(spark):
    pairs = spark.createDataFrame([(1, 36.1627, -86.7816, 36.17, -86.775)], "route_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    r = R.estimate(pairs, "walking").first()
    assert 900 < r.distance_m < 1100 and abs(r.duration_s - r.distance_m / 1.4) < 0.2
    path = pairs.select(R.sample_path(*(pairs[c] for c in ("lat1", "lon1", "lat2", "lon2"))).alias("p")).first().p
    assert len(path) == int(r.distance_m / 100) + 1 and (path[0].lat, path[-1].lat) == (36.1627, 36.17)


def test_near_nodes_are_one(spark):
    """Two roads that end 4 units apart meet only if such nodes are merged."""
    ends = [(0, [(3_600_000, -8_600_000), (3_600_000, -8_599_000)]), (1, [(3_600_008, -8_599_000), (3_601_000, -8_598_000)])]
    v = spark.createDataFrame([(i, p, lat, lon) for i, line in ends for p, (lat, lon) in enumerate(line)], "id long, pos int, lat_micro int, lon_micro int")
    roads = spark.createDataFrame([(0, "primary"), (1, "primary")], "piece_id long, road_class string")
    apart = {tuple(r) for r in R.graph(v, roads)[1].select("src", "dst").collect()}
    nodes, edges = R.graph(v, roads, merge_units=5.0)
    together = {tuple(r) for r in edges.select("src", "dst").collect()}
    assert len({x for e in apart for x in e}) == 4 and len({x for e in together for x in e}) == 3 == nodes.count() and len(together) == 4


DRIVEN = {"motorway", "primary", "secondary", "tertiary", "residential", "service"}  # of the classes in the test layer


def whole(spark):
    """Every driven road's steps in the directions allowed as (node, node), and the places of nodes, from all rows of the tables."""
    place, lines = {}, {}
    use = {r.piece_id for r in view(spark, D, "road").collect() if r.road_class in DRIVEN}
    way = {r.osm_id: r.oneway for r in view(spark, D, "way_tags").collect()}
    for r in view(spark, D, "road_vertex").collect():
        if r.id in use:
            lat, lon = r.lat_micro // 400 * 400, r.lon_micro // 400 * 400
            node = (lat // 2 + (1 << 24)) * (1 << 26) + lon // 2 + (1 << 25)
            place[node] = (lat / 1e5, lon / 1e5)
            lines.setdefault(r.id, {})[r.pos] = node
    steps = {(v[p], v[p + 1], way[i]) for i, v in lines.items() for p in v if p + 1 in v and v[p] != v[p + 1]}
    return place, {(a, b) for a, b, w in steps if w != "-1"} | {(b, a) for a, b, w in steps if w != "yes"}


def labelled(steps):
    up = {x: x for s in steps for x in s}

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in steps:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def metres(a, b):
    la, lo, lb, lp = map(radians, (*a, *b))
    return 2 * 6_371_000 * asin(sqrt(sin((lb - la) / 2) ** 2 + cos(la) * cos(lb) * sin((lp - lo) / 2) ** 2))


def test_whole_graph_components_and_snapping(spark):
    place, steps = whole(spark)
    assert {(r.src, r.dst) for r in catalog.queries()["road_graph"](spark, D).collect()} == steps
    label = labelled(steps)
    assert {r.node: r.component for r in catalog.queries()["connected_components"](spark, D).collect()} == label
    n = Counter(label.values())
    largest = min(n, key=lambda c: (-n[c], c))
    got = {r.qid: r for r in catalog.queries()["snap_to_component"](spark, D).collect()}
    inside = [x for x in label if label[x] == largest]
    for p in view(spark, D, "ping").collect():
        at = (p.lat_micro / 1e5, p.lon_micro / 1e5)
        least = min(metres(at, place[x]) for x in inside)
        assert (p.qid in got) == (least <= 3000)
        if p.qid in got:
            assert label[got[p.qid].node] == largest and abs(got[p.qid].distance - least) < 0.2 and abs(metres(at, place[got[p.qid].node]) - least) < 0.2


def test_whole_graph_paths(spark):
    d = "/root/testdata/sf0.01"
    near = {}
    for r in catalog.queries()["road_graph"](spark, d).collect():
        near.setdefault(r.src, []).append((r.dst, r.weight))
    cost, heap = {}, [(0, min(near, key=lambda x: (-len(near[x]), x)))]
    while heap:
        c, x = heapq.heappop(heap)
        if x not in cost:
            cost[x] = c
            for y, w in near.get(x, ()):
                heapq.heappush(heap, (c + w, y))
    assert len(cost) > 1000 and max(cost.values()) > 12_000
    assert {r.node: r.cost for r in catalog.queries()["shortest_path"](spark, d).collect()} == cost


def test_near_nodes_by_cells_equal_brute_force(spark):
    """Sparse and dense places, a gap just over the distance, cells two apart, and a node without a place."""
    rnd = random.Random(7)
    at = {(rnd.randrange(-400, 400), rnd.randrange(-400, 400)) for _ in range(250)} | {(y, x) for y in range(1000, 1040, 2) for x in range(0, 40, 2)}
    at |= {(y, x) for y in range(1000, 1040, 2) for x in range(59, 79, 2)} | {(1100, 0), (1106, 8), (1100, 10), (2000, 0), (2000, 11)}
    nodes = dict(enumerate(sorted(at)))
    up = {n: n for n in nodes}
    for _ in nodes:
        low = {n: min(up[m] for m, (b, x) in nodes.items() if (a - b) ** 2 + (c - x) ** 2 <= 100) for n, (a, c) in nodes.items()}
        if low == up:
            break
        up = low
    df = spark.createDataFrame([(n, *p) for n, p in nodes.items()] + [(9999, None, None)], "node long, lat_micro int, lon_micro int")
    assert dict(tuple(r) for r in R.merge_near(df, 5.0).collect()) == up | {9999: 9999}


def test_rounds_leave_small_size_estimates(spark):
    """The planner's estimate starts anew in every round: its digits doubled with each round before, until the driver had no memory for them."""
    path = spark.range(300).selectExpr("id AS src", "id + 1 AS dst")
    out = R.components(path)
    assert {tuple(r) for r in out.collect()} == {(i, 0) for i in range(301)}
    assert out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 200
