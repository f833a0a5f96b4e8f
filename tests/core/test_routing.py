"""Routes by profile, nearest things far away, and long ways, against plain searches."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from trailmark.operators import graph, routing


def building(name, floors=4):
    """A corridor, a stair, a lift and a room on each floor; a second stair far away."""
    nodes, edges = [], []
    for f in range(floors):
        for tag, kind, x, y in (("C", "HALL", 30.0, 12.0), ("S1", "STAIRS", 30.0, 10.0), ("L", "LIFT", 30.0, 14.0), ("R", "ROOM", 54.0, 12.0), ("D", "HALL", 5.0, 12.0), ("S2", "STAIRS", 5.0, 10.0)):
            nodes.append((f"{name}-{f}-{tag}", name, f, x, y, kind, f"{name}{f}" if kind == "ROOM" else None))
        e = lambda a, b, kind="WALK", steps=False: edges.append((f"{name}-{a}", f"{name}-{b}", kind, steps, False))
        e(f"{f}-C", f"{f}-S1"), e(f"{f}-C", f"{f}-L", steps=f == 1), e(f"{f}-C", f"{f}-R"), e(f"{f}-C", f"{f}-D"), e(f"{f}-D", f"{f}-S2")
        if f:
            e(f"{f - 1}-S1", f"{f}-S1", "STAIRS"), e(f"{f - 1}-S2", f"{f}-S2", "STAIRS")
            for g in range(f):
                e(f"{g}-L", f"{f}-L", "LIFT")
    return nodes, edges


def campus():
    n1, e1 = building("A", 4)
    n2, e2 = building("B", 3)
    n2 = [(i, b, f, x + 100, y, *r) for i, b, f, x, y, *r in n2]
    passage = [("K-0-P", "K", 0, 80.0, 12.0, "PASSAGE", None)]
    links = [("A-0-C", "K-0-P", "WALK", False, False), ("A-1-C", "K-0-P", "WALK", True, False), ("K-0-P", "B-0-D", "WALK", False, False), ("A-3-R", "B-2-R", "WALK", False, False), ("A-0-D", "B-0-R", "WALK", False, True)]
    return n1 + n2 + passage, e1 + e2 + links


def plain(nodes, edges, source, target, p):
    at = {n[0]: n for n in nodes}
    near = {}
    for a, b, kind, steps, only in edges:
        if not only:
            near.setdefault(a, []).append((b, kind, steps))
            near.setdefault(b, []).append((a, kind, steps))
    if source not in at or target not in at:
        return None
    key = lambda i: at[i][1] + "/" + "-".join(i.split("-")[2:]).removesuffix("-D")
    todo, done = [(0.0, 0.0, source, "", "")], set()
    ends = {at[source][1], at[target][1]}
    while todo:
        price, took, node, last, came = heapq.heappop(todo)
        if (node, last, came) in done:
            continue
        done.add((node, last, came))
        if node == target:
            return took
        if at[node][5] == "ROOM" and node != source:
            continue
        for b, kind, steps in near.get(node, []):
            (_, ba, fa, xa, ya, *_), (_, bb, fb, xb, yb, kb, _) = at[node], at[b]
            if came and bb == came:
                continue
            crowd = max(p.crowd.get(ba, 1.0), p.crowd.get(bb, 1.0))
            if kind == "WALK":
                cost = None if steps and p.avoid_stairs else math.hypot(xa - xb, ya - yb) / p.speed * crowd
            elif kind == "STAIRS":
                cost = None if p.avoid_stairs else (p.stairs_up if fb > fa else p.stairs_down) * abs(fb - fa) * crowd
            else:
                cost = None if p.avoid_lift else p.lift_wait + p.lift_floor * abs(fb - fa)
            vertical = key(b) if kind != "WALK" else last
            if cost is None or kind != "WALK" and (vertical in p.excluded or vertical in p.lift_only_avoiding and not p.avoid_stairs):
                continue
            extra = 0.0
            if kind != "WALK" and vertical != last:
                uncommon = vertical in p.uncommon or vertical in p.uncommon_transit and bb not in ends
                extra = (p.change if last else 0.0) + (p.uncommon_cost if uncommon else 0.0)
            heapq.heappush(todo, (price + cost + extra, took + cost, b, vertical, ba if kb == "PASSAGE" and ba != bb else ""))
    return None


PROFILES = [routing.Profile(avoid_stairs=True), routing.Profile(uncommon=("A/S1",), excluded=("A/L",), crowd={"A": 1.25}), routing.Profile(uncommon_transit=("A/S1", "A/L"), lift_only_avoiding=("B/L",), change=5.0)]


@pytest.fixture(scope="module")
def tables(spark):
    nodes, edges = campus()
    return spark.createDataFrame(nodes, "id string, building string, floor int, x double, y double, kind string, name string"), spark.createDataFrame(edges, "a string, b string, kind string, steps boolean, locate_only boolean")


@pytest.mark.parametrize("case", range(len(PROFILES)))
def test_profile_routes(spark, tables, case):
    (nodes, edges), p = tables, PROFILES[case]
    n, e = campus()
    rng = random.Random(case)
    rooms = [x[0] for x in n if x[5] in ("ROOM", "HALL", "STAIRS")]
    asked = [(i, rng.choice(rooms), rng.choice(rooms)) for i in range(12)] + [(100, "A-0-R", "nowhere"), (101, "A-3-R", "A-3-R"), (102, "A-3-R", "B-2-R")]
    got = {r.request: r for r in routing.routes(edges, nodes, spark.createDataFrame(asked, "request int, source string, target string"), p).collect()}
    for i, s, t in asked:
        want = plain(n, e, s, t, p)
        plainly = want is None and (p.avoid_stairs or p.avoid_lift)
        if plainly:
            want = plain(n, e, s, t, p.avoiding_nothing())
        if want is None:
            assert i not in got
            continue
        assert got[i].seconds == pytest.approx(want) and got[i].fallback == plainly, (s, t)
        assert got[i].path[0] == s and got[i].path[-1] == t
        assert not any(x.endswith("-R") for x in got[i].path[1:-1])


def test_presets_and_keys(spark):
    p = routing.presets(uncommon=("A/S2",))
    assert [p[k].avoid_stairs for k in ("usual", "fastest", "no stairs", "no lift")] == [False, False, True, False] and p["fastest"].uncommon == () and p["no lift"].uncommon == ("A/S2",)
    with pytest.raises(ValueError):
        routing.Profile(crowd={"A": 0.9})
    r = spark.range(1).select(routing.vertical_key(F.lit("NB"), F.lit("NB-1-S-D")).alias("a"), routing.vertical_key(F.lit("N"), F.lit("N-0-L2")).alias("b")).first()
    assert (r.a, r.b) == ("NB/S", "N/L2")


def test_routes_from_points_and_rooms(spark, tables):
    nodes, edges = tables
    n, e = campus()
    p = routing.Profile()
    points = spark.createDataFrame([(1, 28.0, 11.0, "A", 0), (2, 53.0, 13.0, "A", 2)], "point int, x double, y double, building string, floor int")
    targets = spark.createDataFrame([(1, "A-3-R"), (2, "A-2-S2")], "request int, target string")
    got = {r.request: r.seconds for r in routing.routes_from(routing.starts_at_nodes(points, nodes, ["building", "floor"]), targets, edges, nodes, p).collect()}
    near = {1: "A-0-C", 2: "A-2-R"}
    at = {x[0]: x for x in n}
    for r, x, y in ((1, 28.0, 11.0), (2, 53.0, 13.0)):
        leg = math.hypot(x - at[near[r]][3], y - at[near[r]][4]) / p.speed
        assert got[r] == pytest.approx(leg + plain(n, e, near[r], {1: "A-3-R", 2: "A-2-S2"}[r], p))
    # on an edge both ends count
    seg = spark.createDataFrame([(1, "A-0-D", "A-0-C", 5.0, 12.0, 30.0, 12.0)], "edge int, a string, b string, ax double, ay double, bx double, by double")
    one = spark.createDataFrame([(1, 10.0, 13.0)], "point int, x double, y double")
    two, ends = one.union(one.withColumn("point", F.lit(2))), {1: "A-1-S2", 2: "A-0-R"}
    for r in routing.routes_from(routing.starts_on_edges(two, seg, []), spark.createDataFrame(list(ends.items()), "request int, target string"), edges, nodes, p).collect():
        target = ends[r.request]
        assert r.seconds == pytest.approx(min((1 + 5) / p.speed + plain(n, e, "A-0-D", target, p), (1 + 20) / p.speed + plain(n, e, "A-0-C", target, p)))
    asked = spark.createDataFrame([(1, None, "A2"), (2, "A1", "B2"), (3, "A1", "Z9"), (4, "Z9", "A1")], "request int, from_name string, to_name string")
    got = {r.request: r.seconds for r in routing.room_routes(asked, edges, nodes, "A-0-D", p).collect()}
    assert got == {1: pytest.approx(plain(n, e, "A-0-D", "A-2-R", p)), 2: pytest.approx(plain(n, e, "A-1-R", "B-2-R", p)), 3: None, 4: None}


def test_nearest_far_away(spark):
    rng = random.Random(3)
    nodes = [(i, rng.uniform(0, 100), rng.uniform(0, 100), i % 2) for i in range(60)]
    points = [(i, rng.uniform(-50, 150), rng.uniform(-50, 150), i % 2) for i in range(40)] + [(90, 1e6, -3e5, 0), (91, 5.0, 5.0, 7), (92, None, 5.0, 0), (93, float("nan"), 1.0, 0)]
    n = spark.createDataFrame(nodes, "id int, x double, y double, floor int")
    p = spark.createDataFrame(points, "point int, x double, y double, floor int")
    got = {r.point: (r.node, r.distance) for r in graph.nearest(p, n, ["floor"], 3.0).collect()}
    assert len(got) == len(points) and all(got[i] == (None, None) for i in (91, 92, 93))
    for i, x, y, f in points[:41]:
        d, node = min((round(math.hypot(x - a, y - b), 9), k) for k, a, b, g in nodes if g == f)
        assert got[i] == (node, pytest.approx(d))
    some = {r.point: r.node for r in graph.nearest(p, n, ["floor"], 3.0, most=10.0).collect()}
    assert all(some[i] == (got[i][0] if got[i][0] is not None and got[i][1] <= 10.0 else None) for i in some)
    segments = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 0.0, 0), (2, 0.0, 50.0, 0.0, 90.0, 0)], "edge int, ax double, ay double, bx double, by double, floor int")
    far = {r.point: (r.edge, r.share, r.distance) for r in graph.nearest_on_edges(p.where("floor = 0"), segments, ["floor"], 2.0).collect()}
    assert far[90] == (1, 1.0, pytest.approx(math.hypot(1e6 - 100, 3e5)))
