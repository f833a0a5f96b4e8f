"""Map building on small networks with known answers, doors, stairs and numbered tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trailmark.operators import building, graph, search


def net(spark, nodes, edges):
    return spark.createDataFrame(nodes, "id string, x double, y double"), spark.createDataFrame(edges, "a string, b string")


def pairs(df):
    return {tuple(sorted((r.a, r.b))) for r in df.collect()}


def test_joints_are_spliced(spark):
    nodes, edges = net(spark, [(f"n{i}", float(i), 0.05 * (i % 2)) for i in range(9)] + [("t", 4.0, 5.0), ("u", 4.0, 9.0), ("v", 8.0, 9.0)], [(f"n{i}", f"n{i + 1}") for i in range(8)] + [("n4", "t"), ("t", "u"), ("u", "v")])
    n, e = building.simplified(nodes, edges, F.col("id") == "n2")
    assert {r.id for r in n.collect()} == {"n0", "n2", "n4", "n8", "u", "v"}  # ends, the junction, what is kept, and a real bend
    assert pairs(e) == {("n0", "n2"), ("n2", "n4"), ("n4", "n8"), ("n4", "u"), ("u", "v")}
    marked = edges.withColumn("route_only", F.col("b") == "v")
    n, e = building.locating_network(nodes, marked, F.lit(False), 0.001)
    assert pairs(e) >= {("n4", "u")} and ("u", "v") not in pairs(e)
    triangle = net(spark, [("a", 0.0, 0.0), ("b", 1.0, 0.0), ("c", 2.0, 0.0)], [("a", "b"), ("b", "c"), ("a", "c")])
    assert len(pairs(building.simplified(*triangle, F.lit(False), 10.0)[1])) == 3


def test_places_snap(spark):
    nodes, edges = net(spark, [("a", 0.0, 0.0), ("b", 20.0, 0.0), ("c", 20.0, 10.0)], [("a", "b"), ("b", "c")])
    points = spark.createDataFrame([(1, 5.0, 2.0), (2, 12.0, -1.0), (3, 19.5, 0.4), (4, 0.2, 3.0), (5, 22.0, 6.0)], "point int, x double, y double")
    at, n, e = building.snapped(points, nodes, edges)
    assert {r.point: r.node for r in at.collect()} == {1: "snap-1", 2: "snap-2", 3: "b", 4: "a", 5: "snap-5"}
    assert {r.id: (r.x, r.y) for r in n.collect() if r.id.startswith("snap")} == {"snap-1": (5.0, 0.0), "snap-2": (12.0, 0.0), "snap-5": (20.0, 6.0)}
    assert pairs(e) == {("a", "snap-1"), ("snap-1", "snap-2"), ("b", "snap-2"), ("b", "snap-5"), ("c", "snap-5")}
    lines = spark.createDataFrame([(1, [[0.0, 0.0], [10.0, 0.0]]), (2, [[10.0, 0.001], [10.0, 8.0]])], "line int, points array<array<double>>")
    doors = spark.createDataFrame([(7, 4.0, 1.5)], "point int, x double, y double")
    n, e = building.corridors(lines, doors)
    assert n.count() == 5 and pairs(e) == {("c_0.0_0.0", "snap-7"), ("c_10.0_0.0", "snap-7"), ("c_10.0_0.0", "c_10.0_8.0"), ("door-7", "snap-7")}


def test_rings(spark):
    ways = [(1, 1, [1, 2, 3]), (1, 2, [5, 4, 3]), (1, 3, [5, 1]), (1, 4, [9, 8, 7, 9]), (1, 5, [20, 21]), (2, 1, [1, 2])]
    got = building.rings(spark.createDataFrame(ways, "relation int, way int, nodes array<int>"), ["relation"]).collect()
    assert sorted((r.relation, r.ring, r.nodes) for r in got) == [(1, 0, [1, 2, 3, 4, 5, 1]), (1, 1, [9, 8, 7, 9])]


def test_plans_are_placed(spark):
    rng = random.Random(2)
    known = [(1, x, y, 2 * (x * 0.8 - y * 0.6) + 10, 2 * (x * 0.6 + y * 0.8) - 5) for x, y in ((rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(6))]
    df = spark.createDataFrame(known, "k int, x double, y double, u double, v double")
    for r in building.placed(df, graph.similarity(df, ["k"]), ["k"]).collect():
        assert (r.px, r.py) == pytest.approx((r.u, r.v))
    true = [1.2, 0.1, 3.0, -0.2, 0.9, 1.0, 0.01, 0.02]
    warp = lambda x, y: ((true[0] * x + true[1] * y + true[2]) / (true[6] * x + true[7] * y + 1), (true[3] * x + true[4] * y + true[5]) / (true[6] * x + true[7] * y + 1))
    rows = [(1, float(x), float(y), *warp(x, y)) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10), (4, 7))] + [(2, 0.0, 0.0, 1.0, 1.0)]
    h = building.homographies(spark.createDataFrame(rows, "k int, x double, y double, u double, v double"), ["k"])
    assert [(r.k, r.h) for r in h.collect()] == [(1, pytest.approx(true))]
    px, py = building.projected(F.lit(3.0), F.lit(4.0), F.col("h"))
    assert tuple(h.select(px, py).first()) == pytest.approx(warp(3, 4))


def test_numbered_and_blocks(spark, monkeypatch):
    rows = [(i, None if i % 5 == 0 else i * 7 % 23) for i in range(200)]
    got = search.numbered(spark.createDataFrame(rows, "id int, s int").repartition(7), F.col("s").asc_nulls_last(), F.col("id").asc()).collect()
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == [r[0] for r in want] and sorted(r.place for r in got) == list(range(1, 201))
    names = spark.createDataFrame([(i, n, None, ["Main house"]) for i, n in enumerate(["Red room", "red", "Blue room", "Yard"])], "name_id int, name string, aliases array<string>, context array<string>")
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(["red", "room red", "house yard", "none", ""])], "query_id int, query string")
    one = sorted(map(tuple, search.search(names, asked).collect()))
    monkeypatch.setattr(search, "BLOCK", 2)
    assert sorted(map(tuple, search.search(names, asked).collect())) == one and math.isfinite(len(one))
