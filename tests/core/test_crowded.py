"""Rows in great numbers that stand alike: what once met pair by pair, or cost a call of Python a group, must not."""

import math
import time

from trailmark.operators import entering, graph


def test_nearest_of_many_at_one_place(spark):
    at = ("cast(id % 3 * 10 as double) as x", "cast(id % 2 as double) as y")
    points = spark.range(40_000).selectExpr("id as point", "0 as floor", *at)
    nodes = spark.range(40_000).selectExpr("id + 7 as id", "0 as floor", *at)
    began = time.time()
    got = graph.nearest(points, nodes, ["floor"], 20.0).groupBy("x", "y").agg({"node": "max", "distance": "max", "point": "count"}).collect()
    first = {(10.0 * (i % 3), float(i % 2)): i + 7 for i in range(5, -1, -1)}
    assert {(r.x, r.y): r["max(node)"] for r in got} == first and all(r["max(distance)"] == 0 for r in got) and sum(r["count(point)"] for r in got) == 40_000
    assert time.time() - began < 60  # 1.6 thousand million pairs otherwise


def test_nearest_of_many_equal_segments(spark):
    points = spark.range(20_000).selectExpr("id as point", "0 as floor", "cast(id % 4 as double) as x", "1.0D as y")
    segments = spark.range(20_000).selectExpr("id + 3 as edge", "0 as floor", "0.0D as ax", "cast(id % 2 * 5 as double) as ay", "100.0D as bx", "cast(id % 2 * 5 as double) as `by`")
    began = time.time()
    got = graph.nearest_on_edges(points, segments, ["floor"], 15.0).groupBy("x").agg({"edge": "max", "distance": "max", "share": "max", "point": "count"}).collect()
    assert sorted((r.x, r["max(edge)"], r["max(distance)"], round(r["max(share)"], 9), r["count(point)"]) for r in got) == [(float(x), 3, 1.0, x / 100, 5000) for x in range(4)]
    assert time.time() - began < 60  # 400 million pairs, each in several cells, otherwise


def test_slanting_segments_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    points = [(i, i % 2, rng.uniform(-50, 150), rng.uniform(-50, 90)) for i in range(150)]
    segments = [(i, i % 2, *(rng.uniform(0, 100) for _ in range(4))) for i in range(120)]

    def off(x, y, ax, ay, bx, by):
        t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        return round(math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)), 9)

    want = {i: min((off(x, y, *s[2:]), s[0]) for s in segments if s[1] == f) for i, f, x, y in points}
    df = spark.createDataFrame(points, "point int, floor int, x double, y double")
    got = graph.nearest_on_edges(df, spark.createDataFrame(segments, "edge int, floor int, ax double, ay double, bx double, by double"), ["floor"], 15.0)
    assert {r.point: (round(r.distance, 9), r.edge) for r in got.collect()} == want


def test_rings_of_many_outlines(spark):
    from trailmark.operators import building

    ways = spark.range(60_000).selectExpr("id as outline", "explode(array(named_struct('way', 2, 'nodes', array(id + 2, id + 1)), named_struct('way', 1, 'nodes', array(id, id + 1)), named_struct('way', 3, 'nodes', array(id + 2, id)))) as w")
    got = building.rings(ways.select("outline", "w.way", "w.nodes"), ["outline"])
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()  # a call of Python for each outline
    assert got.where("ring = 0 and nodes = array(outline, outline + 1, outline + 2, outline)").count() == got.count() == 60_000


WALK = [(i, 0.5 * i - 12, 0.1, 0.5, 0.0) for i in range(45)]
DIRECTIONS = [math.radians((i * 7 + 100) % 360) for i in range(360)]


def crowd(spark, sessions, doors):
    steps = spark.createDataFrame(WALK, "t int, x double, y double, dx double, dy double").crossJoin(spark.range(sessions).withColumnRenamed("id", "who"))
    turned = "radians(cast((id * 7 + 100) % 360 as double))"
    return steps, spark.range(doors).selectExpr("id as door", "0.0D as x", "0.0D as y", f"cos({turned}) as inx", f"sin({turned}) as iny")


def test_doors_by_direction_at_one_place(spark):
    steps, doors = crowd(spark, 200, 200_000)
    began = time.time()
    got = entering.enters_by_direction(steps, doors, "who").groupBy("t", "door").count().collect()
    first = min(i for i, a in enumerate(DIRECTIONS) if math.cos(a) >= math.cos(math.radians(50)))
    assert {(r.t, r.door, r["count"]) for r in got} == {(t, first, 200) for t, x, *_ in WALK if t >= 2 and math.hypot(x, 0.1) <= 4}
    assert time.time() - began < 90  # 600 million pairs otherwise


def test_doors_by_trail_at_one_place(spark):
    steps, doors = crowd(spark, 200, 200_000)
    began = time.time()
    got = entering.enters_by_trail(steps, doors, "who").groupBy("t", "door").count().collect()
    want = set()
    for t, x, *_ in WALK[15:]:
        trail = [(WALK[t - 15][1] + 0.5 * k, 0.1) for k in range(16)]
        if math.hypot(x, 0.1) <= 9 and min(math.hypot(*p) for p in trail[1:]) <= 4:
            through = [i for i, a in enumerate(DIRECTIONS) if trail[-1][0] * math.cos(a) + 0.1 * math.sin(a) >= 1.5 and trail[0][0] * math.cos(a) + 0.1 * math.sin(a) < 0]
            want |= {(t, min(through), 200)} if through else set()
    assert {(r.t, r.door, r["count"]) for r in got} == want != set()
    assert time.time() - began < 90  # a walk folded a thousand million times otherwise


def test_gates_alike_and_at_the_limit(spark):
    gates = spark.range(100_000).selectExpr("id as gate", "50.0D as x", "10.0D as y", "49.0D as inner_x", "10.0D as inner_y", "true as outer")
    steps = spark.range(2000).selectExpr("id as who", "1 as t", "50.0D as on_x", "10.0D as on_y", "51.0D as x", "10.0D as y", "90.0D as heading")
    began = time.time()
    got = entering.leaves_by_gate(steps, gates, "who").groupBy("gate", "beyond").count().collect()
    assert [tuple(r) for r in got] == [(0, 1.0, 2000)] and time.time() - began < 60  # 200 million pairs otherwise


def test_outline_of_many_doors_and_as_by_windows(spark, monkeypatch):
    # steps 6 and 12 metres off to the last bit, sessions that come back, and doors alike
    steps = spark.range(600).selectExpr("id div 60 as who", "id % 60 as t", "cast(id * 37 % 211 as double) / 10 as x", "cast(id * 53 % 127 as double) / 10 as y", "id % 3 - 0.7D as dx", "id % 2 - 0.4D as dy", "cast(id % 6 - 1 as double) as depth")
    doors = spark.range(30_000).selectExpr("id as door", "cast(id % 30 as double) as x", "cast(id % 11 as double) as y", "cos(radians(id % 9 * 40)) as inx", "sin(radians(id % 9 * 40)) as iny")
    began = time.time()
    held = entering.enters_by_outline(steps, doors, "who")
    assert held.columns == ["who", "t", "door"]
    rows = sorted(map(tuple, held.collect()))
    assert len(rows) > 50 and time.time() - began < 60  # a row for each step and door, 18 million, in windows otherwise
    monkeypatch.setattr(entering, "HELD_DOORS", 0)
    assert sorted(map(tuple, entering.enters_by_outline(steps, doors, "who").collect())) == rows
