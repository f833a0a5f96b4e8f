"""Directions on routes with known steps."""

import numpy as np

from trailmark.operators.directions import directions, next_manoeuvre, straight_points

SCHEMA = "route int, pos int, x double, y double, floor int, kind string, node string, place string, steps boolean"


def route(n, *points):
    """Points (x, y, floor, kind, node, place, steps) as rows."""
    return [(n, i, float(x), float(y), f, k, node, place, steps) for i, (x, y, f, k, node, place, steps) in enumerate(points)]


def test_twelve_kinds(spark):
    h = lambda x, y, f=0, k="WALK", node="HALL", place="A", steps=False: (x, y, f, k, node, place, steps)
    rows = route(1, h(0, 0, node="ROOM"), h(0, 2, node="DOOR"), h(0, 4), h(20, 4.5), h(40, 4), h(40, 20, k="STAIRS"), h(40, 20, 1), h(48, 20, 1, k="STAIRS"), h(48, 20, 2), h(48, 40, 2, k="LIFT"), h(48, 40, 0), h(48, 60, 0), h(48, 80, 0, place="OUT"), h(100, 80, 0, place="OUT"), h(100, 130, 0, place="B"), h(100, 150, 0, place="B"), h(100, 160, 0, place="PASSAGE"), h(100, 170, 1, place="C", steps=True), h(100, 180, 1, place="C"), h(130, 180, 1, place="C"), h(130, 182, 1, node="DOOR", place="C"), h(130, 186, 1, node="ROOM", place="C"))
    rows += route(2, h(0, 0), h(10, 0), h(10, 2), h(20, 2), h(40, 2))  # a pair of turns that cancels out
    rows += route(3, h(0, 0), h(30, 0), h(30, 2, k="STAIRS"), h(30, 2, -1))  # a turn just before stairs
    rows += route(4, h(0, 0), h(20, 0), h(0, 0.5))
    rows += route(5, h(5, 5))
    got = {}
    for r in directions(spark.createDataFrame(rows, SCHEMA)).orderBy("route", "seq").collect():
        got.setdefault(r.route, []).append((r.action, r.floor, r.side, round(r.metres, 1)))
    assert [x[0] for x in got[1]] == ["leave room", "left", "right", "up", "lift", "exit", "left", "enter", "passage", "flight", "left", "arrive"]
    first = [x[:3] for x in got[1]]
    assert first[0] == ("leave room", 0, None) and ("up", 2, None) in first and ("lift", 0, None) in first and first[-1] == ("arrive", 1, "right")
    assert [x for x, *_ in got[1] if x in ("exit", "enter", "passage", "flight")] == ["exit", "enter", "passage", "flight"]
    assert [x[0] for x in got[2]] == ["start", "arrive"] and got[2][0][3] == 42.0
    assert [x[0] for x in got[3]] == ["start", "down", "arrive"] and got[3][1][1] == -1
    assert [x[0] for x in got[4]] == ["start", "back", "arrive"]
    assert got[5] == [("arrive", 0, None, 0.0)]
    steps = directions(spark.createDataFrame(rows, SCHEMA))
    now = {r.route: (r.action, round(r.metres, 1)) for r in next_manoeuvre(steps).collect()}
    assert now[1] == ("leave room", 0.0) and now[2] == ("arrive", 42.0) and now[3] == ("down", 32.0) and now[5] == ("arrive", 0.0)
    assert directions(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_points(x, y, off):
    """One line, a stretch at a time."""
    keep = {0, len(x) - 1}
    todo = [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        dx, dy = x[b] - x[a], y[b] - y[a]
        far = []
        for i in range(a + 1, b):
            t = min(1, max(0, ((x[i] - x[a]) * dx + (y[i] - y[a]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
            far.append((np.hypot(x[i] - x[a] - t * dx, y[i] - y[a] - t * dy), -i))
        if far and max(far)[0] > off:
            i = -max(far)[1]
            keep.add(i)
            todo += [(a, i), (i, b)]
    return [i in keep for i in range(len(x))]


def test_straight_points():
    x, y = np.array([0.0, 1, 2, 3, 4, 5]), np.array([0.0, 0.5, -0.5, 0.4, 3, 0])
    one = lambda x, y, off: straight_points(x, y, np.arange(len(x)) % max(1, len(x) - 1) == 0, np.full(len(x), off)).tolist()
    assert one(x, y, 1.0) == [True, False, True, False, True, True]
    assert one(x, y, 9.0) == [True, False, False, False, False, True]
    assert one(np.zeros(3), np.zeros(3), 0.1) == [True, False, True]
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 40, 200)
    lines = [(rng.integers(0, 30, n).astype(float), rng.integers(0, 30, n).astype(float)) for n in sizes]
    halt = np.concatenate([(np.arange(n) == 0) | (np.arange(n) == n - 1) for n in sizes])
    got = straight_points(np.concatenate([a for a, _ in lines]), np.concatenate([b for _, b in lines]), halt, np.full(len(halt), 3.0))
    assert got.tolist() == [k for a, b in lines for k in plain_points(a, b, 3.0)]


def test_routes_cut_by_batches(spark):
    rng = np.random.default_rng(6)
    rows = [(None if n == 0 else n, i, float(rng.integers(0, 40)), float(rng.integers(0, 40)), 0, "WALK", "HALL", "OUT" if n % 3 else "A", False) for n in range(60) for i in range(int(rng.integers(1, 12)))]
    paths = spark.createDataFrame(rows, SCHEMA)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = []
    for size in ("10000", "3"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got.append(sorted(map(tuple, directions(paths).collect()), key=repr))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert got[0] == got[1]
