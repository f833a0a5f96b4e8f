"""Climbs whose flights and landings are known, lines on stairs, doors, priorities and reports."""

import math

import pytest

from trailmark.operators import climbing, entering, graph
from trailmark.sources import reports, tables


def headings(*parts):
    """Flights as (steps, heading) and turns as (steps, degrees) told apart by a letter."""
    h, out = 0.0, []
    for kind, n, by in parts:
        for _ in range(n):
            h = by if kind == "go" else h + by / n
            out.append(h % 360)
    return out


UP = [("go", 7, 0.0), ("turn", 5, 180.0), ("go", 7, 180.0), ("turn", 5, 180.0), ("go", 7, 0.0), ("turn", 5, 180.0), ("go", 7, 180.0)]


@pytest.mark.parametrize(("stairs", "floors"), [((0, 6, 0, 3, None, None), [0, 1, 2]), ((1, 6, 0, 3, -1, 1), [1, 0, 0]), ((1, 6, 0, 3, None, 1), [1, 2, 3]), ((3, 6, 0, 3, 1, 1), [3, 2, 1]), ((1, 6, 0, 9, None, None), [1, 2, 3])])
def test_climb_of_two_floors(spark, stairs, floors):
    steps = spark.createDataFrame([(1, 1, i, h) for i, h in enumerate(headings(*UP))], "who int, climb int, seq int, heading double")
    where = spark.createDataFrame([(1, 1, *stairs)], "who int, climb int, floor int, treads int, lowest int, highest int, learnt int, told int")
    got = climbing.climb_paths(steps, where, "who").orderBy("seq").collect()
    parts = [r.part for r in got]
    assert [p for i, p in enumerate(parts) if i == 0 or parts[i - 1] != p] == ["FIRST", "LANDING", "SECOND", "FLOOR_LANDING", "FIRST", "LANDING", "SECOND"]
    assert [r.floor for r in got if r.part == "SECOND" or r.seq == 0] == [floors[0]] + [floors[1]] * parts[:20].count("SECOND") + [floors[2]] * parts[20:].count("SECOND")
    first = [r.progress for r in got[:7]]
    assert first[:6] == pytest.approx([i / 6 for i in range(1, 7)]) and first[6] == 1.0
    assert got[11].progress == pytest.approx(1.0) and 0 < got[8].progress < 0.5


def test_climbs_that_end(spark):
    walks = {1: [("go", 5, 0.0), ("turn", 3, 90.0), ("go", 5, 90.0)], 2: [("go", 30, 0.0)], 3: [*UP[:3], ("turn", 5, -180.0), ("go", 6, 0.0)], 4: [*UP[:2], ("go", 14, 180.0)], 5: [("go", 5, 0.0), ("turn", 3, 36.0), ("go", 5, 36.0)]}
    steps = spark.createDataFrame([(1, k, i, h) for k, w in walks.items() for i, h in enumerate(headings(*w))], "who int, climb int, seq int, heading double")
    where = spark.createDataFrame([(1, k, 0, 6, 0, 3, None, None) for k in walks], "who int, climb int, floor int, treads int, lowest int, highest int, learnt int, told int")
    got = {}
    for r in climbing.climb_paths(steps, where, "who").orderBy("climb", "seq").collect():
        got.setdefault(r.climb, []).append((r.part, r.floor, r.progress))
    assert [p for p, _, _ in got[1]] == ["FIRST"] * 5 + ["LEFT"] * 8
    assert [p for p, _, _ in got[2]].count("LEFT") == 6
    assert [(p, f) for p, f, _ in got[3]][-1] == ("LEFT", 1)
    assert [p for p, _, _ in got[4]][-1] == "LEFT" and [p for p, _, _ in got[4]].count("SECOND") == 8
    assert {p for p, _, _ in got[5]} == {"FIRST"} and all(p[2] == 0 for k in got for p in got[k] if p[0] == "LEFT")
    assert climbing.climb_paths(steps.limit(0), where, "who").count() == 0


def test_descents_wait_for_the_gait(spark):
    scores = {1: [0.1, 0.5, 0.1, 0.5], 2: [0.1] * 14, 3: [0.1, None, 0.5], 4: [0.1, 0.5], 5: [0.4, 0.4]}
    steps = spark.createDataFrame([(1, k, i, s) for k, v in scores.items() for i, s in enumerate(v)], "who int, climb int, seq int, score double")
    assert sorted((r.climb, r.seq, r.why) for r in climbing.held_descents(steps, "who").collect()) == [(1, 3, "gait"), (2, 10, "patience"), (3, 1, "blind"), (5, 1, "gait")]


def test_stair_lines(spark):
    edges = spark.createDataFrame([("lo", "up", "S", 0, 1, 0.0, 0.0), ("up", "lo", "S", 1, 0, 2.0, 1.0), ("lo", "same", "S", 0, 0, 0.0, 0.0)], "a string, b string, stair string, floor_a int, floor_b int, x double, y double")
    point = "array<struct<x:double,y:double>>"
    paths = spark.createDataFrame([("S", 0, "left", [(0.0, 0.0), (0.0, 4.0), (2.0, 4.0), (2.0, 0.0)]), ("S", 1, "left", [(0.0, 0.0), (0.0, 4.0), (2.0, 4.0), (2.0, 0.0)]), ("S", 0, "short", [(0.0, 0.0)])], f"stair string, floor int, variant string, points {point}")
    got = {(r.a, r.b, r.variant): ([tuple(p) for p in r.line], r.metres) for r in climbing.stair_lines(edges, paths).collect()}
    assert got == {("lo", "up", "left"): ([(0.0, 0.0), (0.0, 4.0), (2.0, 4.0)], 6.0), ("up", "lo", "left"): ([(2.0, 1.0), (2.0, 0.0), (2.0, 4.0), (0.0, 4.0), (0.0, pytest.approx(4 - 0.35 * 4))], pytest.approx(1 + 4 + 2 + 1.4))}


def test_entry_that_waits(spark):
    def walk(who, points, depth):
        return [(who, i, float(x), float(y), float(x - points[max(0, i - 1)][0]), float(y - points[max(0, i - 1)][1]), depth(i)) for i, (x, y) in enumerate(points)]

    inside = lambda i: 2.0
    rows = walk(1, [(0, 4 - i) for i in range(6)], inside)  # four metres to the door, made after three
    rows += walk(2, [(0, 4), (20, 4), (0, 4.0)], inside)  # cancelled on the way
    rows += walk(3, [(0, 4 - i) for i in range(6)], lambda i: 0.0)  # never inside
    rows += walk(4, [(0, 0.5), (0, 1.5)], inside)  # at the door at once
    rows += walk(5, [(0, 3), (0, 4), (0, 5), (0, 6), (0, 5)], inside)  # outwards until it turns
    steps = spark.createDataFrame(rows, "who int, t int, x double, y double, dx double, dy double, depth double")
    doors = spark.createDataFrame([("D", 0.0, 0.0, 0.0, -1.0), ("far", 90.0, 0.0, 1.0, 0.0)], "door string, x double, y double, inx double, iny double")
    assert sorted(map(tuple, entering.enters_by_outline(steps, doors, "who").collect())) == [(1, 3, "D"), (4, 0, "D"), (5, 4, "D")]


def test_leaving(spark):
    gates = spark.createDataFrame([("in", 10.0, 0.0, 8.0, 0.0, False), ("out", 50.0, 0.0, 48.0, 1.0, True)], "gate string, x double, y double, inner_x double, inner_y double, outer boolean")
    rows = [(1, 1, 10.9, 0.0, 10.0, 0.0, 90.0), (1, 2, 11.2, 0.0, 10.0, 0.0, 90.0), (2, 1, 11.2, 0.0, 9.0, 0.0, 90.0), (3, 1, 50.4, 0.5, 48.0, 0.5, 80.0), (4, 1, 50.4, 0.5, 48.0, 0.5, 10.0), (5, 1, 49.9, 0.5, 48.0, 0.5, 90.0)]
    steps = spark.createDataFrame(rows, "who int, t int, x double, y double, on_x double, on_y double, heading double")
    got = {(r.who, r.t): (r.gate, round(r.beyond, 6)) for r in entering.leaves_by_gate(steps, gates, "who").collect()}
    assert got == {(1, 2): ("in", 1.2), (3, 1): ("out", 1.0)}


def test_reports_are_written_once(spark):
    rows = [(k, s, i * 10**9, "door" if k == "events" else None, 1.0, 2.0, 0.5, 3, 1.5) for i, (k, s) in enumerate([("events", 1), ("track", 1), ("track", 2), ("misses", 1), ("confirmed", 2), ("other", 1)] * 3)]
    schema = "kind string, session long, t long, said string, x double, y double, miss double, held long, seconds double"
    files = tables.in_parts(spark.createDataFrame(rows, schema), graph.new_path(spark, "replay"), "session", "t", 2)
    path = graph.new_path(spark, "reports")
    for _ in range(2):  # a second run of the same query finds nothing new
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(files)
        reports.write_reports(stream, path, f"{path}-state").awaitTermination()
    assert {k: reports.read_report(spark, path, k).count() for k in reports.KINDS} == {"events": 3, "track": 6, "misses": 3, "confirmed": 3}
    assert sorted((r.session, r.value) for r in reports.read_report(spark, path, "events").collect()) == [(1, "    0.00  door"), (1, "    6.00  door"), (1, "   12.00  door")]
    assert {tuple(r)[:4] for r in reports.read_report(spark, path, "confirmed").collect()} == {(2, t * 10**9, 3, 1.5) for t in (4, 10, 16)}
    assert not math.isnan(reports.read_report(spark, path, "misses").first().miss)
