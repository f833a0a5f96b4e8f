"""Operators against hand cases and invariants, with nulls, ties and empty tables."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from trailmark.functions import geo, text
from trailmark.operators import agenda, graph, motion, search, timetable
from trailmark.sources import readers, tables
from trailmark.streaming.machines import position_filter, step_detector
from trailmark.streaming.run import run_batch


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_rooms(spark):
    day = spark.createDataFrame([("A", 480, 600), ("A", 540, 570), ("A", 600, 720), ("A", 735, 780), ("B", 480, 500)], "room string, st int, en int")
    at = lambda t: {r.room: (r.busy, r.until) for r in timetable.room_status(day, ["room"], t).collect()}
    assert at(555) == {"A": (True, 720), "B": (False, None)} and at(720)["A"] == (False, 735) and at(479)["B"] == (False, 480)
    assert {r.room for r in timetable.free_rooms(day, ["room"], 720, 30).collect()} == {"B"}
    assert timetable.busy_islands(day.where("false"), ["room"]).count() == 0


def test_crowd(spark):
    people = lambda k, n, b: one(spark, timetable.people(F.lit(k), F.lit(n), F.lit(b)).alias("x")).x
    assert people("LECTURE", 1, False) == 32 and people("LECTURE", 2, False) == 64 and people("EXERCISE", 3, False) == pytest.approx(12.8) and people("EXERCISE", 1, True) == pytest.approx(6.4)
    low, high = one(spark, timetable.crowd_factor(F.lit(0)).alias("a"), timetable.crowd_factor(F.lit(1e9)).alias("b"))
    assert low == 1 and high == pytest.approx(1.3)


def test_calendar(spark):
    days = spark.sql("select explode(sequence(date'2026-11-09', date'2027-01-05')) as date")
    terms = spark.createDataFrame([("winter", "2026-10-01", "2027-01-20")], "kind string, start string, end string").withColumns({c: F.to_date(c) for c in ("start", "end")})
    rows = [("2026-11-11", None, "OFF", None), ("2026-11-14", None, "MAKEUP", 3), ("2026-12-28", None, "INFO", None), ("2027-01-04", "2027-01-05", "MAKEUP", 5), ("2027-01-04", None, "OFF", None)]
    special = spark.createDataFrame(rows, "start string, end string, type string, as_day int").withColumns({c: F.to_date(c) for c in ("start", "end")})
    got = {str(r.date): r.teaching_day for r in timetable.day_dimension(days, terms, special).collect()}
    assert (got["2026-11-11"], got["2026-11-14"], got["2026-11-15"], got["2026-12-28"], got["2027-01-04"], got["2027-01-05"]) == (None, 3, None, 1, 5, 5)


def test_departures(spark):
    items = spark.createDataFrame([(1, 1, 615, 720, "A1", 3), (1, 2, 730, 800, "A1", 2), (1, 3, 800, 860, "B", 2), (2, 1, 615, 720, "A1", 58), (2, 2, 700, 710, None, 0)], "person int, item long, st int, en int, place string, minutes int")
    got = {(r.person, r.item): r for r in agenda.departures(agenda.with_previous(items, ["person"])).collect()}
    first = got[1, 1]
    assert (first.leave_at, first.notify_at, first.reminder_at, first.first_of_day) == (612, 555, 607, True)
    assert (1, 2) not in got and (got[1, 3].leave_at, got[1, 3].notify_at, got[1, 3].prev_item) == (798, 800, 2)
    assert (got[2, 1].notify_at, got[2, 1].reminder_at) == (552, None) and not got[2, 2].first_of_day


def test_search(spark):
    assert one(spark, text.search_key(F.lit("Svečana Sala-Đ9")).alias("k")).k == "svecanasaladj9"
    names = spark.createDataFrame([(1, "Svečana sala", None, None), (2, "AH9", ["H9"], ["Nastavni blok", "NB"]), (3, "101", None, ["Nastavni blok", "NB"]), (4, "101", None, ["Kula"])], "name_id int, name string, aliases array<string>, context array<string>")
    asked = spark.createDataFrame([(1, "sala svecana"), (2, "h9"), (3, "nastavni 101"), (4, ""), (5, "sve")], "query_id int, query string")
    got = {}
    for r in search.search(names, asked).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.name_id, r["rank"]))
    assert got == {1: [(1, 2)], 2: [(2, 0)], 3: [(3, 3)], 4: [(i, 0) for i in (1, 2, 3, 4)], 5: [(1, 1)]}


def test_group_notes(spark):
    g = lambda s: one(spark, text.parse_groups(F.lit(s)).alias("g")).g
    assert g("СВИ")["all"] and g("Опредељени").elective and g("1,3").numbers == [1, 3] and not g("1,3").biweekly
    assert (g("1(2)").numbers, g("1(2)").biweekly, g("1(1-16)").numbers, g("1(1-16)").biweekly) == ([1, 2], True, [1], False)
    assert g("2 парне нед.").biweekly and g("(непарне недеље) 3").biweekly and not g("парне 4").biweekly and not g("нед. парне").biweekly
    assert g("5 св.др.нед.").biweekly and g("ЕП, ММ").areas == ["EP", "MM"]
    notes = F.array(F.lit("Стручна област (ЕП) групе број 11,12,13"), F.lit("Група број 1 је стручна област (УС)"), F.lit("без"))
    assert one(spark, text.area_groups(notes).alias("m")).m == {"EP": [11, 12, 13], "US": [1]}
    assert one(spark, text.latinised(F.lit("Љубав ЊЕГОШ џак")).alias("x")).x == "Ljubav NJEGOŠ džak"


def test_geometry(spark):
    rng = random.Random(1)
    square = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))])
    points = spark.createDataFrame([(rng.uniform(-2, 6), rng.uniform(-2, 6)) for _ in range(100)], "x double, y double")
    for r in points.select("x", "y", geo.in_ring(F.col("x"), F.col("y"), square).alias("i"), geo.ring_distance(F.col("x"), F.col("y"), square).alias("d")).collect():
        inside = 0 < r.x < 4 and 0 < r.y < 4
        assert r.i == inside
        dx, dy = max(-r.x, 0, r.x - 4), max(-r.y, 0, r.y - 4)
        assert r.d == pytest.approx(min(r.x, 4 - r.x, r.y, 4 - r.y) if inside else math.hypot(dx, dy))
    assert one(spark, geo.ring_distance(F.lit(1.0), F.lit(1.0), F.array().cast("array<array<double>>")).alias("d")).d == math.inf
    wrap = [one(spark, geo.wrapped(F.lit(a)).alias("w")).w for a in (190, -190, 540, 0)]
    assert wrap == [-170, 170, -180, 0]


def test_routes_agree_with_plain_search(spark):
    rng = random.Random(4)
    arcs = [(a, b, float(rng.randint(1, 20)), rng.choice([None, None, "S1", "S2"]), b % 6 == 5) for a in range(18) for b in rng.sample(range(18), 3) if a != b]
    best = {}
    for source in (0, 1):
        todo, seen = [(0.0, 0.0, source, None)], {}
        while todo:
            todo.sort(key=lambda s: s[0])
            price, took, node, last = todo.pop(0)
            if (node, last) in seen:
                continue
            seen[node, last] = (price, took)
            if node == 17:
                continue
            for a, b, c, v, room in arcs:
                if a == node and (not room or b == 17):
                    todo.append((price + c + (20 if v and last and v != last else 0), took + c, b, v or last))
        ends = [x for (n, _), x in seen.items() if n == 17]
        if ends:
            best[source] = min(ends)[0]
    df = spark.createDataFrame(arcs, "a int, b int, cost double, vertical string, room_b boolean")
    asked = spark.createDataFrame([(0, 0, 17), (1, 1, 17)], "request int, source int, target int")
    got = {r.request: r for r in graph.routes(df, asked).collect()}
    assert set(got) == set(best)
    cost = {(a, b): c for a, b, c, _, _ in arcs}
    for s, r in got.items():
        assert r.path[0] == s and r.path[-1] == 17 and r.seconds == pytest.approx(sum(cost[p] for p in zip(r.path, r.path[1:], strict=False)))
        changes = [v for p in zip(r.path, r.path[1:], strict=False) for a, b, _, v, _ in arcs if (a, b) == p and v]
        assert r.seconds + 20 * sum(x != y for x, y in zip(changes, changes[1:], strict=False)) == pytest.approx(best[s])


def test_instructions(spark):
    path = [(1, 0, 0.0, 0.0, 0, "WALK"), (1, 1, 10.0, 0.0, 0, "WALK"), (1, 2, 10.0, 10.0, 0, "STAIRS"), (1, 3, 10.0, 10.0, 1, "STAIRS"), (1, 4, 10.0, 10.0, 2, "WALK"), (1, 5, 10.0, 30.0, 2, "WALK")]
    got = graph.instructions(spark.createDataFrame(path, "route int, pos int, x double, y double, floor int, kind string")).orderBy("seq").collect()
    assert [(r.action, r.metres) for r in got] == [("start", 0.0), ("right", 10.0), ("up", 10.0), ("arrive", 20.0)]
    assert sum(r.metres for r in got) == 40


def test_components_and_ends(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (9, 8), (7, 7)], "a int, b int")
    assert {r.id: r.component for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    assert {r.id: r.depth for r in graph.dead_ends(e).collect()} == {5: 0, 4: 1, 8: 0, 9: 0}
    assert graph.components(e.where("false")).count() == 0


def test_steps_and_lift(spark):
    rows = [("s", i * 20_000_000, 9.81 + 3 * max(0.0, math.sin(2 * math.pi * i / 25))) for i in range(500)]
    steps = run_batch(spark.createDataFrame(rows, "user string, t long, value double"), "user", step_detector()).collect()
    assert 17 <= len(steps) <= 21 and all(r.peak > 0.6 for r in steps)
    ride = [("a", i, v, 0) for i, v in enumerate([0.0] * 4 + [0.5] * 6 + [0.0] * 4 + [-0.5] * 6 + [0.0] * 3)]
    height = motion.height_gain(spark.createDataFrame(ride, "k string, i int, a double, s int").where("i between 3 and 20"), ["k"], ["i"], "a", 0.5).first().height
    assert height == pytest.approx(7.5, abs=0.6)
    storeys = lambda h: one(spark, motion.storeys(F.lit(h), F.lit(0), F.lit(0), F.lit(4)).alias("n")).n
    assert (storeys(7.5), storeys(5.6), storeys(0.5)) == (2, None, None)


def test_readers(spark, tmp_path):
    plan = {"buildingId": "X", "floors": [0], "entranceId": "E", "extra": 1, "nodes": [{"id": "E", "floor": 0, "x": 0.1, "y": 0.5, "type": "ULAZ"}], "edges": [["E", "C", "HOD", "STEPS"], ["C", "S", "STEPENICE"]], "campusLinks": [["K", "E"]]}
    (tmp_path / "p.json").write_text(json.dumps(plan))
    p = readers.plans(spark, str(tmp_path / "p.json"))
    assert readers.plan_nodes(p).first().kind == "ULAZ"
    assert sorted((r.a, r.b, r.kind, r.steps) for r in readers.plan_edges(p).collect()) == [("C", "S", "STAIRS", False), ("E", "C", "WALK", True), ("K", "E", "WALK", False)]
    lines = ["A,5,1.0,2.0,3.5", "R,6,1,0,0,0,1,0,0,0,1", "L,7,RUCNO,NB,2,0.1,0.2", "S,8,90.5,2,1,0,1.7", "X,9,a,b", "", "?,zz"]
    rows = readers.recording(spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "session string, line int, value string")).orderBy("line").collect()
    assert (rows[0].x, rows[0].z, rows[1].m[8], rows[2].building, rows[2].floor, rows[3].redo, rows[3].peak, rows[4].text, rows[6].t_ns) == (1.0, 3.5, 1.0, "NB", 2, 2, 1.7, "a,b", None)
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, tables.upsert(old, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert tables.seed_if_empty(spark, new, str(tmp_path / "t")).count() == tables.seed_if_empty(spark, old, str(tmp_path / "t")).count() == 2


def test_long_chains_are_finished(spark):
    last = 70
    chain = spark.range(last).selectExpr("int(id) as a", "int(id + 1) as b", "1.0D as cost", "cast(null as string) as vertical", "false as room_b")
    starts = spark.createDataFrame([(0, 0)], "request int, node int")
    assert {r.node: r.cost for r in graph.shortest_times(chain, starts).collect()} == {n: float(n) for n in range(last + 1)}
    asked = spark.createDataFrame([(0, 0, last)], "request int, source int, target int")
    assert [(r.seconds, r.path) for r in graph.routes(chain, asked).collect()] == [(float(last), list(range(last + 1)))]
    # a chain of 35 on a triangle: one node goes a round
    branch = spark.range(35).selectExpr("int(id) as a", "int(id + 1) as b").union(spark.createDataFrame([(35, 90), (90, 91), (91, 35)], "a int, b int"))
    assert {r.id: r.depth for r in graph.dead_ends(branch).collect()} == {n: n for n in range(35)}


def test_negative_cycles_raise(spark):
    arcs = spark.createDataFrame([(0, 1, 1.0, None, False), (1, 0, -2.0, None, False)], "a int, b int, cost double, vertical string, room_b boolean")
    with pytest.raises(ValueError, match="negative"):
        graph.shortest_times(arcs, spark.createDataFrame([(0, 0)], "request int, node int"))
    with pytest.raises(ValueError, match="negative"):
        graph.routes(arcs, spark.createDataFrame([(0, 0, 9)], "request int, source int, target int"))


def test_position_filter_passes_over_poor_fixes(spark):
    rows = [(1, "fix", 5.0, 5.0, 80.0), (2, "fix", 10.0, 10.0, 5.0), (3, "step", 1.0, 0.0, None), (4, "fix", 14.0, 10.0, 5.0), (5, "fix", 90.0, 90.0, 31.0), (6, "fix", -4.0, 10.0, 3.0), (7, "step", 0.0, 1.0, None)]
    rows += [(8 + i, "fix", 60.0, 60.0, 3.0) for i in range(5)]
    df = spark.createDataFrame([("a", *r) for r in rows], "user string, t long, kind string, x double, y double, accuracy double")
    got = run_batch(df, "user", position_filter(area=(100.0, 100.0))).orderBy("t").collect()
    assert [r.said for r in got] == ["start", "step", "fix", "passed over", "passed over", "step", *["outlier"] * 4, "jump"]
    k = 25.5 / 50.5  # variance of the place over both
    assert got[2].x == pytest.approx(11 + k * 3) and got[2].var == pytest.approx(25.5 * (1 - k)) and (got[4].x, got[4].y) == (got[2].x, got[2].y)
    assert (got[5].x, got[5].y) == (pytest.approx(got[2].x), 11.0) and (got[-1].x, got[-1].y, got[-1].var) == (60.0, 60.0, 9.0)
