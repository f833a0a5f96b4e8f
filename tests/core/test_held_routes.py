"""Routes that are searched back from their targets, against rounds of joins and at the end of long chains."""

import random
import time

from trailmark.operators import graph


def test_as_by_rounds_of_joins(spark, monkeypatch):
    rng = random.Random(11)
    arcs = []
    for a in range(9):
        for b in rng.sample([x for x in range(9) if x != a], 3):
            v = rng.choice([None, "S", "T"])
            arcs.append((a, b, rng.uniform(1, 30), v, b == 7, b in (3, 4), "B" + str(a % 3), "B" + str(b % 3), v == "S" and a % 2 == 0, "B1" if v == "T" else None))
    df = spark.createDataFrame(arcs, "a int, b int, cost double, vertical string, room_b boolean, passage_b boolean, building_a string, building_b string, uncommon boolean, transit string")
    asked = spark.createDataFrame([(10 * s + t, s, t, "B" + str(s % 3), "B" + str(t % 3)) for s in range(9) for t in (0, 5, 7)] + [(99, 0, 50, "B0", "B0")], "request int, source int, target int, source_building string, target_building string")
    rows = lambda: {r.request: (round(r.price, 9), round(r.seconds, 9), tuple(r.path)) for r in graph.routes(df, asked).collect()}
    held = rows()
    monkeypatch.setattr(graph, "HELD_ARCS", 0)
    assert held == rows() and len(held) > 20


def test_many_near_targets_on_long_chains(spark):
    links = spark.range(20_000).selectExpr("id as a", "id + 1 as b").where("a % 5000 <> 4999")
    arcs = links.union(links.select("b", "a")).selectExpr("a", "b", "1.0D as cost", "cast(null as string) as vertical", "b = 9002 as room_b")
    asked = spark.range(0, 20_000, 10).selectExpr("id as request", "id as source", "id + 4 as target")
    began = time.time()
    got = {r.request: (r.seconds, r.path) for r in graph.routes(arcs, asked).collect()}
    # 9000 to 9004 leads through a room
    assert got == {i: (4.0, list(range(i, i + 5))) for i in range(0, 20_000, 10) if i != 9000} and time.time() - began < 60
