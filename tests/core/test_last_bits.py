"""Where the last bit of a number decides, queries and operators agree with their SQL."""

import math

from pyspark.sql import functions as F

from trailmark import plans
from trailmark.functions import geo
from trailmark.operators import motion
from trailmark.streaming.machines import step_detector
from trailmark.streaming.run import run_batch


def test_minutes_of_exact_sums(spark, tmp_path):
    prices = [2669.0, 1555.0, 860.0, 385.0, 531.0]
    floating = 0.0
    for p in prices:
        floating += p / 100
    assert floating > 60  # 60.00000000000001 in this order, though the prices make 6000
    rows = [(k, 1, p) for k in range(4) for p in (prices if k % 2 else prices[::-1])]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {tuple(r) for r in plans.QUERIES["q_a06_route_minutes"](spark, str(tmp_path)).collect()} == {(k, 1, 1) for k in range(4)}


def test_averages_as_sql_says_them(spark):
    rows, fast, slow, want = [], 9.81, 9.81, []
    for i in range(400):
        v = (i * 7919 % 4001) / 100
        rows.append(("a", i * 10**9, v))
        fast, slow = fast + 0.25 * (v - fast), slow + 0.02 * (v - slow)
        want.append(fast - slow)
    got = run_batch(spark.createDataFrame(rows, "user string, t long, value double"), "user", step_detector()).collect()
    assert len(got) > 5 and all(r.peak in (want[r.t // 10**9], want[r.t // 10**9 + 1]) for r in got)


def test_directions_of_whole_degrees(spark):
    got = spark.range(360).select("id", geo.of_degrees(math.sin, F.col("id")).alias("s"), geo.of_degrees(math.cos, F.col("id")).alias("c")).collect()
    assert all((r.s, r.c) == (math.sin(math.radians(r.id)), math.cos(math.radians(r.id))) for r in got)


def test_stair_score_of_zero(spark):
    rows = spark.range(15).selectExpr("1 as who", "id as t", "case when id = 12 then 0.0D else 2.0D end as spread", "case when id = 13 then 0.0D else 3.0D end as ratio")
    got = {r.t: r.score for r in motion.stair_scores(rows, ["who"], ["t"], "spread", "ratio").collect()}
    assert (got[9], got[11], got[12], got[13], got[14]) == (None, 0.0, -math.inf, math.inf, 0.0)
