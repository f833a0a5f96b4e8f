"""Stairs: which part of a flight of stairs each step is on, on which floor, when a descent begins, and the lines that routes draw there.

A climb is read off its headings alone: straight stretches are flights, turns between them landings. What is particular to a stair (its
treads, its floors, which turn leads up) comes from tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import wrapped

# Degrees of a step that turns, of a turn that leaves the stairs, and of one that is a landing's.
TURNING, OFF, LANDING = 10.0, 45.0, 135.0
# Steps after which a first flight is a corridor, and steps past its treads after which a second one is.
LONGEST, PAST = 24, 3
# Steps a descent waits at most, the score that looks like stairs, and of how many last scores how many must.
WAIT, LIKE_STAIRS, OF_LAST, AGREE = 10, 0.4, 3, 2
# Fixed value: the share of the second flight that a line downwards goes on.
LEAD = 0.35


def climb_paths(steps: DataFrame, stairs: DataFrame, key: str) -> DataFrame:
    """key, climb, seq, part, progress and floor of every step of steps(key, climb, seq, heading).

    stairs(key, climb, floor, treads, lowest, highest, learnt, told): where the climb begins, the treads of one of its flights, and the turn
    (1 right, -1 left) that leads up, as learnt and as told; both may be null. Parts go FIRST, LANDING, SECOND,
    FLOOR_LANDING and round again. A turn lasts until two steps in a row are straight; it is a landing from 135 degrees on.
    Progress is the share of a flight's treads, or of half a turn. The floor changes with each landing between flights: up at the lowest
    floor, down at the highest, else as the first landing's side says by what was learnt, then told, else up.
    From a turn of 45 to 135 degrees, a floor landing to the other side, a first flight of more than 24 steps or a second one
    three steps past its treads, the part is LEFT and the progress 0.
    """
    order = Window.partitionBy(key, "climb").orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = steps.select(key, "climb", "seq", "heading").withColumn("_t", F.coalesce(wrapped(F.col("heading") - F.lag("heading").over(order)), F.lit(0.0)))
    rows = rows.withColumn("_turns", F.abs("_t") > TURNING).withColumn("_bend", F.col("_turns") | F.coalesce(F.lag("_turns").over(order), F.lit(False)))
    rows = rows.withColumn("_begins", F.coalesce(F.col("_bend") != F.lag("_bend").over(order), F.lit(True))).withColumn("_island", F.sum(F.col("_begins").cast("int")).over(upto))
    island = Window.partitionBy(key, "climb", "_island")
    rows = rows.withColumn("_angle", F.sum("_t").over(island)).withColumn("_turned", F.sum("_t").over(island.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_landing", F.col("_bend") & (F.abs("_angle") >= LANDING)).withColumn("_k", F.sum((F.col("_landing") & F.col("_begins")).cast("int")).over(upto))
    rows = rows.withColumn("_side", F.when(F.col("_landing"), F.signum("_angle")))
    side = F.first("_side", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    leg = Window.partitionBy(key, "climb", "_k", "_landing").orderBy("seq")
    rows = rows.withColumn("_first_side", side).withColumn("_n", F.row_number().over(leg)).join(stairs, [key, "climb"])
    second = F.col("_k") % 2 == 1
    leaves = F.col("_bend") & ~F.col("_landing") & (F.abs("_angle") > OFF)
    leaves = leaves | (F.col("_landing") & ~second & (F.col("_side") != F.col("_first_side")))
    leaves = leaves | (~F.col("_landing") & F.when(second, F.col("_n") >= F.col("treads") + PAST).otherwise(F.col("_n") > LONGEST))
    rows = rows.withColumn("_left", F.max(leaves.cast("int")).over(upto) == 1)
    up = F.when(F.col("floor") <= F.col("lowest"), 1).when(F.col("floor") >= F.col("highest"), -1).otherwise(F.coalesce(F.col("_first_side") * F.col("learnt"), F.col("_first_side") * F.col("told"), F.lit(1)))
    changes = F.floor(F.when(F.col("_landing"), F.col("_k")).otherwise(F.col("_k") + 1) / 2)
    part = F.when(F.col("_landing"), F.when(second, "LANDING").otherwise("FLOOR_LANDING")).when(second, "SECOND").otherwise("FIRST")
    progress = F.least(F.lit(1.0), F.when(F.col("_landing"), F.abs("_turned") / 180).otherwise(F.col("_n") / F.col("treads")))
    at = F.greatest(F.col("lowest"), F.least(F.col("highest"), F.col("floor") + up * changes)).cast("int")
    rows = rows.withColumn("_at", at)
    # who has left stays on the floor that the last step on the stairs had
    kept = F.coalesce(F.last(F.when(~F.col("_left"), F.col("_at")), ignorenulls=True).over(upto), F.col("floor").cast("int"))
    return rows.select(key, "climb", "seq", F.when(F.col("_left"), "LEFT").otherwise(part).alias("part"), F.when(F.col("_left"), 0.0).otherwise(progress).alias("progress"), kept.alias("floor"))


def held_descents(steps: DataFrame, key: str) -> DataFrame:
    """key, climb, seq and why of the step with which a descent begins: steps(key, climb, seq, score), score the likeness to stairs, or null.

    It begins once two of the last three scores are like stairs ("gait"), at the eleventh step at the latest ("patience"), and at once
    where a step has no score ("blind"). Climbs that end before have no row.
    """
    w = Window.partitionBy(key, "climb").orderBy("seq")
    like = F.sum(F.when(F.col("score") >= LIKE_STAIRS, 1).otherwise(0)).over(w.rowsBetween(1 - OF_LAST, 0))
    why = F.when(F.col("score").isNull(), "blind").when(like >= AGREE, "gait").when(F.row_number().over(w) > WAIT, "patience")
    found = steps.select(key, "climb", "seq", why.alias("why")).where("why is not null")
    return found.groupBy(key, "climb").agg(F.min(F.struct("seq", "why")).alias("_f")).select(key, "climb", "_f.seq", "_f.why")


def stair_lines(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """a, b, variant, line and metres: what a route draws on a's floor once it goes from a to b by the stairs, one line per variant.

    edges(a, b, stair, floor_a, floor_b, x, y): both directions, x and y where a is. paths(stair, floor, variant, points): of a floor the foot and
    the end of the flight, the start of the next flight and its end: four points(x, y); others are left out. Upwards the line
    goes along the flight and over the landing; downwards it comes from the other end and leads a part of the second flight on. A
    place beside the stairs is joined at a right angle to the flight.
    """
    up = F.col("floor_a") < F.col("floor_b")
    p = lambda i: F.get("points", F.lit(i))
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    pick = lambda a, b: F.when(up, p(a)).otherwise(p(b))
    foot, turn = pick(0, 3), pick(1, 2)
    rows = edges.where("floor_a <> floor_b").join(paths.where(F.size("points") == 4), (edges["stair"] == paths["stair"]) & (edges["floor_a"] == paths["floor"])).drop(paths["stair"])
    rows = rows.withColumns({"_foot": foot, "_turn": turn})
    corner = F.when(F.abs(F.col("_foot.x") - F.col("_turn.x")) < F.abs(F.col("_foot.y") - F.col("_turn.y")), at(F.col("_foot.x"), F.col("y"))).otherwise(at(F.col("x"), F.col("_foot.y")))
    beside = (F.abs(F.col("x") - F.col("_foot.x")) >= 1e-4) | (F.abs(F.col("y") - F.col("_foot.y")) >= 1e-4)
    lead = at(p(1)["x"] + (p(0)["x"] - p(1)["x"]) * LEAD, p(1)["y"] + (p(0)["y"] - p(1)["y"]) * LEAD)
    line = F.concat(F.when(beside, F.array(corner, F.col("_foot"))).otherwise(F.array(F.col("_foot")).cast("array<struct<x:double,y:double>>")), F.when(up, F.array(p(1), p(2))).otherwise(F.array(p(2), p(1), lead)))
    rows = rows.withColumn("line", line)
    return rows.select("a", "b", "variant", "line", length(F.col("line")).alias("metres"))


def length(line: Column) -> Column:
    """Metres of a line given as an array of points."""
    legs = F.arrays_zip(F.slice(line, 1, F.size(line) - 1).alias("p"), F.slice(line, 2, F.size(line) - 1).alias("q"))
    return F.aggregate(legs, F.lit(0.0), lambda m, s: m + F.hypot(s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]))
