"""Routes in words: twelve kinds of step, with floors, sides and metres to the next one. All routes run in the same sorts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import written

# Fixed values, indoors and outdoors: metres a point may lie off the straight line, degrees that count as a turn, and metres within which turns are one.
OFF_LINE, TURN, MERGE = (1.0, 3.0), (35.0, 45.0), (4.0, 12.0)
# Degrees that turn back, metres before stairs and lifts within which turns are left out, metres of a landing between flights, degrees that are ahead of a door.
BACK, APPROACH, LANDING, AHEAD = 150.0, 4.0, 15.0, 30.0
OUTSIDE, PASSAGE = "OUT", "PASSAGE"


def straight_points(x: np.ndarray, y: np.ndarray, halt: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which points of many lines stay so that none lies more than off beside its line: the farthest point splits a stretch, again and again.

    halt marks points that stay anyway, the first and last of each line among them; off is by point. All stretches of all lines are
    split together, so the rounds are as many as a line is deep, whatever the number of lines.
    """
    keep, at = halt.copy(), np.arange(len(x))
    while len(x):
        ends = np.flatnonzero(keep)
        a = ends[np.cumsum(keep) - 1]
        b = ends[np.minimum(np.searchsorted(ends, at), len(ends) - 1)]
        dx, dy, px, py = x[b] - x[a], y[b] - y[a], x - x[a], y - y[a]
        square = dx * dx + dy * dy
        t = np.clip(np.divide(px * dx + py * dy, square, out=np.zeros(len(x)), where=square > 0), 0, 1)
        far = np.where(keep, -1.0, np.hypot(px - t * dx, py - t * dy))
        worst = np.maximum.reduceat(far, ends)[np.cumsum(keep) - 1]
        split = np.flatnonzero((far == worst) & (far > off) & ~keep)
        if not len(split):
            return keep
        keep[split[np.diff(a[split], prepend=-1) != 0]] = True  # of equally far points of a stretch, the first
    return keep


def _kept(key: str):
    """Rows (key, pos) in order, many routes a batch, to those that stay; a route that a batch cuts off waits for the rest."""

    def simplify(rows: pa.Table) -> pa.Table:
        number = np.asarray(rows[key].combine_chunks().dictionary_encode(null_encoding="encode").indices)
        new = np.diff(number, prepend=-1) != 0
        x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
        outdoor = np.asarray(pa.compute.fill_null(pa.compute.equal(rows["place"], OUTSIDE), False).to_numpy(), bool)
        walk = np.asarray(pa.compute.fill_null(pa.compute.equal(rows["kind"], "WALK"), False).to_numpy(), bool)
        before = lambda v: np.concatenate([v[:1], v[:-1]])
        halt = new | np.concatenate([new[1:], [True]]) | ~walk | ~before(walk) | (outdoor != before(outdoor))
        start = np.flatnonzero(halt)[np.cumsum(halt) - 1]  # a stretch has the bound of its first point
        stay = straight_points(x.astype(float), y.astype(float), halt, np.array(OFF_LINE)[outdoor[start].astype(int)])
        return rows.filter(pa.array(stay)).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(key)
            other = np.flatnonzero(~np.asarray(pa.compute.fill_null(pa.compute.equal(ids, ids[-1]), False).to_numpy(zero_copy_only=False), bool)) if ids[-1].is_valid else np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut == 0 and held and held[-1].column(key)[-1] != ids[0]:
                yield from simplify(pa.Table.from_batches(held)).to_batches()
                held = []
            if cut:
                yield from simplify(pa.Table.from_batches([*held, batch.slice(0, cut)])).to_batches()
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from simplify(pa.Table.from_batches(held)).to_batches()

    return run


def directions(path: DataFrame, key: str = "route") -> DataFrame:
    """key, seq, action, floor, side and metres of walking to the next step.

    path(key, pos, x, y, floor, kind, node, place, steps): a route's points in order. kind is the way to the next point (WALK, STAIRS or
    LIFT), steps whether a walk there has stairs, node the point's kind (ROOM, DOOR or other), place its building, OUT or PASSAGE.

    Actions: start or leave room; left, right and back; up, down and lift; flight; exit, enter and passage; arrive. Flights in one
    direction are one step, over landings too; floor is where they end. A passage is told where it leaves one building for another. Turns
    are taken from the simplified line, indoors and outdoors by other bounds; near ones are one, so a pair that cancels out
    vanishes, and those just before stairs or on their landings are left out. side, at the end: left, right or ahead, where the door of a room is.
    """
    order = Window.partitionBy(key).orderBy("pos")
    nxt = lambda c: F.lead(c).over(order)
    after = Window.partitionBy(key).orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    legs = path.select(key, "pos", "x", "y", "floor", "kind", "node", "place", F.coalesce("steps", F.lit(False)).alias("steps"))
    legs = legs.withColumn("_last", nxt("pos").isNull()).withColumn("_walk", F.when((F.col("kind") == "WALK") & nxt("pos").isNotNull(), F.hypot(nxt("x") - F.col("x"), nxt("y") - F.col("y"))).otherwise(0.0))
    legs = legs.withColumn("_rise", nxt("floor") - F.col("floor")).withColumn("_to", nxt("floor")).withColumn("_next", nxt("place"))
    legs = legs.withColumn("_upto", F.sum("_walk").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_walk"))
    # what is entered past a passage
    legs = legs.withColumn("_beyond", F.first(F.when(F.col("place") != PASSAGE, F.col("place")), ignorenulls=True).over(after))
    legs = written(legs, "route-legs")
    moves = legs.where(f"kind = 'WALK' and not _last and place <> '{PASSAGE}' and _next <> place and _beyond is not null and _beyond <> place")
    moves = moves.select(key, "pos", "_upto", F.when(F.col("_beyond") == OUTSIDE, "exit").when(F.col("place") == OUTSIDE, "enter").otherwise("passage").alias("action"), F.lit(None).cast("int").alias("floor"))
    flight = legs.where("kind = 'WALK' and steps and not _last and (_next = place)").select(key, "pos", "_upto", F.lit("flight").alias("action"), F.lit(None).cast("int").alias("floor"))
    lifts = legs.where("kind = 'LIFT' and not _last").select(key, "pos", "_upto", F.lit("lift").alias("action"), F.col("_to").cast("int").alias("floor"))
    stairs = legs.where("kind = 'STAIRS' and not _last")
    before = lambda c: F.lag(c).over(order)
    other = legs.withColumn("_halt", F.sum(F.when((F.col("kind") == "LIFT") | F.col("steps") | (F.col("_next") != F.col("place")), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stairs = stairs.join(other.select(key, "pos", "_halt"), [key, "pos"])
    one = (F.signum("_rise") == F.signum(before("_rise"))) & (F.col("_upto") - before("_upto") <= LANDING) & (F.col("_halt") == before("_halt"))
    stairs = stairs.withColumn("_g", F.sum(F.when(one, 0).otherwise(1)).over(order))
    stairs = stairs.groupBy(key, "_g").agg(F.min("pos").alias("pos"), F.max("pos").alias("_end"), F.min("_upto").alias("_upto"), F.max(F.struct("pos", "_to"))["_to"].cast("int").alias("floor"), F.sum("_rise").alias("_r"))
    flights = stairs.select(key, "pos", "_upto", F.when(F.col("_r") > 0, "up").otherwise("down").alias("action"), "floor")
    events = moves.unionByName(flight).unionByName(lifts).unionByName(flights)

    events = written(events, "route-events")
    line = legs.repartition(key).sortWithinPartitions(key, "pos").mapInArrow(_kept(key), legs.schema)
    heading = F.degrees(F.atan2(nxt("y") - F.col("y"), nxt("x") - F.col("x")))
    line = line.withColumn("_h", heading).withColumn("_bend", F.when((F.col("kind") == "WALK") & (before("kind") == "WALK") & ~F.col("_last"), (F.col("_h") - before("_h") + 540) % 360 - 180).otherwise(0.0))
    outdoor = (F.col("place") == OUTSIDE).cast("int")
    by = lambda v: F.get(F.array(*map(F.lit, v)), outdoor)
    bends = line.where("_bend <> 0").withColumn("_new", F.when(before("pos").isNull() | (F.col("_upto") - before("_upto") >= by(MERGE)), 1).otherwise(0))
    bends = bends.withColumn("_g", F.sum("_new").over(order)).withColumn("_least", by(TURN)).groupBy(key, "_g").agg(F.min("pos").alias("pos"), F.min("_upto").alias("_upto"), F.sum("_bend").alias("_a"), F.min(F.struct("pos", "_least"))["_least"].alias("_least")).where(F.abs("_a") >= F.col("_least"))
    turns = bends.select(key, "pos", "_upto", F.when(F.abs("_a") >= BACK, "back").when(F.col("_a") > 0, "right").otherwise("left").alias("action"), F.lit(None).cast("int").alias("floor"))
    # turns at other steps, on landings and just before stairs aren't told
    turns = turns.join(events.select(key, "pos").distinct(), [key, "pos"], "left_anti")
    near = events.where("action in ('up', 'down', 'lift', 'flight')").select(key, F.col("pos").alias("_p"), F.col("_upto").alias("_u"))
    ends = stairs.select(key, F.col("pos").alias("_from"), "_end")
    turns = turns.join(near, (turns[key] == near[key]) & (F.col("pos") < F.col("_p")) & (F.col("_u") - F.col("_upto") <= APPROACH), "left_anti")
    turns = turns.join(ends, (turns[key] == ends[key]) & (F.col("pos") > F.col("_from")) & (F.col("pos") <= F.col("_end")), "left_anti")
    # the door's side: between the walk to the corridor and the way to the door
    two, three = F.lag("node", 1).over(order), F.lag("node", 2).over(order)
    back = lambda c, n: F.lag(c, n).over(order)
    walked = F.degrees(F.atan2(back("y", 2) - back("y", 3), back("x", 2) - back("x", 3)))
    door = F.degrees(F.atan2(back("y", 1) - back("y", 2), back("x", 1) - back("x", 2)))
    off = (door - walked + 540) % 360 - 180
    side = F.when((F.col("node") == "ROOM") & (two == "DOOR") & three.isNotNull() & back("x", 3).isNotNull(), F.when(F.abs(off) < AHEAD, "ahead").when(off > 0, "right").otherwise("left"))
    door_from = legs.withColumn("_side", side).withColumn("_p", F.lag("pos", 2).over(order)).where("_last and _side is not null").select(key, "_p")
    turns = turns.join(door_from, (turns[key] == door_from[key]) & (F.col("pos") >= F.col("_p")), "left_anti")  # the door's side says it
    last = legs.withColumn("side", side).where("_last").select(key, "pos", "_upto", F.lit("arrive").alias("action"), F.col("floor").cast("int").alias("floor"), "side")
    first = legs.groupBy(key).agg(F.min(F.struct("pos", "node", "floor", "_last")).alias("_f")).where("not _f._last")
    first = first.select(key, F.col("_f.pos").alias("pos"), F.lit(0.0).alias("_upto"), F.when(F.col("_f.node") == "ROOM", "leave room").otherwise("start").alias("action"), F.col("_f.floor").cast("int").alias("floor"))
    every = first.unionByName(events).unionByName(turns).withColumn("side", F.lit(None).cast("string")).unionByName(last)
    rank = F.when(F.col("action").isin("start", "leave room"), 0).when(F.col("action") == "arrive", 2).otherwise(1)
    seq = Window.partitionBy(key).orderBy("pos", rank, "action")
    return every.select(key, F.row_number().over(seq).alias("seq"), "action", "floor", "side", F.coalesce(F.lead("_upto").over(seq) - F.col("_upto"), F.lit(0.0)).alias("metres"))


def next_manoeuvre(steps: DataFrame, key: str = "route") -> DataFrame:
    """Per route what comes next, and the metres to it: the second step after a start, else the first one, now. No row for a route of a start alone."""
    w = Window.partitionBy(key).orderBy("seq")
    told = steps.withColumn("_next", F.lead(F.struct("action", "floor", "side")).over(w)).where("seq = 1")
    start = F.col("action") == "start"
    told = told.withColumn("_s", F.when(start, F.col("_next")).otherwise(F.struct("action", "floor", "side"))).where("_s is not null")
    return told.select(key, "_s.action", "_s.floor", "_s.side", F.when(start, F.col("metres")).otherwise(0.0).alias("metres"))
