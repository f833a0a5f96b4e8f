"""Through doors, up stairs and along corridors: what a walker's last steps and fixes say about the place, by windows over sessions.

Doors are points with a direction inwards: doors(door, x, y, inx, iny), the direction of length 1. Steps have a session key, an
order t, the place x, y after the step and the step dx, dy in metres.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.geo import length, wrapped
from . import graph

# Metres from a door within which steps enter it, degrees off its direction (less for the door that was left last), and how many steps must agree.
DOOR_NEAR, DOOR_ANGLE, LEFT_DOOR_ANGLE, AGREEING = 4.0, 50.0, 30.0, 3
#: Degrees of a sector by which doors of a place are kept apart.
SECTOR = 10.0
# Steps of a dead-reckoned trail, metres it must end behind the door, and metres the place may be from the door then.
TRAIL, DEPTH, PLACE_NEAR = 15, 1.5, 9.0
# Metres to a gate that a fix leaves by, from the walls, of accuracy, and walked inside before a fix may end a stay.
GATE_NEAR, WALL, ACCURACY, WALKED = 8.0, 15.0, 10.0, 30.0
# Degrees off a corridor's axis within which a heading snaps to it, and the least length of such a corridor.
AXIS, SHORTEST = 35.0, 1.5
# Share of straight stairs after which the floor changes, and steps after a change within which a correction teaches its side.
CHANGE_AT, TAUGHT_WITHIN = 0.75, 80
# Steps of a flight, and degrees of turn between flights that change the floor.
FLIGHT, FLOOR_TURN = 6, 135.0


def _near_doors(rows: DataFrame, doors: DataFrame, metres: float) -> DataFrame:
    """rows(x, y, ...) with each door within so many metres: a row meets the doors of its grid cell, in whose nine cells a door stands."""
    about = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    d = doors.select(F.col("x").alias("_x"), F.col("y").alias("_y"), *[c for c in doors.columns if c not in ("x", "y")]).withColumn("_o", about)
    d = d.withColumn("_cx", F.floor(F.col("_x") / metres) + F.col("_o.i")).withColumn("_cy", F.floor(F.col("_y") / metres) + F.col("_o.j")).drop("_o")
    on = rows.withColumn("_cx", F.floor(F.col("x") / metres)).withColumn("_cy", F.floor(F.col("y") / metres)).join(d, ["_cx", "_cy", *[c for c in rows.columns if c in doors.columns and c not in ("x", "y")]])
    return on.withColumn("metres", length(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"))).where(F.col("metres") <= metres)


def _alike(doors: DataFrame, *columns: str) -> DataFrame:
    """Of doors that agree in x, y and columns the least alone, which wins over the others wherever one of them counts."""
    return doors.groupBy("x", "y", *columns).agg(F.min("door").alias("door"))


def enters_by_direction(steps: DataFrame, doors: DataFrame, key: str) -> DataFrame:
    """key, t, door and metres: steps after which the last three all point through a door nearby. Of several doors the nearest, then the least.

    A column left_door of steps names the door that the session left last, through which one returns only by a straighter way.
    """
    w = Window.partitionBy(key).orderBy("t").rowsBetween(1 - AGREEING, 0)
    last = steps.withColumn("_u", F.collect_list(F.struct("dx", "dy")).over(w)).where(F.size("_u") == AGREEING)
    # doors stand by their direction in sectors: a row meets those between the steps' directions less the angle, and none where these lie too far apart
    ahead = lambda a, b: F.floor((F.degrees(F.atan2(b, a)) + 360) / SECTOR)
    first = F.get("_u", F.lit(0))
    turn = F.transform("_u", lambda s: F.degrees(F.atan2(first["dx"] * s["dy"] - first["dy"] * s["dx"], first["dx"] * s["dx"] + first["dy"] * s["dy"])))
    at, slack = F.degrees(F.atan2(first["dy"], first["dx"])) + 360, DOOR_ANGLE + 1e-6
    last = last.where(F.forall("_u", lambda s: length(s["dx"], s["dy"]) > 0)).withColumn("_from", at + F.array_max(turn) - slack).withColumn("_upto", at + F.array_min(turn) + slack).where("_from <= _upto")
    last = last.withColumn("_s", F.explode(F.sequence(F.floor(F.col("_from") / SECTOR), F.floor(F.col("_upto") / SECTOR)))).withColumn("_s", F.pmod("_s", F.lit(int(360 / SECTOR)))).drop("_from", "_upto")
    alike = _alike(doors, "inx", "iny") if "left_door" not in steps.columns else doors
    places = alike.groupBy("x", "y", F.pmod(ahead(F.col("inx"), F.col("iny")), F.lit(int(360 / SECTOR))).alias("_s")).agg(F.collect_list(F.struct("door", "inx", "iny")).alias("_doors"))
    met = _near_doors(last, places, DOOR_NEAR).select("*", F.inline("_doors")).drop("_doors")
    cos = lambda s: (s["dx"] * F.col("inx") + s["dy"] * F.col("iny")) / length(s["dx"], s["dy"])
    least = F.cos(F.radians(F.when(F.col("left_door") == F.col("door"), LEFT_DOOR_ANGLE).otherwise(DOOR_ANGLE))) if "left_door" in steps.columns else F.cos(F.radians(F.lit(DOOR_ANGLE)))
    agree = [F.coalesce(cos(F.get("_u", F.lit(i))) >= least, F.lit(False)) for i in range(AGREEING)]
    for one in agree:
        met = met.where(one)
    best = met.groupBy(key, "t").agg(F.min(F.struct("metres", "door")).alias("_b"))
    return best.select(key, "t", F.col("_b.door").alias("door"), F.col("_b.metres").alias("metres"))


def enters_by_trail(steps: DataFrame, doors: DataFrame, key: str) -> DataFrame:
    """key, t, door and depth: steps after which a trail of the last fifteen steps alone, from the place before them, has gone through a door.

    The trail comes near the door and ends behind it, though the place itself is still outside, held there by fixes.
    """
    order = Window.partitionBy(key).orderBy("t")
    w = order.rowsBetween(1 - TRAIL, 0)
    rows = steps.withColumn("_s", F.collect_list(F.struct("dx", "dy")).over(w)).withColumn("_x0", F.lag("x", TRAIL).over(order)).withColumn("_y0", F.lag("y", TRAIL).over(order)).where("_x0 is not null")
    places = _alike(doors, "inx", "iny").groupBy("x", "y").agg(F.collect_list(F.struct("door", "inx", "iny")).alias("_doors"))
    reach = F.aggregate("_s", F.lit(0.0), lambda a, s: a + length(s["dx"], s["dy"]))
    met = _near_doors(rows.withColumn("_reach", reach + DOOR_NEAR + 1e-6), places, PLACE_NEAR)
    # the walk is folded once for the doors of a place, and only where it can come near
    met = met.where(length(F.col("_x0") - F.col("_x"), F.col("_y0") - F.col("_y")) <= F.col("_reach"))
    start = F.struct(F.col("_x0").alias("x"), F.col("_y0").alias("y"), F.lit(float("inf")).alias("near"))
    walk = F.aggregate("_s", start, lambda a, s: F.struct((a["x"] + s["dx"]).alias("x"), (a["y"] + s["dy"]).alias("y"), F.least(a["near"], length(a["x"] + s["dx"] - F.col("_x"), a["y"] + s["dy"] - F.col("_y"))).alias("near")))
    met = met.withColumn("_w", walk).where(F.col("_w.near") <= DOOR_NEAR).select(key, "t", "metres", "_x0", "_y0", "_x", "_y", "_w", F.inline("_doors")).withColumn("depth", (F.col("_w.x") - F.col("_x")) * F.col("inx") + (F.col("_w.y") - F.col("_y")) * F.col("iny"))
    began = (F.col("_x0") - F.col("_x")) * F.col("inx") + (F.col("_y0") - F.col("_y")) * F.col("iny")
    through = met.where((F.col("depth") >= DEPTH) & (began < 0))
    best = through.groupBy(key, "t").agg(F.min(F.struct("metres", "door", "depth")).alias("_b"))
    return best.select(key, "t", F.col("_b.door").alias("door"), F.col("_b.depth").alias("depth"))


def leaves_by_fix(outside: Column, wall: Column, accuracy: Column, floor_has_entrance: Column, on_stairs: Column, walked: Column) -> Column:
    """Whether a fix ends a stay in a building: agreed outside, far from its walls for its accuracy, exact, on a floor with an entrance, off stairs, after some way inside."""
    return F.coalesce(outside & (wall >= F.greatest(F.lit(WALL), accuracy)) & (accuracy <= ACCURACY) & floor_has_entrance & ~on_stairs & (walked >= WALKED), F.lit(False))


def exit_places(exits: DataFrame, gates: DataFrame, keys: list[str]) -> DataFrame:
    """exits(point, x, y, keys, fix_x, fix_y) with gate, and the place outside (out_x, out_y): the nearest of gates(id, x, y, keys) within reach, else the fix itself."""
    near = graph.nearest(exits, gates, keys, GATE_NEAR, most=GATE_NEAR).drop("distance")
    at = gates.select(F.col("id").alias("node"), F.col("x").alias("_gx"), F.col("y").alias("_gy"))
    return near.join(at, "node", "left").select(*exits.columns, F.col("node").alias("gate"), F.coalesce("_gx", "fix_x").alias("out_x"), F.coalesce("_gy", "fix_y").alias("out_y"))


def along_axis(heading: Column, axis: Column, length: Column) -> Column:
    """A heading in a corridor as the corridor's own direction, one way or the other, 0 to 360; null where it crosses or the corridor is short."""
    off = F.abs(wrapped(heading - axis))
    there = F.when(off <= AXIS, axis).when(off >= 180 - AXIS, axis + 180)
    return F.when(length >= SHORTEST, F.pmod(there, F.lit(360.0)))


def straight_stairs(steps: DataFrame, key: list[str], treads: str = "treads") -> DataFrame:
    """The step of each climb at which straight stairs change the floor: key, t and floor (from + 1 or - 1). A step takes two treads of the whole flight.

    steps(key, t, treads, up, floor): the steps of one climb in order; climbs that end before have no row.
    """
    w = Window.partitionBy(*key).orderBy("t")
    at = steps.withColumn("_p", F.row_number().over(w) / (2.0 * F.col(treads))).where(F.col("_p") >= CHANGE_AT)
    first = at.groupBy(*key).agg(F.min(F.struct("t", (F.col("floor") + F.when(F.col("up"), 1).otherwise(-1)).alias("floor"))).alias("_f"))
    return first.select(*key, "_f.t", "_f.floor")


def learnt_sides(changes: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """stair and up_turn by session: what manual corrections teach about which turn leads up.

    changes(key, n, building, stair, turn, from_floor): floor changes by turn (1 or -1) at step n; corrections(key, n, building, floor):
    places set by hand. A correction teaches about the last change before it, if that is at most 80 steps back, in the same
    building, and no other correction stands between; a later lesson takes the place of an earlier one.
    """
    c = changes.select(key, "n", F.lit(0).alias("_kind"), "building", "stair", "turn", "from_floor", F.lit(None).cast("int").alias("floor"))
    m = corrections.select(key, "n", F.lit(1).alias("_kind"), "building", F.lit(None).cast("string").alias("stair"), F.lit(None).cast("int").alias("turn"), F.lit(None).cast("int").alias("from_floor"), "floor")
    order = Window.partitionBy(key).orderBy("n", "_kind")
    prev = {c: F.lag(c).over(order).alias(f"_{c}") for c in ("n", "building", "stair", "turn", "from_floor")}
    both = c.unionByName(m).select(key, "n", "_kind", "building", "floor", *prev.values(), F.lag("_kind").over(order).alias("_before"))
    told = both.where(f"_kind = 1 and _before = 0 and n - _n <= {TAUGHT_WITHIN} and building = _building and floor <> _from_floor")
    up = F.when(F.col("floor") > F.col("_from_floor"), F.col("_turn")).otherwise(-F.col("_turn"))
    last = told.groupBy(key, F.col("_stair").alias("stair")).agg(F.max(F.struct("n", up.alias("u"))).alias("_l"))
    return last.select(key, "stair", F.col("_l.u").alias("up_turn"))


def floor_turns(runs: DataFrame, key: str) -> DataFrame:
    """Turns between flights that change the floor: key, run (the flight after the turn), turn (degrees, right is positive) and side (1 or -1).

    runs(key, run, n, heading, turned): stretches of like heading in order, with their steps and the turn added up so far. A flight is a
    run of six steps; the turn from one flight to the next counts from 135 degrees on.
    """
    order = Window.partitionBy(key).orderBy("run")
    flights = runs.where(F.col("n") >= FLIGHT)
    turn = F.col("turned") - F.lag("turned").over(order)
    found = flights.withColumn("turn", turn).where(F.abs("turn") >= FLOOR_TURN)
    return found.select(key, "run", "turn", F.signum("turn").cast("int").alias("side"))


def inferred_on_stairs(flights: DataFrame, stairs: DataFrame, keys: list[str], within: float = 5.0) -> DataFrame:
    """flights(point, x, y, keys): places where a flight, turn and flight, or a loop, began in a corridor, with the stair (id) within five metres that it must have been on."""
    near = graph.nearest(flights, stairs, keys, within, most=within)
    return near.where("node is not null").select(*flights.columns, F.col("node").alias("stair"), F.col("distance").alias("metres"))


# Metres inside the outline, metres from the door within which an entry waits, metres of slack before it, and metres from the door that cancel it.
INSIDE, WAITS, SLACK, CANCEL = 1.5, 6.0, 1.0, 12.0
# Metres from a gate and beyond it for the place on the network; metres from an outer door, beyond its wall, degrees off its direction and last steps of which one must lead out.
AT_GATE, BEYOND, OUTER_NEAR, OUTER_BEYOND, OUTER_ANGLE, OUTER_STEPS = 0.3, 1.0, 5.0, 0.3, 30.0, 3


#: Different doors up to which each task that walks through sessions holds all of them, 100 bytes a door.
HELD_DOORS = 1_000_000


def _held_outline(steps: DataFrame, doors: DataFrame, key: str) -> DataFrame:
    """enters_by_outline() with the doors in memory: no pair of step and door is written."""
    held = doors.where("x is not null and y is not null").toPandas().sort_values("door", kind="stable")
    given = steps.sparkSession.sparkContext.broadcast((held["door"].tolist(), *(held[c].to_numpy(float) for c in ("x", "y", "inx", "iny"))))
    kinds = dict(steps.dtypes) | {"door": dict(doors.dtypes)["door"]}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, gx, gy, inx, iny = given.value
        cells: dict[tuple, list[int]] = {}
        for i, cell in enumerate(zip((gx // CANCEL).tolist(), (gy // CANCEL).tolist(), strict=True)):
            cells.setdefault(cell, []).append(i)
        around: dict[tuple, np.ndarray] = {}
        # of each door: the last step near it, whether the stay has an entry that waits (and its metres), the way since, and whether it was made
        seen, waits, need, walked, done = np.full(len(ids), -1), np.zeros(len(ids), bool), np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), bool)
        n, who, any_yet = 0, None, False
        for batch in batches:
            keys = batch.column(key).to_pylist()
            x, y, dx, dy, depth = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y", "dx", "dy", "depth"))
            size = np.nan_to_num(np.sqrt(dx * dx + dy * dy)).tolist()
            cx, cy = (x // CANCEL).tolist(), (y // CANCEL).tolist()
            rows, told = [], []
            for r, k in enumerate(keys):
                n += 1
                if not any_yet or k != who:  # no step before it was near a door
                    n, who, any_yet = n + 1, k, True
                cell = (cx[r], cy[r])
                if cell not in around:
                    around[cell] = np.sort(np.array([i for a in (-1, 0, 1) for b in (-1, 0, 1) for i in cells.get((cell[0] + a, cell[1] + b), ())], int))
                i = around[cell]
                if not len(i):
                    continue
                ux, uy = x[r] - gx[i], y[r] - gy[i]
                metres = np.sqrt(ux * ux + uy * uy)
                near = metres <= CANCEL
                i, metres = i[near], metres[near]
                new = i[seen[i] != n - 1]
                waits[new] = done[new] = False
                seen[i] = n
                going = waits[i]
                walked[i] += size[r]
                able = going & ~done[i]
                able[able] = dx[r] * inx[i[able]] + dy[r] * iny[i[able]] >= 0
                if depth[r] >= INSIDE:
                    first = ~going & (metres <= WAITS)
                    j = i[first]
                    waits[j], need[j], walked[j] = True, metres[first] - SLACK, 0.0
                    able |= first
                made = able & (walked[i] >= need[i])
                if made.any():
                    i, metres = i[made], metres[made]
                    done[i] = True
                    rows.append(r)
                    told.append(ids[i[int(np.argmin(metres))]])
            whose = batch.select([key, "t"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*whose.columns, pa.array(told, door_type)], [key, "t", "door"])

    door_type = to_arrow_type(doors.schema["door"].dataType)
    rows = steps.select(key, "t", "x", "y", "dx", "dy", "depth").repartition(key).sortWithinPartitions(key, "t")
    return rows.mapInArrow(walk, f"{key} {kinds[key]}, t {kinds['t']}, door {kinds['door']}")


def enters_by_outline(steps: DataFrame, doors: DataFrame, key: str) -> DataFrame:
    """key, t, door: steps with which an entry that waited is made: steps(key, t, x, y, dx, dy, depth), depth in metres inside the outline.

    An entry begins 1.5 metres inside, where a door is within six metres, and is made when the way to the door is walked, but for a metre,
    with a step that doesn't lead out again. More than twelve metres from the door it is cancelled. Doors are looked at apart, each
    stay near one on its own; of several entries of a step the nearest door counts, then the least. Up to HELD_DOORS different doors are held by each
    task, which walks through its sessions step by step; more meet the steps by windows.
    """
    alike = graph.written(_alike(doors, "inx", "iny"), "doors")
    if alike.count() <= HELD_DOORS:
        return _held_outline(steps, alike, key)
    order = Window.partitionBy(key).orderBy("t")
    met = _near_doors(steps.withColumn("_n", F.row_number().over(order)), alike, CANCEL)
    w = Window.partitionBy(key, "door").orderBy("_n")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("_stay", F.sum(F.when(F.col("_n") - F.lag("_n").over(w) == 1, 0).otherwise(1)).over(upto))
    stay = Window.partitionBy(key, "door", "_stay").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    begins = (F.col("depth") >= INSIDE) & (F.col("metres") <= WAITS)
    met = met.withColumn("_from", F.first(F.when(begins, F.struct("_n", "metres")), ignorenulls=True).over(stay)).where("_from is not null")
    met = met.withColumn("_walked", F.sum(F.when(F.col("_n") > F.col("_from._n"), length(F.col("dx"), F.col("dy"))).otherwise(0.0)).over(stay))
    outwards = (F.col("_n") > F.col("_from._n")) & (F.col("dx") * F.col("inx") + F.col("dy") * F.col("iny") < 0)
    made = met.where((F.col("_walked") >= F.col("_from.metres") - SLACK) & ~outwards)
    first = made.groupBy(key, "door", "_stay").agg(F.min(F.struct("t", "metres")).alias("_m"))
    best = first.groupBy(key, F.col("_m.t").alias("t")).agg(F.min(F.struct(F.col("_m.metres").alias("m"), "door")).alias("_b"))
    return best.select(key, "t", F.col("_b.door").alias("door"))


def leaves_by_gate(steps: DataFrame, gates: DataFrame, key: str) -> DataFrame:
    """key, t, gate and beyond (metres past it): steps with which a walker has left: steps(key, t, x, y, on_x, on_y, heading).

    x, y is where steps lead, on_x, on_y the place on the network, heading in degrees on the plan. gates(gate, x, y, inner_x, inner_y, outer): the
    place before it on the network, and whether it is a building's own door. One leaves by a gate when the place on the network stands at it
    and the steps are a metre past it, along the last way or along the plan's axis; and by an outer door near both when they are
    past its wall and one of the last three steps leads out. The farthest beyond counts, then the least gate.
    """
    order = Window.partitionBy(key).orderBy("t")
    rows = steps.withColumn("_h", F.collect_list("heading").over(order.rowsBetween(1 - OUTER_STEPS, 0))).withColumnsRenamed({"x": "_fx", "y": "_fy", "on_x": "x", "on_y": "y"})
    ways = gates.select(F.col("gate").alias("door"), "x", "y", F.col("inner_x").alias("inx"), F.col("inner_y").alias("iny"), "outer")
    met = _near_doors(rows, _alike(ways, "inx", "iny", "outer"), OUTER_NEAR)
    dx, dy = F.col("_x") - F.col("inx"), F.col("_y") - F.col("iny")
    past = lambda a, b: ((F.col("_fx") - F.col("_x")) * a + (F.col("_fy") - F.col("_y")) * b) / length(a, b)
    flat = F.abs(dx) >= F.abs(dy)
    ax, ay = F.when(flat, dx).otherwise(0.0), F.when(flat, 0.0).otherwise(dy)
    met = met.withColumns({"_along": past(dx, dy), "_square": past(ax, ay), "_out": F.degrees(F.atan2(ax, ay))})
    leads = F.exists("_h", lambda h: F.abs(wrapped(h - F.col("_out"))) <= OUTER_ANGLE)
    by_gate = (F.col("metres") <= AT_GATE) & (F.greatest("_along", "_square") >= BEYOND)
    by_door = F.col("outer") & (length(F.col("_fx") - F.col("_x"), F.col("_fy") - F.col("_y")) <= OUTER_NEAR) & (F.col("_square") >= OUTER_BEYOND) & leads
    left = met.where((dx != 0) | (dy != 0)).where(by_gate | by_door).withColumn("beyond", F.when(by_gate, F.greatest("_along", "_square")).otherwise(F.greatest(F.col("_square"), F.lit(BEYOND))))
    best = left.groupBy(key, "t").agg(F.min(F.struct((-F.round("beyond", 9)).alias("b"), "door")).alias("_b"))
    return best.select(key, "t", F.col("_b.door").alias("gate"), (-F.col("_b.b")).alias("beyond"))


def dispatch(steps: DataFrame, outcomes: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """key, t, by and place of every step: the first of the outcomes(key, t, place), in the order given, that has something to say about it.

    Where none has, by is null and the place stays what it was, null at the beginning; each operator is a table of its own, and
    they share nothing but the place that comes out.
    """
    said = None
    for i, (name, rows) in enumerate(outcomes):
        part = rows.select(key, "t", F.struct(F.lit(i).alias("i"), F.lit(name).alias("by"), "place").alias("_o"))
        said = part if said is None else said.unionByName(part)
    told = said.groupBy(key, "t").agg(F.min("_o").alias("_o"))
    w = Window.partitionBy(key).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(key, "t").join(told, [key, "t"], "left").select(key, "t", F.col("_o.by").alias("by"), F.last("_o.place", ignorenulls=True).over(w).alias("place"))


def route_starts(requests: DataFrame, places: DataFrame, fixes: DataFrame, entrance: tuple[float, float], key: str, fresh: tuple[int, int], accuracy: float = 30.0) -> DataFrame:
    """request, source, x and y: where a route to a destination begins: requests(request, key, t).

    The last of places(key, t, x, y) that is at most fresh[0] old at t ("place"), else the last of fixes(key, t, x, y, accuracy) that is at most
    fresh[1] old and no less accurate than accuracy ("fix"), else the entrance ("entrance").
    """
    point = lambda: F.struct("t", "x", "y")
    kind = "struct<t:bigint,x:double,y:double>"
    none = lambda n: F.lit(None).cast(kind).alias(n)
    asked = requests.select(key, F.col("t").cast("long").alias("t"), F.lit(1).alias("_k"), none("_p"), none("_f"), "request")
    blank = F.lit(None).cast(dict(requests.dtypes)["request"]).alias("request")
    both = asked.unionByName(places.select(key, F.col("t").cast("long").alias("t"), F.lit(0).alias("_k"), point().cast(kind).alias("_p"), none("_f"), blank))
    both = both.unionByName(fixes.where(F.col("accuracy") <= accuracy).select(key, F.col("t").cast("long").alias("t"), F.lit(0).alias("_k"), none("_p"), point().cast(kind).alias("_f"), blank))
    w = Window.partitionBy(key).orderBy("t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in ("_p", "_f")}).where("_k = 1")
    valid = lambda c, age: F.when(F.col("t") - F.col(f"{c}.t") <= age, F.col(c))
    seen = seen.withColumns({"_p": valid("_p", fresh[0]), "_f": valid("_f", fresh[1])})
    source = F.when(F.col("_p").isNotNull(), "place").when(F.col("_f").isNotNull(), "fix").otherwise("entrance")
    return seen.select("request", source.alias("source"), *[F.coalesce(f"_p.{c}", f"_f.{c}", F.lit(v)).alias(c) for c, v in zip(("x", "y"), entrance, strict=True)])


# Metres from the walls that are deep inside and steps there in a row, steps of the way looked back on, metres that it passes a door by, and degrees off inwards from there.
DEEP, DEEP_STEPS, DEEP_TRAIL, DEEP_NEAR, DEEP_ANGLE = 15.0, 3, 40, 12.0, 45.0


def enters_deep(steps: DataFrame, doors: DataFrame, key: str) -> DataFrame:
    """key, t, building, door, metres and since: the third step in a row that is deep inside a building, for a walker thought to be outside.

    steps(key, t, x, y, building, wall): building null outside of all outlines, wall the metres from its walls. With columns frozen,
    fix_building and fix_wall a step counts while the direction is frozen only if the fix is deep in that building too. The door is the one, of doors
    with a building, that the last forty steps since the last such entry passed nearest by, at since, if from there they led inwards; null where there
    is none, and the walker is on the nearest corridor. Steps after since are to be walked again inside: replay.replayed with since and t.
    """
    order = Window.partitionBy(key).orderBy("t")
    deep = F.col("building").isNotNull() & (F.col("wall") >= DEEP)
    if "frozen" in steps.columns:
        deep = deep & (~F.col("frozen") | (F.col("fix_building").eqNullSafe(F.col("building")) & (F.col("fix_wall") >= DEEP)))
    s = steps.where("t is not null and x is not null and y is not null").select(key, "t", "x", "y", "building", F.coalesce(deep, F.lit(False)).alias("_deep"))
    new = ~F.col("_deep") | ~F.coalesce(F.lag("_deep").over(order) & F.lag("building").over(order).eqNullSafe(F.col("building")), F.lit(False))
    s = s.withColumn("_run", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("_k", F.row_number().over(Window.partitionBy(key, "_run").orderBy("t")))
    entry = F.when(F.col("_deep") & (F.col("_k") == DEEP_STEPS), F.struct("t", "building", F.col("x").alias("px"), F.col("y").alias("py")))
    s = s.withColumn("_e", F.first(entry, ignorenulls=True).over(order.rowsBetween(0, DEEP_TRAIL - 1))).where("_e is not null")
    s = graph.written(s.select(key, F.col("t").alias("since"), "x", "y", "_e"), "deep-trails")
    met = _near_doors(s, doors.select("door", "x", "y", "inx", "iny"), DEEP_NEAR).join(doors.select("door", F.col("building").alias("_building")), "door").where(F.col("_building") == F.col("_e.building"))
    best = met.groupBy(key, "_e", "door", "inx", "iny").agg(F.min(F.struct("metres", "since", "x", "y")).alias("_b"))
    dx, dy = F.col("_e.px") - F.col("_b.x"), F.col("_e.py") - F.col("_b.y")
    inwards = (F.hypot(dx, dy) >= 1.0) & (dx * F.col("inx") + dy * F.col("iny") >= F.hypot(dx, dy) * F.cos(F.radians(F.lit(DEEP_ANGLE))))
    best = best.where(inwards).groupBy(key, F.col("_e.t").alias("t")).agg(F.min(F.struct(F.col("_b.metres").alias("metres"), "door", F.col("_b.since").alias("since"))).alias("_d"))
    entries = s.where("since = _e.t").select(key, F.col("_e.t").alias("t"), F.col("_e.building").alias("building"))
    return entries.join(best, [key, "t"], "left").select(key, "t", "building", F.col("_d.door").alias("door"), F.col("_d.metres").alias("metres"), F.col("_d.since").alias("since"))
