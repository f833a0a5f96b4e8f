"""Graphs of places: checks, costs, shortest paths for many requests at once, connectivity and shape.

nodes(id, building, floor, x, y, kind), edges(a, b, kind) with kinds WALK, STAIRS and LIFT, undirected. Tables are written
between rounds of an iteration, so no lineage grows.
"""

from __future__ import annotations

import heapq
import math
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Seconds a floor by stairs up and down, a lift's wait and seconds a floor, what changing to another stair or lift costs, and what taking an uncommon one does.
STAIRS_UP, STAIRS_DOWN, LIFT_WAIT, LIFT_FLOOR, CHANGE, UNCOMMON = 18.0, 12.0, 45.0, 4.0, 20.0, 60.0
WALKING_SPEED = 1.3


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a new folder, in local mode only: elsewhere each executor would write to its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="trailmark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A folder's name in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a new Parquet table in the shared folder."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def both_ways(edges: DataFrame) -> DataFrame:
    swapped = [F.col({"a": "b", "b": "a"}.get(c, c)).alias(c) for c in edges.columns]
    return edges.unionByName(edges.select(*swapped))


def ends(edges: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Edges with columns of their nodes, prefixed a_ and b_; null where a node is missing."""
    at = lambda c: nodes.select(F.col("id").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in columns])
    return edges.join(at("a"), "a", "left").join(at("b"), "b", "left")


def violations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that break a rule: a missing end, a walk between floors of one building, stairs over more than a floor, a lift over none."""
    e = ends(edges, nodes, ["building", "floor"])
    rise = F.abs(F.col("a_floor") - F.col("b_floor"))
    why = (
        F.when(F.col("a_floor").isNull() | F.col("b_floor").isNull(), "dangling")
        .when((F.col("kind") == "WALK") & (rise != 0) & (F.col("a_building") == F.col("b_building")), "walk between floors")
        .when((F.col("kind") == "STAIRS") & (rise != 1), "stairs over floors")
        .when((F.col("kind") == "LIFT") & (rise < 1), "lift on a floor")
    )
    return e.select("a", "b", "kind", why.alias("why")).where("why is not null")


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges.select("a", "b").distinct()).groupBy("a").agg(F.count_distinct("b").alias("degree")).withColumnRenamed("a", "id")


def seconds(kind: Column, metres: Column, rise: Column, crowd: Column, speed: float = WALKING_SPEED, avoid_stairs: bool = False, avoid_lift: bool = False, stepped: Column | None = None) -> Column:
    """What an edge takes in its direction; null where the profile can't use it. Crowds slow walking and stairs, not lifts."""
    walk = metres / speed * crowd
    walk = F.when(~F.coalesce(stepped, F.lit(False)), walk) if stepped is not None and avoid_stairs else walk
    stairs = F.lit(None).cast("double") if avoid_stairs else F.when(rise > 0, STAIRS_UP).otherwise(STAIRS_DOWN) * F.abs(rise) * crowd
    lift = F.lit(None).cast("double") if avoid_lift else LIFT_WAIT + LIFT_FLOOR * F.abs(rise)
    return F.when(kind == "WALK", walk).when(kind == "STAIRS", stairs).when(kind == "LIFT", lift)


def _most_rounds(arcs: DataFrame, states: int = 1) -> int:
    """Without a negative cycle a cheapest way is in no state twice, so rounds end by the number of nodes times the states of each."""
    return (both_ways(arcs.select("a", "b")).select("a").distinct().count() + 1) * states


#: Rounds whose improvements stay tables of their own before they are merged.
MERGED_EVERY = 3


def relax(first: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], price: str, most: int, label: str) -> DataFrame:
    """The cheapest row of each state that is reached from first by steps; of equal prices, the least of the other columns.

    first and step's rows have the same columns; keys are never null. Frontier relaxation: step sees what the round before has
    improved, so a round moves that much and writes only what it improves; earlier rounds are merged now and then. It ends
    when nothing improves, and raises an error after most rounds, which only a negative cycle needs.
    """
    rest = [c for c in first.columns if c not in (*keys, price)]

    def least(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.min(F.struct(price, *rest)).alias("_s")).select(*keys, "_s.*")

    front = written(least(first), label)
    parts, rounds = [front], 0
    while not front.isEmpty():
        if rounds > most:
            raise ValueError("the arcs have a cycle of negative cost")
        rounds += 1
        known = parts[0]
        for p in parts[1:]:
            known = known.unionByName(p)
        known = known.groupBy(*keys).agg(F.min(price).alias("_known"))
        better = least(step(front).select(*first.columns)).join(known, keys, "left").where(F.col("_known").isNull() | (F.col(price) < F.col("_known")))
        front = written(better.select(*first.columns), label)
        parts.append(front)
        if len(parts) > MERGED_EVERY:
            every = parts[0]
            for p in parts[1:]:
                every = every.unionByName(p)
            parts = [written(least(every), label)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return written(least(every), label)


def shortest_times(arcs: DataFrame, starts: DataFrame) -> DataFrame:
    """request, node, cost and hops of the cheapest way from each request's start to every node it reaches.

    arcs(a, b, cost) and starts(request, node). Many requests run in one join a round.
    """
    arcs = written(arcs.select("a", "b", "cost"), "arcs")

    def step(front: DataFrame) -> DataFrame:
        return front.join(arcs, F.col("node") == F.col("a")).select("request", F.col("b").alias("node"), (front["cost"] + arcs["cost"]).alias("cost"), (F.col("hops") + 1).alias("hops"))

    return relax(starts.select("request", "node", F.lit(0.0).alias("cost"), F.lit(0).alias("hops")), step, ["request", "node"], "cost", _most_rounds(arcs), "paths")


#: Arcs up to which each task that searches routes holds all of them, 50 bytes an arc.
HELD_ARCS = 2_000_000


def _held_routes(arcs: DataFrame, requests: DataFrame, penalty: float, uncommon_penalty: float) -> DataFrame:
    """routes() by searches back from each target, which all its requests share: a state is a place, the vertical that the way takes next (and whether it is
    uncommon where it begins), and on a passage the building it goes on to. A search ends once no request of its target can get cheaper."""
    kinds, asked, spark = dict(arcs.dtypes) | {"request": dict(requests.dtypes)["request"]}, set(requests.columns), arcs.sparkSession
    held = arcs.toPandas()
    codes, ids = pd.factorize(pd.concat([held["a"], held["b"]]))
    order = np.argsort(codes[len(held) :], kind="stable")
    held, a, b = held.iloc[order], codes[: len(held)][order], codes[len(held) :][order]
    verticals = pd.factorize(held["vertical"])[0] + 1  # 0: none
    places = pd.factorize(pd.concat([held["building_a"], held["building_b"], held["transit"]]))
    building_a, building_b, transit = (places[0] + 1).reshape(3, len(held))
    flags = lambda c: (held[c] == True).to_numpy(bool)  # noqa: E712, E731
    came = np.where(flags("passage_b") & (building_a > 0) & (building_b > 0) & (building_a != building_b), building_a, 0)
    is_passage = np.zeros(len(ids), bool)
    is_passage[b[flags("passage_b")]] = True
    goes = np.where(is_passage[a], building_b, 0)
    graph = (ids, np.searchsorted(b, np.arange(len(ids) + 1)), [a, held["cost"].to_numpy(float), verticals, flags("room_b"), came, goes, flags("uncommon"), transit], list(places[1]), int(verticals.max(initial=0)) + 1, len(places[1]) + 1)
    given = spark.sparkContext.broadcast(graph)

    def ways(target: int, own: set[int], wanted: set[int]) -> dict[int, tuple]:
        """price, seconds and path of each wanted place that has a way to the target; own: buildings in which transit costs nothing."""
        _, ptr, columns, _, n_verticals, n_places = given.value
        heap, settled, final, limit = [(0.0, 0, target * 2 * n_verticals * n_places, None, 0.0)], {}, {}, math.inf
        while heap:
            price, hops, state, after, cost = heapq.heappop(heap)
            if price > limit:
                break
            if state in settled:
                continue
            settled[state] = (after, cost)
            rest, on = divmod(state, n_places)
            rest, uncommon = divmod(rest, 2)
            node, vertical = divmod(rest, n_verticals)
            if node in wanted:
                whole = (price + (uncommon_penalty if uncommon else 0.0), hops, state)
                if node not in final or whole < final[node]:
                    final[node] = whole
                    if len(final) == len(wanted):
                        limit = max(f[0] for f in final.values())
            lo, hi = ptr[node], ptr[node + 1]
            for a, c, v, room, came, goes, odd, transit in zip(*(x[lo:hi].tolist() for x in columns), strict=True):
                if (room and node != target) or a == target or (came and came == on):
                    continue
                extra, flag = 0.0, uncommon
                if v:
                    if vertical and v != vertical:
                        extra = penalty + (uncommon_penalty if uncommon else 0.0)
                    flag = int(odd or (transit > 0 and transit not in own))
                state_a = ((a * n_verticals + (v or vertical)) * 2 + flag) * n_places + goes
                if state_a not in settled:
                    heapq.heappush(heap, (price + c + extra, hops + 1, state_a, state, c))
        found = {}
        for source, (_, _, state) in final.items():
            # added up again from the start
            price = seconds = 0.0
            last, path = 0, []
            while state is not None:
                rest, uncommon = divmod(state // n_places, 2)
                node, vertical = divmod(rest, n_verticals)
                path.append(node)
                state, cost = settled[state]
                if vertical and vertical != last and state is not None:
                    price += (penalty if last else 0.0) + (uncommon_penalty if uncommon else 0.0)
                    last = vertical
                price, seconds = price + cost, seconds + cost
            found[source] = (seconds, price, path)
        return found

    def search(batches):
        ids, places = given.value[0], {p: i + 1 for i, p in enumerate(given.value[3])}
        code = {x: i for i, x in enumerate(ids.tolist())}
        for batch in batches:
            rows, groups = [], {}
            for i, (source, target, *own) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("source", "target", "source_building", "target_building")), strict=True)):
                if source is not None and source == target:
                    rows.append((i, 0.0, 0.0, [source]))
                elif source in code and target in code:
                    groups.setdefault((target, *own), []).append((i, code[source]))
            for (target, *own), members in groups.items():
                found = ways(code[target], {places.get(o, -1) for o in own}, {source for _, source in members})
                rows += [(i, *found[source][:2], ids[found[source][2]].tolist()) for i, source in members if source in found]
            whose = batch.select(["request"]).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([*whose.columns, *[pa.array([r[j] for r in rows], t) for j, t in ((1, pa.float64()), (2, pa.float64()), (3, pa.list_(batch.schema.field("target").type)))]], ["request", "seconds", "price", "path"])

    of = lambda c: (F.col(c) if c in asked else F.lit(None)).cast("string").alias(c)
    ends = requests.select("request", *[F.col(c).cast(kinds["a"]).alias(c) for c in ("source", "target")], of("source_building"), of("target_building")).distinct()
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return written(ends.repartition(spread, "target").mapInArrow(search, f"request {kinds['request']}, seconds double, price double, path array<{kinds['a']}>"), "routes")


def routes(arcs: DataFrame, requests: DataFrame, penalty: float = CHANGE, uncommon_penalty: float = UNCOMMON) -> DataFrame:
    """The cheapest route of each requests(request, source, target): its seconds, path and price (seconds and penalties). No row where there is none or an end is unknown.

    arcs(a, b, cost, vertical, room_b): vertical names the stair or lift, null for a walk; room_b tells a room, which no route passes
    through. Optional columns: passage_b, a passage between buildings building_a and building_b, from which no route
    returns into the building it came from; uncommon, a vertical that costs more; transit, the building in which it does so only for routes
    that neither begin nor end there (source_building and target_building of requests). Changing to another vertical costs
    a penalty, and so does taking an uncommon one; both choose but aren't reported. A state is a node, the last vertical and, on a
    passage, the building before it; it points to the state before it, and paths are read back from the ends.

    Up to HELD_ARCS arcs without negative costs every task holds the arcs and searches back from its targets, no farther than the
    requests need; more arcs, or negative costs, are relaxed in rounds of joins.
    """
    has, asked = set(arcs.columns), set(requests.columns)
    some = lambda c, kind: (F.col(c) if c in has else F.lit(None)).cast(kind).alias(c)
    arcs = written(arcs.select("a", "b", "cost", "vertical", "room_b", some("passage_b", "boolean"), some("building_a", "string"), some("building_b", "string"), some("uncommon", "boolean"), some("transit", "string")), "arcs")
    number, plain = arcs.agg(F.count("*"), F.count_if((F.col("cost") >= 0) & (F.col("cost") < float("inf")))).first()
    if number == plain and number <= HELD_ARCS:
        return _held_routes(arcs, requests, penalty, uncommon_penalty)
    most = _most_rounds(arcs, (arcs.select("vertical").distinct().count() + 1) * (arcs.select("building_a").distinct().count() + 1))
    of = lambda c: (F.col(c) if c in asked else F.lit(None)).cast("string").alias(c)
    keys, node = ["request", "node", "last", "came"], F.lit(None).cast(dict(arcs.dtypes)["a"])
    first = requests.select("request", F.col("source").alias("node"), F.lit("").alias("last"), F.lit("").alias("came"), F.lit(0.0).alias("price"), F.lit(0.0).alias("seconds"), F.lit(0).alias("hops"), node.alias("p_node"), F.lit("").alias("p_last"), F.lit("").alias("p_came"), "target", of("source_building"), of("target_building"))

    def step(front: DataFrame) -> DataFrame:
        on = front.where("node <> target").join(arcs, F.col("node") == F.col("a"))
        on = on.where((~F.col("room_b") | (F.col("b") == F.col("target"))) & ((F.col("came") == "") | (F.col("came") != F.coalesce("building_b", F.lit("")))))
        now = F.coalesce("vertical", "last")
        changed = F.col("vertical").isNotNull() & (now != F.col("last"))
        transit = F.coalesce(~F.col("transit").isin(F.coalesce("source_building", F.lit("")), F.coalesce("target_building", F.lit(""))), F.lit(False))
        extra = F.when(changed & (F.col("last") != ""), penalty).otherwise(0.0) + F.when(changed & (F.coalesce("uncommon", F.lit(False)) | transit), uncommon_penalty).otherwise(0.0)
        came = F.when(F.coalesce("passage_b", F.lit(False)) & (F.col("building_a") != F.col("building_b")), F.col("building_a")).otherwise("")
        return on.select("request", F.col("b").alias("node"), now.alias("last"), came.alias("came"), (F.col("price") + F.col("cost") + extra).alias("price"), (F.col("seconds") + F.col("cost")).alias("seconds"), (F.col("hops") + 1).alias("hops"), F.col("node").alias("p_node"), F.col("last").alias("p_last"), F.col("came").alias("p_came"), "target", "source_building", "target_building")

    best = relax(first, step, keys, "price", most, "routes")
    ends = best.where("node = target").groupBy("request").agg(F.min(F.struct("price", "hops", "last", "came", "seconds", "node", "p_node", "p_last", "p_came")).alias("_e"))
    ends = written(ends.select("request", "_e.*"), "ways")
    back = ends.select("request", "seconds", "price", F.array("node").alias("path"), *[F.col(f"p_{c}").alias(c) for c in ("node", "last", "came")])
    at = best.select("request", "node", "last", "came", *[f"p_{c}" for c in ("node", "last", "came")])
    for hop in range(ends.agg(F.max("hops")).first()[0] or 0):  # each join goes one place back on all routes that aren't at their start
        path = F.when(F.col("node").isNull(), F.col("path")).otherwise(F.array_prepend("path", F.col("node")))
        back = back.join(at, keys, "left").select("request", "seconds", "price", path.alias("path"), *[F.col(f"p_{c}").alias(c) for c in ("node", "last", "came")])
        if hop % 6 == 5:
            back = written(back, "ways")
    return back.select("request", "seconds", "price", "path")


def verticals(path: DataFrame, key: str = "request") -> DataFrame:
    """path(key, pos, kind, vertical, metres): per key the first stair or lift, metres walked before it, and how often it changes."""
    order = Window.partitionBy(key).orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    walked = F.coalesce(F.sum(F.when(F.col("kind") == "WALK", F.col("metres")).otherwise(0.0)).over(upto), F.lit(0.0))
    on = path.withColumn("_walked", walked).where("vertical is not null").withColumn("_prev", F.lag("vertical").over(order))
    found = on.groupBy(key).agg(F.min(F.struct("pos", "vertical", "_walked")).alias("_f"), F.sum(F.when(F.col("_prev") != F.col("vertical"), 1).otherwise(0)).alias("changes"))
    return found.select(key, F.col("_f.vertical").alias("first_vertical"), F.col("_f._walked").alias("walk_before"), "changes")


def nearer_vertical(candidates: DataFrame, key: str, slack: float = 10.0) -> DataFrame:
    """Of a key's routes at most slack seconds over the fastest, the one with the shortest walk to its first vertical."""
    fastest = F.min("seconds").over(Window.partitionBy(key))
    near = candidates.withColumn("_fast", fastest).where(F.col("seconds") <= F.col("_fast") + slack)
    return near.groupBy(key).agg(F.min(F.struct("walk_before", "seconds", "route")).alias("_x")).select(key, F.col("_x.route").alias("route"), F.col("_x.seconds").alias("seconds"), F.col("_x.walk_before").alias("walk_before"))


def components(edges: DataFrame) -> DataFrame:
    """id and component (its smallest id) of every node of edges(a, b).

    Nodes point to their smallest neighbour, pointers are doubled to their ends, and linked ends are the next round's nodes, half as many.
    """
    left = written(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "component-edges")
    result = None
    while not left.isEmpty():
        point = written(both_ways(left).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("end")).withColumnRenamed("a", "id"), "component-ends")
        while True:
            far = point.select(F.col("id").alias("end"), F.col("end").alias("_far"))
            moved = written(point.join(far, "end").select("id", F.col("_far").alias("end"), (F.col("_far") != F.col("end")).alias("_moved")), "component-ends")
            point = moved.select("id", "end")
            if moved.where("_moved").isEmpty():
                break
        if result is None:
            result = point.withColumnRenamed("end", "component")
        else:
            onto = point.select(F.col("id").alias("component"), "end")
            result = written(result.join(onto, "component", "left").select("id", F.coalesce("end", "component").alias("component")), "components")
        of = lambda c: point.select(F.col("id").alias(c), F.col("end").alias(f"_{c}"))
        left = written(left.join(of("a"), "a").join(of("b"), "b").where("_a != _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "component-edges")
    return result if result is not None else left.select(F.col("a").alias("id"), F.col("b").alias("component"))


def dead_ends(edges: DataFrame) -> DataFrame:
    """id and depth of nodes on branches that end: leaves are taken off round by round, until none is left."""
    live, gone, depth = written(both_ways(edges.select("a", "b").where("a <> b").distinct()).distinct(), "branch"), None, 0
    while True:
        leaves = live.groupBy("a").count().where("count = 1").select(F.col("a").alias("id")).withColumn("depth", F.lit(depth))
        leaves = written(leaves, "branch-leaves")
        if leaves.isEmpty():
            break
        gone = leaves if gone is None else gone.unionByName(leaves)
        if depth % 32 == 31:  # keeps the union short
            gone = written(gone, "branch-gone")
        off = lambda c: leaves.select(F.col("id").alias(c))
        live = written(live.join(off("a"), "a", "left_anti").join(off("b"), "b", "left_anti"), "branch")
        depth += 1
    return gone if gone is not None else live.select(F.col("a").alias("id"), F.lit(0).alias("depth"))


def straight_joints(edges: DataFrame, nodes: DataFrame, most: float = 0.01) -> DataFrame:
    """Nodes of degree two whose neighbours lie on a line with them: id, a, b and the doubled triangle area that is below most."""
    own = both_ways(edges.select("a", "b").distinct()).groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("_n")).where(F.size("_n") == 2)
    at = lambda c: nodes.select(F.col("id").alias(c), F.col("x").alias(f"_{c}x"), F.col("y").alias(f"_{c}y"))
    three = own.select(F.col("a").alias("id"), F.get("_n", F.lit(0)).alias("a"), F.get("_n", F.lit(1)).alias("b")).join(at("id"), "id").join(at("a"), "a").join(at("b"), "b")
    area = F.abs((F.col("_idx") - F.col("_ax")) * (F.col("_by") - F.col("_ay")) - (F.col("_idy") - F.col("_ay")) * (F.col("_bx") - F.col("_ax")))
    return three.select("id", "a", "b", area.alias("area")).where(F.col("area") <= most)


def _by_cells(points: DataFrame, targets: DataFrame, keys: list[str], cell: float, distance: Column, value: list[str], most: float | None, touches: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """points with _b, the least struct of distance and value among targets(keys, box _x0 _y0 _x1 _y1, ...), by grids of cells.

    A point meets what touches the nine cells around it. What lies within a cell's size can't be elsewhere, so an answer within it is
    the answer; for the other points the cells are doubled, round by round, and only they are joined again. The cells begin at cell, or
    smaller where targets stand close. Points of one place are looked up once, and of targets alike but for value[0] only the least
    is met. Points without finite coordinates or without a target under their keys get null. most: nothing farther counts.
    touches: how far a target is from a point, for targets that fill little of their box.
    """
    finite = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < 1e300" for c in ("x", "y"))
    targets = written(targets.groupBy(*[c for c in targets.columns if c != value[0]]).agg(F.min(value[0]).alias(value[0])), "near-targets")
    w, h = (F.max(f"_{c}1") - F.min(f"_{c}0") for c in "xy")
    crowd = targets.groupBy(*keys).agg(F.count("*").alias("n"), w.alias("w"), h.alias("h"), F.avg(F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))).alias("e"))
    room = F.sqrt(F.greatest(F.col("w") * F.col("h") / F.col("n"), F.pow(F.greatest("w", "h") / F.col("n"), F.lit(2.0))))
    closest = crowd.select(F.greatest(2 * room, F.col("e") / 8).alias("s")).where("s > 0 and s < 1e300").agg(F.min("s")).first()[0]
    asked = points.where(finite).select(*keys, "x", "y").distinct()
    asked = asked.join(targets.select(*keys).distinct(), keys, "left_semi") if keys else asked
    places = written(asked.withColumn("_p", F.monotonically_increasing_id()), "near-open")
    open_, found, size = places, [], min(cell, closest) if closest else cell
    while not open_.isEmpty():
        cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))  # noqa: E731, B023
        here = targets.withColumn("_cx", cells("_x0", "_x1")).withColumn("_cy", cells("_y0", "_y1"))
        if touches is not None:  # a cell's corners are 0.7072 of its size off its middle
            here = here.where(touches((F.col("_cx") + 0.5) * size, (F.col("_cy") + 0.5) * size) <= 0.7072 * size + 1e-6)
        around = open_.withColumn("_o", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])))
        around = around.withColumn("_cx", F.floor(F.col("x") / size) + F.col("_o.i")).withColumn("_cy", F.floor(F.col("y") / size) + F.col("_o.j")).drop("_o")
        met = around.join(here, [*keys, "_cx", "_cy"]).withColumn("_d", F.round(distance, 9))
        met = met.where(F.col("_d") <= most) if most is not None else met
        both = written(open_.join(met.groupBy("_p").agg(F.min(F.struct("_d", *value)).alias("_b")), "_p", "left"), "near-met")
        sure = F.lit(True) if most is not None and size >= most else F.coalesce(F.col("_b._d") <= size, F.lit(False))
        found.append(both.where(sure))
        open_, size = both.where(~sure).drop("_b"), size * 2
    if not found:
        empty = targets.where("false").select(*keys, *[F.lit(None).cast(dict(points.dtypes)[c]).alias(c) for c in ("x", "y")], F.struct(F.lit(0.0).alias("_d"), *value).alias("_b"))
        return points.join(empty, [*keys, "x", "y"], "left")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return points.join(every.select(*keys, "x", "y", "_b"), [*keys, "x", "y"], "left")


def nearest(points: DataFrame, nodes: DataFrame, keys: list[str], cell: float, most: float | None = None) -> DataFrame:
    """Of each points(point, x, y, keys) the nearest node: node and distance. cell: a usual distance, from which the search widens.

    Of equal distances, to a nanometre, the smaller id wins. most: null where nothing is so near.
    """
    n = nodes.select(*keys, F.col("id").alias("_id"), F.col("x").alias("_x0"), F.col("y").alias("_y0"), F.col("x").alias("_x1"), F.col("y").alias("_y1"))
    best = _by_cells(points, n, keys, cell, F.hypot(F.col("x") - F.col("_x0"), F.col("y") - F.col("_y0")), ["_id"], most)
    return best.select(*points.columns, F.col("_b._id").alias("node"), F.col("_b._d").alias("distance"))


def instructions(path: DataFrame, key: str = "route", turn: float = 35.0, back: float = 150.0, merge: float = 4.0) -> DataFrame:
    """What to do along routes: key, seq, action and metres of walking before it.

    path(key, pos, x, y, floor, kind): points of each route in order, kind the way that leads to the next one. Actions: start, left,
    right, back, up, down, lift and arrive. Turns are told from turn degrees on; of turns closer than merge metres the angles
    are added up, so a pair that cancels out vanishes; flights that follow each other become one. All routes run in one sort.
    """
    order = Window.partitionBy(key).orderBy("pos")
    nx, ny, nf = (F.lead(c).over(order) for c in ("x", "y", "floor"))
    legs = path.select(key, "pos", "kind", F.hypot(nx - F.col("x"), ny - F.col("y")).alias("_d"), F.degrees(F.atan2(ny - F.col("y"), nx - F.col("x"))).alias("_h"), (nf - F.col("floor")).alias("_rise"), nf.isNull().alias("_last"))
    walk = F.col("kind") == "WALK"
    legs = legs.withColumn("_walk", F.when(walk & ~F.col("_last"), F.col("_d")).otherwise(0.0)).withColumn("_ph", F.lag("_h").over(order)).withColumn("_pk", F.lag("kind").over(order)).withColumn("_pd", F.lag("_d").over(order))
    bend = F.when(walk & (F.col("_pk") == "WALK") & ~F.col("_last"), (F.col("_h") - F.col("_ph") % 360 + 540) % 360 - 180).otherwise(0.0)
    legs = legs.withColumn("_bend", bend)
    # bends with little way between them are one
    bends = legs.where("_bend != 0").withColumn("_gap", F.col("_pd")).withColumn("_new", F.when(F.lag("pos").over(order).isNull() | (F.col("_pd") >= merge) | (F.lag("pos").over(order) != F.col("pos") - 1), 1).otherwise(0))
    bends = bends.withColumn("_g", F.sum("_new").over(order)).groupBy(key, "_g").agg(F.min("pos").alias("pos"), F.sum("_bend").alias("_a")).where(F.abs("_a") >= turn)
    turns = bends.select(key, "pos", F.when(F.abs("_a") >= back, "back").when(F.col("_a") > 0, "right").otherwise("left").alias("action"))
    flights = legs.where(~walk & ~F.col("_last")).withColumn("_new", F.when((F.lag("pos").over(order) == F.col("pos") - 1) & (F.lag("kind").over(order) == F.col("kind")), 0).otherwise(1)).withColumn("_g", F.sum("_new").over(order))
    flights = flights.groupBy(key, "_g").agg(F.min("pos").alias("pos"), F.sum("_rise").alias("_r"), F.min("kind").alias("_k"))
    flights = flights.select(key, "pos", F.when(F.col("_k") == "LIFT", "lift").when(F.col("_r") > 0, "up").otherwise("down").alias("action"))
    borders = legs.groupBy(key).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    every = turns.unionByName(flights).unionByName(borders.select(key, F.col("lo").alias("pos"), F.lit("start").alias("action"))).unionByName(borders.select(key, F.col("hi").alias("pos"), F.lit("arrive").alias("action")))
    before = F.coalesce(F.sum("_walk").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    walked = legs.withColumn("_upto", before).select(key, "pos", "_upto")
    rank = F.when(F.col("action") == "start", 0).when(F.col("action") == "arrive", 2).otherwise(1)
    seq = Window.partitionBy(key).orderBy("pos", rank, "action")
    return every.join(walked, [key, "pos"]).select(key, F.row_number().over(seq).alias("seq"), "action", (F.col("_upto") - F.coalesce(F.lag("_upto").over(seq), F.lit(0.0))).alias("metres"))


def similarity(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The scale, rotation (degrees) and shift that bring points (x, y) nearest to (u, v), least squares, per key."""
    s = pairs.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("u").alias("mu"), F.avg("v").alias("mv"), *[F.avg(F.col(a) * F.col(b)).alias(a + b) for a, b in ("xu", "yv", "xv", "yu", "xx", "yy")])
    square = F.nullif(F.col("xx") - F.col("mx") * F.col("mx") + F.col("yy") - F.col("my") * F.col("my"), F.lit(0.0))
    a = (F.col("xu") - F.col("mx") * F.col("mu") + F.col("yv") - F.col("my") * F.col("mv")) / square
    b = (F.col("xv") - F.col("mx") * F.col("mv") - F.col("yu") + F.col("my") * F.col("mu")) / square
    return s.select(*keys, F.hypot(a, b).alias("scale"), F.degrees(F.atan2(b, a)).alias("rotation"), (F.col("mu") - a * F.col("mx") + b * F.col("my")).alias("dx"), (F.col("mv") - b * F.col("mx") - a * F.col("my")).alias("dy"))


def with_fallback(wanted: DataFrame, otherwise: DataFrame, key: str = "request") -> DataFrame:
    """Routes of a profile that avoids something, and for requests without one those of the plain profile, marked fallback."""
    rest = otherwise.join(wanted.select(key), key, "left_anti").withColumn("fallback", F.lit(True))
    return wanted.withColumn("fallback", F.lit(False)).unionByName(rest)


def crowd_percent(path: DataFrame, key: str = "request", least: int = 5) -> DataFrame:
    """The most that a crowd slows a route down, in percent; null where it is below least."""
    got = path.groupBy(key).agg(F.round((F.max("crowd") - 1) * 100).cast("int").alias("_p"))
    return got.select(key, F.when(F.col("_p") >= least, F.col("_p")).alias("percent"))


def from_point(points: DataFrame, nodes: DataFrame, arcs: DataFrame, keys: list[str], cell: float, speed: float = WALKING_SPEED) -> DataFrame:
    """request, node and cost of ways that begin at points: straight to the nearest node, then along the arcs."""
    near = nearest(points, nodes, keys, cell).where("node is not null").select(F.col("point").alias("request"), "node", (F.col("distance") / speed).alias("leg"))
    found = shortest_times(arcs, near.select("request", "node"))
    return found.join(near.select("request", "leg"), "request").select("request", "node", (F.col("cost") + F.col("leg")).alias("cost"))


def stair_keys(ids: DataFrame) -> DataFrame:
    """Stairs of ids such as "A-S1-2" or "A-S1-2-D": key without floor and side, floors from lowest to highest, and how many lead down."""
    plain = F.regexp_replace("id", "-D$", "")
    key = F.regexp_replace(plain, r"-?\d+$", "")
    floor = F.regexp_extract(plain, r"(-?\d+)$", 1).try_cast("int")
    return ids.select(key.alias("key"), floor.alias("_f"), F.endswith("id", F.lit("-D")).alias("_d")).groupBy("key").agg(F.min("_f").alias("lowest"), F.max("_f").alias("highest"), F.sum(F.col("_d").cast("int")).alias("n_down"))


def nearest_on_edges(points: DataFrame, segments: DataFrame, keys: list[str], cell: float, most: float | None = None) -> DataFrame:
    """Of each points(point, x, y, keys) the nearest of segments(edge, ax, ay, bx, by, keys): edge, share along it and distance.

    A segment stands in every grid cell that its box touches, so a point meets nearby segments first; the search widens from cell.
    most: null where nothing is so near.
    """
    from ..functions.geo import segment_distance, share_along

    box = {f"_{c}{i}": f(F.col(f"a{c}"), F.col(f"b{c}")) for c in "xy" for i, f in ((0, F.least), (1, F.greatest))}
    t = share_along(*map(F.col, ("x", "y", "ax", "ay", "bx", "by")))
    off = F.hypot(F.col("x") - F.col("ax") - t * (F.col("bx") - F.col("ax")), F.col("y") - F.col("ay") - t * (F.col("by") - F.col("ay")))
    ways = segments.select(*keys, "edge", *[F.col(c).cast("double").alias(c) for c in ("ax", "ay", "bx", "by")]).withColumns(box)
    best = _by_cells(points, ways, keys, cell, off, ["edge", "ax", "ay", "bx", "by"], most, lambda x, y: segment_distance(x, y, *map(F.col, ("ax", "ay", "bx", "by"))))
    t = share_along(F.col("x"), F.col("y"), *[F.col(f"_b.{c}") for c in ("ax", "ay", "bx", "by")])
    return best.select(*points.columns, F.col("_b.edge").alias("edge"), t.alias("share"), F.col("_b._d").alias("distance"))


def containing(points: DataFrame, areas: DataFrame, cell: float = 50.0) -> DataFrame:
    """Each point with the first area (id) whose outline holds it and whose holes don't. An area stands in the grid cells that its box touches, so points meet areas nearby."""
    from ..functions.geo import in_area

    ends = lambda f, i: f(F.transform("outline", lambda p: F.get(p, F.lit(i))))
    boxed = areas.select(F.col("id").alias("_id"), "outline", "holes", *[ends(f, i).alias(n) for f, i, n in ((F.array_min, 0, "_x0"), (F.array_max, 0, "_x1"), (F.array_min, 1, "_y0"), (F.array_max, 1, "_y1"))])
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    boxed = boxed.withColumn("_cx", span("_x0", "_x1")).withColumn("_cy", span("_y0", "_y1"))
    near = points.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell)).join(boxed, ["_cx", "_cy"])
    near = near.where("x between _x0 and _x1 and y between _y0 and _y1")
    held = near.where(in_area(F.col("x"), F.col("y"), F.col("outline"), F.col("holes"))).groupBy("point").agg(F.min("_id").alias("area"))
    return points.join(held, "point", "left")
