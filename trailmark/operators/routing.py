"""Routes by a profile: what each way costs someone, where a route may begin, and routes between named rooms."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .graph import CHANGE, LIFT_FLOOR, LIFT_WAIT, STAIRS_DOWN, STAIRS_UP, UNCOMMON, WALKING_SPEED


@dataclass(frozen=True)
class Profile:
    """How someone goes. crowd: factor by building, 1 or more; uncommon, uncommon_transit, excluded, lift_only_avoiding: names of verticals."""

    speed: float = WALKING_SPEED
    stairs_up: float = STAIRS_UP
    stairs_down: float = STAIRS_DOWN
    lift_wait: float = LIFT_WAIT
    lift_floor: float = LIFT_FLOOR
    avoid_stairs: bool = False
    avoid_lift: bool = False
    change: float = CHANGE
    uncommon_cost: float = UNCOMMON
    crowd: dict[str, float] = field(default_factory=dict)
    uncommon: tuple[str, ...] = ()
    uncommon_transit: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    lift_only_avoiding: tuple[str, ...] = ()

    def __post_init__(self):
        if any(f < 1 for f in self.crowd.values()):
            raise ValueError("a crowd doesn't speed anyone up")

    def avoiding_nothing(self) -> Profile:
        return replace(self, avoid_stairs=False, avoid_lift=False)


def presets(uncommon: tuple[str, ...] = (), uncommon_transit: tuple[str, ...] = (), lift_only_avoiding: tuple[str, ...] = ()) -> dict[str, Profile]:
    """Four ways of changing floors: as people usually do, the fastest, without stairs and without lifts. What is uncommon depends on the place."""
    usual = Profile(uncommon=uncommon, uncommon_transit=uncommon_transit, lift_only_avoiding=lift_only_avoiding)
    return {"usual": usual, "fastest": Profile(), "no stairs": replace(usual, avoid_stairs=True), "no lift": replace(usual, avoid_lift=True)}


def vertical_key(building: Column, id_: Column) -> Column:
    """The stair or lift that a place belongs to: its building, and its id without building, floor and "-D" ("B-2-S1-D": "B/S1")."""
    rest = F.array_join(F.slice(F.split(id_, "-"), 3, 1000), "-")
    return F.concat_ws("/", building, F.regexp_replace(rest, "-D$", ""))


def profile_arcs(edges: DataFrame, nodes: DataFrame, profile: Profile, key: Column | None = None) -> DataFrame:
    """Arcs for graph.routes(): both directions of edges(a, b, kind, and if there: steps, locate_only) that the profile can use.

    nodes(id, building, floor, x, y in metres, kind); rooms are of kind ROOM, passages of PASSAGE. key: the vertical of the place b
    (b, b_building); its own id by vertical_key() otherwise. An edge with a missing end is left out.
    """
    has = set(edges.columns)
    flag = lambda c: (F.col(c) if c in has else F.lit(False)).cast("boolean").alias(c)
    both = graph.both_ways(edges.select("a", "b", "kind", flag("steps"), flag("locate_only")))
    e = graph.ends(both, nodes, ["building", "floor", "x", "y", "kind"]).where("a_floor is not null and b_floor is not null and not locate_only")
    factor = F.create_map(*[F.lit(x) for pair in profile.crowd.items() for x in pair]) if profile.crowd else None
    of = lambda c: F.coalesce(F.element_at(factor, F.col(c).cast("string")), F.lit(1.0)) if profile.crowd else F.lit(1.0)
    crowd, rise = F.greatest(of("a_building"), of("b_building")) if profile.crowd else F.lit(1.0), F.col("b_floor") - F.col("a_floor")
    metres = F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y"))
    walk = F.when(~F.col("steps") | F.lit(not profile.avoid_stairs), metres / profile.speed * crowd)
    stairs = F.when(F.lit(not profile.avoid_stairs), F.when(rise > 0, profile.stairs_up).otherwise(profile.stairs_down) * F.abs(rise) * crowd)
    lift = F.when(F.lit(not profile.avoid_lift), profile.lift_wait + profile.lift_floor * F.abs(rise))
    vertical = F.when(F.col("kind") != "WALK", key if key is not None else vertical_key(F.col("b_building"), F.col("b")))
    shut = [*profile.excluded, *(() if profile.avoid_stairs else profile.lift_only_avoiding)]
    e = e.withColumn("cost", F.when(F.col("kind") == "WALK", walk).when(F.col("kind") == "STAIRS", stairs).otherwise(lift)).withColumn("vertical", vertical)
    e = e.where(F.col("cost").isNotNull() & ~F.coalesce(F.col("vertical").isin(shut), F.lit(False)))
    among = lambda names: F.coalesce(F.col("vertical").isin(list(names)), F.lit(False))
    return e.select("a", "b", "cost", "vertical", (F.col("b_kind") == "ROOM").alias("room_b"), (F.col("b_kind") == "PASSAGE").alias("passage_b"), F.col("a_building").cast("string").alias("building_a"), F.col("b_building").cast("string").alias("building_b"), among(profile.uncommon).alias("uncommon"), F.when(among(profile.uncommon_transit), F.col("b_building").cast("string")).alias("transit"))


def routes(edges: DataFrame, nodes: DataFrame, requests: DataFrame, profile: Profile = Profile(), key: Column | None = None) -> DataFrame:  # noqa: B008
    """request, seconds, path and fallback of requests(request, source, target), all of them searched together.

    Where a profile avoids stairs or lifts and has no route, the route without avoidance is taken and marked fallback. An
    unknown place gives no row. Of routes of equal price the one of fewer places wins.
    """
    at = lambda c: nodes.select(F.col("id").alias(c), F.col("building").cast("string").alias(f"{c}_building"))
    asked = graph.written(requests.select("request", "source", "target").join(at("source"), "source").join(at("target"), "target"), "asked")
    found = graph.routes(profile_arcs(edges, nodes, profile, key), asked, profile.change, profile.uncommon_cost)
    if not (profile.avoid_stairs or profile.avoid_lift):
        return found.withColumn("fallback", F.lit(False))
    found = graph.written(found, "wanted")
    rest = asked.join(found.select("request"), "request", "left_anti")
    plain = profile.avoiding_nothing()
    return graph.with_fallback(found, graph.routes(profile_arcs(edges, nodes, plain, key), rest, plain.change, plain.uncommon_cost))


def starts_at_nodes(points: DataFrame, nodes: DataFrame, keys: list[str], cell: float = 20.0) -> DataFrame:
    """request, node and metres: of points(point, x, y, keys) the nearest node, in a straight line."""
    near = graph.nearest(points, nodes, keys, cell).where("node is not null")
    return near.select(F.col("point").alias("request"), "node", F.col("distance").alias("metres"))


def starts_on_edges(points: DataFrame, segments: DataFrame, keys: list[str], cell: float = 20.0) -> DataFrame:
    """request, node and metres, twice a point: both ends of the nearest of segments(edge, a, b, ax, ay, bx, by, keys), by the way to it and along it."""
    near = graph.nearest_on_edges(points, segments, keys, cell).where("edge is not null")
    along = near.join(segments.select("edge", "a", "b", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("_long")), "edge")
    two = F.explode(F.array(F.struct(F.col("a").alias("node"), (F.col("share") * F.col("_long")).alias("m")), F.struct(F.col("b").alias("node"), ((1 - F.col("share")) * F.col("_long")).alias("m"))))
    return along.select(F.col("point").alias("request"), "distance", two.alias("_e")).select("request", "_e.node", (F.col("distance") + F.col("_e.m")).alias("metres"))


def routes_from(starts: DataFrame, targets: DataFrame, edges: DataFrame, nodes: DataFrame, profile: Profile = Profile(), key: Column | None = None) -> DataFrame:  # noqa: B008
    """request, seconds (the leg to the start included), path and fallback: the best of each request's starts(request, node, metres) to targets(request, target)."""
    legs = graph.written(starts.join(targets, "request").select(F.struct("request", "node").alias("_r"), "request", F.col("node").alias("source"), "target", (F.col("metres") / profile.speed).alias("leg")), "legs")
    found = routes(edges, nodes, legs.select(F.col("_r").alias("request"), "source", "target"), profile, key)
    whole = found.join(legs.select(F.col("_r").alias("request"), F.col("request").alias("_q"), "leg"), "request")
    best = whole.groupBy("_q").agg(F.min(F.struct((F.col("seconds") + F.col("leg")).alias("s"), "path", "fallback")).alias("_x"))
    return best.select(F.col("_q").alias("request"), F.col("_x.s").alias("seconds"), "_x.path", "_x.fallback")


def room_routes(asked: DataFrame, edges: DataFrame, nodes: DataFrame, entrance, profile: Profile = Profile(), key: Column | None = None) -> DataFrame:  # noqa: B008
    """asked(request, from_name, to_name) with seconds, path and fallback: null where a name is unknown or there is no route. A null from_name is the entrance (a place's id).

    nodes also has name; of places with one name, the smallest id counts.
    """
    named = nodes.where("name is not null").groupBy("name").agg(F.min("id").alias("_id"))
    end = lambda c, out: named.select(F.col("name").alias(c), F.col("_id").alias(out))
    known = asked.join(end("from_name", "_from"), "from_name", "left").join(end("to_name", "target"), "to_name", "left")
    known = known.withColumn("source", F.when(F.col("from_name").isNull(), F.lit(entrance)).otherwise(F.col("_from")))
    found = routes(edges, nodes, known.where("source is not null and target is not null").select("request", "source", "target"), profile, key)
    return asked.join(found, "request", "left")
