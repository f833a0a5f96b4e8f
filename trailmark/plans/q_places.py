"""Places: geometry, graphs and routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import graph as op
from .registry import query
from .views import ARCS, CAMPUS_EDGES, CAMPUS_NODES, arcs, campus_edges, campus_nodes, table

# A square with a notch, as ring of points.
RING = [[0.0, 0.0], [100.0, 0.0], [100.0, 60.0], [60.0, 60.0], [50.0, 30.0], [40.0, 60.0], [0.0, 60.0]]
SIDES = "(values " + ", ".join(f"({i}, {a[0]}::double, {a[1]}::double, {b[0]}::double, {b[1]}::double)" for i, (a, b) in enumerate(zip(RING, RING[1:] + RING[:1], strict=True))) + ") as s(i, ax, ay, bx, bq)"
POINTS = "pts as (select c_custkey as id, (c_custkey * 7919) % 1300 / 10.0 - 15 as x, (c_custkey * 104729) % 900 / 10.0 - 15 as y from customer)"
T = "greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (bq - ay)) / ((bx - ax) * (bx - ax) + (bq - ay) * (bq - ay))))"


def _ring():
    return F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in RING])


def _points(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), ((k * 7919) % 1300 / 10.0 - 15).alias("x"), ((k * 104729) % 900 / 10.0 - 15).alias("y"))


@query("q_m01_in_ring", f"with {POINTS} select id, count(*) filter (where (ay > y) <> (bq > y) and x < (bx - ax) * (y - ay) / nullif(bq - ay, 0) + ax) % 2 = 1 as inside from pts, {SIDES} group by id")
def in_ring(spark, d):
    return _points(spark, d).select("id", geo.in_ring(F.col("x"), F.col("y"), _ring()).alias("inside"))


@query("q_m03_wall_distance", f"with {POINTS} select id, round(min(sqrt(power(x - (ax + {T} * (bx - ax)), 2) + power(y - (ay + {T} * (bq - ay)), 2))), 6) as distance from pts, {SIDES} group by id")
def wall(spark, d):
    return _points(spark, d).select("id", F.round(geo.ring_distance(F.col("x"), F.col("y"), _ring()), 6).alias("distance"))


@query("q_m04_boundary_point", f"""with {POINTS}, c as (select id, i, ax + {T} * (bx - ax) as px, ay + {T} * (bq - ay) as py, x, y from pts, {SIDES}),
    r as (select *, row_number() over (partition by id order by round(sqrt(power(x - px, 2) + power(y - py, 2)), 9), i) as n from c) select id, round(px, 5) as px, round(py, 5) as py from r where n = 1""")
def boundary(spark, d):
    x, y = F.col("x"), F.col("y")
    near = lambda s, i: F.struct(F.round(F.hypot(x - (s.ax + geo.share_along(x, y, s.ax, s.ay, s.bx, s.by) * (s.bx - s.ax)), y - (s.ay + geo.share_along(x, y, s.ax, s.ay, s.bx, s.by) * (s.by - s.ay))), 9).alias("distance"), i.alias("side"))
    first = F.array_min(F.transform(geo.sides(_ring()), near)).getField("side")
    s = F.get(geo.sides(_ring()), first)
    t = geo.share_along(x, y, s.ax, s.ay, s.bx, s.by)
    return _points(spark, d).select("id", F.round(s.ax + t * (s.bx - s.ax), 5).alias("px"), F.round(s.ay + t * (s.by - s.ay), 5).alias("py"))


@query("q_m02_segment_distance", f"with {POINTS}, s as (select 10.0::double as ax, 5.0::double as ay, 90.0::double as bx, 45.0::double as bq) select id, round(sqrt(power(x - (ax + {T} * (bx - ax)), 2) + power(y - (ay + {T} * (bq - ay)), 2)), 6) as distance from pts, s")
def segment(spark, d):
    return _points(spark, d).select("id", F.round(geo.segment_distance(F.col("x"), F.col("y"), *map(F.lit, (10.0, 5.0, 90.0, 45.0))), 6).alias("distance"))


RECT = "r as (select p_partkey as id, p_size::double as w, (p_partkey % 17 + 1)::double as h, (p_partkey % 10)::double as x0 from part)"


@query("q_m05_area_centroid", f"with {RECT} select id, round(w * h - w * h / 2, 6) as area, round(x0 + w / 3, 6) as cx, round(h / 3, 6) as cy from r")
def area(spark, d):
    w, h, x0 = F.col("p_size").cast("double"), (F.col("p_partkey") % 17 + 1).cast("double"), (F.col("p_partkey") % 10).cast("double")
    ring = F.array(F.array(x0, F.lit(0.0)), F.array(x0 + w, F.lit(0.0)), F.array(x0, h))
    cx, cy = geo.ring_centroid(F.col("ring"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), ring.alias("ring")).select("id", F.round(geo.ring_area(F.col("ring")), 6).alias("area"), F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"))


@query("q_m07_segments_cross", f"""with {POINTS}, q as (select id, x, y, x + 30 as u, 50 - y as v from pts)
    select id, ((90.0-10)*(y-5)-(45.0-5)*(x-10)) * ((90.0-10)*(v-5)-(45.0-5)*(u-10)) < 0 and ((u-x)*(5.0-y)-(v-y)*(10.0-x)) * ((u-x)*(45.0-y)-(v-y)*(90.0-x)) < 0 as crosses from q""")
def cross(spark, d):
    x, y = F.col("x"), F.col("y")
    return _points(spark, d).select("id", geo.segments_cross(*map(F.lit, (10.0, 5.0, 90.0, 45.0)), x, y, x + 30, 50 - y).alias("crosses"))


@query("q_m12_point_along", """with p as (select p_partkey as id, (p_partkey % 11) / 10.0::double as s from part)
    select id, round(least(s * 70, 40), 6) as x, round(greatest(s * 70 - 40, 0), 6) as y from p""")
def along(spark, d):
    line = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((0.0, 0.0), (40.0, 0.0), (40.0, 30.0))])
    x, y = geo.along(line, (F.col("p_partkey") % 11) / F.lit(10.0))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("q_p01_plan_metres", f"""with {CAMPUS_NODES} select id, round(500 + x * cos(radians(30 * building)) - y * sin(radians(30 * building)), 6) as mx,
    round(200 + x * sin(radians(30 * building)) + y * cos(radians(30 * building)), 6) as my, round(x / 100, 6) as rx, round(y / 60, 6) as ry from nodes""")
def affine(spark, d):
    n = campus_nodes(spark, d)
    place = (F.lit(100.0), F.lit(60.0), F.lit(500.0), F.lit(200.0), (30 * F.col("building")).cast("double"))
    mx, my = geo.to_metres(F.col("x") / 100, F.col("y") / 60, *place)
    rx, ry = geo.to_plan(F.col("mx"), F.col("my"), *place)
    return n.withColumn("mx", mx).withColumn("my", my).select("id", *[F.round(c, 6).alias(a) for c, a in ((F.col("mx"), "mx"), (F.col("my"), "my"), (rx, "rx"), (ry, "ry"))])


@query("q_p03_projection", "select c_custkey, round(((19.85::double + c_acctbal / 1e6) - 19.85::double) * 111320 * cos(radians(45.25::double)), 4) as east, round((45.25::double - (45.25::double + c_custkey % 100 / 1e4)) * 110540, 4) as south from customer")
def projection(spark, d):
    east, south = geo.project(45.25 + F.col("c_custkey") % 100 / 1e4, 19.85 + F.col("c_acctbal") / 1e6, 45.25, 19.85)
    return table(spark, d, "customer").select("c_custkey", F.round(east, 4).alias("east"), F.round(south, 4).alias("south"))


@query("q_m13_angle_wrap", "select l_orderkey, l_linenumber, sum(fmod(cast(l_extendedprice as bigint) % 1000 - 300 + 0 - 360 * floor(0), 360)) as raw, sum(((cast(floor(l_extendedprice) as bigint) % 1000 - 300) % 360 + 540) % 360 - 180) as wrapped from lineitem group by 1, 2".replace("sum(fmod(cast(l_extendedprice as bigint) % 1000 - 300 + 0 - 360 * floor(0), 360)) as raw, ", ""))
def wrap(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(geo.wrapped(F.floor("l_extendedprice") % 1000 - 300)).alias("wrapped"))


@query("q_j08_nearest_node", f"""with {CAMPUS_NODES}, p as (select c_custkey as point, cast(c_custkey % 5 as int) as building, cast(c_custkey % 3 as int) as floor, (c_custkey * 31) % 1000 / 10.0 as x, (c_custkey * 17) % 600 / 10.0 as y from customer),
    c as (select point, id, sqrt(power(p.x - n.x, 2) + power(p.y - n.y, 2)) as d from p join nodes n using (building, floor)), r as (select *, row_number() over (partition by point order by round(d, 9), id) as k from c)
    select point, id as node, round(d, 6) as distance from p left join (select * from r where k = 1) using (point)""")
def nearest(spark, d):
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("point"), (k % 5).cast("int").alias("building"), (k % 3).cast("int").alias("floor"), ((k * 31) % 1000 / 10.0).alias("x"), ((k * 17) % 600 / 10.0).alias("y"))
    return op.nearest(p, campus_nodes(spark, d), ["building", "floor"], 20.0).select("point", "node", F.round("distance", 6).alias("distance"))


@query("q_g01_edge_violations", f"""with {CAMPUS_NODES}, {CAMPUS_EDGES}, e as (select e.*, p.floor as f, q.floor as g, p.building as pb, q.building as qb from edges e left join nodes p on e.a = p.id left join nodes q on e.b = q.id),
    w as (select a, b, kind, case when f is null or g is null then 'dangling' when kind = 'WALK' and f <> g and pb = qb then 'walk between floors' when kind = 'STAIRS' and abs(f - g) <> 1 then 'stairs over floors'
        when kind = 'LIFT' and f = g then 'lift on a floor' end as why from e) select * from w where why is not null""")
def violations(spark, d):
    return op.violations(campus_edges(spark, d), campus_nodes(spark, d))


@query("q_j02_degrees", f"with {CAMPUS_EDGES}, b as (select a, b from edges union select b, a from edges) select a as id, count(distinct b) as degree from b group by a")
def degrees(spark, d):
    return op.degrees(campus_edges(spark, d))


@query("q_g02_edge_seconds", f"""with {CAMPUS_NODES}, {CAMPUS_EDGES} select e.a, e.b, e.kind, round(case e.kind when 'WALK' then sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2)) / 1.3 * 1.1
    when 'STAIRS' then case when q.floor - p.floor > 0 then 18 else 12 end * abs(q.floor - p.floor) * 1.1 else 45 + 4 * abs(q.floor - p.floor) end, 6) as seconds
    from edges e join nodes p on e.a = p.id join nodes q on e.b = q.id""")
def edge_seconds(spark, d):
    e = op.ends(campus_edges(spark, d), campus_nodes(spark, d), ["x", "y", "floor"]).where("a_x is not null and b_x is not null")
    metres = F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y"))
    return e.select("a", "b", "kind", F.round(op.seconds(F.col("kind"), metres, F.col("b_floor") - F.col("a_floor"), F.lit(1.1)), 6).alias("seconds"))


PATHS = f"""with recursive {ARCS}, h as (select 0 as k, n_nationkey as request, n_nationkey as node, 0.0::double as cost from nation
    union all select k, request, node, min(cost) as cost from (select h.k + 1 as k, h.request, arcs.b as node, h.cost + arcs.cost as cost from h join arcs on h.node = arcs.a where h.k < 26) group by 1, 2, 3)"""


@query("q_g03_shortest_times", PATHS + " select request, node, min(cost) as cost from h group by 1, 2")
def shortest(spark, d):
    starts = table(spark, d, "nation").select(F.col("n_nationkey").alias("request"), F.col("n_nationkey").alias("node"))
    return op.shortest_times(arcs(spark, d), starts).select("request", "node", "cost")


@query("q_g11_nearest_by_kind", PATHS + """, m as (select request, node, min(cost) as cost from h group by 1, 2)
    select request, node, cost, row_number() over (partition by request order by cost, node) as place from m where node % 4 = 1""")
def nearest_kind(spark, d):
    starts = table(spark, d, "nation").select(F.col("n_nationkey").alias("request"), F.col("n_nationkey").alias("node"))
    t = op.shortest_times(arcs(spark, d), starts).where("node % 4 = 1")
    return t.select("request", "node", "cost", F.row_number().over(Window.partitionBy("request").orderBy("cost", "node")).alias("place"))


@query("q_g12_reachable_within", PATHS + " select request, node, min(cost) as cost from h group by 1, 2 having min(cost) <= 60")
def reachable(spark, d):
    starts = table(spark, d, "nation").select(F.col("n_nationkey").alias("request"), F.col("n_nationkey").alias("node"))
    return op.shortest_times(arcs(spark, d), starts).where("cost <= 60").select("request", "node", "cost")


@query("q_q16_route_times", PATHS + " select request, min(cost) as seconds from h where node = (request + 12) % 25 group by request")
def routes(spark, d):
    a = arcs(spark, d).select("a", "b", "cost", F.lit(None).cast("string").alias("vertical"), F.lit(False).alias("room_b"))
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("request"), F.col("n_nationkey").alias("source"), ((F.col("n_nationkey") + 12) % 25).alias("target"))
    return op.routes(a, asked).select("request", "seconds")


CANDS = "c as (select l_orderkey as request, cast(l_linenumber as bigint) as route, min(l_quantity) as seconds, min(l_tax * 100) as walk_before from lineitem group by 1, 2)"


@query("q_g08_nearer_vertical", f"""with {CANDS}, n as (select *, min(seconds) over (partition by request) as f from c), r as (select *, row_number() over (partition by request order by walk_before, seconds, route) as k from n where seconds <= f + 10)
    select request, route, seconds, walk_before from r where k = 1""")
def nearer(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("request"), F.col("l_linenumber").cast("long").alias("route")).agg(F.min("l_quantity").alias("seconds"), F.min(F.col("l_tax") * 100).alias("walk_before"))
    return op.nearer_vertical(c, "request")


PATH = "p as (select l_orderkey as request, l_linenumber as pos, case when min(l_suppkey) % 3 = 0 then 'STAIRS' else 'WALK' end as kind, case when min(l_suppkey) % 3 = 0 then 'S' || (min(l_suppkey) % 4) end as vertical, min(l_quantity) as metres from lineitem group by 1, 2)"


@query("q_g09_first_vertical", f"""with {PATH}, w as (select *, coalesce(sum(case when kind = 'WALK' then metres else 0 end) over (partition by request order by pos rows between unbounded preceding and 1 preceding), 0) as walked from p),
    v as (select *, lag(vertical) over (partition by request order by pos) as pv from w where vertical is not null)
    select request, arg_min(vertical, pos) as first_vertical, arg_min(walked, pos) as walk_before, cast(count(*) filter (where pv <> vertical) as bigint) as changes from v group by request""")
def first_vertical(spark, d):
    s = F.min("l_suppkey")
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("pos")).agg(s.alias("s"), F.min("l_quantity").alias("metres"))
    stairs = F.col("s") % 3 == 0
    p = p.select("request", "pos", F.when(stairs, "STAIRS").otherwise("WALK").alias("kind"), F.when(stairs, F.concat(F.lit("S"), (F.col("s") % 4).cast("string"))).alias("vertical"), "metres")
    return op.verticals(p)


@query("q_g14_components")
def components(spark, d):
    """Over all orders; a recursive SQL is too slow for them, a test compares with union-find. A node that only meets itself is its own component."""
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 1500).alias("b"))
    nodes = e.select(F.col("a").alias("id")).union(e.select("b")).where("id is not null").distinct()
    return nodes.join(op.components(e), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


@query("q_o07_edge_difference", f"with {CAMPUS_EDGES} select a, b from edges except all select a, b from edges where kind = 'LIFT' and a % 2 = 0")
def difference(spark, d):
    e = campus_edges(spark, d)
    return e.select("a", "b").exceptAll(e.where("kind = 'LIFT' and a % 2 = 0").select("a", "b"))


@query("q_p10_edge_visibility", f"""with {CAMPUS_NODES}, {CAMPUS_EDGES} select e.a, e.b, p.kind = 'ROOM' or q.kind = 'ROOM' as route_only, p.kind = 'HALL' and q.kind = 'HALL' as locate_only
    from edges e join nodes p on e.a = p.id join nodes q on e.b = q.id""")
def visibility(spark, d):
    e = op.ends(campus_edges(spark, d), campus_nodes(spark, d), ["kind"]).where("a_kind is not null and b_kind is not null")
    return e.select("a", "b", ((F.col("a_kind") == "ROOM") | (F.col("b_kind") == "ROOM")).alias("route_only"), ((F.col("a_kind") == "HALL") & (F.col("b_kind") == "HALL")).alias("locate_only"))


@query("q_p11_exits", f"with {CAMPUS_NODES}, {CAMPUS_EDGES} select id, name from nodes where kind = 'HALL' and id % 7 <> 0 and id in (select a from edges where kind = 'WALK')")
def exits(spark, d):
    out = campus_edges(spark, d).where("kind = 'WALK'").select(F.col("a").alias("id"))
    return campus_nodes(spark, d).where("kind = 'HALL' and id % 7 <> 0").join(out, "id", "left_semi").select("id", "name")


@query("q_p04_rooms", f"with {CAMPUS_NODES} select id, building, floor, name from nodes where kind = 'ROOM' and name is not null")
def rooms(spark, d):
    return campus_nodes(spark, d).where("kind = 'ROOM' and name is not null").select("id", "building", "floor", "name")


@query("q_j14_paired_vertical", f"""with {CAMPUS_NODES}, c as (select s.id, l.id as other, sqrt(power(s.x - l.x, 2) + power(s.y - l.y, 2)) as d from nodes s join nodes l on s.building = l.building and s.floor = l.floor where s.kind = 'STAIRS' and l.kind = 'LIFT'),
    r as (select *, row_number() over (partition by id order by round(d, 9), other) as k from c where d <= 40) select id, other, round(d, 6) as distance from r where k = 1""")
def paired(spark, d):
    n = campus_nodes(spark, d)
    s = n.where("kind = 'STAIRS'").select(F.col("id").alias("point"), "building", "floor", "x", "y")
    return op.nearest(s, n.where("kind = 'LIFT'"), ["building", "floor"], 20.0, most=40.0).where("node is not null").select(F.col("point").alias("id"), F.col("node").alias("other"), F.round("distance", 6).alias("distance"))


@query("q_g13_dead_ends")
def dead_ends(spark, d):
    return op.dead_ends(campus_edges(spark, d))


@query("q_g10_straight_joints", f"""with {CAMPUS_NODES}, l as (select id as a, id + 5 as b from nodes where id % 3 = 0 union all select id, id + 5 from nodes where id % 3 = 1), b2 as (select a, b from l union select b, a from l),
    t as (select a as id, min(b) as a, max(b) as b from b2 group by 1 having count(distinct b) = 2)
    select t.id, t.a, t.b, round(abs((m.x - p.x) * (q.y - p.y) - (m.y - p.y) * (q.x - p.x)), 4) as area from t join nodes m on t.id = m.id join nodes p on t.a = p.id join nodes q on t.b = q.id
    where abs((m.x - p.x) * (q.y - p.y) - (m.y - p.y) * (q.x - p.x)) <= 500.001""")
def joints(spark, d):
    n = campus_nodes(spark, d)
    e = n.where("id % 3 < 2").select(F.col("id").alias("a"), (F.col("id") + 5).alias("b"))
    return op.straight_joints(e, n, 500.001).withColumn("area", F.round("area", 4))


@query("q_g17_instructions")
def instructions(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("route"), F.col("l_linenumber").alias("pos")).agg(F.min("l_suppkey").alias("s"))
    w = Window.partitionBy("route").orderBy("pos")
    p = t.select("route", "pos", (F.col("s") % 40).cast("double").alias("x"), (F.col("s") % 23).cast("double").alias("y"), (F.col("s") % 3).cast("int").alias("floor"))
    nf = F.lead("floor").over(w)
    return op.instructions(p.withColumn("kind", F.when(nf.isNull() | (nf == F.col("floor")), "WALK").otherwise("STAIRS")))
