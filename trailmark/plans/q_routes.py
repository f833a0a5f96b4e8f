"""Routes by profile, doors and stairs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import directions, entering, graph, routing
from .registry import query
from .views import CAMPUS_EDGES, CAMPUS_NODES, READINGS, campus_edges, campus_nodes, readings, table

PROFILE = routing.Profile(crowd={"1": 1.25}, uncommon=("1/0", "3/2"), uncommon_transit=("2/1",), excluded=("4/1",))


def _key():
    return F.concat_ws("/", F.col("b_building").cast("string"), (F.col("b") % 3).cast("string"))


def _profile_sql(starts: str) -> str:
    """Cheapest prices by (node, last vertical); starts(request, target, node, price) begin."""
    return f"""with recursive {CAMPUS_NODES}, {CAMPUS_EDGES}, sym as (select a, b, kind from edges union all select b, a, kind from edges),
    arcs as (select e.a, e.b, q.kind = 'ROOM' as room_b, case when e.kind <> 'WALK' then q.building || '/' || (e.b % 3) end as vertical,
            case e.kind when 'WALK' then sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2)) / 1.3 * case when p.building = 1 or q.building = 1 then 1.25::double else 1 end
                when 'STAIRS' then case when q.floor > p.floor then 18 else 12 end * abs(q.floor - p.floor) * case when p.building = 1 or q.building = 1 then 1.25::double else 1 end
                else 45 + 4 * abs(q.floor - p.floor) end as cost
        from sym e join nodes p on e.a = p.id join nodes q on e.b = q.id),
    {starts},
    h as (select 0 as k, request, target, node, '' as last, price from starts
        union all
        select k, request, target, node, last, min(price) as price from (
            select h.k + 1 as k, request, target, b as node, coalesce(vertical, last) as last,
                price + cost + case when vertical <> last and last <> '' then 20 else 0 end + case when vertical <> last and vertical in ('1/0', '3/2') then 60 else 0 end as price
            from h join arcs on h.node = arcs.a
            where h.node <> h.target and (not room_b or b = target) and coalesce(vertical, '') <> '4/1' and h.k <= (select count(*) // 4 from nodes)) group by 1, 2, 3, 4, 5)"""


@query("q_g03_profile_routes", _profile_sql("starts as (select s.id as request, t.id as target, s.id as node, 0.0::double as price from nodes s join nodes t on t.id = s.id + 20)") + """
    select request, round(min(price), 6) as price from h where node = target group by request""")
def profile_routes(spark, d):
    """From every place to the one four on, with what verticals cost in choice."""
    n = campus_nodes(spark, d)
    at = lambda c, by: n.select((F.col("id") - by).alias("request"), F.col("id").alias(c), F.col("building").cast("string").alias(f"{c}_building"))
    asked = at("source", 0).join(at("target", 20), "request")
    return graph.routes(routing.profile_arcs(campus_edges(spark, d), n, PROFILE, _key()), asked, PROFILE.change, PROFILE.uncommon_cost).select("request", F.round("price", 6).alias("price"))


STARTS = """c as (select c_custkey as request, n.id as node, sqrt(power((c_custkey * 31) % 1000 / 10.0 - n.x, 2) + power((c_custkey * 17) % 600 / 10.0 - n.y, 2)) as d, c_custkey % 5 as building
            from customer join nodes n on n.building = c_custkey % 5 and n.floor = c_custkey % 3),
        near as (select *, row_number() over (partition by request order by round(d, 9), node) as k from c),
        starts as (select request, (select min(id) from nodes t where t.building = near.building) as target, node, d / 1.3 as price from near where k = 1)"""


@query("q_g05_from_point", _profile_sql(STARTS) + " select request, round(min(price), 6) as seconds from h where node = target group by request")
def from_point(spark, d):
    """From each customer's place, by the nearest node, to the first place of its building; nothing uncommon, so price is time but for changes."""
    n, k = campus_nodes(spark, d), F.col("c_custkey")
    points = table(spark, d, "customer").select(k.alias("point"), (k % 5).cast("int").alias("building"), (k % 3).cast("int").alias("floor"), ((k * 31) % 1000 / 10.0).alias("x"), ((k * 17) % 600 / 10.0).alias("y"))
    starts = routing.starts_at_nodes(points, n, ["building", "floor"])
    first = n.groupBy("building").agg(F.min("id").alias("target"))
    asked = starts.join(points.select(F.col("point").alias("request"), "building"), "request").join(first, "building")
    asked = graph.written(asked.select("request", F.col("node").alias("source"), "target", F.col("building").cast("string").alias("building"), (F.col("metres") / PROFILE.speed).alias("leg")), "legs")
    # places are searched once, however many begin there
    ways = asked.select("source", "target", "building").distinct().select(F.struct("source", "target").alias("request"), "source", "target", F.col("building").alias("source_building"), F.col("building").alias("target_building"))
    found = graph.routes(routing.profile_arcs(campus_edges(spark, d), n, PROFILE, _key()), ways, PROFILE.change, PROFILE.uncommon_cost)
    return asked.join(found.select("request.source", "request.target", "price"), ["source", "target"]).select("request", F.round(F.col("price") + F.col("leg"), 6).alias("seconds"))


STEPS = """s as (select event_id, user_id, t, sin(value) * 0.7 as dx, cos(value) * 0.7 as dy, event_id % 97 / 2.0 as x, event_id % 61 / 2.0 as y from readings),
    doors as (select s_suppkey as door, s_suppkey * 7 % 50 + 0.25 as px, s_suppkey * 11 % 30 + 0.25 as py, sin(s_suppkey)::double as inx, cos(s_suppkey)::double as iny from supplier)"""


def _steps(spark, d):
    k, v = F.col("event_id"), F.col("value")
    s = readings(spark, d).select("event_id", "user_id", "t", (F.sin(v) * 0.7).alias("dx"), (F.cos(v) * 0.7).alias("dy"), (k % 97 / 2.0).alias("x"), (k % 61 / 2.0).alias("y"))
    k = F.col("s_suppkey")
    return s, table(spark, d, "supplier").select(k.alias("door"), (k * 7 % 50 + 0.25).alias("x"), (k * 11 % 30 + 0.25).alias("y"), F.sin(k).alias("inx"), F.cos(k).alias("iny"))


@query("q_st22b_enters_by_direction", f"""with {READINGS}, {STEPS}, l as (select *, lag(dx) over w as dx1, lag(dy) over w as dy1, lag(dx, 2) over w as dx2, lag(dy, 2) over w as dy2 from s window w as (partition by user_id order by t)),
    m as (select user_id, t, door, sqrt(power(x - px, 2) + power(y - py, 2)) as metres, dx, dy, dx1, dy1, dx2, dy2, inx, iny from l, doors where dx2 is not null and abs(x - px) <= 4 and abs(y - py) <= 4),
    f as (select *, row_number() over (partition by user_id, t order by metres, door) as k from m
        where metres <= 4 and least((dx * inx + dy * iny), (dx1 * inx + dy1 * iny), (dx2 * inx + dy2 * iny)) / 0.7 >= cos(radians(50.0::double)))
    select user_id, t, door, round(metres, 6) as metres from f where k = 1""")
def by_direction(spark, d):
    s, doors = _steps(spark, d)
    return entering.enters_by_direction(s, doors, "user_id").withColumn("metres", F.round("metres", 6))


@query("q_st22c_enters_by_trail", f"""with {READINGS}, {STEPS},
    l as (select *, row_number() over (partition by user_id order by t) as n, sum(dx) over w as cx, sum(dy) over w as cy, lag(x, 15) over o as x0, lag(y, 15) over o as y0 from s
        window w as (partition by user_id order by t rows unbounded preceding), o as (partition by user_id order by t)),
    m as (select l.*, door, px, py, inx, iny, sqrt(power(x - px, 2) + power(y - py, 2)) as metres from l, doors where x0 is not null and abs(x - px) <= 9 and abs(y - py) <= 9),
    q as (select m.user_id, m.t, m.door, m.metres, min(sqrt(power(m.x0 + p.cx - b.cx - m.px, 2) + power(m.y0 + p.cy - b.cy - m.py, 2))) as near, any_value((m.x0 + m.cx - b.cx - m.px) * m.inx + (m.y0 + m.cy - b.cy - m.py) * m.iny) as depth,
            any_value((m.x0 - m.px) * m.inx + (m.y0 - m.py) * m.iny) as began
        from m join l p on p.user_id = m.user_id and p.n between m.n - 14 and m.n join l b on b.user_id = m.user_id and b.n = m.n - 15 where m.metres <= 9 group by 1, 2, 3, 4),
    f as (select *, row_number() over (partition by user_id, t order by metres, door) as k from q where near <= 4 and depth >= 1.5 and began < 0)
    select user_id, t, door, round(depth, 6) as depth from f where k = 1""")
def by_trail(spark, d):
    s, doors = _steps(spark, d)
    return entering.enters_by_trail(s, doors, "user_id").withColumn("depth", F.round("depth", 6))


@query("q_st17_leaves_by_fix", """select event_id, event_type <> 'view' and value % 40 >= greatest(15, value % 13) and value % 13 <= 10 and event_id % 3 > 0 and not (event_id % 7 = 0) and value >= 30 as leaves from events""")
def by_fix(spark, d):
    e, v, k = table(spark, d, "events"), F.col("value"), F.col("event_id")
    return e.select("event_id", entering.leaves_by_fix(F.col("event_type") != "view", v % 40, v % 13, k % 3 > 0, k % 7 == 0, v).alias("leaves"))


@query("q_st22i_exit_places", f"""with {CAMPUS_NODES}, p as (select c_custkey as point, cast(c_custkey % 5 as int) as building, (c_custkey * 31) % 1000 / 10.0 as x, (c_custkey * 17) % 600 / 10.0 as y from customer),
    c as (select point, id, n.x as gx, n.y as gy, round(sqrt(power(p.x - n.x, 2) + power(p.y - n.y, 2)), 9) as d from p join nodes n using (building) where n.kind = 'HALL'),
    r as (select *, row_number() over (partition by point order by d, id) as k from c where d <= 8)
    select point, id as gate, coalesce(gx, x + 1) as out_x, coalesce(gy, y - 1) as out_y from p left join (select * from r where k = 1) using (point)""")
def exits(spark, d):
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("point"), (k % 5).cast("int").alias("building"), ((k * 31) % 1000 / 10.0).alias("x"), ((k * 17) % 600 / 10.0).alias("y"))
    p = p.withColumn("fix_x", F.col("x") + 1).withColumn("fix_y", F.col("y") - 1)
    return entering.exit_places(p, campus_nodes(spark, d).where("kind = 'HALL'"), ["building"]).select("point", "gate", "out_x", "out_y")


@query("q_st23n_along_axis", """with h as (select event_id, value * 3 as heading, event_id % 360::double as axis, event_id % 5 / 2.0 as length from events),
    o as (select *, abs(((heading - axis) % 360 + 540) % 360 - 180) as off from h), t as (select *, case when off <= 35 then axis when off >= 145 then axis + 180 end as there from o)
    select event_id, round(case when length >= 1.5 then there % 360 end, 6) as heading from t""")
def axis(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.round(entering.along_axis(F.col("value") * 3, (k % 360).cast("double"), k % 5 / 2.0), 6).alias("heading"))


@query("q_st23d_straight_stairs", """with s as (select o_custkey as climb, o_orderkey as t, o_custkey % 4 + 1 as treads, o_custkey % 2 = 0 as up, row_number() over (partition by o_custkey order by o_orderkey) as n from orders)
    select climb, min(t) as t, any_value(case when up then 3 else 1 end) as floor from s where n / (2.0 * treads) >= 0.75 group by climb""")
def straight(spark, d):
    k = F.col("o_custkey")
    s = table(spark, d, "orders").select(k.alias("climb"), F.col("o_orderkey").alias("t"), (k % 4 + 1).alias("treads"), (k % 2 == 0).alias("up"), F.lit(2).alias("floor"))
    return entering.straight_stairs(s, ["climb"])


@query("q_st23m_learnt_sides", """with c as (select user_id, event_id as n, 'B' || event_id % 2 as building, 'S' || event_id % 3 as stair, case when event_id % 2 = 0 then 1 else -1 end as turn, cast(event_id % 4 as int) as from_floor from events where event_type in ('view', 'click')),
    m as (select user_id, event_id as n, 'B' || event_id % 2 as building, cast(value as int) % 4 as floor from events where event_type = 'purchase'),
    b as (select user_id, n, 0 as kind, building, stair, turn, from_floor, null as floor from c union all select user_id, n, 1, building, null, null, null, floor from m),
    l as (select *, lag(n) over w as pn, lag(kind) over w as pk, lag(building) over w as pb, lag(stair) over w as ps, lag(turn) over w as pt, lag(from_floor) over w as pf from b window w as (partition by user_id order by n, kind)),
    t as (select *, case when floor > pf then pt else -pt end as u from l where kind = 1 and pk = 0 and n - pn <= 80 and building = pb and floor <> pf)
    select user_id, ps as stair, arg_max(u, n) as up_turn from t group by 1, 2""")
def sides(spark, d):
    k, e = F.col("event_id"), table(spark, d, "events")
    where = F.concat(F.lit("B"), (k % 2).cast("string")).alias("building")
    c = e.where("event_type in ('view', 'click')").select("user_id", k.alias("n"), where, F.concat(F.lit("S"), (k % 3).cast("string")).alias("stair"), F.when(k % 2 == 0, 1).otherwise(-1).alias("turn"), (k % 4).cast("int").alias("from_floor"))
    m = e.where("event_type = 'purchase'").select("user_id", k.alias("n"), where, (F.round("value").cast("int") % 4).alias("floor"))
    return entering.learnt_sides(c, m, "user_id")


@query("q_st11_floor_turns", f"""with {READINGS}, r as (select user_id, row_number() over (partition by user_id order by t) as run, cast(event_id % 9 as int) as n, value * 3 as heading from readings),
    c as (select *, coalesce(((heading - lag(heading) over w) % 360 + 540) % 360 - 180, 0) as c from r window w as (partition by user_id order by run)),
    s as (select *, sum(c) over (partition by user_id order by run rows unbounded preceding) as turned from c), f as (select user_id, run, turned - lag(turned) over (partition by user_id order by run) as turn from s where n >= 6)
    select user_id, run, round(turn, 6) as turn, cast(sign(turn) as int) as side from f where abs(turn) >= 135""")
def turns(spark, d):
    w = Window.partitionBy("user_id").orderBy("t")
    r = readings(spark, d).select("user_id", F.row_number().over(w).alias("run"), (F.col("event_id") % 9).cast("int").alias("n"), (F.col("value") * 3).alias("heading"))
    o = Window.partitionBy("user_id").orderBy("run")
    r = r.withColumn("_c", F.coalesce(geo.wrapped(F.col("heading") - F.lag("heading").over(o)), F.lit(0.0))).withColumn("turned", F.sum("_c").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return entering.floor_turns(r, "user_id").withColumn("turn", F.round("turn", 6))


@query("q_st23h_inferred_on_stairs", f"""with {CAMPUS_NODES}, p as (select c_custkey as point, cast(c_custkey % 5 as int) as building, cast(c_custkey % 3 as int) as floor, (c_custkey * 31) % 1000 / 10.0 as x, (c_custkey * 17) % 600 / 10.0 as y from customer),
    c as (select point, id, round(sqrt(power(p.x - n.x, 2) + power(p.y - n.y, 2)), 9) as d from p join nodes n using (building, floor) where n.kind = 'STAIRS'),
    r as (select *, row_number() over (partition by point order by d, id) as k from c where d <= 5) select point, id as stair, round(d, 6) as metres from r where k = 1""")
def inferred(spark, d):
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("point"), (k % 5).cast("int").alias("building"), (k % 3).cast("int").alias("floor"), ((k * 31) % 1000 / 10.0).alias("x"), ((k * 17) % 600 / 10.0).alias("y"))
    return entering.inferred_on_stairs(p, campus_nodes(spark, d).where("kind = 'STAIRS'"), ["building", "floor"]).select("point", "stair", F.round("metres", 6).alias("metres"))


ROUTES = """t as (select l_orderkey as route, l_linenumber as pos, min(l_suppkey) as s from lineitem group by 1, 2),
    p as (select route, pos, s, cast(s % 40 as double) as x, cast(s % 23 as double) as y, cast(s % 3 as int) as floor, case when s % 7 = 0 then 'ROOM' when s % 7 = 1 then 'DOOR' else 'HALL' end as node,
        case when s % 5 = 0 then 'OUT' when s % 11 = 0 then 'PASSAGE' else 'B' || (s % 2) end as place, s % 13 = 0 as steps from t),
    n as (select *, lead(floor) over w as nf, lead(place) over w as np, lead(pos) over w is null as last,
        lead(x) over w as nx, lead(y) over w as ny from p window w as (partition by route order by pos)),
    k as (select *, case when nf is null or nf = floor then 'WALK' when s % 4 = 0 then 'LIFT' else 'STAIRS' end as kind,
        first_value(case when place <> 'PASSAGE' then place end ignore nulls) over (partition by route order by pos rows between 1 following and unbounded following) as beyond from n),
    l as (select *, coalesce(sum(case when kind = 'WALK' and not last then sqrt(power(nx - x, 2) + power(ny - y, 2)) else 0 end) over (partition by route order by pos rows between unbounded preceding and 1 preceding), 0) as upto,
        sum(case when kind = 'LIFT' or steps or np <> place then 1 else 0 end) over (partition by route order by pos) as halt from k),
    f as (select *, sign(nf - floor) as way, lag(sign(nf - floor)) over w as pway, lag(upto) over w as pupto, lag(halt) over w as phalt from l where kind = 'STAIRS' and not last window w as (partition by route order by pos)),
    fg as (select *, sum(case when way = pway and upto - pupto <= 15 and halt = phalt then 0 else 1 end) over (partition by route order by pos) as g from f),
    d as (select route, pos, node, last, floor, lag(node) over w as n1, lag(node, 2) over w as n2, lag(x) over w as x1, lag(x, 2) over w as x2, lag(x, 3) over w as x3, lag(y) over w as y1, lag(y, 2) over w as y2, lag(y, 3) over w as y3 from p join n using (route, pos, node, floor, x, y, s, place, steps) window w as (partition by route order by pos)),
    o as (select *, (degrees(atan2(y1 - y2, x1 - x2)) - degrees(atan2(y2 - y3, x2 - x3)) + 540) % 360 - 180 as off from d where last),
    told as (
        select route, case when beyond = 'OUT' then 'exit' when place = 'OUT' then 'enter' else 'passage' end as action, null::int as floor, null as side from l where kind = 'WALK' and not last and place <> 'PASSAGE' and np <> place and beyond <> place
        union all select route, 'flight', null, null from l where kind = 'WALK' and steps and not last and np = place
        union all select route, 'lift', nf, null from l where kind = 'LIFT' and not last
        union all select route, case when sum(nf - floor) > 0 then 'up' else 'down' end, arg_max(nf, pos), null from fg group by route, g
        union all select route, case when arg_min(node, pos) = 'ROOM' then 'leave room' else 'start' end, arg_min(floor, pos), null from n group by route having count(*) > 1
        union all select route, 'arrive', floor, case when node = 'ROOM' and n1 = 'DOOR' and n2 is not null and x3 is not null then case when abs(off) < 30 then 'ahead' when off > 0 then 'right' else 'left' end end from o)"""


@query("q_g17_directions")
def told(spark, d):
    """Each order's lines as a route through buildings, passages and the open; a test has routes with known steps."""
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("route"), F.col("l_linenumber").alias("pos")).agg(F.min("l_suppkey").alias("s"))
    s, w = F.col("s"), Window.partitionBy("route").orderBy("pos")
    p = t.select("route", "pos", "s", (s % 40).cast("double").alias("x"), (s % 23).cast("double").alias("y"), (s % 3).cast("int").alias("floor"), F.when(s % 7 == 0, "ROOM").when(s % 7 == 1, "DOOR").otherwise("HALL").alias("node"), F.when(s % 5 == 0, "OUT").when(s % 11 == 0, "PASSAGE").otherwise(F.concat(F.lit("B"), (s % 2).cast("string"))).alias("place"), (s % 13 == 0).alias("steps"))
    nf = F.lead("floor").over(w)
    return directions.directions(p.withColumn("kind", F.when(nf.isNull() | (nf == F.col("floor")), "WALK").when(s % 4 == 0, "LIFT").otherwise("STAIRS")).drop("s"))


@query("q_g18_next_by_directions")
def next_told(spark, d):
    return directions.next_manoeuvre(told(spark, d))


@query("q_g17_told", f"with {ROUTES} select route, action, floor, side, count(*) as n from told group by all")
def told_often(spark, d):
    """How often a route tells each step, turns apart: their line is simplified, which SQL can't say."""
    steps = told(spark, d).where("action not in ('left', 'right', 'back')")
    return steps.groupBy("route", "action", "floor", "side").agg(F.count("*").alias("n"))


@query("q_st22e_enters_deep", """with n as (select user_id, row_number() over (partition by user_id order by event_id) as n, event_id from events),
    s0 as (select user_id, n as t, user_id % 4 * 10 + event_id % 5 * 0.4 as x, (n % 64 - 20) * 0.7 as y from n), s as (select *, y > 0 and y + x / 10 >= 15 as deep, user_id // 6 as building from s0),
    doors as (select s_suppkey as door, s_suppkey // 4 as building, s_suppkey % 4 * 10 as gx, 0.5 as gy, case when s_suppkey % 4 = 3 then 1 else 0 end as inx, case when s_suppkey % 4 = 3 then 0 else 1 end as iny from supplier),
    r as (select *, sum(case when deep and coalesce(before, false) then 0 else 1 end) over (partition by user_id order by t) as run from (select *, lag(deep) over (partition by user_id order by t) as before from s)),
    k as (select *, row_number() over (partition by user_id, run order by t) as k from r),
    e as (select user_id, t, building, x as px, y as py, coalesce(lag(t) over (partition by user_id order by t), 0) as last from k where deep and k = 3),
    m as (select e.user_id, e.t, px, py, door, inx, iny, s.t as since, s.x, s.y, sqrt(power(s.x - gx, 2) + power(s.y - gy, 2)) as metres from e join s on s.user_id = e.user_id and s.t between e.t - 39 and e.t and s.t > e.last join doors d on d.building = e.building),
    b as (select *, row_number() over (partition by user_id, t, door order by metres, since) as k from m where metres <= 12),
    d as (select *, row_number() over (partition by user_id, t order by metres, door) as o from b
        where k = 1 and sqrt(power(px - x, 2) + power(py - y, 2)) >= 1 and (px - x) * inx + (py - y) * iny >= sqrt(power(px - x, 2) + power(py - y, 2)) * cos(radians(45.0::double)))
    select e.user_id, e.t, e.building, d.door, round(d.metres, 6) as metres, d.since from e left join d on d.user_id = e.user_id and d.t = e.t and d.o = 1""")
def deep(spark, d):
    """Each user walks in and begins again after 64 steps, by one of the four doors of a building of suppliers; every fourth door leads sideways."""
    k, n, u = F.col("event_id"), F.col("n"), F.col("user_id")
    e = table(spark, d, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    s = e.select("user_id", n.alias("t"), (u % 4 * 10 + k % 5 * 0.4).alias("x"), ((n % 64 - 20) * 0.7).alias("y"), F.floor(u / 6).alias("_b"))
    s = s.select("user_id", "t", "x", "y", F.when(F.col("y") > 0, F.col("_b")).alias("building"), (F.col("y") + F.col("x") / 10).alias("wall"))
    k = F.col("s_suppkey")
    # buildings lie apart, so that a cell of the grid holds the doors of few
    doors = table(spark, d, "supplier").select(k.alias("door"), F.floor(k / 4).alias("building"), (k % 4 * 10 + F.floor(k / 4) * 1000.0).alias("x"), F.lit(0.5).alias("y"), F.when(k % 4 == 3, 1.0).otherwise(0.0).alias("inx"), F.when(k % 4 == 3, 0.0).otherwise(1.0).alias("iny"))
    s = s.withColumn("x", F.col("x") + F.floor(u / 6) * 1000.0)
    return entering.enters_deep(s, doors, "user_id").withColumn("metres", F.round("metres", 6))
