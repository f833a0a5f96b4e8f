"""Climbs, descents, doors and route starts, over the events of users and the campus places."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import climbing, entering
from ..streaming.machines import walking_direction
from ..streaming.run import run_batch
from .registry import query
from .views import CAMPUS_NODES, campus_nodes, table

def _columns():
    return F.col("event_id"), F.col("value"), F.col("user_id")


def _numbered(spark, d):
    return table(spark, d, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)


NUMBERED = "e as (select *, row_number() over (partition by user_id order by event_id) - 1 as n from events)"


@query("q_st23b_climb_paths", f"""with {NUMBERED}, h as (select user_id, n // 60 as climb, event_id as seq, case when user_id % 7 = 0 then 60 else 160 * (user_id % 2 * 2 - 1) end as turn, n, value from e),
    s as (select user_id, climb, seq, (n // 8) * turn + greatest(n % 8 - 4, 0) * turn / 4.0 + value % 5 as heading from h),
    c as (select distinct user_id, climb, cast((user_id + climb) % 4 as int) as floor, 3 + user_id % 5 as treads, case when user_id % 3 > 0 then user_id % 3 * 2 - 3 end as learnt, user_id % 2 * 2 - 1 as told from s),
    t as (select *, coalesce(((heading - lag(heading) over w) % 360 + 540) % 360 - 180, 0) as t from s window w as (partition by user_id, climb order by seq)),
    b as (select *, abs(t) > 10 or coalesce(abs(lag(t) over w) > 10, false) as bend from t window w as (partition by user_id, climb order by seq)),
    i as (select *, coalesce(bend <> lag(bend) over w, true) as begins from b window w as (partition by user_id, climb order by seq)),
    j as (select *, sum(case when begins then 1 else 0 end) over (partition by user_id, climb order by seq) as island from i),
    a as (select *, sum(t) over (partition by user_id, climb, island) as angle, sum(t) over (partition by user_id, climb, island order by seq) as turned from j),
    l as (select *, bend and abs(angle) >= 135 as landing from a),
    k as (select *, sum(case when landing and begins then 1 else 0 end) over (partition by user_id, climb order by seq) as k, first_value(case when landing then sign(angle) end ignore nulls) over (partition by user_id, climb order by seq rows between unbounded preceding and unbounded following) as side from l),
    r as (select *, row_number() over (partition by user_id, climb, k, landing order by seq) as nth from k),
    z as (select r.*, c.floor, c.treads, c.learnt, c.told,
        (bend and not landing and abs(angle) > 45) or (landing and k % 2 = 0 and sign(angle) <> side) or (not landing and case when k % 2 = 1 then nth >= treads + 3 else nth > 24 end) as leaves,
        greatest(0, least(3, c.floor + case when c.floor <= 0 then 1 when c.floor >= 3 then -1 else coalesce(side * learnt, side * told, 1) end * case when landing then k // 2 else (k + 1) // 2 end)) as level
        from r join c using (user_id, climb)),
    f as (select *, max(leaves) over (partition by user_id, climb order by seq) as left_ from z)
    select user_id, climb, seq, case when left_ then 'LEFT' when landing then case when k % 2 = 1 then 'LANDING' else 'FLOOR_LANDING' end when k % 2 = 1 then 'SECOND' else 'FIRST' end as part,
        round(case when left_ then 0 when landing then least(1, abs(turned) / 180) else least(1, nth / treads::double) end, 6) as progress,
        cast(coalesce(last_value(case when not left_ then level end ignore nulls) over (partition by user_id, climb order by seq rows unbounded preceding), floor) as int) as floor from f""")
def climbs(spark, d):
    k, v, u = _columns()
    e = _numbered(spark, d)
    turn = F.when(u % 7 == 0, 60).otherwise(160 * (u % 2 * 2 - 1))
    climb = F.floor(F.col("n") / 60)
    s = e.select("user_id", climb.alias("climb"), k.alias("seq"), (F.floor(F.col("n") / 8) * turn + F.greatest(F.col("n") % 8 - 4, F.lit(0)) * turn / 4 + v % 5).alias("heading"))
    c = s.select("user_id", "climb").distinct().select("user_id", "climb", ((u + F.col("climb")) % 4).cast("int").alias("floor"), (3 + u % 5).alias("treads"), F.lit(0).alias("lowest"), F.lit(3).alias("highest"), F.when(u % 3 > 0, u % 3 * 2 - 3).alias("learnt"), (u % 2 * 2 - 1).alias("told"))
    return climbing.climb_paths(s, c, "user_id").withColumn("progress", F.round("progress", 6))


@query("q_st23f_held_descents", f"""with {NUMBERED}, s as (select user_id, n // 20 as climb, event_id as seq, case when event_id % 11 > 0 then value % 1 end as score from e),
    w as (select *, row_number() over p as nth, sum(case when score >= 0.4 then 1 else 0 end) over (partition by user_id, climb order by seq rows 2 preceding) as alike from s window p as (partition by user_id, climb order by seq)),
    y as (select *, case when score is null then 'blind' when alike >= 2 then 'gait' when nth > 10 then 'patience' end as why from w)
    select user_id, climb, min(seq) as seq, arg_min(why, seq) as why from y where why is not null group by 1, 2""")
def descents(spark, d):
    k, v, u = _columns()
    s = _numbered(spark, d).select("user_id", F.floor(F.col("n") / 20).alias("climb"), k.alias("seq"), F.when(k % 11 > 0, v % 1).alias("score"))
    return climbing.held_descents(s, "user_id")


@query("q_g20_stair_lines", f"""with {CAMPUS_NODES}, e as (select p.id as a, q.id as b, p.id % 7 as stair, p.floor as fa, q.floor as fb, p.x, p.y from nodes p join nodes q on abs(p.id - q.id) = 5 where p.floor <> q.floor),
    v as (select n_nationkey as variant, n_nationkey % 7 as stair, n_nationkey % 3 as floor, n_nationkey * 1.5 as px, n_nationkey % 4 * 2.0 as py from nation),
    c as (select *, px as x0, py as y0, px + variant % 2 * 4 as x1, py + (1 - variant % 2) * 4 as y1, px + 5 as x2, py + 5 as y2, px + 1 as x3, py + 7 as y3 from v),
    j as (select *, case when fa < fb then x0 else x3 end as fx, case when fa < fb then y0 else y3 end as fy, case when fa < fb then x1 else x2 end as tx, case when fa < fb then y1 else y2 end as ty from e join c on e.stair = c.stair and e.fa = c.floor),
    k as (select *, case when abs(fx - tx) < abs(fy - ty) then fx else x end as cx, case when abs(fx - tx) < abs(fy - ty) then y else fy end as cy, abs(x - fx) >= 1e-4 or abs(y - fy) >= 1e-4 as beside from j)
    select a, b, variant, cast(3 + case when beside then 1 else 0 end + case when fa < fb then 0 else 1 end as int) as points,
        round(case when beside then sqrt(power(cx - fx, 2) + power(cy - fy, 2)) else 0 end + sqrt(power(fx - tx, 2) + power(fy - ty, 2)) + sqrt(power(x1 - x2, 2) + power(y1 - y2, 2)) + case when fa < fb then 0 else 0.35 * sqrt(power(x0 - x1, 2) + power(y0 - y1, 2)) end, 6) as metres from k""")
def lines(spark, d):
    n = campus_nodes(spark, d)
    p, q = (n.select(F.col("id").alias(i), F.col("floor").alias(f"floor_{i}"), *x) for i, x in (("a", ["x", "y"]), ("b", [])))
    near = lambda by: p.join(q, F.col("b") == F.col("a") + by)
    edges = near(5).unionByName(near(-5)).withColumn("stair", F.col("a") % 7)
    k = F.col("n_nationkey")
    x, y = k * 1.5, (k % 4 * 2).cast("double")
    at = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    paths = table(spark, d, "nation").select((k % 7).alias("stair"), (k % 3).alias("floor"), k.alias("variant"), F.array(at(x, y), at(x + k % 2 * 4, y + (1 - k % 2) * 4), at(x + 5, y + 5), at(x + 1, y + 7)).alias("points"))
    return climbing.stair_lines(edges, paths).select("a", "b", "variant", F.size("line").alias("points"), F.round("metres", 6).alias("metres"))


_PLACES = "event_id as t, (event_id * 37) % 1000 / 10.0 as x, (event_id * 53) % 600 / 10.0 as y"


@query("q_st22a_enters_by_outline", f"""with {CAMPUS_NODES}, g as (select id as door, x as gx, y as gy, cos(radians(id * 40 % 360)) as inx, sin(radians(id * 40 % 360)) as iny from nodes),
    s as (select user_id, event_id as t, row_number() over (partition by user_id order by event_id) as n, (user_id * 11) % 100 + value % 7 as x, (user_id * 17) % 60 + value % 5 as y, value % 3 - 1 as dx, value % 2 - 0.7 as dy, value % 6 - 1 as depth from events),
    m as (select *, sqrt(power(x - gx, 2) + power(y - gy, 2)) as metres from s, g),
    o as (select *, case when n - lag(n) over (partition by user_id, door order by n) = 1 then 0 else 1 end as new from m where metres <= 12),
    p as (select *, sum(new) over (partition by user_id, door order by n) as stay from o),
    q as (select *, first_value(case when depth >= 1.5 and metres <= 6 then n end ignore nulls) over w as fn, first_value(case when depth >= 1.5 and metres <= 6 then metres end ignore nulls) over w as fm from p window w as (partition by user_id, door, stay order by n rows unbounded preceding)),
    r as (select *, sum(case when n > fn then sqrt(dx * dx + dy * dy) else 0 end) over (partition by user_id, door, stay order by n) as walked from q where fn is not null),
    f as (select user_id, door, min(t) as t, arg_min(metres, t) as metres from r where walked >= fm - 1 and not (n > fn and dx * inx + dy * iny < 0) group by user_id, door, stay)
    select user_id, t, door from (select *, row_number() over (partition by user_id, t order by metres, door) as k from f) where k = 1""")
def outline(spark, d):
    k, v, u = _columns()
    s = table(spark, d, "events").select("user_id", k.alias("t"), (u * 11 % 100 + v % 7).alias("x"), (u * 17 % 60 + v % 5).alias("y"), (v % 3 - 1).alias("dx"), (v % 2 - 0.7).alias("dy"), (v % 6 - 1).alias("depth"))
    i = F.radians(F.col("id") * 40 % 360)
    return entering.enters_by_outline(s, campus_nodes(spark, d).select(F.col("id").alias("door"), "x", "y", F.cos(i).alias("inx"), F.sin(i).alias("iny")), "user_id")


@query("q_st22g_leaves_by_gate", f"""with {CAMPUS_NODES}, g as (select id as gate, x as gx, y as gy, x - id % 3 as ix, y - 1 - id % 2 as iy, id % 2 = 0 as outer_ from nodes),
    s as (select user_id, {_PLACES}, value % 5 - 1 as ox, value % 4 - 1 as oy, (value * 3) % 360 as heading from events),
    h as (select *, x + ox as fx, y + oy as fy, lag(heading) over w as h1, lag(heading, 2) over w as h2 from s window w as (partition by user_id order by t)),
    m as (select *, sqrt(power(x - gx, 2) + power(y - gy, 2)) as metres, gx - ix as dx, gy - iy as dy from h, g where abs(x - gx) <= 5 and abs(y - gy) <= 5),
    a as (select *, case when abs(dx) >= abs(dy) then dx else 0 end as ax, case when abs(dx) >= abs(dy) then 0 else dy end as ay from m where metres <= 5),
    b as (select *, ((fx - gx) * dx + (fy - gy) * dy) / sqrt(dx * dx + dy * dy) as along, ((fx - gx) * ax + (fy - gy) * ay) / sqrt(ax * ax + ay * ay) as square, degrees(atan2(ax, ay)) as out_ from a),
    c as (select *, metres <= 0.3 and greatest(along, square) >= 1 as by_gate,
        outer_ and sqrt(power(fx - gx, 2) + power(fy - gy, 2)) <= 5 and square >= 0.3 and least(abs(((heading - out_) % 360 + 540) % 360 - 180), coalesce(abs(((h1 - out_) % 360 + 540) % 360 - 180), 999), coalesce(abs(((h2 - out_) % 360 + 540) % 360 - 180), 999)) <= 30 as by_door from b),
    e as (select *, round(case when by_gate then greatest(along, square) else greatest(square, 1) end, 9) as beyond from c where by_gate or by_door)
    select user_id, t, gate, round(beyond, 6) as beyond from (select *, row_number() over (partition by user_id, t order by beyond desc, gate) as k from e) where k = 1""")
def gates(spark, d):
    k, v, u = _columns()
    x, y = k * 37 % 1000 / 10, k * 53 % 600 / 10
    s = table(spark, d, "events").select("user_id", k.alias("t"), x.alias("on_x"), y.alias("on_y"), (x + (v % 5 - 1)).alias("x"), (y + (v % 4 - 1)).alias("y"), (v * 3 % 360).alias("heading"))
    i = F.col("id")
    g = campus_nodes(spark, d).select(i.alias("gate"), "x", "y", (F.col("x") - i % 3).alias("inner_x"), (F.col("y") - 1 - i % 2).alias("inner_y"), (i % 2 == 0).alias("outer"))
    return entering.leaves_by_gate(s, g, "user_id").withColumn("beyond", F.round("beyond", 6))


@query("q_st21_dispatch", """with o as (select user_id, event_id as t, case when value > 150 then 'passage' when event_id % 9 = 0 then 'climb' when event_type = 'purchase' then 'enter' end as by_,
        case when value > 150 then 'P' || event_id % 3 when event_id % 9 = 0 then 'S' || event_id % 2 when event_type = 'purchase' then 'B' || user_id % 4 end as place from events)
    select user_id, t, by_ as "by", last_value(place ignore nulls) over (partition by user_id order by t rows unbounded preceding) as place from o""")
def dispatched(spark, d):
    k, v, u = _columns()
    e = table(spark, d, "events").withColumn("t", k)
    named = lambda letter, number: F.concat(F.lit(letter), number.cast("string")).alias("place")
    passage, climb, enter = e.where(v > 150), e.where(k % 9 == 0), e.where("event_type = 'purchase'")
    outcomes = [("passage", passage.select("user_id", "t", named("P", k % 3))), ("climb", climb.select("user_id", "t", named("S", k % 2))), ("enter", enter.select("user_id", "t", named("B", u % 4)))]
    return entering.dispatch(e, outcomes, "user_id")


@query("q_q17_route_starts", """with r as (select event_id as request, user_id, event_id as t from events where event_type = 'signup'),
    p as (select user_id, event_id as t, value as x, value / 2 as y from events where event_type = 'view'),
    f as (select user_id, event_id as t, value as x, value / 3 as y from events where event_type = 'click' and value % 60 <= 30),
    a as (select r.*, case when r.t - p.t <= 300 then p.x end as px, case when r.t - p.t <= 300 then p.y end as py from r asof left join p on r.user_id = p.user_id and r.t >= p.t),
    b as (select a.*, case when a.t - f.t <= 900 then f.x end as fx, case when a.t - f.t <= 900 then f.y end as fy from a asof left join f on a.user_id = f.user_id and a.t >= f.t)
    select request, case when px is not null then 'place' when fx is not null then 'fix' else 'entrance' end as source, coalesce(px, fx, 1.0) as x, coalesce(py, fy, 2.0) as y from b""")
def starts(spark, d):
    k, v, u = _columns()
    e = table(spark, d, "events").withColumn("t", k)
    r = e.where("event_type = 'signup'").select(k.alias("request"), "user_id", "t")
    p = e.where("event_type = 'view'").select("user_id", "t", v.alias("x"), (v / 2).alias("y"))
    f = e.where("event_type = 'click'").select("user_id", "t", v.alias("x"), (v / 3).alias("y"), (v % 60).alias("accuracy"))
    return entering.route_starts(r, p, f, (1.0, 2.0), "user_id", (300, 900))


@query("q_st3_walking_direction")
def ways(spark, d):
    """Headings of a user's steps as told first and told again; tests have walks whose way is known."""
    k, v, u = _columns()
    n = F.col("n").cast("long")
    e = _numbered(spark, d).select(
        "user_id", (n * 600_000_000 + F.when(n % 40 > 30, n * 10_000_000_000).otherwise(0)).alias("t"), k.alias("seq"), (F.floor(n / 9) * 70 + v % 9).cast("double").alias("phone"),
        F.when(v % 5 > 1, F.floor(n / 18) * 100 + v % 7).cast("double").alias("phase"), (n % 50 > 45).alias("stairs"), F.when(n % 30 > 1, F.floor(n / 30)).cast("int").alias("pose"), (n % 60 > 30).alias("level"))
    return run_batch(e, "user_id", walking_direction())
