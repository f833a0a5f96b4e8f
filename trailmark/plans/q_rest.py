"""Lookups on edges and areas, seeds, recordings, and machines without SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import graph, lifts, timetable
from ..sources import readers, tables
from ..streaming.machines import step_gate, tilt_filter
from ..streaming.run import run_batch
from .registry import query
from .views import CAMPUS_NODES, READINGS, SLOTS, campus_nodes, readings, slots, table

SEGMENTS = """seg as (select n.id as edge, n.building, n.x as ax, n.y as ay, m.x as bx, m.y as bq from nodes n join nodes m on m.id = n.id + 5)"""
ALONG = "greatest(0, least(1, ((p.x - ax) * (bx - ax) + (p.y - ay) * (bq - ay)) / nullif((bx - ax) * (bx - ax) + (bq - ay) * (bq - ay), 0)))"


@query("q_j09_nearest_edge_point", f"""with {CAMPUS_NODES}, {SEGMENTS}, p as (select c_custkey as point, cast(c_custkey % 5 as int) as building, (c_custkey * 31) % 1000 / 10.0 as x, (c_custkey * 17) % 600 / 10.0 as y from customer),
    t as (select point, edge, {ALONG} as t, p.x - ax as ux, p.y - ay as uy, bx - ax as vx, bq - ay as vy from p join seg using (building)),
    o as (select point, edge, t, round(sqrt(power(ux - t * vx, 2) + power(uy - t * vy, 2)), 9) as d from t), r as (select *, row_number() over (partition by point order by d, edge) as n from o)
    select p.point, edge, round(t, 6) as share, round(d, 6) as distance from p left join (select * from r where n = 1) using (point)""")
def nearest_edge(spark, d):
    n = campus_nodes(spark, d)
    m = n.select((F.col("id") - 5).alias("id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    s = n.join(m, "id").select(F.col("id").alias("edge"), "building", F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by")
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("point"), (k % 5).cast("int").alias("building"), ((k * 31) % 1000 / 10.0).alias("x"), ((k * 17) % 600 / 10.0).alias("y"))
    return graph.nearest_on_edges(p, s, ["building"], 15.0).select("point", "edge", F.round("share", 6).alias("share"), F.round("distance", 6).alias("distance"))


@query("q_j10_point_in_area", """with p as (select c_custkey as point, (c_custkey * 7919) % 1300 / 10.0 - 15.05::double as x, (c_custkey * 104729) % 900 / 10.0 - 15.05::double as y from customer),
    a(id, x0, y0, x1, y1, hole) as (values (1, 0, 0, 40, 40, 10), (2, 30, 20, 90, 60, 5), (3, 100, 0, 110, 70, 0)),
    h as (select point, min(id) as area from p join a on x > x0 and x < x1 and y > y0 and y < y1 and not (hole > 0 and x > x0 + hole and x < x0 + 2 * hole and y > y0 + hole and y < y0 + 2 * hole) group by point)
    select point, area from p left join h using (point)""")
def in_area(spark, d):
    box = lambda x0, y0, x1, y1: [[float(x0), float(y0)], [float(x1), float(y0)], [float(x1), float(y1)], [float(x0), float(y1)]]
    rows = [(i, box(a, b, c, e), [box(a + h, b + h, a + 2 * h, b + 2 * h)] if h else []) for i, a, b, c, e, h in ((1, 0, 0, 40, 40, 10), (2, 30, 20, 90, 60, 5), (3, 100, 0, 110, 70, 0))]
    areas = spark.createDataFrame(rows, "id int, outline array<array<double>>, holes array<array<array<double>>>")
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("point"), ((k * 7919) % 1300 / 10.0 - 15.05).alias("x"), ((k * 104729) % 900 / 10.0 - 15.05).alias("y"))
    return graph.containing(p, areas).select("point", "area")


@query("q_g18_next_manoeuvre")
def next_manoeuvre(spark, d):
    from .q_places import instructions

    first = instructions(spark, d).where("seq > 1").groupBy("route").agg(F.min(F.struct("seq", "action", "metres")).alias("x"))
    return first.select("route", "x.action", "x.metres")


@query("q_w05_last_readings", f"with {READINGS} select event_id, round(avg(value) over (partition by user_id order by t rows between 11 preceding and current row), 6) as mean from readings")
def last_readings(spark, d):
    w = Window.partitionBy("user_id").orderBy("t").rowsBetween(-11, 0)
    return readings(spark, d).select("event_id", F.round(F.avg("value").over(w), 6).alias("mean"))


@query("q_w03_turned", f"""with {READINGS}, c as (select *, coalesce(((value - lag(value) over (partition by user_id order by t)) % 360 + 540) % 360 - 180, 0) as c from readings)
    select event_id, round(sum(c) over (partition by user_id order by t rows unbounded preceding), 6) + 0.0::double as turned from c""")
def turned(spark, d):
    w = Window.partitionBy("user_id").orderBy("t")
    c = readings(spark, d).withColumn("_c", F.coalesce(geo.wrapped(F.col("value") - F.lag("value").over(w)), F.lit(0.0)))
    return c.select("event_id", (F.round(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6) + 0.0).alias("turned"))


@query("q_a01_slots_by_room", f"with {SLOTS} select room, count(*) as n, count(distinct timetable) as n_timetables, min(st) as first_start, max(en) as last_end from slots group by room")
def by_room(spark, d):
    return slots(spark, d).groupBy("room").agg(F.count("*").alias("n"), F.count_distinct("timetable").alias("n_timetables"), F.min("st").alias("first_start"), F.max("en").alias("last_end"))


@query("q_a03_people_moving", f"""with {SLOTS}, m as (select distinct room, dow, st, en from slots)
    select room, sum((case when abs(st - 660) <= 10 then 1 else 0 end + case when abs(en - 660) <= 10 then 1 else 0 end) * 10.0::double) as people from m where abs(st - 660) <= 10 or abs(en - 660) <= 10 group by room""")
def moving(spark, d):
    m = slots(spark, d).select("room", "dow", "st", "en").distinct().withColumn("people", F.lit(10.0))
    return timetable.people_moving(m, "room", 660)


@query("q_o01_stable_order", f"with {SLOTS} select item, row_number() over (partition by room, dow order by st, en, item) as place from slots")
def stable(spark, d):
    return slots(spark, d).select("item", F.row_number().over(Window.partitionBy("room", "dow").orderBy("st", "en", "item")).alias("place"))


@query("q_o06_union", "select c_custkey as id, 'c' as kind from customer union all select s_suppkey, 's' from supplier")
def union(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("c").alias("kind"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("s").alias("kind")))


@query("q_s03_seed_and_rebuild", "select n_nationkey, n_name, 2 as version from nation")
def seeded(spark, d):
    """A table that is seeded once, and built anew under a new version."""
    base = f"{graph.shared_dir(spark)}/nation-{uuid.uuid4().hex}"
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    tables.rebuild(spark, n.where("n_nationkey < 3"), base, 1)
    tables.rebuild(spark, n, base, 2)
    return tables.rebuild(spark, n.where("false"), base, 2).withColumn("version", F.lit(2))


@query("q_s09_recording_rows", "select event_id as line, case event_id % 3 when 0 then 'A' when 1 then 'G' else 'X' end as tag, event_id * 1000 as t_ns, case when event_id % 3 < 2 then value end as x, case when event_id % 3 = 2 then event_type end as text from events")
def recorded(spark, d):
    k = F.col("event_id")
    tag = F.when(k % 3 == 0, "A").when(k % 3 == 1, "G").otherwise("X")
    rest = F.when(k % 3 < 2, F.concat_ws(",", F.col("value").cast("string"), F.lit("1.0"), F.lit("2.0"))).otherwise(F.col("event_type"))
    lines = table(spark, d, "events").select(k.alias("line"), F.concat_ws(",", tag, (k * 1000).cast("string"), rest).alias("value"))
    return readers.recording(lines).select("line", "tag", "t_ns", "x", "text")


@query("q_st8_lift_rides", """with n as (select user_id, row_number() over (partition by user_id order by event_id) as n, value, event_id from events),
    e as (select user_id, n // 500 as session, n * 500000000 as t, case n % 12 when 0 then 0.7 when 1 then 0.6 when 2 then 0.5 when 6 then -0.6 when 7 then -0.6 when 8 then -0.5 else 0 end + value % 1 / 8 as mean,
        event_id % 10 / 12.0 + case when n % 12 in (0, 1, 2) then 0 else 0.1 end as std, case when event_id % 5 = 0 then 1 else 0 end as steps from n),
    h as (select *, list(mean) over (partition by user_id, session order by t rows between 40 preceding and 1 preceding) as held from e),
    a as (select *, mean - list_sort(held)[len(held) // 2 + 1] as a from h),
    s as (select *, case when len(held) < 10 or held is null then 0 when a > 0.15 then 1 when a < -0.15 then -1 else 0 end as s, len(held) >= 10 as based, (std < 0.8 and steps = 0) or (std < 0.55 and steps > 0) as quiet from a),
    g as (select *, lag(std) over w as before, not quiet and s <> 0 and coalesce(lag(s) over w = s and lag(quiet) over w and lead(s) over w = s and lead(quiet) over w, false) as bridge, lag(s) over w as ps from s window w as (partition by user_id, session order by t)),
    i as (select *, s <> 0 and (quiet or bridge) as ins from g),
    j as (select *, case when coalesce(ps <> s or not lag(ins) over (partition by user_id, session order by t), true) then 1 else 0 end as new from i),
    k as (select *, sum(new) over (partition by user_id, session order by t) as run from j where based),
    b as (select *, sum(case when bridge then 1 else 0 end) over (partition by user_id, session, run order by t) as nb from k where ins),
    p as (select user_id, session, min(t) as start, max(t) + 500000000 as stop, any_value(s) as sign, round(sum(a * 0.5), 9) as dv, count(*) as n, round(avg(case when quiet then std end), 9) as m, sum(case when quiet then std end) as total, count(case when quiet then 1 end) as calm, arg_min(std, case when quiet then t end) as first_std, arg_min(before, t) as before
        from b where not bridge or nb = 1 group by user_id, session, run, greatest(0, nb - 1)),
    q as (select *, m >= 0.45 as loose from p where n >= 2 and abs(dv) >= 0.4),
    r as (select * from q where not loose or (calm >= 3 and first_std >= 0.45 and round((total - first_std) / (calm - 1), 9) < 0.45)),
    x as (select *, lead(start) over w as qs, lead(stop) over w as qe, lead(sign) over w as qsign, lead(dv) over w as qdv, lead(loose) over w as qloose from r window w as (partition by user_id, session order by start)),
    y as (select x.user_id, x.session, x.start, sum(case when e.steps > 0 and not (e.std < 0.55) then e.steps else 0 end) as walk, sum(e.steps) as steps, coalesce(max(case when e.steps > 0 then e.t end) - min(case when e.steps > 0 then e.t end), 0) as span
        from x left join e on e.user_id = x.user_id and e.session = x.session and e.t >= x.stop and e.t < x.qs group by 1, 2, 3),
    z as (select x.*, coalesce(walk, 0) as walk, coalesce(steps, 0) as steps, span, qsign = -sign and qs - stop <= 45000000000 and abs(qdv) / abs(dv) between 0.5 and 2 as fits, least(abs(dv), abs(qdv)) as weak from x join y using (user_id, session, start)),
    v as (select *, case when fits and not loose and not qloose and (walk <= 2 or (weak >= 1 and steps <= 6 and span <= 3000000000)) then 1
        when fits and (walk <= 2 or (weak >= 0.6 and steps <= 6 and span <= 3000000000)) and coalesce(before, 0) < 1 then 2 end as how from z),
    c as (select *, sum(case when prev is null then 1 else 0 end) over (partition by user_id, session order by start) as chain from (select *, lag(how) over (partition by user_id, session order by start) as prev from v)),
    o as (select *, row_number() over (partition by user_id, session, chain order by start) as nth from c)
    select user_id, session, start, qe as stop, cast(sign as int) as direction, how = 2 as relaxed from o where how is not null and nth % 2 = 1""")
def rides(spark, d):
    """Bins of half a second made of a user's events, with pushes up and down in turn."""
    k = F.col("event_id")
    e = table(spark, d, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    at = F.col("n") % 12
    push = F.when(at == 0, 0.7).when(at == 1, 0.6).when(at == 2, 0.5).when(at.isin(6, 7), -0.6).when(at == 8, -0.5).otherwise(0.0)
    b = e.select("user_id", F.floor(F.col("n") / 500).alias("session"), (F.col("n") * 500_000_000).alias("t"), (push + F.col("value") % 1 / 8).alias("mean"), (k % 10 / 12 + F.when(at.isin(0, 1, 2), 0.0).otherwise(0.1)).alias("std"), F.when(k % 5 == 0, 1).otherwise(0).alias("steps"))
    return lifts.lift_rides(b, "user_id")


@query("q_st5_step_gate", f"""with {READINGS}, g as (select user_id, t * 1000 as t, case when t - lag(t) over w >= {20_000_000_000} or lag(t) over w is null then 1 else 0 end as fresh from readings window w as (partition by user_id order by t)),
    s as (select *, sum(fresh) over (partition by user_id order by t rows unbounded preceding) as burst from g), n as (select *, row_number() over (partition by user_id, burst order by t) as k, count(*) over (partition by user_id, burst) as size from s)
    select user_id, t, k < 4 as late from n where size >= 4""")
def gate(spark, d):
    return run_batch(readings(spark, d).select("user_id", (F.col("t") * 1000).alias("t")), "user_id", step_gate(4, 20_000_000_000_000))


@query("q_st13_tilt_filter")
def tilt(spark, d):
    v, k = F.col("value"), F.col("event_id")
    r = readings(spark, d).select("user_id", (F.col("t") * 1000).alias("t"), (v / 1e6).alias("gx"), (k % 10 / 1e6).alias("gy"), F.sin(v).alias("ax"), F.cos(v).alias("ay"), F.lit(9.0).alias("az"))
    return run_batch(r, "user_id", tilt_filter())


@query("q_st22d_at_door_lately", f"""with {READINGS}, x as (select event_id, event_type, max(case when event_type = 'view' then t end) over (partition by user_id order by t range between 86400000000 preceding and current row) as seen from readings)
    select event_id, seen is not null as at_door from x where event_type = 'purchase'""")
def at_door(spark, d):
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-86_400_000_000, 0)
    r = readings(spark, d).withColumn("_s", F.max(F.when(F.col("event_type") == "view", F.col("t"))).over(w))
    return r.where("event_type = 'purchase'").select("event_id", F.col("_s").isNotNull().alias("at_door"))
