"""Smaller operators: checks, fits, loops, lookups, orders and limits."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, motion
from ..operators.matching import load_floor, match, way_tables
from ..operators.search import numbered
from .registry import query
from .views import CAMPUS_NODES, READINGS, SLOTS, campus_nodes, readings, slots, table


@query("q_st12_loops", f"with {READINGS}, s as (select event_id, round(sum(value - 100) over (partition by user_id order by t rows between 39 preceding and current row), 6) as turned from readings) select event_id, turned, abs(turned) >= 330 as loop from s")
def loops(spark, d):
    r = motion.loops(readings(spark, d).withColumn("turn", F.col("value") - 100), ["user_id"], ["t"], "turn")
    return r.select("event_id", F.round("turned", 6).alias("turned"), (F.abs(F.round("turned", 6)) >= 330).alias("loop"))


@query("q_st26_heading_check", f"""with {READINGS}, m as (select event_id, value - 50 as dx, event_id % 40 - 20.0 as dy, value - 45 as tx, event_id % 37 - 18.0 as ty, abs(value - 50) + 8 as len from readings),
    e as (select *, sqrt(tx * tx + ty * ty) as tr, sqrt(dx * dx + dy * dy) as gone, ((degrees(atan2(dx, -dy)) - degrees(atan2(tx, -ty))) % 360 + 540) % 360 - 180 as err from m)
    select event_id, round(err, 5) as error, tr >= 10 and gone >= 0.85 * len and len / tr between 0.7 and 1.4 as reliable from e""")
def heading_check(spark, d):
    v, k = F.col("value"), F.col("event_id")
    r = readings(spark, d).select("event_id", (v - 50).alias("dx"), (k % 40 - 20.0).alias("dy"), (v - 45).alias("tx"), (k % 37 - 18.0).alias("ty"), (F.abs(v - 50) + 8).alias("length"))
    return motion.heading_check(r).select("event_id", F.round("error", 5).alias("error"), "reliable")


@query("q_st18_course_mismatch", f"""with {READINGS}, o as (select *, ((value * 2 - event_id % 90) % 360 + 540) % 360 - 180 as off from readings), w as (select event_id, count(*) over v as n, avg(off) over v as m from o window v as (partition by user_id order by t rows between 7 preceding and current row))
    select event_id, case when n = 8 and abs(m) > 40 then round(m, 6) end as mismatch from w""")
def course(spark, d):
    r = readings(spark, d).withColumn("h", F.col("event_id") % 90).withColumn("c", F.col("value") * 2)
    return motion.course_mismatch(r, ["user_id"], ["t"], "h", "c").select("event_id", F.round("mismatch", 6).alias("mismatch"))


@query("q_m08_similarity_fit", """with p as (select s_suppkey % 5 as k, (s_suppkey * 37) % 1000 / 10.0 as x, (s_suppkey * 53) % 600 / 10.0 as y, s_suppkey from supplier),
    q as (select *, 2 * (x * 0.8::double - y * 0.6::double) + 10 as u, 2 * (x * 0.6::double + y * 0.8::double) - 5 as v from p)
    select k, 2.0::double as scale, round(degrees(atan2(0.6::double, 0.8::double)), 6) as rotation, 10.0::double as dx, -5.0::double as dy from q group by k""")
def similarity(spark, d):
    k = F.col("s_suppkey")
    p = table(spark, d, "supplier").select((k % 5).alias("k"), ((k * 37) % 1000 / 10.0).alias("x"), ((k * 53) % 600 / 10.0).alias("y"))
    p = p.withColumn("u", 2 * (F.col("x") * 0.8 - F.col("y") * 0.6) + 10).withColumn("v", 2 * (F.col("x") * 0.6 + F.col("y") * 0.8) - 5)
    return graph.similarity(p, ["k"]).select("k", *[F.round(c, 6).alias(c) for c in ("scale", "rotation", "dx", "dy")])


@query("q_q18_crowd_percent", "with p as (select l_orderkey as request, cast(round((max(1 + l_discount * 2) - 1) * 100) as int) as p from lineitem group by 1) select request, case when p >= 5 then p end as percent from p")
def crowd(spark, d):
    return graph.crowd_percent(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request"), (1 + F.col("l_discount") * 2).alias("crowd")))


@query("q_g07_fallback", "select o_orderkey as request, o_totalprice as seconds, o_orderkey % 3 = 0 as fallback from orders")
def fallback(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_totalprice").alias("seconds"))
    return graph.with_fallback(o.where("request % 3 <> 0"), o)


@query("q_g19_stair_keys", """with i as (select 'N' || (p_partkey % 9) || '-S' || (p_size % 3) || '-' || (p_partkey % 4) || case when p_partkey % 5 = 0 then '-D' else '' end as id from part),
    k as (select regexp_replace(id, '-D$', '') as p, id like '%-D' as d from i)
    select regexp_replace(p, '-?\\d+$', '') as key, min(cast(regexp_extract(p, '(-?\\d+)$', 1) as int)) as lowest, max(cast(regexp_extract(p, '(-?\\d+)$', 1) as int)) as highest, cast(sum(d::int) as bigint) as n_down from k group by 1""")
def stair_keys(spark, d):
    k = F.col("p_partkey")
    made = F.concat(F.lit("N"), (k % 9).cast("string"), F.lit("-S"), (F.col("p_size") % 3).cast("string"), F.lit("-"), (k % 4).cast("string"), F.when(k % 5 == 0, "-D").otherwise(""))
    return graph.stair_keys(table(spark, d, "part").select(made.alias("id")))


@query("q_g21_quickest_exit", "select l_orderkey as request, arg_min(l_linenumber, l_quantity * 1000 + l_linenumber) as exit, min(l_quantity) as seconds from lineitem group by 1")
def quickest(spark, d):
    best = F.min(F.struct(F.col("l_quantity").alias("q"), F.col("l_linenumber").alias("e"))).alias("x")
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("request")).agg(best).select("request", F.col("x.e").alias("exit"), F.col("x.q").alias("seconds"))


@query("q_a08_first_best", f"with {SLOTS} select room, arg_min(item, en::bigint * 1000000000 + item) as item, min(en) as en from slots group by room")
def first_best(spark, d):
    return slots(spark, d).groupBy("room").agg(F.min(F.struct("en", "item")).alias("x")).select("room", F.col("x.item").alias("item"), F.col("x.en").alias("en"))


@query("q_q03_rooms_on_day", f"with {SLOTS} select dow, list_sort(list(distinct room)) as rooms, count(*) as n from slots group by dow")
def on_day(spark, d):
    return slots(spark, d).groupBy("dow").agg(F.array_sort(F.collect_set("room")).alias("rooms"), F.count("*").alias("n"))


@query("q_o03_nulls_last", "with p as (select p_partkey, case when p_size % 7 <> 0 then p_size end as s from part) select p_partkey, s, row_number() over (order by s nulls last, p_partkey) as place from p")
def nulls_last(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("s"))
    return numbered(p, F.col("s").asc_nulls_last(), F.col("p_partkey").asc())


@query("q_o05_top_five", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 5")
def top_five(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select("o_orderkey", "o_totalprice")


@query("q_p05_lookup_by_name", "select p_name, min(p_partkey) as p_partkey from part group by 1")
def lookup(spark, d):
    return table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))


@query("q_p09_places_by_category", f"with {CAMPUS_NODES} select building, kind, count(*) as n, min(name) as first_name from nodes where kind in ('ROOM', 'HALL') group by 1, 2")
def by_category(spark, d):
    return campus_nodes(spark, d).where(F.col("kind").isin("ROOM", "HALL")).groupBy("building", "kind").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


@query("q_j11_free_room_nodes", f"""with {CAMPUS_NODES}, b as (select distinct l_partkey % (select count(*) from part) as room from lineitem
    where l_orderkey % 5 = 0 and 15 * (l_orderkey % 48) <= 120 and 15 * (l_orderkey % 48) + 45 * (1 + l_linenumber % 3) > 120) select id, name from nodes where kind = 'ROOM' and id not in (select room from b)""")
def free_nodes(spark, d):
    """By the whole timetable, with as many rooms as parts: of 40 rooms none would be free."""
    n = table(spark, d, "part").agg(F.count("*").alias("_n"))
    st = 15 * (F.col("l_orderkey") % 48)
    now = table(spark, d, "lineitem").where((F.col("l_orderkey") % 5 == 0) & (st <= 120) & (st + 45 * (1 + F.col("l_linenumber") % 3) > 120))
    busy = now.crossJoin(F.broadcast(n)).select((F.col("l_partkey") % F.col("_n")).alias("id"))
    return campus_nodes(spark, d).where("kind = 'ROOM'").join(busy, "id", "left_anti").select("id", "name")


@query("q_j12_gateways", """with e as (select s_suppkey as a, s_suppkey + 7 as b from supplier), n as (select s_suppkey as id, s_nationkey as building from supplier)
    select x.a as indoor, x.b as passage, y.b as beyond from e x join e y on x.b = y.a join n p on x.a = p.id join n q on x.b = q.id join n r on y.b = r.id where p.building <> q.building and r.building <> p.building""")
def gateways(spark, d):
    k = F.col("s_suppkey")
    e = table(spark, d, "supplier").select(k.alias("a"), (k + 7).alias("b"))
    of = lambda c: table(spark, d, "supplier").select(k.alias(c), F.col("s_nationkey").alias(f"_{c}"))
    two = e.toDF("indoor", "passage").join(e.toDF("passage", "beyond"), "passage").join(of("indoor"), "indoor").join(of("passage"), "passage").join(of("beyond"), "beyond")
    return two.where("_indoor <> _passage and _beyond <> _indoor").select("indoor", "passage", "beyond")


def _floor(spark, d):
    """Nations as a grid of corridors; every third has a door and a room."""
    n, k = table(spark, d, "nation"), F.col("n_nationkey").cast("long")
    x, y = (k % 5 * 20).cast("double"), (F.floor(k / 5) * 15).cast("double")
    place = lambda plus, up, kind: n.select((k + plus).alias("id"), x.alias("x"), (y + up).alias("y"), F.lit(kind).alias("kind"))
    roomy = k % 3 == 0
    nodes = place(0, 0.0, "HALL").unionByName(place(100, 2.0, "DOOR").where((F.col("id") - 100) % 3 == 0)).unionByName(place(200, 6.0, "ROOM").where((F.col("id") - 200) % 3 == 0))
    along = n.where(k % 5 < 4).select((k + 1000).alias("way"), k.alias("a"), (k + 1).alias("b")).unionByName(n.where(k < 20).select((k + 2000).alias("way"), k.alias("a"), (k + 5).alias("b")))
    rooms = n.where(roomy).select((k + 3000).alias("way"), k.alias("a"), (k + 100).alias("b")).unionByName(n.where(roomy).select((k + 4000).alias("way"), (k + 100).alias("a"), (k + 200).alias("b")))
    return nodes, along.unionByName(rooms)


@query("q_mm6_way_table", """with n as (select n_nationkey::bigint as k from nation)
    select k + 1000 as way, null::bigint as branch, null::bigint as junction, false as room from n where k % 5 < 4
    union all select k + 2000, null, null, false from n where k < 20
    union all select k + 3000, k + 200, k, true from n where k % 3 = 0 union all select k + 4000, k + 200, k, true from n where k % 3 = 0""")
def way_table(spark, d):
    """Which ways are rooms', and on which branch."""
    return way_tables(*_floor(spark, d))[0].select("way", "branch", "junction", "room")


@query("q_mm2_map_matching")
def matching(spark, d):
    """A walk per user on the corridors and rooms of the nations' floor; a test has a plain matcher that gives the same."""
    r = readings(spark, d)
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("t"))
    turn = F.radians(F.col("value") * 3)
    first = F.col("_n") == 1
    steps = r.withColumn("_n", n).select("user_id", "t", F.when(first, F.col("user_id") % 80).otherwise(0.7 * F.sin(turn)).alias("x"), F.when(first, F.col("user_id") % 45).otherwise(-0.7 * F.cos(turn)).alias("y"))
    return match(steps, "user_id", load_floor(*_floor(spark, d)))


@query("q_a06_ring_minutes", f"select distinct cast(greatest(1, ceil(l_quantity * {math.pi} * 10 / 60)) as int) as minutes from lineitem")
def ring_minutes(spark, d):
    from ..operators.agenda import route_minutes

    return table(spark, d, "lineitem").select(route_minutes(F.col("l_quantity") * math.pi * 10).alias("minutes")).distinct()
