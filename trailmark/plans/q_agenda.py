"""Agendas, departures and day plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agenda as op
from ..operators import search
from .registry import query
from .views import DAYS, SLOTS, days, slots, table

PREV = f"""with {DAYS}, pv as (
    select a.person, a.item, arg_max(struct_pack(i := b.item, p := b.place, e := b.en), b.en * 1000 - b.item) as x
    from days a join days b on a.person = b.person and b.en <= a.st and b.place is not null and b.item <> a.item group by 1, 2),
    w as (select d.*, x.i as prev_item, x.p as prev_place, x.e as prev_end from days d left join pv using (person, item))"""
DEPART = PREV + """, u as (select *, st - minutes as leave_at, greatest(st - minutes - 5, coalesce(prev_end, st - minutes - 5)) as usual, place is not null and prev_item is null as first
        from w where place is null or prev_place is null or place <> prev_place),
    dep as (select person, item, st, leave_at, case when first then least(usual, st - 60) else usual end as notify_at, first as first_of_day, case when first and usual > st - 60 then usual end as reminder_at from u)"""


@query("q_j07_previous_place", PREV + " select person, item, prev_item, prev_place, prev_end from w")
def previous(spark, d):
    return op.with_previous(days(spark, d), ["person"]).select("person", "item", "prev_item", "prev_place", "prev_end")


def _departures(spark, d):
    return op.departures(op.with_previous(days(spark, d), ["person"]))


@query("q_q08_departures", DEPART + " select person, item, leave_at, notify_at, first_of_day, reminder_at from dep")
def departures(spark, d):
    return _departures(spark, d).select("person", "item", "leave_at", "notify_at", "first_of_day", "reminder_at")


@query("q_w10_next_departure", DEPART + """, e as (select person, item, unnest([notify_at, reminder_at]) as a from dep)
    select person, min(a * 100 + item) // 100 as notify_at, min(a * 100 + item) % 100 as item from e where a > 600 group by person""")
def next_departure(spark, d):
    return op.next_departure(_departures(spark, d), ["person"], 600).withColumn("notify_at", F.col("notify_at").cast("long"))


@query("q_q09_missed_departure", DEPART + """, e as (select person, st, item, unnest([notify_at, reminder_at]) as a from dep where st > 640),
    r as (select *, row_number() over (partition by person order by st, a desc, item) as n from e where a > 560 and a <= 640)
    select person, item, st, a as notify_at from r where n = 1""")
def missed(spark, d):
    return op.missed_departure(_departures(spark, d), ["person"], 560, 640)


@query("q_q10_day_plan", f"""with {DAYS}, l as (select *, lag(item) over w as from_item, lag(place) over w as fp, lag(en) over w as fe from days where place is not null window w as (partition by person order by st, item))
    select person, item, from_item, st - fe as break_min, coalesce(fp = place, false) as same_place, coalesce(not coalesce(fp = place, false) and minutes > st - fe, false) as too_tight from l""")
def plan(spark, d):
    return op.day_plan(days(spark, d), ["person"]).select("person", "item", "from_item", "break_min", "same_place", "too_tight")


@query("q_q07_agenda", f"""with {SLOTS}, {DAYS}, b as (select dow as day, item, st, en, 0 as k from slots union all select cast(person % 5 + 1 as int), person * 8 + item + 1000000000, st, en, 1 from days)
    select day, item, st, en, k as kind_rank, row_number() over (partition by day order by st, k, item) as rank from b""")
def agenda(spark, d):
    c = slots(spark, d).select(F.col("dow").alias("day"), "item", "st", "en")
    e = days(spark, d).select((F.col("person") % 5 + 1).cast("int").alias("day"), (F.col("person") * 8 + F.col("item") + 1000000000).alias("item"), "st", "en")
    return op.agenda(c, e, ["day"])


@query("q_w11_next_item", f"with {DAYS} select person, min(st * 100 + item) // 100 as st, min(st * 100 + item) % 100 as item from days where en > 700 group by person")
def next_item(spark, d):
    return op.next_item(days(spark, d), ["person"], 700).withColumn("st", F.col("st").cast("long"))


@query("q_p08_recurrence", """with e as (select o_orderkey as id, cast(o_orderdate as date) as f, o_orderkey % 3 = 0 as w, case when o_orderkey % 2 = 0 then cast(o_orderdate as date) + 28 end as u from orders),
    days as (select cast(x as date) as day from range(date '1998-01-01', date '1998-03-02', interval 1 day) t(x))
    select id, day from e join days on (not w and f = day) or (w and day >= f and isodow(day) = isodow(f) and (u is null or day <= u))""")
def recurrence(spark, d):
    k, f = F.col("o_orderkey"), F.to_date("o_orderdate")
    e = table(spark, d, "orders").select(k.alias("id"), f.alias("date"), (k % 3 == 0).alias("weekly"), F.when(k % 2 == 0, F.date_add(f, 28)).alias("until"))
    dates = spark.range(60).select(F.date_add(F.lit("1998-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    return op.occurrences(e, dates).select("id", "day")


@query("q_q12_refresh_instant", f"""with {DAYS} select person, item, (select min(v) from (select unnest([st - minutes, st, en, 1440]) as v) where v > 700) as at from days""")
def refresh(spark, d):
    return days(spark, d).select("person", "item", op.refresh_instant(F.lit(700), F.col("st") - F.col("minutes"), F.col("st"), F.col("en")).alias("at"))


@query("q_a06_route_minutes", "select l_orderkey, l_linenumber, cast(greatest(1, ceil(sum(l_extendedprice / 100) / 60)) as int) as minutes from lineitem group by 1, 2")
def minutes(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum((F.col("l_extendedprice") / 100).cast("decimal(28,8)")).alias("s"))  # exact, whatever the order: a whole minute stays one
    return s.select("l_orderkey", "l_linenumber", op.route_minutes(F.col("s")).alias("minutes"))


@query("q_p12_recent_list", """with r as (select o_custkey, list('C' || o_orderkey % 7 order by o_orderdate desc, o_orderkey desc) as l from orders group by 1),
    x as (select o_custkey, l[1] as h, list_filter(l, lambda v: v <> 'C3') as o from r)
    select o_custkey, list_concat(['C3'], o)[1:5] as recent from x""")
def recent(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.struct(F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t"), "o_orderkey", F.concat(F.lit("C"), (F.col("o_orderkey") % 7).cast("string")).alias("v")).alias("x"))
    r = o.groupBy("o_custkey").agg(F.transform(F.reverse(F.array_sort(F.collect_list("x"))), lambda x: x.v).alias("l"))
    return r.select("o_custkey", search.with_recent(F.col("l"), F.lit("C3")).alias("recent"))


@query("q_j06_resolve_cascade", """with w as (select p_partkey, p_name as name from part),
    a as (select p_name as name, min(p_partkey) as node, 0 as source from part where p_size < 3 group by 1),
    b as (select p_name as name, min(p_partkey) as node, 1 as source from part where p_size < 6 group by 1),
    c as (select p_name as name, min(p_partkey) as node, 2 as source from part where p_type = 'ECONOMY' group by 1),
    f as (select name, source, node, row_number() over (partition by name order by source, node) as n from (select * from a union all select * from b union all select * from c))
    select p_partkey, w.name, cast(f.source as int) as source, f.node from w left join f on w.name = f.name and f.n = 1""")
def cascade(spark, d):
    p = table(spark, d, "part")
    pick = lambda cond: p.where(cond).select(F.col("p_name").alias("name"), F.col("p_partkey").alias("node"))
    return search.resolve(p.select("p_partkey", F.col("p_name").alias("name")), [pick("p_size < 3"), pick("p_size < 6"), pick("p_type = 'ECONOMY'")])
