"""Teaching days, rooms, crowds and opening hours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import timetable as op
from .registry import query
from .views import SLOTS, slots, table

ISLES = f"""with {SLOTS},
    m as (select *, case when max(en) over (partition by room, dow order by st, en rows between unbounded preceding and 1 preceding) >= st then 0 else 1 end as fresh from slots),
    i as (select *, sum(fresh) over (partition by room, dow order by st, en rows unbounded preceding) as isle from m),
    isles as (select room, dow, min(st) as busy_from, max(en) as busy_until, count(*) as n_slots from i group by room, dow, isle)"""


@query("q_a02_shared_slots", f"""with {SLOTS} select room, dow, st, en, subject, kind, bool_and(biweekly) as biweekly, count(distinct timetable) as n_timetables
    from slots group by all""")
def shared(spark, d):
    return op.merge_shared(slots(spark, d))


@query("q_w08_busy_islands", ISLES + " select * from isles")
def islands(spark, d):
    return op.busy_islands(slots(spark, d), ["room", "dow"])


STATUS = """, s as (select room, dow, max(case when busy_from <= 600 and busy_until > 600 then busy_until end) as u, min(case when busy_from > 600 then busy_from end) as nx from isles group by 1, 2)"""


@query("q_q02_room_status", ISLES + STATUS + " select room, dow, u is not null as busy, coalesce(u, nx) as until from s")
def status(spark, d):
    return op.room_status(slots(spark, d), ["room", "dow"], 600)


@query("q_q04_free_rooms", ISLES.replace("l_partkey % 40 as int", "l_partkey % 400 as int") + STATUS.replace("600", "605") + " select room, dow, nx as until from s where u is null and (nx is null or nx - 605 >= 45)")
def free(spark, d):
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    st = (480 + 15 * (F.col("l_orderkey") % 48)).cast("int")
    rows = s.select((F.col("l_partkey") % 400).cast("int").alias("room"), (F.col("l_orderkey") % 5 + 1).cast("int").alias("dow"), st.alias("st"), (st + 45 * (1 + F.col("l_linenumber") % 3)).cast("int").alias("en"))
    return op.free_rooms(rows, ["room", "dow"], 605, 45)


@query("q_w09_next_start", f"with {SLOTS} select room, dow, min(case when st > 600 then st end) as next_start from slots group by 1, 2")
def next_start(spark, d):
    return slots(spark, d).groupBy("room", "dow").agg(F.min(F.when(F.col("st") > 600, F.col("st"))).alias("next_start"))


PEOPLE = f"""with {SLOTS}, m as (select room, dow, st, en, subject, kind, bool_and(biweekly) as bw, count(distinct timetable) as n from slots group by all),
    p as (select *, case when kind = 'LECTURE' then 80 * greatest(1, n) * 0.4::double else 16 * 0.8::double end / case when bw then 2.0::double else 1.0::double end as people from m)"""


@query("q_a04_slot_people", PEOPLE + " select room, dow, st, en, subject, kind, round(people, 6) as people from p")
def people(spark, d):
    m = op.merge_shared(slots(spark, d))
    return m.select("room", "dow", "st", "en", "subject", "kind", F.round(op.people(F.col("kind"), F.col("n_timetables"), F.col("biweekly")), 6).alias("people"))


@query("q_q06_crowd_factor", PEOPLE + """, c as (select room, sum((case when abs(st - 600) <= 10 then 1 else 0 end + case when abs(en - 600) <= 10 then 1 else 0 end) * people) as people from p
    where abs(st - 600) <= 10 or abs(en - 600) <= 10 group by room)
    select room, round(people, 6) as people, round(1 + 0.3 * (1 - exp(-people / 400.0)), 9) as factor from c""")
def crowd(spark, d):
    m = op.merge_shared(slots(spark, d))
    c = op.people_moving(m.withColumn("people", op.people(F.col("kind"), F.col("n_timetables"), F.col("biweekly"))), "room", 600)
    return c.select("room", F.round("people", 6).alias("people"), F.round(op.crowd_factor(F.col("people")), 9).alias("factor"))


# Inline dimensions: semesters and special days of the years that orders come from.
SEMESTERS = [("winter", f"{y}-10-01", f"{y + 1}-01-18") for y in range(1994, 2002)] + [("summer", f"{y}-02-15", f"{y}-06-05") for y in range(1995, 2003)]
SPECIAL = [(f"{y}-11-11", f"{y}-11-11", "HOLIDAY", None) for y in range(1994, 2003)] + [(f"{y}-11-14", None, "MAKEUP", 3) for y in range(1994, 2003)] + [(f"{y}-04-10", f"{y}-04-14", "EXAMS", None) for y in range(1995, 2003)] + [(f"{y}-12-28", None, "INFO", None) for y in range(1994, 2003)]


def _values(rows):
    show = lambda v: "null" if v is None else str(v) if isinstance(v, int) else f"'{v}'"
    return ", ".join("(" + ", ".join(show(v) for v in r) + ")" for r in rows)


def _calendar(spark):
    s = spark.createDataFrame(SEMESTERS, "kind string, start string, end string")
    x = spark.createDataFrame(SPECIAL, "start string, end string, type string, as_day int")
    return s.withColumns({c: F.to_date(c) for c in ("start", "end")}), x.withColumns({c: F.to_date(c) for c in ("start", "end")})


DAYS_SQL = f"""with dates as (select distinct cast(o_orderdate as date) as date from orders),
    sem(kind, s, e) as (values {_values(SEMESTERS)}), sp(s, e, type, as_day) as (values {_values(SPECIAL)}),
    t as (select d.date, min(sem.kind) as kind from dates d join sem on d.date between sem.s::date and sem.e::date group by 1),
    x as (select d.date, max(case when type = 'MAKEUP' then as_day end) as makeup, bool_or(type not in ('INFO', 'MAKEUP')) as off
        from dates d join sp on d.date between sp.s::date and coalesce(sp.e, sp.s)::date group by 1),
    dd as (select d.date, t.kind, cast(case when t.kind is not null then coalesce(x.makeup, case when coalesce(x.off, false) or isodow(d.date) = 7 then null else isodow(d.date) end) end as int) as teaching_day
        from dates d left join t using (date) left join x using (date))"""


def _days(spark, d):
    dates = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return op.day_dimension(dates, *_calendar(spark))


@query("q_q01_day_info", DAYS_SQL + " select * from dd")
def day_info(spark, d):
    return _days(spark, d)


CLASSES_SQL = """cl as (select p_partkey as class_id, case when p_partkey % 2 = 0 then 'winter' else 'summer' end as kind, cast(p_size % 6 + 1 as int) as day,
    case when p_partkey % 10 = 3 then date '1997-03-01' + cast(p_partkey % 200 as int) end as date from part)"""


@query("q_j03_classes_on_days", DAYS_SQL + ", " + CLASSES_SQL + """ select class_id, dd.date from cl join dd on cl.date is null and cl.kind = dd.kind and cl.day = dd.teaching_day
    union all select class_id, cl.date from cl where cl.date in (select date from dd)""")
def classes(spark, d):
    k = F.col("p_partkey")
    cl = table(spark, d, "part").select(k.alias("class_id"), F.when(k % 2 == 0, "winter").otherwise("summer").alias("kind"), (F.col("p_size") % 6 + 1).cast("int").alias("day"), F.when(k % 10 == 3, F.date_add(F.lit("1997-03-01").cast("date"), (k % 200).cast("int"))).alias("date"))
    return op.classes_on_days(cl, _days(spark, d)).select("class_id", "date")


@query("q_q19_day_notes", DAYS_SQL + """ select date, case when kind is null then 'no semester' when teaching_day is null then 'no teaching' when teaching_day <> isodow(date) then 'works as ' || teaching_day else 'teaching' end as note from dd""")
def notes(spark, d):
    t = F.col("teaching_day")
    note = F.when(F.col("kind").isNull(), "no semester").when(t.isNull(), "no teaching").when(t != F.weekday("date") + 1, F.concat(F.lit("works as "), t.cast("string"))).otherwise("teaching")
    return _days(spark, d).select("date", note.alias("note"))


HOURS_SQL = """h as (select n_nationkey as place, w as day, st, en from nation, (select unnest(range(7)) as w) cross join (values (0, 420, 600), (1, 660, 1200)) as v(k, st, en)
    where not (w = 6) and not (w = 5 and k = 1) and n_nationkey % 5 <> 4)"""


@query("q_q11_opening_status", f"""with {HOURS_SQL}, a as (select distinct place, x as asked from h, (select unnest(range(7)) as x)),
    p as (select a.place, asked, st, en, (day - asked + 7) % 7 as ahead from a join h using (place)),
    g as (select place, asked, max(case when ahead = 0 and st <= 610 and en > 610 then en end) as o, min(case when ahead = 0 and st <= 610 then 7 else ahead end * 10000 + st) as nx from p group by 1, 2)
    select place, asked::int as asked, o as open_until, case when o is null then nx // 10000 end as opens_in_days, case when o is null then nx % 10000 end as opens_at from g""")
def opening(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("place"))
    h = n.where("place % 5 <> 4").withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("v", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit(420).alias("st"), F.lit(600).alias("en")), F.struct(F.lit(1).alias("k"), F.lit(660).alias("st"), F.lit(1200).alias("en")))))
    h = h.where("not (day = 5 and v.k = 1)").select("place", "day", F.col("v.st").alias("start"), F.col("v.en").alias("end"))
    return op.opening_status(h, "place", "day", 610)


@query("q_p06_group_filter", """with c as (select o_orderkey, o_orderkey % 11 = 0 as everyone, o_orderkey % 13 = 0 as elective, [o_orderkey % 4, o_orderkey % 9] as numbers,
    case when o_orderkey % 3 = 0 then ['AB', 'XY'] when o_orderkey % 3 = 1 then ['AB'] else [] end as areas from orders)
    select o_orderkey, everyone or elective or list_contains(numbers, 5) or (o_orderkey % 3 = 0) or (o_orderkey % 3 = 1 and false) as takes from c""")
def group_filter(spark, d):
    k = F.col("o_orderkey")
    areas = F.when(k % 3 == 0, F.array(F.lit("AB"), F.lit("XY"))).when(k % 3 == 1, F.array(F.lit("AB"))).otherwise(F.array().cast("array<string>"))
    known = F.create_map(F.lit("AB"), F.array(F.lit(1), F.lit(2)).cast("array<bigint>"))
    return table(spark, d, "orders").select("o_orderkey", text.takes_part(F.lit(5).cast("bigint"), k % 11 == 0, k % 13 == 0, F.array(k % 4, k % 9), areas, known).alias("takes"))


@query("q_a07_group_numbers", f"with {SLOTS} select room, list_sort(list(distinct subject)) as subjects from slots group by room")
def group_numbers(spark, d):
    return slots(spark, d).groupBy("room").agg(F.array_sort(F.collect_set("subject")).alias("subjects"))


@query("q_a16_drilldown_counts", "select p_brand, p_type, count(distinct p_size) as n_sizes, count(*) as n from part group by 1, 2")
def drilldown(spark, d):
    return table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count_distinct("p_size").alias("n_sizes"), F.count("*").alias("n"))


@query("q_j05_room_alias", f"with {SLOTS} select case room when 3 then 'A' when 5 then 'A' else cast(room as varchar) end as place, count(*) as n from slots group by 1")
def alias(spark, d):
    return slots(spark, d).select(op.canonical_room(F.col("room").cast("string"), {"3": "A", "5": "A"}).alias("place")).groupBy("place").agg(F.count("*").alias("n"))


@query("q_q05_semester_loaded", DAYS_SQL + " select kind, count(*) as n_days, count(teaching_day) as n_teaching from dd group by kind")
def loaded(spark, d):
    return _days(spark, d).groupBy("kind").agg(F.count("*").alias("n_days"), F.count("teaching_day").alias("n_teaching"))
