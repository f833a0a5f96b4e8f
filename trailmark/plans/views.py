"""Views of the star-schema tables as timetables, places, graphs and readings, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timetable slots: 40 rooms, five weekdays, quarter-hour starts."""
    t = table(spark, sf_dir, "lineitem")
    st = (480 + 15 * (F.col("l_orderkey") % 48)).cast("int")
    return t.select(
        (F.col("l_partkey") % 40).cast("int").alias("room"), (F.col("l_orderkey") % 5 + 1).cast("int").alias("dow"), st.alias("st"),
        (st + 45 * (1 + F.col("l_linenumber") % 3)).cast("int").alias("en"), (F.col("l_suppkey") % 20).cast("int").alias("subject"),
        F.when(F.col("l_linenumber") % 2 == 0, "LECTURE").otherwise("EXERCISE").alias("kind"), (F.col("l_quantity") > 25).alias("biweekly"),
        (F.col("l_partkey") % 7).cast("int").alias("timetable"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item"), F.col("l_orderkey").alias("order_key"))


SLOTS = """slots as (
    select cast(l_partkey % 40 as int) as room, cast(l_orderkey % 5 + 1 as int) as dow, cast(480 + 15 * (l_orderkey % 48) as int) as st,
        cast(480 + 15 * (l_orderkey % 48) + 45 * (1 + l_linenumber % 3) as int) as en, cast(l_suppkey % 20 as int) as subject,
        case when l_linenumber % 2 = 0 then 'LECTURE' else 'EXERCISE' end as kind, l_quantity > 25 as biweekly,
        cast(l_partkey % 7 as int) as timetable, l_orderkey * 8 + l_linenumber as item, l_orderkey as order_key
    from lineitem)"""


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's day: an order's slots, distinct starts, places and minutes of way; every eighth item has no place."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    st = (480 + 60 * F.col("l_linenumber") + F.col("p") % 40).cast("int")
    return t.select(
        F.col("l_orderkey").alias("person"), F.col("l_linenumber").cast("long").alias("item"), st.alias("st"), (st + 20 + F.col("p") % 70).cast("int").alias("en"),
        F.when(F.col("s") % 8 != 0, F.concat(F.lit("P"), (F.col("p") % 4).cast("string"))).alias("place"), (F.col("s") % 25 + 1).cast("int").alias("minutes"))


DAYS = """days as (
    select l_orderkey as person, cast(l_linenumber as bigint) as item, cast(480 + 60 * l_linenumber + p % 40 as int) as st,
        cast(480 + 60 * l_linenumber + p % 40 + 20 + p % 70 as int) as en,
        case when s % 8 <> 0 then 'P' || (p % 4) end as place, cast(s % 25 + 1 as int) as minutes
    from (select l_orderkey, l_linenumber, min(l_partkey) as p, min(l_suppkey) as s from lineitem group by 1, 2))"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings per user in microseconds, of their own order n."""
    t = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return t.select("event_id", "user_id", us.alias("t"), "value", "event_type")


READINGS = """readings as (select event_id, user_id, epoch_us(ts) as t, value, event_type from events)"""


def campus_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places from suppliers: buildings by nation, three floors, a plan of 100 by 60 metres."""
    t = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return t.select(
        k.alias("id"), (k % 5).cast("int").alias("building"), (F.floor(k / 5) % 3).cast("int").alias("floor"), ((k * 37) % 1000 / 10.0).alias("x"), ((k * 53) % 600 / 10.0).alias("y"),
        F.when(k % 4 == 0, "ROOM").when(k % 4 == 1, "STAIRS").when(k % 4 == 2, "LIFT").otherwise("HALL").alias("kind"), F.col("s_name").alias("name"))


CAMPUS_NODES = """nodes as (
    select s_suppkey as id, cast(s_suppkey % 5 as int) as building, cast((s_suppkey // 5) % 3 as int) as floor, ((s_suppkey * 37) % 1000) / 10.0 as x,
        ((s_suppkey * 53) % 600) / 10.0 as y,
        case when s_suppkey % 4 = 0 then 'ROOM' when s_suppkey % 4 = 1 then 'STAIRS' when s_suppkey % 4 = 2 then 'LIFT' else 'HALL' end as kind, s_name as name
    from supplier)"""


def campus_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways between places: two of each, some to places that don't exist."""
    t = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    kind = lambda n: F.when(n % 3 == 0, "STAIRS").when(n % 3 == 1, "WALK").otherwise("LIFT")
    one = t.select(k.alias("a"), (k + 5).alias("b"), kind(k).alias("kind"))
    return one.unionByName(t.select(k.alias("a"), (k + 15).alias("b"), kind(k + 1).alias("kind")))


CAMPUS_EDGES = """edges as (
    select s_suppkey as a, s_suppkey + 5 as b, case s_suppkey % 3 when 0 then 'STAIRS' when 1 then 'WALK' else 'LIFT' end as kind from supplier
    union all
    select s_suppkey, s_suppkey + 15, case (s_suppkey + 1) % 3 when 0 then 'STAIRS' when 1 then 'WALK' else 'LIFT' end from supplier)"""


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed ways between nations: to the next and to the one seven on, as dear as the cheapest order line that leaves there, to a hundred."""
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    cheap = li.join(s, li["l_suppkey"] == s["s_suppkey"]).groupBy("s_nationkey", (F.col("l_linenumber") % 2).alias("odd")).agg((F.min(F.floor("l_extendedprice")) % 100 + 1).cast("double").alias("cost"))
    return cheap.select(F.col("s_nationkey").alias("a"), ((F.col("s_nationkey") + F.when(F.col("odd") == 0, 1).otherwise(7)) % 25).alias("b"), "cost")


ARCS = """arcs as (
    select s_nationkey as a, (s_nationkey + case when l_linenumber % 2 = 0 then 1 else 7 end) % 25 as b, cast(min(floor(l_extendedprice)) % 100 + 1 as double) as cost
    from lineitem join supplier on l_suppkey = s_suppkey group by s_nationkey, l_linenumber % 2,
        (s_nationkey + case when l_linenumber % 2 = 0 then 1 else 7 end) % 25)"""
