"""Names, searches, keyed tables and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import search
from ..sources import tables
from ..streaming.machines import step_detector
from ..streaming.run import run_stream
from .registry import query
from .views import readings, table

KEY = "regexp_replace(replace(translate(lower({0}), 'čćšž', 'ccsz'), 'đ', 'dj'), '[^\\p{{L}}\\p{{Nd}}]', '', 'g')"


@query("q_q13_search_keys", f"select p_partkey, {KEY.format('p_name')} as key, {KEY.format('p_type || chr(32) || p_brand')} as brand_key from part")
def keys(spark, d):
    return table(spark, d, "part").select("p_partkey", text.search_key(F.col("p_name")).alias("key"), text.search_key(F.concat_ws(" ", "p_type", "p_brand")).alias("brand_key"))


@query("q_q13_search_document_keys", f"select doc_id, md5({KEY.format('text')}) as key_md5 from documents")
def document_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.search_key(F.col("text"))).alias("key_md5"))


@query("q_q13_ranked_search", f"""with q(query_id, words) as (values (1, ['red', 'wid']), (2, ['ring']), (3, ['smallring']), (4, ['economy', 'ring'])), n as (select p_partkey as name_id, {KEY.format('p_name')} as k, {KEY.format('p_type')} as c from part),
    r as (select query_id, name_id, case when k = array_to_string(words, '') then 0 when starts_with(k, array_to_string(words, '')) then 1
        when len(list_filter(words, lambda w: not contains(k, w))) = 0 then 2 when len(list_filter(words, lambda w: not contains(k, w) and not starts_with(c, w))) = 0 then 3 end as rank from q, n)
    select query_id, name_id, rank, row_number() over (partition by query_id order by rank, name_id) as place from r where rank is not null""")
def ranked(spark, d):
    n = table(spark, d, "part").select(F.col("p_partkey").alias("name_id"), F.col("p_name").alias("name"), F.lit(None).cast("array<string>").alias("aliases"), F.array("p_type").alias("context"))
    asked = spark.createDataFrame([(1, "Red wid"), (2, "ring"), (3, "Small-Ring"), (4, "economy  ring")], "query_id int, query string")
    return search.search(n, asked)


RULES = [("Brand#1", "ONE"), (r"Brand#1\d", "TEENS"), (r"Brand#2[0-4]?", "TWO"), (r"Brand#.*5", "FIVE")]


@query("q_q14_ordered_rules", r"""select p_partkey, case when p_brand = 'Brand#1' then 'ONE' when regexp_full_match(p_brand, 'Brand#1\d') then 'TEENS' when regexp_full_match(p_brand, 'Brand#2[0-4]?') then 'TWO' when regexp_full_match(p_brand, 'Brand#.*5') then 'FIVE' end as building from part""")
def rules(spark, d):
    return table(spark, d, "part").select("p_partkey", text.first_rule(F.col("p_brand"), RULES).alias("building"))


@query("q_q15_prefix_places", "select p_partkey, case when starts_with(p_name, 'small') then 'near' when starts_with(p_name, 'red') then 'far' end as place from part")
def places(spark, d):
    return table(spark, d, "part").select("p_partkey", text.prefix_place(F.col("p_name"), [("small", "near"), ("red", "far")]).alias("place"))


@query("q_s12_settings_map", "select event_id, cast(regexp_extract(props, '(\\d+)', 1) as varchar) as k, event_type as v from events")
def settings(spark, d):
    made = F.concat(F.lit("k="), F.regexp_extract("props", r"(\d+)", 1), F.lit(";v="), F.col("event_type"))
    return table(spark, d, "events").select("event_id", text.settings_map(made).alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["v"].alias("v"))


@query("q_p13_identity_columns", "select l_orderkey, l_linenumber, min(l_returnflag || '|' || l_linestatus || '|' || l_linenumber) as ident, case when l_linenumber % 2 = 0 then 'summer' else 'winter' end as term from lineitem group by 1, 2")
def identity(spark, d):
    made = F.concat_ws("|", "l_returnflag", "l_linestatus", "l_linenumber")
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(made).alias("ident")).withColumn("term", F.when(F.col("l_linenumber") % 2 == 0, "summer").otherwise("winter"))


@query("q_o09_keep_newest", """with r as (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate desc nulls last, o_orderkey) as n from orders)
    select o_custkey, o_orderpriority, o_orderkey, o_totalprice from r where n = 1""")
def newest(spark, d):
    return tables.keep_newest(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")


@query("q_o08_distinct_by_key", "select o_custkey, min(o_orderkey) as o_orderkey, arg_min(o_totalprice, o_orderkey) as o_totalprice from orders group by 1")
def first(spark, d):
    return tables.distinct_first(table(spark, d, "orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("q_s06_upsert", """select o_orderkey, o_totalprice from orders where o_orderkey % 10 <> 0 union all select o_orderkey, round(o_totalprice * 2, 2) from orders where o_orderkey % 10 = 0
    union all select o_orderkey + 100000000, 1.0 from orders where o_orderkey % 10 = 0""")
def upserted(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    tenth = o.where("o_orderkey % 10 = 0")
    changes = tenth.select("o_orderkey", F.round(F.col("o_totalprice") * 2, 2).alias("o_totalprice")).unionByName(tenth.select((F.col("o_orderkey") + 100000000).alias("o_orderkey"), F.lit(1.0).alias("o_totalprice")))
    return tables.upsert(o, changes, ["o_orderkey"])


@query("q_j15_left_out", "select s_suppkey from supplier where s_suppkey not in (select l_suppkey from lineitem where l_orderkey % 300 = 7)")
def left_out(spark, d):
    gone = table(spark, d, "lineitem").where("l_orderkey % 300 = 7").select(F.col("l_suppkey").alias("s_suppkey"))
    return tables.delete(table(spark, d, "supplier").select("s_suppkey"), gone, ["s_suppkey"])


@query("q_s02_count", "select count(*) as n from supplier")
def count(spark, d):
    return table(spark, d, "supplier").agg(F.count("*").alias("n"))


@query("q_s05_ordered_scan", "select event_id, user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as place from events")
def ordered(spark, d):
    from pyspark.sql import Window

    return table(spark, d, "events").select("event_id", "user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("place"))


@query("q_st1_steps_streamed", None)
def streamed(spark, d):
    """The step detector over a file stream, run to its end; the batch query q_st1_steps gives the same rows."""
    import uuid

    from ..operators.graph import shared_dir, written

    rows = written(readings(spark, d).select("user_id", (F.col("t") * 1000).alias("t"), "value").repartitionByRange(3, "t"), "stream-in")
    base, name = shared_dir(spark), uuid.uuid4().hex
    found = run_stream(spark.readStream.schema(rows.schema).parquet(rows.inputFiles()[0].rsplit("/", 1)[0]), "user_id", step_detector())
    tables.append_to(f"{base}/stream-out-{name}", f"{base}/stream-state-{name}", found).awaitTermination()
    out = spark.read.schema(found.schema).parquet(f"{base}/stream-out-{name}")
    return out.select("user_id", "t", F.round("peak", 6).alias("peak"))
