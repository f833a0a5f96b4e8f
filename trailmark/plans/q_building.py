"""Sources of plans and map extracts, and map building."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import building, graph
from ..sources import readers
from .registry import query
from .views import CAMPUS_EDGES, CAMPUS_NODES, campus_edges, campus_nodes, table


def _plans(spark, d):
    """A plan file for each building, written as JSON with keys that no reader knows, and read again."""
    n = campus_nodes(spark, d)
    kind = F.when(F.col("kind") == "ROOM", "PROSTORIJA").otherwise("HODNIK")
    node = F.struct(F.col("id").cast("string").alias("id"), "floor", F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"), kind.alias("type"), "name", F.lit("odd").alias("unknownKey"))
    e = campus_edges(spark, d)
    code = F.when(F.col("kind") == "WALK", "HOD").when(F.col("kind") == "STAIRS", "STEPENICE").otherwise("LIFT")
    mark = F.when(F.col("a") % 4 == 0, F.array(F.lit("STEPS"))).otherwise(F.array().cast("array<string>"))
    e = e.withColumn("building", (F.col("a") % 5).cast("int")).withColumn("_e", F.concat(F.array(F.col("a").cast("string"), F.col("b").cast("string"), code), mark))
    own = n.groupBy("building").agg(F.collect_list(node).alias("nodes"))
    ways = e.groupBy("building").agg(F.collect_list("_e").alias("edges"), F.collect_list(F.when(F.col("a") % 7 == 0, F.array(F.col("a").cast("string"), F.lit("K-1")))).alias("campusLinks"))
    base = f"{graph.shared_dir(spark)}/plans-{uuid.uuid4().hex}"
    text = F.to_json(F.struct(F.concat(F.lit("B"), F.col("building").cast("string")).alias("buildingId"), "nodes", "edges", "campusLinks", F.lit(1).alias("version")))
    own.join(ways, "building").select("building", text.alias("value")).write.partitionBy("building").text(base)
    return readers.plans(spark, base)


@query("q_s07_plan_source", f"with {CAMPUS_NODES} select id::varchar as id, 'B' || building as building, floor, case when kind = 'ROOM' then 'PROSTORIJA' else 'HODNIK' end as kind, name from nodes")
def plan_source(spark, d):
    return readers.plan_nodes(_plans(spark, d)).select("id", "building", "floor", "kind", "name")


@query("q_s08_seed_union", f"""with {CAMPUS_EDGES} select a::varchar as a, b::varchar as b, kind, a % 4 = 0 as steps from edges
    union all select a::varchar, 'K-1', 'WALK', false from edges where a % 7 = 0""")
def seed_union(spark, d):
    return readers.plan_edges(_plans(spark, d)).select("a", "b", "kind", "steps")


@query("q_s14_map_extract", """select c_custkey as id, 'n' as kind, 0 as n_nodes, cast(null as varchar) as highway from customer
    union all select o_orderkey, 'w', 2, case when o_orderkey % 2 = 0 then 'path' end from orders""")
def extract(spark, d):
    """A saved map extract with nodes and ways, written and read."""
    c = table(spark, d, "customer").select(F.to_json(F.struct(F.lit("node").alias("type"), F.col("c_custkey").alias("id"), F.lit(45.2).alias("lat"), F.lit(19.8).alias("lon"))).alias("e"), (F.col("c_custkey") % 8).alias("part"))
    tags = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("highway"), F.lit("path")))
    o = table(spark, d, "orders").select(F.to_json(F.struct(F.lit("way").alias("type"), F.col("o_orderkey").alias("id"), F.array("o_custkey", F.col("o_custkey") + 1).alias("nodes"), tags.alias("tags"))).alias("e"), (F.col("o_orderkey") % 8).alias("part"))
    base = f"{graph.shared_dir(spark)}/extract-{uuid.uuid4().hex}"
    files = c.unionByName(o).groupBy("part").agg(F.array_join(F.collect_list("e"), ",").alias("_e"))
    files.select("part", F.concat(F.lit('{"version": 0.6, "elements": ['), "_e", F.lit("]}")).alias("value")).write.partitionBy("part").text(base)
    nodes, ways = readers.overpass(spark, base)
    n = nodes.select("id", F.lit("n").alias("kind"), F.lit(0).alias("n_nodes"), F.lit(None).cast("string").alias("highway"))
    return n.unionByName(ways.select("id", F.lit("w").alias("kind"), F.size("nodes").alias("n_nodes"), F.try_element_at("tags", F.lit("highway")).alias("highway")))


@query("q_p02_plan_inverse", f"""with {CAMPUS_NODES}, m as (select id, x * 3 + 7 as mx, y * 2 - 4 as my, radians(30.0::double * building) as a from nodes)
    select id, round(((mx - 500) * cos(a) + (my - 200) * sin(a)) / 100, 6) as rx, round((-(mx - 500) * sin(a) + (my - 200) * cos(a)) / 60, 6) as ry from m""")
def inverse(spark, d):
    n = campus_nodes(spark, d)
    rx, ry = geo.to_plan(F.col("x") * 3 + 7, F.col("y") * 2 - 4, F.lit(100.0), F.lit(60.0), F.lit(500.0), F.lit(200.0), (30 * F.col("building")).cast("double"))
    return n.select("id", F.round(rx, 6).alias("rx"), F.round(ry, 6).alias("ry"))


@query("q_g15_simplified", """with n as (select s_suppkey as id, s_suppkey % 5 as chain from supplier), c as (select chain, min(id) as lo, max(id) as hi, count(*) as k from n group by chain)
    select least(lo::varchar, hi::varchar) as a, greatest(lo::varchar, hi::varchar) as b from c where k > 1""")
def simplified(spark, d):
    """Straight chains of places come down to their ends."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier")
    nodes = s.select(k.cast("string").alias("id"), k.cast("double").alias("x"), (k % 5).cast("double").alias("y"))
    edges = s.select(k.cast("string").alias("a"), (k + 5).cast("string").alias("b")).join(nodes.select(F.col("id").alias("b")), "b", "left_semi")
    return building.simplified(nodes, edges, F.lit(False))[1].select("a", "b")


@query("q_g16_snapped", """with p as (select c_custkey as point, (c_custkey * 31) % 1000 / 10.0 as x, (c_custkey * 17) % 90 / 10.0 as y from customer)
    select point, case when round(x, 9) < 1 then 'a' when round(100 - x, 9) < 1 then 'b' else 'snap-' || point end as node from p""")
def snap(spark, d):
    """Customers put onto one long corridor."""
    k = F.col("c_custkey")
    points = table(spark, d, "customer").select(k.alias("point"), ((k * 31) % 1000 / 10.0).alias("x"), ((k * 17) % 90 / 10.0).alias("y"))
    nodes = spark.createDataFrame([("a", 0.0, 0.0), ("b", 100.0, 0.0)], "id string, x double, y double")
    return building.snapped(points, nodes, spark.createDataFrame([("a", "b")], "a string, b string"))[0]


@query("q_m06_rings", "select o_orderkey as outline, 0 as ring, [3 * o_orderkey, 3 * o_orderkey + 1, 3 * o_orderkey + 2, 3 * o_orderkey] as nodes from orders")
def rings(spark, d):
    """Each order's outline from three ways, one against the direction."""
    k = F.col("o_orderkey")
    way = lambda i, a, b: F.struct(F.lit(i).alias("way"), F.array(3 * k + a, 3 * k + b).alias("nodes"))
    w = table(spark, d, "orders").select(k.alias("outline"), F.explode(F.array(way(1, 0, 1), way(2, 2, 1), way(3, 2, 0))).alias("w")).select("outline", "w.way", "w.nodes")
    return building.rings(w, ["outline"])


@query("q_m10_placed", """select s_suppkey as id, round(2 * ((s_suppkey * 37) % 1000 / 10.0 * 0.8::double - (s_suppkey * 53) % 600 / 10.0 * 0.6::double) + 10, 4) as px,
    round(2 * ((s_suppkey * 37) % 1000 / 10.0 * 0.6::double + (s_suppkey * 53) % 600 / 10.0 * 0.8::double) - 5, 4) as py from supplier""")
def placed(spark, d):
    """Plans of five buildings laid onto the map by the places known in both."""
    k = F.col("s_suppkey")
    p = table(spark, d, "supplier").select(k.alias("id"), (k % 5).alias("k"), ((k * 37) % 1000 / 10.0).alias("x"), ((k * 53) % 600 / 10.0).alias("y"))
    known = p.withColumn("u", 2 * (F.col("x") * 0.8 - F.col("y") * 0.6) + 10).withColumn("v", 2 * (F.col("x") * 0.6 + F.col("y") * 0.8) - 5)
    return building.placed(p, graph.similarity(known, ["k"]), ["k"]).select("id", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"))


@query("q_m09_homography", "select k as k, round(1.2::double, 5) as h0, round(0.01::double, 5) as h6 from (select distinct n_nationkey as k from nation)")
def homography(spark, d):
    """A screen seen at an angle, once a nation, from nine pairs of points."""
    grid = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x in (0, 5, 10) for y in (0, 4, 8)]))
    p = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), grid.alias("p")).select("k", "p.x", "p.y")
    below = 0.01 * F.col("x") + 0.02 * F.col("y") + 1
    pairs = p.withColumn("u", (1.2 * F.col("x") + 0.1 * F.col("y") + 3) / below).withColumn("v", (-0.2 * F.col("x") + 0.9 * F.col("y") + 1) / below)
    return building.homographies(pairs, ["k"]).select("k", F.round(F.get("h", F.lit(0)), 5).alias("h0"), F.round(F.get("h", F.lit(6)), 5).alias("h6"))
