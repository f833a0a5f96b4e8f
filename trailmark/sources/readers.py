"""JSON plans and map extracts, timetables and ragged sensor recordings as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLAN = """buildingId string, floors array<int>, entranceId string,
    nodes array<struct<id:string,floor:int,x:float,y:float,type:string,name:string,amenity:string>>,
    edges array<array<string>>, campusLinks array<array<string>>, indoorLinks array<array<string>>,
    areas array<struct<floor:int,polygon:array<array<float>>>>, stairwells array<struct<key:string,floor:int,path:array<array<float>>>>"""
TIMETABLES = """generatedAt string, timetables array<struct<programId:string,program:string,level:string,semester:int,year:int,module:string,lastModified:string,
    notes:array<string>,areaGroups:map<string,array<int>>,classes:array<struct<day:int,date:string,start:string,end:string,room:string,type:string,subject:string,
    lecturers:array<string>,groups:struct<raw:string,all:boolean,elective:boolean,numbers:array<int>,areas:array<string>,biweekly:boolean>>>>>"""
# Marks of an edge that is stairs to walk, only for locating, or only for routes; and kinds of edges.
STEPS, LOCATE_ONLY, ROUTE_ONLY = "STEPS", "LOCATE", "ROUTE"
KINDS = {"HOD": "WALK", "STEPENICE": "STAIRS", "LIFT": "LIFT"}


def plans(spark: SparkSession, path: str) -> DataFrame:
    """One row per plan file; keys that the schema doesn't know are passed over, missing ones are null."""
    return spark.read.schema(PLAN).option("multiLine", True).json(path)


def plan_nodes(plan: DataFrame) -> DataFrame:
    return plan.select(F.col("buildingId").alias("building"), F.explode("nodes").alias("n")).select("n.id", "building", "n.floor", "n.x", "n.y", F.col("n.type").alias("kind"), "n.name", "n.amenity")


def plan_edges(plan: DataFrame, marks: tuple[str, str, str] = (STEPS, LOCATE_ONLY, ROUTE_ONLY)) -> DataFrame:
    """Edges and links as one table; an edge kind that isn't known raises an error when the row is read."""
    own = plan.select(F.explode("edges").alias("e")).select(F.get("e", F.lit(0)).alias("a"), F.get("e", F.lit(1)).alias("b"), F.get("e", F.lit(2)).alias("_k"), F.get("e", F.lit(3)).alias("_m"))
    links = plan.select(F.explode(F.concat(F.coalesce("campusLinks", F.array()), F.coalesce("indoorLinks", F.array()))).alias("e"))
    links = links.select(F.get("e", F.lit(0)).alias("a"), F.get("e", F.lit(1)).alias("b"), F.lit("HOD").alias("_k"), F.get("e", F.lit(2)).alias("_m"))
    known = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    kind = F.coalesce(F.try_element_at(known, F.col("_k")), F.raise_error(F.concat(F.lit("unknown edge kind "), F.col("_k"))).cast("string"))
    flags = [F.coalesce(F.col("_m") == m, F.lit(False)).alias(n) for m, n in zip(marks, ("steps", "locate_only", "route_only"), strict=True)]
    return own.unionByName(links).select("a", "b", kind.alias("kind"), *flags)


def overpass(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, lat, lon) and ways (id, nodes, tags) of a saved map extract."""
    raw = spark.read.option("multiLine", True).schema("elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>>").json(path)
    e = raw.select(F.explode("elements").alias("e")).select("e.*")
    return e.where("type = 'node'").select("id", "lat", "lon"), e.where("type = 'way'").select("id", "nodes", F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"))


def minutes(clock: Column) -> Column:
    """Minutes from midnight of "HH:mm"."""
    part = F.split(clock, ":")
    return part.getItem(0).cast("int") * 60 + part.getItem(1).cast("int")


def classes(spark: SparkSession, path: str) -> DataFrame:
    """A row per class of a timetable file, with its timetable's id, semester and area groups."""
    t = spark.read.schema(TIMETABLES).option("multiLine", True).json(path).select(F.explode("timetables").alias("t")).select("t.*")
    ident = F.concat_ws("|", "programId", "level", "semester", F.coalesce("module", F.lit("")))
    c = t.select(ident.alias("timetable"), "program", "semester", "year", "areaGroups", F.explode("classes").alias("c"))
    return c.select("timetable", "program", "semester", "year", "areaGroups", "c.day", F.to_date("c.date").alias("date"), minutes(F.col("c.start")).alias("st"), minutes(F.col("c.end")).alias("en"), "c.room", F.col("c.type").alias("kind"), "c.subject", "c.lecturers", "c.groups")


def recording(lines: DataFrame) -> DataFrame:
    """Wide rows of recordings(session, line, value), one per event: tag, t_ns and what its tag carries; batch or stream.

    Lines are ragged: the tag says what the fields are. A line without a time, or of a tag that isn't known, keeps its text.
    """
    f = F.split("value", ",", -1)
    at = lambda i, kind="double": F.expr(f"try_cast(get(_f, {i}) as {kind})")
    on = lambda tags, c: F.when(F.col("tag").isin(*tags), c)
    rows = lines.withColumn("_f", f).withColumn("tag", F.get("_f", F.lit(0)))
    return rows.select(
        *[c for c in ("session", "line") if c in lines.columns], "tag", at(1, "bigint").alias("t_ns"),
        on("R", F.transform(F.slice("_f", 3, 9), lambda x: x.try_cast("double"))).alias("m"),
        on(("A", "G"), at(2)).alias("x"), on(("A", "G"), at(3)).alias("y"), on("A", at(4)).alias("z"), on("G", at(4)).alias("accuracy"),
        on("S", at(2)).alias("heading"), on("S", at(3, "int")).alias("redo"), on("S", at(6)).alias("peak"),
        on("L", F.get("_f", F.lit(2))).alias("reason"), on(("L", "T", "H"), F.get("_f", F.when(F.col("tag") == "L", 3).otherwise(2))).alias("building"),
        on(("L", "T", "H"), F.expr("try_cast(get(_f, case when tag = 'L' then 4 else 3 end) as int)")).alias("floor"),
        on("V", at(4)).alias("height"), on("K", at(2)).alias("step_length"), on("X", F.array_join(F.slice("_f", 3, 1000), ",")).alias("text"), F.col("value").alias("raw"))
