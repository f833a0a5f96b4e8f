"""Reports of a replay: one pass over a stream that writes what happened, the track, the misses and the confirmations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What each report holds, by the kind of a row; all are CSV with a header but the first, which is lines of text.
KINDS = {"events": ("session", "t", "said"), "track": ("session", "t", "x", "y"), "misses": ("session", "t", "x", "y", "miss"), "confirmed": ("session", "t", "held", "seconds")}


def line(t: Column, said: Column) -> Column:
    """A line of the events' text: seconds with two decimals, and what was said."""
    return F.concat(F.format_string("%8.2f", t / 1e9), F.lit("  "), said)


def write_reports(rows: DataFrame, path: str, checkpoint: str):
    """Starts a query that writes the four reports of a stream of rows(kind, session, t, said, x, y, miss, held, seconds), t in ns.

    The text has the session before each line, as a file for each would be as many files as sessions. Each micro-batch is read once and written under its number to every report, over whatever an attempt that failed has left, so a
    restart neither loses nor repeats rows. Rows of another kind go nowhere.
    """

    def batch(some: DataFrame, number: int) -> None:
        some = some.persist()
        try:
            for kind, columns in KINDS.items():
                own = some.where(F.col("kind") == kind)
                if kind == "events":
                    own.select(F.concat(F.coalesce(F.col("session").cast("string"), F.lit("")), F.lit("\t"), line(F.col("t"), F.col("said"))).alias("value")).write.mode("overwrite").text(f"{path}/{kind}/batch={number}")
                else:
                    own.select(*columns).write.mode("overwrite").option("header", True).csv(f"{path}/{kind}/batch={number}")
        finally:
            some.unpersist()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_report(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A report back, with its columns and the number of the batch that wrote each row."""
    kinds = {"session": "long", "t": "long", "held": "long", "said": "string"}
    if kind == "events":
        lines = spark.read.schema("value string, batch long").option("basePath", f"{path}/{kind}").text(f"{path}/{kind}")
        cut = F.instr("value", "\t")
        return lines.select(F.substring(F.col("value"), cut + 1, F.length("value")).alias("value"), "batch", F.substring(F.col("value"), F.lit(1), cut - 1).try_cast("long").alias("session"))
    schema = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in KINDS[kind])
    return spark.read.schema(f"{schema}, batch long").option("header", True).option("basePath", f"{path}/{kind}").csv(f"{path}/{kind}")
