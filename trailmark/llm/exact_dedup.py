"""Exact dedup: 128-bit content hashes find candidate groups, the bytes inside a group decide."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, save, with_hit


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Documents are equal when their texts are byte for byte; a null text counts as empty. keep: "max" or "min", the id that stays.
    Rows that repeat an id count each in group_size and share the fate of that id. A null id stays only if its whole group has
    none, then keep_id is null and kept true. Other columns are ignored. An empty table gives an empty result.

    Only the hashes of all rows are shuffled. Texts move only where a hash occurs twice (a bitmap of fixed size tells which), and
    equal texts of one task are merged before that, so a group of copies of any size costs each task one text. Grouping by
    hash and text compares the bytes: texts that merely share a hash fall into separate classes, told apart by their SHA-256.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text")).withColumn("_hash", content_hash(F.col("_text")))
    light = save(rows.select("doc_id", "_hash", F.sha2("_text", 256).alias("text_sha256")), "exact-hashes")
    twice = light.groupBy("_hash").count().where("count > 1").select("_hash")
    best = {"max": F.max, "min": F.min}[keep]("doc_id")
    suspects = with_hit(rows, bitmap_of(twice, "_hash"), "_hash").where("_hit")
    classes = suspects.groupBy("_hash", "_text").agg(best.alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    # a table of its own, so that Spark can split the rows of a text with very many copies where they meet their class
    classes = save(classes.select("_hash", F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size"), "exact-classes")
    found = light.join(classes, ["_hash", "text_sha256"], "left")
    found = found.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
    return found.select("doc_id", "keep_id", F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
