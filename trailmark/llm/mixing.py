"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

#: Expected copies are counted in units of 2**-24, so their running sums are exact and don't depend on the order of adding.
UNIT = 24
#: No document is taken more often than this.
MOST = 3
#: Documents of one source and size class are dealt into so many groups, by hashed id.
SALTS = 256
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """Sorts as the source does by code point, null last; never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _size_class(size: str) -> Column:
    """Rises with the size; sizes of one class differ by an eighth at most."""
    return F.expr(f"case when {size} < 16 then {size} else length(bin({size})) * 8 + (shiftright({size}, length(bin({size})) - 4) & 7) end")


def source_targets(sized: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per _key of sized(_key, _size): source_size and target.

    All sizes are shared by weight; a target stops at most times its source's size, and what is over goes to the others by weight
    until none is above. The window here is over one row per source, not over documents.
    """
    totals = sized.groupBy("_key").agg(F.sum("_size").alias("source_size"))
    ranked = totals.withColumn("_rank", F.row_number().over(Window.orderBy("_key")))
    ranked = ranked.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") - 1) % len(weights) + 1))
    whole = Window.partitionBy(F.lit(0))
    earlier = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("_weight"), "_key").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(most * F.col("source_size")).over(earlier), F.lit(0))
    weight = F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(earlier), F.lit(0))
    level = ranked.withColumn("_level", left.cast("double") / weight.cast("double"))
    cap, share = F.col("source_size") * float(most), F.col("_level") * F.col("_weight")
    # of the sources in order of size by weight, the first whose cap isn't below its share fixes the level for all from there on
    fixed = level.withColumn("_fixed", F.min(F.when(cap >= share, F.struct(F.col("source_size") / F.col("_weight"), F.col("_key"), F.col("_level")))).over(whole).getField("_level"))
    return fixed.select("_key", "source_size", F.coalesce(F.least(cap, F.col("_fixed") * F.col("_weight")), cap).alias("target"))


def mix_plan(docs: DataFrame, *, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, salts: int = SALTS, carry: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken of each row of docs, and the columns of carry.

    Within a source, documents stand in order of size class, salt, size and hashed id; each adds target / source_size expected
    copies to the running sum, and is emitted once per integer that the sum, from one random offset a source, passes. So a
    source's words come within about a document of each size class and salt of its target. Sizes are words of the whole text.
    A null text has size 0, a null source is a source of its own, a null id is hashed as empty. Rows that repeat an id stand
    side by side as documents of their own. Sources of size 0 get target 0. An empty table stays empty. Other columns are
    ignored, whatever their names.

    The running sum is kept by (source, class, salt): a source is summed by these groups, and documents meet only within one,
    so a hot source or size never comes into one task. The number of salts is a parameter and not taken from the table:
    adding a document moves its own place and no other document's group.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), _source_key(F.col(source_col)).alias("_key"), words(F.col(text_col)).alias("_size"), *carry)
    rows = rows.withColumn("_digest", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("_class", _size_class("_size")).withColumn("_salt", F.conv(F.substring("_digest", 1, 7), 16, 10).cast("long") % salts)
    steps = F.least(F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * (1 << UNIT) + 0.5).cast("long"), F.lit(most << UNIT))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_key"))), 1, 6), 16, 10).cast("long")
    groups = rows.groupBy("_key", "_class", "_salt").agg(F.count("*").alias("_n"), F.sum("_size").alias("_size"))
    targets = source_targets(groups, weights=weights, most=most)
    before = Window.partitionBy("_key").orderBy("_class", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.drop("_size").join(targets, "_key").withColumn("_step", steps)
    groups = groups.withColumn("_base", offset + F.coalesce(F.sum(F.col("_n") * F.col("_step")).over(before), F.lit(0))).drop("_n")
    place = Window.partitionBy("_key", "_class", "_salt").orderBy("_size", "_digest", "doc_id")
    placed = rows.withColumn("_at", F.row_number().over(place)).join(groups, ["_key", "_class", "_salt"])
    passed = lambda n: F.shiftright(F.col("_base") + n * F.col("_step"), UNIT)
    placed = placed.withColumn("copies", passed(F.col("_at")) - passed(F.col("_at") - 1)).withColumnRenamed("_size", "size")
    return placed.withColumn("taken", F.col("copies") * F.col("size")).drop("_key", "_digest", "_class", "_salt", "_at", "_base", "_step")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of docs, all their columns, each row as often as mix_plan() takes it."""
    plan = mix_plan(docs, carry=(F.struct("*").alias("_row"),), **options).where("copies > 0")
    return plan.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
