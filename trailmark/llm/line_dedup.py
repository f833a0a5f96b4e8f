"""Line dedup: a suffix array over line ids by prefix doubling finds repeated runs of lines; later copies go. DataFrame operations only.

A run counts when it has MIN_WORDS words or more. From a line, the shortest run that counts has a length in lines that depends on
the lines alone; whether it occurs earlier in the corpus decides, and longer prefixes cannot change that. So doubling stops at
the largest power of two within such a length: two overlapping ranks of that depth name a run of any length exactly (equal names,
equal lines), that is, its interval of the suffix array whose common prefix is at least that long. A line goes when it
lies in such a run that isn't the first of its interval.

Runs from each line alone leave the end of a maximal repeated run, up to MIN_WORDS - 1 words. With whole=True the shortest runs that
end at each line count as well, and together they are the maximal runs exactly: of a line in a repeated run [a, b] of MIN_WORDS,
either the shortest run from it ends by b, or it lies in the shortest run that ends at b. Both repeat where [a, b] does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap_of, driver_gives_back, running_start, save, with_hit
from .mixing import words

#: Words that a repeated run of lines must have.
MIN_WORDS = 50
#: Rank space is cut into so many ranges, each ranked by itself.
RANGES = 10


def _line_id(line: Column) -> list[Column]:
    """128 bits."""
    return [F.xxhash64(line).alias("_h1"), F.xxhash64(F.lit(1), line).alias("_h2")]


def _repeated_lines(texts: DataFrame) -> DataFrame:
    """Of the lines that occur more than once: doc, line (from 0), words, and rank of depth 1, ordered by line id."""
    lines = texts.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("line", "_line"))
    lines = save(lines.select("doc", "line", words(F.col("_line")).alias("words"), *_line_id(F.col("_line"))), "lines")
    kinds = lines.groupBy("_h1", "_h2").agg(F.count("*").alias("_n")).where("_n > 1")
    ranked = running_start(kinds.withColumn("_all", F.lit(0)), ["_all"], F.shiftright("_h1", 64 - RANGES), ["_h1", "_h2"], "_n", "rank")
    return lines.join(ranked.select("_h1", "_h2", "rank"), ["_h1", "_h2"]).select("doc", "line", "words", "rank")


def _double(level: DataFrame, depth: int, total: int) -> DataFrame:
    """Ranks of depth 2 * depth from those of depth, of the suffixes that share theirs with another."""
    ahead = Window.partitionBy("doc").orderBy("line")
    pairs = level.select("doc", "line", "rank", F.lead("rank", depth).over(ahead).alias("next"), F.lead("line", depth).over(ahead).alias("at"))
    pairs = pairs.where(F.col("at") == F.col("line") + depth).select("doc", "line", "rank", "next")
    kinds = pairs.groupBy("rank", "next").agg(F.count("*").alias("_n")).where("_n > 1")
    wide = max(0, total.bit_length() - RANGES)
    ranked = running_start(kinds, ["rank"], F.shiftright("next", wide), ["next"], "_n", "_inside")
    new = ranked.select("rank", "next", (F.col("rank") + F.col("_inside")).alias("_new"))
    return pairs.join(new, ["rank", "next"]).select("doc", "line", F.col("_new").alias("rank"))


def _shortest_runs(lines: DataFrame, min_words: int, whole: bool) -> DataFrame:
    """doc, line and length: the fewest lines from there, all repeated, that have min_words words; whole: also the fewest up to a line."""
    island = lines.withColumn("_isl", F.col("line") - F.row_number().over(Window.partitionBy("doc").orderBy("line")))
    upto = Window.partitionBy("doc", "_isl").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    sums = island.withColumn("_sum", F.sum("words").over(upto))
    ends = sums.select("doc", "_isl", F.col("_sum").alias("_key"), F.lit(None).cast("int").alias("start"), F.col("line").alias("end"))
    starts = sums.select("doc", "_isl", (F.col("_sum") - F.col("words") + min_words).alias("_key"), F.col("line").alias("start"), F.lit(None).cast("int").alias("end"))
    down = Window.partitionBy("doc", "_isl").orderBy(F.desc("_key"), F.col("end").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = ends.unionByName(starts).withColumn("_end", F.min("end").over(down)).where("start is not null and _end is not null")
    runs = both.select("doc", F.col("start").alias("line"), (F.col("_end") - F.col("start") + 1).alias("length"))
    if not whole:
        return runs
    # upwards the last start whose key isn't above a line's sum; a run that is short of words without its last line is known from its start
    ends = sums.select("doc", "_isl", F.col("_sum").alias("_key"), (F.col("_sum") - F.col("words")).alias("_before"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("long").alias("_at"), F.col("line").alias("end"))
    starts = starts.withColumn("_at", F.col("_key")).withColumn("_before", F.lit(None).cast("long"))
    up = Window.partitionBy("doc", "_isl").orderBy("_key", F.col("start").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = ends.unionByName(starts).withColumn("_start", F.max(F.struct("start", "_at")).over(up)).where("end is not null and _start.start is not null")
    back = both.where(F.col("_before") >= F.col("_start._at"))
    return runs.unionByName(back.select("doc", F.col("_start.start").alias("line"), (F.col("end") - F.col("_start.start") + 1).alias("length")))


def repeated_runs(texts: DataFrame, *, min_words: int = MIN_WORDS, whole: bool = False) -> DataFrame:
    """doc, line: the lines of texts(doc, text) that lie in later copies of repeated runs. doc must be unique and never null."""
    lines = save(_repeated_lines(texts), "lines-repeated")
    runs = save(_shortest_runs(lines, min_words, whole), "line-runs")
    longest, total = runs.agg(F.max("length")).first()[0] or 0, lines.count()
    depth, levels = 1, [lines.select(F.lit(0).alias("level"), "doc", "line", "rank")]
    while 2 * depth <= longest:
        level = save(_double(levels[-1], depth, total), "line-ranks")
        depth *= 2
        driver_gives_back(texts.sparkSession)
        levels.append(level.select(F.lit(len(levels)).alias("level"), "doc", "line", "rank"))
    ranks = levels[0]
    for level in levels[1:]:
        ranks = ranks.unionByName(level)
    # a level's ranks are told apart from another's by the run's length, which is part of the name
    named = runs.withColumn("level", F.length(F.bin("length")) - 1)
    named = named.join(ranks.withColumnRenamed("rank", "_left"), ["level", "doc", "line"])
    tail = ranks.select("level", "doc", F.col("line").alias("_tail"), F.col("rank").alias("_right"))
    named = named.withColumn("_tail", F.col("line") + F.col("length") - F.expr("shiftleft(1, level)")).join(tail, ["level", "doc", "_tail"])
    named = save(named.select("doc", "line", "length", "_left", "_right"), "line-named")
    first = named.groupBy("length", "_left", "_right").agg(F.min(F.struct("doc", "line")).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    # two tables, so that Spark can split the copies of a run that very many documents share where they meet the first one
    first = save(first, "line-firsts")
    later = named.join(first, ["length", "_left", "_right"]).where(F.struct("doc", "line") != F.col("_first"))
    later = later.groupBy("doc", "line").agg(F.max(F.col("line") + F.col("length") - 1).alias("_end"))
    reach = lines.select("doc", "line").join(later, ["doc", "line"], "left")
    upto = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return reach.withColumn("_reach", F.max("_end").over(upto)).where("_reach >= line").select("doc", "line")


def line_dedup(docs: DataFrame, *, min_words: int = MIN_WORDS, whole: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its text column rewritten, and the array column _removed of (first, last) line numbers that went.

    Lines end at "\\n". Of equal runs, the one with the smallest (id, line) stays; runs repeat within a document as well as
    across. Text without such runs stays as it is, byte for byte; a text of which all lines go becomes empty. A null text stays
    null. An id must name one row; rows with a null id, and all but one of rows that repeat an id, keep their text and don't
    count as copies. Empty lines have no words but can lie within a run. An empty table stays empty. whole: maximal runs go to
    their end; without it, what follows the last start of min_words words in a run stays.

    Only line ids are shuffled, and beyond the first count only those of repeated lines. Whole rows move only where
    something goes; a bitmap of fixed size tells the others.
    """
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    unique = docs.groupBy(id_col).count().where("count > 1")
    repeats = not unique.isEmpty()
    if repeats:
        place = Window.partitionBy("doc").orderBy("text")
        texts = texts.withColumn("_at", F.row_number().over(place)).where("_at = 1").drop("_at")
    gone = save(repeated_runs(texts, min_words=min_words, whole=whole), "lines-gone")
    isle = F.col("line") - F.row_number().over(Window.partitionBy("doc").orderBy("line"))
    spans = gone.withColumn("_isl", isle).groupBy("doc", "_isl").agg(F.min("line").alias("first"), F.max("line").alias("last"))
    spans = save(spans.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("_spans")), "line-spans")
    rows = with_hit(docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")), bitmap_of(spans, "doc"), "_doc")
    hit = rows.where("_hit").join(spans, F.col("_doc") == F.col("doc"), "left")
    if repeats:
        hit = hit.withColumn("_spans", F.when(F.row_number().over(Window.partitionBy("_doc").orderBy(F.col("_text").asc_nulls_last())) == 1, F.col("_spans")))
    kept = F.expr("array_join(filter(split(_text, '\\n', -1), (x, i) -> not exists(_spans, s -> i between s.first and s.last)), '\\n')")
    hit = hit.withColumn("_text", F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(kept))
    miss = rows.where(~F.col("_hit")).withColumn("_spans", F.lit(None).cast(spans.schema["_spans"].dataType))
    out = hit.select("_row", "_text", "_spans").unionByName(miss.select("_row", "_text", "_spans"))
    return out.select(*[F.col("_text").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns], F.coalesce("_spans", F.array().cast(spans.schema["_spans"].dataType)).alias("_removed"))
