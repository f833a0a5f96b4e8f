"""Finding a destination: ranked search, the cascade from a room to a node, and short lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import search_key
from .graph import written

#: Empty queries of a block, about; characters of the runs that names are listed under.
BLOCK, GRAM = 5_000, 3


def _each(words: str, n: int, of: Callable[[Column, int], Column]) -> Column:
    """What of gives for each word of a column and n, in one array."""
    return F.flatten(F.transform(words, lambda w: of(w, n)))


def search(names: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, name_id and rank of every name that answers a query; place is its place among the query's answers.

    names(name_id, name, aliases, context) and queries(query_id, query). Rank 0: the key of the name or of an alias is the query's;
    1: it starts with it; 2: it holds all its words; 3: what it doesn't hold starts a word of the context. An empty query
    takes all names, at rank 0.

    A name is listed under all runs of up to GRAM characters of its keys, and under the beginnings of its context's words; whatever the
    rank, it is there under the beginning of each word of the query. A query looks under the one of its words that lists fewest names.
    """
    words = F.filter(F.transform(F.split("query", " "), search_key), lambda w: w != "")
    asked = queries.select("query_id", words.alias("_words")).withColumn("_whole", F.array_join("_words", ""))
    keys = F.concat(F.array(search_key(F.col("name"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), search_key))
    context = F.coalesce("context", F.array().cast("array<string>"))
    parts = F.concat(F.flatten(F.transform(context, lambda t: F.transform(F.split(t, "[ -]"), search_key))), F.transform(context, search_key))
    held = names.select("name_id", keys.alias("_keys"), F.filter(parts, lambda w: w != "").alias("_context"))
    runs = lambda k, n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(k) - n + 1)), lambda i: F.substring(k, i, F.lit(n)))
    listed = F.array_distinct(F.filter(F.concat(*[_each("_keys", n, runs) for n in range(1, GRAM + 1)], *[_each("_context", n, lambda c, n: F.array(F.substring(c, 1, n))) for n in range(1, GRAM + 1)]), lambda g: g != ""))
    lists = written(held.select("name_id", F.explode(listed).alias("gram")), "search-lists")
    grams = asked.select("query_id", F.explode(F.transform("_words", lambda w: F.substring(w, 1, GRAM))).alias("gram")).distinct()
    sizes = lists.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("_n"))
    # a beginning that lists nothing has no answer
    fewest = grams.join(sizes, "gram", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram")).alias("_g")).select("query_id", F.col("_g.gram").alias("gram"))
    pairs = lists.join(fewest, "gram").drop("gram").join(held, "name_id").join(asked, "query_id")
    rank = (
        F.when(F.exists("_keys", lambda k: k == F.col("_whole")), 0)
        .when(F.exists("_keys", lambda k: F.startswith(k, F.col("_whole"))), 1)
        .when(F.exists("_keys", lambda k: F.forall("_words", lambda w: F.contains(k, w))), 2)
        .when((F.size("_context") > 0) & F.forall("_words", lambda w: F.exists("_keys", lambda k: F.contains(k, w)) | F.exists("_context", lambda c: F.startswith(c, w))), 3)
    )
    found = pairs.select("query_id", "name_id", rank.alias("rank")).where("rank is not null")
    # an empty query's answer is the names themselves; the queries are dealt in blocks of a bounded size
    empty = asked.where(F.size("_words") == 0).select("query_id")
    blocks = -(-empty.count() // BLOCK)
    for i in range(blocks):
        block = empty.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        found = found.unionByName(names.select("name_id").join(F.broadcast(block)).select("query_id", "name_id", F.lit(0).alias("rank")))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "name_id")))


def resolve(wanted: DataFrame, sources: list[DataFrame], key: str = "name") -> DataFrame:
    """Each wanted key with the first of the sources (key, node) that has it, and that source's number; null where none has."""
    found = None
    for i, s in enumerate(sources):
        part = s.groupBy(key).agg(F.min("node").alias("node")).withColumn("source", F.lit(i))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy(key).agg(F.min(F.struct("source", "node")).alias("_x"))
    return wanted.join(best, key, "left").select(*wanted.columns, F.col("_x.source").alias("source"), F.col("_x.node").alias("node"))


def with_recent(recents: Column, name: Column, most: int = 5) -> Column:
    """The name in front, once, and at most so many."""
    return F.slice(F.concat(F.array(name), F.filter(recents, lambda x: x != name)), 1, most)


def toggled(list_: Column, name: Column) -> Column:
    return F.when(F.array_contains(list_, name), F.array_remove(list_, name)).otherwise(F.array_append(list_, name))


def quick_list(favourites: Column, recents: Column, available: Column) -> tuple[Column, Column]:
    """Favourites, and recents that aren't among them, of what is still there."""
    kept = F.filter(favourites, lambda x: F.array_contains(available, x))
    return kept, F.filter(recents, lambda x: F.array_contains(available, x) & ~F.array_contains(kept, x))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with place, from 1, in a total order: ranges of the order are numbered by themselves and their sizes added up, so no task gets the whole table."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    base = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_at", inside).join(F.broadcast(base), "_part").withColumn("place", F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")
