"""Ranked lexical search: documents ordered by recursive graph bisection, an inverted index cut into shards of that order, shards visited by bound.

The order is learnt on a bounded sample: at each node of a binary tree documents change sides while that shortens the gaps between
the documents of a term, and what the sides' term frequencies say then places every document, which goes down the tree. The
order (leaf, lean at the last node, doc_id) is cut into shards of bounded size. For each term a shard has the largest share
of a score that any of its documents gets from it, so the sum over an item's terms bounds all scores in the shard.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, give_back, save, small_batches
from .words import slices, words_of

#: The order is learnt on about so many documents, terms hashed to so many buckets; the tree has 2 ** LEVELS leaves.
SAMPLE, BUCKETS, LEVELS, SWAPS = 4000, 1 << 13, 6, 8
#: A shard has at most so many documents, and ends where so many postings are reached.
SHARD_DOCS, SHARD_POSTINGS = 4096, 4_000_000
#: Bytes of text a task takes apart at once.
TOGETHER = 4_000_000
#: Items are asked in blocks of about so many pairs of item and term.
BLOCK = 50_000
#: A first round visits at least so many of an item's best shards, each later round so many times more.
FIRST, WIDER = 4, 16
#: Bounds are counted in so many classes an octave to choose how many shards a round visits.
FINE = 16

FORWARD = "n long, terms array<string>, tfs array<int>"
SHARDS = "shard long, docs array<{}>, terms array<string>, ends array<int>, at array<int>, share array<int>, top array<int>"


def _lists(values: pa.Array, count: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), values)


def terms_of(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows with n (terms with repeats), their distinct terms and how often each occurs, in place of the text; rows without a term go."""
    small_batches(rows.sparkSession)
    rest = [c for c in rows.columns if c != text_col]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*rest).dtypes) + (", " if rest else "") + FORWARD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(text_col).cast(pa.binary())
            for a, b in slices(text, TOGETHER):
                found = [Counter(words_of(t)) for t in text[a:b].to_pylist()]
                keep = np.array([bool(c) for c in found])
                count = np.fromiter(map(len, found), np.int64, len(found))[keep]
                terms = pa.array([w for c in found for w in c], pa.binary()).cast(pa.string())
                tfs = np.fromiter((n for c in found for n in c.values()), np.int32, int(count.sum()))
                n = np.add.reduceat(tfs, np.cumsum(count) - count, dtype=np.int64) if len(tfs) else np.zeros(0, np.int64)
                some = pa.array(keep)
                yield pa.RecordBatch.from_arrays([*[batch.column(c)[a:b].filter(some) for c in rest], pa.array(n), _lists(terms, count), _lists(pa.array(tfs), count)], [*rest, "n", "terms", "tfs"])
                del found, terms, tfs
        give_back()

    return rows.mapInArrow(run, schema)


def _buckets(terms: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each term of all rows together, and the number of terms of each row."""
    coded = terms.flatten().dictionary_encode()
    own = np.fromiter((zlib.crc32(w) & BUCKETS - 1 for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.int32, len(coded.dictionary))
    return own[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.int32), np.asarray(terms.value_lengths()).astype(np.int64)


@dataclass
class Tree:
    """Nodes by level, root first: weights of buckets, and the lean from which on a document goes left."""

    weights: np.ndarray
    limit: np.ndarray

    def place(self, bucket: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each document and its lean at the last node; documents have one bucket at least."""
        node, lean = np.zeros(len(count), np.int64), np.zeros(len(count), np.float32)
        begin = np.cumsum(count) - count
        for _ in range(LEVELS):
            lean = np.add.reduceat(self.weights[np.repeat(node, count), bucket], begin) / count if len(count) else lean
            node = 2 * node + 1 + (lean < self.limit[node])
        return node - (1 << LEVELS) + 1, lean


def bisect(docs: list[np.ndarray]) -> Tree:
    """Recursive graph bisection of documents given as distinct buckets: halves swap documents while that lowers the sum over terms
    of degree * log2(size / (degree + 1)), the estimated bits of the gaps between a term's documents."""
    nodes = (1 << LEVELS) - 1
    tree = Tree(np.zeros((nodes, BUCKETS), np.float32), np.zeros(nodes, np.float32))
    parts = {0: np.arange(len(docs))}
    for node in range(nodes):
        part = parts.pop(node)
        count = np.array([len(docs[d]) for d in part], np.int64)
        flat = np.concatenate([docs[d] for d in part]) if len(part) else np.zeros(0, np.int32)
        begin, left = np.cumsum(count) - count, np.arange(len(part)) < (len(part) + 1) // 2
        lean = np.zeros(len(part))
        for _ in range(SWAPS if len(part) > 1 else 0):
            here = np.repeat(left, count)
            deg = [np.bincount(flat[here], minlength=BUCKETS).astype(np.float64), np.bincount(flat[~here], minlength=BUCKETS).astype(np.float64)]
            size = [max(1, int(left.sum())), max(1, int((~left).sum()))]
            tree.weights[node] = np.log2((deg[0] + 1) / (size[0] + 1)) - np.log2((deg[1] + 1) / (size[1] + 1))

            def cost(d: np.ndarray, n: int) -> np.ndarray:
                return d * np.log2(n / (d + 1))

            now = cost(deg[0], size[0]) + cost(deg[1], size[1])
            over = now - cost(np.maximum(deg[0] - 1, 0), size[0]) - cost(deg[1] + 1, size[1])  # gained when a left document moves
            back = now - cost(deg[0] + 1, size[0]) - cost(np.maximum(deg[1] - 1, 0), size[1])
            gain = np.add.reduceat(np.where(here, over[flat], back[flat]), begin)
            a, b = np.flatnonzero(left), np.flatnonzero(~left)
            a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
            pairs = int((gain[a[: len(b)]] + gain[b[: len(a)]] > 1e-9).sum())
            if not pairs:
                break
            left[a[:pairs]], left[b[:pairs]] = False, True
        if len(part):
            lean = np.add.reduceat(tree.weights[node][flat], begin) / count
            tree.limit[node] = np.float32(np.median(lean))
        if 2 * node + 2 < nodes:
            parts[2 * node + 1], parts[2 * node + 2] = part[lean >= tree.limit[node]], part[lean < tree.limit[node]]
    return tree


def _learn(forward: DataFrame, rows: int, id_col: str) -> Tree:
    """The tree from the rows of smallest hashed id, SAMPLE of them at most; a row is at most BUCKETS numbers then."""

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, count = _buckets(batch.column("terms"))
            own = [np.unique(x) for x in np.split(flat, np.cumsum(count)[:-1])] if len(count) else []
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(own, pa.list_(pa.int32()))], ["place", "own"])

    place = F.pmod(F.xxhash64(F.lit("order"), F.col(id_col)), F.lit(1 << 32))
    share = min(1 << 32, 2 * (SAMPLE << 32) // max(rows, 1) + 1)
    near = forward.select(place.alias("place"), "terms").where(F.col("place") < share)
    table = near.mapInArrow(bucketed, "place long, own array<int>").orderBy("place", "own").limit(SAMPLE).toArrow()
    return bisect([np.asarray(x.values) for x in table["own"].combine_chunks()] if table.num_rows else [])


@dataclass
class Index:
    """shards is a written table; n_docs and n_terms are the documents with a term and all their terms."""

    shards: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS) -> Index:
    """An index of every row of docs that has a term, whole texts.

    Ids may repeat or be null: rows stay apart. Other columns are ignored. Forward lists are written once and go when the shards are
    written; their order is a range partitioning by (leaf, lean, id), so no leaf, however large, is one task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    forward = save(terms_of(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))), "forward", compression="zstd")
    n_docs, n_terms = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tree = spark.sparkContext.broadcast(_learn(forward, n_docs, "doc_id"))
    kind, step = dict(forward.dtypes)["doc_id"], max(1, min(64, shard_docs // 4))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, lean = tree.value.place(*_buckets(batch.column("terms")))
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(lean.astype(np.float32)), *batch.columns], ["leaf", "lean", *batch.schema.names])

    def shard(rows: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        n = [25 + 75 * x * n_docs // n_terms for x in table["n"].to_pylist()]  # a document's m; Python's integers don't overflow
        terms, tf = table["terms"].combine_chunks(), np.asarray(table["tfs"].combine_chunks().flatten()).astype(np.int64)
        count = np.asarray(terms.value_lengths()).astype(np.int64)
        coded = terms.flatten().dictionary_encode()
        at = np.repeat(np.arange(len(count), dtype=np.int32), count)
        share = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(np.array(n, np.int64), count))
        code = np.asarray(coded.indices)
        order = np.argsort(code, kind="stable")
        held = np.bincount(code, minlength=len(coded.dictionary))
        ends = np.cumsum(held)
        top = np.maximum.reduceat(share[order], ends - held)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        whole = [pa.array([number], pa.int64()), one(table["doc_id"].combine_chunks()), one(coded.dictionary), one(pa.array(ends.astype(np.int32)))]
        return pa.RecordBatch.from_arrays([*whole, one(pa.array(at[order])), one(pa.array(share[order].astype(np.int32))), one(pa.array(top.astype(np.int32)))], ["shard", "docs", "terms", "ends", "at", "share", "top"])

    def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, rows, docs_, postings = TaskContext.get().partitionId() << 33, [], 0, 0
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                rows.append(part)
                docs_ += part.num_rows
                postings += len(part.column("terms").flatten())
                if docs_ + step > shard_docs or postings >= SHARD_POSTINGS:
                    yield shard(rows, number)
                    number, rows, docs_, postings = number + 1, [], 0, 0
        if rows:
            yield shard(rows, number)
        rows.clear()
        give_back()

    schema = f"leaf int, lean float, doc_id {kind}, {FORWARD}"
    parts = max(1, -(-n_docs // max(1, shard_docs - 2 * step)))
    ordered = forward.mapInArrow(placed, schema).repartitionByRange(parts, "leaf", "lean", "doc_id").sortWithinPartitions("leaf", "lean", "doc_id")
    shards = save(ordered.select("doc_id", "n", "terms", "tfs").mapInArrow(inverted, SHARDS.format(kind)), "shards", compression="zstd")
    forget(forward)
    tree.unpersist()
    return Index(shards, n_docs, n_terms)


class Asked:
    """A block of items: pairs of item and term, terms once, pairs in the order of items."""

    def __init__(self, rows: list):
        self.items = [(r["item_id"], r["key"]) for r in rows]
        self.terms = sorted({t for r in rows for t in r["terms"]})
        number = {t: i for i, t in enumerate(self.terms)}
        self.term = np.array([number[t] for r in rows for t in r["terms"]], np.int64)
        self.times = np.array([n for r in rows for n in r["tfs"]], np.int64)
        size = np.array([len(r["terms"]) for r in rows], np.int64)
        self.begin = np.cumsum(size) - size
        self.end = self.begin + size
        self.weight = np.zeros(len(self.terms), np.int64)

    def found(self, terms: pa.Array) -> np.ndarray:
        """The place of each asked term among a shard's terms, -1 where it has none."""
        return np.asarray(pa.compute.index_in(pa.array(self.terms, pa.string()), value_set=terms).fill_null(-1)).astype(np.int64)

    def bounds(self, top: np.ndarray, place: np.ndarray) -> np.ndarray:
        """By item, what no document of the shard scores above."""
        best = np.where(place >= 0, top[place], 0) * self.weight
        return np.add.reduceat(self.times * best[self.term], self.begin)


def _bound_class(bound: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(bound, 1)) * FINE).astype(np.int64)


def _first(rows: DataFrame, most: int) -> DataFrame:
    """The best rows of each item, most at the most: by score, then by doc_id, null last."""
    best = Window.partitionBy("item_id", "key").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def _asked_block(index: Index, asked: Asked, most: int, item_type: pa.DataType, hits_schema: str) -> DataFrame:
    """item_id, key, doc_id, score and rank of a block's items: rounds over the shards, best bounds first, until no bound left can enter."""
    spark, shards = index.shards.sparkSession, index.shards

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(asked.terms), np.int64)
        for batch in batches:
            for terms, ends in zip(batch.column("terms"), batch.column("ends"), strict=True):
                place, ends = asked.found(terms.values), np.asarray(ends.values)
                df += np.where(place >= 0, np.diff(ends, prepend=0)[place], 0)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    held = np.zeros(len(asked.terms), np.int64)
    for r in shards.select("terms", "ends").mapInArrow(counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        held[r["term"]] = r["df"]
    asked.weight = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for terms, top in zip(batch.column("terms"), batch.column("top"), strict=True):
                bound = asked.bounds(np.asarray(top.values).astype(np.int64), asked.found(terms.values))
                seen.update((i, c) for i, c in enumerate(_bound_class(bound).tolist()) if bound[i] > 0)
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in seen], pa.int64()), pa.array([c for _, c in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], ["item", "class", "n"])

    classes: list[dict[int, int]] = [{} for _ in asked.items]
    for r in shards.select("terms", "top").mapInArrow(classed, "item long, class long, n long").groupBy("item", "class").agg(F.sum("n").alias("n")).collect():
        classes[r["item"]][r["class"]] = r["n"]

    def visited(low: np.ndarray, high: np.ndarray, least: np.ndarray):
        """A round: of each shard those items whose bound has a class in [low, high) and reaches the score that the item asks for by now."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    one = lambda c: batch.column(c)[row].values  # noqa: B023, E731
                    place, top = asked.found(one("terms")), np.asarray(one("top")).astype(np.int64)
                    bound = asked.bounds(top, place)
                    due = _bound_class(bound)
                    due = np.flatnonzero((bound > 0) & (bound >= least) & (due >= low) & (due < high))
                    if not due.size:
                        continue
                    ends, at, share, docs = np.asarray(one("ends")), np.asarray(one("at")), np.asarray(one("share")), one("docs")
                    who, where, what = [], [], []
                    for i in due.tolist():
                        score = np.zeros(len(docs), np.int64)
                        for t, n in zip(asked.term[asked.begin[i] : asked.end[i]].tolist(), asked.times[asked.begin[i] : asked.end[i]].tolist(), strict=True):
                            p = place[t]
                            if p >= 0:
                                a, b = (ends[p - 1] if p else 0), ends[p]
                                score[at[a:b]] += n * asked.weight[t] * share[a:b].astype(np.int64)
                        some = np.flatnonzero(score >= max(1, least[i]))
                        if len(some) > most:
                            edge = np.partition(score[some], len(some) - most)[len(some) - most]
                            over, ties = some[score[some] > edge], some[score[some] == edge]
                            ties = ties[np.asarray(pa.compute.sort_indices(docs.take(pa.array(ties))))[: most - len(over)]]
                            some = np.concatenate([over, ties])
                        who += [i] * len(some)
                        where.append(some)
                        what.append(score[some])
                    at_ = np.concatenate(where)
                    yield pa.RecordBatch.from_arrays([pa.array([asked.items[i][0] for i in who], item_type), pa.array([asked.items[i][1] for i in who], pa.string()), docs.take(pa.array(at_)), pa.array(np.concatenate(what))], ["item_id", "key", "doc_id", "score"])
            give_back()

        return run

    n = len(asked.items)
    number = {x: i for i, x in enumerate(asked.items)}
    best, least, high, shards_due = None, np.ones(n, np.int64), np.full(n, 1 << 40, np.int64), FIRST
    while True:
        low = np.zeros(n, np.int64)
        for i, c in enumerate(classes):
            left = 0
            for k in sorted((k for k in c if k < high[i]), reverse=True):
                left += c[k]
                if left >= shards_due:
                    low[i] = k
                    break
        hits = shards.mapInArrow(visited(low, high, least), hits_schema)
        best = save(_first(hits if best is None else hits.unionByName(best.drop("rank")), most), "ranked")
        for r in best.where(F.col("rank") == most).collect():
            least[number[r["item_id"], r["key"]]] = r["score"]
        high, shards_due = low, shards_due * WIDER
        if not any(k < high[i] and k >= _bound_class(least[i : i + 1])[0] for i, c in enumerate(classes) for k in c):
            return best


def search(index: Index, items: DataFrame, *, most: int = 10, item_col: str = "item_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: each item's best documents with a score above 0, ties by doc_id, exact.

    An item is a distinct row of (item_col, text_col): equal rows count once, rows of one id and other texts are ranked apart. Items are
    asked in blocks of about block pairs of item and term, each block in rounds over the shards; a round visits the shards of best
    bounds that are left, and the rounds end when no bound left reaches an item's last score.
    An item without a term found, or an empty index, gives no rows.
    """
    spark = items.sparkSession
    kind = dict(items.select(F.col(item_col).alias("x")).dtypes)["x"]
    rows = items.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).distinct()
    asked = save(terms_of(rows.withColumn("key", F.md5(F.coalesce("text", F.lit(""))))), "asked")
    pairs = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-pairs // block))
    doc_type = dict(index.shards.dtypes)["docs"][len("array<") : -1]
    schema = f"item_id {kind}, key string, doc_id {doc_type}, score long"
    out = None
    for k in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("item_id", "key"), F.lit(blocks)) == k).toArrow()
        if some.num_rows and index.n_docs:
            found = _asked_block(index, Asked(some.to_pylist()), most, some.schema.field("item_id").type, schema)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"{schema}, rank int")
    return out.select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, *, most: int = 10) -> DataFrame:
    """Builds the index of docs and asks it all items."""
    return search(build_index(docs), items, most=most)

