"""Target-distribution importance resampling: documents drawn by how much more likely their n-grams are in a target text than in the corpus.

Words get integer ids once, n-grams are tuples of these ids. A block of documents keeps its own small dictionary, so what meets in
joins is a block's distinct words or tuples, never its occurrences: a word that is in every text is one row a block. The bytes of a
distinct tuple are put together and hashed once, its counts in corpus and target are summed, and its gain goes back to the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, give_back, running_start, save, small_batches
from .words import slices, words_of

#: Bytes of text in a block; a longer text is a block of its own.
TOGETHER = 16_000_000


def _one(x: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers of a block's words in order, as they pass between stages: the longest column, so it is compressed."""
    return pa.compress(numbers.astype("<i4").tobytes(), codec="zstd", asbytes=True)


def _unpacked(held: bytes, count: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(held, decompressed_size=4 * count, codec="zstd", asbytes=True), "<i4")


def word_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of rows (target, doc_id, text): their distinct words, and all their words in order as numbers into these; a written table."""
    small_batches(rows.sparkSession)
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"block long, target array<boolean>, docs array<{kind}>, size array<long>, words array<string>, seq binary"

    def block(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        sizes, coded = [], []
        for some in held:  # a slice's words at once, the whole block's only as numbers
            found = [words_of(t) for t in some.column("text").to_pylist()]
            sizes += map(len, found)
            coded.append(pa.array([w for f in found for w in f], pa.binary()).dictionary_encode())
            del found
        whole = pa.chunked_array(coded).unify_dictionaries()
        size, words = pa.array(sizes, pa.int64()), whole.chunk(0).dictionary.cast(pa.string())
        seq = np.concatenate([np.asarray(c.indices) for c in whole.chunks])
        columns = [pa.array([number], pa.int64()), *[_one(table[c].combine_chunks()) for c in ("target", "doc_id")], _one(size), _one(words), pa.array([_packed(seq)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "target", "docs", "size", "words", "seq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            text = batch.column("text").cast(pa.binary())
            batch = pa.RecordBatch.from_arrays([batch.column("target"), batch.column("doc_id"), text], ["target", "doc_id", "text"])
            for a, b in slices(text, TOGETHER // 16):
                more = pa.compute.sum(pa.compute.binary_length(text[a:b])).as_py() or 0
                if held and size + more > TOGETHER:
                    yield block(held, number)
                    number, held, size = number + 1, [], 0
                held.append(batch.slice(a, b - a))
                size += more
        if held:
            yield block(held, number)
        held.clear()
        give_back()

    return save(rows.select("target", "doc_id", "text").mapInArrow(run, schema), "word-blocks", compression="zstd")


def _by_block(rows: DataFrame, value: str) -> DataFrame:
    """Per block the values of its entries in the order of their numbers; a block's entries are bounded by its text."""
    return rows.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", value))), lambda x: x[value]).alias(f"{value}s"))


def tuple_blocks(blocks: DataFrame, ids: DataFrame, max_n: int) -> DataFrame:
    """Blocks with each document's n-grams as numbers into the block's distinct tuples of word ids, and how often a tuple occurs; a written table."""
    kind = dict(blocks.dtypes)["docs"]
    schema = f"block long, docs {kind}, target array<boolean>, size array<long>, n_features array<long>, tuples array<array<long>>, own array<long>, asked array<long>, seq binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = lambda c: batch.column(c)[row].values  # noqa: B023, E731
                size = np.asarray(one("size"))
                seq = _unpacked(batch.column("seq")[row].as_py(), int(size.sum())).astype(np.int64)
                word_id = np.asarray(one("ids")) if batch.column("ids")[row].is_valid else np.zeros(0, np.int64)
                target = np.asarray(one("target").to_numpy(zero_copy_only=False), bool)
                doc = np.repeat(np.arange(len(size)), size)
                tuples, feature, owner, features = [], [], [], np.zeros(len(size), np.int64)
                name, base = seq, 0  # name: the number of the n-gram that begins at a place
                distinct = np.arange(len(word_id))[:, None]
                for n in range(1, max_n + 1):
                    if n > 1:
                        whole = doc[: len(doc) - n + 1] == doc[n - 1 :]
                        pair, name_ = np.unique(name[: len(whole)] * len(word_id) + seq[n - 1 :], return_inverse=True)
                        used, name_of = np.unique(name_[whole], return_inverse=True)
                        distinct = np.concatenate([distinct[pair[used] // max(1, len(word_id))], (pair[used] % max(1, len(word_id)))[:, None]], 1)
                        name = np.full(len(whole), -1, np.int64)
                        name[whole] = name_of
                        here, at = name_of, doc[: len(whole)][whole]
                        name[~whole] = 0  # begins in one document and ends in another: never part of a longer one
                    else:
                        here, at = seq, doc
                    tuples += word_id[distinct].tolist()
                    feature.append(here + base)
                    owner.append(at)
                    base += len(distinct)
                    features += np.maximum(size - n + 1, 0)
                feature_, owner_ = np.concatenate(feature), np.concatenate(owner)
                order = np.argsort(owner_, kind="stable")
                feature_, asking = feature_[order], target[owner_[order]]
                counts = [np.bincount(feature_[~asking], minlength=base), np.bincount(feature_[asking], minlength=base)]
                out = [one("docs"), one("target"), one("size"), pa.array(features), pa.array(tuples, pa.list_(pa.int64())), *[pa.array(c.astype(np.int64)) for c in counts]]
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(row, 1), *map(_one, out), pa.array([_packed(feature_)], pa.binary())], ["block", "docs", "target", "size", "n_features", "tuples", "own", "asked", "seq"])
        give_back()

    held = blocks.drop("words").join(ids, "block", "left").select("block", "docs", "target", "size", "seq", "ids")
    return save(held.mapInArrow(run, schema), "tuple-blocks", compression="zstd")


def weigh(docs: DataFrame, target: DataFrame, *, max_n: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean of gains) per row of docs; target is a table with text_col.

    The gain of a bucket compares its share of the target's features with its share of the corpus's, each count plus one. Whole texts are
    read; a null text has no word, no feature and weight 0. Ids may repeat or be null; other columns are ignored. Only the sums of
    the fixed number of buckets come to the driver.
    """
    corpus = docs.select(F.lit(False).alias("target"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(corpus.dtypes)["doc_id"]
    blocks = word_blocks(corpus.unionByName(target.select(F.lit(True).alias("target"), F.lit(None).cast(kind).alias("doc_id"), F.col(text_col).cast("string").alias("text"))))
    entries = blocks.select("block", F.posexplode("words").alias("n", "word"))
    dictionary = save(entries.select("word").distinct().select("word", F.monotonically_increasing_id().alias("id")), "dictionary")
    held = tuple_blocks(blocks, _by_block(entries.join(dictionary, "word").select("block", "n", "id"), "id"), max_n)
    forget(blocks)
    entries = held.select("block", F.posexplode(F.arrays_zip("tuples", "own", "asked")).alias("n", "x")).select("block", "n", F.col("x.tuples").alias("tuple"), F.col("x.own").alias("own"), F.col("x.asked").alias("asked"))
    counted = entries.groupBy("tuple").agg(F.sum("own").alias("own"), F.sum("asked").alias("asked"))
    parts = counted.select("*", F.posexplode("tuple").alias("at", "id")).join(dictionary, "id")
    # the bytes of a distinct tuple, once
    spelt = parts.groupBy("tuple").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])).alias("feature"), F.first("own").alias("own"), F.first("asked").alias("asked"))
    hashed = save(spelt.select("tuple", F.pmod(F.crc32(F.col("feature").cast("binary")), F.lit(buckets)).cast("int").alias("bucket"), "own", "asked"), "tuples")
    forget(dictionary)
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in hashed.groupBy("bucket").agg(F.sum("own").alias("s"), F.sum("asked").alias("t")).collect():
        s[r["bucket"]], t[r["bucket"]] = r["s"], r["t"]
    gains = np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)
    valued = _by_block(entries.join(hashed.select("tuple", "bucket"), "tuple").select("block", "n", "bucket"), "bucket")

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = lambda c: batch.column(c)[row].values  # noqa: B023, E731
                keep = pa.compute.invert(one("target"))
                n = np.asarray(one("n_features"))
                seq = _unpacked(batch.column("seq")[row].as_py(), int(n.sum()))
                value = gains[np.asarray(one("buckets"))] if batch.column("buckets")[row].is_valid else np.zeros(0, np.int64)
                upto = np.concatenate([[0], np.cumsum(value[seq])])
                end = np.cumsum(n)
                weight = np.where(n > 0, (upto[end] - upto[end - n]) // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([x.filter(keep) for x in (one("docs"), one("size"), pa.array(n), pa.array(weight))], ["doc_id", "n_words", "n_features", "weight"])
        give_back()

    out = held.select("block", "docs", "target", "size", "n_features", "seq").join(valued, "block", "left").select("docs", "target", "size", "n_features", "seq", "buckets")
    weights = save(out.mapInArrow(weighed, f"doc_id {kind}, n_words long, n_features long, weight long"), "weights")
    forget(held, hashed)
    return weights


def resample(docs: DataFrame, target: DataFrame, *, max_n: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank per row of docs: percent of the rows with least_words words are drawn without replacement.

    score is the weight with Gumbel noise that the seed and the id give, in thousandths; the rows of highest scores are drawn, ties to the
    smaller id (null first), and rank numbers them; the others have none. A null id is hashed as an empty text. Scores are whole numbers of
    a bounded range, so ranks are counted by score first and rows meet only within one score.
    """
    weights = weigh(docs, target, max_n=max_n, buckets=buckets, id_col=id_col, text_col=text_col)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    scored = weights.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long"))
    able = F.col("n_words") >= least_words
    drawn = weights.where(able).count() * percent // 100
    placed = running_start(scored.where(able).withColumn("one", F.lit(1).cast("long")), [], -F.col("score"), ["doc_id"], "one", "before")
    ranked = placed.withColumn("rank", F.when(F.col("before") < drawn, F.col("before") + 1))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(rest.select(*columns))
