"""Token ids in a content-addressed store: rolling hashes cut id streams into chunks, each kept once; recipes and Merkle roots rebuild them.

Files, all Parquet, below one folder of the shared directory:
  blobs/kind=0   chunks: key (BLAKE2b-128 of the ids as stored), n (ids), data (zstd of the ids, little-endian, 2 or 4 bytes each)
  recipes        one row per document in ascending id order: doc_id, start, n_tokens, keys (16 bytes a chunk), root
  manifest       one row per 2**20 ids of the whole stream: block, n_docs, n_tokens, root over the documents' roots

Reading goes the other way: chunks against their keys, the keys found against the document's root, and the roots found against the
manifest's, so a changed byte anywhere, a lost or an added document shows.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, running_start, save, small_batches

#: A chunk ends where the rolling hash of its last 16 ids has this many leading zeros, but is neither shorter nor longer than this.
LEADING, SHORTEST, LONGEST = 9, 128, 4096
#: Words whose ids a task remembers; beyond, it starts anew. A bound on memory, not on the work.
REMEMBERED = 800_000
#: Words of 32 characters at most that come again which a worker process keeps for its next task: some 60 MB.
KEPT = 250_000
#: Ids of a manifest block.
BLOCK = 1 << 20
#: Documents of a range of ids, about: starts are summed by range first. The ranges are Spark's own, from a sample of the ids.
PER_RANGE = 1_000_000
# a space after white space and not before a word: the pre-tokeniser doesn't cut there
_UNCUT = re.compile(r"\s (?!\S)")
_WHITE = [c for c in map(chr, range(0x3001)) if c.isspace()]


def default_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts as the tokenizers library gives them.

    The byte-level pre-tokeniser always cuts before a space that a word follows or precedes, so a text's ids are those of its pieces
    between such spaces, and each piece is encoded once and remembered. A text with other spaces, or with the name of one of the
    vocabulary's added tokens, which the library takes for that token, goes to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        added = [t.content for t in self.model.get_added_tokens_decoder().values() if t.content]
        self.added = added
        self.type = np.dtype("<u2" if self.model.get_vocab_size() <= 65536 else "<u4")
        size = self.model.get_vocab_size()
        self.spaced = np.array([(self.model.id_to_token(i) or "").startswith("\u0120") for i in range(size)])  # ids that begin with a space
        self.known: dict[str, bytes] = {}  # of a piece after a space
        self.heads: dict[str, bytes] = {}  # of a text's first piece
        self.again: set[str] = set()  # pieces that have come again

    def _whole(self, text: str) -> bool:
        """Whether a text goes to the library as it is. What most texts lack is looked for first."""
        return any(a in text for a in self.added) or any(c in text and c + " " in text for c in _WHITE) and bool(_UNCUT.search(text))

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _after_space(self, words: list[str]) -> list[bytes]:
        """Ids of each word after a space. The words begin with no white space, so many are encoded together: each begins at an id with a space."""
        out: list[bytes] = []
        for a in range(0, len(words), 64):
            some = words[a : a + 64]
            ids = np.array(self.model.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, self.type)
            at = np.flatnonzero(self.spaced[ids]).tolist()
            if len(at) == len(some) and at[0] == 0:
                raw, w = ids.tobytes(), ids.itemsize
                out += [raw[i * w : j * w] for i, j in zip(at, [*at[1:], len(ids)], strict=True)]
            else:
                out += self._encode([" " + w for w in some])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        known, heads = self.known, self.heads
        if len(known) + len(heads) > REMEMBERED:
            known.clear()
            heads.clear()
            self.again.clear()
        parts = [[t] if self._whole(t) else t.split(" ") for t in texts]
        first = [p.pop(0) for p in parts]
        words = set().union(*parts)
        new = words.difference(known)
        self.again.update(words.difference(new))
        plain = [w for w in new if w and not w[0].isspace()]
        known.update(zip(plain, self._after_space(plain), strict=True))
        other = [w for w in new if not w or w[0].isspace()]
        known.update(zip(other, self._encode([" " + w for w in other]), strict=True))
        begin = [w for w in dict.fromkeys(first) if w not in heads]
        own = dict(zip(begin, self._encode(begin), strict=True))
        out = [(heads.get(h) or own.get(h, b"")) + b"".join(map(known.__getitem__, p)) for h, p in zip(first, parts, strict=True)]
        heads.update((w, ids) for w, ids in own.items() if len(w) <= 32)
        return out

    def forget(self) -> None:
        """What a task has met goes with it, but for KEPT words that came again: the worker process serves other tasks afterwards."""
        some = [w for w in self.again if len(w) <= 32][:KEPT]
        self.known, self.heads, self.again = {w: self.known[w] for w in some}, {}, set()
        give_back()


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


@functools.cache
def _gear(size: int) -> np.ndarray:
    """A fixed random number per id."""
    z = (np.arange(size, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype(np.uint32)


def cut(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream."""
    h = _gear(1 << (8 * ids.dtype.itemsize) if ids.dtype.itemsize == 2 else int(ids.max(initial=0)) + 1)[ids]
    for s in (1, 2, 4, 8):
        h[s:] += h[:-s] << np.uint32(s)
    ends, last = [], 0
    for e in (np.flatnonzero(h >> np.uint32(32 - LEADING) == 0) + 1).tolist():
        while e - last > LONGEST:
            last += LONGEST
            ends.append(last)
        if e - last >= SHORTEST:
            ends.append(e)
            last = e
    while len(ids) - last > LONGEST:
        last += LONGEST
        ends.append(last)
    if last < len(ids):
        ends.append(len(ids))
    return ends


def key_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over the leaves; an odd one rises by itself."""
    level = list(leaves) or [b""]
    while len(level) > 1:
        level = [key_of(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


@functools.cache
def _zeros(power: int) -> np.ndarray:
    """What 2**power zero bytes do to a CRC-32, as 4 x 256 table."""
    if power < 0:
        bits = [0xEDB88320, *[1 << i for i in range(31)]]
        for _ in range(3):
            bits = [_apply_bits(bits, b) for b in bits]
    else:
        old = _zeros(power - 1)
        bits = [int(_apply(old, np.array([1 << i], np.uint32))[0]) for i in range(32)]
        if power:
            bits = [int(_apply(old, np.array([b], np.uint32))[0]) for b in bits]
    table = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for v in range(256):
            table[byte, v] = _apply_bits(bits, v << 8 * byte)
    return table


def _apply_bits(bits: list[int], v: int) -> int:
    out = 0
    for i, b in enumerate(bits):
        if v >> i & 1:
            out ^= b
    return out


def _apply(table: np.ndarray, v: np.ndarray) -> np.ndarray:
    return table[0][v & 255] ^ table[1][v >> 8 & 255] ^ table[2][v >> 16 & 255] ^ table[3][v >> 24]


def join_crcs(crc: np.ndarray, size: np.ndarray, number: np.ndarray) -> np.ndarray:
    """CRC-32 of each concatenation of parts, from the parts' CRCs and sizes in bytes; number: how many parts each has."""
    end = np.cumsum(number)
    upto = np.cumsum(size)
    after = np.repeat(np.r_[0, upto][end], number) - upto
    crc = crc.astype(np.uint32)
    for power in range(int(after.max(initial=0)).bit_length()):
        on = np.flatnonzero(after >> power & 1)
        crc[on] = _apply(_zeros(power), crc[on])
    out = np.zeros(len(number), np.uint32)
    some = number > 0
    if some.any():
        out[some] = np.bitwise_xor.reduceat(crc, (end - number)[some])
    return out


@dataclass
class Store:
    blobs: DataFrame
    recipes: DataFrame
    manifest: DataFrame
    width: int  # bytes of a stored id

    @property
    def chunks(self) -> DataFrame:
        return self.blobs.where("kind = 0").select("key", "n", "data")


def write_store(docs: DataFrame, *, tokenizer: str | None = None, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> Store:
    """Encodes every whole text of docs (null: empty), appends end_id, and writes the store.

    Documents stand in ascending order of id, null first; rows that repeat an id stand side by side by content. Texts are
    encoded once; a task sends each distinct chunk once, and per chunk one copy of all is kept, so a chunk that many
    documents share never gathers in a task. Other columns are ignored. An empty table gives empty files.
    """
    path, spark = tokenizer or default_tokenizer(), docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = "kind int, key binary, doc_id long, n long, data binary"
    arrow = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, zstd, sent = encoder(path), zstandard.ZstdCompressor(level=3), set()
        tail = b"" if end_id is None else np.array([end_id], enc.type).tobytes()
        for b in batches:
            rows = []
            for doc, raw in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
                ids, keys, last = np.frombuffer(raw + tail, enc.type), [], 0
                for e in cut(ids):
                    data = ids[last:e].tobytes()
                    key = key_of(data)
                    keys.append(key)
                    if key not in sent:
                        sent.add(key)
                        rows.append((0, key, None, e - last, zstd.compress(data)))
                    last = e
                rows.append((1, key_of(str(doc).encode()), doc, len(ids), b"".join(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)] if rows else [pa.array([], f.type) for f in arrow], schema=arrow)
        enc.forget()

    copy = F.row_number().over(Window.partitionBy("key").orderBy("kind"))
    blobs = src.mapInArrow(run, schema).withColumn("_copy", copy).where("kind = 1 or _copy = 1")
    blobs = save(blobs.select("key", "doc_id", "n", "data", "kind"), "token-blobs", by=["kind"])
    recipes = blobs.where("kind = 1").select("doc_id", F.col("n").alias("n_tokens"), F.col("data").alias("keys"))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), recipes.count() // PER_RANGE)
    # written once, so the ranges stay as they were drawn
    ranged = save(recipes.repartitionByRange(ranges, F.col("doc_id").asc_nulls_first()).withColumn("_range", F.spark_partition_id()), "token-ranges")
    recipes = running_start(ranged.withColumn("_all", F.lit(0)), ["_all"], F.col("_range"), ["doc_id", "keys"], "n_tokens", "start")

    @F.pandas_udf("binary")
    def root(keys):
        return keys.map(lambda k: merkle([k[i : i + 16] for i in range(0, len(k), 16)]))

    recipes = recipes.select("doc_id", "start", "n_tokens", "keys", root("keys").alias("root"))
    recipes = save(recipes.repartitionByRange("start").sortWithinPartitions("start"), "token-recipes")
    return Store(blobs, recipes, save(_blocks(recipes), "token-manifest"), encoder(path).type.itemsize)


def _blocks(recipes: DataFrame) -> DataFrame:
    """The manifest of recipes(start, n_tokens, root)."""

    @F.pandas_udf("binary")
    def block_root(roots):
        return roots.map(lambda r: merkle(list(r)))

    blocks = recipes.withColumn("block", F.floor(F.col("start") / BLOCK)).groupBy("block").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.transform(F.array_sort(F.collect_list(F.struct("start", "root"))), lambda x: x["root"]).alias("_roots"))
    return blocks.select("block", "n_docs", "n_tokens", block_root("_roots").alias("root"))


def _references(store: Store) -> DataFrame:
    """A row for each chunk of each document: start of the document, place of the chunk, key."""
    places = F.explode(F.sequence(F.lit(0), F.greatest(F.length("keys") / 16 - 1, F.lit(0)).cast("int")))
    return store.recipes.where(F.length("keys") > 0).select("start", "keys", places.alias("place")).select("start", "place", F.expr("substring(keys, place * 16 + 1, 16)").alias("key"))


def read_documents(store: Store) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and verified per document, from the stored files.

    Each chunk is read and decompressed once. verified: every chunk has the ids that its key says, the keys and lengths found give the
    document's root and number, and the roots found in the document's block give the manifest's. ids_crc32 is of the ids as little-endian unsigned 32-bit integers, joined from the
    chunks' CRCs. A document without ids (no end id, empty text) has CRC 0.
    """
    width = store.width

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdDecompressor()
        for b in batches:
            got = []
            for key, data in zip(b.column("key").to_pylist(), b.column("data").to_pylist(), strict=True):
                try:
                    raw = zstd.decompress(data)
                except zstandard.ZstdError:
                    raw = b""
                ids = np.frombuffer(raw[: len(raw) // width * width], f"<u{width}")
                got.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), key_of(raw) == key))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.bool_())], ["key", "n", "crc", "sound"])

    @F.pandas_udf("n long, crc long, root binary")
    def joined(keys, sizes, crcs):
        import pandas as pd

        number = np.array([len(x) for x in sizes], np.int64)
        size = np.concatenate([*sizes, []]).astype(np.int64)
        crc = join_crcs(np.concatenate([*crcs, []]).astype(np.int64), 4 * size, number)
        end, total = np.cumsum(number), np.r_[0, np.cumsum(size)]
        root = [merkle([k[i : i + 16] for i in range(0, len(k), 16)]) for k in keys]
        return pd.DataFrame({"n": total[end] - total[end - number], "crc": crc.astype(np.int64), "root": root})

    # a table of its own, so that Spark can split the references of a chunk that very many documents share
    digests = save(store.chunks.select("key", "data").mapInArrow(digest, "key binary, n long, crc long, sound boolean"), "token-digests")
    parts = _references(store).join(digests, "key").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("place", "n", "crc"))).alias("_p"), F.bool_and("sound").alias("_sound"))
    both = store.recipes.join(parts, "start", "left")
    each = lambda c: F.coalesce(F.transform("_p", lambda x: x[c]), F.array().cast("array<long>"))
    full = both.withColumn("_f", joined("keys", each("n"), each("crc")))
    same = (F.col("_f.n") == F.col("n_tokens")) & (F.col("_f.root") == F.col("root")) & (F.coalesce(F.size("_p"), F.lit(0)) * 16 == F.length("keys"))
    found = full.select("doc_id", "start", F.col("_f.n").alias("n_tokens"), F.col("_f.crc").alias("ids_crc32"), F.col("_f.root").alias("root"), (same & F.coalesce("_sound", F.lit(True))).alias("_same"))
    found = save(found, "token-found")
    blocks = _blocks(found).select("block", "n_docs", "n_tokens", "root")
    agreed = store.manifest.join(blocks, ["block", "n_docs", "n_tokens", "root"]).select("block", F.lit(True).alias("_agreed"))
    checked = found.withColumn("block", F.floor(F.col("start") / BLOCK)).join(agreed, "block", "left")
    return checked.select("doc_id", "start", "n_tokens", "ids_crc32", (F.col("_same") & F.coalesce("_agreed", F.lit(False))).alias("verified"))


def reconstruct(store: Store) -> DataFrame:
    """doc_id, start and ids of every document, rebuilt from its recipe and chunks; a document without ids has an empty array."""
    width = store.width

    @F.pandas_udf("array<long>")
    def ids(parts):
        zstd = zstandard.ZstdDecompressor()
        return parts.map(lambda p: np.concatenate([np.frombuffer(zstd.decompress(x["data"]), f"<u{width}") for x in p]).astype(np.int64))

    parts = _references(store).join(store.chunks, "key").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("place", "data"))).alias("_parts"))
    return store.recipes.join(parts.select("start", ids("_parts").alias("ids")), "start", "left").select("doc_id", "start", F.coalesce("ids", F.array().cast("array<long>")).alias("ids"))
