"""N-gram Jaccard join: adaptive multi-match prefixes over word shingles, exact links, components.

A document's shingles stand in one global order (estimated frequency, then hash). Two sets that overlap by a share of 3/4 or more of
either share at least l of their first |set| - ceil(3/4 |set|) + l shingles, for every l. Each document takes the l, up to all it must
share, that makes its estimated cost least: postings to scan, and candidates to verify, which are fewer the more shared shingles are asked
for. A posting carries its place in the document's order, so that a pair, whose sizes are then known, asks for the l shared shingles
within prefixes of |set| - (overlap that this pair needs) + l, which are far shorter than those that serve every partner. A pair is a
candidate if it shares as many shingles there as the smaller l of the two asks for.

Equal sets are one node, named by a fingerprint. A shingle never gives more than CROWD / 2 rows a node at a time: where it would, its nodes
meet some of its own as pivots first, twice as many each round; links are merged into components, and only pairs across components, which
alone can still change the result, are formed afterwards. The rule holds for every l, and there a pair asks for l = 1: one shared
shingle within the shortest prefixes. Copies of one text that are no copies of each other share many shingles, but few there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, driver_gives_back, give_back, save, small_batches, with_hit

#: Words of a shingle, and the share of the union that the intersection must have, as a fraction.
SHINGLE, SHARE = 5, (3, 4)
#: Counters of the frequency estimate: a fixed-size sketch of all shingles of all documents.
COUNTERS = 1 << 22
#: The cost of verifying a candidate in postings scanned.
VERIFY_COST = 20.0
#: Other documents that a shingle is thought to be in which the sketch can't tell from chance.
UNSEEN = 0.1
#: Nodes of a shingle whose pairs are formed at once. A bound on rows: a shingle gives no more than CROWD / 2 a node.
CROWD = 64
#: Nodes of a shingle that are compared in one task.
BLOCK_NODES = 1024

_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


#: Buckets of a set's histogram: the sum of smaller counts bounds an overlap from above.
BUCKETS = 256
#: Texts of about so many characters are hashed together.
TOGETHER = 1_000_000


class Shingler:
    """Shingle sets of texts as sorted arrays of 64-bit hashes. Words are what white space (space and bytes 9 to 13) parts, A-Z in lower case."""

    def __init__(self, salt: int = 0, shingle: int = SHINGLE):
        rng = np.random.default_rng(1000 + salt)
        some = lambda n: rng.integers(0, 1 << 64, n, np.uint64)
        self.letters, self.places, self.size = some(256), some(shingle) | np.uint64(1), shingle
        self.letters[65:91] = self.letters[97:123]
        self.blank = np.zeros(256, bool)
        self.blank[[32, *range(9, 14)]] = True
        self.base = int(some(1)[0]) | 1
        self.powers = self.inverse = np.zeros(0, np.uint64)

    def _power(self, n: int) -> None:
        """Powers of base and of its inverse, modulo 2**64, up to n."""
        if len(self.powers) < n:
            n = max(n, 1 << 21)
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.base, np.uint64)])
            self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, pow(self.base, -1, 1 << 64), np.uint64)])

    def _words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and beginning of each word: a polynomial in its bytes, from running sums."""
        byte = np.frombuffer(raw, np.uint8)
        self._power(len(byte) + 1)
        gap = np.r_[True, self.blank[byte], True]
        turn = np.flatnonzero(gap[1:] != gap[:-1])
        begin, end = turn[::2], turn[1::2]
        run = np.r_[np.uint64(0), np.cumsum(self.letters[byte] * self.powers[: len(byte)])]
        return _mix((run[end] - run[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64)), begin

    def _together(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        at = np.cumsum(size + 1) - size - 1
        h, begin = self._words(b" ".join(raw))
        first = np.r_[np.searchsorted(begin, at), len(h)]
        n = self.size
        if len(h) >= n:
            whole = sum((h[i : len(h) - n + 1 + i] * self.places[i] for i in range(n)), np.uint64(n))
            whole = _mix(whole)
        out = []
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if hi - lo >= n:
                x = np.sort(whole[lo : hi - n + 1])
                keep = np.empty(len(x), bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                out.append(x[keep])
            elif hi > lo:
                out.append(_mix(np.array([sum(int(v) * int(p) for v, p in zip(h[lo:hi], self.places, strict=False)) + hi - lo & (1 << 64) - 1], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b] or "") <= TOGETHER):
                size += len(texts[b] or "")
                b += 1
            yield from self._together([t or "" for t in texts[a:b]])
            a = b


def histogram(shingles: np.ndarray) -> bytes | None:
    """Counts by bucket; none where a byte is too small for one."""
    n = np.bincount((shingles >> np.uint64(8)).astype(np.int64) & (BUCKETS - 1), minlength=BUCKETS)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else None


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed longs."""
    if not len(shingles):
        return 0, 0
    a, b = _mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64), _mix(shingles + _P).sum(dtype=np.uint64)
    return int(_mix(np.array([a + np.uint64(len(shingles))]))[0].astype(np.int64)), int(b.astype(np.int64))


def least_overlap(size: np.ndarray | int, share: tuple[int, int] = SHARE):
    """ceil(share * size): what a set of this size must share at least with any it is linked to."""
    return -(-size * share[0] // share[1])


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def prefix(shingles: np.ndarray, extra: np.ndarray, share: tuple[int, int]) -> tuple[int, np.ndarray]:
    """The chosen l and the prefix. extra: by counter, the estimated number of other documents that have the shingle."""
    estimate, need = extra[_slot(shingles)], int(least_overlap(len(shingles), share))
    base, often = len(shingles) - need, estimate > 0
    order = np.arange(len(shingles))
    if often.any():
        level = np.zeros(len(shingles), np.int64)
        level[often] = np.log2(estimate[often]).astype(np.int64) + 1
        order = np.argsort(level, kind="stable")  # the shingles are sorted
    scanned = np.cumsum(np.where(often, estimate, UNSEEN)[order])[base:]
    shared = np.arange(1, need + 1)
    best = int((base + shared + scanned + VERIFY_COST * scanned / shared).argmin()) + 1
    return best, shingles[order[: base + best]]


def within(n: np.ndarray, l: np.ndarray, at: np.ndarray, n2: np.ndarray, l2: np.ndarray, at2: np.ndarray, share: tuple[int, int]) -> np.ndarray:  # noqa: E741
    """Whether a shingle at these places of two sets of n and n2 shingles counts for the pair: both places are in the prefixes it asks for."""
    num, den = share
    spare = np.minimum(l, l2) + num * (n + n2) // -(num + den)  # l - ceil(overlap needed)
    return (den * np.minimum(n, n2) >= num * np.maximum(n, n2)) & (at < n + spare) & (at2 < n2 + spare)


def _within(a: str, b: str, share: tuple[int, int]) -> Column:
    """The same of columns n and at with a prefix each, and l = 1."""
    num, den = share
    of = lambda c: (F.col(f"{a}{c}"), F.col(f"{b}{c}"))
    (n, n2), (at, at2) = of("n"), of("at")
    spare = 1 - F.expr(f"({num} * ({a}n + {b}n) + {num + den - 1}) div {num + den}")
    return (den * F.least(n, n2) >= num * F.greatest(n, n2)) & (at < n + spare) & (at2 < n2 + spare)


def _in_order(batch: pa.RecordBatch, shingler: Shingler) -> Iterator[np.ndarray]:
    return shingler.sets(batch.column("text").to_pylist())


#: Counters travel in blocks of so many.
_BLOCK = 1 << 14


def _fingerprints(docs: DataFrame, salt: int) -> DataFrame:
    """Rows of kind 0: doc_id, n, fingerprint (hi, lo) and histogram of each document; of kind 1, a few a task: n is a block, data its counts."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, count, names = Shingler(salt), np.zeros(COUNTERS, np.int64), ["kind", "doc_id", "n", "hi", "lo", "data"]
        ids = None
        for b in batches:
            sets = list(_in_order(b, s))
            ids = b.column("doc_id").type
            if sets:
                count += np.bincount(_slot(np.concatenate(sets)), minlength=COUNTERS)
            prints = [fingerprint(x) for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), b.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x[0] for x in prints], pa.int64()), pa.array([x[1] for x in prints], pa.int64()), pa.array([histogram(x) if len(x) else None for x in sets], pa.binary())], names)
        if count.any():
            n = COUNTERS // _BLOCK
            zstd = zstandard.ZstdCompressor(level=1)
            data = [zstd.compress(x.astype("<u4").tobytes()) for x in count.reshape(n, _BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.nulls(n, ids), pa.array(np.arange(n)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(data, pa.binary())], names)

    return docs.mapInArrow(run, f"kind int, doc_id {kind}, n long, hi long, lo long, data binary")


def _sketch(counts: DataFrame) -> np.ndarray:
    """By counter, how many documents have a shingle there, above what chance fills a counter with. COUNTERS numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        unzip, zstd = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for b in batches:
            for k, data in zip(b.column("n").to_pylist(), b.column("data").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(unzip.decompress(data), "<u4").astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([zstd.compress(x.tobytes()) for x in total.values()], pa.binary())], ["n", "data"])

    full, unzip = np.zeros(COUNTERS, np.float32), zstandard.ZstdDecompressor()
    for r in counts.select("n", "data").repartition("n").mapInArrow(run, "n long, data binary").collect():
        full[r["n"] * _BLOCK : (r["n"] + 1) * _BLOCK] = np.frombuffer(unzip.decompress(r["data"]), np.int64)
    # taking chance for frequency now and then does no harm: any order finds all links
    usual = np.float32(np.median(full))
    often = full > usual + np.float32(3 * math.sqrt(usual) + 1)
    full -= usual
    full *= often
    del often
    give_back()  # the driver's Python stands beside its heap
    return full


def _postings(docs: DataFrame, sent: Broadcast, salt: int, share: tuple[int, int]) -> DataFrame:
    """shingle, node, size (n << 32 | l) and place (its place << 8 | spread) of each prefix shingle; a task sends equal sets once.

    spread is 0, but for shingles that the sketch shows to be in very many documents: those needn't meet at first and are dealt out by it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, seen = Shingler(salt), set()
        for b in batches:
            columns = [], [], [], []
            for shingles in _in_order(b, s):
                key = fingerprint(shingles)[0]
                if len(shingles) and key not in seen:
                    seen.add(key)
                    l, chosen = prefix(shingles, sent.value, share)  # noqa: E741
                    spread = np.where(sent.value[_slot(chosen)] >= 4 * CROWD, 1 + key % 63, 0)
                    for c, x in zip(columns, (chosen.astype(np.int64), np.full(len(chosen), key), np.full(len(chosen), len(shingles) << 32 | l), np.arange(len(chosen)) << 8 | spread), strict=True):
                        c.append(x)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in columns], ["shingle", "node", "size", "place"])

    return docs.select("text").mapInArrow(run, "shingle long, node long, size long, place long")


def _meet(postings: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Rows of kind 0: pairs of nodes that share shingles which few nodes have, in how many (n), and the smaller l; of kind 1: shingle, node, n, l and at of the others."""
    arranged = postings.repartition("shingle", F.col("place").bitwiseAND(255)).sortWithinPartitions("shingle", "node")
    names = ["kind", "a", "b", "n", "l", "at"]

    def out(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *map(pa.array, columns)], names)

    def split(rows: np.ndarray) -> tuple[np.ndarray, ...]:
        return rows[:, 2] >> 32, rows[:, 2] & 0xFFFFFFFF, rows[:, 3] >> 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, flowing = np.zeros((0, 4), np.int64), None  # rows of the last shingle; a shingle that has shown to be in many nodes

        def whole(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            heads = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
            size = np.diff(np.r_[heads, len(rows)])
            later = (size > CROWD) | (rows[heads, 3] & 255 != 0)
            if flowing is not None:
                later |= rows[heads, 0] == flowing
            many = np.repeat(later, size)
            if many.any():
                yield out(1, rows[many, 0], rows[many, 1], *split(rows[many]))
            alone = np.repeat(size == 1, size)
            few, size, pairs = rows[~many & ~alone], size[~later & (size > 1)], []
            place = np.arange(len(few)) - np.repeat(np.cumsum(size) - size, size)
            for step in range(1, int(size.max(initial=1))):  # each row with the one so many places before
                y = few[at := np.flatnonzero(place >= step)]
                x = few[at - step]
                fits = within(*split(x), *split(y), share)
                if fits.any():
                    x, y = x[fits], y[fits]
                    pairs.append(np.stack([x[:, 1], y[:, 1], np.minimum(split(x)[1], split(y)[1])], 1))
            if pairs:
                found = np.concatenate(pairs)
                found = found[np.lexsort((found[:, 1], found[:, 0]))]
                heads = np.flatnonzero(np.r_[True, (found[1:, :2] != found[:-1, :2]).any(axis=1)])
                yield out(0, found[heads, 0], found[heads, 1], np.diff(np.r_[heads, len(found)]), found[heads, 2], np.zeros(len(heads), np.int64))

        for b in batches:
            rows = np.concatenate([held, np.stack([b.column(c).to_numpy() for c in ("shingle", "node", "size", "place")], 1)])
            if not len(rows):
                continue
            rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]]
            last = int(np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])[-1])
            if last:
                yield from whole(rows[:last])
            held = rows[last:]
            if len(held) > CROWD or held[0, 0] == flowing:
                flowing = int(held[0, 0])
                yield from whole(held)
                held = held[:0]
        if len(held):
            yield from whole(held)

    return arranged.mapInArrow(run, "kind int, a long, b long, n long, l long, at long")


def _sets(docs: DataFrame, nodes: DataFrame, salt: int) -> DataFrame:
    """node and its shingles, of the nodes named: a bitmap of fixed size drops most others before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, seen = Shingler(salt), set()
        for b in batches:
            found = {}
            for shingles in _in_order(b, s):
                key = fingerprint(shingles)[0]
                if len(shingles) and key not in seen:
                    seen.add(key)
                    found[key] = shingles.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], ["node", "shingles"])

    made = docs.select("text").mapInArrow(run, "node long, shingles array<long>")
    hits = with_hit(made, bitmap_of(nodes, "node"), "node").where("_hit").drop("_hit")
    return hits.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def linked(pairs: DataFrame, sets: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """The pairs(a, b) whose sets(node, shingles) reach the share."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b").withColumn("_n", F.size(F.array_intersect("_sa", "_sb")))
    return both.where(share[1] * F.col("_n") >= share[0] * (F.size("_sa") + F.size("_sb") - F.col("_n"))).select("a", "b")


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node and component (its smallest node) of every node of links(a, b).

    known: components of other links, which these are added to. Only components that these links join are gone through, as one node each.

    Each round a node takes the smallest label among its neighbours' and then that label's own, so labels run ahead of the
    links they go along. Every round is a written table, so no lineage grows; nothing comes to the driver but whether a label moved.
    """
    if known is not None:
        of = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
        ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
        links = ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    once = links.where("a != b")
    edges = save(once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "join-edges")
    if known is not None and edges.isEmpty():
        return known
    labels = _rounds(edges)
    if known is None:
        return labels
    joined = known.join(labels.select(F.col("node").alias("component"), F.col("component").alias("_new")), "component", "left")
    joined = joined.select("node", F.coalesce("_new", "component").alias("component"))
    return save(joined.unionByName(labels.join(known.select("node"), "node", "left_anti").select("node", "component")), "join-labels")


def _rounds(edges: DataFrame) -> DataFrame:
    """node and component of edges(a, b), each of which stands there both ways."""
    labels = save(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"), "join-labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("_near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").withColumn("_new", F.least("component", "_near"))
        ahead = labels.select(F.col("node").alias("_new"), F.col("component").alias("_far"))
        moved = step.join(ahead, "_new").select("node", F.least("_new", "_far").alias("component"), (F.least("_new", "_far") != F.col("component")).alias("moved"))
        moved = save(moved, "join-labels")
        labels = moved.select("node", "component")
        driver_gives_back(edges.sparkSession)
        if moved.where("moved").isEmpty():
            return labels


def _near_labels(links: DataFrame) -> DataFrame:
    """node and the smallest node within three links of it: enough for nodes around pivots, without going on to the end."""
    ways = save(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "join-ways")
    near = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component"))
    for _ in range(2):
        of = near.select(F.col("a").alias("b"), F.col("component").alias("_l"))
        near = ways.join(of, "b").groupBy("a").agg(F.min("_l").alias("component"))
    return save(near.withColumnRenamed("a", "node"), "join-labels")


def _labelled(crowd: DataFrame, labels: DataFrame) -> DataFrame:
    return crowd.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def possible(pairs: DataFrame, histograms: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs(a, b) that histograms(node, n, data) don't rule out: the sum of the smaller counts is no less than any overlap."""
    num, den = share
    at = lambda c: histograms.select(F.col("node").alias(c), F.col("n").alias(f"_n{c}"), F.col("data").alias(f"_d{c}"))
    both = pairs.join(at("a"), "a").join(at("b"), "b").select("a", "b", "_na", "_nb", "_da", "_db")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = np.array([x is not None and y is not None for x, y in zip(b.column("_da").to_pylist(), b.column("_db").to_pylist(), strict=True)], bool)
            keep, n = ~known, b.column("_na").to_numpy() + b.column("_nb").to_numpy()
            if known.any():
                held = [np.frombuffer(b"".join(x.as_py() for x in b.column(c).filter(pa.array(known))), np.uint8).reshape(-1, BUCKETS) for c in ("_da", "_db")]
                most = np.minimum(*held).sum(axis=1, dtype=np.int64)
                keep[known] = (den + num) * most >= num * n[known]
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def _across(now: DataFrame, share: tuple[int, int]) -> DataFrame:
    """a and b, once per shingle, of nodes of different components which it counts for with l = 1.

    Nodes of a shingle are dealt into blocks, and each pair of blocks is a group of its own, so none grows with the shingle's nodes. Pairs
    are compared as arrays and only those that the shingle counts for become rows.
    """
    num, den = share
    now = now.where(F.col("at") <= F.col("n") - F.expr(f"({num} * n + {den - 1}) div {den}")).select("shingle", "node", "component", "n", "at")
    blocks = now.groupBy("shingle").agg(F.ceil(F.count("*") / BLOCK_NODES).alias("_blocks"), F.min("component").alias("_x"), F.max("component").alias("_y")).where("_x != _y").select("shingle", "_blocks")
    rows = now.join(save(blocks, "join-blocks"), "shingle").withColumn("_i", F.pmod(F.xxhash64("node"), F.col("_blocks")))
    rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).withColumn("_lo", F.least("_i", "_j")).withColumn("_hi", F.greatest("_i", "_j"))

    def compare(g):
        import pandas as pd

        node, of, n, at, block = (g[c].to_numpy() for c in ("node", "component", "n", "at", "_i"))
        lo, hi = g["_lo"].iloc[0], g["_hi"].iloc[0]
        x, y = np.triu_indices(len(node), 1) if lo == hi else (v.ravel() for v in np.meshgrid(np.flatnonzero(block == lo), np.flatnonzero(block == hi)))
        apart = of[x] != of[y]
        x, y = x[apart], y[apart]
        keep = within(n[x], one := np.int64(1), at[x], n[y], one, at[y], share)
        x, y = x[keep], y[keep]
        return pd.DataFrame({"a": np.minimum(node[x], node[y]), "b": np.maximum(node[x], node[y])})

    return rows.select("shingle", "_lo", "_hi", "_i", "node", "component", "n", "at").groupBy("shingle", "_lo", "_hi").applyInPandas(compare, "a long, b long")


def _by_pivots(rows: DataFrame, number: int, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links between rows(shingle, node, n, at), some found by pivots: each shingle's nodes meet 1, 2, 4 ... of them, round by round.

    Rounds end when the pairs that are left across components are few for the rows, when a round links nothing, or when all nodes
    have been pivots. That bounds the work only: what is left is compared afterwards.
    """
    none = rows.where("false").select(F.col("node").alias("a"), F.col("node").alias("b"))
    links, labels, turn = none, none.toDF("node", "component"), 0
    weights, used = save(rows.groupBy("node").agg(F.count("*").alias("_w")), "join-weights"), rows.where("false").select("node")
    while True:
        now = save(_labelled(rows, labels), "join-now")
        sizes = now.groupBy("shingle", "component").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc"))
        crossing = sizes.agg(F.sum((F.col("c") * F.col("c") - F.col("cc")) / 2)).first()[0] or 0
        if crossing <= 2 * number:
            return links
        # the node with the most such shingles in its prefix is likely the one that the others are copies of
        able = now.join(weights, "node").join(used, "node", "left_anti").withColumn("_slot", F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(1 << turn)))
        pivots = able.groupBy("shingle", "_slot").agg(F.max(F.struct("_w", "node", "n", "at", "component")).alias("p"))
        pivots = save(pivots.select("shingle", *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("node", "n", "at", "component")]), "join-pivots")
        used = used.unionByName(pivots.select(F.col("p_node").alias("node"))).distinct()
        tests = now.join(pivots, "shingle").where((F.col("p_component") != F.col("component")) & _within("", "p_", share))
        new = save(linked(tests.select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).distinct(), sets, share), "join-links")
        if new.isEmpty():
            return links
        links, turn = links.unionByName(new), turn + 1
        labels = _near_labels(links)
        driver_gives_back(rows.sparkSession)


def _node_components(docs: DataFrame, prints: DataFrame, extra: np.ndarray, salt: int, share: tuple[int, int]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(extra)
    del extra
    met = save(_meet(_postings(docs, sent, salt, share), share), "join-met", by=["kind"])
    sent.destroy()  # the table is written, nothing asks for it again
    # what few nodes share counts against the pair's l; a pair that has l or more there is a candidate
    light = save(met.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("shared"), F.min("l").alias("l")), "join-light")
    crowd = save(met.where("kind = 1").select(F.col("a").alias("shingle"), F.col("b").alias("node"), "n", "at").distinct(), "join-crowd")
    rows = crowd.count()
    # a linked pair with fewer there shares some that many nodes share, so both nodes have such ones, and its first shared shingle is in
    # either lot: the pair is then a candidate by that one shingle
    crowded = save(crowd.select("node").distinct(), "join-crowded")
    of = lambda c: crowded.select(F.col("node").alias(c), F.lit(True).alias(f"_{c}"))
    hopeful = light.where("shared >= l")
    if rows:
        hopeful = light.join(of("a"), "a", "left").join(of("b"), "b", "left").where("shared >= l or (_a and _b)").select(*light.columns)
    names = light.select(F.col("a").alias("node")).unionByName(light.select(F.col("b").alias("node"))).distinct()
    histograms = with_hit(prints.select("node", "n", "data"), bitmap_of(names, "node"), "node").where("_hit").drop("_hit").dropDuplicates(["node"])
    open_ = save(possible(hopeful, histograms, share).join(light, ["a", "b"]), "join-possible")
    nodes = open_.select(F.col("a").alias("node")).unionByName(open_.select(F.col("b").alias("node"))).unionByName(crowded).distinct()
    sets = save(_sets(docs, nodes, salt), "join-sets")
    labels, pairs = open_.where("false").select(F.col("a").alias("node"), F.col("b").alias("component")), open_
    if rows:
        labels = components(_by_pivots(crowd, rows, sets, share))
        across = _across(save(_labelled(crowd, labels), "join-now"), share).groupBy("a", "b").agg(F.count("*").alias("shared"))
        pairs = open_.select("a", "b", "shared").unionByName(across).groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    pairs = save(pairs.select("a", "b", "shared"), "join-pairs")
    # first each node with the one it shares most with, then what is still apart
    best = pairs.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("_x")).select(F.col("_x.a").alias("a"), "b")
    for tests in (best, pairs):
        at = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
        apart = tests.join(at("a"), "a", "left").join(at("b"), "b", "left").where("coalesce(_a, a) != coalesce(_b, b)").select("a", "b")
        labels = components(save(linked(apart, sets, share), "join-links"), labels)
    return labels


def ngram_components(docs: DataFrame, *, share: tuple[int, int] = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that links reach, its own included) per row of docs.

    Whole texts are read; null counts as empty. A text without words has no shingle, links with nothing and is its own component; one
    of fewer than five words has its word sequence as only shingle. Rows that repeat an id are documents of their own;
    the null id is never the smallest, so component_id is null only where no member has an id. Links are exact but for 64-bit
    hashes of shingles. Other columns are ignored. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    driver_gives_back(docs.sparkSession)
    salt = 0
    while True:  # a salt under which no two different sets share a node
        both = save(_fingerprints(src, salt), "join-prints", by=["kind"])
        found = both.where("kind = 0").select("doc_id", "n", F.col("hi").alias("node"), "lo", "data")
        if found.where("n > 0").groupBy("node").agg(F.min("lo").alias("x"), F.max("lo").alias("y")).where("x != y").isEmpty():
            break
        salt += 1
    labels = _node_components(src, found, _sketch(both.where("kind = 1")), salt, share)
    placed = found.where("n > 0").join(labels, "node", "left").withColumn("_c", F.coalesce("component", "node")).select("doc_id", "n", "_c")
    placed = save(placed, "join-placed")
    # two tables, so that Spark can split the many rows of one component where they meet its label
    least = save(placed.groupBy("_c").agg(F.min("doc_id").alias("component_id")), "join-least")
    full = placed.join(least, "_c").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(found.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without those that have a linked document of smaller id: one row of each component stays, all columns kept.

    A row with a null id stays. Rows that repeat an id stay or go together.
    """
    gone = ngram_components(docs, **options).where("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = save(gone, "join-gone")
    # only rows that a bitmap of fixed size can't clear are moved
    rows = with_hit(docs.select(F.struct("*").alias("_row"), F.col(options.get("id_col", "doc_id")).alias("_gone")), bitmap_of(gone, "_gone"), "_gone")
    kept = rows.where(~F.col("_hit")).select("_row").unionByName(rows.where("_hit").join(gone, "_gone", "left_anti").select("_row"))
    return kept.select("_row.*")
