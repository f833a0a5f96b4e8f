"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole document, max-pooled, one probability.

Bytes are embedded, learned filters slide over them, and a chunk keeps each filter's largest answer. A document's probability is a
logistic function of the mean and the largest of its chunks' answers, however many chunks it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches
from .language_id import held_out
from .words import slices

#: Filters, the bytes one sees, and the numbers a byte is embedded in.
FILTERS, WIDTH, DEPTH = 16, 5, 8
#: Bytes in a unit; units in a chunk, and units from one chunk to the next: chunks of 256 bytes share 32.
UNIT, CHUNK, APART = 32, 8, 7
#: Bytes scored at once.
TOGETHER = 1 << 20
#: The network is fitted on so many documents of each label at most, the rows of smallest hashed id, and on so many bytes of each, evenly spread pieces of a longer one.
PER_LABEL, FIT_BYTES, ROUNDS, BATCH, RATE = 1000, 2048, 20, 64, 0.02


@dataclass
class Network:
    embed: np.ndarray  # byte, DEPTH
    kernel: np.ndarray  # place before the last byte, DEPTH, filter
    bias: np.ndarray
    out: np.ndarray  # weights of mean and largest answers, and one for no text in particular

    def tables(self) -> np.ndarray:
        """What each byte at each place adds to each filter's answer."""
        return (self.embed @ self.kernel).astype(np.float32)


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, each followed by WIDTH - 1 zeros at least up to a whole number of units, and their numbers of units.

    Filters look backwards, so at a text's first bytes they see zeros, never another text.
    """
    units = np.array([(len(t) + WIDTH - 1 + UNIT - 1) // UNIT for t in texts], np.int64)
    return np.frombuffer(b"".join(t.ljust(u * UNIT, b"\0") for t, u in zip(texts, units.tolist(), strict=True)), np.uint8), units


def _answers(code: np.ndarray, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """By place and filter."""
    z = table[0][code]
    z += bias.astype(np.float32)
    before = np.zeros(len(code), np.uint8)
    for j in range(1, WIDTH):
        before[:j], before[j:] = 0, code[: len(code) - j]
        z += table[j][before]
    return z


def _chunks(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units of each chunk (a short one repeats its last), and the number of chunks of each text; every unit is in a chunk."""
    count = np.maximum(1, -(-(units - CHUNK) // APART) + 1)
    begin = np.cumsum(units) - units
    own = np.repeat(np.arange(len(units)), count)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    at = (begin[own] + nth * APART)[:, None] + np.arange(CHUNK)
    return np.minimum(at, (begin + units - 1)[own][:, None]), count


def scores(net: Network, texts: list[bytes]) -> np.ndarray:
    """The probability of label 1 of each text; its own bytes alone decide."""
    if not texts:
        return np.zeros(0)
    table = net.tables()
    code, units = _padded(texts)
    best = np.empty((len(code) // UNIT, FILTERS), np.float32)
    step = TOGETHER // 16 // UNIT * UNIT
    for a in range(0, len(code), step):
        lead = min(a, UNIT)
        z = _answers(code[a - lead : a + step], table, net.bias)[lead:]
        best[a // UNIT : (a + step) // UNIT] = z.reshape(-1, UNIT, FILTERS).max(axis=1)
    at, count = _chunks(units)
    v = np.maximum(best[at[:, 0]], 0)
    for j in range(1, CHUNK):
        np.maximum(v, best[at[:, j]], out=v)
    begin = np.cumsum(count) - count
    mean, most = np.add.reduceat(v, begin, axis=0, dtype=np.float64) / count[:, None], np.maximum.reduceat(v, begin, axis=0)
    logit = (np.concatenate([mean, most], 1) * net.out[:-1]).sum(axis=1) + net.out[-1]  # a text's own row only, so neighbours can't change its last digit
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _cropped(text: bytes, rng: np.random.Generator) -> bytes:
    """One text in two gives a short piece only, so that a short text isn't taken for one in which little goes on."""
    if rng.random() > 1 / 2:
        return text
    size = int(rng.integers(4, 300))
    at = int(rng.integers(0, max(1, len(text) - size + 1)))
    return text[at : at + size]


def fit(texts: list[bytes], labels: list[int], *, prior: float = 0.5, seed: int = 12) -> Network:
    """Adam on the logistic loss, label 1 with the weight prior of the whole; the largest answers pass the gradient to the bytes they came from."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 0.5, (256, DEPTH)), rng.normal(0, 0.4, (WIDTH, DEPTH, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS + 1)]
    m, s, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    y_all = np.array(labels, np.float64)
    share = np.where(y_all == 1, prior / max(1, (y_all == 1).sum()), (1 - prior) / max(1, (y_all == 0).sum())) * len(y_all)
    for _ in range(ROUNDS):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            net = Network(*p)
            code, units = _padded([_cropped(texts[i], rng) for i in some])
            z = _answers(code, net.tables(), net.bias).reshape(-1, UNIT, FILTERS)
            where = z.argmax(axis=1)
            best = np.take_along_axis(z, where[:, None], axis=1)[:, 0]
            at, count = _chunks(units)
            unit = best[at].argmax(axis=1)  # chunk, filter
            row = np.take_along_axis(at, unit, axis=1)
            v = np.maximum(best[row, np.arange(FILTERS)], 0)
            place = row * UNIT + where[row, np.arange(FILTERS)]
            begin = np.cumsum(count) - count
            own = np.repeat(np.arange(len(some)), count)
            mean, most = np.add.reduceat(v, begin, axis=0) / count[:, None], np.maximum.reduceat(v, begin, axis=0)
            x = np.concatenate([mean, most, np.ones((len(some), 1))], 1).astype(np.float64)
            g = (1 / (1 + np.exp(-np.clip(x @ p[3], -30, 30))) - y_all[some]) * share[some] / len(some)
            first = (v == most[own]) & (v > 0)
            dv = (g[:, None] * p[3][:FILTERS] / count[:, None])[own] + (g[:, None] * p[3][FILTERS:-1])[own] * first / np.maximum(1, np.add.reduceat(first, begin, axis=0, dtype=np.float64))[own]
            dv *= v > 0
            grad = [np.zeros_like(q) for q in p]
            grad[2], grad[3] = dv.sum(axis=0), g @ x
            for j in range(WIDTH):
                byte = np.where(place >= j, code[np.maximum(place - j, 0)], 0)
                for f in range(FILTERS):
                    grad[1][j, :, f] += dv[:, f] @ p[0][byte[:, f]]
                by_byte = np.zeros((256, FILTERS))
                np.add.at(by_byte, (byte, np.arange(FILTERS)), dv)
                grad[0] += by_byte @ p[1][j].T
            step += 1
            for i, d in enumerate(grad):
                d += 1e-4 * p[i]
                m[i] = 0.9 * m[i] + 0.1 * d
                s[i] = 0.999 * s[i] + 0.001 * d * d
                p[i] = p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
    return Network(*p)


def spread(text: bytes, most: int = FIT_BYTES) -> bytes:
    """The text, or evenly spread pieces of a chunk's size that fill most bytes."""
    if len(text) <= most:
        return text
    size = UNIT * CHUNK
    n = most // size
    return b"".join(text[k : k + size] for k in ((len(text) - size) * i // max(1, n - 1) for i in range(n)))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL) -> Network | None:
    """A network from labelled rows whose id isn't held out; None where there is none of one of the labels 0 and 1.

    Rows with a null id, text or label teach nothing; an id that is labelled both ways counts with both. The sample's size is bounded,
    so its ids are broadcast, and FIT_BYTES of each text come to the driver.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id"))).distinct()
    place = F.pmod(F.xxhash64(F.lit("quality"), "_id"), F.lit(1 << 32))
    sizes = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    if len(sizes) < 2:
        return None
    picked = None
    for y, n in sorted(sizes.items()):
        near = known.where((F.col("_label") == y) & (place < min(1 << 32, 2 * (per_label << 32) // n + 1)))
        near = near.orderBy(place, "_id").limit(per_label)
        picked = near if picked is None else picked.unionByName(near)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), pa.array([spread(t) for t in batch.column("text").to_pylist()], pa.binary())], ["_id", "_label", "text"])

    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").cast("binary").alias("text")).where(F.col("text").isNotNull())
    kind = dict(own.dtypes)["_id"]
    # an id may come in many rows: of each id and label, one
    rows = own.join(F.broadcast(picked), "_id").select("_id", "_label", "text").mapInArrow(cut, f"_id {kind}, _label int, text binary").groupBy("_id", "_label").agg(F.max("text").alias("text")).orderBy("_id", "_label").collect()
    if len({r["_label"] for r in rows}) < 2:
        return None
    net = fit([bytes(r["text"]) for r in rows], [r["_label"] for r in rows], prior=sizes[1] / (sizes[0] + sizes[1]))
    give_back()
    return net


def judge(docs: DataFrame, net: Network | None, *, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted, from the whole text alone; columns of these names are replaced.

    A null text counts as empty, and an empty one is scored like any other: what the network answers to zeros. Without a network every
    score is 0.5. The network is of fixed size and goes to every task; a task holds what filters answer to 65,536 bytes at once.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def scored(text):
        import pandas as pd

        if shared.value is None:
            return pd.Series([0.5] * len(text))
        column, out = pa.array(text, pa.binary()), []
        for a, b in slices(column, TOGETHER):
            out += scores(shared.value, [t or b"" for t in column[a:b].to_pylist()]).tolist()
        return pd.Series(out, dtype="float64")

    return docs.withColumn("score", scored(F.col(text_col).cast("string").cast("binary"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
