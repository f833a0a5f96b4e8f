"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, follow-the-regularised-leader, temperature."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches

#: Character n-grams of these lengths, in so many hashed buckets.
GRAMS, BUCKETS = (1, 2, 3), 1 << 16
#: The classifier is fitted on about so many documents a language, and at most so many in all; document frequencies cover all learnable rows.
PER_LANGUAGE, AT_MOST = 400, 6000
#: Texts of about so many characters are scored together.
TOGETHER = 1_000_000
#: What is given to a text without letters.
UNDETERMINED = "und"
#: TF-IDF vectors have this sum.
SCALE = 64.0


def held_out(doc_id: Column) -> Column:
    """True where the crc32 of the id as text leaves 1 when divided by 3; never null."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def grams(texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Lengths of the lower-cased texts; for each n the bucket at each place of all texts together, and the place each text begins at."""
    low = [t.lower() for t in texts]
    size = np.fromiter(map(len, low), np.int64, len(low))
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin, out = np.cumsum(size) - size, []
    h = np.zeros(len(code), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(code) - n + 1] * np.uint32(0x01000193) + code[n - 1 :] + np.uint32(n)
        if n in GRAMS:
            out.append((((h * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32), begin))
    return size, out


def _sums(values: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of values over [begin, begin + count) each; a sum depends on its own values only."""
    out = np.zeros((len(begin), *values.shape[1:]), np.float64)
    some = np.flatnonzero(count > 0)
    if some.size:
        edges = np.stack([begin[some], begin[some] + count[some]], 1).ravel()
        last = edges[-1] == len(values)
        out[some] = np.add.reduceat(values, edges[:-1] if last else edges, axis=0, dtype=np.float64)[::2]
    return out


def pieces_of(texts: list[str], most: int = TOGETHER) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= most):
            size += len(texts[b])
            b += 1
        yield a, b
        a = b


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs."""
    return np.unique(np.concatenate([h for h, _ in grams([text])[1]]), return_counts=True)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # by bucket and language
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        table = np.concatenate([self.weights * self.idf[:, None], self.idf[:, None]], 1).astype(np.float32)
        out = []
        for a, b in pieces_of(texts):
            size, found = grams(texts[a:b])
            total = sum(_sums(table[h], begin, np.maximum(size - n + 1, 0)) for n, (h, begin) in zip(GRAMS, found, strict=True))
            out.append(SCALE * total[:, :-1] / np.maximum(total[:, -1:], 1e-12) + self.bias)
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        some = [t or "" for t in texts]
        z = self.logits(some) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)  # of equal probabilities, the language that comes first
        lettered = [any(map(str.isalpha, t)) for t in some]
        return [self.languages[i] if y else UNDETERMINED for i, y in zip(best.tolist(), lettered, strict=True)], [float(p[d, i]) if y else 0.0 for d, (i, y) in enumerate(zip(best.tolist(), lettered, strict=True))]


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], idf: np.ndarray, *, rate: float = 0.5, l1: float = 0.02, l2: float = 0.05, rounds: int = 4, seed: int = 5) -> Model:
    """FTRL-proximal with elastic net on rows of (bucket, count, language), then a temperature from every fifth row, which isn't trained on."""
    k, rng = len(languages), np.random.default_rng(seed)
    data = []
    for at, n, y in rows:
        x = n * idf[at]
        data.append((np.append(at, BUCKETS), np.append(SCALE * x / max(x.sum(), 1e-12), 1.0), y))
    test, train = data[::5] if len(data) >= 10 else data, [d for i, d in enumerate(data) if i % 5 or len(data) < 10]
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weight(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((1.0 + np.sqrt(n[at])) / rate + l2))

    def logit(at: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        s = x @ w
        return s - s.max()

    for _ in range(rounds):
        for i in rng.permutation(len(train)).tolist():
            at, x, y = train[i]
            w = weight(at)
            p = np.exp(logit(at, x, w))
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / rate
            z[at] += g - sigma * w
            n[at] += g * g
    w = weight(np.arange(BUCKETS + 1))
    scores = [(logit(at, x, w[at]), y) for at, x, y in test]

    def loss(t: float) -> float:
        return sum(math.log(np.exp(s / t).sum()) - s[y] / t for s, y in scores)

    temperature = min((2.0 ** (i / 8) for i in range(-24, 41)), key=loss) if scores else 1.0
    return Model(languages, idf, w[:-1], w[-1], temperature)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, at_most: int = AT_MOST) -> Model | None:
    """A model from the rows whose language isn't null and whose id isn't held out; None where there is no such row.

    Document frequencies come from all these rows, whole texts. The classifier sees a bounded sample, rows of smallest hashed id,
    about per_language of each language and at_most in all; only their counted buckets come to the driver.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 32)).alias("place"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in pieces_of(texts, TOGETHER // 4):
                size, found = grams(texts[a:b])
                for c in range(0, b - a, 32):  # a bit for each of 32 texts
                    seen = np.zeros(BUCKETS, np.uint32)
                    for j in range(c, min(c + 32, b - a)):
                        mark = np.uint32(1 << (j - c))
                        for n, (h, begin) in zip(GRAMS, found, strict=True):
                            own = h[begin[j] : begin[j] + max(0, size[j] - n + 1)]
                            seen[own] |= mark
                    df += np.bitwise_count(seen)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["bucket", "n"])

    idf = np.zeros(BUCKETS)
    for r in rows.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        idf[r["bucket"]] = r["n"]
    idf = np.log((1.0 + sum(sizes.values())) / (1.0 + idf)) + 1.0
    each = min(per_language, max(1, at_most // len(languages)))
    share = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1 << 32, (each << 32) // sizes[k] + 1))]), F.col("lang"))
    sample = rows.where(F.col("place") < share).orderBy("place", "lang", F.xxhash64("text")).limit(at_most)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [counts(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("place"), pa.array([a for a, _ in got], pa.list_(pa.int32())), pa.array([n for _, n in got], pa.list_(pa.int64()))], ["lang", "place", "at", "n"])

    table = sample.mapInArrow(counted, "lang string, place long, at array<int>, n array<long>").toArrow()
    place = {k: i for i, k in enumerate(languages)}
    rows_ = [(np.asarray(a.values), np.asarray(n.values), place[k]) for k, a, n in zip(table["lang"].to_pylist(), table["at"].combine_chunks() if table.num_rows else [], table["n"].combine_chunks() if table.num_rows else [], strict=True)]
    model = fit(rows_, languages, idf)
    del table, rows_
    give_back()  # the driver's Python stands beside its heap
    return model


def identify(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (columns of these names are replaced), from the whole text alone.

    A null text or one without a letter (a character that str.isalpha() takes) gets "und" and score 0, and so does every text where
    there is no model. Of equal probabilities the language first in code point order wins. The model has a
    fixed number of buckets, so it is sent to every task. Rows keep their columns; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def judged(text):
        import pandas as pd

        if shared.value is None:
            return pd.DataFrame({"lang_pred": [UNDETERMINED] * len(text), "score": [0.0] * len(text)})
        lang, score = shared.value.predict(text.tolist())
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return docs.withColumn("_judged", judged(F.col(text_col))).withColumns({"lang_pred": F.col("_judged.lang_pred"), "score": F.col("_judged.score")}).drop("_judged")
