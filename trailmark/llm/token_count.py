"""Token counts without tokens: Viterbi over a unigram vocabulary that carries the best score and its piece count only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .common import give_back, small_batches

#: Units remembered by a task; beyond, it starts anew. A bound on memory, not on the work.
REMEMBERED = 600_000


class Counter:
    """Counts the pieces that the unigram model of the tokenizers library (byte fallback on) makes of marked(text).

    Its rules: scores add up in double precision from the left; at an end, of equal sums the piece that starts first wins; a
    character that no single-character piece covers may also be unknown, at the lowest score less 10, and becomes its UTF-8 bytes.
    """

    def __init__(self, path: str):
        v = pieces.load(path)
        self.find, self.scores = pieces.automaton(path), v.scores.tolist()
        self.unknown = float(v.scores.min()) - pieces.UNKNOWN_PENALTY
        # whole scores add up exactly, so units can be summed apart; otherwise the whole text is one unit
        self.apart = v.cuts and all(s == int(s) for s in self.scores)
        self.known: dict[str, int] = {}

    def walk(self, text: str) -> tuple[float, int]:
        n, scores, unknown = len(text), self.scores, self.unknown
        best, count, single = [0.0] + [float("-inf")] * n, [0] * (n + 1), bytearray(n)
        done = 1

        def close(upto: int) -> None:
            for e in range(done, upto):
                if not single[e - 1] and best[e - 1] + unknown > best[e]:
                    best[e], count[e] = best[e - 1] + unknown, count[e - 1] + len(text[e - 1].encode())

        for last, hit in self.find.iter(text):
            if last >= done:
                close(last + 1)
                done = last + 1
            length = hit & 63
            start = last + 1 - length
            score = best[start] + scores[hit >> 6]
            if score > best[last + 1]:
                best[last + 1], count[last + 1] = score, count[start] + 1
            if length == 1:
                single[start] = 1
        close(n + 1)
        return best[n], count[n]

    def packed(self, unit: str) -> int:
        """-score * 2**40 + count of a unit; such numbers add up."""
        score, count = self.walk(pieces.SPACE + unit)
        return (-int(score) << 40) + count

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        if not self.apart:
            score, count = self.walk(pieces.marked(text))
            return count, score
        parts, known = pieces.units(text), self.known
        try:
            total = sum(map(known.__getitem__, parts))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            total = 0
            for u in parts:
                v = known.get(u)
                if v is None:
                    v = self.packed(u)
                    if len(u) <= 32:
                        known[u] = v
                total += v
        return total & (1 << 40) - 1, -float(total >> 40)


def token_counts(docs: DataFrame, *, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and score (the best sum) per row of docs.

    Whole texts are counted. A null or empty text has no token and score 0. Ids may repeat or be null; other columns are ignored.
    No shuffle: a row's count needs the row and the vocabulary file only, which every executor has at the path model.
    """
    path = model or pieces.default_model()
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = dict(src.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Counter(path)  # what it remembers goes with the task
        for b in batches:
            got = [c.count(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "n_tokens", "score"])
        del c
        give_back()

    return src.mapInArrow(run, f"doc_id {kind}, n_tokens long, score double")
