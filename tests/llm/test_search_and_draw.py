"""Ranked search, importance resampling and the quality network against plain versions of the same rules."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from trailmark.llm import importance, quality, ranked_search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_ranks(docs, items, most=10):
    found = [(d, Counter(plain_terms(t))) for d, t in docs]
    found = [(d, c, sum(c.values())) for d, c in found if c]
    n_docs, n_terms = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        asked = Counter(plain_terms(text))
        scored = []
        for d, c, n in found:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, k in asked.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:most])]
    return sorted(out, key=repr)


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["Thé", "ha", "x1", "word", "Über", "z", "ñandú", "QUICK", "fox", *[f"w{i}" for i in range(60)]]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(40)]  # equal scores
    docs += [(2 * n, None), (2 * n + 1, ""), (2 * n + 2, " ,;\x00- "), (2 * n + 3, "fox " * 30000), (None, "quick brown fox"), (5, "fox fox"), (5, "fox fox")]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("shard_docs", "block"), [(16, 30), (4096, 50_000)])
def test_ranked_search_equals_all_scores(spark, shard_docs, block):
    docs = corpus(300, 7)
    items = [(1, docs[3][1]), (1, docs[3][1]), (2, "fox fox, QUICK-fox?"), (2, "other text w1"), (3, None), (4, "unknownword"), (None, "w3 w4"), (5, docs[0][1]), (6, " ".join(f"w{i}" for i in range(60)))]
    d = spark.createDataFrame([(a, b, 9) for a, b in docs], "doc_id long, text string, score int").repartition(5)
    index = ranked_search.build_index(d, shard_docs=shard_docs)
    assert shard_docs > 1000 or index.shards.count() > 10
    got = ranked_search.search(index, spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, rank int"), block=block).collect()
    assert sorted(map(tuple, got), key=repr) == plain_ranks(docs, items)


def test_ranked_search_on_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.rank_documents(docs, items).count() == 0
    assert ranked_search.rank_documents(items.toDF("doc_id", "text"), items.limit(0)).count() == 0
    assert ranked_search.rank_documents(items.toDF("doc_id", "text"), items).columns == ["item_id", "rank", "doc_id", "score"]


def test_order_gathers_documents_of_a_kind():
    rng = np.random.default_rng(1)
    docs = [np.unique(rng.integers(0, 400, 60) + 400 * (i % 8)).astype(np.int32) for i in range(800)]
    tree = ranked_search.bisect(docs)
    leaf, _ = tree.place(np.concatenate(docs), np.array(list(map(len, docs))))
    shares = [Counter((leaf[np.arange(len(docs)) % 8 == k] >> 3).tolist()).most_common(1)[0][1] for k in range(8)]
    assert sum(shares) / len(docs) > 0.9  # eight kinds, eight nodes of the third level
    assert np.bincount(leaf >> 3, minlength=8).max() < 200


def plain_draw(docs, target, max_n, buckets=10_000):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    own, asked = [features(t) for _, t in docs], [features(t)[1] for t in target]
    s, t = Counter(b for _, f in own for b in f), Counter(b for f in asked for b in f)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    out = []
    for (d, _), (n, f) in zip(docs, own, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is not None, x[0]))
    rank = {id(x): i + 1 for i, x in enumerate(able[: len(able) // 10])}
    return sorted(((x[0], *x[2:], rank.get(id(x))) for x in out), key=repr)


@pytest.mark.parametrize("max_n", [1, 3])
def test_resampling_equals_plain_counts(spark, max_n):
    docs = corpus(300, 11)
    target = ["quick fox w1 w2 w3 w4", "Thé ha X1 quick fox", None, "", "only-here twice twice"]
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, weight int").repartition(5)
    got = importance.resample(d, spark.createDataFrame([(t,) for t in target], "text string"), max_n=max_n)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_draw(docs, target, max_n)


def test_resampling_on_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert importance.resample(none, one.select("text")).count() == 0
    (row,) = importance.resample(one, none.select("text")).collect()
    assert (row.doc_id, row.n_features, row["rank"]) == (1, 2, None)


def plain_score(net, text):
    """Every filter at every place, one at a time."""
    code = [0] * (quality.WIDTH - 1) + list(text)
    units = -(-(len(text) + quality.WIDTH - 1) // quality.UNIT)
    code += [0] * (units * quality.UNIT - len(text))
    answer = [net.bias + sum(net.embed[code[p + quality.WIDTH - 1 - j]] @ net.kernel[j] for j in range(quality.WIDTH)) for p in range(units * quality.UNIT)]
    chunks, at = [], 0
    while True:
        inside = answer[at * quality.UNIT : (at + quality.CHUNK) * quality.UNIT]
        chunks.append(np.maximum(np.max(inside, axis=0), 0))
        if at + quality.CHUNK >= units:
            break
        at += quality.APART
    x = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0), [1]])
    return 1 / (1 + math.exp(-x @ net.out))


def test_quality_scores_equal_plain_convolution():
    rng = np.random.default_rng(3)
    net = quality.Network(rng.normal(0, 0.5, (256, quality.DEPTH)), rng.normal(0, 0.3, (quality.WIDTH, quality.DEPTH, quality.FILTERS)), rng.normal(0, 0.3, quality.FILTERS), rng.normal(0, 0.3, 2 * quality.FILTERS + 1))
    texts = [rng.integers(0, 256, n, np.uint8).tobytes() for n in (0, 1, 27, 28, 29, 252, 253, 476, 477, 1500)]
    assert quality.scores(net, texts) == pytest.approx([plain_score(net, t) for t in texts], abs=1e-5)
    assert quality.scores(net, texts[::-1])[::-1].tolist() == quality.scores(net, texts).tolist()  # neighbours don't matter
    long = rng.integers(0, 256, 300_000, np.uint8).tobytes()
    tail = bytearray(long)
    tail[-40:] = bytes(40)
    assert quality.scores(net, [long])[0] != quality.scores(net, [bytes(tail)])[0]


def test_quality_learns_and_keeps_clean_texts(spark):
    rng = random.Random(5)
    syllables = ["an", "the", "ti", "ou", "re", "st", "in", "ed"]

    def prose():
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(5, 300))).capitalize() + "."

    texts = [prose() if i % 3 else re.sub(r"(\w) ", r"\1%%% ", prose()) for i in range(900)]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(None, "x", 1), (7, None, 1), (900, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted int").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(900)] + [(None, 1), (3, None), (5, 7), (10_000, 1)], "doc_id long, quality int")
    out = quality.judge(docs, quality.train(docs, labels)).collect()
    assert len(out) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    unseen = [r for r in out if r.doc_id is not None and r.doc_id < 900 and r.text and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.predicted == (r.doc_id % 3 > 0) for r in unseen) / len(unseen) > 0.95
    assert quality.train(docs, labels.where("quality = 1")) is None
    assert {r.score for r in quality.judge(docs, None).collect()} == {0.5}
    assert quality.judge(docs.limit(0), None).count() == 0
