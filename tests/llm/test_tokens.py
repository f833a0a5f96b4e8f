"""Token counts, sampled pieces and the token store against the libraries, enumeration and exact round trips."""

import math
import random
import zlib
from collections import Counter as Tally
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import piece_sampling as ps
from trailmark.llm import pieces
from trailmark.llm import token_count as tc
from trailmark.llm import token_store as ts

PATH = pieces.default_model()


def texts(seed, n):
    rng = random.Random(seed)
    parts = ["a", "the", " the", "  ", " ", "\n", "\t", " \n", "'s", "é", "漢", "😀", "1", "!", "<0x0A>", "▁", "of", " x", "\u00a0", "<|endoftext|>", "supercalifragilistic"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)] + ["", " ", "x" * 5000, "a b " * 2000]


def test_counts_are_the_librarys():
    from tokenizers import Tokenizer, models

    v = pieces.load(PATH)
    # the library would also find "<0x0A>" and the like in a text; those are no pieces of text here
    model = Tokenizer(models.Unigram(list(zip(v.texts, v.scores.tolist(), strict=True)), unk_id=0, byte_fallback=True))
    counter = tc.Counter(PATH)
    for t in texts(1, 1500):
        if "<0x" not in t and "<s>" not in t:
            assert counter.count(t)[0] == len(model.encode(pieces.marked(t)).ids), t
            assert counter.walk(pieces.marked(t))[1] == counter.count(t)[0] or not t


def test_token_counts_table(spark):
    rows = [(1, "the cat"), (1, "the cat"), (None, "x"), (3, None), (4, "")]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in tc.token_counts(docs).collect())
    n = {t: tc.Counter(PATH).walk(pieces.marked(t))[1] for t in ("the cat", "x")}
    assert got == [(0, n["x"]), (1, n["the cat"]), (1, n["the cat"]), (3, 0), (4, 0)]
    assert tc.token_counts(docs.where("false")).count() == 0


def segmentations(text, logp, ids):
    if not text:
        yield (), 0.0
    for n in range(1, len(text) + 1):
        if text[:n] in ids:
            for rest, w in segmentations(text[n:], logp, ids):
                yield (ids[text[:n]], *rest), w + logp[ids[text[:n]]]


def test_sampling_without_replacement():
    v, (logp, _) = pieces.load(PATH), pieces.rank_log_probs(PATH, 1.0)
    ids = {v.texts[i]: i for i in v.matched.tolist()}
    weights = dict(segmentations("▁cats", logp, ids))
    total = math.log(sum(map(math.exp, weights.values())))
    p = {s: math.exp(w - total) for s, w in weights.items()}
    n, first, estimate, before = 6000, Tally(), Tally(), None
    for _, number, out, log_prob, _, kept in ps.sample_texts(ps._keys(list(range(n)), 7), ["cats"] * n, 2, PATH, 1.0):
        s = tuple(out.tolist())
        assert log_prob == pytest.approx(math.log(p[s]))
        estimate[s] += math.exp(log_prob) / kept / n
        if number == 1:
            first[s] += 1 / n
            before = s
        else:
            assert s != before
    for s in sorted(p, key=p.get)[-3:]:
        assert first[s] == pytest.approx(p[s], abs=4 * math.sqrt(p[s] / n) + 1e-3)
        assert estimate[s] == pytest.approx(p[s], rel=0.15, abs=2e-3)


def test_all_segmentations_come_once():
    v, (logp, _) = pieces.load(PATH), pieces.rank_log_probs(PATH, 1.0)
    ids = {v.texts[i]: i for i in v.matched.tolist()}
    every = dict(segmentations("▁the▁a", logp, ids))
    got = list(ps.sample_texts(ps._keys([1], 1), ["the a"], len(every) + 5, PATH, 1.0))
    assert {tuple(g[2].tolist()) for g in got} == set(every) and len(got) == len(every)
    assert all(g[5] == 1.0 for g in got) and [g[4] for g in got] == sorted((g[4] for g in got), reverse=True)


def test_sampled_round_trip_and_batches(spark):
    some = texts(3, 120)
    alone = [[(g[1], g[2].tolist()) for g in ps.sample_texts(ps._keys([i], 1), [t], 3, PATH, 1.0)] for i, t in enumerate(some)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(some)] + [(0, some[0], 1), (900, None, 2)], "doc_id long, text string, sample int")
    got = ps.decode_ids(ps.sample_encode(docs.repartition(5), 3)).collect()
    for r in got:
        if r.doc_id < 900:
            assert r.decoded == some[r.doc_id].replace("▁", " ")
            assert (r["sample"], r.ids) in alone[r.doc_id]
    assert [(r["sample"], r.ids, r.inclusion) for r in got if r.doc_id == 900] == [(1, [], 1.0)]
    assert sum(r.doc_id == 0 for r in got) == 2 * len(alone[0])
    digest = ps.sample_encode(docs, 3, digest=True).collect()
    assert {(r.doc_id, r["sample"], r.ids_crc32) for r in digest} == {(r.doc_id, r["sample"], zlib.crc32(np.array(r.ids, "<i4").tobytes())) for r in got}
    assert ps.sample_encode(docs.where("false"), 2).count() == 0


def test_encoder_is_the_librarys():
    from tokenizers import Tokenizer

    e, plain = ts.Encoder(ts.default_tokenizer()), Tokenizer.from_file(ts.default_tokenizer())  # as it comes, nothing set
    some = texts(5, 4000) + ["<|endoftext|>", "a<|endoftext|> b", " <|endoftext|>\n<|endoftext|"]
    assert np.frombuffer(e.encode(["<|endoftext|>"])[0], e.type).tolist() == [plain.token_to_id("<|endoftext|>")]
    for got, want in zip(e.encode(some), plain.encode_batch(some, add_special_tokens=False), strict=True):
        assert np.frombuffer(got, e.type).tolist() == want.ids


def test_store(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(ts.default_tokenizer())
    rng = random.Random(8)
    long = " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(6000))
    rows = [(i * 3, t) for i, t in enumerate(texts(6, 60))] + [(500, long), (501, long), (502, "new start " + long), (503, None), (-4, "x"), (7, "same"), (7, "same"), (None, "n"), (-(2**63), "least"), (2**63 - 1, "most")]
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, keys string").repartition(6)
    store = ts.write_store(docs)
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = model.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((-99 if i is None else i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True))
        start += len(ids)
    assert sorted(tuple(r) for r in ts.read_documents(store).na.fill(-99, ["doc_id"]).collect()) == sorted(want)
    rebuilt = {r.start: r.ids for r in ts.reconstruct(store).collect()}
    assert all(zlib.crc32(np.array(rebuilt[s], "<u4").tobytes()) == c for _, s, _, c, _ in want)
    assert store.chunks.count() == store.chunks.select("key").distinct().count() < sum(len(r["keys"]) // 16 for r in store.recipes.collect())
    assert store.manifest.agg({"n_tokens": "sum"}).first()[0] == start
    assert ts.read_documents(ts.write_store(docs.where("false"))).count() == 0


def test_joined_crcs():
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 256, n, np.uint8).tobytes() for n in (0, 1, 5, 300, 70000, 0, 3)]
    crc, size = np.array([zlib.crc32(p) for p in parts]), np.array([len(p) for p in parts])
    assert ts.join_crcs(crc, size, np.array([3, 0, 4])).tolist() == [zlib.crc32(b"".join(parts[:3])), 0, zlib.crc32(b"".join(parts[3:]))]


def test_store_shows_changed_bytes(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 40) for i in range(20)], "doc_id long, text string")
    store = ts.write_store(docs)
    assert all(r.verified for r in ts.read_documents(store).collect())
    first = store.recipes.orderBy("start").first()
    key = bytes(first["keys"][:16])
    flipped = F.when(F.col("key") == F.lit(bytearray(key)), F.concat(F.substring("data", 1, F.length("data") - 1), F.lit(bytearray(b"\x00")))).otherwise(F.col("data"))
    damaged = replace(store, blobs=store.blobs.withColumn("data", flipped))
    assert not {r.doc_id: r.verified for r in ts.read_documents(damaged).collect()}[first.doc_id]
    # another root in the manifest, and a document that is lost
    other = replace(store, manifest=store.manifest.withColumn("root", F.lit(bytearray(16))))
    assert not any(r.verified for r in ts.read_documents(other).collect())
    lost = replace(store, recipes=store.recipes.where(F.col("start") != first.start))
    assert not any(r.verified for r in ts.read_documents(lost).collect())


def test_a_task_gives_its_memory_back(spark):
    """What workers hold after tasks with many distinct words is no more than before, but for the model and slack."""
    docs = spark.range(0, 6000, 1, 2).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(150)), lambda i: F.substring(F.md5(F.concat(F.col("id").cast("string"), i.cast("string"))), 1, 9))).alias("text"))

    def held(_):
        import pathlib
        import re

        import pandas as pd

        yield pd.DataFrame({"mb": [sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", pathlib.Path("/proc/self/smaps_rollup").read_text()))) / 1024]})

    most = lambda: max(r.mb for r in spark.range(0, 8, 1, 4).mapInPandas(held, "mb double").collect())
    for operator in (lambda: ps.sample_encode(docs, 2, digest=True), lambda: tc.token_counts(docs)):
        operator().agg(F.count("*")).collect()
        assert most() < 260
