"""The n-gram join against all pairs, and the pipeline's stages on their own input."""

import random
import re
from contextlib import nullcontext
from itertools import combinations

import pytest

import corpus_pipeline
from trailmark.llm import common
from trailmark.llm import ngram_join as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        n = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            parent[root(a)] = root(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[root(x)] = min(least.get(root(x), i), i)
    return sorted(((-1 if i is None else i), len(sets[x]), least.get(root(x), -1)) for x, (i, _) in enumerate(rows))


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 120))] for _ in range(8)]
    common = [rng.choice(vocabulary) for _ in range(25)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.4:
            w = common + w + common
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(x.upper() if rng.random() < 0.2 else x for x in w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "a b"), (n + 4, "A\tB"), (n + 4, "A\tB"), (n + 5, "a\u00a0b"), (None, "a b"), (None, "lone words here"), (n + 6, "z " * 4000)]


@pytest.mark.parametrize("crowd", [64, 4])
def test_components(spark, monkeypatch, crowd):
    monkeypatch.setattr(op, "CROWD", crowd)
    rows = corpus(crowd, 140)
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, node int, component_id string")
    got = sorted(tuple(r) for r in op.ngram_components(docs).na.fill(-1).collect())
    assert got == brute(rows)


def test_empty_and_keep_one(spark):
    schema = "doc_id long, text string, n int"
    assert op.ngram_components(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(4, "a b c d e f", 1), (2, "A b c d e f", 2), (9, "other", 3), (None, "a b c d e f", 4)], schema)
    assert sorted(r.n for r in op.keep_one(docs).collect()) == [2, 3, 4]


def test_pipeline(spark):
    rng = random.Random(9)
    words = {"en": "the of and to in is that for it was".split(), "fr": "le la les des une est dans pour qui que".split()}
    tail = lambda k: [f"{k}{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}" for _ in range(90)]
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "fr"
        own = tail(lang[0])
        rows.append((i, " ".join(rng.choice(words[lang]) if rng.random() < 0.5 else rng.choice(own) for _ in range(80)), lang, f"s{i % 3}", 0))
    rows += [(100, rows[0][1], "fr", "s0", 0), (101, "12 34 !!", "en", "s1", 0), (102, None, None, None, None), (103, "new line\n" + rows[1][1], "en", "s1", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names, step = [], docs
    for name, stage in corpus_pipeline.STAGES:
        before, step = step, op.save(stage(spark, step, ""), f"test-{name}")
        names.append((name, {r.doc_id for r in step.collect()}, {r.doc_id for r in before.collect()}))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert step.columns == docs.columns
        if name == "line_dedup":
            assert {r.doc_id: r.text for r in step.collect()}[103] == "new line"
    first = names[0]
    assert first[2] - first[1] == {101, 102}
    assert 100 not in names[1][1]  # all its lines were a copy
    assert names[-1][1] == names[-2][1]


def near_copies(n, size, seed):
    """n different texts that are one text with random words changed: links of all strengths around the threshold."""
    rng = random.Random(seed)
    base = [f"v{rng.randrange(500)}" for _ in range(size)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("crowd", [64, 6])
def test_one_large_group_of_near_copies(spark, monkeypatch, crowd):
    monkeypatch.setattr(op, "CROWD", crowd)
    rows = near_copies(500, 120, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in op.ngram_components(docs).collect())
    assert got == brute(rows)
    assert 1 < len({r[2] for r in got}) < 400  # a large component and texts of their own


def test_prefix_rule_loses_no_link():
    """Of linked sets, at least the smaller l shared shingles lie within the prefixes that the pair asks for."""
    import numpy as np

    rng, shingler = random.Random(5), op.Shingler()
    extra = np.zeros(op.COUNTERS, np.float32)
    sets = list(shingler.sets([t for _, t in near_copies(60, 90, 7)]))
    for s in sets[:30]:
        extra[op._slot(s)] += 3 * (np.random.default_rng(len(s)).random(len(s)) < 0.5)
    pre = [op.prefix(s, extra, op.SHARE) for s in sets]
    linked = 0
    for a, b in combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 4 * both < 3 * (len(sets[a]) + len(sets[b]) - both):
            continue
        linked += 1
        (la, pa), (lb, pb) = pre[a], pre[b]
        for least in {min(la, lb), 1, rng.randint(1, min(la, lb))}:
            _, ia, ib = np.intersect1d(pa, pb, return_indices=True)
            one = np.int64(least)
            n = op.within(np.int64(len(sets[a])), one, ia, np.int64(len(sets[b])), one, ib, op.SHARE).sum()
            assert n >= least
    assert linked > 50


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, _gone long, score double, _spans string"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, name):
    """Each stage on an empty table, and on null ids, repeated ids, clashing names, very long and empty texts."""
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
    run = "same words in a row that repeat " * 12
    rows = [(1, "the and that with this " * 6, "en", "a", 1), (1, "the and that with this " * 6, "en", "a", 1), (None, "the and that with which", "en", None, None), (None, None, None, None, None), (2, "", None, "b", 0), (3, "the of and " * 60_000, "en", "b", 5), (4, f"one\n{run}\n", "en", "a", 9), (5, f"two words here\n{run}", "en", "c", 9)]
    docs = spark.createDataFrame([(*r, "r", 7, 0.5, "s") for r in rows], SCHEMA)
    out = stage(spark, docs, "")
    got = out.collect()
    if name == "sample_pieces":
        assert {r.doc_id for r in got} == {r[0] for r in rows} and len(got) == sum(2 if r[1] else 1 for r in rows)
        return
    assert out.columns == docs.columns
    assert all((r._row, r._gone, r.score, r._spans) == ("r", 7, 0.5, "s") for r in got)
    text = {r.doc_id: r.text for r in got}
    if name == "language_id":
        assert len(got) == 6 and 2 not in text  # without letters
    elif name == "line_dedup":
        assert text[5] == "two words here" and text[3] == rows[5][1] and text[4] == rows[6][1]
    elif name == "ngram_join":
        assert sorted((r.doc_id or 0) for r in got) == [0, 0, 1, 1, 2, 3, 4, 5]


def test_components_that_new_links_join(spark):
    """Links that come later are added to known components: the same as all links at once, and no round where they join nothing."""
    rng = random.Random(11)
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    old = [(i, i + 1) for i in range(100, 108)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(25)]
    new = [(5, 104), (300, 301), (301, 7), (200, 201)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(8)]
    known = op.components(frame(old))
    got = {r.node: r.component for r in op.components(frame(new), known).collect()}
    assert got == {r.node: r.component for r in op.components(frame(old + new)).collect()}
    assert op.components(frame([(100, 108), (103, 105)]), known) is known
    assert op.components(frame(new), known.where("false")).count() == op.components(frame(new)).count()


def test_the_driver_gives_memory_back(spark, monkeypatch):
    """The collector runs, and the JVM takes the command rather than refuse it unseen."""
    monkeypatch.setattr(common.contextlib, "suppress", lambda *kinds: nullcontext())
    of = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    before = of()
    common.driver_gives_back(spark)
    assert of() > before
