"""Exact dedup, source mixing and line dedup against brute force, with nulls, ties, repeated rows and empty tables."""

import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from trailmark.llm.exact_dedup import exact_dedup
from trailmark.llm.line_dedup import line_dedup
from trailmark.llm.mixing import mix, mix_plan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, size string, _hash string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)


def sample(seed, n=120):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 4))) for _ in range(30)] + [None, "", " ", "é" * 5000]
    return [(i, rng.choice(texts), rng.choice(["a", "b", "c", "é", None])) for i in range(n)]


def test_exact_dedup(spark):
    rows = sample(1) + [(5, "again", "a"), (5, "again", "a"), (None, "again", "a"), (None, "lone", "a")]
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    for weak in (None, lambda t: F.substring(F.md5(t), 1, 1)):
        got = sorted(tuple(r) for r in exact_dedup(table(spark, rows), **({"content_hash": weak} if weak else {})).na.fill(-1, ["doc_id", "keep_id"]).collect())
        best = {t: max((x for x in m if x is not None), default=-1) for t, m in groups.items()}
        want = sorted((-1 if i is None else i, best[t or ""], len(groups[t or ""]), (-1 if i is None else i) == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
        assert got == want
    assert exact_dedup(table(spark, [])).count() == 0
    assert {r.keep_id for r in exact_dedup(table(spark, [(3, "a", "s"), (1, "a", "s")]), keep="min").collect()} == {1}


def brute_targets(sizes, weights):
    left, targets, open_ = sum(sizes.values()), {}, dict(sizes)
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = [s for s in open_ if 3 * open_[s] < level * weights[s]]
        if not over:
            return targets | {s: level * weights[s] for s in open_}
        s = min(over, key=lambda s: open_[s] / weights[s])
        targets[s] = 3.0 * open_.pop(s)
        left -= targets[s]
    return targets


def test_mix(spark):
    rng = random.Random(3)
    for pick in (["a", "b", "c", "d", None], ["a"] * 30 + ["b", "c", None]):
        rows = [(i, " ".join("w" * rng.randint(1, 60)), rng.choice(pick)) for i in range(600)] + [(None, None, "a"), (7007, "x y", "z"), (7007, "x y", "z"), (9009, " ", "0")]
        got = mix_plan(table(spark, rows)).collect()
        assert len(got) == len(rows)
        sizes = defaultdict(int)
        for _, t, s in rows:
            sizes[s] += len(WORD.findall(t or ""))
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        want = brute_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(names)})
        source = {i: s for i, _, s in rows}
        taken = defaultdict(int)
        for r in got:
            assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
            s = "a" if r.doc_id is None else source[r.doc_id]
            assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
            taken[s] += r.taken
        for s in names:
            assert abs(taken[s] - want[s]) <= max(200, 0.03 * want[s])
        assert sorted(map(str, got)) == sorted(map(str, mix_plan(table(spark, rows).repartition(7)).collect()))
    mixed = mix(table(spark, rows))
    assert mixed.columns == table(spark, rows).columns
    assert mixed.count() == sum(r.copies for r in mix_plan(table(spark, rows)).collect())
    assert mix(table(spark, [])).count() == 0


def brute_lines(rows, least):
    """Removed lines by id: every shortest run of least words that has begun before."""
    seen, gone = set(), defaultdict(set)
    for i, text in sorted(rows):
        lines = text.split("\n")
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += len(WORD.findall(lines[b]))
                if n >= least:
                    run = tuple(lines[a : b + 1])
                    if run in seen:
                        gone[i].update(range(a, b + 1))
                    seen.add(run)
                    break
    return gone


def test_line_dedup(spark):
    rng = random.Random(5)
    lines = ["one two three", "four five", "", "six", "seven eight nine ten", "x"]
    rows = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.8 else f"own {i} {rng.random()}" for _ in range(rng.randint(0, 14)))) for i in range(80)]
    rows += [(100, "\n".join(lines * 30)), (101, "\n".join(lines * 30)), (102, "\n" * 40)]
    docs = spark.createDataFrame([(i, t, "keep", 1) for i, t in rows] + [(200, None, "n", 0), (None, rows[3][1], "null id", 0)], "doc_id long, text string, _row string, line int")
    for least in (3, 7, 50):
        want, texts = brute_lines(rows, least), dict(rows)
        got = {r.doc_id: r for r in line_dedup(docs, min_words=least).collect()}
        assert len(got) == len(rows) + 2 and got[200].text is None and got[None].text == rows[3][1]
        for i, t in rows:
            left = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i])
            assert got[i].text == (left if want[i] else t) and got[i]._row == "keep"
            assert {n for a, b in got[i]._removed for n in range(a, b + 1)} == want[i]
    assert line_dedup(docs.where("false")).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert sorted(r.text for r in line_dedup(twice, min_words=3).collect()) == ["", "a b c", "a b c"]


def brute_maximal(rows, least):
    """Removed lines by id: from each line, the longest prefix that an earlier line begins as well, where it has least words."""
    every = [(i, text.split("\n")) for i, text in sorted(rows)]
    before, gone = [], defaultdict(set)
    for i, lines in every:
        for a in range(len(lines)):
            longest = 0
            for other, b in before:
                n = 0
                while a + n < len(lines) and b + n < len(other) and lines[a + n] == other[b + n]:
                    n += 1
                longest = max(longest, n)
            before.append((lines, a))
            if sum(len(WORD.findall(x)) for x in lines[a : a + longest]) >= least:
                gone[i].update(range(a, a + longest))
    return gone


def test_line_dedup_takes_whole_runs(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"{a}\n{b}"), (2, f"{a}\n{b}"), (3, f"own\n{a}\n{b}\nend"), (4, b)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup(docs, whole=True).collect()} == {1: f"{a}\n{b}", 2: "", 3: "own\nend", 4: b}
    rng = random.Random(6)
    lines = ["one two three", "four five", "", "six", "seven eight nine ten", "x"]
    rows = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.85 else f"own {i} {rng.random()}" for _ in range(rng.randint(0, 14)))) for i in range(60)]
    rows += [(100, "\n".join(lines * 8)), (101, "\n".join(lines * 8)), (102, "\n" * 20)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (3, 7, 50):
        want = brute_maximal(rows, least)
        got = {r.doc_id: {n for x, y in r._removed for n in range(x, y + 1)} for r in line_dedup(table, min_words=least, whole=True).collect()}
        assert got == {i: want[i] for i, _ in rows}
