"""Ranked search against every pair of name and query; tables that appear whole or not at all."""

import os
import random

from pyspark.sql import functions as F

from trailmark.functions.text import search_key
from trailmark.operators.search import search
from trailmark.sources.tables import rebuild, seed_if_empty


def test_search_equals_all_pairs(spark):
    rng = random.Random(4)
    bits = ["ab", "abc", "b", "Čačak", "dé", "Blok", "east", "1", "12", "x-y", "West Hall"]
    text = lambda n: " ".join(rng.choices(bits, k=rng.randint(0, n)))
    names = [(i, text(4), rng.choice([None, [], [text(2)], [text(2), text(3)]]), rng.choice([None, [], [text(2)], [text(3), "old wing"]])) for i in range(200)]
    queries = [(i, text(3)) for i in range(40)] + [(40, ""), (41, " - "), (42, "zzz"), (43, "old ab"), (44, "wing 12"), (45, "b")]
    n = spark.createDataFrame(names, "name_id int, name string, aliases array<string>, context array<string>")
    q = spark.createDataFrame(queries, "query_id int, query string")
    words = {t for _, a, b, c in names for t in (a, *(b or []), *(c or []))} | {w for _, t in queries for w in t.split(" ")} | {p for *_, c in names for t in c or [] for p in t.replace("-", " ").split(" ")}
    key = {r.t: r.k for r in spark.createDataFrame([(w,) for w in words], "t string").select("t", search_key(F.col("t")).alias("k")).collect()}
    want = []
    for query, asked in queries:
        parts = [k for k in (key[w] for w in asked.split(" ")) if k]
        whole = "".join(parts)
        for name, text_, aliases, context in names:
            keys = [key[text_], *[key[a] for a in aliases or []]]
            begins = [k for t in context or [] for k in (*[key[p] for p in t.replace("-", " ").split(" ")], key[t]) if k]
            if not parts or whole in keys:
                rank = 0
            elif any(k.startswith(whole) for k in keys):
                rank = 1
            elif any(all(w in k for w in parts) for k in keys):
                rank = 2
            elif begins and all(any(w in k for k in keys) or any(c.startswith(w) for c in begins) for w in parts):
                rank = 3
            else:
                continue
            want.append((query, name, rank))
    got = search(n, q).collect()
    assert sorted((r.query_id, r.name_id, r["rank"]) for r in got) == sorted(want) and len(want) > 300
    order = sorted((r.query_id, r["rank"], r.name_id) for r in got)
    assert order == [(r.query_id, r["rank"], r.name_id) for r in sorted(got, key=lambda r: (r.query_id, r.place))]


def test_seeds_appear_whole(spark, tmp_path):
    one, two = spark.range(3), spark.range(5)
    assert seed_if_empty(spark, one, f"{tmp_path}/deep/a").count() == 3
    assert seed_if_empty(spark, two, f"{tmp_path}/deep/a").count() == 3
    os.makedirs(f"{tmp_path}/b/_temporary/0")  # a writer that broke off
    assert seed_if_empty(spark, two, f"{tmp_path}/b").count() == 5
    assert rebuild(spark, one, f"{tmp_path}/c", 1).count() == 3 and rebuild(spark, two, f"{tmp_path}/c", 2).count() == 5
    assert sorted(os.listdir(tmp_path)) == ["b", "c", "deep"] and os.listdir(f"{tmp_path}/deep") == ["a"]
