"""Every query of the library with SQL agrees with DuckDB on the smallest tables; the entry point works without the llm subpackage."""

import datetime
import decimal
import os
import subprocess
import sys

import duckdb
import pytest

from trailmark import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return repr(float(f"{float(v):.9g}") + 0.0)
    return v.isoformat() if isinstance(v, datetime.date) else str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_against_sql(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = db.execute(plans.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs_without_sql(spark, name):
    """Queries that SQL can't say run too; what they give is tested beside their operators."""
    df = plans.QUERIES[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
def test_components_of_all_orders(spark, db):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in db.execute("select o_custkey, o_orderkey % 1500 from orders").fetchall():
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r.id: r.component for r in plans.QUERIES["q_g14_components"](spark, SF).collect()}
    assert got == {x: find(x) for x in root}


def test_recurrence_of_high_keys(spark, tmp_path):
    spark.sql("select 600001L as o_orderkey, timestamp '1998-01-05' as o_orderdate union all select 600003L, timestamp '1998-02-20'").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted((r.id, r.day.isoformat()) for r in plans.QUERIES["q_p08_recurrence"](spark, str(tmp_path)).collect())
    assert got == [(600001, "1998-01-05"), (600003, "1998-02-20"), (600003, "1998-02-27")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
def test_dead_ends_of_all_edges(spark, db):
    keys = [k for (k,) in db.execute("select s_suppkey from supplier").fetchall()]
    near, want, depth = {}, {}, 0
    for a, b in [(k, k + n) for k in keys for n in (5, 15)]:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    while leaves := [x for x in near if len(near[x]) == 1]:
        want |= dict.fromkeys(leaves, depth)
        near = {x: n - set(leaves) for x, n in near.items() if x not in leaves}
        depth += 1
    assert {r.id: r.depth for r in plans.QUERIES["q_g13_dead_ends"](spark, SF).collect()} == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
def test_streamed_steps_are_the_batchs(spark):
    rows = lambda n: sorted(map(tuple, plans.QUERIES[n](spark, SF).collect()))
    assert rows("q_st1_steps_streamed") == rows("q_st1_steps") != []


def test_entry_without_llm(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for p in ("trailmark", "__spark_entry__.py"):
        os.symlink(f"{root}/{p}", tmp_path / p) if p.endswith("py") else None
    os.mkdir(tmp_path / "trailmark")
    for p in os.listdir(f"{root}/trailmark"):
        if p != "llm" and not p.startswith("__pycache__"):
            os.symlink(f"{root}/trailmark/{p}", tmp_path / "trailmark" / p)
    code = "from pyspark.sql import SparkSession; import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), e.entry(SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()).limit(1).count())"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.split()[-3:] == [str(len(plans.QUERIES)), "False", "1"], out.stderr
