"""Registered queries next to their SQL on the smallest tables; coverage of the inventory."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans.registry import NAMES

QUERIES, SQL = entry.queries(), entry.oracle_sql()

#: Every query with SQL, each on a connection of its own.
NAMED = sorted(n for n in SQL if not n.startswith("op") and n != "pipeline")


def text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


@pytest.fixture
def con(folder):
    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def test_inventory_is_covered():
    sizes = dict(a=13, b=28, c=23, d=25, e=41, f=9, g=11, h=6, i=26, j=7, k=6, l=5, m=7, n=4, o=5, p=4)
    have = {n.split("_")[0] for n in QUERIES}
    assert not [f"{s}{i}" for s, n in sizes.items() for i in range(1, n + 1) if f"{s}{i}" not in have]
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", NAMED)
def test_query_equals_sql(spark, folder, con, name):
    df = QUERIES[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    cols = sorted(df.columns)
    cur = con.execute(SQL[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == cols
    want = sorted([text(r[have.index(c)]) for c in cols] for r in cur.fetchall())
    assert sorted([text(r[c]) for c in cols] for r in df.collect()) == want


def test_entry_is_lazy_and_named(spark):
    df = entry.entry(spark)
    assert {"pid", "feature", "step", "mean_filled"} <= set(df.columns)
