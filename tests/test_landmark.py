"""Landmark datasets against plain Python, with short and long series."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import landmark as lm

HOURS = [0.0, 1.0, 2.5, 4.0, 9.0, 30.0]
FUNCTIONS = ("first", "last", "min", "max", "mean", "std", "count", "median")


def made(spark, seed=1, hot=0):
    """Events of few entities, with ties in time and value, nulls, events past the last landmark, and a hot series."""
    rnd, rows, i = random.Random(seed), [], 0
    for pid in range(8):
        for f in ("a", "b"):
            for _ in range(rnd.choice([0, 1, 2, 5, 40])):
                rows.append((pid, rnd.choice([0, 3600, rnd.randrange(40 * 3600)]), f, rnd.choice([None, 1.0, -2.0, rnd.gauss(1e6, 1)]), i := i + 1))
    for _ in range(hot):
        rows.append((99, rnd.randrange(31 * 3600), "a", rnd.choice([7.0, round(rnd.gauss(0, 50), 1), rnd.random()]), i := i + 1))
    df = spark.createDataFrame(rows, "pid long, s long, feature string, value double, event_id long")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000).cast("timestamp_ntz")).drop("s")
    starts = spark.createDataFrame([(p,) for p in [*range(9), 99]], "pid long").withColumn("start_ts", F.timestamp_seconds(F.lit(1_700_000_000)).cast("timestamp_ntz"))
    return rows, df, starts


def expected(rows):
    out = {}
    for h in HOURS:
        for pid, f in {(r[0], r[2]) for r in rows}:
            seen = sorted((r for r in rows if (r[0], r[2]) == (pid, f) and r[1] <= h * 3600 and r[3] is not None), key=lambda r: (r[1], r[4]))
            v = [r[3] for r in seen]
            if v:
                out[h, pid, f] = [v[0], v[-1], min(v), max(v), np.mean(v), np.std(v, ddof=1) if len(v) > 1 else None, len(v), np.median(v)]
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        for a, b in zip(got[k], w):
            assert (a is None and b is None) or np.isclose(a, b, rtol=1e-9, atol=1e-6), (k, got[k], w)


@pytest.mark.parametrize("small", [4096, 10])
def test_stats_equal_plain_ones(spark, small, monkeypatch):
    """With a bound of 10 most series take the way of long ones."""
    monkeypatch.setattr(lm, "SMALL", small)
    monkeypatch.setattr(lm, "SLICES", 16)
    rows, df, starts = made(spark, 2, hot=1500)
    got = {(r.landmark, r.pid, r.feature): list(r[3:]) for r in lm.landmark_stats(df, starts, HOURS, FUNCTIONS).collect()}
    same(got, expected(rows))


def test_dataset_has_every_entity_and_landmark(spark):
    rows, df, starts = made(spark, 3)
    want, functions = expected(rows), ("median", "count")
    out = lm.landmark_dataset(df, starts, HOURS, ["a", "b", "never"], "x", functions)
    got = out.collect()
    assert len(got) == 10 * len(HOURS) and out.columns[2:] == [f"{f}_x_{fn}" for fn in functions for f in ("a", "b", "never")]
    for r in got:
        for f in ("a", "b", "never"):
            w = want.get((r.landmark, r.pid, f), [0.0] * 8)
            assert np.isclose(r[f"{f}_x_median"], w[7]) and r[f"{f}_x_count"] == w[6]


def test_events_are_not_copied_per_landmark(spark):
    """The only generators of the plan lay out finished rows: none stands below an aggregate."""
    _, df, starts = made(spark)
    plan = lm.landmark_stats(df, starts, HOURS, FUNCTIONS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2 and plan.rindex("Generate explode") < plan.index("Aggregate")


def test_rows_are_dealt_in_ranges_without_a_sample(spark):
    """Few landmarks a task; ranges from a sample would lay out the dataset a second time."""
    hours, n = [1.0, 2.5, 4.0], 400
    data = spark.range(n).select(F.col("id").alias("pid"), F.explode(F.lit([*hours, 9.0])).alias("landmark"), F.rand(1).alias("x"))
    rows = lm._landmark_rows(data, ["x"], F.lit(0.0), F.lit(-1), hours)
    assert "rangepartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
    # the unknown landmark lies with the first
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = {}
    for r in rows.withColumn("part", F.spark_partition_id()).collect():
        by.setdefault(r.part, set()).add(r.group)
    assert rows.count() == 4 * n and len(by) == parts and all(len(known - {9.0}) <= -(-len(hours) // parts) + 1 for known in by.values())
