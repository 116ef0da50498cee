"""Rows of a channel stay where they are: what is fitted to channels is broadcast to them."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import normalize as nz


@pytest.fixture
def rows(spark):
    draw = random.Random(7)
    data = [(i, f, None if i % 17 == 0 else draw.gauss(0, 1) ** p) for i in range(300) for f, p in (("a", 1), ("b", 3), ("c", 6))]
    return spark.createDataFrame(data, "pid long, feature string, value double")


@pytest.fixture
def no_size_hints(spark):
    """Joins as for tables whose size Spark does not know to be small."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shape_joins_no_rows_by_channel(rows, no_size_hints):
    # the two aggregates of few rows meet in a join; the rows of the edge masses are not dealt by channel
    edges = plan(nz.adaptive_methods(rows))
    assert "BroadcastHashJoin" in edges and edges.count("SortMergeJoin") <= 1


def test_quantiles_are_applied_without_a_shuffle(rows, no_size_hints):
    fitted = nz.fit_quantile(rows, 11).localCheckpoint()
    out = nz.apply_quantile(rows, fitted, "uniform")
    assert "SortMergeJoin" not in plan(out) and "Exchange hashpartitioning" not in plan(out)
    # as the position made in one expression
    want = rows.join(fitted, "feature").select("pid", "feature", nz.position(F.col("value"), F.col("quantiles")).alias("value"))
    as_set = lambda df: {tuple(r) for r in df.select("pid", "feature", "value").collect()}
    assert as_set(out) == as_set(want)


def test_all_methods_are_fitted_and_applied_without_dealing_by_channel(rows, no_size_hints):
    fitted = nz.fit(rows)
    assert {r["method"] for r in fitted.collect()} >= {"standard", "quantile"}
    out = nz.transform(rows, fitted.localCheckpoint())
    assert "SortMergeJoin" not in plan(out) and out.count() == 900
    semi = [line for line in plan(fitted).splitlines() if "LeftSemi" in line]
    assert semi and all("BroadcastHashJoin" in line for line in semi)
