"""Steps that hold far more than they shuffle are dealt over a set number of tasks, and cells are aggregated in order."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import features as ft
from tidemark.operators import medication as md
from tidemark.plans.features import doses
from tidemark.plans.registry import Tables
from tidemark.session import spread

QUERIES = entry.queries()


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_spread_is_not_merged(spark):
    tasks = spread(spark.range(1000), "id").select(F.spark_partition_id()).distinct().count()
    assert tasks >= 4 * spark.sparkContext.defaultParallelism


def test_doses_and_signals_are_dealt_by_entity_and_rolled_up_in_order(spark, folder):
    strongest = md.strongest_dose(doses(Tables(spark, folder)))
    assert "REPARTITION_BY_NUM" in executed(strongest)
    rolled = md.roll_up_signals(md.tag_signals(strongest))
    # a hash table of cells would hold some sixty sums of each
    assert "HashAggregate(keys=[pid#" not in executed(rolled).split("SortMergeJoin")[0].split("BroadcastHashJoin")[0]


def test_signal_levels_of_cells(spark):
    rows = [(1, 0, "J01FA01", "100", "mg"), (1, 0, "J01DH02", "100", "mg"), (1, 1, "C01CA03", "5", None), (None, 0, "J01DD99", None, "mg")]
    out = md.roll_up_signals(md.tag_signals(spark.createDataFrame(rows, "pid long, step int, code string, dose string, unit string")))
    got = {(r.pid, r.step): (r.antibiotic, r.icu_vaso, r.abx_level) for r in out.collect()}
    level = md.TIER_MAPS["antibiotic_escalation"].tier(F.col("c"))
    want = {r.c: r.l for r in spark.createDataFrame([("J01DH02",), ("J01DD99",)], "c string").select("c", level.alias("l")).collect()}
    assert got == {(1, 0): (1, 0, want["J01DH02"]), (1, 1): (0, 1, None), (None, 0): (1, 0, want["J01DD99"])}


def test_series_of_gaps(spark):
    rows = [(1, "a", 2, 5.0), (1, "a", 0, None), (1, "a", 9, 1.0), (1, "b", 3, 7.0), (2, "a", -1, 4.0), (2, "c", None, 4.0), (None, "a", 1, 2.0)]
    cells = spark.createDataFrame(rows, "pid long, feature string, step int, value double")
    frame = ft.series(cells, 4)
    got = {(r.pid, r.feature): r["values"] for r in frame.collect()}
    none = [None] * 4
    assert got == {(1, "a"): [None, None, 5.0, None], (1, "b"): [None, None, None, 7.0], (2, "a"): none, (None, "a"): [None, 2.0, None, None]}
    # laid out along the cells, without a search for every step
    assert "try_element_at" not in frame._jdf.queryExecution().analyzed().toString()
    twice = cells.unionByName(spark.createDataFrame([(1, "b", 3, 8.0)], cells.schema))
    with pytest.raises(PySparkException):
        ft.series(twice, 4).collect()


@pytest.mark.parametrize("name", ["a8_metadata_read", "k4_running_intervals"])
def test_copies_are_found_apart_from_the_joins(spark, folder, name):
    assert "REPARTITION_BY_NUM" in executed(QUERIES[name](spark, folder))
