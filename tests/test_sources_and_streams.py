"""Readers, stores and incremental refresh."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import mapping as m
from tidemark.plans.registry import Tables
from tidemark.sources import tables as src
from tidemark.streaming import incremental as inc
from tidemark.streaming.runs import Runs

STD = ["pid", "ts", "feature", "value", "event_id"]


def test_delimited_files_keep_bad_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("_index;key;n\n0;a;1\n1;b;x\n2;c;3\n")
    schema = T.StructType().add("_index", "string").add("key", "string").add("n", T.IntegerType())
    df = src.read_delimited(spark, str(tmp_path / "a.csv"), schema, ";")
    good, bad = src.split_bad_lines(df.cache())
    assert sorted((r.key, r.n) for r in good.collect()) == [("a", 1), ("c", 3)]
    assert bad.count() == 1 and "_index" not in df.columns


def test_entity_store_reads_one_bucket(spark, folder, tmp_path):
    ev = Tables(spark, folder).ev
    path = str(tmp_path / "store")
    src.write_entity_store(ev, path, "pid", 8)
    got = src.read_entity(spark, path, "pid", 7, 8)
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in ev.filter("pid = 7").collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(pid,7)" in plan
    other = src.read_entity_or(spark, str(tmp_path / "none"), ev, "pid", 7)
    assert other.count() == got.count()


def test_refresh_equals_batch_in_any_order(spark, folder, tmp_path):
    t = Tables(spark, folder)
    ev = t.ev.select(*STD)
    want = {tuple(r) for r in m.map_concept(ev, t.base, ["count", "max", "last"]).collect()}
    for order in ([0, 1, 2], [2, 0, 1]):
        store = inc.CellStore(spark, str(tmp_path / f"s{order[0]}"), t.base, ["count", "max", "last"], fanout=2)
        for version, part in enumerate(order):
            store.refresh(ev.filter(F.col("event_id") % 3 == part), version)
        store.refresh(ev.filter(F.col("event_id") % 3 == order[2]), 2)  # a repeated batch changes nothing
        assert {tuple(r) for r in store.current().select("pid", "step", "feature", "count", "max", "last").collect()} == want


ROW = "k long, v long"


def summed(rows):
    return rows.groupBy("k").agg(F.sum("v").alias("v"))


def runs_of(spark, path):
    return Runs(spark, str(path), spark.createDataFrame([], ROW).schema, summed, 3)


def total(runs):
    return {r.k: r.v for r in runs.read().collect()}


def test_runs_stay_few(spark, tmp_path):
    """Reading opens a bounded number of runs after any number of appends, and repeats change nothing."""
    runs, want = runs_of(spark, tmp_path / "t"), {}
    assert total(runs) == {}
    for version in range(14):
        rows = [(k, version) for k in range(version % 5 + 1)]
        for k, v in rows:
            want[k] = want.get(k, 0) + v
        assert runs.add(spark.createDataFrame(rows, ROW), version)
        assert not runs.add(spark.createDataFrame(rows, ROW), version)
        assert len(runs.state.live) <= 2 * 3 and total(runs) == want
    again = runs_of(spark, tmp_path / "t")  # another process sees the same
    assert again.state == runs.state and total(again) == want
    assert sum(1 for _ in (tmp_path / "t").glob("level0/*")) <= 8  # folders are used again
    again.replace(spark.createDataFrame([(1, 5)], ROW), 20)
    assert total(runs_of(spark, tmp_path / "t")) == {1: 5}


def test_killed_compaction_and_broken_manifest(spark, tmp_path):
    rows = lambda v: spark.createDataFrame([(1, v), (v, 1)], ROW)
    runs = runs_of(spark, tmp_path / "t")
    for v in (0, 1):
        runs.add(rows(v), v)
    commit, calls = Runs._commit, []

    def dies(self, *a):
        calls.append(a)
        if len(calls) == 2:  # the merged run is written, its manifest is not
            raise KeyboardInterrupt
        commit(self, *a)

    Runs._commit = dies
    try:
        runs.add(rows(2), 2)
    except KeyboardInterrupt:
        pass
    finally:
        Runs._commit = commit
    want = {0: 1, 1: 4, 2: 1}
    again = runs_of(spark, tmp_path / "t")
    assert again.state.version == 2 and len(again.state.live) == 3 and total(again) == want
    again.compact()
    assert len(again.state.live) == 1 and total(again) == want
    # a manifest that broke off is empty; the other one says what is live
    spark.createDataFrame([], "seq long, version long, level int, slot int").write.mode("overwrite").parquet(str(tmp_path / "t" / f"manifest{(again.state.seq + 1) % 2}"))
    assert total(runs_of(spark, tmp_path / "t")) == want


def test_refresh_does_not_read_earlier_batches(spark, folder, tmp_path):
    """The states of a batch are made from that batch alone; all aggregates merge to those of the batch build."""
    t = Tables(spark, folder)
    ev, functions = t.ev.select(*STD), list(m.CONTINUOUS)
    store = inc.CellStore(spark, str(tmp_path / "s"), t.base, functions, fanout=2)
    for version in range(5):
        store.refresh(ev.filter(F.col("event_id") % 5 == version), version)
    both = store.current().alias("a").join(m.map_concept(ev, t.base, functions).alias("b"), m.CELL, "full")
    near = lambda f: F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")) | (F.abs(F.col(f"a.{f}") - F.col(f"b.{f}")) <= 1e-9 * (1 + F.abs(F.col(f"b.{f}"))))
    for f in functions:
        assert both.filter(~F.coalesce(near(f), F.lit(False))).count() == 0, f


def test_state_of_closed_cells_goes(spark, tmp_path):
    """Cells past the bound are emitted once and leave the state; an event for a closed cell is dropped."""
    base = spark.sql("SELECT id AS pid, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(id) AS start_ts, timestamp_ntz'2024-03-01 00:00:00' AS end_ts FROM range(6)")
    event = lambda pid, day, hour, i: (pid, f"2024-01-{day:02d} {hour:02d}:05:00", "f", 1.0, i)
    batches = [
        [event(0, 1, 1, 1), event(0, 1, 1, 2), event(1, 2, 3, 3)],
        [event(2, 4, 1, 4), event(3, 9, 1, 5)],
        [event(3, 8, 23, 6), event(4, 10, 1, 7)],  # 6 is late, but within the bound
        [event(0, 1, 1, 8), event(4, 20, 1, 9)],  # 8 is late for a closed cell
    ]
    schema = "pid long, ts string, feature string, value double, event_id long"
    for rows in batches:
        spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = inc.event_stream(spark, str(tmp_path / "in"), "pid long, ts timestamp_ntz, feature string, value double, event_id long")
    cells = inc.mergeable_cells(stream, base, watermark="2 days")
    q = cells.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in q.recentProgress if p["stateOperators"])
    got = sorted((r.pid, r.n) for r in spark.read.schema(cells.schema).parquet(str(tmp_path / "out")).collect())
    assert kept[-1] == 1 and dropped == 1  # only the newest cell is open
    assert got == [(0, 2), (1, 1), (2, 1), (3, 1), (3, 1), (4, 1)]


def test_mergeable_stream(spark, folder, tmp_path):
    t = Tables(spark, folder)
    ev = t.ev.select(*STD)
    ev.repartition(3).write.parquet(str(tmp_path / "in"))
    cells = inc.mergeable_cells(inc.event_stream(spark, str(tmp_path / "in"), ev.schema), t.base)
    q = cells.writeStream.format("memory").queryName("cells_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = inc.finish_mergeable(spark.table("cells_out"))
    want = m.map_concept(ev, t.base, ["mean", "std", "count"])
    both = got.select(*m.CELL, "n", F.col("mean").alias("m"), F.col("std").alias("s")).join(want, m.CELL, "full")
    bad = ~(F.col("n").eqNullSafe(F.col("count"))) | (F.abs(F.col("m") - F.col("mean")) > 1e-9) | (F.abs(F.col("s") - F.col("std")) > 1e-5)
    assert both.filter(bad).count() == 0


def test_landmark_schedule():
    from tidemark.operators.landmark import landmark_hours

    hours = landmark_hours()
    assert hours[:7] == [0.0, 0.166667, 0.333333, 0.5, 1.0, 2.0, 3.0]
    assert hours[-1] <= 2160 and hours == sorted(set(hours))
    assert landmark_hours({"30min": "10min", "4h": "1h"}) == [0.0, 0.166667, 0.333333, 0.5, 1.0, 2.0, 3.0, 4.0]


def test_entities_that_arrive_late(spark, folder, tmp_path):
    """Events that come before their entity are mapped once it is admitted."""
    t = Tables(spark, folder)
    ev = t.ev.select(*STD)
    want = {tuple(r) for r in m.map_concept(ev, t.base, ["count"]).collect()}
    store = inc.CellStore(spark, str(tmp_path / "late"), t.base.filter("pid % 3 <> 0"), ["count"], fanout=2)
    store.refresh(ev.filter("event_id % 2 = 0"), 0)
    store.admit(t.base, 1)
    store.refresh(ev.filter("event_id % 2 = 1"), 2)
    assert {tuple(r) for r in store.current().select("pid", "step", "feature", "count").collect()} == want


def test_archive_keeps_earlier_groups(spark, tmp_path):
    log = inc.PredictionLog(spark, str(tmp_path / "log"), lambda df: df)
    log.refresh(spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "pid long, pred double"), 0)
    one = spark.createDataFrame([(1,)], "pid long")
    assert [r.pid for r in log.archive(one, 0).collect()] == [1]
    log.archive(spark.createDataFrame([(2,)], "pid long"), 1)
    assert sorted(r.pid for r in log.archive(one, 0).collect()) == [1, 2]
