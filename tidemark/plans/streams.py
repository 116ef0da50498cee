"""Incremental refresh: streams run to their end, the stored result is read back."""

from itertools import pairwise

from pyspark.sql import functions as F

from tidemark.operators import mapping as m
from tidemark.operators import trajectory as tr
from tidemark.plans.registry import query, rounded, with_
from tidemark.plans.source_checks import scratch
from tidemark.session import cut_lineage, spread
from tidemark.streaming import incremental as inc

STD = ["pid", "ts", "feature", "value", "event_id"]


def files_of(t, name: str, parts: int, key=None) -> tuple[str, object]:
    """The event table as a folder of files that arrive one after the other."""
    path = scratch(t, name)
    ev = t.ev.select(*STD)
    # arrival order has nothing to do with event time
    ev.repartition(parts, key if key is not None else F.col("event_id")).write.mode("overwrite").parquet(path)
    return path, ev.schema


@query(
    "k1_incremental_refresh",
    f"""{with_("ev", "base", "seg", "grid", "mapped")} SELECT pid, step, feature, round(avg(value), 6) AS mean, max(value) AS max, min(value) AS min, count(value) AS count FROM mapped GROUP BY 1, 2, 3""",
)
def k1(t):
    """Cells kept by micro-batches, with a compaction; must equal the batch build."""
    path, schema = files_of(t, "arrivals", 4)
    store = inc.CellStore(t.spark, scratch(t, "cells"), cut_lineage(t.base))
    store.run(inc.event_stream(t.spark, path, schema), scratch(t, "offsets"))
    return rounded(store.current())


@query(
    "k2_prediction_log",
    f"""{with_("ev", "base")}, d AS (SELECT pid FROM base WHERE end_ts <= TIMESTAMP '2024-01-30 12:00:00') SELECT pid, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM ev WHERE pid IN (SELECT pid FROM d) GROUP BY 1""",
)
def k2(t):
    """Scores appended per refresh; the archived log of ended users, summed."""
    path, schema = files_of(t, "arrivals", 3)
    log = inc.PredictionLog(
        t.spark, scratch(t, "log"), lambda df: df.groupBy("pid").agg(F.count("*").alias("n"), F.sum("value").alias("pred"))
    )
    log.run(inc.event_stream(t.spark, path, schema), scratch(t, "offsets"))
    ended = t.base.filter(F.col("end_ts") <= F.expr("timestamp_ntz'2024-01-30 12:00:00'"))
    done = log.archive(ended).groupBy("pid").agg(F.sum("n").alias("n"), F.sum("pred").alias("total"))
    return rounded(done, 4)


@query(
    "k3_late_and_future",
    f"""{with_("ev", "base", "seg", "grid", "mapped")} SELECT pid, step, feature, count(value) AS count FROM mapped WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY 1, 2, 3""",
)
def k3(t):
    """Files arrive newest first; late events land in their cells, future ones are rejected."""
    path = scratch(t, "arrivals")
    ev = t.ev.select(*STD)
    ev.repartitionByRange(4, F.col("ts").desc()).write.mode("overwrite").parquet(path)
    store = inc.CellStore(t.spark, scratch(t, "cells"), cut_lineage(t.base), functions=["count"])
    store.run(inc.event_stream(t.spark, path, ev.schema), scratch(t, "offsets"), now=F.expr("timestamp_ntz'2024-01-15 00:00:00'"))
    return store.current()


@query(
    "k1_late_entities",
    f"""{with_("ev", "base", "seg", "grid", "mapped")} SELECT pid, step, feature, round(stddev_samp(value), 6) AS std, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last, round(sum(value), 4) AS sum FROM mapped GROUP BY 1, 2, 3""",
)
def k1_late(t):
    """A third of the entities is admitted between the refreshes, after most of their events came."""
    ev, base = cut_lineage(t.ev.select(*STD)), cut_lineage(t.base)
    store = inc.CellStore(t.spark, scratch(t, "cells"), base.filter("pid % 3 <> 0"), ["std", "first", "last", "sum"], fanout=2)
    for version, part in enumerate((0, 1)):
        store.refresh(ev.filter(F.col("event_id") % 3 == part), version)
    store.admit(base, 2)
    store.refresh(ev.filter(F.col("event_id") % 3 == 2), 3)
    return rounded(rounded(store.current(), 6, ("std",)), 4, ("sum",))


@query(
    "k3_bounded_state",
    f"""{with_("ev", "base", "seg", "grid", "mapped")}, c AS (SELECT pid, step, feature, start_ts + to_minutes(hi::INT) AS cell_end, count(value) AS n, max(value) AS max
      FROM mapped JOIN base USING (pid) JOIN grid USING (step) GROUP BY ALL)
    SELECT pid, step, feature, n, max FROM c WHERE epoch_us(cell_end) <= (SELECT epoch_us(max(cell_end)) // 1000 * 1000 - 172800000000 FROM c)""",
)
def k3_bounded(t):
    """Cells that a stream in order of time has closed under a bound of a day (and the widest cell, a day too)."""
    path = scratch(t, "arrivals")
    ev = t.ev.select(*STD)
    for since, until in pairwise(["0001-01-01", "2024-01-09", "2024-01-20", "9999-01-01"]):  # written one after the other
        ev.filter((F.col("ts") >= since) & (F.col("ts") < until)).coalesce(1).write.mode("append").parquet(path)
    cells = inc.mergeable_cells(inc.event_stream(t.spark, path, ev.schema), cut_lineage(t.base), watermark="1 day")
    out = scratch(t, "closed")
    query_ = cells.writeStream.format("parquet").option("checkpointLocation", scratch(t, "offsets")).outputMode("append").trigger(availableNow=True).start(out)
    query_.awaitTermination()
    return t.spark.read.schema(cells.schema).parquet(out).select(*m.CELL, "n", "max")


@query(
    "k4_running_intervals",
    f"""{with_("ev", "base", "seg", "grid", "nexts")}, x AS (SELECT n.pid, feature, event_id, n.ts, least(coalesce(n.end_ts, start_ts + to_hours(300)), start_ts + to_hours(300)) AS e, start_ts FROM nexts n JOIN base USING (pid) WHERE n.ts <= start_ts + to_hours(300))
    SELECT DISTINCT pid, feature, step FROM x JOIN grid g ON epoch_us(x.ts) - epoch_us(start_ts) < g.hi * 60000000 AND epoch_us(x.e) - epoch_us(start_ts) > g.lo * 60000000""",
)
def k4(t):
    """Three refreshes of running intervals give the same cells as one look at the end."""
    from tidemark.operators.sliced import neighbour

    stays = neighbour(t.ev, ["pid"], ["ts", "event_id"], {"end_ts": "ts"}, ahead=True)
    base = t.base
    stays = stays.join(base.select("pid", F.col("start_ts").alias("s")), "pid")
    out = None
    for a, b in ((-1, 50), (50, 120), (120, 300)):
        lo, hi = (F.col("s") + F.expr(f"make_dt_interval(0, {h}, 0, 0)") for h in (a, b))
        part = inc.extend_running(stays, base, lo, hi).select("pid", "feature", "step")
        out = part if out is None else out.unionByName(part)
    return spread(out, *out.columns).distinct()
