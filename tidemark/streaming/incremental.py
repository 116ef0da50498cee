"""Keeping mapped cells current from a stream of events.

Every micro-batch is aggregated to partial states of the cells it touches, and these are appended as a run of
the store; a cell's states are merged when runs are compacted and when cells are read. A refresh so reads only
its own batch, and reading costs the same after any number of refreshes (``runs.py``). States merge in any
grouping, so the outcome does not depend on arrival order and equals the batch build (sums up to the last digits).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timegrid import DEFAULT_GRID, MINUTE, Grid, micros
from tidemark.operators.cohort import delta_window
from tidemark.operators.mapping import CELL, interval_to_steps, point_to_step
from tidemark.streaming.runs import Runs


def accept(events: DataFrame, now: Column | None) -> DataFrame:
    """Events known by ``now``: late ones of any age pass, future ones do not."""
    return events if now is None else events.filter(F.col("ts") <= now)


# ---- mergeable states of a cell ----------------------------------------------------------


#: What each aggregate function needs of a cell's state, besides the number of values ``n``.
NEEDS = {"first": ["first"], "last": ["last"], "mean": ["total"], "min": ["lo"], "max": ["hi"], "std": ["total", "m2"], "sum": ["total"], "count": []}


def cell_states(mapped: DataFrame, functions: Iterable[str] = tuple(NEEDS)) -> DataFrame:
    """What the aggregate functions need, one row per cell."""
    row = F.struct("ts", "event_id", "value")
    parts = {
        "total": F.sum("value"),
        "m2": F.var_pop("value") * F.count("value"),
        "lo": F.min("value"),
        "hi": F.max("value"),
        "first": F.min(row),
        "last": F.max(row),
    }
    needed = {part for f in functions for part in NEEDS.get(f, NEEDS["mean"])}
    kept = [column.alias(name) for name, column in parts.items() if name in needed]
    return mapped.filter(F.col("value").isNotNull()).groupBy(*CELL).agg(F.count("value").alias("n"), *kept)


def _spread(parts: Column) -> Column:
    """Sum of squared deviations of all parts (n, total, m2), merged one after the other without squares of means."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def merge(acc: Column, p: Column) -> Column:
        n, away = acc["n"] + p["n"], p["total"] / p["n"] - acc["mean"]
        m2 = acc["m2"] + p["m2"] + away * away * acc["n"] * p["n"] / n
        return F.struct(n.alias("n"), (acc["mean"] + away * p["n"] / n).alias("mean"), m2.alias("m2"))

    return F.aggregate(parts, zero, merge)["m2"]


def merge_states(states: DataFrame) -> DataFrame:
    """One state per cell. A cell has at most one state in a run, so the list of its parts is short."""
    merged = {
        "n": F.sum("n"),
        "total": F.sum("total"),
        "m2": _spread(F.sort_array(F.collect_list(F.struct("n", "total", "m2")))) if "m2" in states.columns else None,
        "lo": F.min("lo"),
        "hi": F.max("hi"),
        "first": F.min("first"),
        "last": F.max("last"),
    }
    return states.groupBy(*CELL).agg(*[column.alias(name) for name, column in merged.items() if name in states.columns])


def finish_states(states: DataFrame, functions: Iterable[str]) -> DataFrame:
    """The aggregates of ``mapping.aggregate_cells``; names without a function are the mean."""
    n = F.col("n")
    known = {
        "first": lambda: F.col("first.value"),
        "last": lambda: F.col("last.value"),
        "mean": lambda: F.col("total") / n,
        "min": lambda: F.col("lo"),
        "max": lambda: F.col("hi"),
        "std": lambda: F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))),
        "sum": lambda: F.col("total"),
        "count": lambda: n,
    }
    return states.select(*CELL, *[known.get(f, known["mean"])().alias(f) for f in functions])


@dataclass
class CellStore:
    """Cells of a stream of events under one folder on shared storage.

    ``base`` holds the start of every entity. Events of entities that are not in it wait in a table of their own
    until the entity is admitted; events of known ones are not kept.
    """

    spark: SparkSession
    path: str
    base: DataFrame
    functions: Iterable[str] = ("mean", "max", "min", "count")
    grid: Grid = DEFAULT_GRID
    fanout: int = 8
    events: str = "pid long, ts timestamp_ntz, feature string, value double, event_id long"

    def __post_init__(self) -> None:
        self.base = self.base.select("pid", "start_ts")
        none = self.spark.createDataFrame([], self.events)
        self.functions = tuple(self.functions)
        schema = self._states(point_to_step(none, self.base, self.grid)).schema
        self.cells = Runs(self.spark, f"{self.path}/cells", schema, merge_states, self.fanout)
        self.waiting = Runs(self.spark, f"{self.path}/waiting", none.schema, lambda rows: rows, self.fanout)

    def refresh(self, new: DataFrame, version: int, now: Column | None = None) -> None:
        """Take in a batch of events ``(pid, ts, feature, value, event_id)``. Versions rise; a repeated one is left out."""
        if version <= self.cells.state.version:
            return
        new = accept(new, now).select(*self.waiting.schema.names)
        early = new.join(self.base, "pid", "left_anti")
        if not early.isEmpty():
            self.waiting.add(early, version)
        self.cells.add(self._states(point_to_step(new, self.base, self.grid)), version)

    def _states(self, mapped: DataFrame) -> DataFrame:
        return cell_states(mapped, self.functions)

    def admit(self, entities: DataFrame, version: int) -> None:
        """Take in entities ``(pid, start_ts, …)`` whose events may have come before them: those that wait are mapped."""
        fresh = entities.select("pid", "start_ts").join(self.base.select("pid"), "pid", "left_anti")
        early = self.waiting.read()
        self.cells.add(self._states(point_to_step(early, fresh, self.grid)), version)
        self.waiting.replace(early.join(fresh, "pid", "left_anti"), version)
        self.base = self.base.unionByName(fresh)

    def current(self) -> DataFrame:
        """All cells as they are now."""
        return finish_states(self.cells.read(), self.functions)

    def run(self, stream: DataFrame, checkpoint: str, now: Column | None = None) -> None:
        """Drain a stream of event files into the store."""
        query = (
            stream.writeStream.foreachBatch(lambda df, i: self.refresh(df, i, now))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Stream of parquet event files with an explicit schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def mergeable_cells(stream: DataFrame, base: DataFrame, grid: Grid = DEFAULT_GRID, watermark: str | None = None) -> DataFrame:
    """Streaming aggregate of mergeable statistics per cell.

    Without ``watermark`` an event of any age still reaches its cell, and the state of a cell is never dropped
    (update or complete mode). With one (such as ``"2 days"``) the state is bounded: cells are keyed by the time
    ``cell_end`` too, and once the newest cell end seen is more than the bound and the widest cell past a cell's own
    end, its state is dropped. In append mode the cell is then emitted, once and for good. So an event that is
    not older than the bound, counted from the newest event, is never lost, and one whose cell is closed is dropped
    and counted in the progress as dropped by the watermark. The static base is joined to the stream.
    """
    if not watermark:
        keys, mapped = CELL, point_to_step(stream, base, grid)
    else:
        held = stream.join(base.select("pid", "start_ts"), "pid").withColumn("step", grid.step_of(F.col("ts"), F.col("start_ts")))
        _, hi = grid.bounds(F.col("step"))
        end = F.timestamp_micros(micros(F.col("start_ts")) + hi.cast("long") * MINUTE)
        widest = max(c.hi - c.lo for c in grid.steps)
        mapped = held.filter(F.col("step").isNotNull()).withColumn("cell_end", end).withWatermark("cell_end", f"{watermark} {widest} minutes")
        keys = [*CELL, "cell_end"]
    return mapped.filter(F.col("value").isNotNull()).groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.sum("value").alias("total"),
        F.sum(F.col("value") * F.col("value")).alias("squares"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def finish_mergeable(cells: DataFrame) -> DataFrame:
    """Mean and sample std from the merged sums (less exact than re-aggregation)."""
    n, s, q = F.col("n"), F.col("total"), F.col("squares")
    var = F.when(n > 1, F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))
    return cells.withColumns({"mean": s / n, "std": F.sqrt(var)})


@dataclass
class PredictionLog:
    """Append-only log of scores, one folder per refresh, and the archive of ended entities."""

    spark: SparkSession
    path: str
    score: Callable[[DataFrame], DataFrame]

    def refresh(self, batch: DataFrame, version: int) -> None:
        """Score a batch and append the rows."""
        self.score(batch).write.mode("overwrite").parquet(f"{self.path}/log/version={version}")

    def log(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/log")

    def archive(self, ended: DataFrame, group: int = 0) -> DataFrame:
        """Final log rows of ended entities, written next to the groups archived before; a repeated
        group replaces its own rows. Returns the whole archive."""
        done = self.log().join(ended.select("pid").distinct(), "pid", "left_semi")
        done.write.mode("overwrite").parquet(f"{self.path}/archive/group={group}")
        return self.spark.read.parquet(f"{self.path}/archive").drop("group")

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        query = (
            stream.writeStream.foreachBatch(self.refresh)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def extend_running(intervals: DataFrame, base: DataFrame, before: Column, now: Column, grid: Grid = DEFAULT_GRID) -> DataFrame:
    """Cells reached between two refreshes: new intervals and the growth of those still running.

    ``intervals(pid, ts, end_ts, …)`` with an open end while running. Cells already covered before
    may come again; as labels of a cell they are idempotent.
    """
    grown = delta_window(intervals, before, now)
    return interval_to_steps(grown, base, grid)
