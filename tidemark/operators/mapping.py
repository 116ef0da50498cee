"""Events onto the grid: cell assignment, per-cell aggregates, back-join to the full grid.

Frames: ``events(pid, ts, feature, value[, end_ts, sub_code, event_id])`` and
``base(pid, start_ts, end_ts)`` with one row per entity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timegrid import DEFAULT_GRID, MINUTE, Grid, from_micros, micros

CELL = ["pid", "step", "feature"]


def entity_span(events: DataFrame) -> DataFrame:
    """Base frame of the first and last event per entity (partial aggregation, no window)."""
    return events.groupBy("pid").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


def lay_grid(base: DataFrame, grid: Grid = DEFAULT_GRID, included_only: bool = True) -> DataFrame:
    """Grid rows of every entity: ``pid, step, bin_start, bin_end, bin_counter, bin_freq``.

    Positions are exploded and their edges read from literal arrays, so no join is planned. A
    cell exists when it ends within ``end + margin``; the open tail continues in whole cells.
    """
    cells = grid.steps if included_only else grid.cells
    n = len(cells)
    start = micros(F.col("start_ts"))
    room = micros(F.col("end_ts")) + F.lit(grid.margin * MINUTE) - start
    last = F.lit(n - 1)
    at = F.col("__i")
    inside = at < n
    slot = F.least(at, F.lit(n - 1)) + 1

    def pick(values):
        return F.element_at(F.lit(values), slot)

    lo, hi = pick([c.lo for c in cells]).cast("long"), pick([c.hi for c in cells]).cast("long")
    label = pick([c.label for c in cells])
    tail = grid.tail
    if tail is not None and not included_only:
        more = F.floor((room - tail.lo * MINUTE) / F.lit(tail.width * MINUTE)).cast("int")
        last = last + F.greatest(more, F.lit(0))
        past = (at - n).cast("long")
        lo = F.when(inside, lo).otherwise(tail.lo + past * tail.width)
        hi = F.when(inside, hi).otherwise(tail.lo + (past + 1) * tail.width)
        label = F.when(inside, label).otherwise(F.lit(tail.label))
    out = base.filter(F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull())
    out = out.select("pid", start.alias("__s"), room.alias("__room"), F.explode(F.sequence(F.lit(0), last)).alias("__i"))
    out = out.select(
        "pid",
        "__s",
        "__room",
        F.when(inside, pick([c.step for c in cells])).otherwise(F.lit(-1)).alias("step"),
        F.when(inside, pick([c.counter for c in cells])).otherwise(at + 1).alias("bin_counter"),
        (lo * MINUTE).alias("__lo"),
        (hi * MINUTE).alias("__hi"),
        label.alias("bin_freq"),
    ).filter(F.col("__hi") <= F.col("__room"))
    out = out.select(
        "pid",
        "step",
        from_micros(F.col("__s") + F.col("__lo")).alias("bin_start"),
        from_micros(F.col("__s") + F.col("__hi")).alias("bin_end"),
        "bin_counter",
        "bin_freq",
    )
    return out if included_only else out.drop("step")


def drop_last_cell(grid_rows: DataFrame, flagged: DataFrame) -> DataFrame:
    """Remove the last cell of flagged entities (``flagged``: pid)."""
    last = grid_rows.groupBy("pid").agg(F.max("bin_counter").alias("__last"))
    marks = last.join(flagged.select("pid").distinct(), "pid", "left_semi")
    return (
        grid_rows.join(marks, "pid", "left")
        .filter(F.col("__last").isNull() | (F.col("bin_counter") < F.col("__last")))
        .drop("__last")
    )


# ---- assignment ------------------------------------------------------------------------


def with_start(events: DataFrame, base: DataFrame, extra: Iterable[str] = ()) -> DataFrame:
    """Attach the entity's start. One base row per entity; AQE broadcasts it when its measured
    size allows and splits hot partitions of the event side otherwise."""
    return events.join(base.select("pid", "start_ts", *extra), "pid")


def point_to_step(events: DataFrame, base: DataFrame, grid: Grid = DEFAULT_GRID) -> DataFrame:
    """Half-open point assignment in closed form; events outside the grid are dropped."""
    out = with_start(events, base).withColumn("step", grid.step_of(F.col("ts"), F.col("start_ts")))
    return out.filter(F.col("step").isNotNull()).drop("start_ts")


def point_to_step_closed(events: DataFrame, base: DataFrame, grid: Grid = DEFAULT_GRID) -> DataFrame:
    """Closed variant ``[lo, hi]``: a point on an inner edge belongs to both cells."""
    out = with_start(events, base)
    right = grid.step_of(F.col("ts"), F.col("start_ts"))
    left = grid.last_step_before(F.col("ts"), F.col("start_ts"))
    lo, hi = grid.bounds(left)
    touches = (micros(F.col("ts")) - micros(F.col("start_ts"))) <= hi.cast("long") * MINUTE
    steps = F.array_distinct(F.array_compact(F.array(F.when(touches, left), right)))
    return out.withColumn("step", F.explode(steps)).drop("start_ts")


def interval_to_steps(intervals: DataFrame, base: DataFrame, grid: Grid = DEFAULT_GRID) -> DataFrame:
    """One row per cell overlapped by ``[ts, end_ts]`` (strict on both sides)."""
    out = with_start(intervals, base)
    first = grid.first_step_after(F.col("ts"), F.col("start_ts"))
    last = grid.last_step_before(F.col("end_ts"), F.col("start_ts"))
    out = out.withColumn("__a", first).withColumn("__b", last).filter(F.col("__a") <= F.col("__b"))
    return out.withColumn("step", F.explode(F.sequence("__a", "__b"))).drop("__a", "__b", "start_ts")


# ---- aggregation -----------------------------------------------------------------------


def _ordered(value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(F.col("ts"), F.col("event_id")))


def _value() -> Column:
    return F.col("value")


# name -> Column builder; unknown names fall back to the mean
CONTINUOUS: dict[str, Callable[[], Column]] = {
    "first": lambda: F.min_by(_value(), _ordered(_value())),
    "last": lambda: F.max_by(_value(), _ordered(_value())),
    "mean": lambda: F.avg(_value()),
    "min": lambda: F.min(_value()),
    "max": lambda: F.max(_value()),
    "std": lambda: F.stddev_samp(_value()),
    "sum": lambda: F.sum(_value()),
    "count": lambda: F.count(_value()),
}


def aggregate_column(name: str) -> Column:
    return CONTINUOUS.get(name, CONTINUOUS["mean"])().alias(name)


def aggregate_cells(mapped: DataFrame, functions: Iterable[str], keys: Iterable[str] = CELL) -> DataFrame:
    """All aggregate functions of all features in one grouped job.

    ``first``/``last`` need a tie break: rows are ordered by ``ts`` then ``event_id``.
    """
    keep = mapped.filter(F.col("value").isNotNull())
    return keep.groupBy(*keys).agg(*[aggregate_column(f) for f in functions])


def multi_label_cells(mapped: DataFrame, sub_code: bool = False) -> DataFrame:
    """Distinct labels per cell."""
    cols = ["pid", "step", "feature", "value"] + (["sub_code"] if sub_code else [])
    return mapped.select(*cols).distinct()


def single_label_cells(mapped: DataFrame, how: str = "last") -> DataFrame:
    """One label per cell: the most frequent (smallest on ties), the first or the last."""
    if how == "mode":
        counted = mapped.filter(F.col("value").isNotNull()).groupBy(*CELL, "value").agg(F.count("*").alias("n"))
        # min over (-n, value): the largest count, then the smallest label
        return counted.groupBy(*CELL).agg(F.min(F.struct(-F.col("n"), F.col("value"))).getField("value").alias("value"))
    pick = F.min_by if how == "first" else F.max_by
    return (
        mapped.filter(F.col("value").isNotNull())
        .groupBy(*CELL)
        .agg(pick("value", F.struct("ts", "event_id")).alias("value"))
    )


def to_full_grid(cells: DataFrame, base: DataFrame, grid: Grid = DEFAULT_GRID) -> DataFrame:
    """All grid cells of all entities; cells without data stay once with NULLs.

    Rows of occupied cells whose feature or value is NULL are placeholders and go.
    """
    value_cols = [c for c in cells.columns if c not in CELL]
    laid = lay_grid(base, grid).select("pid", "step", "bin_start", "bin_end")
    joined = laid.join(cells, ["pid", "step"], "left")
    filled = F.col("feature").isNotNull() & F.coalesce(*[F.col(c).isNotNull() for c in value_cols])
    occupied = F.max(F.when(F.col("feature").isNotNull(), 1).otherwise(0)).over(Window.partitionBy("pid", "step"))
    return joined.withColumn("__o", occupied).filter((F.col("__o") == 0) | filled).drop("__o")


def map_concept(
    events: DataFrame,
    base: DataFrame,
    functions: Iterable[str] = ("mean",),
    grid: Grid = DEFAULT_GRID,
    kind: str = "continuous",
    full_grid: bool = False,
) -> DataFrame:
    """Whole-concept mapping: every feature and function of a concept in one job.

    Events with an ``end_ts`` are spread over the cells they overlap, others are points.
    """
    assign = interval_to_steps if "end_ts" in events.columns else point_to_step
    mapped = assign(events, base, grid)
    if kind == "multi_label":
        cells = multi_label_cells(mapped, "sub_code" in events.columns)
    elif kind == "single_label":
        cells = single_label_cells(mapped, list(functions)[0])
    else:
        cells = aggregate_cells(mapped, functions)
    return to_full_grid(cells, base, grid) if full_grid else cells


def explode_labels(cells: DataFrame, column: str = "value") -> DataFrame:
    """List cells to one row per label; empty and NULL cells are kept."""
    return cells.withColumn(column, F.explode_outer(column))


def scaffold(ids: DataFrame, features: list[str], key: str = "pid") -> DataFrame:
    """All ids x a known feature list, by exploding a literal array."""
    return ids.select(key).distinct().withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))


def spread_cells(series: DataFrame, cells: DataFrame, columns: list[str], n_steps: int) -> DataFrame:
    """Every step of every series ``(pid, feature)``, with the cell's columns where there is one.

    The cells of a series (at most one per grid step) are packed into a map and joined once per
    series; the steps are exploded afterwards, so the dense rows are never shuffled and stay
    partitioned by series for a window that follows.
    """
    entry = F.struct("step", F.struct(*columns).alias("c"))
    packed = cells.groupBy("pid", "feature").agg(F.map_from_entries(F.collect_list(entry)).alias("__m"))
    out = series.select("pid", "feature").join(packed, ["pid", "feature"], "left")
    out = out.select("pid", "feature", "__m", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1))).alias("step"))
    cell = F.try_element_at("__m", F.col("step"))
    out = out.withColumn("__c", cell).drop("__m")
    return out.select("pid", "feature", "step", *[F.col("__c").getField(c).alias(c) for c in columns])


def fill_forward(cells: DataFrame, columns: Iterable[str], keys=("pid", "feature"), order: str = "step") -> DataFrame:
    """Carry values along the steps of a series. A series has at most one row per grid cell,
    so its window is bounded by the grid."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
