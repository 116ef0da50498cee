"""Cohort rules with attrition, refilters, windows and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.classify import rule
from tidemark.functions.timegrid import DEFAULT_GRID, Grid, micros

HOUR = 3_600_000_000


def criteria_rules(criteria: dict, grid: Grid = DEFAULT_GRID) -> list[tuple[str, Column]]:
    """Named conditions, in order, from a criteria dict; unset keys are skipped.

    Columns: ``age, service_ts, site_flag, pre_start, keyword, keyword_12h, duration_days,
    start_ts, end_ts, first_hospital, pid``.
    """
    out: list[tuple[str, Column]] = []

    def number(key):
        v = criteria.get(key)
        return isinstance(v, (int, float)) and not isinstance(v, bool)

    if number("age_min"):
        out.append(("age_min", F.col("age") >= criteria["age_min"]))
    if number("age_max"):
        out.append(("age_max", F.col("age") <= criteria["age_max"]))
    if number("start_year"):
        out.append(("start_year", F.year("service_ts") >= criteria["start_year"]))
    if number("end_year"):
        out.append(("end_year", F.year("service_ts") <= criteria["end_year"]))
    if criteria.get("site_only"):
        out.append(("site_only", F.col("site_flag") == 1))
    if criteria.get("prehospital_only"):
        out.append(("prehospital_only", F.col("pre_start").isNotNull()))
    if criteria.get("keyword"):
        out.append(("keyword", F.col("keyword")))
    if criteria.get("keyword_12h"):
        out.append(("keyword_12h", F.col("keyword_12h")))
    if number("max_duration_days"):
        out.append(("max_duration_days", F.col("duration_days") <= criteria["max_duration_days"]))
    if number("min_steps") and criteria["min_steps"] > 0:
        minutes = (micros(F.col("end_ts")) - micros(F.col("start_ts"))) / F.lit(60_000_000.0)
        # a stay past the horizon fills the whole grid, an empty one has no step
        n = F.when(minutes <= 0, 0).otherwise(F.coalesce(grid.time_to_step(minutes) + 1, F.lit(grid.total_steps)))
        out.append(("min_steps", n >= criteria["min_steps"]))
    sites = [s for s in criteria.get("first_hospital") or [] if s is not None]
    if sites:
        out.append(("first_hospital", F.col("first_hospital").isin(*sites)))
    for f in criteria.get("custom_filters") or []:
        out.append((f"{f['column']} {f['op']}", rule(f["column"], f["op"], f["value"])))
    return [(name, F.coalesce(cond, F.lit(False))) for name, cond in out]


def apply_criteria(base: DataFrame, rules: list[tuple[str, Column]], ids: DataFrame | None = None) -> DataFrame:
    """Rows that meet every rule, and are in ``ids`` when given."""
    out = base
    for _, cond in rules:
        out = out.filter(cond)
    return out if ids is None else out.join(ids.select("pid").distinct(), "pid", "left_semi")


def attrition(base: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Rows lost to each rule in order, in one pass: ``(position, rule, excluded, remaining)``."""
    alive = F.lit(True)
    aggs = []
    for i, (_, cond) in enumerate(rules):
        aggs.append(F.sum((alive & ~cond).cast("long")).alias(f"x{i}"))
        alive = alive & cond
        aggs.append(F.sum(alive.cast("long")).alias(f"r{i}"))
    one = base.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("rule"),
                F.coalesce(f"x{i}", F.lit(0)).alias("excluded"),
                F.coalesce(f"r{i}", F.lit(0)).alias("remaining"),
            )
            for i, (name, _) in enumerate(rules)
        ]
    )
    return one.select(F.explode(rows).alias("s")).select("s.*")


def refilter(table: DataFrame, survivors: DataFrame, key: str = "pid") -> DataFrame:
    return table.join(survivors.select(key).distinct(), key, "left_semi")


def elapsed_window(events: DataFrame, hours: float) -> DataFrame:
    """Events with elapsed hours since the start in ``[0, w]``; needs ``start_ts``."""
    h = (micros(F.col("ts")) - micros(F.col("start_ts"))) / F.lit(float(HOUR))
    return events.withColumn("elapsed_hours", h).filter((h >= 0) & (h <= hours))


def landmark_mask(events: DataFrame, starts: DataFrame, hours: float) -> DataFrame:
    """Events up to ``start + hours``; entities without a start use their first event."""
    first = events.groupBy("pid").agg(F.min("ts").alias("__first"))
    anchor = first.join(starts.select("pid", "start_ts"), "pid", "left")
    anchor = anchor.select("pid", F.coalesce("start_ts", "__first").alias("__anchor"))
    limit = F.col("__anchor") + F.expr(f"make_dt_interval(0, 0, 0, {hours * 3600:.6f})")
    return events.join(anchor, "pid").filter(F.col("ts") <= limit).drop("__anchor")


def snapshot(events: DataFrame, cutoff: Column) -> DataFrame:
    """What was known at a cutoff: points up to it; intervals begun by it, ends clamped."""
    out = events.filter(F.col("ts") <= cutoff)
    if "end_ts" in events.columns:
        out = out.withColumn("end_ts", F.least(F.coalesce("end_ts", cutoff), cutoff))
    return out


def delta_window(events: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """What changed in ``(lo, hi]``: new points; new or still running intervals, ends clamped."""
    new = (F.col("ts") > lo) & (F.col("ts") <= hi)
    if "end_ts" not in events.columns:
        return events.filter(new)
    running = (F.col("ts") <= lo) & (F.coalesce("end_ts", hi) > lo)
    return events.filter(new | running).withColumn("end_ts", F.least(F.coalesce("end_ts", hi), hi))
