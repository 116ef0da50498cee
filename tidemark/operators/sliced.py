"""Ordered per-key scans that survive a hot key.

A plain window puts all rows of one key into one task. Here every key's rows are cut into
slices by a monotone function of the order column (time or value buckets). Each slice is
scanned locally, one summary row per (key, slice) is made with map-side combine, the few
summaries are scanned per key, and the carry is joined back. The result equals the plain
window; the largest task holds one slice, not one key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timegrid import micros


def time_slice(ts: Column, width: str = "1 day") -> Column:
    """Monotone slice number of a timestamp."""
    seconds = {"hour": 3600, "day": 86400, "minute": 60}
    n, unit = width.split()
    us = int(n) * seconds[unit.rstrip("s")] * 1_000_000
    return F.floor(micros(ts) / F.lit(us))


def value_slice(value: Column, per_unit: int = 1024) -> list[Column]:
    """Monotone slice of a number: about linear near zero, logarithmic further out, so scores in
    [0, 1] get many slices and large amounts a bounded number."""
    return [F.floor(F.asinh(value) * per_unit)]


@dataclass(frozen=True)
class Scan:
    """One running aggregate: ``kind`` is sum, max, min or last (last non-null).

    ``inclusive`` says whether the current row counts; ``reverse`` scans from the end.
    """

    name: str
    kind: str
    value: Column
    inclusive: bool = True
    reverse: bool = False


def _fold(kind: str, value: Column, order: list[str]) -> Column:
    if kind in ("last", "first"):
        key = F.when(value.isNotNull(), F.struct(*[F.col(c) for c in order]))
        return F.max_by(value, key) if kind == "last" else F.min_by(value, key)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value)


def _over(kind: str, value: Column, window) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value).over(window)


def _merge(kind: str, local: Column, carry: Column) -> Column:
    if kind == "last":
        return F.coalesce(local, carry)
    if kind == "sum":
        return F.when(local.isNull() & carry.isNull(), F.lit(None)).otherwise(
            F.coalesce(local, local - local, F.lit(0)) + F.coalesce(carry, F.lit(0))
        )
    return F.greatest(local, carry) if kind == "max" else F.least(local, carry)


def sliced_scan(
    df: DataFrame, keys: list[str], order: list[str], slices: list[Column], scans: list[Scan]
) -> DataFrame:
    """Add one column per scan, equal to the window over ``keys`` ordered by ``order``.

    ``order`` must be a total order within the key and its first column must rise with the
    slices. Rows with a NULL slice are kept together in a slice of their own, first in order.
    Keys are entity ids and must not be NULL.
    """
    names = [f"__slice{i}" for i in range(len(slices))]
    df = df.withColumns({n: F.coalesce(s.cast("long"), F.lit(-(2**62))) for n, s in zip(names, slices)})

    asc = [F.col(c).asc_nulls_first() for c in order]
    desc = [F.col(c).desc_nulls_last() for c in order]
    local: dict[str, Column] = {}
    folds, carries = [], {}
    for s in scans:
        inside = Window.partitionBy(*keys, *names).orderBy(*(desc if s.reverse else asc))
        local[f"__l_{s.name}"] = _over(
            s.kind, s.value, inside.rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1)
        )
        fold_kind = "first" if s.kind == "last" and s.reverse else s.kind
        folds.append(_fold(fold_kind, s.value, order).alias(f"__f_{s.name}"))
        across = Window.partitionBy(*keys).orderBy(
            *[F.col(n).desc() if s.reverse else F.col(n).asc() for n in names]
        )
        carries[f"__c_{s.name}"] = _over(
            s.kind, F.col(f"__f_{s.name}"), across.rowsBetween(Window.unboundedPreceding, -1)
        )

    summary = df.groupBy(*keys, *names).agg(*folds)
    carry = summary.withColumns(carries).select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], *[F.col(n).alias(f"__s_{n}") for n in names], *carries.keys()
    )
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__k_{k}"))
    for n in names:
        cond = cond & (F.col(n) == F.col(f"__s_{n}"))
    joined = df.withColumns(local).join(carry, cond, "left")
    joined = joined.withColumns({s.name: _merge(s.kind, F.col(f"__l_{s.name}"), F.col(f"__c_{s.name}")) for s in scans})
    drop = [*local, *carries, *names, *[f"__k_{k}" for k in keys], *[f"__s_{n}" for n in names]]
    return joined.drop(*drop)


# ---- the usual scans over time -----------------------------------------------------------


def running_sum(df, keys, order, value: Column, name: str, width="1 day") -> DataFrame:
    return sliced_scan(df, keys, order, [time_slice(F.col(order[0]), width)], [Scan(name, "sum", value)])


def running_number(df, keys, order, name: str, width="1 day", slices=None) -> DataFrame:
    """1-based position of every row within its key."""
    return sliced_scan(
        df, keys, order, slices or [time_slice(F.col(order[0]), width)], [Scan(name, "sum", F.lit(1).cast("long"))]
    )


def forward_fill(df, keys, order, value: str, name: str, width="1 day") -> DataFrame:
    return sliced_scan(df, keys, order, [time_slice(F.col(order[0]), width)], [Scan(name, "last", F.col(value))])


def neighbour(df, keys, order, columns: dict[str, str], ahead: bool = False, width="1 day") -> DataFrame:
    """Previous (or next) row's columns; ``columns`` maps the new name to the source column."""
    row = F.struct(*[F.col(src).alias(new) for new, src in columns.items()])
    out = sliced_scan(
        df,
        keys,
        order,
        [time_slice(F.col(order[0]), width)],
        [Scan("__row", "last", row, inclusive=False, reverse=ahead)],
    )
    return out.withColumns({new: F.col("__row").getField(new) for new in columns}).drop("__row")


def numbered_runs(df, keys, order, previous: dict[str, str], starts_new, name: str, width="1 day") -> DataFrame:
    """Running number of groups, where ``starts_new()`` tells from the previous row's columns
    whether a row opens a group (no previous row: they are NULL).

    One pass instead of a lag followed by a running sum: inside a slice only its first row needs
    the row before it, and that one is the last row of an earlier slice.
    """
    row = F.struct(*[F.col(src).alias(new) for new, src in previous.items()])
    position = F.struct(*[F.col(c) for c in order])
    df = df.withColumn("__slice", time_slice(F.col(order[0]), width).cast("long"))
    inside = Window.partitionBy(*keys, "__slice").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    local = df.withColumn("__prev", F.lag(row).over(inside))
    local = local.withColumns({new: F.col("__prev").getField(new) for new in previous})
    # the first row of a slice is settled on the slice level
    opens = F.when(F.col("__prev").isNotNull(), starts_new().cast("long")).otherwise(F.lit(0))
    local = local.withColumn("__open", F.coalesce(opens, F.lit(0))).drop("__prev", *previous)

    first_row = [F.min_by(F.col(c), position).alias(c) for c in df.columns if c not in (*keys, "__slice")]
    slices = local.groupBy(*keys, "__slice").agg(F.sum("__open").alias("__n"), F.max_by(row, position).alias("__last"), *first_row)
    across = Window.partitionBy(*keys).orderBy("__slice")
    slices = slices.withColumn("__before", F.lag("__last").over(across))
    slices = slices.withColumns({new: F.col("__before").getField(new) for new in previous})
    slices = slices.withColumn("__first", F.coalesce(starts_new().cast("long"), F.lit(0)))
    total = F.sum(F.col("__n") + F.col("__first")).over(across.rowsBetween(Window.unboundedPreceding, 0))
    slices = slices.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__slice").alias("__s"), (total - F.col("__n")).alias("__base")
    )
    cond = F.col("__slice") == F.col("__s")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__k_{k}"))
    running = F.sum("__open").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    out = local.withColumn("__run", running).join(slices, cond, "left")
    out = out.withColumn(name, F.coalesce("__base", F.lit(0)) + F.col("__run"))
    return out.drop("__slice", "__open", "__run", "__s", "__base", *[f"__k_{k}" for k in keys])
