"""Time-aware joins, planned as equi-joins on time buckets so that no key is multiplied out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timegrid import micros
from tidemark.operators.sliced import Scan, sliced_scan, time_slice
from tidemark.session import spread


def days_before(ts: Column, n: int) -> Column:
    return ts - F.make_dt_interval(days=F.lit(n))


def days_after(ts: Column, n: int) -> Column:
    return ts + F.make_dt_interval(days=F.lit(n))


def range_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    ts: str,
    lo: Column,
    hi: Column,
    bucket: str | None = "1 day",
) -> DataFrame:
    """Inner join of points to the intervals of the same keys that contain them, ``[lo, hi]``.

    Intervals are exploded to the time buckets they touch, points have one bucket, and the
    join runs on (keys, bucket). Each match is found exactly once, a hot key is spread over
    its buckets, and only pairs near in time are compared. The bucket should be of the order of
    the intervals. With ``bucket=None`` (keys with one interval each) it is a plain equi-join: no
    point meets more than one interval, and AQE splits a hot key's points.
    """
    if bucket is None:
        one = intervals.withColumn("__lo", lo).withColumn("__hi", hi)
        return points.join(one, keys).filter(F.col(ts).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")
    spread = (
        intervals.withColumn("__lo", lo)
        .withColumn("__hi", hi)
        .filter(F.col("__lo") <= F.col("__hi"))
        .withColumn(
            "__b", F.explode(F.sequence(time_slice(F.col("__lo"), bucket), time_slice(F.col("__hi"), bucket)))
        )
    )
    out = points.withColumn("__b", time_slice(F.col(ts), bucket)).join(spread, [*keys, "__b"])
    return out.filter(F.col(ts).between(F.col("__lo"), F.col("__hi"))).drop("__b", "__lo", "__hi")


def in_stay(events: DataFrame, base: DataFrame, offset_days: int = 1, key: str = "pid", bucket: str | None = None) -> DataFrame:
    """Events within ``[start - d, end + d]`` days of a stay, distinct. Give a ``bucket`` when a key
    has several stays. Copies are found by the whole row, apart from the join, so that a task holds neither
    all rows of a key nor those of a merged partition of the join."""
    out = range_join(
        events,
        base,
        [key],
        "ts",
        days_before(F.col("start_ts"), offset_days),
        days_after(F.col("end_ts"), offset_days),
        bucket,
    )
    out = out.drop("start_ts", "end_ts")
    return spread(out, *out.columns).distinct()


def match_episodes(references: DataFrame, episodes: DataFrame, date: str, offset_days: int = 1) -> DataFrame:
    """Reference rows joined to the episode whose padded span holds their date, distinct."""
    return range_join(
        references,
        episodes,
        ["key"],
        date,
        days_before(F.col("start_ts"), offset_days),
        days_after(F.col("end_ts"), offset_days),
    ).distinct()


def nearest_date_match(
    left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str, payload: list[str], window: int = 2
) -> DataFrame:
    """For each left row the right row of the same key within +-window days.

    Preference: smaller offset, then before ahead of after. The date windows are exploded to
    equi-join keys; the right side is reduced to one row per (key, date) first.
    """
    r = last_per_date(right, key, right_date, payload)
    offsets = left.withColumn("__off", F.explode(F.sequence(F.lit(-window), F.lit(window)))).withColumn(
        "__d", F.date_add(F.col(left_date).cast("date"), F.col("__off"))
    )
    hits = offsets.join(
        r.select(F.col(key), F.col("__date").alias("__d"), F.struct(*payload).alias("__p")), [key, "__d"]
    )
    best = hits.groupBy(*left.columns).agg(
        F.min(F.struct(F.abs("__off").alias("a"), F.col("__off").alias("o"), F.col("__p").alias("p"))).alias("__m")
    )
    found = best.select(
        *[F.col(c).alias(f"__k_{c}") for c in left.columns],
        F.col("__m.o").alias("offset_days"),
        *[F.col("__m.p").getField(c).alias(c) for c in payload],
    )
    cond = F.lit(True)
    for c in left.columns:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    return left.join(found, cond, "left").drop(*[f"__k_{c}" for c in left.columns])


def last_per_date(df: DataFrame, key: str, date: str, payload: list[str]) -> DataFrame:
    """Registry de-duplication: the latest record per (key, calendar date), by max of a struct."""
    rest = [c for c in payload if c != date]
    newest = F.max(F.struct(F.col(date).alias("__t"), *rest)).alias("__m")
    out = df.withColumn("__date", F.col(date).cast("date")).groupBy(key, "__date").agg(newest)
    return out.select(
        key,
        "__date",
        *[F.col("__m.__t").alias(c) if c == date else F.col("__m").getField(c).alias(c) for c in payload],
    )


def as_of(
    points: DataFrame, marks: DataFrame, keys: list[str], at: str, mark_at: str, value: str, width: Column | float
) -> DataFrame:
    """Backward as-of: the latest non-null mark at or before each point.

    Both sides are stacked and the last mark is carried forward, slice by slice, so that an
    entity with very many points is not one task. ``at``/``mark_at`` are numeric times.
    """
    other = [c for c in points.columns if c not in (*keys, at)]
    p = points.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*other).alias("__row"), F.lit(None).cast(marks.schema[value].dataType).alias("__v"))
    m = marks.select(*keys, F.col(mark_at).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(p.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"))
    both = p.unionByName(m)
    order = ["__t", "__side"]
    scanned = sliced_scan(both, keys, order, [F.floor(F.col("__t") / width)], [Scan("__asof", "last", F.col("__v"))])
    kept = scanned.filter(F.col("__side") == 1)
    return kept.select(*keys, F.col("__t").alias(at), *[F.col("__row").getField(c).alias(c) for c in other], F.col("__asof").alias(value))


def closest_value(
    base: DataFrame, events: DataFrame, key: str, base_ts: str, ts: str, value: str, lo_days: float, hi_days: float
) -> DataFrame:
    """Value nearest to each base row's time within ``[lo, hi]`` days of it (signed)."""
    day = 86_400_000_000
    left = base.select(key, base_ts).distinct()
    pad_lo = F.expr(f"make_dt_interval(0, 0, 0, {abs(lo_days) * 86400:.6f})")
    pad_hi = F.expr(f"make_dt_interval(0, 0, 0, {abs(hi_days) * 86400:.6f})")
    lo = F.col(base_ts) - pad_lo if lo_days < 0 else F.col(base_ts) + pad_lo
    hi = F.col(base_ts) + pad_hi if hi_days >= 0 else F.col(base_ts) - pad_hi
    near = range_join(events.select(key, ts, value), left, [key], ts, lo, hi)
    delta = micros(F.col(ts)) - micros(F.col(base_ts))
    near = near.withColumn("__d", delta / F.lit(float(day)))
    best = near.groupBy(key, base_ts).agg(
        F.min(F.struct(F.abs("__d").alias("a"), F.col("__d").alias("d"), F.col(value).alias("v"))).alias("m")
    )
    best = best.select(key, base_ts, F.col("m.v").alias(value), F.col("m.d").alias("delta_days"))
    return base.join(best, [key, base_ts], "left")


def full_merge(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """Full outer merge of component frames on an id, as one union and one aggregation
    (each component holds one row per id)."""
    stacked = None
    for name, df in frames.items():
        row = df.select(key, F.lit(name).alias("part"), F.col(name).alias("v"))
        stacked = row if stacked is None else stacked.unionByName(row)
    return stacked.groupBy(key).agg(*[F.max(F.when(F.col("part") == n, F.col("v"))).alias(n) for n in frames])


def fallback_union(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """Primary rows plus the secondary rows of ids the primary does not know."""
    ids = primary.select(key).distinct()
    return primary.unionByName(secondary.join(ids, key, "left_anti"))


def id_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many ids are on both sides, only left, only right."""
    tagged = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    sides = tagged.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    side = F.when((F.col("l") == 1) & (F.col("r") == 1), "both").when(F.col("l") == 1, "left_only").otherwise("right_only")
    return sides.groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def align_columns(df: DataFrame, columns: list[str], fill) -> DataFrame:
    """Exactly ``columns`` in order; missing ones are filled, extra ones dropped."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in columns])


def snap_times(requested: DataFrame, available: list[float], column: str) -> DataFrame:
    """Nearest available time of each requested one (earlier on ties), de-duplicated."""
    pairs = F.array(*[F.lit(float(a)) for a in available])
    nearest = F.array_min(F.transform(pairs, lambda a: F.struct(F.abs(a - F.col(column)).alias("d"), a.alias("t"))))
    return requested.select(nearest["t"].alias(column)).distinct()


def attach_static(series: DataFrame, static: DataFrame, key: str = "pid") -> DataFrame:
    """Left join of one static row per id; a repeated id raises instead of fanning out."""
    checked = static.groupBy(key).agg(
        F.count("*").alias("__n"), *[F.any_value(c).alias(c) for c in static.columns if c != key]
    )
    checked = checked.withColumn(
        "__ok", F.when(F.col("__n") > 1, F.raise_error(F.lit("static side repeats an id"))).otherwise(F.lit("ok"))
    )
    return series.join(checked, key, "left").filter(F.col("__ok").isNull() | (F.col("__ok") == "ok")).drop("__ok", "__n")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], columns: list[str], last: bool = False) -> DataFrame:
    """First (or last) row per key by order, as an aggregate with map-side combine."""
    names = [f"__o{i}" for i in range(len(order))]
    pick = F.max if last else F.min
    packed = F.struct(*[o.alias(n) for o, n in zip(order, names)], *columns)
    out = df.groupBy(*keys).agg(pick(packed).alias("__m"))
    return out.select(*keys, *[F.col("__m").getField(c).alias(c) for c in columns])


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """Top k rows per key; Spark trims every input partition to k rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
