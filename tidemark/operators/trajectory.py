"""Trajectories from moves: numbering, gap collapse, tie shifts, masks and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timegrid import DEFAULT_GRID, Grid, from_micros, micros
from tidemark.operators.numbering import number_distinct
from tidemark.operators.sliced import Scan, neighbour, numbered_runs, running_sum, sliced_scan, time_slice

HOUR = 3_600_000_000


def number_admissions(moves: DataFrame, is_admission: Column, key: str = "pid", order=("ts", "event_id")) -> DataFrame:
    """Running count of admission rows per entity, carried to the rows that follow.

    Rows before the first admission get NULL. Numbering never leaks into the next entity.
    """
    out = running_sum(moves, [key], list(order), F.when(is_admission, 1).otherwise(0).cast("long"), "trajectory")
    return out.withColumn("trajectory", F.when(F.col("trajectory") > 0, F.col("trajectory")))


def mark_islands(
    stays: DataFrame, gap_hours: float, key: str = "pid", order=("start_ts", "event_id"), running_max: bool = False
) -> DataFrame:
    """Island number per row: a new one starts when ``start - previous end >= gap``.

    ``running_max`` compares with the latest end seen so far instead of the previous row's.
    A missing end keeps the island open.
    """
    order = list(order)

    def late() -> Column:
        return micros(F.col("start_ts")) - micros(F.col("__prev_end")) >= F.lit(int(gap_hours * HOUR))

    if not running_max:
        return numbered_runs(stays, [key], order, {"__prev_end": "end_ts"}, late, "island")
    seen = Scan("__prev_end", "max", F.col("end_ts"), inclusive=False)
    out = sliced_scan(stays, [key], order, [time_slice(F.col(order[0]))], [seen])
    out = out.withColumn("__new", F.when(late(), 1).otherwise(0).cast("long")).drop("__prev_end")
    return running_sum(out, [key], order, F.col("__new"), "island").drop("__new")


def collapse_islands(marked: DataFrame, key: str = "pid") -> DataFrame:
    """One row per island. Its members stay in ``marked`` (long form), not in a list per row."""
    return (
        marked.groupBy(key, "island")
        .agg(
            F.min("start_ts").alias("start_ts"),
            F.max("end_ts").alias("end_ts"),
            F.count("*").alias("n_members"),
            F.min("event_id").alias("first_member"),
            F.max("event_id").alias("last_member"),
        )
        .withColumn("duration_hours", (micros(F.col("end_ts")) - micros(F.col("start_ts"))) / F.lit(float(HOUR)))
    )


def flag_overlap(trajectories: DataFrame, key: str = "pid") -> DataFrame:
    """True when a trajectory ends after the next one starts."""
    out = neighbour(trajectories, [key], ["start_ts", "island"], {"__next": "start_ts"}, ahead=True, width="30 day")
    return out.withColumn("overlap", F.coalesce(F.col("end_ts") > F.col("__next"), F.lit(False))).drop("__next")


def shift_ties(moves: DataFrame, is_move_in: Column, ts: str = "ts") -> DataFrame:
    """Move-in rows one second later, so that equal times have a defined order."""
    return moves.withColumn(ts, F.when(is_move_in, F.col(ts) + F.expr("INTERVAL 1 SECOND")).otherwise(F.col(ts)))


def close_open_ends(moves: DataFrame, base: DataFrame, key: str = "pid") -> DataFrame:
    """Missing end := next start, else the entity's end; rows still open or empty-ended go."""
    out = neighbour(moves, [key], ["ts", "event_id"], {"__next": "ts"}, ahead=True)
    out = out.join(base.select(key, F.col("end_ts").alias("__base_end")), key, "left")
    end = F.coalesce(F.col("end_ts"), F.col("__next"), F.col("__base_end")) if "end_ts" in moves.columns else F.coalesce(
        F.col("__next"), F.col("__base_end")
    )
    return out.withColumn("end_ts", end).drop("__next", "__base_end").filter(F.col("end_ts").isNotNull())


def next_start_as_end(points: DataFrame, key: str = "pid") -> DataFrame:
    """Point events as intervals that last until the entity's next event; the last one is dropped."""
    out = neighbour(points, [key], ["ts", "event_id"], {"end_ts": "ts"}, ahead=True)
    return out.filter(F.col("end_ts").isNotNull())


def merge_adjacent(stays: DataFrame, key: str = "pid", state: str = "feature") -> DataFrame:
    """Merge touching stays in the same state (end = next start); empty stays go first."""
    alive = stays.filter(F.col("end_ts") > F.col("ts"))

    def fresh() -> Column:
        same = (F.col("__pe") == F.col("ts")) & (F.col("__ps") == F.col(state))
        return ~F.coalesce(same, F.lit(False))

    out = numbered_runs(alive, [key], ["ts", "event_id"], {"__pe": "end_ts", "__ps": state}, fresh, "run")
    return out.groupBy(key, "run", state).agg(
        F.min("ts").alias("ts"), F.max("end_ts").alias("end_ts"), F.count("*").alias("n_merged")
    )


def time_in_state(stays: DataFrame, key: str = "pid", state: str = "feature") -> DataFrame:
    hours = (micros(F.col("end_ts")) - micros(F.col("ts"))) / F.lit(float(HOUR))
    return stays.groupBy(key, state).agg(F.sum(hours).alias("hours"))


def per_minute(stays: DataFrame) -> DataFrame:
    """One row per started minute of an interval, both ends included; a missing end is the start."""
    end = F.coalesce(F.col("end_ts"), F.col("ts"))
    return stays.withColumn("minute_ts", F.explode(F.sequence(F.col("ts"), end, F.expr("INTERVAL 1 MINUTE"))))


def mask_end_of_life(
    base: DataFrame, event: Column, method: str = "percentage", min_hours: float = 0.5, event_ts: Column | None = None
) -> DataFrame:
    """Pull the end of entities with the event back, so that the last hours do not leak it.

    ``percentage`` keeps 90/95/98 % of the stay for up to 6 h / 72 h / longer; ``absolute``
    ends 10 min / 30 min / 3 h / 1 day before the event; ``drop_last_bin`` only flags.
    A masked stay never becomes shorter than ``min_hours``.
    """
    if method == "drop_last_bin":
        return base.withColumn("drop_last_bin", event)
    start, end = micros(F.col("start_ts")), micros(F.col("end_ts"))
    span = end - start
    hours = span / F.lit(float(HOUR))
    if method == "percentage":
        # Share of the stay kept by duration class.
        kept = F.when(hours <= 6, 0.9).when(hours <= 72, 0.95).otherwise(0.98)
        masked = start + F.floor(span * kept)
    elif method == "absolute":
        if event_ts is None:
            raise ValueError("absolute masking needs the event time")
        # Time cut before the event by duration class.
        cut = F.when(hours < 3, F.lit(HOUR // 6)).when(hours <= 72, F.lit(HOUR // 2))
        cut = cut.when(hours <= 168, F.lit(3 * HOUR)).otherwise(F.lit(24 * HOUR))
        masked = micros(event_ts) - cut
    else:
        raise ValueError(f"unknown method {method!r}")
    floor = start + F.lit(int(min_hours * HOUR))
    masked = F.when(masked <= floor, floor).otherwise(masked)
    return base.withColumn("end_ts", F.when(event, from_micros(masked)).otherwise(F.col("end_ts")))


def survival_labels(base: DataFrame, event_ts: str, grid: Grid = DEFAULT_GRID) -> DataFrame:
    """Event indicator within the horizon, event or censoring time, its discrete step."""
    horizon = grid.steps[-1].hi / 60.0
    to_event = (micros(F.col(event_ts)) - micros(F.col("start_ts"))) / F.lit(float(HOUR))
    to_end = (micros(F.col("end_ts")) - micros(F.col("start_ts"))) / F.lit(float(HOUR))
    indicator = F.coalesce(to_event <= horizon, F.lit(False))
    hours = F.greatest(F.when(indicator, to_event).otherwise(F.least(to_end, F.lit(horizon))), F.lit(0.0))
    out = base.withColumn("event_indicator", indicator.cast("int")).withColumn("event_time_hours", hours)
    step = F.coalesce(grid.time_to_step(F.col("event_time_hours") * 60), F.lit(0))
    return out.withColumn("event_time_steps", F.least(step, F.lit(grid.total_steps - 1)))


def static_labels(base: DataFrame, birth: str, death: str, second_start: str | None = None) -> DataFrame:
    """Stay length in days, age in whole years, death within 30 and 90 days, site flag."""
    day = 24 * HOUR
    span = lambda a, b: micros(F.col(a)) - micros(F.col(b))
    out = base.withColumns(
        {
            "duration_days": span("end_ts", "start_ts") / F.lit(float(day)),
            "age": F.floor(F.floor(span("start_ts", birth) / F.lit(day)) / 365.25).cast("int"),
            "deceased_30d": F.coalesce((span(death, "start_ts") <= 30 * day).cast("int"), F.lit(0)),
            "deceased_90d": F.coalesce((span(death, "start_ts") <= 90 * day).cast("int"), F.lit(0)),
        }
    )
    if second_start:
        out = out.withColumn("site_flag", F.col(second_start).isNotNull().cast("int"))
    return out


def boundary_step(base: DataFrame, second_start: str, grid: Grid = DEFAULT_GRID) -> DataFrame:
    """Step at which a second start time falls; NULL when it is not after the start."""
    minutes = (micros(F.col(second_start)) - micros(F.col("start_ts"))) / F.lit(60_000_000.0)
    return base.withColumn("boundary_step", F.when(minutes > 0, grid.time_to_step(minutes)))


def enumerate_ids(df: DataFrame, keys: list[str], name: str = "pid") -> DataFrame:
    """Dense 1-based id per distinct key tuple, in key order."""
    return df.join(number_distinct(df, keys, name), keys)


def composed_id(key: Column, ts: Column) -> Column:
    """First eight characters of the key plus the date."""
    return F.concat(F.substring(key, 1, 8), F.date_format(ts, "yyyyMMdd"))


def finish_base(base: DataFrame) -> DataFrame:
    """Complete intervals only, one row per pid, one row per (key, start, end): lowest pid wins."""
    whole = base.filter(F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull())
    rest = [c for c in base.columns if c not in ("pid", "start_ts", "end_ts")]
    per_pid = whole.groupBy("pid").agg(F.min(F.struct("start_ts", "end_ts", *rest)).alias("m")).select("pid", "m.*")
    others = [c for c in rest if c != "key"]
    per_span = per_pid.groupBy("key", "start_ts", "end_ts").agg(F.min(F.struct("pid", *others)).alias("m"))
    return per_span.select("key", "start_ts", "end_ts", "m.*")


def first_contacts(moves: DataFrame, base: DataFrame, site: Column, main_site: Column) -> DataFrame:
    """First contact per episode, first contact at the site, delay, and a visit label.

    ``moves(key, ts, unit, event_id)``; ``site`` and ``main_site`` are conditions on moves.
    """
    from tidemark.operators.joins import range_join

    inside = range_join(moves, base, ["key"], "ts", F.col("start_ts"), F.col("end_ts"))
    out = inside.groupBy("key", "start_ts").agg(
        F.min_by(F.struct("unit", main_site.alias("main")), F.struct("ts", "event_id")).alias("f"),
        F.min(F.when(site, F.col("ts"))).alias("first_site"),
    )
    out = out.select("key", "start_ts", F.col("f.unit").alias("first_unit"), F.col("f.main").alias("main"), "first_site")
    out = out.withColumn(
        "hours_to_site", (micros(F.col("first_site")) - micros(F.col("start_ts"))) / F.lit(float(HOUR))
    )
    # Labels of the visit type.
    label = F.when(F.col("main"), "primær").when(F.col("first_site").isNotNull(), "sekundær").otherwise("primær ingen RH")
    return out.withColumn("visit_type", label).drop("main")


def generated_transport(base: DataFrame, sources: DataFrame) -> DataFrame:
    """Interval events ``[source start, in-house start)`` labelled by their source; empty ones go."""
    out = sources.join(base.select("pid", "start_ts"), "pid")
    out = out.select(
        "pid",
        F.col("source_start").alias("ts"),
        F.col("start_ts").alias("end_ts"),
        F.concat(F.lit("PREHOSP_"), F.upper("source")).alias("value"),
    )
    return out.filter(F.col("ts") < F.col("end_ts"))


