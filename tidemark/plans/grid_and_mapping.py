"""Grid, cell assignment, per-cell aggregates, forward fill; the flagship query."""

from pyspark.sql import functions as F

from tidemark.functions.timegrid import DEFAULT_GRID, Grid, elapsed_minutes, micros
from tidemark.operators import mapping as m
from tidemark.operators import trajectory as tr
from tidemark.plans.registry import query, rounded, with_

FEATURES = ["click", "error", "purchase", "signup", "view"]


@query(
    "flagship",
    f"""{with_("ev", "base", "seg", "grid", "mapped")},
    agg AS (SELECT pid, step, feature, avg(value) mean, stddev_samp(value) std, max(value) AS mx, count(value) AS n
      FROM mapped GROUP BY 1, 2, 3),
    scaf AS (SELECT pid, feature, step FROM base, (SELECT DISTINCT feature FROM ev), grid)
    SELECT s.pid, s.feature, s.step, round(a.mean, 6) AS mean, round(a.std, 6) AS std, a.mx AS max,
      coalesce(a.n, 0) AS count,
      round(last_value(a.mean IGNORE NULLS) OVER w, 6) AS mean_filled
    FROM scaf s LEFT JOIN agg a USING (pid, feature, step)
    WINDOW w AS (PARTITION BY s.pid, s.feature ORDER BY s.step ROWS UNBOUNDED PRECEDING)""",
)
def flagship(t):
    """Events to cells, four aggregates, all cells present, mean carried forward."""
    cells = m.map_concept(t.ev, t.base, ["mean", "std", "max", "count"])
    series = m.scaffold(t.base, FEATURES)
    out = m.spread_cells(series, cells, ["mean", "std", "max", "count"], DEFAULT_GRID.total_steps)
    out = out.withColumn("mean_filled", F.col("mean"))
    out = m.fill_forward(out, ["mean_filled"]).withColumn("count", F.coalesce("count", F.lit(0)))
    return rounded(out)


@query(
    "c2_point_to_bin",
    f"{with_('ev', 'base', 'seg', 'grid', 'mapped')} SELECT pid, ts, feature, value, event_id, k, step FROM mapped",
)
def c2(t):
    return m.point_to_step(t.ev, t.base)


@query(
    "c3_point_to_bin_closed",
    f"""{with_("ev", "base", "seg", "grid")},
    shifted AS (SELECT pid, date_trunc('minute', ts) AS ts, feature, event_id FROM ev),
    b2 AS (SELECT pid, date_trunc('minute', start_ts) AS start_ts FROM base)
    SELECT e.pid, e.ts, e.feature, e.event_id, g.step FROM shifted e JOIN b2 USING (pid) JOIN grid g
      ON epoch_us(e.ts) - epoch_us(start_ts) >= g.lo * 60000000 AND epoch_us(e.ts) - epoch_us(start_ts) <= g.hi * 60000000""",
)
def c3(t):
    """Closed cells on whole minutes, so that many events sit exactly on an edge."""
    ev = t.ev.select("pid", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"), "feature", "event_id")
    base = t.base.withColumn("start_ts", F.date_trunc("minute", "start_ts").cast("timestamp_ntz"))
    return m.point_to_step_closed(ev, base)


@query(
    "c4_interval_to_bins",
    f"""{with_("ev", "base", "seg", "grid", "nexts")}
    SELECT n.pid, n.feature, n.event_id, g.step FROM nexts n JOIN base USING (pid) JOIN grid g
      ON epoch_us(n.ts) - epoch_us(base.start_ts) < g.hi * 60000000 AND epoch_us(n.end_ts) - epoch_us(base.start_ts) > g.lo * 60000000
    WHERE n.end_ts IS NOT NULL""",
)
def c4(t):
    """Intervals (event to next event) spread over the cells they overlap."""
    stays = tr.next_start_as_end(t.ev)
    return m.interval_to_steps(stays, t.base).select("pid", "feature", "event_id", "step")


@query(
    "d6_grid",
    """WITH base AS (SELECT user_id AS pid, min(ts) AS start_ts, max(ts) AS end_ts FROM events GROUP BY 1),
    edges(n, lo, hi, lab) AS (
      SELECT CAST(row_number() OVER (ORDER BY lo) AS INT), lo, hi, lab FROM (
        SELECT s + i*f AS lo, s + (i+1)*f AS hi, lab FROM (VALUES (0,360,10,'10min'),(360,720,20,'20min'),(720,1440,60,'1h'),
          (1440,4320,240,'4h'),(4320,20160,720,'12h'),(20160,43200,1440,'1D'),(43200,129600,10080,'7D')) v(s,e,f,lab),
          UNNEST(generate_series(0, (e-s)//f - 1)) u(i)))
    SELECT pid, n AS bin_counter, lab AS bin_freq, start_ts + to_minutes(lo) AS bin_start, start_ts + to_minutes(hi) AS bin_end
    FROM base JOIN edges ON start_ts + to_minutes(hi) <= end_ts + to_days(30)""",
)
def d6(t):
    """Every cell of every user, excluded widths too."""
    return m.lay_grid(t.base, included_only=False)


@query(
    "d6_open_tail",
    """WITH stay AS (SELECT o_custkey AS pid, min(o_orderdate) AS start_ts, max(o_orderdate) AS end_ts FROM orders GROUP BY 1),
    tail AS (SELECT pid, start_ts, end_ts, u.k AS k FROM stay,
      UNNEST(generate_series(0, date_diff('day', start_ts, end_ts) // 30 + 2)) u(k))
    SELECT pid, CAST(124 + k + 1 AS INT) AS bin_counter, start_ts + to_days(CAST(86 + 30 * k AS INT)) AS bin_start,
      start_ts + to_days(CAST(116 + 30 * k AS INT)) AS bin_end FROM tail
    WHERE start_ts + to_days(CAST(116 + 30 * k AS INT)) <= end_ts + to_days(30)""",
)
def d6_tail(t):
    """The open tail of long stays: 30-day cells from the last closed edge (day 86)."""
    rows = m.lay_grid(t.stay, included_only=False)
    return rows.filter(F.col("bin_freq") == "30D").select("pid", "bin_counter", "bin_start", "bin_end")


@query(
    "d7_grid_drop_last",
    f"""{with_("base", "seg", "grid")},
    flag AS (SELECT DISTINCT user_id AS pid FROM events WHERE event_type = 'error' AND value > 200),
    laid AS (SELECT pid, step, start_ts + to_minutes(lo) AS bin_start, max(step) OVER (PARTITION BY pid) AS last
      FROM base, grid)
    SELECT pid, step, bin_start FROM laid WHERE step < last OR pid NOT IN (SELECT pid FROM flag)""",
)
def d7(t):
    flagged = t.ev.filter((F.col("feature") == "error") & (F.col("value") > 200))
    return m.drop_last_cell(m.lay_grid(t.base), flagged).select("pid", "step", "bin_start")


@query(
    "d8_time_to_step",
    f"""{with_("ev", "base")},
    e AS (SELECT event_id, (epoch_us(ts) - epoch_us(start_ts)) / 60000000.0 AS x FROM ev JOIN base USING (pid))
    SELECT event_id, CAST(CASE WHEN x <= 0 THEN 0 WHEN x <= 360 THEN ceil(x / 10.0) - 1
      WHEN x <= 720 THEN 36 + ceil((x - 360) / 20.0) - 1 WHEN x <= 1440 THEN 54 + ceil((x - 720) / 60.0) - 1
      WHEN x <= 4320 THEN 66 + ceil((x - 1440) / 240.0) - 1 WHEN x <= 20160 THEN 78 + ceil((x - 4320) / 720.0) - 1
      WHEN x <= 43200 THEN 100 + ceil((x - 20160) / 1440.0) - 1 END AS INT) AS step,
      CAST(CASE WHEN x <= 0 THEN 10 WHEN x <= 360 THEN ceil(x / 10.0) * 10
      WHEN x <= 720 THEN ceil(x / 20.0) * 20 WHEN x <= 1440 THEN ceil(x / 60.0) * 60
      WHEN x <= 4320 THEN ceil(x / 240.0) * 240 WHEN x <= 20160 THEN ceil(x / 720.0) * 720
      WHEN x <= 43200 THEN ceil(x / 1440.0) * 1440 END AS INT) AS step_time_min FROM e""",
)
def d8(t):
    """Elapsed time to right-closed step and back to the step's time."""
    x = elapsed_minutes(F.col("ts"), F.col("start_ts"))
    out = m.with_start(t.ev, t.base).select("event_id", DEFAULT_GRID.time_to_step(x).alias("step"))
    return out.withColumn("step_time_min", DEFAULT_GRID.step_to_time(F.col("step")))


@query(
    "d9_width_positions",
    """WITH base AS (SELECT user_id AS pid, min(ts) AS start_ts FROM events GROUP BY 1),
    c(lo, hi) AS (SELECT s + i*f, s + (i+1)*f FROM (VALUES (720,1440,60),(1440,4320,240),(20160,43200,1440)) v(s,e,f),
      UNNEST(generate_series(0, (e-s)//f - 1)) u(i))
    SELECT pid, CAST(row_number() OVER (PARTITION BY pid ORDER BY lo) - 1 AS INT) AS step,
      start_ts + to_minutes(lo) AS bin_start FROM base, c""",
)
def d9(t):
    """Only some cell widths kept, positions renumbered from 0 without gaps."""
    grid = Grid(widths=("1h", "4h", "1D"))
    return m.lay_grid(t.base, grid).select("pid", "step", "bin_start")


@query(
    "d10_elapsed_channels",
    f"""{with_("base", "seg", "grid")}
    SELECT pid, step, round((lo + hi) / 120.0, 6) AS elapsed_hours, round((hi - lo) / 60.0, 6) AS width_hours FROM base, grid""",
)
def d10(t):
    """Midpoint hours and width of every cell."""
    g = m.lay_grid(t.base).join(t.base.select("pid", "start_ts"), "pid")
    lo, hi = (micros(F.col(c)) - micros(F.col("start_ts")) for c in ("bin_start", "bin_end"))
    return rounded(
        g.select("pid", "step", ((lo + hi) / 7.2e9).alias("elapsed_hours"), ((hi - lo) / 3.6e9).alias("width_hours"))
    )


@query(
    "d10_elapsed_arrays",
    f"""{with_("base", "seg", "grid")}
    SELECT pid, step, round((lo + hi) / 120.0, 6) AS elapsed_hours FROM base, grid""",
)
def d10_arrays(t):
    """Elapsed hours as one array per user (a literal array, nothing is collected), shown as rows."""
    mid = F.lit([round((c.lo + c.hi) / 120.0, 6) for c in DEFAULT_GRID.steps])
    wide = t.base.select("pid", mid.alias("elapsed"))
    return wide.select("pid", F.posexplode("elapsed").alias("step", "elapsed_hours"))


@query(
    "d11_schedule",
    f"""{with_("base")},
    h(x) AS (SELECT CAST(i AS DOUBLE) FROM UNNEST(generate_series(1, 72)) u(i)
      UNION SELECT CAST(24 * i AS DOUBLE) FROM UNNEST(generate_series(4, 30)) u(i)),
    s AS (SELECT DISTINCT CAST(CASE WHEN x * 60 <= 360 THEN ceil(x * 60 / 10.0) - 1
      WHEN x * 60 <= 720 THEN 36 + ceil((x * 60 - 360) / 20.0) - 1 WHEN x * 60 <= 1440 THEN 54 + ceil((x * 60 - 720) / 60.0) - 1
      WHEN x * 60 <= 4320 THEN 66 + ceil((x * 60 - 1440) / 240.0) - 1
      WHEN x * 60 <= 20160 THEN 78 + ceil((x * 60 - 4320) / 720.0) - 1
      ELSE 100 + ceil((x * 60 - 20160) / 1440.0) - 1 END AS INT) AS step FROM h)
    SELECT pid, step FROM base, s""",
)
def d11(t):
    """Evaluation schedule (hourly to 72 h, then daily) as distinct steps per user."""
    from tidemark.operators.evaluate import schedule_steps

    return t.base.select("pid", F.explode(schedule_steps()).alias("step"))


@query(
    "e1_cell_aggregates",
    f"""{with_("ev", "base", "seg", "grid", "mapped")}
    SELECT pid, step, feature, arg_min(value, (ts, event_id)) AS first, round(avg(value), 6) AS mean, max(value) AS max,
      min(value) AS min, round(stddev_samp(value), 6) AS std, round(sum(value), 6) AS sum, count(value) AS count,
      arg_max(value, (ts, event_id)) AS last FROM mapped GROUP BY 1, 2, 3""",
)
def e1(t):
    return rounded(m.aggregate_cells(m.point_to_step(t.ev, t.base), list(m.CONTINUOUS)))


@query(
    "e2_multi_label",
    f"""{with_("ev", "base", "seg", "grid", "mapped")}
    SELECT DISTINCT pid, step, 'events' AS feature, feature AS value, CAST(k // 10 AS VARCHAR) AS sub_code FROM mapped""",
)
def e2(t):
    ev = t.ev.select(
        "pid",
        "ts",
        F.lit("events").alias("feature"),
        F.col("feature").alias("value"),
        F.floor(F.col("k") / 10).cast("string").alias("sub_code"),
    )
    return m.multi_label_cells(m.point_to_step(ev, t.base), sub_code=True)


@query(
    "e3_single_label",
    f"""{with_("ev", "base", "seg", "grid", "mapped")},
    n AS (SELECT pid, step, feature AS v, count(*) AS n FROM mapped GROUP BY 1, 2, 3)
    SELECT pid, step, arg_min(v, (-n, v)) AS mode, any_value(f) AS first, any_value(l) AS last FROM n
    JOIN (SELECT pid, step, arg_min(feature, (ts, event_id)) AS f, arg_max(feature, (ts, event_id)) AS l
      FROM mapped GROUP BY 1, 2) USING (pid, step) GROUP BY 1, 2""",
)
def e3(t):
    ev = t.ev.withColumn("value", F.col("feature")).withColumn("feature", F.lit("events"))
    mapped = m.point_to_step(ev, t.base)
    out = None
    for how in ("mode", "first", "last"):
        part = m.single_label_cells(mapped, how).withColumnRenamed("value", how)
        out = part if out is None else out.join(part, m.CELL)
    return out.drop("feature")


@query(
    "e4_full_grid",
    f"""{with_("ev", "base", "seg", "grid", "mapped")},
    agg AS (SELECT pid, step, feature, max(value) AS max FROM mapped GROUP BY 1, 2, 3)
    SELECT pid, step, start_ts + to_minutes(lo) AS bin_start, start_ts + to_minutes(hi) AS bin_end, feature, max
    FROM base CROSS JOIN grid LEFT JOIN agg USING (pid, step)""",
)
def e4(t):
    return m.map_concept(t.ev, t.base, ["max"], full_grid=True)


@query(
    "e5_expand_labels",
    """WITH l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN NULL ELSE string_split(regexp_replace(text, '\\s+', ' ', 'g'), '. ') END AS w FROM conversations)
    SELECT conv_id, turn, value FROM l, UNNEST(w) AS u(value)
    UNION ALL SELECT conv_id, turn, NULL FROM l WHERE w IS NULL""",
)
def e5(t):
    """List cells to rows, NULL cells kept."""
    parts = F.split(F.regexp_replace("text", r"\s+", " "), r"\. ")
    cells = t.conversations.select("conv_id", "turn", F.when(F.col("role") != "user", parts).alias("value"))
    return m.explode_labels(cells)


@query(
    "e6_map_concept",
    f"""{with_("ev", "base", "seg", "grid", "nexts")},
    mi AS (SELECT n.*, g.step FROM nexts n JOIN base USING (pid) JOIN grid g
      ON epoch_us(n.ts) - epoch_us(base.start_ts) < g.hi * 60000000 AND epoch_us(n.end_ts) - epoch_us(base.start_ts) > g.lo * 60000000)
    SELECT pid, step, feature, round(avg(value), 6) AS mean, max(value) AS max, min(value) AS min, count(value) AS count
    FROM mi GROUP BY 1, 2, 3""",
)
def e6(t):
    """Whole interval concept: all features and functions in one job."""
    return rounded(m.map_concept(tr.next_start_as_end(t.ev), t.base, ["mean", "max", "min", "count"]))


@query(
    "f2_forward_fill",
    f"""{with_("ev", "base", "seg", "grid", "mapped")},
    agg AS (SELECT pid, step, feature, max(value) AS v FROM mapped GROUP BY 1, 2, 3),
    s AS (SELECT pid, feature, step FROM (SELECT DISTINCT pid, feature FROM mapped), grid)
    SELECT pid, feature, step, last_value(v IGNORE NULLS) OVER (PARTITION BY pid, feature ORDER BY step ROWS UNBOUNDED PRECEDING) AS value
    FROM s LEFT JOIN agg USING (pid, feature, step)""",
)
def f2(t):
    cells = m.map_concept(t.ev, t.base, ["max"]).withColumnRenamed("max", "value")
    series = cells.select("pid", "feature").distinct()
    return m.fill_forward(m.spread_cells(series, cells, ["value"], DEFAULT_GRID.total_steps), ["value"])
