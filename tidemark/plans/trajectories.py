"""Trajectories, intervals, masks, labels and the window operators they use."""

from pyspark.sql import functions as F

from tidemark.functions.timegrid import DEFAULT_GRID, micros
from tidemark.operators import joins as j
from tidemark.operators import mapping as m
from tidemark.operators import trajectory as tr
from tidemark.operators.sliced import Scan, forward_fill, neighbour, running_number, running_sum, sliced_scan, time_slice
from tidemark.plans.registry import query, rounded, with_

ORDER = ["ts", "event_id"]

ISLANDS = """nx AS (SELECT pid, feature, event_id, ts AS start_ts, ts + to_minutes(CAST(k * 10 AS BIGINT)) AS end_ts FROM ev),
    g AS (SELECT *, lag(end_ts) OVER (PARTITION BY pid ORDER BY start_ts, event_id) AS pe FROM nx),
    isl AS (SELECT *, CAST(sum(CASE WHEN start_ts - pe >= to_hours(6) THEN 1 ELSE 0 END)
      OVER (PARTITION BY pid ORDER BY start_ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM g),
    tra AS (SELECT pid, island, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(*) AS n_members,
      min(event_id) AS first_member, max(event_id) AS last_member FROM isl GROUP BY 1, 2)"""


def stays_of(t):
    """Events as stays of ``10 k`` minutes."""
    return t.ev.select(
        "pid",
        "feature",
        "event_id",
        F.col("ts").alias("start_ts"),
        (F.col("ts") + F.make_dt_interval(mins=F.col("k") * 10)).alias("end_ts"),
    )


def trajectories_of(t):
    return tr.collapse_islands(tr.mark_islands(stays_of(t), 6))


@query(
    "d1_admission_number",
    f"""{with_("ev")} SELECT event_id, pid, nullif(CAST(sum(CASE WHEN feature = 'signup' THEN 1 ELSE 0 END)
      OVER (PARTITION BY pid ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT), 0) AS trajectory FROM ev""",
)
def d1(t):
    return tr.number_admissions(t.ev, F.col("feature") == "signup").select("event_id", "pid", "trajectory")


@query(
    "d2_gap_collapse",
    f"""{with_("ev")}, {ISLANDS} SELECT pid, island, start_ts, end_ts, n_members, first_member, last_member,
      round((epoch_us(end_ts) - epoch_us(start_ts)) / 3.6e9, 6) AS duration_hours FROM tra""",
)
def d2(t):
    return rounded(trajectories_of(t))


@query("d2_island_members", f"{with_('ev')}, {ISLANDS} SELECT pid, event_id, island FROM isl")
def d2_members(t):
    """Which island each stay belongs to (the id list in long form)."""
    return tr.mark_islands(stays_of(t), 6).select("pid", "event_id", "island")


@query(
    "d2_gap_collapse_running_max",
    f"""{with_("ev")},
    nx AS (SELECT pid, event_id, ts AS start_ts, ts + to_minutes(CAST(k * 10 AS BIGINT)) AS end_ts FROM ev),
    g AS (SELECT *, max(end_ts) OVER (PARTITION BY pid ORDER BY start_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM nx),
    isl AS (SELECT *, CAST(sum(CASE WHEN start_ts - pe >= to_hours(1) THEN 1 ELSE 0 END)
      OVER (PARTITION BY pid ORDER BY start_ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM g)
    SELECT pid, island, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(*) AS n_members FROM isl GROUP BY 1, 2""",
)
def d2_max(t):
    out = tr.collapse_islands(tr.mark_islands(stays_of(t), 1, running_max=True))
    return out.select("pid", "island", "start_ts", "end_ts", "n_members")


@query(
    "d3_overlap_flag",
    f"""{with_("ev")},
    s AS (SELECT pid, event_id AS island, ts AS start_ts, ts + to_minutes(CAST(k * 10 AS BIGINT)) AS end_ts FROM ev)
    SELECT pid, island, coalesce(end_ts > lead(start_ts) OVER (PARTITION BY pid ORDER BY start_ts, island), false) AS overlap FROM s""",
)
def d3(t):
    s = stays_of(t).withColumnRenamed("event_id", "island")
    return tr.flag_overlap(s).select("pid", "island", "overlap")


@query(
    "d4_tie_shift",
    f"{with_('ev')} SELECT event_id, CASE WHEN feature = 'click' THEN ts + to_seconds(1) ELSE ts END AS ts FROM ev",
)
def d4(t):
    return tr.shift_ties(t.ev, F.col("feature") == "click").select("event_id", "ts")


@query(
    "d5_close_open",
    f"""{with_("ev", "base")},
    o AS (SELECT pid, event_id, ts, CASE WHEN k % 2 = 0 THEN ts + to_minutes(k) END AS e FROM ev)
    SELECT * FROM (SELECT o.pid, event_id, o.ts, coalesce(e, lead(o.ts) OVER (PARTITION BY o.pid ORDER BY o.ts, event_id),
      base.end_ts) AS end_ts FROM o JOIN base USING (pid)) WHERE end_ts IS NOT NULL""",
)
def d5(t):
    moves = t.ev.select(
        "pid",
        "event_id",
        "ts",
        F.when(F.col("k") % 2 == 0, F.col("ts") + F.make_dt_interval(mins=F.col("k"))).alias("end_ts"),
    )
    return tr.close_open_ends(moves, t.base)


@query(
    "d12_finish_base",
    """WITH b AS (SELECT o_orderkey AS pid, CAST(o_custkey % 100 AS VARCHAR) AS key, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS start_ts,
      CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) + to_days(30) END AS end_ts FROM orders)
    SELECT key, start_ts, end_ts, min(pid) AS pid FROM b WHERE end_ts IS NOT NULL GROUP BY 1, 2, 3""",
)
def d12(t):
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    b = t.orders.select(
        F.col("o_orderkey").alias("pid"),
        (F.col("o_custkey") % 100).cast("string").alias("key"),
        month.alias("start_ts"),
        F.when(F.col("o_orderstatus") != "F", month + F.expr("INTERVAL 30 DAYS")).alias("end_ts"),
    )
    return tr.finish_base(b)


@query(
    "d13_eval_times",
    f"""{with_("base", "seg", "grid")} SELECT pid, step, start_ts + to_minutes(hi) AS eval_ts FROM base, grid
      WHERE start_ts + to_minutes(hi) > start_ts + to_hours(6) AND start_ts + to_minutes(hi) <= least(end_ts, start_ts + to_hours(72))""",
)
def d13(t):
    """Cell ends inside (start + 6 h, min(end, start + 72 h)]."""
    g = m.lay_grid(t.base).join(t.base, "pid")
    lo = F.col("start_ts") + F.expr("INTERVAL 6 HOURS")
    hi = F.least("end_ts", F.col("start_ts") + F.expr("INTERVAL 72 HOURS"))
    out = g.filter((F.col("bin_end") > lo) & (F.col("bin_end") <= hi))
    return out.select("pid", "step", F.col("bin_end").alias("eval_ts"))


MASK_BASE = f"""{with_("ev")}, {ISLANDS},
    b AS (SELECT *, epoch_us(end_ts) - epoch_us(start_ts) AS d, epoch_us(start_ts) AS s, epoch_us(end_ts) AS e, n_members >= 2 AS dead FROM tra)"""


@query(
    "d14_mask_percentage",
    f"""{MASK_BASE}, x AS (SELECT *, s + CAST(floor(d * CASE WHEN d / 3.6e9 <= 6 THEN 0.9::DOUBLE WHEN d / 3.6e9 <= 72 THEN 0.95::DOUBLE ELSE 0.98::DOUBLE END) AS BIGINT) AS ne FROM b)
    SELECT pid, island, make_timestamp(CASE WHEN NOT dead THEN e WHEN ne <= s + 1800000000 THEN s + 1800000000 ELSE ne END) AS end_ts FROM x""",
)
def d14(t):
    base = trajectories_of(t)
    return tr.mask_end_of_life(base, F.col("n_members") >= 2).select("pid", "island", "end_ts")


@query(
    "d14_mask_absolute",
    f"""{MASK_BASE}, x AS (SELECT *, e - CASE WHEN d / 3.6e9 < 3 THEN 600000000 WHEN d / 3.6e9 <= 72 THEN 1800000000
      WHEN d / 3.6e9 <= 168 THEN 10800000000 ELSE 86400000000 END AS ne FROM b)
    SELECT pid, island, make_timestamp(CASE WHEN NOT dead THEN e WHEN ne <= s + 1800000000 THEN s + 1800000000 ELSE ne END) AS end_ts FROM x""",
)
def d14_abs(t):
    base = trajectories_of(t)
    out = tr.mask_end_of_life(base, F.col("n_members") >= 2, "absolute", event_ts=F.col("end_ts"))
    return out.select("pid", "island", "end_ts")


SURV = """stay AS (SELECT o_custkey AS pid, min(o_orderdate) AS start_ts, min(o_orderdate) + to_days(40) AS end_ts,
      min(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS death_ts FROM orders GROUP BY 1)"""


def survival_base(t):
    first = F.min("o_orderdate")
    return t.orders.groupBy(F.col("o_custkey").alias("pid")).agg(
        first.alias("start_ts"),
        (first + F.expr("INTERVAL 40 DAYS")).alias("end_ts"),
        F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("death_ts"),
    )


@query(
    "d15_survival_labels",
    f"""WITH {SURV}, x AS (SELECT pid, date_diff('day', start_ts, death_ts) * 24.0 AS td, 960.0 AS te FROM stay),
    y AS (SELECT pid, CAST(coalesce(td <= 720, false) AS INT) AS event_indicator,
      CAST(greatest(CASE WHEN coalesce(td <= 720, false) THEN td ELSE least(te, 720.0) END, 0) AS DOUBLE) AS event_time_hours FROM x)
    SELECT *, CAST(least(CASE WHEN event_time_hours <= 0 THEN 0 WHEN event_time_hours <= 6 THEN ceil(event_time_hours * 6) - 1
      WHEN event_time_hours <= 12 THEN 36 + ceil((event_time_hours - 6) * 3) - 1
      WHEN event_time_hours <= 24 THEN 54 + ceil(event_time_hours - 12) - 1
      WHEN event_time_hours <= 72 THEN 66 + ceil((event_time_hours - 24) / 4) - 1
      WHEN event_time_hours <= 336 THEN 78 + ceil((event_time_hours - 72) / 12) - 1
      ELSE 100 + ceil((event_time_hours - 336) / 24) - 1 END, 115) AS INT) AS event_time_steps FROM y""",
)
def d15(t):
    out = tr.survival_labels(survival_base(t), "death_ts")
    return out.select("pid", "event_indicator", "event_time_hours", "event_time_steps")


@query(
    "d16_static_labels",
    f"""WITH {SURV}, b AS (SELECT *, start_ts - to_days(CAST(10000 + pid % 7000 AS INT)) AS birth FROM stay)
    SELECT pid, round((epoch_us(end_ts) - epoch_us(start_ts)) / 8.64e10, 6) AS duration_days,
      CAST(floor(date_diff('day', birth, start_ts) / 365.25) AS INT) AS age,
      CAST(coalesce(death_ts - start_ts <= to_days(30), false) AS INT) AS deceased_30d,
      CAST(coalesce(death_ts - start_ts <= to_days(90), false) AS INT) AS deceased_90d,
      CAST(death_ts IS NOT NULL AS INT) AS site_flag FROM b""",
)
def d16(t):
    base = survival_base(t).withColumn(
        "birth", F.col("start_ts") - F.make_dt_interval(days=(10000 + F.col("pid") % 7000).cast("int"))
    )
    out = tr.static_labels(base, "birth", "death_ts", "death_ts")
    return rounded(out.select("pid", "duration_days", "age", "deceased_30d", "deceased_90d", "site_flag"))


@query(
    "d17_enumerate_ids",
    """WITH d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, row_number() OVER (ORDER BY o_custkey, CAST(o_orderdate AS DATE)) AS pid
      FROM (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders))
    SELECT o_orderkey, o_custkey, day, pid FROM orders JOIN d USING (o_custkey) WHERE CAST(o_orderdate AS DATE) = day""",
)
def d17(t):
    o = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    return tr.enumerate_ids(o, ["o_custkey", "day"])


@query(
    "d18_composed_id",
    "SELECT o_orderkey, substr(o_orderpriority, 1, 8) || strftime(o_orderdate, '%Y%m%d') AS pid FROM orders",
)
def d18(t):
    return t.orders.select("o_orderkey", tr.composed_id(F.col("o_orderpriority"), F.col("o_orderdate")).alias("pid"))


@query(
    "d19_universal_start",
    f"""{with_("ev")} SELECT pid, min(CASE WHEN feature = 'click' THEN ts END) AS pre_start, max(CASE WHEN feature = 'click' THEN ts END) AS pre_end,
      min(CASE WHEN feature = 'signup' THEN ts END) AS in_start,
      least(min(CASE WHEN feature = 'click' THEN ts END), min(CASE WHEN feature = 'signup' THEN ts END)) AS start_ts FROM ev GROUP BY 1""",
)
def d19(t):
    """First and last time per source, universal start as their minimum."""
    pre, inn = (F.when(F.col("feature") == f, F.col("ts")) for f in ("click", "signup"))
    out = t.ev.groupBy("pid").agg(
        F.min(pre).alias("pre_start"), F.max(pre).alias("pre_end"), F.min(inn).alias("in_start")
    )
    return out.withColumn("start_ts", F.least("pre_start", "in_start"))


@query(
    "d20_generated_transport",
    f"""{with_("ev")}, s AS (SELECT pid, feature AS source, min(ts) AS ts FROM ev WHERE feature <> 'view' GROUP BY 1, 2),
    b AS (SELECT pid, min(ts) AS start_ts FROM ev WHERE feature = 'view' GROUP BY 1)
    SELECT pid, ts, start_ts AS end_ts, 'PREHOSP_' || upper(source) AS value FROM s JOIN b USING (pid) WHERE ts < start_ts""",
)
def d20(t):
    sources = (
        t.ev.filter(F.col("feature") != "view")
        .groupBy("pid", F.col("feature").alias("source"))
        .agg(F.min("ts").alias("source_start"))
    )
    base = t.ev.filter(F.col("feature") == "view").groupBy("pid").agg(F.min("ts").alias("start_ts"))
    return tr.generated_transport(base, sources)


@query(
    "d21_boundary_step",
    f"""{with_("ev", "seg", "grid")},
    b AS (SELECT pid, min(CASE WHEN feature = 'click' THEN ts END) AS start_ts, min(CASE WHEN feature = 'view' THEN ts END) AS second FROM ev GROUP BY 1)
    SELECT pid, g.step AS boundary_step FROM b LEFT JOIN grid g ON epoch_us(second) - epoch_us(start_ts) > g.lo * 60000000 AND epoch_us(second) - epoch_us(start_ts) <= g.hi * 60000000""",
)
def d21(t):
    first = {f: F.min(F.when(F.col("feature") == f, F.col("ts"))) for f in ("click", "view")}
    b = t.ev.groupBy("pid").agg(first["click"].alias("start_ts"), first["view"].alias("second"))
    return tr.boundary_step(b, "second").select("pid", "boundary_step")


@query(
    "d22_merge_adjacent",
    f"""{with_("ev", "nexts")}, a AS (SELECT * FROM nexts WHERE end_ts > ts),
    f AS (SELECT *, CASE WHEN lag(end_ts) OVER w = ts AND lag(feature) OVER w = feature THEN 0 ELSE 1 END AS nw FROM a
      WINDOW w AS (PARTITION BY pid ORDER BY ts, event_id)),
    r AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY pid ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM f)
    SELECT pid, run, feature, min(ts) AS ts, max(end_ts) AS end_ts, count(*) AS n_merged FROM r GROUP BY 1, 2, 3""",
)
def d22(t):
    return tr.merge_adjacent(tr.next_start_as_end(t.ev))


@query(
    "d23_time_in_state",
    f"""{with_("ev", "nexts")} SELECT pid, feature, round(sum((epoch_us(end_ts) - epoch_us(ts)) / 3.6e9), 6) AS hours
      FROM nexts WHERE end_ts IS NOT NULL GROUP BY 1, 2""",
)
def d23(t):
    return rounded(tr.time_in_state(tr.next_start_as_end(t.ev)))


@query(
    "d24_visible_cells",
    f"""{with_("ev", "base", "seg", "grid")} SELECT event_id, count(*) FILTER (start_ts + to_minutes(lo) <= ts) AS visible
      FROM ev JOIN base USING (pid), grid GROUP BY 1""",
)
def d24(t):
    """Number of cells begun by each event's time, in closed form."""
    started = DEFAULT_GRID.step_of(F.col("ts"), F.col("start_ts"))
    us = micros(F.col("ts")) - micros(F.col("start_ts"))
    n = F.when(us < 0, 0).otherwise(F.coalesce(started + 1, F.lit(DEFAULT_GRID.total_steps)))
    return m.with_start(t.ev, t.base).select("event_id", n.cast("long").alias("visible"))


@query(
    "d25_per_minute",
    f"""{with_("ev")} SELECT event_id, unnest(generate_series(ts, ts + to_minutes(CASE WHEN k % 3 = 0 THEN 0 ELSE k % 7 END), to_minutes(1))) AS minute_ts FROM ev""",
)
def d25(t):
    end = F.when(F.col("k") % 3 != 0, F.col("ts") + F.make_dt_interval(mins=F.col("k") % 7))
    return tr.per_minute(t.ev.withColumn("end_ts", end)).select("event_id", "minute_ts")


@query(
    "c13_first_contacts",
    f"""{with_("ev")}, {ISLANDS},
    i AS (SELECT pid, island, tra.start_ts, ev.ts, ev.feature, ev.event_id FROM ev JOIN tra USING (pid) WHERE ev.ts BETWEEN tra.start_ts AND tra.end_ts),
    a AS (SELECT pid, start_ts, arg_min(feature, (ts, event_id)) AS first_unit, min(CASE WHEN feature IN ('view', 'signup') THEN ts END) AS first_site FROM i GROUP BY 1, 2)
    SELECT pid AS key, start_ts, first_unit, first_site, round((epoch_us(first_site) - epoch_us(start_ts)) / 3.6e9, 6) AS hours_to_site,
      CASE WHEN first_unit = 'signup' THEN 'primær' WHEN first_site IS NOT NULL THEN 'sekundær' ELSE 'primær ingen RH' END AS visit_type FROM a""",
)
def c13(t):
    moves = t.ev.select(F.col("pid").alias("key"), "ts", F.col("feature").alias("unit"), "event_id")
    base = trajectories_of(t).select(F.col("pid").alias("key"), "start_ts", "end_ts")
    out = tr.first_contacts(moves, base, F.col("unit").isin("view", "signup"), F.col("unit") == "signup")
    return rounded(out)


# ---- window operators ----------------------------------------------------------------


@query(
    "f1_running_count",
    f"{with_('ev')} SELECT event_id, row_number() OVER (PARTITION BY pid ORDER BY ts, event_id) AS n FROM ev",
)
def f1(t):
    return running_number(t.ev, ["pid"], ORDER, "n").select("event_id", "n")


@query(
    "f2_forward_fill_events",
    f"""{with_("ev")} SELECT event_id, last_value(CASE WHEN feature = 'purchase' THEN value END IGNORE NULLS)
      OVER (PARTITION BY pid ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM ev""",
)
def f2_events(t):
    """Forward fill over raw events (unbounded per user, hence sliced)."""
    ev = t.ev.withColumn("v", F.when(F.col("feature") == "purchase", F.col("value")))
    return forward_fill(ev, ["pid"], ORDER, "v", "last_purchase").select("event_id", "last_purchase")


@query(
    "f3_shift",
    f"""{with_("ev")} SELECT event_id, lag(value) OVER w AS prev_value, lead(ts) OVER w AS next_ts FROM ev
      WINDOW w AS (PARTITION BY pid ORDER BY ts, event_id)""",
)
def f3(t):
    out = neighbour(t.ev, ["pid"], ORDER, {"prev_value": "value"})
    out = neighbour(out, ["pid"], ORDER, {"next_ts": "ts"}, ahead=True)
    return out.select("event_id", "prev_value", "next_ts")


@query(
    "f4_flag_groups",
    f"""{with_("ev")} SELECT event_id, CAST(sum(CASE WHEN value > 100 THEN 1 ELSE 0 END)
      OVER (PARTITION BY pid ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM ev""",
)
def f4(t):
    flag = F.when(F.col("value") > 100, 1).otherwise(0).cast("long")
    return running_sum(t.ev, ["pid"], ORDER, flag, "grp").select("event_id", "grp")


@query(
    "f5_first_last_row",
    f"""{with_("ev")} SELECT pid, feature, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id
      FROM ev GROUP BY 1, 2""",
)
def f5(t):
    order = [F.col("ts"), F.col("event_id")]
    first = j.first_per_key(t.ev, ["pid", "feature"], order, ["event_id"]).withColumnRenamed("event_id", "first_id")
    last = j.first_per_key(t.ev, ["pid", "feature"], order, ["event_id"], last=True)
    return first.join(last.withColumnRenamed("event_id", "last_id"), ["pid", "feature"])


@query(
    "f6_preference_rank",
    f"""{with_("ev")} SELECT pid, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY pid ORDER BY
      CASE feature WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, abs(value - 50), value, event_id) = 1""",
)
def f6(t):
    """Best row per user by a preference list."""
    rank = F.when(F.col("feature") == "purchase", 0).when(F.col("feature") == "signup", 1).otherwise(2)
    order = [rank, F.abs(F.col("value") - 50), F.col("value"), F.col("event_id")]
    return j.first_per_key(t.ev, ["pid"], order, ["event_id"])


@query(
    "f8_log_survival",
    f"""{with_("ev", "base", "seg", "grid", "mapped")},
    h AS (SELECT pid, step, count(*) / (count(*) + 100.0) AS hz FROM mapped GROUP BY 1, 2)
    SELECT pid, step, round(exp(sum(ln(1 - hz)) OVER (PARTITION BY pid ORDER BY step ROWS UNBOUNDED PRECEDING)), 6) AS survival FROM h""",
)
def f8(t):
    from tidemark.operators.evaluate import survival_from_hazard

    cells = m.point_to_step(t.ev, t.base).groupBy("pid", "step").agg((F.count("*") / (F.count("*") + 100.0)).alias("hazard"))
    return rounded(survival_from_hazard(cells).select("pid", "step", "survival"))
