"""Interval, nearest and as-of joins, set operations, top-k, point-in-time snapshots."""

from pyspark.sql import functions as F

from tidemark.functions.timegrid import DEFAULT_GRID, elapsed_minutes, micros
from tidemark.operators import cohort as co
from tidemark.operators import joins as j
from tidemark.operators import mapping as m
from tidemark.operators import trajectory as tr
from tidemark.operators.sliced import Scan, sliced_scan
from tidemark.plans.cleaning import one_of, sql_one_of
from tidemark.plans.features import DIAG, DIAG_SQL, diagnoses
from tidemark.plans.registry import query, rounded, with_
from tidemark.plans.trajectories import ISLANDS, trajectories_of

GRID = DEFAULT_GRID


@query(
    "c1_in_stay",
    f"""{with_("ev")}, b AS (SELECT user_id AS pid, min(ts) + to_days(5) AS start_ts, min(ts) + to_days(12) AS end_ts FROM events GROUP BY 1)
    SELECT DISTINCT pid, ts, feature, value, event_id FROM ev JOIN b USING (pid) WHERE ts BETWEEN start_ts - to_days(1) AND end_ts + to_days(1)""",
)
def c1(t):
    base = t.base.select(
        "pid", (F.col("start_ts") + F.expr("INTERVAL 5 DAYS")).alias("start_ts"), (F.col("start_ts") + F.expr("INTERVAL 12 DAYS")).alias("end_ts")
    )
    return j.in_stay(t.ev.drop("k"), base, 1)


@query(
    "c1_in_stay_many",
    f"""{with_("ev")}, {ISLANDS}, e AS (SELECT pid AS key, ts, event_id FROM ev) SELECT DISTINCT key, e.ts, event_id, island FROM e JOIN tra ON key = pid
      WHERE e.ts BETWEEN tra.start_ts - to_days(1) AND tra.end_ts + to_days(1)""",
)
def c1_many(t):
    """Several stays per key: an event may fall into more than one padded stay."""
    stays = trajectories_of(t).select(F.col("pid").alias("key"), "island", "start_ts", "end_ts")
    events = t.ev.select(F.col("pid").alias("key"), "ts", "event_id")
    return j.in_stay(events, stays, 1, key="key", bucket="1 day")


@query(
    "c5_episode_match",
    f"""{with_("ev")}, {ISLANDS}, r AS (SELECT o_orderkey, o_custkey % 150 AS key, TIMESTAMP '2024-01-01' + to_hours(o_orderkey % 720) AS ref_ts FROM orders)
    SELECT DISTINCT o_orderkey, key, island FROM r JOIN tra ON key = pid WHERE ref_ts BETWEEN tra.start_ts - to_days(1) AND tra.end_ts + to_days(1)""",
)
def c5(t):
    """Reference dates matched to padded episodes of the same key."""
    refs = t.orders.select(
        "o_orderkey",
        (F.col("o_custkey") % 150).alias("key"),
        (F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(hours=(F.col("o_orderkey") % 720).cast("int"))).alias("ref_ts"),
    )
    episodes = trajectories_of(t).select(F.col("pid").alias("key"), "island", "start_ts", "end_ts")
    return j.match_episodes(refs, episodes, "ref_ts").select("o_orderkey", "key", "island").distinct()


REGISTRY = """reg AS (SELECT o_custkey AS key, CAST(l_shipdate AS DATE) AS d, arg_max(l_quantity, (l_shipdate, l_quantity)) AS score
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def registry(t):
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("key"))
    return t.lineitem.select("l_orderkey", "l_shipdate", F.col("l_quantity").alias("score")).join(o, "l_orderkey").drop("l_orderkey")


@query(
    "c6_nearest_date",
    f"""WITH {REGISTRY}, c AS (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), d) AS off, score FROM orders JOIN reg ON key = o_custkey
      AND d BETWEEN CAST(o_orderdate AS DATE) - 2 AND CAST(o_orderdate AS DATE) + 2),
    b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(off), off) = 1)
    SELECT o_orderkey, CAST(off AS INT) AS offset_days, score FROM orders LEFT JOIN b USING (o_orderkey)""",
)
def c6(t):
    """Nearest registry date within two days, earlier before later."""
    left = t.orders.select("o_orderkey", F.col("o_custkey").alias("key"), "o_orderdate")
    out = j.nearest_date_match(left, registry(t), "key", "o_orderdate", "l_shipdate", ["score"])
    return out.select("o_orderkey", "offset_days", "score")


@query("c7_registry_last", f"WITH {REGISTRY} SELECT key, d AS day, score FROM reg")
def c7(t):
    return j.last_per_date(registry(t), "key", "l_shipdate", ["score"]).withColumnRenamed("__date", "day")


@query(
    "c8_bridge_join",
    """WITH mp AS (SELECT CAST(o_custkey AS VARCHAR) AS key, CAST(o_orderkey AS VARCHAR) AS journal_id, o_orderdate AS c, CASE WHEN o_orderkey % 2 = 0 THEN 'North' ELSE 'South' END AS region FROM orders),
    b AS (SELECT o_custkey AS pid, CAST(o_custkey AS VARCHAR) AS key, min(o_orderdate) + to_days(400) AS start_ts, min(o_orderdate) + to_days(800) AS end_ts FROM orders GROUP BY 1),
    l AS (SELECT DISTINCT pid, journal_id, region FROM b JOIN mp USING (key) WHERE c <= end_ts AND c >= start_ts - to_hours(48))
    SELECT l_orderkey, l_linenumber, pid, region FROM lineitem JOIN l ON CAST(l_orderkey AS VARCHAR) = journal_id""",
)
def c8(t):
    """Lines linked to customers through order ids made near the stay."""
    from tidemark.sources.tables import bridge_join

    mapping = t.orders.select(
        F.col("o_custkey").cast("string").alias("key"),
        F.col("o_orderkey").cast("string").alias("journal_id"),
        F.col("o_orderdate").alias("created_ts"),
        F.when(F.col("o_orderkey") % 2 == 0, "North").otherwise("South").alias("region"),
    )
    first = F.min("o_orderdate")
    base = t.orders.groupBy(F.col("o_custkey").alias("pid")).agg(
        (first + F.expr("INTERVAL 400 DAYS")).alias("start_ts"), (first + F.expr("INTERVAL 800 DAYS")).alias("end_ts")
    )
    base = base.withColumn("key", F.col("pid").cast("string"))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_orderkey").cast("string").alias("journal_id"))
    return bridge_join(lines, mapping, base)[0].select("l_orderkey", "l_linenumber", "pid", "region")


@query(
    "c9_full_merge",
    f"""{with_("ev")}, a AS (SELECT pid, max(value) AS v FROM ev WHERE feature = 'click' GROUP BY 1),
    b AS (SELECT o_custkey AS pid, max(o_totalprice) AS v FROM orders GROUP BY 1), c AS (SELECT s_suppkey AS pid, max(s_acctbal) AS v FROM supplier GROUP BY 1)
    SELECT coalesce(a.pid, b.pid, c.pid) AS pid, a.v AS "A", b.v AS "B", c.v AS "C" FROM a FULL JOIN b ON a.pid = b.pid FULL JOIN c ON coalesce(a.pid, b.pid) = c.pid""",
)
def c9(t):
    """Three tables whose ids overlap in part."""
    parts = {
        "A": t.ev.filter(F.col("feature") == "click").groupBy("pid").agg(F.max("value").alias("A")),
        "B": t.orders.groupBy(F.col("o_custkey").alias("pid")).agg(F.max("o_totalprice").alias("B")),
        "C": t.supplier.groupBy(F.col("s_suppkey").alias("pid")).agg(F.max("s_acctbal").alias("C")),
    }
    return j.full_merge(parts, "pid")


@query(
    "c10_fallback_union",
    """WITH a AS (SELECT s_suppkey AS pid, s_suppkey AS id FROM supplier), b AS (SELECT o_custkey AS pid, o_orderkey AS id FROM orders),
    c AS (SELECT c_custkey AS pid, c_custkey AS id FROM customer), ab AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE pid NOT IN (SELECT pid FROM a))
    SELECT * FROM ab UNION ALL SELECT * FROM c WHERE pid NOT IN (SELECT pid FROM ab)""",
)
def c10(t):
    """Rows of the first table that has an id: suppliers, else orders, else customers."""

    def part(table, key, row):
        return table.select(F.col(key).alias("pid"), F.col(row).alias("id"))

    known = j.fallback_union(part(t.supplier, "s_suppkey", "s_suppkey"), part(t.orders, "o_custkey", "o_orderkey"), "pid")
    return j.fallback_union(known, part(t.customer, "c_custkey", "c_custkey"), "pid")


@query("c11_semi_join", "SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def c11(t):
    rich = t.customer.filter(F.col("c_acctbal") > 5000).select(F.col("c_custkey").alias("user_id"))
    return t.events.join(rich, "user_id", "left_semi").select("event_id")


LAND_SQL = """lm AS (SELECT c_custkey AS pid, h.h::DOUBLE AS h, CASE WHEN (c_custkey + h.h) % 4 <> 0 THEN (c_custkey * 7 + h.h) % 100 / 100.0::DOUBLE END AS p
      FROM customer, (VALUES (0), (1), (6), (24), (72), (240)) h(h) WHERE h.h > 0 OR c_custkey % 3 = 0)"""


def landmarks(t):
    hours = F.explode(F.lit([0, 1, 6, 24, 72, 240]))
    lm = t.customer.select(F.col("c_custkey").alias("pid"), hours.alias("h"))
    lm = lm.filter((F.col("h") > 0) | (F.col("pid") % 3 == 0))
    p = F.when((F.col("pid") + F.col("h")) % 4 != 0, (F.col("pid") * 7 + F.col("h")) % 100 / F.lit(100.0))
    return lm.select("pid", F.col("h").cast("double").alias("h"), p.alias("p"))


@query(
    "c12_landmark_fill",
    f"""{with_("base", "seg", "grid")}, {LAND_SQL}, c AS (SELECT pid, step, lo / 60.0::DOUBLE AS h FROM base, grid)
    SELECT c.pid, c.step, round(l.p, 6) AS p FROM c ASOF LEFT JOIN (SELECT * FROM lm WHERE p IS NOT NULL) l ON c.pid = l.pid AND c.h >= l.h""",
)
def c12(t):
    """Latest non-null landmark prediction at or before each cell's start."""
    cells = t.base.select("pid", F.posexplode(F.lit([c.lo / 60.0 for c in GRID.steps])).alias("step", "h"))
    out = j.as_of(cells, landmarks(t), ["pid"], "h", "h", "p", 168.0)
    return rounded(out.select("pid", F.col("step").cast("int").alias("step"), "p"))


@query(
    "c14_nearest_categorical",
    f"""WITH {DIAG_SQL}, bs AS (SELECT o_custkey AS pid, min(o_orderdate) + to_days(900) AS base_ts FROM orders GROUP BY 1)
    SELECT bs.pid, CAST(count(*) FILTER (starts_with(code, 'DI') AND (resolved_ts IS NULL OR resolved_ts > base_ts)
      AND date_diff('day', base_ts, noted_ts) BETWEEN -365 AND 0) > 0 AS INT) AS heart FROM bs LEFT JOIN dg ON key = bs.pid GROUP BY 1""",
)
def c14(t):
    """0/1 of an unresolved code with a prefix in the year before the base date."""
    from tidemark.operators.comorbidity import prefix_flags
    from tidemark.plans.features import flag_base

    return prefix_flags(flag_base(t), diagnoses(t), {"heart": ["DI"]}, -365, 0).select("pid", "heart")


@query(
    "c15_nearest_continuous",
    f"""{with_("ev", "base")}, b AS (SELECT pid, start_ts + to_days(10) AS base_ts FROM base),
    c AS (SELECT b.pid, value, epoch_us(ts) - epoch_us(base_ts) AS d FROM b JOIN ev USING (pid) WHERE feature = 'purchase' AND ts BETWEEN base_ts - to_days(1) AND base_ts + to_days(2)),
    n AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY pid ORDER BY abs(d), d, value) = 1)
    SELECT b.pid, round(value * 0.5, 4) AS x, round(d / 8.64e10, 6) AS delta_days FROM b LEFT JOIN n USING (pid)""",
)
def c15(t):
    """Purchase value closest to a base time within [-1, 2] days, scaled."""
    base = t.base.select("pid", (F.col("start_ts") + F.expr("INTERVAL 10 DAYS")).alias("base_ts"))
    rows = t.ev.filter(F.col("feature") == "purchase")
    out = j.closest_value(base, rows, "pid", "base_ts", "ts", "value", -1, 2)
    return rounded(out.select("pid", F.round(F.col("value") * 0.5, 4).alias("x"), "delta_days"))


@query(
    "c16_landmark_mask",
    f"""{with_("ev", "base")}, a AS (SELECT pid, CASE WHEN pid % 3 = 0 THEN min(ts) ELSE min(ts) + to_days(2) END AS s FROM ev GROUP BY 1)
    SELECT event_id FROM ev JOIN a USING (pid) WHERE ts <= s + to_hours(24)""",
)
def c16(t):
    """Events up to start + 24 h; a third of the users has no start and uses the first event."""
    starts = t.base.filter(F.col("pid") % 3 != 0).withColumn("start_ts", F.col("start_ts") + F.expr("INTERVAL 2 DAYS"))
    return co.landmark_mask(t.ev, starts, 24).select("event_id")


@query(
    "c17_snapshot",
    f"""{with_("ev", "base", "nexts")} SELECT event_id, least(nexts.end_ts, start_ts + to_hours(100)) AS end_ts FROM nexts JOIN base USING (pid)
      WHERE nexts.end_ts IS NOT NULL AND ts <= start_ts + to_hours(100)""",
)
def c17(t):
    stays = tr.next_start_as_end(t.ev).join(t.base.select("pid", "start_ts"), "pid")
    return co.snapshot(stays, F.col("start_ts") + F.expr("INTERVAL 100 HOURS")).select("event_id", "end_ts")


@query(
    "c18_delta_window",
    f"""{with_("ev", "base", "nexts")}, w AS (SELECT nexts.*, start_ts + to_hours(100) AS a, start_ts + to_hours(110) AS b FROM nexts JOIN base USING (pid) WHERE nexts.end_ts IS NOT NULL)
    SELECT event_id, least(end_ts, b) AS end_ts FROM w WHERE (ts > a AND ts <= b) OR (ts <= a AND end_ts > a)""",
)
def c18(t):
    stays = tr.next_start_as_end(t.ev).join(t.base.select("pid", "start_ts"), "pid")
    lo, hi = (F.col("start_ts") + F.expr(f"INTERVAL {h} HOURS") for h in (100, 110))
    return co.delta_window(stays, lo, hi).select("event_id", "end_ts")


@query(
    "c19_snap_times",
    """WITH a(t) AS (VALUES (1.0::DOUBLE), (6.0), (24.0), (48.0), (72.0), (240.0)), r AS (SELECT DISTINCT p_size * 5.0::DOUBLE AS x FROM part)
    SELECT DISTINCT arg_min(t, (abs(t - x), t)) AS x FROM r, a GROUP BY r.x""",
)
def c19(t):
    return j.snap_times(t.part.select((F.col("p_size") * F.lit(5.0)).alias("x")), [1, 6, 24, 48, 72, 240], "x")


@query(
    "c20_scaffold",
    f"""{with_("ev")}, a AS (SELECT pid, feature, count(*) AS n FROM ev GROUP BY 1, 2)
    SELECT s.pid, f.feature, coalesce(n, 0) AS n FROM (SELECT DISTINCT pid FROM ev) s CROSS JOIN (SELECT DISTINCT feature FROM ev) f LEFT JOIN a ON a.pid = s.pid AND a.feature = f.feature""",
)
def c20(t):
    counts = t.ev.groupBy("pid", "feature").agg(F.count("*").alias("n"))
    full = m.scaffold(t.ev, ["click", "error", "purchase", "signup", "view"])
    return full.join(counts, ["pid", "feature"], "left").fillna(0, ["n"])


@query("c21_attach_static", "SELECT event_id, c_mktsegment, c_acctbal FROM events LEFT JOIN customer ON user_id = c_custkey")
def c21(t):
    static = t.customer.select(F.col("c_custkey").alias("pid"), "c_mktsegment", "c_acctbal")
    return j.attach_static(t.ev, static).select("event_id", "c_mktsegment", "c_acctbal")


@query("c22_align_columns", "SELECT p_partkey, p_size, 0 AS p_weight, p_brand FROM part")
def c22(t):
    return j.align_columns(t.part, ["p_partkey", "p_size", "p_weight", "p_brand"], 0)


@query(
    "c23_id_overlap",
    """WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_totalprice > 300000), b AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_acctbal > 3000)
    SELECT CASE WHEN a.id IS NULL THEN 'right_only' WHEN b.id IS NULL THEN 'left_only' ELSE 'both' END AS side, count(*) AS n FROM a FULL JOIN b USING (id) GROUP BY 1""",
)
def c23(t):
    a = t.orders.filter(F.col("o_totalprice") > 300000).select(F.col("o_custkey").alias("id"))
    b = t.customer.filter(F.col("c_acctbal") > 3000).select(F.col("c_custkey").alias("id"))
    return j.id_overlap(a, b, "id")


# ---- set operations, order, top-k ------------------------------------------------------


@query("m1_union_all", "SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT s_suppkey, s_name FROM supplier")
def m1(t):
    a = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return a.unionByName(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("m2_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders UNION SELECT 'X', l_returnflag FROM lineitem")
def m2(t):
    a = t.orders.select("o_orderstatus", "o_orderpriority")
    return a.unionByName(t.lineitem.select(F.lit("X").alias("o_orderstatus"), F.col("l_returnflag").alias("o_orderpriority"))).distinct()


@query("m3_intersect", "SELECT o_custkey AS id FROM orders INTERSECT SELECT user_id FROM events")
def m3(t):
    return t.orders.select(F.col("o_custkey").alias("id")).intersect(t.events.select(F.col("user_id").alias("id")))


@query("m4_except", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def m4(t):
    big = t.orders.filter(F.col("o_totalprice") > 400000)
    return t.customer.select(F.col("c_custkey").alias("id")).subtract(big.select(F.col("o_custkey").alias("id")))


@query("m5_global_sort", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def m5(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey")


@query("m6_top_k_count", "SELECT p_brand, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10")
def m6(t):
    sold = t.lineitem.select(F.col("l_partkey").alias("p_partkey")).join(t.part.select("p_partkey", "p_brand"), "p_partkey")
    return sold.groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "p_brand").limit(10)


@query(
    "m7_top_k_per_group",
    "SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INT) AS rank FROM customer QUALIFY rank <= 3",
)
def m7(t):
    out = j.top_k(t.customer, ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 3)
    return out.select("c_nationkey", "c_custkey", "rank")


# ---- visibility and replay -------------------------------------------------------------


@query(
    "k5_visibility",
    f"""{with_("base", "seg", "grid")}, n AS (SELECT pid, least(TIMESTAMP '2024-01-10 07:30:00' + to_hours(pid % 100), end_ts) AS horizon, start_ts FROM base)
    SELECT pid, horizon, count(*) FILTER (start_ts + to_minutes(lo) <= horizon) AS visible FROM n, grid GROUP BY 1, 2""",
)
def k5(t):
    """Cells begun by min(now, end of stay)."""
    now = F.expr("timestamp_ntz'2024-01-10 07:30:00'") + F.make_dt_interval(hours=(F.col("pid") % 100).cast("int"))
    base = t.base.withColumn("horizon", F.least(now, F.col("end_ts")))
    us = micros(F.col("horizon")) - micros(F.col("start_ts"))
    n = F.when(us < 0, 0).otherwise(F.coalesce(GRID.step_of(F.col("horizon"), F.col("start_ts")) + 1, F.lit(GRID.total_steps)))
    return base.select("pid", "horizon", n.cast("long").alias("visible"))


@query(
    "k6_prefix_replay",
    f"""{with_("ev", "base", "seg", "grid")} SELECT base.pid, g.step, ev.feature, count(*) AS n, round(sum(value), 6) AS total, max(value) AS max FROM base CROSS JOIN grid g
      JOIN ev ON ev.pid = base.pid AND epoch_us(ev.ts) - epoch_us(base.start_ts) <= g.hi * 60000000 GROUP BY 1, 2, 3""",
)
def k6(t):
    """For every cell end the running count, sum and maximum of what was known then.

    Events are folded to the first cell end that sees them; the history is a running window over
    at most one row per cell, so no event is repeated.
    """
    from pyspark.sql import Window

    cell = F.coalesce(GRID.time_to_step(elapsed_minutes(F.col("ts"), F.col("start_ts"))), F.lit(GRID.total_steps))
    seen = m.with_start(t.ev, t.base).withColumn("step", cell).filter(F.col("step") < GRID.total_steps)
    per = seen.groupBy("pid", "feature", "step").agg(F.count("*").alias("c"), F.sum("value").alias("s"), F.max("value").alias("m"))
    steps = per.select("pid", "feature").distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(GRID.total_steps - 1))))
    w = Window.partitionBy("pid", "feature").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    out = steps.join(per, ["pid", "feature", "step"], "left")
    out = out.select("pid", "step", "feature", F.sum("c").over(w).alias("n"), F.sum("s").over(w).alias("total"), F.max("m").over(w).alias("max"))
    return rounded(out.filter(F.col("n").isNotNull()))
