"""Scans, sources, sinks and stage checks."""

import uuid

from pyspark.sql import functions as F

from tidemark.operators import mapping as m
from tidemark.operators import quality as q
from tidemark.plans.registry import query, rounded, with_
from tidemark.session import checkpoint_dir
from tidemark.sources import tables as src


def scratch(t, name: str) -> str:
    """A fresh folder on the shared storage the cluster names."""
    return f"{checkpoint_dir(t.spark).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


@query(
    "a1_cohort_scan",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')",
)
def a1(t):
    cohort = t.customer.filter(F.col("c_mktsegment") == "MACHINERY")
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return src.cohort_scan(orders, cohort, "o_custkey", "c_custkey")


@query(
    "a2_big_cohort_scan",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN
      (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000)""",
)
def a2(t):
    cohort = t.orders.filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return src.cohort_scan(lines, cohort, "l_orderkey", "o_orderkey")


@query("a3_cohort_seed", "SELECT DISTINCT user_id AS pid, ts FROM events WHERE event_type = 'signup'")
def a3(t):
    return src.cohort_by_code(t.ev, "signup", "feature", ["pid", "ts"])


@query(
    "a4_sampled_recompute",
    f"""{with_("ev", "base", "seg", "grid", "mapped")},
    ids AS (SELECT pid FROM base ORDER BY md5(CAST(pid AS VARCHAR) || ':42'), pid LIMIT 40),
    r AS (SELECT pid, step, feature, avg(value) AS a FROM mapped WHERE pid IN (SELECT pid FROM ids) GROUP BY 1, 2, 3),
    s AS (SELECT pid, step, feature, avg(value) + CASE WHEN step % 29 = 3 THEN 1 ELSE 0 END AS b FROM mapped
      WHERE step % 31 <> 5 AND pid IN (SELECT pid FROM ids) GROUP BY 1, 2, 3)
    SELECT pid, CASE WHEN a IS NULL OR b IS NULL THEN 'SKIP' WHEN abs(a - b) < 0.01 THEN 'PASS' ELSE 'WARN' END AS status,
      count(*) AS n FROM r FULL JOIN s USING (pid, step, feature) GROUP BY 1, 2""",
)
def a4(t):
    """Stored cells (some missing, some altered on purpose) against a recompute for 40 sampled users."""
    mapped = m.map_concept(t.ev, t.base, ["mean"])
    altered = F.col("mean") + F.when(F.col("step") % 29 == 3, 1).otherwise(0)
    stored = mapped.filter(F.col("step") % 31 != 5).withColumn("mean", altered)
    return q.recompute_check(t.ev, t.base, stored, 40, 42)


@query(
    "a5_delimited_source",
    """SELECT o_orderkey, o_custkey, o_totalprice, false AS bad FROM orders WHERE o_orderkey % 10 <> 7
    UNION ALL SELECT NULL, NULL, NULL, true FROM orders WHERE o_orderkey % 10 = 7""",
)
def a5(t):
    """Semicolon lines with an explicit schema; every tenth line is broken and set aside."""
    broken = F.concat(F.lit("x"), F.col("o_orderkey").cast("string"), F.lit(";?;y"))
    line = F.concat_ws(";", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_totalprice").cast("string"))
    lines = t.orders.select(F.when(F.col("o_orderkey") % 10 == 7, broken).otherwise(line).alias("line"))
    out = src.parse_delimited(lines, "line", "o_orderkey bigint, o_custkey bigint, o_totalprice double", ";")
    bad = F.col(src.BAD).isNotNull()
    return out.select(*[F.when(~bad, F.col(c)).alias(c) for c in ("o_orderkey", "o_custkey", "o_totalprice")], bad.alias("bad"))


MAPPINGS = """m1 AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS key, CAST(o_orderkey % 4000 AS VARCHAR) AS journal_id, o_orderdate + to_milliseconds(CAST(o_orderkey % 1000 AS INT)) AS c
      FROM orders WHERE o_orderkey % 3 <> 0),
    m2 AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS key, CAST(o_orderkey % 4000 AS VARCHAR) AS journal_id, o_orderdate AS c FROM orders WHERE o_orderkey % 3 <> 1),
    u AS (SELECT *, 0 AS r, 'North' AS region FROM m1 UNION ALL SELECT *, 1, 'South' FROM m2),
    mp AS (SELECT key, journal_id, c AS created_ts, region FROM u QUALIFY row_number() OVER (PARTITION BY key, journal_id ORDER BY r, c) = 1)"""


def mappings_of(t):
    key = (F.col("o_custkey") % 50).cast("string").alias("key")
    jid = (F.col("o_orderkey") % 4000).cast("string")
    millis = F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0")
    sas = F.concat(F.upper(F.date_format("o_orderdate", "ddMMMyyyy:HH:mm:ss")), F.lit("."), millis, F.lit("0"))
    north = t.orders.filter(F.col("o_orderkey") % 3 != 0).select(key, F.concat(jid, F.lit(".0")).alias("journal_id"), sas.alias("created"))
    south = t.orders.filter(F.col("o_orderkey") % 3 != 1).select(
        key, jid.alias("journal_id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created")
    )
    return src.load_mappings([src.MappingSource("North", north, "sas"), src.MappingSource("South", south, "iso")])


@query("a6_multi_source_mapping", f"WITH {MAPPINGS} SELECT * FROM mp")
def a6(t):
    """Two sources, two time formats, float-like ids; one row per key and journal."""
    return mappings_of(t)


@query(
    "a7_prefilter_raw",
    f"""WITH {MAPPINGS} SELECT l_orderkey, l_linenumber FROM lineitem
      WHERE CAST(l_orderkey AS VARCHAR) IN (SELECT journal_id FROM mp WHERE region = 'South')""",
)
def a7(t):
    ids = mappings_of(t).filter(F.col("region") == "South").select(F.col("journal_id").alias("jid"))
    raw = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_orderkey").cast("string").alias("jid"))
    return src.cohort_scan(raw, ids, "jid").drop("jid")


@query(
    "a8_metadata_read",
    f"""{with_("stay")}, a AS (SELECT DISTINCT 'orders' AS source, pid, o_orderdate AS ts FROM orders JOIN stay ON o_custkey = pid
      WHERE o_orderdate BETWEEN start_ts - to_days(1) AND end_ts + to_days(1)),
    b AS (SELECT DISTINCT 'lineitem' AS source, pid, l_shipdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN stay ON o_custkey = pid
      WHERE l_shipdate BETWEEN start_ts - to_days(30) AND end_ts + to_days(30))
    SELECT * FROM a UNION ALL SELECT * FROM b""",
)
def a8(t):
    """Two tables with their own time columns and day offsets."""
    ship = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    tables = {
        "orders": t.orders.select(F.col("o_custkey").alias("key"), "o_orderdate"),
        "lineitem": ship.select(F.col("o_custkey").alias("key"), "l_shipdate"),
    }
    specs = [src.SourceSpec("orders", "o_orderdate", 1), src.SourceSpec("lineitem", "l_shipdate", 30)]
    out = None
    for name, df in src.read_in_stay(tables, specs, t.stay, "key").items():
        df = df.select(F.lit(name).alias("source"), "pid", "ts")
        out = df if out is None else out.unionByName(df)
    return out


@query(
    "a9_code_resolve",
    """WITH dim AS (SELECT DISTINCT p_name AS txt, p_type AS dt, p_brand AS code FROM part),
    w(name, label, spare) AS (VALUES ('ring', 'small ring', 'S1'), ('widget', 'red widget', 'S2'), ('gear', 'no such part', 'S3'))
    SELECT DISTINCT w.name, coalesce(dim.code, spare) AS code FROM w LEFT JOIN dim ON lower(txt) = label AND dt = 'ECONOMY'""",
)
def a9(t):
    wanted = {"ring": "small ring", "widget": "red widget", "gear": "no such part"}
    spare = {"ring": "S1", "widget": "S2", "gear": "S3"}
    dim = t.part.select("p_name", "p_brand", "p_type").distinct()
    return src.resolve_codes(dim, "p_name", "p_brand", wanted, spare, datatype=("p_type", "ECONOMY"))


@query(
    "a9_code_resolve_contains",
    """WITH w(name, label) AS (VALUES ('ring', 'ring'), ('blue', 'blue'))
    SELECT DISTINCT w.name, p_brand AS code FROM w JOIN part ON contains(lower(p_name), label) AND p_type = 'SMALL'""",
)
def a9_contains(t):
    return src.resolve_codes(
        t.part, "p_name", "p_brand", {"ring": "ring", "blue": "blue"}, {}, contains=True, datatype=("p_type", "SMALL")
    )


@query("a10_entity_store", "SELECT event_id, user_id AS pid, ts, event_type AS feature, value FROM events")
def a10(t):
    """Whole table written to the bucketed entity store and read back."""
    path = scratch(t, "store")
    src.write_entity_store(t.ev.drop("k"), path, "pid", 16)
    return t.spark.read.parquet(path).drop("bucket")


@query(
    "a11_source_check",
    """SELECT 'required_columns' AS "check", 'FAIL' AS status, 'region' AS detail
    UNION ALL SELECT 'extra_columns', 'WARN', 'noise'
    UNION ALL SELECT 'shifted_columns', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END, CAST(count(*) AS VARCHAR) FROM orders WHERE o_orderkey % 100 = 3""",
)
def a11(t):
    """Source with a missing and an extra column and some rows whose id slipped."""
    rows = t.orders.select(
        F.when(F.col("o_orderkey") % 100 == 3, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.col("o_orderkey").cast("string"))
        .alias("key"),
        F.col("o_orderdate").alias("created"),
        F.lit(1).alias("noise"),
    )
    return src.check_source(rows, ["key", "created", "region"], "key")


@query(
    "a12_stage_checks",
    f"""{with_("ev", "base", "seg", "grid", "mapped")},
    b AS (SELECT pid, start_ts + CASE WHEN pid % 10 = 0 THEN to_hours(1) ELSE to_hours(0) END AS start_ts FROM base WHERE pid % 7 <> 0),
    c AS (SELECT DISTINCT pid, step, base.start_ts + to_minutes(lo) AS bin_start FROM mapped JOIN base USING (pid) JOIN grid USING (step)),
    j AS (SELECT c.*, b.start_ts AS s FROM c LEFT JOIN b USING (pid))
    SELECT 'columns' AS "check", 'FAIL' AS status, 'feature' AS detail
    UNION ALL SELECT 'rows', 'PASS', CAST(count(*) AS VARCHAR) FROM j
    UNION ALL SELECT 'entities', 'PASS', CAST(count(DISTINCT pid) AS VARCHAR) FROM j
    UNION ALL SELECT 'first_bin_at_first_start', CASE WHEN min(bin_start) = min(s) THEN 'PASS' ELSE 'WARN' END, '' FROM j
    UNION ALL SELECT 'rows_before_start', 'WARN', CAST(count(*) FILTER (bin_start < s) AS VARCHAR) FROM j
    UNION ALL SELECT 'rows_without_entity', 'FAIL', CAST(count(*) FILTER (s IS NULL) AS VARCHAR) FROM j""",
)
def a12(t):
    """Checks over a mapped stage whose base is damaged on purpose."""
    hit = m.point_to_step(t.ev, t.base).select("pid", "step").distinct()
    cells = m.lay_grid(t.base).join(hit, ["pid", "step"], "left_semi").select("pid", "step", "bin_start")
    late = F.when(F.col("pid") % 10 == 0, F.expr("INTERVAL 1 HOUR")).otherwise(F.expr("INTERVAL 0 HOUR"))
    base = t.base.filter(F.col("pid") % 7 != 0).withColumn("start_ts", F.col("start_ts") + late)
    return q.check_stage(cells, base, ["pid", "step", "bin_start", "feature"])


@query(
    "a13_mapped_sink",
    f"""{with_("ev", "base", "seg", "grid", "mapped")} SELECT pid, step, feature, round(avg(value), 6) AS mean, count(*) AS count FROM mapped GROUP BY 1, 2, 3""",
)
def a13(t):
    """Mapped concept written by feature and read back."""
    path = scratch(t, "mapped")
    src.write_mapped(m.map_concept(t.ev, t.base, ["mean", "count"]), path)
    return rounded(t.spark.read.parquet(path).withColumn("feature", F.col("feature").cast("string")))
