"""Landmark aggregates, series, encodings, comorbidity, medication features."""

from pyspark.sql import functions as F

from tidemark.functions import diagnosis_tables as D
from tidemark.functions import drug_tables as T
from tidemark.functions import lookups as L
from tidemark.functions.timegrid import DEFAULT_GRID, Grid
from tidemark.operators import comorbidity as cm
from tidemark.operators import features as ft
from tidemark.operators import mapping as m
from tidemark.operators import medication as md
from tidemark.operators import quality as q
from tidemark.plans.cleaning import one_of, readings, READ_SQL, sql_case, sql_list, sql_one_of
from tidemark.plans.grid_and_mapping import FEATURES
from tidemark.plans.registry import query, rounded, with_
from tidemark.session import spread

N = DEFAULT_GRID.total_steps
AGGS = {
    "first": "arg_min(value, (ts, event_id))",
    "last": "arg_max(value, (ts, event_id))",
    "min": "min(value)",
    "max": "max(value)",
    "mean": "avg(value)",
    "std": "stddev_samp(value)",
    "count": "count(value)",
    "median": "median(value)",
}


def wide_sql(features, concept, where="true"):
    """``{feature}_{concept}_{agg}`` columns per pid."""
    cols = [
        f"CAST(coalesce(round({sql} FILTER (feature = '{f}' AND {where}), 6), 0) AS DOUBLE) AS \"{f}_{concept}_{a}\""
        for a, sql in AGGS.items()
        for f in features
    ]
    return ",\n      ".join(cols)


@query("e7_numeric_pivot", f"{with_('ev')} SELECT pid, {wide_sql(FEATURES, 'ev')} FROM ev GROUP BY 1")
def e7(t):
    return rounded(ft.numeric_features(t.ev, FEATURES, "ev"))


@query("e7_numeric_long", f"{with_('ev')} SELECT pid, feature, " + ", ".join(f"CAST(round({v}, 6) AS DOUBLE) AS {k}" for k, v in AGGS.items()) + " FROM ev GROUP BY 1, 2")
def e7_long(t):
    return rounded(ft.numeric_stats(t.ev))


LABEL_SQL = ", ".join(
    f"count(*) FILTER (feature = '{f}') AS \"{f}_ev_count\", CAST(count(*) FILTER (feature = '{f}') > 0 AS INT) AS \"{f}_ev_given\"" for f in FEATURES
)


@query("e8_label_pivot", f"{with_('ev')} SELECT pid, {LABEL_SQL} FROM ev GROUP BY 1")
def e8(t):
    rows = t.ev.withColumn("value", F.col("feature"))
    return ft.label_features(rows, FEATURES, "ev")


@query(
    "e9_landmark_dataset",
    f"""{with_("ev")}, a AS (SELECT pid, {wide_sql(["click", "purchase"], "ev")} FROM ev WHERE feature IN ('click', 'purchase') GROUP BY 1),
    b AS (SELECT pid, {LABEL_SQL} FROM ev GROUP BY 1)
    SELECT c_custkey AS pid, c_acctbal, CAST(c_custkey % 2 AS INT) AS target,
      {", ".join(f'coalesce(a."{f}_ev_{x}", 0) AS "{f}_ev_{x}"' for x in AGGS for f in ("click", "purchase"))},
      {", ".join(f'coalesce(b."{f}_ev_{x}", 0) AS "{f}_ev_{x}"' for x in ("count", "given") for f in ("error", "signup", "view"))}
    FROM customer LEFT JOIN a ON a.pid = c_custkey LEFT JOIN b ON b.pid = c_custkey""",
)
def e9(t):
    """Static rows joined with numeric and label features, missing ones 0."""
    static = t.customer.select(
        F.col("c_custkey").alias("pid"), "c_acctbal", (F.col("c_custkey") % 2).cast("int").alias("target")
    )
    numeric = ft.numeric_features(t.ev, ["click", "purchase"], "ev")
    rows = t.ev.withColumn("value", F.col("feature"))
    labels = ft.label_features(rows, ["error", "signup", "view"], "ev")
    return rounded(ft.assemble_dataset(static, [numeric, labels], keep=("target",)))


@query(
    "e10_series",
    f"""{with_("ev", "base", "seg", "grid", "mapped")}, a AS (SELECT pid, feature, step, avg(value) AS v FROM mapped GROUP BY 1, 2, 3)
    SELECT s.pid, s.feature, grid.step, round(a.v, 6) AS value FROM (SELECT DISTINCT pid, feature FROM mapped) s CROSS JOIN grid LEFT JOIN a
      ON a.pid = s.pid AND a.feature = s.feature AND a.step = grid.step""",
)
def e10(t):
    """Series arrays at absolute steps (shown as rows)."""
    cells = m.map_concept(t.ev, t.base, ["mean"]).withColumnRenamed("mean", "value")
    return rounded(ft.series_to_cells(ft.series(cells, N)).withColumn("step", F.col("step").cast("int")))


@query(
    "e11_label_series",
    f"""{with_("ev", "base", "seg", "grid", "mapped")}, a AS (SELECT pid, step, string_agg(DISTINCT feature, '|' ORDER BY feature) AS v FROM mapped GROUP BY 1, 2)
    SELECT b.pid, grid.step, a.v AS labels FROM (SELECT DISTINCT pid FROM mapped) b CROSS JOIN grid LEFT JOIN a ON a.pid = b.pid AND a.step = grid.step""",
)
def e11(t):
    ev = t.ev.withColumn("value", F.col("feature")).withColumn("feature", F.lit("events"))
    out = ft.label_series(m.multi_label_cells(m.point_to_step(ev, t.base)), N)
    out = ft.series_to_cells(out)
    return out.select("pid", F.col("step").cast("int").alias("step"), F.array_join("value", "|").alias("labels"))


def two_label_features(t):
    a = t.ev.select("pid", "ts", F.lit("kind").alias("feature"), F.col("feature").alias("value"))
    b = t.ev.select("pid", "ts", F.lit("decile").alias("feature"), F.floor(F.col("k") / 10).cast("string").alias("value"))
    return m.multi_label_cells(m.point_to_step(a.unionByName(b), t.base))


WORDS_SQL = """lab AS (SELECT DISTINCT pid, step, 'kind' AS feature, feature AS value FROM mapped
      UNION SELECT DISTINCT pid, step, 'decile', CAST(k // 10 AS VARCHAR) FROM mapped),
    w AS (SELECT feature, value, CAST(row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS INT) AS idx FROM (SELECT DISTINCT feature, value FROM lab WHERE pid % 3 <> 0)),
    n AS (SELECT feature, CAST(count(*) AS INT) AS n_classes FROM w GROUP BY 1),
    o AS (SELECT feature, n_classes, CAST(coalesce(sum(n_classes) OVER (ORDER BY feature ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS "offset" FROM n)"""


@query(
    "e12_multi_hot_vocabulary",
    f"""{with_("ev", "base", "seg", "grid", "mapped")}, {WORDS_SQL} SELECT feature, value, idx, n_classes, "offset" FROM w JOIN o USING (feature)""",
)
def e12_fit(t):
    return ft.vocabulary(two_label_features(t).filter(F.col("pid") % 3 != 0))


@query(
    "e12_multi_hot",
    f"""{with_("ev", "base", "seg", "grid", "mapped")}, {WORDS_SQL} SELECT DISTINCT pid, step, "offset" + idx AS dim FROM lab JOIN w USING (feature, value) JOIN o USING (feature)""",
)
def e12(t):
    labels = two_label_features(t)
    return ft.multi_hot(labels, ft.vocabulary(labels.filter(F.col("pid") % 3 != 0)))


@query(
    "e13_dense_tensor",
    f"""{with_("ev", "base", "seg", "grid", "mapped")}, a AS (SELECT pid, feature, step, avg(value) AS v FROM mapped GROUP BY 1, 2, 3)
    SELECT s.pid, CAST(f.i AS INT) AS channel, grid.step, round(a.v, 6) AS value FROM (SELECT DISTINCT pid FROM mapped) s CROSS JOIN (SELECT f, i - 1 AS i FROM (SELECT unnest({sql_list(FEATURES)}) AS f, unnest(range(1, 6)) AS i)) f CROSS JOIN grid
      LEFT JOIN a ON a.pid = s.pid AND a.feature = f.f AND a.step = grid.step""",
)
def e13(t):
    """Channel x step nested array per user (shown as rows)."""
    cells = m.map_concept(t.ev, t.base, ["mean"]).withColumnRenamed("mean", "value")
    wide = ft.dense_tensor(cells, FEATURES, N)
    rows = wide.select("pid", F.posexplode("tensor").alias("channel", "steps"))
    return rounded(rows.select("pid", "channel", F.posexplode("steps").alias("step", "value")))


@query(
    "e14_trajectory_length",
    f"""{with_("ev", "base", "seg", "grid", "mapped")}, a AS (SELECT pid, feature, step, avg(CASE WHEN k % 9 = 0 THEN 0 ELSE value END) AS v FROM mapped GROUP BY 1, 2, 3)
    SELECT pid, coalesce(max(step) FILTER (feature <> 'view' AND abs(v) > 1e-8) + 1, 0) AS traj_len FROM a GROUP BY 1""",
)
def e14(t):
    ev = t.ev.withColumn("value", F.when(F.col("k") % 9 == 0, 0.0).otherwise(F.col("value")))
    cells = m.map_concept(ev, t.base, ["mean"]).withColumnRenamed("mean", "value")
    return ft.trajectory_lengths(cells, exclude=("view",))


@query(
    "e16_latest_measures",
    f"""{with_("ev", "base")}, r AS (SELECT pid, event_id, ts, ['HEIGHT', 'WEIGHT', 'OTHER'][CAST(k % 3 AS INT) + 1] AS feature, value FROM ev)
    SELECT pid, arg_max(value, (ts, event_id)) FILTER (feature = 'HEIGHT') AS "HEIGHT", arg_max(value, (ts, event_id)) FILTER (feature = 'WEIGHT') AS "WEIGHT"
    FROM r JOIN base USING (pid) WHERE ts <= start_ts + to_days(20) AND feature <> 'OTHER' GROUP BY 1""",
)
def e16(t):
    rows = t.ev.withColumn("feature", one_of(["HEIGHT", "WEIGHT", "OTHER"], F.col("k"))).filter(F.col("feature") != "OTHER")
    base = t.base.withColumn("end_ts", F.col("start_ts") + F.expr("INTERVAL 20 DAYS"))
    return ft.latest_before_end(rows, base, ["HEIGHT", "WEIGHT"])


DIAG = [
    "DI509A", "DI110B", "DI420X", "DI426A", "DE102A", "DE119B", "DC80A", "DC509B", "DI10A", "DI12B", "DK703A", "DF101A",
    "DJ449A", "DN179A", "DB20B", "DS065A", "DG810A", "DE660A", "DR634A", "DF329B", "DC349A", "DJ150A", "DI269B", "DA419A", "DZ720EA",
]


def diagnoses(t):
    """Diagnoses of customers: code, noted and resolved time."""
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("key"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity").join(o, "l_orderkey")
    return rows.select(
        "key",
        one_of(DIAG, F.col("l_partkey")).alias("code"),
        F.col("l_shipdate").alias("noted_ts"),
        F.when(F.col("l_quantity") < 20, F.col("l_shipdate") + F.make_dt_interval(days=F.col("l_quantity").cast("int") * 20)).alias("resolved_ts"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"),
    )


DIAG_SQL = f"""dg AS MATERIALIZED (SELECT o_custkey AS key, {sql_one_of(DIAG, "l_partkey")} AS code, l_shipdate AS noted_ts,
      CASE WHEN l_quantity < 20 THEN l_shipdate + to_days(CAST(l_quantity AS INT) * 20) END AS resolved_ts, l_orderkey * 10 + l_linenumber AS event_id
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(
    "e17_enumerated_codes",
    f"""{with_("stay")}, {DIAG_SQL}, i AS (SELECT pid, noted_ts AS ts, substr(code, 2, length(code) - 2) AS code, event_id FROM dg JOIN stay ON key = pid
      WHERE noted_ts BETWEEN start_ts - to_days(1) AND end_ts + to_days(1))
    SELECT pid, code, event_id, row_number() OVER (PARTITION BY pid ORDER BY ts, code, event_id) AS position FROM i""",
)
def e17(t):
    from tidemark.functions.columns import normal_diagnosis

    codes = diagnoses(t).select(F.col("key").alias("pid"), F.col("noted_ts").alias("ts"), normal_diagnosis(F.col("code")).alias("code"), "event_id")
    return ft.numbered_codes(codes, t.stay).select("pid", "code", "event_id", "position")


@query(
    "e17_code_columns",
    f"""{with_("stay")}, {DIAG_SQL}, i AS (SELECT pid, code, row_number() OVER (PARTITION BY pid ORDER BY noted_ts, code, event_id) AS n FROM dg JOIN stay ON key = pid
      WHERE noted_ts BETWEEN start_ts - to_days(1) AND end_ts + to_days(1))
    SELECT pid, string_agg(code, ' ' ORDER BY n) AS codes, max(n) AS n_code FROM i GROUP BY 1""",
)
def e17_wide(t):
    """All codes of an entity in order, with their number."""
    codes = diagnoses(t).select(F.col("key").alias("pid"), F.col("noted_ts").alias("ts"), "code", "event_id")
    rows = ft.codes_in_order(ft.numbered_codes(codes, t.stay))
    return rows.select("pid", F.array_join("codes", " ").alias("codes"), "n_code")


@query(
    "e18_score_times",
    f"""{with_("stay")}, {DIAG_SQL}, l AS (SELECT pid, max(noted_ts) AS ts FROM dg JOIN stay ON key = pid WHERE noted_ts BETWEEN start_ts - to_days(1) AND end_ts + to_days(1) GROUP BY 1),
    s AS (SELECT c_custkey AS pid, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS riss, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal / 2 END AS niss FROM customer)
    SELECT pid, ts, 'ISS' AS feature, coalesce(riss, niss) AS value FROM s JOIN l USING (pid) WHERE coalesce(riss, niss) IS NOT NULL""",
)
def e18(t):
    k = F.col("c_custkey")
    scores = t.customer.select(
        k.alias("pid"), F.when(k % 3 == 0, F.col("c_acctbal")).alias("riss"), F.when(k % 5 != 0, F.col("c_acctbal") / 2).alias("niss")
    )
    codes = diagnoses(t).select(F.col("key").alias("pid"), F.col("noted_ts").alias("ts"))
    return ft.score_times(scores, codes, t.stay)


@query(
    "e19_max_over_sources",
    """WITH a AS (SELECT o_custkey AS pid, o_totalprice AS value FROM orders UNION ALL SELECT c_custkey, c_acctbal * 50 FROM customer)
    SELECT pid, max(value) AS value FROM a GROUP BY 1""",
)
def e19(t):
    return ft.max_over_sources(
        [
            t.orders.select(F.col("o_custkey").alias("pid"), F.col("o_totalprice").alias("value")),
            t.customer.select(F.col("c_custkey").alias("pid"), (F.col("c_acctbal") * 50).alias("value")),
        ]
    )


@query(
    "e19_row_max",
    "SELECT l_orderkey, l_linenumber, greatest(l_tax, CASE WHEN l_linenumber % 2 = 0 THEN l_discount END, l_quantity / 100) AS worst FROM lineitem",
)
def e19_row(t):
    out = t.lineitem.withColumn("d", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount"))).withColumn("q", F.col("l_quantity") / 100)
    return out.select("l_orderkey", "l_linenumber", ft.row_max(["l_tax", "d", "q"]).alias("worst"))


PRIOR_SQL = f"""{DIAG_SQL}, bs AS (SELECT o_custkey AS pid, min(o_orderdate) + to_days(900) AS start_ts FROM orders GROUP BY 1),
    pr AS (SELECT pid, substr(code, 2, length(code) - 2) AS code FROM dg JOIN bs ON key = pid
      WHERE noted_ts <= start_ts - to_days(1) AND (resolved_ts IS NULL OR resolved_ts >= start_ts + to_days(1)))"""


def prior(t):
    from tidemark.functions.columns import normal_diagnosis

    base = t.orders.groupBy(F.col("o_custkey").alias("pid")).agg((F.min("o_orderdate") + F.expr("INTERVAL 900 DAYS")).alias("start_ts"))
    base = base.withColumn("key", F.col("pid"))
    kept = cm.prior_unresolved(diagnoses(t), base)
    return base, kept.select("pid", normal_diagnosis(F.col("code")).alias("code"))


def comorbidity_sql(weights):
    rows = ", ".join(f"('{p}', '{c}')" for c, prefixes in D.CATEGORY_CODES.items() for p in prefixes)
    wrows = ", ".join(f"('{c}', {w})" for c, w in weights.items())
    return f"""WITH {PRIOR_SQL}, mp(prefix, cat) AS (VALUES {rows}), wt(cat, w) AS (VALUES {wrows}),
    f AS (SELECT DISTINCT pid, cat FROM pr JOIN mp ON starts_with(code, prefix)),
    k AS (SELECT * FROM f WHERE NOT (cat = 'solidtum' AND pid IN (SELECT pid FROM f WHERE cat = 'metacanc'))
      AND NOT (cat = 'diabunc' AND pid IN (SELECT pid FROM f WHERE cat = 'diabc')) AND NOT (cat = 'hypunc' AND pid IN (SELECT pid FROM f WHERE cat = 'hypc')))
    SELECT bs.pid, coalesce(string_agg(k.cat, ' ' ORDER BY k.cat), '') AS categories, CAST(count(k.cat) AS INT) AS n_categories,
      CAST(coalesce(sum(w), 0) AS DOUBLE) AS score FROM bs LEFT JOIN k USING (pid) LEFT JOIN wt USING (cat) GROUP BY 1"""


@query("e20_comorbidity_score", comorbidity_sql(D.CATEGORY_WEIGHTS))
def e20(t):
    base, rows = prior(t)
    return cm.comorbidity_score(rows, base)


OTHER_WEIGHTS = {c: 1 for c in D.CATEGORY_CODES} | {"ld": 3, "metacanc": 6, "rf": 2}


@query("e21_other_weights", comorbidity_sql(OTHER_WEIGHTS))
def e21(t):
    """Same operator with the caller's own weights."""
    base, rows = prior(t)
    return cm.comorbidity_score(rows, base, weights=OTHER_WEIGHTS)


@query(
    "e22_injury_scores",
    f"""WITH {DIAG_SQL}, tb AS (SELECT code, row_number() OVER (ORDER BY code) AS i FROM (SELECT unnest({sql_list(DIAG)}) AS code)),
    sv AS (SELECT code, CAST(i % 6 AS INT) AS region, CAST(i % 5 + 1 + CASE WHEN i = 17 THEN 3 ELSE 0 END AS INT) AS severity FROM tb),
    h AS (SELECT DISTINCT key AS pid, code, region, severity FROM dg JOIN sv USING (code)),
    r AS (SELECT pid, region, max(severity) AS severity FROM h GROUP BY 1, 2),
    a AS (SELECT pid, CASE WHEN max(severity) >= 6 THEN 75 ELSE sum(severity * severity) END AS iss FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY pid ORDER BY severity DESC, region) <= 3) GROUP BY 1),
    b AS (SELECT pid, CASE WHEN max(severity) >= 6 THEN 75 ELSE sum(severity * severity) END AS niss, max(severity) AS max_severity FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY pid ORDER BY severity DESC, code) <= 3) GROUP BY 1)
    SELECT pid, CAST(iss AS INT) AS iss, CAST(niss AS INT) AS niss, max_severity FROM a JOIN b USING (pid)""",
)
def e22(t):
    """Injury scores with the caller's (code, region, severity) table."""
    rows = [(c, i % 6, i % 5 + 1 + (3 if i == 17 else 0)) for i, c in enumerate(sorted(DIAG), 1)]
    table = t.lit_frame(rows, "code string, region int, severity int")
    injuries = diagnoses(t).select(F.col("key").alias("pid"), "code")
    return cm.injury_scores(injuries, table)


def flag_sql(flags):
    return ", ".join(
        f"coalesce(max(CAST({' OR '.join(f'starts_with(code, {chr(39)}{p}{chr(39)})' for p in ps)} AS INT)), 0) AS {name}" for name, ps in flags.items()
    )


FLAG_SQL = f"""WITH {DIAG_SQL}, bs AS (SELECT o_custkey AS pid, min(o_orderdate) + to_days(900) AS base_ts FROM orders GROUP BY 1),
    j AS (SELECT bs.pid, code, date_diff('day', base_ts, noted_ts) AS d FROM bs JOIN dg ON key = bs.pid WHERE resolved_ts IS NULL OR resolved_ts > base_ts)"""


def flag_base(t):
    base = t.orders.groupBy(F.col("o_custkey").alias("pid")).agg((F.min("o_orderdate") + F.expr("INTERVAL 900 DAYS")).alias("base_ts"))
    return base.withColumn("key", F.col("pid"))


@query(
    "e23_chronic_flags",
    f"""{FLAG_SQL}, f AS (SELECT pid, {flag_sql(D.CHRONIC_FLAGS)} FROM j WHERE d <= 0 GROUP BY 1)
    SELECT bs.pid, {", ".join(f"coalesce({n}, 0) AS {n}" for n in D.CHRONIC_FLAGS)} FROM bs LEFT JOIN f USING (pid)""",
)
def e23(t):
    return cm.prefix_flags(flag_base(t), diagnoses(t), D.CHRONIC_FLAGS, None, 0).drop("key", "base_ts")


@query(
    "e23_complication_flags",
    f"""{FLAG_SQL}, f AS (SELECT pid, {flag_sql(D.COMPLICATION_FLAGS)} FROM j WHERE d BETWEEN 0 AND 30 GROUP BY 1)
    SELECT bs.pid, {", ".join(f"coalesce({n}, 0) AS {n}" for n in D.COMPLICATION_FLAGS)} FROM bs LEFT JOIN f USING (pid)""",
)
def e23_hc(t):
    return cm.prefix_flags(flag_base(t), diagnoses(t), D.COMPLICATION_FLAGS, 0, 30).drop("key", "base_ts")


# ---- medication ------------------------------------------------------------------------

CODES = [
    "J01FA01", "J01DH02", "J01DD99", "J01XB01", "J01ZZ99", "C01CA26", "C01CA03", "C01CA24", "C01BD01", "N05CH01", "N05CM18",
    "N01AX10", "N05CD08", "M03AC09", "M03AC11", "M03AB01", "B01AB10", "B01AB05", "B01AB01", "B01AF02", "B01AA03", "B01AC06",
    "B01AC04", "B02AA02", "B02BB01", "B02BD01", "B02BD08", "C03CA01", "C03AA03", "C03BA08", "B05AA01", "B05XA02", "B05XA03",
    "B05XA01", "A10AB01", "A10AE04", "B05BA01", "N02AX02", "N02AA01", "N02AB02", "N01AH01", "N01BB02", "N01AX14", "N01AF03",
    "V03AB15", "V03AB23", "C07AB02", "C01AA05", "N01AB08", "X01",
]
DOSE_UNITS = ["mg", "mg/t", " Ml/Time ", "stk", "MG"]


def doses(t):
    """Coded doses of customers on 20-day cells from their first line."""
    grid = Grid(intervals={"3000D": "20D"}, widths=None)
    rows = t.coded.select(
        "pid",
        "ts",
        one_of(CODES, F.col("p_partkey") + F.col("l_linenumber")).alias("code"),
        F.when(F.col("l_orderkey") % 11 == 0, "ukendt").otherwise((F.col("dose") * 100).cast("string")).alias("dose"),
        F.when(F.col("l_orderkey") % 13 != 0, one_of(DOSE_UNITS, F.col("l_orderkey"))).alias("unit"),
    )
    return m.point_to_step(spread(rows, "pid"), m.entity_span(rows), grid)


DOSE_SQL = f"""cd AS MATERIALIZED (SELECT o_custkey AS pid, l_shipdate AS ts, {sql_one_of(CODES, "(l_partkey + l_linenumber)")} AS code,
      CASE WHEN l_orderkey % 11 = 0 THEN 'ukendt' ELSE CAST(l_quantity * 100 AS VARCHAR) END AS dose,
      CASE WHEN l_orderkey % 13 <> 0 THEN {sql_one_of(DOSE_UNITS, "l_orderkey")} END AS unit FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    ds AS (SELECT pid, CAST(date_diff('day', min(ts) OVER (PARTITION BY pid), ts) // 20 AS INT) AS step, code, dose, unit FROM cd),
    dd AS (SELECT * FROM ds QUALIFY row_number() OVER (PARTITION BY pid, step, code ORDER BY coalesce(TRY_CAST(dose AS DOUBLE), 0) DESC, dose DESC NULLS LAST, unit DESC NULLS LAST) = 1)"""


@query("e25_strongest_dose", f"WITH {DOSE_SQL} SELECT pid, step, code, dose, unit FROM dd")
def e25(t):
    return md.strongest_dose(doses(t))


def codes_in(*names):
    codes = [c for n in names for c in T.SIGNAL_CODES[n]]
    return "code IN (" + ", ".join(f"'{c}'" for c in codes) + ")"


def begins(*prefixes):
    return "(" + " OR ".join(f"code LIKE '{p}%'" for p in prefixes) + ")"


INF = "coalesce(lower(trim(unit)) IN (" + ", ".join(f"'{u}'" for u in T.INFUSION_UNITS) + "), false)"
MG = "coalesce(lower(trim(unit)) = 'mg', false)"
DOSE = "TRY_CAST(dose AS DOUBLE)"
HIGH = "coalesce((code = 'B01AB10' AND x > 4500) OR (code = 'B01AB04' AND x > 5000) OR (code = 'B01AB05' AND x > 40), false)"


def abx_case():
    t = T.TIER_TABLES["antibiotic_escalation"]
    ex = " ".join(f"WHEN code = '{c}' THEN {lv}" for c, lv in t["exact"].items())
    pf = " ".join(f"WHEN {begins(p)} THEN {lv}" for p, lv in t["prefix"].items())
    return f"CASE {ex} {pf} WHEN code LIKE 'J01DD%' THEN 4 END"


SIGNALS = [
    *T.SIGNAL_CODES, *T.SIGNAL_PREFIXES, "antibiotic", "propofol_sedation", "propofol_surgical", "nmba_infusion", "nmba_bolus", "prophylactic_lmwh",
    "therapeutic_lmwh", "iv_heparin", "continuous_loop", "iv_insulin", "strong_or_icu_opioid", "therapeutic_anticoag",
]

TAG_SQL = f"""tg AS (SELECT *, {INF} AS inf, {MG} AS mg, {DOSE} AS x FROM dd),
    sg AS (SELECT pid, step, code, code LIKE 'J01%' AND NOT coalesce(code = 'J01FA01' AND x <= 250 AND mg, false) AS antibiotic,
      code = 'N01AX10' AND NOT mg AS propofol_sedation, code = 'N01AX10' AND mg AS propofol_surgical,
      code = 'M03AC11' OR (code = 'M03AC09' AND inf) AS nmba_infusion, code = 'M03AB01' OR (code = 'M03AC09' AND NOT inf) AS nmba_bolus,
      code IN ('B01AB10', 'B01AB04', 'B01AB05') AND NOT {HIGH} AS prophylactic_lmwh,
      (code IN ('B01AB10', 'B01AB04', 'B01AB05') AND {HIGH}) OR (code = 'B01AB01' AND inf) OR {codes_in("doac", "vka")} AS therapeutic_anticoag,
      {codes_in("loop_diuretic")} AND inf AS continuous_loop, code IN ('A10AB01', 'A10AB05') AND inf AS iv_insulin,
      code IN ('B01AB10', 'B01AB04', 'B01AB05') AND {HIGH} AS therapeutic_lmwh, code = 'B01AB01' AND inf AS iv_heparin,
      {codes_in("strong_opioid")} OR code LIKE 'N01AH%' AS strong_or_icu_opioid,
      {", ".join(f"{codes_in(n)} AS {n}" for n in T.SIGNAL_CODES)}, {", ".join(f"{begins(*p)} AS {n}" for n, p in T.SIGNAL_PREFIXES.items())} FROM tg)"""


@query(
    "e24_signal_tags",
    f"""WITH {DOSE_SQL}, {TAG_SQL} SELECT pid, step, code, {", ".join(SIGNALS)},
      CAST(CASE WHEN antibiotic THEN {abx_case()} END AS INT) AS abx_level FROM sg""",
)
def e24(t):
    """Every signal flag of every record."""
    out = md.tag_signals(md.strongest_dose(doses(t)))
    return out.select("pid", "step", "code", *SIGNALS, "abx_level")


ROLL_SQL = f"""rl AS (SELECT pid, step, coalesce(max(CASE WHEN antibiotic THEN {abx_case()} END), 0) AS abx,
      count(DISTINCT code) FILTER (antibiotic) AS n_abx,
      {", ".join(f"coalesce(bool_or({codes_in(n)}), false) AS {n}" for n in ("periop_vaso", "icu_vaso", "amiodarone", "ward_sed", "icu_light_sed", "deep_benzo", "txa", "rfviia", "loop_diuretic", "albumin", "bicarbonate", "metolazone", "mild_opioid", "esketamine", "thiopental", "cv_comorbidity", "hemostatic"))},
      {", ".join(f"bool_or({n}) AS {n}" for n in ("propofol_sedation", "propofol_surgical", "nmba_infusion", "nmba_bolus", "prophylactic_lmwh", "therapeutic_anticoag", "continuous_loop", "iv_insulin"))},
      {", ".join(f"bool_or({begins(*T.SIGNAL_PREFIXES[n])}) AS {n}" for n in T.SIGNAL_PREFIXES)},
      {", ".join(f"count(DISTINCT code) FILTER ({codes_in(n)}) AS n_{n}" for n in ("icu_vaso", "antiplatelet", "electrolyte", "hemostatic", "reversal"))},
      count(DISTINCT code) FILTER ({codes_in("strong_opioid")} OR code LIKE 'N01AH%') AS n_strong FROM sg GROUP BY 1, 2)"""

TIER_SQL = """ti AS (SELECT *, CASE WHEN n_icu_vaso >= 2 OR (icu_vaso AND amiodarone) THEN 3 WHEN icu_vaso THEN 2 WHEN periop_vaso THEN 1 ELSE 0 END AS hemo,
      CASE WHEN (propofol_sedation OR deep_benzo) AND nmba_infusion THEN 5 WHEN (propofol_sedation OR deep_benzo) AND nmba_bolus THEN 4
        WHEN propofol_sedation OR deep_benzo THEN 3 WHEN icu_light_sed THEN 2 WHEN ward_sed THEN 1 ELSE 0 END AS sed,
      CASE WHEN rfviia OR n_hemostatic >= 2 THEN 4 WHEN hemostatic THEN 3 WHEN therapeutic_anticoag OR n_antiplatelet >= 2 THEN 2
        WHEN prophylactic_lmwh OR n_antiplatelet = 1 OR txa THEN 1 ELSE 0 END AS coag,
      CASE WHEN continuous_loop OR bicarbonate OR CAST(loop_diuretic AS INT) + CAST(iv_insulin AS INT) + CAST(n_electrolyte >= 2 AS INT) + CAST(albumin AS INT)
          + CAST(tpn AS INT) + CAST(bicarbonate AS INT) + CAST(metolazone AS INT) + CAST(continuous_loop AS INT) >= 3 THEN 4
        WHEN albumin OR tpn OR metolazone OR (loop_diuretic AND (iv_insulin OR n_electrolyte >= 2 OR albumin)) THEN 3
        WHEN loop_diuretic OR iv_insulin OR n_electrolyte >= 2 THEN 2 WHEN oral_diuretic OR sc_insulin OR n_electrolyte = 1 THEN 1 ELSE 0 END AS organ,
      CASE WHEN n_strong >= 2 THEN 3 WHEN n_strong >= 1 THEN 2 WHEN mild_opioid THEN 1 ELSE 0 END AS opioid,
      CASE WHEN thiopental THEN 3 WHEN esketamine OR propofol_surgical OR volatile OR (icu_opioid AND (propofol_sedation OR propofol_surgical)) THEN 2 WHEN regional THEN 1 ELSE 0 END AS surg,
      least(n_reversal, 2) AS acute,
      CAST(beta_blocker AS INT) + CAST(sc_insulin AS INT) + CAST(antiplatelet_broad AS INT) + CAST(oral_anticoag_broad AS INT) + CAST(cv_comorbidity AS INT) AS comorb FROM rl)"""


@query(
    "e26_signal_rollup",
    f"""WITH {DOSE_SQL}, {TAG_SQL} SELECT pid, step, {", ".join(f"CAST(count(DISTINCT code) FILTER ({n}) AS INT) AS {n}" for n in SIGNALS)},
      CAST(coalesce(max(CASE WHEN antibiotic THEN {abx_case()} END), 0) AS INT) AS abx_level FROM sg GROUP BY 1, 2""",
)
def e26(t):
    """Every signal per cell: how many codes carry it."""
    out = md.roll_up_signals(md.tag_signals(md.strongest_dose(doses(t))))
    return out.select("pid", "step", *SIGNALS, F.coalesce("abx_level", F.lit(0)).alias("abx_level"))


FINAL_TIERS = """SELECT pid, step, CAST(abx AS INT) AS abx_tier, CAST(n_abx AS INT) AS abx_n_concurrent, hemo AS hemodynamic_tier, sed AS sedation_tier,
      coag AS coagulation_tier, organ AS organ_support_tier, opioid AS opioid_tier, surg AS surgical_tier, CAST(acute AS INT) AS acute_deterioration, comorb AS comorbidity_med_count,
      CAST(abx > 0 AS INT) + CAST(hemo > 0 AS INT) + CAST(sed > 0 AS INT) + CAST(coag > 0 AS INT) + CAST(organ > 0 AS INT) + CAST(opioid > 0 AS INT)
        + CAST(surg > 0 AS INT) + CAST(acute > 0 AS INT) + CAST(comorb > 0 AS INT) AS n_active_dimensions,
      round(CAST(greatest(abx / 6.0, hemo / 3.0, sed / 5.0, coag / 4.0, organ / 4.0, opioid / 3.0, surg / 3.0, acute / 2.0) AS DOUBLE), 6) AS max_severity_signal FROM ti"""


@query("e27_composite_tiers", f"WITH {DOSE_SQL}, {TAG_SQL}, {ROLL_SQL}, {TIER_SQL} {FINAL_TIERS}")
def e27(t):
    out = md.composite_tiers(md.roll_up_signals(md.tag_signals(md.strongest_dose(doses(t)))))
    return rounded(out.select("pid", "step", *md.COMPOSITE_FEATURES))


@query(
    "e28_composite_series",
    f"""WITH {DOSE_SQL}, {TAG_SQL}, {ROLL_SQL}, {TIER_SQL}, x AS ({FINAL_TIERS}),
    l AS (UNPIVOT (SELECT pid, step, {", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in md.COMPOSITE_FEATURES)} FROM x) ON {", ".join(md.COMPOSITE_FEATURES)} INTO NAME feature VALUE v)
    SELECT s.pid, f.feature, CAST(g.i AS INT) AS step, round(coalesce(l.v, 0), 6) AS value FROM (SELECT DISTINCT pid FROM x) s, (SELECT DISTINCT feature FROM l) f,
      UNNEST(range(0, 150)) g(i) LEFT JOIN l ON l.pid = s.pid AND l.feature = f.feature AND l.step = g.i""",
)
def e28(t):
    """Composite features as series with 0 where no drug was given."""
    cells = rounded(md.composite_features(doses(t)))  # before the series are laid out: most of their cells are empty
    rows = ft.series_to_cells(ft.series(cells, 150))
    return rows.select("pid", "feature", F.col("step").cast("int").alias("step"), F.coalesce("value", F.lit(0.0)).alias("value"))


def tier_case(name):
    t = T.TIER_TABLES[name]
    parts = [f"WHEN code = '{c}' THEN {lv}" for c, lv in t["exact"].items()]
    for part in ("prefix", "default"):
        parts += [f"WHEN {begins(p)} THEN {lv}" for p, lv in t.get(part, {}).items()]
    return f"CAST(CASE WHEN length(code) < 4 THEN NULL {' '.join(parts)} END AS INT)"


@query(
    "e29_tier_maps",
    f"""WITH {DOSE_SQL}, c AS (SELECT DISTINCT code FROM cd) SELECT code, {", ".join(f"{tier_case(n)} AS {n}" for n in T.TIER_TABLES)} FROM c""",
)
def e29(t):
    """All eight tier maps over the codes in use."""
    codes = doses(t).select("code").distinct()
    return codes.select("code", *[tm.tier(F.col("code")).alias(n) for n, tm in md.TIER_MAPS.items()])


CATEGORIES = {
    "antibiotics": {"prefixes": ["J01"], "mapping": "antibiotic_escalation", "exclusions": [{"code": "J01FA01", "threshold": 250, "unit": "mg"}]},
    "vasopressor": {"prefixes": ["C01CA03", "C01CA24", "H01BA01"], "mapping": "vasopressor_escalation"},
    "beta_blocker": {"prefixes": ["C07"]},
    "anticoag": {"prefixes": ["B01AB", "B01AF", "B01AA"], "mapping": "anticoag_escalation"},
}


@query(
    "e30_tier_features",
    f"""WITH {DOSE_SQL}, tl AS (
      SELECT pid, step, code, 'antibiotics' AS category, {tier_case("antibiotic_escalation")} AS lv FROM ds WHERE code LIKE 'J01%'
        AND NOT coalesce(code LIKE 'J01FA01%' AND TRY_CAST(dose AS DOUBLE) <= 250 AND trim(unit) = 'mg', false)
      UNION ALL SELECT pid, step, code, 'vasopressor', {tier_case("vasopressor_escalation")} FROM ds WHERE code IN ('C01CA03', 'C01CA24', 'H01BA01')
      UNION ALL SELECT pid, step, code, 'beta_blocker', 1 FROM ds WHERE code LIKE 'C07%'
      UNION ALL SELECT pid, step, code, 'anticoag', {tier_case("anticoag_escalation")} FROM ds WHERE {begins("B01AB", "B01AF", "B01AA")})
    SELECT pid, step, category, max(lv) AS max_level, count(DISTINCT code) AS n_distinct FROM tl WHERE lv IS NOT NULL GROUP BY 1, 2, 3""",
)
def e30(t):
    return md.tier_features(doses(t), CATEGORIES)


@query(
    "e31_dose_exclusion",
    f"""WITH {DOSE_SQL} SELECT pid, step, code, dose FROM ds WHERE NOT coalesce(code LIKE 'J01FA01%' AND TRY_CAST(dose AS DOUBLE) <= 2500 AND trim(unit) = 'mg', false)
      AND NOT coalesce(code LIKE 'B01AC%' AND TRY_CAST(dose AS DOUBLE) <= 1000, false)""",
)
def e31(t):
    rules = [{"code": "J01FA01", "threshold": 2500, "unit": "mg"}, {"code": "B01AC", "threshold": 1000}]
    return md.exclude_doses(doses(t), rules).select("pid", "step", "code", "dose")


RULES = {
    "J": [{"level": 1, "type": "count", "min": 1, "max": 1}, {"level": 2, "type": "count", "min": 2}, {"level": 3, "type": "codes", "required": ["J01D", "J01X"]}],
    "N": [{"level": 1, "type": "count", "min": 1, "max": 2}, {"level": 4, "type": "codes", "required": ["N05C", "N01A", "N02A"]}, {"level": 2, "type": "count", "min": 3}],
}


def cell_codes(t):
    return doses(t).select("pid", "step", F.substring("code", 1, 1).alias("value"), F.substring("code", 1, 4).alias("sub_code"))


@query(
    "e32_profile_levels",
    f"""WITH {DOSE_SQL}, s AS (SELECT DISTINCT pid, step // 10 AS step, substr(code, 1, 1) AS category, substr(code, 1, 4) AS sc FROM ds),
    a AS (SELECT pid, step, category, count(*) AS n, list(sc) AS codes FROM s WHERE category IN ('J', 'N') GROUP BY 1, 2, 3)
    SELECT pid, CAST(step AS INT) AS step, category, CASE category WHEN 'J' THEN CASE WHEN list_has_all(codes, ['J01D', 'J01X']) THEN 3 WHEN n >= 2 THEN 2 ELSE 1 END
      ELSE CASE WHEN list_has_all(codes, ['N05C', 'N01A', 'N02A']) THEN 4 WHEN n >= 3 THEN 2 ELSE 1 END END AS level FROM a""",
)
def e32(t):
    wide = cell_codes(t).withColumn("step", F.floor(F.col("step") / 10).cast("int"))
    return md.profile_levels(wide, RULES)


@query(
    "e33_strip_profiled",
    f"WITH {DOSE_SQL} SELECT DISTINCT pid, step, substr(code, 1, 1) AS value FROM ds WHERE substr(code, 1, 1) NOT IN ('J', 'N')",
)
def e33(t):
    return md.strip_profiled(cell_codes(t), list(RULES)).select("pid", "step", "value").distinct()


@query(
    "e34_category_codes",
    """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS seg, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS bal FROM customer),
    v AS (SELECT seg, CAST(row_number() OVER (ORDER BY seg) AS INT) AS code FROM (SELECT DISTINCT seg FROM c WHERE seg IS NOT NULL AND c_custkey % 2 = 0))
    SELECT c_custkey, coalesce(code, 0) AS seg, coalesce(bal, 0) AS bal, bal IS NULL AS bal_na FROM c LEFT JOIN v USING (seg)""",
)
def e34(t):
    k = F.col("c_custkey")
    df = t.customer.select(
        "c_custkey", F.when(k % 7 != 0, F.col("c_mktsegment")).alias("seg"), F.when(k % 5 != 0, F.col("c_acctbal")).alias("bal")
    )
    return ft.category_codes(ft.na_indicators(df, ["bal"]), ["seg"], df.filter(k % 2 == 0))


@query(
    "e35_one_hot_schema",
    """SELECT c_custkey AS pid, CAST(c_mktsegment = 'BUILDING' AS DOUBLE) AS "seg_BUILDING", CAST(c_mktsegment = 'MACHINERY' AS DOUBLE) AS "seg_MACHINERY",
      0.0::DOUBLE AS "lost_x", c_acctbal AS bal, 0.0::DOUBLE AS missing FROM customer""",
)
def e35(t):
    df = t.customer.select(F.col("c_custkey").alias("pid"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    return ft.one_hot(df, {"seg": ["BUILDING", "MACHINERY"], "lost": ["x"]}, ["bal", "missing"])


@query(
    "e36_feature_summary",
    f"""{with_("ev", "base")} SELECT pid, feature, count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean
      FROM ev JOIN base USING (pid) WHERE ts - start_ts <= to_hours(240) GROUP BY 1, 2""",
)
def e36(t):
    from tidemark.operators.cohort import elapsed_window

    rows = elapsed_window(t.ev.join(t.base.select("pid", "start_ts"), "pid"), 240)
    return q.feature_summary(rows, ["pid", "feature"], 6)


@query("e36_name_list", "SELECT o_custkey AS pid, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS names FROM orders GROUP BY 1")
def e36_names(t):
    return q.name_list(t.orders.withColumnRenamed("o_custkey", "pid"), ["pid"], "o_orderpriority")


REG = f"{with_('ev')}, s AS (SELECT *, CASE WHEN ts <= TIMESTAMP '2024-01-20' THEN 'train' ELSE 'holdout' END AS split FROM ev)"


def split_events(t):
    return t.ev.withColumn("split", F.when(F.col("ts") <= F.expr("timestamp_ntz'2024-01-20 00:00:00'"), "train").otherwise("holdout"))


@query(
    "e37_registration_counts",
    f"{REG} SELECT split, count(*) AS n_rows, count(DISTINCT pid) AS n_entities FROM s GROUP BY 1 UNION ALL SELECT 'all', count(*), count(DISTINCT pid) FROM s",
)
def e37(t):
    return q.registration_counts(split_events(t))


@query(
    "e37_top_features",
    f"""{REG}, c AS (SELECT split, feature, count(*) AS n FROM s GROUP BY 1, 2)
    SELECT *, CAST(row_number() OVER (PARTITION BY split ORDER BY n DESC, feature) AS INT) AS rank FROM c QUALIFY rank <= 3""",
)
def e37_top(t):
    return q.top_features(split_events(t), 3)


RANGES = {"click": (1.0, 200.0), "error": (0.5, 50.0), "purchase": (5.0, 100.0), "view": (0.0, 400.0)}
RANGE_SQL = "r(feature, lo, hi) AS (VALUES " + ", ".join(f"('{f}', {a}::DOUBLE, {b}::DOUBLE)" for f, (a, b) in RANGES.items()) + ")"


@query(
    "e38_range_report",
    f"""{with_("ev")}, {RANGE_SQL} SELECT feature, count(*) AS n, min(value) AS min, max(value) AS max, count(*) FILTER (value < lo) AS n_below, count(*) FILTER (value > hi) AS n_above,
      min(value) FILTER (value < lo) AS min_below, max(value) FILTER (value < lo) AS max_below, min(value) FILTER (value > hi) AS min_above, max(value) FILTER (value > hi) AS max_above,
      round(count(*) FILTER (value < lo OR value > hi) * 100.0 / count(*), 6) AS pct_lost FROM ev JOIN r USING (feature) GROUP BY 1""",
)
def e38(t):
    return rounded(q.range_report(t.ev, RANGES))


@query(
    "e38_outside_buckets",
    f"""{with_("ev")}, {RANGE_SQL}, o AS (SELECT feature, value, min(value) OVER (PARTITION BY feature) AS a, max(value) OVER (PARTITION BY feature) AS b FROM ev JOIN r USING (feature) WHERE value > hi)
    SELECT feature, CAST(CASE WHEN a = b THEN 0 ELSE greatest(0, least(9, ceil((value - a) / ((b - a) / 10)) - 1)) END AS INT) AS bucket, count(*) AS n FROM o GROUP BY 1, 2""",
)
def e38_buckets(t):
    return q.outside_buckets(t.ev, RANGES)


@query(
    "e39_concept_types",
    f"""{with_("ev")}, {READ_SQL} SELECT param AS feature, count(*) AS n_total, count(DISTINCT value) AS n_unique, count(*) FILTER (TRY_CAST(value AS DOUBLE) IS NULL) AS n_non_numeric,
      round(count(DISTINCT value) / count(*), 6) AS unique_ratio, count(*) FILTER (TRY_CAST(value AS DOUBLE) IS NULL) > 0 OR (count(DISTINCT value) / count(*) < 0.2 AND count(DISTINCT value) < 100) AS is_categorical FROM vit GROUP BY 1""",
)
def e39(t):
    return rounded(q.concept_types(readings(t).withColumnRenamed("param", "feature")))


STATE_SQL = f"""{with_("ev", "base", "seg", "grid", "mapped")}, ln AS (SELECT pid, max(step) + 1 AS traj_len FROM mapped GROUP BY 1),
    st AS (SELECT ln.pid, f.feature, g.step, CASE WHEN g.step >= traj_len THEN 'padding' WHEN c.pid IS NOT NULL THEN 'present' ELSE 'missing' END AS state
      FROM ln CROSS JOIN (SELECT unnest({sql_list(FEATURES)}) AS feature) f CROSS JOIN grid g LEFT JOIN (SELECT DISTINCT pid, feature, step FROM mapped) c
      ON c.pid = ln.pid AND c.feature = f.feature AND c.step = g.step)"""


def completeness_states(t):
    cells = m.map_concept(t.ev, t.base, ["mean"]).withColumnRenamed("mean", "value")
    lengths = cells.groupBy("pid").agg((F.max("step") + 1).alias("traj_len"))
    return q.completeness(cells, lengths, FEATURES, N)


@query("e40_completeness", f"{STATE_SQL} SELECT pid, feature, step, state FROM st")
def e40(t):
    return completeness_states(t)


@query(
    "e40_completeness_rate",
    f"{STATE_SQL} SELECT feature, round(avg(CASE WHEN state = 'present' THEN 1 ELSE 0 END), 6) AS rate, count(*) AS n FROM st WHERE state <> 'padding' GROUP BY 1",
)
def e40_rate(t):
    return rounded(q.completeness_rate(completeness_states(t)))


@query(
    "e41_note_lines",
    "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1",
)
def e41(t):
    """Turns of a conversation joined in order."""
    return ft.join_lines(t.conversations, ["conv_id"], ["turn"], "text")


@query(
    "l2_tier_registry",
    f"WITH {DOSE_SQL}, k(mapping, code, expected) AS (VALUES "
    + ", ".join(f"('{n}', '{c}', {v})" for n, cs in T.TIER_SPOT_CHECKS.items() for c, v in cs.items())
    + ") SELECT mapping, code, count(*) AS n, any_value(expected) AS expected, any_value(expected) AS tier, true AS ok FROM cd JOIN k USING (code) GROUP BY 1, 2",
)
def l2(t):
    """Spot checks of the registered maps on the codes of all doses."""
    return md.check_tiers(doses(t).select("code"))


@query(
    "l3_configured_functions",
    f"""{with_("ev", "base", "seg", "grid", "mapped")}
    SELECT 'vitals' AS concept, pid, step, feature, round(avg(value), 6) AS a, round(stddev_samp(value), 6) AS b FROM mapped WHERE feature IN ('click', 'view') GROUP BY 2, 3, 4
    UNION ALL SELECT 'labs', pid, step, feature, max(value), NULL FROM mapped WHERE feature = 'purchase' GROUP BY 2, 3, 4""",
)
def l3(t):
    """Aggregate functions chosen per concept by configuration."""
    config = {"vitals": (["click", "view"], ["mean", "std"]), "labs": (["purchase"], ["max"])}
    out = None
    for concept, (features, functions) in config.items():
        cells = m.map_concept(t.ev.filter(F.col("feature").isin(*features)), t.base, functions)
        cols = [F.col(f) for f in functions] + [F.lit(None).cast("double")] * (2 - len(functions))
        part = cells.select(F.lit(concept).alias("concept"), *m.CELL, cols[0].alias("a"), cols[1].alias("b"))
        out = part if out is None else out.unionByName(part)
    return rounded(out)
