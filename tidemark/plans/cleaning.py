"""Cleaning, recoding and concept filters over readings derived from the event table."""

from pyspark.sql import functions as F

from tidemark.functions import columns as c
from tidemark.functions import lookups as L
from tidemark.functions.classify import department, drug_class, drug_classes, hospital, longest_prefix, prefix_join, rule
from tidemark.operators import cohort as co
from tidemark.operators import concepts as cp
from tidemark.operators import trajectory as tr
from tidemark.plans.registry import query, rounded, with_

PARAMS = [
    "Saturation", "Puls", "BT", "NIBP", "Temperatur", "Blæretemperatur", "Højde", "Vægt",
    "Resp.frekvens", "ABP Puls (fra A-kanyle)", "ART inv BT", "Andet",
]
PAIRS = ["BT", "NIBP", "ART inv BT"]
SCORES = ["SAT (score)", "Temp. (score)", "BT (score)", "RF (score)", "EWS korr. total score"]
LABS = ["LAKTAT;P(AB)", "LAKTAT(POC);P(VB)", "BASE EXCESS;ECV", "HÆMOGLOBIN;B", "LEUKOCYTTER;B", "TEG-R", "UKENDT"]
DRUGS = ["C01CA03", "J01DD04", "N02AA01", "B05BB01", "A10AB01", "B01AC06", "N05CD08", "X99", "M03AC09", "B05AA01", "N0"]
ACTIONS = ["Administreret", "Ny pose", "Annulleret", "Genstartet"]
PROCEDURES = ["KAAA10", "KB", "BGDA0", "BGAZ", "KNFJ", "KQXX", "BGX1", "ZZ", "KPA1"]
UNITS = [
    "RH TRAUMECENTER", "HGH akutmodtagelse, 1", "RH børnemodtagelse akutmodtagelse", "BFH F. modtagelse",
    "NOH operationsgang 2", "RH øjenkl. operation", "RH intensiv 4131", "SJ KØGE ITA 2", "SJ HOLB sengeafsnit, A",
    "AHH amb. kir", "SJ ROS Kirurgi", "ukendt afdeling", "SJ NÆSTVED Bedøvelse og operation", "RH reum/ryg op, x",
]


def sql_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def one_of(values, i):
    return F.element_at(F.lit(values), (i % len(values) + 1).cast("int"))


def sql_one_of(values, i):
    return f"{sql_list(values)}[CAST({i} % {len(values)} AS INT) + 1]"


READ_SQL = f"""vt AS (SELECT *, {sql_one_of(PARAMS, "k")} AS param FROM ev),
    vit AS (SELECT pid, ts, event_id, k, param, CASE WHEN k % 17 = 0 THEN 'neg'
      WHEN param IN ('BT', 'NIBP', 'ART inv BT') THEN CASE WHEN k % 5 = 0 THEN CAST(CAST(floor(value) AS INT) AS VARCHAR)
        ELSE CAST(CAST(floor(value) AS INT) AS VARCHAR) || '/' || CAST(CAST(floor(value / 2) AS INT) AS VARCHAR) END
      ELSE CAST(value AS VARCHAR) END AS value FROM vt)"""


def readings(t):
    """Vital readings: a parameter name per event, pairs, a few texts that are no numbers."""
    ev = t.ev.withColumn("param", one_of(PARAMS, F.col("k")))
    whole = F.floor("value").cast("int").cast("string")
    half = F.floor(F.col("value") / 2).cast("int").cast("string")
    pair = F.when(F.col("k") % 5 == 0, whole).otherwise(F.concat(whole, F.lit("/"), half))
    value = F.when(F.col("k") % 17 == 0, "neg").when(F.col("param").isin(*PAIRS), pair).otherwise(F.col("value").cast("string"))
    return ev.select("pid", "ts", "event_id", "k", "param", value.alias("value"))


SCORE_SQL = f"""sc AS (SELECT pid, ts, event_id, {sql_one_of(SCORES, "event_id")} AS param, CAST(CAST(floor(value) AS INT) AS VARCHAR)
      || CASE WHEN event_id % 5 = 2 THEN '/60' ELSE '' END || CASE WHEN event_id % 5 <> 4 THEN ' (' || CAST(k % 4 AS VARCHAR) || ')' ELSE '' END AS value FROM ev)"""


def score_rows(t):
    i = F.col("event_id") % 5
    text = F.concat(
        F.floor("value").cast("int").cast("string"),
        F.when(i == 2, "/60").otherwise(""),
        F.when(i != 4, F.concat(F.lit(" ("), (F.col("k") % 4).cast("string"), F.lit(")"))).otherwise(""),
    )
    return t.ev.select("pid", "ts", "event_id", one_of(SCORES, F.col("event_id")).alias("param"), text.alias("value"))


def sql_case(col, mapping, default="NULL"):
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {default} END"


RENAME = {k: v for k, v in {**L.VITAL_NAMES, **L.BODY_NAMES}.items() if k in PARAMS}


@query(
    "b1_rename",
    f"{with_('ev')}, {READ_SQL} SELECT event_id, {sql_case('param', RENAME, 'param')} AS feature FROM vit",
)
def b1(t):
    return readings(t).select("event_id", c.rename_values(F.col("param"), {**L.VITAL_NAMES, **L.BODY_NAMES}).alias("feature"))


@query(
    "b2_whitelist",
    f"""{with_("ev")}, {READ_SQL}, r AS (SELECT event_id, {sql_case("param", RENAME, "param")} AS feature FROM vit)
    SELECT * FROM r WHERE feature IN ('SPO2', 'HR', 'RESPIRATORYRATE', 'SBP', 'MAP', 'TEMP', 'DBP')""",
)
def b2(t):
    return b1(t).filter(F.col("feature").isin(*sorted(set(L.VITAL_NAMES.values()))))


CODE_SQL = f"cd AS (SELECT event_id, pid, ts, value AS dose, {sql_one_of(PROCEDURES, 'k')} AS pcode, {sql_one_of(DRUGS, 'k')} AS code, {sql_one_of(ACTIONS, 'event_id')} AS action FROM ev)"


def codes(t):
    return t.ev.select(
        "event_id",
        "pid",
        "ts",
        F.col("value").alias("dose"),
        one_of(PROCEDURES, F.col("k")).alias("pcode"),
        one_of(DRUGS, F.col("k")).alias("code"),
        one_of(ACTIONS, F.col("event_id")).alias("action"),
    )


@query(
    "b3_longest_prefix",
    f"""{with_("ev")}, {CODE_SQL} SELECT event_id, CASE WHEN pcode LIKE 'BGD%' THEN 'respirator' WHEN pcode LIKE 'BGA%' THEN 'sonde_tube'
      WHEN pcode LIKE 'KA%' THEN 'neuro' WHEN pcode LIKE 'KB%' THEN 'endokrin' WHEN pcode LIKE 'KN%' THEN 'orto'
      WHEN pcode LIKE 'KQ%' THEN 'hud' WHEN pcode LIKE 'KP%' THEN 'vaskulær' END AS class FROM cd""",
)
def b3(t):
    return codes(t).select("event_id", longest_prefix(F.col("pcode"), L.PROCEDURE_CLASSES).alias("class"))


@query(
    "b3_prefix_table_join",
    """WITH tab AS (SELECT prefix, min(p_brand) AS brand FROM (SELECT substr(p_name, 1, 3 + CAST(p_partkey % 4 AS INT)) AS prefix, p_brand FROM part) GROUP BY 1),
    m AS (SELECT p_name, arg_max(brand, length(prefix)) AS brand FROM (SELECT DISTINCT p_name FROM part) JOIN tab ON starts_with(p_name, prefix) GROUP BY 1)
    SELECT p_partkey, m.brand FROM part LEFT JOIN m USING (p_name)""",
)
def b3_join(t):
    """Longest prefix against a prefix table made from data (equality per prefix length)."""
    length = (3 + F.col("p_partkey") % 4).cast("int")
    table = t.part.groupBy(F.substring(F.col("p_name"), F.lit(1), length).alias("prefix")).agg(F.min("p_brand").alias("brand"))
    return prefix_join(t.part.select("p_partkey", "p_name"), "p_name", table, ["brand"]).select("p_partkey", "brand")


L3 = {"C01": "cardiovascular_drugs", "J01": "antibiotics", "N05": "neuro_drugs", "M03": "neuro_drugs", "B01": "anti_thrombotic"}
L4 = {"N02A": "opiods", "B05B": "infusion", "A10A": "insulin", "B05A": "blood"}


@query(
    "b4_two_level_classes",
    f"""{with_("ev")}, {CODE_SQL} SELECT DISTINCT event_id, value FROM (
      SELECT event_id, {sql_case("substr(code, 1, 3)", L3)} AS value FROM cd UNION ALL SELECT event_id, {sql_case("substr(code, 1, 4)", L4)} FROM cd)
      WHERE value IS NOT NULL""",
)
def b4(t):
    return codes(t).select("event_id", F.explode(drug_classes(F.col("code"))).alias("value")).distinct()


@query(
    "b5_first_class",
    f"{with_('ev')}, {CODE_SQL} SELECT event_id, coalesce({sql_case('substr(code, 1, 3)', L3)}, {sql_case('substr(code, 1, 4)', L4)}) AS class FROM cd",
)
def b5(t):
    return codes(t).select("event_id", drug_class(F.col("code")).alias("class"))


UNIT_LABELS = ["TB", "ED", "ED", "ED", "OR", "OR", "ICU", "ICU", "WARD", "OPD", None, None, "OR", "OR"]
UNIT_SITES = ["RH", "HGH", "RH", "BFH", "NOH", "RH", "RH", "SJ KØGE", "SJ HOLBÆK", "AHH", "SJ ROSKILDE", "MISC", "SJ NÆSTVED", "RH"]


@query(
    "b6_department",
    f"""{with_("ev")}, u(unit) AS (SELECT unnest({sql_list(UNITS)})),
    x AS (SELECT unit, lower(unit) AS s, regexp_replace(lower(unit), '^.*(traumecenter|psyk|børnemod)', '') AS rest FROM u),
    lab AS (SELECT unit, CASE WHEN contains(s, 'traumecenter') THEN 'TB'
      WHEN regexp_matches(rest, '(^|[^a-zæøå])(akutmodtagelse|akutklinik)($|[^a-zæøå])') OR regexp_matches(rest, '[a-zæøå.]\\s+modtagelse($|[^a-zæøå])') THEN 'ED'
      WHEN contains(s, 'operationsgang') OR contains(s, 'bedøvelse og operation') OR (contains(s, 'øjenkl') AND contains(s, 'operation')) OR contains(s, 'reum/ryg op') THEN 'OR'
      WHEN contains(s, 'intensiv') OR regexp_matches(s, ' ita[ ,]') THEN 'ICU' WHEN contains(s, 'seng') THEN 'WARD' WHEN contains(s, 'amb') THEN 'OPD' END AS label FROM x)
    SELECT event_id, unit, label FROM (SELECT event_id, {sql_one_of(UNITS, "event_id")} AS unit FROM ev) JOIN lab USING (unit)""",
)
def b6(t):
    unit = one_of(UNITS, F.col("event_id"))
    return t.ev.select("event_id", unit.alias("unit")).withColumn("label", department(F.col("unit")))


@query(
    "b7_hospital",
    f"""{with_("ev")} SELECT event_id, {sql_one_of(UNITS, "event_id")} AS unit, {sql_one_of(UNIT_SITES, "event_id")} AS site FROM ev""",
)
def b7(t):
    out = t.ev.select("event_id", one_of(UNITS, F.col("event_id")).alias("unit"))
    return out.withColumn("site", hospital(F.col("unit")))


@query(
    "b8_pair_split",
    f"""{with_("ev")}, {READ_SQL} SELECT event_id, 'SBP' AS feature, split_part(value, '/', 1) AS value FROM vit WHERE param IN ('BT', 'NIBP', 'ART inv BT')
    UNION ALL SELECT event_id, 'DBP', CASE WHEN contains(value, '/') THEN split_part(value, '/', 2) END FROM vit WHERE param IN ('BT', 'NIBP', 'ART inv BT')
    UNION ALL SELECT event_id, param, value FROM vit WHERE param NOT IN ('BT', 'NIBP', 'ART inv BT')""",
)
def b8(t):
    rows = readings(t).withColumnRenamed("param", "feature")
    return cp.split_pairs(rows, F.col("feature").isin(*L.PRESSURE_PAIRS)).select("event_id", "feature", "value")


@query(
    "b9_strip_score",
    f"""{with_("ev")}, {SCORE_SQL} SELECT event_id, {sql_case("param", L.SCORE_VITALS)} AS param, trim(split_part(value, '(', 1)) AS value
      FROM sc WHERE param <> 'EWS korr. total score'""",
)
def b9(t):
    return cp.score_vitals(score_rows(t)).select("event_id", "param", "value")


LAB_TEXT = """CASE k % 6 WHEN 0 THEN '<' || replace(CAST(value AS VARCHAR), '.', ',') WHEN 1 THEN '*' || CAST(value AS VARCHAR)
      WHEN 2 THEN 'neg' WHEN 3 THEN '> ' || CAST(value AS VARCHAR) ELSE CAST(value AS VARCHAR) END"""


def lab_rows(t):
    v = F.col("value").cast("string")
    k = F.col("k") % 6
    text = (
        F.when(k == 0, F.concat(F.lit("<"), F.replace(v, F.lit("."), F.lit(","))))
        .when(k == 1, F.concat(F.lit("*"), v))
        .when(k == 2, "neg")
        .when(k == 3, F.concat(F.lit("> "), v))
        .otherwise(v)
    )
    return t.ev.select("pid", "ts", "event_id", one_of(LABS, F.col("event_id")).alias("param"), text.alias("value"))


@query(
    "b10_lab_clean",
    f"""{with_("ev")}, r AS (SELECT pid, ts, {sql_one_of(LABS, "event_id")} AS param, {LAB_TEXT} AS txt FROM ev),
    n AS (SELECT pid, ts, {sql_case("param", {"LAKTAT;P(AB)": "LACTATE", "LAKTAT(POC);P(VB)": "LACTATE", "BASE EXCESS;ECV": "BASE_EXCESS", "HÆMOGLOBIN;B": "HEMOGLOBIN", "LEUKOCYTTER;B": "LEUKOCYTES", "TEG-R": "TEG-R"})} AS feature,
      TRY_CAST(trim(regexp_replace(replace(replace(txt, ',', '.'), '*', ''), '[<>]', '', 'g')) AS DOUBLE) AS value FROM r)
    SELECT * FROM n WHERE feature IS NOT NULL AND value IS NOT NULL""",
)
def b10(t):
    return cp.clean_labs(lab_rows(t))


@query(
    "b11_parse_number",
    f"""{with_("ev")}, r AS (SELECT event_id, CASE WHEN k % 4 = 0 THEN ' < ' || CAST(value AS VARCHAR) WHEN k % 4 = 1 THEN 'x' || CAST(value AS VARCHAR)
      WHEN k % 4 = 2 THEN '>' || CAST(value AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS txt FROM ev)
    SELECT event_id, TRY_CAST(regexp_replace(trim(txt), '^[<>]\\s*', '') AS DOUBLE) AS x FROM r""",
)
def b11(t):
    v, k = F.col("value").cast("string"), F.col("k") % 4
    text = F.when(k == 0, F.concat(F.lit(" < "), v)).when(k == 1, F.concat(F.lit("x"), v)).when(k == 2, F.concat(F.lit(">"), v)).otherwise(v)
    return t.ev.select("event_id", c.parse_number(text).alias("x"))


@query(
    "b12_unit_conversion",
    f"""{with_("ev")}, {READ_SQL}, n AS (SELECT event_id, param, TRY_CAST(value AS DOUBLE) AS x FROM vit)
    SELECT event_id, round(CASE WHEN param = 'Blæretemperatur' OR (param = 'Temperatur' AND x > 50) THEN (x - 32) * 5.0 / 9.0
      WHEN param = 'Højde' THEN x * 2.54 WHEN param = 'Vægt' THEN x * 0.0283495231 ELSE x END, 6) AS x,
      round(x * 30.48, 6) AS feet, round(x * 0.45359237, 6) AS pounds FROM n""",
)
def b12(t):
    r = readings(t)
    name = c.rename_values(F.col("param"), L.BODY_NAMES)
    raw = c.to_number(F.col("value"))
    x = c.to_number(cp.body_units(name, cp.to_celsius(F.col("param"), F.col("value"))))
    return rounded(r.select("event_id", x.alias("x"), c.convert(raw, "feet_cm").alias("feet"), c.convert(raw, "pound_kg").alias("pounds")))


BOUND_SQL = "bd(feature, lo, hi) AS (VALUES " + ", ".join(f"('{f}', {a}, {b})" for f, (a, b) in L.VITAL_BOUNDS.items()) + ")"


@query(
    "b13_plausible_bounds",
    f"""{with_("ev")}, {READ_SQL}, {BOUND_SQL}, r AS (SELECT event_id, {sql_case("param", RENAME, "param")} AS feature, value FROM vit)
    SELECT event_id, r.feature, value FROM r LEFT JOIN bd USING (feature) WHERE TRY_CAST(value AS DOUBLE) IS NULL OR lo IS NULL
      OR TRY_CAST(value AS DOUBLE) BETWEEN lo AND hi""",
)
def b13(t):
    rows = readings(t).select("event_id", c.rename_values(F.col("param"), {**L.VITAL_NAMES, **L.BODY_NAMES}).alias("feature"), "value")
    return rows.filter(c.within_bounds(F.col("feature"), F.col("value"), L.VITAL_BOUNDS))


@query(
    "b14_exact_dedupe",
    f"""{with_("ev")} SELECT DISTINCT pid, date_trunc('day', ts)::TIMESTAMP AS ts, feature, round(value) AS value FROM ev""",
)
def b14(t):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return cp.dedupe_events(t.ev.select("pid", day.alias("ts"), "feature", F.round("value").alias("value")))


VITALS_SQL = f"""{READ_SQL}, {SCORE_SQL}, {BOUND_SQL},
    al AS (SELECT pid, ts, param, value FROM vit UNION SELECT pid, ts, {sql_case("param", L.SCORE_VITALS)}, trim(split_part(value, '(', 1)) FROM sc WHERE param <> 'EWS korr. total score'),
    cv AS (SELECT *, CASE WHEN param = 'Blæretemperatur' OR (param = 'Temperatur' AND TRY_CAST(value AS DOUBLE) > 50) THEN CAST((TRY_CAST(value AS DOUBLE) - 32) * 5.0 / 9.0 AS VARCHAR) ELSE value END AS v2,
      {sql_case("param", {"ABP Puls (fra A-kanyle)": "arterial_hr", "Blæretemperatur": "invasive_temp", "ART inv BT": "arterial_bp"})} AS inv FROM al),
    sp AS (SELECT pid, ts, param AS f, v2 AS v, inv FROM cv WHERE param NOT IN ('BT', 'NIBP', 'ART inv BT')
      UNION ALL SELECT pid, ts, 'SBP', split_part(v2, '/', 1), inv FROM cv WHERE param IN ('BT', 'NIBP', 'ART inv BT')
      UNION ALL SELECT pid, ts, 'DBP', split_part(v2, '/', 2), inv FROM cv WHERE param IN ('BT', 'NIBP', 'ART inv BT') AND contains(v2, '/')),
    nm AS (SELECT pid, ts, {sql_case("f", {**RENAME, "SBP": "SBP", "DBP": "DBP"}, "f")} AS feature, v, TRY_CAST(v AS DOUBLE) AS x, inv FROM sp),
    okv AS (SELECT pid, ts, feature, x, min(inv) AS invasive FROM nm JOIN bd USING (feature) WHERE feature NOT IN ('HEIGHT', 'WEIGHT') AND x BETWEEN lo AND hi GROUP BY 1, 2, 3, 4, v)"""


@query(
    "b15_vitals_concept",
    f"{with_('ev')}, {VITALS_SQL} SELECT pid, ts, feature, round(x, 6) AS value, invasive FROM okv",
)
def b15(t):
    """Vitals concept: three sources, conversion, pairs, names, bounds, duplicates."""
    out = cp.clean_vitals(readings(t), score_rows(t)).withColumn("value", c.to_number(F.col("value")))
    return rounded(out)


@query(
    "b16_derived_invasive",
    f"""{with_("ev")}, {VITALS_SQL} SELECT DISTINCT pid, ts, 'invasive_monitoring' AS feature, invasive AS value FROM okv WHERE invasive IS NOT NULL""",
)
def b16(t):
    return cp.invasive_events(cp.clean_vitals(readings(t), score_rows(t)))


@query(
    "b17_parse_timestamp",
    """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 2 = 0 THEN date_trunc('millisecond', ts)
      ELSE date_trunc('second', ts) END AS parsed FROM events""",
)
def b17(t):
    sas = F.upper(F.date_format("ts", "ddMMMyyyy:HH:mm:ss.SSS"))
    iso = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    text = F.when(F.col("event_id") % 5 == 4, "not a time").when(F.col("event_id") % 2 == 0, F.concat(sas, F.lit("0"))).otherwise(iso)
    return t.events.select("event_id", c.parse_timestamp(text).alias("parsed"))


@query(
    "b18_id_normalise",
    "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) || '.05' END AS id FROM orders",
)
def b18(t):
    key = F.col("o_custkey").cast("string")
    raw = F.when(F.col("o_custkey") % 2 == 0, F.concat(key, F.lit(".0"))).otherwise(F.concat(key, F.lit(".05")))
    return t.orders.select("o_orderkey", c.normal_id(raw).alias("id"))


@query(
    "b19_empty_and_identity",
    "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS txt FROM events WHERE event_type <> 'error'",
)
def b19(t):
    """Quotes around nothing become NULL; identity rows go by their code."""
    text = F.when(F.col("event_id") % 3 != 0, F.col("event_type")).when(F.col("event_id") % 2 == 0, '""').otherwise("")
    rows = t.events.select("event_id", "event_type", c.empty_to_null(text).alias("txt"))
    return rows.filter(c.not_in(F.col("event_type"), ["error"])).drop("event_type")


@query(
    "b20_recode",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' WHEN 2 THEN 'Female' WHEN 3 THEN 'Ukendt' END AS sex FROM customer""",
)
def b20(t):
    raw = F.when(F.col("c_custkey") % 5 < 4, one_of(["Mand", "Kvinde", "K", "Ukendt"], F.col("c_custkey") % 5))
    return t.customer.select("c_custkey", c.rename_values(raw, L.SEX_NAMES).alias("sex"))


@query(
    "b21_keyword_flags",
    """SELECT doc_id, coalesce(regexp_matches(lower(text), 'ander|über|être|within'), false) AS keyword,
      coalesce(TIMESTAMP '2024-01-01' + to_hours(doc_id % 48) <= TIMESTAMP '2024-01-01 06:00:00' + to_hours(12), false) AS within_12_hours FROM documents""",
)
def b21(t):
    ts = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(hours=(F.col("doc_id") % 48).cast("int"))
    return t.documents.select(
        "doc_id",
        c.has_keyword(F.col("text"), ["ander", "über", "être", "within"]).alias("keyword"),
        c.not_after(ts, F.expr("timestamp_ntz'2024-01-01 06:00:00'"), 12).alias("within_12_hours"),
    )


@query(
    "b22_scaled_number",
    f"""{with_("ev")}, {READ_SQL} SELECT event_id, round_even(TRY_CAST(value AS DOUBLE) * 0.5 * 100::DOUBLE, 0) / 100 AS x, CASE WHEN TRY_CAST(value AS DOUBLE) IS NULL THEN value END AS raw FROM vit""",
)
def b22(t):
    """Number times factor, rounded; texts stay as they are."""
    out = readings(t).select("event_id", "value", c.scaled(F.col("value"), 0.5).alias("s"))
    x = c.to_number(F.col("s"))
    return out.select("event_id", x.alias("x"), F.when(x.isNull(), F.col("s")).alias("raw"))


@query(
    "b23_drop_list",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS feature FROM events
      WHERE event_id % 7 <> 0 AND event_type NOT IN ('error', 'view')""",
)
def b23(t):
    rows = t.events.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("feature"))
    return rows.filter(c.not_in(F.col("feature"), ["error", "view"]))


@query(
    "b24_diagnosis_code",
    """SELECT p_partkey, substr(p_type, 2, length(p_type) - 2) AS trimmed, upper(replace(replace(p_name, ' ', ''), '.', '')) AS compact FROM part""",
)
def b24(t):
    return t.part.select(
        "p_partkey", c.normal_diagnosis(F.col("p_type")).alias("trimmed"), c.compact_code(F.col("p_name")).alias("compact")
    )


CRITERIA = {
    "age_min": 20,
    "age_max": 85,
    "start_year": 1996,
    "site_only": True,
    "prehospital_only": True,
    "keyword": True,
    "max_duration_days": 2200,
    "min_steps": 10,
    "first_hospital": [None, "BUILDING", "MACHINERY", "HOUSEHOLD"],
    "custom_filters": [{"column": "balance", "op": ">=", "value": -500.0}, {"column": "nation", "op": "not_in", "value": [3, 4]}],
}

CRITERIA_SQL = """st AS (SELECT o_custkey AS pid, min(o_orderdate) AS start_ts, max(o_orderdate) AS end_ts, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1),
    b AS (SELECT st.*, CAST(c_custkey % 97 AS INT) AS age, n >= 5 AS site, c_mktsegment AS seg, c_acctbal AS bal, c_nationkey AS nat, date_diff('day', start_ts, end_ts) AS dur FROM st JOIN customer ON c_custkey = pid),
    f AS (SELECT *, [age >= 20, age <= 85, year(start_ts) >= 1996, site, n > 2, top > 300000, dur <= 2200,
      end_ts > start_ts AND dur * 1440 > 90, seg IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD'), bal >= -500, nat NOT IN (3, 4)] AS r FROM b)"""


def criteria_base(t):
    st = t.orders.groupBy(F.col("o_custkey").alias("pid")).agg(
        F.min("o_orderdate").alias("start_ts"),
        F.max("o_orderdate").alias("end_ts"),
        F.count("*").alias("n"),
        F.max("o_totalprice").alias("top"),
    )
    cust = t.customer.select(
        F.col("c_custkey").alias("pid"), "c_mktsegment", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation")
    )
    out = st.join(cust, "pid")
    return out.select(
        "pid",
        "start_ts",
        "end_ts",
        "balance",
        "nation",
        (F.col("pid") % 97).cast("int").alias("age"),
        F.col("start_ts").alias("service_ts"),
        (F.col("n") >= 5).cast("int").alias("site_flag"),
        F.when(F.col("n") > 2, F.col("start_ts")).alias("pre_start"),
        (F.col("top") > 300000).alias("keyword"),
        F.datediff("end_ts", "start_ts").alias("duration_days"),
        F.col("c_mktsegment").alias("first_hospital"),
    )


@query("b25_criteria_filter", f"WITH {CRITERIA_SQL} SELECT pid, age FROM f WHERE list_bool_and(r)")
def b25(t):
    return co.apply_criteria(criteria_base(t), co.criteria_rules(CRITERIA)).select("pid", "age")


RULE_NAMES = [
    "age_min", "age_max", "start_year", "site_only", "prehospital_only", "keyword", "max_duration_days", "min_steps",
    "first_hospital", "balance >=", "nation not_in",
]


@query(
    "b25_criteria_attrition",
    f"""WITH {CRITERIA_SQL}, p AS (SELECT unnest(range(0, 11)) AS i),
    nm AS (SELECT {sql_list(RULE_NAMES)} AS names)
    SELECT CAST(i AS INT) AS position, names[i + 1] AS "rule", count(*) FILTER (coalesce(list_bool_and(r[1:i]), true) AND NOT r[i + 1]) AS excluded,
      count(*) FILTER (list_bool_and(r[1:i + 1])) AS remaining FROM p, nm, f GROUP BY ALL""",
)
def b25_attrition(t):
    return co.attrition(criteria_base(t), co.criteria_rules(CRITERIA))


@query(
    "b26_refilter",
    f"WITH {CRITERIA_SQL} SELECT o_orderkey, o_custkey AS pid FROM orders WHERE o_custkey IN (SELECT pid FROM f WHERE list_bool_and(r))",
)
def b26(t):
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("pid"))
    return co.refilter(orders, co.apply_criteria(criteria_base(t), co.criteria_rules(CRITERIA))).select("o_orderkey", "pid")


@query(
    "b27_elapsed_window",
    f"""{with_("ev", "base")} SELECT event_id, round((epoch_us(ts) - epoch_us(start_ts)) / 3.6e9, 6) AS elapsed_hours FROM ev JOIN base USING (pid)
      WHERE ts - start_ts <= to_hours(72)""",
)
def b27(t):
    ev = t.ev.join(t.base.select("pid", "start_ts"), "pid")
    return rounded(co.elapsed_window(ev, 72).select("event_id", "elapsed_hours"))


@query(
    "b28_device_events",
    f"""{with_("ev")}, d AS (SELECT pid, ['SVD00029', 'SVD00030', 'SVD00031', 'SVD00032', 'OTHER'][CAST(k % 5 AS INT) + 1] AS code,
      CASE WHEN k % 3 = 0 THEN ts + to_minutes(5) END AS m, CASE WHEN k % 11 <> 1 THEN ts END AS cr, CASE WHEN k % 13 <> 0 THEN value END AS value FROM ev),
    f AS (SELECT pid, coalesce(m, cr) AS ts, {sql_case("code", {"SVD00029": "HR", "SVD00030": "SBP", "SVD00031": "DBP", "SVD00032": "SPO2"})} AS feature, value FROM d)
    SELECT * FROM f WHERE ts IS NOT NULL AND feature IS NOT NULL AND value BETWEEN 0 AND CASE feature WHEN 'HR' THEN 220 WHEN 'SPO2' THEN 100 WHEN 'SBP' THEN 300 ELSE 200 END""",
)
def b28(t):
    rows = t.ev.select(
        "pid",
        one_of(["SVD00029", "SVD00030", "SVD00031", "SVD00032", "OTHER"], F.col("k")).alias("code"),
        F.when(F.col("k") % 3 == 0, F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("manual_ts"),
        F.when(F.col("k") % 11 != 1, F.col("ts")).alias("created_ts"),
        F.when(F.col("k") % 13 != 0, F.col("value")).alias("value"),
    )
    return cp.device_events(rows, L.DEVICE_FALLBACK_CODES, L.DEVICE_BOUNDS, L.DEVICE_FEATURES)


# ---- the other concept filters of the registry ----------------------------------------


@query(
    "l1_concept_registry",
    f"""{with_("ev", "base")}, {SCORE_SQL}, {CODE_SQL},
    ews AS (SELECT DISTINCT pid, ts, CAST(value AS DOUBLE) AS v FROM sc WHERE param = 'EWS korr. total score'),
    pr AS (SELECT event_id FROM cd WHERE substr(pcode, 1, 2) IN ('KA', 'KB', 'KN', 'KQ', 'KP') OR substr(pcode, 1, 3) IN ('BGD', 'BGA')),
    md AS (SELECT DISTINCT event_id, v FROM (SELECT event_id, {sql_case("substr(code, 1, 3)", L3)} AS v, action FROM cd
      UNION ALL SELECT event_id, {sql_case("substr(code, 1, 4)", L4)}, action FROM cd) WHERE v IS NOT NULL AND action <> 'Annulleret')
    SELECT 'warning_scores' AS concept, count(*) AS n FROM ews UNION ALL SELECT 'procedures', count(*) FROM pr UNION ALL SELECT 'medication', count(*) FROM md""",
)
def l1(t):
    """Registered filters applied by name; rows that come out of each."""
    inputs = {
        "warning_scores": score_rows(t),
        "procedures": codes(t).select("event_id", "pid", "ts", F.col("pcode").alias("code")),
        "medication": codes(t).select("event_id", "pid", "ts", "code", "action"),
    }
    out = None
    for name, rows in inputs.items():
        n = cp.CONCEPT_FILTERS[name](rows).agg(F.lit(name).alias("concept"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query(
    "l1_moves_concept",
    f"""{with_("ev", "base")}, lab(unit, label) AS (VALUES {", ".join(f"('{u}', '{v}')" for u, v in zip(UNITS, UNIT_LABELS) if v)}),
    mv AS (SELECT pid, event_id, ts, {sql_one_of(UNITS, "event_id")} AS unit, CASE WHEN k % 2 = 0 THEN ts + to_hours(2) END AS e FROM ev),
    a AS (SELECT mv.pid, event_id, mv.ts, label, coalesce(e, lead(mv.ts) OVER (PARTITION BY mv.pid ORDER BY mv.ts, event_id), base.end_ts) AS end_ts
      FROM mv JOIN lab USING (unit) JOIN base USING (pid))
    SELECT event_id, label AS value, end_ts FROM a WHERE end_ts IS NOT NULL""",
)
def l1_moves(t):
    """Moves concept: classified departments, open ends closed."""
    rows = t.ev.select(
        "pid",
        "event_id",
        "ts",
        one_of(UNITS, F.col("event_id")).alias("unit"),
        F.when(F.col("k") % 2 == 0, F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("end_ts"),
    )
    return cp.clean_moves(rows, t.base).select("event_id", "value", "end_ts")


@query(
    "l4_icu_rename",
    f"""{with_("ev")} SELECT event_id, {sql_one_of(["GCS", "SAPS3", "SOFA", "Andet"], "k")} AS feature, value FROM ev""",
)
def l4(t):
    """Row lambdas of the concept filters as native columns (ICU score names)."""
    names = ["Glasgow Coma Score", "SAPS 3 SCORE", "SOFA total score", "Andet"]
    return cp.clean_icu(t.ev.select("event_id", one_of(names, F.col("k")).alias("param"), "value"))


@query(
    "l5_rule_compiler",
    """SELECT o_orderkey, o_totalprice > 200000 AND o_orderstatus IN ('F', 'O') AND o_orderpriority <> '5-LOW' AS keep FROM orders""",
)
def l5(t):
    """Config rules compiled to one condition."""
    rules = [("o_totalprice", ">", 200000), ("o_orderstatus", "in", ["F", "O"]), ("o_orderpriority", "!=", "5-LOW")]
    return t.orders.select("o_orderkey", c.all_of(rule(*r) for r in rules).alias("keep"))


@query(
    "e15_worst_value",
    f"""{with_("ev")}, r AS (SELECT pid, event_id, ts, ['A', 'B', 'N', 'Z'][CAST(k % 4 AS INT) + 1] AS component, k, value FROM ev),
    v AS (SELECT *, CASE component WHEN 'A' THEN ['Fri', 'Truede', 'Blokerede', 'ukendt'][CAST(event_id % 4 AS INT) + 1]
      WHEN 'B' THEN ['Normal', 'Let påvirket', 'Meget påvirket', 'Respirationsstop'][CAST(event_id % 4 AS INT) + 1]
      WHEN 'N' THEN CAST(CAST(floor(value) AS INT) AS VARCHAR) ELSE 'z' || CAST(event_id % 9 AS VARCHAR) END AS txt FROM r),
    w AS (SELECT *, CASE component WHEN 'A' THEN list_position(['Fri', 'Truede', 'Blokerede'], txt) - 1
      WHEN 'B' THEN list_position(['Normal', 'Let påvirket', 'Meget påvirket', 'Respirationsstop'], txt) - 1 WHEN 'N' THEN floor(value) ELSE 0 END AS wgt FROM v)
    SELECT pid, component, arg_max(txt, (coalesce(wgt, -1), ts, event_id)) AS value FROM w GROUP BY 1, 2""",
)
def e15(t):
    comp = one_of(["A", "B", "N", "Z"], F.col("k"))
    i = F.col("event_id")
    text = (
        F.when(comp == "A", one_of(["Fri", "Truede", "Blokerede", "ukendt"], i))
        .when(comp == "B", one_of(L.ASSESSMENT_SEVERITY["B"], i))
        .when(comp == "N", F.floor("value").cast("int").cast("string"))
        .otherwise(F.concat(F.lit("z"), (i % 9).cast("string")))
    )
    rows = t.ev.select("pid", comp.alias("component"), text.alias("value"), "ts", "event_id")
    return cp.worst_value(rows, L.ASSESSMENT_SEVERITY)


@query(
    "d5_open_intervals_from_points",
    f"{with_('ev', 'nexts')} SELECT event_id, end_ts FROM nexts WHERE end_ts IS NOT NULL",
)
def d5_points(t):
    return tr.next_start_as_end(t.ev).select("event_id", "end_ts")
