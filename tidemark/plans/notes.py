"""Events from notes. Notes are documents with a phrase in front; the whole text is processed."""

from pyspark.sql import functions as F

from tidemark.operators import text as tx
from tidemark.plans.cleaning import one_of, sql_list, sql_one_of
from tidemark.plans.registry import query, rounded

# phrase -> coma scores it holds
COMA = {
    "Pt vågen, GCS 15 ved ankomst": [15],
    "glasgow coma score er nu 7": [7],
    "Alarm ved fald til under GCS 9. Aktuelt GCS: 13": [13],
    "GCS 6 for 3 dage siden": [],
    "GCS falder fra 14 til 9": [9],
    "gcs 14 -> 12 -> 8 over natten": [8],
    "GCS: Ø4 V5 M6 = 15": [15],
    "rp GCS 14, ellers stabil": [],
    "GCS 2 noteret": [],
    "GCS 10 og senere GCS 12": [10, 12],
    "BT 120/70 uden score": [],
    "Gentaget GCS 11 samt GCS 5": [5],
    "glasgow coma scale 3": [3],
}
# phrase -> injury scores it holds
INJURY = {
    "ISS 17 beregnet": [17],
    "pt scorer 22 på ISS": [22],
    "Samlet ISS-score: 34": [34],
    "ingen score": [],
    "ISS er ca. 9": [9],
    "ISS 76": [],
    "issue 5 åbne": [5],
    "(ISS) 41 i dag": [41],
}
# phrase -> airway event
AIRWAY = {
    "Pt intuberet på stedet": True,
    "Ikke intuberet": False,
    "Lagt i respirator": True,
    "overvejer RSI": False,
    "OTI foretaget": True,
    "uden tube, men ETT anlagt senere på dagen": False,
    "ekstuberet uden problemer, senere atter ETT": True,
    "stabil luftvej": False,
    "forsøgt intub": False,
    "planlægges tubet, derefter ventilatorbehandling startet": True,
}
TYPES = ["AKA-notater", "AOP", "Sygeplejenotat", "AKA-Traumenotat", "Lægenotat"]

ARREST = [
    "Pt får hjertestop kl. 12",
    "Ikke hjertestop",
    "Kaldes til hjertestop på stuen",
    "Formodet hjertestop",
    "Tidligere hjertestop i 2012",
    "Pt får igen hjertestop",
    "Hjertestop x 3 undervejs",
    "Ubevidnet hjertestop på gaden",
    "Hjertestop under transport hertil",
    "Familiære dispositioner:\nfar fik hjertestop\nAktuelt:\nPt indbringes med hjertestop",
    "Sygehistorie: hjertestop",
    "hjertestop 01/02 beskrevet",
    "Prognose efter hjertestop drøftet",
    "Nyt hjertestop i nat. Hjertestop konstateres",
    "Ingen klager",
]
ARREST_TYPES = ["Hjertestopsnotat", "Lægenotat", "Sygeplejenotat", "Konferencenotat"]


def notes_with(t, phrases, types=TYPES):
    """documents as notes: a phrase, then the whole text; 97 entities, hourly times with repeats."""
    d = F.col("doc_id")
    ts = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(hours=(d % 200).cast("int"))
    return t.documents.select(
        (d % 97).alias("pid"),
        ts.alias("ts"),
        d.alias("note_id"),
        one_of(types, F.floor(d / 3)).alias("note_type"),
        F.concat(one_of(phrases, d), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"),
    )


def phrase_table(phrases: dict) -> str:
    """Values each phrase holds, as SQL rows."""
    rows = [f"({i}, {v}::DOUBLE)" for i, vs in enumerate(phrases.values()) for v in vs]
    return "(VALUES " + ", ".join(rows) + ")"


NOTE_SQL = """nt AS (SELECT doc_id % 97 AS pid, TIMESTAMP '2024-01-01' + to_hours(doc_id % 200) AS ts, doc_id AS note_id, {kind} AS note_type, doc_id % {n} AS i FROM documents)"""


def note_sql(phrases, types=TYPES):
    return NOTE_SQL.format(kind=sql_one_of(types, "(doc_id // 3)"), n=len(phrases))


@query(
    "j1_keyword_flags",
    """WITH k AS (SELECT doc_id % 97 AS pid, TIMESTAMP '2024-01-01' + to_hours(doc_id % 200) AS ts FROM documents WHERE regexp_matches(lower(text), 'would|monde|nicht|hasta')),
    b AS (SELECT DISTINCT doc_id % 97 AS pid FROM documents)
    SELECT b.pid, count(k.pid) > 0 AS keyword, coalesce(bool_or(ts <= TIMESTAMP '2024-01-01 06:00:00' + to_hours(12)), false) AS keyword_12h FROM b LEFT JOIN k USING (pid) GROUP BY 1""",
)
def j1(t):
    """Keyword in any note and in a note up to 12 h after the start."""
    d = F.col("doc_id")
    ts = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(hours=(d % 200).cast("int"))
    notes = t.documents.select((d % 97).alias("pid"), ts.alias("ts"), "text")
    base = notes.select("pid").distinct().withColumn("start_ts", F.expr("timestamp_ntz'2024-01-01 06:00:00'"))
    return tx.keyword_flags(base, notes, ["would", "monde", "nicht", "hasta"]).drop("start_ts")


@query("j2_coma_scores", f"WITH {note_sql(COMA)} SELECT pid, ts, note_id, 'GCS' AS feature, v AS value FROM nt JOIN {phrase_table(COMA)} p(i, v) USING (i)")
def j2(t):
    return tx.coma_scores(notes_with(t, list(COMA)))


@query(
    "j3_injury_scores",
    f"""WITH l AS (SELECT doc_id % 97 AS pid, TIMESTAMP '2024-01-01' + to_hours(doc_id % 20) AS ts, doc_id % {len(INJURY)} AS i FROM documents),
    v AS (SELECT pid, ts, max(v) AS v FROM l JOIN {phrase_table(INJURY)} p(i, v) USING (i) GROUP BY 1, 2)
    SELECT pid, ts, 'ISS_notes' AS feature, v AS value FROM v QUALIFY row_number() OVER (PARTITION BY pid ORDER BY ts) = 1""",
)
def j3(t):
    """Lines of an entity and time joined, then scores after and before the keyword."""
    d = F.col("doc_id")
    ts = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(hours=(d % 20).cast("int"))
    # closing lines keep a phrase's keyword from reading a number of what stands next to it
    close = F.lit("\n- - - - -\n")
    text = F.concat(one_of(list(INJURY), d), close, F.coalesce("text", F.lit("")), close)
    return tx.injury_scores(t.documents.select((d % 97).alias("pid"), ts.alias("ts"), d.alias("line_no"), text.alias("text")))


AIR_SQL = f"""WITH {note_sql(AIRWAY)}, h AS (SELECT nt.*, list_contains([{", ".join(str(i) for i, v in enumerate(AIRWAY.values()) if v)}], i) AS hit FROM nt),
    pr AS (SELECT * FROM h WHERE note_type IN ('AKA-notater', 'AKA-Traumenotat')), fb AS (SELECT * FROM h WHERE note_type = 'AOP' AND pid NOT IN (SELECT pid FROM pr)),
    f AS (SELECT pid, min(ts) AS ts FROM (SELECT * FROM pr UNION ALL SELECT * FROM fb) WHERE hit GROUP BY 1)"""


def airway_notes(t):
    d = F.col("doc_id")
    ts = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(hours=(d % 200).cast("int"))
    text = F.concat(one_of(list(AIRWAY), d), F.lit("\n"), F.coalesce("text", F.lit("")))
    return t.documents.select((d % 97).alias("pid"), ts.alias("ts"), d.alias("note_id"), one_of(TYPES, F.floor(d / 3)).alias("note_type"), text.alias("text"))


@query("j4_airway_events", f"{AIR_SQL} SELECT pid, ts, 'INTUBATED' AS feature, 1.0::DOUBLE AS value FROM f WHERE ts <= TIMESTAMP '2024-01-02 12:00:00' + to_hours(24)")
def j4(t):
    notes = airway_notes(t)
    base = notes.select("pid").distinct().withColumn("start_ts", F.expr("timestamp_ntz'2024-01-02 12:00:00'"))
    return tx.airway_events(notes, base, 24)


@query("j5_repeated_events")
def j5(t):
    """Repeated events with entity state (checked against a sequential reading in the tests)."""
    return tx.arrest_events(notes_with(t, ARREST, ARREST_TYPES)).groupBy("pid", "ts").agg(F.sum("n").alias("n"))


@query(
    "j6_jaccard",
    f"""WITH c AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(regexp_replace(text, '[^\\w\\sÀ-ÖØ-öø-ÿœŒßÆØÅæøå]', '', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN {str(tuple(tx.P.STOPWORDS))})) AS w FROM conversations),
    p AS (SELECT a.conv_id, a.turn, a.w AS x, b.w AS y FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
    SELECT conv_id, turn, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(x || y)) END, 6) AS jaccard FROM p""",
)
def j6(t):
    """Token overlap of consecutive turns."""
    c = t.conversations.select("conv_id", "turn", tx.token_set(F.col("text")).alias("w"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("w2"))
    return rounded(c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", tx.jaccard(F.col("w"), F.col("w2")).alias("jaccard")))


@query(
    "j7_text_concept",
    f"""{AIR_SQL}, g AS (SELECT doc_id % 97 AS pid, TIMESTAMP '2024-01-01' + to_hours(doc_id % 200) AS ts FROM documents JOIN {phrase_table(COMA)} p(i, v) ON doc_id % {len(COMA)} = i)
    SELECT pid, ts, 'event' AS feature, 'INTUBATED' AS value FROM f UNION ALL SELECT pid, ts, 'event', 'GCS' FROM g""",
)
def j7(t):
    return tx.as_concept([tx.airway_events(airway_notes(t)), tx.coma_scores(notes_with(t, list(COMA)))])
