"""Note extractors against a sequential reading of the rules."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from tidemark.functions import note_patterns as P
from tidemark.operators import text as tx
from tidemark.plans.notes import AIRWAY, ARREST, COMA, INJURY

T0 = dt.datetime(2024, 2, 1)


def notes_frame(spark, rows):
    return spark.createDataFrame(rows, "pid long, ts timestamp_ntz, note_id long, note_type string, text string")


def rx(pattern):
    return re.compile(pattern.replace("(?iuU)", "").replace("(?iu)", "").replace("(?U)", ""), re.I)


def norm(text):
    return re.sub(r"\s+", " ", text.lower().strip())


def arrests_one_by_one(rows):
    """Events of one entity, reading its notes in order and keeping state."""
    out, seen_text, counts, times = [], set(), set(), set()
    any_event = transport = witnessed = False
    for _, ts, _, kind, text in sorted(rows, key=lambda r: (r[1], r[2])):
        if rx(P.ARREST_EXCLUDED_TYPES).search(kind.strip()):
            continue
        fresh_note = ts not in times
        if "hjertestop" in kind.lower():
            known = text.strip() in seen_text
            seen_text.add(text.strip())
            again = len(rx(P.ARREST_AGAIN).findall(text))
            if (known and not again) or rx(P.ARREST_TYPE_NEGATION).search(text):
                continue
            out += [ts] * (1 + again)
            any_event = True
            times.add(ts)
            continue
        recap = bool(rx(P.ARREST_RECAP).search(norm(text[:300])))
        outside = False
        lines = []
        for raw in re.split(r"[\n\r]+", text):
            if not rx(P.ARREST_DATE_PREFIX).match(norm(raw)):
                lines += [s.strip() for s in re.split(r"(?<=\w)\.(?=\s+(?:[A-ZÆØÅ]|[Hh]jertestop\b))", raw) if s.strip()]
        for line in lines:
            if rx(P.ARREST_EXCLUDED_SECTION).search(line):
                outside = True
                continue
            if re.match(r"^[A-ZÆØÅ\w][^\n]{0,40}:\s*$", line):
                outside = False
            n = norm(line)
            if outside or "hjertestop" not in n or rx(P.ARREST_DIAGNOSIS).search(n):
                continue
            today = f"{ts.day:02d}/{ts.month:02d}"
            dates = [rx(p).search(n) for p in (P.ARREST_DATE, P.ARREST_DATED)]
            if any(d and f"{int(d.group(1)):02d}/{int(d.group(2)):02d}" != today for d in dates):
                continue
            year = rx(P.ARREST_YEAR).search(n)
            if year and int(year.group(1)) != ts.year:
                continue
            if any(rx(p).search(n) for p in (P.ARREST_UNCERTAIN, P.ARREST_NEGATIVE, P.ARREST_CALLED_BUT)) or not rx(P.ARREST_POSITIVE).search(n):
                continue
            strong = rx(P.ARREST_STRONG).search(n)
            at = n.index("hjertestop")
            if not strong and (rx(P.ARREST_CONTEXT_NEGATION).search(n[max(0, at - 100) : at + 110]) or rx(P.ARREST_PAST).search(n)):
                continue
            if rx(P.ARREST_TRANSPORT).search(n):
                if transport:
                    continue
                transport = True
            if rx(P.ARREST_WITNESSED).search(n):
                if witnessed:
                    continue
                witnessed = True
            times_n = rx(P.ARREST_TIMES_N).search(n)
            if times_n and int(times_n.group(1)) not in counts:
                counts.add(int(times_n.group(1)))
                hits = int(times_n.group(1))
            elif rx(P.ARREST_AGAIN).search(n) or (rx(P.ARREST_PRESENT).search(n) and fresh_note and not recap):
                hits = 1
            elif not any_event:
                hits = 1
            else:
                continue
            out += [ts] * hits
            any_event = True
            times.add(ts)
    return out


def test_arrests_equal_sequential_reading(spark):
    rnd = random.Random(11)
    kinds = ["Hjertestopsnotat", "Lægenotat", "Sygeplejenotat", "Konferencenotat"]
    extra = [
        "Hjertestop x 3 undervejs. Hjertestop x 2", "Pt får hjertestop kl. 3\nPt får igen hjertestop", "hjertestop", "Hjertestop x 0",
        "Kort sygehistorie\nPt får hjertestop i dag", "Ubevidnet hjertestop og hjertestop under transport hertil", "12/01: hjertestop igen",
    ]
    rows = []
    for i in range(700):
        text = "\n".join(rnd.choice(ARREST + extra) for _ in range(rnd.randint(1, 3)))
        rows.append((rnd.randint(1, 60), T0 + dt.timedelta(hours=rnd.randint(0, 30)), i, rnd.choice(kinds), text))
    got = sorted((r.pid, r.ts) for r in tx.one_row_each(tx.arrest_events(notes_frame(spark, rows))).select("pid", "ts").collect())
    want = sorted((p, ts) for p in range(1, 61) for ts in arrests_one_by_one([r for r in rows if r[0] == p]))
    assert got == want


def test_coma_and_injury_phrases(spark):
    rows = [(i, T0, i, "Lægenotat", p) for i, p in enumerate(COMA)]
    got = {}
    for r in tx.coma_scores(notes_frame(spark, rows)).collect():
        got.setdefault(r.pid, []).append(int(r.value))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in enumerate(COMA.values()) if v}
    lines = spark.createDataFrame([(i, T0, 1, p) for i, p in enumerate(INJURY)], "pid long, ts timestamp_ntz, line_no int, text string")
    got = {r.pid: [int(r.value)] for r in tx.injury_scores(lines).collect()}
    assert got == {i: [max(v)] for i, v in enumerate(INJURY.values()) if v}


def test_airway_negation_window(spark):
    df = spark.createDataFrame([(p,) for p in AIRWAY], "t string")
    assert [r[0] for r in df.select(tx.airway_mentioned(F.col("t"))).collect()] == list(AIRWAY.values())


def test_jaccard(spark):
    df = spark.createDataFrame([("pt fik hjertestop xxx", "hjertestop xxxx igen", "og i er")], "a string, b string, e string")
    row = df.select(
        tx.jaccard(tx.token_set(F.col("a")), tx.token_set(F.col("b"))).alias("j"), tx.jaccard(tx.token_set(F.col("a")), tx.token_set(F.col("e"))).alias("z")
    ).first()
    assert row.j == 2 / 4 and row.z == 0.0
