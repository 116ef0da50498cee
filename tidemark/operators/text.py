"""Events from free-text notes, as column expressions over whole texts.

``notes(pid, ts, note_id, note_type, text)``, one row per note. Per-row rules are regex columns;
rules that look across the notes of an entity are aggregates and equi-joins on the few matching
lines, never a per-entity Python loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import note_patterns as P
from tidemark.functions.columns import has_keyword, not_after
from tidemark.functions.lookups import COHORT_KEYWORDS
from tidemark.operators.joins import fallback_union, first_per_key
from tidemark.session import cut_lineage

MARK = "\u0001"


def _hit(col: Column, pattern: str) -> Column:
    return F.coalesce(col.rlike(pattern), F.lit(False))


def mentions(col: Column, *words: str) -> Column:
    """May any of some lower-case words occur? A first look at long texts without a regex; the rare
    long s, which a case-insensitive match takes for s, passes and is left to the exact patterns."""
    plain = F.lower(col)
    return F.coalesce(reduce(lambda a, b: a | b, [plain.contains(w) for w in words]) | col.contains("\u017f"), F.lit(False))


def normal_text(col: Column) -> Column:
    """Lower case, single blanks, trimmed."""
    return F.regexp_replace(F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", "")), r"(?U)\s+", " ")


# ---- keyword flags -----------------------------------------------------------------------


def keyword_flags(base: DataFrame, notes: DataFrame, keywords: list[str] = COHORT_KEYWORDS, hours: float = 12) -> DataFrame:
    """Entities with a keyword in any note, and in a note not later than ``hours`` after the start."""
    rows = notes.select("pid", "ts", has_keyword(F.col("text"), keywords).alias("__k")).filter("__k")
    rows = rows.join(base.select("pid", "start_ts"), "pid")
    hits = rows.groupBy("pid").agg(
        F.lit(True).alias("keyword"), F.max(not_after(F.col("ts"), F.col("start_ts"), hours)).alias("keyword_12h")
    )
    out = base.join(hits, "pid", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("keyword", "keyword_12h")})


# ---- coma score --------------------------------------------------------------------------


def coma_scores(notes: DataFrame) -> DataFrame:
    """Every coma score (3-15) named in a note, one event per hit.

    Per line: threshold phrases are cut, lines about the past are skipped, "from X to Y" and arrows
    keep their last value, subscales their total; a score after "repeat" is skipped.
    """
    rows = notes.filter(mentions(F.col("text"), "gcs", "glasgow"))
    line = F.explode(F.split("text", r"[\n\r.]+"))
    rows = rows.select("pid", "ts", "note_id", line.alias("l"))
    rows = rows.filter(mentions(F.col("l"), "gcs", "glasgow"))
    rows = rows.withColumn("l", F.regexp_replace("l", P.COMA_THRESHOLD, "")).filter(~_hit(F.col("l"), P.COMA_HISTORICAL))
    text = F.regexp_replace("l", P.COMA_FALL, "GCS $2")
    text = F.regexp_replace(text, P.COMA_ARROW, "GCS $1")
    text = F.regexp_replace(text, P.COMA_SUBSCALE, "GCS $1")
    # every match becomes MARK value MARK: odd pieces are values, the piece before is the left context
    pieces = F.split(F.regexp_replace(text, P.COMA_VALUE, f"{MARK}$1{MARK}"), MARK)
    rows = rows.withColumn("p", pieces).filter(F.size("p") >= 3)
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("p") - 2, F.lit(2))))
    before = F.regexp_replace(F.get("p", F.col("i") - 1), r"(?U)\s+$", "")
    value = F.get("p", F.col("i")).try_cast("int")
    rows = rows.filter(~_hit(F.substring(before, -30, 30), P.COMA_REPEAT)).withColumn("value", value)
    rows = rows.filter(F.col("value").between(3, 15))
    return rows.select("pid", "ts", "note_id", F.lit("GCS").alias("feature"), F.col("value").cast("double").alias("value"))


# ---- injury score ------------------------------------------------------------------------


def injury_scores(lines: DataFrame) -> DataFrame:
    """One injury score (0-75) per entity: the largest at its earliest note time.

    ``lines(pid, ts, line_no, text)``: the lines of a time are joined first, then values after and
    before the keyword are read.
    """
    pieces = F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("text", F.lit("")).alias("t"))))
    notes = lines.groupBy("pid", "ts").agg(F.array_join(F.transform(pieces, lambda s: s["t"]), "\n").alias("text"))
    notes = notes.filter(mentions(F.col("text"), "iss"))
    found = F.concat(F.regexp_extract_all("text", F.lit(P.INJURY_AFTER), 1), F.regexp_extract_all("text", F.lit(P.INJURY_BEFORE), 1))
    values = notes.select("pid", "ts", F.explode(found).alias("v")).select("pid", "ts", F.col("v").try_cast("double").alias("value"))
    best = F.min(F.struct("ts", (-F.col("value")).alias("v"))).alias("m")
    out = values.filter(F.col("value").isNotNull()).groupBy("pid").agg(best)
    return out.select("pid", F.col("m.ts").alias("ts"), F.lit("ISS_notes").alias("feature"), (-F.col("m.v")).alias("value"))


# ---- airway ------------------------------------------------------------------------------


def airway_mentioned(text: Column) -> Column:
    """Any airway word without a negation in the 15 characters before it."""
    pieces = F.split(F.regexp_replace(text, P.AIRWAY, f"{MARK}$0"), MARK)
    # only the ends of the pieces are looked at; the text is cut once, as the one element of a list
    ends = F.transform(F.array(pieces), lambda all_: F.transform(all_, lambda p: F.right(p, F.lit(15))))

    def clear(ends: Column) -> Column:
        # a piece starts with its match (three letters at least), so five pieces cover the window
        def before(i: Column) -> Column:
            first = F.greatest(i - 5, F.lit(1))
            return F.right(F.array_join(F.slice(ends, first, i - first), ""), F.lit(15))

        places = F.sequence(F.lit(2), F.greatest(F.size(ends), F.lit(2)))
        return F.exists(places, lambda i: ~before(i).rlike(P.AIRWAY_NEGATION) & (i <= F.size(ends)))

    return F.coalesce(text.rlike(P.AIRWAY) & F.exists(ends, clear), F.lit(False))


def airway_events(
    notes: DataFrame,
    base: DataFrame | None = None,
    cutoff_hours: float | None = None,
    primary: list[str] = P.PRIMARY_NOTE_TYPES,
    fallback: list[str] = P.FALLBACK_NOTE_TYPES,
) -> DataFrame:
    """First airway event per entity.

    Primary note types decide; the fallback type only for entities without a primary note; entities
    still without an event may have one by a specific phrase in any other note type. With a cutoff
    only events up to ``start + cutoff`` stay.
    """

    def first_hits(rows: DataFrame, condition: Column) -> DataFrame:
        return rows.filter(condition).groupBy("pid").agg(F.min("ts").alias("ts"))

    body = F.coalesce("text", F.lit(""))
    merged = notes.filter(F.col("note_type").isin(*primary, *fallback)).groupBy("pid", "ts", "note_type").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("note_id", body.alias("t")))), lambda s: s["t"]), "\n").alias("text")
    )
    merged = merged.select("pid", "ts", "note_type", airway_mentioned(F.col("text")).alias("hit"))
    first = merged.filter(F.col("note_type").isin(*primary))
    second = merged.filter(F.col("note_type").isin(*fallback))
    rows = fallback_union(first, second, "pid")
    # at most a row an entity, asked for twice: the texts are read once
    found = cut_lineage(first_hits(rows, F.col("hit")))
    others = notes.filter(~F.coalesce(F.col("note_type").isin(*primary, *fallback), F.lit(False)))
    extra = first_hits(others, _hit(F.col("text"), P.AIRWAY_SPECIFIC))
    out = fallback_union(found, extra, "pid")
    if cutoff_hours is not None:
        out = out.join(base.select("pid", "start_ts"), "pid").filter(not_after(F.col("ts"), F.col("start_ts"), cutoff_hours)).drop("start_ts")
    return out.select("pid", "ts", F.lit("INTUBATED").alias("feature"), F.lit(1.0).alias("value"))


# ---- token sets --------------------------------------------------------------------------


def token_set(text: Column) -> Column:
    """Distinct words without punctuation and stopwords; masked words are one token."""
    plain = F.regexp_replace(F.regexp_replace(text, P.ANONYMISED, "ANON"), r"(?U)[^\w\s]", "")
    return F.array_distinct(F.filter(F.split(plain, r"(?U)\s+"), lambda w: (w != "") & ~w.isin(*P.STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token sets; 0 when one is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / either)


# ---- repeated events ---------------------------------------------------------------------


def _candidate_lines(notes: DataFrame) -> DataFrame:
    """Lines that may report an arrest, with their flags. One regex pass over the matching notes."""
    norm_head = normal_text(F.substring("text", 1, 300))
    rows = notes.withColumn("recap", _hit(norm_head, P.ARREST_RECAP))
    rows = rows.select("pid", "ts", "note_id", "recap", F.posexplode(F.split("text", r"[\n\r]+")).alias("i", "line"))
    # most lines neither name the event nor open a section: they need no further look
    speaks = F.col("line").contains(":") | mentions(F.col("line"), P.ARREST, "fam", "information", "hereditet")
    rows = rows.filter(speaks & ~_hit(normal_text(F.col("line")), P.ARREST_DATE_PREFIX))
    parts = F.split("line", r"(?U)(?<=\w)\.(?=\s+(?:[A-ZÆØÅ]|[Hh]jertestop\b))")
    rows = rows.select("pid", "ts", "note_id", "recap", "i", F.posexplode(parts).alias("j", "line"))
    rows = rows.withColumn("line_no", F.col("i").cast("long") * 1_000_000 + F.col("j"))
    rows = rows.withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", "")).filter(F.col("line") != "")
    # a family section lasts until the next heading; the window holds the lines of one note
    section = F.when(_hit(F.col("line"), P.ARREST_EXCLUDED_SECTION), "out").when(_hit(F.col("line"), P.ARREST_HEADING), "in")
    upto = Window.partitionBy("note_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__s", F.last(section, ignorenulls=True).over(upto))
    n = normal_text(F.col("line"))
    rows = rows.filter(F.coalesce(F.col("__s") != "out", F.lit(True))).select("pid", "ts", "note_id", "recap", "line_no", n.alias("n"))
    rows = rows.filter(F.col("n").contains(P.ARREST) & ~_hit(F.col("n"), P.ARREST_DIAGNOSIS))

    n = F.col("n")
    today = F.date_format("ts", "dd/MM")

    def day_month(pattern: str) -> Column:
        found = [F.regexp_extract(n, pattern, i) for i in (1, 2)]
        return F.when(found[0] != "", F.concat_ws("/", *[F.lpad(f, 2, "0") for f in found]))

    dated = [F.coalesce(day_month(p) != today, F.lit(False)) for p in (P.ARREST_DATE, P.ARREST_DATED)]
    year = F.regexp_extract(n, P.ARREST_YEAR, 1).try_cast("int")
    other_year = F.coalesce(year != F.year("ts"), F.lit(False))
    strong = _hit(n, P.ARREST_STRONG)
    at = F.instr(n, P.ARREST)
    context = F.substring(n, F.greatest(at - 100, F.lit(1)), F.least(at - 1, F.lit(100)) + len(P.ARREST) + 100)
    weak = ~strong & (_hit(context, P.ARREST_CONTEXT_NEGATION) | _hit(n, P.ARREST_PAST))
    wrong = [*dated, other_year, weak, *[_hit(n, p) for p in (P.ARREST_UNCERTAIN, P.ARREST_NEGATIVE, P.ARREST_CALLED_BUT)]]
    rows = rows.filter(_hit(n, P.ARREST_POSITIVE) & ~reduce(lambda a, b: a | b, wrong))
    return rows.select(
        "pid",
        "ts",
        "note_id",
        "line_no",
        _hit(n, P.ARREST_TRANSPORT).alias("transport"),
        _hit(n, P.ARREST_WITNESSED).alias("witnessed"),
        F.regexp_extract(n, P.ARREST_TIMES_N, 1).try_cast("int").alias("times"),
        _hit(n, P.ARREST_AGAIN).alias("again"),
        (_hit(n, P.ARREST_PRESENT) & ~F.col("recap")).alias("present"),
    )


def _place() -> Column:
    """Order of lines within an entity: note time (missing last), note, line."""
    return F.struct(F.col("ts").isNull().alias("late"), "ts", "note_id", "line_no")


def arrest_events(notes: DataFrame) -> DataFrame:
    """Repeated arrest events of an entity from its notes in time order.

    Notes of the event's own type count once per distinct text, plus once per word of repetition.
    Other notes are read line by line: filtered lines count "x N" once per N, every line with a word
    of repetition, a line in the present tense if no earlier note of the same time counted, and any
    other line only as the entity's very first event. The line-overlap comparison of near duplicates
    (``jaccard``) needs an event counted before, after which plain lines no longer count; so the
    rules below already decide every line and all of them are order statistics per entity. A line that
    reports several events is one row with their number ``n``.
    """
    kept = notes.filter(~_hit(F.trim("note_type"), P.ARREST_EXCLUDED_TYPES))
    own_type = _hit(F.col("note_type"), "(?iu)" + P.ARREST)
    kept = kept.filter(own_type | mentions(F.col("text"), P.ARREST))

    own = kept.filter(own_type & ~_hit(F.col("text"), P.ARREST_TYPE_NEGATION))
    own = own.select(
        "pid", "ts", "note_id", F.lit(0).cast("long").alias("line_no"), F.sha2(F.trim("text"), 256).alias("key"), F.regexp_count("text", F.lit(P.ARREST_AGAIN)).alias("more")
    )
    firsts = own.groupBy("pid", "key").agg(F.min(_place()).alias("f"))
    own = own.join(firsts, ["pid", "key"]).filter((_place() == F.col("f")) | (F.col("more") > 0))
    own = own.select("pid", "ts", "note_id", "line_no", (F.col("more") + 1).alias("n"))

    # the few matching lines feed five small aggregates: keep the regex work to one run
    lines = cut_lineage(_candidate_lines(kept.filter(~own_type)).withColumn("place", _place()))
    once = lines.filter("transport").groupBy("pid").agg(F.min("place").alias("t1"))
    lines = lines.join(once, "pid", "left").filter(~F.col("transport") | (F.col("place") == F.col("t1"))).drop("t1")
    once = lines.filter("witnessed").groupBy("pid").agg(F.min("place").alias("w1"))
    lines = lines.join(once, "pid", "left").filter(~F.col("witnessed") | (F.col("place") == F.col("w1"))).drop("w1")
    counted = lines.filter(F.col("times").isNotNull()).groupBy("pid", "times").agg(F.min("place").alias("x1"))
    lines = lines.join(counted, ["pid", "times"], "left").withColumn("fresh_n", F.coalesce(F.col("place") == F.col("x1"), F.lit(False))).drop("x1")

    kind = F.when(F.col("fresh_n"), "times").when(F.col("again"), "again").when(F.col("present"), "present").otherwise("plain")
    lines = lines.withColumn("kind", kind).withColumn("n", F.when(F.col("fresh_n"), F.col("times")).otherwise(1))
    cols = ["pid", "ts", "note_id", "line_no", "n", "kind"]
    every = lines.select(*cols).unionByName(own.withColumn("kind", F.lit("own")))

    # present-tense lines count in the first counting note of their time only
    leaders = every.filter((F.col("kind") != "plain") & F.col("ts").isNotNull()).groupBy("pid", "ts").agg(F.min("note_id").alias("leader"))
    every = every.join(leaders, ["pid", "ts"], "left")
    stale = (F.col("kind") == "present") & F.col("leader").isNotNull() & (F.col("note_id") > F.col("leader"))
    every = every.filter(~stale).drop("leader").withColumn("place", _place())

    plain = F.col("kind") == "plain"
    ends = every.groupBy("pid").agg(F.min(F.when(plain, F.col("place"))).alias("p1"), F.min(F.when(~plain, F.col("place"))).alias("e1"))
    every = every.join(ends, "pid")
    leads = F.col("p1").isNotNull() & (F.col("e1").isNull() | (F.col("p1") < F.col("e1")))
    # a plain first event makes later notes of its own time stale as well
    shadowed = (F.col("kind") == "present") & leads & F.coalesce((F.col("ts") == F.col("p1.ts")) & (F.col("note_id") > F.col("p1.note_id")), F.lit(False))
    every = every.filter((plain & leads & (F.col("place") == F.col("p1"))) | (~plain & ~shadowed))
    out = every.filter(F.col("n") >= 1)
    return out.select("pid", "ts", "note_id", F.lit("cardiac_arrest").alias("feature"), F.lit(1.0).alias("value"), F.col("n").cast("long").alias("n"))


def one_row_each(events: DataFrame) -> DataFrame:
    """A row for each of the ``n`` events of a row, for export: as many rows as the notes claim events."""
    return events.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")


def as_concept(parts: list[DataFrame], feature: str = "event") -> DataFrame:
    """Text events as one categorical concept: the event's name becomes the value."""
    out = None
    for p in parts:
        rows = p.select("pid", "ts", F.lit(feature).alias("feature"), F.col("feature").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def first_note(notes: DataFrame, keys: list[str] = ("pid",)) -> DataFrame:
    return first_per_key(notes, list(keys), [F.col("ts"), F.col("note_id")], ["ts", "note_id", "text"])
