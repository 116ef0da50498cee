"""Diagnosis scores: comorbidity categories, weighted sums, injury scores, prefix flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import diagnosis_tables as D
from tidemark.functions.columns import compact_code, lookup
from tidemark.functions.timegrid import micros
from tidemark.operators.joins import days_after, days_before, top_k

DAY = 86_400_000_000


def prior_unresolved(diagnoses: DataFrame, base: DataFrame) -> DataFrame:
    """Diagnoses noted at least a day before the start and not resolved by a day after it.

    ``diagnoses(key, code, noted_ts, resolved_ts)``, ``base(key, pid, start_ts)``.
    """
    out = diagnoses.join(base.select("key", "pid", "start_ts"), "key")
    noted = F.col("noted_ts") <= days_before(F.col("start_ts"), 1)
    alive = F.col("resolved_ts").isNull() | (F.col("resolved_ts") >= days_after(F.col("start_ts"), 1))
    return out.filter(noted & alive)


def category_array(code: Column, codes: dict[str, list[str]]) -> Column:
    """All categories whose prefixes match a code; a code may belong to several."""
    by_length: dict[int, dict[str, list[str]]] = {}
    for category, prefixes in codes.items():
        for prefix in prefixes:
            by_length.setdefault(len(prefix), {}).setdefault(prefix, []).append(category)
    parts = [
        F.coalesce(F.split(lookup(F.substring(code, 1, n), {p: " ".join(c) for p, c in table.items()}), " "), F.array().cast("array<string>"))
        for n, table in sorted(by_length.items())
    ]
    return F.array_distinct(F.concat(*parts))


def comorbidity_score(
    diagnoses: DataFrame,
    base: DataFrame,
    codes: dict[str, list[str]] = D.CATEGORY_CODES,
    weights: dict[str, float] = D.CATEGORY_WEIGHTS,
    exclusions: dict[str, str] = D.CATEGORY_EXCLUSIONS,
) -> DataFrame:
    """Category list, count and weighted score per pid; pids without a match score 0.

    ``diagnoses(pid, code)``. Maps, weights and exclusions are parameters (other published maps fit).
    The categories per pid are a set over a fixed vocabulary, combined map-side.
    """
    hit = diagnoses.select("pid", F.explode(category_array(compact_code(F.col("code")), codes)).alias("category"))
    sets = hit.groupBy("pid").agg(F.collect_set("category").alias("found"))
    kept = F.col("found")
    for present, milder in exclusions.items():
        kept = F.when(F.array_contains(F.col("found"), present), F.array_remove(kept, milder)).otherwise(kept)
    sets = sets.select("pid", F.array_sort(kept).alias("categories"))
    weight = lambda c: F.coalesce(lookup(c, {k: float(v) for k, v in weights.items()}), F.lit(0.0))
    score = F.aggregate("categories", F.lit(0.0), lambda acc, c: acc + weight(c))
    out = base.select("pid").distinct().join(sets, "pid", "left")
    return out.select(
        "pid",
        F.coalesce(F.array_join("categories", " "), F.lit("")).alias("categories"),
        F.coalesce(F.size("categories"), F.lit(0)).alias("n_categories"),
        F.coalesce(score, F.lit(0.0)).alias("score"),
    )


def injury_scores(injuries: DataFrame, table: DataFrame) -> DataFrame:
    """Injury severity per pid from a ``(code, region, severity)`` table.

    ``iss``: squares of the three worst region maxima; ``niss``: of the three worst injuries
    anywhere; any severity of 6 makes both 75. ``max_severity`` is the worst one.
    """
    hits = injuries.select("pid", "code").distinct().join(table, "code")
    regions = hits.groupBy("pid", "region").agg(F.max("severity").alias("severity"))
    square = F.when(F.max("severity") >= 6, 75).otherwise(F.sum(F.col("severity") * F.col("severity"))).cast("int")
    iss = top_k(regions, ["pid"], [F.col("severity").desc(), F.col("region")], 3).groupBy("pid").agg(square.alias("iss"))
    niss = top_k(hits, ["pid"], [F.col("severity").desc(), F.col("code"), F.col("region")], 3).groupBy("pid").agg(
        square.alias("niss"), F.max("severity").alias("max_severity")
    )
    return iss.join(niss, "pid")


def prefix_flags(
    base: DataFrame, diagnoses: DataFrame, flags: dict[str, list[str]], lo_days: int | None, hi_days: int | None
) -> DataFrame:
    """0/1 per flag: a matching, unresolved diagnosis noted within ``[lo, hi]`` days (floored) of the base time.

    All flags in one pass. ``base(pid, key, base_ts)``, ``diagnoses(key, code, noted_ts, resolved_ts)``.
    """
    both = diagnoses.join(base.select("pid", "key", "base_ts"), "key")
    delta = F.floor((micros(F.col("noted_ts")) - micros(F.col("base_ts"))) / F.lit(DAY))
    keep = F.col("resolved_ts").isNull() | (F.col("resolved_ts") > F.col("base_ts"))
    if lo_days is not None:
        keep = keep & (delta >= lo_days)
    if hi_days is not None:
        keep = keep & (delta <= hi_days)
    rows = both.filter(keep)

    def any_prefix(prefixes):
        out = F.lit(False)
        for p in prefixes:
            out = out | F.col("code").startswith(p)
        return out

    found = rows.groupBy("pid").agg(*[F.max(any_prefix(p).cast("int")).alias(name) for name, p in flags.items()])
    out = base.join(found, "pid", "left")
    return out.withColumns({name: F.coalesce(name, F.lit(0)) for name in flags})
