"""Clinical scores as column formulas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import to_number

# Weights of the coded parts.
PHYSIOLOGY_WEIGHTS = {"gcs": 0.9368, "sbp": 0.7326, "rr": 0.2908}
# Intercept and slopes (physiology, severity, age) per mechanism.
SURVIVAL_COEFFICIENTS = {"blunt": (-0.4499, 0.8085, -0.0835, -1.7430), "penetrating": (-2.5355, 0.9934, -0.0651, -1.1360)}
# Accepted spellings per mechanism.
MECHANISM_NAMES = {"blunt": ["blunt", "b", "blunt_tr"], "penetrating": ["penetrating", "p", "pen"]}


def physiology_codes(gcs: Column, sbp: Column, rr: Column) -> dict[str, Column]:
    """Each vital coded 0-4."""
    return {
        "gcs": F.when(gcs >= 13, 4).when(gcs >= 9, 3).when(gcs >= 6, 2).when(gcs >= 4, 1).otherwise(0),
        "sbp": F.when(sbp > 89, 4).when(sbp >= 76, 3).when(sbp >= 50, 2).when(sbp >= 1, 1).otherwise(0),
        "rr": F.when((rr >= 10) & (rr <= 29), 4).when(rr >= 30, 3).when(rr >= 6, 2).when(rr >= 1, 1).otherwise(0),
    }


def physiologic_score(gcs: Column, sbp: Column, rr: Column) -> tuple[Column, Column]:
    """(weighted, plain) score; NULL when any part is missing."""
    codes = physiology_codes(gcs, sbp, rr)
    whole = gcs.isNotNull() & sbp.isNotNull() & rr.isNotNull()
    weighted = reduce(lambda a, b: a + b, [codes[k] * w for k, w in PHYSIOLOGY_WEIGHTS.items()])
    plain = reduce(lambda a, b: a + b, codes.values())
    return F.when(whole, weighted), F.when(whole, plain.cast("double"))


def survival_probability(physiology: Column, severity: Column, age: Column, mechanism: Column) -> Column:
    """Logistic survival by mechanism; age 55 and over adds its term; NULL on unknown mechanism."""
    name = F.lower(mechanism)
    older = F.when(age >= 55, 1.0).when(age.isNotNull(), 0.0)
    out = F.lit(None).cast("double")
    for kind, (b0, b1, b2, b3) in SURVIVAL_COEFFICIENTS.items():
        b = b0 + b1 * physiology + b2 * severity + b3 * older
        out = F.when(name.isin(*MECHANISM_NAMES[kind]), 1 / (1 + F.exp(-b))).otherwise(out)
    return out


def mechanism(df: DataFrame, code_columns: list[str], text_columns: list[str], is_penetrating=lambda c: c[2:4] == "60") -> Column:
    """Blunt unless a penetrating code column is positive or a text names a cut or firearm.
    Which code columns count is told by their name."""
    hits = [F.coalesce(to_number(F.col(c)) > 0, F.lit(False)) for c in code_columns if is_penetrating(c)]
    hits += [F.coalesce(F.col(c).rlike("(?i)Cut/pierce|Firearm"), F.lit(False)) for c in text_columns]
    any_hit = reduce(lambda a, b: a | b, hits, F.lit(False))
    return F.when(any_hit, "penetrating").otherwise("blunt")


def score_table(vitals: DataFrame, severities: DataFrame, statics: DataFrame, severity_columns: list[str], text_columns: list[str], code_columns: list[str] | None = None) -> DataFrame:
    """First vitals, physiologic score, largest severity, mechanism and survival per pid.

    ``vitals(pid, first_GCS, first_SBP, first_RR)``, ``severities(pid, …)``, ``statics(pid, age, …)``.
    A vital of 0 is a filled gap and counts as missing.
    """
    out = statics.join(vitals, "pid", "left").join(severities, "pid", "left")
    for c in ("first_GCS", "first_SBP", "first_RR"):
        out = out.withColumn(c, F.when(F.col(c) != 0, F.col(c)))
    weighted, plain = physiologic_score(F.col("first_GCS"), F.col("first_SBP"), F.col("first_RR"))
    out = out.withColumns({"physiology": weighted, "physiology_plain": plain})
    out = out.withColumn("severity", F.greatest(*[F.col(c) for c in severity_columns]))
    out = out.withColumn("mechanism", mechanism(out, code_columns or [], text_columns))
    survival = survival_probability(F.col("physiology"), F.col("severity"), F.col("age"), F.col("mechanism"))
    return out.withColumns({"survival_prob": survival, "death_prob": 1 - survival})


def coverage(scores: DataFrame, columns: list[str]) -> DataFrame:
    """How many entities have each score: ``(score, n_valid, n, pct)``."""
    one = scores.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("score"), F.col(c).alias("n_valid")) for c in columns])
    out = one.select("n", F.explode(rows).alias("r")).select("r.score", "r.n_valid", "n")
    return out.withColumn("pct", F.col("n_valid") * 100.0 / F.col("n"))
