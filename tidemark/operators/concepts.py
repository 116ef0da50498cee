"""Concept filters: raw source tables to standard events, and their registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as c
from tidemark.functions import lookups as L
from tidemark.functions.classify import department, drug_classes, longest_prefix
from tidemark.operators.trajectory import close_open_ends

EVENT_KEY = ["pid", "ts", "feature", "value"]


def split_pairs(df: DataFrame, is_pair: Column, value: str = "value", feature: str = "feature") -> DataFrame:
    """``"120/70"`` rows to an SBP and a DBP row; other rows pass."""
    both = F.array(
        F.struct(F.lit("SBP").alias("f"), c.pair_part(F.col(value), 0).alias("v")),
        F.struct(F.lit("DBP").alias("f"), c.pair_part(F.col(value), 1).alias("v")),
    )
    same = F.array(F.struct(F.col(feature).alias("f"), F.col(value).alias("v")))
    out = df.withColumn("__p", F.explode(F.when(is_pair, both).otherwise(same)))
    return out.withColumn(feature, F.col("__p.f")).withColumn(value, F.col("__p.v")).drop("__p")


def dedupe_events(events: DataFrame, tags: tuple[str, ...] = ()) -> DataFrame:
    """Exact duplicates on (pid, ts, feature, value); of extra tags the smallest is kept."""
    if not tags:
        return events.dropDuplicates(EVENT_KEY)
    return events.groupBy(*EVENT_KEY).agg(*[F.min(t).alias(t) for t in tags])


def to_celsius(feature: Column, value: Column) -> Column:
    """Text value with Fahrenheit readings converted: by name, or by size for ``Temperatur``."""
    number = c.to_number(value)
    celsius = c.fahrenheit_to_celsius(number).cast("string")
    return (
        F.when(feature.isin(*L.FAHRENHEIT_NAMES), celsius)
        .when((feature == "Temperatur") & (number > 50), celsius)
        .otherwise(value)
    )


def body_units(feature: Column, value: Column) -> Column:
    """Height from inches, weight from ounces."""
    number = c.to_number(value)
    return (
        F.when(feature == "HEIGHT", c.convert(number, "inch_cm").cast("string"))
        .when(feature == "WEIGHT", c.convert(number, "ounce_kg").cast("string"))
        .otherwise(value)
    )


def score_vitals(scores: DataFrame) -> DataFrame:
    """Vital readings hidden in score rows (``param``, ``value "120/70 (0)"``)."""
    name = c.lookup(F.col("param"), L.SCORE_VITALS)
    return scores.filter(name.isNotNull()).withColumns({"param": name, "value": c.strip_score(F.col("value"))})


def clean_vitals(
    vitals: DataFrame, scores: DataFrame | None = None, extra: DataFrame | None = None, body: bool = False
) -> DataFrame:
    """``vitals(pid, ts, param, value)`` to standard events with an invasive-source tag.

    Augment from scores, convert units, split pressure pairs, rename, keep known features,
    drop implausible values, add another source's events, remove duplicates.
    ``body`` keeps height and weight instead of the vital features.
    """
    cols = ["pid", "ts", "param", "value"]
    rows = vitals.select(*cols)
    if scores is not None:
        rows = rows.unionByName(score_vitals(scores).select(*cols)).dropDuplicates(cols)
    param, value = F.col("param"), F.col("value")
    tag = F.when(param.isin(*L.INVASIVE_PRESSURES), "arterial_bp").otherwise(c.lookup(param, L.INVASIVE_NAMES))
    rows = rows.select("pid", "ts", param.alias("feature"), to_celsius(param, value).alias("value"), tag.alias("invasive"))
    rows = split_pairs(rows, F.col("feature").isin(*L.PRESSURE_PAIRS))
    rows = rows.withColumn("feature", c.rename_values(F.col("feature"), {**L.VITAL_NAMES, **L.BODY_NAMES}))
    rows = rows.withColumn("value", body_units(F.col("feature"), F.col("value")))
    wanted = list(L.BODY_NAMES.values()) if body else sorted(set(L.VITAL_NAMES.values()))
    rows = rows.filter(
        F.col("feature").isin(*wanted)
        & F.col("value").rlike(c.NUMBER_PATTERN)
        & c.within_bounds(F.col("feature"), F.col("value"), L.VITAL_BOUNDS)
    )
    if extra is not None:
        rows = rows.unionByName(extra, allowMissingColumns=True)
    return dedupe_events(rows, ("invasive",))


def invasive_events(vitals: DataFrame) -> DataFrame:
    """Distinct categorical events from the invasive-source tag of cleaned vitals."""
    return (
        vitals.filter(F.col("invasive").isNotNull())
        .select("pid", "ts", F.lit("invasive_monitoring").alias("feature"), F.col("invasive").alias("value"))
        .distinct()
    )


def clean_labs(labs: DataFrame) -> DataFrame:
    """``labs(pid, ts, param, value)``: known orders, numeric values."""
    names = L.reverse(L.LAB_NAMES)
    out = labs.filter(F.col("param").isin(*names))
    out = out.select("pid", "ts", c.lookup(F.col("param"), names).alias("feature"), c.lab_number(F.col("value")).alias("value"))
    return out.filter(F.col("value").isNotNull())


def clean_icu(rows: DataFrame) -> DataFrame:
    return rows.withColumn("feature", c.rename_values(F.col("param"), L.ICU_NAMES)).drop("param")


def clean_warning_scores(rows: DataFrame) -> DataFrame:
    name = c.lookup(F.col("param"), L.WARNING_SCORE_NAMES)
    out = rows.select("pid", "ts", name.alias("feature"), c.to_number(F.col("value")).alias("value"))
    return out.filter(F.col("feature").isNotNull() & F.col("value").isNotNull()).dropDuplicates(EVENT_KEY)


def clean_procedures(rows: DataFrame, sub_code_length: int = 0) -> DataFrame:
    """``rows(pid, ts, code)`` to specialty labels; unknown codes go."""
    label = longest_prefix(F.col("code"), L.PROCEDURE_CLASSES)
    out = rows.withColumn("value", label).filter(F.col("value").isNotNull()).withColumn("feature", F.lit("procedures"))
    if sub_code_length:
        out = out.withColumn("sub_code", F.substring("code", 1, sub_code_length))
    return out.drop("code")


def clean_medication(rows: DataFrame, sub_code_length: int = 0) -> DataFrame:
    """``rows(pid, ts, code, action)``: one event per matching class of both code levels."""
    out = rows.filter(F.col("action").isin(*L.DRUG_ACTIONS))
    out = out.withColumn("value", F.explode(drug_classes(F.col("code")))).withColumn("feature", F.lit("medication"))
    if sub_code_length:
        out = out.withColumn("sub_code", F.substring("code", 1, sub_code_length))
    return out.distinct()


def clean_moves(rows: DataFrame, base: DataFrame) -> DataFrame:
    """``rows(pid, ts, end_ts, unit, event_id)`` to department intervals with closed ends."""
    out = rows.withColumn("value", department(F.col("unit"))).filter(F.col("value").isNotNull())
    return close_open_ends(out.withColumn("feature", F.lit("ADT")), base)


def device_events(
    events: DataFrame, code_map: dict[str, str], bounds: dict[str, tuple[float, float]], names: dict[str, str] | None = None
) -> DataFrame:
    """Coded device rows ``(pid, code, manual_ts, created_ts, value)`` to standard events."""
    feature = c.lookup(F.col("code"), code_map)
    if names is not None:
        feature = c.lookup(feature, names)
    out = events.select(
        "pid", F.coalesce("manual_ts", "created_ts").alias("ts"), feature.alias("feature"), c.to_number(F.col("value")).alias("value")
    )
    whole = F.col("feature").isNotNull() & F.col("ts").isNotNull() & F.col("value").isNotNull() & F.col("pid").isNotNull()
    return out.filter(whole & c.within_bounds(F.col("feature"), F.col("value"), bounds))


def worst_value(rows: DataFrame, severity: dict[str, list[str]], order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Worst reading per (pid, component): by number if the component has numbers, else by the
    component's severity list, else the latest. ``rows(pid, component, value, ts, event_id)``."""
    number = c.to_number(F.col("value"))
    numeric = rows.groupBy("component").agg(F.max(number.isNotNull()).alias("__numeric"))
    rank = F.lit(None).cast("double")
    for comp, labels in severity.items():
        at = F.array_position(F.lit(labels), F.col("value")).cast("double") - 1
        rank = F.when(F.col("component") == comp, at).otherwise(rank)
    known = F.col("component").isin(*severity) if severity else F.lit(False)
    weight = F.when(F.col("__numeric"), number).when(known, F.coalesce(rank, F.lit(-1.0))).otherwise(F.lit(0.0))
    key = F.struct(F.coalesce(weight, F.lit(-1e308)), *order)
    return rows.join(numeric, "component").groupBy("pid", "component").agg(F.max_by("value", key).alias("value"))


# name -> filter; users add their own
CONCEPT_FILTERS: dict[str, Callable[..., DataFrame]] = {
    "vitals": clean_vitals,
    "labs": clean_labs,
    "icu": clean_icu,
    "warning_scores": clean_warning_scores,
    "procedures": clean_procedures,
    "medication": clean_medication,
    "moves": clean_moves,
}


def register_concept(name: str, fn: Callable[..., DataFrame]) -> None:
    CONCEPT_FILTERS[name] = fn
