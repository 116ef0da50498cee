"""Data-quality jobs: stage checks, sampled recompute, range QA, typing, counts, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import lookup, to_number
from tidemark.operators.joins import top_k
from tidemark.operators.mapping import CELL, aggregate_cells, point_to_step


def _verdict(name: str, ok: Column, detail: Column, weak: str = "FAIL") -> Column:
    status = F.when(ok, "PASS").otherwise(weak)
    return F.struct(F.lit(name).alias("check"), status.alias("status"), detail.cast("string").alias("detail"))


def check_stage(cells: DataFrame, base: DataFrame, required: list[str]) -> DataFrame:
    """Stage output checks as ``(check, status, detail)``: columns, rows, entities, first cell
    against the earliest start, rows before the start."""
    missing = sorted(set(required) - set(cells.columns))
    facts = cells.join(base.select("pid", F.col("start_ts").alias("__s")), "pid", "left").agg(
        F.count("*").alias("rows"),
        F.count_distinct("pid").alias("entities"),
        F.min("bin_start").alias("first_bin"),
        F.min("__s").alias("first_start"),
        F.coalesce(F.sum((F.col("bin_start") < F.col("__s")).cast("long")), F.lit(0)).alias("early"),
        F.coalesce(F.sum(F.col("__s").isNull().cast("long")), F.lit(0)).alias("orphans"),
    )
    rows = F.array(
        _verdict("columns", F.lit(not missing), F.lit(",".join(missing))),
        _verdict("rows", F.col("rows") > 0, F.col("rows")),
        _verdict("entities", F.col("entities") > 0, F.col("entities")),
        _verdict("first_bin_at_first_start", F.col("first_bin") == F.col("first_start"), F.lit(""), "WARN"),
        _verdict("rows_before_start", F.col("early") == 0, F.col("early"), "WARN"),
        _verdict("rows_without_entity", F.col("orphans") == 0, F.col("orphans")),
    )
    return facts.select(F.explode(rows).alias("r")).select("r.*")


def sample_entities(ids: DataFrame, n: int, seed: int, key: str = "pid") -> DataFrame:
    """n entities by the smallest seeded hash: a deterministic sample, a distributed top-n."""
    order = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return ids.select(key).distinct().orderBy(order, key).limit(n)


def recompute_check(events: DataFrame, base: DataFrame, mapped: DataFrame, n: int, seed: int, tolerance: float = 0.01) -> DataFrame:
    """For sampled entities compare the stored mean per cell with one recomputed from raw events:
    PASS within tolerance, WARN beyond it, SKIP where one side is missing."""
    ids = sample_entities(base, n, seed)
    raw = aggregate_cells(point_to_step(events.join(ids, "pid", "left_semi"), base), ["mean"])
    kept = mapped.join(ids, "pid", "left_semi").select(*CELL, F.col("mean").alias("stored"))
    both = raw.withColumnRenamed("mean", "recomputed").join(kept, CELL, "full")
    diff = F.abs(F.col("stored") - F.col("recomputed"))
    status = F.when(diff.isNull(), "SKIP").when(diff < tolerance, "PASS").otherwise("WARN")
    return both.groupBy("pid", status.alias("status")).agg(F.count("*").alias("n"))


def range_report(values: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Per feature: count, min, max, rows outside its range, share lost, counts and extremes
    below and above. ``values(feature, value)``."""
    number = to_number(F.col("value"))
    rows = values.withColumns(
        {
            "x": number,
            "lo": lookup(F.col("feature"), {k: v[0] for k, v in bounds.items()}),
            "hi": lookup(F.col("feature"), {k: v[1] for k, v in bounds.items()}),
        }
    ).filter(F.col("x").isNotNull() & F.col("lo").isNotNull())
    below, above = F.col("x") < F.col("lo"), F.col("x") > F.col("hi")
    out = rows.groupBy("feature").agg(
        F.count("*").alias("n"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.sum(below.cast("long")).alias("n_below"),
        F.sum(above.cast("long")).alias("n_above"),
        F.min(F.when(below, F.col("x"))).alias("min_below"),
        F.max(F.when(below, F.col("x"))).alias("max_below"),
        F.min(F.when(above, F.col("x"))).alias("min_above"),
        F.max(F.when(above, F.col("x"))).alias("max_above"),
    )
    lost = (F.col("n_below") + F.col("n_above")) * 100.0 / F.col("n")
    return out.withColumn("pct_lost", lost)


def outside_buckets(values: DataFrame, bounds: dict[str, tuple[float, float]], buckets: int = 10) -> DataFrame:
    """Equal-width buckets, left-open like pandas ``cut``, of the values above their range."""
    rows = values.withColumns(
        {"x": to_number(F.col("value")), "hi": lookup(F.col("feature"), {k: v[1] for k, v in bounds.items()})}
    ).filter(F.col("x") > F.col("hi"))
    span = rows.groupBy("feature").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    pos = F.ceil((F.col("x") - F.col("a")) / ((F.col("b") - F.col("a")) / F.lit(float(buckets)))) - 1
    pos = F.when(F.col("b") == F.col("a"), 0).otherwise(F.greatest(F.lit(0), F.least(pos, F.lit(buckets - 1))))
    return rows.join(span, "feature").groupBy("feature", pos.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def concept_types(values: DataFrame) -> DataFrame:
    """Per feature: distinct values, their share, non-numeric rows, and whether it looks categorical:
    any non-numeric value, or text with few values (< 100 and < 20 %)."""
    text = values.schema["value"].dataType.typeName() == "string"
    # two-level: distinct values first, so that a hot feature is spread over its values
    per_value = values.groupBy("feature", "value").agg(F.count("*").alias("c"))
    out = per_value.groupBy("feature").agg(
        F.sum("c").alias("n_total"),
        F.sum(F.col("value").isNotNull().cast("long")).alias("n_unique"),
        F.sum(F.when(F.col("value").isNotNull() & to_number(F.col("value")).isNull(), F.col("c")).otherwise(0)).alias("n_non_numeric"),
    )
    out = out.withColumn("unique_ratio", F.col("n_unique") / F.col("n_total"))
    few = F.lit(text) & (F.col("unique_ratio") < 0.2) & (F.col("n_unique") < 100)
    return out.withColumn("is_categorical", (F.col("n_non_numeric") > 0) | few)


def feature_summary(events: DataFrame, keys: list[str], decimals: int = 2) -> DataFrame:
    """Count, min, max and rounded mean per key."""
    return events.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.round(F.min("value"), decimals).alias("min"),
        F.round(F.max("value"), decimals).alias("max"),
        F.round(F.avg("value"), decimals).alias("mean"),
    )


def name_list(events: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Sorted distinct names per key as one text (names come from a bounded vocabulary)."""
    return events.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(name)), ", ").alias("names"))


def registration_counts(events: DataFrame, split: str = "split") -> DataFrame:
    """Rows and distinct entities per split and overall."""
    per_entity = events.groupBy(split, "pid").agg(F.count("*").alias("c"))
    by = per_entity.groupBy(split).agg(F.sum("c").alias("n_rows"), F.count("*").alias("n_entities"))
    every = per_entity.groupBy("pid").agg(F.sum("c").alias("c"))
    total = every.agg(F.lit("all").alias(split), F.sum("c").alias("n_rows"), F.count("*").alias("n_entities"))
    return by.unionByName(total)


def top_features(events: DataFrame, k: int = 10, split: str = "split") -> DataFrame:
    """Most frequent features per split."""
    counted = events.groupBy(split, "feature").agg(F.count("*").alias("n"))
    return top_k(counted, [split], [F.col("n").desc(), F.col("feature")], k)


def completeness(cells: DataFrame, lengths: DataFrame, features: list[str], n_steps: int) -> DataFrame:
    """present / missing / padding per (entity, channel, step). ``lengths(pid, traj_len)``."""
    full = lengths.withColumn("feature", F.explode(F.lit(features))).withColumn(
        "step", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1)))
    )
    seen = cells.select(*CELL, F.lit(1).alias("__p"))
    state = F.when(F.col("step") >= F.col("traj_len"), "padding").when(F.col("__p").isNotNull(), "present").otherwise("missing")
    return full.join(seen, CELL, "left").select(*CELL, state.alias("state"))


def completeness_rate(states: DataFrame) -> DataFrame:
    """Share of present cells per channel, padding left out."""
    alive = states.filter(F.col("state") != "padding")
    return alive.groupBy("feature").agg(F.avg((F.col("state") == "present").cast("double")).alias("rate"), F.count("*").alias("n"))


def compare_pipelines(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float, by: list[str]) -> DataFrame:
    """Two pipelines over the same keys: how many agree, the largest difference, pass or fail."""
    both = a.select(*keys, F.col(value).alias("__a")).join(b.select(*keys, F.col(value).alias("__b")), keys, "full")
    diff = F.abs(F.col("__a") - F.col("__b"))
    out = both.withColumn("__d", diff).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum(F.col("__d").isNull().cast("long")).alias("n_one_sided"),
        F.sum((F.col("__d") <= tolerance).cast("long")).alias("n_within"),
        F.max("__d").alias("max_diff"),
        F.avg("__d").alias("mean_diff"),
    )
    return out.withColumn("n_within", F.coalesce("n_within", F.lit(0))).withColumn("status", F.when(F.col("n_within") == F.col("n"), "PASS").otherwise("FAIL"))


def largest_differences(a: DataFrame, b: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """Top k keys by absolute difference of two pipelines."""
    both = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys)
    both = both.withColumn("diff", F.abs(F.col("a") - F.col("b")))
    return both.orderBy(F.col("diff").desc(), *keys).limit(k)
