"""Deterministic splits and samples by seeded hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quantiles import group_quantiles
from tidemark.operators.sliced import running_number


def seeded_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def hash_rank(df: DataFrame, strata: list[str], key: str, seed: int, name: str = "rank") -> DataFrame:
    """1-based rank per stratum in hash order. Slices are hash prefixes, hence even: a stratum
    that holds most rows is numbered by many tasks."""
    out = df.withColumn("__h", seeded_hash(F.col(key), seed))
    slices = [F.conv(F.substring("__h", 1, 3), 16, 10).cast("long")]
    return running_number(out, strata, ["__h", key], name, slices=slices).drop("__h")


def temporal_split(df: DataFrame, ts: str, date: str) -> tuple[DataFrame, DataFrame]:
    """(on or before the date, after it); the date is required."""
    cut = F.lit(date).cast("timestamp_ntz")
    return df.filter(F.col(ts) <= cut), df.filter(F.col(ts) > cut)


def stratified_holdout(df: DataFrame, label: str | None, key: str, fraction: float, seed: int) -> DataFrame:
    """``holdout`` flag: the first ``round(f n)`` ids of each stratum in hash order."""
    rows = df if label else df.withColumn("__all", F.lit(1))
    stratum = label or "__all"
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("__n"))
    ranked = hash_rank(rows, [stratum], key, seed, "__r").join(sizes, stratum)
    out = ranked.withColumn("holdout", F.col("__r") <= F.round(F.col("__n") * fraction))
    return out.drop("__r", "__n", "__all")


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: int) -> DataFrame:
    """Fold 0..k-1 per id, spread evenly inside every label."""
    out = hash_rank(df, [label], key, seed, "__r")
    return out.withColumn("fold", ((F.col("__r") - 1) % k).cast("int")).drop("__r")


def case_control(df: DataFrame, steps: list[int], seed: int, strict: bool = False) -> DataFrame:
    """Per step all active cases and as many active controls in hash order.

    ``df(pid, label, traj_len)``; active is ``traj_len >= step`` (``>`` when strict).
    """
    rows = df.withColumn("step", F.explode(F.lit(steps)))
    active = F.col("traj_len") > F.col("step") if strict else F.col("traj_len") >= F.col("step")
    rows = rows.filter(active)
    n_cases = rows.groupBy("step").agg(F.sum("label").alias("__n"))
    ranked = hash_rank(rows, ["step", "label"], "pid", seed, "__r").join(n_cases, "step")
    return ranked.filter((F.col("label") == 1) | (F.col("__r") <= F.col("__n"))).drop("__r", "__n")


def case_control_report(df: DataFrame, sample: DataFrame, steps: list[int], strict: bool = False) -> DataFrame:
    """Active, case, control and sampled counts with the prevalence per step."""
    rows = df.withColumn("step", F.explode(F.lit(steps)))
    active = F.col("traj_len") > F.col("step") if strict else F.col("traj_len") >= F.col("step")
    a = rows.filter(active).groupBy("step").agg(F.count("*").alias("n_active"), F.sum("label").alias("n_cases"))
    s = sample.groupBy("step").agg(F.count("*").alias("n_sampled"))
    out = a.join(s, "step", "left").withColumn("n_sampled", F.coalesce("n_sampled", F.lit(0)))
    return out.withColumn("prevalence", F.col("n_cases") * 100.0 / F.col("n_active"))


def quantile_bins(df: DataFrame, value: str, q: int, name: str) -> DataFrame:
    """Right-closed quantile bins 0..q-1 with linear quantile edges; the lowest edge is included,
    repeated edges are dropped. Edges are one row for the whole frame."""
    probs = {f"__e{i}": i / q for i in range(q + 1)}
    edges = group_quantiles(df, [], value, probs).select(F.array_distinct(F.array(*[F.col(p) for p in probs])))
    # number of edges below the value, the first bin taking the minimum itself
    below = F.size(F.filter("__edges", lambda e: e < F.col(value)))
    out = df.withColumn("__edges", edges.scalar())
    return out.withColumn(name, F.when(F.col(value).isNotNull(), F.greatest(below - 1, F.lit(0)))).drop("__edges")


def equal_width_bins(value: Column, lo: float, hi: float, n: int) -> Column:
    """Right-closed equal-width bins 0..n-1; the low end belongs to the first; NULL outside."""
    pos = F.ceil((value - lo) / ((hi - lo) / n)) - 1
    return F.when((value >= lo) & (value <= hi), F.greatest(F.least(pos, F.lit(n - 1)), F.lit(0)).cast("int"))


def proportional_sample(df: DataFrame, strata: list[str], key: str, n_target: int, seed: int) -> DataFrame:
    """About ``n_target`` ids, at least one per stratum, in proportion to the stratum's size."""
    sizes = df.groupBy(*strata).agg(F.count("*").alias("__n"))
    total = sizes.agg(F.sum("__n"))
    # rounding half to even, as the quota rule does
    quota = sizes.withColumn("__total", total.scalar()).withColumn(
        "__q", F.greatest(F.lit(1.0), F.rint(F.col("__n") * F.lit(float(n_target)) / F.col("__total")))
    )
    ranked = hash_rank(df, strata, key, seed, "__r").join(quota.select(*strata, "__q"), strata)
    return ranked.filter(F.col("__r") <= F.col("__q")).drop("__r", "__q")


def compare_sample(cohort: DataFrame, sample: DataFrame, numeric: list[str], shares: dict[str, Column]) -> DataFrame:
    """Cohort and sample side by side: n, mean and std of numbers, percentages of conditions."""
    aggs = [F.count("*").alias("n")]
    for c in numeric:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    aggs += [(F.avg(cond.cast("double")) * 100).alias(f"{name}_pct") for name, cond in shares.items()]
    both = cohort.withColumn("part", F.lit("cohort")).unionByName(sample.withColumn("part", F.lit("sample")))
    return both.groupBy("part").agg(*aggs)
