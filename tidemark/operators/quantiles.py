"""Exact grouped quantiles without holding a group in one place.

Values are counted first (map-side combine), ranks come from a sliced running count, and only
the few rows that hold a wanted rank reach the final aggregate. Linear interpolation between
order statistics, as numpy's default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sliced import Scan, sliced_scan, value_slice


def ranked_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values with their rank range: ``keys, value, n, total, first_rank, last_rank`` (0-based); keys may be none."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    out = sliced_scan(counts, keys, [value], value_slice(F.col(value)), [Scan("__cum", "sum", F.col("n"))])
    out = out.join(totals, keys) if keys else out.withColumn("total", totals.scalar())
    return out.select(
        *keys, value, "n", "total", (F.col("__cum") - F.col("n")).alias("first_rank"), (F.col("__cum") - 1).alias("last_rank")
    )


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One column per named probability."""
    ranked = ranked_values(df, keys, value)
    aggs = []
    for name, p in probs.items():
        pos = (F.col("total") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (rank >= F.col("first_rank")) & (rank <= F.col("last_rank"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"__{side}_{name}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"__w_{name}"))
    out = ranked.groupBy(*keys).agg(*aggs)
    lerp = {
        name: F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * F.col(f"__w_{name}")
        for name in probs
    }
    return out.select(*keys, *[c.cast("double").alias(n) for n, c in lerp.items()])


def quantile_table(df: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """``n`` evenly spaced quantiles per key (fewer where the key has fewer values) as rows
    ``keys, i, n_q, q``; every ranked value is matched to the quantiles it serves in closed form.

    Quantile i lies at rank i * (total - 1) / gaps. Ranks are kept as whole numbers and a remainder, so
    the last quantile is the last rank for every total and n.
    """
    ranked = ranked_values(df, keys, value).withColumn("n_q", F.least(F.lit(n), F.col("total")).cast("int"))
    ranked = ranked.withColumns({"__span": F.col("total") - 1, "__gaps": F.greatest(F.col("n_q") - 1, F.lit(1)).cast("long")})
    # the least quantile above the rank before the value's first, the greatest below the one after its last
    first = F.when(F.col("first_rank") > 0, F.expr("(first_rank - 1) * __gaps div __span") + 1).otherwise(0)
    last = F.when(F.col("__span") > 0, F.expr("((last_rank + 1) * __gaps + __span - 1) div __span") - 1).otherwise(0)
    ranked = ranked.withColumns({"__from": first, "__to": F.least(last, F.col("n_q").cast("long") - 1)})
    rows = ranked.filter("__from <= __to").withColumn("i", F.explode(F.sequence("__from", "__to")))
    rest = (F.col("i") * F.col("__span")) % F.col("__gaps")
    lower = F.expr("i * __span div __gaps")
    upper = lower + (rest > 0).cast("long")
    serves = {name: F.when(r.between(F.col("first_rank"), F.col("last_rank")), F.col(value)) for name, r in (("a", lower), ("b", upper))}
    out = rows.groupBy(*keys, F.col("i").cast("int").alias("i")).agg(
        F.max("n_q").alias("n_q"), *[F.max(c).alias(name) for name, c in serves.items()], F.max(rest / F.col("__gaps")).alias("w")
    )
    return out.select(*keys, "i", "n_q", (F.col("a") + (F.col("b") - F.col("a")) * F.col("w")).alias("q"))
