"""Roll-ups of a long attribution table ``(pid, timeframe, channel, step, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import top_k


def importance(rows: DataFrame, axis: str) -> DataFrame:
    """Mean and std over entities of each entity's mean |value| along ``axis`` (channel, step or
    category), per timeframe."""
    per = rows.groupBy("timeframe", "pid", axis).agg(F.avg(F.abs("value")).alias("v"))
    return per.groupBy("timeframe", axis).agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("*").alias("n_entities")
    )


def entity_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("timeframe", "pid").agg(F.lit(1).alias("one")).groupBy("timeframe").agg(F.count("*").alias("n_entities"))


def group_share(rows: DataFrame, in_group: Column, by_step: bool = False) -> DataFrame:
    """Share of the total |value| held by a channel group against the rest, averaged over entities."""
    keys = ["timeframe", "step"] if by_step else ["timeframe"]
    per = rows.groupBy(*keys, "pid").agg(
        F.sum(F.when(in_group, F.abs("value")).otherwise(0.0)).alias("a"),
        F.sum(F.when(~in_group, F.abs("value")).otherwise(0.0)).alias("b"),
    )
    out = per.groupBy(*keys).agg(F.avg("a").alias("group_total"), F.avg("b").alias("rest_total"))
    total = F.col("group_total") + F.col("rest_total")
    return out.withColumns(
        {
            "group_pct": F.when(total > 0, F.col("group_total") / total * 100).otherwise(0.0),
            "rest_pct": F.when(total > 0, F.col("rest_total") / total * 100).otherwise(0.0),
        }
    )


def _ranked(imp: DataFrame) -> DataFrame:
    """Average rank per timeframe. Channels are a bounded vocabulary."""
    from pyspark.sql import Window

    w = Window.partitionBy("timeframe").orderBy("mean")
    ties = Window.partitionBy("timeframe", "mean")
    return imp.withColumn("r", F.rank().over(w) + (F.count("*").over(ties) - 1) / 2.0)


def stability(rows: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Between timeframes: rank and value correlation of channel importance, and the overlap of the
    top k channels. Pairs are formed on the importance table (timeframe x channel), not on rows."""
    imp = importance(rows, "channel").select("timeframe", "channel", "mean")
    r = _ranked(imp)
    left = r.select(F.col("timeframe").alias("t1"), "channel", F.col("mean").alias("m1"), F.col("r").alias("r1"))
    right = r.select(F.col("timeframe").alias("t2"), "channel", F.col("mean").alias("m2"), F.col("r").alias("r2"))
    out = left.join(right, "channel").groupBy("t1", "t2").agg(F.corr("r1", "r2").alias("spearman"), F.corr("m1", "m2").alias("pearson"))
    for k in ks:
        best = top_k(imp, ["timeframe"], [F.col("mean").desc(), F.col("channel").desc()], k)
        sets = best.groupBy("timeframe").agg(F.collect_set("channel").alias("s"))
        # both frames hold one bounded set per timeframe
        pairs = out.select("t1", "t2").join(sets.select(F.col("timeframe").alias("t1"), F.col("s").alias("s1")), "t1")
        pairs = pairs.join(sets.select(F.col("timeframe").alias("t2"), F.col("s").alias("s2")), "t2")
        overlap = F.size(F.array_intersect("s1", "s2")) / F.size(F.array_union("s1", "s2"))
        out = out.join(pairs.select("t1", "t2", overlap.alias(f"jaccard_{k}")), ["t1", "t2"])
    return out


def top_channels(rows: DataFrame, k: int = 15) -> DataFrame:
    """Top k channels per timeframe with the standard error of their importance."""
    imp = importance(rows, "channel").withColumn("sem", F.col("std") / F.sqrt("n_entities"))
    return top_k(imp.drop("std"), ["timeframe"], [F.col("mean").desc(), F.col("channel")], k)


def timeframe_summary(rows: DataFrame, in_group: Column) -> DataFrame:
    """Per timeframe: top five channels, mean and largest importance, group share."""
    imp = importance(rows, "channel")
    top = top_k(imp, ["timeframe"], [F.col("mean").desc(), F.col("channel")], 5)
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "channel"))), lambda s: s["channel"].cast("string")), ", ")
    out = top.groupBy("timeframe").agg(names.alias("top5"))
    out = out.join(imp.groupBy("timeframe").agg(F.avg("mean").alias("mean"), F.max("mean").alias("max")), "timeframe")
    return out.join(group_share(rows, in_group).select("timeframe", "group_pct", "rest_pct"), "timeframe")


def change_between(rows: DataFrame, t1, t2, k: int) -> DataFrame:
    """Channels whose summed |value| changed most between two timeframes; an absent one counts 0."""
    sums = rows.filter(F.col("timeframe").isin(t1, t2)).groupBy("channel").agg(
        F.sum(F.when(F.col("timeframe") == t1, F.abs("value")).otherwise(0.0)).alias("before"),
        F.sum(F.when(F.col("timeframe") == t2, F.abs("value")).otherwise(0.0)).alias("after"),
    )
    out = sums.withColumn("change", F.col("after") - F.col("before"))
    return out.orderBy(F.abs("change").desc(), "channel").limit(k)
