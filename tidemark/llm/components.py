"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import work


def stars(edges: DataFrame) -> bool:
    """Whether every id of ``edges`` (u, v) is either a centre or points at one centre only."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    tied = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)")
    return tied.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id it reaches) of every id in ``links`` (a long, b long).

    Each step points neighbours at the least one seen, so chains halve; each result is written, so a lost
    executor never repeats earlier steps. Repeated links and links to oneself change nothing; no links, no rows.
    """
    edges = work.written(work.gathered(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()))
    while not stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = work.written(work.gathered(kept.union(low.select("u", F.col("m").alias("v"))).distinct()))
    # edges are now stars around the least id: each points from the larger end to the smaller
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
