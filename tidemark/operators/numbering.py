"""Dense numbers of distinct keys in key order, without gathering the keys."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

_LOCAL = 33


def number_distinct(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Distinct key tuples with a dense 1-based number in key order, nulls first.

    Keys are sorted by ranges, one range a task, and kept with their place in the range; a key's number is its
    place plus the sizes of the ranges before. Only the sizes, one for each shuffle partition, reach the driver.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.select(*keys).distinct().repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = cut_lineage(ranged.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", _LOCAL).cast("int")
    sizes = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before = [0, *accumulate(sizes.get(i, 0) for i in range(max(sizes, default=0)))]
    number = F.get(F.lit(before).cast("array<bigint>"), part) + F.col("__at").bitwiseAND(F.lit((1 << _LOCAL) - 1)) + 1
    return placed.select(*keys, number.alias(name))


def number_columns(df: DataFrame, known: dict[str, Column]) -> dict[str, DataFrame]:
    """For every column of ``known`` its distinct values (where the condition holds) and their dense 1-based
    ``code`` in ascending order. All columns are numbered in one sort."""
    columns = list(known)
    each = []
    for i, c in enumerate(columns):
        fields = [(F.col(o) if o == c else F.lit(None).cast(df.schema[o].dataType)).alias(o) for o in columns]
        each.append(F.when(known[c], F.struct(F.lit(i).alias("__i"), *fields)))
    rows = df.select(F.explode(F.array_compact(F.array(*each))).alias("r")).select("r.*")
    numbers = cut_lineage(number_distinct(rows, ["__i", *columns], "__n"))
    first = {r["__i"]: r["n"] for r in numbers.groupBy("__i").agg(F.min("__n").alias("n")).collect()}  # one row a column
    return {c: numbers.filter(F.col("__i") == i).select(c, (F.col("__n") - F.lit(first.get(i, 0)) + 1).alias("code")) for i, c in enumerate(columns)}
