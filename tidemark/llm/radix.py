"""Ranks of rows by a composite key: a distributed radix sort, least significant digit first.

Rows lie in an array that is cut into blocks. A pass orders them stably by one digit of the key: rows are
counted per digit and block, prefix sums of the counts say where each block's share of a digit begins, and a
row goes to that place plus its number among its block's rows of that digit. Only counts are added up across
blocks; a row moves once a pass, and no task sees more than a block's rows, whatever the keys.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import work

#: Bits of a digit at most, and rows of a block at most.
DIGIT = 16
BLOCK = 1 << 20
_LEAST = -(1 << 63)


@dataclass(frozen=True)
class Digit:
    """``bits`` bits of ``column`` less ``least``, from bit ``shift`` on; without ``least`` the sign is flipped."""

    column: str
    least: int | None
    shift: int
    bits: int

    def of(self) -> Column:
        value = F.col(self.column)
        plain = value.bitwiseXOR(F.lit(_LEAST)) if self.least is None else value - F.lit(self.least)
        return F.shiftrightunsigned(plain, self.shift).bitwiseAND(F.lit((1 << self.bits) - 1)).cast("int")


def digits(column: str, least: int, most: int) -> list[Digit]:
    """The digits of a column with values from ``least`` to ``most``, least significant first; none if all are equal."""
    width = (most - least).bit_length()
    base = least
    if width > 63:
        width, base = 64, None
    parts = -(-width // DIGIT)
    cuts = [width * i // parts for i in range(parts + 1)] if parts else [0]
    return [Digit(column, base, a, b - a) for a, b in zip(cuts, cuts[1:])]


def _pass(rows: DataFrame, digit: Digit, block: int) -> DataFrame:
    """``rows`` at their places after a stable counting sort by ``digit``; column ``pos`` is the place in the array."""
    spark = rows.sparkSession
    rows = rows.withColumn("digit", digit.of())
    counts = rows.groupBy("digit", "block").agg(F.count("*").alias("n"))
    # at most 2 ** DIGIT totals
    totals = counts.groupBy("digit").agg(F.sum("n").alias("n")).toArrow().sort_by("digit")
    n = totals["n"].to_numpy()
    starts = F.broadcast(spark.createDataFrame(pa.table({"digit": totals["digit"], "start": np.cumsum(n) - n})))
    earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("digit", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    offsets = before.join(starts, "digit").select("block", "digit", (F.col("start") + F.col("before")).alias("offset"))
    among = F.row_number().over(Window.partitionBy("block", "digit").orderBy("pos")) - 1
    moved = rows.withColumn("among", among).join(offsets, ["block", "digit"]).withColumn("pos", F.col("offset") + F.col("among"))
    return work.written(moved.withColumn("block", F.floor(F.col("pos") / block)).drop("digit", "among", "offset"))


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, 3, ...) in ascending order of ``keys`` (long columns without nulls, first counts most).

    Rows that are equal in all keys follow each other in no set order. No rows give no rows. ``pos``, ``block``,
    ``digit``, ``among`` and ``offset`` must not be names of columns.
    """
    rows = work.written(rows.withColumn("pos", F.monotonically_increasing_id()))
    ends = rows.agg(F.count("*").alias("n"), *[f(k).alias(f"{name}_{i}") for i, k in enumerate(keys) for name, f in (("lo", F.min), ("hi", F.max))]).first()
    if not ends["n"]:
        return rows.withColumn("rank", F.col("pos")).drop("pos")
    blocks = max(work.slots(rows.sparkSession), -(-ends["n"] // BLOCK))
    size = -(-ends["n"] // blocks)
    passes = [d for i in reversed(range(len(keys))) for d in digits(keys[i], ends[f"lo_{i}"], ends[f"hi_{i}"])]
    if not passes:  # all keys are equal: one pass by nothing numbers the rows
        passes = [Digit(keys[0], ends["lo_0"], 0, 1)]
    rows = rows.withColumn("block", F.pmod(F.xxhash64("pos"), F.lit(blocks)))
    for digit in passes:
        rows = _pass(rows, digit, size)
    return rows.withColumn("rank", F.col("pos") + 1).drop("pos", "block")
