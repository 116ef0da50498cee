"""A filter of fixed size for ids: rows that a join would drop anyway need not be shuffled with their texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import memory, spans

BITS = 1 << 23


def _place(ids: np.ndarray) -> np.ndarray:
    return (spans.mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(BITS)).astype(np.int64)


def marked(ids: DataFrame) -> np.ndarray:
    """A boolean for each hash value, true if an id of ``ids`` (one long column, no nulls) has it."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, np.uint8)
        for b in batches:
            bits[_place(b.column(0).to_numpy())] = 1
        word = np.packbits(bits, bitorder="little").view(np.int64)
        at = np.flatnonzero(word)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at), "bits": pa.array(word[at])})

    rows = ids.mapInArrow(memory.tidy(mark), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    word = np.zeros(BITS // 64, np.int64)
    word[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return np.unpackbits(word.view(np.uint8), bitorder="little").astype(bool)


def may_hold(filled: np.ndarray, ids: pa.Array) -> pa.Array:
    """Which ids may be among the marked ones; null ids always may."""
    return pa.array(filled[_place(ids.fill_null(0).to_numpy())] | ids.is_null().to_numpy(zero_copy_only=False))


def held(rows: DataFrame, filled: np.ndarray, column: str = "doc_id", inside: bool = True) -> DataFrame:
    """The rows of ``rows`` whose id may be among the marked ones, or the others, whose id surely isn't."""
    shared = rows.sparkSession.sparkContext.broadcast(filled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            may = may_hold(shared.value, b.column(column))
            yield b.filter(may if inside else pc.invert(may))

    return rows.mapInArrow(memory.tidy(run), rows.schema)
