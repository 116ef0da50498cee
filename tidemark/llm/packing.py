"""Packing into fixed-length sequences by minimum bin slack.

Texts become ids, each text's ids are cut into full windows and one rest. The rests' lengths form a
histogram of at most ``capacity`` entries, all that the planner sees: a bitset subset-sum fills one window
as closely as can be with the remaining lengths, and the same filling is repeated as often as the counts
allow. Every piece then finds its place by arithmetic from its number among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import memory, tokens, work

PIECE = "block long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, nth long"
_RANK_BITS = 44


def fill_window(counts: dict[int, int], lengths: list[int], target: int) -> dict[int, int]:
    """The multiset of at most ``counts`` lengths whose sum comes closest to ``target`` from below.

    Bit ``s`` of ``reach`` says that some multiset sums to ``s``; counts enter in doubling batches, and
    the bitset before each batch lets the batches used be traced back.
    """
    reach, full, trail = 1, (1 << (target + 1)) - 1, []
    for length in lengths:
        left, take = min(counts[length], target // length), 1
        while left and not reach >> target & 1:
            take = min(take, left)
            trail.append((length, take, reach))
            reach |= (reach << length * take) & full
            left -= take
            take *= 2
        if reach >> target & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(trail):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def slack_plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Windows as (multiset of lengths, how many such windows); each holds the longest length left."""
    counts = {k: v for k, v in counts.items() if v and 0 < k <= capacity}
    lengths, plan = sorted(counts, reverse=True), []
    while lengths:
        top = lengths[0]
        counts[top] -= 1
        used = fill_window(counts, lengths, capacity - top)
        counts[top] += 1
        used[top] = used.get(top, 0) + 1
        times = min(counts[k] // n for k, n in used.items())
        for k, n in used.items():
            counts[k] -= n * times
        plan.append((used, times))
        lengths = [k for k in lengths if counts[k]]
    return plan


def plan_table(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length and first piece number as one key, first sequence, pieces a sequence, offset)."""
    rows, used_up, sequence = [], {}, 0
    for used, times in plan:
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            first = used_up.get(length, 0)
            rows.append((length << _RANK_BITS | first, sequence, n, offset))
            used_up[length] = first + n * times
            offset += length * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """One row per piece: its place in its document, checksum, and number among its length in its task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for rows, ids, begin in tokens.encoded(batches, tokenizer, "text"):
            n = np.diff(begin) + 1
            pieces = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), pieces)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            length = np.minimum(n[row] - start, capacity)
            raw, end = ids.tobytes(), np.uint32(end_id).tobytes()
            a = begin[row] + start
            b = np.minimum(a + length, begin[row + 1])
            parts = [raw[4 * x : 4 * y] for x, y in zip(a.tolist(), b.tolist())]
            closes = start + length == n[row]
            parts = [p + end if z else p for p, z in zip(parts, closes.tolist())]
            order = np.argsort(length, kind="stable")
            sorted_length = length[order]
            fresh = np.append(True, sorted_length[1:] != sorted_length[:-1])
            group = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            nth = np.empty(len(row), np.int64)
            nth[order] = np.arange(len(row)) - group
            nth += seen[length]
            seen[:] += np.bincount(length, minlength=capacity + 1)
            cols = {
                "block": pa.array(np.full(len(row), block)),
                "doc_id": rows.column("doc_id").take(pa.array(row)),
                "start": pa.array(start),
                "length": pa.array(length),
                "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                "doc_tokens": pa.array(n[row]),
                "nth": pa.array(nth),
            }
            yield pa.RecordBatch.from_pydict(cols | ({"ids": pa.array(parts, pa.binary())} if with_ids else {}))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(memory.tidy(cut, remembers=True), PIECE + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` ids.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    ``with_ids`` the ids as little-endian 32-bit integers. A null or empty text is its end id alone; every
    row is a document, also with a null or repeated doc_id; no rows give no pieces; further columns are
    not looked at.
    """
    pieces = work.written(cut_pieces(docs, tokenizer, capacity, end_id, with_ids))
    found = work.written(pieces.groupBy("block", "length").agg(F.count("*").alias("n")))
    rests = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = rests.pop(capacity, 0)
    plan = slack_plan(dict(rests), capacity)
    if full:
        plan.append(({capacity: 1}, full))
    table = plan_table(plan)
    keys = table[:, 0].copy()
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    numbered = pieces.join(found.select("block", "length", F.coalesce(before, F.lit(0)).alias("before")), ["block", "length"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy()
            key = length << _RANK_BITS | (b.column("before").to_numpy() + b.column("nth").to_numpy())
            at = np.searchsorted(keys, key, "right") - 1
            nth = key - keys[at]
            cols = {c: b.column(c) for c in kept}
            cols["sequence_id"] = pa.array(table[at, 1] + nth // table[at, 2])
            cols["offset"] = pa.array(table[at, 3] + nth % table[at, 2] * length)
            yield pa.RecordBatch.from_pydict(cols)

    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long," + " ids binary," * with_ids
    return numbered.mapInArrow(memory.tidy(place), schema + " sequence_id long, offset long")
