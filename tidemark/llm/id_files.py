"""Token ids in files: frequency-ranked, byte-aligned, control bytes apart from data bytes.

Ids are replaced by their rank among all ids of the corpus (most frequent first), so frequent ids take one
byte. Four ids share a control byte (two bits each: bytes of the rank less one), kept apart from the data
bytes; both are decoded by table lookups on whole arrays. Files lie in ascending doc_id order, each with
its number; the container is Parquet, so that Spark's commit protocol and readers apply.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import tokens, work

#: Bytes of the four ranks for each control byte (two bits each, lowest first).
SIZES = 1 + (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3)
ROW = "doc_id long, n_tokens int, control binary, data binary"
#: Of a file's share of the rows, the part by which the file may be larger or smaller.
SLACK = 8


def _lists(column: pa.Array, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each value begins (in units of ``width``)."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, (off - off[0]) // width


def _pieces(data: np.ndarray, begin: np.ndarray) -> pa.Array:
    """A binary column whose values are ``data[begin[i] : begin[i + 1]]``."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def code(ranks: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control and data bytes of lists of ranks, and where each list's begin."""
    n = np.diff(begin)
    size = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    groups = -(-n // 4)
    control_at = np.concatenate(([0], np.cumsum(groups)))
    slot = np.arange(len(ranks)) + np.repeat(control_at[:-1] * 4 - begin[:-1], n)
    bits = np.zeros(control_at[-1] * 4, np.uint8)
    bits[slot] = size - 1
    control = (bits.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(1, dtype=np.uint8)
    data_at = np.concatenate(([0], np.cumsum(size)))
    data = np.zeros(data_at[-1], np.uint8)
    for k in range(4):
        has = np.flatnonzero(size > k) if k else np.arange(len(ranks))
        if not len(has):
            break
        data[data_at[has] + k] = (ranks[has] >> np.uint32(8 * k)).astype(np.uint8)
    return control, control_at, data, data_at[begin]


def decode(control: np.ndarray, data: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Ranks of lists of ``n`` ranks each, from their control and data bytes."""
    groups = -(-n // 4)
    begin = np.cumsum(groups * 4) - groups * 4
    slot = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
    size = SIZES[control].ravel()[slot]
    at = np.cumsum(size) - size
    out = data[at].astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
    for k in range(1, 4):
        has = np.flatnonzero(size > k)
        if not len(has):
            break
        out[has] |= data[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _edges(rows: DataFrame, parts: int) -> np.ndarray:
    """Ascending doc_ids that cut ``rows`` into at most ``parts`` ranges of about as many rows; an edge begins a range."""
    if parts < 2:
        return np.zeros(0, np.int64)
    shares = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    found = rows.agg(F.percentile_approx("doc_id", shares, F.lit(SLACK * parts))).first()[0]
    return np.unique(np.array(found or [], np.int64))


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode ``docs`` (doc_id, text), and write ``path/ranks`` and ``path/ids`` in ascending doc_id order.

    Null text counts as empty (its end id alone). A null doc_id comes first; rows with the same doc_id
    follow each other, in order of their ids' bytes. No rows give files without rows.
    """
    vocabulary = tokens.tokenizer(tokenizer).get_vocab_size() + 1
    vocabulary = max(vocabulary, end_id + 1)
    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for rows, ids, begin in tokens.encoded(batches, tokenizer, "text"):
            own = np.arange(len(ids)) + np.repeat(np.arange(len(begin) - 1), np.diff(begin))
            out = np.full(len(ids) + len(begin) - 1, end_id, kind)
            out[own] = ids
            total += np.bincount(out, minlength=vocabulary)
            pieces = _pieces(out.view(np.uint8), (begin + np.arange(len(begin))) * kind().itemsize)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pieces, pa.nulls(len(rows), pa.binary())], names=["doc_id", "ids", "counts"])
        # a task's counts of ids are a row of their own, the only one with counts
        yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(1, pa.int64()), "ids": pa.array([b""]), "counts": pa.array([total.tobytes()])})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for counts in b.column("counts"):
                total += np.frombuffer(counts.as_py(), np.int64)
        yield pa.RecordBatch.from_pydict({"id": pa.array(np.flatnonzero(total), pa.int32()), "n": pa.array(total[total > 0])})

    spark = docs.sparkSession
    staged = work.written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, ids binary, counts binary"))
    counted = staged.select("counts").where("counts IS NOT NULL").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = counted.orderBy(F.desc("n"), "id").collect()  # as many as the vocabulary at most
    table = spark.createDataFrame([(k, r["id"], r["n"]) for k, r in enumerate(ranked)], "rank int, id int, n long")
    table.coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(vocabulary, np.uint32)
    rank_of[[r["id"] for r in ranked]] = np.arange(len(ranked))

    rows = staged.where("counts IS NULL").select("doc_id", "ids")
    files = work.slots(spark)
    edges = _edges(rows, files)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                b = batch.slice(i, 1024)
                ids, begin = _lists(b.column("ids"), kind().itemsize)
                control, control_at, data, data_at = code(rank_of[ids.view(kind)], begin)
                place = np.searchsorted(edges, b.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy(), side="right")
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_tokens": pa.array(np.diff(begin), pa.int32()), "control": _pieces(control, control_at), "data": _pieces(data, data_at), "place": pa.array(place, pa.int32())})

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, before = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column("n_tokens").to_numpy().astype(np.int64)
            at = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), file)), pa.array(at)], names=[*b.schema.names, "file", "before"])

    # the files' ranges are found on the doc_ids alone: a range shuffle would code all ids once more for its sample
    coded = rows.mapInArrow(pack, ROW + ", place int").repartitionById(files, "place").drop("place")
    ordered = coded.sortWithinPartitions("doc_id", "n_tokens", "data")
    ordered.mapInArrow(number, ROW + ", file long, before long").write.option("compression", "zstd").parquet(f"{path}/ids")


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Read files of ``write_ids``: doc_id, start, n_tokens and the ids (array), or their crc32 with ``digest``."""
    ranked = spark.read.parquet(f"{path}/ranks").collect()
    id_of = np.zeros(max(len(ranked), 1), np.uint32)
    id_of[[r["rank"] for r in ranked]] = [r["id"] for r in ranked]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                b = batch.slice(i, 1024)
                n = b.column("n_tokens").to_numpy().astype(np.int64)
                ids = id_of[decode(_lists(b.column("control"))[0], _lists(b.column("data"))[0], n)]
                edge = np.concatenate(([0], np.cumsum(n)))
                if digest:
                    raw = ids.astype("<u4").tobytes()
                    found = pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(edge.tolist(), edge[1:].tolist())], pa.int64())
                else:
                    found = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(n), found], names=["doc_id", "start", "n_tokens", last])

    last = "ids_crc32" if digest else "ids"
    files = spark.read.parquet(f"{path}/ids")
    total = files.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # one row a file: its window is the one place where all files meet, and no ids are shuffled to find theirs
    first = total.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("first"))
    rows = files.join(F.broadcast(first), "file").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "control", "data")
    return rows.mapInArrow(unpack, f"doc_id long, start long, n_tokens long, {last} " + ("long" if digest else "array<int>"))
