"""Token counts without ids: each distinct pre-token is counted once and joined to frequencies.

A block of texts becomes a sparse matrix: for each distinct pre-token the texts that hold it and how often.
The matrix is dealt out by the pre-token's hash. Where the pre-tokens of a range meet, each is counted
once by the library, multiplied with its frequencies, and only a partial sum per text of the block goes
on. A pre-token in many texts of its block is dealt out by block too, so that no range fills up with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import spans, tokens, work

MATRIX = "slot int, block long, texts int, pieces binary, sizes binary, holders binary, at binary, times binary, doc_ids binary, n_bytes binary, no_id binary"
PARTIAL = "block long, sums binary, doc_ids binary, n_bytes binary, no_id binary"
BLOCK_BYTES = 12 << 20


def _small(x: np.ndarray) -> bytes:
    """Unsigned integers in the least width that holds them, width first."""
    top = int(x.max()) if len(x) else 0
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _large(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


def frequencies(docs: DataFrame, tokenizer: str, slots: int) -> DataFrame:
    """Block matrices of pre-token frequencies, a row for each block and range of pre-tokens."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, block = tokens.splitter(tokenizer), TaskContext.get().partitionId() << 32
        for batch in batches:
            for c in spans.chunks(batch.column("text"), BLOCK_BYTES):
                block += 1
                start, end, doc = split(c.data, c.off)
                first, which, h = spans.distinct(c.data, start, end)
                pair, nth = spans.distinct_keys(which * len(c) + doc)
                times = np.bincount(nth, minlength=len(pair))
                piece, text = which[pair], doc[pair]
                holders = np.bincount(piece, minlength=len(first))
                often = holders * 64 > max(len(c), 64)
                salt = spans.mix(np.array([block], np.uint64))
                slot = (np.where(often, h + salt, h) % np.uint64(slots)).astype(np.int64)
                order = np.argsort(slot, kind="stable")
                place = np.empty(len(first), np.int64)
                place[order] = np.arange(len(first))
                entry = np.argsort(place[piece], kind="stable")
                cut = np.searchsorted(slot[order], np.arange(slots + 1))
                cut_entry = np.concatenate(([0], np.cumsum(holders[order])))[cut]
                raw, s, e = c.data.tobytes(), start[first][order], end[first][order]
                rows = []
                ids = batch.column("doc_id").slice(c.first, len(c))
                for k in range(slots):
                    home = k == block % slots
                    a, b = cut[k], cut[k + 1]
                    if a == b and not home:
                        continue
                    x = entry[cut_entry[k] : cut_entry[k + 1]]
                    rows.append({
                        "slot": k, "block": block, "texts": len(c),
                        "pieces": b"".join(raw[i:j] for i, j in zip(s[a:b].tolist(), e[a:b].tolist())),
                        "sizes": _small((e - s)[a:b]), "holders": _small(holders[order][a:b]), "at": _small(text[x]), "times": _small(times[x]),
                        "doc_ids": ids.fill_null(0).to_numpy().tobytes() if home else None,
                        "n_bytes": _small(np.diff(c.off)) if home else None,
                        "no_id": ids.is_null().to_numpy(zero_copy_only=False).tobytes() if home else None,
                    })
                yield pa.RecordBatch.from_pylist(rows, schema=_MATRIX_SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(deal, MATRIX)


_BINARY = ("pieces", "sizes", "holders", "at", "times", "doc_ids", "n_bytes", "no_id")
_MATRIX_SCHEMA = pa.schema([("slot", pa.int32()), ("block", pa.int64()), ("texts", pa.int32()), *((c, pa.binary()) for c in _BINARY)])


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs`` (doc_id, text).

    Null text counts as empty: 0 bytes, 0 tokens. Rows with a null or repeated doc_id stay rows of their
    own; no rows give no rows; further columns are not looked at.
    """
    slots = work.slots(docs.sparkSession)

    def count(table: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        out = []
        for r in table.to_pylist():
            size = _large(r["sizes"])
            edge = np.concatenate(([0], np.cumsum(size))).tolist()
            pieces = [r["pieces"][a:b] for a, b in zip(edge, edge[1:])]
            new = list(dict.fromkeys(p for p in pieces if p not in known))
            known.update(zip(new, (len(x) // 4 for x in tokens.encode_pieces(tokenizer, new))))
            n = np.fromiter((known[p] for p in pieces), np.int64, len(pieces))
            weight = np.repeat(n, _large(r["holders"])) * _large(r["times"])
            total = np.bincount(_large(r["at"]), weights=weight, minlength=r["texts"]).astype(np.int64)
            out.append({"block": r["block"], "sums": _small(total), "doc_ids": r["doc_ids"], "n_bytes": r["n_bytes"], "no_id": r["no_id"]})
        return pa.Table.from_pylist(out, schema=partial)

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        home = next(r for r in rows if r["doc_ids"] is not None)
        total = sum(_large(r["sums"]) for r in rows)
        ids = pa.array(np.frombuffer(home["doc_ids"], np.int64), mask=np.frombuffer(home["no_id"], bool))
        return pa.table({"doc_id": ids, "n_bytes": _large(home["n_bytes"]), "n_tokens": total, "over_limit": total > limit})

    partial = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("sums", "doc_ids", "n_bytes", "no_id"))])
    parts = frequencies(docs, tokenizer, slots).groupBy("slot").applyInArrow(count, PARTIAL)
    return parts.groupBy("block").applyInArrow(add, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
