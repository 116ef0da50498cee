"""Byte-level BPE as a reduction over a tree of halves.

Encoded texts form a monoid: two neighbours are joined by encoding a window around their seam anew. The
window grows on each side until it reaches a *stable* place, one where the pattern ends a match whatever
stands elsewhere: after a letter before another kind of character, after a digit before another kind, and
after any character that isn't white space before one that is (no alternative of the pattern goes on from
there). Matches are encoded separately, so the tokens outside two stable places cannot change.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STABLE = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\S)(?=\s)")
LEAF = 2048
WINDOW = 16
_loaded: dict[tuple, "Codec"] = {}


class Codec:
    """Vocabulary of a rank file with its pattern; leaves are encoded by the tiktoken library."""

    def __init__(self, ranks_path: str, pattern: str, leaf: int = LEAF):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.leaf = leaf
        self.encode_leaf: Callable[[str], list[int]] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.token = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.token[rank] = piece
        self.size = [len(t) for t in self.token]
        self.decimal = [b"%d" % i for i in range(len(self.token))]

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``: halves are encoded for themselves and joined."""
        if len(text) <= self.leaf:
            return self.encode_leaf(text)
        middle = len(text) // 2
        left, right = text[:middle], text[middle:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def join(self, left: str, a: list[int], right: str, b: list[int]) -> list[int]:
        """Ids of ``left + right`` from the ids of both."""
        if not left or not right:
            return a or b
        i, j = self._before(left), self._after(right)
        # stable places end matches, so tokens end there too: drop whole tokens of the window's bytes
        keep, drop = len(a), len(left[i:].encode())
        while drop > 0:
            keep -= 1
            drop -= self.size[a[keep]]
        skip, over = 0, len(right[:j].encode())
        while over > 0:
            over -= self.size[b[skip]]
            skip += 1
        return a[:keep] + self.encode_leaf(left[i:] + right[:j]) + b[skip:]

    @staticmethod
    def _before(text: str) -> int:
        """The last stable place of a growing window at the end of ``text``, or its beginning."""
        window = WINDOW
        while window < len(text):
            found = [m.start() for m in STABLE.finditer(text, len(text) - window)]
            if found:
                return found[-1]
            window *= 2
        return 0

    @staticmethod
    def _after(text: str) -> int:
        """The first stable place in ``text``, looked for in a growing window, or its end."""
        window = WINDOW
        while window < len(text):
            m = STABLE.search(text, 1, window)
            if m:
                return m.start()
            window *= 2
        return len(text)

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ``ids``: those of both halves, concatenated up the tree."""
        if len(ids) <= self.leaf:
            return b"".join(map(self.token.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def codec(ranks_path: str, pattern: str, leaf: int = LEAF) -> Codec:
    """The codec, loaded once in each Python process."""
    key = (ranks_path, pattern, leaf)
    if key not in _loaded:
        _loaded[key] = Codec(*key)
    return _loaded[key]


def _rows(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[pa.RecordBatch]:
    """Small slices, so that few texts are Python objects at a time."""
    for b in batches:
        for i in range(0, b.num_rows, size):
            yield b.slice(i, size)


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """doc_id and ids (array) of every row of ``docs`` (doc_id, text); null text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(ranks_path, pattern, leaf)
        for b in _rows(batches):
            ids = [made.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """doc_id and bytes (binary) of every row of ``encoded`` (doc_id, ids); null ids are no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(ranks_path, pattern, leaf)
        for b in _rows(batches):
            raw = [made.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "bytes": pa.array(raw, pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """Encode every text, decode its ids, and return digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text counts as empty; rows with null or repeated doc_id stay rows of their own; no rows give no
    rows; further columns are not looked at. One text is one row of work, whatever its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(ranks_path, pattern, leaf)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in _rows(batches):
            n, ids_sha, raw_sha = [], [], []
            for t in b.column("text").to_pylist():
                ids = made.encode(t or "")
                n.append(len(ids))
                ids_sha.append(sha(b" ".join(map(made.decimal.__getitem__, ids))))
                raw_sha.append(sha(made.decode(ids)))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(raw_sha, pa.string())})

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
