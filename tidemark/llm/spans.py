"""Words and pieces of many texts at once, on the UTF-8 bytes of an Arrow column.

A *chunk* is a run of whole texts of a few MB; a text longer than that is a chunk of its own. Null text
counts as empty. Arrays hold byte positions in the chunk, so nothing is done per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Chunk:
    """Texts ``first`` to ``first + len(off) - 2`` of a batch: their bytes, and where each text begins."""

    first: int
    data: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """Cut a string column into chunks of whole texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield Chunk(i, data[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """64-bit hash of each span of bytes (spans in ascending order); equal bytes give equal hashes."""
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + block, "right")))
        s, e = start[i:j] - start[i], end[i:j] - start[i]
        part = data[start[i] : end[j - 1]]
        power, inverse = _tables(len(part) + 1)
        total = np.zeros(len(part) + 1, U64)
        np.cumsum((part.astype(U64) + U64(1)) * power[: len(part)], out=total[1:])
        out[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
        i = j
    return out


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of bytes without ASCII white space."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def _wide_space_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each position is white space outside ASCII."""
    c, b, a = (data[np.maximum(at - k, 0)].astype(np.int32) for k in (1, 2, 3))
    two = (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
    e2 = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    return two | e2 | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))


def space_led(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of pieces that begin where white space follows another character.

    The pattern of the byte-level vocabularies always ends a match there (no alternative goes from a
    character that isn't white space to one that is), so each piece is encoded by itself.
    """
    space = SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[1:-1] = space[1:] & ~space[:-1]
    cut = np.flatnonzero(first)
    high = data[cut - 1] >= 0x80
    if high.any():
        cut = cut[high]
        first[cut[_wide_space_before(data, cut)]] = False
    first[off[:-1]] = True
    start = np.flatnonzero(first[:-1])
    end = np.append(start[1:], len(data))
    return start, end, np.searchsorted(off, start, "right") - 1


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray, long: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One span of each distinct one, the number of its distinct span for every span, and the distinct hashes.

    Spans are told apart by a 64-bit hash; one longer than ``long`` bytes always counts as distinct.
    """
    h = span_hash(data, start, end)
    far = np.flatnonzero(end - start > long)
    if len(far):
        h[far] = mix(h[far] + np.arange(1, len(far) + 1, dtype=U64))
    first, which = distinct_keys(h)
    return first, which, h[first]


def distinct_keys(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct value, and the number of its distinct value for every place."""
    order = np.argsort(h)
    step = np.empty(len(h), bool)
    step[:1] = True
    sorted_h = h[order]
    step[1:] = sorted_h[1:] != sorted_h[:-1]
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(step) - 1
    return order[step], which


LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def letter_runs(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of letters, each framed by a space: their bytes, and the run of each byte.

    Then the run and the text number of every occurrence. ASCII is lowered; bytes from 0x80 on count as letters.
    """
    data = np.where(LETTER[c.data], LOWER[c.data], 0x20).astype(np.uint8)
    start, end, doc = words(data, c.off)
    if not len(start):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), none, none, doc
    first, which, _ = distinct(data, start, end)
    size = (end - start)[first] + 2
    at = np.cumsum(size) - size
    framed = np.full(size.sum(), 0x20, np.uint8)
    body = np.ones(len(framed), bool)
    body[at] = body[at + size - 1] = False
    framed[body] = gather(data, start, end - start, first)
    return framed, np.repeat(np.arange(len(first)), size), which, doc


def gather(flat: np.ndarray, begin: np.ndarray, length: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Concatenate ``flat[begin[w] : begin[w] + length[w]]`` for every ``w`` of ``which``."""
    n = length[which]
    shift = np.repeat(begin[which] - (np.cumsum(n) - n), n)
    return flat[shift + np.arange(len(shift))]
