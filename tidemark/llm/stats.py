"""Counts of whole texts, for all texts of a chunk at once."""

from __future__ import annotations

import numpy as np

from tidemark.llm import spans

U64 = np.uint64
#: Character classes, by byte: small letters, capitals, digits, white space, punctuation of prose,
#: exclamation marks, symbols, and bytes of characters outside ASCII.
CLASSES = ("small", "capital", "digit", "space", "prose", "shout", "symbol", "wide")
CLASS = np.full(256, 6, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 0, 1, 2, 7
CLASS[spans.SPACE] = 3
CLASS[[ord(x) for x in ".,;:'\"()-?"]] = 4
CLASS[ord("!")] = 5
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(x) for x in "#*$%&|<>"]] = True


def _per_text(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask)))
    return total[off[1:]] - total[off[:-1]]


def _salted(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that also tell texts apart."""
    return spans.mix(h + doc.astype(U64) * U64(0x9E3779B97F4A7C15))


def text_stats(c: spans.Chunk) -> dict[str, np.ndarray]:
    """For each text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_distinct_words, classes."""
    n, data = len(c), c.data
    start, end, doc = spans.words(data, c.off)
    word = spans.span_hash(data, start, end)
    out = {"n_words": np.bincount(doc, minlength=n)}
    out["word_chars"] = _per_text(~spans.SPACE[data] & ((data & 0xC0) != 0x80), c.off)
    out["n_symbols"] = _per_text(SYMBOL[data], c.off)

    # lines that hold a word, told apart by all their bytes
    newline = np.flatnonzero(data == 10)
    line_start = np.union1d(c.off[:-1][np.diff(c.off) > 0], newline + 1)
    line_start = line_start[line_start < len(data)]
    line_doc = np.searchsorted(c.off, line_start, "right") - 1
    next_newline = np.append(newline, len(data))[np.searchsorted(newline, line_start)]
    line_end = np.minimum(next_newline, c.off[line_doc + 1])
    filled = np.concatenate(([0], np.cumsum(~spans.SPACE[data])))
    held = filled[line_end] > filled[line_start]
    line_start, line_end, line_doc = line_start[held], line_end[held], line_doc[held]
    first, _ = spans.distinct_keys(_salted(spans.span_hash(data, line_start, line_end), line_doc))
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_doc[first], minlength=n)

    first, _ = spans.distinct_keys(_salted(word, doc))
    out["n_distinct_words"] = np.bincount(doc[first], minlength=n)
    m = max(len(word) - 2, 0)
    whole = doc[:m] == doc[2:]
    at = np.flatnonzero(whole)
    key = _salted(((word[at] * U64(0xC2B2AE3D27D4EB4F)) + word[at + 1]) * U64(0x165667B19E3779F9) + word[at + 2], doc[at])
    _, which = spans.distinct_keys(key)
    again = at[np.bincount(which)[which] > 1] if len(at) else at
    covered = np.zeros(len(word), bool)
    for k in range(3):
        covered[again + k] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)

    text = np.repeat(np.arange(n), np.diff(c.off))
    out["classes"] = np.bincount(text * len(CLASSES) + CLASS[data], minlength=n * len(CLASSES)).reshape(n, -1)
    return out
