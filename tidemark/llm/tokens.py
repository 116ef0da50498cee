"""Token ids of whole texts: each distinct piece of a chunk is encoded once by the tokenizer's library."""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex

from tidemark.llm import memory as worker_memory
from tidemark.llm import spans

#: Pieces, and pre-tokens in them, that a Python worker remembers; when full, further ones are encoded anew.
REMEMBERED = 250_000
REMEMBERED_PARTS = 150_000
#: The same for pre-tokens of a byte-level vocabulary, whose pieces are more various.
REMEMBERED_BYTE_PARTS = 400_000
#: Bytes of a chunk: the larger, the fewer pieces come up in several chunks.
CHUNK = 6 << 20
_known = worker_memory.remembered
_loaded: dict[str, object] = {}

# The pre-token patterns of the two vocabularies, and the characters that stand for bytes.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(SHOWN))}
#: Below this character every Unicode version agrees on classes, and composing changes nothing.
PLAIN = "\u0250"
#: Characters that end a match of letters and are one by themselves at a piece's end.
CLOSING = (".", ",")


def tokenizer(path: str):
    """The tokenizer of a ``.json`` file, loaded once in each Python process, on one thread."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _loaded[path] = made
    return _loaded[path]


def is_word_vocabulary(path: str) -> bool:
    """Whether the vocabulary marks word ends and drops white space (else it is byte-level)."""
    return os.path.basename(path).startswith("word_")


def encode_pieces(path: str, pieces: list[bytes]) -> list[bytes]:
    """Ids of each piece as little-endian 32-bit integers.

    Latin pieces go pre-token by pre-token to the library's model, each distinct pre-token once;
    the rest (other scripts, special strings) goes whole to the library.
    """
    tk, word = tokenizer(path), is_word_vocabulary(path)
    most = REMEMBERED_PARTS if word else REMEMBERED_BYTE_PARTS
    model, memory = tk.model.tokenize, _known.setdefault((path, "pre-tokens"), {})
    find = regex.compile(WORD_PATTERN if word else BYTE_PATTERN).findall
    out: list[bytes | None] = []
    rest: list[str] = []
    for piece in pieces:
        text = piece.decode("utf-8", "replace")
        if "<|" in text or not (text.isascii() or max(text) < PLAIN):
            out.append(None)
            rest.append(text)
            continue
        if word:
            text = text.lower()
        letters = text[1:] if text[:1] == " " else text
        if letters.isalpha():
            parts = (text,)
        elif letters[-1:] in CLOSING and letters[:-1].isalpha():
            parts = (text[:-1], text[-1])
        else:
            parts = find(text)
        ids = b""
        for token in parts:
            found = memory.get(token)
            if found is None:
                shown = token if token.isascii() and token.isalnum() else token.encode().decode("latin-1").translate(BYTE_CHARS)
                found = array("I", [t.id for t in model(shown)]).tobytes()
                if len(memory) < most and len(token) <= 64:
                    memory[token] = found
            ids += found
        out.append(ids)
    if rest:
        done = iter(tk.encode_batch_fast(rest, add_special_tokens=False))
        out = [np.array(next(done).ids, "<u4").tobytes() if x is None else x for x in out]
    return out


def splitter(path: str) -> Callable:
    """How texts fall into pieces that the tokenizer encodes one by one."""
    return spans.words if is_word_vocabulary(path) else spans.space_led


class Encoder:
    """Encodes chunks of texts; pieces met before are taken from a bounded memory."""

    def __init__(self, path: str):
        self.path, self.split = path, splitter(path)
        self.known = _known.setdefault((path,), {})

    def chunk(self, c: spans.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk's texts, and where each text's ids begin (one more entry at the end)."""
        start, end, doc = self.split(c.data, c.off)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(c) + 1, np.int64)
        first, which, _ = spans.distinct(c.data, start, end)
        raw = c.data.tobytes()
        pieces = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())]
        found = list(map(self.known.get, pieces))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            new = [pieces[i] for i in missing]
            for i, piece, ids in zip(missing, new, encode_pieces(self.path, new)):
                found[i] = ids
                if len(self.known) < REMEMBERED and len(piece) <= 64:
                    self.known[piece] = ids
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        ids = spans.gather(flat, np.cumsum(length) - length, length, which)
        count = np.bincount(doc, weights=length[which], minlength=len(c)).astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(count)))


def encoded(batches: Iterator[pa.RecordBatch], path: str, text_col: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Chunk by chunk: the rows, all their ids, and where each row's ids begin."""
    encoder = Encoder(path)
    for batch in batches:
        for c in spans.chunks(batch.column(text_col), CHUNK):
            ids, begin = encoder.chunk(c)
            yield batch.slice(c.first, len(c)), ids, begin
