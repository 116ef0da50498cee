"""Quality rules by distribution divergence.

Each language has two references, taken from all its texts that pass the base rules: how often the
character classes occur, and how often each of its common words does (mean of the texts' histograms, so
that long ones weigh no more). Common words are the ``COMMON`` most frequent slots of a table of fixed
size that words are hashed into. A text is compared with every language by Jensen-Shannon distance and
kept if some language is near enough in both; each test is made only on texts long enough for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import spans
from tidemark.llm.stats import CLASSES, text_stats

SLOTS = 1 << 14
COMMON = 64
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Limits:
    """Greatest distances, and the least length for each test."""

    class_distance: float = 0.28
    word_distance: float = 0.42
    least_chars: int = 150
    least_words: int = 100


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence (base 2) of the rows of ``p`` and of ``q``: 0 to 1."""
    m = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(-1)
    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    """Under 50 words, or more than half of them in repeated three-word windows."""
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def word_slots(c: spans.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Slot and text number of every lower-cased word without punctuation."""
    framed, run, which, doc = spans.letter_runs(c)
    if not len(which):
        return np.zeros(0, np.int64), doc
    end = np.flatnonzero(np.append(run[1:] != run[:-1], True)) + 1
    start = np.concatenate(([0], end[:-1]))
    slot = (spans.span_hash(framed, start, end) % np.uint64(SLOTS)).astype(np.int64)
    return slot[which], doc


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1)


@dataclass
class References:
    """Per language: shares of the character classes; common slots, and shares of them and of the rest."""

    classes: np.ndarray
    slots: np.ndarray
    words: np.ndarray


def learn(docs: DataFrame) -> References:
    """References of every language in ``docs`` (text, lang), from all texts that pass the base rules."""
    known = docs.where("lang IS NOT NULL")
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    number = {x: i for i, x in enumerate(languages)}
    width = len(CLASSES) + SLOTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), width))
        texts = np.zeros(len(languages))
        for b in batches:
            lang = np.array([number[x] for x in b.column("lang").to_pylist()], np.int64)
            for c in spans.chunks(b.column("text")):
                s = text_stats(c)
                good = ~base_failed(s)
                own = lang[c.first : c.first + len(c)]
                slot, doc = word_slots(c)
                weight = good / np.maximum(np.bincount(doc, minlength=len(c)), 1)
                share = _shares(s["classes"]) * good[:, None]
                for x in np.unique(own).tolist():
                    mine = own == x
                    texts[x] += good[mine].sum()
                    total[x, : len(CLASSES)] += share[mine].sum(axis=0)
                    at = mine[doc]
                    total[x, len(CLASSES) :] += np.bincount(slot[at], weights=weight[doc[at]], minlength=SLOTS)
        for x in range(len(languages)):
            at = np.flatnonzero(total[x])
            yield pa.RecordBatch.from_pydict({"lang": pa.array(np.full(len(at), x, np.int32)), "at": pa.array(at.astype(np.int32)), "n": pa.array(total[x][at])})

    rows = known.select("text", "lang").mapInArrow(count, "lang int, at int, n double").groupBy("lang", "at").agg(F.sum(F.col("n").cast("decimal(28,9)")).cast("double").alias("n")).toArrow()
    table = np.zeros((len(languages), width))
    table[rows["lang"].to_numpy(), rows["at"].to_numpy()] = rows["n"].to_numpy()
    words = table[:, len(CLASSES) :]
    slots = np.argsort(-words, axis=1, kind="stable")[:, :COMMON]
    common = np.take_along_axis(words, slots, axis=1)
    rest = words.sum(axis=1, keepdims=True) - common.sum(axis=1, keepdims=True)
    return References(_shares(table[:, : len(CLASSES)]), slots, _shares(np.concatenate([common, rest], axis=1)))


def distances(c: spans.Chunk, s: dict[str, np.ndarray], ref: References) -> tuple[np.ndarray, np.ndarray]:
    """Distance of every text from every language: of character classes, and of common words."""
    n, n_lang = len(c), len(ref.classes)
    by_class = js_distance(_shares(s["classes"])[:, None, :], ref.classes[None])
    slot, doc = word_slots(c)
    total = np.bincount(doc, minlength=n)
    by_word = np.zeros((n, n_lang))
    for x in range(n_lang):
        place = np.full(SLOTS, -1)
        place[ref.slots[x]] = np.arange(COMMON)
        at = place[slot]
        hit = at >= 0
        found = np.bincount(doc[hit] * COMMON + at[hit], minlength=n * COMMON).reshape(n, COMMON)
        share = np.concatenate([found, total[:, None] - found.sum(axis=1, keepdims=True)], axis=1) / np.maximum(total, 1)[:, None]
        by_word[:, x] = js_distance(share, ref.words[x])
    return by_class, by_word


def judge(docs: DataFrame, ref: References, limits: Limits = Limits(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` (text, ...), the base counts, and the verdict.

    Returns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance and
    word_distance (those of the language nearest in the greater of both; null without a reference), kept.
    A null text has no words and fails the base rules. Without references only the base rules decide.
    Clashing columns: those named here are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ref)
    names = [*BASE, "base_failed", "class_distance", "word_distance", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = {k: [np.zeros(0, bool if k in ("base_failed", "kept") else float if "distance" in k else np.int64)] for k in names}
            for c in spans.chunks(b.column("text")):
                s = text_stats(c)
                fails = base_failed(s)
                x, y = np.full(len(c), np.nan), np.full(len(c), np.nan)
                ok = ~fails
                if len(shared.value.classes):
                    by_class, by_word = distances(c, s, shared.value)
                    by_class = np.where((s["word_chars"] >= limits.least_chars)[:, None], by_class, 0)
                    by_word = np.where((s["n_words"] >= limits.least_words)[:, None], by_word, 0)
                    worst = np.maximum(by_class / limits.class_distance, by_word / limits.word_distance)
                    near = worst.argmin(axis=1)
                    at = np.arange(len(c))
                    x, y, ok = by_class[at, near], by_word[at, near], ok & (worst[at, near] <= 1)
                for k, v in zip(names, [*[s[k].astype(np.int64) for k in BASE], fails, x, y, ok]):
                    parts[k].append(v)
            cols = {k: b.column(k) for k in keep} | {k: pa.array(np.concatenate(v), from_pandas=True) for k, v in parts.items()}
            yield pa.RecordBatch.from_pydict(cols)

    keep = tuple(k for k in keep if k not in names)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    kind = lambda k: "boolean" if k in ("base_failed", "kept") else "double" if "distance" in k else "long"
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + [f"{k} {kind(k)}" for k in names])
    return docs.select("text", *[k for k in keep if k != "text"]).mapInArrow(run, schema)
