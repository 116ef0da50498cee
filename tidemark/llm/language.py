"""Language identification by n-gram filters that answer for all languages at once.

A filter is a Bloom filter sliced by bits: each place of its ``HASHES`` tables holds a mask with a bit for
every language, so one lookup per table and an AND give all languages that contain an n-gram. Learning
counts n-grams at those places for each language, in tables of fixed size; a language's bit is set where
its rate is at least ``SHARE`` of the highest rate that any language has there. A text's n-grams are looked
up, hits are counted for each language (bits of the masks), the hits that the filter's filling would give
any n-gram by chance are taken off, and the language with the most is chosen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import memory, spans

U64 = np.uint64
#: n-gram lengths in bytes (words are framed by one space), hash tables, places of a table.
LENGTHS = (3, 4, 5)
HASHES = 2
PLACES = 1 << 18
#: A bit is set from this share of the highest rate of any language, and from this rate in the language.
SHARE = 0.2
LEAST_RATE = 2e-7
UNKNOWN = "und"

def no_letters(texts: pa.Array, suspects: np.ndarray) -> np.ndarray:
    """Which of the texts at ``suspects`` hold no letter at all."""
    return np.array([not any(ch.isalpha() for ch in texts[int(i)].as_py() or "") for i in suspects], bool)


def grams(c: spans.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct letter runs' n-grams: hashes and their run; then the run and text of each occurrence."""
    framed, run, which, doc = spans.letter_runs(c)
    values, owners = [], []
    for n in LENGTHS:
        m = max(len(framed) - n + 1, 0)
        key = np.full(m, n, U64)
        for k in range(n):
            key = key << U64(8) | framed[k : k + m]
        whole = run[:m] == run[n - 1 :][:m]
        values.append(spans.mix(key[whole]))
        owners.append(run[:m][whole])
    return np.concatenate(values), np.concatenate(owners), which, doc


def places(h: np.ndarray, k: int) -> np.ndarray:
    """Place of each n-gram in table ``k``."""
    return ((h >> U64(24 * k)) & U64(PLACES - 1)).astype(np.int64)


@dataclass
class Filters:
    """The languages, their mask at each place of each table, and each language's filling."""

    languages: list[str]
    masks: np.ndarray  # HASHES x PLACES x words of 64 languages

    def chance(self) -> np.ndarray:
        """How likely an n-gram of no language hits each language's filter."""
        filled = self.bits(self.masks).mean(axis=1)
        return filled.prod(axis=0)

    def bits(self, masks: np.ndarray) -> np.ndarray:
        """The masks as one boolean per language."""
        shift = np.arange(len(self.languages))
        return (masks[..., shift // 64] >> (shift % 64).astype(U64) & U64(1)).astype(bool)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Masks of all languages that contain each n-gram."""
        out = self.masks[0][places(h, 0)]
        for k in range(1, HASHES):
            out = out & self.masks[k][places(h, k)]
        return out


def learn(docs: DataFrame) -> Filters:
    """Filters of the languages in ``docs`` (text, lang); rows without a language are left out.

    All rows count. What is gathered is tables of ``HASHES`` x ``PLACES`` counts for each language.
    """
    known = docs.where("lang IS NOT NULL")
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), HASHES * PLACES), np.float64)
        for b in batches:
            lang = np.array([number[x] for x in b.column("lang").to_pylist()], np.int64)
            for c in spans.chunks(b.column("text")):
                h, run, which, doc = grams(c)
                at = [places(h, k) + k * PLACES for k in range(HASHES)]
                own = lang[c.first : c.first + len(c)][doc]
                for x in np.unique(own).tolist():
                    weight = np.bincount(which[own == x], minlength=run.max() + 1 if len(run) else 0)[run]
                    for p in at:
                        total[x] += np.bincount(p, weights=weight, minlength=HASHES * PLACES)
        for x in range(len(languages)):
            held = np.flatnonzero(total[x])
            for i in range(0, len(held), 1 << 16):
                part = held[i : i + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"lang": pa.array(np.full(len(part), x, np.int32)), "at": pa.array(part.astype(np.int32)), "n": pa.array(total[x][part].astype(np.int64))})

    rows = known.select("text", "lang").mapInArrow(memory.tidy(count), "lang int, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((len(languages), HASHES * PLACES))
    table[rows["lang"].to_numpy(), rows["at"].to_numpy()] = rows["n"].to_numpy()
    rate = table * HASHES / np.maximum(table.sum(axis=1, keepdims=True), 1)
    top = rate.max(axis=0, initial=0)
    on = (rate >= np.maximum(SHARE * top, LEAST_RATE)) & (table > 0)
    masks = np.zeros((HASHES * PLACES, -(-max(len(languages), 1) // 64)), U64)
    for x in range(len(languages)):
        masks[on[x], x // 64] |= U64(1) << U64(x % 64)
    return Filters(languages, masks.reshape(HASHES, PLACES, -1))


def predict(docs: DataFrame, filters: Filters, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` (text, ...), with lang_pred and score.

    The score is the chosen language's share of all corrected hits, weighted by the share of n-grams it
    holds. A null text or one without letters is ``und`` with score 0, and so is any text if no language
    was learned. Ties go to the language that comes first. A text none of whose n-grams is known gets
    the first language with score 0. Clashing columns: lang_pred and score are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Filters = shared.value
        n_lang = len(f.languages)
        chance = f.chance() if n_lang else np.zeros(0)
        names = np.array([*f.languages, UNKNOWN])
        for b in batches:
            pred, score = [], []
            for c in spans.chunks(b.column("text")):
                h, run_of, which, doc = grams(c)
                total = np.zeros(len(c))
                hits = np.zeros((len(c), n_lang))
                if len(h):
                    runs = run_of.max() + 1
                    held = f.bits(f.lookup(h))
                    per_run = np.bincount(run_of, minlength=runs)
                    total = np.bincount(doc, weights=per_run[which], minlength=len(c))
                    for x in range(n_lang):
                        of_run = np.bincount(run_of, weights=held[:, x], minlength=runs)
                        hits[:, x] = np.bincount(doc, weights=of_run[which], minlength=len(c))
                corrected = np.maximum(hits - total[:, None] * chance, 0) / np.maximum(1 - chance, 1e-9)
                best = corrected.argmax(axis=1) if n_lang else np.zeros(len(c), np.int64)
                top = corrected[np.arange(len(c)), best] if n_lang else np.zeros(len(c))
                part = top / np.maximum(corrected.sum(axis=1), 1e-9) * np.minimum(1, top / np.maximum(total, 1))
                ascii_letter = np.zeros(len(c), bool)
                has = spans.LETTER[c.data] & (c.data < 128)
                ascii_letter[np.searchsorted(c.off, np.flatnonzero(has), "right") - 1] = True
                suspects = np.flatnonzero(~ascii_letter)
                none = np.zeros(len(c), bool)
                none[suspects] = no_letters(b.column("text").slice(c.first, len(c)), suspects)
                best = np.where(none, n_lang, best)
                pred.append(names[best])
                score.append(np.where(none | (n_lang == 0), 0.0, np.clip(part, 0, 1)))
            cols = {k: b.column(k) for k in keep}
            cols["lang_pred"] = pa.array(np.concatenate(pred) if pred else [], pa.string())
            cols["score"] = pa.array(np.concatenate(score) if score else [], pa.float64())
            yield pa.RecordBatch.from_pydict(cols)

    keep = tuple(k for k in keep if k not in ("lang_pred", "score"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["lang_pred string", "score double"])
    return docs.select("text", *[k for k in keep if k != "text"]).mapInArrow(memory.tidy(run), schema)
