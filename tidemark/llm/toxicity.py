"""Toxicity by class-conditional Kneser-Ney models.

Two models of the letters in words, one of toxic and one of ordinary texts, are interpolated with the same
lower orders: continuation counts of both classes together. A rare expression that one class alone has
seen thus falls back on what both share, and says little; an expression that a class has seen often says
much. A word's two log-likelihoods are compared per letter; a text's score is a logistic function of its
mean over all words, its highest word, how far its words stand out, and how many words it had the chance
to do so in, fitted on a fold of its own.

Counts cover all labelled rows given, so they grow with the input. The scorer holds every counted expression
and context, in tables as long as there are distinct ones (12 bytes each).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import id_filter, memory, spans, work

ORDER = 6
DISCOUNT = 0.75
#: A word stands out by what its log-ratio exceeds this.
MARGIN = 3.0
#: At most so many labelled rows fit the weights of the logistic function.
FIT_ROWS = 20_000


def grams(framed: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each letter with the ``ORDER - 1`` bytes before it in its run (0 before the run), and its run."""
    key = np.zeros(len(framed), np.int64)
    for k in range(ORDER - 1, -1, -1):
        byte = np.zeros(len(framed), np.int64)
        byte[k:] = np.where(run[k:] == run[: len(run) - k], framed[: len(framed) - k], 0)
        key = key << 8 | byte
    after = np.zeros(len(framed), bool)
    after[1:] = run[1:] == run[:-1]  # the space before a run is given, not predicted
    return key[after], run[after]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """key, toxic and ordinary occurrences (c1, c0) in all of ``labelled`` (text, label 0 or 1)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column("label").to_numpy()
            for c in spans.chunks(b.column("text"), 4 * spans.CHUNK):
                framed, run, which, doc = spans.letter_runs(c)
                key, owner = grams(framed, run)
                one, of = spans.distinct_keys(key)
                bad = label[c.first + doc] == 1
                n = run.max(initial=-1) + 1
                cols = {"key": pa.array(key[one])}
                for name, part in (("c0", ~bad), ("c1", bad)):
                    weight = np.bincount(which[part], minlength=n)
                    cols[name] = pa.array(np.bincount(of, weights=weight[owner], minlength=len(one)).astype(np.int64))
                yield pa.RecordBatch.from_pydict(cols)

    rows = labelled.select("text", F.col("label").cast("int")).mapInArrow(memory.tidy(count), "key long, c0 long, c1 long")
    return rows.groupBy("key").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def shared_probability(keys: DataFrame) -> DataFrame:
    """s and p: the shared model's probability of the last byte of every suffix of ``ORDER - 1`` bytes."""
    types, orders = keys.select("key"), []
    for m in range(ORDER - 1, 0, -1):
        # how many different bytes stand before each suffix, over both classes
        types = types.groupBy(F.col("key").bitwiseAND((1 << 8 * m) - 1).alias("key")).agg(F.count("*").alias("n"))
        orders.append(types)
        types = types.select("key", "n")
    low = None
    for m, level in enumerate(reversed(orders), 1):
        level = level.withColumn("ctx", F.shiftright("key", 8))
        total = level.groupBy("ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        level = level.join(total, "ctx")
        if low is None:
            base = level.withColumn("below", F.lit(1 / 256))
        else:
            base = level.withColumn("s", F.col("key").bitwiseAND((1 << 8 * (m - 1)) - 1)).join(low.withColumnRenamed("p", "below"), "s").drop("s")
        p = (F.col("n") - DISCOUNT + DISCOUNT * F.col("kinds") * F.col("below")) / F.col("total")
        low = base.select(F.col("key").alias("s"), p.alias("p"))
    return low


@dataclass
class Model:
    """Log-ratios (toxic to ordinary) of known expressions, and of contexts' backoff weights; keys ascend."""

    ratio_key: np.ndarray
    ratio: np.ndarray
    backoff_key: np.ndarray
    backoff: np.ndarray
    weights: np.ndarray | None = None

    def of(self, key: np.ndarray) -> np.ndarray:
        """Log-ratio of each letter given the bytes before it."""
        one, which = np.unique(key, return_inverse=True)
        known, ratio = _looked_up(self.ratio_key, self.ratio, one)
        return np.where(known, ratio, _looked_up(self.backoff_key, self.backoff, one >> 8)[1])[which]


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of ``wanted`` is among ``keys`` (ascending), and its value or 0."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.float32)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    known = keys[at] == wanted
    return known, np.where(known, values[at], np.float32(0))


def _table(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All ``rows`` (key, value), keys ascending."""
    got = rows.select("key", "value").toArrow()
    key, value = got["key"].to_numpy(), got["value"].to_numpy()
    order = np.argsort(key)
    return key[order], value[order]


def learn_counts(labelled: DataFrame) -> Model:
    """The two models' log-ratios from all rows of ``labelled`` (text, label)."""
    counts = work.written(gram_counts(labelled).withColumn("ctx", F.shiftright("key", 8)))
    ctx = work.written(counts.groupBy("ctx").agg(*[F.sum(f"c{k}").alias(f"t{k}") for k in (0, 1)], *[F.count_if(F.col(f"c{k}") > 0).alias(f"kinds{k}") for k in (0, 1)]))
    weight = lambda k: F.when(F.col(f"t{k}") > 0, DISCOUNT * F.col(f"kinds{k}") / F.col(f"t{k}")).otherwise(1.0)
    shared = shared_probability(counts)
    both = counts.withColumn("s", F.col("key").bitwiseAND((1 << 8 * (ORDER - 1)) - 1)).join(shared, "s").join(ctx, "ctx")
    p = lambda k: F.when(F.col(f"t{k}") > 0, F.greatest(F.col(f"c{k}") - DISCOUNT, F.lit(0.0)) / F.col(f"t{k}")).otherwise(0.0) + weight(k) * F.col("p")
    seen = both.select("key", F.log(p(1) / p(0)).cast("float").alias("value"))
    falls = ctx.select(F.col("ctx").alias("key"), F.log(weight(1) / weight(0)).cast("float").alias("value"))
    return Model(*_table(seen), *_table(falls))


def evidence(docs: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and x1 to x4 of every text: mean log-ratio per letter, highest word's, words' excess, and length."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_evidence(c, shared.value) for c in spans.chunks(b.column("text"))]
            x = np.concatenate(found) if found else np.zeros((0, 4))
            yield pa.RecordBatch.from_pydict({k: b.column(k) for k in keep} | {f"x{i + 1}": pa.array(x[:, i]) for i in range(4)})

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + [f"x{i} double" for i in (1, 2, 3, 4)])
    return docs.select("text", *[k for k in keep if k != "text"]).mapInArrow(memory.tidy(run), schema)


def _evidence(c: spans.Chunk, model: Model) -> np.ndarray:
    framed, run, which, doc = spans.letter_runs(c)
    out = np.zeros((len(c), 4))
    if not len(which):
        return out
    key, owner = grams(framed, run)
    n = run.max() + 1
    ratio = np.bincount(owner, weights=model.of(key), minlength=n)
    letters = np.bincount(owner, minlength=n)
    held = np.flatnonzero(np.bincount(doc, minlength=len(c)))
    begin = np.searchsorted(doc, held)
    per_word = ratio[which]
    out[held, 0] = np.add.reduceat(per_word, begin) / np.add.reduceat(letters[which], begin)
    out[held, 1] = np.maximum.reduceat(per_word, begin)
    out[held, 3] = np.log1p(np.bincount(doc, minlength=len(c))[held])
    out[held, 2] = np.log1p(np.add.reduceat(np.maximum(per_word - MARGIN, 0), begin))
    return out


def _design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.clip(x[:, 0], -5, 5), np.clip(x[:, 1], -5, 15), np.clip(x[:, 2], 0, 10), x[:, 3]])


def _logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_design(x) @ w, -35, 35)))


def _score(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The logistic function where there are words, else 0."""
    return np.where(x[:, 3] > 0, _logistic(x, w), 0.0)


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of the logistic function by Newton steps, with a ridge; without rows, a score of about 0."""
    a, w = _design(x), np.array([-8.0, 0, 0, 0, 0])
    if not len(y):
        return w
    w = np.zeros(5)
    for _ in range(50):
        p = _logistic(x, w)
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(5), a.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_texts(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """doc_id, text and label of the rows of ``docs`` with a label; of repeated labels the highest."""
    marks = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    return id_filter.held(texts, id_filter.marked(marks.select(F.col("doc_id").cast("long")))).join(marks, "doc_id")


def learn(count_rows: DataFrame, fit_rows: DataFrame) -> Model:
    """A model from two disjoint sets of (doc_id, text, label): one is counted, the other fits the weights."""
    model = learn_counts(count_rows)
    chosen = fit_rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    some = fit_rows.join(F.broadcast(chosen), "doc_id", "left_semi")  # FIT_ROWS ids at most
    rows = evidence(some, model, ("label",)).toArrow()
    x = np.column_stack([rows[f"x{i}"].to_numpy() for i in (1, 2, 3, 4)]) if rows.num_rows else np.zeros((0, 4))
    model.weights = fit_weights(x, rows["label"].to_numpy() if rows.num_rows else np.zeros(0))
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` (text, ...), with score and predicted.

    A null text, or one without letters, has no evidence against it and scores 0. Without labelled rows
    every score is near 0. Clashing columns: score and predicted are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_score(_evidence(c, shared.value), shared.value.weights) for c in spans.chunks(b.column("text"))]
            p = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_pydict({k: b.column(k) for k in keep} | {"score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32))})

    keep = tuple(k for k in keep if k not in ("score", "predicted"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["score double", "predicted int"])
    return docs.select("text", *[k for k in keep if k != "text"]).mapInArrow(memory.tidy(run), schema)
