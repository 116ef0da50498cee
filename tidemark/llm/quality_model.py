"""Quality by histogram gradient-boosted trees over document statistics.

Statistics are binned by their quantiles, each tree splits on histograms of gradients, and all trees are
flattened into arrays that whole columns of texts walk through together.
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

#: At most so many labelled rows are fitted to, chosen by the hash of their doc_id.
FIT_ROWS = 20_000
FEATURES = ("words", "word_length", *(f"share_{c}" for c in CLASSES), "symbols", "dup_lines", "repeats", "distinct", "words_a_line")


def features(c: spans.Chunk) -> np.ndarray:
    """A row of statistics for each text, in the order of ``FEATURES``."""
    s = text_stats(c)
    words, lines = np.maximum(s["n_words"], 1), np.maximum(s["n_lines"], 1)
    size = np.maximum(np.diff(c.off), 1)[:, None]
    rest = [s["n_symbols"] / words, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["n_distinct_words"] / words, s["n_words"] / lines]
    return np.column_stack([np.log1p(s["n_words"]), s["word_chars"] / words, s["classes"] / size, *rest])


@dataclass
class Forest:
    """Trees of equal depth: a feature and threshold for each inner node, a value for each leaf."""

    start: float
    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # trees x 2**depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: every row walks each tree from level to level."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.1, ridge: float = 1.0, least: int = 10) -> Forest:
    """Boost ``trees`` trees on log-loss; without rows, or with one label, the forest is its start."""
    n = len(y)
    p0 = (y.sum() + 1) / (n + 2)
    start, inner = float(np.log(p0 / (1 - p0))), 2**depth - 1
    if n == 0 or y.min() == y.max():
        return Forest(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)])
    width = bins + 1
    flat = binned + np.arange(x.shape[1]) * width
    margin = np.full(n, start)
    feature, threshold, value = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first = 2**level - 1
            for k in range(first, 2 * first + 1):
                at = np.flatnonzero(node == k)
                if len(at) >= 2 * least:
                    keys, rep = flat[at].ravel(), x.shape[1]
                    sums = [np.bincount(keys, weights=w, minlength=rep * width).reshape(rep, width).cumsum(axis=1) for w in (np.repeat(g[at], rep), np.repeat(h[at], rep), np.ones(len(keys)))]
                    left, all_ = [s[:, :-1] for s in sums], [s[:, -1:] for s in sums]
                    right = [a - b for a, b in zip(all_, left)]
                    gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - all_[0] ** 2 / (all_[1] + ridge)
                    gain[(left[2] < least) | (right[2] < least)] = -1
                    j, b = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[j, b] > 1e-9 and b < len(edges[j]):
                        f[k], t[k] = j, edges[j][b]
                node[at] = 2 * k + 1 + (x[at, f[k]] > t[k])
        leaf = node - inner
        v = rate * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + ridge)
        margin += v[leaf]
        feature.append(f), threshold.append(t), value.append(v)
    return Forest(start, np.array(feature), np.array(threshold), np.array(value))


def _columns(batches: Iterator[pa.RecordBatch], keep: tuple[str, ...], make) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [features(c) for c in spans.chunks(b.column("text"))]
        x = np.concatenate(found) if found else np.zeros((0, len(FEATURES)))
        yield pa.RecordBatch.from_pydict({k: b.column(k) for k in keep} | make(x))


def learn(docs: DataFrame, labels: DataFrame, column: str) -> Forest:
    """Fit to the rows of ``docs`` with a label in ``labels`` (doc_id, column); of repeated labels the highest."""
    marks = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    some = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "label")  # FIT_ROWS rows at most
    schema = "label int, " + ", ".join(f"{f} double" for f in FEATURES)
    made = rows.mapInArrow(lambda it: _columns(it, ("label",), lambda x: {f: pa.array(x[:, j]) for j, f in enumerate(FEATURES)}), schema).toArrow()
    # in a fixed order, so that sums do not depend on how rows were dealt out
    x = np.column_stack([made[f].to_numpy() for f in FEATURES]) if made.num_rows else np.zeros((0, len(FEATURES)))
    y = made["label"].to_numpy().astype(float) if made.num_rows else np.zeros(0)
    order = np.lexsort([y, *x.T]) if len(y) else slice(None)
    return fit(x[order], y[order])


def score(docs: DataFrame, forest: Forest, threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` (text, ...), with score and predicted.

    A null or empty text is scored by statistics that are all 0. Clashing columns: score and predicted are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def made(x: np.ndarray) -> dict:
        p = shared.value.score(x)
        return {"score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32))}

    keep = tuple(k for k in keep if k not in ("score", "predicted"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["score double", "predicted int"])
    return docs.select("text", *[k for k in keep if k != "text"]).mapInArrow(lambda it: _columns(it, keep, made), schema)
