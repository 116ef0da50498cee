"""Gradient-boosted trees for many models at once, one model per group and left-out fold.

Rows ``(group, id, fold, label, columns…)`` train the model ``(group, k)`` unless their fold is k; rows of a
negative fold train nothing, and the model with k = -1 is left no fold out. All models grow in step: a level of a
tree is one job, in which every task adds up the histograms of its rows for all models they train, partial
histograms are added by key, and the best split of each node is found where its histogram ends up. The driver sees
one row per node. Gradients are whole numbers (``SCALE`` parts), so sums, and with them all splits, do not depend
on how rows lie in tasks. Trees are kept as a table, one folder a tree: a stopped fit goes on after its last tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE = float(1 << 28)
#: Partial histograms of a node are added in so many groups before the last sum.
PARTS = 32
_NODES = "group double, fold int, node int, feature int, cut int, value double"


@dataclass(frozen=True)
class Rule:
    trees: int = 5
    depth: int = 3
    bins: int = 32
    rate: float = 0.3
    l2: float = 1.0
    least_rows: int = 1


@dataclass
class Forest:
    """Bin edges of each group's columns, and per (group, fold) the trees as arrays over nodes in level order.

    A node has the column and bin it splits by (``-1``: none) and its value.
    """

    rule: Rule
    columns: list[str]
    edges: dict[float, list[np.ndarray]]
    trees: dict[tuple[float, int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = field(default_factory=dict)

    def bins(self, group: float, x: np.ndarray) -> np.ndarray:
        """Bin of every value: how many of the column's edges are less."""
        out = np.zeros(x.shape, np.uint8)
        for j, edge in enumerate(self.edges.get(group, [])):
            out[:, j] = np.searchsorted(edge, x[:, j], "left")
        return out

    def leaf(self, tree, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node every row lies in after ``depth`` levels."""
        feature, cut, _ = tree
        at, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(depth):
            f = feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (bins[row, np.maximum(f, 0)] > cut[at]), at)
        return at

    def margin(self, group: float, fold: int, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins))
        for tree in self.trees.get((group, fold), []):
            out += self.rule.rate * tree[2][self.leaf(tree, bins, self.rule.depth)]
        return out


def edges_of(rows: DataFrame, columns: list[str], rule: Rule) -> dict[float, list[np.ndarray]]:
    """At most ``bins - 1`` approximate quantiles of each column in every group's training rows."""
    at = [i / rule.bins for i in range(1, rule.bins)]
    cuts = rows.filter("fold >= 0").groupBy("group").agg(*[F.percentile_approx(c, at, 20 * rule.bins).alias(f"c{i}") for i, c in enumerate(columns)])
    return {r["group"]: [np.unique(np.array(r[f"c{i}"] or [], float)) for i in range(len(columns))] for r in cuts.collect()}


def binned(rows: DataFrame, forest: Forest) -> DataFrame:
    """group, id, fold, label and the bins of all columns as bytes; nulls and NaN lie in the first and last bin."""
    shared = rows.sparkSession.sparkContext.broadcast((forest.rule, forest.columns, forest.edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, columns, edges = shared.value
        model = Forest(rule, columns, edges)
        for b in batches:
            x = np.column_stack([b.column(c).fill_null(-np.inf).to_numpy(zero_copy_only=False) for c in columns])
            group = b.column("group").to_numpy()
            out = np.zeros(x.shape, np.uint8)
            for g in np.unique(group).tolist():
                mine = group == g
                out[mine] = model.bins(g, x[mine])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("group", "id", "fold", "label")), pa.array([r.tobytes() for r in out], pa.binary())], names=["group", "id", "fold", "label", "bins"])

    plain = rows.select(F.col("group").cast("double"), "id", F.col("fold").cast("int"), F.col("label").cast("double"), *[F.col(c).cast("double") for c in forest.columns])
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"group double, id {kind}, fold int, label double, bins binary")


def _batch(b: pa.RecordBatch, n_columns: int) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """Group, places and bins of the rows of every group in a batch."""
    group = b.column("group").to_numpy()
    x = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(len(b), n_columns)
    for g in np.unique(group).tolist():
        at = np.flatnonzero(group == g)
        yield g, at, x[at]


def _histograms(table: DataFrame, forest: Forest, level: int) -> DataFrame:
    """Partial sums of gradients, curvatures and rows per (group, fold, node), columns and bins, as bytes.

    The tree being grown is the last one of each model; it has ``level`` levels of splits.
    """
    shared = table.sparkSession.sparkContext.broadcast(forest)
    folds = sorted({k for _, k in forest.trees})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        rule, n = forest.rule, len(forest.columns)
        first, nodes, sums = (1 << level) - 1, 1 << level, {}
        for b in batches:
            fold, label = b.column("fold").to_numpy(), b.column("label").to_numpy()
            for g, at, x in _batch(b, n):
                for k in folds:
                    trees = forest.trees.get((g, k))
                    use = np.flatnonzero((fold[at] >= 0) & (fold[at] != k))
                    if not trees or not len(use):
                        continue
                    bins, y = x[use], label[at[use]]
                    done = Forest(rule, forest.columns, forest.edges, {(g, k): trees[:-1]})
                    p = 1 / (1 + np.exp(-done.margin(g, k, bins)))
                    node = forest.leaf(trees[-1], bins, level) - first
                    open_ = node >= 0
                    bins, p, y, node = bins[open_], p[open_], y[open_], node[open_]
                    total = sums.setdefault((g, k), np.zeros((3, nodes, n, rule.bins), np.int64))
                    weights = (np.rint((p - y) * SCALE), np.rint(p * (1 - p) * SCALE), None)
                    for j, column in enumerate(np.ascontiguousarray(bins.T)):
                        place = node * rule.bins + column
                        for i, w in enumerate(weights):
                            total[i, :, j] += np.bincount(place, w, nodes * rule.bins).astype(np.int64).reshape(nodes, -1)
        for (g, k), total in sums.items():
            each = total.reshape(3, nodes, -1).transpose(1, 0, 2)
            some = np.flatnonzero(each[:, 2].any(axis=1))
            if len(some):
                columns = [pa.array(np.full(len(some), g)), pa.array(np.full(len(some), k, np.int32)), pa.array((some + first).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([np.ascontiguousarray(each[j]).tobytes() for j in some], pa.binary())], names=["group", "fold", "node", "sums"])

    return table.mapInArrow(run, "group double, fold int, node int, sums binary")


def _add(blobs: pa.ChunkedArray) -> np.ndarray:
    total = None
    for blob in blobs:
        part = np.frombuffer(blob.as_py(), np.int64)
        total = part.copy() if total is None else total + part
    return total


def best_split(sums: np.ndarray, n_columns: int, rule: Rule) -> tuple[int, int, float, float, float]:
    """Column, bin, the node's value and those of its halves; column -1 if no split gains. Ties go to the first."""
    g, h, n = sums.reshape(3, n_columns, rule.bins)
    left = [np.cumsum(x, axis=1)[:, :-1] / s for x, s in ((g, SCALE), (h, SCALE), (n, 1))]
    whole = [x[0].sum() / s for x, s in ((g, SCALE), (h, SCALE), (n, 1))]
    right = [w - x for w, x in zip(whole, left)]
    gain = left[0] ** 2 / (left[1] + rule.l2) + right[0] ** 2 / (right[1] + rule.l2) - whole[0] ** 2 / (whole[1] + rule.l2)
    gain = np.where((left[2] >= rule.least_rows) & (right[2] >= rule.least_rows), np.round(gain, 9), -np.inf)
    at = int(gain.argmax()) if gain.size else 0
    value = -whole[0] / (whole[1] + rule.l2)
    if not gain.size or gain.flat[at] <= 1e-9:
        return -1, 0, value, 0.0, 0.0
    halves = [-s[0].flat[at] / (s[1].flat[at] + rule.l2) for s in (left, right)]
    return at // (rule.bins - 1), at % (rule.bins - 1), value, *halves


def _splits(table: DataFrame, forest: Forest, level: int) -> list:
    n, rule = len(forest.columns), forest.rule
    keys, kind = ["group", "fold", "node"], "group double, fold int, node int"

    def add(part: pa.Table) -> pa.Table:
        return pa.table({**{c: part[c].slice(0, 1) for c in keys}, "sums": pa.array([_add(part["sums"]).tobytes()], pa.binary())})

    def choose(part: pa.Table) -> pa.Table:
        found = best_split(_add(part["sums"]), n, rule)
        names = ["feature", "cut", "value", "left", "right"]
        return pa.table({**{c: part[c].slice(0, 1) for c in keys}, **{c: pa.array([v], pa.int32() if c in names[:2] else pa.float64()) for c, v in zip(names, found)}})

    partial = _histograms(table, forest, level).withColumn("part", F.spark_partition_id() % PARTS)
    added = partial.groupBy(*keys, "part").applyInArrow(add, f"{kind}, sums binary")
    return added.groupBy(*keys).applyInArrow(choose, f"{kind}, feature int, cut int, value double, left double, right double").collect()


def _saved(spark: SparkSession, path: str) -> list | None:
    try:
        return spark.read.schema(_NODES).parquet(path).collect() or None
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _empty(rule: Rule):
    size = (2 << rule.depth) - 1
    return np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size)


def fit(table: DataFrame, forest: Forest, folds: int, path: str) -> Forest:
    """Grow the trees of all models on ``table`` (from ``binned``), writing each tree's nodes under ``path``."""
    spark, rule = table.sparkSession, forest.rule
    models = [(g, k) for g in forest.edges for k in [*range(folds), -1]]
    forest.trees = {m: [] for m in models}
    for t in range(rule.trees):
        for m in models:
            forest.trees[m].append(_empty(rule))
        rows = _saved(spark, f"{path}/tree{t}")
        if rows is None:
            for level in range(rule.depth):
                for r in _splits(table, forest, level):
                    feature, cut, value = forest.trees[r["group"], r["fold"]][-1]
                    feature[r["node"]], cut[r["node"]], value[r["node"]] = r["feature"], r["cut"], r["value"]
                    if r["feature"] >= 0:
                        value[2 * r["node"] + 1], value[2 * r["node"] + 2] = r["left"], r["right"]
            nodes = [(g, k, i, int(f), int(c), float(v)) for (g, k), trees in forest.trees.items() for i, (f, c, v) in enumerate(zip(*trees[-1]))]
            spark.createDataFrame(nodes, _NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/tree{t}")
        else:
            for r in rows:
                for array, name in zip(forest.trees[r["group"], r["fold"]][-1], ("feature", "cut", "value")):
                    array[r["node"]] = r[name]
    return forest


def score(table: DataFrame, forest: Forest, folds: list[int] | None = None) -> DataFrame:
    """group, id, fold and pred: each row by the model of its own fold, or by the mean margin of the models ``folds``.

    A row of a group without a model has a null pred.
    """
    shared = table.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for b in batches:
            fold, pred = b.column("fold").to_numpy(), np.full(len(b), np.nan)
            for g, at, x in _batch(b, len(forest.columns)):
                for k in np.unique(fold[at]).tolist():
                    mine = fold[at] == k
                    use = [f for f in ([max(k, -1)] if folds is None else folds) if (g, f) in forest.trees]
                    if use:
                        pred[at[mine]] = 1 / (1 + np.exp(-np.mean([forest.margin(g, f, x[mine]) for f in use], axis=0)))
            yield pa.RecordBatch.from_arrays([b.column("group"), b.column("id"), b.column("fold"), pa.array(pred, from_pandas=True)], names=["group", "id", "fold", "pred"])

    kind = table.schema["id"].dataType.simpleString()
    return table.mapInArrow(run, f"group double, id {kind}, fold int, pred double")
