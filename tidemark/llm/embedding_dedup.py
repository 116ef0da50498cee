"""Near-duplicate vectors by a forest of random-projection trees.

Each node of a tree projects its vectors on a random direction and splits them at the median; vectors near
the median go to both sides, so close pairs are seldom torn apart, and many trees make up for those that
are. A split through a dense group would tear its links however close they are, so a node whose links no
tried direction leaves whole becomes a leaf early, as long as a fair share of its pairs are links. Trees are
fitted to a bounded sample; every vector is dealt to its leaves. Within a leaf all vectors are compared in
double precision. A leaf that holds more than ``TILE`` vectors (a large group of near
copies) is cut into tiles, and every pair of tiles is a group of its own. Equal vectors are one class from
the start, with its size, so copies are never paired off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import work
from tidemark.llm.components import components

#: Vectors that trees are fitted to at most, trees, vectors of a leaf aimed at, share that goes both ways.
SAMPLE = 20_000
TREES = 8
LEAF = 400
SPILL = 0.2
TILE = 2048
#: A node stays whole if this share of its pairs are links and every direction of ``TRIES`` tears more than
#: ``TORN`` of them; judged on ``JUDGED`` vectors. Its pairs are thus at most 1 / ``DENSE`` times its links.
DENSE = 1 / 16
TORN = 0.05
TRIES = 8
JUDGED = 256


@dataclass
class Tree:
    """A direction, and bounds of the zone that goes both ways, for every inner node; nodes in level order.

    ``dense`` nodes are leaves though they have a place among the inner ones.
    """

    direction: np.ndarray
    low: np.ndarray
    high: np.ndarray
    dense: np.ndarray

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and leaf (a node's number) of every place that the unit vectors ``x`` belong to."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        done = [(row[:0], node[:0])]
        while len(node) and node[0] < len(self.low):
            out = [(row[:0], node[:0])]
            for k in np.unique(node).tolist():
                mine = row[node == k]
                if self.dense[k]:
                    done.append((mine, np.full(len(mine), k)))
                    continue
                at = x[mine] @ self.direction[k]
                for side, go in ((1, at <= self.high[k]), (2, at > self.low[k])):
                    out.append((mine[go], np.full(go.sum(), 2 * k + side)))
            row, node = (np.concatenate(p) for p in zip(*out))
        row, node = (np.concatenate(p) for p in zip(*done, (row, node)))
        return row, node


def _zone(at: np.ndarray) -> np.ndarray:
    return np.quantile(at, [0.5 - SPILL / 2, 0.5 + SPILL / 2])


def _whole(x: np.ndarray, first: np.ndarray, least: float, rng: np.random.Generator) -> tuple[np.ndarray, bool]:
    """The direction, ``first`` or another, that tears the fewest links of ``x``, and whether to split by none."""
    a, b = np.triu_indices(len(x), 1)
    linked = (x @ x.T)[a, b] >= least
    if linked.sum() < DENSE * len(a) or not linked.any():
        return first, False
    a, b = a[linked], b[linked]
    tries = np.concatenate([first[None], rng.standard_normal((TRIES - 1, x.shape[1]))])
    tries /= np.maximum(np.linalg.norm(tries, axis=1, keepdims=True), 1e-300)
    torn = []
    for at in tries @ x.T:
        low, high = _zone(at)
        torn.append((np.minimum(at[a], at[b]) <= low) & (np.maximum(at[a], at[b]) > high))
    torn = np.mean(torn, axis=1)
    return tries[torn.argmin()], torn.min() > TORN


def grow(x: np.ndarray, depth: int, seed: int, least: float = 0.9) -> Tree:
    """A tree of at most ``depth`` levels on the unit vectors ``x`` in random order, for links from cosine ``least``.

    A node that no vector reaches splits at 0.
    """
    rng, more = np.random.default_rng(seed), np.random.default_rng([seed, 1])
    n = 2**depth - 1
    tree = Tree(rng.standard_normal((n, x.shape[1])), np.zeros(n), np.zeros(n), np.zeros(n, bool))
    tree.direction /= np.maximum(np.linalg.norm(tree.direction, axis=1, keepdims=True), 1e-300)
    held = {0: np.arange(len(x))}
    for k in range(n):
        mine = held.pop(k, np.zeros(0, np.int64))
        if len(mine):
            tree.direction[k], tree.dense[k] = _whole(x[mine[:JUDGED]], tree.direction[k], least, more)
            if tree.dense[k]:
                continue
            at = x[mine] @ tree.direction[k]
            tree.low[k], tree.high[k] = _zone(at)
            held[2 * k + 1], held[2 * k + 2] = mine[at <= tree.high[k]], mine[at > tree.low[k]]
    return tree


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that very large and very small components keep their digits."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """cls, embedding, dim, rep (least vec_id) and m (how many) of each distinct usable vector."""
    v = F.col("embedding")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    usable = vectors.where(v.isNotNull() & fine)
    same = usable.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    return same.withColumns({"cls": F.monotonically_increasing_id(), "dim": F.size("embedding")})


def leaf_places(distinct: DataFrame, trees: dict[int, list[Tree]]) -> DataFrame:
    """cls, embedding, leaf (dimension, tree and node as text) and before of every place in the forest.

    ``before`` has the numbers of the vector's dense leaves that come before this one (all of them, in a leaf
    that isn't dense): two vectors with one in common meet there already.
    """
    shared = distinct.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                b = batch.filter(pa.array(dims == dim))
                x = unit(_matrix(b.column("embedding"), dim))
                before: list[list[int]] = [[] for _ in range(len(x))]
                # trees are gone through twice: all dense leaves come before the others
                places = [tree.leaves(x) if tree else (np.arange(len(x)), np.zeros(len(x), np.int64)) for tree in shared.value.get(dim) or [None]]
                for dense in (True, False):
                    for t, (row, leaf) in enumerate(places):
                        tree = (shared.value.get(dim) or [None])[t]
                        is_dense = np.append(tree.dense, False)[np.minimum(leaf, len(tree.dense))] if tree else np.zeros(len(leaf), bool)
                        row, leaf = row[is_dense == dense], leaf[is_dense == dense]
                        order = np.argsort(leaf, kind="stable")
                        row, leaf = row[order], leaf[order]
                        seen = []
                        for i, k in zip(row.tolist(), leaf.tolist()):
                            seen.append(list(before[i]))
                            if dense:
                                before[i].append(t << 32 | k)
                        part = b.select(["cls", "embedding"]).take(pa.array(row))
                        name = pa.array([f"{dim}/{t}/{k}" for k in leaf.tolist()], pa.string())
                        yield pa.RecordBatch.from_arrays([*part.columns, name, pa.array(seen, pa.list_(pa.int64()))], names=["cls", "embedding", "leaf", "before"])

    return distinct.select("cls", "embedding", "dim").mapInArrow(run, "cls long, embedding array<double>, leaf string, before array<long>")


def near(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` and of ``y`` whose cosine reaches ``least``."""
    return np.nonzero(unit(x) @ unit(y).T >= least)


def _sharing(x: pa.ListArray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which rows of ``left`` and of ``right`` have a number of the lists ``x`` in common."""
    of, which = np.unique(x.flatten().to_numpy(), return_inverse=True)
    has = np.zeros((len(x), len(of)), np.float32)
    has[np.repeat(np.arange(len(x)), x.value_lengths().to_numpy()), which] = 1
    return has[left] @ has[right].T > 0


def compare(places: DataFrame, least: float) -> DataFrame:
    """Linked classes (a < b) among those that share a leaf."""

    def pairs(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cls, tile = table.column("cls").to_numpy(), table.column("tile").to_numpy()
        x = np.asarray(table.column("embedding").combine_chunks().flatten(), np.float64).reshape(len(cls), -1)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        a, b = (np.zeros(0, np.int64),) * 2
        if len(left) and len(right):
            p, q = near(x[left], x[right], least)
            new = ~_sharing(table.column("before").combine_chunks(), left, right)[p, q]
            p, q = p[new], q[new]
            a, b = cls[left[p]], cls[right[q]]
        ok = a < b if i == j else a != b
        return pa.table({"a": np.minimum(a, b)[ok], "b": np.maximum(a, b)[ok]})

    tiles = places.groupBy("leaf").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    cut = places.join(tiles, "leaf").withColumn("tile", F.pmod(F.xxhash64("cls"), "tiles").cast("int"))
    partners = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least("tile", t).alias("i"), F.greatest("tile", t).alias("j")))
    dealt = cut.withColumn("p", F.explode(partners)).select("leaf", "p.i", "p.j", "tile", "cls", "embedding", "before")
    return dealt.groupBy("leaf", "i", "j").applyInArrow(pairs, "a long, b long").distinct()


def fit(distinct: DataFrame, least: float, seed: int = 7) -> dict[int, list[Tree]]:
    """``TREES`` trees for every dimension in a sample of at most ``SAMPLE`` vectors."""
    sample = distinct.orderBy(F.xxhash64("embedding"), "cls").limit(SAMPLE).select("embedding", "dim").toArrow()
    sizes = {r["dim"]: r["n"] for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(1000).collect()}
    dims, out = sample["dim"].to_numpy() if sample.num_rows else np.zeros(0), {}
    for dim in np.unique(dims).astype(int).tolist():
        part = sample.filter(pa.array(dims == dim)).combine_chunks()
        x = unit(_matrix(part.column("embedding").combine_chunks(), dim))
        most = int(np.log2(max(len(x) / 16, 1)))
        depth = min(int(np.ceil(np.log2(max(sizes.get(dim, 0) / LEAF, 1)))), most)
        if depth:
            out[dim] = [grow(x, depth, seed * 1000 + t, least) for t in range(TREES)]
    return out


def near_duplicates(vectors: DataFrame, least: float = 0.9, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding).

    Vectors that are null, empty, all zero, or hold null or non-finite components link with nothing, nor do
    vectors of different dimensions. Rows are vectors of their own, also with a null or repeated vec_id: equal
    rows link. A null vec_id counts as the least only where no other is reached. No rows give no rows;
    further columns are not looked at.
    """
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    same = work.written(distinct_vectors(vectors))
    links = work.written(compare(leaf_places(same, fit(same, least, seed)), least))
    label = components(links)
    sizes = same.select("cls", "m")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    count = both.join(sizes.withColumnRenamed("cls", "b"), "b").groupBy("a").agg(F.sum("m").alias("others"))
    named = same.join(label, same["cls"] == label["id"], "left").join(count, same["cls"] == count["a"], "left")
    named = named.select("embedding", "rep", F.coalesce("component", "cls").alias("label"), (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    least_id = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(least_id, "label").select("embedding", "n_links", "component_id")
    found = vectors.join(named, "embedding", "left")
    component = F.coalesce("component_id", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
