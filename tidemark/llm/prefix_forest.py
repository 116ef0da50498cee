"""Nearest vectors by inner product from a forest of sorted hash strings (hash-prefix forest).

In each tree a vector has a string of ``bits`` bits, each the side of a random plane it lies on; the strings of
a tree form a sorted array, in which the vectors that share a prefix lie next to each other. The array is dealt
to tiles of about ``tile`` vectors by a directory of bounds, so a prefix of any length is a run of tiles.

A query first descends: in a few trees it is compared with the tile its own string falls in, where its longest
prefix matches lie. The least inner product so found says how long a prefix must be for a vector as near as that
to share it in at least one tree, but for a chance of ``miss``. The query then ascends to that length in all
trees at once and is compared with every vector under those prefixes: long ones within dense groups, short ones
where all vectors are about equally far. Strings are made for vectors brought to one length by one more
component, which turns the largest inner product into the smallest angle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import work

#: The directory is fitted to about so many components of vectors, and so many vectors, at most.
SAMPLE_NUMBERS = 4_000_000
SAMPLE = 60_000
#: Tiles of a tree at most (so the directory has a bounded size), dimensions with a forest at most.
TILES = 1 << 16
DIMS = 1000
#: Queries of a tile that are compared in one group.
CHUNK = 4096
_BYTES = 16
_WORST = 1e-9


@dataclass(frozen=True)
class Rule:
    """``nearest`` neighbours from ``trees`` sorted arrays; ``first`` of them are descended for the first estimate."""

    nearest: int = 20
    trees: int = 16
    first: int = 4
    tile: int = 2048
    miss: float = 0.1
    seed: int = 11


@dataclass
class Forest:
    """For every dimension the greatest length of a vector, and the bounds of each tree's tiles."""

    rule: Rule
    longest: dict[int, float] = field(default_factory=dict)
    bounds: dict[int, list[np.ndarray]] = field(default_factory=dict)

    def trees(self, dim: int) -> int:
        """A dimension too rare to be in the sample has one tile."""
        return self.rule.trees if dim in self.bounds else 1

    def bound(self, dim: int, tree: int) -> np.ndarray:
        return self.bounds[dim][tree] if dim in self.bounds else np.zeros(0, f"S{_BYTES}")


def strings(x: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """The hash strings of the rows of ``x`` in a tree."""
    planes = np.random.default_rng([seed, tree, x.shape[1]]).standard_normal((x.shape[1], 8 * _BYTES))
    return np.ascontiguousarray(np.packbits(x @ planes > 0, axis=1)).view(f"S{_BYTES}").ravel()


def _to_binary(s: np.ndarray) -> pa.Array:
    size = s.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(np.arange(len(s) + 1, dtype=np.int32) * size), pa.py_buffer(np.ascontiguousarray(s))])


def _from_binary(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), f"S{_BYTES}") if len(column) else np.zeros(0, f"S{_BYTES}")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _length(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(axis=1)
    return np.minimum(most * np.sqrt(((x / most[:, None]) ** 2).sum(axis=1)), 1e300)


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows with one more component that brings them all to length 1 (as a share of ``longest``)."""
    x = x / longest
    return np.column_stack([x, np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0))])


def level(least: np.ndarray, length: np.ndarray, longest: float, rule: Rule) -> np.ndarray:
    """The longest prefix at which a vector with inner product ``least`` is missed by all trees with a chance of ``miss``."""
    cosine = np.clip(least / (length * longest), -1, 1 - 1e-12)
    share = 1 - np.arccos(cosine) / np.pi
    with np.errstate(divide="ignore"):
        bits = np.log1p(-(rule.miss ** (1 / rule.trees))) / np.log(share)
    return np.where(np.isfinite(least), np.clip(np.floor(bits), 0, 8 * _BYTES), 0).astype(np.int64)


def run_of(s: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest string with the first ``bits`` bits of each ``s``."""
    octets = s.view(np.uint8).reshape(len(s), _BYTES)
    free = (np.uint16(0xFF) >> np.clip(bits[:, None] - 8 * np.arange(_BYTES), 0, 8).astype(np.uint16)).astype(np.uint8)
    low, high = octets & ~free, octets | free
    return tuple(np.ascontiguousarray(x).view(f"S{_BYTES}").ravel() for x in (low, high))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, cls (a hash of the vector), length and embedding of the rows whose vector takes part."""
    number = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.is_valid(b.column("embedding")))
            lists = b.column("embedding")
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(lists.flatten(), float("nan")).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            fine = (np.bincount(row[~np.isfinite(flat)], minlength=len(size)) == 0) & (np.bincount(row[flat != 0], minlength=len(size)) > 0)
            for dim in np.unique(size[fine]).tolist():
                mine = fine & (size == dim)
                part = b.filter(pa.array(mine))
                x = _matrix(part.column("embedding"), dim) + 0.0
                cls = np.array([hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x], f"V{_BYTES}")
                columns = [part.column("vec_id"), pa.array(np.full(len(x), dim, np.int32)), _to_binary(cls), pa.array(_length(x)), part.column("embedding")]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "dim", "cls", "length", "embedding"])

    plain = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{number}>"))
    return plain.mapInArrow(run, f"vec_id long, dim int, cls binary, length double, embedding array<{number}>")


def classes(rows: DataFrame, most: int) -> DataFrame:
    """cls, dim, length, embedding and ids (its ``most`` least vec_ids, null last) of each distinct vector."""
    place = F.row_number().over(Window.partitionBy("cls").orderBy(F.asc_nulls_last("vec_id")))
    few = rows.dropDuplicates(["cls", "vec_id"]).withColumn("place", place).where(F.col("place") <= most)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("place", "vec_id"))), lambda s: s["vec_id"])
    return few.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("dim", "length", "embedding")], ids.alias("ids"))


def fit(known: DataFrame, rule: Rule) -> Forest:
    """Directories from a sample of about ``SAMPLE`` vectors, whose strings' quantiles bound the tiles."""
    sizes = known.groupBy("dim").agg(F.count("*").alias("n"), F.max("length").alias("longest")).orderBy(F.desc("n"), "dim").limit(DIMS).collect()
    forest = Forest(rule, {r["dim"]: r["longest"] for r in sizes})
    total = sum(r["n"] for r in sizes)
    if not total:
        return forest
    aim = min(SAMPLE, SAMPLE_NUMBERS // max(1, sum(r["n"] * r["dim"] for r in sizes) // total))
    share = F.pmod(F.xxhash64("cls"), F.lit(1 << 30)) < min(1 << 30, (aim << 30) // total + 1)
    sample = known.where(share).select("dim", "embedding").limit(2 * SAMPLE).toArrow()
    dims = sample["dim"].to_numpy() if sample.num_rows else np.zeros(0, np.int32)
    for r in sizes:
        mine = dims == r["dim"]
        if mine.any():
            x = lifted(_matrix(sample["embedding"].filter(pa.array(mine)), r["dim"]), r["longest"])
            tiles = min(TILES, -(-r["n"] // rule.tile))
            cut = len(x) * np.arange(1, tiles) // tiles
            forest.bounds[r["dim"]] = [np.sort(strings(x, t, rule.seed))[cut] for t in range(rule.trees)]
    return forest


_KEY = ["dim", "tree", "tile"]


def _by_dim(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        part = batch.filter(pa.array(dims == dim))
        for at in range(0, len(part), rows):
            yield dim, part.slice(at, rows)


def index(known: DataFrame, forest: Forest) -> DataFrame:
    """Every distinct vector at its place in every tree. Equal strings over several tiles are dealt among them."""
    shared = known.sparkSession.sparkContext.broadcast(forest)
    number = dict(known.dtypes)["embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            for dim, b in _by_dim(batch):
                x = lifted(_matrix(b.column("embedding"), dim), forest.longest.get(dim, 1.0)) if dim in forest.bounds else None
                pick = np.frombuffer(b"".join(b.column("cls").to_pylist()), np.uint64)[::2]
                for t in range(forest.trees(dim)):
                    bounds = forest.bound(dim, t)
                    s = strings(x, t, forest.rule.seed) if x is not None else np.zeros(len(b), f"S{_BYTES}")
                    low, high = np.searchsorted(bounds, s, "left"), np.searchsorted(bounds, s, "right")
                    tile = low + (pick % (high - low + 1).astype(np.uint64)).astype(np.int64)
                    keys = [pa.array(np.full(len(b), k, np.int32)) for k in (dim, t)] + [pa.array(tile.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*keys, _to_binary(s), *(b.column(c) for c in ("cls", "ids", "embedding"))], names=[*_KEY, "string", "cls", "ids", "embedding"])

    return known.select("dim", "cls", "ids", "embedding").mapInArrow(run, f"dim int, tree int, tile int, string binary, cls binary, ids array<long>, embedding {number}")


def probes(queries: DataFrame, forest: Forest, first: bool) -> DataFrame:
    """The tiles that each query (dim, cls, length, embedding, least) has to meet, and the run of strings within.

    ``first``: the tile of its own string in some trees; else all under the prefix that ``least`` asks for, in all.
    """
    shared = queries.sparkSession.sparkContext.broadcast(forest)
    number = dict(queries.dtypes)["embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        rule = forest.rule
        for batch in batches:
            for dim, b in _by_dim(batch, 256):
                longest, length = forest.longest.get(dim, 1.0), b.column("length").to_numpy()
                least = pc.fill_null(b.column("least"), float("-inf")).to_numpy()
                x = _matrix(b.column("embedding"), dim) / length[:, None]
                bits = level(least, length, longest, rule)
                for t in range(min(rule.first, forest.trees(dim)) if first else forest.trees(dim)):
                    bounds = forest.bound(dim, t)
                    if dim in forest.bounds:
                        s = strings(np.column_stack([x, np.zeros(len(x))]), t, rule.seed)
                    else:
                        s, bits = np.zeros(len(x), f"S{_BYTES}"), np.zeros(len(x), np.int64)
                    low, high = run_of(s, bits * (not first))
                    a, z = (np.searchsorted(bounds, *p) for p in (((s, "right"), (s, "right")) if first else ((low, "left"), (high, "right"))))
                    row = np.repeat(np.arange(len(x)), z - a + 1)
                    tile = np.arange(len(row)) - np.repeat(np.cumsum(z - a + 1) - (z - a + 1), z - a + 1) + a[row]
                    keys = [pa.array(np.full(len(row), k, np.int32)) for k in (dim, t)] + [pa.array(tile.astype(np.int32))]
                    part = b.take(pa.array(row))
                    columns = [*keys, _to_binary(low[row]), _to_binary(high[row]), part.column("cls"), pa.array(least[row]), part.column("embedding")]
                    yield pa.RecordBatch.from_arrays(columns, names=[*_KEY, "low", "high", "query", "least", "embedding"])

    cols = queries.select("dim", "cls", "length", "least", "embedding")
    return cols.mapInArrow(run, f"dim int, tree int, tile int, low binary, high binary, query binary, least double, embedding {number}")


def _best(q: np.ndarray, x: np.ndarray, least: np.ndarray, lowest: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of ``q`` its (up to) ``most`` best rows of ``x`` not below ``least``, with the scores.

    The product of matrices only sieves; a score is summed up pair by pair, the same way wherever the pair meets.
    """
    about = q @ x.T
    slack = _WORST * np.abs(about).max(axis=1, initial=0) + 1e-300
    bar = least - slack
    if about.shape[1] > most:
        bar = np.maximum(bar, np.partition(about, -most, axis=1)[:, -most] - slack)
    for i in range(len(q)):
        at = np.flatnonzero(about[i] >= bar[i])
        if len(at):
            score = (x[at] * q[i]).sum(axis=1)
            order = np.lexsort((lowest[at], -score))[:most]
            order = order[score[order] >= least[i]]
            yield i, at[order], score[order]


def search(places: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """query, cls, ids and score: of every tile the ``most`` nearest to each query that meets it there."""

    def pairs(rows: pa.Table, queries: pa.Table) -> pa.Table:
        q_at, c_at, scores = [], [], []
        if rows.num_rows and queries.num_rows:
            dim = rows["dim"][0].as_py()
            s = _from_binary(rows["string"])
            order = np.argsort(s, kind="stable")
            rows, s = rows.take(pa.array(order)), s[order]
            x, q = _matrix(rows["embedding"], dim), _matrix(queries["embedding"], dim)
            lists = rows["ids"].combine_chunks()
            head = pc.list_element(lists, 0)
            lowest = pc.fill_null(head, np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            a = np.searchsorted(s, _from_binary(queries["low"]), "left")
            z = np.searchsorted(s, _from_binary(queries["high"]), "right")
            least = queries["least"].to_numpy()
            # queries with one run of strings are compared together
            same = np.lexsort((z, a))
            edge = np.flatnonzero(np.append(True, (np.diff(a[same]) != 0) | (np.diff(z[same]) != 0)))
            for i, j in zip(edge, np.append(edge[1:], len(same))):
                for k in range(i, j, 256):
                    mine = same[k : min(j, k + 256)]
                    lo, hi = a[mine[0]], z[mine[0]]
                    if lo < hi:
                        for r, at, score in _best(q[mine], x[lo:hi], least[mine], lowest[lo:hi], most):
                            q_at.append(np.full(len(at), mine[r]))
                            c_at.append(at + lo)
                            scores.append(score)
        none = np.zeros(0, np.int64)
        q_at, c_at = (pa.array(np.concatenate([none, *p])) for p in (q_at, c_at))
        columns = {"query": queries["query"].take(q_at), "cls": rows["cls"].take(c_at), "ids": rows["ids"].take(c_at)}
        return pa.table(columns | {"score": np.concatenate([np.zeros(0), *scores])})

    parts = asked.groupBy(*_KEY).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    dealt = asked.join(parts, _KEY).withColumn("part", F.pmod(F.xxhash64("query"), "parts").cast("int")).drop("parts")
    met = places.join(parts, _KEY).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    key = [*_KEY, "part"]
    return met.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(pairs, "query binary, cls binary, ids array<long>, score double")


def bars(found: DataFrame, most: int) -> DataFrame:
    """query and the score that its ``most``-th nearest row found so far has."""
    rows = F.sum(F.size("ids")).over(Window.partitionBy("query").orderBy(F.desc("score"), "cls"))
    return found.withColumn("rows", rows).groupBy("query").agg(F.max(F.when(F.col("rows") >= most, F.col("score"))).alias("least"))


def answers(found: DataFrame, most: int) -> DataFrame:
    """query and its ``most`` nearest rows found (score, vec_id, own: whether of the query's own vector), nearest first."""
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last(F.element_at("ids", 1)), "cls")
    few = found.dropDuplicates(["query", "cls"]).withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)
    rows = few.select("query", "score", (F.col("query") == F.col("cls")).alias("own"), F.explode("ids").alias("vec_id"))
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    rows = rows.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= most)
    return rows.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "score", "vec_id", "own"))).alias("nearest"))


def nearest(vectors: DataFrame, is_query: Column, rule: Rule = Rule()) -> DataFrame:
    """query_id, rank, vec_id and score: the nearest rows of ``vectors`` (vec_id, embedding) to each one ``is_query`` picks.

    Nearest first by inner product in double precision, ties to the smaller vec_id (null last). ``is_query`` is an
    expression of vec_id; a row without vec_id is no query but may be found. Vectors that are null, empty, zero or
    hold null or non-finite components take no part; vectors of another dimension are never near. Rows that repeat
    vec_id and vector are one; a vec_id with two vectors is two rows, each the other's candidate. Equal vectors
    are compared once. No rows give no rows; further columns are not looked at.
    """
    most = rule.nearest + 1  # the query's own row may be among them
    rows = work.written(usable(vectors))
    known = work.written(classes(rows, most))
    forest = fit(known, rule)
    asking = work.written(rows.where(is_query & F.col("vec_id").isNotNull()).select(F.col("vec_id").alias("query_id"), F.col("cls").alias("query")).distinct())
    queries = work.written(known.join(asking.select(F.col("query").alias("cls")).distinct(), "cls", "left_semi"))
    places = index(known, forest)
    descended = places.where(F.col("tree") < rule.first)
    near = work.written(search(descended, probes(queries.withColumn("least", F.lit(None).cast("double")), forest, True), most).dropDuplicates(["query", "cls"]))
    asked = queries.join(bars(near, most).withColumnRenamed("query", "cls"), "cls", "left")
    found = work.written(near.union(search(places, probes(asked, forest, False), most)))
    given = work.hot_join(asking, work.written(answers(found, most)), "query")
    others = F.filter("nearest", lambda r: ~(r["own"] & F.coalesce(r["vec_id"] == F.col("query_id"), F.lit(False))))
    listed = given.select("query_id", F.posexplode(F.slice(others, 1, rule.nearest)).alias("at", "row"))
    return listed.select("query_id", (F.col("at") + 1).alias("rank"), "row.vec_id", "row.score")
