"""The forest against brute force, and its parts."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_forest as P
from tidemark.llm import queries, work

SCHEMA = "vec_id long, embedding array<double>, rank string, tile int"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, every, nearest):
    """vec_id, list of (score, vec_id) of each query, by sorting all others."""
    kept = sorted({(i, tuple(v)) for i, v, *_ in rows if usable(v)}, key=repr)
    out = defaultdict(list)
    for i, v in kept:
        if i is not None and i % every == 0:
            near = [(-float((np.array(w) * np.array(v)).sum()), j is None, j or 0) for j, w in kept if (j, w) != (i, v) and len(w) == len(v)]
            out[i].append(sorted(near)[:nearest])
    return out


def found(frame, every, rule):
    out = defaultdict(list)
    for r in P.nearest(frame, F.col("vec_id") % every == 0, rule).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["rank"], -r["score"], r["vec_id"] is None, r["vec_id"] or 0))
    return out


def odd_vectors():
    rng = random.Random(4)
    v = lambda d=6: [rng.gauss(0, 1) for _ in range(d)]
    rows = [(0, None), (3, []), (6, [0.0] * 6), (9, [1.0, None, 0, 0, 0, 0]), (12, [float("nan")] * 6), (15, [float("inf")] + [0.0] * 5), (None, v())]
    rows += [(i, v()) for i in range(20, 80)]
    same = v()
    rows += [(i, same) for i in range(100, 140)] + [(21, rows[8][1])] * 2
    rows += [(150, [-0.0, 1, 0, 0, 0, 0]), (151, [0.0, 1, 0, 0, 0, 0]), (152, [1e-200] * 6), (153, [1e150, 0, 0, 0, 0, 0])]
    rows += [(i, v(2)) for i in range(200, 206)] + [(300, v(3))]
    return [(i, v and [x if x is None else float(x) for x in v], "x", 7) for i, v in rows]


def test_few_vectors_are_exact(spark):
    """One tile holds them all; nulls, ties, copies, repeated rows and other dimensions have their defined result."""
    rows = odd_vectors()
    got, want = found(spark.createDataFrame(rows, SCHEMA).repartition(3), 3, P.Rule(nearest=5)), brute(rows, 3, 5)
    assert {i: [x[1:] for x in g] for i, g in got.items()} == {i: w[0] for i, w in want.items() if w[0]}
    assert all([x[0] for x in g] == list(range(1, len(g) + 1)) for g in got.values())


def test_empty(spark):
    assert P.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 2 == 0).count() == 0
    assert P.nearest(spark.createDataFrame([(2, [1.0], "", 0)], SCHEMA), F.col("vec_id") % 2 == 0).count() == 0


def test_recall_with_a_dense_third(spark):
    """A third near one vector, a third on few directions, a third anywhere; lengths differ; small tiles."""
    rng = np.random.default_rng(5)
    n, dim = 3000, 24
    x = rng.standard_normal((n, dim))
    x[: n // 3] = x[0] + 0.02 * rng.standard_normal((n // 3, dim))
    x[n // 3 : 2 * n // 3] = x[rng.integers(n - 30, n, n // 3)] + 0.3 * rng.standard_normal((n // 3, dim))
    x *= rng.uniform(0.5, 1, (n, 1))
    rows = [(i, x[i].tolist(), "", 0) for i in rng.permutation(n).tolist()]
    got = found(spark.createDataFrame(rows, SCHEMA), 20, P.Rule(nearest=10, tile=200))
    right = []
    for i in range(0, n, 20):
        scores = x @ x[i]
        scores[i] = -np.inf
        right.append(len({r[3] for r in got[i]} & set(np.argsort(-scores)[:10].tolist())) / 10)
        assert np.allclose([-r[1] for r in got[i]], scores[[r[3] for r in got[i]]], rtol=1e-12)
    assert len(got) == n // 20 and np.mean(right) >= 0.95


def test_query_recall(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute(rows, 20, 20)
    got = defaultdict(set)
    result = queries.QUERIES["op13_prefix_forest"](spark, folder)
    assert result.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    for r in result.collect():
        got[r["query_id"]].add(r["vec_id"])
    assert got.keys() == want.keys()
    assert np.mean([len(got[i] & {j for *_, j in w[0]}) / len(w[0]) for i, w in want.items()]) >= 0.9


def test_levels_grow_with_nearness():
    rule = P.Rule()
    bits = P.level(np.array([-np.inf, -0.5, 0.0, 0.4, 0.9, 0.999, 1.0]), np.ones(7), 1.0, rule)
    assert bits[0] == 0 and (np.diff(bits) >= 0).all() and bits[-1] == 128
    share = 1 - np.arccos(0.9) / np.pi
    assert (1 - share ** bits[4]) ** rule.trees <= rule.miss < (1 - share ** (bits[4] + 1)) ** rule.trees


@pytest.mark.parametrize("bits", [0, 1, 7, 8, 13, 127, 128])
def test_runs_of_strings(bits):
    rng = np.random.default_rng(bits)
    s = np.frombuffer(rng.bytes(16 * 50), "S16")
    low, high = P.run_of(s, np.full(50, bits))
    whole = lambda x: int.from_bytes(x.ljust(16, b"\0"), "big")
    for a, lo, hi in zip(s, low, high):
        a, lo, hi = whole(bytes(a)), whole(bytes(lo)), whole(bytes(hi))
        assert lo <= a <= hi and lo >> (128 - bits) == hi >> (128 - bits) == a >> (128 - bits) and hi - lo == (1 << (128 - bits)) - 1


def test_equal_strings_are_dealt_among_their_tiles(spark):
    """Vectors on one ray have one string; their tiles share them, and a query meets all of them."""
    rows = [(i, [1.0 + i / 1000, 0.0], "", 0) for i in range(600)]
    rule = P.Rule(nearest=5, tile=50)
    known = P.classes(P.usable(spark.createDataFrame(rows, SCHEMA)), 6)
    forest = P.fit(known, rule)
    forest.longest[2] = 1e9  # all but the added component vanishes
    forest.bounds[2] = [np.sort(np.repeat(P.strings(P.lifted(np.array([[1.0, 0.0]]), 1e9), t, rule.seed), 11)) for t in range(rule.trees)]
    sizes = [r["count"] for r in P.index(known, forest).where("tree = 0").groupBy("tile").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 100


def test_hot_join(spark, monkeypatch):
    monkeypatch.setattr(work, "HOT", 2)
    many = spark.createDataFrame([(k, i) for i in range(50) for k in (["a"] * 5 + ["b", "b", None, f"x{i}"])], "key string, i int")
    one = spark.createDataFrame([("a", 1), ("b", 2), ("x7", 3), ("y", 4)], "key string, v int")
    got = sorted(tuple(r) for r in work.hot_join(many, one, "key").select("key", "i", "v").collect())
    assert got == sorted(tuple(r) for r in many.join(one, "key").select("key", "i", "v").collect())
