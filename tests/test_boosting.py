"""Grouped boosting against a plain single fit, kept models, and a stopped run."""

import numpy as np
import pytest

from tidemark.operators import boosting as B
from tidemark.operators import landmark as lm

COLUMNS = ["a", "b", "c"]


def plain_fit(x, y, rule):
    """Trees of one model, node by node, as nested tuples."""

    def grow(rows, g, h, depth):
        value = -g[rows].sum() / (h[rows].sum() + rule.l2)
        best = (1e-9, None)
        for j in range(x.shape[1]) if depth < rule.depth else ():
            for cut in range(rule.bins - 1):
                left, right = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
                if len(left) and len(right):
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + rule.l2) for s in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + rule.l2)
                    if round(gain, 9) > best[0]:
                        best = (round(gain, 9), (j, cut, left, right))
        if best[1] is None:
            return value
        j, cut, left, right = best[1]
        return (j, cut, grow(left, g, h, depth + 1), grow(right, g, h, depth + 1))

    def walk(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    margin, trees = np.zeros(len(x)), []
    for _ in range(rule.trees):
        p = 1 / (1 + np.exp(-margin))
        trees.append(grow(np.arange(len(x)), p - y, p * (1 - p), 0))
        margin += rule.rate * np.array([walk(trees[-1], r) for r in x])
    return lambda rows: 1 / (1 + np.exp(-sum(rule.rate * np.array([walk(t, r) for r in rows]) for t in trees)))


def made(seed=0, n=400, groups=(0.0, 2.5)):
    rng, rows = np.random.default_rng(seed), []
    for g in groups:
        for i in range(n if g == 0 else n // 4):  # one group has most rows
            x = rng.normal(size=3)
            y = float(x[0] + (x[1] > 0.5) * (1 + g) + rng.normal() > 0.7)
            x[2] = np.nan if i % 17 == 0 else x[2]
            rows.append((g, i, int(rng.integers(-1, 3)), y, *[None if j == 1 and i % 23 == 0 else float(v) for j, v in enumerate(x)]))
    return rows


SCHEMA = "group double, id long, fold int, label double, a double, b double, c double"


def test_all_models_equal_single_fits(spark, tmp_path):
    rule, rows = B.Rule(trees=3, depth=3, bins=8), made()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    forest = B.Forest(rule, COLUMNS, B.edges_of(frame, COLUMNS, rule))
    table = B.binned(frame, forest)
    B.fit(table, forest, 3, str(tmp_path / "trees"))
    got = {(r["group"], r["id"]): r["pred"] for r in B.score(table, forest).collect()}
    assert len(got) == len(rows)
    for g in (0.0, 2.5):
        own = [r for r in rows if r[0] == g]
        fold, y = np.array([r[2] for r in own]), np.array([r[3] for r in own])
        x = forest.bins(g, np.array([[-np.inf if v is None else v for v in r[4:]] for r in own]))
        for k in (-1, 0, 1, 2):
            train = (fold >= 0) & (fold != k)
            want = plain_fit(x[train], y[train], rule)(x[fold == k])
            assert np.allclose([got[g, r[1]] for r in own if r[2] == k], want, atol=1e-6)


def test_a_stopped_fit_goes_on(spark, tmp_path, monkeypatch):
    rows = made(1, 200)
    frame = spark.createDataFrame(rows, SCHEMA)
    forest = lambda trees: B.Forest(B.Rule(trees=trees, bins=8), COLUMNS, edges)
    edges = B.edges_of(frame, COLUMNS, B.Rule(bins=8))
    table = B.binned(frame, forest(1))
    whole = B.fit(table, forest(3), 2, str(tmp_path / "whole"))
    B.fit(table, forest(2), 2, str(tmp_path / "parts"))
    grown = []
    splits = B._splits
    monkeypatch.setattr(B, "_splits", lambda *a: grown.append(a[2]) or splits(*a))
    parts = B.fit(table, forest(3), 2, str(tmp_path / "parts"))
    assert grown == [0, 1, 2]  # one tree, not three
    for m, trees in whole.trees.items():
        for a, b in zip(trees, parts.trees[m]):
            assert all(np.array_equal(x, y) for x, y in zip(a, b))


@pytest.mark.parametrize("use", ["all", "folds"])
def test_kept_models_score_new_entities(spark, tmp_path, use):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + rng.normal(0, 0.5, 600) > 0).astype(int)
    data = spark.createDataFrame([(h, i, *map(float, x[i])) for h in (0.0, 24.0) for i in range(600)], "landmark double, pid long, a double, b double, c double")
    labels = spark.createDataFrame([(i, int(y[i]), i % 5 == 0) for i in range(400)], "pid long, label int, holdout boolean")
    path, rule = str(tmp_path / "m"), B.Rule(trees=4)
    scores = lm.out_of_fold(data, labels, [0.0, 24.0], COLUMNS, path, folds=3, rule=rule)
    assert scores.count() == 800 and scores.filter("pred IS NULL").count() == 0
    forest = lm.load_landmarks(spark, path, 3, rule)
    new = lm.score_landmarks(data.filter("pid >= 400").unionByName(data.filter("pid = 1").selectExpr("99D AS landmark", "pid", "a", "b", "c")), forest, use, 3).collect()
    assert len(new) == 402 and [r.pred for r in new if r.landmark == 99.0] == [None, None]
    p = np.array([r.pred for r in new if r.landmark == 24.0])
    truth = y[[r.pid for r in new if r.landmark == 24.0]]
    assert (p[truth == 1][:, None] > p[truth == 0]).mean() > 0.9
    # a holdout entity has the same score from the kept model
    held = {r.pid: r.pred for r in scores.filter("landmark = 0 AND pid = 5").collect()}
    again = {r.pid: r.pred for r in lm.score_landmarks(data.filter("landmark = 0 AND pid = 5"), forest).collect()}
    assert held.keys() == again.keys() and abs(held[5] - again[5]) < 1e-12
    with pytest.raises(ValueError):
        lm.load_landmarks(spark, path, 3, B.Rule(trees=9))
