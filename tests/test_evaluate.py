"""Rank statistics and survival metrics against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate as ev


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(2)
    return [(i, i % 3, rnd.choice([0.0, 0.1, 0.5, 0.9, rnd.random()]), int(rnd.random() < 0.3)) for i in range(300)]


@pytest.fixture(scope="module")
def rows(spark, data):
    return spark.createDataFrame(data, "pid long, step int, score double, label int")


def pairs(data, step):
    pos = [s for _, k, s, y in data if k == step and y]
    neg = [s for _, k, s, y in data if k == step and not y]
    return pos, neg


def test_auroc_and_symmetry(rows, data):
    got = {r.step: r.auroc for r in ev.discrimination(rows, ["step"]).collect()}
    flip = {r.step: r.auroc for r in ev.discrimination(rows.withColumn("score", -F.col("score")), ["step"]).collect()}
    for k in range(3):
        pos, neg = pairs(data, k)
        want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
        assert got[k] == pytest.approx(want) and flip[k] == pytest.approx(1 - want)


def test_one_class_gives_null(spark):
    df = spark.createDataFrame([(1, 0, 0.5, 0), (2, 0, 0.7, 0)], "pid long, step int, score double, label int")
    r = ev.discrimination(df, ["step"]).first()
    assert r.auroc is None and r.auroc_ci_lower is None and r.n_samples == 2


def test_bootstrap_interval_holds_the_point(rows):
    for r in ev.average_precision_ci(rows, ["step"], replicates=60).collect():
        assert r.ci_lower < r.auprc < r.ci_upper


def test_poisson_weights_have_unit_mean(spark):
    df = spark.range(4000).select("id", ev.poisson_weight(F.lit(1), F.col("id")).alias("a"), ev.poisson_weight(F.lit(500), F.col("id")).alias("b"))
    r = df.agg(F.avg("a").alias("ma"), F.var_pop("a").alias("va"), F.avg("b").alias("mb"), F.var_pop("b").alias("vb")).first()
    assert abs(r.ma - 1) < 0.06 and abs(r.va - 1) < 0.1 and abs(r.mb - 500) < 2 and abs(r.vb - 500) < 50


def test_delong_against_definition(rows, data):
    two = rows.withColumn("b", (F.col("pid") * 7 % 11) / 11 + F.col("label") * 0.2).withColumnRenamed("score", "a")
    got = {r.step: r for r in ev.delong(two, ["step"], "a", "b").collect()}
    for k in range(3):
        sel = [(s, (i * 7 % 11) / 11 + y * 0.2, y) for i, kk, s, y in data if kk == k]
        v = {}
        for j in (0, 1):
            pos, neg = [r[j] for r in sel if r[2]], [r[j] for r in sel if not r[2]]
            v[j] = (
                np.array([np.mean([(p > n) + 0.5 * (p == n) for n in neg]) for p in pos]),
                np.array([np.mean([(p > n) + 0.5 * (p == n) for p in pos]) for n in neg]),
            )
        var = sum(np.var(v[0][s] - v[1][s], ddof=1) / len(v[0][s]) for s in (0, 1))
        z = (v[0][0].mean() - v[1][0].mean()) / var**0.5
        assert got[k].z == pytest.approx(z) and got[k].se_diff == pytest.approx(var**0.5)
    same = ev.delong(two.withColumn("b", F.col("a")), ["step"], "a", "b").first()
    assert (same.z, same.p, same.se_diff) == (0.0, 1.0, 0.0)


def test_concordance(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.randint(0, 6), int(rnd.random() < 0.5), rnd.choice([0.1, 0.4, 0.4, 0.8])) for i in range(80)]
    df = spark.createDataFrame(rows, "pid long, time int, event int, risk double")
    hits = [(a[3] > b[3]) + 0.5 * (a[3] == b[3]) for a in rows if a[2] for b in rows if b[1] > a[1]]
    r = ev.concordance(df).first()
    assert r.cindex == pytest.approx(np.mean(hits)) and r.n_pairs == len(hits)


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.5, 0.03]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(p)], "g int, i int, p double")
    got = {r.i: r.p_adjusted for r in ev.benjamini_hochberg(df, ["g"], "p", ["i"]).collect()}
    assert [round(got[i], 6) for i in range(5)] == [0.05, 0.05, 0.05, 0.5, 0.05]


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0, 0.0, 0), (0, 0.25, 1), (0, 0.26, 0), (0, 1.0, 1)], "step int, score double, label int")
    bins = {r.bin: r.n for r in ev.calibration_bins(df, ["step"]).collect()}
    assert bins == {1: 1, 2: 1, 4: 1}  # 0 is in no bin


def test_out_of_fold_covers_the_schedule(spark, folder, monkeypatch):
    """The query scores every landmark of the schedule from all features and aggregates."""
    import __spark_entry__ as entry
    from tidemark.operators import landmark as lm
    from tidemark.plans import landmarks as plan

    seen = []

    def look(data, labels, hours, columns, path):
        seen.append((data.columns, hours, columns))
        return data.select("landmark", "pid")

    monkeypatch.setattr(lm, "out_of_fold", look)
    got = entry.queries()["p2_out_of_fold"](spark, folder)
    ((held, hours, columns),) = seen
    assert hours == lm.landmark_hours() and {r.landmark for r in got.select("landmark").distinct().collect()} == set(hours)
    assert set(columns) == {f"{f}_ev_{k}" for f in plan.FEATURES for k in plan.STATS} <= set(held)


def test_out_of_fold_scores_every_row(spark, tmp_path):
    """Each entity has one score at each landmark, and a second call reads what is there."""
    from tidemark.operators import landmark as lm

    hours = [0.0, 0.166667, 24.0]
    data = spark.createDataFrame([(h, i, float(i % 7)) for h in hours for i in range(60)], "landmark double, pid long, a double")
    labels = spark.createDataFrame([(i, int(i % 7 > 3), i % 6 == 0) for i in range(60)], "pid long, label int, holdout boolean")
    got = [lm.out_of_fold(data, labels, hours, ["a"], str(tmp_path), folds=2).collect() for _ in range(2)]
    assert sorted((r.landmark, r.pid) for r in got[0]) == [(h, i) for h in hours for i in range(60)]
    assert sorted(got[0]) == sorted(got[1]) and all((r.fold == -1) == (r.pid % 6 == 0) for r in got[0])
