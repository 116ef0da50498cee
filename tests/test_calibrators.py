"""Saved calibrators against their definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import recalibrate as rc


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    out = []
    for i in range(600):
        p = float(rng.random())
        out += [(i, s, round(p, 2), int(rng.random() < p**2)) for s in (1, 2)]
    out += [(i, 3, 0.5, 0) for i in range(30)]
    return spark.createDataFrame(out, "pid long, step int, score double, label int")


def test_fit_save_apply(spark, rows, tmp_path):
    rc.fit_calibrators(rows).write.parquet(f"{tmp_path}/c")
    saved = spark.read.schema(rc.CALIBRATORS).parquet(f"{tmp_path}/c")
    assert saved.groupBy("scope").count().orderBy("scope").collect() == [("global", 2), ("step", 4)]
    got = rc.apply_calibrators(rows, saved).toPandas()
    assert set(got.step) == {1, 2} and got.groupby(["step", "scope", "method"]).size().eq(600).all()
    for _, part in got[got.method == "isotonic"].groupby(["step", "scope"]):
        # pooled neighbours: rising, and as a whole without bias
        means = part.sort_values("score").calibrated.to_numpy()
        assert (np.diff(means) >= -1e-9).all()
    own = got[got.scope == "step"]
    # optimality of the logistic fit: residuals sum to 0, also weighted with the logit
    for _, part in own[own.method == "platt"].groupby("step"):
        p = part.score.clip(1e-7, 1 - 1e-7)
        assert abs((part.label - part.calibrated).sum()) < 0.05
        assert abs(((part.label - part.calibrated) * np.log(p / (1 - p))).sum()) < 0.2
    for _, part in own[own.method == "isotonic"].groupby("step"):
        assert abs((part.label - part.calibrated).sum()) < 1e-6


def test_best_and_none(spark, rows):
    fitted = rc.fit_calibrators(rows)
    best = rc.best_calibrators(fitted, rows).select("step", "scope", "method").collect()
    scored = rc.apply_calibrators(rows, fitted).withColumn("e", (F.col("calibrated") - F.col("label")) ** 2)
    own = scored.filter("scope = 'step'").groupBy("step", "method").agg(F.avg("e").alias("e")).toPandas()
    want = {int(s): part.sort_values("e").method.iloc[0] for s, part in own.groupby("step")}
    assert {r.step: r.method for r in best if r.scope == "step"} == want and len(best) == 3
    assert rc.recalibrate(rows, rows, min_positive=10_000).count() == 0
