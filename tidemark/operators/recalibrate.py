"""Post-hoc calibration of predictions: isotonic and Platt, per step and over all steps.

Fitted calibrators are a table (a row per step, scope and method), so they are saved with the writer of
any DataFrame and applied again by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.evaluate import brier, calibration_error
from tidemark.session import cut_lineage

CALIBRATORS = "step int, scope string, method string, slope double, offset double, xs array<double>, ys array<double>"


def _logit(score: Column) -> Column:
    p = F.greatest(F.least(score, F.lit(1 - 1e-7)), F.lit(1e-7))
    return F.log(p / (1 - p))


def _isotonic(train: DataFrame) -> tuple:
    from pyspark.ml.regression import IsotonicRegression

    model = IsotonicRegression(featuresCol="score", labelCol="y", predictionCol="calibrated").fit(train)
    return None, None, [float(x) for x in model.boundaries], [float(y) for y in model.predictions]


def _platt(train: DataFrame) -> tuple:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    shaped = VectorAssembler(inputCols=["logit"], outputCol="x").transform(train.withColumn("logit", _logit(F.col("score"))))
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=0.0, maxIter=1000).fit(shaped)
    return float(model.coefficients[0]), float(model.intercept), None, None


METHODS = {"isotonic": _isotonic, "platt": _platt}


def fit_calibrators(train: DataFrame, min_positive: int = 20, methods=("isotonic", "platt")) -> DataFrame:
    """Calibrators of ``train(step, score, label)``: one per method and step with enough positives (and a
    negative), and one per method over all these steps (scope ``global``, no step). None where no step has."""
    train = cut_lineage(train.select("step", "score", "label", F.col("label").cast("double").alias("y")))
    counts = train.groupBy("step").agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect()  # one row per step
    usable = sorted(r["step"] for r in counts if r["p"] >= min_positive and r["p"] < r["n"])
    fits = [(s, "step", train.filter(F.col("step") == s)) for s in usable]
    if usable:
        fits.append((None, "global", train.filter(F.col("step").isin(usable))))
    rows = [(step, scope, m, *METHODS[m](part)) for step, scope, part in fits for m in methods]
    return train.sparkSession.createDataFrame(rows, CALIBRATORS)


def _calibrated() -> Column:
    """Score through its row's calibrator: a line on the logit, or interpolation between ascending ``xs``."""
    score, xs, ys = F.col("score"), F.col("xs"), F.col("ys")
    n = F.size(xs)
    upto = F.size(F.filter(xs, lambda x: x <= score))
    lo, hi = F.get(xs, upto - 1), F.get(xs, upto)
    y0, y1 = F.get(ys, upto - 1), F.get(ys, upto)
    step = F.when(upto == 0, F.get(ys, F.lit(0))).when(upto == n, F.get(ys, n - 1)).otherwise(y0 + (y1 - y0) * (score - lo) / (hi - lo))
    line = 1 / (1 + F.exp(-(F.col("slope") * _logit(score) + F.col("offset"))))
    return F.when(F.col("method") == "isotonic", F.greatest(F.least(step, F.lit(1.0)), F.lit(0.0))).otherwise(line)


def apply_calibrators(rows: DataFrame, calibrators: DataFrame) -> DataFrame:
    """``rows(step, score, …)`` with every calibrator that fits their step: adds ``scope, method, calibrated``.

    A step without calibrators of its own has no row of scope ``step``, and none of scope ``global`` either.
    """
    own = calibrators.filter("scope = 'step'")
    # the calibrators for all steps, once for each step that has its own
    shared = calibrators.filter("scope = 'global'").select("method", F.explode(own.agg(F.collect_set("step")).scalar()).alias("step"), "scope", "slope", "offset", "xs", "ys")
    return rows.join(own.unionByName(shared), "step").withColumn("calibrated", _calibrated()).drop("slope", "offset", "xs", "ys")


def best_calibrators(calibrators: DataFrame, rows: DataFrame) -> DataFrame:
    """The calibrator of least Brier score on ``rows(step, score, label)`` for each step and scope, ties by method."""
    error = apply_calibrators(rows, calibrators).withColumn("e", F.pow(F.col("calibrated") - F.col("label"), F.lit(2)))
    own = F.when(F.col("scope") == "step", F.col("step"))
    scored = error.groupBy(own.alias("step"), "scope", "method").agg(F.avg("e").alias("e"))
    best = scored.groupBy("step", "scope").agg(F.min_by("method", F.struct("e", "method")).alias("method"))
    same = calibrators["step"].eqNullSafe(best["step"]) & (calibrators["scope"] == best["scope"]) & (calibrators["method"] == best["method"])
    return calibrators.join(best, same, "left_semi")


def recalibrate(train: DataFrame, test: DataFrame, min_positive: int = 20, methods=("isotonic", "platt")) -> DataFrame:
    """Test scores after calibration: ``step, scope, method, pid, label, score, calibrated``."""
    fitted = fit_calibrators(train, min_positive, methods)
    out = apply_calibrators(test.select("pid", "step", "score", "label"), fitted)
    return out.select("step", "scope", "method", "pid", "label", "score", "calibrated")


def compare_calibration(calibrated: DataFrame) -> DataFrame:
    """Calibration error and Brier score before and after, per (step, scope, method)."""
    keys = ["step", "scope", "method"]
    raw = calibrated.select(*keys, "label", "score")
    cal = calibrated.select(*keys, "label", F.col("calibrated").alias("score"))
    out = calibration_error(raw, keys).select(*keys, "n", F.col("ece").alias("ece_raw"))
    out = out.join(calibration_error(cal, keys).select(*keys, F.col("ece").alias("ece_cal")), keys)
    out = out.join(brier(raw, keys).withColumnRenamed("brier", "brier_raw"), keys)
    return out.join(brier(cal, keys).withColumnRenamed("brier", "brier_cal"), keys)
