"""Landmark datasets, out-of-fold scores, prediction channel, recalibration."""

from pyspark.sql import functions as F

from tidemark.operators import evaluate as ev
from tidemark.operators import landmark as lm
from tidemark.operators import recalibrate as rc
from tidemark.operators.sampling import stratified_holdout
from tidemark.plans.evaluation import EVAL, ap_sql, at_steps, auc_sql
from tidemark.plans.joining import LAND_SQL, landmarks
from tidemark.plans.registry import query, rounded, with_
from tidemark.plans.source_checks import scratch

HOURS = lm.landmark_hours()
FEATURES = ["click", "error", "purchase", "signup", "view"]
SQL_HOURS = "hr(h) AS (VALUES " + ", ".join(f"({h!r}::DOUBLE)" for h in HOURS) + ")"
STATS = {
    "first": "arg_min(value, (ts, event_id))",
    "last": "arg_max(value, (ts, event_id))",
    "min": "min(value)",
    "max": "max(value)",
    "mean": "avg(value)",
    "std": "stddev_samp(value)",
    "count": "CAST(count(value) AS DOUBLE)",
    "median": "median(value)",
}


@query(
    "p1_landmark_stats",
    f"""{with_("ev", "base")}, {SQL_HOURS} SELECT h AS landmark, ev.pid, feature, {", ".join(f"round({sql}, 5) AS {k}" for k, sql in STATS.items())}
    FROM ev JOIN base USING (pid) JOIN hr ON epoch_us(ev.ts) - epoch_us(start_ts) <= round(h * 3600000000) GROUP BY 1, 2, 3""",
)
def p1(t):
    """All aggregates at all landmarks of the default schedule in one job."""
    return rounded(lm.landmark_stats(t.ev, t.base, HOURS), 5, tuple(STATS))


@query(
    "p1_landmark_dataset",
    f"""{with_("ev", "base")}, {SQL_HOURS}, a AS (SELECT h, ev.pid, feature, {", ".join(f"round({sql}, 5) AS s_{k}" for k, sql in STATS.items())} FROM ev JOIN base USING (pid) JOIN hr ON epoch_us(ev.ts) - epoch_us(start_ts) <= round(h * 3600000000) GROUP BY 1, 2, 3)
    SELECT hr.h AS landmark, base.pid, {", ".join(f'coalesce(max(s_{k}) FILTER (feature = {f!r}), 0) AS {f}_ev_{k}' for k in STATS for f in FEATURES)}
    FROM base CROSS JOIN hr LEFT JOIN a ON a.pid = base.pid AND a.h = hr.h GROUP BY 1, 2""",
)
def p1_dataset(t):
    """Every feature and aggregate at every landmark, one row per entity and landmark."""
    out = lm.landmark_dataset(t.ev, t.base, HOURS, FEATURES, "ev", tuple(STATS))
    return rounded(out, 5, tuple(c for c in out.columns if c not in ("landmark", "pid")))


@query(
    "p1_landmark_labels",
    f"""{with_("ev", "base")}, {SQL_HOURS} SELECT h AS landmark, ev.pid, feature AS value, count(*) AS n FROM ev JOIN base USING (pid) JOIN hr ON epoch_us(ev.ts) - epoch_us(start_ts) <= round(h * 3600000000) GROUP BY 1, 2, 3""",
)
def p1_labels(t):
    return lm.landmark_counts(t.ev.select("pid", "ts", F.col("feature").alias("value")), t.base, HOURS)


def labelled(t):
    """The landmark dataset of all features and aggregates, labels with a holdout, and the columns."""
    data = lm.landmark_dataset(t.ev, t.base, HOURS, FEATURES, "ev", tuple(STATS))
    label = t.ev.groupBy("pid").agg((F.max("value") > 250).cast("int").alias("label"))
    return data, stratified_holdout(label, "label", "pid", 0.2, 2024), [f"{f}_ev_{fn}" for fn in STATS for f in FEATURES]


@query("p2_out_of_fold")
def p2(t):
    """Out-of-fold and holdout scores at all landmarks from all features and aggregates (the learner's numbers have no SQL)."""
    data, labels, columns = labelled(t)
    return rounded(lm.out_of_fold(data, labels, HOURS, columns, scratch(t, "folds")))


@query("p2_kept_models")
def p2_kept(t):
    """Models fitted to two thirds of the users are kept, read again, and score the other third both ways."""
    data, labels, columns = labelled(t)
    path = scratch(t, "folds")
    lm.fit_landmarks(data, labels.filter("pid % 3 <> 0"), HOURS, columns, path)
    forest = lm.load_landmarks(t.spark, path)
    new = data.filter("pid % 3 = 0")
    both = [lm.score_landmarks(new, forest, use).withColumnRenamed("pred", f"pred_{use}") for use in ("all", "folds")]
    return rounded(both[0].join(both[1], ["landmark", "pid"]))


@query(
    "p3_prediction_channel",
    f"""{with_("base", "seg", "grid")}, {LAND_SQL}, c AS (SELECT pid, step, lo / 60.0 AS h FROM base, grid)
    SELECT c.pid, c.step, 'landmark_pred' AS feature, round(l.p, 6) AS value FROM c ASOF LEFT JOIN (SELECT * FROM lm WHERE p IS NOT NULL) l ON c.pid = l.pid AND c.h >= l.h""",
)
def p3(t):
    preds = landmarks(t).select("pid", F.col("h").alias("landmark"), F.col("p").alias("pred"))
    return rounded(lm.prediction_channel(t.base, preds))


LPRED = f"""{LAND_SQL}, lp AS MATERIALIZED (SELECT h AS landmark, p AS score, CAST(c_acctbal > 5000 AS INT) AS label FROM lm JOIN customer ON c_custkey = pid WHERE p IS NOT NULL), sz AS (SELECT landmark, count(*) AS n_samples FROM lp GROUP BY 1)"""


@query(
    "p4_landmark_metrics",
    f"WITH {LPRED} SELECT landmark, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, n_samples FROM {auc_sql('lp', ['landmark'])} JOIN {ap_sql('lp', ['landmark'])} USING (landmark) JOIN sz USING (landmark)",
)
def p4(t):
    """Metrics of landmark predictions by landmark."""
    label = t.customer.select(F.col("c_custkey").alias("pid"), (F.col("c_acctbal") > 5000).cast("int").alias("label"))
    rows = landmarks(t).filter(F.col("p").isNotNull()).join(label, "pid")
    out = ev.discrimination(rows.select(F.col("h").alias("landmark"), F.col("p").alias("score"), "label"), ["landmark"])
    return rounded(out.select("landmark", "auroc", "auprc", "n_samples"))


def split(t):
    rows = at_steps(t)
    return rows.filter(F.col("pid") % 4 != 0), rows.filter(F.col("pid") % 4 == 0)


@query("i13_posthoc_calibration")
def i13(t):
    """Isotonic and Platt calibration fitted on three quarters of the entities, judged on the rest."""
    return rounded(rc.compare_calibration(rc.recalibrate(*split(t))))


@query("i13_saved_calibrators")
def i13_saved(t):
    """Calibrators fitted, saved, read again, and the best of each step applied."""
    train, test = split(t)
    path = scratch(t, "calibrators")
    rc.fit_calibrators(train).write.mode("overwrite").parquet(path)
    best = rc.best_calibrators(t.spark.read.schema(rc.CALIBRATORS).parquet(path), test)
    return rounded(rc.apply_calibrators(test, best).select("pid", "step", "scope", "method", "label", "score", "calibrated"))
