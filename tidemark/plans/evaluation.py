"""Evaluation of predictions over time, survival metrics, paired tests, scores, attribution."""

from pyspark.sql import functions as F

from tidemark.functions import scores as sc
from tidemark.functions.timegrid import DEFAULT_GRID
from tidemark.operators import attribution as at
from tidemark.operators import evaluate as ev
from tidemark.operators import features as ft
from tidemark.operators import mapping as m
from tidemark.operators import quality as q
from tidemark.plans.cleaning import one_of, sql_one_of
from tidemark.plans.grid_and_mapping import FEATURES
from tidemark.plans.registry import query, rounded, with_

STEPS = [0, 5, 20, 40, 66, 80, 100, 115]

ENT = """en AS (SELECT doc_id AS pid, toxic AS label, CAST(n_chars % 116 + 1 AS INT) AS traj_len FROM labels JOIN documents USING (doc_id)),
    pr AS (SELECT pid, CAST(s AS INT) AS step, ((pid * 37 + s * 11) % 101 + 30 * label) / 131.0::DOUBLE AS pred FROM en, UNNEST(range(0, 116)) u(s) WHERE s < traj_len)"""
EVAL = f"""{ENT}, stp(step) AS (SELECT unnest({STEPS})),
    ef AS (SELECT pid, label, traj_len, stp.step, greatest(0, least(stp.step, traj_len - 1)) AS e FROM en, stp),
    rw AS MATERIALIZED (SELECT ef.pid, ef.label, ef.traj_len, CAST(ef.step AS INT) AS step, pred AS score FROM ef JOIN pr ON pr.pid = ef.pid AND pr.step = ef.e)"""


def entities(t):
    d = t.documents.select("doc_id", "n_chars")
    return t.labels.join(d, "doc_id").select(
        F.col("doc_id").alias("pid"), F.col("toxic").alias("label"), (F.col("n_chars") % 116 + 1).cast("int").alias("traj_len")
    )


def predictions(t):
    """A prediction per entity and step of its trajectory, with many ties."""
    e = entities(t).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("traj_len") - 1)))
    pred = ((F.col("pid") * 37 + F.col("step") * 11) % 101 + 30 * F.col("label")) / F.lit(131.0)
    return e.select("pid", "step", pred.alias("pred"))


def at_steps(t):
    return ev.at_effective_step(entities(t), predictions(t), STEPS)


@query(
    "i1_active_counts",
    f"WITH {ENT}, st AS (SELECT unnest(range(0, 116)) AS step) SELECT CAST(step AS INT) AS step, count(*) AS n_active, CAST(sum(label) AS BIGINT) AS n_positive FROM en, st WHERE traj_len > step GROUP BY 1",
)
def i1(t):
    return ev.active_counts(entities(t), list(range(116)))


@query("i2_effective_step", f"WITH {EVAL} SELECT pid, step, round(score, 6) AS score FROM rw")
def i2(t):
    return rounded(at_steps(t).select("pid", "step", "score"))


# AUROC by pair comparison, average precision by thresholds: written independently per (key)
def auc_sql(src, keys, score="score"):
    k = ", ".join(keys)
    using = f"USING ({k})"
    return f"""(SELECT {k}, avg(CASE WHEN a.{score} > b.{score} THEN 1.0 WHEN a.{score} = b.{score} THEN 0.5 ELSE 0 END) AS auroc
      FROM (SELECT * FROM {src} WHERE label = 1) a JOIN (SELECT * FROM {src} WHERE label = 0) b {using} GROUP BY ALL)"""


def ap_sql(src, keys, score="score"):
    k = ", ".join(keys)
    return f"""(SELECT {k}, sum(pos * tp / (tp + fp)) / nullif(any_value(np), 0) AS auprc FROM (SELECT {k}, {score}, pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {k}) AS np
      FROM (SELECT {k}, {score}, sum(label) AS pos, sum(1 - label) AS neg FROM {src} GROUP BY ALL) WINDOW w AS (PARTITION BY {k} ORDER BY {score} DESC ROWS UNBOUNDED PRECEDING)) GROUP BY ALL)"""


CI = """round(CASE WHEN auroc IS NOT NULL THEN greatest(auroc - 1.959963984540054 * sqrt((auroc / (2 - auroc) - auroc * auroc) / (n - p) + (2 * auroc * auroc / (1 + auroc) - auroc * auroc) / p), 0) END, 6) AS auroc_ci_lower,
      round(CASE WHEN auroc IS NOT NULL THEN least(auroc + 1.959963984540054 * sqrt((auroc / (2 - auroc) - auroc * auroc) / (n - p) + (2 * auroc * auroc / (1 + auroc) - auroc * auroc) / p), 1) END, 6) AS auroc_ci_upper"""
MODES = """rm AS MATERIALIZED (SELECT *, 'full' AS mode FROM rw UNION ALL SELECT *, 'active' FROM rw WHERE traj_len > step)"""
STEP_HOURS = "CASE step WHEN 0 THEN 10 WHEN 5 THEN 60 WHEN 20 THEN 210 WHEN 40 THEN 460 WHEN 66 THEN 1680 WHEN 80 THEN 6480 WHEN 100 THEN 21600 WHEN 115 THEN 43200 END / 60.0::DOUBLE"
METRICS = f"""{EVAL}, {MODES}, sz AS (SELECT mode, step, count(*) AS n, sum(label) AS p FROM rm GROUP BY 1, 2),
    mt AS (SELECT mode, step, auroc, auprc, n, p, {STEP_HOURS} AS time_hours, {CI} FROM sz LEFT JOIN {auc_sql("rm", ["mode", "step"])} USING (mode, step) LEFT JOIN {ap_sql("rm", ["mode", "step"])} USING (mode, step))"""


@query(
    "i3_metric_table",
    f"""WITH {METRICS} SELECT mode, step, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, CAST(p AS BIGINT) AS n_positive, n AS n_samples, auroc_ci_lower, auroc_ci_upper, round(time_hours, 6) AS time_hours FROM mt""",
)
def i3(t):
    """Full and active-only metrics at every evaluation step."""
    return rounded(ev.metric_table(entities(t), predictions(t), STEPS))


@query(
    "i4_auroc",
    f"""WITH {EVAL}, sz AS (SELECT step, count(*) AS n, sum(label) AS p FROM rw GROUP BY 1)
    SELECT step, round(auroc, 6) AS auroc, {CI} FROM {auc_sql("rw", ["step"])} JOIN sz USING (step)""",
)
def i4(t):
    return rounded(ev.discrimination(at_steps(t), ["step"]).select("step", "auroc", "auroc_ci_lower", "auroc_ci_upper"))


@query("i5_average_precision", f"WITH {EVAL} SELECT step, round(auprc, 6) AS auprc FROM {ap_sql('rw', ['step'])}")
def i5(t):
    return rounded(ev.discrimination(at_steps(t), ["step"]).select("step", "auprc"))


@query("i5_average_precision_ci")
def i5_ci(t):
    """Average precision with a bootstrap interval."""
    return rounded(ev.average_precision_ci(at_steps(t), ["step"]))


@query(
    "i6_curve_points",
    f"""WITH {EVAL}, g AS (SELECT step, score, sum(label) AS pos, sum(1 - label) AS neg FROM rw GROUP BY 1, 2)
    SELECT step, round(score, 6) AS threshold, round(sum(pos) OVER w / sum(pos) OVER k, 6) AS tpr, round(sum(neg) OVER w / sum(neg) OVER k, 6) AS fpr, round(sum(pos) OVER w / (sum(pos) OVER w + sum(neg) OVER w), 6) AS precision
    FROM g WINDOW w AS (PARTITION BY step ORDER BY score DESC ROWS UNBOUNDED PRECEDING), k AS (PARTITION BY step)""",
)
def i6(t):
    return rounded(ev.curve_points(at_steps(t), ["step"]))


@query(
    "i7_recall_at_top",
    f"""WITH {EVAL}, r AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY score DESC, pid DESC) AS r, count(*) OVER (PARTITION BY step) AS n FROM rw),
    p AS (SELECT *, unnest([5, 10, 15, 20, 25]) AS percent FROM r)
    SELECT step, percent, round(sum(CASE WHEN r <= greatest(1, ceil(n * percent / 100)) THEN label ELSE 0 END) / sum(label), 6) AS recall,
      count(*) FILTER (r <= greatest(1, ceil(n * percent / 100))) AS n_selected FROM p GROUP BY 1, 2""",
)
def i7(t):
    return rounded(ev.recall_at_top(at_steps(t), ["step"], [5, 10, 15, 20, 25]))


@query("i7_recall_at_top_ci")
def i7_ci(t):
    return rounded(ev.recall_at_top_ci(at_steps(t), ["step"], [5, 10, 15, 20, 25]))


@query(
    "i8_best_fbeta",
    f"""WITH {EVAL}, g AS (SELECT step, score, sum(label) AS pos, sum(1 - label) AS neg FROM rw GROUP BY 1, 2),
    c AS (SELECT step, score, sum(pos) OVER w / (sum(pos) OVER w + sum(neg) OVER w) AS pr, sum(pos) OVER w / sum(pos) OVER k AS re FROM g WINDOW w AS (PARTITION BY step ORDER BY score DESC ROWS UNBOUNDED PRECEDING), k AS (PARTITION BY step)),
    f AS (SELECT step, score, round(CASE WHEN 16 * pr + re > 0 THEN 17 * pr * re / (16 * pr + re) ELSE 0 END, 12) AS f FROM c)
    SELECT step, round(arg_max(score, (f, -score)), 6) AS threshold, round(max(f), 6) AS fbeta FROM f GROUP BY 1""",
)
def i8(t):
    return rounded(ev.best_fbeta(at_steps(t), ["step"], beta=4.0))


@query(
    "i9_confusion",
    f"""WITH {EVAL}, c AS (SELECT step, count(*) FILTER (score >= 0.6 AND label = 1) AS tp, count(*) FILTER (score >= 0.6 AND label = 0) AS fp, count(*) FILTER (score < 0.6 AND label = 0) AS tn, count(*) FILTER (score < 0.6 AND label = 1) AS fn FROM rw GROUP BY 1)
    SELECT *, round(tp / (tp + fn) * 100, 6) AS sensitivity, round(tn / (tn + fp) * 100, 6) AS specificity, round((tp + fn) / (tp + fp + tn + fn) * 100, 6) AS prevalence FROM c""",
)
def i9(t):
    return rounded(ev.confusion(at_steps(t), ["step"], 0.6))


@query(
    "i10_net_benefit",
    f"""WITH {EVAL}, th AS (SELECT i / 20.0::DOUBLE AS threshold FROM UNNEST(range(1, 20)) u(i)), n AS (SELECT step, threshold, count(*) AS n, sum(label) AS p, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp FROM rw, th GROUP BY 1, 2)
    SELECT step, round(threshold, 6) AS threshold, round(tp / n - fp / n * threshold / (1 - threshold), 6) AS nb_model, round(p / n - (1 - p / n) * threshold / (1 - threshold), 6) AS nb_all, 0.0::DOUBLE AS nb_none FROM n""",
)
def i10(t):
    return rounded(ev.net_benefit(at_steps(t), ["step"], [i / 20.0 for i in range(1, 20)]))


ECE = f"""WITH {EVAL}, b AS (SELECT *, CASE WHEN score <= 0 THEN 0 WHEN score <= 0.25 THEN 1 WHEN score <= 0.5 THEN 2 WHEN score <= 0.75 THEN 3 ELSE 4 END AS bin, count(*) OVER (PARTITION BY step) AS tot FROM rw),
    cb AS (SELECT step, bin, count(*) AS n, count(*) / any_value(tot) AS share, avg(score) AS confidence, avg(label) AS accuracy FROM b WHERE bin > 0 GROUP BY 1, 2)"""


@query(
    "i11_calibration_bins",
    f"{ECE} SELECT step, CAST(bin AS INT) AS bin, round(bin / 4, 6) AS bin_upper, n, round(share, 6) AS share, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy, round(confidence - accuracy, 6) AS error FROM cb",
)
def i11(t):
    return rounded(ev.calibration_bins(at_steps(t), ["step"]))


@query(
    "i11_calibration_error",
    f"""{ECE}, e AS (SELECT step, sum(abs(confidence - accuracy) * share) AS ece FROM cb GROUP BY 1) SELECT step, count(*) AS n, round(avg(score), 6) AS confidence, round(avg(label), 6) AS accuracy, round(any_value(ece), 6) AS ece FROM rw JOIN e USING (step) GROUP BY 1""",
)
def i11_ece(t):
    return rounded(ev.calibration_error(at_steps(t), ["step"]))


@query("i12_brier", f"WITH {EVAL} SELECT step, round(avg(pow(score - label, 2)), 6) AS brier FROM rw GROUP BY 1")
def i12(t):
    return rounded(ev.brier(at_steps(t), ["step"]))


@query(
    "i12_calibration_curve",
    f"""WITH {EVAL} SELECT step, CAST(CASE WHEN score <= 0.2 THEN 0 WHEN score <= 0.4 THEN 1 WHEN score <= 0.6 THEN 2 WHEN score <= 0.8 THEN 3 ELSE 4 END AS INT) AS bin, round(avg(label), 6) AS prob_true, round(avg(score), 6) AS prob_pred, count(*) AS n FROM rw GROUP BY 1, 2""",
)
def i12_curve(t):
    return rounded(ev.calibration_curve(at_steps(t), ["step"], 5))


# ---- survival ----------------------------------------------------------------------------

SUBJ = """su AS (SELECT o_custkey AS pid, CAST(least(date_diff('day', min(o_orderdate), max(o_orderdate)) // 25, 115) AS INT) AS time, CAST(count(*) % 3 = 0 AS INT) AS event, (o_custkey * 13 % 53) / 53.0::DOUBLE AS risk FROM orders GROUP BY 1),
    sv AS (SELECT pid, CAST(s AS INT) AS step, pow(1 - risk / 40, s + 1) AS survival FROM su, UNNEST(range(0, 116)) u(s))"""


def subjects(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("pid")).agg(
        F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"), F.count("*").alias("n")
    )
    return o.select(
        "pid",
        F.least(F.floor(F.datediff("b", "a") / 25), F.lit(115)).cast("int").alias("time"),
        (F.col("n") % 3 == 0).cast("int").alias("event"),
        (F.col("pid") * 13 % 53 / F.lit(53.0)).alias("risk"),
    )


def survival_curves(t, steps):
    rows = subjects(t).withColumn("step", F.explode(F.lit(steps)))
    return rows.select("pid", "step", F.pow(1 - F.col("risk") / 40, F.col("step") + 1).alias("survival"))


@query(
    "i14_concordance",
    f"""WITH {SUBJ} SELECT round(avg(CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0 END), 6) AS cindex, count(*) AS n_pairs FROM (SELECT * FROM su WHERE event = 1) a JOIN su b ON b.time > a.time""",
)
def i14(t):
    return rounded(ev.concordance(subjects(t)))


@query("i14_concordance_ci")
def i14_ci(t):
    return rounded(ev.concordance_ci(subjects(t)))


@query(
    "i15_time_dependent_auc",
    f"""WITH {SUBJ}, x AS (SELECT *, unnest([0, 20, 60, 90]) AS eval_step FROM su), y AS (SELECT eval_step, risk AS score, CAST(time <= eval_step AND event = 1 AS INT) AS label FROM x WHERE event = 1 OR time > eval_step),
    n AS (SELECT eval_step, count(*) AS n FROM y GROUP BY 1)
    SELECT CAST(n.eval_step AS INT) AS eval_step, round(CASE WHEN n.n >= 10 AND auroc IS NOT NULL THEN auroc ELSE 0.5 END, 6) AS auc, n.n FROM n LEFT JOIN {auc_sql("y", ["eval_step"])} USING (eval_step)""",
)
def i15(t):
    return rounded(ev.time_dependent_auc(subjects(t), [0, 20, 60, 90]))


@query(
    "i16_survival_brier",
    f"""WITH {SUBJ}, b AS (SELECT time, count(*) AS n, sum(event) AS d, sum(1 - event) AS c FROM su GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS rs FROM b),
    g AS (SELECT time, product(CASE WHEN rs - d > 0 THEN 1 - c / (rs - d) ELSE 1 END) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING) AS g FROM r),
    x AS (SELECT su.*, unnest([20, 60, 90]) AS eval_step FROM su), j AS (SELECT x.*, g.g AS go, coalesce((SELECT max_by(g2.g, g2.time) FROM g g2 WHERE g2.time <= x.eval_step), 1) AS ga, survival AS s FROM x JOIN g ON g.time = x.time JOIN sv ON sv.pid = x.pid AND sv.step = x.eval_step)
    SELECT CAST(eval_step AS INT) AS eval_step, round(avg(CASE WHEN time <= eval_step AND event = 1 AND go > 0 THEN s * s / go WHEN time > eval_step AND ga > 0 THEN (1 - s) * (1 - s) / ga ELSE 0 END), 6) AS brier FROM j GROUP BY 1""",
)
def i16(t):
    return rounded(ev.survival_brier(subjects(t).drop("risk"), survival_curves(t, [20, 60, 90]), [20, 60, 90]))


@query(
    "i17_d_calibration",
    f"""WITH {SUBJ}, x AS (SELECT su.*, survival AS s FROM su JOIN sv USING (pid) WHERE step = 80)
    SELECT CAST(least(floor(s * 10) + 1, 10) AS INT) AS bin, count(*) AS n, round(avg(s), 6) AS predicted, round(1 - avg(CAST(time <= 80 AND event = 1 AS INT)), 6) AS observed FROM x GROUP BY 1 HAVING count(*) >= 5""",
)
def i17(t):
    rows = subjects(t).join(survival_curves(t, [80]).select("pid", "survival"), "pid")
    return rounded(ev.d_calibration(rows, 80))


# ---- paired tests ------------------------------------------------------------------------

TWO = f"""{EVAL}, tw AS MATERIALIZED (SELECT *, ((pid * 17 + step) % 47 + 20 * label) / 67.0::DOUBLE AS b FROM rw),
    pl AS (SELECT x.step, x.pid, 1 AS cls, avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END) AS va, avg(CASE WHEN x.b > y.b THEN 1.0 WHEN x.b = y.b THEN 0.5 ELSE 0 END) AS vb
      FROM tw x JOIN tw y ON x.step = y.step AND x.label = 1 AND y.label = 0 GROUP BY 1, 2
      UNION ALL SELECT y.step, y.pid, 0, avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END), avg(CASE WHEN x.b > y.b THEN 1.0 WHEN x.b = y.b THEN 0.5 ELSE 0 END)
      FROM tw x JOIN tw y ON x.step = y.step AND x.label = 1 AND y.label = 0 GROUP BY 1, 2),
    mo AS (SELECT step, cls, avg(va) AS a, avg(vb) AS b, (var_samp(va) + var_samp(vb) - 2 * covar_samp(va, vb)) / count(*) AS v, count(*) AS n FROM pl GROUP BY 1, 2),
    dl AS (SELECT p.step, p.a AS auc_a, p.b AS auc_b, sqrt(p.v + q.v) AS se_diff, (p.a - p.b) / sqrt(p.v + q.v) AS z, p.n + q.n AS n FROM mo p JOIN mo q ON p.step = q.step AND p.cls = 1 AND q.cls = 0)"""


def two_scores(t):
    b = ((F.col("pid") * 17 + F.col("step")) % 47 + 20 * F.col("label")) / F.lit(67.0)
    return at_steps(t).withColumnRenamed("score", "a").withColumn("b", b)


@query(
    "i18_delong",
    f"WITH {TWO} SELECT step, round(auc_a, 6) AS auc_a, round(auc_b, 6) AS auc_b, round(z, 5) AS z, round(se_diff, 6) AS se_diff, n FROM dl",
)
def i18(t):
    out = ev.delong(two_scores(t), ["step"], "a", "b").withColumn("z", F.round("z", 5))
    return rounded(out.drop("p"))


@query(
    "i19_benjamini_hochberg",
    """WITH t AS (SELECT p_brand AS grp, p_partkey AS id, (p_partkey * 7919 % 1009) / 1009.0::DOUBLE * (p_partkey * 31 % 97) / 97.0::DOUBLE AS p FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p, id) AS r, count(*) OVER (PARTITION BY grp) AS n FROM t),
    a AS (SELECT *, min(least(p * n / r, 1)) OVER (PARTITION BY grp ORDER BY p DESC, id DESC ROWS UNBOUNDED PRECEDING) AS q FROM r)
    SELECT grp, id, round(p, 6) AS p, round(q, 6) AS p_adjusted, q <= 0.3 AS rejected FROM a""",
)
def i19(t):
    k = F.col("p_partkey")
    tests = t.part.select(F.col("p_brand").alias("grp"), k.alias("id"), (k * 7919 % 1009 / F.lit(1009.0) * (k * 31 % 97) / F.lit(97.0)).alias("p"))
    return rounded(ev.benjamini_hochberg(tests, ["grp"], "p", ["id"], alpha=0.3))


CMP = f"""{EVAL}, scs AS (SELECT pid, 'first' AS name, CASE WHEN pid % 4 <> 0 THEN ((pid * 7) % 23)::DOUBLE + 4 * label END AS v FROM en UNION ALL SELECT pid, 'second', CASE WHEN pid % 3 <> 0 THEN -1 * ((pid * 5) % 19)::DOUBLE END FROM en),
    cx AS MATERIALIZED (SELECT name, step, pid, label, score, v FROM rw JOIN scs USING (pid) WHERE traj_len > step AND v IS NOT NULL),
    cn AS (SELECT name, step, count(*) AS n_samples, CAST(sum(label) AS BIGINT) AS n_positive FROM cx GROUP BY 1, 2 HAVING count(*) >= 10 AND min(label) <> max(label))"""


@query(
    "i20_score_comparison",
    f"""WITH {CMP} SELECT cn.name, cn.step, n_samples, n_positive, round(s.auroc, 6) AS score_auroc, round(sp.auprc, 6) AS score_auprc, round(mm.auroc, 6) AS model_auroc, round(mp.auprc, 6) AS model_auprc
    FROM cn JOIN {auc_sql("cx", ["name", "step"], "v")} s USING (name, step) JOIN {ap_sql("cx", ["name", "step"], "v")} sp USING (name, step) JOIN {auc_sql("cx", ["name", "step"])} mm USING (name, step) JOIN {ap_sql("cx", ["name", "step"])} mp USING (name, step)""",
)
def i20(t):
    """Two static scores against the predictions on the same active entities."""
    return rounded(compared(t).select("name", "step", "n_samples", "n_positive", "score_auroc", "score_auprc", "model_auroc", "model_auprc"))


def compared(t):
    e = entities(t)
    p, y = F.col("pid"), F.col("label")
    scores = e.select(
        "pid",
        F.when(p % 4 != 0, (p * 7 % 23).cast("double") + 4 * y).alias("first"),
        F.when(p % 3 != 0, (p * 5 % 19).cast("double")).alias("second"),
    )
    return ev.compare_scores(e, scores, predictions(t), STEPS, {"first": False, "second": True})


@query("i20_score_comparison_tests")
def i20_tests(t):
    """The paired tests of the comparison with adjusted p-values."""
    return rounded(compared(t).select("name", "step", "z", "p", "p_adjusted", "rejected"))


@query(
    "i21_class_distribution",
    f"""WITH {EVAL} SELECT step, label, round(quantile_cont(score, 0.25), 6) AS q25, round(median(score), 6) AS median, round(quantile_cont(score, 0.75), 6) AS q75, count(*) AS n, round(avg(score), 6) AS mean FROM rw GROUP BY 1, 2""",
)
def i21(t):
    return rounded(ev.by_class_quantiles(at_steps(t), ["step"]))


@query(
    "i22_report_table",
    f"""WITH {METRICS}, k(h, time) AS (VALUES (1.0::DOUBLE, '1 h'), (3, '3 h'), (6, '6 h'), (12, '12 h'), (24, '24 h'), (48, '48 h'), (72, '72 h'), (168, '7 days'), (336, '14 days'), (720, '30 days'), (1440, '60 days'), (2160, '90 days')),
    nr AS (SELECT h, time, mode, arg_min(printf('%.3f [%.3f–%.3f]', auroc, auroc_ci_lower, auroc_ci_upper), (abs(time_hours - h), step)) AS txt, arg_min(n, (abs(time_hours - h), step)) AS n FROM k JOIN mt ON abs(time_hours - h) <= 1.5 AND auroc IS NOT NULL GROUP BY 1, 2, 3)
    SELECT h AS hours, time, coalesce(max(txt) FILTER (mode = 'full'), '—') AS auroc_full, coalesce(max(txt) FILTER (mode = 'active'), '—') AS auroc_active, max(n) FILTER (mode = 'full') AS n_full, max(n) FILTER (mode = 'active') AS n_active FROM nr GROUP BY 1, 2""",
)
def i22(t):
    return ev.report_table(ev.metric_table(entities(t), predictions(t), STEPS))


def altered_cells(t):
    a = m.map_concept(t.ev, t.base, ["mean"]).withColumnRenamed("mean", "value")
    shift = F.when(F.col("step") % 17 == 2, 0.5).when(F.col("step") % 11 == 1, 0.001).otherwise(0.0)
    return a, a.filter(F.col("step") % 37 != 4).withColumn("value", F.col("value") + shift)


PAIR = f"""{with_("ev", "base", "seg", "grid", "mapped")}, a AS (SELECT pid, step, feature, avg(value) AS va FROM mapped GROUP BY 1, 2, 3),
    b AS (SELECT pid, step, feature, va + CASE WHEN step % 17 = 2 THEN 0.5 WHEN step % 11 = 1 THEN 0.001 ELSE 0 END AS vb FROM a WHERE step % 37 <> 4),
    j AS (SELECT step, abs(va - vb) AS d FROM a FULL JOIN b USING (pid, step, feature))"""


@query(
    "i23_pipeline_consistency",
    f"""{PAIR} SELECT step, count(*) AS n, count(*) FILTER (d IS NULL) AS n_one_sided, count(*) FILTER (d <= 0.01) AS n_within, round(max(d), 6) AS max_diff, round(avg(d), 6) AS mean_diff,
      CASE WHEN count(*) FILTER (d <= 0.01) = count(*) THEN 'PASS' ELSE 'FAIL' END AS status FROM j GROUP BY 1""",
)
def i23(t):
    a, b = altered_cells(t)
    return rounded(q.compare_pipelines(a, b, m.CELL, "value", 0.01, ["step"]))


@query(
    "i23_largest_differences",
    f"""{with_("ev")}, a AS (SELECT pid, feature, sum(value) AS a FROM ev GROUP BY 1, 2), b AS (SELECT pid, feature, sum(value) AS b FROM ev WHERE k <> 50 GROUP BY 1, 2)
    SELECT pid, feature, round(a, 4) AS a, round(b, 4) AS b, round(abs(a - b), 4) AS diff FROM a JOIN b USING (pid, feature) ORDER BY abs(a - b) DESC, pid, feature LIMIT 20""",
)
def i23_top(t):
    a = t.ev.groupBy("pid", "feature").agg(F.sum("value").alias("value"))
    b = t.ev.filter(F.col("k") != 50).groupBy("pid", "feature").agg(F.sum("value").alias("value"))
    return rounded(q.largest_differences(a, b, ["pid", "feature"], "value", 20), 4)


AUD = f"""{EVAL}, au AS MATERIALIZED (SELECT 'raw' AS source, step AS hour, score, label FROM rw UNION ALL SELECT 'halved', step, round(score / 2, 2), label FROM rw UNION ALL SELECT 'inverted', step, -1 * score, label FROM rw),
    an AS (SELECT source, hour, count(*) AS n_samples FROM au GROUP BY 1, 2)"""


@query(
    "i24_signal_audit",
    f"""WITH {AUD} SELECT source, hour, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, n_samples FROM {auc_sql("au", ["source", "hour"])} JOIN {ap_sql("au", ["source", "hour"])} USING (source, hour) JOIN an USING (source, hour)""",
)
def i24(t):
    rows = at_steps(t).withColumn("hour", F.col("step"))
    forms = {
        "raw": rows,
        "halved": rows.withColumn("score", F.round(F.col("score") / 2, 2)),
        "inverted": rows.withColumn("score", -F.col("score")),
    }
    return rounded(ev.signal_audit(forms))


@query(
    "i25_early_coverage",
    f"""{with_("ev", "base", "seg", "grid", "mapped")}, a AS (SELECT pid, step, feature, avg(CASE WHEN k % 7 = 0 THEN 0 ELSE value END) AS v FROM mapped GROUP BY 1, 2, 3), h(h) AS (VALUES (1.0::DOUBLE), (6), (24), (240)),
    c AS (SELECT h, max(step) AS last FROM h, grid WHERE lo / 60.0 <= h GROUP BY 1), n AS (SELECT count(DISTINCT pid) AS n FROM ev)
    SELECT feature, h AS hour, round(count(DISTINCT pid) * 100.0 / any_value(n), 6) AS pct_entities, round(avg(v), 6) AS mean_value FROM a JOIN c ON step <= last, n WHERE v <> 0 GROUP BY 1, 2 HAVING count(DISTINCT pid) * 100.0 / any_value(n) >= 5""",
)
def i25(t):
    rows = t.ev.withColumn("value", F.when(F.col("k") % 7 == 0, 0.0).otherwise(F.col("value")))
    cells = m.map_concept(rows, t.base, ["mean"]).withColumnRenamed("mean", "value")
    return rounded(ev.early_coverage(cells, t.base.agg(F.count("*").alias("n")), [1, 6, 24, 240]))


@query(
    "i26_interval_ranges",
    f"""WITH {METRICS}, x AS (SELECT *, CASE WHEN time_hours >= 72 THEN 'late' WHEN time_hours >= 6 THEN 'middle' WHEN time_hours >= 0 THEN 'early' END AS interval FROM mt)
    SELECT mode, interval, round(min(auroc), 6) AS auroc_min, round(max(auroc), 6) AS auroc_max, round(min(auprc), 6) AS auprc_min, round(max(auprc), 6) AS auprc_max FROM x GROUP BY 1, 2""",
)
def i26(t):
    table = ev.metric_table(entities(t), predictions(t), STEPS)
    return rounded(ev.interval_ranges(table, [("early", 0, 6), ("middle", 6, 72), ("late", 72, None)]))


@query(
    "d8_step_labels",
    f"""{with_("ev", "base", "seg", "grid", "mapped")}
    SELECT event_id, CASE WHEN hi < 60 THEN hi || ' min' WHEN hi < 1440 THEN CASE WHEN hi % 60 = 0 THEN CAST(hi // 60 AS VARCHAR) ELSE CAST(hi / 60 AS VARCHAR) END || ' h'
      ELSE CASE WHEN hi % 1440 = 0 THEN CAST(hi // 1440 AS VARCHAR) ELSE CAST(hi / 1440 AS VARCHAR) END || CASE WHEN hi = 1440 THEN ' day' ELSE ' days' END END AS label
    FROM mapped JOIN grid USING (step)""",
)
def d8_labels(t):
    """Readable time of every event's step."""
    return m.point_to_step(t.ev, t.base).select("event_id", ev.step_label(F.col("step")).alias("label"))


# ---- clinical scores ---------------------------------------------------------------------

MECH = ["blunt", "Penetrating", "p", "unknown", "B"]
VIT = f"""vv AS (SELECT o_orderkey AS pid, CASE WHEN o_orderkey % 19 <> 0 THEN (o_custkey % 16)::DOUBLE END AS gcs, (o_orderkey * 7 % 140)::DOUBLE AS sbp, (o_orderkey * 3 % 45)::DOUBLE AS rr,
      (o_custkey % 76)::DOUBLE AS sev, CASE WHEN o_orderkey % 23 <> 0 THEN (o_orderkey % 95)::INT END AS age, {sql_one_of(MECH, "o_orderkey")} AS mech FROM orders),
    cd AS (SELECT *, CASE WHEN gcs >= 13 THEN 4 WHEN gcs >= 9 THEN 3 WHEN gcs >= 6 THEN 2 WHEN gcs >= 4 THEN 1 ELSE 0 END AS g, CASE WHEN sbp > 89 THEN 4 WHEN sbp >= 76 THEN 3 WHEN sbp >= 50 THEN 2 WHEN sbp >= 1 THEN 1 ELSE 0 END AS s,
      CASE WHEN rr BETWEEN 10 AND 29 THEN 4 WHEN rr >= 30 THEN 3 WHEN rr >= 6 THEN 2 WHEN rr >= 1 THEN 1 ELSE 0 END AS r FROM vv),
    rt AS (SELECT *, CASE WHEN gcs IS NOT NULL THEN CAST(0.9368 * g + 0.7326 * s + 0.2908 * r AS DOUBLE) END AS rts, CASE WHEN gcs IS NOT NULL THEN CAST(g + s + r AS DOUBLE) END AS plain FROM cd),
    ts AS (SELECT *, CASE WHEN lower(mech) IN ('blunt', 'b', 'blunt_tr') THEN -0.4499 + 0.8085 * rts - 0.0835 * sev - 1.743 * CAST(age >= 55 AS INT)
      WHEN lower(mech) IN ('penetrating', 'p', 'pen') THEN -2.5355 + 0.9934 * rts - 0.0651 * sev - 1.136 * CAST(age >= 55 AS INT) END AS b FROM rt)"""


def patients(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        k.alias("pid"),
        F.when(k % 19 != 0, (c % 16).cast("double")).alias("gcs"),
        (k * 7 % 140).cast("double").alias("sbp"),
        (k * 3 % 45).cast("double").alias("rr"),
        (c % 76).cast("double").alias("sev"),
        F.when(k % 23 != 0, (k % 95).cast("int")).alias("age"),
        one_of(MECH, k).alias("mech"),
    )


@query("n1_physiologic_score", f"WITH {VIT} SELECT pid, round(rts, 6) AS weighted, plain FROM rt")
def n1(t):
    weighted, plain = sc.physiologic_score(F.col("gcs"), F.col("sbp"), F.col("rr"))
    return rounded(patients(t).select("pid", weighted.alias("weighted"), plain.alias("plain")))


@query("n2_survival_probability", f"WITH {VIT} SELECT pid, round(1 / (1 + exp(-b)), 6) AS survival FROM ts")
def n2(t):
    weighted, _ = sc.physiologic_score(F.col("gcs"), F.col("sbp"), F.col("rr"))
    return rounded(patients(t).select("pid", sc.survival_probability(weighted, F.col("sev"), F.col("age"), F.col("mech")).alias("survival")))


@query(
    "n3_mechanism",
    """SELECT l_orderkey, l_linenumber, CASE WHEN (l_quantity > 45) OR (l_linenumber % 5 = 2) THEN 'penetrating' ELSE 'blunt' END AS mechanism FROM lineitem""",
)
def n3(t):
    rows = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_quantity") > 45, F.col("l_quantity")).cast("string").alias("ai60"),
        F.col("l_quantity").cast("string").alias("ai10"),
        one_of(["Fall", "MVT", "cut/Pierce wound", "Fire", "Burn"], F.col("l_linenumber")).alias("major1"),
    )
    return rows.select("l_orderkey", "l_linenumber", sc.mechanism(rows, ["ai60", "ai10"], ["major1"]).alias("mechanism"))


FIRST = """fv AS (SELECT pid, coalesce(arg_min(value / 30, (ts, event_id)) FILTER (feature = 'click'), 0) AS g, coalesce(arg_min(value * 2, (ts, event_id)) FILTER (feature = 'view'), 0) AS s, coalesce(arg_min(value / 4, (ts, event_id)) FILTER (feature = 'error'), 0) AS r FROM ev GROUP BY 1),
    sv AS (SELECT c_custkey AS pid, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 60)::DOUBLE END AS riss, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 70)::DOUBLE END AS niss, c_mktsegment AS seg, (c_custkey % 95)::INT AS age FROM customer),
    x AS (SELECT sv.*, nullif(g, 0) AS g, nullif(s, 0) AS s, nullif(r, 0) AS r, greatest(riss, niss) AS severity, CASE WHEN seg = 'MACHINERY' THEN 'penetrating' ELSE 'blunt' END AS mechanism FROM sv LEFT JOIN fv USING (pid)),
    y AS (SELECT *, CASE WHEN g IS NOT NULL AND s IS NOT NULL AND r IS NOT NULL THEN 0.9368 * CASE WHEN g >= 13 THEN 4 WHEN g >= 9 THEN 3 WHEN g >= 6 THEN 2 WHEN g >= 4 THEN 1 ELSE 0 END + 0.7326 * CASE WHEN s > 89 THEN 4 WHEN s >= 76 THEN 3 WHEN s >= 50 THEN 2 WHEN s >= 1 THEN 1 ELSE 0 END
      + 0.2908 * CASE WHEN r BETWEEN 10 AND 29 THEN 4 WHEN r >= 30 THEN 3 WHEN r >= 6 THEN 2 WHEN r >= 1 THEN 1 ELSE 0 END END AS rts FROM x),
    z AS (SELECT *, 1 - 1 / (1 + exp(-(CASE WHEN mechanism = 'blunt' THEN -0.4499 + 0.8085 * rts - 0.0835 * severity - 1.743 * CAST(age >= 55 AS INT) ELSE -2.5355 + 0.9934 * rts - 0.0651 * severity - 1.136 * CAST(age >= 55 AS INT) END))) AS death FROM y)"""


def scored(t):
    ev_ = t.ev.filter(F.col("feature").isin("click", "view", "error"))
    scale = F.when(F.col("feature") == "click", F.col("value") / 30).when(F.col("feature") == "view", F.col("value") * 2).otherwise(F.col("value") / 4)
    first = ft.numeric_features(ev_.withColumn("value", scale), ["click", "view", "error"], "v", ["first"])
    vitals = first.select(
        "pid", F.col("click_v_first").alias("first_GCS"), F.col("view_v_first").alias("first_SBP"), F.col("error_v_first").alias("first_RR")
    )
    k = F.col("c_custkey")
    statics = t.customer.select(
        k.alias("pid"),
        (k % 95).cast("int").alias("age"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "Firearm").otherwise(F.col("c_mktsegment")).alias("cause"),
    )
    sev = t.customer.select(k.alias("pid"), F.when(k % 2 == 0, (k % 60).cast("double")).alias("riss"), F.when(k % 3 == 0, (k % 70).cast("double")).alias("niss"))
    return sc.score_table(vitals, sev, statics, ["riss", "niss"], ["cause"])


@query(
    "n4_score_table",
    f"{with_('ev')}, {FIRST} SELECT pid, mechanism, severity, round(CAST(rts AS DOUBLE), 6) AS physiology, round(death, 6) AS death_prob FROM z",
)
def n4(t):
    return rounded(scored(t).select("pid", "mechanism", "severity", "physiology", "death_prob"))


@query(
    "n4_score_coverage",
    f"""{with_("ev")}, {FIRST}, c AS (SELECT count(*) AS n, count(rts) AS a, count(severity) AS b, count(death) AS d FROM z)
    SELECT 'physiology' AS score, a AS n_valid, n, round(a * 100.0 / n, 6) AS pct FROM c UNION ALL SELECT 'severity', b, n, round(b * 100.0 / n, 6) FROM c UNION ALL SELECT 'death_prob', d, n, round(d * 100.0 / n, 6) FROM c""",
)
def n4_coverage(t):
    return rounded(sc.coverage(scored(t), ["physiology", "severity", "death_prob"]))


# ---- attribution -------------------------------------------------------------------------

ATTR = """atr AS MATERIALIZED (SELECT vec_id AS pid, label % 4 AS timeframe, CAST((p - 1) % 16 AS INT) AS channel, CAST((p - 1) // 16 AS INT) AS step, CAST(embedding[p] AS DOUBLE) AS value FROM embeddings, UNNEST(range(1, 65)) u(p))"""


def attribution(t):
    e = t.embeddings.select(F.col("vec_id").alias("pid"), (F.col("label") % 4).alias("timeframe"), F.posexplode("embedding").alias("p", "v"))
    return e.select("pid", "timeframe", (F.col("p") % 16).cast("int").alias("channel"), F.floor(F.col("p") / 16).cast("int").alias("step"), F.col("v").cast("double").alias("value"))


def imp_sql(axis):
    return f"SELECT timeframe, {axis}, avg(v) AS mean, stddev_pop(v) AS std, count(*) AS n_entities FROM (SELECT timeframe, pid, {axis}, avg(abs(value)) AS v FROM atr GROUP BY 1, 2, 3) GROUP BY 1, 2"


@query("o1_channel_importance", f"WITH {ATTR} SELECT timeframe, channel, round(mean, 6) AS mean, round(std, 6) AS std, n_entities FROM ({imp_sql('channel')})")
def o1(t):
    return rounded(at.importance(attribution(t), "channel"))


@query("o1_step_importance", f"WITH {ATTR} SELECT timeframe, step, round(mean, 6) AS mean, round(std, 6) AS std, n_entities FROM ({imp_sql('step')})")
def o1_step(t):
    return rounded(at.importance(attribution(t), "step"))


@query(
    "o1_category_importance",
    f"""WITH {ATTR}, c AS (SELECT timeframe, pid, 'c' || channel // 4 AS category, avg(abs(value)) AS v FROM atr GROUP BY 1, 2, 3) SELECT timeframe, category, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(*) AS n_entities FROM c GROUP BY 1, 2""",
)
def o1_category(t):
    rows = attribution(t).withColumn("category", F.concat(F.lit("c"), F.floor(F.col("channel") / 4).cast("string")))
    return rounded(at.importance(rows, "category"))


@query("o1_entity_counts", f"WITH {ATTR} SELECT timeframe, count(DISTINCT pid) AS n_entities FROM atr GROUP BY 1")
def o1_counts(t):
    return at.entity_counts(attribution(t))


SHARE = "SELECT {k}, avg(a) AS group_total, avg(b) AS rest_total FROM (SELECT {k}, pid, sum(abs(value)) FILTER (channel < 3) AS a, sum(abs(value)) FILTER (channel >= 3) AS b FROM atr GROUP BY ALL) GROUP BY ALL"


@query(
    "o2_group_share",
    f"WITH {ATTR}, s AS ({SHARE.format(k='timeframe')}) SELECT timeframe, round(group_total, 6) AS group_total, round(rest_total, 6) AS rest_total, round(group_total / (group_total + rest_total) * 100, 6) AS group_pct, round(rest_total / (group_total + rest_total) * 100, 6) AS rest_pct FROM s",
)
def o2(t):
    return rounded(at.group_share(attribution(t), F.col("channel") < 3))


@query(
    "o2_group_share_by_step",
    f"WITH {ATTR}, s AS ({SHARE.format(k='timeframe, step')}) SELECT timeframe, step, round(group_total, 6) AS group_total, round(rest_total, 6) AS rest_total, round(group_total / (group_total + rest_total) * 100, 6) AS group_pct, round(rest_total / (group_total + rest_total) * 100, 6) AS rest_pct FROM s",
)
def o2_step(t):
    return rounded(at.group_share(attribution(t), F.col("channel") < 3, by_step=True))


@query(
    "o3_stability",
    f"""WITH {ATTR}, im AS MATERIALIZED ({imp_sql("channel")}), r AS (SELECT *, rank() OVER (PARTITION BY timeframe ORDER BY mean) AS r, row_number() OVER (PARTITION BY timeframe ORDER BY mean DESC, channel DESC) AS d FROM im)
    SELECT a.timeframe AS t1, b.timeframe AS t2, round(corr(a.r, b.r), 5) AS spearman, round(corr(a.mean, b.mean), 5) AS pearson,
      {", ".join(f"round(count(*) FILTER (a.d <= {k} AND b.d <= {k}) / count(*) FILTER (a.d <= {k} OR b.d <= {k}), 5) AS jaccard_{k}" for k in (5, 10, 20))}
    FROM r a JOIN r b USING (channel) GROUP BY 1, 2""",
)
def o3(t):
    return rounded(at.stability(attribution(t)), 5)


@query(
    "o4_top_channels",
    f"""WITH {ATTR}, im AS ({imp_sql("channel")}), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY timeframe ORDER BY mean DESC, channel) AS INT) AS rank FROM im)
    SELECT timeframe, channel, round(mean, 6) AS mean, n_entities, round(std / sqrt(n_entities), 6) AS sem, rank FROM r WHERE rank <= 15""",
)
def o4(t):
    return rounded(at.top_channels(attribution(t)))


@query(
    "o4_timeframe_summary",
    f"""WITH {ATTR}, im AS MATERIALIZED ({imp_sql("channel")}), r AS (SELECT *, row_number() OVER (PARTITION BY timeframe ORDER BY mean DESC, channel) AS rank FROM im), s AS ({SHARE.format(k="timeframe")})
    SELECT timeframe, string_agg(CAST(channel AS VARCHAR), ', ' ORDER BY rank) FILTER (rank <= 5) AS top5, round(avg(mean), 6) AS mean, round(max(mean), 6) AS max, round(any_value(group_total / (group_total + rest_total)) * 100, 6) AS group_pct,
      round(any_value(rest_total / (group_total + rest_total)) * 100, 6) AS rest_pct FROM r JOIN s USING (timeframe) GROUP BY 1""",
)
def o4_summary(t):
    return rounded(at.timeframe_summary(attribution(t), F.col("channel") < 3))


@query(
    "o5_change_between",
    f"""WITH {ATTR}, s AS (SELECT channel, coalesce(sum(abs(value)) FILTER (timeframe = 0), 0) AS "before", coalesce(sum(abs(value)) FILTER (timeframe = 1), 0) AS "after" FROM atr WHERE timeframe IN (0, 1) GROUP BY 1)
    SELECT channel, round("before", 5) AS "before", round("after", 5) AS "after", round("after" - "before", 5) AS change FROM s ORDER BY abs("after" - "before") DESC, channel LIMIT 10""",
)
def o5(t):
    return rounded(at.change_between(attribution(t), 0, 1, 10), 5)
