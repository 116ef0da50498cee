"""Time-dependent evaluation of predictions, all steps in one job.

Rank statistics never sort a step in one task: equal scores are counted first (map-side),
then a sliced running count over the score gives every threshold its true and false positives.

``rows(keys…, score, label)``; keys are e.g. ``["step"]`` or ``["mode", "step"]``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import two_sided_p
from tidemark.functions.timegrid import DEFAULT_GRID, Grid
from tidemark.operators.quantiles import group_quantiles
from tidemark.operators.sliced import Scan, sliced_scan, value_slice
from tidemark.session import cut_lineage

Z95 = 1.959963984540054


# ---- schedules and alignment -------------------------------------------------------------


def schedule_minutes(grid: Grid = DEFAULT_GRID, cut_hours: int = 72) -> list[int]:
    """Hourly up to the cut, then daily up to the horizon."""
    first_day = -(-cut_hours // 24) + 1
    return [60 * h for h in range(1, cut_hours + 1)] + [1440 * d for d in range(first_day, grid.max_days + 1)]


def schedule_steps(grid: Grid = DEFAULT_GRID, cut_hours: int = 72) -> Column:
    """The schedule as a literal array of distinct steps."""
    steps = F.transform(F.lit(schedule_minutes(grid, cut_hours)), lambda m: grid.time_to_step(m))
    return F.array_distinct(F.array_compact(steps))


def step_label(step: Column, grid: Grid = DEFAULT_GRID) -> Column:
    """Readable time of a step: minutes below an hour, hours below a day, else days."""
    minutes = grid.step_to_time(step).cast("double")

    def plain(x: Column) -> Column:
        return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))

    hours, days = minutes / 60, minutes / 1440
    text = F.when(minutes < 60, F.concat(F.floor(minutes).cast("string"), F.lit(" min")))
    text = text.when(minutes < 1440, F.concat(plain(hours), F.lit(" h")))
    unit = F.when(days == 1, " day").otherwise(" days")
    text = text.otherwise(F.concat(plain(days), unit))
    return F.when(minutes.isNull(), F.concat(F.lit("Step "), step.cast("string"))).otherwise(text)


def active_counts(entities: DataFrame, steps: list[int]) -> DataFrame:
    """Entities with ``traj_len > step`` and positives among them per step.

    Lengths take few values: they are counted first, then the steps are exploded over the counts.
    """
    by_len = entities.groupBy("traj_len").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    hit = by_len.withColumn("step", F.explode(F.lit(steps))).filter(F.col("traj_len") > F.col("step"))
    return hit.groupBy("step").agg(F.sum("n").alias("n_active"), F.sum("p").alias("n_positive"))


def at_effective_step(entities: DataFrame, predictions: DataFrame, steps: list[int], active_only: bool = False) -> DataFrame:
    """Prediction of each entity at every evaluation step, frozen at its last step when shorter.

    ``entities(pid, label, traj_len)``, ``predictions(pid, step, pred)``.
    """
    rows = entities.withColumn("step", F.explode(F.lit(steps)))
    if active_only:
        rows = rows.filter(F.col("traj_len") > F.col("step"))
    eff = F.greatest(F.lit(0), F.least(F.col("step"), F.col("traj_len") - 1))
    rows = rows.withColumn("__eff", eff)
    p = predictions.select("pid", F.col("step").alias("__eff"), F.col("pred").alias("score"))
    return rows.join(p, ["pid", "__eff"]).drop("__eff")


# ---- threshold tables --------------------------------------------------------------------


def threshold_table(rows: DataFrame, keys: list[str], totals: bool = False) -> DataFrame:
    """One row per distinct score: positives and negatives at it (``pos neg``), true and false
    positives of the rule ``score >= threshold`` (``tp fp``), negatives below (``neg_below``);
    with ``totals`` the class sizes ``n_pos n_neg`` too. Needs at least one key."""
    counts = rows.groupBy(*keys, "score").agg(
        F.sum(F.when(F.col("label") == 1, 1.0).otherwise(0.0)).alias("pos"),
        F.sum(F.when(F.col("label") == 0, 1.0).otherwise(0.0)).alias("neg"),
    )
    return cumulate(counts, keys, totals)


def cumulate(counts: DataFrame, keys: list[str], totals: bool = False) -> DataFrame:
    """Threshold table from positives and negatives counted per score."""
    scans = [
        Scan("tp", "sum", F.col("pos"), reverse=True),
        Scan("fp", "sum", F.col("neg"), reverse=True),
        Scan("neg_below", "sum", F.col("neg"), inclusive=False),
    ]
    out = sliced_scan(counts, keys, ["score"], value_slice(F.col("score")), scans)
    out = out.withColumn("neg_below", F.coalesce("neg_below", F.lit(0.0)))
    if totals:
        sizes = counts.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
        out = out.join(sizes, keys)
    return out


def auroc_column() -> Column:
    """Mann-Whitney: a positive beats the negatives below it, ties count half."""
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    pairs = F.sum("pos") * F.sum("neg")
    return F.when(pairs > 0, wins / pairs)


def average_precision_column() -> Column:
    gain = F.when(F.col("tp") + F.col("fp") > 0, F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    return F.when(F.sum("pos") > 0, F.sum(gain) / F.sum("pos"))


def hanley_like(auc: Column, n_pos: Column, n_neg: Column) -> Column:
    """Variance of the area from its value and class sizes (the simple, not the DeLong, form)."""
    return (auc / (2 - auc) - auc * auc) / n_neg + (2 * auc * auc / (1 + auc) - auc * auc) / n_pos


def discrimination(rows: DataFrame, keys: list[str]) -> DataFrame:
    """AUROC with interval and average precision per key, with counts."""
    out = threshold_table(rows, keys).groupBy(*keys).agg(
        auroc_column().alias("auroc"),
        average_precision_column().alias("auprc"),
        F.sum("pos").alias("n_positive"),
        F.sum(F.col("pos") + F.col("neg")).alias("n_samples"),
    )
    n_neg = F.col("n_samples") - F.col("n_positive")
    variance = F.when(F.col("auroc").isNotNull(), F.greatest(hanley_like(F.col("auroc"), F.col("n_positive"), n_neg), F.lit(0.0)))
    half = F.sqrt(variance) * Z95
    out = out.withColumns(
        {
            "auroc_ci_lower": F.when(half.isNotNull(), F.greatest(F.col("auroc") - half, F.lit(0.0))),
            "auroc_ci_upper": F.when(half.isNotNull(), F.least(F.col("auroc") + half, F.lit(1.0))),
        }
    )
    return out.withColumns({c: F.col(c).cast("long") for c in ("n_positive", "n_samples")})


def curve_points(rows: DataFrame, keys: list[str]) -> DataFrame:
    """ROC and precision-recall points at every distinct threshold."""
    t = threshold_table(rows, keys, totals=True)
    return t.select(
        *keys,
        F.col("score").alias("threshold"),
        F.when(F.col("n_pos") > 0, F.col("tp") / F.col("n_pos")).alias("tpr"),
        F.when(F.col("n_neg") > 0, F.col("fp") / F.col("n_neg")).alias("fpr"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
    )


# ---- bootstrap ---------------------------------------------------------------------------


def _uniform(*parts: Column) -> Column:
    """Uniform (0, 1) number from hashed parts."""
    return (F.pmod(F.xxhash64(*parts), F.lit(2**52)).cast("double") + 0.5) / float(2**52)


def poisson_quantile():
    """Vectorised function of (u, mean): the smallest k with P(Poisson(mean) <= k) >= u. Made on
    demand, so that it travels to the workers by value and importing needs no session."""

    @F.pandas_udf("double")
    def quantile(u: pd.Series, mean: pd.Series) -> pd.Series:
        x, m = u.to_numpy(dtype=float), mean.to_numpy(dtype=float)
        # from 12 standard deviations below the mean on; less than 1e-30 lies outside them
        wide = 12 * np.sqrt(m) + 20
        k = np.floor(np.maximum(m - wide, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            term = np.where(m > 0, np.exp(np.where(k > 0, k * np.log(m), 0) - m - np.array([math.lgamma(i + 1) for i in k])), 1.0)
        total = term.copy()
        open_ = (total < x) & (m > 0)
        while open_.any():
            k[open_] += 1
            term[open_] *= m[open_] / k[open_]
            total[open_] += term[open_]
            open_ &= (total < x) & (k < m + wide)
        return pd.Series(k)

    return quantile


def poisson_weight(count: Column, *parts: Column) -> Column:
    """Poisson(count) resampling weight from hashed parts, by inversion whatever the count."""
    return poisson_quantile()(_uniform(*parts), count.cast("double"))


def bootstrap_tables(rows: DataFrame, keys: list[str], replicates: int, seed: int, totals: bool = False) -> DataFrame:
    """Threshold tables of resampled data, keyed by ``replicate`` too.

    Counts per score are resampled, not rows: equal scores share one draw of their total. The
    drawn counts are cut from their lineage, because the tables read them more than once.
    """
    counts = rows.groupBy(*keys, "score", F.col("label").alias("y")).agg(F.count("*").alias("c"))
    rep = counts.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    tags = [F.col(k) for k in keys] + [F.col("score"), F.col("y"), F.col("replicate"), F.lit(seed)]
    drawn = rep.withColumn("w", poisson_weight(F.col("c"), *tags)).filter(F.col("w") > 0)
    sums = drawn.groupBy(*keys, "replicate", "score").agg(
        F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0.0)).alias("neg")
    )
    return cumulate(cut_lineage(sums), [*keys, "replicate"], totals)


def bootstrap_interval(values: DataFrame, keys: list[str], value: str, alpha: float = 0.95) -> DataFrame:
    """Percentile interval over replicates: order statistics at ``int((1 -+ alpha) / 2 n)``."""
    ordered = values.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("v"))
    n = F.size("v")
    lo, hi = ((F.floor(n * p + 1e-9)).cast("int") for p in ((1 - alpha) / 2, (1 + alpha) / 2))
    return ordered.select(*keys, F.get("v", lo).alias("ci_lower"), F.get("v", F.least(hi, n - 1)).alias("ci_upper"))


def average_precision_ci(rows: DataFrame, keys: list[str], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Average precision with its bootstrap interval; one-class replicates are left out."""
    point = threshold_table(rows, keys).groupBy(*keys).agg(average_precision_column().alias("auprc"))
    reps = bootstrap_tables(rows, keys, replicates, seed).groupBy(*keys, "replicate").agg(
        F.when(F.sum("neg") > 0, average_precision_column()).alias("v")
    )
    return point.join(bootstrap_interval(reps, keys, "v"), keys, "left")


# ---- ranking and thresholds --------------------------------------------------------------


def score_rank(rows: DataFrame, keys: list[str]) -> DataFrame:
    """1-based rank by falling score within the keys (ties by pid), and the group size ``__n``."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    one = Scan("rank", "sum", F.lit(1).cast("long"), reverse=True)
    return sliced_scan(rows, keys, ["score", "pid"], value_slice(F.col("score")), [one]).join(sizes, keys)


def recall_at_top(rows: DataFrame, keys: list[str], percents: list[int]) -> DataFrame:
    """Share of positives among the top p percent by score (at least one row selected)."""
    ranked = score_rank(rows, keys).withColumn("percent", F.explode(F.lit(percents)))
    chosen = F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.col("__n") * F.col("percent") / 100))
    found = F.sum(F.when(chosen, F.col("label")).otherwise(0))
    total = F.sum("label")
    return ranked.groupBy(*keys, "percent").agg(F.when(total > 0, found / total).otherwise(0.0).alias("recall"), F.sum(chosen.cast("long")).alias("n_selected"))


def recall_at_top_ci(rows: DataFrame, keys: list[str], percents: list[int], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Bootstrap interval of the recall in the top p percent, from resampled threshold tables.
    The score group that crosses the cut adds its positives in proportion."""
    t = bootstrap_tables(rows, keys, replicates, seed, totals=True).withColumn("percent", F.explode(F.lit(percents)))
    n = F.col("n_pos") + F.col("n_neg")
    room = F.greatest(F.lit(1.0), F.ceil(n * F.col("percent") / 100)) - (F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), room / (F.col("pos") + F.col("neg"))))
    reps = t.groupBy(*keys, "percent", "replicate").agg((F.sum(F.col("pos") * share) / F.max("n_pos")).alias("v"))
    return recall_at_top(rows, keys, percents).join(bootstrap_interval(reps, [*keys, "percent"], "v"), [*keys, "percent"], "left")


def best_fbeta(rows: DataFrame, keys: list[str], beta: float = 1.0) -> DataFrame:
    """Threshold with the largest F-beta (the smallest one on ties)."""
    b2 = beta * beta
    t = threshold_table(rows, keys, totals=True)
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.col("n_pos")
    denom = b2 * precision + recall
    f = F.when(denom > 0, (1 + b2) * precision * recall / denom).otherwise(0.0)
    t = t.withColumn("__f", f)
    best = F.max(F.struct(F.round("__f", 12).alias("f"), (-F.col("score")).alias("s"))).alias("m")
    return t.filter(F.col("n_pos") > 0).groupBy(*keys).agg(best).select(*keys, (-F.col("m.s")).alias("threshold"), F.col("m.f").alias("fbeta"))


def confusion(rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Confusion counts, sensitivity, specificity and prevalence in percent at a threshold."""
    up, y = F.col("score") >= threshold, F.col("label") == 1

    def n(cond):
        return F.sum(cond.cast("long"))

    out = rows.groupBy(*keys).agg(n(up & y).alias("tp"), n(up & ~y).alias("fp"), n(~up & ~y).alias("tn"), n(~up & y).alias("fn"))
    pos, neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    return out.withColumns(
        {
            "sensitivity": F.when(pos > 0, F.col("tp") / pos * 100).otherwise(0.0),
            "specificity": F.when(neg > 0, F.col("tn") / neg * 100).otherwise(0.0),
            "prevalence": pos / (pos + neg) * 100,
        }
    )


def net_benefit(rows: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """Decision curve: net benefit of the model, of treating all and of treating none.

    Scores are counted into the gaps between thresholds first, so the thresholds are exploded
    over that small table and not over the rows.
    """
    cuts = sorted(thresholds)
    at = F.size(F.filter(F.lit([float(c) for c in cuts]), lambda c: c <= F.col("score")))
    bins = rows.groupBy(*keys, at.alias("__b")).agg(
        F.sum((F.col("label") == 1).cast("long")).alias("p"), F.sum((F.col("label") == 0).cast("long")).alias("q")
    )
    table = bins.withColumn("t", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(c)).alias("c")) for i, c in enumerate(cuts, 1)])))
    above = F.col("__b") >= F.col("t.i")
    out = table.groupBy(*keys, F.col("t.c").alias("threshold")).agg(
        F.sum(F.when(above, F.col("p")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("q")).otherwise(0)).alias("fp"),
        F.sum("p").alias("n_pos"),
        F.sum(F.col("p") + F.col("q")).alias("n"),
    )
    odds = F.col("threshold") / (1 - F.col("threshold"))
    prevalence = F.col("n_pos") / F.col("n")
    return out.select(
        *keys,
        "threshold",
        (F.col("tp") / F.col("n") - F.col("fp") / F.col("n") * odds).alias("nb_model"),
        (prevalence - (1 - prevalence) * odds).alias("nb_all"),
        F.lit(0.0).alias("nb_none"),
    )


# ---- calibration -------------------------------------------------------------------------


def _edges(n_bins: int) -> list[float]:
    return [i / n_bins for i in range(n_bins + 1)]


def calibration_bins(rows: DataFrame, keys: list[str], n_bins: int = 4) -> DataFrame:
    """Per right-closed bin ``(lo, hi]``: count, share of all rows, mean score, event rate, error.
    A score of exactly 0 belongs to no bin but counts in the total."""
    edges = _edges(n_bins)
    b = F.size(F.filter(F.lit(edges), lambda e: e < F.col("score")))
    sums = rows.groupBy(*keys, b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("score").alias("confidence"), F.avg(F.col("label").cast("double")).alias("accuracy")
    )
    totals = sums.groupBy(*keys).agg(F.sum("n").alias("__n"))
    out = sums.join(totals, keys).filter((F.col("bin") >= 1) & (F.col("bin") <= n_bins))
    return out.select(
        *keys,
        "bin",
        (F.col("bin") / n_bins).alias("bin_upper"),
        "n",
        (F.col("n") / F.col("__n")).alias("share"),
        "confidence",
        "accuracy",
        (F.col("confidence") - F.col("accuracy")).alias("error"),
    )


def calibration_error(rows: DataFrame, keys: list[str], n_bins: int = 4) -> DataFrame:
    """Expected calibration error with overall means."""
    ece = calibration_bins(rows, keys, n_bins).groupBy(*keys).agg(F.sum(F.abs("error") * F.col("share")).alias("ece"))
    overall = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("score").alias("confidence"), F.avg(F.col("label").cast("double")).alias("accuracy")
    )
    return overall.join(ece, keys, "left").withColumn("ece", F.coalesce("ece", F.lit(0.0)))


def brier(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(F.pow(F.col("score") - F.col("label"), F.lit(2))).alias("brier"))


def calibration_curve(rows: DataFrame, keys: list[str], n_bins: int = 4) -> DataFrame:
    """Equal-width curve; here the first bin takes scores of 0."""
    inner = _edges(n_bins)[1:-1]
    b = F.size(F.filter(F.lit(inner), lambda e: e < F.col("score")))
    return rows.groupBy(*keys, b.alias("bin")).agg(
        F.avg(F.col("label").cast("double")).alias("prob_true"), F.avg("score").alias("prob_pred"), F.count("*").alias("n")
    )


# ---- survival ----------------------------------------------------------------------------


def survival_from_hazard(cells: DataFrame, hazard: str = "hazard") -> DataFrame:
    """Survival after each step from discrete hazards; one row per step, so the grid bounds the window."""
    w = Window.partitionBy("pid").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("survival", F.exp(F.sum(F.log1p(-F.col(hazard))).over(w)))


def concordance(subjects: DataFrame) -> DataFrame:
    """Concordance index: over pairs where one had the event before the other's time, the share
    with the higher risk first, ties half; 0.5 when there is no pair.

    ``subjects(time, event, risk)`` with discrete times. Subjects are counted by (time, event, risk);
    every count is laid on the event steps before its time, and each step is one rank statistic.
    """
    counted = subjects.groupBy("time", "event", "risk").agg(F.count("*").cast("double").alias("c"))
    return _concordance(counted, [])


def _concordance(counted: DataFrame, keys: list[str]) -> DataFrame:
    events = counted.filter(F.col("event") == 1)
    # the discrete event times of a key are bounded by the grid
    steps = events.groupBy(*keys).agg(F.array_sort(F.collect_set("time")).alias("__steps"))
    everyone = counted.groupBy(*keys, "time", "risk").agg(F.sum("c").alias("c"))
    everyone = everyone.join(steps, keys) if keys else everyone.withColumn("__steps", steps.scalar())
    later = everyone.select(
        *keys, F.explode(F.filter("__steps", lambda s: s < F.col("time"))).alias("eval_step"), "risk", F.lit(0.0).alias("pos"), F.col("c").alias("neg")
    )
    cases = events.select(*keys, F.col("time").alias("eval_step"), "risk", F.col("c").alias("pos"), F.lit(0.0).alias("neg"))
    both = cases.unionByName(later).groupBy(*keys, "eval_step", F.col("risk").alias("score")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    per_step = cumulate(both, [*keys, "eval_step"]).groupBy(*keys, "eval_step").agg(
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("wins"), (F.sum("pos") * F.sum("neg")).alias("pairs")
    )
    total = F.sum("pairs")
    return per_step.groupBy(*keys).agg(F.when(total > 0, F.sum("wins") / total).otherwise(0.5).alias("cindex"), total.cast("long").alias("n_pairs"))


def concordance_ci(subjects: DataFrame, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Concordance with a bootstrap interval (2.5 and 97.5 percentiles over replicates)."""
    counted = subjects.groupBy("time", "event", "risk").agg(F.count("*").alias("c"))
    rep = counted.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    tags = [F.col(c) for c in ("time", "event", "risk", "replicate")] + [F.lit(seed)]
    drawn = rep.withColumn("c", poisson_weight(F.col("c"), *tags)).filter(F.col("c") > 0)
    per = _concordance(cut_lineage(drawn), ["replicate"])
    q = group_quantiles(per, [], "cindex", {"ci_lower": 0.025, "ci_upper": 0.975})
    ends = q.select(F.struct("ci_lower", "ci_upper")).scalar()
    return concordance(subjects).withColumn("__q", ends).select("*", "__q.ci_lower", "__q.ci_upper").drop("__q")


def time_dependent_auc(subjects: DataFrame, times: list[int], min_n: int = 10) -> DataFrame:
    """AUROC of "event by t" at each time, without subjects censored before it; 0.5 when there are
    too few or only one class. ``subjects(time, event, risk)``."""
    rows = subjects.withColumn("eval_step", F.explode(F.lit(times)))
    rows = rows.filter((F.col("event") == 1) | (F.col("time") > F.col("eval_step")))
    label = ((F.col("time") <= F.col("eval_step")) & (F.col("event") == 1)).cast("int")
    out = discrimination(rows.select("eval_step", F.col("risk").alias("score"), label.alias("label")), ["eval_step"])
    auc = F.when((F.col("n_samples") >= min_n) & F.col("auroc").isNotNull(), F.col("auroc")).otherwise(0.5)
    return out.select("eval_step", auc.alias("auc"), F.col("n_samples").alias("n"))


def censoring_survival(subjects: DataFrame) -> DataFrame:
    """Kaplan-Meier of the censoring time; events at a time leave before its censorings. One row per
    discrete time, so the windows run over the grid and not over subjects."""
    by = subjects.groupBy("time").agg(
        F.count("*").alias("n"), F.sum((F.col("event") == 1).cast("long")).alias("d"), F.sum((F.col("event") == 0).cast("long")).alias("c")
    )
    later = Window.partitionBy(F.lit(0)).orderBy(F.col("time").desc()).rowsBetween(Window.unboundedPreceding, 0)
    by = by.withColumn("risk_set", F.sum("n").over(later))
    base = F.col("risk_set") - F.col("d")
    factor = F.when(base > 0, 1 - F.col("c") / base).otherwise(1.0)
    upto = Window.partitionBy(F.lit(0)).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    log_sum = F.sum(F.when(factor > 0, F.log(factor))).over(upto)
    dead = F.max((factor <= 0).cast("int")).over(upto)
    return by.select("time", F.when(dead == 1, 0.0).otherwise(F.exp(F.coalesce(log_sum, F.lit(0.0)))).alias("g"))


def survival_brier(subjects: DataFrame, survival: DataFrame, times: list[int]) -> DataFrame:
    """Brier score at each time with inverse censoring weights.

    ``subjects(pid, time, event)``, ``survival(pid, step, survival)``.
    """
    g = censoring_survival(subjects)
    rows = subjects.join(g.select("time", F.col("g").alias("g_own")), "time").withColumn("eval_step", F.explode(F.lit(times)))
    # G at the evaluation time: the last value at or before it, over the few discrete times
    steps = g.agg(F.array_sort(F.collect_list(F.struct("time", "g"))))
    rows = rows.withColumn("__g", steps.scalar())
    past = F.filter("__g", lambda s: s["time"] <= F.col("eval_step"))
    rows = rows.withColumn("g_at", F.coalesce(F.try_element_at(past, F.lit(-1))["g"], F.lit(1.0))).drop("__g")
    rows = rows.join(survival.select("pid", F.col("step").alias("eval_step"), "survival"), ["pid", "eval_step"])
    case = (F.col("time") <= F.col("eval_step")) & (F.col("event") == 1)
    control = F.col("time") > F.col("eval_step")
    s = F.col("survival")
    loss = F.when(case & (F.col("g_own") > 0), s * s / F.col("g_own")).when(control & (F.col("g_at") > 0), (1 - s) * (1 - s) / F.col("g_at")).otherwise(0.0)
    return rows.groupBy("eval_step").agg(F.avg(loss).alias("brier"))


def d_calibration(subjects: DataFrame, at: int, n_bins: int = 10, min_n: int = 5) -> DataFrame:
    """Predicted against observed survival at a time by bins of predicted survival.
    ``subjects(time, event, survival)``; left-closed bins, the last one includes 1."""
    b = F.least(F.size(F.filter(F.lit(_edges(n_bins)), lambda e: e <= F.col("survival"))), F.lit(n_bins))
    dead = (F.col("time") <= at) & (F.col("event") == 1)
    out = subjects.groupBy(b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("survival").alias("predicted"), (1 - F.avg(dead.cast("double"))).alias("observed")
    )
    return out.filter(F.col("n") >= min_n)


# ---- paired tests ------------------------------------------------------------------------


def placements(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Placement value per distinct score: share of the other class it beats, ties half."""
    t = threshold_table(rows.select(*keys, F.col(score).alias("score"), "label"), keys, totals=True)
    above_pos = F.col("tp") - F.col("pos")
    return t.select(
        *keys,
        F.col("score").alias(score),
        ((F.col("neg_below") + F.col("neg") / 2) / F.col("n_neg")).alias(f"__p_{score}"),
        ((above_pos + F.col("pos") / 2) / F.col("n_pos")).alias(f"__q_{score}"),
    )


def delong(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Paired test of two areas on the same rows: areas, z, two-sided p, error of the difference.
    Fewer than two rows in a class or no variance gives z 0 and p 1."""
    clean = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = clean.join(placements(clean, keys, a), [*keys, a]).join(placements(clean, keys, b), [*keys, b])

    def moments(side, cond):
        x, y = F.when(cond, F.col(f"__{side}_{a}")), F.when(cond, F.col(f"__{side}_{b}"))
        return [
            F.avg(x).alias(f"{side}a"),
            F.avg(y).alias(f"{side}b"),
            F.var_samp(x).alias(f"{side}va"),
            F.var_samp(y).alias(f"{side}vb"),
            F.covar_samp(x, y).alias(f"{side}c"),
            F.count(x).alias(f"{side}n"),
        ]

    y = F.col("label") == 1
    m = both.groupBy(*keys).agg(*moments("p", y), *moments("q", ~y))

    def spread(s):
        return (F.col(f"{s}va") + F.col(f"{s}vb") - 2 * F.col(f"{s}c")) / F.col(f"{s}n")

    m = m.withColumn("var", F.coalesce(spread("p") + spread("q"), F.lit(0.0)))
    usable = (F.col("var") > 1e-15) & (F.col("pn") >= 2) & (F.col("qn") >= 2)
    z = F.when(usable, (F.col("pa") - F.col("pb")) / F.sqrt("var")).otherwise(0.0)
    out = m.withColumn("z", z)
    return out.select(
        *keys,
        F.col("pa").alias("auc_a"),
        F.col("pb").alias("auc_b"),
        "z",
        F.when(usable, two_sided_p(F.col("z"))).otherwise(1.0).alias("p"),
        F.when(usable, F.sqrt("var")).otherwise(0.0).alias("se_diff"),
        (F.col("pn") + F.col("qn")).alias("n"),
    )


def benjamini_hochberg(tests: DataFrame, keys: list[str], p: str, order: list[str], alpha: float = 0.05) -> DataFrame:
    """Adjusted p-values (never falling with p) and rejections within the keys. ``order`` breaks ties."""
    n = tests.groupBy(*keys).agg(F.count("*").alias("__n"))
    both = tests.join(n, keys)
    slices = [F.floor(F.col(p) * 1024)]
    ranked = sliced_scan(both, keys, [p, *order], slices, [Scan("__r", "sum", F.lit(1).cast("long"))])
    ranked = ranked.withColumn("__x", F.least(F.col(p) * F.col("__n") / F.col("__r"), F.lit(1.0)))
    out = sliced_scan(ranked, keys, [p, *order], slices, [Scan("p_adjusted", "min", F.col("__x"), reverse=True)])
    return out.withColumn("rejected", F.col("p_adjusted") <= alpha).drop("__n", "__r", "__x")


def compare_scores(
    entities: DataFrame, scores: DataFrame, predictions: DataFrame, steps: list[int], columns: dict[str, bool], min_n: int = 10
) -> DataFrame:
    """Static scores against predictions on identical active entities per step.

    ``columns`` maps score columns to "higher is safer" (negated). One job over (score, step):
    areas and precision of both, the paired test, adjusted p within a score.
    """
    parts = F.array(*[F.struct(F.lit(c).alias("name"), (-F.col(c) if neg else F.col(c)).cast("double").alias("v")) for c, neg in columns.items()])
    long = scores.select("pid", F.explode(parts).alias("s")).select("pid", F.col("s.name").alias("name"), F.col("s.v").alias("value"))
    at = at_effective_step(entities, predictions, steps, active_only=True).withColumnRenamed("score", "model")
    rows = at.join(long.filter(F.col("value").isNotNull()), "pid")
    keys = ["name", "step"]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("label").alias("__a"), F.max("label").alias("__b"))
    fit = sizes.filter((F.col("__n") >= min_n) & (F.col("__a") != F.col("__b")))
    # read six times below: written once to shared storage instead of recomputed
    rows = cut_lineage(rows.join(fit.select(*keys), keys, "left_semi"))

    def side(column, tag):
        d = discrimination(rows.select(*keys, F.col(column).alias("score"), "label"), keys)
        return d.select(*keys, F.col("auroc").alias(f"{tag}_auroc"), F.col("auprc").alias(f"{tag}_auprc"), *(["n_samples", "n_positive"] if tag == "score" else []))

    test = delong(rows, keys, "model", "value").select(*keys, "z", "p")
    out = side("value", "score").join(side("model", "model"), keys).join(test, keys)
    return benjamini_hochberg(out, ["name"], "p", ["step"])


# ---- tables ------------------------------------------------------------------------------


def metric_table(entities: DataFrame, predictions: DataFrame, steps: list[int], grid: Grid = DEFAULT_GRID) -> DataFrame:
    """Full and active-only metrics of every evaluation step, in one job keyed by (mode, step)."""
    rows = at_effective_step(entities, predictions, steps)
    modes = F.when(F.col("traj_len") > F.col("step"), F.array(F.lit("full"), F.lit("active"))).otherwise(F.array(F.lit("full")))
    rows = rows.withColumn("mode", F.explode(modes))
    out = discrimination(rows, ["mode", "step"])
    minutes = grid.step_to_time(F.col("step"))
    return out.withColumn("time_hours", minutes / 60)


def by_class_quantiles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles and mean of the scores per class."""
    by = [*keys, "label"]
    q = group_quantiles(rows, by, "score", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return q.join(rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("score").alias("mean")), by)


# Key times of the report in hours and their labels.
REPORT_HOURS = {
    1: "1 h",
    3: "3 h",
    6: "6 h",
    12: "12 h",
    24: "24 h",
    48: "48 h",
    72: "72 h",
    168: "7 days",
    336: "14 days",
    720: "30 days",
    1440: "60 days",
    2160: "90 days",
}


def report_table(metrics: DataFrame, within_hours: float = 1.5) -> DataFrame:
    """``value [low-high]`` texts at key times for both modes; a dash when no step is near enough.
    ``metrics`` has one row per (mode, step)."""
    times = F.array(*[F.struct(F.lit(float(h)).alias("h"), F.lit(t).alias("t")) for h, t in REPORT_HOURS.items()])
    near = metrics.withColumn("k", F.explode(times)).withColumn("d", F.abs(F.col("time_hours") - F.col("k.h")))
    text = F.format_string("%.3f [%.3f–%.3f]", "auroc", "auroc_ci_lower", "auroc_ci_upper")
    near = near.filter((F.col("d") <= within_hours) & F.col("auroc").isNotNull())
    best = near.groupBy("k.h", "k.t", "mode").agg(F.min(F.struct("d", "step", text.alias("text"), "n_samples")).alias("m"))
    dash = F.lit("—")
    out = best.groupBy(F.col("h").alias("hours"), F.col("t").alias("time")).agg(
        *[F.coalesce(F.max(F.when(F.col("mode") == m, F.col("m.text"))), dash).alias(f"auroc_{m}") for m in ("full", "active")],
        *[F.max(F.when(F.col("mode") == m, F.col("m.n_samples"))).alias(f"n_{m}") for m in ("full", "active")],
    )
    return out


def interval_ranges(metrics: DataFrame, intervals: list[tuple[str, float, float | None]]) -> DataFrame:
    """Smallest and largest AUROC and average precision per time interval ``[lo, hi)``."""
    label = F.lit(None).cast("string")
    for name, lo, hi in intervals:
        inside = F.col("time_hours") >= lo
        if hi is not None:
            inside = inside & (F.col("time_hours") < hi)
        label = F.when(inside, name).otherwise(label)
    return (
        metrics.withColumn("interval", label)
        .filter(F.col("interval").isNotNull())
        .groupBy("mode", "interval")
        .agg(*[f(c).alias(f"{c}_{n}") for c in ("auroc", "auprc") for n, f in (("min", F.min), ("max", F.max))])
    )


def signal_audit(forms: dict[str, DataFrame]) -> DataFrame:
    """AUROC and precision of one channel in several forms at given hours: ``source, hour``."""
    rows = None
    for name, df in forms.items():
        part = df.select(F.lit(name).alias("source"), "hour", "score", "label")
        rows = part if rows is None else rows.unionByName(part)
    out = discrimination(rows, ["source", "hour"])
    return out.select("source", "hour", "auroc", "auprc", "n_samples")


def early_coverage(cells: DataFrame, n_entities: DataFrame, hours: list[float], grid: Grid = DEFAULT_GRID, min_pct: float = 5.0) -> DataFrame:
    """Per channel and hour: percent of entities with any non-zero value in a cell begun by then,
    mean of those values; channels below the minimum share are left out.

    ``cells(pid, step, feature, value)``, ``n_entities`` one row ``(n)``.
    """
    last = [max((c.step for c in grid.steps if c.lo / 60 <= h), default=-1) for h in hours]
    # fold to (pid, feature, step) sums once, then spread over the few hours
    rows = cells.filter(F.col("value").isNotNull() & (F.col("value") != 0))
    table = F.array(*[F.struct(F.lit(float(h)).alias("hour"), F.lit(s).alias("last")) for h, s in zip(hours, last)])
    seen = rows.withColumn("t", F.explode(table)).filter(F.col("step") <= F.col("t.last"))
    per = seen.groupBy("feature", F.col("t.hour").alias("hour"), "pid").agg(F.sum("value").alias("s"), F.count("*").alias("c"))
    out = per.groupBy("feature", "hour").agg(F.count("*").alias("n_pid"), (F.sum("s") / F.sum("c")).alias("mean_value"))
    out = out.withColumn("pct_entities", F.col("n_pid") * 100.0 / n_entities.select("n").scalar()).filter(F.col("pct_entities") >= min_pct)
    return out.select("feature", "hour", "pct_entities", "mean_value")
