"""Per-channel normalisation and distribution statistics over long rows.

``rows(pid, step, feature, value)``; only measured values count: not NULL and inside the
trajectory (``lengths(pid, traj_len)``). Channels are a vocabulary, and what is fitted to one is a
row of at most some thousand numbers: it is broadcast, so that no task gets all rows of a channel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import clip
from tidemark.functions.numeric import inverse_normal, yeo_johnson
from tidemark.operators.quantiles import group_quantiles, quantile_table
from tidemark.session import cut_lineage

# Shape thresholds of the adaptive choice.
SKEW_NORMAL, SKEW_MODERATE = 0.5, 2.0
KURT_NORMAL, KURT_MODERATE = 3.0, 7.0
EDGE_SHARE, EDGE_MASS = 0.05, 0.40
PERCENTILES = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def measured(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    return (
        rows.filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .join(lengths.select("pid", "traj_len"), "pid")
        .filter(F.col("step") < F.col("traj_len"))
        .drop("traj_len")
    )


def shape(values: DataFrame, by: str = "feature") -> DataFrame:
    """n, mean, population std, min, max, skewness, excess kurtosis and edge mass per channel."""
    first = values.groupBy(by).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.skewness("value").alias("skewness"),
        F.kurtosis("value").alias("kurtosis"),
    )
    # a constant channel has no shape
    first = first.withColumns({c: F.when(F.col("std") > 0, F.col(c)) for c in ("skewness", "kurtosis")})
    zone = (F.col("max") - F.col("min")) * EDGE_SHARE
    top, low = F.col("value") >= F.col("max") - zone, F.col("value") <= F.col("min") + zone
    edges = (
        values.join(F.broadcast(first.select(by, "min", "max")), by)
        .groupBy(by)
        .agg(F.greatest(F.avg(top.cast("double")), F.avg(low.cast("double"))).alias("edge_mass"))
    )
    return first.join(edges, by)


def choose_method() -> Column:
    """Method per channel from its shape."""
    s, k = F.abs(F.col("skewness")), F.col("kurtosis")
    edge = (F.col("max") > F.col("min")) & (F.col("edge_mass") >= EDGE_MASS)
    return (
        F.when(F.col("n") < 3, "standard")
        .when((s < SKEW_NORMAL) & (k < KURT_NORMAL), "standard")
        .when((s < SKEW_MODERATE) & (k < KURT_MODERATE), "power")
        .when(edge, "robust")
        .otherwise("quantile")
    )


def adaptive_methods(values: DataFrame, by: str = "feature") -> DataFrame:
    return shape(values, by).select(by, choose_method().alias("method"))


def fit_standard(values: DataFrame, by: str = "feature") -> DataFrame:
    """Mean and population std; std 0 becomes 1, fewer than 3 values give 0 and 1."""
    out = values.groupBy(by).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    few = F.col("n") < 3
    return out.select(
        by,
        F.when(few, 0.0).otherwise(F.col("m")).alias("center"),
        F.when(few | (F.col("s") == 0), 1.0).otherwise(F.col("s")).alias("scale"),
    )


def fit_robust(values: DataFrame, by: str = "feature") -> DataFrame:
    """Median and interquartile range; range 0 becomes 1."""
    q = group_quantiles(values, [by], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.select(by, F.col("q2").alias("center"), F.when(iqr == 0, 1.0).otherwise(iqr).alias("scale"))


def apply_center(rows: DataFrame, fitted: DataFrame, by: str = "feature") -> DataFrame:
    """(value - center) / scale with fitted statistics."""
    out = rows.join(F.broadcast(fitted.select(by, "center", "scale")), by)
    return out.withColumn("value", (F.col("value") - F.col("center")) / F.col("scale")).drop("center", "scale")


# ---- quantile --------------------------------------------------------------------------


def fit_quantile(values: DataFrame, n_quantiles: int = 1000, by: str = "feature") -> DataFrame:
    """Sorted quantile array per channel: at most ``n_quantiles`` numbers each."""
    rows = quantile_table(values, [by], "value", n_quantiles)
    return rows.groupBy(by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda r: r["q"]).alias("quantiles")
    )


# The normal output is cut at the quantile of 1e-7.
NORMAL_LIMIT = 5.19933758270342


def count_below(value: Column, ascending: Column, or_equal: bool = False) -> Column:
    """How many numbers of an ascending array are less than ``value`` (or not greater), by halving."""

    def go_on(found: Column, i: Column) -> Column:
        more = found + F.call_function("shiftleft", F.lit(1), i)
        # past the end there is no number, so the step is not taken
        at = F.get(ascending, more - 1)
        return F.when(at <= value if or_equal else at < value, more).otherwise(found)

    # steps of powers of two, the first for the highest binary digit of the size
    digits = F.length(F.bin(F.greatest(F.size(ascending), F.lit(1))))
    return F.aggregate(F.sequence(digits - 1, F.lit(0), F.lit(-1)), F.lit(0), go_on)


def position(value: Column, quantiles: Column, counts: tuple[Column, Column] | None = None) -> Column:
    """Position of a value in [0, 1] among ascending quantiles; a repeated quantile counts at the
    middle of its run. NULL for NULL or NaN values, without quantiles and where the first or last is NULL.

    ``counts``: how many quantiles are less, and how many are not greater, where they are known."""
    n = F.size(quantiles)
    below, upto = counts or (count_below(value, quantiles), count_below(value, quantiles, or_equal=True))
    first, last = F.get(quantiles, F.lit(0)), F.get(quantiles, n - 1)
    lo, hi = F.get(quantiles, below - 1), F.get(quantiles, below)
    between = below - 1 + (value - lo) / (hi - lo)
    middle = (below + upto - 1) / 2
    inside = F.when(upto > below, middle).otherwise(between) / (n - 1)
    top = F.when((n > 1) & (last > first), 1.0).otherwise(0.0)
    found = F.when(value >= last, top).when(value <= first, 0.0).otherwise(inside)
    known = value.isNotNull() & ~F.isnan(value) & first.isNotNull() & last.isNotNull()
    return F.when(known & (n > 0), found)


def with_position(rows: DataFrame, column: str, ascending: str, name: str) -> DataFrame:
    """``position`` of a column among a column of quantiles. The counts are columns of their own, so that a row is
    searched once, and a second time only if its value is a quantile; rows without quantiles are not searched."""
    value, quantiles = F.col(column), F.col(ascending)
    rows = rows.withColumn("__below", F.when(quantiles.isNotNull(), count_below(value, quantiles)))
    met = F.get(quantiles, F.col("__below")) == value
    rows = rows.withColumn("__upto", F.when(met, count_below(value, quantiles, or_equal=True)).otherwise(F.col("__below")))
    found = position(value, quantiles, (F.col("__below"), F.col("__upto")))
    return rows.withColumn(name, found).drop("__below", "__upto")


def normal_score(u: Column) -> Column:
    z = F.when(u <= 1e-7, -NORMAL_LIMIT).when(u >= 1 - 1e-7, NORMAL_LIMIT).otherwise(inverse_normal(u))
    return clip(z, -NORMAL_LIMIT, NORMAL_LIMIT)


def apply_quantile(rows: DataFrame, fitted: DataFrame, output: str = "normal", by: str = "feature") -> DataFrame:
    """Map values to their quantile position, as uniform or normal scores."""
    out = rows.join(F.broadcast(fitted.select(by, F.col("quantiles").alias("__q"))), by, "left")
    out = with_position(out, "value", "__q", "__u")
    out = out.withColumn("value", F.col("__u") if output == "uniform" else normal_score(F.col("__u")))
    return out.select(*rows.columns)


# ---- power -----------------------------------------------------------------------------


def fit_power(values: DataFrame, by: str = "feature", lo: float = -5.0, hi: float = 5.0, points: int = 9, rounds: int = 3) -> DataFrame:
    """Yeo-Johnson lambda by maximum likelihood, with the mean and std of the transformed values.

    Values are counted once and written once; every round scores ``points`` candidates per channel
    in one aggregation with map-side combine and narrows the bracket around the best. The vertex of
    the parabola through the last three scores is the result.
    """
    counts = cut_lineage(values.filter(F.col("value").isNotNull()).groupBy(by, "value").agg(F.count("*").cast("double").alias("w")))
    bracket = counts.groupBy(by).agg(F.lit(lo).alias("a"), F.lit(hi).alias("b"))
    x, w = F.col("value"), F.col("w")
    jacobian = F.signum(x) * F.log1p(F.abs(x))
    for _ in range(rounds):
        step = (F.col("b") - F.col("a")) / (points - 1)
        at = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("a") + i * step)
        tried = bracket.select(by, step.alias("h"), F.explode(at).alias("lam"))
        scored = counts.join(F.broadcast(tried), by).withColumn("y", yeo_johnson(x, F.col("lam")))
        scored = scored.groupBy(by, "h", "lam").agg(
            F.sum("w").alias("n"), F.sum(w * jacobian).alias("j"), F.sum(w * F.col("y")).alias("s"), F.sum(w * F.col("y") * F.col("y")).alias("q")
        )
        var = F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2))
        ll = F.when(var > 1e-300, -F.col("n") / 2 * F.log(var) + (F.col("lam") - 1) * F.col("j")).otherwise(F.lit(-1e300))
        scored = scored.withColumn("ll", F.when(F.isnan(ll), F.lit(-1e300)).otherwise(ll))
        curve = scored.groupBy(by, "h").agg(
            F.array_sort(F.collect_list(F.struct("lam", "ll"))).alias("c"), F.max_by("lam", F.struct("ll", -F.abs("lam"))).alias("best")
        )
        bracket = curve.select(by, (F.col("best") - F.col("h")).alias("a"), (F.col("best") + F.col("h")).alias("b"), "best", "h", "c")
    i = F.array_position(F.transform("c", lambda r: r["lam"]), F.col("best")).cast("int")
    left, mid, right = (F.get("c", i - 1 + d)["ll"] for d in (-1, 0, 1))
    bend = left - 2 * mid + right
    shift = F.when((bend < 0) & (left > -1e299) & (right > -1e299), (left - right) / (2 * bend) * F.col("h")).otherwise(0.0)
    chosen = bracket.select(by, (F.col("best") + F.coalesce(shift, F.lit(0.0))).alias("lam"))
    y = yeo_johnson(x, F.col("lam"))
    moments = counts.join(F.broadcast(chosen), by).withColumn("y", y).groupBy(by, "lam").agg(
        (F.sum(w * F.col("y")) / F.sum(w)).alias("center"), F.sum(w * F.col("y") * F.col("y")).alias("q"), F.sum(w).alias("n")
    )
    std = F.sqrt(F.greatest(F.col("q") / F.col("n") - F.pow(F.col("center"), F.lit(2)), F.lit(0.0)))
    return moments.select(by, "lam", "center", F.when(std == 0, 1.0).otherwise(std).alias("scale"))


def apply_power(rows: DataFrame, fitted: DataFrame, by: str = "feature") -> DataFrame:
    out = rows.join(F.broadcast(fitted), by)
    y = (yeo_johnson(F.col("value"), F.col("lam")) - F.col("center")) / F.col("scale")
    return out.withColumn("value", y).drop("lam", "center", "scale")


# ---- all together ----------------------------------------------------------------------


_FITS = {"standard": fit_standard, "robust": fit_robust, "power": fit_power}


def fit(values: DataFrame, method: str = "adaptive", n_quantiles: int = 1000, by: str = "feature") -> DataFrame:
    """Fitted statistics of every channel: ``feature, method, center, scale, lam, quantiles``.

    A fixed method fits only itself (and the standard fallback of tiny channels); the adaptive
    choice restricts every fit to the channels that chose it. Persist as parquet and reuse.
    """
    if method == "adaptive":
        # every fit asks which channels are its own: the shapes are made once
        values = cut_lineage(values.select(by, "value"))
        chosen = cut_lineage(adaptive_methods(values, by))
        methods = ["standard", "power", "robust", "quantile"]
    else:
        few = F.count("value") < 3
        chosen = values.groupBy(by).agg(F.when(few, "standard").otherwise(method).alias("method"))
        methods = sorted({"standard", method})
    out = None
    for name in methods:
        mine = chosen.filter(F.col("method") == name)
        rows = values.join(F.broadcast(mine.select(by)), by, "left_semi")
        if name == "quantile":
            part = fit_quantile(rows, n_quantiles, by)
        else:
            part = _FITS[name](rows, by)
        part = part.withColumn("method", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    for c, kind in {"center": "double", "scale": "double", "lam": "double", "quantiles": "array<double>"}.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(kind))
    return out.select(by, "method", "center", "scale", "lam", "quantiles")


def transform(rows: DataFrame, fitted: DataFrame, clip_range: tuple[float, float] | None = None, by: str = "feature") -> DataFrame:
    """Normalise with fitted statistics; every row stays and NULL or unknown becomes 0.0."""
    keep = rows.columns
    out = rows.join(F.broadcast(fitted.select(by, "method", "center", "scale", "lam", "quantiles")), by, "left")
    x, is_ = F.col("value"), lambda name: F.col("method") == name
    y = F.when(is_("power"), (yeo_johnson(x, F.col("lam")) - F.col("center")) / F.col("scale")).otherwise(
        (x - F.col("center")) / F.col("scale")
    )
    out = with_position(out, "value", "quantiles", "__u")
    y = F.when(is_("quantile"), normal_score(F.col("__u"))).otherwise(y)
    if clip_range is not None:
        y = clip(y, *clip_range)
    return out.withColumn("value", F.coalesce(y, F.lit(0.0))).select(*keep)


def transform_padded(rows: DataFrame, lengths: DataFrame, fitted: DataFrame, **kw) -> DataFrame:
    """As ``transform``; positions past the trajectory become 0.0 too."""
    out = rows.join(lengths.select("pid", "traj_len"), "pid", "left")
    inside = F.col("step") < F.coalesce("traj_len", F.lit(0))
    return transform(out.withColumn("value", F.when(inside, F.col("value"))).drop("traj_len"), fitted, **kw)


def unpivot(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Tabular columns as long channels."""
    return table.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([key], columns, "feature", "value")


def normalise_table(table: DataFrame, key: str, columns: list[str], train: DataFrame | None = None) -> DataFrame:
    """Tabular variant: missing values are filled with the training mean, then standardised."""
    long = unpivot(table, key, columns)
    fit_rows = unpivot(train if train is not None else table, key, columns)
    fitted = fit_standard(fit_rows.filter(F.col("value").isNotNull()), "feature")
    means = fit_rows.groupBy("feature").agg(F.avg("value").alias("fill"))
    filled = long.join(F.broadcast(means), "feature").withColumn("value", F.coalesce("value", "fill")).drop("fill")
    out = apply_center(filled, fitted)
    return out.groupBy(key).agg(*[F.max(F.when(F.col("feature") == c, F.col("value"))).alias(c) for c in columns])


def distribution_report(values: DataFrame, by: str = "feature") -> DataFrame:
    """Moments, percentiles, shape class and recommended scaler per channel."""
    s = shape(values, by).join(group_quantiles(values, [by], "value", PERCENTILES), by)
    skew, kurt = F.abs(F.col("skewness")), F.col("kurtosis")
    edge = (F.col("max") > F.col("min")) & (F.col("edge_mass") >= EDGE_MASS)

    def pick(normal, moderate, boundary, heavy, few):
        return (
            F.when(F.col("n") < 3, few)
            .when((skew < SKEW_NORMAL) & (kurt < KURT_NORMAL), normal)
            .when((skew < SKEW_MODERATE) & (kurt < KURT_MODERATE), moderate)
            .when(edge, boundary)
            .otherwise(heavy)
        )

    # Class names and recommendations.
    return s.withColumns(
        {
            "distribution_class": pick("normal-ish", "moderate skew", "boundary-concentrated", "heavy skew/tails", "insufficient data"),
            "recommendation": pick("StandardScaler", "PowerTransformer", "RobustScaler", "QuantileTransformer", "N/A"),
        }
    ).drop("edge_mass")
