"""Landmark datasets for all times at once, out-of-fold scoring, predictions as a channel."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.timegrid import DEFAULT_GRID, Grid, micros, minutes_of
from tidemark.operators import boosting
from tidemark.operators import features as ft
from tidemark.operators.joins import as_of
from tidemark.operators.normalize import count_below
from tidemark.operators.sampling import stratified_folds
from tidemark.session import cut_lineage

HOUR = 3_600_000_000

# Landmark schedule, horizon to step.
DEFAULT_SCHEDULE = {
    "30min": "10min",
    "4h": "1h",
    "24h": "4h",
    "72h": "6h",
    "6D": "12h",
    "14D": "1D",
    "30D": "3D",
    "90D": "7D",
}


def landmark_hours(schedule: dict[str, str] | None = None) -> list[float]:
    """Landmark times in hours: every range steps over clean multiples of its step, from the first
    one after the range before it; the very first range includes 0."""
    out, before = set(), 0
    for end, step in sorted((schedule or DEFAULT_SCHEDULE).items(), key=lambda kv: minutes_of(kv[0])):
        end_min, step_min = minutes_of(end), minutes_of(step)
        at = math.ceil(before / step_min) * step_min
        if at == before and at > 0:
            at += step_min
        while at <= end_min:
            out.add(round(at / 60, 6))
            at += step_min
        before = end_min
    return sorted(out)


def _first_landmark(rows: DataFrame, hours: list[float]) -> DataFrame:
    """``rows`` that some landmark sees, with the index ``lm`` of the first one that does."""
    limits = F.lit([int(round(h * HOUR)) for h in hours])
    rows = rows.withColumn("__elapsed", micros(F.col("ts")) - micros(F.col("start_ts")))
    rows = rows.withColumn("lm", count_below(F.col("__elapsed"), limits)).drop("__elapsed")
    return rows.filter((F.col("lm") < len(hours)) & F.col("ts").isNotNull() & F.col("start_ts").isNotNull())


def _seen_rows(events: DataFrame, starts: DataFrame, hours: list[float]) -> DataFrame:
    rows = events.filter(F.col("value").isNotNull()).join(starts.select("pid", "start_ts"), "pid")
    return _first_landmark(rows, hours)


#: Series of more values than this have their medians found slice by slice; ``SLICES`` slices a series.
SMALL = 4096
SLICES = 256
SERIES = ["pid", "feature"]


def _running(parts: Column) -> Column:
    """Running merges of the parts of a series, in order: each step merges one part into the last result."""

    def step(done: Column, p: Column) -> Column:
        before = F.get(done, F.size(done) - 1)
        n_before, mean = F.coalesce(before["n"], F.lit(0)), F.coalesce(before["m"], F.lit(0.0))
        n, away = n_before + p["n"], p["m"] - mean
        merged = {
            "lm": p["lm"],
            "n": n,
            "m": mean + away * p["n"] / n,
            "m2": F.coalesce(before["m2"], F.lit(0.0)) + p["m2"] + away * away * n_before * p["n"] / n,
            "lo": F.least(before["lo"], p["lo"]),
            "hi": F.greatest(before["hi"], p["hi"]),
            "f": F.least(before["f"], p["f"]),
            "l": F.greatest(before["l"], p["l"]),
        }
        return F.concat(done, F.array(F.struct(*[c.alias(name) for name, c in merged.items()])))

    return F.aggregate(parts, F.slice(parts, F.lit(1), F.lit(0)), step)


def _finished(e: Column, functions) -> Column:
    """The aggregates of a running merge; the median is left open."""
    build = {
        "first": e["f"]["v"],
        "last": e["l"]["v"],
        "min": e["lo"],
        "max": e["hi"],
        "mean": e["m"],
        "std": F.when(e["n"] > 1, F.sqrt(e["m2"] / (e["n"] - 1))),
        "count": e["n"].cast("double"),
        "median": F.lit(None).cast("double"),
    }
    return F.struct(e["lm"].alias("lm"), *[build[f].alias(f) for f in functions])


def _middle(ordered: Column, lm: Column) -> Column:
    """Median of the values with a landmark up to ``lm`` in an ascending list of (value, lm)."""
    seen = F.array(F.filter(ordered, lambda x: x["lm"] <= lm))  # a list of one, so that it is made once
    pick = lambda s: (F.get(s, F.shiftright(F.size(s) - 1, 1))["v"] + F.get(s, F.shiftright(F.size(s), 1))["v"]) / 2
    return F.get(F.transform(seen, pick), F.lit(0))


def long_medians(rows: DataFrame, n_landmarks: int) -> DataFrame:
    """Median of every series at every landmark that adds a value: ``pid, feature, lm, median``, for series of any length.

    Each series is cut into slices at its approximate quantiles. A slice carries one vector of counters, how many
    of its values each landmark sees; their running sums say in which slice a landmark's middle ranks lie and how
    far in, and only that slice's values are ordered. An event is in one slice and is never copied per landmark.
    """
    counts = rows.groupBy(*SERIES, "value", "lm").agg(F.count("*").alias("n"))
    cuts = rows.groupBy(*SERIES).agg(F.percentile_approx("value", [i / SLICES for i in range(1, SLICES)], 10 * SLICES).alias("cuts"))
    sliced = counts.join(cuts, SERIES).withColumn("slice", count_below(F.col("value"), F.col("cuts"))).drop("cuts")
    sliced = cut_lineage(sliced)
    seen = F.array(*[F.coalesce(F.sum(F.when(F.col("lm") <= j, F.col("n"))), F.lit(0)) for j in range(n_landmarks)])
    vectors = sliced.groupBy(*SERIES, "slice").agg(seen.alias("seen"), F.collect_set("lm").alias("lms"))
    series = vectors.groupBy(*SERIES).agg(
        F.sort_array(F.collect_list(F.struct("slice", "seen"))).alias("slices"), F.array_distinct(F.flatten(F.collect_list("lms"))).alias("lms")
    )
    start = F.struct(F.lit(0).cast("long").alias("cum"), F.lit(None).cast("int").alias("slice"), F.lit(None).cast("long").alias("off"))

    def find(rank: Column, lm: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            more = F.get(s["seen"], lm)
            here = acc["cum"] + more > rank
            found = F.struct(acc["cum"].alias("cum"), s["slice"].alias("slice"), (rank - acc["cum"]).alias("off"))
            on = F.struct((acc["cum"] + more).alias("cum"), acc["slice"].alias("slice"), acc["off"].alias("off"))
            return F.when(acc["slice"].isNotNull(), acc).when(here, found).otherwise(on)

        return F.aggregate("slices", start, step)

    each = series.select(*SERIES, "slices", F.explode("lms").alias("lm"))
    each = each.withColumn("total", F.aggregate("slices", F.lit(0).cast("long"), lambda a, s: a + F.get(s["seen"], F.col("lm"))))
    each = each.select(*SERIES, "lm", F.explode(F.array(F.shiftright(F.col("total") - 1, 1), F.shiftright("total", 1))).alias("rank"), "slices").distinct()
    targets = each.select(*SERIES, F.col("lm").alias("at"), "rank", find(F.col("rank"), F.col("lm")).alias("t")).select(*SERIES, "at", "rank", "t.slice", "t.off")
    met = sliced.join(targets, [*SERIES, "slice"]).filter(F.col("lm") <= F.col("at"))
    upto = Window.partitionBy(*SERIES, "at", "rank").orderBy("value").rangeBetween(Window.unboundedPreceding, 0)
    hits = met.withColumn("upto", F.sum("n").over(upto)).filter(F.col("upto") > F.col("off"))
    # a rank's value is the least that reaches it; the median is the mean of both middle ranks (one, if odd)
    middle = hits.groupBy(*SERIES, "at", "rank").agg(F.min("value").alias("v"))
    return middle.groupBy(*SERIES, F.col("at").alias("lm")).agg(F.avg("v").alias("median"))


def landmark_series(events: DataFrame, starts: DataFrame, hours: list[float], functions=ft.NUMERIC) -> DataFrame:
    """``pid, feature, entries``: the aggregates of every series after each landmark that adds events, in order.

    An event is folded into the first landmark that sees it, so a series has at most one part a landmark, and
    entries are running merges of its parts. Medians come from one ordering of the series' values, cut off at each
    landmark; those of series with more than ``SMALL`` values from ``long_medians``.
    """
    rows = _seen_rows(events, starts, hours)
    order = F.struct("ts", "event_id")
    first, last = F.min(F.struct(order.alias("o"), F.col("value").alias("v"))), F.max(F.struct(order.alias("o"), F.col("value").alias("v")))
    aggregates = {
        "n": F.count("*"),
        "m": F.avg("value"),
        "m2": F.var_pop("value") * F.count("*"),
        "lo": F.min("value"),
        "hi": F.max("value"),
        "f": first,
        "l": last,
    }
    medians = None
    if "median" in functions:
        rows = rows.select(*SERIES, "lm", "value", "ts", "event_id")
        long = events.groupBy(*SERIES).agg(F.count("value").alias("n")).filter(F.col("n") > SMALL).select(*SERIES)
        if not long.isEmpty():
            long = cut_lineage(long)
            medians = long_medians(rows.join(long, SERIES, "left_semi"), len(hours))
            rows = rows.join(long.withColumn("long", F.lit(True)), SERIES, "left")
        short = F.col("value") if medians is None else F.when(F.col("long").isNull(), F.col("value"))
        aggregates["vals"] = F.collect_list(short)
    parts = rows.groupBy(*SERIES, "lm").agg(*[c.alias(name) for name, c in aggregates.items()])
    series = parts.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("lm", *aggregates))).alias("parts"))
    merges = ["lm", "n", "m", "m2", "lo", "hi", "f", "l"]
    series = series.withColumn("merged", _running(F.transform("parts", lambda p: F.struct(*[p[c].alias(c) for c in merges]))))
    entries = F.transform("merged", lambda e: _finished(e, functions))
    if "median" not in functions:
        return series.select(*SERIES, entries.alias("entries"))
    tagged = F.flatten(F.transform("parts", lambda p: F.transform(p["vals"], lambda v: F.struct(v.alias("v"), p["lm"].alias("lm")))))
    series = series.select(*SERIES, entries.alias("entries"), F.array_sort(tagged).alias("ordered"))
    found = lambda e: _middle(F.col("ordered"), e["lm"])
    if medians is not None:
        known = medians.groupBy(*SERIES).agg(F.map_from_entries(F.collect_list(F.struct("lm", "median"))).alias("known"))
        series = series.join(known, SERIES, "left")
        found = lambda e: F.coalesce(F.try_element_at("known", e["lm"]), _middle(F.col("ordered"), e["lm"]))
    return series.select(*SERIES, F.transform("entries", lambda e: e.withField("median", found(e))).alias("entries"))


def landmark_stats(events: DataFrame, starts: DataFrame, hours: list[float], functions=ft.NUMERIC) -> DataFrame:
    """Numeric aggregates per (landmark, pid, feature) of the events up to ``start + landmark``.

    Neither events nor values are repeated for the landmarks that see them: an entry of a series holds until the
    next one, and only finished rows are laid out over the landmarks.
    """
    series = landmark_series(events, starts, hours, functions)
    until = lambda i: F.coalesce(F.get("entries", i + 1)["lm"], F.lit(len(hours)))
    held = F.transform("entries", lambda e, i: F.struct(F.sequence(e["lm"], until(i) - 1).alias("lms"), e.alias("e")))
    rows = series.select(*SERIES, F.explode(held).alias("h")).select(*SERIES, F.explode("h.lms").alias("lm"), "h.e")
    hour = F.element_at(F.lit([float(h) for h in hours]), F.col("lm") + 1).alias("landmark")
    return rows.select(hour, *SERIES, *[F.col("e")[f].alias(f) for f in functions])


def landmark_counts(labels: DataFrame, starts: DataFrame, hours: list[float]) -> DataFrame:
    """Label counts per (landmark, pid, value), merged along the landmarks as above."""
    rows = _first_landmark(labels.join(starts.select("pid", "start_ts"), "pid"), hours)
    part = rows.groupBy("pid", "value", "lm").agg(F.count("*").alias("n"))
    # the count holds for every later landmark too: spread the few partial rows, then sum
    spread = part.withColumn("landmark", F.explode(F.slice(F.lit([float(h) for h in hours]), F.col("lm") + 1, len(hours))))
    return spread.groupBy("landmark", "pid", "value").agg(F.sum("n").alias("n"))


def landmark_dataset(
    events: DataFrame, base: DataFrame, hours: list[float], features: list[str], concept: str, functions=("first", "last", "min", "max", "mean", "std", "count")
) -> DataFrame:
    """Wide feature table keyed by (landmark, pid) with one feature space for all landmarks; every
    entity has a row at every landmark, missing features are 0."""
    series = landmark_series(events.filter(F.col("feature").isin(*features)), base, hours, functions)
    each = [f"__e{i}" for i in range(len(features))]
    wide = series.groupBy("pid").agg(*[F.first(F.when(F.col("feature") == f, F.col("entries")), ignorenulls=True).alias(e) for f, e in zip(features, each)])
    at = F.sequence(F.lit(0), F.lit(len(hours) - 1))

    def then(entries: str, lm: Column) -> Column:
        seen = F.filter(entries, lambda e: e["lm"] <= lm)
        return F.get(seen, F.size(seen) - 1)

    laid = base.select("pid").distinct().join(wide, "pid", "left")
    rows = F.transform(at, lambda lm: F.struct(lm.alias("lm"), *[then(e, lm).alias(e) for e in each]))
    laid = laid.select("pid", F.explode(rows).alias("r"))
    hour = F.element_at(F.lit([float(h) for h in hours]), F.col("r.lm") + 1).alias("landmark")
    values = [F.coalesce(F.col("r")[e][fn], F.lit(0.0)).alias(f"{f}_{concept}_{fn}") for fn in functions for f, e in zip(features, each)]
    return laid.select(hour, "pid", *values)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there; the writer leaves no files behind before it commits."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    return True


def _kept(df: DataFrame, path: str) -> DataFrame:
    """``df`` written under ``path``, unless it is there already."""
    if not _exists(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _landmark_rows(dataset: DataFrame, columns: list[str], label, fold, hours: list[float]) -> DataFrame:
    """Rows as the learner takes them, in ranges of landmark and entity: a task has few landmarks, and a large landmark has many tasks.

    An entity has a row at every landmark, so the ranges are even by the landmark's place and the entity's hash;
    nothing is sampled for them, which would lay out the dataset twice. Unknown landmarks go with the first."""
    rows = dataset.select(F.col("landmark").cast("double").alias("group"), F.col("pid").alias("id"), fold.alias("fold"), label.cast("double").alias("label"), *columns)
    parts = int(dataset.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = sorted({float(h) for h in hours}) or [0.0]
    place = F.greatest(F.coalesce(F.array_position(F.lit(known), F.col("group")), F.lit(1)) - 1, F.lit(0))
    within = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20)
    return rows.repartitionById(parts, F.floor((place + within) * parts / len(known)).cast("int"))


_EDGES = "group double, columns array<string>, edges array<array<double>>"


def fit_landmarks(
    dataset: DataFrame, labels: DataFrame, hours: list[float], columns: list[str], path: str, folds: int = 5, seed: int = 2024, rule: boosting.Rule = boosting.Rule()
) -> tuple[boosting.Forest, DataFrame]:
    """The models of all landmarks and folds, and the binned rows they were fitted to.

    ``dataset(landmark, pid, columns…)``, ``labels(pid, label, holdout)``. Training entities get a fold, holdout
    ones -1: their model is fitted to all training entities. Rows, bin edges and trees are kept under ``path``, so
    a stopped run goes on where it was.
    """
    spark = dataset.sparkSession
    split = stratified_folds(labels.filter(~F.col("holdout")), "label", "pid", folds, seed).select("pid", "label", F.col("fold").cast("int").alias("fold"))
    known = split.unionByName(labels.filter("holdout").select("pid", "label", F.lit(-1).alias("fold")))
    rows = _landmark_rows(dataset.filter(F.col("landmark").isin(*hours)).join(known, "pid"), columns, F.col("label"), F.col("fold"), hours)
    rows = _kept(rows, f"{path}/rows")
    if not _exists(spark, f"{path}/edges"):
        edges = boosting.edges_of(rows, columns, rule)
        spark.createDataFrame([(g, columns, [x.tolist() for x in e]) for g, e in edges.items()], _EDGES).coalesce(1).write.mode("overwrite").parquet(f"{path}/edges")
    forest = boosting.Forest(rule, columns, _edges(spark, path)[0])
    table = _kept(boosting.binned(rows, forest), f"{path}/binned")
    return boosting.fit(table, forest, folds, f"{path}/trees"), table


def _edges(spark: SparkSession, path: str) -> tuple[dict, list[str]]:
    saved = spark.read.schema(_EDGES).parquet(f"{path}/edges").collect()
    return {r["group"]: [np.array(e) for e in r["edges"]] for r in saved}, list(saved[0]["columns"]) if saved else []


def out_of_fold(
    dataset: DataFrame, labels: DataFrame, hours: list[float], columns: list[str], path: str, folds: int = 5, seed: int = 2024, rule: boosting.Rule = boosting.Rule()
) -> DataFrame:
    """Leak-free scores per landmark: ``landmark, pid, fold, pred``. Training entities are scored by models that
    did not see them (k folds), holdout entities (fold -1) by a model of all training entities."""
    forest, table = fit_landmarks(dataset, labels, hours, columns, path, folds, seed, rule)
    return boosting.score(table, forest).select(F.col("group").alias("landmark"), F.col("id").alias("pid"), "fold", "pred")


def load_landmarks(spark: SparkSession, path: str, folds: int = 5, rule: boosting.Rule = boosting.Rule()) -> boosting.Forest:
    """The models kept under ``path``; only those, nothing is fitted."""
    edges, columns = _edges(spark, path)
    forest = boosting.Forest(rule, columns, edges)
    none = spark.createDataFrame([], "group double, id long, fold int, label double, bins binary")
    for t in range(rule.trees):
        if not _exists(spark, f"{path}/trees/tree{t}"):
            raise ValueError(f"the fit under {path} was stopped before tree {t}")
    return boosting.fit(none, forest, folds, f"{path}/trees")


def score_landmarks(dataset: DataFrame, forest: boosting.Forest, use: str = "all", folds: int = 5) -> DataFrame:
    """Scores of entities that took no part in a fit: ``landmark, pid, pred``.

    ``use``: the model of ``all`` training entities (the one to deploy), or the mean of the ``folds``' models.
    A landmark without a model gives NULL.
    """
    rows = _landmark_rows(dataset, forest.columns, F.lit(0.0), F.lit(-1), list(forest.edges))
    models = {"all": [-1], "folds": list(range(folds))}[use]
    scored = boosting.score(boosting.binned(rows, forest), forest, models)
    return scored.select(F.col("group").alias("landmark"), F.col("id").alias("pid"), "pred")


def prediction_channel(base: DataFrame, predictions: DataFrame, grid: Grid = DEFAULT_GRID, name: str = "landmark_pred") -> DataFrame:
    """Landmark predictions as a series: each cell takes the latest one made at or before its start;
    NULL before the first. ``predictions(pid, landmark, pred)``."""
    starts = F.posexplode(F.lit([c.lo / 60.0 for c in grid.steps])).alias("step", "h")
    cells = base.select("pid", starts).withColumn("step", F.col("step").cast("int"))
    filled = as_of(cells, predictions, ["pid"], "h", "landmark", "pred", 168.0)
    return filled.select("pid", "step", F.lit(name).alias("feature"), F.col("pred").alias("value"))
