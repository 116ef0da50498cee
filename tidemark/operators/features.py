"""Per-entity aggregates, series, encodings and tensor exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import to_number
from tidemark.operators.joins import first_per_key, range_join
from tidemark.operators.numbering import number_columns, number_distinct
from tidemark.operators.quantiles import group_quantiles
from tidemark.operators.sliced import running_number

NUMERIC = ("first", "last", "min", "max", "mean", "std", "count", "median")


def clean_name(value: str) -> str:
    for mark in " /-":
        value = value.replace(mark, "_")
    return value


def numeric_stats(events: DataFrame, functions=NUMERIC, keys: tuple[str, ...] = ("pid",)) -> DataFrame:
    """Long numeric aggregates per (keys, feature): one grouped pass; the exact median is added
    from ranked counts. First and last follow (ts, event_id)."""
    rows = events.withColumn("__x", to_number(F.col("value"))).filter(F.col("__x").isNotNull())
    order = F.struct("ts", "event_id")
    build = {
        "first": F.min_by("__x", order),
        "last": F.max_by("__x", order),
        "min": F.min("__x"),
        "max": F.max("__x"),
        "mean": F.avg("__x"),
        "std": F.stddev_samp("__x"),
        "count": F.count("__x").cast("double"),
    }
    by = [*keys, "feature"]
    out = rows.groupBy(*by).agg(*[build[f].alias(f) for f in functions if f != "median"])
    if "median" in functions:
        out = out.join(group_quantiles(rows, by, "__x", {"median": 0.5}), by)
    return out


def numeric_features(
    events: DataFrame, features: list[str], concept: str, functions=NUMERIC, keys: tuple[str, ...] = ("pid",)
) -> DataFrame:
    """Wide ``{feature}_{concept}_{function}`` columns per entity, missing 0. ``features`` is the
    known vocabulary, so the wide schema costs no extra job."""
    stats = numeric_stats(events.filter(F.col("feature").isin(*features)), functions, keys)
    aggs = [
        F.coalesce(F.max(F.when(F.col("feature") == f, F.col(fn))), F.lit(0.0)).alias(f"{f}_{concept}_{fn}")
        for fn in functions
        for f in features
    ]
    return stats.groupBy(*keys).agg(*aggs)


def label_features(events: DataFrame, values: list[str], concept: str, keys: tuple[str, ...] = ("pid",)) -> DataFrame:
    """``{value}_{concept}_given`` (0/1) and ``…_count`` per entity over a known vocabulary."""
    counts = events.filter(F.col("value").isin(*values)).groupBy(*keys).agg(
        *[F.sum((F.col("value") == v).cast("long")).alias(f"{clean_name(v)}_{concept}_count") for v in values]
    )
    given = {
        f"{clean_name(v)}_{concept}_given": (F.col(f"{clean_name(v)}_{concept}_count") > 0).cast("int") for v in values
    }
    return counts.withColumns(given)


def assemble_dataset(static: DataFrame, parts: list[DataFrame], key: str = "pid", keep: tuple[str, ...] = ()) -> DataFrame:
    """Static rows with all feature parts joined; missing features are 0, key and ``keep`` columns stay."""
    out = static
    for p in parts:
        out = out.join(p, key, "left")
    fill = [f.name for f in out.schema.fields if f.name not in (key, *keep) and f.dataType.typeName() in ("double", "integer", "long", "float")]
    return out.fillna(0, subset=fill)


def feature_types(dataset: DataFrame, concept_suffixes: tuple[str, ...] = ("_given",)) -> dict[str, list[str]]:
    """Feature names by type, read from the naming rule."""
    cat = [c for c in dataset.columns if c.endswith(concept_suffixes)]
    return {"categorical": cat, "continuous": [c for c in dataset.columns if c not in cat]}


def split_target(dataset: DataFrame, target: str, key: str = "pid") -> tuple[DataFrame, DataFrame]:
    return dataset.drop(target), dataset.select(key, target)


# ---- series ----------------------------------------------------------------------------


def series(cells: DataFrame, n_steps: int, value: str = "value", keys: tuple[str, ...] = ("pid", "feature")) -> DataFrame:
    """One array per series at absolute steps, gaps NULL; a repeated step raises. A series has at most ``n_steps``
    cells, so what is collected is bounded by the grid. Its cells are ordered, and each one fills the gap after it."""
    pairs = F.sort_array(F.collect_list(F.when(F.col("step") >= 0, F.struct("step", F.col(value).alias("v")))))
    out = cells.filter(F.col("step") < n_steps).groupBy(*keys).agg(pairs.alias("__m"))
    nothing = F.lit(None).cast(cells.schema[value].dataType)

    def upto_next(cell: Column, i: Column) -> Column:
        gap = F.coalesce(F.get("__m", i + 1)["step"], F.lit(n_steps)) - cell["step"] - 1
        return F.concat(F.array(cell["v"]), F.array_repeat(nothing, gap.cast("int")))

    lead = F.array_repeat(nothing, F.coalesce(F.get("__m", F.lit(0))["step"], F.lit(n_steps)).cast("int"))
    out = out.withColumn("values", F.concat(lead, F.flatten(F.transform("__m", upto_next))))
    whole = F.size("values") == n_steps
    return out.select(*keys, F.when(whole, F.col("values")).otherwise(F.raise_error(F.lit("a series repeats a step"))).alias("values"))


def label_series(labels: DataFrame, n_steps: int, keys: tuple[str, ...] = ("pid", "feature")) -> DataFrame:
    """Series whose cells hold the sorted distinct labels of a step (absolute steps)."""
    cell = labels.groupBy(*keys, "step").agg(F.array_sort(F.collect_set("value")).alias("value"))
    return series(cell, n_steps, keys=keys)


def series_to_cells(frame: DataFrame, keys: tuple[str, ...] = ("pid", "feature")) -> DataFrame:
    """Arrays back to rows."""
    return frame.select(*keys, F.posexplode("values").alias("step", "value"))


def vocabulary(labels: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Sorted vocabulary with 0-based index per feature and the feature's offset in the joint
    dimension. Works on distinct labels only."""
    words = number_distinct(labels.filter(F.col(value).isNotNull()), [feature, value], "__n")
    # numbers run through all features in order, so a feature's offset is its first number
    features = words.groupBy(feature).agg(F.count("*").cast("int").alias("n_classes"), (F.min("__n") - 1).cast("int").alias("offset"))
    return words.join(features, feature).withColumn("idx", (F.col("__n") - 1 - F.col("offset")).cast("int")).select(feature, value, "idx", "n_classes", "offset")


def multi_hot(labels: DataFrame, words: DataFrame) -> DataFrame:
    """Long 1s ``pid, step, dim``; labels outside the vocabulary are ignored."""
    hit = labels.join(words.select("feature", "value", (F.col("offset") + F.col("idx")).alias("dim")), ["feature", "value"])
    return hit.select("pid", "step", "dim").distinct()


def dense_tensor(cells: DataFrame, features: list[str], n_steps: int, value: str = "value") -> DataFrame:
    """Per entity a channel x step nested array (sorted channels, absent ones all NULL)."""
    arrays = series(cells.filter(F.col("feature").isin(*features)), n_steps, value)
    empty = F.array_repeat(F.lit(None).cast("double"), n_steps)
    by = arrays.groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("feature", "values"))).alias("m"))
    channels = [F.coalesce(F.try_element_at("m", F.lit(f)), empty) for f in sorted(features)]
    return by.select("pid", F.array(*channels).alias("tensor"))


def trajectory_lengths(cells: DataFrame, value: str = "value", exclude: tuple[str, ...] = ()) -> DataFrame:
    """Last step with a present (non-null, non-zero) channel plus one; 0 when there is none."""
    present = F.col(value).isNotNull() & (F.abs(F.col(value)) > 1e-8)
    if exclude:
        present = present & ~F.col("feature").isin(*exclude)
    return cells.groupBy("pid").agg(F.coalesce(F.max(F.when(present, F.col("step"))) + 1, F.lit(0)).alias("traj_len"))


# ---- encodings -------------------------------------------------------------------------


def na_indicators(df: DataFrame, columns: list[str]) -> DataFrame:
    """``{col}_na`` flags; NULL numbers become 0."""
    flags = {f"{c}_na": F.col(c).isNull() for c in columns}
    return df.withColumns(flags).withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in columns})


def category_codes(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Integer codes by sorted value, from 1; 0 is unknown or missing. Vocabularies are fitted on
    ``fit_on`` (train and holdout together) and joined by equality."""
    out = df
    fit = fit_on if fit_on is not None else df
    numbers = number_columns(fit, {c: F.col(c).isNotNull() & (F.col(c).cast("string") != "#na#") for c in columns})
    for c, codes in numbers.items():
        out = out.join(codes, c, "left").withColumn(c, F.coalesce("code", F.lit(0)).cast("int")).drop("code")
    return out.select(*df.columns)


def one_hot(df: DataFrame, vocabularies: dict[str, list[str]], numeric: list[str], key: str = "pid") -> DataFrame:
    """Fixed feature space: ``{col}_{value}`` flags for the expected vocabulary (unknown values and
    missing columns give zeros), then the expected numeric columns (missing ones 0)."""
    cols: list[Column] = [F.col(key)]
    for c, values in vocabularies.items():
        for v in values:
            hit = (F.col(c).cast("string") == v) if c in df.columns else F.lit(False)
            cols.append(F.coalesce(hit, F.lit(False)).cast("double").alias(f"{c}_{v}"))
    for c in numeric:
        cols.append((F.col(c).cast("double") if c in df.columns else F.lit(0.0)).alias(c))
    return df.select(*cols)


# ---- selections ------------------------------------------------------------------------


def latest_before_end(measures: DataFrame, base: DataFrame, features: list[str]) -> DataFrame:
    """Latest value of each feature at or before the entity's end, one column per feature."""
    rows = measures.join(base.select("pid", "end_ts"), "pid").filter(F.col("ts") <= F.col("end_ts"))
    last = first_per_key(rows, ["pid", "feature"], [F.col("ts"), F.col("event_id")], ["value"], last=True)
    return last.groupBy("pid").agg(*[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in features])


def numbered_codes(codes: DataFrame, base: DataFrame, offset_days: int = 1) -> DataFrame:
    """Codes inside the padded stay numbered per entity in (ts, code) order: the long form of
    ``code_1 … code_n``, with no bound on n."""
    from tidemark.operators.joins import days_after, days_before

    rows = range_join(
        codes, base, ["pid"], "ts", days_before(F.col("start_ts"), offset_days), days_after(F.col("end_ts"), offset_days), None
    )
    rows = rows.select("pid", "ts", "code", "event_id")
    return running_number(rows, ["pid"], ["ts", "code", "event_id"], "position", width="30 day")


def codes_in_order(numbered: DataFrame) -> DataFrame:
    """All codes of an entity as one array in order, and how many there are."""
    rows = F.array_sort(F.collect_list(F.struct("position", "code")))
    return numbered.groupBy("pid").agg(F.transform(rows, lambda r: r["code"]).alias("codes"), F.max("position").alias("n_code"))


def score_times(scores: DataFrame, codes: DataFrame, base: DataFrame, offset_days: int = 1) -> DataFrame:
    """First non-null score column with the time of the entity's latest code in the padded stay."""
    from tidemark.operators.joins import days_after, days_before

    rows = range_join(
        codes.select("pid", "ts"),
        base,
        ["pid"],
        "ts",
        days_before(F.col("start_ts"), offset_days),
        days_after(F.col("end_ts"), offset_days),
        None,
    )
    latest = rows.groupBy("pid").agg(F.max("ts").alias("ts"))
    value = F.coalesce(*[F.col(c) for c in scores.columns if c != "pid"])
    out = scores.select("pid", value.alias("value")).filter(F.col("value").isNotNull())
    return out.join(latest, "pid").select("pid", "ts", F.lit("ISS").alias("feature"), "value")


def max_over_sources(sources: list[DataFrame], key: str = "pid", value: str = "value") -> DataFrame:
    out = sources[0].select(key, value)
    for s in sources[1:]:
        out = out.unionByName(s.select(key, value))
    return out.groupBy(key).agg(F.max(value).alias(value))


def row_max(columns: list[str]) -> Column:
    """Largest of several columns, NULLs ignored."""
    return F.greatest(*[F.col(c) for c in columns])


def join_lines(lines: DataFrame, keys: list[str], order: list[str], text: str, sep: str = " ") -> DataFrame:
    """Lines of a note in order as one text. The group is one note; its lines are pre-sorted pieces."""
    pieces = F.array_sort(F.collect_list(F.struct(*order, text)))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda p: p[text]), sep).alias(text))
