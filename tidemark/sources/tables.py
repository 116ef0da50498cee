"""Reading sources: cohort scans, delimited files, multi-source mappings, entity store, sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import normal_id, parse_timestamp


def cohort_scan(table: DataFrame, cohort: DataFrame, key: str, cohort_key: str | None = None) -> DataFrame:
    """Rows of a source whose key is in the cohort. Large files need no chunking: the scan is
    split by Spark and the semi join is broadcast only if the keys prove small at run time."""
    keys = cohort.select(F.col(cohort_key or key).alias(key)).distinct()
    return table.join(keys, key, "left_semi")


def cohort_by_code(procedures: DataFrame, code: str, code_col: str, columns: list[str]) -> DataFrame:
    """Seed of a cohort: rows with one procedure code."""
    return procedures.filter(F.col(code_col) == code).select(*columns).distinct()


BAD = "_bad_line"


def read_delimited(spark: SparkSession, paths, schema: T.StructType, sep: str = ",", header: bool = True) -> DataFrame:
    """Delimited files with an explicit schema; unreadable lines are kept aside in ``_bad_line``
    instead of failing the job, a leading unnamed index column is dropped."""
    with_bad = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    df = (
        spark.read.schema(with_bad)
        .option("sep", sep)
        .option("header", str(header).lower())
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD)
        .option("enforceSchema", "true")
        .csv(paths)
    )
    return df.drop("_index")


def parse_delimited(lines: DataFrame, column: str, schema: str, sep: str) -> DataFrame:
    """The same parser over a text column."""
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    parsed = lines.select(F.from_csv(column, f"{schema}, {BAD} string", options).alias("r"))
    return parsed.select("r.*")


def split_bad_lines(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines)."""
    return df.filter(F.col(BAD).isNull()).drop(BAD), df.filter(F.col(BAD).isNotNull()).select(BAD)


@dataclass(frozen=True)
class MappingSource:
    """One id-mapping source with its region tag and time format."""

    region: str
    frame: DataFrame
    timestamp_format: str = "iso"  # iso or sas


def load_mappings(sources: list[MappingSource]) -> DataFrame:
    """Union of id mappings ``(key, journal_id, created)`` with normalised ids, parsed times and
    a region tag; one row per (key, journal_id): the first source in list order, earliest time."""
    out = None
    for rank, s in enumerate(sources):
        rows = s.frame.select(
            F.col("key").cast("string").alias("key"),
            normal_id(F.col("journal_id")).alias("journal_id"),
            parse_timestamp(F.col("created")).alias("created_ts"),
            F.lit(s.region).alias("region"),
            F.lit(rank).alias("__rank"),
        )
        out = rows if out is None else out.unionByName(rows)
    best = F.min(F.struct("__rank", "created_ts", "region")).alias("m")
    picked = out.groupBy("key", "journal_id").agg(best)
    return picked.select("key", "journal_id", F.col("m.created_ts").alias("created_ts"), F.col("m.region").alias("region"))


def bridge_join(
    events: DataFrame, mapping: DataFrame, base: DataFrame, max_hours_before: float = 48
) -> tuple[DataFrame, DataFrame]:
    """Link events to entities through journal ids, for journals made from ``max_hours_before``
    before the start up to the end. Returns (events with pid, distinct pid-region links)."""
    links = base.select("key", "pid", "start_ts", "end_ts").join(mapping, "key")
    floor = F.col("start_ts") - F.expr(f"make_dt_interval(0, 0, 0, {max_hours_before * 3600:.6f})")
    links = links.filter((F.col("created_ts") <= F.col("end_ts")) & (F.col("created_ts") >= floor))
    linked = events.join(links.select("journal_id", "pid", "region").distinct(), "journal_id")
    return linked, links.select("key", "pid", "region", "start_ts", "end_ts").distinct()


def resolve_codes(
    dimension: DataFrame, label: str, code: str, wanted: dict[str, str], fallback: dict[str, str], contains: bool = False,
    datatype: tuple[str, str] | None = None,
) -> DataFrame:
    """``(name, code)`` rows of a code dimension for wanted labels ``{name: label}``; names
    without a hit use the fallback. ``contains`` matches parts of labels."""
    dim = dimension
    if datatype is not None:
        dim = dim.filter(F.col(datatype[0]) == datatype[1])
    spark = dimension.sparkSession
    want = spark.createDataFrame(
        [(n, w.lower(), fallback.get(n)) for n, w in wanted.items()], "name string, label string, spare string"
    )
    text = F.lower(F.col(label))
    # the wanted labels are a fixed list, so they travel as one literal array, not as a join
    hits = F.filter(
        F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w.lower()).alias("label")) for n, w in wanted.items()]),
        (lambda w: F.contains(text, w["label"])) if contains else (lambda w: text == w["label"]),
    )
    found = dim.withColumn("w", F.explode(hits)).select(F.col("w.name").alias("name"), F.col(code).alias("found")).distinct()
    out = want.join(found, "name", "left")
    return out.select("name", F.coalesce("found", "spare").alias("code")).filter(F.col("code").isNotNull())


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_slots(spark: SparkSession, buckets: int) -> int:
    """Write tasks of one bucket: the session's shuffle partitions, dealt over the buckets."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)


def write_entity_store(table: DataFrame, path: str, key: str, buckets: int = 256) -> None:
    """Table laid out by hash bucket of the entity and sorted inside, so that one entity is one
    pruned folder and a few row groups. A bucket may be spread over several files: rows are
    distributed by (bucket, file slot), so that a hot entity is not one task."""
    slots = F.pmod(F.xxhash64(*table.columns), F.lit(write_slots(table.sparkSession, buckets)))
    (
        table.withColumn("bucket", bucket_of(F.col(key), buckets))
        .repartition(F.col("bucket"), slots)
        .sortWithinPartitions("bucket", key)
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(path)
    )


def read_entity(spark: SparkSession, path: str, key: str, value, buckets: int = 256) -> DataFrame:
    """Rows of one entity: partition pruning on its bucket plus a pushed filter on the key."""
    df = spark.read.parquet(path)
    typed = F.lit(value).cast(df.schema[key].dataType)
    return df.filter((F.col("bucket") == bucket_of(typed, buckets)) & (F.col(key) == typed)).drop("bucket")


def read_entity_or(spark: SparkSession, path: str, fallback: DataFrame, key: str, value, buckets: int = 256) -> DataFrame:
    """Entity read that falls back to the whole table when the store does not exist."""
    try:
        return read_entity(spark, path, key, value, buckets)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    return fallback.filter(F.col(key) == F.lit(value))


def write_mapped(cells: DataFrame, path: str, by: str = "feature") -> None:
    """Mapped concept to parquet, one folder per feature; file counts follow the data's size."""
    cells.write.mode("overwrite").partitionBy(by).parquet(path)


def check_source(df: DataFrame, required: list[str], id_col: str, date_pattern: str = r"\d{4}-\d{2}-\d{2}|\d{2}[A-Z]{3}\d{4}:") -> DataFrame:
    """Missing and extra columns (schema only) and rows whose id looks like a date, which means
    the columns slipped: ``(check, status, detail)``."""
    missing = sorted(set(required) - set(df.columns))
    extra = sorted(set(df.columns) - set(required))
    shifted = F.sum(F.col(id_col).cast("string").rlike(date_pattern).cast("long"))
    rows = [
        F.struct(F.lit("required_columns").alias("check"), F.lit("FAIL" if missing else "PASS").alias("status"), F.lit(",".join(missing)).alias("detail")),
        F.struct(F.lit("extra_columns").alias("check"), F.lit("WARN" if extra else "PASS").alias("status"), F.lit(",".join(extra)).alias("detail")),
        F.struct(
            F.lit("shifted_columns").alias("check"),
            F.when(F.col("shifted") > 0, "FAIL").otherwise("PASS").alias("status"),
            F.coalesce("shifted", F.lit(0)).cast("string").alias("detail"),
        ),
    ]
    return df.agg(shifted.alias("shifted")).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@dataclass(frozen=True)
class SourceSpec:
    """How to read one concept table: its time column and day offset around the stay."""

    name: str
    ts_col: str
    offset_days: int = 1


def read_in_stay(tables: dict[str, DataFrame], specs: list[SourceSpec], base: DataFrame, key: str) -> dict[str, DataFrame]:
    """Metadata-driven read: every table restricted to the padded stay by its own time column."""
    from tidemark.operators.joins import in_stay

    out = {}
    for s in specs:
        rows = tables[s.name].withColumn("ts", F.col(s.ts_col)).withColumnRenamed(key, "pid")
        out[s.name] = in_stay(rows.drop(*([s.ts_col] if s.ts_col != "ts" else [])), base, s.offset_days)
    return out
