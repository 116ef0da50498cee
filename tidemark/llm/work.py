"""Tables that cut lineage, and small parts the operators share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir


def folder(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it: later jobs and retries see the same rows."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tasks that ``gathered`` leaves for each core, and shuffle partitions that share one of them at most.
WAVES, SHARED = 3, 8


def gathered(df: DataFrame) -> DataFrame:
    """``df`` in fewer tasks, without a shuffle, for steps whose price is mostly that of a task (a file, a Python run).

    A task goes through its shuffle partitions one after the other, so its memory is still that of one of them.
    There stay tasks enough for several waves over all cores, however few cores are there when this is called.
    """
    spark = df.sparkSession
    return df.coalesce(max(WAVES * spark.sparkContext.defaultParallelism, -(-slots(spark) // SHARED)))


def slots(spark: SparkSession) -> int:
    """How many ranges packed intermediate data is dealt into: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """On a local master, give Python workers this package; on a cluster it is submitted with the job."""
    context = spark.sparkContext
    if context.master.startswith("local") and "cluster" not in context.master and context.applicationId not in _shipped:
        context.addFile(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), recursive=True)
        _shipped.add(context.applicationId)


#: Keys of ``hot_join`` that are broadcast at most.
HOT = 1000


def hot_join(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """Inner join of ``many`` with ``one`` (a row for each ``key``), however many rows of ``many`` share a key.

    The rows of the ``HOT`` most frequent keys meet a broadcast of at most ``HOT`` rows of ``one``; any other key
    has less than 1 / ``HOT`` of all rows and is joined by a shuffle.
    """
    top = many.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), key).limit(HOT).select(key)
    top = written(top)
    hot = F.broadcast(written(one.join(F.broadcast(top), key, "left_semi")))
    rest = many.join(F.broadcast(top), key, "left_anti").join(one.join(F.broadcast(top), key, "left_anti"), key)
    return many.join(hot, key).unionByName(rest)
