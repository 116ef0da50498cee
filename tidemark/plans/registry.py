"""Registry of named queries with their independent SQL."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import prepare

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


class Tables:
    """The given tables, read lazily, plus the standard frames the queries share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def ev(self) -> DataFrame:
        """events as standard long events."""
        return self.events.select(
            F.col("user_id").alias("pid"),
            "ts",
            F.col("event_type").alias("feature"),
            "value",
            "event_id",
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )

    @property
    def base(self) -> DataFrame:
        """one stay per user: first to last event."""
        return self.events.groupBy(F.col("user_id").alias("pid")).agg(
            F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")
        )

    @property
    def coded(self) -> DataFrame:
        """order lines as coded, dosed events of customers."""
        line = self.lineitem.select(
            "l_orderkey",
            "l_linenumber",
            F.col("l_shipdate").alias("ts"),
            F.col("l_partkey").alias("p_partkey"),
            F.col("l_quantity").alias("dose"),
            F.col("l_returnflag").alias("unit"),
        )
        orders = self.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("pid"))
        part = self.part.select("p_partkey", F.col("p_type").alias("ptype"), F.col("p_brand").alias("brand"))
        return line.join(orders, "l_orderkey").join(part, "p_partkey")

    @property
    def stay(self) -> DataFrame:
        """one long stay per customer: first to last order date."""
        return self.orders.groupBy(F.col("o_custkey").alias("pid")).agg(
            F.min("o_orderdate").alias("start_ts"), F.max("o_orderdate").alias("end_ts")
        )

    def lit_frame(self, rows, schema: str) -> DataFrame:
        """A lookup of fixed size."""
        return self.spark.createDataFrame(rows, schema)


QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

# SQL building blocks, written independently of the Spark code (the grid as a range join)
CTE = {
    "ev": """ev AS (SELECT user_id AS pid, ts, event_type AS feature, value, event_id,
      CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
    "base": """base AS (SELECT user_id AS pid, min(ts) AS start_ts, max(ts) AS end_ts FROM events GROUP BY 1)""",
    "seg": """seg(b, s, e, f, lab) AS (VALUES (0,0,360,10,'10min'), (36,360,720,20,'20min'), (54,720,1440,60,'1h'),
      (66,1440,4320,240,'4h'), (78,4320,20160,720,'12h'), (100,20160,43200,1440,'1D'))""",
    "grid": """grid AS (SELECT CAST(b + u.i AS INT) AS step, s + u.i * f AS lo, s + (u.i + 1) * f AS hi, lab
      FROM seg, UNNEST(generate_series(0, (e - s) // f - 1)) AS u(i))""",
    "mapped": """mapped AS (SELECT ev.*, g.step FROM ev JOIN base USING (pid) JOIN grid g
      ON epoch_us(ev.ts) - epoch_us(base.start_ts) >= g.lo * 60000000
      AND epoch_us(ev.ts) - epoch_us(base.start_ts) < g.hi * 60000000)""",
    "stay": """stay AS (SELECT o_custkey AS pid, min(o_orderdate) AS start_ts, max(o_orderdate) AS end_ts
      FROM orders GROUP BY 1)""",
    "coded": """coded AS (SELECT o_custkey AS pid, l_orderkey, l_linenumber, l_shipdate AS ts, l_quantity AS dose,
      l_returnflag AS unit, p_type AS ptype, p_brand AS brand
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""",
    "nexts": """nexts AS (SELECT pid, feature, value, event_id, ts, lead(ts) OVER (PARTITION BY pid ORDER BY ts, event_id) AS end_ts
      FROM ev)""",
}


def with_(*names: str) -> str:
    """``WITH`` clause of the named building blocks."""
    return "WITH " + ",\n".join(CTE[n] for n in names)


def query(name: str, sql: str | None = None):
    """Register a query; the README names those without SQL and how they are tested."""

    def keep(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        QUERIES[name].__doc__ = inspect.getdoc(fn)
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def rounded(df: DataFrame, digits: int = 6, only: tuple | None = None) -> DataFrame:
    """Doubles rounded for comparison; -0.0 becomes 0.0."""
    cols: list[Column] = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double" and (only is None or f.name in only):
            cols.append((F.round(f.name, digits) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
