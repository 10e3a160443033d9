"""The list of queries and the stand-in relations that they run on."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Width of time buckets for interval joins, and of the slices that unions are made in (microseconds).
BUCKET = 4 * 3600 * 1_000_000
SLICE = 7 * 24 * 3600 * 1_000_000


def query(sql: str | None = None):
    def add(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's rows as a stream, be it one file or a folder of parts."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech spans (k, side, start, end) in microseconds, from events: two sides per user, minutes long."""
    e = table(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("k"), (F.col("event_id") % 2 + 1).cast("int").alias("side"), start.alias("start"), (start + F.round(F.col("value") * 100).cast("bigint") * 600000).alias("end"))


SPANS = """spans AS (SELECT user_id AS k, CAST(event_id % 2 + 1 AS INTEGER) AS side, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 600000 AS e FROM events)"""

#: Union of spans by k (and side) in SQL.
def union_sql(name: str, source: str, keys: str = "k") -> str:
    return f"""{name}_m AS (SELECT {keys}, s, e, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source} WHERE e > s),
{name}_n AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM {name}_m),
{name} AS (SELECT {keys}, min(s) AS s, max(e) AS e FROM {name}_n GROUP BY {keys}, run)"""


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, low, high): from the first start to the last end of each recording."""
    return spans(spark, sf_dir).groupBy("k").agg(F.min("start").alias("low"), F.max("end").alias("high"))
