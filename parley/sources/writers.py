"""Sinks: training shards with an inventory, metadata as JSON, publication plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.sources.readers import files

SPLITS = ("train", "validation", "test")


def write_shards(df: DataFrame, root: str, rows: int = 1000) -> DataFrame:
    """Write rows by split, at most ``rows`` to a file, and return the inventory (split, file, rows, bytes, sha256). An existing target is an error."""
    spark, path = df.sparkSession, f"{root}/training"
    df.write.mode("errorifexists").partitionBy("split").option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)
    seen = files(spark, path, "*.parquet", content=True).select(F.regexp_extract("path", "split=([^/]+)/", 1).alias("split"), F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    n = spark.read.parquet(path).groupBy(F.regexp_extract(F.input_file_name(), "split=([^/]+)/", 1).alias("split"), F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("file")).agg(F.count("*").alias("rows"))
    return seen.join(n, ["split", "file"]).select("split", "file", "rows", "bytes", "sha256")


def split_summaries(df: DataFrame, duration: str) -> DataFrame:
    """Rows and total duration of each of the three splits, zeros for an empty one."""
    every = df.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    return every.join(df.groupBy("split").agg(F.count("*").alias("n"), F.sum(duration).alias("duration")), "split", "left").fillna(0, ["n", "duration"])


def write_json(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """One JSON document per row, in folders by the columns ``by``. An existing target is an error."""
    body = F.to_json(F.struct(*[c for c in df.columns if c not in by])).alias("value")
    w = df.select(*by, body).write.mode("errorifexists")
    (w.partitionBy(*by) if by else w).text(path)


def dataset_metadata(df: DataFrame, dataset: str, duration: str, versions: Sequence[str]) -> DataFrame:
    """One row per dataset: samples, total duration, and the versions that stand in it."""
    return df.groupBy(dataset).agg(F.count("*").alias("n_samples"), F.sum(duration).alias("duration"), *[F.array_sort(F.collect_set(v)).alias(v) for v in versions])


def verification_picks(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The first and, if ``n`` is 2, the last row of each key."""
    picks = [F.min_by(F.struct("*"), order)] + ([F.max_by(F.struct("*"), order)] if n > 1 else [])
    return df.groupBy(*keys).agg(F.array_distinct(F.array(*picks)).alias("_p")).select(F.explode("_p").alias("p")).select("p.*")


def summarize_plan(plan: DataFrame, size: str) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
