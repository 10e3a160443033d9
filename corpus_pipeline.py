"""Corpus pipeline: five corpus operators in a row over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; all but the last with
the columns of ``documents``. Stages judge whatever their predecessor kept, so counts and
thresholds are of that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import decontaminate, line_dedup, mixing, quality_rules, simhash
from parley.llm.common import discard, kept_at, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Texts that are null, empty or short go; repeated rows are judged alike, null languages and sources as groups of their own; no documents give none."""
    return quality_rules.quality_rules(docs).where("_quality.kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them hold; n_chars follows the text. A null text is one empty line; repeated rows count as one document where they share an id; none are dropped."""
    out = line_dedup.line_dedup(docs.select(*COLUMNS))
    text = F.col("_lines.kept")
    return out.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("_lines.n_dropped") > 0, F.length(text).cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of smallest id. Rows that repeat an id are documents of their own, those without an id all stay; texts without words are alike; no documents give none."""
    return simhash.keep_one(docs.select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item. Null and empty texts share none; repeated rows are judged alike; without items all stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs.select(*COLUMNS), items).where(~F.col("_contamination.contaminated")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with how many it takes. Null and empty texts have none to take; ties go by hash, id and text; null sources are one source, the last."""
    out = mixing.mix(docs.select(*COLUMNS)).where("_mix.taken > 0")
    return out.select(*COLUMNS, "_mix.size", "_mix.source_size", "_mix.target", "_mix.taken")


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-duplicates", near_duplicates), ("decontamination", benchmark), ("mixing", mixture)]

#: Fingerprints and thresholds go beyond SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again, and whatever it was made from deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs, path = kept_at(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before is not None:
            discard(spark, before)
        before = path
    return docs
