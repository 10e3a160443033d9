"""The registered queries of the corpus operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import decontaminate, filter_audit, line_dedup, mixing, neighbours, quality_classifier, quality_rules, secret_scan, simhash, suffix_dedup, url_filter, vector_codes, warc
from parley.llm.oracles import ORACLE_SQL


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.col("_secrets.counts")
    return out.select("doc_id", n[0].alias("n_assign"), n[1].alias("n_access"), n[2].alias("n_hex"), F.sha2("_secrets.base", 256).alias("base_sha256"), "_secrets.spans")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    c = "_contamination"
    return out.select("doc_id", f"{c}.n_words", f"{c}.n_hit", f"{c}.n_items", F.sha2(F.concat_ws(",", f"{c}.items"), 256).alias("items_sha256"), f"{c}.contaminated")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    q = "_quality"
    return out.select("doc_id", f"{q}.n_words", f"{q}.word_chars", f"{q}.n_symbols", f"{q}.n_dup_lines", f"{q}.n_repeat_words", f"{q}.base_failed", f"{q}.kept")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    out = quality_classifier.quality_scores(docs, _read(spark, sf_dir, "labels"), meta_cols=("n_chars",))
    return out.select("doc_id", "_score.held_out", "_score.score", "_score.predicted")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2("_lines.kept", 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.capture_history(_read(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "_cut.n_bytes", "_cut.n_removed", "_cut.n_spans", F.sha2("_cut.kept", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(_read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", "_mix.taken")


#: Host and path rules of the URL query.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.filter_urls(_read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "_url.host", "_url.path", "_url.rule", "_url.verdict", "_url.score")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), every=100, n=10)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = vector_codes.vector_codes(_read(spark, sf_dir, "embeddings"))
    return out.withColumn("codebooks_sha256", F.lit(vector_codes.digest(books)))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), _read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_decontaminate, op3_quality_rules, op4_quality_classifier, op5_line_dedup, op6_warc, op7_suffix_dedup, op8_simhash, op9_mixing, op10_url_filter, op11_neighbours, op12_vector_codes, op13_filter_audit)} | {"pipeline": corpus_pipeline.run}

__all__ = ["ORACLE_SQL", "QUERIES"]
