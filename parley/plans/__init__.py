"""Registered queries: each a function of (spark, sf_dir), with DuckDB SQL for the same rows where SQL can express it."""

from parley.plans import audit_queries, catalog_queries, corpus_queries, export_queries, interval_queries, misalignment_queries, offset_queries, proposition_queries, read_queries, repair_queries, review_queries, snapshot_queries, stream_queries, supervision_queries, turn_queries
from parley.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "audit_queries", "catalog_queries", "corpus_queries", "export_queries", "interval_queries", "misalignment_queries", "offset_queries", "proposition_queries", "read_queries", "repair_queries", "review_queries", "snapshot_queries", "stream_queries", "supervision_queries", "turn_queries"]
