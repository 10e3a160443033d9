"""Corpus operators for large training-data pipelines (self-contained subpackage)."""
