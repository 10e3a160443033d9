"""Ordered folds over each key's rows, for what neither windows nor aggregates can say (a step depends on all steps before)."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame

#: Rows that a fold hands back in one Arrow batch.
OUT_ROWS = 4096


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], schema: str, step: Callable[[tuple, Iterator[tuple]], Iterable[tuple]]) -> DataFrame:
    """Rows of ``schema`` that ``step(key, rows)`` makes of each key's rows in ``order``.

    ``rows`` are tuples of all columns of ``df``, read as they come: a key's rows are sorted on disk
    where they do not fit, and never gathered, so a step keeps no more than its own state. One key
    is one task's work, as every step needs the one before. Keys may be null; ties in ``order`` are
    the caller's to break. No rows give no rows.
    """
    spark = df.sparkSession
    at = [df.columns.index(k) for k in keys]
    empty = spark.createDataFrame([], schema).toArrow().schema

    def task(batches):
        made = (row for key, rows in itertools.groupby(_rows(batches), key=lambda r: tuple(r[i] for i in at)) for row in step(key, rows))
        while part := list(itertools.islice(made, OUT_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*part, strict=True), empty, strict=True)], schema=empty)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(task, schema)
