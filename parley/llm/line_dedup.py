"""Corpus-wide line dedup over levelled sorted runs of line hashes.

Each batch of documents has one table of its distinct line keys, hashed to 128 bits, with the
number of its documents that hold them. It is merge-joined against the runs so far: keys that
enough documents are already known to hold are left out (anti-join), all others go out as the
batch's own run, of level 0. ``fanout`` runs of one level are merged into a run of the next, so a
batch meets few runs however many came before. All tables are bucketed and sorted by key in
the same way, so neither the joins nor the merges shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import textvec as tv
from parley.llm.common import HOT_SHARE, bucketed, join_unique, kept, materialize, packed, partitions_for, scratch, shuffle_partitions, small_batches

FANOUT = 2
BATCHES = 4
#: Frequent keys (16 bytes each) that are sent to every task; with more, lines are joined to them by shuffle.
BROADCAST_KEYS = 500_000


class LineRuns:
    """Sorted runs (h binary, n: documents) by level. A key that ``min_docs`` documents hold is settled: it enters no further run."""

    def __init__(self, spark: SparkSession, min_docs: int, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.min_docs, self.buckets, self.fanout = spark, min_docs, buckets or shuffle_partitions(spark), fanout
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, counts: DataFrame) -> DataFrame:
        """Join a batch's (h, n), one row for each key, against the runs and add its own; returns (h, n, before), before: documents of earlier batches, ``min_docs`` or more if settled."""
        known = counts.select("h", "n", F.lit(0).cast("bigint").alias("before"))
        for run in self.runs():
            found = run.select("h", F.col("n").alias("_n"))
            known = known.join(found.hint("merge"), "h", "left").select("h", "n", (F.col("before") + F.coalesce("_n", F.lit(0))).alias("before"))
        batch = bucketed(known, self.buckets, "h", "line_batch")
        self.levels[0].append(batch.where(F.col("before") < self.min_docs).select("h", "n"))
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                self.compact(level)
        return batch

    def compact(self, level: int) -> None:
        merged, *rest = self.levels[level]
        for run in rest:
            merged = self._merge(merged, run)
        self.levels[level] = []
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(merged)

    def settled(self) -> DataFrame | None:
        """(h, n) of the keys that ``min_docs`` documents or more hold, over all runs."""
        runs = self.runs()
        if not runs:
            return None
        merged = runs[0]
        for run in runs[1:]:
            merged = self._merge(merged, run)
        return merged.where(F.col("n") >= self.min_docs)

    def _merge(self, one: DataFrame, other: DataFrame) -> DataFrame:
        both = one.join(other.select("h", F.col("n").alias("_n")).hint("merge"), "h", "full_outer")
        return bucketed(both.select("h", (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n")), self.buckets, "h", "line_run")


def keys(raw: bytes, min_chars: int) -> list[bytes | None]:
    """Hash of each line's key, None for keys shorter than ``min_chars``."""
    out: list[bytes | None] = []
    digest = xxhash.xxh3_128_digest
    for line in raw.split(b"\n"):
        key = line.strip().lower()
        short = len(key) < min_chars or min_chars > 1 and len(key.decode()) < min_chars
        out.append(None if short else digest(key))
    return out


def line_counts(docs: DataFrame, text_col: str, min_chars: int, batches: int) -> DataFrame:
    """(batch, h, n): documents of each batch that hold each key; several rows for a key, each the sum of a chunk."""

    def count(parts):
        for part in parts:
            batch, texts = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
            for lo, hi, data, off in tv.chunks(texts, 8 * tv.CHUNK_BYTES):
                raw, n = data.tobytes(), {}
                for d in range(hi - lo):
                    b = int(batch[lo + d])
                    for h in set(keys(raw[off[d] : off[d + 1]], min_chars)):
                        if h is not None:
                            n[b, h] = n.get((b, h), 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in n], pa.int32()), pa.array([h for _, h in n], pa.binary()), pa.array(list(n.values()), pa.int64())], ["batch", "h", "n"])

    rows = docs.select(F.pmod(F.xxhash64(text_col), F.lit(batches)).cast("int").alias("batch"), F.col(text_col).cast("string"))
    return rows.mapInArrow(count, "batch int, h binary, n bigint")


def batch_counts(docs: DataFrame, text_col: str, min_chars: int, batches: int, buckets: int) -> DataFrame:
    """(batch, h, n) of all batches from one pass over ``docs``, in buckets of ``h``."""
    rows = line_counts(docs, text_col, min_chars, batches).repartition(buckets, "h")
    return bucketed(rows.groupBy("batch", "h").agg(F.sum("n").alias("n")), buckets, "h", "line_counts")


def _clean(texts: pa.Array, dropped) -> pa.Array:
    """n_lines, n_dropped and the kept text (null where nothing is dropped); ``dropped(row, hashes)`` marks lines."""
    n_lines, n_dropped, kept = [], [], []
    for lo, hi, data, off in tv.chunks(texts):
        raw = data.tobytes()
        for d in range(hi - lo):
            own = raw[off[d] : off[d + 1]]
            drop = dropped(lo + d, own)
            n_lines.append(own.count(b"\n") + 1)
            n_dropped.append(len(drop))
            kept.append(b"\n".join(x for i, x in enumerate(own.split(b"\n")) if i not in drop).decode() if drop else None)
    return pa.StructArray.from_arrays([pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["n_lines", "n_dropped", "kept"])


CLEAN = "struct<n_lines:bigint,n_dropped:bigint,kept:string>"


def drop_frequent(docs: DataFrame, frequent: DataFrame, text_col: str, min_chars: int, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``docs`` packed as ``_row``, its text ``_t``, and ``_c`` (CLEAN) without the lines whose keys are in ``frequent`` (h, n: documents)."""
    spark = docs.sparkSession
    size = frequent.count()
    rows = docs.select(packed(docs, "_lines"), F.col(text_col).cast("string").alias("_t"))
    if size <= broadcast_keys:
        held = spark.sparkContext.broadcast(frozenset(bytes(r[0]) for r in frequent.select("h").toLocalIterator()))

        @F.arrow_udf(CLEAN)
        def clean(texts: pa.Array) -> pa.Array:
            every = held.value
            return _clean(texts, lambda _, raw: {i for i, h in enumerate(keys(raw, min_chars)) if h in every} if every else ())

        return rows.select("_row", "_t", clean("_t").alias("_c"))

    @F.arrow_udf("array<binary>")
    def hashes(texts: pa.Array) -> pa.Array:
        return pa.array([list(dict.fromkeys(h for h in keys((t or "").encode(), min_chars) if h)) for t in texts.to_pylist()], pa.list_(pa.binary()))

    @F.arrow_udf(CLEAN)
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        marks = [frozenset(x or ()) for x in found.to_pylist()]
        return _clean(texts, lambda d, raw: {i for i, h in enumerate(keys(raw, min_chars)) if h in marks[d]} if marks[d] else ())

    # A text stands for itself in the joins, as equal texts lose equal lines.
    rows = rows.withColumn("_k", F.concat(F.md5("_t"), F.hex(F.xxhash64("_t"))))
    texts = rows.where("_k is not null").groupBy("_k").agg(F.first("_t").alias("_t"), F.count("*").alias("_n"))
    lines = texts.select("_k", "_n", F.explode(hashes("_t")).alias("h"))
    total = frequent.agg(F.sum("n")).first()[0]
    hot = frequent.where(F.col("n") > total // HOT_SHARE).select("h")
    cold = frequent.where(F.col("n") <= total // HOT_SHARE).select("h")
    found = lines.join(F.broadcast(hot), "h", "left_semi").unionByName(lines.join(F.broadcast(hot), "h", "left_anti").join(cold, "h", "left_semi"))
    marks = materialize(found.groupBy("_k").agg(F.collect_list("h").alias("_found"), F.max("_n").alias("_n")), "marks")
    return join_unique(rows, marks, "_k", "_n").select("_row", "_t", cut("_t", "_found").alias("_c"))


def _result(cleaned: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("_c.kept"), F.col("_t"), F.lit(""))
    return cleaned.select("_row.*", F.struct(F.col("_c.n_lines").alias("n_lines"), F.col("_c.n_dropped").alias("n_dropped"), text.alias("kept")).alias("_lines"))


def line_dedup(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """All columns of ``docs`` and struct ``_lines``: n_lines, n_dropped, kept (the text without dropped lines).

    A line's key is the line without white space at its ends, A-Z lowered. Keys of ``min_chars``
    code points or more that ``min_docs`` documents hold lose all their lines everywhere, so lines are
    dropped in a second pass, when all batches have been through the runs. A null or empty text is
    one empty line, whose key is never dropped; repeated rows are documents of their own, so they
    count; an empty table gives an empty result. Other columns are kept and not read; an input
    column ``_lines`` is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    buckets = partitions_for(spark, total)
    runs = LineRuns(spark, min_docs, buckets)
    with scratch(spark):
        counts = batch_counts(docs, text_col, min_chars, batches, runs.buckets)
        for b in range(batches):
            runs.add(counts.where(F.col("batch") == b).select("h", "n"))
        settled = runs.settled().select("h")
        frequent = kept(settled.hint("merge").join(counts.groupBy("h").agg(F.sum("n").alias("n")), "h"), "frequent")
    return _result(drop_frequent(docs, frequent, text_col, min_chars, broadcast_keys))


def dedup_batch(batch: DataFrame, runs: LineRuns, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """Incremental form: add ``batch`` to ``runs``, and clean it by what all batches so far hold."""
    small_batches(batch.sparkSession)
    counts = batch_counts(batch, text_col, min_chars, 1, runs.buckets)
    known = runs.add(counts.select("h", "n")).select("h", (F.col("n") + F.col("before")).alias("n"))
    return _result(drop_frequent(batch, materialize(known.where(F.col("n") >= runs.min_docs), "frequent"), text_col, min_chars))
