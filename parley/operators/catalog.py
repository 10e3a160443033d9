"""Catalogue operators: current rows of versioned relations, upserts, existence, completeness, filtered pages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """One row per key: the largest by ``order`` (first decides). A partial maximum per task, so no key's history is gathered."""
    rest = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order)).alias("_top")
    return df.groupBy(*keys).agg(top).select(*keys, "_top.*").select(*df.columns)


def latest_k(df: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def children(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], out: str = "children") -> DataFrame:
    """Rows of each key as an array of structs in order."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias(out))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``old`` with ``new`` rows put in; columns in ``keep`` take the old value where the new one is null."""
    o = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("_o"))
    n = new.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("_n"))
    both = o.join(n, list(keys), "full_outer")
    value = lambda c: F.coalesce(F.col(f"_n.{c}"), F.col(f"_o.{c}")) if c in keep else F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}"))
    return both.select(*[F.col(c) if c in keys else value(c).alias(c) for c in old.columns])


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` and those ``new`` rows whose key it lacks."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def guarded_update(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Fill ``columns`` from ``new`` where the old row has none of them yet."""
    unset = F.lit(True)
    for c in columns:
        unset = unset & F.col(c).isNull()
    n = new.select(*keys, F.struct(*columns).alias("_n"))
    both = old.join(n, list(keys), "left")
    return both.select(*[F.when(unset & F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c) if c in columns else c for c in old.columns])


def exists_flag(df: DataFrame, other: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Whether ``other`` has a row with the keys, as a column; for EXISTS under OR."""
    seen = other.select(*keys).distinct().withColumn(out, F.lit(True))
    return df.join(seen, list(keys), "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def pending(found: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return found.join(done.select(*keys), list(keys), "left_anti")


def cumulative_prefix(df: DataFrame, order: Sequence[str], size: str, limit: float, keys: Sequence[str] = (), slices: str | None = None) -> DataFrame:
    """The first rows in order whose sizes add up to at most ``limit``; at least one row.

    ``slices`` names a column that follows the order coarsely (a slice's rows all precede the next
    one's): sums are then made per slice first, so that no task sees all rows.
    """
    if slices is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn("_sum", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w)).where((F.col("_sum") <= limit) | (F.col("_n") == 1)).drop("_sum", "_n")
    per = df.groupBy(*keys, slices).agg(F.sum(size).alias("_part"))
    before = F.coalesce(F.sum("_part").over(Window.partitionBy(*keys).orderBy(slices).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per.select(*keys, slices, before.alias("_before"), F.lag(slices).over(Window.partitionBy(*keys).orderBy(slices)).isNull().alias("_first"))
    w = Window.partitionBy(*keys, slices).orderBy(*order)
    cum = df.join(starts, [*keys, slices]).withColumn("_sum", F.col("_before") + F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    return cum.where((F.col("_sum") <= limit) | (F.col("_first") & (F.col("_n") == 1))).select(*df.columns)


@dataclass(frozen=True)
class SampleFilter:
    """Optional conditions of a catalogue page; None asks nothing."""

    dataset: object = None
    status: str | None = None
    flag: str | None = None
    quality_min: float | None = None
    quality_max: float | None = None
    duration_min: float | None = None
    duration_max: float | None = None
    speech_ratio_min: float | None = None
    speech_ratio_max: float | None = None
    overlap_ratio_min: float | None = None
    overlap_ratio_max: float | None = None
    silence_ratio_min: float | None = None
    silence_ratio_max: float | None = None
    wer_min: float | None = None
    wer_max: float | None = None
    limit: int | None = None
    offset: int = 0

    def where(self) -> Column:
        """All conditions; a comparison with a missing value does not hold."""
        ok = F.lit(True)
        for name, column in (("dataset", "dataset"), ("status", "status")):
            if getattr(self, name) is not None:
                ok = ok & (F.col(column) == getattr(self, name))
        if self.flag is not None:
            ok = ok & F.array_contains("flags", self.flag)
        for f in fields(self):
            column, _, bound = f.name.rpartition("_")
            value = getattr(self, f.name)
            if bound == "min" and value is not None:
                ok = ok & (F.col(column) >= value)
            elif bound == "max" and value is not None:
                ok = ok & (F.col(column) <= value)
        return ok

    def page(self, df: DataFrame, *order: Column) -> DataFrame:
        out = df.where(self.where()).orderBy(*order)
        if self.offset:
            out = out.offset(self.offset)
        return out if self.limit is None else out.limit(self.limit)


def best_error(first: Column, second: Column) -> Column:
    """The smaller of two error rates, a missing one counting as infinite."""
    inf = F.lit(float("inf"))
    return F.least(F.coalesce(first, inf), F.coalesce(second, inf))


def language_status(tracks: DataFrame, keys: Sequence[str], status: str, expected: int) -> DataFrame:
    """Status of a recording from its tracks: any non_english; else inconclusive if a track is missing, inconclusive or failed; else english."""
    agg = tracks.groupBy(*keys).agg(F.count(status).alias("_n"), F.bool_or(F.col(status) == "non_english").alias("_non"), F.bool_or(F.col(status).isin("inconclusive", "failed")).alias("_open"))
    value = F.when(F.col("_n") == 0, F.lit(None).cast("string")).when(F.col("_non"), "non_english").when((F.col("_n") < expected) | F.col("_open"), "inconclusive").otherwise("english")
    return agg.select(*keys, value.alias("language_status"))


def track_language(code: Column, confidence: Column, words: Column, minimum: float = 0.75, least: int = 4) -> Column:
    """english, non_english, or inconclusive for an unknown code, low confidence or few words."""
    return F.when(code.isNull() | confidence.isNull() | (confidence < minimum) | (words < least), "inconclusive").when(F.startswith(F.lower(code), F.lit("en")), "english").otherwise("non_english")


def seeded_pick(df: DataFrame, seed: str, key: str, last: Column | None = None, n: int = 1) -> DataFrame:
    """``n`` rows in a repeatable random order; rows for which ``last`` holds come after all others."""
    order = [] if last is None else [last.cast("int")]
    return df.orderBy(*order, F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256), key).limit(n)


def top_then_pick(df: DataFrame, score: str, key: str, top: int, seed: str, exclude: object = None) -> DataFrame:
    """One of the ``top`` rows by score (missing scores last), picked at random but repeatably."""
    best = df.orderBy(F.col(score).desc_nulls_last(), key).limit(top)
    return seeded_pick(best if exclude is None else best.where(F.col(key) != exclude), seed, key)


def pair_sides(df: DataFrame, keys: Sequence[str], side: str, value: Sequence[str]) -> DataFrame:
    """Keys that have exactly one row on each of sides 1 and 2: structs ``one`` and ``two``."""
    v = F.struct(*value)
    agg = df.groupBy(*keys).agg(F.count_if(F.col(side) == 1).alias("_a"), F.count_if(F.col(side) == 2).alias("_b"), F.max(F.when(F.col(side) == 1, v)).alias("one"), F.max(F.when(F.col(side) == 2, v)).alias("two"))
    return agg.where("_a = 1 and _b = 1").drop("_a", "_b")


def ordered_lookup(wanted: DataFrame, order: str, table: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` for each wanted key, in the wanted order; a key without a row comes with nulls and ``missing``."""
    t = table.withColumn("_found", F.lit(True))
    return wanted.join(t, key, "left").withColumn("missing", F.col("_found").isNull()).drop("_found").orderBy(order)


def diff(local: DataFrame, remote: DataFrame, path: str, digest: str, excluded: DataFrame | None = None) -> DataFrame:
    """(path, action): add, update or unchanged for local files against remote ones; excluded files as such."""
    r = remote.select(path, F.col(digest).alias("_remote"))
    action = F.when(F.col("_remote").isNull(), "add").when(F.col("_remote") != F.col(digest), "update").otherwise("unchanged")
    out = local.join(r, path, "left").select(path, action.alias("action"))
    return out if excluded is None else out.unionByName(excluded.select(path, F.lit("excluded").alias("action")))


def completeness(samples: DataFrame, done: DataFrame, keys: Sequence[str], group: Sequence[str], conditions: dict[str, Column]) -> DataFrame:
    """Per group: rows, rows with a ``done`` row, and how many of those meet each condition."""
    joined = samples.join(done.withColumn("_done", F.lit(True)), list(keys), "left")
    return joined.groupBy(*group).agg(F.count("*").alias("total"), F.count_if(F.col("_done").isNotNull()).alias("done"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def totals(df: DataFrame, sums: Sequence[str], conditions: dict[str, Column]) -> DataFrame:
    """One row of counts and sums, zeros for an empty table."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()], *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])


def histogram(df: DataFrame, domain: Sequence[str], column: str) -> DataFrame:
    """Count of each value of a fixed domain, zeros included."""
    spark = df.sparkSession
    every = spark.createDataFrame([(v,) for v in domain], f"{column} string")
    return every.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").fillna(0, ["n"])


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that stand more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
