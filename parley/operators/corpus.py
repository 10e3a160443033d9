"""Corpus building: splits, windows and their audit, identifiers, validation, previews' propositions, review plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions.scalar import clamp, flags, hash_order

SPLITS = ("train", "validation", "test")


def split_quotas(n: Column) -> list[Column]:
    """Sizes of the three splits of n items: 80/10/10 by largest remainder (train, validation, test in ties); from 3 items on no split is empty."""
    # In tenths: train 8n, the others n; whole parts first, then the left-over items by remainder.
    whole = [F.floor(8 * n / 10), F.floor(n / 10), F.floor(n / 10)]
    rest = [(8 * n) % 10, n % 10, n % 10]
    left = n - whole[0] - whole[1] - whole[2]
    rank = [sum(((rest[j] > rest[i]) | ((rest[j] == rest[i]) & F.lit(j < i))).cast("int") for j in range(3) if j != i) for i in range(3)]
    train, val, test = (whole[i] + (rank[i] < left).cast("int") for i in range(3))
    lift = lambda x: F.when((n >= 3) & (x == 0), 1).otherwise(0)
    up = lift(val) + lift(test)
    return [(train - up).cast("bigint"), (val + lift(val)).cast("bigint"), (test + lift(test)).cast("bigint")]


def assign_splits(df: DataFrame, group: str, key: str, seed: str, policy: str = "hash-quota-1") -> DataFrame:
    """``df`` (one row per group and key) with split: rank by hash within the group against the quotas."""
    rank = F.sha2(F.concat_ws(":", F.lit(policy), F.lit(seed), F.col(group).cast("string"), F.col(key).cast("string")), 256)
    w = Window.partitionBy(group).orderBy(rank, key)
    numbered = df.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    a, b, _ = split_quotas(F.col("_n"))
    return numbered.withColumn("split", F.when(F.col("_r") <= a, SPLITS[0]).when(F.col("_r") <= a + b, SPLITS[1]).otherwise(SPLITS[2])).drop("_r", "_n")


def hash_split(key: Column | str) -> Column:
    """train, validation, test (80/10/10) by the first two bytes of the key's SHA-256."""
    from parley.functions.scalar import hash_bucket

    b = hash_bucket(key, 100)
    return F.when(b < 80, SPLITS[0]).when(b < 90, SPLITS[1]).otherwise(SPLITS[2])


def window_starts(duration: Column, stride: float = 16.0, burn_in: float = 4.0) -> Column:
    """0, stride, 2 stride, ... while start + burn_in is before the end."""
    n = F.ceil((duration - burn_in) / stride)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1), lambda i: (i * F.lit(stride)).cast("double"))).otherwise(F.array().cast("array<double>"))


def window_audit(windows: DataFrame, quality: float = 0.95, supervised: float = 8.0, primary: float = 0.9, future: float = 0.95, masked: float = 0.35) -> DataFrame:
    """Windows (quality, supervised, primary, future, masked) with what speaks against each, whether it is accepted, and its effective seconds."""
    c = F.col
    why = flags((c("quality") <= quality, "low_quality"), (c("supervised") < supervised, "short_supervision"), (c("primary") < primary, "primary_coverage"), (c("future") < future, "future_coverage"), (c("masked") > masked, "masked"))
    effective = F.greatest(F.lit(0.0), c("supervised") * c("primary") - c("masked"))
    return windows.withColumn("rejections", why).withColumn("accepted", F.size("rejections") == 0).withColumn("effective", F.when(F.col("accepted"), effective).otherwise(0.0))


def window_category(kinds: Column) -> Column:
    """The strongest kind of event in a window: overlap, feedback, hold, shift, else background."""
    return F.coalesce(*[F.when(F.array_contains(kinds, k), F.lit(k)) for k in ("overlap", "feedback", "hold", "shift")], F.lit("background"))


def window_id(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]), 256)


def leakage(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that stand in more than one split."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def concentration(df: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """Per group: rows, keys, and the largest key's share of the rows."""
    per = df.groupBy(*group, key).agg(F.count("*").alias("_n"))
    return per.groupBy(*group).agg(F.sum("_n").alias("n"), F.count("*").alias("n_keys"), (F.max("_n") / F.sum("_n")).alias("largest_share"))


def rejection_histogram(windows: DataFrame, domain: Sequence[str]) -> DataFrame:
    every = windows.sparkSession.createDataFrame([(x,) for x in domain], "reason string")
    n = windows.select(F.explode("rejections").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return every.join(n, "reason", "left").fillna(0, ["n"])


def round_robin(df: DataFrame, kind: str, order: Sequence[Column], limit: int | None = None) -> DataFrame:
    """Rows of all kinds in turn: each kind's best, each kind's second best, and so on."""
    w = Window.partitionBy(kind).orderBy(*order)
    out = df.withColumn("rank", F.row_number().over(w)).orderBy("rank", kind)
    return out if limit is None else out.limit(limit)


def spread(df: DataFrame, kind: str, order: str, most: int = 18) -> DataFrame:
    """Up to ``most`` rows of each kind, evenly spaced in order (halves to even)."""
    every = Window.partitionBy(kind)
    n = F.count("*").over(every)
    numbered = df.withColumn("_i", F.row_number().over(Window.partitionBy(kind).orderBy(order)) - 1).withColumn("_n", n)
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: F.bround(j * (F.col("_n") - 1) / F.lit(float(most - 1))).cast("int"))
    return numbered.where((F.col("_n") <= most) | F.array_contains(picks, F.col("_i"))).drop("_i", "_n")


def proposition_score(primary: Column, future: Column, confidence: Column, anchors: Column, masked: Column, category: Column) -> Column:
    # Fixed weights.
    one = F.lit(1.0)
    raw = 0.25 * primary + 0.15 * future + 0.2 * confidence + 0.1 * F.least(one, anchors / 3) + 0.15 * (1 - masked) + 0.15 * F.least(one, category / 3) - 0.7 * F.greatest(F.lit(0.0), masked - 0.2)
    return clamp(raw)


def interaction_score(alternations: Column, rapid: Column, turns: Column, backchannels: Column, interruptions: Column, both: Column) -> Column:
    # Fixed weights.
    return 2.0 * alternations + 1.5 * rapid + 0.8 * turns + 1.8 * backchannels + 2.0 * interruptions + 0.5 * F.least(F.lit(6.0), both)


def review_plan(df: DataFrame, group: str, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows of each group in a repeatable random order, with their place in it."""
    w = Window.partitionBy(group).orderBy(hash_order(seed, group, key), key)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def anchors_by_frame(anchors: DataFrame, keys: Sequence[str], frame: Column) -> DataFrame:
    """One anchor per frame; a frame with several is ambiguous and has none."""
    per = anchors.withColumn("frame", frame).groupBy(*keys, "frame").agg(F.count("*").alias("n"), F.first("probability").alias("_p"))
    return per.select(*keys, "frame", F.when(F.col("n") == 1, F.col("_p")).alias("probability"), (F.col("n") > 1).alias("ambiguous"))


def readiness(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row of issues: names of the conditions (aggregates) that hold."""
    return df.agg(flags(*[(c, n) for n, c in rules.items()]).alias("issues"))
