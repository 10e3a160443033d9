"""Masked evaluation of predictions per frame: priors, binary cross-entropy, Brier score, baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.scalar import nearest_rank as nearest

EPSILON = 1e-7


def bce(p: Column, target: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return -(target * F.log(p) + (1 - target) * F.log(1 - p))


def brier(p: Column, target: Column) -> Column:
    return (p - target) * (p - target)


def class_priors(df: DataFrame, head: str, target: str) -> DataFrame:
    """(head, prior, support): mean of the targets that are not masked (negative)."""
    return df.where(F.col(target) >= 0).groupBy(head).agg(F.avg(target).alias("prior"), F.count("*").alias("support"))


def head_metrics(df: DataFrame, head: str, p: str, target: str, weight: str) -> DataFrame:
    """Per head, over rows not masked: support, weighted cross-entropy and Brier score, mean prediction and target. No support, no row."""
    w, ok = F.col(weight), df.where((F.col(target) >= 0) & (F.col(weight) > 0))
    mean = lambda x: F.sum(w * x) / F.sum(w)
    return ok.groupBy(head).agg(F.sum(w).alias("support"), mean(bce(F.col(p), F.col(target))).alias("bce"), mean(brier(F.col(p), F.col(target))).alias("brier"), mean(F.col(p)).alias("mean_prediction"), mean(F.col(target)).alias("mean_target"))


def total_loss(heads: DataFrame, families: dict[str, Sequence[str]], weights: dict[str, float], head: str) -> DataFrame:
    """One row: support-weighted mean cross-entropy of each family of heads, and their weighted sum."""
    means = [F.coalesce(F.sum(F.when(F.col(head).isin(*names), F.col("support") * F.col("bce"))) / F.nullif(F.sum(F.when(F.col(head).isin(*names), F.col("support"))), F.lit(0)), F.lit(0.0)).alias(f) for f, names in families.items()]
    out = heads.agg(*means)
    return out.withColumn("total", sum((F.col(f) * weights.get(f, 1.0) for f in families), F.lit(0.0)))


def compare(reference: DataFrame, candidate: DataFrame, head: str) -> DataFrame:
    """Differences of two evaluations per head; heads or supports that do not match are marked."""
    r = reference.select(head, F.struct("support", "bce", "brier").alias("r"))
    c = candidate.select(head, F.struct("support", "bce", "brier").alias("c"))
    return r.join(c, head, "full_outer").select(head, (F.col("c.bce") - F.col("r.bce")).alias("bce_change"), (F.col("c.brier") - F.col("r.brier")).alias("brier_change"), F.coalesce(F.col("r.support") == F.col("c.support"), F.lit(False)).alias("comparable"))


def frame_targets(values: Column) -> Column:
    """An array with -1 for masked entries as (target, mask) structs."""
    return F.transform(values, lambda v: F.struct(F.when(v >= 0, v).otherwise(0.0).alias("target"), (v >= 0).alias("mask")))


def resample_nearest(values: Column, n: Column) -> Column:
    """An array brought to ``n`` entries: each the nearest one on an even grid (halves to even)."""
    m = F.size(values)
    at = lambda i: F.when(n > 1, F.bround(i * (m - 1) / (n - 1))).otherwise(0).cast("int")
    return F.when(m > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(values, at(i))))


def oracle_probability(floor: Column) -> Column:
    """1 - floor, 0.5 where it is masked."""
    return F.when(floor < 0, 0.5).otherwise(1 - floor)


def floor_probability(speaking: Column) -> Column:
    return F.when(speaking > 0.5, 0.99).otherwise(0.01)


def rates(df: DataFrame, kind: str, outcomes: dict[str, Column]) -> DataFrame:
    """Per kind of case: cases, and the share of each outcome."""
    return df.groupBy(kind).agg(F.count("*").alias("n"), *[F.avg(c.cast("double")).alias(n) for n, c in outcomes.items()])


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float]) -> DataFrame:
    """Percentiles by nearest rank (the value at ceil(p n))."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), *[F.expr(f"percentile_disc({p}) within group (order by {value})").alias(f"p{round(p * 100)}") for p in levels])


CALL = "<tool_call>(.*?)</tool_call>"


def parse_generation(text: Column) -> Column:
    """struct spoken, n_calls, tool, arguments, parser_valid, bridge_words of a generated text with tool calls (JSON with name and arguments) in tags.

    A call that is not such an object, or whose tag never closes, makes the text invalid, and so do
    two calls or more; ``tool`` is named where there is just one good call. What is outside tags is spoken.
    """
    text = F.coalesce(text, F.lit(""))
    calls = F.regexp_extract_all(text, F.lit(f"(?s){CALL}"), F.lit(1))
    name, args = (lambda c: F.get_json_object(c, "$.name")), (lambda c: F.get_json_object(c, "$.arguments"))
    good = F.filter(calls, lambda c: F.coalesce((F.length(name(c)) > 0) & F.startswith(args(c), F.lit("{")), F.lit(False)))
    rest = F.regexp_replace(text, f"(?s){CALL}", "")
    open_ = F.contains(rest, F.lit("<tool_call>"))
    spoken = F.trim(F.regexp_replace(rest, "(?s)<tool_call>.*", ""))
    one = F.size(good) == 1
    words = F.size(F.filter(F.split(spoken, "\\s+"), lambda w: w != ""))
    valid = (F.size(calls) == F.size(good)) & ~open_ & (F.size(good) <= 1)
    return F.struct(spoken.alias("spoken"), F.size(good).alias("n_calls"), F.when(one, name(F.get(good, 0))).alias("tool"), F.when(one, args(F.get(good, 0))).alias("arguments"), valid.alias("parser_valid"), words.alias("bridge_words"))


def generation_metrics(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rates of (keys, kind: tool_call, no_tool, tool_continuation; expected, tool, schema_valid, parser_valid, spoken, bridge_words); 0 where no case counts."""
    c = F.col
    rate = lambda kind, ok: F.coalesce(F.avg(F.when(F.lit(True) if kind is None else c("kind") == kind, F.coalesce(ok, F.lit(False)).cast("double"))), F.lit(0.0))
    called, silent = c("tool").isNotNull(), c("tool").isNull() & c("parser_valid")
    return predictions.groupBy(*keys).agg(
        F.count("*").alias("n"),
        rate(None, c("parser_valid")).alias("parser_valid_rate"),
        rate("tool_call", called).alias("tool_decision_accuracy"),
        rate("tool_call", c("tool") == c("expected")).alias("tool_name_accuracy"),
        rate("tool_call", c("schema_valid")).alias("schema_valid_rate"),
        rate("tool_call", c("bridge_words") > 0).alias("bridge_present_rate"),
        rate("tool_call", c("bridge_words").between(1, 12)).alias("bridge_concise_rate"),
        rate("no_tool", silent).alias("no_tool_accuracy"),
        rate("tool_continuation", silent & (c("spoken") != "")).alias("continuation_nonempty_rate"),
    )


def constant_predictions(rows: DataFrame, priors: DataFrame, head: str, out: str = "p") -> DataFrame:
    """``rows`` with each head's prior as its prediction; heads without one get 0.5."""
    known = priors.select(head, F.col("prior").alias(out))
    return rows.join(known, head, "left").fillna(0.5, [out])


def oracle_activity(rows: DataFrame, priors: DataFrame, head: str, floor: str, yield_head: str = "user_yield", out: str = "p") -> DataFrame:
    """A baseline that knows the floor: it answers ``yield_head`` from that, and all other heads by their priors."""
    x = constant_predictions(rows, priors, head, out)
    return x.withColumn(out, F.when(F.col(head) == yield_head, oracle_probability(F.col(floor))).otherwise(F.col(out)))


def predictive_metrics(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per ``keys``, of replies prepared ahead (promoted, invalidation, tokens, commit, released, played, true_end: seconds): hit and invalidation rates, waste, median latencies in ms."""
    rate = lambda c: F.count_if(c) / F.count("*")
    ms = lambda a, b: F.greatest(F.lit(0.0), F.col(b) - F.col(a)) * 1000.0
    gone = F.col("invalidation").isNotNull()
    return candidates.groupBy(*keys).agg(
        F.count("*").alias("n"),
        rate(F.col("promoted")).alias("hit_rate"),
        rate(gone).alias("invalidation_rate"),
        F.coalesce(F.sum(F.when(gone, F.col("tokens"))), F.lit(0)).alias("wasted_tokens"),
        nearest(ms("commit", "played"), 0.5).alias("played_p50_ms"),
        nearest(ms("commit", "released"), 0.5).alias("released_p50_ms"),
        nearest(F.when(gone, ms("commit", "played")), 0.5).alias("after_invalidation_p50_ms"),
    )
