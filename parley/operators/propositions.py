"""Training windows worth looking at: about the best anchors of each kind in turn, scored by what they supervise.

``anchors``: (keys, kind, time, confidence); ``regions``: disjoint unusable spans (keys, start, end,
reason); ``recordings``: (keys, duration). Times in seconds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.operators import intervals
from parley.operators.audit import BURN_IN
from parley.operators.corpus import proposition_score

# Seconds, kinds in turn, least score and shares.
INPUT, AHEAD, FRAME = 20.0, 12.0, 0.08
KINDS = ("turn_shift", "hold_pause", "non_floor_feedback", "overlap_interruption", "background")
SCORE, PRIMARY, FUTURE, MASKED = 0.75, 0.9, 0.95, 0.35


def anchor_windows(anchors: DataFrame, recordings: DataFrame, regions: DataFrame, keys: Sequence[str], width: float = INPUT) -> DataFrame:
    """Anchors with the window about each (start, end, from: where supervision begins), masked (share of the supervised part), reasons, and n_kind, the anchors of its kind supervised there."""
    keys = list(keys)
    d = F.col("duration")
    start = F.least(F.greatest(F.lit(0.0), d - INPUT), F.greatest(F.lit(0.0), F.col("time") - AHEAD))
    x = anchors.select(*keys, "kind", "time", "confidence").join(recordings.select(*keys, "duration"), keys).withColumn("start", start).withColumn("end", F.least(d, F.col("start") + INPUT)).withColumn("from", F.least("end", F.col("start") + BURN_IN))
    own = x.select(*keys, F.col("from").alias("start"), "end", F.col("start").alias("_w")).distinct()
    cut = intervals.overlap_join(own, regions.select(*keys, "start", "end", "reason"), keys, width).groupBy(*keys, F.col("a._w").alias("start"), F.col("a.end").alias("end")).agg(F.sum(F.col("to") - F.col("from")).alias("_m"), F.array_sort(F.collect_set("b.reason")).alias("reasons"))
    points = anchors.select(*keys, "kind", F.col("time").alias("start"), F.col("time").alias("end"))
    near = intervals.overlap_join(own, points, keys, width, closed=True).where("b.start < a.end").groupBy(*keys, F.col("a._w").alias("start"), F.col("a.end").alias("end"), F.col("b.kind").alias("kind")).agg(F.count("*").alias("n_kind"))
    x = x.join(cut, [*keys, "start", "end"], "left").join(near, [*keys, "start", "end", "kind"], "left").fillna(0, ["n_kind"])
    length = F.col("end") - F.col("from")
    return x.withColumn("masked", F.when(length > 0, F.coalesce("_m", F.lit(0.0)) / length).otherwise(0.0)).withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>"))).drop("_m")


def preference(confidence: Column, n_kind: Column, masked: Column) -> Column:
    # Fixed weights. Rounded, so that values that only differ in the order of sums tie.
    return F.struct(F.round(confidence + 0.08 * F.least(F.lit(3), n_kind) - 0.8 * F.greatest(F.lit(0.0), masked - 0.2), 9).alias("value"), (-F.round(masked, 9)).alias("clear"))


def balanced(windows: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """``limit`` windows of each recording at most: each kind's best, each kind's second best, and so on; ``place`` in that order. Ties go to the earlier anchor."""
    keys = list(keys)
    liked = windows.withColumn("_p", preference(F.col("confidence"), F.col("n_kind"), F.col("masked")))
    own = Window.partitionBy(*keys, "kind").orderBy(F.desc("_p"), "time", F.desc("confidence"))
    turn = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    ranked = liked.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= limit)
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("_r", turn))).where(F.col("place") <= limit).drop("_p", "_r")


def propositions(chosen: DataFrame, ratios: DataFrame, marks: DataFrame, available: DataFrame, keys: Sequence[str], width: float = INPUT) -> DataFrame:
    """``chosen`` windows with n_marks and score, those that are good enough and lie within one of the ``available`` spans (keys, start, end).

    ``ratios``: (keys, start, end, primary, future) of each window; ``marks``: (keys, time) of anchored
    frames, counted once for each frame of the supervised part.
    """
    keys = list(keys)
    x = chosen.join(ratios, [*keys, "start", "end"])
    own = x.select(*keys, F.col("from").alias("start"), "end", F.col("start").alias("_w")).distinct()
    points = marks.select(*keys, F.col("time").alias("start"), F.col("time").alias("end"))
    frame = F.floor((F.col("b.start") - F.col("a._w")) / FRAME + 1e-9)
    n = intervals.overlap_join(own, points, keys, width, closed=True).where("b.start < a.end").groupBy(*keys, F.col("a._w").alias("start"), F.col("a.end").alias("end")).agg(F.count_distinct(frame).alias("n_marks"))
    inside = intervals.overlap_join(own.select(*keys, F.col("_w").alias("start"), "end").distinct(), available.select(*keys, "start", "end"), keys, width).where("b.start <= a.start and b.end >= a.end").select(*keys, F.col("a.start").alias("start"), F.col("a.end").alias("end")).distinct()
    x = x.join(n, [*keys, "start", "end"], "left").fillna(0, ["n_marks"]).join(inside, [*keys, "start", "end"], "left_semi")
    score = proposition_score(F.col("primary"), F.col("future"), F.col("confidence"), F.col("n_marks"), F.col("masked"), F.col("n_kind"))
    good = (F.col("score") >= SCORE) & (F.col("primary") >= PRIMARY) & (F.col("future") >= FUTURE) & (F.col("masked") <= MASKED)
    return x.withColumn("score", score).where(good)
