"""Which recordings to review, and where in them: repeatable draws that are uniform over what exclusions leave.

A draw is a whole number made of a seed and keys by SHA-256. A place is drawn by measure: the free
parts of a recording lie end to end, and the draw, modulo their length, is mapped back. Places
are whole numbers (frames, milliseconds), so nothing depends on rounding.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions.scalar import hash_order
from parley.operators import intervals

# Seconds, shares and counts.
FRAME, INPUT, BURN_IN = 0.08, 20.0, 4.0
MASKED, TRIES = 0.35, 64


def draw(seed: str, *keys: Column | str) -> Column:
    """A repeatable whole number of 60 bits."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 15), 16, 10).cast("bigint")


def _first_above(x: Column, unit: float, plus: float = 0.0) -> Column:
    """The least whole n with n * unit + plus > x, compared as doubles."""
    n = F.floor((x - plus) / unit) - 1
    return F.coalesce(*[F.when((n + i) * unit + plus > x, n + i) for i in range(3)], n + 3)


def _last_below(x: Column, unit: float) -> Column:
    """The largest whole n with n * unit < x."""
    n = F.ceil(x / unit) + 1
    return F.coalesce(*[F.when((n - i) * unit < x, n - i) for i in range(3)], n - 3)


def free_starts(recordings: DataFrame, exclusions: DataFrame, keys: Sequence[str], length: float = INPUT, frame: float = FRAME) -> DataFrame:
    """(keys, start, end) spans of frames at which a window of ``length`` may begin: inside (keys, duration), touching no exclusion (keys, start, end).

    Windows may meet an exclusion's ends. Recordings that are shorter than a window have the one start 0.
    """
    keys = list(keys)
    most = F.floor(F.greatest(F.lit(0.0), F.col("duration") - length) / frame)
    bounds = recordings.select(*keys, F.lit(0).cast("bigint").alias("low"), (most + 1).cast("bigint").alias("high"))
    shut = exclusions.select(*keys, _first_above(F.col("start"), frame, length).cast("bigint").alias("start"), (_last_below(F.col("end"), frame) + 1).cast("bigint").alias("end"))
    return intervals.gaps(shut.join(bounds.select(*keys), keys, "left_semi"), keys, bounds=bounds)


def by_measure(spans: DataFrame, draws: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``draws`` (keys, u and more) with ``place``, u carried into the disjoint ``spans`` (keys, start, end; whole numbers), and ``room``, their length.

    Draws of keys without room vanish.
    """
    keys = list(keys)
    size = F.col("end") - F.col("start")
    laid = spans.where(size > 0).withColumn("_before", F.coalesce(F.sum(size).over(Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    room = spans.where(size > 0).groupBy(*keys).agg(F.sum(size).alias("room"))
    at = draws.join(room, keys).withColumn("_at", F.pmod("u", "room"))
    hit = at.join(laid.select(*keys, "start", "end", "_before"), keys).where((F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_before") + size))
    return hit.select(*draws.columns, "room", (F.col("start") + F.col("_at") - F.col("_before")).alias("place"))


def review_starts(recordings: DataFrame, exclusions: DataFrame, keys: Sequence[str], seed: str) -> DataFrame:
    """(keys, start, room): a window's start drawn from the free frames of each recording; those without any are missing."""
    keys = list(keys)
    draws = recordings.select(*keys, draw(seed, F.lit("start"), *keys).alias("u"))
    found = by_measure(free_starts(recordings, exclusions, keys), draws, keys)
    return found.select(*keys, (F.col("place") * FRAME).alias("start"), "room")


def _side(seed: str, *keys: Column | str) -> Column:
    return (F.pmod(draw(seed, F.lit("side"), *keys), F.lit(2)) + 1).cast("int")


def plan_review(recordings: DataFrame, exclusions: DataFrame, group: str, key: str, n: int, seed: str) -> DataFrame:
    """``n`` recordings of each group, in a repeatable order, with side (1 or 2) and start: (group, key, place, side, start).

    Recordings (group, key, duration, analysed) that are analysed, as long as a window and have a
    free start can be drawn. Groups with fewer than ``n`` give what they have; see :func:`shortfalls`.
    """
    fit = recordings.where(F.col("analysed") & (F.col("duration") >= INPUT)).select(group, key, "duration")
    able = fit.join(review_starts(fit, exclusions, [group, key], seed), [group, key])
    w = Window.partitionBy(group).orderBy(hash_order(seed, group, key), key)
    drawn = able.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return drawn.select(group, key, "place", _side(seed, group, key).alias("side"), "start")


def shortfalls(planned: DataFrame, groups: DataFrame, group: str, n: int) -> DataFrame:
    """(group, n_planned) of the ``groups`` for which fewer than ``n`` recordings could be drawn."""
    have = planned.groupBy(group).agg(F.count("*").alias("n_planned"))
    return groups.select(group).distinct().join(have, group, "left").fillna(0, ["n_planned"]).where(F.col("n_planned") < n)


def replacements(failed: DataFrame, planned: DataFrame, recordings: DataFrame, exclusions: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """A recording of its group for each ``failed`` (group, key), none planned before and none used twice: (group, key, new_key, side, start).

    The i-th failed recording takes the i-th unused one, both in orders drawn from the seed; a failed one without a replacement is missing.
    """
    fit = recordings.where(F.col("analysed") & (F.col("duration") >= INPUT)).select(group, key, "duration").join(planned.select(group, key), [group, key], "left_anti")
    able = fit.join(review_starts(fit, exclusions, [group, key], seed), [group, key])
    place = lambda label: F.row_number().over(Window.partitionBy(group).orderBy(hash_order(seed, F.lit(label), group, key), key))
    need = failed.select(group, key).withColumn("_i", place("failed"))
    spare = able.withColumn("_i", place("replacement")).select(group, "_i", F.col(key).alias("new_key"), "start")
    met = need.join(spare, [group, "_i"])
    return met.select(group, key, "new_key", _side(seed, group, "new_key").alias("side"), "start")


def usable_starts(available: DataFrame, regions: DataFrame, keys: Sequence[str], seed: str, length: int, burn_in: int, width: float, tries: int = TRIES, masked: float = MASKED) -> DataFrame:
    """(keys, start, ratio): one of ``tries`` starts drawn by measure from the ``available`` spans (whole numbers), of those masked little.

    ``ratio`` is the share of a window, after its burn-in, that the unusable ``regions`` (keys, start,
    end) cover. Among starts with at most ``masked`` of it one is drawn, else the least masked is
    taken. A span of just one window's length counts as one start if there is no longer one.
    """
    keys = list(keys)
    starts = available.where(F.col("end") - F.col("start") >= length).select(*keys, "start", (F.col("end") - length).alias("end"))
    wide = starts.where(F.col("end") > F.col("start"))
    tight = starts.join(wide.select(*keys).distinct(), keys, "left_anti").withColumn("end", F.col("start") + 1)
    spans = wide.withColumn("end", F.col("end") + 1).unionByName(tight)
    draws = starts.select(*keys).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).withColumn("u", draw(seed, *keys, "i"))
    found = by_measure(spans, draws, keys).select(*keys, "i", F.col("place").alias("at"), (F.col("place") + burn_in).alias("start"), (F.col("place") + length).alias("end"))
    met = intervals.overlap_join(found, intervals.union(regions, keys), keys, width)
    cover = met.groupBy(*keys, F.col("a.i").alias("i")).agg(F.sum(F.col("to") - F.col("from")).alias("_m"))
    rated = found.join(cover, [*keys, "i"], "left").withColumn("ratio", F.coalesce("_m", F.lit(0)) / F.lit(float(length - burn_in)))
    good = F.col("ratio") <= masked
    rank = F.struct((~good).alias("bad"), F.when(good, F.lit(0.0)).otherwise(F.col("ratio")).alias("r"), F.when(good, hash_order(seed, F.lit("choice"), *keys, "i")).otherwise("").alias("h"), "i")
    return rated.groupBy(*keys).agg(F.min_by(F.struct("at", "ratio"), rank).alias("_b")).select(*keys, F.col("_b.at").alias("start"), F.col("_b.ratio").alias("ratio"))
