"""Recordings whose two tracks may not fit: what to listen to next, which shift would mend them, and how sure that is.

Tables share the ``keys`` of a recording. ``recordings`` have duration and mismatch (of the tracks'
durations, null if unknown), in seconds; ``audits`` one row of kind and anomaly score; ``windows``
of the audit start, end, shift, confidence, persistence, sources (transcripts that agree), accepted
and boundary (the shift is the largest that was tried).
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions.scalar import hash_order
from parley.operators import intervals
from parley.operators.corpus import interaction_score
from parley.operators.folds import fold

# Seconds, counts and shares.
CLIP, STEP = 20.0, 5.0
LATE, LATE_SHARE = 360.0, 0.6
ALTERNATION, RAPID = 6.0, 1.5
CONFIDENCE, PERSISTENCE, NEIGHBOUR = 0.65, 3, 180.0
TOLERANCE, SUFFIX, SUFFIX_SECONDS = 1.25, 4, 300.0
BASELINE, PREFIX, CHANGE = 0.75, 3, 1.0
SPREAD, ALIGNED, LEAST = 1.25, 1.0, 0.1
CATEGORIES = ("likely_aligned", "likely_constant_offset", "non_constant_or_uncertain")


def reliable() -> Column:
    """Whether a window of the audit counts as evidence."""
    c = F.col
    return c("accepted") & ~c("boundary") & (c("confidence") >= CONFIDENCE) & (c("persistence") >= PERSISTENCE)


def _median(ordered: list[float]) -> float:
    n = len(ordered)
    return ordered[n // 2] if n % 2 else (ordered[n // 2 - 1] + ordered[n // 2]) / 2


def _final_run(key: tuple, rows):
    """The last reliable windows whose shifts stay near the median of those after them; rows come last first."""
    shifts: list[float] = []
    sources = 0
    for start, end, shift, agree in (r[len(key) :] for r in rows):
        if not shifts:
            first, last_end = (start, end), end
        elif first[0] - start > NEIGHBOUR or abs(shift - _median(shifts)) > TOLERANCE:
            break
        first = start, end
        insort(shifts, shift)
        sources += agree
    n = len(shifts)
    yield (*key, *first, last_end, n, _median(shifts), shifts[-1] - shifts[0], sources / (2.0 * n))


def stable_suffix(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, stable_start, first_end, stable_end, n_windows, shift, spread, agreement) of each recording's last stable run of windows.

    Taken from the last reliable window backwards, while the next one begins within three minutes and
    its shift is near the median of the run so far; one odd window that is not reliable changes nothing.
    """
    some = windows.where(reliable()).select(*keys, *[F.col(c).cast("double").alias(c) for c in ("start", "end", "shift")], F.col("sources").cast("int").alias("sources"))
    kinds = ", ".join(f"`{k}` {some.schema[k].dataType.simpleString()}" for k in keys)
    return fold(some, keys, [F.desc("start"), F.desc("end"), F.desc("shift"), F.desc("sources")], f"{kinds}, stable_start double, first_end double, stable_end double, n_windows int, shift double, spread double, agreement double", _final_run)


def piecewise_repair(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per recording whose later part has one stable shift, and whose part before has none: both shifts, where the change lies, and confidence.

    The later part is :func:`stable_suffix`, four windows and five minutes long at least; the part
    before is the last run of windows near shift zero that end before it, three at least. Recordings
    without both, or with less than a second between their shifts, have no row.
    """
    keys = list(keys)
    suffix = stable_suffix(windows, keys).where((F.col("n_windows") >= SUFFIX) & (F.col("stable_end") - F.col("stable_start") >= SUFFIX_SECONDS))
    near = windows.where(~F.col("boundary") & (F.abs("shift") <= BASELINE)).select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("shift").alias("_shift"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_s"), F.desc("_e"))
    before = near.join(suffix, keys).where(F.col("_e") <= F.col("stable_start"))
    chained = before.withColumn("_far", (F.lag("_s").over(w) - F.col("_s") > NEIGHBOUR).cast("int")).withColumn("_breaks", F.sum(F.coalesce("_far", F.lit(0))).over(w))
    prefix = chained.where("_breaks = 0").groupBy(*keys).agg(F.count("*").alias("_n"), F.median("_shift").alias("_first"), F.max(F.struct("_s", "_e")).alias("_last"))
    x = suffix.join(prefix.where(F.col("_n") >= PREFIX), keys).withColumn("_change", F.col("shift") - F.col("_first")).where(F.abs("_change") >= CHANGE)
    length = F.col("stable_end") - F.col("stable_start")
    one = F.lit(1.0)
    sure = 0.30 * (1 - F.least(one, F.col("spread") / 1.5)) + 0.25 * F.least(one, length / 900.0) + 0.25 * F.col("agreement") + 0.20 * F.least(one, F.col("n_windows") / 8.0)
    return x.select(
        *keys,
        F.round("_first", 2).alias("first_shift"),
        F.round("shift", 2).alias("second_shift"),
        F.round("_change", 2).alias("shift_change"),
        F.round((F.col("_last._s") + F.col("_last._e")) / 2, 3).alias("change_from"),
        F.round((F.col("stable_start") + F.col("first_end")) / 2, 3).alias("change_to"),
        F.col("_last._s").alias("first_part_end"),
        F.col("first_end").alias("second_part_start"),
        "stable_start",
        "stable_end",
        F.round(length, 3).alias("stable_duration"),
        "n_windows",
        F.round("spread", 2).alias("spread"),
        F.round(sure, 3).alias("confidence"),
    )


def stable_offset(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, shift, confidence, n_windows) of recordings of which three reliable windows or more, all there are, agree on one shift."""
    per = windows.where(reliable()).groupBy(*keys).agg(F.count("*").alias("n_windows"), F.median("shift").alias("_m"), (F.max("shift") - F.min("shift")).alias("_spread"), F.avg("confidence").alias("_c"))
    sure = 0.6 * F.col("_c") + 0.4 * (1 - F.col("_spread") / SPREAD)
    return per.where((F.col("n_windows") >= PREFIX) & (F.col("_spread") <= SPREAD)).select(*keys, F.round("_m", 2).alias("shift"), F.round(sure, 3).alias("confidence"), F.col("n_windows").cast("int").alias("n_windows"))


def alignment_assessment(recordings: DataFrame, audits: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per recording: category, likelihood of it, and the shift to try, if one is safe (scope, shift, confidence, n_windows).

    A piecewise repair comes first; then, where the audit calls the offset stable, one shift of all;
    everything else is uncertain, as is a recording without an audit.
    """
    keys = list(keys)
    later = piecewise_repair(windows, keys).select(*keys, F.struct(F.lit("after_change_point").alias("scope"), F.col("second_shift").alias("shift"), "confidence", "n_windows").alias("_late"))
    whole = stable_offset(windows, keys).select(*keys, F.struct(F.lit("global_offset").alias("scope"), "shift", "confidence", "n_windows").alias("_whole"))
    x = recordings.select(*keys).join(audits.select(*keys, "kind", "score"), keys, "left").join(later, keys, "left").join(whole, keys, "left")
    steady = (F.col("kind") == "stable_offset") & F.col("_whole").isNotNull()
    size = F.abs("_whole.shift")
    aligned, offset, uncertain = (F.lit(c) for c in CATEGORIES)
    category = F.when(F.col("_late").isNotNull(), offset).when(steady & (size <= ALIGNED), aligned).when(steady, offset).otherwise(uncertain)
    chance = (
        F.when(F.col("_late").isNotNull(), F.col("_late.confidence"))
        .when(steady & (size <= ALIGNED), F.round(F.col("_whole.confidence") * (1 - size / (2 * ALIGNED)), 3))
        .when(steady, F.col("_whole.confidence"))
        .otherwise(F.round(F.greatest(F.lit(0.0), 1 - F.coalesce("score", F.lit(1.0))), 3))
    )
    advice = F.when(F.col("_late").isNotNull(), F.col("_late")).when(steady & (size >= LEAST), F.col("_whole"))
    return x.select(*keys, category.alias("category"), chance.alias("likelihood"), advice.alias("_a")).select(*keys, "category", "likelihood", "_a.scope", "_a.shift", "_a.confidence", "_a.n_windows")


def suspicion(recordings: DataFrame, audits: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, suspicion, late_shift): how likely the tracks drift apart late, from the audit's strongest late window and the tracks' durations."""
    keys = list(keys)
    late = windows.join(recordings.select(*keys, "duration"), keys).where((F.col("end") >= F.col("duration") - LATE) & F.col("accepted") & ~F.col("boundary") & (F.abs("shift") > 1))
    rank = F.struct("sources", "persistence", "confidence", F.abs("shift").alias("_size"), (-F.col("start")).alias("_s"), "shift")
    top = late.groupBy(*keys).agg(F.max(rank).alias("_t"))
    x = recordings.select(*keys, "mismatch").join(audits.select(*keys, "score"), keys, "left").join(top, keys, "left")
    one = F.lit(1.0)
    factor = F.when(F.col("_t").isNull(), 0.2).otherwise(0.35 + 0.35 * F.least(one, F.col("_t.sources") / 2.0) + 0.30 * F.least(one, F.col("_t.persistence") / 3.0))
    heard = F.coalesce(F.col("score") * factor, F.lit(0.0))
    apart = F.least(one, F.coalesce("mismatch", F.lit(0.0)) / 6.0)
    value = F.greatest(F.lit(0.03), F.least(one, 1 - (1 - heard) * (1 - 0.65 * apart)))
    return x.select(*keys, value.alias("suspicion"), F.col("_t.shift").alias("late_shift"))


def late_start(duration: Column) -> Column:
    """Where the part begins that clips are taken from: the last six minutes, or the last two fifths if that is less."""
    return F.greatest(F.lit(0.0), duration - LATE, duration * LATE_SHARE)


def candidate_starts(recordings: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, duration, start): clips of each recording's late part, every five seconds, about each event there, and the last one.

    ``events``: (keys, time) of turns, back-channels' starts and interruptions. Recordings shorter than a clip have none.
    """
    keys = list(keys)
    own = recordings.select(*keys, "duration").where(F.col("duration") >= CLIP).withColumns({"_late": late_start(F.col("duration")), "_most": F.col("duration") - CLIP})
    first = F.ceil(F.col("_late") / STEP)
    last = F.floor((F.col("_most") + 1e-9) / STEP)
    grid = own.where(last >= first).select(*keys, "duration", F.explode(F.sequence(first, last)).alias("_i")).select(*keys, "duration", (F.col("_i") * STEP).alias("start"))
    about = events.select(*keys, "time").join(own, keys).where((F.col("time") >= F.col("_late")) & (F.col("time") <= F.col("duration")))
    centred = about.select(*keys, "duration", F.round(F.least("_most", F.greatest("_late", F.col("time") - CLIP / 2)), 3).alias("start"))
    return grid.unionByName(centred).unionByName(own.select(*keys, "duration", F.round("_most", 3).alias("start"))).distinct()


def window_metrics(clips: DataFrame, segments: DataFrame, speech: DataFrame, turns: DataFrame, backchannels: DataFrame, interruptions: DataFrame, keys: Sequence[str], slice_width: float | None = None) -> DataFrame:
    """``clips`` (keys, start; a clip each) with what the two speakers do there: alternations, rapid, turns, backchannels, interruptions, both (seconds), score.

    ``segments`` (transcribed) and ``speech`` are spans with side, ``backchannels`` spans, ``turns``
    and ``interruptions`` points in time. Everything meets the clips in one join by buckets of a
    clip's length; only the segments of one clip are ordered together.
    """
    keys = list(keys)
    point = lambda df, kind: df.select(*keys, F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("side"), F.col("time").cast("double").alias("s"), F.col("time").cast("double").alias("e"))
    span = lambda df, kind, side: df.select(*keys, F.lit(kind).alias("kind"), side.cast("int").alias("side"), F.col("start").cast("double").alias("s"), F.col("end").cast("double").alias("e"))
    none = F.lit(None)
    one, two = (intervals.union(speech.where(F.col("side") == i), keys, slice_width=slice_width) for i in (1, 2))
    items = point(turns, "turn").unionByName(point(interruptions, "interruption")).unionByName(span(backchannels, "backchannel", none)).unionByName(span(segments, "segment", F.col("side"))).unionByName(span(intervals.intersect(one, two, keys, CLIP), "both", none))
    own = clips.select(*keys, F.col("start").cast("double").alias("start"), (F.col("start") + CLIP).cast("double").alias("end")).distinct()
    met = intervals.overlap_join(own, items, keys, CLIP, closed=True, b_span=("s", "e")).select(*keys, F.col("a.start").alias("start"), *[f"b.{c}" for c in ("kind", "side", "s", "e")], (F.col("to") - F.col("from")).alias("shared"))
    w = Window.partitionBy(*keys, "start").orderBy("s", "e", "side")
    said = met.where("kind = 'segment'").withColumn("_gap", F.when(F.lag("side").over(w) != F.col("side"), F.col("s") - F.lag("e").over(w)))
    pairs = said.groupBy(*keys, "start").agg(F.count_if(F.col("_gap") <= ALTERNATION).alias("alternations"), F.count_if(F.col("_gap") <= RAPID).alias("rapid"))
    n = lambda kind: F.count_if(F.col("kind") == kind)
    counts = met.where("kind != 'segment'").groupBy(*keys, "start").agg(n("turn").alias("turns"), n("backchannel").alias("backchannels"), n("interruption").alias("interruptions"), F.coalesce(F.sum(F.when(F.col("kind") == "both", F.col("shared"))), F.lit(0.0)).alias("both"))
    x = clips.join(pairs, [*keys, "start"], "left").join(counts, [*keys, "start"], "left").fillna(0, ["alternations", "rapid", "turns", "backchannels", "interruptions", "both"])
    c = F.col
    return x.withColumn("score", F.round(interaction_score(c("alternations"), c("rapid"), c("turns"), c("backchannels"), c("interruptions"), c("both")), 3)).withColumn("both", F.round("both", 3))


def misalignment_queue(scored: DataFrame, assessments: DataFrame, suspicions: DataFrame, judgments: DataFrame, keys: Sequence[str], limit: int, seed: str = "misalignment-queue-1") -> DataFrame:
    """The ``limit`` recordings to judge next, each by its liveliest clip (keys, duration, start, score) that no judgment's window overlaps.

    ``judgments`` (keys, start, end, verdict): a recording judged aligned or misaligned is done; one
    judged unsure comes after all others. Then by category, likelihood, and keys. ``weight`` is for sampling.
    """
    keys = list(keys)
    done = judgments.where(F.col("verdict").isin("plausibly_aligned", "likely_misaligned")).select(*keys).distinct()
    unsure = judgments.where("verdict = 'unsure'").select(*keys).distinct().withColumn("unsure", F.lit(True))
    open_ = scored.join(done, keys, "left_anti").withColumn("end", F.col("start") + CLIP)
    fresh = intervals.overlap_join(open_, judgments.select(*keys, "start", "end"), keys, CLIP, how="left_anti")
    best = fresh.groupBy(*keys).agg(F.max(F.struct("score", (-(F.col("duration") - F.col("end"))).alias("_late"), "start", "end", "duration")).alias("_b"))
    x = best.select(*keys, "_b.start", "_b.end", "_b.score", (F.col("_b.duration") - F.col("_b.end")).alias("from_end")).join(assessments, keys).join(suspicions, keys).join(unsure, keys, "left").fillna(False, ["unsure"])
    lively = 1 - F.exp(-F.col("score") / 10.0)
    place = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    out = x.withColumn("weight", 0.15 + 3.0 * F.col("suspicion") + 0.75 * lively).withColumn("clip_id", hash_order(seed, *keys, F.round(F.col("start") * 1000).cast("bigint")))
    return out.orderBy("unsure", place, F.desc("likelihood"), *keys).limit(limit)
