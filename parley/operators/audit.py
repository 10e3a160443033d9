"""Audit of a corpus: events of each orientation, windows and why they are rejected, sums by recording and dataset, progress to a pilot.

Spans are in the unit of ``unit`` (1 for seconds). An orientation takes one side for the user and the
other for the assistant; keys name recording and orientation where both are audited.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.scalar import flags
from parley.operators import intervals

# Limits in seconds and shares; the pilot's targets.
FRAME, BURN_IN = 0.08, 4.0
SHIFT_GAP, HOLD_GAP, HOLD_MERGE = 1.5, 0.25, 0.5
HORIZONS = (0.2, 0.5, 1.0, 1.5)
CATEGORIES = ("overlap_interruption", "non_floor_feedback", "hold_pause", "turn_shift", "background")
REJECTIONS = ("missing_region_analysis", "insufficient_supervised_duration", "insufficient_primary_supervision", "insufficient_future_supervision", "excessive_masking", "human_review_exclusion")
PILOT = (("usable_hours", 100.0), ("turn_shifts", 20_000.0), ("hold_pauses", 20_000.0), ("backchannels", 5_000.0), ("interruptions_and_overlaps", 2_000.0))


def shift_times(releasing: DataFrame, responding: DataFrame, keys: Sequence[str], unit: float = 1.0) -> DataFrame:
    """(keys, time): ends of transcript segments that the other side follows within the gap."""
    said = lambda df: df.where("source = 'transcript'")
    answers = said(responding).select(*keys, F.col("start").alias("_n"))
    x = intervals.asof(said(releasing).select(*keys, "start", "end"), answers, keys, "end", "_n", forward=True, tolerance=SHIFT_GAP * unit, out="_m")
    return x.where("_m is not null").select(*keys, F.col("end").alias("time"))


def overlap_onsets(first: DataFrame, second: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """(keys, time): where each overlap of the two sides' disjoint spans begins."""
    return intervals.overlap_join(first, second, keys, width).select(*keys, F.col("from").alias("time"))


def events(user: DataFrame, assistant: DataFrame, connections: DataFrame, backchannels: DataFrame, interruptions: DataFrame, user_speech: DataFrame, assistant_speech: DataFrame, keys: Sequence[str], width: float, unit: float = 1.0) -> DataFrame:
    """(keys, kind, time) of what a window can be about: shifts of either side, the user's holds, feedback, interruptions and overlaps."""
    kind = lambda df, name, time: df.select(*keys, F.lit(name).alias("kind"), time.cast("double").alias("time"))
    shifts = shift_times(user, assistant, keys, unit).unionByName(shift_times(assistant, user, keys, unit))
    holds = connections.where((F.col("end") - F.col("start") >= HOLD_GAP * unit) & (F.col("merge") >= HOLD_MERGE))
    middle = (F.col("start") + F.col("end")) / 2
    heard = intervals.overlap_join(backchannels, assistant_speech, keys, width, how="left_semi")
    parts = [kind(shifts, "turn_shift", F.col("time")), kind(holds, "hold_pause", middle), kind(heard, "non_floor_feedback", middle), kind(interruptions, "overlap_interruption", F.col("time")), kind(overlap_onsets(user_speech, assistant_speech, keys, width), "overlap_interruption", F.col("time"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def floor_validity(segments: DataFrame, connections: DataFrame, keys: Sequence[str], width: float, unit: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Spans in which the floor is known to be valid whatever else holds, and spans in which it is masked unless the first say otherwise.

    Transcript segments are valid; then a connection is valid if transcript segments end and start at
    its bounds, and masked if not; mere activity is masked; everything else is valid.
    """
    said, mere = segments.where("source = 'transcript'"), segments.where("source = 'audio'")
    both = connections.select(*keys, "start", "end").distinct()
    edge = FRAME * unit
    for name, bound, of in (("_a", "start", "end"), ("_b", "end", "start")):
        near = said.select(*keys, (F.col(of) - edge).alias("start"), (F.col(of) + edge).alias("end"))
        points = both.select(*keys, F.col(bound).alias("start"), F.col(bound).alias("end")).distinct()
        hit = intervals.overlap_join(points, near, keys, width, closed=True).select(*keys, F.col("a.start").alias(bound)).distinct().withColumn(name, F.lit(True))
        both = both.join(hit, [*keys, bound], "left")
    ok = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    valid = said.select(*keys, "start", "end").unionByName(both.where(ok).select(*keys, "start", "end"))
    return intervals.union(valid, keys), intervals.union(both.where(~ok).select(*keys, "start", "end").unionByName(mere.select(*keys, "start", "end")), keys)


def supervision(windows: DataFrame, valid: DataFrame, doubtful: DataFrame, keys: Sequence[str], width: float, unit: float = 1.0) -> DataFrame:
    """Windows (keys, start, end, limit) with n_frames supervised, and primary and future ratios: frames of valid floor, and horizons that the annotation covers.

    Frames are counted where spans cut the grid of their middles, not made; only the last one, whose
    middle may lie past the window's end and then stands at it, is looked at as a point.
    """
    frame = FRAME * unit if not isinstance(unit, int) else round(FRAME * unit)
    n = F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("start")) / frame)).cast("bigint")
    first = F.ceil(F.lit(BURN_IN / FRAME - 0.5) - 1e-9).cast("bigint")
    x = windows.select(*keys, "start", "end", "limit").withColumns({"_n": n, "_i": first})
    x = x.withColumn("_last", F.least(F.col("end").cast("double"), F.col("start") + (F.col("_n") - 0.5) * frame)).withColumn("n_frames", F.greatest(F.col("_n") - F.col("_i"), F.lit(0)))
    bad = intervals.subtract(doubtful, valid, keys, width)
    inside = lambda v: F.greatest(F.col("a._i"), F.least(F.col("a._n") - 1, F.ceil((v - F.col("a.start")) / frame - 0.5)))
    cut = intervals.overlap_join(x, bad, keys, width).groupBy(*keys, F.col("a.start").alias("start"), F.col("a.end").alias("end")).agg(F.sum(inside(F.col("to")) - inside(F.col("from"))).alias("_bad"))
    x = intervals.contains(x.join(cut, [*keys, "start", "end"], "left").fillna(0, ["_bad"]), bad, keys, width, "_last", "_end_bad")
    lost = F.greatest(F.col("_bad"), F.lit(0)) + F.col("_end_bad").cast("bigint")
    ahead = F.lit(0).cast("bigint")
    for h in HORIZONS:
        seen = F.floor((F.col("limit") - h * unit - F.col("start")) / frame - 0.5) + 1
        ahead = ahead + F.greatest(F.least(seen, F.col("_n") - 1) - F.col("_i"), F.lit(0)) + (F.col("_last") + h * unit <= F.col("limit")).cast("bigint")
    some = F.nullif(F.col("n_frames"), F.lit(0))
    primary, future = F.coalesce(1 - lost / some, F.lit(0.0)), F.coalesce(ahead / (some * len(HORIZONS)), F.lit(0.0))
    return x.select(*keys, "start", "end", "n_frames", primary.alias("primary"), future.alias("future"))


def audit_windows(windows: DataFrame, found: DataFrame, regions: DataFrame, exclusions: DataFrame, keys: Sequence[str], width: float, unit: float = 1.0, supervised: float = 8.0, primary: float = 0.9, future: float = 0.95, most_masked: float = 0.35, analysed: str | None = None) -> DataFrame:
    """Windows (keys, start, end, primary, future) with supervised, masked, category, counts of events covered (n_events, and by kind), rejections, accepted and effective seconds.

    ``regions`` are unusable spans (disjoint), ``exclusions`` those that people excluded, ``found`` the events.
    ``analysed`` names a boolean column of the windows: whether the recording's regions were ever
    analysed. A window of one that was not is rejected for that alone, as nothing is known about its masks.
    """
    seen = F.lit(True) if analysed is None else F.coalesce(F.col(analysed), F.lit(False))
    begin = F.least(F.col("end"), F.col("start") + BURN_IN * unit)
    x = windows.withColumn("_from", begin).withColumn("supervised", F.greatest(F.lit(0.0), F.col("end") - F.col("_from")) / unit)
    inner = x.select(*keys, F.col("_from").alias("start"), F.col("end"), F.col("start").alias("_w"))
    cut = intervals.overlap_join(inner, regions.select(*keys, "start", "end"), keys, width).groupBy(*keys, F.col("a._w").alias("start"), F.col("a.end").alias("end")).agg((F.sum(F.col("to") - F.col("from")) / unit).alias("masked"))
    points = found.select(*keys, F.col("time").alias("start"), F.col("time").alias("end"), "kind")
    met = intervals.overlap_join(inner, points, keys, width, closed=True).where("b.start < a.end")
    of = F.create_map(*[x for c in CATEGORIES[:-1] for x in (F.lit(c), F.count_if(F.col("b.kind") == c))])
    about = met.groupBy(*keys, F.col("a._w").alias("start"), F.col("a.end").alias("end")).agg(F.collect_set("b.kind").alias("_kinds"), F.count("*").alias("n_events"), of.alias("covered"))
    out = intervals.overlap_join(x.select(*keys, "start", "end"), exclusions.select(*keys, "start", "end"), keys, width).select(*keys, F.col("a.start").alias("start"), F.col("a.end").alias("end")).distinct().withColumn("_out", F.lit(True))
    same = [*keys, "start", "end"]
    x = x.join(cut, same, "left").join(about, same, "left").join(out, same, "left").fillna(0.0, ["masked"]).fillna(0, ["n_events"])
    share = F.when(F.col("supervised") > 0, F.col("masked") / F.col("supervised")).otherwise(0.0)
    why = flags((F.col("supervised") < supervised, "insufficient_supervised_duration"), (F.col("primary") < primary, "insufficient_primary_supervision"), (F.col("future") < future, "insufficient_future_supervision"), (share > most_masked, "excessive_masking"), (F.col("_out").isNotNull(), "human_review_exclusion"))
    why = F.when(seen, why).otherwise(F.array(F.lit("missing_region_analysis")))
    category = F.coalesce(*[F.when(F.array_contains("_kinds", c), F.lit(c)) for c in CATEGORIES[:-1]], F.lit(CATEGORIES[-1]))
    effective = F.greatest(F.lit(0.0), F.col("supervised") * F.col("primary") - F.col("masked"))
    x = x.withColumns({"category": category, "rejections": why, "masked": F.when(seen, F.col("masked")).otherwise(0.0)}).withColumn("accepted", F.size("rejections") == 0)
    none = F.create_map(*[v for c in CATEGORIES[:-1] for v in (F.lit(c), F.lit(0).cast("bigint"))])
    x = x.withColumns({"effective": F.when(F.col("accepted"), effective).otherwise(0.0), "n_events": F.when(F.col("accepted"), F.col("n_events")).otherwise(0), "covered": F.when(F.col("accepted"), F.coalesce("covered", none)).otherwise(none)})
    return x.drop("_from", "_kinds", "_out")


def summarize(audited: DataFrame, keys: Sequence[str], unit: float = 1.0) -> DataFrame:
    """Sums of audited windows per ``keys``: of recordings, datasets or everything, as sums add up."""
    ok = F.col("accepted")
    total = lambda c: F.sum(F.when(ok, c).otherwise(0.0))
    return audited.groupBy(*keys).agg(F.count("*").alias("candidates"), F.count_if(ok).alias("accepted"), total((F.col("end") - F.col("start")) / unit).alias("input_seconds"), total(F.col("supervised")).alias("supervised_seconds"), F.sum("effective").alias("effective_seconds"), total(F.col("masked")).alias("masked_seconds"))


def category_summary(audited: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, category, windows, available, covered): accepted windows of each category, events there are, and those in accepted windows.

    One row for every category of each of the ``keys`` that has windows, zeros included; covered
    counts an event once for each accepted window about it.
    """
    keys = list(keys)
    ok = F.col("accepted")
    own = audited.groupBy(*keys).agg(*[F.count_if(ok & (F.col("category") == c)).alias(f"w_{c}") for c in CATEGORIES], *[F.sum(F.col("covered")[c]).alias(f"c_{c}") for c in CATEGORIES[:-1]])
    there = found.groupBy(*keys).agg(*[F.count_if(F.col("kind") == c).alias(f"a_{c}") for c in CATEGORIES[:-1]])
    zero = F.lit(0).cast("bigint")
    count = lambda k, c: zero if c == CATEGORIES[-1] and k != "w" else F.coalesce(F.col(f"{k}_{c}"), zero)
    rows = F.array(*[F.struct(F.lit(c).alias("category"), count("w", c).alias("windows"), count("a", c).alias("available"), count("c", c).alias("covered")) for c in CATEGORIES])
    return own.join(there, keys, "left").select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def rejection_summary(audited: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, reason, windows) of every reason, zeros included, for each of the ``keys`` that has windows."""
    keys = list(keys)
    own = audited.groupBy(*keys).agg(*[F.count_if(F.array_contains("rejections", r)).alias(r) for r in REJECTIONS])
    return own.select(*keys, F.explode(F.array(*[F.struct(F.lit(r).alias("reason"), F.col(r).alias("windows")) for r in REJECTIONS])).alias("r")).select(*keys, "r.*")


def usable_seconds(recordings: DataFrame, regions: DataFrame, exclusions: DataFrame, keys: Sequence[str], width: float, unit: float = 1.0, analysed: str | None = None) -> DataFrame:
    """``recordings`` (keys, duration) with ``usable``: without unusable regions (disjoint), and without exclusions where these go beyond them.

    ``analysed`` names a boolean column of the recordings; of one whose regions were never analysed nothing is usable.
    """
    bad = regions.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("_bad"))
    part = intervals.overlap_join(exclusions, regions, keys, width).groupBy(*keys).agg(F.sum(F.col("to") - F.col("from")).alias("_both"))
    out = exclusions.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("_out"))
    x = recordings.join(bad, list(keys), "left").join(out, list(keys), "left").join(part, list(keys), "left").fillna(0, ["_bad", "_out", "_both"])
    seen = F.lit(True) if analysed is None else F.coalesce(F.col(analysed), F.lit(False))
    left = F.greatest(F.lit(0.0), (F.col("duration") - F.col("_bad") - (F.col("_out") - F.col("_both"))) / unit)
    return x.withColumn("usable", F.when(seen, left).otherwise(0.0)).drop("_bad", "_out", "_both")


def pilot(totals: DataFrame) -> DataFrame:
    """(metric, current, target, ready) of one row of totals with the PILOT columns."""
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("current"), F.lit(t).alias("target")) for n, t in PILOT])
    return totals.select(F.explode(rows).alias("m")).select("m.*", (F.col("m.current") >= F.col("m.target")).alias("ready"))
