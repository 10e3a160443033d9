"""Events of two-party conversations and the scores of whole recordings, from speech spans (key, side, start, end)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions.scalar import clamp, flags, leakage_score, penalty_above, per_hour, safe_ratio, score_between, weighted_mean
from parley.operators import intervals


@dataclass(frozen=True)
class EventRules:
    """Thresholds in the unit of the spans divided by ``unit`` (1 for seconds, 1e6 for microseconds)."""

    # Gap and overlap limits of the event rules.
    minimum_turn_gap: float = 0.05
    maximum_turn_gap: float = 2.0
    maximum_response: float = 0.70
    minimum_pause: float = 0.75
    minimum_overlap: float = 0.12
    interruption_overlap: float = 0.20
    maximum_backchannel: float = 0.85
    minimum_floor: float = 1.00
    unit: float = 1.0

    def at(self, name: str) -> float:
        return getattr(self, name) * self.unit


def neighbours(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Each span with the next one of its key, whoever speaks: next_side, next_start, next_end, gap."""
    w = Window.partitionBy(*keys).orderBy("start", "end", "side")
    out = spans.withColumns({f"next_{c}": F.lead(c).over(w) for c in ("side", "start", "end")})
    return out.where("next_start is not null").withColumn("gap", F.col("next_start") - F.col("end"))


def transitions(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Adjacent spans of different sides with a gap of 0 or more."""
    return neighbours(spans, keys).where("side != next_side and gap >= 0")


def transition_events(spans: DataFrame, keys: list[str], rules: EventRules = EventRules()) -> DataFrame:
    """turn_completion of the side that ends, start_response of the side that begins."""
    t = transitions(spans, keys).where(F.col("gap").between(rules.at("minimum_turn_gap"), rules.at("maximum_turn_gap")))
    kinds = F.array_compact(F.array(F.struct(F.lit("turn_completion").alias("kind"), F.col("side").alias("by"), F.col("next_side").alias("to")), F.when(F.col("gap") <= rules.at("maximum_response"), F.struct(F.lit("start_response").alias("kind"), F.col("next_side").alias("by"), F.col("side").alias("to")))))
    return t.select(*keys, F.col("end").alias("start"), F.col("next_start").alias("end"), F.explode(kinds).alias("x")).select(*keys, "start", "end", "x.kind", "x.by", "x.to")


def pauses(spans: DataFrame, keys: list[str], width: float, rules: EventRules = EventRules()) -> DataFrame:
    """Gaps within one side's speech, long enough, in which the other side is silent."""
    w = Window.partitionBy(*keys, "side").orderBy("start", "end")
    gaps = spans.select(*keys, "side", F.col("end").alias("start"), F.lead("start").over(w).alias("end")).where(F.col("end") - F.col("start") >= rules.at("minimum_pause"))
    busy = intervals.overlap_join(gaps, spans, keys, width).where("a.side != b.side").select(*keys, F.col("a.side").alias("side"), F.col("a.start").alias("start"), F.col("a.end").alias("end")).distinct()
    return gaps.join(busy, [*keys, "side", "start", "end"], "left_anti")


def overlaps(first: DataFrame, second: DataFrame, keys: list[str], width: float, rules: EventRules = EventRules()) -> DataFrame:
    """Overlapping pairs of the two sides: spans, shared part, and kind (backchannel, interruption, overlap) with who did it.

    A short span inside a long one is a back-channel; otherwise a strictly later start inside the
    other's span, with enough overlap, interrupts. The first side is tried first.
    """
    pairs = intervals.overlap_join(first, second, keys, width, minimum=rules.at("minimum_overlap"))
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    size = lambda s: s("end") - s("start")
    inside = lambda s, o: (size(s) <= rules.at("maximum_backchannel")) & (size(o) >= rules.at("minimum_floor")) & (s("start") >= o("start")) & (s("end") <= o("end"))
    cuts = lambda s, o: (F.col("to") - F.col("from") >= rules.at("interruption_overlap")) & (s("start") > o("start")) & (s("start") < o("end"))
    kind = F.when(inside(a, b), "backchannel:1").when(inside(b, a), "backchannel:2").when(cuts(a, b), "interruption:1").when(cuts(b, a), "interruption:2").otherwise("overlap:1")
    parts = F.split(kind, ":")
    return pairs.select(*keys, a("start").alias("start_1"), a("end").alias("end_1"), b("start").alias("start_2"), b("end").alias("end_2"), F.col("from").alias("start"), F.col("to").alias("end"), parts[0].alias("kind"), parts[1].cast("int").alias("by"))


def event_candidates(spans: DataFrame, keys: list[str], width: float, rules: EventRules = EventRules(), sides: tuple = (1, 2)) -> DataFrame:
    """(keys, kind, by, start, end) of all events: transitions, pauses, overlaps."""
    one, two = (spans.where(F.col("side") == s) for s in sides)
    found = transition_events(spans, keys, rules).select(*keys, "kind", "by", "start", "end")
    found = found.unionByName(pauses(spans, keys, width, rules).select(*keys, F.lit("pause").alias("kind"), F.col("side").alias("by"), "start", "end"))
    over = overlaps(one, two, keys, width, rules)
    return found.unionByName(over.select(*keys, "kind", F.when(F.col("by") == 1, sides[0]).otherwise(sides[1]).alias("by"), "start", "end"))


def density(spans: DataFrame, events: DataFrame, durations: DataFrame, keys: list[str], width: float, unit: float = 1.0, slice_width: float | None = None) -> DataFrame:
    """Per recording: speech, silence and overlap ratios, turns and windows per hour, and their mean score.

    Every event but a plain overlap makes a usable window. ``durations`` has (keys, duration);
    recordings without spans have ratios of 0.
    """
    one, two = spans.where("side = 1"), spans.where("side = 2")
    speech = intervals.measure(spans, keys, out="speech", slice_width=slice_width)
    shared = intervals.measure(intervals.intersect(one, two, keys, width), keys, out="overlap", slice_width=slice_width)
    counts = events.groupBy(*keys).agg(F.count_if(F.col("kind") == "turn_completion").alias("n_turns"), F.count_if(F.col("kind") != "overlap").alias("n_events"))
    base = durations.join(speech, keys, "left").join(shared, keys, "left").join(counts, keys, "left").fillna(0, ["speech", "overlap", "n_turns", "n_events"])
    seconds = F.col("duration") / unit
    out = base.withColumns({"speech_ratio": clamp(safe_ratio("speech", "duration")), "overlap_ratio": clamp(safe_ratio("overlap", "duration")), "turns_per_hour": per_hour("n_turns", seconds), "windows_per_hour": per_hour("n_events", seconds)})
    out = out.withColumn("silence_ratio", 1.0 - F.col("speech_ratio"))
    # The ranges over which the four terms are scored.
    score = (score_between("speech_ratio", 0.12, 0.45) + score_between("turns_per_hour", 0.0, 120.0) + score_between("windows_per_hour", 0.0, 180.0) + penalty_above("overlap_ratio", 0.18, 0.36)) / 4
    return out.withColumn("density_score", score)


def timing(spans: DataFrame, events: DataFrame, keys: list[str], unit: float = 1.0) -> DataFrame:
    """Per recording: median span, tiny and long shares, balance of events between the sides, and the timing score."""
    size = (F.col("end") - F.col("start")) / unit
    # A tiny span is under 0.2 s, a long one over 30 s.
    per = spans.groupBy(*keys).agg(F.percentile(size, 0.5).alias("median_span"), F.avg((size < 0.2).cast("double")).alias("tiny_ratio"), F.avg((size > 30.0).cast("double")).alias("long_ratio"))
    n = events.groupBy(*keys).agg(F.count_if(F.col("by") == 1).alias("n_1"), F.count_if(F.col("by") == 2).alias("n_2"))
    out = per.join(n, keys, "left").fillna(0, ["n_1", "n_2"])
    plausible = (score_between("median_span", 0.25, 1.20) + penalty_above("tiny_ratio", 0.15, 0.50) + penalty_above("long_ratio", 0.02, 0.15)) / 3
    total = F.col("n_1") + F.col("n_2")
    balance = F.when(total > 0, 1.0 - F.abs(F.col("n_1") - F.col("n_2")) / total).otherwise(0.0)
    return out.withColumn("balance", balance).withColumn("timing_score", (plausible + F.col("balance")) / 2)


def quality_flags(scores: dict[str, Column]) -> Column:
    """Names of what is wrong with a recording.

    ``scores``: speech_ratio, overlap_ratio, windows_per_hour, timing_score, gap_ratio (of the tracks'
    durations), envelope_correlation (may be null), annotated_events (0 without an annotation), and
    booleans low_information_1, low_information_2, very_low_rms, leakage. Annotated events speak
    for themselves, so with some of them neither little speech nor poor timing counts.
    """
    s = scores
    plain, shared, speech = s["annotated_events"] <= 0, s["overlap_ratio"], s["speech_ratio"]
    # The limits of the rules.
    return flags(
        (plain & ((speech < 0.08) | (s["windows_per_hour"] < 25.0)), "empty_or_no_interaction"),
        (s["low_information_1"] & s["low_information_2"], "both_tracks_low_information"),
        (s["very_low_rms"], "very_low_rms"),
        (F.coalesce(s["envelope_correlation"] >= 0.75, F.lit(False)), "shared_energy_reverb_or_bleed"),
        (s["leakage"], "inactive_track_leakage"),
        (shared >= 0.45, "severe_overlap"),
        ((shared >= 0.30) & (shared < 0.45), "high_overlap"),
        ((shared >= 0.18) & (shared < 0.30) & (speech >= 0.70), "dense_overlap"),
        ((s["gap_ratio"] > 0.01) & (speech < 0.35), "low_interaction_duration_mismatch"),
        (plain & (s["timing_score"] < 0.35), "poor_timing_plausibility"),
    )


def total_score(density_score: Column, timing_score: Column, audio_score: Column, annotation_score: Column) -> Column:
    """Weighted mean; without an annotation the other weights fill in."""
    return weighted_mean([(density_score, 0.15), (timing_score, 0.10), (audio_score, 0.25), (annotation_score, 0.50)])


def pair_audio_score(first: Column, second: Column, gap_ratio: Column, correlation: Column, envelope: Column, leak_1: Column, leak_2: Column) -> Column:
    """Mean of six terms of a pair of tracks; a missing correlation costs nothing."""
    none = lambda c: F.coalesce(F.abs(c), F.lit(0.0))
    terms = [(first + second) / 2, penalty_above(gap_ratio, 0.01, 0.10), penalty_above(none(correlation), 0.15, 0.50), penalty_above(none(envelope), 0.20, 0.70), leakage_score(leak_1), leakage_score(leak_2)]
    return sum(terms[1:], terms[0]) / len(terms)


def unusable_regions(spans: DataFrame, durations: DataFrame, keys: list[str], width: float, unit: float = 1.0, slice_width: float | None = None) -> DataFrame:
    """(keys, start, end, reason): long dual silence, long one-sided activity, slow exchange of turns."""
    # At least 6 s without speech; 45 s without one side while the other speaks 3 s; 3 s between turns.
    bounds = durations.select(*keys, (F.col("duration") * 0).alias("low"), F.col("duration").alias("high"))
    return dual_silence(spans, bounds, keys, 6 * unit, slice_width).unionByName(one_sided(spans, bounds, keys, 45 * unit, 3 * unit, width)).unionByName(slow_exchange(spans, keys, 3 * unit))


def dual_silence(spans: DataFrame, bounds: DataFrame | None, keys: list[str], minimum: float, slice_width: float | None = None) -> DataFrame:
    quiet = intervals.gaps(spans, keys, bounds=bounds, slice_width=slice_width)
    return quiet.where(F.col("end") - F.col("start") >= minimum).withColumn("reason", F.lit("dual_silence"))


def one_sided(spans: DataFrame, bounds: DataFrame | None, keys: list[str], minimum: float, present: float, width: float) -> DataFrame:
    """From the first to the last activity of one side within a long gap of the other's."""
    by_side = [*keys, "side"]
    both = None if bounds is None else bounds.withColumn("side", F.explode(F.array(F.lit(1), F.lit(2))))
    gaps = intervals.gaps(spans.select(*by_side, "start", "end"), by_side, bounds=both).where(F.col("end") - F.col("start") >= minimum)
    met = intervals.overlap_join(gaps, spans, keys, width).where("a.side != b.side")
    per = met.groupBy(*keys, F.col("a.side").alias("side"), F.col("a.start").alias("gap_start"), F.col("a.end").alias("gap_end")).agg(F.min("from").alias("start"), F.max("to").alias("end"), F.sum(F.col("to") - F.col("from")).alias("active"))
    return per.where(F.col("active") >= present).select(*keys, "start", "end", F.lit("one_sided_activity").alias("reason"))


def slow_exchange(spans: DataFrame, keys: list[str], minimum: float) -> DataFrame:
    return transitions(spans, keys).where(F.col("gap") >= minimum).select(*keys, F.col("end").alias("start"), F.col("next_start").alias("end"), F.lit("slow_turn_exchange").alias("reason"))
