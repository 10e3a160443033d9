"""Training targets of frames: what each head of a turn-taking model should say at a moment, and where it must not be asked.

A target is struct<target, valid, reason>: a value, or the reason why there is none. Spans are in
the unit of ``unit`` (1 for seconds). Segments are (keys, start, end, source, turn, keep_playing,
interruption) of one speaker, source being transcript or audio; connections (keys, start, end, merge,
pause) lie between two segments of one speaker. Frames are (keys, time). Where several spans hold a
moment the first by start and end counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators import intervals

# The limits of the targets, in seconds, and shares.
FRAME = 0.08
YIELD_HORIZON, YIELD_RADIUS, YIELD_FLOOR, YIELD_LENGTH = 0.5, 0.5, 0.1, 0.1
BACKCHANNEL_HORIZON = 0.2
PAUSE_RETENTION = 0.5
COMPLETION_SILENCE = 1.5
LONGEST_SILENCE = 2.0
HIGH = 0.8


def _in(seconds: float, unit: float) -> float:
    """A length in the unit of the spans: whole where that is."""
    return round(seconds * unit) if isinstance(unit, int) else seconds * unit


def valid(x: Column) -> Column:
    return F.struct(x.cast("double").alias("target"), F.lit(True).alias("valid"), F.lit(None).cast("string").alias("reason"))


def masked(reason: str) -> Column:
    return F.struct(F.lit(None).cast("double").alias("target"), F.lit(False).alias("valid"), F.lit(reason).alias("reason"))


def covering(points: DataFrame, spans: DataFrame, keys: Sequence[str], width: float, at: str, fields: Sequence[str], out: str) -> DataFrame:
    """``points`` with struct ``out``: start, end and ``fields`` of the first span with start <= at < end, else null."""
    one = points.select(*keys, F.col(at).alias("start"), F.col(at).alias("end")).distinct()
    hit = intervals.overlap_join(one, spans.select(*keys, "start", "end", *fields), keys, width, closed=True).where("a.start >= b.start and a.start < b.end")
    best = hit.groupBy(*keys, F.col("a.start").alias(at)).agg(F.min(F.struct("b.start", "b.end", *[f"b.{f}" for f in fields])).alias(out))
    return points.join(best, [*keys, at], "left")


def coverings(points: DataFrame, spans: dict[str, tuple[DataFrame, Sequence[str]]], keys: Sequence[str], width: float, at: str) -> DataFrame:
    """:func:`covering` for several kinds of spans at once, each a struct by its name: one join of the points with all spans."""
    one = points.select(*keys, F.col(at).alias("start"), F.col(at).alias("end")).distinct()
    tagged = None
    for name, (df, fields) in spans.items():
        own = df.select(*keys, "start", "end", F.struct("start", "end", *fields).alias(name))
        tagged = own if tagged is None else tagged.unionByName(own, allowMissingColumns=True)
    hit = intervals.overlap_join(one, tagged, keys, width, closed=True).where("a.start >= b.start and a.start < b.end")
    best = hit.groupBy(*keys, F.col("a.start").alias(at)).agg(*[F.min(f"b.{name}").alias(name) for name in spans])
    return points.join(best, [*keys, at], "left")


def beside(points: DataFrame, spans: DataFrame, keys: Sequence[str], width: float, at: str, edge_col: str, edge: float, fields: Sequence[str], out: str) -> DataFrame:
    """``points`` with struct ``out`` of the first span whose ``edge_col`` is within ``edge`` of ``at``."""
    one = points.select(*keys, F.col(at).alias("start"), F.col(at).alias("end")).distinct()
    near = spans.select(*keys, (F.col(edge_col) - edge).alias("start"), (F.col(edge_col) + edge).alias("end"), F.struct("start", "end", *fields).alias("o"))
    hit = intervals.overlap_join(one, near, keys, width, closed=True)
    best = hit.groupBy(*keys, F.col("a.start").alias(at)).agg(F.min("b.o").alias(out))
    return points.join(best, [*keys, at], "left")


def connection_floor(connections: DataFrame, segments: DataFrame, keys: Sequence[str], width: float, unit: float = 1.0) -> DataFrame:
    """Connections with struct ``floor``: merge, less half the pause, times the lesser turn confidence beside it; masked where a side has no transcript."""
    said = segments.where("source = 'transcript'")
    both = beside(connections, said, keys, width, "start", "end", _in(FRAME, unit), ["turn"], "_before")
    both = beside(both, said, keys, width, "end", "start", _in(FRAME, unit), ["turn"], "_after")
    value = F.col("merge") * (1 - (1 - PAUSE_RETENTION) * F.col("pause")) * F.least("_before.turn", "_after.turn")
    ok = F.col("_before").isNotNull() & F.col("_after").isNotNull()
    return both.withColumn("floor", F.when(ok, valid(value)).otherwise(masked("ambiguous_annotation"))).drop("_before", "_after")


def floor(frames: DataFrame, segments: DataFrame, connections: DataFrame, keys: Sequence[str], width: float, unit: float = 1.0, at: str = "time", out: str = "floor") -> DataFrame:
    """How much the speaker holds the floor: the transcript segment's confidence, the connection's floor, masked in mere activity, else 0."""
    x = coverings(frames, _floor_spans(segments, connections, keys, width, unit), keys, width, at)
    return x.withColumn(out, _floor_target()).drop("_floor_s", "_floor_c", "_floor_a")


def _floor_spans(segments: DataFrame, connections: DataFrame, keys: Sequence[str], width: float, unit: float) -> dict[str, tuple[DataFrame, Sequence[str]]]:
    said, mere = segments.where("source = 'transcript'"), segments.where("source = 'audio'")
    return {"_floor_s": (said, ["turn"]), "_floor_c": (connection_floor(connections, segments, keys, width, unit), ["floor"]), "_floor_a": (mere, [])}


def _floor_target() -> Column:
    return F.when(F.col("_floor_s").isNotNull(), valid(F.col("_floor_s.turn"))).when(F.col("_floor_c").isNotNull(), F.col("_floor_c.floor")).when(F.col("_floor_a").isNotNull(), masked("ambiguous_annotation")).otherwise(valid(F.lit(0.0)))


def user_yield(frames: DataFrame, segments: DataFrame, connections: DataFrame, keys: Sequence[str], width: float, unit: float = 1.0, out: str = "user_yield") -> DataFrame:
    """Whether the user gives up the floor within the horizon: asked near the end of a turn only. Frames have supervised and limit (end of the annotation)."""
    turns = segments.where((F.col("source") == "transcript") & (F.col("turn") >= YIELD_FLOOR) & (F.col("end") - F.col("start") >= _in(YIELD_LENGTH, unit)))
    x = beside(frames, turns, keys, width, "time", "end", _in(YIELD_RADIUS, unit), [], "_near").withColumn("_then", F.col("time") + _in(YIELD_HORIZON, unit))
    x = floor(x, segments, connections, keys, width, unit, "_then", "_floor")
    target = (
        F.when(~F.col("supervised"), masked("burn_in"))
        .when(F.col("_near").isNull(), masked("outside_user_yield_context"))
        .when(F.col("_then") > F.col("limit"), masked("future_horizon_censored"))
        .when(F.col("_floor.valid"), valid(1 - F.col("_floor.target")))
        .otherwise(F.col("_floor"))
    )
    return x.withColumn(out, target).drop("_near", "_then", "_floor")


def floor_input(frames: DataFrame, segments: DataFrame, connections: DataFrame, backchannels: DataFrame, keys: Sequence[str], width: float, unit: float = 1.0, out: str = "floor_input") -> DataFrame:
    """The assistant's floor as an input: that of the connection alone within its back-channels; 0 where it is masked."""
    x = coverings(frames, _floor_spans(segments, connections, keys, width, unit) | {"_b": (backchannels, [])}, keys, width, "time").withColumn("_f", _floor_target())
    inside = F.coalesce("_floor_c.floor.target", F.lit(0.0))
    return x.withColumn(out, F.when(F.col("_b").isNotNull(), inside).otherwise(F.coalesce("_f.target", F.lit(0.0)))).drop("_b", "_f", "_floor_s", "_floor_c", "_floor_a")


def backchannel_confidence(backchannels: DataFrame, segments: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Back-channels with ``confidence``: keep_playing of the transcript segment that shares most with each; null without one."""
    own = backchannels.select(*keys, "start", "end").distinct()
    met = intervals.overlap_join(own, segments.where("source = 'transcript'").select(*keys, "start", "end", "keep_playing"), keys, width)
    rank = F.struct(F.col("to") - F.col("from"), -F.col("b.start"), -F.col("b.end"))
    best = met.groupBy(*keys, F.col("a.start").alias("start"), F.col("a.end").alias("end")).agg(F.max_by("b.keep_playing", rank).alias("confidence"))
    return backchannels.join(best, [*keys, "start", "end"], "left")


def upcoming_backchannel(frames: DataFrame, backchannels: DataFrame, segments: DataFrame, keys: Sequence[str], width: float, unit: float = 1.0, out: str = "backchannel") -> DataFrame:
    """Whether the assistant gives a back-channel within the horizon: the largest confidence of those that begin then; masked if one has none."""
    sure = backchannel_confidence(backchannels, segments, keys, width)
    ahead = frames.select(*keys, F.col("time").alias("start"), (F.col("time") + _in(BACKCHANNEL_HORIZON, unit)).alias("end")).distinct()
    begin = sure.select(*keys, F.col("start").alias("start"), F.col("start").alias("end"), "confidence")
    met = intervals.overlap_join(ahead, begin, keys, width, closed=True)
    best = met.groupBy(*keys, F.col("a.start").alias("time")).agg(F.max("b.confidence").alias("_most"), F.max(F.col("b.confidence").isNull()).alias("_unsure"))
    x = frames.join(best, [*keys, "time"], "left")
    target = (
        F.when(~F.col("supervised"), masked("burn_in"))
        .when(F.col("time") + _in(BACKCHANNEL_HORIZON, unit) > F.col("limit"), masked("future_horizon_censored"))
        .when(F.col("_unsure"), masked("ambiguous_annotation"))
        .otherwise(valid(F.coalesce("_most", F.lit(0.0))))
    )
    return x.withColumn(out, target).drop("_most", "_unsure")


def continuation_pause(frames: DataFrame, connections: DataFrame, keys: Sequence[str], width: float, out: str = "continuation_pause") -> DataFrame:
    x = covering(frames, connections, keys, width, "time", ["merge", "pause"], "_c")
    return x.withColumn(out, F.when(F.col("_c").isNotNull(), valid(F.col("_c.pause") * F.col("_c.merge"))).otherwise(masked("no_auxiliary_annotation"))).drop("_c")


def feedback(frames: DataFrame, backchannels: DataFrame, segments: DataFrame, keys: Sequence[str], width: float, out: str = "non_floor_feedback") -> DataFrame:
    x = covering(frames, backchannel_confidence(backchannels, segments, keys, width), keys, width, "time", ["confidence"], "_b")
    return x.withColumn(out, F.when(F.col("_b").isNull(), masked("no_auxiliary_annotation")).when(F.col("_b.confidence").isNull(), masked("ambiguous_annotation")).otherwise(valid(F.col("_b.confidence")))).drop("_b")


def speaking(frames: DataFrame, speech: DataFrame, pauses: DataFrame, backchannels: DataFrame, keys: Sequence[str], width: float, at: str = "time", out: str = "speaking") -> DataFrame:
    """Whether a speaker is heard: in a turn but not in its pauses, or in a back-channel."""
    x = coverings(frames, {"_t": (speech, []), "_p": (pauses, []), "_b": (backchannels, [])}, keys, width, at)
    return x.withColumn(out, (F.col("_t").isNotNull() & F.col("_p").isNull()) | F.col("_b").isNotNull()).drop("_t", "_p", "_b")


def _following(segments: DataFrame, user: DataFrame, assistant: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segments with the next start of either side, at or after their end."""
    x = segments
    for name, other in (("next_user", user), ("next_assistant", assistant)):
        x = intervals.asof(x, other.select(*keys, F.col("start").alias("_n")), keys, "end", "_n", forward=True, out="_m").withColumn(name, F.col("_m._n")).drop("_m")
    return x


def decision_boundaries(user: DataFrame, assistant: DataFrame, connections: DataFrame, limits: DataFrame, keys: Sequence[str], width: float, unit: float = 1.0) -> DataFrame:
    """(keys, offset, until, source) of each user segment's end: up to two seconds of silence after it, or to whoever speaks next.

    ``limits`` has (keys, limit). source is connection, segment_end, or censored where the annotation ends too early to tell.
    """
    x = _following(user.select(*keys, "start", "end"), user, assistant, keys).join(limits, list(keys))
    x = beside(x, connections, keys, width, "end", "start", _in(FRAME, unit), [], "_c")
    silence = F.col("end") + _in(LONGEST_SILENCE, unit)
    until = F.least("limit", silence, F.coalesce(F.least("next_user", "next_assistant"), "limit"))
    source = F.when(F.col("_c").isNotNull(), "connection").when(F.col("next_assistant").isNotNull() | (silence <= F.col("limit")), "segment_end").otherwise("censored")
    return x.select(*keys, F.col("end").alias("offset"), F.greatest(F.col("end") + _in(FRAME, unit), until).alias("until"), source.alias("source"))


def active_boundary(frames: DataFrame, boundaries: DataFrame, keys: Sequence[str], width: float, out: str = "boundary") -> DataFrame:
    """Frames with the latest boundary that holds them."""
    one = frames.select(*keys, F.col("time").alias("start"), F.col("time").alias("end")).distinct()
    spans = boundaries.select(*keys, F.col("offset").alias("start"), F.col("until").alias("end"), "source")
    hit = intervals.overlap_join(one, spans, keys, width, closed=True).where("a.start < b.end")
    best = hit.groupBy(*keys, F.col("a.start").alias("time")).agg(F.max(F.struct(F.col("b.start").alias("offset"), F.col("b.end").alias("until"), "b.source")).alias(out))
    return frames.join(best, [*keys, "time"], "left")


def completion_anchors(user: DataFrame, assistant: DataFrame, connections: DataFrame, points: DataFrame, limits: DataFrame, keys: Sequence[str], width: float, unit: float = 1.0) -> DataFrame:
    """(keys, time, source, completion) at the end of each user segment.

    A connection leaves what it does not merge. Else a turn counts as complete where a detector has
    a sure point (``points``: keys, at, confidence), the assistant speaks next, or nobody speaks for a
    while; where the annotation ends too early the anchor is censored, and otherwise ambiguous.
    """
    x = _following(user.select(*keys, "start", "end", "source", "turn"), user, assistant, keys).join(limits, list(keys))
    x = beside(x, connections, keys, width, "end", "start", _in(FRAME, unit), ["merge"], "_c")
    sure = points.where(F.coalesce(F.col("confidence") >= HIGH, F.lit(True))).select(*keys, F.col("at").alias("start"), F.col("at").alias("end"))
    x = beside(x, sure, keys, width, "end", "start", _in(FRAME, unit), [], "_p")
    quiet = F.col("end") + _in(COMPLETION_SILENCE, unit)
    answered = F.col("next_assistant").isNotNull() & (F.col("next_user").isNull() | (F.col("next_assistant") < F.col("next_user")))
    silent = (F.col("limit") >= quiet) & (F.col("next_user").isNull() | (F.col("next_user") >= quiet))
    early = F.col("next_user").isNull() & F.col("next_assistant").isNull() & (F.col("limit") < quiet)
    said, linked = F.col("source") == "transcript", F.col("_c").isNotNull()
    done = F.col("_p").isNotNull() | answered | silent
    completion = (
        F.when(~said, masked("ambiguous_annotation"))
        .when(linked, valid(F.col("turn") * (1 - F.col("_c.merge"))))
        .when(done, valid(F.col("turn")))
        .when(early, masked("censored_annotation"))
        .otherwise(masked("ambiguous_annotation"))
    )
    source = F.when(linked, "connection").when(said & ~done & early, "censored").otherwise("segment_end")
    return x.select(*keys, F.col("end").alias("time"), source.alias("source"), completion.alias("completion"))


def overlap_anchors(user: DataFrame, assistant: DataFrame, speech: DataFrame, pauses: DataFrame, backchannels: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """(keys, time, source, floor_take) where a user segment begins while the assistant speaks in a sure turn; ``speech``, ``pauses``, ``backchannels`` are the assistant's."""
    sure = assistant.where((F.col("turn") >= HIGH) & (F.col("source") == "transcript"))
    x = covering(user, sure, keys, width, "start", [], "_o")
    x = speaking(x, speech, pauses, backchannels, keys, width, "start", "_on").where(F.col("_o").isNotNull() & F.col("_on"))
    take = F.when(F.col("source") == "transcript", valid(F.col("turn") * F.col("interruption"))).otherwise(masked("ambiguous_annotation"))
    return x.select(*keys, F.col("start").alias("time"), F.lit("overlap_onset").alias("source"), take.alias("floor_take"))


def causal_frame(time: Column, start: Column, n: int, frame: float = FRAME) -> Column:
    """The first frame whose middle is not before ``time``, within the window."""
    return F.least(F.greatest(F.ceil((time - start - frame / 2) / frame - 1e-9), F.lit(0)), F.lit(n - 1)).cast("int")


def anchors_of_windows(windows: DataFrame, completions: DataFrame, onsets: DataFrame, keys: Sequence[str], width: float, n: int, frame: float = FRAME) -> DataFrame:
    """(keys, window start, frame, time, source, completion, floor_take): the anchors of each window's frames.

    Windows are (keys, start, end). Anchors that share a frame become one: the earliest time, the
    overlap's source if there is one, and a target that two of them claim is ambiguous.
    """
    kind = completions.schema["completion"].dataType
    every = completions.withColumn("floor_take", F.lit(None).cast(kind)).unionByName(onsets.withColumn("completion", F.lit(None).cast(kind)))
    points = every.select(*keys, F.col("time").alias("start"), F.col("time").alias("end"), "source", "completion", "floor_take")
    met = intervals.overlap_join(windows.select(*keys, "start", "end"), points, keys, width, closed=True)
    x = met.select(*keys, F.col("a.start").alias("window"), F.col("b.start").alias("time"), "b.source", "b.completion", "b.floor_take")
    x = x.withColumn("frame", causal_frame(F.col("time"), F.col("window"), n, frame))
    one = lambda c: F.when(F.count(c) == 0, F.lit(None).cast(kind)).when(F.count(c) == 1, F.max(c)).otherwise(masked("ambiguous_annotation")).alias(c)
    source = F.when(F.max(F.col("source") == "overlap_onset"), "overlap_onset").otherwise(F.min_by("source", F.struct("time", "source")))
    return x.groupBy(*keys, "window", "frame").agg(F.min("time").alias("time"), source.alias("source"), one("completion"), one("floor_take"))


def coverage(frames: DataFrame, keys: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Per ``keys``: supervised frames, and of each target the share of them that is valid and how often each reason masks it."""
    n = F.count_if(F.col("supervised"))
    share = [(F.count_if(F.col("supervised") & F.col(f"{t}.valid")) / F.nullif(n, F.lit(0))).alias(f"{t}_coverage") for t in targets]
    per = frames.groupBy(*keys).agg(n.alias("supervised"), *share)
    long = frames.where("supervised").select(*keys, F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"{t}.reason").alias("r")) for t in targets])).alias("x")).where("x.r is not null")
    why = long.groupBy(*keys, "x.t", "x.r").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("t").alias("target"), F.col("r").alias("reason"), "n"))).alias("masked"))
    return per.join(why, list(keys), "left")
