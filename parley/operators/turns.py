"""Turns and end-of-turn decisions from timed words or spans of two speakers.

A turn is (keys, speaker, start, end, words, text). Every detector here gives the same columns for
the same thing, so detectors can be united and compared.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions.scalar import clamp, smoothstep
from parley.operators import intervals

# Replies that hold no floor.
BACKCHANNEL_TOKENS = ("yeah", "yep", "yup", "yes", "ok", "okay", "right", "sure", "mhm", "mm", "hmm", "huh", "haha", "hah", "laugh", "laughs", "laughter", "chuckle", "chuckles")
BACKCHANNEL_PHRASES = ("uh huh", "uh-huh", "mm hmm", "mm-hmm", "mm hm", "mm-hm", "mhm mhm", "yeah yeah", "yep yep", "ok ok", "okay okay", "ha ha", "haha haha")


LAUGHTER = ("ha", "haha", "hahaha", "hah", "laugh", "laughs", "laughter", "chuckle", "chuckles")


def sessions(words: DataFrame, keys: Sequence[str], gap: float, running_end: bool = True, out: str = "session") -> DataFrame:
    """Number the sessions of ``words``: a new one where a word starts more than ``gap`` after the end of those before.

    ``running_end`` compares with the latest end so far, else with the previous word's own end.
    """
    if running_end:
        return intervals.islands(words, keys, gap=gap, out=out)
    w = Window.partitionBy(*keys).orderBy("start", "end")
    new = F.lag("end").over(w).isNull() | (F.col("start") - F.lag("end").over(w) > gap)
    return words.withColumn("_new", new.cast("int")).withColumn(out, F.sum("_new").over(w)).drop("_new")


def turns(words: DataFrame, keys: Sequence[str], gap: float, running_end: bool = True, text: str | None = None) -> DataFrame:
    """(keys, start, end, n_words, text) of each session."""
    numbered = sessions(words, keys, gap, running_end, "_session")
    agg = [F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_words")]
    if text:
        agg.append(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", text))), lambda x: x[text]), " ").alias("text"))
    return numbered.groupBy(*keys, "_session").agg(*agg).drop("_session")


def internal_pauses(words: DataFrame, keys: Sequence[str], turn_gap: float, pause: float) -> DataFrame:
    """Gaps of at least ``pause`` within one session, from the latest word end so far."""
    numbered = sessions(words, keys, turn_gap, True, "_session")
    w = Window.partitionBy(*keys, "_session").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return numbered.withColumn("_from", F.max("end").over(w)).where(F.col("start") - F.col("_from") >= pause).select(*keys, F.col("_from").alias("start"), F.col("start").alias("end"))


def end_of_turn(spans: DataFrame, keys: Sequence[str], silence: float, analysis_end: Column | None = None, shift: bool = False) -> DataFrame:
    """(keys, at, silence): ends followed by at least ``silence`` up to the next start, or up to ``analysis_end`` for the last.

    Without ``analysis_end`` the last span gives no event. ``shift`` puts the event at the end plus the threshold.
    """
    w = Window.partitionBy(*keys).orderBy("start", "end")
    nxt = F.lead("start").over(w)
    if analysis_end is not None:
        nxt = F.coalesce(nxt, analysis_end)
    quiet = spans.withColumn("_quiet", nxt - F.col("end")).where(F.col("_quiet") >= silence)
    at = F.col("end") + silence if shift else F.col("end")
    return quiet.select(*keys, at.alias("at"), F.col("_quiet").alias("silence"))


def candidate_pauses(spans: DataFrame, keys: Sequence[str], silence: float, duration: Column) -> DataFrame:
    """(keys, start, end, evaluate_at): silences after each span, up to the next one or the recording's end."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    out = spans.select(*keys, F.col("end").alias("start"), F.coalesce(F.lead("start").over(w), duration).alias("end"))
    return out.where(F.col("end") - F.col("start") >= silence).withColumn("evaluate_at", F.col("start") + silence)


def gated(candidates: DataFrame, scores: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Candidates that a model scored at ``threshold`` or more; scores come as a table (keys, evaluate_at, score)."""
    return candidates.join(scores, [*keys, "evaluate_at"]).where(F.col("score") >= threshold)


def normalized_tokens(text: Column) -> Column:
    """Words in lower case, of letters, digits and hyphens only; what is left empty is no word."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9\\s-]", ""), "\\s+"), lambda t: t != "")


def lexical_backchannel(text: Column) -> Column:
    """1 for an acknowledgement, 0.15 for any other one or two words, else 0."""
    tokens = normalized_tokens(text)
    plain = F.array_join(tokens, " ")
    known = F.array(*[F.lit(t) for t in BACKCHANNEL_TOKENS])
    phrase = plain.isin(*BACKCHANNEL_PHRASES)
    return F.when(phrase | ((F.size(tokens) > 0) & F.forall(tokens, lambda t: F.array_contains(known, t))), 1.0).when(F.size(tokens) <= 2, 0.15).otherwise(0.0)


def short_backchannel(text: Column) -> Column:
    """Whether a text is one known acknowledgement, a known phrase, or laughter only."""
    tokens = normalized_tokens(text)
    known, laughs = (F.array(*[F.lit(t) for t in x]) for x in (BACKCHANNEL_TOKENS, LAUGHTER))
    one = (F.size(tokens) == 1) & F.array_contains(known, F.get(tokens, 0))
    return F.coalesce((F.size(tokens) > 0) & (F.array_join(tokens, " ").isin(*BACKCHANNEL_PHRASES) | one | ((F.size(tokens) > 1) & F.forall(tokens, lambda t: F.array_contains(laughs, t)))), F.lit(False))


def word_shortness(n: Column) -> Column:
    # Fixed values.
    return F.when(n <= 2, 1.0).when(n == 3, 0.65).when(n == 4, 0.3).otherwise(0.0)


@dataclass(frozen=True)
class ScoreRules:
    turn: float = 0.5
    merge: float = 0.5
    end_silence: float = 1.5


def segment_hypotheses(own: DataFrame, other: DataFrame, keys: Sequence[str], width: float, unit: float = 1.0) -> DataFrame:
    """Each turn of ``own`` with keep_playing, turn and interruption confidences against the other speaker's turns."""
    pairs = intervals.overlap_join(own, other, keys, width)
    # Times are subtracted before they are divided: quotients of microseconds since 1970 keep some nine digits behind the point.
    apart = lambda x, y: (F.col(x) - F.col(y)) / unit
    size = F.greatest(apart("a.end", "a.start"), F.lit(1e-9))
    share = (F.col("to") - F.col("from")) / unit / size
    held = share * (0.5 + 0.25 * smoothstep(0.0, 0.3, apart("a.start", "b.start")) + 0.25 * smoothstep(0.0, 0.3, apart("b.end", "a.end")))
    inside = (F.col("b.start") <= F.col("a.start")) & (F.col("a.start") < F.col("b.end"))
    onset = F.when(inside, F.least(smoothstep(0.1, 0.4, apart("a.start", "b.start")), smoothstep(0.2, 0.6, apart("b.end", "a.start")))).otherwise(0.0)
    best = pairs.groupBy(*keys, F.col("a.start").alias("start"), F.col("a.end").alias("end")).agg(F.max(held).alias("_held"), F.max(onset).alias("_onset"))
    out = own.join(best, [*keys, "start", "end"], "left").fillna(0.0, ["_held", "_onset"])
    length = (F.col("end") - F.col("start")) / unit
    keep = F.col("_held") * (0.55 * (1 - smoothstep(0.6, 2.0, length)) + 0.30 * word_shortness(F.col("n_words")) + 0.15 * lexical_backchannel(F.col("text")))
    out = out.withColumn("keep_playing", clamp(keep)).withColumn("turn", 1 - F.col("keep_playing"))
    return out.withColumn("interruption", F.col("_onset") * F.col("turn")).drop("_held", "_onset")


def connection_hypotheses(own: DataFrame, other: DataFrame, keys: Sequence[str], width: float, unit: float = 1.0) -> DataFrame:
    """(keys, start, end, merge, pause) of each gap between consecutive turns of one speaker."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    gaps = own.select(*keys, F.col("end").alias("start"), F.lead("start").over(w).alias("end")).where("end is not null")
    real = gaps.where(F.col("end") > F.col("start"))
    met = intervals.overlap_join(real, other, keys, width)
    over = (F.col("to") - F.col("from")) / unit
    partner = 1 - clamp(0.55 * (1 - smoothstep(0.5, 1.5, over)) + 0.30 * word_shortness(F.col("b.n_words")) + 0.15 * lexical_backchannel(F.col("b.text")))
    best = met.groupBy(*keys, F.col("a.start").alias("start"), F.col("a.end").alias("end")).agg(F.max(partner).alias("_partner"))
    gap = F.greatest((F.col("end") - F.col("start")) / unit, F.lit(0.0))
    out = gaps.join(best, [*keys, "start", "end"], "left").fillna(0.0, ["_partner"])
    out = out.withColumn("merge", (1 - smoothstep(1.5, 2.5, gap)) * (1 - F.col("_partner")))
    return out.withColumn("pause", smoothstep(0.08, 0.75, gap) * F.col("merge")).drop("_partner")


def logical_turns(segments: DataFrame, connections: DataFrame, keys: Sequence[str], rules: ScoreRules = ScoreRules()) -> DataFrame:
    """Consecutive turns made one where both are turns and the gap merges; a segment that is no turn breaks the chain."""
    links = connections.select(*keys, F.col("start").alias("_prev_end"), F.col("end").alias("start"), "merge").groupBy(*keys, "_prev_end", "start").agg(F.max("merge").alias("_merge"))
    w = Window.partitionBy(*keys).orderBy("start", "end")
    rows = segments.withColumn("_prev_end", F.lag("end").over(w)).withColumn("_prev_turn", F.lag("turn").over(w)).join(links, [*keys, "_prev_end", "start"], "left")
    joined = (F.col("turn") >= rules.turn) & (F.col("_prev_turn") >= rules.turn) & (F.coalesce("_merge", F.lit(0.0)) >= rules.merge)
    marked = rows.withColumn("_run", F.sum(F.when(joined, 0).otherwise(1)).over(w))
    return marked.where(F.col("turn") >= rules.turn).groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_words").alias("n_words"), F.count("*").alias("n_turns")).drop("_run")


def untranscribed(activity: DataFrame, own: DataFrame, keys: Sequence[str], width: float, pad: float = 0.08, minimum: float = 0.12) -> DataFrame:
    """Activity outside the padded turns, pieces of at least ``minimum``."""
    padded = own.select(*keys, (F.col("start") - pad).alias("start"), (F.col("end") + pad).alias("end"))
    return intervals.subtract(activity, padded, keys, width, minimum)


def context(all_turns: DataFrame, keys: Sequence[str], speaker: str = "speaker") -> DataFrame:
    """Each turn with the previous and next turn of the other speaker, and its neighbours whoever speaks.

    Two speakers, named 1 and 2: the last turn of either so far is carried along, and likewise backwards.
    """
    turn = F.struct("start", "end", "text")
    w = Window.partitionBy(*keys).orderBy("start", "end", speaker)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    of = lambda n, frame, f: f(F.when(F.col(speaker) == n, turn), ignorenulls=True).over(frame)
    prev = F.when(F.col(speaker) == 1, of(2, before, F.last)).otherwise(of(1, before, F.last))
    nxt = F.when(F.col(speaker) == 1, of(2, after, F.first)).otherwise(of(1, after, F.first))
    return all_turns.withColumns({"prev_other": prev, "next_other": nxt, "prev_speaker": F.lag(speaker).over(w), "next_speaker": F.lead(speaker).over(w), "prev_end": F.lag("end").over(w), "next_start": F.lead("start").over(w)})


def contextual(all_turns: DataFrame, keys: Sequence[str], speaker: str = "speaker", unit: float = 1.0) -> DataFrame:
    """Flags of each turn: backchannel (short, answers no question, no own neighbour, other goes on) and interruption."""
    t = context(all_turns, keys, speaker)
    s = lambda c: F.col(c) / unit
    # Limits of the rules, in seconds.
    short = (s("end") - s("start") <= 1.2) & (F.col("n_words") <= 2) & short_backchannel(F.col("text"))
    answers = F.coalesce(F.endswith(F.rtrim(F.col("prev_other.text")), F.lit("?")), F.lit(False))
    own = F.when(F.col("prev_speaker") == F.col(speaker), s("start") - s("prev_end") <= 1.5).otherwise((F.col("next_speaker") == F.col(speaker)) & (s("next_start") - s("end") <= 1.5))
    goes_on = (s("start") - s("prev_other.end") <= 0.5) | (s("next_other.start") - s("end") <= 1.5)
    no = lambda c: F.coalesce(c, F.lit(False))
    cut = no(s("prev_other.end") - s("start") >= 0.1)
    return t.withColumn("backchannel", short & ~answers & ~no(own) & no(goes_on)).withColumn("interruption", cut)


def classified(all_turns: DataFrame, keys: Sequence[str], speaker: str = "speaker", unit: float = 1.0, gap: float = 1.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(speech spans merged over short gaps, back-channels, interruptions) of each speaker, by the contextual rules."""
    x = contextual(all_turns, keys, speaker, unit)
    own = [*keys, speaker]
    speech = x.where(~F.col("backchannel"))
    merged = merge_to_later_end(speech.select(*own, "start", "end"), own, gap * unit)
    return merged, x.where("backchannel").select(*own, "start", "end", "text"), speech.where("interruption").select(*own, F.col("start").alias("time"))


def activity_backchannels(activity: DataFrame, own: DataFrame, keys: Sequence[str], width: float, unit: float = 1.0) -> DataFrame:
    """Short activity of a speaker that none of their turns explains."""
    brief = activity.where(F.col("end") - F.col("start") <= 1.2 * unit)
    return intervals.overlap_join(brief, own.select(*keys, "start", "end"), keys, width, how="left_anti").withColumn("text", F.lit("[activity]"))


def clipped(words: DataFrame, limit: Column) -> DataFrame:
    """Words cut to [0, limit); what is left empty vanishes."""
    return intervals.clip(words, F.lit(0.0), limit)


#: Detectors by name: each takes (spans, keys, scores or None) and gives (keys, at, silence).
DETECTORS: dict[str, object] = {}


def detector(name: str):
    """Registers a detector of ends of turns."""

    def add(f):
        DETECTORS[name] = f
        return f

    return add


@detector("silence")
def _silence(spans: DataFrame, keys: Sequence[str], scores: DataFrame | None = None, silence: float = 1.5) -> DataFrame:
    return end_of_turn(spans, keys, silence)


@detector("delayed_silence")
def _delayed(spans: DataFrame, keys: Sequence[str], scores: DataFrame | None = None, silence: float = 1.5) -> DataFrame:
    return end_of_turn(spans, keys, silence, shift=True)


def run_detectors(names: Sequence[str], spans: DataFrame, keys: Sequence[str], scores: DataFrame | None = None, **options) -> DataFrame:
    """(detector, keys, at, silence) of the named detectors; an unknown name is an error."""
    unknown = [n for n in names if n not in DETECTORS]
    if unknown or not names:
        raise ValueError(f"unknown detectors: {unknown}" if unknown else "no detector is named")
    parts = [DETECTORS[n](spans, keys, scores, **options).select(F.lit(n).alias("detector"), *keys, "at", "silence") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chat_context(all_turns: DataFrame, keys: Sequence[str], n: int, speaker: str = "speaker") -> DataFrame:
    """Each turn with its last ``n`` turns as chat messages: role user for its own speaker, assistant for the other."""
    w = Window.partitionBy(*keys).orderBy("start", "end", speaker).rowsBetween(-(n - 1), 0)
    listed = all_turns.withColumn("_last", F.collect_list(F.struct(speaker, "text")).over(w))
    return listed.withColumn("messages", F.transform("_last", lambda x: F.struct(F.when(x[speaker] == F.col(speaker), "user").otherwise("assistant").alias("role"), x["text"].alias("content")))).drop("_last")


def conversation_annotation(all_turns: DataFrame, durations: DataFrame, keys: Sequence[str], speaker: str = "speaker", unit: float = 1.0) -> DataFrame:
    """Per recording: turns of each speaker, alternations, events per hour, balance and the annotation score."""
    w = Window.partitionBy(*keys).orderBy("start", "end", speaker)
    t = all_turns.withColumn("_alt", (F.lag(speaker).over(w) != F.col(speaker)).cast("int"))
    size = (F.col("end") - F.col("start")) / unit
    agg = t.groupBy(*keys).agg(F.count_if(F.col(speaker) == 1).alias("turns_1"), F.count_if(F.col(speaker) == 2).alias("turns_2"), F.coalesce(F.sum("_alt"), F.lit(0)).alias("alternations"), F.coalesce(F.sum(F.when(F.col(speaker) == 1, size)), F.lit(0.0)).alias("speech_1"), F.coalesce(F.sum(F.when(F.col(speaker) == 2, size)), F.lit(0.0)).alias("speech_2"))
    out = durations.join(agg, list(keys)).withColumn("_d", F.col("duration") / unit)
    total = F.col("speech_1") + F.col("speech_2")
    balance = F.when(total > 0, 1 - F.abs(F.col("speech_1") - F.col("speech_2")) / total).otherwise(0.0)
    out = out.withColumn("events_per_hour", F.when(F.col("_d") > 0, F.col("alternations") * 3600.0 / F.col("_d")).otherwise(0.0)).withColumn("balance", balance)
    score = (clamp(F.when(F.col("_d") > 0, total / F.col("_d") / 0.45).otherwise(0.0)) + clamp(F.col("events_per_hour") / 180.0) + F.col("balance")) / 3
    return out.withColumn("score", score).drop("_d")


def merge_to_later_end(spans: DataFrame, keys: Sequence[str], gap: float) -> DataFrame:
    """Neighbours within ``gap`` made one, which ends where its last span does, even if an earlier one ends later."""
    numbered = sessions(spans, keys, gap, running_end=False, out="_run")
    return numbered.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end")).drop("_run")


def short_response_candidates(connections: DataFrame, responses: DataFrame, keys: Sequence[str], width: float, duration: Column, unit: float = 1.0) -> DataFrame:
    """Ambiguous back-channels: a mergeable gap of the floor holder with a short response of the other speaker in it, and a 10 s clip around."""
    brief = responses.where(((F.col("end") - F.col("start")) / unit <= 2.0) & (F.col("n_words") <= 4))
    met = intervals.overlap_join(connections.where("merge > 0"), brief, keys, width)
    start, end = F.col("b.start"), F.col("b.end")
    clip = F.greatest(F.lit(0.0), F.least((start + end) / 2 - 5 * unit, duration - 10 * unit))
    return met.select(*keys, start.alias("start"), end.alias("end"), F.col("a.merge").alias("merge"), clip.alias("clip_start"), F.least(duration, clip + 10 * unit).alias("clip_end"))
