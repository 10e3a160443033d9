"""What to do about overlapping speech: one pure function of a row of evidence, so it runs on batches and streams alike."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.scalar import nearest_rank

# The vocabulary of the rules, and their limits.
ACKNOWLEDGEMENTS = ("mm hm", "mhm", "uh huh", "okay", "right", "yeah", "yes", "exactly")
LAUGHTER = ("ha", "haha", "hehe", "laugh", "laughter")
QUESTIONS = ("how", "what", "why", "when", "where", "who")
REPAIRS = ("no", "wait", "actually", "stop", "repeat", "again")
REPAIR_PHRASES = ("say that again", "say it again", "hold on", "that's not", "that is not")
CONTINUATIONS = ("and", "but", "though", "however")
DEADLINE_MS = 500
INTERRUPTION = 0.7


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+(?:'[a-z0-9]+)?"), F.lit(0))


def _starts(plain: Column, phrases: tuple[str, ...], whole_words: bool = True) -> Column:
    return F.rlike(plain, F.lit("^(" + "|".join(map(re.escape, phrases)) + ")" + ("( |$)" if whole_words else "")))


def matched_acknowledgement(plain: Column) -> Column:
    """Number of words of the longest acknowledgement that the text begins with, 0 for none."""
    longest = sorted(ACKNOWLEDGEMENTS, key=lambda p: -len(p))
    found = F.regexp_extract(plain, "^(" + "|".join(map(re.escape, longest)) + ")( |$)", 1)
    return F.when(found == "", 0).otherwise(F.size(F.split(found, " ")))


def classify(elapsed_ms: Column, active: Column, transcript: Column, interruption: Column) -> Column:
    """struct kind, reason, confidence, source, fast_path; the first rule that holds decides.

    Kinds are floor_taking, response_required, non_floor_taking, unresolved. Nulls are no evidence.
    An acknowledgement or a laugh says nothing while speech goes on; then time decides.
    """
    words = words_of(F.coalesce(transcript, F.lit("")))
    plain, n = F.array_join(words, " "), F.size(words)
    ack = matched_acknowledgement(plain)
    on, late = F.coalesce(active, F.lit(False)), F.coalesce(elapsed_ms, F.lit(0)) >= DEADLINE_MS
    laugh = plain.isin(*LAUGHTER)

    def out(kind: str, reason: str, confidence, source: str = "lexical", fast: bool = False) -> Column:
        confidence = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
        return F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"), confidence.cast("double").alias("confidence"), F.lit(source).alias("source"), F.lit(fast).alias("fast_path"))

    return (
        F.when(F.coalesce(interruption >= INTERRUPTION, F.lit(False)), out("floor_taking", "predicted_interruption", interruption, "model", True))
        .when(_starts(plain, REPAIRS) | _starts(plain, REPAIR_PHRASES, False), out("response_required", "explicit_stop_or_repair", 0.95, fast=True))
        .when(_starts(plain, QUESTIONS), out("response_required", "question", 0.9, fast=True))
        .when((ack > 0) & (n > ack) & F.get(words, ack).isin(*CONTINUATIONS), out("floor_taking", "acknowledgement_continuation", 0.9, fast=True))
        .when((ack > 0) & (n > ack), out("floor_taking", "meaningful_lexical_material", 0.9, fast=True))
        .when((ack > 0) & ~on, out("non_floor_taking", "closed_acknowledgement", 0.85))
        .when((ack == 0) & laugh & ~on, out("non_floor_taking", "short_laughter", 0.75))
        .when((ack == 0) & ~laugh & (n > 0), out("response_required", "meaningful_lexical_material", 0.8))
        .when(on & late, out("floor_taking", "speech_duration_deadline", 0.9, "activity"))
        .when(~on, out("non_floor_taking", "acoustic_burst_ended", F.when(late, 0.6).otherwise(0.7), "activity"))
        .otherwise(out("unresolved", "awaiting_more_evidence", 0.5, "activity"))
    )




def overlap_metrics(overlaps: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``keys``: overlaps, co-operative and competitive ones, 95th percentiles (nearest rank) of their latencies in ms, samples generated.

    ``overlaps`` has kind, onset, decision, duck, pause, cancel, resume, paused_at (ns, null: did not happen), fast_path, samples.
    """
    ms = lambda a, b: (F.col(b) - F.col(a)) / 1e6
    shared = F.col("kind") == "non_floor_taking"
    resolved = F.col("kind").isNotNull()
    p95 = lambda x, name: nearest_rank(x, 0.95).alias(name)
    return overlaps.groupBy(*keys).agg(
        F.count("*").alias("n_overlaps"),
        F.count_if(shared).alias("n_cooperative"),
        F.count_if(resolved & ~shared).alias("n_competitive"),
        p95(ms("onset", "duck"), "duck_p95_ms"),
        p95(ms("onset", "pause"), "pause_p95_ms"),
        p95(F.when(F.col("fast_path"), ms("onset", "cancel")), "explicit_stop_p95_ms"),
        p95(ms("onset", "resume"), "resume_p95_ms"),
        p95(F.when(shared, ms("onset", "decision")), "cooperative_p95_ms"),
        p95(F.when(resolved & ~shared, ms("onset", "decision")), "competitive_p95_ms"),
        p95(F.when(F.col("resume").isNotNull(), ms("paused_at", "resume")), "buffer_age_p95_ms"),
        F.sum(F.when(resolved, F.col("samples")).otherwise(0)).alias("generated_samples"),
    )


def can_resume(state: Column, paused_at_ms: Column, now_ms: Column) -> Column:
    """Whether playback may go on: while ducking or draining, or paused for 800 ms at most."""
    return F.coalesce(state.isin("ducking", "draining") | ((state == "paused") & (now_ms - paused_at_ms <= 800)), F.lit(False))


def final_invalidation(stable_prefix: Column, prompted: Column, final: Column) -> Column:
    """Why a prepared reply no longer fits the final text; null if it does: the prefix must stand, and the words be the same."""
    return F.when(~F.startswith(final, stable_prefix), "prefix_changed").when(F.array_join(words_of(prompted), " ") != F.array_join(words_of(final), " "), "words_changed")


def revision_invalidation(source: Column, stable_prefix: Column, prompted: Column, new_stable: Column, new_volatile: Column) -> Column:
    """Why a prepared reply no longer fits a revised transcript; null if it does.

    A reply that silence set off needs the whole text as it was; one that the transcript set off only the stable part.
    """
    whole = F.trim(F.concat(new_stable, new_volatile))
    return F.when(source == "activity", F.when(whole != prompted, "transcript_superseded")).otherwise(F.when(~F.startswith(new_stable, stable_prefix), "stable_prefix_revised"))
