"""Queries over speech spans: interval algebra, events, scores of recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import events as ev
from parley.operators import intervals as iv
from parley.plans.registry import BUCKET, SLICE, SPANS, durations, query, spans, table, union_sql

US = 1_000_000.0
K = ["k"]
RULES = ev.EventRules(unit=US)
OUT = 's AS "start", e AS "end"'


@query(f"WITH {SPANS}, {union_sql('u', 'spans', 'k, side')} SELECT k, side, {OUT} FROM u")
def interval_union(spark, d):
    return iv.union(spans(spark, d), ["k", "side"], slice_width=SLICE)


@query(f"WITH {SPANS}, {union_sql('u', 'spans')}, g AS (SELECT k, lag(e) OVER (PARTITION BY k ORDER BY s) AS a, s AS b FROM u) SELECT k, a AS \"start\", b AS \"end\" FROM g WHERE a IS NOT NULL")
def interval_gaps(spark, d):
    return iv.gaps(spans(spark, d), K, slice_width=SLICE)


@query(f"WITH {SPANS}, {union_sql('u', 'spans')} SELECT k, CAST(sum(e - s) AS BIGINT) AS measure FROM u GROUP BY k")
def interval_union_measure(spark, d):
    return iv.measure(spans(spark, d), K, slice_width=SLICE)


PAIRS = "pairs AS (SELECT a.k, a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM spans a JOIN spans b ON a.k = b.k AND a.side = 1 AND b.side = 2 AND a.s < b.e AND b.s < a.e)"


@query(f"WITH {SPANS}, {PAIRS} SELECT k, s1, e1, s2, e2, {OUT} FROM pairs")
def interval_overlap_pairs(spark, d):
    x = spans(spark, d)
    p = iv.overlap_join(x.where("side = 1"), x.where("side = 2"), K, BUCKET)
    return p.select("k", F.col("a.start").alias("s1"), F.col("a.end").alias("e1"), F.col("b.start").alias("s2"), F.col("b.end").alias("e2"), F.col("from").alias("start"), F.col("to").alias("end"))


@query(f"WITH {SPANS}, {PAIRS}, {union_sql('u', 'pairs')} SELECT k, CAST(sum(e - s) AS BIGINT) AS measure FROM u GROUP BY k")
def overlap_measure(spark, d):
    x = spans(spark, d)
    return iv.measure(iv.intersect(x.where("side = 1"), x.where("side = 2"), K, BUCKET), K)


@query(f"""WITH {SPANS}, one AS (SELECT * FROM spans WHERE side = 1), two AS (SELECT * FROM spans WHERE side = 2), {union_sql('a', 'one')}, {union_sql('b', 'two')},
edges AS (SELECT k, s AS pt FROM a UNION SELECT k, e FROM a UNION SELECT k, s FROM b UNION SELECT k, e FROM b),
cells AS (SELECT k, pt AS s, lead(pt) OVER (PARTITION BY k ORDER BY pt) AS e FROM edges),
kept AS (SELECT * FROM cells c WHERE e IS NOT NULL AND EXISTS (SELECT 1 FROM a WHERE a.k = c.k AND a.s <= c.s AND c.e <= a.e) AND NOT EXISTS (SELECT 1 FROM b WHERE b.k = c.k AND b.s <= c.s AND c.e <= b.e)),
{union_sql('u', 'kept')} SELECT k, {OUT} FROM u""")
def interval_subtract(spark, d):
    x = spans(spark, d)
    a = iv.union(x.where("side = 1"), K, slice_width=SLICE)
    return iv.subtract(a, x.where("side = 2"), K, BUCKET)


GAP = 1800 * 1_000_000


@query(f"""WITH {SPANS}, o AS (SELECT k, s, e, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans WHERE side = 1),
f AS (SELECT *, (reach IS NULL OR s > reach + {GAP} OR (s > reach AND EXISTS (SELECT 1 FROM spans b WHERE b.side = 2 AND b.k = o.k AND b.s < o.s AND b.e > o.reach))) AS fresh FROM o),
n AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT k, min(s) AS "start", max(e) AS "end" FROM n GROUP BY k, run""")
def merge_blocked_by_other(spark, d):
    x = spans(spark, d)
    return iv.merge_unless_blocked(x.where("side = 1"), x.where("side = 2"), K, GAP, BUCKET)


@query(f"""WITH {SPANS}, edges AS (SELECT k, s AS pt FROM spans UNION SELECT k, e FROM spans), cells AS (SELECT k, pt AS s, lead(pt) OVER (PARTITION BY k ORDER BY pt) AS e FROM edges),
cover AS (SELECT c.k, c.s, c.e, string_agg(DISTINCT x.side, '+' ORDER BY x.side) AS sides FROM cells c JOIN spans x ON x.k = c.k AND x.s < c.e AND x.e > c.s GROUP BY ALL),
m AS (SELECT *, CASE WHEN lag(e) OVER w = s AND lag(sides) OVER w = sides THEN 0 ELSE 1 END AS fresh FROM cover WINDOW w AS (PARTITION BY k ORDER BY s)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT k, min(s) AS "start", max(e) AS "end", sides FROM n GROUP BY k, run, sides""")
def elementary_reason_segments(spark, d):
    x = iv.elementary(spans(spark, d), K, "side", BUCKET)
    return x.select("k", "start", "end", F.array_join(F.col("labels").cast("array<string>"), "+").alias("sides"))


QUIET = 6 * 3600 * 1_000_000


@query(f"WITH {SPANS}, {union_sql('u', 'spans')}, g AS (SELECT k, lag(e) OVER (PARTITION BY k ORDER BY s) AS a, s AS b FROM u) SELECT k, a AS \"start\", b AS \"end\", 'dual_silence' AS reason FROM g WHERE b - a >= {QUIET}")
def dual_silence(spark, d):
    return ev.dual_silence(spans(spark, d), None, K, QUIET, SLICE)


ALONE, PRESENT = 12 * 3600 * 1_000_000, 600 * 1_000_000


@query(f"""WITH {SPANS}, {union_sql('u', 'spans', 'k, side')}, g AS (SELECT k, side, lag(e) OVER (PARTITION BY k, side ORDER BY s) AS a, s AS b FROM u),
m AS (SELECT g.k, g.side, g.a, g.b, greatest(g.a, x.s) AS s, least(g.b, x.e) AS e FROM g JOIN spans x ON x.k = g.k AND x.side != g.side AND x.s < g.b AND x.e > g.a WHERE g.b - g.a >= {ALONE})
SELECT k, min(s) AS "start", max(e) AS "end", 'one_sided_activity' AS reason FROM m GROUP BY k, side, a, b HAVING sum(e - s) >= {PRESENT}""")
def one_sided_activity(spark, d):
    return ev.one_sided(spans(spark, d), None, K, ALONE, PRESENT, BUCKET)


NEXT = f"WITH {SPANS}, n AS (SELECT *, lead(side) OVER w AS side2, lead(s) OVER w AS s2, lead(e) OVER w AS e2 FROM spans WINDOW w AS (PARTITION BY k ORDER BY s, e, side)), t AS (SELECT * FROM n WHERE s2 IS NOT NULL AND side != side2 AND s2 >= e)"
SLOW = 3 * 3600 * 1_000_000


@query(f"{NEXT} SELECT k, e AS \"start\", s2 AS \"end\", 'slow_turn_exchange' AS reason FROM t WHERE s2 - e >= {SLOW}")
def slow_exchange(spark, d):
    return ev.slow_exchange(spans(spark, d), K, SLOW)


#: Wide limits, as the stand-in's gaps are hours long.
WIDE = ev.EventRules(minimum_turn_gap=0.05, maximum_turn_gap=4 * 3600.0, maximum_response=3600.0, minimum_pause=1800.0, minimum_overlap=60.0, interruption_overlap=120.0, maximum_backchannel=1200.0, minimum_floor=1800.0, unit=US)


@query(f"""{NEXT}, g AS (SELECT *, s2 - e AS gap FROM t WHERE s2 - e BETWEEN 50000 AND 14400000000)
SELECT k, e AS "start", s2 AS "end", 'turn_completion' AS kind, side AS by, side2 AS "to" FROM g UNION ALL SELECT k, e, s2, 'start_response', side2, side FROM g WHERE gap <= 3600000000""")
def turn_transitions(spark, d):
    return ev.transition_events(spans(spark, d), K, WIDE)


@query(f"""WITH {SPANS}, g AS (SELECT k, side, e AS a, lead(s) OVER (PARTITION BY k, side ORDER BY s, e) AS b FROM spans)
SELECT k, side, a AS "start", b AS "end" FROM g WHERE b - a >= 1800000000 AND NOT EXISTS (SELECT 1 FROM spans x WHERE x.k = g.k AND x.side != g.side AND x.s < g.b AND x.e > g.a)""")
def pauses_without_other(spark, d):
    return ev.pauses(spans(spark, d), K, BUCKET, WIDE)


KINDS = f"""over AS (SELECT *, CASE WHEN e1 - s1 <= 1200000000 AND e2 - s2 >= 1800000000 AND s1 >= s2 AND e1 <= e2 THEN 'backchannel:1'
WHEN e2 - s2 <= 1200000000 AND e1 - s1 >= 1800000000 AND s2 >= s1 AND e2 <= e1 THEN 'backchannel:2'
WHEN e - s >= 120000000 AND s1 > s2 AND s1 < e2 THEN 'interruption:1' WHEN e - s >= 120000000 AND s2 > s1 AND s2 < e1 THEN 'interruption:2' ELSE 'overlap:1' END AS c FROM pairs WHERE e - s >= 60000000)"""


@query(f"WITH {SPANS}, {PAIRS}, {KINDS} SELECT k, s1 AS start_1, e1 AS end_1, s2 AS start_2, e2 AS end_2, {OUT}, split_part(c, ':', 1) AS kind, CAST(split_part(c, ':', 2) AS INTEGER) AS by FROM over")
def overlap_classification(spark, d):
    x = spans(spark, d)
    return ev.overlaps(x.where("side = 1"), x.where("side = 2"), K, BUCKET, WIDE)


EVENTS = f"""{NEXT}, g AS (SELECT *, s2 - e AS gap FROM t WHERE s2 - e BETWEEN 50000 AND 14400000000), {PAIRS}, {KINDS},
p AS (SELECT k, side, e AS a, lead(s) OVER (PARTITION BY k, side ORDER BY s, e) AS b FROM spans),
events_all AS (SELECT k, 'turn_completion' AS kind, side AS by FROM g UNION ALL SELECT k, 'start_response', side2 FROM g WHERE gap <= 3600000000
UNION ALL SELECT k, 'pause', side FROM p WHERE b - a >= 1800000000 AND NOT EXISTS (SELECT 1 FROM spans x WHERE x.k = p.k AND x.side != p.side AND x.s < p.b AND x.e > p.a)
UNION ALL SELECT k, split_part(c, ':', 1), CAST(split_part(c, ':', 2) AS INTEGER) FROM over)"""


def _clamp(x: str) -> str:
    return f"least(greatest({x}, 0.0::DOUBLE), 1.0::DOUBLE)"


def _above(x: str, a: float, b: float) -> str:
    return f"(CASE WHEN {x} <= {a}::DOUBLE THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - {_clamp(f'({x} - {a}::DOUBLE) / {b - a!r}::DOUBLE')} END)"


def _between(x: str, a: float, b: float) -> str:
    return _clamp(f"({x} - {a}::DOUBLE) / {b - a!r}::DOUBLE")


DENSITY = f"""{EVENTS}, {union_sql('u', 'spans')}, {union_sql('o', 'pairs')}, len AS (SELECT k, max(e) - min(s) AS duration FROM spans GROUP BY k),
su AS (SELECT k, CAST(sum(e - s) AS BIGINT) AS speech FROM u GROUP BY k), so AS (SELECT k, CAST(sum(e - s) AS BIGINT) AS overlap FROM o GROUP BY k),
ne AS (SELECT k, count(*) FILTER (kind = 'turn_completion') AS n_turns, count(*) FILTER (kind != 'overlap') AS n_events FROM events_all GROUP BY k),
base AS (SELECT len.k, duration, coalesce(speech, 0) AS speech, coalesce(overlap, 0) AS overlap, coalesce(n_turns, 0) AS n_turns, coalesce(n_events, 0) AS n_events FROM len LEFT JOIN su USING (k) LEFT JOIN so USING (k) LEFT JOIN ne USING (k)),
r AS (SELECT *, {_clamp('speech::DOUBLE / duration')} AS speech_ratio, {_clamp('overlap::DOUBLE / duration')} AS overlap_ratio, n_turns * 3600.0::DOUBLE / (duration / 1000000.0::DOUBLE) AS turns_per_hour, n_events * 3600.0::DOUBLE / (duration / 1000000.0::DOUBLE) AS windows_per_hour FROM base),
density AS (SELECT *, 1.0::DOUBLE - speech_ratio AS silence_ratio, ({_between('speech_ratio', 0.12, 0.45)} + {_between('turns_per_hour', 0.0, 120.0)} + {_between('windows_per_hour', 0.0, 180.0)} + {_above('overlap_ratio', 0.18, 0.36)}) / 4 AS density_score FROM r)"""


def _density(spark, d):
    x = spans(spark, d)
    length = durations(spark, d).select("k", (F.col("high") - F.col("low")).alias("duration"))
    return ev.density(x, ev.event_candidates(x, K, BUCKET, WIDE), length, K, BUCKET, US, SLICE)


@query(f"{DENSITY} SELECT k, duration, speech, overlap, n_turns, n_events, round(speech_ratio, 9) AS speech_ratio, round(overlap_ratio, 9) AS overlap_ratio, round(silence_ratio, 9) AS silence_ratio, round(turns_per_hour, 6) AS turns_per_hour, round(windows_per_hour, 6) AS windows_per_hour, round(density_score, 9) AS density_score FROM density")
def density_metrics(spark, d):
    x = _density(spark, d)
    nine = [F.round(c, 9).alias(c) for c in ("speech_ratio", "overlap_ratio", "silence_ratio", "density_score")]
    six = [F.round(c, 6).alias(c) for c in ("turns_per_hour", "windows_per_hour")]
    return x.select("k", "duration", "speech", "overlap", "n_turns", "n_events", *nine, *six)


TIMING = f"""{EVENTS}, per AS (SELECT k, median((e - s) / 1000000.0::DOUBLE) AS median_span, avg(CASE WHEN (e - s) / 1000000.0::DOUBLE < 0.2 THEN 1.0 ELSE 0.0 END) AS tiny_ratio, avg(CASE WHEN (e - s) / 1000000.0::DOUBLE > 30.0 THEN 1.0 ELSE 0.0 END) AS long_ratio FROM spans GROUP BY k),
n1 AS (SELECT k, count(*) FILTER ("by" = 1) AS n_1, count(*) FILTER ("by" = 2) AS n_2 FROM events_all GROUP BY k),
timing AS (SELECT per.*, coalesce(n_1, 0) AS n_1, coalesce(n_2, 0) AS n_2, CASE WHEN coalesce(n_1, 0) + coalesce(n_2, 0) > 0 THEN 1.0::DOUBLE - abs(n_1 - n_2)::DOUBLE / (n_1 + n_2) ELSE 0.0 END AS balance FROM per LEFT JOIN n1 USING (k))"""


@query(f"{TIMING} SELECT k, median_span, round(tiny_ratio, 9) AS tiny_ratio, round(long_ratio, 9) AS long_ratio, n_1, n_2, round(balance, 9) AS balance, round((({_between('median_span', 0.25, 1.20)} + {_above('tiny_ratio', 0.15, 0.50)} + {_above('long_ratio', 0.02, 0.15)}) / 3 + balance) / 2, 9) AS timing_score FROM timing")
def timing_metrics(spark, d):
    x = spans(spark, d)
    t = ev.timing(x, ev.event_candidates(x, K, BUCKET, WIDE), K, US)
    return t.select("k", "median_span", "n_1", "n_2", *[F.round(c, 9).alias(c) for c in ("tiny_ratio", "long_ratio", "balance", "timing_score")])


SCORED = f"""{DENSITY}, {TIMING.removeprefix(EVENTS + ', ')}, both_scores AS (SELECT density.*, (({_between('median_span', 0.25, 1.20)} + {_above('tiny_ratio', 0.15, 0.50)} + {_above('long_ratio', 0.02, 0.15)}) / 3 + balance) / 2 AS timing_score, k % 3 = 0 AS low_1, k % 2 = 0 AS low_2, k % 11 = 0 AS quiet, CASE WHEN k % 7 > 0 THEN (k % 100) / 100.0::DOUBLE END AS env, k % 13 = 0 AS leak, (k % 5) / 100.0::DOUBLE AS gap, k % 17 AS annotated FROM density JOIN timing USING (k))"""


@query(f"""{SCORED} SELECT k, concat_ws(',', CASE WHEN annotated = 0 AND (speech_ratio < 0.08 OR windows_per_hour < 25) THEN 'empty_or_no_interaction' END, CASE WHEN low_1 AND low_2 THEN 'both_tracks_low_information' END, CASE WHEN quiet THEN 'very_low_rms' END,
CASE WHEN env >= 0.75 THEN 'shared_energy_reverb_or_bleed' END, CASE WHEN leak THEN 'inactive_track_leakage' END, CASE WHEN overlap_ratio >= 0.45 THEN 'severe_overlap' WHEN overlap_ratio >= 0.30 THEN 'high_overlap' WHEN overlap_ratio >= 0.18 AND speech_ratio >= 0.70 THEN 'dense_overlap' END,
CASE WHEN gap > 0.01 AND speech_ratio < 0.35 THEN 'low_interaction_duration_mismatch' END, CASE WHEN annotated = 0 AND timing_score < 0.35 THEN 'poor_timing_plausibility' END) AS flags FROM both_scores""")
def quality_flags(spark, d):
    """Audio figures, which the stand-in lacks, are made from the key."""
    x = spans(spark, d)
    timing = ev.timing(x, ev.event_candidates(x, K, BUCKET, WIDE), K, US).select("k", "timing_score")
    k, c = F.col("k"), F.col
    audio = {"low_information_1": k % 3 == 0, "low_information_2": k % 2 == 0, "very_low_rms": k % 11 == 0, "envelope_correlation": F.when(k % 7 > 0, (k % 100) / F.lit(100.0)), "leakage": k % 13 == 0, "gap_ratio": (k % 5) / F.lit(100.0), "annotated_events": k % 17}
    scores = {n: c(n) for n in ("speech_ratio", "overlap_ratio", "windows_per_hour", "timing_score")} | audio
    return _density(spark, d).join(timing, "k").select("k", F.array_join(ev.quality_flags(scores), ",").alias("flags"))


@query(f"""WITH {SPANS}, a AS (SELECT k, e AS pt, s FROM spans WHERE side = 1), b AS (SELECT k, s AS pt FROM spans WHERE side = 2)
SELECT a.k, a.s AS "start", a.pt AS "end", (SELECT min(b.pt) FROM b WHERE b.k = a.k AND b.pt >= a.pt AND b.pt - a.pt <= 7200000000) AS response FROM a""")
def asof_next_response(spark, d):
    x = spans(spark, d)
    out = iv.asof(x.where("side = 1"), x.where("side = 2").select("k", F.col("start").alias("answer")), K, "end", "answer", forward=True, tolerance=7200 * 1_000_000)
    return out.select("k", "start", "end", F.col("match.answer").alias("response"))


@query(f"""WITH {SPANS}, a AS (SELECT k, e, s FROM spans WHERE side = 1), b AS (SELECT k, s AS at FROM spans WHERE side = 2)
SELECT a.k, a.s AS "start", a.e AS "end", (SELECT max(b.at) FROM b WHERE b.k = a.k AND b.at <= a.s) AS previous FROM a""")
def asof_prev_other(spark, d):
    x = spans(spark, d)
    out = iv.asof(x.where("side = 1"), x.where("side = 2").select("k", F.col("start").alias("before")), K, "start", "before", forward=False)
    return out.select("k", "start", "end", F.col("match.before").alias("previous"))


@query(f"""WITH {SPANS}, p AS (SELECT event_id, user_id AS k, epoch_us(ts) AS pt FROM events WHERE event_type = 'click'), one AS (SELECT * FROM spans WHERE side = 2), {union_sql('u', 'one')}
SELECT event_id, p.k, pt AS "at", EXISTS (SELECT 1 FROM u WHERE u.k = p.k AND u.s <= pt AND pt < u.e) AS inside FROM p""")
def point_containment(spark, d):
    p = table(spark, d, "events").where("event_type = 'click'").select("event_id", F.col("user_id").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return iv.contains(p, spans(spark, d).where("side = 2"), K, BUCKET)


@query(f"""WITH {SPANS}, w AS (SELECT k, min(s) AS a, max(e) AS b FROM spans GROUP BY k), g AS (SELECT k, unnest(range(a, b, 86400000000)) AS s, b FROM w), g2 AS (SELECT k, s, s + 86400000000 AS e FROM g),
{union_sql('u', 'spans')}
SELECT g2.k, g2.s AS "start", g2.e AS "end", CAST(coalesce(sum(CASE WHEN u.s IS NOT NULL THEN least(g2.e, u.e) - greatest(g2.s, u.s) END), 0) AS BIGINT) AS covered FROM g2 LEFT JOIN u ON u.k = g2.k AND u.s < g2.e AND u.e > g2.s GROUP BY ALL""")
def active_fraction_windows(spark, d):
    day = 86_400_000_000
    w = durations(spark, d).select("k", F.explode(F.expr(f"sequence(low, high - 1, {day}L)")).alias("start")).withColumn("end", F.col("start") + day)
    return iv.covered_seconds(w, spans(spark, d), K, BUCKET)
