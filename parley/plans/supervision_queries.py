"""Queries of training targets: user segments are side 1, the assistant's side 2, moments are events."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import frames as fr
from parley.operators import supervision as sv
from parley.plans.registry import BUCKET, query, spans, table
from parley.plans.turn_queries import CONNECT, UNIT, _connections, _segments

K = ["k"]
S = int(UNIT)


def _source(c: str = "start"):
    return F.when(F.floor(F.col(c) / 1_000_000) % 5 == 0, "audio").otherwise("transcript")


def _user(spark, d):
    return _segments(spark, d).withColumn("source", _source())


def _assistant(spark, d):
    x = spans(spark, d).where("side = 2").drop("side")
    turn = F.when(F.col("end") - F.col("start") >= 240_000_000, 0.9).otherwise(0.5)
    return x.withColumn("turn", turn).withColumn("keep_playing", 1 - turn).withColumn("source", F.lit("transcript"))


def _brief(spark, d, side: int):
    return spans(spark, d).where(f"side = {side} and end - start < 120000000").drop("side")


def _frames(spark, d):
    e = table(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select("event_id", F.col("user_id").alias("k"), at.alias("time"), (F.col("event_id") % 7 > 0).alias("supervised")).join(_limits(spark, d), "k")


def _limits(spark, d):
    return spans(spark, d).groupBy("k").agg((F.max("end") - 300_000_000).alias("limit"))


def _told(x, name: str):
    return x.select("event_id", F.round(f"{name}.target", 6).alias("target"), F.col(f"{name}.reason").alias("reason"))


BASE = f"""{CONNECT}, usr AS (SELECT k, s, e, onset, keep_playing, 1 - keep_playing AS turn, CASE WHEN (s // 1000000) % 5 = 0 THEN 'audio' ELSE 'transcript' END AS source FROM seg), said AS (SELECT * FROM usr WHERE source = 'transcript'),
ast AS (SELECT k, s, e, CASE WHEN e - s >= 240000000 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS turn FROM spans WHERE side = 2), brief1 AS (SELECT k, s, e FROM spans WHERE side = 1 AND e - s < 120000000), brief2 AS (SELECT k, s, e FROM spans WHERE side = 2 AND e - s < 120000000),
lim AS (SELECT k, max(e) - 300000000 AS lim FROM spans GROUP BY k), f AS (SELECT event_id, user_id AS k, epoch_us(ts) AS t, event_id % 7 > 0 AS sup, lim FROM events JOIN lim ON k = user_id),
step AS (SELECT merge, step * merge AS pause, k, a, b FROM con),
linked AS (SELECT c.k, a, b, merge, pause, merge * (1 - 0.5::DOUBLE * pause) * least((SELECT arg_min(turn, s) FROM said WHERE said.k = c.k AND abs(said.e - a) <= 48000000), (SELECT arg_min(turn, s) FROM said WHERE said.k = c.k AND abs(said.s - b) <= 48000000)) AS v,
EXISTS (SELECT 1 FROM said WHERE said.k = c.k AND abs(said.e - a) <= 48000000) AND EXISTS (SELECT 1 FROM said WHERE said.k = c.k AND abs(said.s - b) <= 48000000) AS ok FROM step c)"""


def _floor(name: str, at: str, source: str = "f") -> str:
    return f"""{name}_s AS (SELECT event_id, arg_min(turn, s) AS turn FROM {source} f JOIN said ON said.k = f.k AND s <= {at} AND {at} < e GROUP BY 1),
{name}_c AS (SELECT event_id, arg_min({{'v': v, 'ok': ok}}, a) AS c FROM {source} f JOIN linked l ON l.k = f.k AND a <= {at} AND {at} < b GROUP BY 1),
{name}_a AS (SELECT DISTINCT event_id FROM {source} f JOIN usr ON usr.k = f.k AND source = 'audio' AND s <= {at} AND {at} < e),
{name} AS (SELECT f.*, CASE WHEN s.event_id IS NOT NULL THEN s.turn WHEN c.event_id IS NOT NULL THEN CASE WHEN c.c.ok THEN c.c.v END WHEN a.event_id IS NOT NULL THEN NULL ELSE 0.0 END AS target, CASE WHEN s.event_id IS NOT NULL THEN NULL WHEN c.event_id IS NOT NULL THEN CASE WHEN NOT c.c.ok THEN 'ambiguous_annotation' END WHEN a.event_id IS NOT NULL THEN 'ambiguous_annotation' END AS reason FROM {source} f LEFT JOIN {name}_s s USING (event_id) LEFT JOIN {name}_c c USING (event_id) LEFT JOIN {name}_a a USING (event_id))"""


@query(f"WITH {BASE}, {_floor('g', 'f.t')} SELECT event_id, round(target, 6) AS target, reason FROM g")
def floor_supervision(spark, d):
    return _told(sv.floor(_frames(spark, d), _user(spark, d), _connections(spark, d), K, BUCKET, S), "floor")


@query(f"""WITH {BASE}, {_floor('g', 'f.t + 300000000')}, near AS (SELECT DISTINCT event_id FROM f JOIN said ON said.k = f.k AND turn >= 0.1 AND e - s >= 60000000 AND abs(f.t - e) <= 300000000)
SELECT event_id, CASE WHEN sup AND near.event_id IS NOT NULL AND t + 300000000 <= lim THEN round(1 - target, 6) END AS target, CASE WHEN NOT sup THEN 'burn_in' WHEN near.event_id IS NULL THEN 'outside_user_yield_context' WHEN t + 300000000 > lim THEN 'future_horizon_censored' ELSE reason END AS reason FROM g LEFT JOIN near USING (event_id)""")
def user_yield_supervision(spark, d):
    return _told(sv.user_yield(_frames(spark, d), _user(spark, d), _connections(spark, d), K, BUCKET, S), "user_yield")


@query(f"""WITH {BASE}, {_floor('g', 'f.t')}, inside AS (SELECT DISTINCT event_id FROM f JOIN brief1 b ON b.k = f.k AND s <= t AND t < e)
SELECT event_id, round(coalesce(CASE WHEN i.event_id IS NOT NULL THEN CASE WHEN c.c.ok THEN c.c.v END ELSE target END, 0.0), 6) AS floor_input FROM g LEFT JOIN inside i USING (event_id) LEFT JOIN g_c c USING (event_id)""")
def floor_input(spark, d):
    x = sv.floor_input(_frames(spark, d), _user(spark, d), _connections(spark, d), _brief(spark, d, 1), K, BUCKET, S)
    return x.select("event_id", F.round("floor_input", 6).alias("floor_input"))


@query(f"""WITH {BASE}, lk AS (SELECT c.k, a, b, merge * (1 - 0.5::DOUBLE * pause) * least((SELECT arg_min(turn, s) FROM usr WHERE usr.k = c.k AND abs(usr.e - a) <= 48000000), (SELECT arg_min(turn, s) FROM usr WHERE usr.k = c.k AND abs(usr.s - b) <= 48000000)) AS v FROM step c),
x AS (SELECT event_id, arg_min(turn, s) AS turn FROM f JOIN usr ON usr.k = f.k AND s <= t AND t < e GROUP BY 1), y AS (SELECT event_id, arg_min(v, a) AS v FROM f JOIN lk ON lk.k = f.k AND a <= t AND t < b GROUP BY 1), z AS (SELECT DISTINCT event_id FROM f JOIN ast ON ast.k = f.k AND s <= t AND t < e)
SELECT event_id, round(coalesce(x.turn, y.v, CASE WHEN z.event_id IS NOT NULL THEN -1.0 END, 0.0), 6) AS floor FROM f LEFT JOIN x USING (event_id) LEFT JOIN y USING (event_id) LEFT JOIN z USING (event_id)""")
def frame_floor_state(spark, d):
    x = fr.floor_state(_frames(spark, d), _segments(spark, d), _connections(spark, d), spans(spark, d).where("side = 2"), K, BUCKET, int(0.08 * UNIT))
    return x.select("event_id", F.round("floor", 6).alias("floor"))


CONFIDENCE = """sure AS (SELECT b.k, b.s, b.e, (SELECT arg_max(keep_playing, least(said.e, b.e) - greatest(said.s, b.s)) FROM said WHERE said.k = b.k AND said.s < b.e AND said.e > b.s) AS confidence FROM (SELECT DISTINCT * FROM brief1) b)"""


@query(f"WITH {BASE}, {CONFIDENCE} SELECT k, s AS \"start\", e AS \"end\", round(confidence, 6) AS confidence FROM sure")
def backchannel_confidence(spark, d):
    x = sv.backchannel_confidence(_brief(spark, d, 1).distinct(), _user(spark, d), K, BUCKET)
    return x.select("k", "start", "end", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {BASE}, {CONFIDENCE}, h AS (SELECT event_id, max(confidence) AS most, bool_or(confidence IS NULL) AS unsure FROM f JOIN sure ON sure.k = f.k AND s BETWEEN t AND t + 120000000 GROUP BY 1)
SELECT event_id, CASE WHEN sup AND t + 120000000 <= lim AND NOT coalesce(unsure, false) THEN round(coalesce(most, 0.0), 6) END AS target, CASE WHEN NOT sup THEN 'burn_in' WHEN t + 120000000 > lim THEN 'future_horizon_censored' WHEN unsure THEN 'ambiguous_annotation' END AS reason FROM f LEFT JOIN h USING (event_id)""")
def backchannel_supervision(spark, d):
    return _told(sv.upcoming_backchannel(_frames(spark, d), _brief(spark, d, 1), _user(spark, d), K, BUCKET, S), "backchannel")


@query(f"WITH {BASE}, c AS (SELECT event_id, arg_min(pause * merge, a) AS v FROM f JOIN step ON step.k = f.k AND a <= t AND t < b GROUP BY 1) SELECT event_id, round(v, 6) AS target, CASE WHEN c.event_id IS NULL THEN 'no_auxiliary_annotation' END AS reason FROM f LEFT JOIN c USING (event_id)")
def continuation_pause_supervision(spark, d):
    return _told(sv.continuation_pause(_frames(spark, d), _connections(spark, d), K, BUCKET), "continuation_pause")


@query(f"""WITH {BASE}, {CONFIDENCE}, c AS (SELECT event_id, first(confidence ORDER BY s, e) AS v FROM f JOIN sure ON sure.k = f.k AND s <= t AND t < e GROUP BY 1)
SELECT event_id, round(v, 6) AS target, CASE WHEN c.event_id IS NULL THEN 'no_auxiliary_annotation' WHEN v IS NULL THEN 'ambiguous_annotation' END AS reason FROM f LEFT JOIN c USING (event_id)""")
def feedback_supervision(spark, d):
    return _told(sv.feedback(_frames(spark, d), _brief(spark, d, 1), _user(spark, d), K, BUCKET), "non_floor_feedback")


NEXT = """nx AS (SELECT u.*, lim, (SELECT min(x.s) FROM usr x WHERE x.k = u.k AND x.s >= u.e) AS nu, (SELECT min(x.s) FROM ast x WHERE x.k = u.k AND x.s >= u.e) AS na, (SELECT arg_min({'merge': merge}, a) FROM step c WHERE c.k = u.k AND abs(c.a - u.e) <= 48000000) AS c FROM usr u JOIN lim USING (k))"""
BOUNDARIES = f"""{NEXT}, bd AS (SELECT k, e AS "offset", greatest(e + 48000000, least(lim, e + 1200000000, coalesce(least(nu, na), lim))) AS until, CASE WHEN c IS NOT NULL THEN 'connection' WHEN na IS NOT NULL OR e + 1200000000 <= lim THEN 'segment_end' ELSE 'censored' END AS source FROM nx)"""


def _boundaries(spark, d):
    return sv.decision_boundaries(_user(spark, d), _assistant(spark, d), _connections(spark, d), _limits(spark, d), K, BUCKET, S)


@query(f"WITH {BASE}, {BOUNDARIES} SELECT * FROM bd")
def decision_boundaries(spark, d):
    return _boundaries(spark, d)


@query(f"""WITH {BASE}, {BOUNDARIES}, h AS (SELECT event_id, max("offset") AS o FROM f JOIN bd ON bd.k = f.k AND "offset" <= t AND t < until GROUP BY 1) SELECT event_id, o AS boundary FROM f LEFT JOIN h USING (event_id)""")
def active_boundary(spark, d):
    return sv.active_boundary(_frames(spark, d), _boundaries(spark, d), K, BUCKET).select("event_id", F.col("boundary.offset").alias("boundary"))


ANCHORS = f"""{NEXT}, pts AS (SELECT user_id AS k, epoch_us(ts) AS pt, CASE WHEN event_id % 3 > 0 THEN (event_id % 10) / 10.0 END AS confidence FROM events WHERE event_type = 'click'),
an0 AS (SELECT nx.*, EXISTS (SELECT 1 FROM pts WHERE pts.k = nx.k AND coalesce(confidence >= 0.8, true) AND abs(pt - nx.e) <= 48000000) AS point FROM nx),
an1 AS (SELECT *, point OR (na IS NOT NULL AND (nu IS NULL OR na < nu)) OR (lim >= e + 900000000 AND (nu IS NULL OR nu >= e + 900000000)) AS done, nu IS NULL AND na IS NULL AND lim < e + 900000000 AS early FROM an0),
an AS (SELECT k, e AS "time", CASE WHEN c IS NOT NULL THEN 'connection' WHEN source = 'transcript' AND NOT done AND early THEN 'censored' ELSE 'segment_end' END AS source, CASE WHEN source = 'transcript' THEN CASE WHEN c IS NOT NULL THEN turn * (1 - c.merge) WHEN done THEN turn END END AS target,
CASE WHEN source != 'transcript' THEN 'ambiguous_annotation' WHEN c IS NOT NULL OR done THEN NULL WHEN early THEN 'censored_annotation' ELSE 'ambiguous_annotation' END AS reason FROM an1),
onset AS (SELECT u.k, u.s AS "time", CASE WHEN source = 'transcript' THEN turn * onset * turn END AS target, CASE WHEN source != 'transcript' THEN 'ambiguous_annotation' END AS reason FROM usr u WHERE EXISTS (SELECT 1 FROM ast a WHERE a.k = u.k AND a.turn >= 0.8 AND a.s <= u.s AND u.s < a.e) AND EXISTS (SELECT 1 FROM ast a WHERE a.k = u.k AND a.s <= u.s AND u.s < a.e) AND (NOT EXISTS (SELECT 1 FROM ast a WHERE a.k = u.k AND a.s + (a.e - a.s) // 3 <= u.s AND u.s < a.s + 2 * (a.e - a.s) // 3) OR EXISTS (SELECT 1 FROM brief2 b WHERE b.k = u.k AND b.s <= u.s AND u.s < b.e)))"""


def _completions(spark, d):
    points = table(spark, d, "events").where("event_type = 'click'").select(F.col("user_id").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 10) / F.lit(10.0)).alias("confidence"))
    return sv.completion_anchors(_user(spark, d), _assistant(spark, d), _connections(spark, d), points, _limits(spark, d), K, BUCKET, S)


def _onsets(spark, d):
    """The assistant pauses in the middle third of each of its turns."""
    a = _assistant(spark, d)
    third = F.col("end") - F.col("start")
    pauses = a.select("k", (F.col("start") + F.floor(third / 3)).alias("start"), (F.col("start") + F.floor(2 * third / 3)).alias("end"))
    return sv.overlap_anchors(_user(spark, d), a, a, pauses, _brief(spark, d, 2), K, BUCKET)


@query(f'WITH {BASE}, {ANCHORS} SELECT k, "time", source, round(target, 6) AS target, reason FROM an')
def completion_anchors(spark, d):
    return _completions(spark, d).select("k", "time", "source", F.round("completion.target", 6).alias("target"), F.col("completion.reason").alias("reason"))


@query(f'WITH {BASE}, {ANCHORS} SELECT k, "time", round(target, 6) AS target, reason FROM onset')
def overlap_anchors(spark, d):
    return _onsets(spark, d).select("k", "time", F.round("floor_take.target", 6).alias("target"), F.col("floor_take.reason").alias("reason"))


@query(f"""WITH {BASE}, {ANCHORS}, w AS (SELECT DISTINCT k, d * 86400000000 AS a FROM (SELECT k, unnest(range(min(s) // 86400000000, max(e) // 86400000000 + 1)) AS d FROM spans GROUP BY k)),
p AS (SELECT k, "time", source, {{'t': target, 'r': reason}} AS c, NULL AS o FROM an UNION ALL SELECT k, "time", 'overlap_onset', NULL, {{'t': target, 'r': reason}} FROM onset),
m AS (SELECT w.k, w.a, p."time", source, c, o, least(greatest(CAST(ceil((p."time" - w.a - 432000000 / 2) / 432000000 - 1e-9) AS BIGINT), 0), 199) AS frame FROM w JOIN p ON p.k = w.k AND p."time" BETWEEN w.a AND w.a + 86400000000)
SELECT k, a AS "window", CAST(frame AS INTEGER) AS frame, min("time") AS "time", CASE WHEN count(c) = 1 THEN round(max(c.t), 6) END AS completion, CASE WHEN count(c) = 1 THEN max(c.r) WHEN count(c) > 1 THEN 'ambiguous_annotation' END AS completion_reason, CASE WHEN count(o) = 1 THEN round(max(o.t), 6) END AS floor_take, bool_or(source = 'overlap_onset') AS onset FROM m GROUP BY k, a, frame""")
def anchors_of_windows(spark, d):
    day = 86_400_000_000
    w = spans(spark, d).groupBy("k").agg(F.floor(F.min("start") / day).alias("a"), F.floor(F.max("end") / day).alias("b")).select("k", F.explode(F.sequence("a", "b")).alias("n")).select("k", (F.col("n") * day).alias("start")).withColumn("end", F.col("start") + day)
    x = sv.anchors_of_windows(w, _completions(spark, d), _onsets(spark, d), K, BUCKET, 200, 432_000_000)
    return x.select("k", "window", "frame", "time", F.round("completion.target", 6).alias("completion"), F.col("completion.reason").alias("completion_reason"), F.round("floor_take.target", 6).alias("floor_take"), (F.col("source") == "overlap_onset").alias("onset"))


@query(f"""WITH {BASE}, {_floor('g', 'f.t')} SELECT k, count(*) FILTER (sup) AS supervised, round(count(*) FILTER (sup AND reason IS NULL) / nullif(count(*) FILTER (sup), 0)::DOUBLE, 6) AS floor_coverage, count(*) FILTER (sup AND reason = 'ambiguous_annotation') AS ambiguous FROM g GROUP BY k""")
def supervision_coverage(spark, d):
    x = sv.floor(_frames(spark, d), _user(spark, d), _connections(spark, d), K, BUCKET, S)
    one = F.aggregate(F.coalesce("masked", F.array().cast("array<struct<target:string,reason:string,n:bigint>>")), F.lit(0).cast("bigint"), lambda a, m: a + m["n"])
    return sv.coverage(x, K, ["floor"]).select("k", "supervised", F.round("floor_coverage", 6).alias("floor_coverage"), one.alias("ambiguous"))
