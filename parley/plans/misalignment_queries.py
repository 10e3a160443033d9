"""Queries of the misalignment review: clips, repairs, assessments, what to judge next.

Stand-in: each user is a recording; thirty days of events become ten minutes of speech.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import misalignment as mi
from parley.plans.registry import query, table, union_sql

K = ["k"]
FROM = 1_704_067_200_000_000
SLICE = 60.0


def _speech(spark, d):
    ms = F.expr(f"(unix_micros(cast(ts as timestamp)) - {FROM}) div 8640000 * 2")
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("k"), ms.alias("ms"))
    return e.select("event_id", "k", (F.col("event_id") % 2 + 1).cast("int").alias("side"), (F.col("ms") / 1000.0).alias("start"), ((F.col("ms") + F.col("event_id") * 38 % 4000 + 200) / 1000.0).alias("end"))


def _recordings(spark, d):
    return _speech(spark, d).groupBy("k").agg(F.max("end").alias("duration")).withColumn("mismatch", F.when(F.col("k") % 4 > 0, F.col("k") % 4 * 1.25))


def _windows(spark, d):
    c = F.col
    shift = F.when((c("k") % 3 == 1) & (c("start") >= 280), 4.0).when(c("k") % 3 == 2, 1.5).otherwise(0.0) + c("event_id") * 7 % 16 / 64.0 + F.when(c("event_id") % 61 == 0, 5.0).otherwise(0.0)
    return _speech(spark, d).select("k", "start", (c("start") + 60).alias("end"), shift.alias("shift"), (0.5 + c("event_id") % 8 / 16.0).alias("confidence"), (c("event_id") % 5 + 1).cast("int").alias("persistence"), (c("event_id") % 3).cast("int").alias("sources"), (c("event_id") % 10 > 0).alias("accepted"), (c("event_id") % 23 == 0).alias("boundary"))


def _audits(spark, d):
    return _recordings(spark, d).where("k % 11 > 0").select("k", F.when(F.col("k") % 3 == 1, "temporal_change").otherwise("stable_offset").alias("kind"), (F.col("k") * 13 % 97 / 97.0).alias("score"))


BASE = f"""x AS (SELECT event_id, user_id AS k, event_id % 2 + 1 AS side, ms / 1000.0::DOUBLE AS s, (ms + event_id * 38 % 4000 + 200) / 1000.0::DOUBLE AS e FROM (SELECT *, (epoch_us(ts) - {FROM}) // 8640000 * 2 AS ms FROM events)),
rec AS (SELECT k, max(e) AS d, CASE WHEN k % 4 > 0 THEN k % 4 * 1.25::DOUBLE END AS mismatch FROM x GROUP BY k),
win AS (SELECT k, s, s + 60 AS e, CASE WHEN k % 3 = 1 AND s >= 280 THEN 4.0::DOUBLE WHEN k % 3 = 2 THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END + event_id * 7 % 16 / 64.0::DOUBLE + CASE WHEN event_id % 61 = 0 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS shift, 0.5::DOUBLE + event_id % 8 / 16.0::DOUBLE AS conf, event_id % 5 + 1 AS pers, event_id % 3 AS src, event_id % 10 > 0 AS acc, event_id % 23 = 0 AS bnd FROM x),
au AS (SELECT k, CASE WHEN k % 3 = 1 THEN 'temporal_change' ELSE 'stable_offset' END AS kind, k * 13 % 97 / 97.0::DOUBLE AS score FROM rec WHERE k % 11 > 0),
rel AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, e DESC, shift DESC, src DESC) AS rn FROM win WHERE acc AND NOT bnd AND conf >= 0.65 AND pers >= 3)"""
#: The suffix grows window by window.
SUFFIX = """sfx AS (SELECT k, rn, s AS fs, e AS fe, e AS le, [shift] AS sh, src AS ag FROM rel WHERE rn = 1 UNION ALL SELECT sfx.k, rel.rn, rel.s, rel.e, sfx.le, list_append(sfx.sh, rel.shift), sfx.ag + rel.src FROM sfx JOIN rel ON rel.k = sfx.k AND rel.rn = sfx.rn + 1 WHERE sfx.fs - rel.s <= 180 AND abs(rel.shift - list_aggregate(sfx.sh, 'median')) <= 1.25),
st AS (SELECT k, fs AS stable_start, fe AS first_end, le AS stable_end, len(sh) AS n, list_aggregate(sh, 'median') AS shift, list_max(sh) - list_min(sh) AS spread, ag / (2.0::DOUBLE * len(sh)) AS ag FROM (SELECT *, max(rn) OVER (PARTITION BY k) AS top FROM sfx) WHERE rn = top)"""
REPAIR = f"""{SUFFIX},
pre AS (SELECT *, sum(far) OVER (PARTITION BY k ORDER BY s DESC, e DESC) AS breaks FROM (SELECT win.k, win.s, win.e, win.shift, CASE WHEN lag(win.s) OVER (PARTITION BY win.k ORDER BY win.s DESC, win.e DESC) - win.s > 180 THEN 1 ELSE 0 END AS far FROM win JOIN st ON win.k = st.k AND n >= 4 AND stable_end - stable_start >= 300 WHERE NOT bnd AND abs(win.shift) <= 0.75 AND win.e <= stable_start)),
pf AS (SELECT k, count(*) AS m, median(shift) AS first, max(s) AS ls, max(e) AS le FROM pre WHERE breaks = 0 GROUP BY k HAVING count(*) >= 3),
rep AS (SELECT k, round(first, 2) AS first_shift, round(shift, 2) AS second_shift, round(shift - first, 2) AS shift_change, round((ls + le) / 2, 3) AS change_from, round((stable_start + first_end) / 2, 3) AS change_to, ls AS first_part_end, first_end AS second_part_start, stable_start, stable_end, round(stable_end - stable_start, 3) AS stable_duration, n::INTEGER AS n_windows, round(spread, 2) AS spread,
round(0.30 * (1 - least(1.0, spread / 1.5)) + 0.25 * least(1.0, (stable_end - stable_start) / 900.0) + 0.25 * ag + 0.20 * least(1.0, n / 8.0::DOUBLE), 3) AS confidence FROM st JOIN pf USING (k) WHERE abs(shift - first) >= 1)"""


@query(f"WITH RECURSIVE {BASE}, {SUFFIX} SELECT k, stable_start, first_end, stable_end, n::INTEGER AS n_windows, shift, spread, round(ag, 6) AS agreement FROM st")
def stable_suffix(spark, d):
    return mi.stable_suffix(_windows(spark, d), K).withColumn("agreement", F.round("agreement", 6))


@query(f"WITH RECURSIVE {BASE}, {REPAIR} SELECT * FROM rep")
def piecewise_repair(spark, d):
    return mi.piecewise_repair(_windows(spark, d), K)


ASSESSED = f"""{REPAIR}, off AS (SELECT k, round(median(shift), 2) AS shift, round(0.6 * avg(conf) + 0.4 * (1 - (max(shift) - min(shift)) / 1.25), 3) AS confidence, count(*)::INTEGER AS n_windows FROM rel GROUP BY k HAVING count(*) >= 3 AND max(shift) - min(shift) <= 1.25),
asm AS (SELECT rec.k, CASE WHEN rep.k IS NOT NULL THEN 'likely_constant_offset' WHEN kind = 'stable_offset' AND off.k IS NOT NULL THEN CASE WHEN abs(off.shift) <= 1 THEN 'likely_aligned' ELSE 'likely_constant_offset' END ELSE 'non_constant_or_uncertain' END AS category,
CASE WHEN rep.k IS NOT NULL THEN rep.confidence WHEN kind = 'stable_offset' AND off.k IS NOT NULL THEN CASE WHEN abs(off.shift) <= 1 THEN round(off.confidence * (1 - abs(off.shift) / 2.0::DOUBLE), 3) ELSE off.confidence END ELSE round(greatest(0.0, 1 - coalesce(score, 1.0)), 3) END AS likelihood,
CASE WHEN rep.k IS NOT NULL THEN 'after_change_point' WHEN kind = 'stable_offset' AND abs(off.shift) >= 0.1 THEN 'global_offset' END AS scope, CASE WHEN rep.k IS NOT NULL THEN second_shift WHEN kind = 'stable_offset' AND abs(off.shift) >= 0.1 THEN off.shift END AS shift,
CASE WHEN rep.k IS NOT NULL THEN rep.confidence WHEN kind = 'stable_offset' AND abs(off.shift) >= 0.1 THEN off.confidence END AS confidence, CASE WHEN rep.k IS NOT NULL THEN rep.n_windows WHEN kind = 'stable_offset' AND abs(off.shift) >= 0.1 THEN off.n_windows END AS n_windows
FROM rec LEFT JOIN au USING (k) LEFT JOIN rep ON rep.k = rec.k LEFT JOIN off ON off.k = rec.k)"""


@query(f"WITH RECURSIVE {BASE}, {ASSESSED} SELECT * FROM asm")
def alignment_assessment(spark, d):
    return mi.alignment_assessment(_recordings(spark, d), _audits(spark, d), _windows(spark, d), K)


SUSPECT = """lw AS (SELECT k, src, pers, shift FROM (SELECT win.*, row_number() OVER (PARTITION BY win.k ORDER BY src DESC, pers DESC, conf DESC, abs(shift) DESC, win.s, shift DESC) AS p FROM win JOIN rec ON win.k = rec.k AND win.e >= d - 360 WHERE acc AND NOT bnd AND abs(shift) > 1) WHERE p = 1),
sus AS (SELECT rec.k, greatest(0.03::DOUBLE, least(1.0::DOUBLE, 1 - (1 - coalesce(score * CASE WHEN lw.k IS NULL THEN 0.2::DOUBLE ELSE 0.35::DOUBLE + 0.35::DOUBLE * least(1.0, src / 2.0::DOUBLE) + 0.30::DOUBLE * least(1.0, pers / 3.0::DOUBLE) END, 0.0)) * (1 - 0.65::DOUBLE * least(1.0::DOUBLE, coalesce(mismatch, 0.0) / 6.0)))) AS suspicion, lw.shift AS late_shift FROM rec LEFT JOIN au USING (k) LEFT JOIN lw ON lw.k = rec.k)"""


@query(f"WITH {BASE}, {SUSPECT} SELECT k, round(suspicion, 6) AS suspicion, late_shift FROM sus")
def misalignment_suspicion(spark, d):
    return mi.suspicion(_recordings(spark, d), _audits(spark, d), _windows(spark, d), K).withColumn("suspicion", F.round("suspicion", 6))


def _clips(spark, d):
    s = _speech(spark, d)
    part = lambda i: s.where(F.col("event_id") % 6 == i)
    turns, interruptions = (part(i).select("k", F.col("start").alias("time")) for i in (0, 1))
    backchannels = part(2).select("k", "start", "end")
    events = turns.unionByName(interruptions).unionByName(backchannels.select("k", F.col("start").alias("time")))
    clips = mi.candidate_starts(_recordings(spark, d), events, K)
    return mi.window_metrics(clips, s.where("event_id % 5 > 0"), s, turns, backchannels, interruptions, K, SLICE)


CLIPS = f"""own AS (SELECT k, d, greatest(0, d - 360, d * 0.6::DOUBLE) AS late FROM rec WHERE d >= 20),
clip AS (SELECT k, d, i * 5.0::DOUBLE AS a FROM (SELECT k, d, unnest(range(ceil(late / 5)::BIGINT, floor((d - 20 + 1e-9::DOUBLE) / 5)::BIGINT + 1)) AS i FROM own) UNION SELECT k, d, round(least(d - 20, greatest(late, s - 10)), 3) FROM own JOIN x USING (k) WHERE event_id % 6 <= 2 AND s >= late AND s <= d UNION SELECT k, d, round(d - 20, 3) FROM own),
one AS (SELECT * FROM x WHERE side = 1), two AS (SELECT * FROM x WHERE side = 2), {union_sql('u1', 'one')}, {union_sql('u2', 'two')}, bo AS (SELECT u1.k, greatest(u1.s, u2.s) AS s, least(u1.e, u2.e) AS e FROM u1 JOIN u2 ON u1.k = u2.k AND u1.s < u2.e AND u2.s < u1.e),
sg AS (SELECT k, a, count(*) FILTER (side != ps AND s - pe <= 6) AS alternations, count(*) FILTER (side != ps AND s - pe <= 1.5) AS rapid FROM (SELECT clip.k, a, s, side, lag(side) OVER w AS ps, lag(e) OVER w AS pe FROM clip JOIN x ON x.k = clip.k AND x.e >= a AND x.s <= a + 20 WHERE event_id % 5 > 0 WINDOW w AS (PARTITION BY clip.k, a ORDER BY s, e, side)) GROUP BY k, a),
pt AS (SELECT clip.k, a, count(*) FILTER (event_id % 6 = 0 AND s >= a AND s <= a + 20) AS turns, count(*) FILTER (event_id % 6 = 2) AS backchannels, count(*) FILTER (event_id % 6 = 1 AND s >= a AND s <= a + 20) AS interruptions FROM clip JOIN x ON x.k = clip.k AND x.e >= a AND x.s <= a + 20 GROUP BY clip.k, a),
bs AS (SELECT clip.k, a, sum(least(bo.e, a + 20) - greatest(bo.s, a)) AS both_s FROM clip JOIN bo ON bo.k = clip.k AND bo.s < a + 20 AND bo.e > a GROUP BY clip.k, a),
met AS (SELECT clip.k, clip.d, clip.a, coalesce(alternations, 0) AS alternations, coalesce(rapid, 0) AS rapid, coalesce(turns, 0) AS turns, coalesce(backchannels, 0) AS backchannels, coalesce(interruptions, 0) AS interruptions, coalesce(both_s, 0.0) AS both_s FROM clip LEFT JOIN sg USING (k, a) LEFT JOIN pt USING (k, a) LEFT JOIN bs USING (k, a)),
sc AS (SELECT *, round(2.0::DOUBLE * alternations + 1.5::DOUBLE * rapid + 0.8::DOUBLE * turns + 1.8::DOUBLE * backchannels + 2.0::DOUBLE * interruptions + 0.5::DOUBLE * least(6.0::DOUBLE, both_s), 3) AS score FROM met)"""


@query(f'WITH {BASE}, {CLIPS} SELECT k, a AS "start", alternations, rapid, turns, backchannels, interruptions, round(both_s, 3) AS "both", score FROM sc')
def clip_metrics(spark, d):
    return _clips(spark, d).select("k", "start", "alternations", "rapid", "turns", "backchannels", "interruptions", "both", "score")


@query(f"""WITH RECURSIVE {BASE}, {ASSESSED}, {SUSPECT}, {CLIPS}, ju AS (SELECT k, s, s + 20 AS e, CASE WHEN event_id % 90 = 0 THEN 'likely_misaligned' WHEN event_id % 90 = 30 THEN 'plausibly_aligned' ELSE 'unsure' END AS verdict FROM x WHERE event_id % 15 = 0),
be AS (SELECT * FROM (SELECT sc.*, row_number() OVER (PARTITION BY k ORDER BY score DESC, d - (a + 20), a DESC) AS p FROM sc WHERE NOT EXISTS (SELECT 1 FROM ju WHERE ju.k = sc.k AND a < ju.e AND a + 20 > ju.s) AND k NOT IN (SELECT k FROM ju WHERE verdict != 'unsure')) WHERE p = 1)
SELECT be.k, a AS "start", score, category, likelihood, shift, round(suspicion, 6) AS suspicion, be.k IN (SELECT k FROM ju WHERE verdict = 'unsure') AS unsure, round(0.15 + 3.0 * suspicion + 0.75 * (1 - exp(-score / 10.0)), 6) AS weight FROM be JOIN asm ON asm.k = be.k JOIN sus ON sus.k = be.k
ORDER BY unsure, CASE category WHEN 'likely_aligned' THEN 1 WHEN 'likely_constant_offset' THEN 2 ELSE 3 END, likelihood DESC, be.k LIMIT 50""")
def misalignment_queue(spark, d):
    s, e = _speech(spark, d), F.col("event_id") % 90
    verdict = F.when(e == 0, "likely_misaligned").when(e == 30, "plausibly_aligned").otherwise("unsure")
    judged = s.where("event_id % 15 = 0").select("k", "start", (F.col("start") + 20).alias("end"), verdict.alias("verdict"))
    r, a, w = _recordings(spark, d), _audits(spark, d), _windows(spark, d)
    scored = _clips(spark, d).select("k", "duration", "start", "score")
    out = mi.misalignment_queue(scored, mi.alignment_assessment(r, a, w, K), mi.suspicion(r, a, w, K), judged, K, 50)
    return out.select("k", "start", "score", "category", "likelihood", "shift", F.round("suspicion", 6).alias("suspicion"), "unsure", F.round("weight", 6).alias("weight"))
