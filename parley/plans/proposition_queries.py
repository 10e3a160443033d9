"""Queries of propositions. Stand-in: the recordings of the misalignment review; anchors are events, regions some of them grown."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import intervals as iv
from parley.operators import propositions as pp
from parley.plans.misalignment_queries import BASE, K, SLICE, _speech
from parley.plans.registry import query, union_sql

LIMIT = 8


def _windows(spark, d):
    s = _speech(spark, d)
    e = F.col("event_id")
    kind = F.get(F.array(*[F.lit(k) for k in pp.KINDS[:4]]), (e % 4).cast("int"))
    anchors = s.select("k", kind.alias("kind"), F.col("start").alias("time"), ((e % 8) / 8.0).alias("confidence"))
    recordings = s.groupBy("k").agg(F.max("end").alias("duration"))
    bad = iv.union(s.where("event_id % 7 = 0").select("k", "start", (F.col("end") + 4).alias("end")), K, slice_width=SLICE)
    return pp.anchor_windows(anchors, recordings, bad.withColumn("reason", F.lit("long_silence")), K)


SQL = f"""{BASE}, an AS (SELECT event_id, k, s AS t, ['turn_shift', 'hold_pause', 'non_floor_feedback', 'overlap_interruption'][event_id % 4 + 1] AS kind, event_id % 8 / 8.0::DOUBLE AS c FROM x), bd AS (SELECT k, s, e + 4 AS e FROM x WHERE event_id % 7 = 0), {union_sql('bad', 'bd')},
wn AS (SELECT an.*, d, least(greatest(0.0, d - 20), greatest(0.0, t - 12)) AS a FROM an JOIN rec USING (k)), we AS (SELECT *, least(d, a + 20) AS b, least(least(d, a + 20), a + 4) AS f FROM wn),
wm AS (SELECT we.*, coalesce((SELECT sum(least(bad.e, b) - greatest(bad.s, f)) FROM bad WHERE bad.k = we.k AND bad.s < b AND bad.e > f), 0.0) / (b - f) AS masked, (SELECT count(*) FROM an z WHERE z.k = we.k AND z.kind = we.kind AND z.t >= f AND z.t < b) AS n_kind FROM we WHERE b > f),
lk AS (SELECT *, row_number() OVER (PARTITION BY k, kind ORDER BY round(c + 0.08 * least(3, n_kind) - 0.8 * greatest(0.0, masked - 0.2), 9) DESC, round(masked, 9), t, c DESC) AS r FROM wm),
bl AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r, list_position(['turn_shift', 'hold_pause', 'non_floor_feedback', 'overlap_interruption'], kind)) AS place FROM lk WHERE r <= {LIMIT} QUALIFY place <= {LIMIT})"""


@query(f'WITH {SQL} SELECT k, kind, t AS "time", round(a, 6) AS "start", round(masked, 6) AS masked, n_kind, place::INTEGER AS place FROM bl')
def balanced_anchors(spark, d):
    """Values are rounded before they are compared, so that equal ones tie alike everywhere."""
    out = pp.balanced(_windows(spark, d), K, LIMIT)
    return out.select("k", "kind", "time", F.round("start", 6).alias("start"), F.round("masked", 6).alias("masked"), "n_kind", "place")


@query(f"""WITH {SQL}, rt AS (SELECT *, 1 - (floor(a) % 5) / 64.0::DOUBLE AS pr, 1 - (floor(a) % 3) / 64.0::DOUBLE AS fu FROM bl), mk AS (SELECT rt.*, (SELECT count(DISTINCT floor((s - a) / 0.08::DOUBLE + 1e-9)) FROM x WHERE x.k = rt.k AND event_id % 2 = 0 AND s >= f AND s < b) AS n_marks FROM rt),
sc AS (SELECT *, greatest(0.0, least(1.0, 0.25 * pr + 0.15 * fu + 0.2 * c + 0.1 * least(1.0, n_marks / 3.0::DOUBLE) + 0.15 * (1 - masked) + 0.15 * least(1.0, n_kind / 3.0::DOUBLE) - 0.7 * greatest(0.0, masked - 0.2))) AS score FROM mk)
SELECT k, kind, t AS "time", round(a, 6) AS "start", n_marks, round(score + 1e-9, 6) AS score FROM sc WHERE score >= 0.75 AND pr >= 0.9 AND fu >= 0.95 AND masked <= 0.35 AND (b <= 250 OR (a >= 300 AND b <= d))""")
def training_propositions(spark, d):
    w = pp.balanced(_windows(spark, d), K, LIMIT)
    ratios = w.select("k", "start", "end", (1 - F.floor("start") % 5 / 64.0).alias("primary"), (1 - F.floor("start") % 3 / 64.0).alias("future")).distinct()
    s = _speech(spark, d)
    ends = s.groupBy("k").agg(F.max("end").alias("end"))
    free = ends.select("k", F.lit(0.0).alias("start"), F.lit(250.0).alias("end")).unionByName(ends.select("k", F.lit(300.0).alias("start"), "end"))
    out = pp.propositions(w, ratios, s.where("event_id % 2 = 0").select("k", F.col("start").alias("time")), free, K)
    return out.select("k", "kind", "time", F.round("start", 6).alias("start"), "n_marks", F.round(F.col("score") + 1e-9, 6).alias("score"))
