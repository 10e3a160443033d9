"""Queries of the review plan. Stand-in: users are recordings of ten minutes at most, in ten datasets; errors and short spans are excluded."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import intervals as iv
from parley.operators import review as rv
from parley.plans.misalignment_queries import BASE, _speech
from parley.plans.registry import query, union_sql

GROUPS = ["g", "k"]
SEED = "review-1"


def _recordings(spark, d):
    r = _speech(spark, d).groupBy("k").agg(F.max("end").alias("duration"))
    return r.select((F.col("k") % 10).alias("g"), "k", "duration", (F.col("k") % 9 > 0).alias("analysed"))


def _exclusions(spark, d):
    return _speech(spark, d).where("event_id % 4 = 0").select((F.col("k") % 10).alias("g"), "k", "start", "end")


def _hash(*parts: str) -> str:
    return f"('0x' || substr(sha256(concat_ws(':', '{SEED}', {', '.join(parts)})), 1, 15))::BIGINT"


#: All free frames, one by one.
STARTS = f"""{BASE}, rc AS (SELECT k % 10 AS g, k, d AS duration, k % 9 > 0 AS analysed FROM rec), fr AS (SELECT g, k, unnest(range(0, floor(greatest(0.0, duration - 20) / 0.08::DOUBLE)::BIGINT + 1)) AS f FROM rc),
fm AS (SELECT g, k, f, f * 0.08::DOUBLE AS t FROM fr), ok AS (SELECT g, k, f, row_number() OVER (PARTITION BY k ORDER BY f) - 1 AS i, count(*) OVER (PARTITION BY k) AS room FROM fm WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.k = fm.k AND event_id % 4 = 0 AND t < e AND t + 20 > s)),
rs AS (SELECT g, k, f * 0.08::DOUBLE AS start, room FROM ok WHERE i = {_hash("'start'", 'g', 'k')} % room)"""


@query(f'WITH {STARTS} SELECT g, k, start AS "start", room FROM rs')
def review_starts(spark, d):
    return rv.review_starts(_recordings(spark, d), _exclusions(spark, d), GROUPS, SEED)


PLANNED = f"""{STARTS}, pl AS (SELECT * FROM (SELECT g, k, start, row_number() OVER (PARTITION BY g ORDER BY sha256(concat_ws(':', '{SEED}', g, k)), k) AS place FROM rs JOIN rc USING (g, k) WHERE analysed AND duration >= 20) WHERE place <= 4)"""


@query(f'WITH {PLANNED} SELECT g, k, place::INTEGER AS place, ({_hash("\'side\'", "g", "k")} % 2 + 1)::INTEGER AS side, start AS "start" FROM pl')
def plan_review(spark, d):
    return rv.plan_review(_recordings(spark, d), _exclusions(spark, d), "g", "k", 4, SEED)


@query(f"""WITH {PLANNED}, fa AS (SELECT g, k, row_number() OVER (PARTITION BY g ORDER BY sha256(concat_ws(':', '{SEED}', 'failed', g, k)), k) AS i FROM pl WHERE k % 2 = 0),
sp AS (SELECT g, k, start, row_number() OVER (PARTITION BY g ORDER BY sha256(concat_ws(':', '{SEED}', 'replacement', g, k)), k) AS i FROM rs JOIN rc USING (g, k) WHERE analysed AND duration >= 20 AND k NOT IN (SELECT k FROM pl))
SELECT fa.g, fa.k, sp.k AS new_key, ({_hash("'side'", 'sp.g', 'sp.k')} % 2 + 1)::INTEGER AS side, start AS "start" FROM fa JOIN sp ON fa.g = sp.g AND fa.i = sp.i""")
def review_replacements(spark, d):
    r, x = _recordings(spark, d), _exclusions(spark, d)
    planned = rv.plan_review(r, x, "g", "k", 4, SEED)
    return rv.replacements(planned.where("k % 2 = 0"), planned, r, x, "g", "k", SEED)


#: What lies between some events; starts laid end to end, the i-th draw found among them.
USABLE = f"""{BASE}, ms AS (SELECT event_id, k, round(s * 1000)::BIGINT AS a, round(e * 1000)::BIGINT AS b FROM x), ex AS (SELECT k, a, b FROM ms WHERE event_id % 12 = 0 UNION ALL SELECT k, max(b), max(b) FROM ms GROUP BY k),
av AS (SELECT k, r AS a, a AS b FROM (SELECT k, a, b, coalesce(max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM ex) WHERE a - r > 20000),
la AS (SELECT *, n + before AS upto FROM (SELECT k, a, b - 20000 - a + 1 AS n, coalesce(sum(b - 20000 - a + 1) OVER (PARTITION BY k ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM av)), ro AS (SELECT k, max(upto) AS room FROM la GROUP BY k),
dr AS (SELECT k, i, {_hash('k', 'i')} % room AS v FROM (SELECT k, room, unnest(range(64)) AS i FROM ro)), p AS (SELECT dr.k, i, a + v - before AS place FROM dr JOIN la ON la.k = dr.k AND v >= before AND v < upto),
{union_sql('un', '(SELECT k, a AS s, b AS e FROM ms)')},
r AS (SELECT p.k, i, place, coalesce(sum(least(un.e, place + 20000) - greatest(un.s, place + 4000)) FILTER (un.k IS NOT NULL), 0) / 16000.0::DOUBLE AS ratio FROM p LEFT JOIN un ON un.k = p.k AND un.s < place + 20000 AND un.e > place + 4000 GROUP BY ALL)"""


@query(f"""WITH {USABLE} SELECT k, place AS "start", ratio FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY ratio > 0.05, CASE WHEN ratio > 0.05 THEN ratio ELSE 0.0 END, CASE WHEN ratio > 0.05 THEN '' ELSE sha256(concat_ws(':', '{SEED}', 'choice', k, i)) END, i) = 1""")
def usable_starts(spark, d):
    s = _speech(spark, d)
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint").alias(c)
    spans = s.select("event_id", "k", ms("start"), ms("end"))
    bounds = spans.groupBy("k").agg(F.lit(0).cast("bigint").alias("low"), F.max("end").alias("high"))
    free = iv.gaps(spans.where("event_id % 12 = 0"), ["k"], bounds=bounds, slice_width=60000)
    return rv.usable_starts(free.where(F.col("end") - F.col("start") > 20000), spans.select("k", "start", "end"), ["k"], SEED, 20000, 4000, 20000.0, masked=0.05)
