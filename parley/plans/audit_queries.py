"""Queries of the corpus audit, and of how well two timelines fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import audit as au
from parley.operators import intervals as iv
from parley.operators import timeline as tl
from parley.plans.registry import BUCKET, query, spans, table, union_sql
from parley.plans.supervision_queries import BASE, K, S, _assistant, _brief, _connections, _user

DAY = 86_400_000_000


def _side(spark, d, side: int):
    return iv.union(spans(spark, d).where(f"side = {side}"), K)


def _cuts(spark, d):
    return table(spark, d, "events").where("event_type = 'click'").select(F.col("user_id").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("time"))


def _events(spark, d):
    return au.events(_user(spark, d), _assistant(spark, d), _connections(spark, d), _brief(spark, d, 1), _cuts(spark, d), _side(spark, d, 1), _side(spark, d, 2), K, BUCKET, S)


ONE, TWO = "one AS (SELECT * FROM spans WHERE side = 1)", "two AS (SELECT * FROM spans WHERE side = 2)"
EVENTS = f"""{ONE}, {TWO}, {union_sql('u1', 'one')}, {union_sql('u2', 'two')}, ov AS (SELECT u1.k, greatest(u1.s, u2.s) AS t FROM u1 JOIN u2 ON u1.k = u2.k AND u1.s < u2.e AND u2.s < u1.e),
sh AS (SELECT k, e AS t FROM (SELECT k, e, (SELECT min(s) FROM ast WHERE ast.k = said.k AND ast.s >= said.e) AS n FROM said) WHERE n - e <= 900000000 UNION ALL SELECT k, e FROM (SELECT k, e, (SELECT min(s) FROM said WHERE said.k = ast.k AND said.s >= ast.e) AS n FROM ast) WHERE n - e <= 900000000),
ev AS (SELECT k, 'turn_shift' AS kind, t::DOUBLE AS t FROM sh UNION ALL SELECT k, 'hold_pause', (a + b) / 2 FROM step WHERE b - a >= 150000000 AND merge >= 0.5 UNION ALL SELECT k, 'non_floor_feedback', (s + e) / 2 FROM brief1 WHERE EXISTS (SELECT 1 FROM u2 WHERE u2.k = brief1.k AND u2.s < brief1.e AND u2.e > brief1.s)
UNION ALL SELECT user_id, 'overlap_interruption', epoch_us(ts) FROM events WHERE event_type = 'click' UNION ALL SELECT k, 'overlap_interruption', t FROM ov)"""


@query(f"WITH {BASE}, {EVENTS} SELECT k, kind, count(*) AS n, min(t) AS first, max(t) AS last FROM ev GROUP BY k, kind")
def audit_events(spark, d):
    return _events(spark, d).groupBy("k", "kind").agg(F.count("*").alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))


@query(f'WITH {BASE}, {EVENTS} SELECT k, t AS "time" FROM sh')
def shift_times(spark, d):
    u, a = _user(spark, d), _assistant(spark, d)
    return au.shift_times(u, a, K, S).unionByName(au.shift_times(a, u, K, S))


def _windows(spark, d):
    b = spans(spark, d).groupBy("k").agg(F.min("start").alias("low"), F.max("end").alias("limit"))
    w = b.select("k", "limit", F.explode(F.expr(f"sequence(low, limit, {DAY}L)")).alias("start")).where(F.col("start") + 4 * S < F.col("limit"))
    return w.withColumn("end", F.least(F.col("limit"), F.col("start") + 20 * S))


WINDOWS = f"""w AS (SELECT k, lim, a AS s, least(lim, a + 12000000000) AS e FROM (SELECT k, max(e) AS lim, unnest(range(min(s), max(e) + 1, {DAY})) AS a FROM spans GROUP BY k) WHERE a + 2400000000 < lim)"""
#: By frames, one after the other.
SUPERVISION = f"""{WINDOWS}, fr AS (SELECT k, s, e, lim, least(e::DOUBLE, s + (i + 0.5::DOUBLE) * 48000000) AS t FROM (SELECT *, unnest(range(50, greatest(1, CAST(ceil((e - s) / 48000000.0::DOUBLE) AS BIGINT)))) AS i FROM w)),
ok AS (SELECT k, s, e FROM said UNION ALL SELECT k, a, b FROM linked WHERE ok), bad AS (SELECT k, a AS s, b AS e FROM linked WHERE NOT ok UNION ALL SELECT k, s, e FROM usr WHERE source = 'audio'), {union_sql('oku', 'ok')}, {union_sql('badu', 'bad')},
fv AS (SELECT fr.k, fr.s, fr.e, fr.t, fr.lim, max(CASE WHEN oku.k IS NOT NULL THEN 1 ELSE 0 END) AS v FROM fr LEFT JOIN oku ON oku.k = fr.k AND oku.s <= fr.t AND fr.t < oku.e GROUP BY ALL),
fd AS (SELECT fv.*, badu.k IS NOT NULL AS dd FROM fv LEFT JOIN badu ON badu.k = fv.k AND badu.s <= fv.t AND fv.t < badu.e),
sup AS (SELECT k, s, e, count(*) AS n_frames, avg(CASE WHEN v = 1 OR NOT dd THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS prim, avg(((t + 120000000 <= lim)::INTEGER + (t + 300000000 <= lim)::INTEGER + (t + 600000000 <= lim)::INTEGER + (t + 900000000 <= lim)::INTEGER) / 4.0::DOUBLE) AS fut FROM fd GROUP BY ALL),
sp AS (SELECT w.k, w.s, w.e, coalesce(n_frames, 0) AS n_frames, coalesce(prim, 0.0) AS prim, coalesce(fut, 0.0) AS fut FROM w LEFT JOIN sup USING (k, s, e))"""


def _supervised(spark, d):
    ok, bad = au.floor_validity(_user(spark, d), _connections(spark, d), K, BUCKET, S)
    return au.supervision(_windows(spark, d), ok, bad, K, BUCKET, S)


@query(f'WITH {BASE}, {SUPERVISION} SELECT k, s AS "start", e AS "end", n_frames, round(prim, 6) AS "primary", round(fut, 6) AS future FROM sp')
def window_supervision(spark, d):
    return _supervised(spark, d).select("k", "start", "end", "n_frames", F.round("primary", 6).alias("primary"), F.round("future", 6).alias("future"))


AUDIT = f"""{SUPERVISION}, {EVENTS}, rg AS (SELECT k, s, e FROM u2 WHERE e - s >= 300000000), ex AS (SELECT k, s, e FROM brief2 WHERE s // 1000000 % 4 = 0),
z AS (SELECT sp.*, least(e, s + 2400000000) AS f, greatest(0.0::DOUBLE, (e - least(e, s + 2400000000)) / 600000000.0::DOUBLE) AS sec FROM sp),
y AS (SELECT z.*, coalesce((SELECT sum(least(z.e, r.e) - greatest(z.f, r.s)) FROM rg r WHERE r.k = z.k AND r.s < z.e AND r.e > z.f) / 600000000.0::DOUBLE, 0.0) AS masked, EXISTS (SELECT 1 FROM ex WHERE ex.k = z.k AND ex.s < z.e AND ex.e > z.s) AS excl FROM z),
c AS (SELECT z.k, z.s, z.e, list(DISTINCT kind) AS kinds, count(*) AS n FROM z JOIN ev ON ev.k = z.k AND ev.t >= z.f AND ev.t < z.e GROUP BY ALL),
r AS (SELECT y.*, coalesce(c.n, 0) AS n, CASE WHEN list_contains(kinds, 'overlap_interruption') THEN 'overlap_interruption' WHEN list_contains(kinds, 'non_floor_feedback') THEN 'non_floor_feedback' WHEN list_contains(kinds, 'hold_pause') THEN 'hold_pause' WHEN list_contains(kinds, 'turn_shift') THEN 'turn_shift' ELSE 'background' END AS category,
CASE WHEN y.k % 8 = 0 THEN 'missing_region_analysis' ELSE concat_ws(',', CASE WHEN sec < 8 THEN 'insufficient_supervised_duration' END, CASE WHEN prim < 0.9 THEN 'insufficient_primary_supervision' END, CASE WHEN fut < 0.95 THEN 'insufficient_future_supervision' END, CASE WHEN CASE WHEN sec > 0 THEN masked / sec ELSE 0 END > 0.35 THEN 'excessive_masking' END, CASE WHEN excl THEN 'human_review_exclusion' END) END AS rejections FROM y LEFT JOIN c USING (k, s, e)),
audited AS (SELECT *, CASE WHEN rejections = '' THEN greatest(0.0, sec * prim - masked) ELSE 0.0 END AS effective FROM r)"""


def _regions(spark, d):
    return _side(spark, d, 2).where("end - start >= 300000000")


def _exclusions(spark, d):
    return _brief(spark, d, 2).where(F.floor(F.col("start") / 1_000_000) % 4 == 0)


def _audited(spark, d):
    windows = _supervised(spark, d).withColumn("analysed", F.col("k") % 8 > 0)
    return au.audit_windows(windows, _events(spark, d), _regions(spark, d), _exclusions(spark, d), K, BUCKET, S, analysed="analysed")


@query(f"""WITH {BASE}, {AUDIT} SELECT k, s AS "start", e AS "end", round(sec, 6) AS supervised, CASE WHEN k % 8 = 0 THEN 0.0 ELSE round(masked, 6) END AS masked, category, rejections, CASE WHEN rejections = '' THEN n ELSE 0 END AS n_events, round(effective, 6) AS effective FROM audited""")
def audit_windows(spark, d):
    r = [F.round(c, 6).alias(c) for c in ("supervised", "masked", "effective")]
    return _audited(spark, d).select("k", "start", "end", "category", F.array_join("rejections", ",").alias("rejections"), "n_events", *r)


@query(f"""WITH {BASE}, {AUDIT} SELECT k, count(*) AS candidates, count(*) FILTER (rejections = '') AS accepted, round(sum(CASE WHEN rejections = '' THEN (e - s) / 600000000.0::DOUBLE ELSE 0 END), 4) AS input_seconds, round(sum(effective), 4) AS effective_seconds, round(sum(CASE WHEN rejections = '' THEN masked ELSE 0 END), 4) AS masked_seconds FROM audited GROUP BY k""")
def audit_conversations(spark, d):
    x = au.summarize(_audited(spark, d), K, S)
    return x.select("k", "candidates", "accepted", *[F.round(c, 4).alias(c) for c in ("input_seconds", "effective_seconds", "masked_seconds")])


@query(f"""WITH {BASE}, {AUDIT}, g AS (SELECT DISTINCT k FROM audited), a AS (SELECT k, kind, count(*) AS n FROM ev GROUP BY ALL), v AS (SELECT z.k, kind, count(*) AS n FROM audited z JOIN ev ON ev.k = z.k AND ev.t >= z.f AND ev.t < z.e WHERE rejections = '' GROUP BY ALL), wi AS (SELECT k, category AS kind, count(*) AS n FROM audited WHERE rejections = '' GROUP BY ALL)
SELECT g.k, c.kind AS category, coalesce(wi.n, 0) AS windows, coalesce(a.n, 0) AS available, coalesce(v.n, 0) AS covered FROM g CROSS JOIN (SELECT unnest(['overlap_interruption', 'non_floor_feedback', 'hold_pause', 'turn_shift', 'background']) AS kind) c LEFT JOIN wi ON wi.k = g.k AND wi.kind = c.kind LEFT JOIN a ON a.k = g.k AND a.kind = c.kind LEFT JOIN v ON v.k = g.k AND v.kind = c.kind""")
def audit_categories(spark, d):
    return au.category_summary(_audited(spark, d), _events(spark, d), K)


@query(f"""WITH {BASE}, {AUDIT}, r1 AS (SELECT k % 10 AS g, unnest(string_split(rejections, ',')) AS reason FROM audited WHERE rejections != ''), g AS (SELECT DISTINCT k % 10 AS g FROM audited)
SELECT g.g, r.reason, count(r1.reason) AS windows FROM g CROSS JOIN (SELECT unnest(['missing_region_analysis', 'insufficient_supervised_duration', 'insufficient_primary_supervision', 'insufficient_future_supervision', 'excessive_masking', 'human_review_exclusion']) AS reason) r LEFT JOIN r1 ON r1.g = g.g AND r1.reason = r.reason GROUP BY ALL""")
def audit_rejections(spark, d):
    return au.rejection_summary(_audited(spark, d).withColumn("g", F.col("k") % 10), ["g"])


@query(f"""WITH {BASE}, {EVENTS}, rg AS (SELECT k, s, e FROM u2 WHERE e - s >= 300000000), ex AS (SELECT k, s, e FROM brief2 WHERE s // 1000000 % 4 = 0), rec AS (SELECT k, max(e) - min(s) AS duration FROM spans GROUP BY k),
x AS (SELECT k, sum(greatest(0, e - s - coalesce(o, 0))) AS out FROM (SELECT ex.*, (SELECT sum(least(ex.e, r.e) - greatest(ex.s, r.s)) FROM rg r WHERE r.k = ex.k AND r.s < ex.e AND r.e > ex.s) AS o FROM ex) GROUP BY k), b AS (SELECT k, sum(e - s) AS bad FROM rg GROUP BY k)
SELECT k, CASE WHEN k % 8 = 0 THEN 0.0 ELSE round(greatest(0.0, (duration - coalesce(bad, 0) - coalesce(out, 0)) / 600000000.0::DOUBLE), 6) END AS usable FROM rec LEFT JOIN b USING (k) LEFT JOIN x USING (k)""")
def usable_seconds(spark, d):
    rec = spans(spark, d).groupBy("k").agg((F.max("end") - F.min("start")).alias("duration")).withColumn("analysed", F.col("k") % 8 > 0)
    return au.usable_seconds(rec, _regions(spark, d), _exclusions(spark, d), K, BUCKET, S, "analysed").select("k", F.round("usable", 6).alias("usable"))


@query("""SELECT metric, current, target, current >= target AS ready FROM (SELECT unnest([{'metric': 'usable_hours', 'current': sum(value), 'target': 100.0}, {'metric': 'turn_shifts', 'current': count(*)::DOUBLE, 'target': 20000.0}, {'metric': 'hold_pauses', 'current': count(*) FILTER (event_type = 'view')::DOUBLE, 'target': 20000.0},
{'metric': 'backchannels', 'current': count(*) FILTER (event_type = 'click')::DOUBLE, 'target': 5000.0}, {'metric': 'interruptions_and_overlaps', 'current': count(*) FILTER (event_type = 'purchase')::DOUBLE, 'target': 2000.0}], recursive := true) FROM (SELECT event_type, round(value) AS value FROM events))""")
def pilot_progress(spark, d):
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    t = table(spark, d, "events").agg(F.sum(F.round("value")).alias("usable_hours"), F.count("*").alias("turn_shifts"), n("view").alias("hold_pauses"), n("click").alias("backchannels"), n("purchase").alias("interruptions_and_overlaps"))
    return au.pilot(t)


FRAME, REACH, MARGIN = 0.1, 0.5, 0.6
V = ["vec_id", "source"]


def _activity(spark, d):
    e = table(spark, d, "embeddings")
    pair = e.select("vec_id", F.col("embedding").alias("p")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("q")), "vec_id")
    low = {"loud": 0.05, "any": 0.0, "most": -0.05}
    above = lambda c, x: F.transform(c, lambda v: v > F.lit(x).cast("float"))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("source"), above("p", x).alias("a"), above("q", x).alias("b")) for n, x in low.items()])).alias("r")
    return pair.select("vec_id", rows).select("vec_id", "r.*")


ACTIVITY = """act AS (SELECT a.vec_id, source, generate_subscripts(a.embedding, 1) - 1 AS i, unnest(a.embedding) > low AS x, unnest(b.embedding) > low AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, (VALUES ('loud', 0.05::FLOAT), ('any', 0.0::FLOAT), ('most', -0.05::FLOAT)) s(source, low)),
st AS (SELECT *, CASE WHEN x AND y THEN 'both' WHEN x THEN 'a' WHEN y THEN 'b' ELSE 'neither' END AS state FROM act),
sn AS (SELECT *, sum(CASE WHEN p = state THEN 0 ELSE 1 END) OVER (PARTITION BY vec_id, source ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(state) OVER (PARTITION BY vec_id, source ORDER BY i) AS p FROM st)),
rn AS (SELECT vec_id, source, state, min(i) AS first, max(i) AS last, count(*) AS length FROM sn GROUP BY vec_id, source, run, state),
lg AS (SELECT *, lag(state) OVER w AS ps, first - lag(last) OVER w - 1 AS gap FROM rn WHERE (state = 'both' AND length >= 8) OR (state = 'neither' AND length >= 12) WINDOW w AS (PARTITION BY vec_id, source ORDER BY first)),
cy AS (SELECT vec_id, source, count(*) FILTER (ps != state AND gap <= 50) AS cycles FROM lg GROUP BY ALL)"""


def _shift_sql(name: str, source: str, keys: str) -> str:
    """Best shifts of relation ``source`` (keys, i from 0, n, x, y)."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""{name}_l AS (SELECT {', '.join('a.' + k for k in keys.split(', '))}, g.lag, any_value(a.n) - 12 AS n, count(*) FILTER (a.x AND b.y) AS bo, count(*) FILTER (NOT a.x AND NOT b.y) AS ne FROM {source} a JOIN (SELECT unnest(range(-5, 6)) AS lag) g ON true JOIN {source} b ON {on} AND b.i = a.i - g.lag WHERE a.i >= 6 AND a.i < a.n - 6 GROUP BY ALL),
{name} AS (SELECT {keys}, lag * 0.1::DOUBLE AS lag, greatest(0, (bo0 + ne0 - bo - ne) / n::DOUBLE) AS improvement, (bo0 - bo) / n::DOUBLE AS overlap_reduction, (ne0 - ne) / n::DOUBLE AS silence_reduction, greatest(0.0, least((bo0 - bo) / n::DOUBLE, (ne0 - ne) / n::DOUBLE)) AS joint FROM (SELECT *, max(bo) FILTER (lag = 0) OVER (PARTITION BY {keys}) AS bo0, max(ne) FILTER (lag = 0) OVER (PARTITION BY {keys}) AS ne0, row_number() OVER (PARTITION BY {keys} ORDER BY bo + ne, lag) AS place FROM {name}_l) WHERE place = 1)"""


METRICS = f"""{ACTIVITY}, full_ AS (SELECT *, count(*) OVER (PARTITION BY vec_id, source) AS n FROM act), {_shift_sql('bs', 'full_', 'vec_id, source')},
rt AS (SELECT vec_id, source, count(*) FILTER (x AND y) / count(*)::DOUBLE AS overlap_ratio, count(*) FILTER (NOT x AND NOT y) / count(*)::DOUBLE AS silence_ratio FROM act GROUP BY ALL),
mt AS (SELECT rt.*, coalesce(cycles, 0) AS cycles, lag, improvement, overlap_reduction, silence_reduction, joint FROM rt JOIN bs USING (vec_id, source) LEFT JOIN cy USING (vec_id, source))"""
NUMBERS = ("lag", "improvement", "overlap_reduction", "silence_reduction")


def _metrics(spark, d):
    return tl.metrics(_activity(spark, d), V, FRAME, REACH, MARGIN)


@query(f"WITH {ACTIVITY} SELECT vec_id, source, state, count(*) AS n, CAST(max(length) AS BIGINT) AS longest FROM rn GROUP BY ALL")
def timeline_states(spark, d):
    return tl.states(_activity(spark, d), V).groupBy(*V, "state").agg(F.count("*").alias("n"), F.max("length").alias("longest"))


@query(f"WITH {METRICS} SELECT vec_id, source, cycles, round(joint, 9) AS joint_reduction, {', '.join(f'round({c}, 9) AS {c}' for c in (*NUMBERS, 'overlap_ratio', 'silence_ratio'))} FROM mt")
def timeline_metrics(spark, d):
    return _metrics(spark, d).select(*V, "cycles", *[F.round(c, 9).alias(c) for c in (*NUMBERS, "overlap_ratio", "silence_ratio", "joint_reduction")])


WINDOWED = f"""wn AS (SELECT vec_id, source, i // 40 AS w, i % 40 AS i, least(40, n - (i // 40) * 40) AS n, x, y FROM full_), wk AS (SELECT * FROM wn WHERE n >= 20), {_shift_sql('wb', 'wk', 'vec_id, source, w')}"""


def _windowed(spark, d):
    return tl.windows(_activity(spark, d), V, FRAME, 4.0, 2.0, REACH, MARGIN)


@query(f"WITH {METRICS}, {WINDOWED} SELECT vec_id, source, w * 4.0::DOUBLE AS \"start\", improvement >= 0.02 AS meaningful, {', '.join(f'round({c}, 9) AS {c}' for c in NUMBERS)} FROM wb")
def timeline_windows(spark, d):
    return _windowed(spark, d).select(*V, "start", "meaningful", *[F.round(c, 9).alias(c) for c in NUMBERS])


SHIFTS = f"""{METRICS}, {WINDOWED}, mg AS (SELECT *, greatest(0.001::DOUBLE, improvement + 2 * joint) AS wt FROM mt WHERE abs(lag) >= 0.4 AND improvement >= 0.02), rs AS (SELECT vec_id, min(lag) AS shift FROM (SELECT *, sum(wt) OVER (PARTITION BY vec_id ORDER BY lag) AS c, sum(wt) OVER (PARTITION BY vec_id) AS t FROM mg) WHERE c * 2 >= t GROUP BY 1)"""


@query(f"WITH {SHIFTS} SELECT vec_id, round(shift, 6) AS shift FROM rs")
def robust_shift(spark, d):
    return tl.robust_shift(_metrics(spark, d), ["vec_id"]).select("vec_id", F.round("shift", 6).alias("shift"))


CANDIDATES = f"""{SHIFTS}, sp AS (SELECT vec_id, max(lag) - min(lag) AS source_spread, avg(overlap_ratio) AS o, avg(improvement) AS im, avg(joint) AS jo, avg(cycles) AS cyc, avg(0.5 * least(1.0, improvement / 0.20) + 0.5 * least(1.0, joint / 0.10)) AS st FROM mt GROUP BY 1), ag AS (SELECT vec_id, count(*) >= 2 AND max(lag) - min(lag) <= 0.8 + 1e-9 AS agree FROM mg GROUP BY 1),
ws AS (SELECT vec_id, count(*) FILTER (s >= 1.5 - 1e-9) AS wide, max(s) AS window_spread FROM (SELECT vec_id, source, max(lag) - min(lag) AS s FROM wb WHERE improvement >= 0.02 GROUP BY ALL) GROUP BY 1),
an AS (SELECT vec_id, lag AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY improvement < 0.02, w, source) AS p FROM wb) WHERE p = 1),
j AS (SELECT sp.*, coalesce(agree, false) AS agree, CASE WHEN coalesce(wide, 0) >= 2 THEN 'variable' WHEN coalesce(agree, false) THEN 'constant' ELSE 'uncertain' END AS pattern, coalesce(window_spread, 0.0) AS window_spread, coalesce(shift, 0.0) AS full_shift, anchor FROM sp LEFT JOIN ag USING (vec_id) LEFT JOIN ws USING (vec_id) LEFT JOIN rs USING (vec_id) LEFT JOIN an USING (vec_id)),
q AS (SELECT *, round(round_even(CASE WHEN pattern = 'variable' AND anchor IS NOT NULL THEN anchor ELSE full_shift END / 0.1::DOUBLE, 0) * 0.1::DOUBLE, 1) AS recommended FROM j)"""


@query(f"""WITH {CANDIDATES} SELECT vec_id, pattern, round(full_shift, 6) AS full_shift, recommended, round(least(1.0, 1 - exp(-(4 * im + 8 * jo + 1.5 * o + 0.025 * cyc + 0.15 * agree::INTEGER + 0.10 * (pattern = 'variable')::INTEGER) / 1.2)), 6) AS likelihood,
round(greatest(0.0, least(1.0, st * (0.35 + 0.65 * exp(-source_spread / 1.5)) * (0.5 + 0.5 * exp(-abs(recommended - full_shift) / 2.0)) * (0.6 + 0.4 * exp(-window_spread / 4.0)))), 6) AS confidence FROM q""")
def synchronization_candidates(spark, d):
    x = tl.candidates(_metrics(spark, d), _windowed(spark, d), ["vec_id"])
    return x.select("vec_id", "pattern", "recommended", *[F.round(c, 6).alias(c) for c in ("full_shift", "likelihood", "confidence")])


@query(f"""WITH x AS (SELECT user_id AS k, epoch_us(ts) AS s, (event_id * 37 % 6001 - 3000) / 1000.0::DOUBLE AS shift, (event_id % 100) / 100.0::DOUBLE AS c, event_id % 5 AS p, event_id % 3 > 0 AS ok FROM events),
t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c * least(1.0::DOUBLE, abs(shift) / 2.0) DESC, abs(shift) DESC, s, shift DESC, c DESC, p DESC) AS place FROM x), r AS (SELECT k, coalesce(max(shift) FILTER (ok AND p >= 3 AND c >= 0.65) - min(shift) FILTER (ok AND p >= 3 AND c >= 0.65), 0.0) AS rg FROM x GROUP BY k),
y AS (SELECT t.*, rg, CASE WHEN rg >= 1 THEN 'temporal_change' WHEN p >= 2 AND abs(shift) >= 0.3 THEN 'stable_offset' ELSE 'uncertain' END AS kind FROM t JOIN r USING (k) WHERE place = 1)
SELECT k, kind, round(rg, 6) AS shift_range, round(shift, 6) AS shift, round(CASE kind WHEN 'uncertain' THEN least(0.19, 0.19 * c) ELSE least(1.0, c * (0.5 + 0.5 * (1 - exp(-CASE kind WHEN 'temporal_change' THEN rg ELSE abs(shift) END / 4.0)))) END, 6) AS score FROM y""")
def synchronization_audit(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    x = table(spark, d, "events").select(F.col("user_id").alias("k"), at.alias("start"), ((F.col("event_id") * 37 % 6001 - 3000) / F.lit(1000.0)).alias("shift"), ((F.col("event_id") % 100) / F.lit(100.0)).alias("confidence"), (F.col("event_id") % 5).alias("persistence"), (F.col("event_id") % 3 > 0).alias("reliable"))
    return tl.anomaly(x, K).select("k", "kind", *[F.round(c, 6).alias(c) for c in ("shift_range", "shift", "score")])
