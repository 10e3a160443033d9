"""Queries over turns, words and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import frames as fr
from parley.operators import intervals as iv
from parley.operators import text as tx
from parley.operators import turns as tn
from parley.plans.registry import BUCKET, SPANS, query, spans, table, union_sql

US = 1_000_000.0
K = ["k"]
KS = ["k", "side"]
HALF = 1800 * 1_000_000


def session_sql(name: str, source: str, keys: str, gap: int) -> str:
    return f"""{name}_m AS (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
{name} AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM {name}_m)"""


@query(f"WITH {SPANS}, {session_sql('n', 'spans', 'k, side', HALF)} SELECT k, side, min(s) AS \"start\", max(e) AS \"end\", count(*) AS n_words FROM n GROUP BY k, side, run")
def sessionize_gap(spark, d):
    return tn.turns(spans(spark, d), KS, HALF)


@query(f"""WITH {SPANS}, {session_sql('n', 'spans', 'k, side', HALF)}, p AS (SELECT *, max(e) OVER (PARTITION BY k, side, run ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM n) SELECT k, side, prev AS "start", s AS "end" FROM p WHERE s - prev >= 300000000""")
def internal_pauses(spark, d):
    return tn.internal_pauses(spans(spark, d), KS, HALF, 300 * 1_000_000)


@query(f"""WITH {SPANS}, {union_sql('u', 'spans', 'k, side')}, z AS (SELECT k, max(e) + 7200000000 AS z FROM spans GROUP BY k), l AS (SELECT u.k, side, e, coalesce(lead(s) OVER (PARTITION BY u.k, side ORDER BY s, e), z) - e AS quiet FROM u JOIN z ON z.k = u.k) SELECT k, side, e AS "at", quiet AS silence FROM l WHERE quiet >= {HALF}""")
def end_of_turn_events(spark, d):
    x = spans(spark, d)
    last = x.groupBy("k").agg((F.max("end") + 7200 * 1_000_000).alias("z"))
    return tn.end_of_turn(iv.union(x, KS).join(last, "k"), KS, HALF, F.col("z"))


@query(f"""WITH {SPANS}, {union_sql('u', 'spans', 'k, side')}, l AS (SELECT k, side, e, lead(s) OVER (PARTITION BY k, side ORDER BY s, e) - e AS quiet FROM u) SELECT k, side, e + {HALF} AS "at", quiet AS silence FROM l WHERE quiet >= {HALF}""")
def end_of_turn_energy(spark, d):
    return tn.end_of_turn(iv.union(spans(spark, d), KS), KS, HALF, shift=True)


#: The stand-in's spans last minutes; a unit of ten minutes brings them to the seconds that the rules are made for.
UNIT = 600_000_000.0


def _turns(spark, d):
    return spans(spark, d).withColumn("n_words", (F.floor((F.col("end") - F.col("start")) / 120_000_000) + 1).cast("bigint")).withColumn("text", F.when(F.col("n_words") <= 1, "yeah").when(F.col("n_words") == 2, "uh huh").otherwise("and then we went on and on"))


TURNS = f"{SPANS}, t AS (SELECT *, n_words <= 1 AS one, CASE WHEN n_words <= 1 THEN 1.0::DOUBLE WHEN n_words = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lex, CASE WHEN n_words <= 2 THEN 1.0::DOUBLE WHEN n_words = 3 THEN 0.65::DOUBLE WHEN n_words = 4 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS short FROM (SELECT *, CAST(floor((e - s) / 120000000.0::DOUBLE) + 1 AS BIGINT) AS n_words FROM spans))"


def ss(a: float, b: float, x: str) -> str:
    t = f"least(greatest(({x} - {a}::DOUBLE) / {b - a!r}::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE)"
    return f"({t} * {t} * (3.0::DOUBLE - 2.0::DOUBLE * {t}))"


def u(x: str) -> str:
    return f"(({x}) / 600000000.0::DOUBLE)"


SEGMENTS = f"""{TURNS}, own AS (SELECT * FROM t WHERE side = 1), other AS (SELECT * FROM t WHERE side = 2),
held AS (SELECT a.k, a.s, a.e, max({u('least(a.e, b.e) - greatest(a.s, b.s)')} / greatest({u('a.e - a.s')}, 1e-9::DOUBLE) * (0.5::DOUBLE + 0.25::DOUBLE * {ss(0.0, 0.3, u('a.s - b.s'))} + 0.25::DOUBLE * {ss(0.0, 0.3, u('b.e - a.e'))})) AS held,
max(CASE WHEN b.s <= a.s AND a.s < b.e THEN least({ss(0.1, 0.4, u('a.s - b.s'))}, {ss(0.2, 0.6, u('b.e - a.s'))}) ELSE 0.0 END) AS onset FROM own a JOIN other b ON a.k = b.k AND a.s < b.e AND b.s < a.e GROUP BY ALL),
seg AS (SELECT o.*, coalesce(onset, 0.0) AS onset, least(greatest(coalesce(held, 0.0) * (0.55::DOUBLE * (1 - {ss(0.6, 2.0, u('o.e - o.s'))}) + 0.30::DOUBLE * short + 0.15::DOUBLE * lex), 0.0::DOUBLE), 1.0::DOUBLE) AS keep_playing FROM own o LEFT JOIN held h ON h.k = o.k AND h.s = o.s AND h.e = o.e)"""


def _segments(spark, d):
    x = _turns(spark, d)
    return tn.segment_hypotheses(x.where("side = 1").drop("side"), x.where("side = 2").drop("side"), K, BUCKET, UNIT)


@query(f'WITH {SEGMENTS} SELECT k, s AS "start", e AS "end", round(keep_playing, 6) AS keep_playing, round(1 - keep_playing, 6) AS turn, round(onset * (1 - keep_playing), 6) AS interruption FROM seg')
def segment_hypotheses(spark, d):
    return _segments(spark, d).select("k", "start", "end", *[F.round(c, 6).alias(c) for c in ("keep_playing", "turn", "interruption")])


CONNECT = f"""{SEGMENTS}, gaps AS (SELECT k, e AS a, lead(s) OVER (PARTITION BY k ORDER BY s, e) AS b FROM own), real AS (SELECT * FROM gaps WHERE b > a),
partner AS (SELECT g.k, g.a, g.b, max(1 - least(greatest(0.55::DOUBLE * (1 - {ss(0.5, 1.5, u('least(g.b, o.e) - greatest(g.a, o.s)'))}) + 0.30::DOUBLE * short + 0.15::DOUBLE * lex, 0.0::DOUBLE), 1.0::DOUBLE)) AS p FROM real g JOIN other o ON o.k = g.k AND o.s < g.b AND o.e > g.a GROUP BY ALL),
con AS (SELECT g.k, g.a, g.b, (1 - {ss(1.5, 2.5, f"greatest({u('g.b - g.a')}, 0.0::DOUBLE)")}) * (1 - coalesce(p, 0.0)) AS merge, {ss(0.08, 0.75, f"greatest({u('g.b - g.a')}, 0.0::DOUBLE)")} AS step FROM gaps g LEFT JOIN partner q ON q.k = g.k AND q.a = g.a AND q.b = g.b WHERE g.b IS NOT NULL)"""


def _connections(spark, d):
    x = _turns(spark, d)
    return tn.connection_hypotheses(x.where("side = 1").drop("side"), x.where("side = 2").drop("side"), K, BUCKET, UNIT)


@query(f'WITH {CONNECT} SELECT k, a AS "start", b AS "end", round(merge, 8) AS merge, round(step * merge, 8) AS pause FROM con')
def connection_hypotheses(spark, d):
    return _connections(spark, d).select("k", "start", "end", *[F.round(c, 8).alias(c) for c in ("merge", "pause")])


@query(f"""WITH {CONNECT}, l AS (SELECT *, lag(e) OVER w AS pe, lag(1 - keep_playing) OVER w AS pt FROM seg WINDOW w AS (PARTITION BY k ORDER BY s, e)),
m AS (SELECT l.*, CASE WHEN 1 - keep_playing >= 0.5 AND pt >= 0.5 AND coalesce(merge, 0) >= 0.5 THEN 0 ELSE 1 END AS fresh FROM l LEFT JOIN (SELECT k, a, b, max(merge) AS merge FROM con GROUP BY ALL) c ON c.k = l.k AND c.a = l.pe AND c.b = l.s),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT k, min(s) AS "start", max(e) AS "end", CAST(sum(n_words) AS BIGINT) AS n_words, count(*) AS n_turns FROM n WHERE 1 - keep_playing >= 0.5 GROUP BY k, run""")
def logical_turns(spark, d):
    return tn.logical_turns(_segments(spark, d), _connections(spark, d), K)


@query(f"""WITH {TURNS}, a AS (SELECT k, side, s, e, lag(side) OVER (PARTITION BY k ORDER BY s, e, side) AS p FROM t)
SELECT k, count(*) FILTER (side = 1) AS turns_1, count(*) FILTER (side = 2) AS turns_2, count(*) FILTER (p != side) AS alternations FROM a GROUP BY k""")
def conversation_annotation(spark, d):
    x = spans(spark, d)
    length = x.groupBy("k").agg((F.max("end") - F.min("start")).alias("duration"))
    return tn.conversation_annotation(x, length, K, "side", US).select("k", "turns_1", "turns_2", "alternations")


@query("""WITH t AS (SELECT conv_id AS k, turn, CASE role WHEN 'assistant' THEN 2 ELSE 1 END AS speaker, text FROM conversations),
c AS (SELECT k, turn, speaker, list(CASE WHEN x.s2 = speaker THEN 'user' ELSE 'assistant' END ORDER BY x.t2) AS roles FROM (SELECT a.k, a.turn, a.speaker, {'s2': b.speaker, 't2': b.turn} AS x FROM t a JOIN t b ON a.k = b.k AND b.turn BETWEEN a.turn - 2 AND a.turn) GROUP BY ALL)
SELECT k, turn, array_to_string(roles, ',') AS roles FROM c""")
def chat_context(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("k"), F.col("turn").alias("start"), F.col("turn").alias("end"), F.when(F.col("role") == "assistant", 2).otherwise(1).alias("speaker"), "text")
    return tn.chat_context(t, K, 3).select("k", F.col("start").alias("turn"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"))


WORDS = "w AS (SELECT conv_id, turn, regexp_extract(lower(x), '[a-z0-9]+(?:[-''][a-z0-9]+)*-?') AS token, n FROM (SELECT conv_id, turn, unnest(string_split_regex(text, '\\s+')) AS x, generate_subscripts(string_split_regex(text, '\\s+'), 1) AS n FROM conversations))"


@query(f"WITH {WORDS} SELECT token, count(*) AS n FROM w WHERE token != '' GROUP BY token")
def token_normalize(spark, d):
    return table(spark, d, "conversations").select(F.explode(tx.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"WITH {WORDS}, t AS (SELECT conv_id, turn, token, lag(token) OVER (PARTITION BY conv_id, turn ORDER BY n) AS p FROM w WHERE token != '') SELECT conv_id, turn, count(*) AS n FROM t WHERE token = p GROUP BY ALL")
def immediate_repetitions(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", tx.tokens(F.col("text")).alias("words"))
    return t.select("conv_id", "turn", F.size(tx.repetitions("words")).cast("bigint").alias("n")).where("n > 0")


@query(f"WITH {WORDS}, a AS (SELECT conv_id, token, count(*) AS n FROM w WHERE token != '' AND turn % 2 = 0 GROUP BY ALL), b AS (SELECT conv_id, token, count(*) AS m FROM w WHERE token != '' AND turn % 2 = 1 GROUP BY ALL) SELECT conv_id, CAST(sum(n) AS BIGINT) AS expected, CAST(sum(least(n, coalesce(m, 0))) AS BIGINT) AS recalled FROM a LEFT JOIN b USING (conv_id, token) GROUP BY conv_id")
def multiset_recall(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.explode(tx.tokens(F.col("text"))).alias("token"))
    return tx.multiset_recall(t.where("turn % 2 = 0"), t.where("turn % 2 = 1"), ["conv_id"], "token")


@query(f"""WITH {SPANS} SELECT k, s AS "start", e AS "end", 1 AS source FROM spans WHERE side = 1 UNION ALL SELECT k, s, e, 2 FROM spans b WHERE side = 2 AND NOT EXISTS (SELECT 1 FROM spans a WHERE a.side = 1 AND a.k = b.k AND a.s <= b.e AND a.e >= b.s)""")
def union_words_anti_overlap(spark, d):
    x = spans(spark, d).select("k", "start", "end", F.col("side").alias("source"))
    return tx.union_words(x.where("source = 1"), x.where("source = 2"), K, BUCKET)


@query()
def word_alignment_wer(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", tx.tokens(F.col("text")).alias("words"))
    a = c.where("turn % 2 = 0").select("conv_id", F.col("turn").alias("pair"), F.col("words").alias("reference"))
    b = c.where("turn % 2 = 1").select("conv_id", (F.col("turn") - 1).alias("pair"), F.col("words").alias("hypothesis"))
    return tx.with_alignment(a.join(b, ["conv_id", "pair"]), "reference", "hypothesis").select("conv_id", "pair", *[x.alias(n) for n, x in tx.error_counts("alignment").items()])


@query("SELECT conv_id, turn, length(text) / 10.0 AS duration, CAST(greatest(ceil((length(text) / 10.0 - 1) / 29), 1) AS BIGINT) AS n_chunks FROM conversations")
def chunk_windows(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", (F.length("text") / 10.0).alias("duration"))
    return t.withColumn("n_chunks", F.size(tx.chunk_windows(F.col("duration"))).cast("bigint"))


@query("SELECT vec_id, CAST(f AS INTEGER) AS frame, round(sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding[f * 10 + 1:f * 10 + 10]]) / 10), 6) AS rms FROM (SELECT vec_id, embedding, unnest(range(CAST(ceil(len(embedding) / 10.0) AS BIGINT))) AS f FROM embeddings)")
def frame_rms(spark, d):
    return fr.frame_rms(table(spark, d, "embeddings"), ["vec_id"], "embedding", 10).withColumn("rms", F.round("rms", 6))


@query("""WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT vec_id, i - 1 AS i, round(avg(v::DOUBLE) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS mean FROM x""")
def moving_average(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", F.col("i").cast("bigint").alias("i"), F.col("v").cast("double").alias("v"))
    return fr.centered_mean(x, ["vec_id"], "i", "v", 3).select("vec_id", "i", F.round("mean", 6).alias("mean"))


@query("SELECT vec_id, CAST(b AS INTEGER) AS bucket, list_min(embedding[b * 7 + 1:b * 7 + 7]) AS low, list_max(embedding[b * 7 + 1:b * 7 + 7]) AS high FROM (SELECT vec_id, embedding, unnest(range(10)) AS b FROM embeddings)")
def waveform_minmax(spark, d):
    return fr.waveform(table(spark, d, "embeddings"), ["vec_id"], "embedding", 10)


@query("""WITH x AS (SELECT vec_id, unnest(embedding) > 0 AS on_, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), m AS (SELECT *, CASE WHEN lag(on_) OVER (PARTITION BY vec_id ORDER BY i) = on_ THEN 0 ELSE 1 END AS fresh FROM x),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY vec_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT vec_id, on_ AS mask, CAST(min(i) AS INTEGER) AS first, CAST(max(i) AS INTEGER) AS last, count(*) AS length FROM n GROUP BY vec_id, run, on_""")
def rle_mask_segments(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", "i", (F.col("v") > 0).alias("mask"))
    return iv.runs(x, ["vec_id"], "i", ["mask"]).select("vec_id", "mask", "first", "last", "length")


@query("""WITH p AS (SELECT a.vec_id, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(corr(x, y), 6) AS correlation FROM p GROUP BY vec_id""")
def track_correlation(spark, d):
    e = table(spark, d, "embeddings")
    pair = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return fr.correlation(pair, "a", "b").select("vec_id", F.round("correlation", 6).alias("correlation"))


@query(f"""WITH {SPANS}, {union_sql('u', 'spans')}, f AS (SELECT event_id, user_id AS k, epoch_us(ts) AS t FROM events WHERE event_type = 'view'),
h AS (SELECT event_id, f.k, t, i, t + i * 3600000000 AS a, t + (i + 1) * 3600000000 AS b FROM f, (SELECT unnest(range(4)) AS i)),
c AS (SELECT h.event_id, h.i, h.a, h.b, sum(CASE WHEN u.s IS NOT NULL THEN least(h.b, u.e) - greatest(h.a, u.s) END) AS c FROM h LEFT JOIN u ON u.k = h.k AND u.s < h.b AND u.e > h.a GROUP BY ALL)
SELECT event_id, array_to_string(list(round(coalesce(c, 0)::DOUBLE / 3600000000.0::DOUBLE, 6)::DECIMAL(10, 6)::VARCHAR ORDER BY i), ',') AS occupancy FROM c GROUP BY event_id""")
def frame_future_occupancy(spark, d):
    hour = 3600 * 1_000_000
    f = table(spark, d, "events").where("event_type = 'view'").select("event_id", F.col("user_id").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("time"))
    o = fr.future_occupancy(f, spans(spark, d), ["k"], [(i * hour, (i + 1) * hour) for i in range(4)], BUCKET)
    return f.join(o, ["k", "time"]).select("event_id", F.array_join(F.transform("occupancy", lambda v: F.round(v, 6).cast("decimal(10,6)").cast("string")), ",").alias("occupancy"))


PAIRS_OF_TURNS = f"{WORDS}, l AS (SELECT conv_id, turn - turn % 2 AS pair, turn % 2 AS part, n, token, lag(token) OVER (PARTITION BY conv_id, turn ORDER BY n) AS p FROM w WHERE token != ''), ev AS (SELECT conv_id, pair, part, 'repetition' AS kind, token FROM l WHERE token = p UNION ALL SELECT conv_id, pair, part, 'partial', token FROM l WHERE token LIKE '%-' AND length(token) > 1)"


@query(f"""WITH {PAIRS_OF_TURNS}, k AS (SELECT DISTINCT a.conv_id, a.turn AS pair FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0), c AS (SELECT conv_id, pair, kind, token, count(*) FILTER (part = 0) AS a, count(*) FILTER (part = 1) AS b FROM ev GROUP BY ALL)
SELECT k.conv_id, k.pair, CAST(coalesce(sum(a) FILTER (kind = 'repetition'), 0) AS BIGINT) AS repetition_expected, CAST(coalesce(sum(b) FILTER (kind = 'repetition'), 0) AS BIGINT) AS repetition_found, CAST(coalesce(sum(least(a, b)) FILTER (kind = 'repetition'), 0) AS BIGINT) AS repetition_recalled, CAST(coalesce(sum(a) FILTER (kind = 'partial'), 0) AS BIGINT) AS partial_expected FROM k LEFT JOIN c ON c.conv_id = k.conv_id AND c.pair = k.pair GROUP BY k.conv_id, k.pair""")
def disfluency_recall(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", tx.tokens(F.col("text")).alias("words"))
    a = c.where("turn % 2 = 0").select("conv_id", F.col("turn").alias("pair"), F.col("words").alias("reference"))
    b = c.where("turn % 2 = 1").select("conv_id", (F.col("turn") - 1).alias("pair"), F.col("words").alias("hypothesis"))
    return tx.disfluencies(a.join(b, ["conv_id", "pair"]), "reference", "hypothesis").select("conv_id", "pair", "repetition_expected", "repetition_found", "repetition_recalled", "partial_expected")


@query("""WITH p AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS id, l_quantity::DOUBLE AS rs, CASE WHEN l_linenumber % 3 > 0 THEN l_quantity + l_discount END::DOUBLE AS s, l_quantity + 1::DOUBLE AS re, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity + 1 + l_tax END::DOUBLE AS e FROM lineitem),
m AS (SELECT *, coalesce(greatest(abs(s - rs), abs(e - re)), 0.0) AS largest FROM p) SELECT k, place, round(largest, 9) AS largest FROM (SELECT k, largest, row_number() OVER (PARTITION BY k ORDER BY largest DESC, rs, re, s, e) AS place FROM m) WHERE place <= 25""")
def largest_timestamp_errors(spark, d):
    i = table(spark, d, "lineitem")
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber")
    x = i.select(F.col("l_suppkey").alias("k"), q.alias("ref_start"), F.when(n % 3 > 0, q + F.col("l_discount")).alias("start"), (q + 1).alias("ref_end"), F.when(n % 2 == 0, q + 1 + F.col("l_tax")).alias("end"))
    return tx.largest_errors(x, ["k"]).select("k", F.col("place").cast("bigint").alias("place"), F.round("largest", 9).alias("largest"))


@query("""WITH d AS (SELECT doc_id, coalesce(n_chars, 0) / 100.0::DOUBLE AS t FROM documents) SELECT doc_id, CAST(i AS INTEGER) AS i, round(CASE WHEN t > 8 THEN (t - 8) * i / 8 ELSE 0.0 END, 6) AS "start", round(least(t, 8.0), 6) AS length FROM (SELECT *, unnest(range(CASE WHEN t > 8 THEN 9 ELSE 1 END)) AS i FROM d)""")
def probe_windows(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.posexplode(tx.probe_windows(F.coalesce("n_chars", F.lit(0)) / F.lit(100.0))).alias("i", "w"))
    return t.select("doc_id", "i", F.round("w.start", 6).alias("start"), F.round("w.length", 6).alias("length"))


@query("""WITH x AS (SELECT l_orderkey AS k, l_linenumber AS s, -l_quantity * 1.5::DOUBLE AS db FROM lineitem) SELECT k, s AS "start", round(db, 6) AS db FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY db DESC, s) AS n FROM x WHERE db >= -55) WHERE n <= 3""")
def active_probe_windows(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("start"), (-F.col("l_quantity") * F.lit(1.5)).alias("db"))
    return tx.active_windows(x, ["k"]).select("k", "start", F.round("db", 6).alias("db"))


CONTEXT = f"""{TURNS}, tx AS (SELECT *, CASE WHEN n_words <= 1 THEN 'yeah' WHEN n_words = 2 THEN 'uh huh' ELSE 'and then we went on and on' END AS said FROM t),
cx AS (SELECT *, lag(side) OVER w AS ps, lead(side) OVER w AS ns, lag(e) OVER w AS pe, lead(s) OVER w AS nst FROM tx WINDOW w AS (PARTITION BY k ORDER BY s, e, side)),
co AS (SELECT c.*, (SELECT arg_max(o.e, {{'a': o.s, 'b': o.e}}) FROM tx o WHERE o.k = c.k AND o.side != c.side AND (o.s, o.e, o.side) < (c.s, c.e, c.side)) AS poe, (SELECT arg_min(o.s, {{'a': o.s, 'b': o.e}}) FROM tx o WHERE o.k = c.k AND o.side != c.side AND (o.s, o.e, o.side) > (c.s, c.e, c.side)) AS nos FROM cx c),
cl AS (SELECT *, n_words <= 2 AND e - s <= 720000000 AND NOT coalesce(CASE WHEN ps = side THEN s - pe <= 900000000 ELSE ns = side AND nst - e <= 900000000 END, false) AND coalesce(s - poe <= 300000000, false) OR (n_words <= 2 AND e - s <= 720000000 AND NOT coalesce(CASE WHEN ps = side THEN s - pe <= 900000000 ELSE ns = side AND nst - e <= 900000000 END, false) AND coalesce(nos - e <= 900000000, false)) AS bc, coalesce(poe - s >= 60000000, false) AS cut FROM co)"""


def _contextual(spark, d):
    return tn.contextual(_turns(spark, d).withColumnRenamed("side", "speaker"), K, unit=UNIT)


@query(f'WITH {CONTEXT} SELECT k, side AS speaker, s AS "start", e AS "end", bc AS backchannel, cut AS interruption FROM cl')
def contextual_turns(spark, d):
    return _contextual(spark, d).select("k", "speaker", "start", "end", "backchannel", "interruption")


@query(f"""WITH {SPANS}, {union_sql('un', 'spans', 'k, side')}, l AS (SELECT k, side, e, lead(s) OVER (PARTITION BY k, side ORDER BY s, e) - e AS quiet FROM un) SELECT 'silence' AS detector, k, side, e AS "at", quiet AS silence FROM l WHERE quiet >= {HALF} UNION ALL SELECT 'delayed_silence', k, side, e + {HALF}, quiet FROM l WHERE quiet >= {HALF}""")
def detector_registry(spark, d):
    return tn.run_detectors(["silence", "delayed_silence"], iv.union(spans(spark, d), KS), KS, silence=HALF)
