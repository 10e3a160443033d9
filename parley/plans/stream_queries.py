"""Queries of the live session: policy, revisions, and streams run over what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parley.operators import text as tx
from parley.plans.registry import query, stream, table
from parley.streaming import evidence, jobs, policy, replies, turns

SAID = {"view": "", "click": "Yeah.", "purchase": "wait, no", "signup": "haha", "error": "okay, and then", "search": "right so the plan", "login": "who is it", "logout": "that's not it"}


@query(f"""WITH e AS (SELECT event_id, event_type AS kind, CAST(event_id % 8 * 100 AS INTEGER) AS elapsed, event_id % 3 != 0 AS active, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in SAID.items())} ELSE 'the train leaves' END AS text, CASE WHEN event_id % 5 > 0 THEN (event_id * 7 % 100) / 100.0 END AS p FROM events)
SELECT event_id, CASE WHEN p >= 0.7 THEN 'floor_taking:predicted_interruption' WHEN text IN ('wait, no', 'that''s not it') THEN 'response_required:explicit_stop_or_repair' WHEN text = 'who is it' THEN 'response_required:question' WHEN text = 'okay, and then' THEN 'floor_taking:acknowledgement_continuation' WHEN text = 'right so the plan' THEN 'floor_taking:meaningful_lexical_material'
WHEN text = 'Yeah.' AND NOT active THEN 'non_floor_taking:closed_acknowledgement' WHEN text = 'haha' AND NOT active THEN 'non_floor_taking:short_laughter' WHEN text NOT IN ('', 'Yeah.', 'haha') THEN 'response_required:meaningful_lexical_material'
WHEN active AND elapsed >= 500 THEN 'floor_taking:speech_duration_deadline' WHEN NOT active THEN 'non_floor_taking:acoustic_burst_ended' ELSE 'unresolved:awaiting_more_evidence' END AS decision FROM e""")
def overlap_policy_rules(spark, d):
    said = F.create_map(*[F.lit(x) for kv in SAID.items() for x in kv])
    e = table(spark, d, "events").withColumn("text", F.coalesce(said[F.col("event_type")], F.lit("the train leaves")))
    p = F.when(F.col("event_id") % 5 > 0, (F.col("event_id") * 7 % 100) / F.lit(100.0))
    out = policy.classify((F.col("event_id") % 8 * 100).cast("int"), F.col("event_id") % 3 != 0, F.col("text"), p)
    return e.select("event_id", F.concat_ws(":", out["kind"], out["reason"]).alias("decision"))


@query("""WITH o AS (SELECT user_id AS k, CASE WHEN event_id % 4 = 0 THEN 'non_floor_taking' WHEN event_id % 4 < 3 THEN 'floor_taking' END AS kind, CAST(round(value * 1000) AS BIGINT) * 1000000 AS t FROM events)
, v AS (SELECT k, list_sort(list(t / 1e6) FILTER (kind = 'non_floor_taking')) AS a, list_sort(list(t / 1e6) FILTER (kind = 'floor_taking')) AS b, count(*) AS n, count(*) FILTER (kind = 'non_floor_taking') AS n_a, count(*) FILTER (kind = 'floor_taking') AS n_b FROM o GROUP BY k)
SELECT k, n AS n_overlaps, n_a AS n_cooperative, n_b AS n_competitive, a[greatest(1, CAST(ceil(0.95::DOUBLE * n_a) AS INTEGER))]::DOUBLE AS cooperative_p95_ms, b[greatest(1, CAST(ceil(0.95::DOUBLE * n_b) AS INTEGER))]::DOUBLE AS competitive_p95_ms FROM v""")
def overlap_metrics(spark, d):
    at = F.round(F.col("value") * 1000).cast("bigint") * 1_000_000
    none = F.lit(None).cast("bigint")
    kind = F.when(F.col("event_id") % 4 == 0, "non_floor_taking").when(F.col("event_id") % 4 < 3, "floor_taking")
    o = table(spark, d, "events").select(F.col("user_id").alias("k"), kind.alias("kind"), F.lit(0).cast("bigint").alias("onset"), at.alias("decision"), *[none.alias(c) for c in ("duck", "pause", "cancel", "resume", "paused_at")], F.lit(True).alias("fast_path"), F.lit(1).alias("samples"))
    return policy.overlap_metrics(o, ["k"]).select("k", "n_overlaps", "n_cooperative", "n_competitive", "cooperative_p95_ms", "competitive_p95_ms")


@query(r"""WITH r AS (SELECT conv_id, turn, text, regexp_replace(text, '\S+\s*$', 'and on') AS p FROM conversations),
c AS (SELECT *, CASE WHEN p = text THEN length(text) ELSE coalesce((SELECT min(i) - 1 FROM (SELECT unnest(range(1, least(length(p), length(text)) + 1)) AS i) WHERE substr(p, i, 1) != substr(text, i, 1)), least(length(p), length(text))) END AS n FROM r)
SELECT conv_id, turn, CASE WHEN p = text THEN text ELSE regexp_extract(substr(text, 1, n), '(?s)^.*[\s.,!?;:]') END AS stable FROM c""")
def revision_stable_prefix(spark, d):
    """Of every turn's whole text against a revision with another last word."""
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", tx.stable_prefix(F.regexp_replace("text", r"\S+\s*$", "and on"), F.col("text")).alias("stable"))


def _event_stream(spark, d):
    return stream(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))


#: Key of the row that ends a stream.
ENDED = -1


def _end() -> dict:
    """Event time and key of the row that ends a stream."""
    return {"ts": F.lit("2100-01-01").cast("timestamp"), "user_id": F.lit(ENDED)}


@query("""WITH s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS r FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events))
SELECT user_id, epoch_us(min(ts)) AS "start", epoch_us(max(ts)) AS "last", count(*) AS n FROM s GROUP BY user_id, r""")
def stream_sessions(spark, d):
    out = jobs.run_to_end(lambda e: jobs.stream_sessions(e, ["user_id"], "ts", "30 minutes", "1 hour"), _event_stream(spark, d), _end(), f"sessions_{uuid.uuid4().hex}")
    return out.where(F.col("user_id") != ENDED).select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("last").alias("last"), "n")


@query("""SELECT concat_ws(':', user_id, strftime(date_trunc('day', ts), '%Y-%m-%d')) AS "group", least(max(value) FILTER (event_type = 'view'), max(value) FILTER (event_type = 'click'), max(value) FILTER (event_type = 'error')) AS confidence FROM events GROUP BY user_id, date_trunc('day', ts)
HAVING count(DISTINCT CASE WHEN event_type IN ('view', 'click', 'error') AND value IS NOT NULL THEN event_type END) = 3""")
def stream_evidence_join(spark, d):
    kinds = ["view", "click", "error"]

    def groups(e):
        x = e.where(F.col("event_type").isin(*kinds)).withColumn("day", F.date_trunc("day", "ts"))
        return jobs.complete_evidence(x.withColumn("group", F.concat_ws(":", "user_id", F.date_format("day", "yyyy-MM-dd"))), "group", "event_type", kinds, "value", "day", "1 hour")

    return jobs.run_to_end(groups, _event_stream(spark, d), _end() | {"event_type": F.lit("view")}, f"evidence_{uuid.uuid4().hex}").select("group", "confidence")


def _chunks(events):
    c = F.col
    said = c("event_id") % 4 == 0
    p = lambda i: F.when(said, c("event_id") * i % 10 / F.lit(10.0))
    return events.select(c("user_id").cast("string").alias("session"), c("event_id").alias("seq"), (160 * (1 + c("event_id") % 30)).cast("bigint").alias("samples"), (c("event_id") * 7 % 10 < 3).alias("speech"), p(1).alias("confidence"), (p(3) + 0.15).alias("p_yield"), p(7).alias("p_speech"), "ts")


#: Chunk by chunk, as the live session goes.
LIVE_TURNS = """WITH RECURSIVE c AS (SELECT user_id::VARCHAR AS session, event_id AS seq, 160 * (1 + event_id % 30) AS n, event_id * 7 % 10 < 3 AS speech, event_id % 4 = 0 AND (event_id % 10) / 10.0::DOUBLE >= 0.7 AS sure, (event_id * 3 % 10) / 10.0::DOUBLE + 0.15 >= 0.9 AS yields, (event_id * 7 % 10) / 10.0::DOUBLE >= 0.65 AS hold, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, (sum(160 * (1 + event_id % 30)) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS stop FROM events),
t AS (SELECT session, 0::BIGINT AS i, false AS talks, 0 AS epoch, 0::BIGINT AS spoke, 0::BIGINT AS first_stop, 0::BIGINT AS free, 0::BIGINT AS quiet, 0 AS n_speech, NULL::VARCHAR AS reason, 0::BIGINT AS stop FROM c WHERE i = 1
UNION ALL SELECT t.session, c.i, CASE WHEN NOT was THEN speech ELSE ended IS NULL END, CASE WHEN t.reason IS NOT NULL THEN epoch + 1 ELSE epoch END, CASE WHEN NOT was AND speech THEN c.stop - n ELSE spoke END, CASE WHEN NOT was AND speech THEN c.stop ELSE first_stop END, CASE WHEN t.reason IS NOT NULL THEN t.stop ELSE free END, CASE WHEN speech THEN 0 ELSE quiet + n END, CASE WHEN NOT was THEN speech::INTEGER ELSE n_speech + speech::INTEGER END, CASE WHEN was THEN ended END, c.stop
FROM (SELECT t.*, t.talks AS was FROM t) t JOIN (SELECT c.*, NULL AS x FROM c) c ON c.session = t.session AND c.i = t.i + 1, LATERAL (SELECT CASE WHEN speech THEN NULL WHEN sure AND yields THEN 'prediction' WHEN quiet + n >= 8000 AND NOT (sure AND hold) THEN 'silence' END AS ended)),
o AS (SELECT session, epoch, spoke, first_stop, free, stop AS over, n_speech, reason FROM t WHERE reason IS NOT NULL UNION ALL SELECT session, epoch, spoke, first_stop, free, stop, n_speech, 'end' FROM t JOIN (SELECT session, max(i) AS i FROM c GROUP BY session) m USING (session, i) WHERE talks)
SELECT session, epoch, coalesce((SELECT min(c.stop - c.n) FROM c WHERE c.session = o.session AND c.stop - c.n >= free AND c.stop - c.n <= spoke AND first_stop - (c.stop - c.n) <= 4800), first_stop) AS start_sample, spoke AS speech_sample, over AS end_sample, n_speech, reason FROM o"""


@query(LIVE_TURNS)
def live_turns(spark, d):
    """Turns by the stateful operator, the open ones ended by its timer."""
    out = jobs.run_to_end(lambda e: turns.stream_turns(_chunks(e).withColumnRenamed("ts", "at")), _event_stream(spark, d), _end() | {"event_id": F.lit(1)}, f"turns_{uuid.uuid4().hex}", rocks=True)
    return out.where(F.col("session") != str(ENDED))


@query(LIVE_TURNS)
def batch_turns(spark, d):
    return turns.batch_turns(_chunks(table(spark, d, "events")))


def _evidence(events):
    """Each event is a chunk and the four kinds of evidence about it; some come late, about another sample, without a value, or cite nothing."""
    c = F.col
    i, late = c("event_id"), F.when(c("event_id") % 7 == 0, c("event_id") % 5 * 40).otherwise(0)
    row = lambda k, kind, seq, sample, playback, p: F.struct(F.lit(kind).alias("kind"), (seq * 8 + k).alias("seq"), sample.alias("sample"), playback.alias("playback"), p.alias("p"))
    at = i * 10
    none = F.lit(None).cast("string")
    own = F.concat(F.lit("p"), i)
    rows = F.array(
        row(0, "chunk", i, at, own, F.lit(None).cast("double")),
        row(1, "yield", i, at, F.when(i % 19 == 0, "other").when(i % 17 > 0, own), i % 100 / 100.0),
        row(2, "future", i, at, none, F.lit(0.5)),
        row(3, "turn", i, at + F.when(i % 11 == 0, 1).otherwise(0), none, i % 50 / 100.0),
        row(F.when(late > 0, 5).otherwise(4), "overlap", i + late, at, none, F.when(i % 13 > 0, i % 20 / 100.0)),
    )
    x = events.select(c("user_id").cast("string").alias("session"), F.lit(1).alias("stream_epoch"), F.floor(i / 2000).cast("int").alias("turn_epoch"), i.cast("string").alias("group_id"), i.alias("_i"), F.explode(rows).alias("r"))
    return x.select("session", "r.seq", "r.kind", "stream_epoch", "turn_epoch", "r.sample", "group_id", "r.playback", "r.p", (1 - F.coalesce("r.p", F.lit(0.0))).alias("p_speech"), ((c("r.seq") % 64) / 64.0).alias("confidence"))


EVIDENCE = """WITH b AS (SELECT user_id::VARCHAR AS session, event_id AS i, event_id // 2000 AS ep, event_id * 10 AS pos, CASE WHEN event_id % 7 = 0 THEN event_id % 5 * 40 ELSE 0 END AS late FROM events),
ev AS (SELECT session, i, ep, i * 8 AS seq, 0 AS kind, pos AS sample, NULL::DOUBLE AS p FROM b UNION ALL SELECT session, i, ep, i * 8 + 1, 1, pos, i % 100 / 100.0::DOUBLE FROM b UNION ALL SELECT session, i, ep, i * 8 + 2, 2, pos, 0.5::DOUBLE FROM b UNION ALL SELECT session, i, ep, i * 8 + 3, 3, pos + (i % 11 = 0)::INTEGER, i % 50 / 100.0::DOUBLE FROM b UNION ALL SELECT session, i, ep, (i + late) * 8 + 4 + (late > 0)::INTEGER, 4, pos, CASE WHEN i % 13 > 0 THEN i % 20 / 100.0::DOUBLE END FROM b),
la AS (SELECT *, last_value(CASE WHEN kind = 0 THEN sample END IGNORE NULLS) OVER w AS cs, last_value(CASE WHEN kind = 0 THEN ep END IGNORE NULLS) OVER w AS ce FROM ev WINDOW w AS (PARTITION BY session ORDER BY seq)),
va AS (SELECT *, ep = ce AND sample >= greatest(0, cs - 1600) AS ok FROM la WHERE kind > 0), gr AS (SELECT *, first_value(CASE WHEN ok THEN sample END IGNORE NULLS) OVER (PARTITION BY session, i ORDER BY seq) AS gs FROM va),
me AS (SELECT *, CASE WHEN NOT ok THEN 'stale' WHEN sample != gs THEN 'inconsistent' ELSE 'member' END AS state FROM gr), fu AS (SELECT session, i, max(seq) AS seq, max(p) FILTER (kind = 1) AS y, max(p) FILTER (kind = 3) AS bc, max(p) FILTER (kind = 4) AS it, min(seq % 64 / 64.0::DOUBLE) AS conf FROM me WHERE state = 'member' GROUP BY session, i HAVING count(*) = 4),
ou AS (SELECT *, CASE WHEN i % 19 > 0 AND i % 17 = 0 THEN 'uncited' WHEN it IS NULL THEN 'incomplete' WHEN i % 19 = 0 THEN 'unknown_playback' ELSE 'predicted' END AS outcome FROM fu)
SELECT session, seq, i::VARCHAR AS group_id, outcome, CASE WHEN outcome = 'predicted' THEN 1 - y END AS p_speech, CASE WHEN outcome = 'predicted' THEN y END AS p_yield, CASE WHEN outcome = 'predicted' THEN bc END AS p_backchannel, CASE WHEN outcome = 'predicted' THEN it END AS p_interruption, CASE WHEN outcome = 'predicted' THEN 'p' || i END AS playback, CASE WHEN outcome = 'predicted' THEN conf END AS confidence FROM ou
UNION ALL SELECT session, seq, i::VARCHAR, state, NULL, NULL, NULL, NULL, NULL, NULL FROM me WHERE state != 'member'"""


@query(EVIDENCE)
def evidence_predictions(spark, d):
    return evidence.batch_predictions(_evidence(table(spark, d, "events")))


@query(EVIDENCE)
def stream_predictions(spark, d):
    return jobs.run_once(evidence.stream_predictions(_evidence(_event_stream(spark, d))), f"predictions_{uuid.uuid4().hex}")


@query()
def stream_revisions(spark, d):
    c = stream(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("seq"), "text")
    return jobs.run_once(jobs.stream_revisions(c), f"revisions_{uuid.uuid4().hex}")


def _pieces(c):
    """Every turn as a reply in pieces of eleven characters; two in three call a tool, well or badly."""
    call = F.format_string('<tool_call>{"name": "find", "arguments": {"turn": %d}}</tool_call>', "turn")
    tail = F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 5 == 0, F.substr(call, F.lit(1), F.lit(20))).when(F.col("turn") % 7 == 0, F.concat(call, call)).when(F.col("turn") % 4 == 0, F.concat(call, F.lit(" and more"))).otherwise(F.concat(call, F.lit(" ")))
    whole = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), tail)
    n = F.greatest(F.lit(1), F.ceil(F.length("whole") / 11)).cast("int")
    x = c.select(F.concat_ws(":", "conv_id", "turn").alias("session"), whole.alias("whole")).withColumn("n", n).withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return x.select("session", F.col("seq").cast("bigint").alias("seq"), F.substr("whole", F.col("seq") * 11 + 1, F.lit(11)).alias("delta"), (F.col("seq") == F.col("n") - 1).alias("final"))


#: Of whole texts: words and what parts them, and what each kind of tail must give.
REPLIES = r"""WITH c AS (SELECT conv_id || ':' || turn AS session, turn, regexp_extract_all(coalesce(text, ''), '\S+') AS w, string_split_regex(coalesce(text, ''), '\S+') AS g FROM conversations),
u AS (SELECT session, turn, len(w) AS n, unnest(w) AS t, unnest(g[:len(w)]) AS before, generate_subscripts(w, 1) AS i FROM c), p AS (SELECT *, (sum(length(before) + length(t)) OVER (PARTITION BY session ORDER BY i ROWS UNBOUNDED PRECEDING))::INTEGER AS stop FROM u),
e AS (SELECT session, turn, len(w) AS n FROM c WHERE turn % 3 != 0)
SELECT session, (i - 1)::INTEGER AS number, 'word' AS kind, t AS text, (stop - length(t))::INTEGER AS "start", stop AS "end", NULL::VARCHAR AS name, NULL::VARCHAR AS arguments, NULL::VARCHAR AS reason FROM p
UNION ALL SELECT session, n::INTEGER, 'failed', NULL, NULL, NULL, NULL, NULL, 'incomplete_call' FROM e WHERE turn % 5 = 0
UNION ALL SELECT session, n::INTEGER, 'call', NULL, NULL, NULL, 'find', '{"turn":' || turn || '}', NULL FROM e WHERE turn % 5 != 0
UNION ALL SELECT session, n::INTEGER + 1, 'failed', NULL, NULL, NULL, 'find', NULL, 'duplicate_call' FROM e WHERE turn % 5 != 0 AND turn % 7 = 0
UNION ALL SELECT session, n::INTEGER + 1, 'failed', NULL, NULL, NULL, NULL, NULL, 'unexpected_content' FROM e WHERE turn % 5 != 0 AND turn % 7 != 0 AND turn % 4 = 0"""


@query(REPLIES)
def reply_events(spark, d):
    return replies.batch_replies(_pieces(table(spark, d, "conversations")))


@query(REPLIES)
def stream_replies(spark, d):
    c = stream(spark, d, "conversations")
    return jobs.run_once(replies.stream_replies(_pieces(c)), f"replies_{uuid.uuid4().hex}")
