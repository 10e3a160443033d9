"""Reads over several relations of the catalogue: customers stand for samples, nations for datasets, orders for results, lineitems for the rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import reads
from parley.plans.registry import query, table


def _samples(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("sample"), F.col("c_nationkey").alias("dataset"), F.col("c_name").alias("external"), F.when(F.col("c_custkey") % 9 > 0, F.abs("c_acctbal")).alias("duration"), (F.col("c_custkey") % 13 == 0).alias("unusable"))


def _quality(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(F.col("o_custkey").alias("sample"), k.alias("result"), F.col("o_orderdate").cast("date").alias("created"), F.when(k % 4 == 0, "m1").otherwise("m2").alias("metric"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"), F.when(k % 5 == 0, "a1").otherwise("a2").alias("annotation"), F.col("o_totalprice").alias("score"), (k % 9000).cast("double").alias("analyzed"))


def _regions(spark, d):
    return _samples(spark, d).where("sample % 3 > 0").select("sample", (F.col("sample") * 10).alias("region"), F.lit("r1").alias("analysis"), F.when(F.col("sample") % 2 == 0, "a1").otherwise("a2").alias("annotation"), F.concat(F.lit("regions "), F.col("sample").cast("string")).alias("payload"))


def _exclusions(spark, d):
    i = table(spark, d, "lineitem")
    return i.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("sample"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_quantity") >= 49, "recording").otherwise("interval").alias("scope"), F.col("l_linenumber").cast("double").alias("start"), (F.col("l_linenumber") + F.col("l_quantity")).cast("double").alias("end"))


def _tracks(spark, d):
    s = _samples(spark, d).where("sample % 17 > 0")
    sides = F.explode(F.when(F.col("sample") % 19 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))).alias("side")
    return s.select("sample", sides).select("sample", "side", (F.col("sample") * 2 + F.col("side")).alias("track"), (F.col("sample") % 4).cast("string").alias("sha"))


def _made(spark, d):
    i = table(spark, d, "lineitem")
    text = F.concat(F.lit("t"), F.col("l_partkey").cast("string"))
    track = F.col("l_suppkey") * 2 + 1 + F.col("l_linenumber") % 2
    return i.select(track.alias("track"), (F.col("l_orderkey") % 4).cast("string").alias("sha"), F.col("l_shipdate").cast("date").alias("updated"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("result"), F.concat(F.lit("m"), (F.col("l_orderkey") % 3).cast("string")).alias("model"), F.when(F.col("l_linenumber") == 7, "broken").alias("error"), text.alias("text"), text.alias("payload"))


SAMPLES = "smp AS (SELECT c_custkey AS sample, c_nationkey AS dataset, c_name AS external, CASE WHEN c_custkey % 9 > 0 THEN abs(c_acctbal) END AS duration, c_custkey % 13 = 0 AS unusable FROM customer)"
QUALITY = "qua AS (SELECT o_custkey AS sample, o_orderkey AS result, o_orderdate::DATE AS created, CASE WHEN o_orderkey % 4 = 0 THEN 'm1' ELSE 'm2' END AS metric, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'a1' ELSE 'a2' END AS annotation, o_totalprice AS score, (o_orderkey % 9000)::DOUBLE AS analyzed FROM orders)"
REGIONS = "reg AS (SELECT sample, sample * 10 AS region, CASE WHEN sample % 2 = 0 THEN 'a1' ELSE 'a2' END AS annotation, 'regions ' || sample AS payload FROM smp WHERE sample % 3 > 0)"
EXCLUSIONS = "exc AS (SELECT l_suppkey AS sample, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_quantity >= 49 THEN 'recording' ELSE 'interval' END AS scope, l_linenumber::DOUBLE AS s FROM lineitem WHERE l_returnflag = 'R')"
TRACKS = "trk AS (SELECT sample, side, sample * 2 + side AS track, (sample % 4)::VARCHAR AS sha FROM smp, (VALUES (1), (2)) t(side) WHERE sample % 17 > 0 AND (side = 1 OR sample % 19 > 0))"
MADE = "made AS (SELECT l_suppkey * 2 + 1 + l_linenumber % 2 AS track, (l_orderkey % 4)::VARCHAR AS sha, l_shipdate::DATE AS updated, l_orderkey * 10 + l_linenumber AS result, 'm' || (l_orderkey % 3) AS model, CASE WHEN l_linenumber = 7 THEN 'broken' END AS error, 't' || l_partkey AS text FROM lineitem)"
BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY created DESC, result DESC) AS n FROM qua WHERE metric = 'm2' AND status = 'completed' AND annotation = 'a2') WHERE n = 1)"


@query(f"""WITH {SAMPLES}, {QUALITY}, {REGIONS}, {EXCLUSIONS}, {BEST} SELECT s.dataset, n_name AS name, s.sample, external, least(coalesce(duration, analyzed), analyzed) AS seconds, score, payload AS regions, coalesce((SELECT string_agg(id::VARCHAR, ',' ORDER BY s, id) FROM exc WHERE exc.sample = s.sample AND scope = 'interval'), '') AS intervals
FROM smp s JOIN nation ON n_nationkey = s.dataset JOIN best USING (sample) LEFT JOIN reg ON reg.sample = s.sample AND reg.annotation = 'a2' WHERE s.dataset < 20 AND NOT unusable AND score > 1000 AND NOT EXISTS (SELECT 1 FROM exc WHERE exc.sample = s.sample AND scope = 'recording')""")
def audit_evidence(spark, d):
    datasets = table(spark, d, "nation").select(F.col("n_nationkey").alias("dataset"), F.col("n_name").alias("name"))
    x = reads.audit_evidence(_samples(spark, d), datasets, _quality(spark, d), _regions(spark, d), _exclusions(spark, d), F.col("dataset") < 20, "m2", "a2", "r1", 1000.0)
    return x.withColumn("intervals", F.array_join(F.transform("intervals", lambda i: i["id"].cast("string")), ","))


@query(f"""WITH {SAMPLES}, {QUALITY}, {TRACKS}, {MADE}, {BEST}, act AS (SELECT * FROM (SELECT sample, side, text, row_number() OVER (PARTITION BY sample, side ORDER BY updated DESC, made.result DESC) AS n FROM made JOIN trk ON trk.track = made.track AND trk.sha = made.sha) WHERE n = 1)
SELECT s.sample, external, least(coalesce(duration, analyzed), analyzed) AS seconds, result, a.text AS activity_1, b.text AS activity_2 FROM smp s JOIN best USING (sample) JOIN act a ON a.sample = s.sample AND a.side = 1 JOIN act b ON b.sample = s.sample AND b.side = 2""")
def region_evidence(spark, d):
    return reads.region_evidence(_samples(spark, d), _tracks(spark, d), _quality(spark, d), _made(spark, d), "m2", "a2")


FOUND = f"{SAMPLES}, {TRACKS}, {MADE}, tr AS (SELECT * FROM (SELECT sample, side, model, made.result, text, row_number() OVER (PARTITION BY sample, side, model ORDER BY updated DESC, made.result DESC) AS n FROM made JOIN trk ON trk.track = made.track AND trk.sha = made.sha WHERE model IN ('m1', 'm2') AND error IS NULL) WHERE n = 1)"


@query(f"WITH {FOUND} SELECT sample, external, side, model, result, text FROM tr JOIN smp USING (sample)")
def latest_transcripts(spark, d):
    return reads.transcripts(_samples(spark, d), _tracks(spark, d), _made(spark, d), ["m1", "m2"])


@query(f"WITH {FOUND} SELECT sample FROM (SELECT DISTINCT sample, side, model FROM tr) GROUP BY sample HAVING count(*) = 4")
def samples_with_all_transcripts(spark, d):
    return reads.complete_samples(reads.transcripts(_samples(spark, d), _tracks(spark, d), _made(spark, d), ["m1", "m2"]), ["m1", "m2"])


@query("SELECT o_custkey AS sample, o_orderkey AS prediction FROM orders WHERE o_orderpriority = '1-URGENT' AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = o_custkey)")
def unreviewed_predictions(spark, d):
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("sample"), F.col("o_orderkey").alias("prediction"), F.col("o_orderpriority").alias("version"))
    return reads.unreviewed(p, table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample")), "1-URGENT").select("sample", "prediction")


@query(f"WITH {SAMPLES}, {TRACKS} SELECT s.sample, external, a.track AS track_1, b.track AS track_2 FROM smp s JOIN trk a ON a.sample = s.sample AND a.side = 1 JOIN trk b ON b.sample = s.sample AND b.side = 2")
def registered_samples(spark, d):
    return reads.registered(_samples(spark, d), _tracks(spark, d))


@query(f"""WITH {SAMPLES}, {QUALITY}, {REGIONS}, {TRACKS}, it AS (SELECT o_orderkey AS item, o_custkey AS sample, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey - 7 END AS replaces, o_orderkey AS result, o_totalprice + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS score, o_custkey * 10 AS region, (o_custkey % 4)::VARCHAR AS sha_1, (CASE WHEN o_orderkey % 6 = 0 THEN 9 ELSE o_custkey % 4 END)::VARCHAR AS sha_2, CASE WHEN o_orderkey % 4 = 0 THEN 'm1' ELSE 'm2' END AS metric, CASE WHEN o_orderkey % 5 = 0 THEN 'a1' ELSE 'a2' END AS annotation, o_orderpriority AS decision FROM orders)
SELECT i.item, i.sample, external, decision, replaces, (SELECT max(j.item) FROM it j WHERE j.replaces = i.item) AS replaced_by, NOT unusable AND coalesce(sha_1 = (SELECT sha FROM trk WHERE trk.sample = i.sample AND side = 1) AND sha_2 = (SELECT sha FROM trk WHERE trk.sample = i.sample AND side = 2), false)
AND coalesce((SELECT arg_max({{'r': q.result, 'p': q.score}}, {{'c': created, 'r': q.result}}) FROM qua q WHERE q.sample = i.sample AND status = 'completed' AND q.metric = i.metric AND q.annotation = i.annotation) = {{'r': i.result, 'p': i.score}}, false) AND EXISTS (SELECT 1 FROM reg WHERE reg.sample = i.sample AND reg.region = i.region AND reg.annotation = i.annotation) AS current FROM it i JOIN smp USING (sample)""")
def review_items(spark, d):
    k = F.col("o_orderkey")
    items = table(spark, d, "orders").select(k.alias("item"), F.col("o_custkey").alias("sample"), F.when(k % 7 == 0, k - 7).alias("replaces"), k.alias("result"), (F.col("o_totalprice") + F.when(k % 11 == 0, 1).otherwise(0)).alias("score"), (F.col("o_custkey") * 10).alias("region"), (F.col("o_custkey") % 4).cast("string").alias("sha_1"), F.when(k % 6 == 0, "9").otherwise((F.col("o_custkey") % 4).cast("string")).alias("sha_2"), F.when(k % 4 == 0, "m1").otherwise("m2").alias("metric"), F.when(k % 5 == 0, "a1").otherwise("a2").alias("annotation"), F.col("o_orderpriority").alias("decision"))
    return reads.review_items(items, _samples(spark, d), _tracks(spark, d), _quality(spark, d), _regions(spark, d))


VERDICT = "CASE l_linestatus WHEN 'F' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'aligned' ELSE 'misaligned' END ELSE 'unsure' END"
JUDGED = f"jd AS (SELECT * FROM (SELECT l_suppkey AS item, 'r' || (l_partkey % 5) AS reviewer, {VERDICT} AS verdict, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 5 ORDER BY l_shipdate::DATE DESC, l_orderkey * 10 + l_linenumber DESC) AS n FROM lineitem) WHERE n = 1)"


def _judged(spark, d):
    verdict = F.when(F.col("l_linestatus") == "F", F.when(F.col("l_linenumber") % 2 == 0, "aligned").otherwise("misaligned")).otherwise("unsure")
    j = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("item"), F.concat(F.lit("r"), (F.col("l_partkey") % 5).cast("string")).alias("reviewer"), verdict.alias("verdict"), F.col("l_shipdate").cast("date").alias("created"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("judgment"))
    return reads.latest_judgments(j, ["item", "reviewer"])


@query(f"WITH {JUDGED} SELECT item, reviewer, verdict FROM jd")
def latest_judgments(spark, d):
    return _judged(spark, d).select("item", "reviewer", "verdict")


@query(f"WITH {JUDGED}, q AS (SELECT c_custkey AS item FROM customer), m AS (SELECT item, verdict FROM jd WHERE reviewer = 'r1') SELECT count(*) AS n, count(verdict) AS judged, count(*) FILTER (verdict = 'aligned') AS aligned, count(*) FILTER (verdict = 'misaligned') AS misaligned, count(*) FILTER (verdict = 'unsure') AS unsure FROM q LEFT JOIN m USING (item)")
def judgment_progress(spark, d):
    queue = table(spark, d, "customer").select(F.col("c_custkey").alias("item"))
    return reads.progress(_judged(spark, d).where("reviewer = 'r1'"), queue, ["item"])
