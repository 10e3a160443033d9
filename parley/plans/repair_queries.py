"""Queries of repaired clocks, merged transcripts and acoustic offsets. Stand-ins: customers are plans, turns are transcripts, embeddings are onsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import acoustic, maps, text
from parley.plans.registry import query, table

K = ["k"]


def _plans(spark, d):
    c = F.col
    k = c("c_custkey")
    low = F.when(k % 3 > 0, k * 7 % 200 / 8.0)
    return table(spark, d, "customer").select(k.alias("k"), (k * 37 % 400).alias("n_frames"), F.lit(10).alias("rate"), ((k * 13 % 160 - 80) / 8.0).alias("first_shift"), ((k * 29 % 160 - 80) / 8.0).alias("second_shift"), low.alias("exclude_from"), (low + k * 11 % 80 / 8.0).alias("exclude_to"))


#: Frame by frame.
FRAMES = """p AS (SELECT c_custkey AS k, c_custkey * 37 % 400 AS n, round_even((c_custkey * 13 % 160 - 80) / 8.0::DOUBLE * 10, 0)::BIGINT AS first, round_even((c_custkey * 29 % 160 - 80) / 8.0::DOUBLE * 10, 0)::BIGINT AS second, CASE WHEN c_custkey % 3 > 0 THEN round_even((c_custkey * 7 % 200) / 8.0::DOUBLE * 10, 0)::BIGINT END AS low, CASE WHEN c_custkey % 3 > 0 THEN round_even(((c_custkey * 7 % 200) / 8.0::DOUBLE + c_custkey * 11 % 80 / 8.0::DOUBLE) * 10, 0)::BIGINT END AS high FROM customer),
f AS (SELECT *, unnest(range(n)) AS f FROM p), o AS (SELECT k, n, f, CASE WHEN low IS NULL OR f >= high THEN second WHEN f < low THEN first END AS o FROM f), s AS (SELECT k, f, CASE WHEN f - o >= 0 AND f - o < n THEN o END AS o FROM o)"""


@query(f"""WITH {FRAMES}, r AS (SELECT *, sum(CASE WHEN g IS NULL OR o IS DISTINCT FROM q THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY f) AS run FROM (SELECT *, lag(f) OVER (PARTITION BY k ORDER BY f) AS g, lag(o) OVER (PARTITION BY k ORDER BY f) AS q FROM s))
SELECT k, min(f) AS "start", max(f) + 1 AS "end", any_value(o) AS "offset" FROM r GROUP BY k, run""")
def repair_pieces(spark, d):
    return maps.repair_pieces(_plans(spark, d), K)


@query(f"WITH {FRAMES} SELECT k, count(o) AS n_sounding, count(DISTINCT f - o) AS n_sources, count(o) FILTER (f % 2 = 0) AS n_even FROM s GROUP BY k")
def repair_round_trip(spark, d):
    """Each repaired track's frames carried to the source and back: those that find themselves, and the source frames met on the way."""
    m = maps.sounding(maps.repair_pieces(_plans(spark, d), K))
    back = maps.compose(m, maps.invert(m, K), K, 100).where("offset = 0")
    n = F.sum(F.col("end") - F.col("start")).alias("n_sounding")
    even = F.sum(F.floor((F.col("end") + 1) / 2) - F.floor((F.col("start") + 1) / 2)).cast("bigint").alias("n_even")
    met = maps.invert(m, K).select("k", F.explode(F.sequence("start", F.col("end") - 1)).alias("f")).groupBy("k").agg(F.count_distinct("f").alias("n_sources"))
    found = back.groupBy("k").agg(n, even).join(met, "k")
    return _plans(spark, d).where("n_frames > 0").select("k").join(found, "k", "left").fillna(0).select("k", "n_sounding", "n_sources", "n_even")


@query(f"""WITH {FRAMES}, q AS (SELECT k, i, (k * 3 + i * 41) % 300 AS a, (k * 3 + i * 41) % 300 + 1 + (k + i * 7) % 50 AS b FROM p, (SELECT unnest(range(5)) AS i))
SELECT q.k, q.i::INTEGER AS i, a AS "start", b AS "end", CASE WHEN count(o) = b - a AND min(o) = max(o) THEN a - min(o) END AS source_start, CASE WHEN count(o) = b - a AND min(o) = max(o) THEN b - min(o) END AS source_end FROM q LEFT JOIN s ON s.k = q.k AND f >= a AND f < b GROUP BY q.k, q.i, a, b""")
def source_intervals(spark, d):
    plans = _plans(spark, d)
    first = (F.col("k") * 3 + F.col("i") * 41) % 300
    spans = plans.select("k", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select("k", "i", first.alias("start"), (first + 1 + (F.col("k") + F.col("i") * 7) % 50).alias("end"))
    return maps.source_intervals(spans, maps.sounding(maps.repair_pieces(plans, K)), K, 100)


@query()
def progressive_merge(spark, d):
    """Three readings of every turn: as it is, without every third word, and with every fourth word changed."""
    c = table(spark, d, "conversations").where("text is not null")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")

    def reading(rank, keep, say, late):
        timed = F.transform(words, lambda w, i: F.struct(say(w, i).alias("text"), (i * 0.5 + late).alias("start"), (i * 0.5 + 0.4 + late).alias("end"), F.lit(0.5 + rank / 10).alias("confidence"), i.alias("i")))
        return c.select("conv_id", "turn", F.lit(rank).alias("rank"), F.filter(timed, lambda w: keep(w["i"])).alias("words"))

    parts = [reading(1, lambda i: F.lit(True), lambda w, i: w, 0.0), reading(2, lambda i: i % 3 > 0, lambda w, i: w, 0.1), reading(3, lambda i: F.lit(True), lambda w, i: F.when(i % 4 == 0, F.concat(w, F.lit("x"))).otherwise(w), 0.2)]
    return text.progressive_merge(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["conv_id", "turn"])


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS a FROM embeddings), p AS (SELECT l.vec_id, l.a, list_transform(r.a, lambda x, i: x + coalesce(l.a[i + 3], 0.0)) AS b FROM v l JOIN v r ON r.vec_id = l.vec_id + 1 WHERE l.vec_id % 3 > 0 UNION ALL SELECT l.vec_id, l.a, r.a FROM v l JOIN v r ON r.vec_id = l.vec_id + 1 WHERE l.vec_id % 3 = 0),
z AS (SELECT vec_id, list_transform(a, lambda x: (x - list_avg(a)) / list_stddev_pop(a)) AS a, list_transform(b, lambda x: (x - list_avg(b)) / list_stddev_pop(b)) AS b FROM p), l AS (SELECT *, unnest(range(-20, 21)) AS g FROM z),
c AS (SELECT vec_id, g, round(list_sum(list_transform(list_zip(a[greatest(0, g) + 1:64 + least(0, g)], b[greatest(0, -g) + 1:64 - greatest(0, g)]), lambda q: q[1] * q[2])) / (64 - abs(g)), 12) AS c FROM l), t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, g) AS place FROM c), o AS (SELECT t.vec_id, t.g, t.c, max(c.c) AS other FROM t JOIN c ON c.vec_id = t.vec_id AND abs(c.g - t.g) > 5 WHERE place = 1 GROUP BY ALL)
SELECT vec_id, round(g * 0.05::DOUBLE, 6) AS shift, round(c, 6) AS peak, round(c - other, 6) AS margin FROM o""")
def acoustic_offset(spark, d):
    """Of neighbouring vectors, two in three of which carry a moved copy of the first."""
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("a"))
    pair = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    mixed = F.transform("b", lambda x, i: x + F.coalesce(F.get("a", i + 3), F.lit(0.0)))
    out = acoustic.with_offset(pair.withColumn("b", F.when(F.col("vec_id") % 3 > 0, mixed).otherwise(F.col("b"))), "a", "b", reach=1.0)
    return out.select("vec_id", *[F.round(f"offset.{c}", 6).alias(c) for c in ("shift", "peak", "margin")])
