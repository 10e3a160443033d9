"""Queries of the exported corpus. Stand-in: users are recordings in three datasets, their windows follow each other, targets are made of frame numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parley.operators import training_corpus as tc
from parley.plans.registry import query, table
from parley.streaming.jobs import shared_folder


def _recordings(spark, d):
    k = F.col("k")
    u = table(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg((F.count("*") * 2.0 + 20).alias("duration"))
    split = F.when(k % 10 < 8, "train").when(k % 10 == 8, "validation").otherwise("test")
    text = lambda s, c: F.concat(F.lit(s), c.cast("string"))
    return u.select((k % 3).alias("dataset"), text("set ", k % 3).alias("dataset_name"), k.alias("sample"), text("user ", k).alias("external_id"), split.alias("split"), (k % 20 / 20.0).alias("quality"), "duration", F.col("duration").alias("annotated"), text("a/", k).alias("audio1"), text("b/", k).alias("audio2"), F.sha2(text("a", k), 256).alias("sha1"), F.sha2(text("b", k), 256).alias("sha2"))


def _windows(spark, d):
    starts = F.sequence(F.lit(0), (F.floor((F.col("duration") - 4) / 48)).cast("int"))
    r = _recordings(spark, d).select("dataset", "sample", F.explode(starts).alias("i"))
    w = r.select("dataset", "sample", F.explode(F.array(F.lit(1), F.lit(2))).alias("user_side"), (F.col("i") * 48.0).alias("start"))
    kinds = F.array(*[F.lit(c) for c in ("turn_shift", "hold_pause", "background")])
    return w.select("*", (F.col("start") + 20).alias("end"), F.get(kinds, (F.col("sample") + F.col("start") / 48).cast("int") % 3).alias("category"))


def _frames(spark, d):
    # Windows are few and small, and 250 frames come of each: dealt out by number, as Spark would put them into one task by size.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    w = _windows(spark, d).repartition(n, "dataset", "sample", "user_side", "start")
    f = w.select("dataset", "sample", "user_side", "start", F.explode(F.sequence(F.lit(0), F.lit(tc.N_FRAMES - 1))).alias("frame"))
    n = F.col("frame") + F.col("sample") + F.col("user_side") * 3
    target = lambda i: F.struct((n * (i + 2) % 16 / 16.0).alias("target"), (n % (i + 3) > 0).alias("valid"))
    return f.select("*", (n % 8 / 8.0).alias("assistant_has_floor"), *[target(i).alias(c) for i, c in enumerate(tc.TARGETS)])


def _rows(spark, d):
    return tc.assemble(_windows(spark, d), _frames(spark, d), _recordings(spark, d))


BASE = """r AS (SELECT user_id AS k, count(*) * 2.0::DOUBLE + 20 AS d FROM events GROUP BY user_id), w AS (SELECT k, d, side, i * 48.0::DOUBLE AS s FROM (SELECT k, d, unnest(range(0, floor((d - 4) / 48)::BIGINT + 1)) AS i FROM r), (SELECT unnest([1, 2]) AS side) WHERE i * 48.0::DOUBLE + 20 <= d),
sp AS (SELECT *, CASE WHEN k % 10 < 8 THEN 'train' WHEN k % 10 = 8 THEN 'validation' ELSE 'test' END AS split, sha256(concat_ws(':', 'corpus-1', 'labels-1', k % 3, k, side, round_even(s / 0.08::DOUBLE, 0)::BIGINT)) AS window_id FROM w)"""


@query(f"""WITH {BASE}, f AS (SELECT window_id, split, s, k, side, unnest(range(250)) AS f FROM sp), n AS (SELECT *, f + k + side * 3 AS n FROM f)
SELECT window_id, split, s AS "start", sum(n % 8 / 8.0::DOUBLE) AS floor_sum, sum(CASE WHEN n % 4 > 0 THEN n * 3 % 16 / 16.0::DOUBLE ELSE -1.0::DOUBLE END) AS yield_sum, count(*) FILTER (n % 13 = 0) AS n_masked, sum(CASE WHEN n % 13 > 0 THEN n * 12 % 16 / 16.0::DOUBLE ELSE -1.0::DOUBLE END * (f + 1)) AS take_order FROM n GROUP BY ALL""")
def exported_rows(spark, d):
    """Written to shards and read back: sums of some targets, one of them weighed by its place."""
    root = f"{shared_folder(spark)}/corpus_{uuid.uuid4().hex}"
    tc.export(_rows(spark, d), _recordings(spark, d), root)
    rows = spark.read.parquet(f"{root}/training")
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    order = F.aggregate(F.transform("floor_take", lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return rows.select("window_id", "split", "start", add("assistant_has_floor").alias("floor_sum"), add("p_user_yield").alias("yield_sum"), F.size(F.filter("floor_take", lambda v: v == -1)).cast("bigint").alias("n_masked"), order.alias("take_order"))


@query(f"""WITH {BASE} SELECT e.dataset, e.split, (SELECT count(*) FROM r WHERE k % 3 = e.dataset AND CASE WHEN k % 10 < 8 THEN 'train' WHEN k % 10 = 8 THEN 'validation' ELSE 'test' END = e.split) AS n_recordings, coalesce(x.n_windows, 0) AS n_windows, coalesce(x.most, 0) AS most, coalesce(x.most / x.n_windows::DOUBLE, 0.0) AS share
FROM (SELECT * FROM (SELECT DISTINCT k % 3 AS dataset FROM r), (SELECT unnest(['train', 'validation', 'test']) AS split)) e LEFT JOIN (SELECT k % 3 AS dataset, split, sum(n)::BIGINT AS n_windows, max(n) AS most FROM (SELECT k, split, count(*) AS n FROM sp GROUP BY ALL) GROUP BY ALL) x ON x.dataset = e.dataset AND x.split = e.split""")
def corpus_concentrations(spark, d):
    return tc.concentrations(_rows(spark, d), _recordings(spark, d))


@query(f"""WITH {BASE} SELECT code, count(*) AS n FROM (
SELECT 'window_duration' AS code FROM sp WHERE k % 16 = 1 UNION ALL SELECT 'beyond_recording' FROM sp JOIN r USING (k) WHERE k % 16 = 1 AND s + 21 > r.d + 0.001 UNION ALL SELECT 'beyond_annotation' FROM sp JOIN r USING (k) WHERE k % 16 = 1 AND s + 21 > r.d + 0.001
UNION ALL SELECT 'sides' FROM sp WHERE k % 16 = 2 UNION ALL SELECT 'recording_fields' FROM sp WHERE k % 16 = 3 AND side = 1 AND split != 'test' UNION ALL SELECT 'recording_in_splits' FROM sp WHERE k % 16 = 3 AND split != 'test' UNION ALL SELECT 'window_identity' FROM sp WHERE k % 16 = 4
UNION ALL SELECT c FROM sp, (SELECT unnest(['duplicate_window_id', 'duplicate_window', 'duplicate_window_id', 'duplicate_window']) AS c) WHERE k % 16 = 5 UNION ALL SELECT 'target_length' FROM sp WHERE k % 16 = 6 UNION ALL SELECT 'target_range' FROM sp WHERE k % 16 = 7 UNION ALL SELECT 'unknown_recording' FROM sp WHERE k % 16 = 8
UNION ALL SELECT 'window_identity' FROM sp WHERE k % 16 = 8 UNION ALL SELECT 'versions' FROM sp WHERE k % 16 = 9 UNION ALL SELECT 'audio_paths' FROM sp WHERE k % 16 = 10) GROUP BY code""")
def corpus_issues(spark, d):
    """What is found in rows broken on purpose, a kind in each sixteenth of the recordings."""
    rows, c = _rows(spark, d), F.col
    is_ = lambda i: c("sample") % 16 == i
    broken = rows.withColumns(
        {
            "end": F.when(is_(1), c("end") + 1).otherwise(c("end")),
            "assistant_side": F.when(is_(2), c("user_side")).otherwise(c("assistant_side")),
            "split": F.when(is_(3) & (c("user_side") == 1), "test").otherwise(c("split")),
            "window_id": F.when(is_(4), F.reverse("window_id")).otherwise(c("window_id")),
            "floor_take": F.when(is_(6), F.slice("floor_take", 1, 249)).otherwise(c("floor_take")),
            "p_user_yield": F.when(is_(7), F.transform("p_user_yield", lambda v, i: F.when(i == 9, 1.5).otherwise(v).cast("float"))).otherwise(c("p_user_yield")),
            "schema_version": F.when(is_(9), "old").otherwise(c("schema_version")),
            "user_audio_path": F.when(is_(10), c("assistant_audio_path")).otherwise(c("user_audio_path")),
        }
    )
    lost = broken.withColumn("sample", F.when(is_(8), -c("sample") - 1).otherwise(c("sample")))
    twice = lost.withColumn("_copy", F.explode(F.when(is_(5), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_copy")
    return tc.sample_issues(twice, _recordings(spark, d)).groupBy("code").agg(F.count("*").alias("n"))
