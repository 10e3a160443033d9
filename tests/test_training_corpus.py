"""The exported corpus: what is written comes back, whatever is broken is found."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from parley.operators import training_corpus as tc

RECORDING = "dataset int, dataset_name string, sample int, external_id string, split string, quality double, duration double, annotated double, audio1 string, audio2 string, sha1 string, sha2 string"


def recordings(spark, n=6):
    rows = [(k % 2, f"set {k % 2}", k, f"r{k}", ("train", "train", "validation")[k % 3], k / 10, 60.0, 60.0, f"{k}/1.flac", f"{k}/2.flac", f"x{k}", f"y{k}") for k in range(n)]
    return spark.createDataFrame(rows, RECORDING)


def corpus(spark, n=6, frames=4):
    w = recordings(spark, n).select("dataset", "sample", F.explode(F.array(F.lit(1), F.lit(2))).alias("user_side"), F.explode(F.array(F.lit(0.0), F.lit(16.0), F.lit(48.0))).alias("start")).withColumn("end", F.col("start") + 20).withColumn("category", F.lit("background"))
    target = lambda i: F.struct(F.when(F.col("frame") % 3 > 0, (F.col("frame") + i) / 16.0).alias("target"), (F.col("frame") % 3 > 0).alias("valid"))
    f = w.select("dataset", "sample", "user_side", "start", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("frame")).select("*", (F.col("frame") / 8.0).alias("assistant_has_floor"), *[target(i).alias(c) for i, c in enumerate(tc.TARGETS)])
    return w, f


def test_assembled_rows(spark):
    w, f = corpus(spark)
    rows = tc.assemble(w, f, recordings(spark), 4).collect()
    assert len(rows) == 6 * 2 * 2  # the third window goes beyond its recording
    r = next(r for r in rows if (r["sample"], r.user_side, r.start) == (3, 2, 16.0))
    assert (r.assistant_side, r.user_audio_path, r.assistant_audio_path, r.split, r.quality, r.end) == (1, "3/2.flac", "3/1.flac", "train", 0.3, 36.0)
    assert r.p_user_yield == [-1.0, 2 / 16, 3 / 16, -1.0] and r.assistant_has_floor == [0.0, 1 / 8, 2 / 8, 3 / 8]
    assert len({x.window_id for x in rows}) == 24 and all(len(x.window_id) == 64 for x in rows)
    # Identity depends on the side and the frame, not on what is in the window.
    again = tc.assemble(w, f.withColumn("assistant_has_floor", F.lit(0.0)), recordings(spark), 4).collect()
    assert {x.window_id for x in again} == {x.window_id for x in rows}


def test_incomplete_frames_are_not_filled_in(spark):
    w, f = corpus(spark, 1)
    short = f.where("not (start = 0 and user_side = 1 and frame = 2)").unionByName(f.where("start = 16 and user_side = 1 and frame = 0"))
    empty = short.withColumn("floor_take", F.when((F.col("start") == 0) & (F.col("user_side") == 2) & (F.col("frame") == 1), F.struct(F.lit(None).cast("double").alias("target"), F.lit(True).alias("valid"))).otherwise(F.col("floor_take")))
    rows = tc.assemble(w, empty, recordings(spark), 4)
    issues = tc.sample_issues(rows, recordings(spark), 4).groupBy("code").count().collect()
    assert {r.code: r["count"] for r in issues} == {"target_length": 2, "target_range": 1}


@pytest.fixture
def exported(spark, tmp_path):
    w, f = corpus(spark)
    root = str(tmp_path / "corpus")
    tc.export(tc.assemble(w, f, recordings(spark), 4), recordings(spark), root, 5)
    return root


def codes(spark, root):
    return {(r.code, r.subject) for r in tc.validate(spark, root, 4).collect()}


def manifest_of(root):
    path = glob.glob(f"{root}/manifest/part-*")[0]
    return path, json.loads(open(path).read())


def rewrite(path, content):
    with open(path, "w") as f:
        f.write(json.dumps(content))
    crc = os.path.join(os.path.dirname(path), "." + os.path.basename(path) + ".crc")
    if os.path.exists(crc):
        os.remove(crc)


def test_a_whole_corpus_has_no_issue(spark, exported):
    assert codes(spark, exported) == set()
    m = tc.read_manifest(spark, exported).first()
    assert (m.n_recordings, m.n_samples) == (6, 24) and [(s.split, s.n_recordings, s.n_samples, s.duration) for s in m.splits] == [("test", 0, 0, 0.0), ("train", 4, 16, 240.0), ("validation", 2, 8, 120.0)]
    assert sum(s.rows for s in m.shards) == 24 and all(s.rows <= 5 for s in m.shards)
    with pytest.raises(Exception, match="(?i)exists"):
        tc.export(spark.read.parquet(f"{exported}/training"), recordings(spark), exported)


def test_manifests_that_do_not_add_up(spark, exported):
    path, m = manifest_of(exported)
    m["n_samples"] += 1
    m["splits"][1]["n_samples"] += 2
    m["splits"][0]["split"] = "train"
    m["shards"].append(dict(m["shards"][0]))
    m["shards"][1]["path"] = "../x.parquet"
    rewrite(path, m)
    found = codes(spark, exported)
    assert {c for c, s in found if s == "manifest"} == {"shard_rows", "split_samples", "split_summaries", "duplicate_shard", "unsafe_path"}
    assert {c for c, s in found if s != "manifest"} == {"missing_shard", "unnamed_shard", "wrong_split", "split_summary"}


def test_shards_that_differ(spark, exported):
    shards = sorted(glob.glob(f"{exported}/training/split=train/*.parquet"))
    os.remove(shards[0])
    with open(shards[1], "ab") as f:
        f.write(b"")
    path, m = manifest_of(exported)
    for s in m["shards"]:
        if s["path"].endswith(os.path.basename(shards[1])):
            s["rows"], s["bytes"], s["sha256"] = s["rows"] + 1, s["bytes"] - 1, "0" * 64
    rewrite(path, m)
    found = codes(spark, exported)
    assert {c for c, s in found if s.endswith(os.path.basename(shards[0]))} == {"missing_shard"}
    assert {c for c, s in found if s.endswith(os.path.basename(shards[1]))} == {"shard_size", "shard_hash", "shard_row_count"}
    assert ("split_summary", "train") in found


def test_recordings_that_clash(spark):
    r = recordings(spark, 4)
    bad = r.unionByName(r.where("sample = 1")).withColumn("sha1", F.when(F.col("sample") == 3, "x2").otherwise(F.col("sha1"))).withColumn("sha2", F.when(F.col("sample") == 3, "y2").otherwise(F.col("sha2"))).withColumn("annotated", F.when(F.col("sample") == 0, 61.0).otherwise(F.col("annotated")))
    assert {(x.code, x.subject) for x in tc.recording_issues(bad).collect()} == {("duplicate_recording", "1/1"), ("duplicate_audio", "1/1"), ("duplicate_audio", "0/2"), ("duplicate_audio", "1/3"), ("annotation_beyond_end", "0/0")}


def test_concentrations(spark):
    w, f = corpus(spark)
    rows = tc.assemble(w, f, recordings(spark), 4).where("not (sample = 0 and start = 0)")
    got = {(r.dataset, r.split): (r.n_recordings, r.n_windows, r.most, r.share) for r in tc.concentrations(rows, recordings(spark)).collect()}
    assert got[0, "train"] == (2, 6, 4, 4 / 6) and got[0, "test"] == (0, 0, 0, 0.0) and len(got) == 6
