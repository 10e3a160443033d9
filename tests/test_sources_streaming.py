import json
import struct
import wave

from pyspark.sql import functions as F

from parley.sources import readers, writers
from parley.streaming import jobs, policy


def write_wave(path, samples, rate=8000):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"".join(struct.pack("<hh", s, -s if i % 2 else s) for i, s in enumerate(samples)))


def test_waves(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for n in ("speaker2.wav", "speaker1.wav"):
        write_wave(tmp_path / "a" / n, [1000] * 8000)
    (tmp_path / "bad.wav").write_bytes(b"no wave")
    listing = readers.files(spark, str(tmp_path), "*.wav", content=True)
    pair = readers.discover_samples(listing).where("folder like '%/a'").first()
    assert pair.speaker1.endswith("speaker1.wav") and pair.speaker2.endswith("speaker2.wav")
    w = {r.path.rsplit("/", 1)[1]: r for r in readers.read_waves(listing).collect()}
    assert w["speaker1.wav"].duration == 1.0 and len(w["speaker1.wav"].samples) == 16000 and w["bad.wav"].error
    assert readers.read_waves(listing, chunk_seconds=0.25).where("error is null").count() == 8


def test_manifest_and_sessions(spark, tmp_path):
    m = {"sample_count": 1, "samples": [{"id": "x", "files": [{"path": "b/speaker2.wav", "duration_seconds": 100.5}, {"path": "b/speaker1.wav", "duration_seconds": 100.0}]}]}
    (tmp_path / "m.json").write_text(json.dumps(m))
    r = readers.read_manifest(spark, str(tmp_path / "m.json")).first()
    assert (r.speaker1, r.duration, r.compatible) == ("b/speaker1.wav", 100.5, True)
    s = tmp_path / "sessions" / "s1"
    s.mkdir(parents=True)
    (s / "metadata.json").write_text(json.dumps({"turns": [{"speaker": "a", "start_seconds": 1.0, "end_seconds": 2.0, "text": "hi"}, {"speaker": "b", "start_seconds": 2.0, "end_seconds": 3.0, "text": " "}]}))
    t = readers.transcript_turns(readers.read_sessions(spark, str(tmp_path / "sessions")), spark.createDataFrame([("s1", "a", 0.5)], "session string, speaker string, offset double"))
    assert [tuple(x) for x in t.collect()] == [("s1", "a", 1.5, 2.5, "hi")]


def test_shards(spark, tmp_path):
    df = spark.range(2500).select("id", F.when(F.col("id") % 10 == 0, "test").otherwise("train").alias("split"), F.lit(1.0).alias("d"))
    inventory = writers.write_shards(df.coalesce(1), str(tmp_path / "out"), 1000)
    got = {(r.split, r.rows) for r in inventory.collect()}
    assert ("test", 250) in got and all(r.rows <= 1000 for r in inventory.collect())
    assert readers.read_shards(spark, str(tmp_path / "out"), "train", inventory).count() == 2250
    assert {(r.split, r.n) for r in writers.split_summaries(df, "d").collect()} == {("train", 2250), ("validation", 0), ("test", 250)}


def test_overlap_policy(spark):
    cases = [(100, False, "mm-hm", None, "non_floor_taking", 0.85), (100, False, "[laughter]", None, "non_floor_taking", 0.75), (100, False, "", None, "non_floor_taking", 0.7), (600, False, "", None, "non_floor_taking", 0.6), (100, True, "why is that", None, "response_required", 0.9), (100, True, "no wait", None, "response_required", 0.95), (200, True, "yeah but then", None, "floor_taking", 0.9), (500, True, "", None, "floor_taking", 0.9), (100, True, None, None, "unresolved", 0.5), (100, True, "", 0.8, "floor_taking", 0.8), (600, True, "yeah", None, "floor_taking", 0.9), (100, True, "haha", None, "unresolved", 0.5), (100, True, "is it done?", None, "response_required", 0.8)]
    df = spark.createDataFrame(cases, "e int, a boolean, t string, p double, want string, sure double")
    bad = df.select("t", "want", "sure", policy.classify(F.col("e"), F.col("a"), F.col("t"), F.col("p")).alias("x")).where("x.kind != want or abs(x.confidence - sure) > 1e-9").collect()
    assert bad == []


def test_revisions_and_chunks():
    out, last = jobs.revise([(1, "hello wor"), (2, "hello world and"), (3, "hello world and"), (4, "hello word")], None)
    assert out == [(1, "", "hello wor", None), (2, "hello ", "world and", 1), (4, "hello ", "word", 2)] and last == (4, "hello word")
    text, pending, got = "one two three four five six. seven eight nine ten eleven twelve thirteen four", "", []
    for i in range(0, len(text), 5):
        chunks, pending = jobs.chunk_text(pending, text[i : i + 5])
        got += chunks
    got += jobs.chunk_text(pending, "", final=True)[0]
    assert " ".join(got) == text and got[0] == "one two three four five six."


def test_stream_sessions_match_batch(spark, tmp_path):
    data = [(i % 3, i * 7.0 + (400 if i > 50 else 0)) for i in range(100)]
    df = spark.createDataFrame(data, "k int, s double").select("k", F.timestamp_seconds("s").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = jobs.run_once(jobs.stream_sessions(stream, ["k"], "ts", "60 seconds", "1 second"), "sessions_test")
    batch = jobs.batch_sessions(df, ["k"], "ts", 60)
    closed = {tuple(r) for r in got.select("k", "start", "last", "n").collect()}
    assert closed and closed <= {tuple(r) for r in batch.select("k", "start", "last", "n").collect()}


def test_acknowledgements(spark):
    c = spark.createDataFrame([(1, 1, True), (2, 1, True)], "command_id int, generation int, active boolean")
    a = spark.createDataFrame([(1, 1, 1, 10, 1), (1, 1, 1, 10, 2), (2, 1, 2, 5, 3), (9, 1, 3, 20, 4), (2, 1, 4, 30, 5)], "command_id int, generation int, sequence int, position int, received int")
    out = [r.state for r in jobs.acknowledgements(c, a).orderBy("received").collect()]
    assert out == ["applied", "duplicate", "stale", "stale", "applied"]
