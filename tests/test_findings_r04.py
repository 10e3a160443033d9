"""What the review of round 4 found: each failed before, but for the comparison of held-out offsets, which was slow."""

import os

import duckdb
from pyspark.sql import functions as F

from parley.operators import events as ev
from parley.operators import frames as fr
from parley.operators import intervals as iv
from parley.operators import propositions as pp
from parley.operators import timeline as tl
from parley.operators import training_corpus as tc
from parley.operators import turns as tn
from parley.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_held_out_offsets_equal_their_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW customer AS SELECT * FROM '{SF}/customer.parquet'")
    want = sorted(db.execute(ORACLES["offset_held_out"]).fetchall())
    assert want == sorted(tuple(r) for r in QUERIES["offset_held_out"](spark, SF).collect())


def test_frames_are_gathered_before_they_are_shuffled(spark):
    """Frames in order leave one row of a window; shuffled ones give the same arrays."""
    n = lambda c: F.col("frame") / 64.0 + c
    f = spark.range(2).select(F.lit(1).alias("dataset"), F.col("id").cast("int").alias("sample"), F.lit(1).alias("user_side"), F.lit(0.0).alias("start"), F.explode(F.sequence(F.lit(0), F.lit(49))).alias("frame"))
    f = f.select("*", *[n(i / 1024).cast("float").alias(c) for i, c in enumerate(tc.FIELDS)])
    by = ["dataset", "sample", "user_side", "start"]
    assert tc.stretches(f.coalesce(1), by).count() == 2
    assert {(r["sample"], len(r.frame)) for r in tc.stretches(f.coalesce(1), by).collect()} == {(0, 50), (1, 50)}
    target = [F.struct(F.col(c).cast("double").alias("target"), F.lit(True).alias("valid")).alias(c) for c in tc.TARGETS]
    frames = f.select(*by, "frame", *tc.INPUTS, *target)
    w = frames.select(*by).distinct().withColumns({"end": F.lit(20.0), "category": F.lit("background")})
    r = [(1, "set", k, f"r{k}", "train", 0.5, 60.0, 60.0, "a", "b", "x", "y") for k in range(2)]
    rec = spark.createDataFrame(r, "dataset int, dataset_name string, sample int, external_id string, split string, quality double, duration double, annotated double, audio1 string, audio2 string, sha1 string, sha2 string")
    rows = lambda x: sorted((tuple(v) for v in tc.assemble(w, x, rec, 50).collect()), key=repr)
    whole = rows(frames.coalesce(1))
    assert len(whole) == 2 and whole == rows(frames.repartition(7, F.rand(3)).orderBy(F.rand(5))) and all(len(v) == 50 for v in whole[0][-12:])


def test_confidences_do_not_depend_on_when(spark):
    """The same turns, 54 years later in microseconds, have the very same confidences."""
    schema = "k int, start bigint, end bigint, n_words bigint, text string"
    at = [(0, 738_000_000, -1_234_567, 777_777_777), (3, 90_000_001, 2, 700_000_003), (7, 400_000_007, -99_999_989, 420_000_011)]

    def run(shift):
        own = [(k, a + shift, b + shift, 2, "uh huh") for k, a, b, _, _ in [(i, *x) for i, x in enumerate(at)]]
        other = [(k, c + shift, d + shift, 9, "and then we went on") for k, _, _, c, d in [(i, *x) for i, x in enumerate(at)]]
        out = tn.segment_hypotheses(spark.createDataFrame(own, schema), spark.createDataFrame(other, schema), ["k"], 1e9, 6e8)
        return {r.k: (r.keep_playing, r.interruption) for r in out.collect()}

    assert run(0) == run(1_704_222_291_876_589)


def test_values_that_differ_by_the_order_of_sums_tie(spark):
    near = 0.1 + 0.2 - 0.3  # 5.6e-17
    rows = [(1, "turn_shift", 20.0, 0.5, 1, 0.3 + near), (1, "turn_shift", 60.0, 0.5, 1, 0.3)]
    out = pp.balanced(spark.createDataFrame(rows, "k int, kind string, time double, confidence double, n_kind bigint, masked double"), ["k"], 2)
    assert [r.time for r in out.orderBy("place").collect()] == [20.0, 60.0]


def test_empty_spans_meet_what_they_lie_within(spark):
    schema = "k int, side int, start bigint, end bigint"
    rules = ev.EventRules(minimum_pause=10)
    said = [(1, 1, 0, 10), (1, 1, 30, 40), (1, 2, 20, 20), (2, 1, 0, 10), (2, 1, 30, 40), (2, 2, 10, 10), (2, 2, 30, 30)]
    got = {(r.k, r.start, r.end) for r in ev.pauses(spark.createDataFrame(said, schema), ["k"], 8, rules).collect()}
    assert got == {(2, 10, 30)}
    a, b = (spark.createDataFrame(r, "k int, start bigint, end bigint") for r in ([(1, 0, 10), (2, 5, 5)], [(1, 4, 4), (1, 0, 0), (1, 10, 10), (2, 0, 10)]))
    assert {(r.k, r["from"], r["to"]) for r in iv.overlap_join(a, b, ["k"], 3).collect()} == {(1, 4, 4), (2, 5, 5)}


def test_frames_of_one_time_have_one_occupancy(spark):
    frames = spark.createDataFrame([(1, 0.0), (1, 0.0), (1, 0.0), (1, 2.0)], "k int, time double")
    said = spark.createDataFrame([(1, 0.0, 1.5)], "k int, start double, end double")
    got = sorted((r.time, list(r.occupancy)) for r in fr.future_occupancy(frames, said, ["k"], [(0, 1), (1, 2)], 1.0).collect())
    assert got == [(0.0, [1.0, 0.5]), (2.0, [0.0, 0.0])]


def test_streams_read_tables_of_several_files(spark, tmp_path):
    c = spark.read.parquet(f"{SF}/conversations.parquet")
    c.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    assert len(os.listdir(tmp_path / "conversations.parquet")) > 3
    n = QUERIES["reply_events"](spark, SF).count()
    assert n > 0 and QUERIES["stream_replies"](spark, str(tmp_path)).count() == n


def test_improvements_are_quotients_of_whole_numbers(spark):
    import random

    rng = random.Random(1)
    rows = [(k, [rng.random() < 0.5 for _ in range(64)], [rng.random() < 0.5 for _ in range(64)]) for k in range(60)]
    out = tl.with_best_shift(spark.createDataFrame(rows, "k int, a array<boolean>, b array<boolean>"), 0.1, 0.5, 0.6)
    seen = [r["shift"].improvement for r in out.collect()]
    assert max(seen) > 0 and all(v == round(v * 52) / 52 for v in seen)
