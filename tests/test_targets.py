"""Training targets, audit and timelines on small hand-made recordings."""

import numpy as np
from pyspark.sql import functions as F

from parley.operators import audit, supervision, text, timeline
from parley.streaming import policy

SEG = "k int, start double, end double, source string, turn double, keep_playing double, interruption double"
CON = "k int, start double, end double, merge double, pause double"
K = ["k"]


def spans(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "k int, start double, end double")


def told(df, name):
    return {r.time: (None if r[name].target is None else round(r[name].target, 6), r[name].reason) for r in df.collect()}


def frames(spark, times, supervised=True, limit=100.0):
    return spark.createDataFrame([(1, t, supervised, limit) for t in times], "k int, time double, supervised boolean, limit double")


def test_floor(spark):
    seg = spark.createDataFrame([(1, 0.0, 2.0, "transcript", 0.9, 0.1, 0.0), (1, 3.0, 4.0, "transcript", 0.6, 0.4, 0.5), (1, 6.0, 7.0, "audio", 0.5, 0.5, 0.0)], SEG)
    con = spark.createDataFrame([(1, 2.0, 3.0, 0.8, 0.5), (1, 8.0, 9.0, 0.8, 0.5)], CON)
    got = told(supervision.floor(frames(spark, [1.0, 2.0, 2.9, 3.0, 5.0, 6.5, 8.5]), seg, con, K, 5.0), "floor")
    assert got == {1.0: (0.9, None), 2.0: (round(0.8 * 0.75 * 0.6, 6), None), 2.9: (round(0.8 * 0.75 * 0.6, 6), None), 3.0: (0.6, None), 5.0: (0.0, None), 6.5: (None, "ambiguous_annotation"), 8.5: (None, "ambiguous_annotation")}
    yields = told(supervision.user_yield(frames(spark, [1.6, 3.8, 5.0], limit=4.4), seg, con, K, 5.0), "user_yield")
    assert yields == {1.6: (round(1 - 0.8 * 0.75 * 0.6, 6), None), 3.8: (1.0, None), 5.0: (None, "outside_user_yield_context")}
    assert told(supervision.user_yield(frames(spark, [4.2], limit=4.4), seg, con, K, 5.0), "user_yield") == {4.2: (None, "future_horizon_censored")}
    assert told(supervision.user_yield(frames(spark, [1.6], supervised=False), seg, con, K, 5.0), "user_yield") == {1.6: (None, "burn_in")}


def test_anchors_and_boundaries(spark):
    user = spark.createDataFrame([(1, 0.0, 2.0, "transcript", 0.9, 0.1, 0.2), (1, 5.0, 6.0, "transcript", 0.7, 0.3, 0.5), (1, 9.0, 9.5, "audio", 0.5, 0.5, 0.0), (1, 19.0, 19.5, "transcript", 0.4, 0.5, 0.0)], SEG)
    other = spark.createDataFrame([(1, 2.4, 5.5, "transcript", 0.95, 0.0, 0.0)], SEG)
    con = spark.createDataFrame([], CON)
    limits = spark.createDataFrame([(1, 20.0)], "k int, limit double")
    b = {r.offset: (r.until, r.source) for r in supervision.decision_boundaries(user, other, con, limits, K, 5.0).collect()}
    assert b == {2.0: (2.4, "segment_end"), 6.0: (8.0, "segment_end"), 9.5: (11.5, "segment_end"), 19.5: (20.0, "censored")}
    points = spark.createDataFrame([], "k int, at double, confidence double")
    a = {r.time: (r.source, r.completion.target, r.completion.reason) for r in supervision.completion_anchors(user, other, con, points, limits, K, 5.0).collect()}
    assert a == {2.0: ("segment_end", 0.9, None), 6.0: ("segment_end", 0.7, None), 9.5: ("segment_end", None, "ambiguous_annotation"), 19.5: ("censored", None, "censored_annotation")}
    none = spans(spark, [(90.0, 91.0)])
    o = supervision.overlap_anchors(user, other, other, none, none, K, 5.0).collect()
    assert [(r.time, round(r.floor_take.target, 6)) for r in o] == [(5.0, 0.35)]


def test_causal_frame(spark):
    t = spark.createDataFrame([(0.0,), (0.04,), (0.041,), (0.12,), (99.0,)], "t double")
    assert [r[0] for r in t.select(supervision.causal_frame(F.col("t"), F.lit(0.0), 250)).collect()] == [0, 0, 1, 1, 249]


def test_backchannel_confidence(spark):
    seg = spark.createDataFrame([(1, 0.0, 1.0, "transcript", 0.2, 0.8, 0.0), (1, 0.9, 3.0, "transcript", 0.7, 0.3, 0.0)], SEG)
    b = supervision.backchannel_confidence(spans(spark, [(0.5, 1.0), (2.0, 2.5), (7.0, 8.0)]), seg, K, 5.0)
    assert {r.start: r.confidence for r in b.collect()} == {0.5: 0.8, 2.0: 0.3, 7.0: None}


def test_window_supervision_counts_frames(spark):
    """Against frames one by one, windows that end in the middle of a frame included."""
    valid, doubtful = spans(spark, [(5.0, 6.03), (9.99, 14.0)]), spans(spark, [(5.5, 8.41), (13.0, 18.0)])
    ends = [(0.0, 20.0), (0.0, 17.93), (3.0, 7.02), (1.0, 1.5)]
    w = spark.createDataFrame([(1, a, b, 18.2) for a, b in ends], "k int, start double, end double, limit double")
    got = {(r.start, r.end): (r.n_frames, r.primary, r.future) for r in audit.supervision(w, valid, doubtful, K, 5.0).collect()}
    inside = lambda t, v: any(a <= t < b for a, b in v)
    for a, b in ends:
        n = max(1, int(np.ceil((b - a) / 0.08)))
        at = [min(b, a + (i + 0.5) * 0.08) for i in range(n) if a + (i + 0.5) * 0.08 >= a + 4.0]
        ok = sum(inside(t, [(5.0, 6.03), (9.99, 14.0)]) or not inside(t, [(5.5, 8.41), (13.0, 18.0)]) for t in at)
        ahead = sum(t + h <= 18.2 for t in at for h in audit.HORIZONS)
        want = (len(at), ok / len(at) if at else 0.0, ahead / (4 * len(at)) if at else 0.0)
        assert got[a, b][0] == want[0] and abs(got[a, b][1] - want[1]) < 1e-9 and abs(got[a, b][2] - want[2]) < 1e-9, (a, b)


def test_shift_counts():
    rng = np.random.default_rng(2)
    for n, reach, margin in ((60, 5, 6), (200, 12, 12), (11, 3, 6)):
        a, b = rng.random(n) < 0.4, rng.random(n) < 0.5
        both, neither, width = timeline.shift_counts(a, b, reach, margin)
        if n <= 2 * margin:
            assert width == 0
            continue
        for lag in range(-reach, reach + 1):
            moved = np.array([0 <= i - lag < n and b[i - lag] for i in range(n)])
            cut = slice(margin, n - margin)
            assert both[lag + reach] == (a & moved)[cut].sum() and neither[lag + reach] == (~a & ~moved)[cut].sum()


def test_activity_and_cycles(spark):
    d = spark.createDataFrame([(1, 3.05)], "k int, duration double")
    a = timeline.activity(spans(spark, [(0.0, 1.0), (2.95, 9.0)]), d, K, 0.1, "a").first().a
    assert len(a) == 31 and [i for i, x in enumerate(a) if x] == [*range(10), 29, 30]
    rows = spark.createDataFrame([(1, [True] * 10 + [False] * 20 + [True] * 3 + [False] * 15, [True] * 10 + [False] * 20 + [True] * 3 + [False] * 15)], "k int, a array<boolean>, b array<boolean>")
    assert timeline.cycles(timeline.states(rows, K), K, 0.1).first().cycles == 1


def test_pilot(spark):
    t = spark.createDataFrame([(120.0, 5, 20_000, 1, 2_000)], "usable_hours double, turn_shifts long, hold_pauses long, backchannels long, interruptions_and_overlaps long")
    assert [r.ready for r in audit.pilot(t).collect()] == [True, False, True, False, True]


def test_overlap_metrics(spark):
    rows = [(1, "non_floor_taking", 0, i * 1_000_000, None, None, None, None, None, False, 10) for i in range(1, 21)] + [(1, None, 0, None, 5_000_000, None, None, None, None, None, 7)]
    names = ["k", "kind", "onset", "decision", "duck", "pause", "cancel", "resume", "paused_at", "fast_path", "samples"]
    df = spark.createDataFrame(rows, "k int, kind string, onset long, decision long, duck long, pause long, cancel long, resume long, paused_at long, fast_path boolean, samples long").toDF(*names)
    r = policy.overlap_metrics(df, K).first()
    assert (r.n_overlaps, r.n_cooperative, r.n_competitive, r.cooperative_p95_ms, r.duck_p95_ms, r.competitive_p95_ms, r.generated_samples) == (21, 20, 0, 19.0, 5.0, None, 200)


def test_text_evaluation(spark):
    df = spark.createDataFrame([(["um", "the", "the", "ca-", "uh"], ["umm", "the", "the", "uh", "hmm"])], "r array<string>, h array<string>")
    x = text.evaluate(df, "r", "h").first()
    assert (x.repetition_expected, x.repetition_recalled, x.partial_expected, x.partial_recalled) == (1, 1, 1, 0)
    assert (x.tp_um, x.fn_um, x.fp_hmm) == (1, 0, 1)
    m = spark.createDataFrame([((0, 2), [(0.0, 0.5), (0.6, 1.0), (1.25, 2.0)])], "m struct<first:int,end:int>, w array<struct<start:double,end:double>>")
    y = m.select(text.placement("m", "w", "backchannel", F.lit(200)).alias("a"), text.placement("m", "w", "before_last_word", F.lit(900)).alias("b"), text.pause_after("m", "w").alias("c")).first()
    assert (y.a, y.b, y.c) == (1.2, 0.0, 250)


def test_windows_without_region_analysis(spark):
    """Rejected for that alone; nothing of their recordings is usable."""
    from parley.operators import audit

    w = spark.createDataFrame([(1, 0.0, 20.0, 1.0, 1.0, True), (2, 0.0, 20.0, 0.1, 0.1, False), (3, 0.0, 20.0, 1.0, 1.0, None)], "k int, start double, end double, primary double, future double, seen boolean")
    found = spark.createDataFrame([(1, "turn_shift", 10.0), (1, "hold_pause", 12.0), (1, "hold_pause", 2.0), (2, "hold_pause", 12.0)], "k int, kind string, time double")
    regions = spark.createDataFrame([(1, 18.0, 20.0), (2, 10.0, 20.0)], "k int, start double, end double")
    none = regions.where("false")
    out = {r.k: r for r in audit.audit_windows(w, found, regions, none, ["k"], 30.0, analysed="seen").collect()}
    assert (out[1].accepted, out[1].masked, out[1].effective, out[1].n_events, out[1].category) == (True, 2.0, 14.0, 2, "hold_pause")
    assert out[1].covered == {"overlap_interruption": 0, "non_floor_feedback": 0, "hold_pause": 1, "turn_shift": 1}
    for k in (2, 3):
        assert (out[k].rejections, out[k].accepted, out[k].masked, out[k].effective, out[k].n_events) == (["missing_region_analysis"], False, 0.0, 0.0, 0)
    audited = audit.audit_windows(w, found, regions, none, ["k"], 30.0, analysed="seen")
    n = {(r.k, r.category): (r.windows, r.available, r.covered) for r in audit.category_summary(audited, found, ["k"]).collect()}
    assert n[1, "hold_pause"] == (1, 2, 1) and n[1, "turn_shift"] == (0, 1, 1) and n[2, "hold_pause"] == (0, 1, 0) and n[3, "background"] == (0, 0, 0) and len(n) == 15
    assert {(r.reason, r.windows) for r in audit.rejection_summary(audited.withColumn("all", F.lit(1)), ["all"]).collect() if r.windows} == {("missing_region_analysis", 2)}
    rec = spark.createDataFrame([(1, 100.0, True), (2, 100.0, False), (3, 50.0, None)], "k int, duration double, seen boolean")
    assert {r.k: r.usable for r in audit.usable_seconds(rec, regions, none, ["k"], 30.0, analysed="seen").collect()} == {1: 98.0, 2: 0.0, 3: 0.0}


def test_recordings_without_windows_have_no_anomaly(spark):
    from parley.operators import timeline

    w = spark.createDataFrame([(1, 0.0, 2.0, 0.9, 3, True)], "k int, start double, shift double, confidence double, persistence int, reliable boolean")
    rec = spark.createDataFrame([(1,), (2,)], "k int")
    out = {r.k: (r.kind, r.score, r.shift) for r in timeline.anomaly(w, ["k"], rec).collect()}
    assert out[2] == ("uncertain", 0.0, 0.0) and out[1][0] == "stable_offset"
