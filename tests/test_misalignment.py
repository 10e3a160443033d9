"""Misalignment review, review plans, frame maps, merged transcripts and acoustic offsets: known values and plain versions."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import acoustic, maps, review, text
from parley.operators import misalignment as mi

K = ["k"]
WINDOWS = "k int, start double, end double, shift double, confidence double, persistence int, sources int, accepted boolean, boundary boolean"


def audit_windows(suffix, k=1, prefix=5):
    """A quiet beginning, then windows a minute apart from 240 s on."""
    rows = [(k, i * 60.0, i * 60.0 + 180, 0.0, 0.9, 5, 2, True, False) for i in range(prefix)]
    return rows + [(k, 600 + i * 60.0, 600 + i * 60.0 + 180, s, 0.9, 5, 2, True, False) for i, s in enumerate(suffix)]


def test_piecewise_repair_of_a_stable_later_part(spark):
    w = audit_windows((4.0, 4.2, 4.3, 4.1, 4.2, 4.4))
    r = mi.piecewise_repair(spark.createDataFrame(w, WINDOWS).repartition(3), K).first()
    assert (r.first_shift, r.second_shift, r.shift_change, r.n_windows, r.stable_duration) == (0.0, 4.2, 4.2, 6, 480.0)
    assert (r.first_part_end, r.second_part_start, r.stable_start, r.stable_end) == (240.0, 780.0, 600.0, 1080.0)
    assert r.confidence == round(0.30 * (1 - 0.4 / 1.5) + 0.25 * 480 / 900 + 0.25 + 0.20 * 6 / 8, 3)


def test_one_noisy_window_moves_no_repair(spark):
    """Not reliable, it is passed over; reliable, it only ends the suffix there."""
    w = audit_windows((4.0, 4.2, 4.3, 4.1, 4.2, 4.4))
    noise = [(1, 660.0, 840.0, 11.0, 0.3, 1, 0, True, False), (1, 300.0, 480.0, -9.0, 0.95, 1, 2, True, False)]
    plain, noisy = (mi.piecewise_repair(spark.createDataFrame(x, WINDOWS), K).first() for x in (w, w + noise))
    assert plain == noisy
    broken = w + [(1, 540.0, 590.0, 9.0, 0.9, 5, 2, True, False)]
    assert mi.piecewise_repair(spark.createDataFrame(broken, WINDOWS), K).first() == plain


@pytest.mark.parametrize("suffix", [(4.0, 4.1, 4.2), (0.1, 0.2, 0.1, 0.2, 0.1, 0.2), (4.0, 9.0, 4.0, 9.0, 4.0, 9.0)])
def test_short_equal_or_unstable_suffixes_make_no_repair(spark, suffix):
    assert mi.piecewise_repair(spark.createDataFrame(audit_windows(suffix), WINDOWS), K).collect() == []


def test_suffix_follows_its_running_median(spark):
    rng = random.Random(3)
    rows = []
    for k in range(40):
        at, shift = 0.0, 0.0
        for _ in range(rng.randint(1, 60)):
            at += rng.choice([20.0, 60.0, 170.0, 190.0])
            shift += rng.choice([0, 0, 0.5, -0.25, 1.0])
            rows.append((k, at, at + 120, shift, rng.choice([0.6, 0.9]), rng.choice([2, 3]), rng.randint(0, 2), rng.random() < 0.9, rng.random() < 0.1))
    got = {r.k: (r.stable_start, r.first_end, r.stable_end, r.n_windows, r.shift, r.spread, r.agreement) for r in mi.stable_suffix(spark.createDataFrame(rows, WINDOWS).repartition(6), K).collect()}
    want = {}
    for k in range(40):
        good = [r for r in rows if r[0] == k and r[7] and not r[8] and r[4] >= 0.65 and r[5] >= 3]
        if good:
            run = [good[-1]]
            for r in reversed(good[:-1]):
                if run[0][1] - r[1] > 180 or abs(r[3] - statistics.median(x[3] for x in run)) > 1.25:
                    break
                run.insert(0, r)
            s = [r[3] for r in run]
            want[k] = (run[0][1], run[0][2], run[-1][2], len(run), statistics.median(s), max(s) - min(s), statistics.mean(r[6] / 2 for r in run))
    assert got == want


@pytest.mark.parametrize(
    ("kind", "shifts", "category", "shift", "scope"),
    [
        ("stable_offset", (0.18, 0.21, 0.24, 0.20), "likely_aligned", 0.21, "global_offset"),
        ("stable_offset", (3.1, 3.2, 3.3, 3.2), "likely_constant_offset", 3.2, "global_offset"),
        ("stable_offset", (0.02, 0.04, 0.03), "likely_aligned", None, None),
        ("stable_offset", (0.0, 3.0, 6.0), "non_constant_or_uncertain", None, None),
        ("temporal_change", (3.1, 3.2, 3.3, 3.2), "non_constant_or_uncertain", None, None),
    ],
)
def test_assessment(spark, kind, shifts, category, shift, scope):
    w = [(1, i * 60.0, i * 60.0 + 60, s, 0.9, 5, 2, True, False) for i, s in enumerate(shifts)]
    rec = spark.createDataFrame([(1, 600.0, None), (2, 600.0, 1.0)], "k int, duration double, mismatch double")
    audits = spark.createDataFrame([(1, kind, 0.4)], "k int, kind string, score double")
    a = {r.k: r for r in mi.alignment_assessment(rec, audits, spark.createDataFrame(w, WINDOWS), K).collect()}
    assert (a[1].category, a[1].shift, a[1].scope) == (category, shift, scope)
    assert (a[2].category, a[2].likelihood, a[2].scope) == ("non_constant_or_uncertain", 0.0, None)
    if category == "non_constant_or_uncertain":
        assert a[1].likelihood == 0.6


def brute_metrics(start, segs, speech, turns, backs, inter):
    end = start + 20
    own = sorted((s, e, d) for d, s, e in segs if e >= start and s <= end)
    alt = rapid = 0
    for (_, e, d), (s2, _, d2) in zip(own, own[1:], strict=False):
        if d != d2 and s2 - e <= 6:
            alt, rapid = alt + 1, rapid + (s2 - e <= 1.5)
    ms = lambda d: {t for x, s, e in speech if x == d for t in range(round(s * 1000), round(e * 1000))}
    both = len({t for t in ms(1) & ms(2) if start * 1000 <= t < end * 1000}) / 1000
    n = [sum(start <= t <= end for t in turns), sum(e >= start and s <= end for s, e in backs), sum(start <= t <= end for t in inter)]
    return alt, rapid, *n, round(both, 3), round(2 * alt + 1.5 * rapid + 0.8 * n[0] + 1.8 * n[1] + 2 * n[2] + 0.5 * min(6, both), 3)


def test_clip_metrics_and_queue(spark):
    rng = random.Random(9)
    ms = lambda hi: rng.randrange(0, hi, 2) / 1000
    data = {}
    for k in range(4):
        spans = [(d, s, s + 0.2 + ms(5000)) for d in (1, 2) for s in sorted(ms(120_000) for _ in range(25))]
        data[k] = (spans[::2], spans, [ms(120_000) for _ in range(8)], [(s, s + 0.5) for s in (ms(119_000) for _ in range(5))], [ms(120_000) for _ in range(4)])
    frame = lambda i, schema: spark.createDataFrame([(k, *(r if isinstance(r, tuple) else (r,))) for k, v in data.items() for r in v[i]], schema)
    segs, speech = (frame(i, "k int, side int, start double, end double") for i in (0, 1))
    turns, inter = (frame(i, "k int, time double") for i in (2, 4))
    backs = frame(3, "k int, start double, end double")
    rec = spark.createDataFrame([(k, 120.0, 3.0) for k in data] + [(9, 10.0, None)], "k int, duration double, mismatch double")
    events = turns.unionByName(inter).unionByName(backs.select("k", F.col("start").alias("time")))
    clips = mi.window_metrics(mi.candidate_starts(rec, events, K), segs, speech, turns, backs, inter, K, 30.0)
    rows = clips.collect()
    for k, v in data.items():
        late, most = 72.0, 100.0
        times = [*v[2], *v[4], *(s for s, _ in v[3])]
        want = {float(x) for x in range(75, 101, 5)} | {round(min(most, max(late, t - 10)), 3) for t in times if t >= late} | {100.0}
        assert {r.start for r in rows if r.k == k} == want
    for r in rows:
        assert (r.alternations, r.rapid, r.turns, r.backchannels, r.interruptions, r.both, r.score) == brute_metrics(r.start, *data[r.k]), r
    assert not [r for r in rows if r.k == 9]
    judged = spark.createDataFrame([(0, 0.0, 20.0, "likely_misaligned"), (1, 75.0, 95.0, "unsure")], "k int, start double, end double, verdict string")
    windows = spark.createDataFrame([(k, i * 60.0, i * 60.0 + 60, 2.0, 0.9, 5, 2, True, False) for k in (2, 3) for i in range(3)], WINDOWS)
    audits = spark.createDataFrame([(2, "stable_offset", 0.5), (3, "temporal_change", 0.9)], "k int, kind string, score double")
    queue = mi.misalignment_queue(clips, mi.alignment_assessment(rec, audits, windows, K), mi.suspicion(rec, audits, windows, K), judged, K, 10).collect()
    assert [(r.k, r.unsure) for r in queue] == [(2, False), (3, False), (1, True)]
    for r in queue:
        free = [c for c in rows if c.k == r.k and not (r.k == 1 and c.start < 95 and c.start + 20 > 75)]
        best = max(free, key=lambda c: (c.score, c.start))
        assert (r.start, r.score) == (best.start, best.score)


def test_suspicion_values(spark):
    rec = spark.createDataFrame([(1, 600.0, 3.0), (2, 600.0, None), (3, 600.0, 60.0)], "k int, duration double, mismatch double")
    audits = spark.createDataFrame([(1, "stable_offset", 0.8), (2, "x", 0.5)], "k int, kind string, score double")
    w = [(1, 400.0, 460.0, 2.5, 0.9, 3, 1, True, False), (1, 300.0, 360.0, 5.0, 0.9, 3, 2, True, True), (1, 0.0, 100.0, 5.0, 0.9, 9, 2, True, False)]
    s = {r.k: r for r in mi.suspicion(rec, audits, spark.createDataFrame(w, WINDOWS), K).collect()}
    assert abs(s[1].suspicion - (1 - (1 - 0.8 * (0.35 + 0.175 + 0.3)) * (1 - 0.65 * 0.5))) < 1e-12 and s[1].late_shift == 2.5
    assert abs(s[2].suspicion - 0.1) < 1e-12 and abs(s[3].suspicion - 0.65) < 1e-12


def test_review_plan(spark):
    rng = random.Random(1)
    rec = [(g, k, 15.0 + 10 * (k % 30), k % 5 > 0) for g in "ab" for k in range(40)] + [("c", 1, 100.0, True)]
    ex = [(g, k, s, s + rng.uniform(0, 30)) for g, k, d, _ in rec for s in [rng.uniform(0, d) for _ in range(k % 4)]]
    r = spark.createDataFrame(rec, "g string, k int, duration double, analysed boolean").repartition(4)
    x = spark.createDataFrame(ex, "g string, k int, start double, end double").repartition(3)
    allowed = {(g, k): [f * 0.08 for f in range(int(max(0.0, d - 20) / 0.08) + 1) if not any(f * 0.08 < e and f * 0.08 + 20 > s for a, b, s, e in ex if (a, b) == (g, k))] for g, k, d, _ in rec}
    starts = {(q.g, q.k): q for q in review.review_starts(r, x, ["g", "k"], "s").collect()}
    assert set(starts) == {q for q, v in allowed.items() if v}
    assert all(q.start in allowed[q.g, q.k] and q.room == len(allowed[q.g, q.k]) for q in starts.values())
    plan = review.plan_review(r, x, "g", "k", 6, "s")
    rows = plan.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, review.plan_review(r.repartition(1), x, "g", "k", 6, "s").collect()))
    assert sorted(q.g for q in rows) == ["a"] * 6 + ["b"] * 6 + ["c"] and len({(q.g, q.k) for q in rows}) == 13
    assert all(q.k % 5 and allowed[q.g, q.k] for q in rows if q.g != "c") and {q.side for q in rows} == {1, 2}
    assert {(q.g, q.k) for q in review.plan_review(r, x, "g", "k", 6, "t").collect()} != {(q.g, q.k) for q in rows}
    assert [tuple(q) for q in review.shortfalls(plan, r, "g", 6).collect()] == [("c", 1)]
    new = review.replacements(plan.where("place <= 3"), plan, r, x, "g", "k", "s").collect()
    planned, used = {(q.g, q.k) for q in rows}, {(q.g, q.new_key) for q in new}
    assert len(new) == 6 and len(used) == 6 and not used & planned and all(q.start in allowed[q.g, q.new_key] for q in new)


def test_draws_are_uniform_over_what_is_left(spark):
    spans = spark.createDataFrame([(1, 0, 10), (1, 50, 80), (1, 90, 90), (2, 5, 5)], "k int, start long, end long")
    draws = spark.range(40000).select((F.col("id") % 2 + 1).cast("int").alias("k"), review.draw("s", "id").alias("u"))
    n = {r.place: r["count"] for r in review.by_measure(spans, draws, ["k"]).groupBy("place").count().collect()}
    assert set(n) == set(range(10)) | set(range(50, 80)) and sum(n.values()) == 20000 and all(380 < c < 630 for c in n.values())


def test_usable_starts_prefer_unmasked_windows(spark):
    free = spark.createDataFrame([(1, 0, 100), (1, 200, 320), (2, 0, 20), (3, 0, 19), (4, 0, 60)], "k int, start long, end long")
    bad = spark.createDataFrame([(1, 0, 300), (1, 10, 50), (2, 4, 8), (4, 0, 60)], "k int, start long, end long")
    got = {r.k: (r.start, r.ratio) for r in review.usable_starts(free, bad, ["k"], "s", 20, 4, 50).collect()}
    assert set(got) == {1, 2, 4} and got[2] == (0, 0.25) and got[4][1] == 1.0
    assert got[1][0] + 20 > 300 - 6 and got[1][1] <= 0.35


def plain_pieces(n, rate, first, second, low=None, high=None):
    """Source frame of each output frame, None where silent."""
    out = [None] * n
    a, b = (n, n) if low is None else (min(n, round(low * rate)), min(n, round(high * rate)))
    for f in range(n):
        if low is not None and a <= f < b:
            continue
        s = f - round((second if low is None or f >= b else first) * rate)
        out[f] = s if 0 <= s < n else None
    return out


def test_frame_maps(spark):
    rng = random.Random(4)
    plans = [(0, 100, 10, 0.0, 0.0, None, None), (1, 100, 10, 0.0, 2.0, None, None), (2, 100, 10, 0.0, -3.05, None, None), (3, 100, 10, 0.0, 50.0, None, None), (4, 100, 10, 1.0, -2.0, 4.0, 6.0), (5, 0, 10, 0.0, 1.0, None, None), (6, 100, 10, 1.0, 1.0, 5.0, 5.0), (7, 100, 10, 20.0, -20.0, 9.0, 30.0)]
    plans += [(10 + i, rng.randint(1, 300), 10, rng.randint(-80, 80) / 8, rng.randint(-80, 80) / 8, *sorted((rng.randint(0, 240) / 8, rng.randint(0, 240) / 8))) for i in range(40)]
    df = spark.createDataFrame(plans, "k int, n_frames long, rate int, first_shift double, second_shift double, exclude_from double, exclude_to double")
    pieces = maps.repair_pieces(df, ["k"]).cache()
    by = {}
    for r in pieces.collect():
        by.setdefault(r.k, []).append((r.start, r.end, r.offset))
    frames = {}
    for k, n, rate, first, second, low, high in plans:
        want = plain_pieces(n, rate, first, second, low, high)
        own = sorted(by.get(k, []))
        assert [x for a, b, o in own for x in [None if o is None else f - o for f in range(a, b)]] == want, k
        assert all(p[2] != q[2] for p, q in zip(own, own[1:], strict=False))
        frames[k] = want
    m = maps.sounding(pieces)
    back = maps.compose(maps.invert(m, ["k"]), m, ["k"], 50).collect()
    there_and_back = maps.compose(m, maps.invert(m, ["k"]), ["k"], 50)
    # Output, source and output again: every sounding frame finds itself.
    same = {(r.k, f) for r in there_and_back.where("offset = 0").collect() for f in range(r.start, r.end)}
    assert same == {(k, f) for k, v in frames.items() for f, s in enumerate(v) if s is not None}
    assert all(r.offset == 0 for r in back)  # a source frame, wherever it stands, comes back as itself
    spans = spark.createDataFrame([(k, a, a + n, i) for i, (k, a, n) in enumerate((k, rng.randrange(0, 250), rng.randint(1, 60)) for k in list(frames) * 6)], "k int, start long, end long, i int")
    whole = {r.i: (r.source_start, r.source_end) for r in maps.source_intervals(spans, m, ["k"], 50).collect()}
    carried = {}
    for r in maps.carry(spans, m, ["k"], 50).collect():
        carried.setdefault(r.i, []).extend(range(r.start, r.end))
    for r in spans.collect():
        own = [frames[r.k][f] if f < len(frames[r.k]) else None for f in range(r.start, r.end)]
        assert sorted(carried.get(r.i, [])) == sorted(s for s in own if s is not None)
        straight = None not in own and all(y == x + 1 for x, y in zip(own, own[1:], strict=False))
        assert whole[r.i] == ((own[0], own[-1] + 1) if straight else (None, None))


WORD = "struct<text:string,start:double,end:double,confidence:double>"


def test_progressive_merge(spark):
    a = [("hello", 0.0, 0.3, None), ("world", 0.9, 1.1, 0.5)]
    b = [("hello", 0.0, 0.4, 0.7), ("there", 0.5, 0.8, None), ("world", 0.9, 1.2, 0.7)]
    c = [("Hello,", 0.2, 0.35, 0.9), ("their", 0.45, 0.8, None), ("...", 0.8, 0.81, None), ("world", None, None, None), ("again", None, None, None)]
    rows = [("x", 1, a), ("x", 2, b), ("y", 3, c), ("y", 1, a), ("y", 2, b), ("z", 1, None), ("z", 2, a), ("w", 1, c)]
    df = spark.createDataFrame(rows, f"k string, rank int, words array<{WORD}>").repartition(4)
    got = {}
    for r in sorted(text.progressive_merge(df, ["k"]).collect(), key=lambda r: r.place):
        got.setdefault(r.k, []).append((r.text, None if r.start is None else round(r.start, 6), None if r.end is None else round(r.end, 6), r.confidence))
    assert got["x"] == [("hello", 0.0, 0.35, 0.7), ("there", 0.5, 0.8, None), ("world", 0.9, 1.15, 0.6)]
    assert got["y"] == [("hello", 0.1, 0.35, 0.8), ("their", 0.45, 0.8, None), ("there", 0.5, 0.8, None), ("world", 0.9, 1.15, 0.6), ("again", None, None, None)]
    assert got["z"] == [("hello", 0.0, 0.3, None), ("world", 0.9, 1.1, 0.5)] and len(got["w"]) == 5


def test_acoustic_offset_finds_planted_shifts(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k, lag in enumerate((0, 13, -40, 200, -239)):
        base = rng.exponential(size=2600)
        rows.append((k, lag, base[300:2300].tolist(), (base[300 + lag : 2300 + lag] + 0.2 * rng.exponential(size=2000)).tolist()))
    rows += [(10, None, [1.0] * 2000, rows[0][2]), (11, None, [1.0, 2.0], [1.0, 2.0]), (12, None, None, rows[0][2])]
    out = acoustic.with_offset(spark.createDataFrame(rows, "k int, lag int, a array<double>, b array<double>"), "a", "b").collect()
    for r in out:
        if r.lag is None:
            assert r.offset is None
            continue
        assert abs(r.offset.shift - r.lag * 0.05) < 1e-9 and r.offset.peak > 0.5 and r.offset.margin > 0.3
        x, y = (np.array(v) for v in (r.a, r.b))
        x, y = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()
        brute = [np.mean(x[max(0, g) : 2000 + min(0, g)] * y[max(0, -g) : 2000 - max(0, g)]) for g in range(-240, 241)]
        assert abs(max(brute) - r.offset.peak) < 1e-9


def test_onset_envelope(spark):
    rng = np.random.default_rng(1)
    p = {k: rng.exponential(size=80) * (rng.random(80) > 0.1) for k in (1, 2)}
    df = spark.createDataFrame([(k, i, float(v)) for k, own in p.items() for i, v in enumerate(own)], "k int, frame int, power double").repartition(5)
    got = {(r.k, r.frame): r.onset for r in acoustic.onset_envelope(df, ["k"]).collect()}
    for k, own in p.items():
        db = 10 * np.log10(np.maximum(own, 1e-12))
        cut = np.clip(db, *np.percentile(db, (5, 95)))
        assert np.allclose([got[k, i] for i in range(80)], np.abs(np.diff(cut, prepend=cut[0])))
