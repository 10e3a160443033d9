"""Operators of conversations on small cases, and against plain Python versions."""

import random

import pytest
from pyspark.sql import functions as F

from parley.operators import catalog, composition, corpus, dialogue, evaluation, events, frames, intervals, sync, text, turns


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def random_spans(n, seed, side=(1, 2)):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        s = rng.randrange(0, 1000)
        out.append((rng.randrange(3), rng.choice(side), s, s + rng.randrange(0, 40)))
    return out


def plain_union(spans):
    out = []
    for s, e in sorted(x for x in spans if x[1] > x[0]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


SCHEMA = "k int, side int, start int, end int"


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_algebra_against_points(spark, seed):
    data = random_spans(120, seed)
    df = spark.createDataFrame(data, SCHEMA)
    a, b = df.where("side = 1"), df.where("side = 2")
    for k in range(3):
        pa = {p for kk, side, s, e in data if kk == k and side == 1 for p in range(s, e)}
        pb = {p for kk, side, s, e in data if kk == k and side == 2 for p in range(s, e)}
        points = lambda x: [p for s, e in rows(x.where(F.col("k") == k), "start", "end") for p in range(s, e)]
        assert rows(intervals.union(a, ["k"], slice_width=100).where(F.col("k") == k), "start", "end") == sorted(plain_union([(s, e) for kk, side, s, e in data if kk == k and side == 1]), key=repr)
        assert set(points(intervals.intersect(a, b, ["k"], 50))) == pa & pb
        assert sorted(points(intervals.subtract(intervals.union(a, ["k"]), b, ["k"], 50))) == sorted(pa - pb)
        covered = {r[0]: r[1] for r in intervals.measure(a, ["k"]).collect()}
        assert covered.get(k, 0) == len(pa)
    bounds = spark.createDataFrame([(k, 0, 1100) for k in range(3)], "k int, low int, high int")
    gaps = intervals.measure(intervals.gaps(a, ["k"], bounds=bounds), ["k"])
    both = gaps.withColumnRenamed("measure", "g").join(intervals.measure(a, ["k"]), "k")
    assert both.where("g + measure != 1100").count() == 0


def test_overlap_join_once_per_pair(spark):
    a = spark.createDataFrame([(1, 0, 1000), (1, 5, 6), (2, 0, 10)], "k int, start int, end int")
    b = spark.createDataFrame([(1, 0, 1000), (1, 6, 7), (2, 10, 20)], "k int, start int, end int")
    assert intervals.overlap_join(a, b, ["k"], 10).count() == 3
    assert intervals.overlap_join(a, b, ["k"], 10, closed=True).count() == 5
    assert rows(intervals.overlap_join(a, b, ["k"], 10, how="left_anti"), "k", "start") == [(2, 0)]


def test_merge_unless_blocked(spark):
    own = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.2, 2.0), (1, 2.2, 3.0)], "k int, start double, end double")
    other = spark.createDataFrame([(1, 2.05, 2.1)], "k int, start double, end double")
    assert rows(intervals.merge_unless_blocked(own, other, ["k"], 0.25, 10.0), "start", "end") == [(0.0, 2.0), (2.2, 3.0)]


def test_regions_fixture(spark):
    spans = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 1, 20.0, 30.0), (1, 2, 12.0, 18.0), (1, 2, 70.0, 75.0)], "k int, side int, start double, end double")
    found = rows(events.dual_silence(spans, spark.createDataFrame([(1, 0.0, 120.0)], "k int, low double, high double"), ["k"], 6.0), "start", "end")
    assert found == [(30.0, 70.0), (75.0, 120.0)]
    assert (30.0, 70.0, "slow_turn_exchange") in rows(events.slow_exchange(spans, ["k"], 3.0), "start", "end", "reason")


def test_asof(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 1)], "k int, t int")
    right = spark.createDataFrame([(1, 4), (1, 10), (1, 30)], "k int, u int")
    out = lambda **o: rows(intervals.asof(left, right, ["k"], "t", "u", **o).select("k", "t", F.col("match.u").alias("u")), "k", "t", "u")
    assert out(forward=True) == [(1, 10, 10), (1, 5, 10), (2, 1, None)]
    assert out(forward=False) == [(1, 10, 10), (1, 5, 4), (2, 1, None)]
    assert out(forward=True, strict=True) == [(1, 10, 30), (1, 5, 10), (2, 1, None)]
    assert out(forward=True, tolerance=4) == [(1, 10, 10), (1, 5, None), (2, 1, None)]


def test_alignment_ties_and_counts(spark):
    assert text.align(["a", "b", "c"], ["a", "c"]) == [("equal", 0, 0), ("delete", 1, -1), ("equal", 2, 1)]
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(8))] for _ in range(2))
        ops = text.align(a, b)
        assert [i for _, i, _ in ops if i >= 0] == list(range(len(a))) and [j for _, _, j in ops if j >= 0] == list(range(len(b)))
        assert sum(o != "equal" for o, _, _ in ops) == plain_distance(a, b)
        assert all(a[i] == b[j] for o, i, j in ops if o == "equal")
    df = spark.createDataFrame([(["hello", "world", "again"], ["hello", "there", "again", "now"])], "r array<string>, h array<string>")
    n = text.error_counts("alignment")
    assert rows(text.with_alignment(df, "r", "h"), n["substitutions"], n["insertions"], n["deletions"], n["n_words"], F.round(n["wer"], 6)) == [(1, 1, 0, 3, 0.666667)]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_tokens(spark):
    df = spark.createDataFrame([("Uh-huh! go- DON'T  ＡＢ ...",)], "t string")
    assert df.select(text.tokens(F.col("t"))).first()[0] == ["uh-huh", "go-", "don't"]
    assert df.select(text.tokens(text.nfkc(F.col("t")))).first()[0] == ["uh-huh", "go-", "don't", "ab"]


def test_merge_aligned(spark):
    word = "array<struct<text:string,start:double,end:double,confidence:double>>"
    a = [("hello", 0.0, 0.3, None), ("world", 0.9, 1.1, None)]
    b = [("hello", 0.0, 0.4, None), ("there", 0.5, 0.8, None), ("world", 0.9, 1.2, None)]
    df = spark.createDataFrame([(a, b)], f"a {word}, b {word}").withColumn("x", F.transform("a", lambda w: w["text"])).withColumn("y", F.transform("b", lambda w: w["text"]))
    out = text.merge_aligned(text.with_alignment(df, "x", "y"), "a", "b", "alignment").first()["merged"]
    assert [(w.text, round(w.start, 3), round(w.end, 3)) for w in out] == [("hello", 0.0, 0.35), ("there", 0.5, 0.8), ("world", 0.9, 1.15)]


def test_logical_turns_and_scores(spark):
    t = "k int, start double, end double, n_words long, text string"
    own = spark.createDataFrame([(1, 0.0, 1.0, 6, "so then we went home again"), (1, 1.15, 2.0, 6, "and it was a long way"), (1, 6.0, 7.0, 6, "which we did not mind much")], t)
    other = spark.createDataFrame([(1, 3.0, 5.5, 9, "we should have taken the bus that day though")], t)
    seg, con = turns.segment_hypotheses(own, other, ["k"], 10.0), turns.connection_hypotheses(own, other, ["k"], 10.0)
    merge = {r.start: round(r.merge, 3) for r in con.collect()}
    assert merge[1.0] == 1.0 and merge[2.0] == 0.0
    assert rows(turns.logical_turns(seg, con, ["k"]), "start", "end", "n_turns") == [(0.0, 2.0, 2), (6.0, 7.0, 1)]
    listener = spark.createDataFrame([(1, 3.5, 3.8, 1, "yeah")], t)
    assert turns.segment_hypotheses(listener, other, ["k"], 10.0).first()["keep_playing"] > 0.5


def test_contextual_turns(spark):
    data = [(1, 1, 0.0, 2.0, 8, "what do you think?"), (1, 2, 2.2, 2.6, 1, "yeah"), (1, 1, 3.0, 9.0, 20, "well let me go on"), (1, 2, 5.0, 5.3, 1, "right"), (1, 1, 9.2, 10.0, 3, "and on")]
    out = turns.contextual(spark.createDataFrame(data, "k int, speaker int, start double, end double, n_words int, text string"), ["k"])
    flags = {r.start: (r.backchannel, r.interruption) for r in out.collect()}
    assert flags[2.2] == (False, False)  # it answers a question
    assert flags[5.0] == (True, True)


def test_vad_segments(spark):
    def track(side, on):
        return [(1, side, i, 0.1 if any(a <= i < b for a, b in on) else 1e-6) for i in range(200)]

    f = spark.createDataFrame(track(1, [(10, 40), (45, 80)]) + track(2, [(100, 150)]), "k int, side int, frame int, rms double")
    out = frames.speech_segments(frames.speech_mask(f, ["k", "side"]), ["k"])
    assert [(s, round(a, 2), round(b, 2)) for s, a, b in rows(out, "side", "start", "end")] == [(1, 0.3, 2.4), (2, 3.0, 4.5)]


def test_crosstalk(spark):
    powers = spark.createDataFrame([(1, i, t, o) for i, (t, o) in enumerate(zip([1.0, 0.1, 0.001], [0.01, 1.0, 0.001], strict=True))], "k int, frame long, target double, other double")
    words = spark.createDataFrame([(1, float(i), i + 1.0, f"w{i}") for i in range(3)], "k int, start double, end double, text string")
    assert rows(frames.crosstalk_words(words, powers, ["k"], frame=1.0).where("keep"), "text") == [("w0",)]


def test_split_quotas(spark):
    sizes = {1: (1, 0, 0), 2: (2, 0, 0), 3: (1, 1, 1), 4: (2, 1, 1), 8: (6, 1, 1), 10: (8, 1, 1), 29: (23, 3, 3), 33: (27, 3, 3), 37: (29, 4, 4)}
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    got = {r[0]: tuple(r)[1:] for r in df.select("n", *corpus.split_quotas(F.col("n"))).collect()}
    assert got == sizes
    rows_ = [(f"d{n}", f"s{i}") for n in (3, 10, 29) for i in range(n)]
    a = spark.createDataFrame(rows_, "d string, s string")
    one, two = (sorted(map(tuple, corpus.assign_splits(x, "d", "s", "seed").collect())) for x in (a, a.orderBy(F.rand(1))))
    assert one == two
    assert one != sorted(map(tuple, corpus.assign_splits(a, "d", "s", "other").collect()))


def test_lag(spark):
    rng = random.Random(7)
    base = [rng.random() < 0.5 for _ in range(2000)]
    for i in range(1, 2000):
        base[i] = base[i - 1] if rng.random() < 0.9 else base[i]
    late = [False] * 23 + [not x for x in base[:-23]]
    df = spark.createDataFrame([(base, late)], "a array<boolean>, b array<boolean>")
    e = sync.with_stable_lag(df, "a", "b").first()["estimate"]
    assert abs(e.shift + 0.69) < 1e-9 and e.accepted


def test_weighted_median(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 1.0), (1, 3.0, 5.0)], "k int, v double, w double")
    assert sync.weighted_median(df, ["k"], "v", "w").first()[1] == 3.0


def test_catalogue(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 5, None)], "k int, t int, v string")
    assert rows(catalog.latest(df, ["k"], "t"), "k", "t", "v") == [(1, 2, "b"), (2, 5, None)]
    new = spark.createDataFrame([(1, 9, None), (3, 1, "n")], "k int, t int, v string")
    assert rows(catalog.upsert(catalog.latest(df, ["k"], "t"), new, ["k"], keep=["v"]), "k", "t", "v") == [(1, 9, "b"), (2, 5, None), (3, 1, "n")]
    s = spark.createDataFrame([(i, 10) for i in range(10)], "i int, size int").withColumn("slice", F.floor(F.col("i") / 3))
    plain = rows(catalog.cumulative_prefix(s, ["i"], "size", 45), "i")
    assert plain == rows(catalog.cumulative_prefix(s, ["i"], "size", 45, slices="slice"), "i") == [(0,), (1,), (2,), (3,)]
    assert rows(catalog.cumulative_prefix(s, ["i"], "size", 5, slices="slice"), "i") == [(0,)]


def test_dialogues(spark):
    assert [dialogue.calculate(x) for x in ("1/3*3", "2*(3+4)", "1/0", "__import__('os')", "0.1+0.2", "9" * 200)] == ["0.9999999999999999999999999999", "14", None, None, "0.3", None]
    m = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}") for c in range(30) for t in range(6)]
    d = dialogue.nest(spark.createDataFrame(m, "c int, t int, role string, text string"), "c", "t", ["role", "text"]).withColumn("n", F.lit(3)).withColumn("g", F.lit(1))
    assert dialogue.violations(d, "c").count() == 0


def test_compositions(spark):
    """Each dialogue once, 8 to 16 turns of two buckets or more, whatever the partitioning."""
    rng = random.Random(3)
    rows = [(i, i % 3, rng.choice("abcde") if i % 11 else None, rng.choice([1, 2, 3, 4, 5, 7])) for i in range(900)]
    df = spark.createDataFrame(rows, "c int, g int, family string, n int")
    out = composition.compose(df.repartition(7), "c", ["g"], "family", "n", "seed").collect()
    again = composition.compose(df.repartition(2, "family"), "c", ["g"], "family", "n", "seed").collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    assert sorted(map(tuple, out)) != sorted(map(tuple, composition.compose(df, "c", ["g"], "family", "n", "other").collect()))
    assert sorted(r.c for r in out) == list(range(900))
    by = {}
    for r in out:
        assert (r.bucket, r.turns) == (rows[r.c][2] or "", rows[r.c][3])
        by.setdefault((r.g, r.composition), []).append(r)
    for members in by.values():
        assert sorted(r.place for r in members) == list(range(len(members)))
        if members[0].whole:
            assert 8 <= sum(r.turns for r in members) <= 16 and len({r.bucket for r in members}) > 1
        else:
            assert len(members) == 1
    assert sum(not r.whole for r in out) <= 6
    assert len({tuple(sorted(r.turns for r in m)) for m in by.values()}) > 20


def test_composition_plans():
    for counts in ({("a", 3): 7}, {("a", 20): 2, ("b", 1): 1}, {}, {("a", 8): 1, ("b", 8): 1}, {("a", 1): 1000, ("b", 1): 1}, {(b, t): 50 + t for b in "abc" for t in range(1, 9)}):
        placed = {}
        for pattern, times, whole in composition.plan(counts, 8, 16):
            for k in pattern:
                placed[k] = placed.get(k, 0) + times
            assert times > 0 and (not whole or (8 <= sum(t for _, t in pattern) <= 16 and len({b for b, _ in pattern}) > 1)) and (whole or len(pattern) == 1 or times > 0)
        assert placed == counts


def test_evaluation(spark):
    df = spark.createDataFrame([("h", 0.5, 1.0, 1.0), ("h", 1.0, 1.0, 3.0), ("h", 0.3, -1.0, 9.0)], "head string, p double, y double, w double")
    r = evaluation.head_metrics(df, "head", "p", "y", "w").first()
    assert r.support == 4.0 and abs(r.brier - 0.0625) < 1e-12
    x = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    assert x.select(evaluation.resample_nearest(F.col("v"), F.lit(5))).first()[0] == [1.0, 1.0, 2.0, 3.0, 3.0]


def test_timeline_repair(spark):
    from parley.operators.repair import Repair, available, copy_plan, segments, source_interval, words

    r = Repair(1.0, 3.0, change=50.0, exclude_from=45.0, exclude_to=55.0)
    assert r.boundary == 48.0
    df = spark.createDataFrame([(1, 0.0, 10.0), (2, 0.0, 10.0), (2, 47.0, 49.0), (2, 60.0, 61.0)], "track int, start double, end double")
    assert rows(segments(df, r), "track", "start", "end") == [(1, 0.0, 10.0), (2, 1.0, 11.0), (2, 48.0, 49.0), (2, 51.0, 52.0), (2, 63.0, 64.0)]
    assert rows(words(df, r, 63.5), "track", "start", "end") == [(1, 0.0, 10.0), (2, 1.0, 11.0), (2, 63.0, 63.5)]
    out = spark.createDataFrame([(1.0, 2.0), (44.0, 46.0), (60.0, 61.0)], "s double, e double").select(source_interval(F.col("s"), F.col("e"), r).alias("x")).collect()
    assert [None if o.x is None else tuple(o.x) for o in out] == [(0.0, 1.0), None, (57.0, 58.0)]
    assert available(100.0, r) == [(1.0, 45.0), (55.0, 100.0)]
    plan = copy_plan(100, 1, r)
    assert plan == [(0, 1, None), (1, 45, 0), (45, 55, None), (55, 100, 52)]
    assert copy_plan(10, 1, Repair(-2.0)) == [(0, 8, 2), (8, 10, None)]


def test_floor_state(spark):
    rng = random.Random(4)
    segs, cons, acts, points = [], [], [], []
    for k in range(8):
        t = 0.0
        own = []
        for _ in range(12):
            t += rng.choice([-0.5, 0.4, 0.9, 1.6])
            own.append((k, t, t + rng.choice([0.5, 1.5]), rng.random()))
            t = own[-1][2]
        segs += own
        for a, b in zip(own, own[1:]):
            if b[1] > a[2]:
                cons.append((k, a[2] + rng.choice([0.0, 0.05, 0.2]), b[1] + rng.choice([0.0, -0.05]), rng.random(), rng.random()))
        acts += [(k, x, x + 0.3) for x in (rng.uniform(0, t) for _ in range(6))]
        points += [(k, rng.uniform(-1, t + 1)) for _ in range(150)]

    def plain(k, t):
        mine = sorted(s[1:] for s in segs if s[0] == k)
        for a, b, turn in mine:
            if a <= t < b:
                return turn
        for c in sorted(c for c in cons if c[0] == k):
            if c[1] <= t < c[2]:
                early = [s[2] for s in mine if abs(s[1] - c[1]) <= 0.08]
                late = [s[2] for s in mine if abs(s[0] - c[2]) <= 0.08]
                return c[3] * (1 - 0.5 * c[4]) * min(early[0], late[0]) if early and late else -1.0
        return -1.0 if any(a[0] == k and a[1] <= t < a[2] for a in acts) else 0.0

    df = lambda x, names: spark.createDataFrame(x, names)
    out = frames.floor_state(df(points, "k int, time double"), df(segs, "k int, start double, end double, turn double"), df(cons, "k int, start double, end double, merge double, pause double"), df(acts, "k int, start double, end double"), ["k"], 10.0)
    got = {(r.k, r.time): r.floor for r in out.collect()}
    expected = {p: plain(*p) for p in points}
    assert got.keys() == expected.keys() and all(abs(got[p] - expected[p]) < 1e-12 for p in points)
    assert len({v for v in expected.values() if v not in (-1.0, 0.0)}) > 50


def test_lag_loss_argmin_takes_every_pair(spark, tmp_path):
    from parley.plans import QUERIES

    rng = random.Random(6)
    x = {i: [rng.uniform(-1, 1) for _ in range(64)] for i in range(9)}
    spark.createDataFrame(list(x.items()), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    expected = []
    for i in range(8):
        loss = {lag: sum((x[i][t] > 0) == (x[i + 1][t - lag] > 0) for t in range(6, 58)) for lag in range(-5, 6)}
        lag = min(loss, key=lambda g: (loss[g], g))
        expected.append((i, lag, loss[lag]))
    assert rows(QUERIES["lag_loss_argmin"](spark, str(tmp_path)), "vec_id", "lag", "loss") == sorted(expected, key=repr)


def test_revision_stable_prefix_reads_whole_texts(spark, tmp_path):
    import os.path
    import re

    from parley.plans import QUERIES

    rng = random.Random(7)
    said = [(c, t, " ".join(rng.choice(["one", "and", "on", "three,", "four."]) for _ in range(rng.randrange(1, 60)))) for c in range(3) for t in range(8)]
    spark.createDataFrame(said, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    expected = []
    for c, t, text in said:
        was = re.sub(r"\S+\s*$", "and on", text)
        cut = re.match(r"(?s)^.*[\s.,!?;:]", os.path.commonprefix([was, text]))
        expected.append((c, t, text if was == text else cut.group() if cut else ""))
    assert max(len(e[2]) for e in expected) > 60
    assert rows(QUERIES["revision_stable_prefix"](spark, str(tmp_path)), "conv_id", "turn", "stable") == sorted(expected, key=repr)
