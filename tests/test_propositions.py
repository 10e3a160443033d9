"""Propositions against a plain version on small recordings."""

import random

from parley.operators import propositions as pp

K = ["k"]


def plain(k, duration, anchors, regions, limit):
    """Windows of the balanced anchors: (kind, time, start, masked, n_kind), in order."""
    found = []
    for kind, time, confidence in anchors:
        start = min(max(0.0, duration - 20), max(0.0, time - 12))
        end = min(duration, start + 20)
        begin = min(end, start + 4)
        masked = sum(max(0.0, min(end, e) - max(begin, s)) for s, e in regions) / (end - begin) if end > begin else 0.0
        n = sum(a[0] == kind and begin <= a[1] < end for a in anchors)
        found.append((kind, time, start, masked, n, confidence + 0.08 * min(3, n) - 0.8 * max(0.0, masked - 0.2)))
    by = {kind: sorted((f for f in found if f[0] == kind), key=lambda f: (-f[5], f[3], f[1])) for kind in pp.KINDS}
    out, rank = [], 0
    while len(out) < limit and any(len(v) > rank for v in by.values()):
        out += [v[rank] for v in by.values() if len(v) > rank]
        rank += 1
    return [f[:5] for f in out[:limit]]


def make(seed=3, n=6):
    rng = random.Random(seed)
    data = {}
    for k in range(n):
        d = rng.choice([10.0, 25.0, 90.0])
        anchors = [(rng.choice(pp.KINDS), rng.randrange(0, int(d * 8)) / 8, rng.randrange(0, 9) / 8) for _ in range(rng.randint(0, 14))]
        edges = sorted(rng.sample(range(int(d * 4)), 6))
        data[k] = (d, list(dict.fromkeys(anchors)), [(edges[i] / 4, edges[i + 1] / 4) for i in (0, 2, 4)])
    return data


def frames(spark, data):
    rows = lambda i: [(k, *r) for k, v in data.items() for r in v[i]]
    anchors = spark.createDataFrame(rows(1), "k int, kind string, time double, confidence double").repartition(3)
    regions = spark.createDataFrame([(*r, "silence") for r in rows(2)], "k int, start double, end double, reason string")
    return anchors, spark.createDataFrame([(k, v[0]) for k, v in data.items()], "k int, duration double"), regions


def test_balanced_anchors(spark):
    data = make()
    out = pp.balanced(pp.anchor_windows(*frames(spark, data), K), K, 7)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.k, r.place)):
        got.setdefault(r.k, []).append((r.kind, r.time, r.start, round(r.masked, 9), r.n_kind))
    assert got == {k: [(*f[:3], round(f[3], 9), f[4]) for f in plain(k, *v, 7)] for k, v in data.items() if v[1]}


def test_only_good_windows_in_available_spans(spark):
    data = {1: (100.0, [("turn_shift", 20.0, 1.0), ("turn_shift", 70.0, 1.0), ("hold_pause", 40.0, 0.1)], [(60.0, 80.0)])}
    chosen = pp.balanced(pp.anchor_windows(*frames(spark, data), K), K, 5)
    ratios = chosen.select("k", "start", "end").distinct().selectExpr("*", "1.0D AS primary", "1.0D AS future")
    marks = spark.createDataFrame([(1, t) for t in (13.0, 13.01, 15.0, 21.0, 9.0)], "k int, time double")
    whole = spark.createDataFrame([(1, 0.0, 100.0)], "k int, start double, end double")
    out = {r.time: r for r in pp.propositions(chosen, ratios, marks, whole, K).collect()}
    assert set(out) == {20.0}  # the second is masked, the third too unsure
    r = out[20.0]
    assert (r.start, r.end, r.n_marks, r.n_kind, r.reasons) == (8.0, 28.0, 3, 1, [])
    assert abs(r.score - (0.25 + 0.15 + 0.2 + 0.1 + 0.15 + 0.05)) < 1e-9
    late = spark.createDataFrame([(1, 9.0, 100.0)], "k int, start double, end double")
    assert pp.propositions(chosen, ratios, marks, late, K).collect() == []
