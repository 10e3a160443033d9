"""The offset estimator against a plain version, and its choice of configurations by held-out folds."""

import json
import math
import random

from parley.operators import offsets

SCHEMA = "k int, full boolean, sources array<struct<source:string,shift:double,improvement:double,joint:double>>, windows array<struct<source:string,start:double,shift:double,improvement:double,joint:double>>, label double, fold int"
BASE = {"least_lag": 0.4, "least_improvement": 0.02, "least_joint": 0.0, "least_sources": 1, "fallback": "all_sources"}


def plain(row, c):
    _, full, sources, windows, *_ = row
    static = [s for s in sources if not full or s[0] != offsets.ANNOTATION]
    real = [s for s in static if abs(s[1]) >= c["least_lag"] and s[2] >= c["least_improvement"] and s[3] >= c["least_joint"]]
    if len(real) < c["least_sources"]:
        if c["fallback"] == "zero_shift":
            return 0.0
        real = static
    if not real:
        return 0.0
    step = lambda x: round(round(x / 0.1) * 0.1, 1)
    if full and windows:
        by = {}
        for w in windows:
            by.setdefault(w[0], []).append(w)
        series = sorted(by[max(by, key=lambda s: (sum(w[3] + 2 * w[4] for w in by[s]), s))], key=lambda w: w[1])
        moving = [w[2] for w in series if w[3] >= c["least_improvement"] and w[4] >= c["least_joint"]]
        if len(moving) >= 2 and max(moving) - min(moving) >= 1.5:
            return step(series[0][2])
    weighed = sorted((s[1], max(0.001, s[2] + 2 * s[3])) for s in real)
    half, acc = sum(w for _, w in weighed) / 2, 0.0
    for shift, w in weighed:
        acc += w
        if acc >= half:
            return step(shift)


def evidence_rows(n=80, seed=2):
    rng = random.Random(seed)
    names = ["annotation", "canary", offsets.ANNOTATION]
    return [
        (
            k,
            k % 3 > 0,
            [(s, rng.randint(-100, 100) / 16, rng.randint(0, 12) / 128, rng.randint(0, 8) / 256) for s in names[: rng.randint(0, 3)]],
            [(rng.choice(names), 60.0 * i, rng.randint(-40, 40) / 16, rng.randint(0, 12) / 128, rng.randint(0, 8) / 256) for i in range(rng.randint(0, 8))],
            rng.randint(-20, 20) / 10,
            k % 4,
        )
        for k in range(n)
    ]


def test_predictions_equal_the_plain_version(spark):
    rows = evidence_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in (BASE, offsets.GRID[0], offsets.GRID[31], offsets.GRID[-1]):
        got = {r.k: r.prediction for r in offsets.predict(df, "k", c).collect()}
        assert got == {r[0]: plain(r, c) for r in rows}


def test_weak_evidence_falls_back(spark):
    weak = [("a", -12.0, 0.005, 0.001), ("b", -11.8, 0.005, 0.001), ("c", 8.0, 0.005, 0.001)]
    strong = [(s, -3.0, 0.1, 0.05) for s in "abc"]
    moving = [("a", 0.0, 8.0, 0.1, 0.05), ("a", 180.0, -8.0, 0.1, 0.05)]
    df = spark.createDataFrame([(1, False, weak, [], 0.0, 0), (2, False, strong, moving, 0.0, 0), (3, True, strong, moving, 0.0, 0), (4, False, [], [], 0.0, 0)], SCHEMA)
    get = lambda c: {r.k: r.prediction for r in offsets.predict(df, "k", c).collect()}
    assert get(BASE | {"least_improvement": 0.03, "least_joint": 0.008}) == {1: -11.8, 2: -3.0, 3: 8.0, 4: 0.0}
    assert get(BASE | {"fallback": "zero_shift"})[1] == 0.0


def test_evaluation_chooses_by_the_other_folds(spark):
    rows = evidence_rows(120, 5)
    folds, samples = offsets.evaluate(spark.createDataFrame(rows, SCHEMA).repartition(5), "k")
    error = lambda r, c: abs(plain(r, c) - r[4])
    got = {r.fold: r for r in folds.collect()}
    held = {r.k: r for r in samples.collect()}
    assert set(got) == {0, 1, 2, 3} and len(held) == 120
    for f, r in got.items():
        rest = [x for x in rows if x[5] != f]

        def rank(c, rest=rest):
            e = [error(x, c) for x in rest]
            return round(math.sqrt(sum(v * v for v in e) / len(e)), 9), round(sum(e) / len(e), 9), max(e), -sum(v <= 0.1 for v in e) / len(e), json.dumps(c, separators=(",", ":"))

        best = min(offsets.GRID, key=rank)
        assert {c: r[c] for c in offsets.CONFIGURATION} == best
        assert abs(r.train_rmse - rank(best)[0]) < 1e-8
        own = [x for x in rows if x[5] == f]
        assert abs(r.test_mae - sum(error(x, best) for x in own) / len(own)) < 1e-9
        assert all(held[x[0]].prediction == plain(x, best) and held[x[0]].fold == f for x in own)


def test_planted_fallback_is_found(spark):
    """Every other recording is aligned but has weak evidence of a large shift: the configuration that ignores it is chosen everywhere."""
    rows = [(i, False, [(s, -10.0 if i % 2 == 0 else -2.0, 0.005 if i % 2 == 0 else 0.2, 0.001 if i % 2 == 0 else 0.1) for s in "abc"], [], 0.0 if i % 2 == 0 else -2.0, i % 5) for i in range(10)]
    folds, samples = offsets.evaluate(spark.createDataFrame(rows, SCHEMA), "k", grid=[BASE, BASE | {"fallback": "zero_shift"}])
    assert {r.fallback for r in folds.collect()} == {"zero_shift"}
    assert all(r.error == 0 for r in samples.collect())
    assert offsets.evaluate(spark.createDataFrame([r[:5] + (0,) for r in rows], SCHEMA), "k")[0].collect() == []


def test_arrays_predict_as_the_columns_do(spark):
    """Every configuration, by arrays and by the column expression, on evidence with nulls and NaN in it."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    rng = random.Random(9)
    odd = lambda v: rng.choice([None, float("nan")]) if rng.random() < 0.08 else v
    rows = [(k, rng.choice([True, True, False, None]), s and [tuple([x[0] if rng.random() > 0.05 else None, *map(odd, x[1:])]) for x in s], [tuple([x[0], x[1], *map(odd, x[2:])]) for x in w], label, fold) for k, _, s, w, label, fold in evidence_rows(150, 4)]
    rows += [(k, k % 2 == 0, None, evidence_rows(9, 8)[8][3], 0.0, 0) for k in (900, 901)] + [(902, True, [], [], 0.0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    x = df.join(offsets.strongest_series(df, "k"), "k", "left").cache()
    lit = [offsets.predicted({n: F.lit(v) for n, v in c.items()}) for c in offsets.GRID]
    want = [r.p for r in x.select(F.array(*lit).alias("p")).collect()]
    t = x.select("full", "sources", "series").toArrow().combine_chunks()
    column = lambda c: t.column(c).combine_chunks()
    got = offsets.grid_predictions(column("full"), column("sources"), column("series"), offsets.GRID)
    assert pa.types.is_list(t.schema.field("sources").type) and got.shape == (len(rows), len(offsets.GRID))
    plainly = lambda v: None if v is None or math.isnan(v) else v
    assert [[plainly(v) for v in r] for r in got.tolist()] == [[plainly(v) for v in r] for r in want]


def test_grid_makes_no_row_for_each_configuration(spark):
    """The grid is scored where the evidence stands: nothing multiplies the rows by its 108 configurations."""
    df = spark.createDataFrame(evidence_rows(20), SCHEMA)
    folds, samples = offsets.evaluate(df, "k")
    for out in (folds, samples):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Generate" not in plan
