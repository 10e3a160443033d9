"""Neighbour search, codes of vectors and the filter audit against plain versions."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import common, filter_audit, neighbours, vector_codes
from tests.llm import brute

VECTORS = "vec_id long, embedding array<float>, label int, n string, q int, x string, score string"
NAN, INF = float("nan"), float("inf")


def vector_rows(n=900, width=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    rows = []
    for i in range(n):
        v = (centres[i % 6] + 0.5 * rng.normal(size=width)).astype(np.float32).tolist()
        rows.append([i, v, i % 5 if i % 7 else None])
    for i in range(0, 300, 3):
        rows[i][1] = rows[1][1]  # a third of the rows are one vector
    rows[10][1], rows[11][1], rows[12][1], rows[13][1] = None, [1.0, None] + [0.0] * 14, [NAN] + [0.0] * 15, [INF] + [0.0] * 15
    rows[20][1], rows[100][1] = [0.0] * 16, [-0.0] * 16
    rows[21][1] = rows[22][1][:9]
    rows += [[40, rows[40][1], 1], [40, rows[41][1], 2], [None, rows[42][1], 3], [None, rows[200][1], None]]
    return [(*r, "n", 1, "x", "s") for r in rows]


ROWS = vector_rows()


def padded(v, width=16):
    return np.array(v + [0.0] * (width - len(v)), np.float64)


def usable(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def brute_nearest(rows, every, n):
    """(query row, [(score, id is None, id)] of all others, nearest first)."""
    own = [(r[0], padded(r[1])) for r in rows if usable(r[1]) and any(r[1])]
    x = np.stack([v for _, v in own])
    for at, (q, v) in enumerate(own):
        if q is not None and q % every == 0:
            d = np.sqrt(((x - v) ** 2).sum(1))
            yield q, sorted((d[i], own[i][0] is None, own[i][0] or 0) for i in range(len(own)) if i != at)[:n]


def test_nearest_is_whole_and_near_exact(spark):
    df = spark.createDataFrame(ROWS, VECTORS).repartition(3)
    out = neighbours.nearest(df, every=20, n=10).collect()
    got = {}
    for r in out:
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id is None, r.vec_id or 0))
    want = {}
    for q, near in brute_nearest(ROWS, 20, 10):
        want.setdefault(q, []).append(near)
    assert set(got) == set(want)
    hits = total = 0
    for q, lists in want.items():
        rows = sorted(got[q], key=lambda r: r[0])
        assert [r[0] for r in rows] == sorted(list(range(1, 11)) * len(lists))
        if len(lists) == 1:
            assert [r[1:] for r in rows] == sorted(r[1:] for r in rows)
            hits, total = hits + len(set(lists[0]) & {r[1:] for r in rows}), total + 10
    assert hits / total >= 0.99
    assert 100 not in got and 20 not in got  # zero vectors take no part


def test_graph_search_finds_nine_in_ten_on_shapeless_data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = neighbours.nearest(df).collect()
    got = {}
    for r in out:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 6000, 100):
        d = ((x.astype(np.float64) - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits / 600 >= 0.9


def test_descent_improves_the_graph(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)  # begin with little
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    nodes, width = neighbours.nodes_of(df, 3)
    place = {r.n: r.ids[0] for r in nodes.select("n", "ids").collect()}

    def recall(rounds):
        edges = neighbours.neighbour_graph(nodes, width, 12, rounds).collect()
        assert len({(r.v, r.w) for r in edges}) == len(edges) == 5000 * 12 and all(r.v != r.w for r in edges)
        near = {}
        for r in edges:
            near.setdefault(place[r.v], set()).add(place[r.w])
        hits = 0
        for q in range(0, 5000, 50):
            d = ((x - x[q]) ** 2).sum(1)
            d[q] = np.inf
            hits += len(near[q] & set(np.argsort(d)[:12].tolist()))
        return hits / 1200

    before, after = recall(0), recall(3)
    assert after > before + 0.1


def test_a_hub_meets_its_many_neighbours_in_blocks(spark):
    """A centre that all others have for a neighbour."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 120))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[0] = 1e-3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.query_id: r.vec_id for r in neighbours.nearest(df, every=10).where("rank = 1").collect()}
    assert len(got) == 150 and sum(v == 0 for v in got.values()) > 140


@pytest.mark.parametrize("rows", [[], [(1, None)], [(100, [1.0, 2.0])], [(0, [1.0]), (100, [1.0]), (100, [3.0]), (None, [1.0, 0.5])]])
def test_few_vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = sorted((r.query_id, r["rank"], r.score) for r in neighbours.nearest(df).collect())
    if len(rows) < 4:
        assert out == []
    else:
        assert [r[:2] for r in out] == [(0, i) for i in (1, 2, 3)] + [(100, i) for i in (1, 1, 2, 2, 3, 3)] and out[0][2] == 0


def brute_codes(rows, entries=16, rounds=6, parts=8):
    own = sorted(((r[0] is None, r[0] or 0, [float(c) for c in r[1]]), r) for r in rows if usable(r[1]))
    width = max(1, -(-max((len(r[1]) for _, r in own), default=0) // parts))
    ints = [[max(-(1 << 60), min(1 << 60, int(np.floor(np.float64(c) * 4096)))) for c in r[1]] + [0] * (parts * width - len(r[1])) for _, r in own]
    cut = [[x[p * width : (p + 1) * width] for p in range(parts)] for x in ints]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]
    dist = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))

    def assign():
        return [[min((dist(c[p], e), j) for j, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        now = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, now, strict=True) if a[p][1] == j]
                if mine:
                    books[p][j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    now = assign()
    errors = [sum(d for d, _ in a) for a in now]
    by = {}
    for (_, r), e in zip(own, errors, strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    out = [(r[0], "".join(f"{j:02x}" for _, j in a), e, by[r[2]]) for (_, r), a, e in zip(own, now, errors, strict=True)]
    return out, hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()


@pytest.mark.parametrize("kind", ["mixed", "few", "none", "huge", "grid"])
def test_vector_codes(spark, kind):
    rng = random.Random(7)
    rows = {
        "mixed": ROWS,
        "few": ROWS[30:37],
        "none": [(1, None, 1, "", 1, "", "")],
        "huge": [(i, [float(np.float32(1e30 if i in (30, 31) else rng.uniform(-1e5, 1e5))) for _ in range(16)], i % 2, "", 1, "", "") for i in range(40)],
        "grid": [(i, [rng.randint(-2, 2) / 4096 for _ in range(16)], i % 3, "", 1, "", "") for i in range(400)],  # ties everywhere
    }[kind]
    out, books = vector_codes.vector_codes(spark.createDataFrame(rows, VECTORS).repartition(3))
    got = sorted(((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error) for r in out.collect()), key=str)
    want, sha = brute_codes(rows)
    whole = lambda e: e if e < 1 << 63 else None
    want = [(*r[:2], whole(r[2]), r[3] if whole(r[2]) is None else whole(r[3])) for r in want]
    assert got == sorted(((r[0] is None, r[0] or 0, *r[1:]) for r in want), key=str)
    assert vector_codes.digest(books) == sha


def test_bounds_spare_distances_and_change_nothing():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(-300, 300, (1, 8)) + rng.integers(-15, 16, (200, 8)) for _ in range(16)])
    entries = points[::200].copy()
    groups = vector_codes.grouped(entries)
    best, upper, lower = vector_codes.first_assignment(points, entries, groups)
    seen = []
    for _ in range(6):
        moved = entries.copy()
        for j in np.unique(best):
            moved[j] = points[best == j].sum(0) // (best == j).sum()
        best, upper, lower, n = vector_codes.next_assignment(points, best, upper, lower, entries, moved, groups)
        entries = moved
        seen.append(n)
        assert (best == vector_codes.squared(points, entries).argmin(1)).all()
    assert max(seen[1:]) < points.shape[0] * len(entries) / 4


def brute_audit(docs, labels):
    lows = {}
    for d, t, _ in docs:
        if d is not None:
            lows[t or ""] = min(lows.get(t or "", d), d)
    good, toxic = ({d for d, q, x in labels if (q, x)[i] == 1 and d is not None} for i in (0, 1))
    by = {}
    for d, t, lang in docs:
        t = t or ""
        w = brute.WORD.findall(t)
        low = lows.get(t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": low is not None and (d is None or d > low),
        }
        by.setdefault(lang or "", []).append(({f for f, x in fails.items() if x}, d in good, d in toxic))
    out = []
    for part, rows in by.items():
        removed_by = dict.fromkeys("ABCDE", 0)
        found = []
        for order in itertools.permutations("ABCDE"):
            for i, f in enumerate(order):
                here = [r for r in rows if f in r[0] and not r[0] & set(order[:i])]
                removed_by[f] += len(here)
                kept = sum(not r[0] & set(order[: i + 1]) for r in rows)
                redundant = sum(f in r[0] and bool(r[0] & set(order[:i])) for r in rows)
                found.append((part, "".join(order), i + 1, kept, len(here), redundant, sum(r[0] == {f} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here), f))
        out += [(*r[:9], removed_by[r[9]]) for r in found]
    return sorted(out)


DOCS = "doc_id long, text string, lang string, mask string, fp int, p int, run int, id string, part string"


def audit_rows():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)] + ["École", "日本", "ABC", "x y"]
    texts = [None, "", "  \t\n", "A#B", "\x1c" * 3, "ÄÖ|"] + [" ".join(rng.choice(words[: rng.choice([20, 404])]) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    texts.append(" ".join(rng.choice(words) for _ in range(200_000)))  # over a megabyte
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", "", None])) for i in range(300)]
    rows += [(1000 + i, "one text that a third of all rows hold", "en") for i in range(200)]
    rows += [(7, rows[7][1], "en"), (7, "other", "de"), (None, "other", "en"), (None, "alone twice", "en"), (None, "alone twice", "fr"), (2000, texts[-1], "xx")]
    return rows


def test_filter_audit(spark):
    rows = audit_rows()
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 1100, 2)] + [(8, None, None), (8, 1, 1), (None, 1, 1), (9, 0, None)]
    docs = spark.createDataFrame([(*r, "m", 1, 2, 3, "i", "q") for r in rows], DOCS).repartition(5)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("4", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = sorted(tuple(r) for r in filter_audit.filter_audit(docs, told).collect())
            assert got == brute_audit(rows, labels)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_runs_of_equal_texts_cross_ranges_and_fingerprints_may_collide(spark):
    """Two texts of one fingerprint, each over several ranges."""
    import pyarrow as pa

    rows = sorted((5, t, i) for t in (b"a", b"b") for i in range(10))
    task = filter_audit._compare(pa.int64())
    batch = lambda p, part: pa.RecordBatch.from_pydict({"p": [p] * len(part), "fp": [r[0] for r in part], "text": [r[1] for r in part], "id": [r[2] for r in part], "part": [""] * len(part)})
    found = [r for b in task(iter([batch(0, rows[:3]), batch(0, rows[3:])])) for r in b.to_pylist()]
    assert [(r["run"], r["text"], r["id"]) for r in found if r["edge"]] == [(0, b"a", 0), (1, b"b", 0)]
    assert sum(r["mask"] >> 4 for r in found if not r["edge"]) == 18


def test_empty_audit(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_counters_of_parts_add_up(spark):
    """Audits of disjoint halves, without copies across them, sum to the audit of the whole."""
    rows = [(i, f"{'Word #' if i % 4 == 0 else 'word'} {i} " * (i % 90), "en") for i in range(200)]
    told = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    make = lambda part: spark.createDataFrame(part, "doc_id long, text string, lang string")
    masks = [filter_audit.failure_masks(make(p)) for p in (rows, [r for r in rows if r[0] % 90], [r for r in rows if r[0] % 90 == 0])]
    whole, *halves = (filter_audit.part_counters(m, told) for m in masks)
    both = halves[0].unionByName(halves[1]).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, both.collect()))


def test_nothing_is_left_behind(spark):
    docs = spark.createDataFrame([(i, "a b", "en") for i in range(20)], "doc_id long, text string, lang string")
    told = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([r[:3] for r in ROWS[:60]], "vec_id long, embedding array<float>, label int")
    root = spark._jvm.org.apache.hadoop.fs.Path(common.work_root(spark))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda: {s.getPath().getName() for s in fs.listStatus(root)}
    before = there()
    with common.scratch(spark):
        filter_audit.filter_audit(docs, told).collect()
        vector_codes.vector_codes(vectors)[0].collect()
        neighbours.nearest(vectors, every=10).collect()
        assert 0 < len(there() - before) < 6  # what the results are read from
    assert there() == before
