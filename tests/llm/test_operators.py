"""Each corpus operator against its plain version, on texts that mean trouble."""

import random

import pytest
from pyspark.sql import functions as F

from parley.llm import decontaminate, line_dedup, mixing, quality_classifier, quality_rules, secret_scan, simhash, suffix_dedup, url_filter, warc
from parley.llm.queries import URL_RULES
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, row int, rules string, size int"


def fixture_rows(n=60, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["École", "naïve", "ÄÖ", "日本語", "x\u00a0y", "o'k"]
    texts = []
    for i in range(n):
        kind = i % 12
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        if kind == 0:
            texts.append(None)
        elif kind == 1:
            texts.append("")
        elif kind == 2:
            texts.append(" \t\n \x0b\x0c\r\n")
        elif kind == 3 and texts:
            texts.append(texts[-1 - rng.randrange(min(len(texts), 8))])
        elif kind == 4:
            texts.append("ab " * rng.randint(20, 60))
        elif kind == 5:
            base = next((t for t in texts if t and len(t) > 200), " ".join(words))
            texts.append(base[: len(base) // 2] + "!" + base[len(base) // 2 :])
        elif kind == 6:
            texts.append(" ".join(words) + "\nShared line here\n  SHARED LINE here \t\n\n" + " ".join(words[::-1]))
        elif kind == 7:
            texts.append("password = 'abcdefgh12' token:short secret=\"0123456789\" " + "ab12" * 9 + " AKIA1234567890ABCD AKIAX é AKIA" + "Z" * 20 + " token=secret:abcdefghijk api_key: qwertyuiop.")
        elif kind == 8:
            texts.append("\u20ac" * rng.randint(30, 90) + "\ud7ff" + "\U0001f600" * 20)
        else:
            texts.append(" ".join(words))
    texts[-1] = " ".join(rng.choice(vocabulary) for _ in range(30000))
    return [(i * 3, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "B", None]), None if t is None else len(t), "x", "y", i, "z", 1) for i, t in enumerate(texts)]


ROWS = fixture_rows()
DOCS = [(r[0], r[1]) for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def bench_rows():
    long = next(t for _, t in DOCS if t and len(t) > 5000).split()
    return [(1, " ".join(long[100:130])), (10, " ".join(long[105:125])), (2, "w1 w2"), (3, None), (None, "w1"), (4, ""), (5, "école naïve"), (6, " ".join(long[500:511]).upper()), (6, "w3 w4 w5")]


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def want(rows):
    return sorted(rows, key=repr)


def test_decontaminate(spark, docs, bench_rows):
    bench = spark.createDataFrame(bench_rows, "item_id long, text string")
    c = "_contamination"
    cols = ["doc_id", f"{c}.n_words", f"{c}.n_hit", f"{c}.n_items", F.sha2(F.concat_ws(",", f"{c}.items"), 256), f"{c}.contaminated"]
    expected = want(brute.contamination(DOCS, bench_rows))
    assert got(decontaminate.decontaminate(docs, bench), *cols) == expected
    assert any(r[2] for r in expected)
    many = decontaminate.decontaminate(docs, bench, block_words=12)  # joined
    assert got(many, *cols) == expected
    assert decontaminate.decontaminate(docs, bench.limit(0)).where(f"{c}.contaminated").count() == 0


def test_quality_rules(docs):
    out = quality_rules.quality_rules(docs)
    q = "_quality"
    assert set(docs.columns) < set(out.columns)
    cols = ["doc_id", *[f"{q}.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]]
    assert got(out, *cols) == want(brute.quality_base(DOCS))
    assert out.where(f"{q}.base_failed and {q}.kept").count() == 0


def test_quality_counts_each_text_once_a_pass(docs):
    """A filter on the verdict takes no second Python worker beside the first."""
    plan = quality_rules.quality_rules(docs).where("_quality.kept")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_quality_sketch_is_exact_to_its_buckets(spark):
    v = spark.range(1, 200_000).select(F.col("id").alias("v"))
    b = v.select("v", quality_rules.bucket(F.col("v")).alias("b")).select("v", "b", quality_rules.bucket_low(F.col("b")).alias("low"))
    assert b.where("low > v or v - low > v / 32").count() == 0
    assert b.groupBy("b").agg(F.countDistinct("low").alias("n")).where("n > 1").count() == 0


def test_quality_fences_follow_the_group(spark):
    rows = [(i, " ".join(f"{'long' if s == 'b' else 'x'}word{j}{i}" for j in range(60)) + (" ##" * 40 if i == 7 else ""), "en", s) for s in "ab" for i in range(250)]
    out = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    bad = {r[0] for r in out.where("not _quality.kept").select("doc_id").collect()}
    assert bad == {7}


def test_line_dedup(spark, docs):
    out = line_dedup.line_dedup(docs, min_docs=3)
    cols = ["doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2("_lines.kept", 256)]
    expected = want(brute.line_dedup(DOCS, 3))
    assert any(r[2] for r in expected)
    assert got(out, *cols) == expected
    assert got(line_dedup.line_dedup(docs, min_docs=3, broadcast_keys=0), *cols) == expected  # joined by shuffle
    assert got(line_dedup.line_dedup(docs, min_docs=3, batches=7), *cols) == expected  # compacted twice


def test_line_runs_incremental(spark):
    runs = line_dedup.LineRuns(spark, 2)
    for i in range(5):
        batch = spark.createDataFrame([(i, f"common\nonly {i}")], "doc_id long, text string")
        last = line_dedup.dedup_batch(batch, runs).select("_lines.kept").first()[0]
        assert last == (f"common\nonly {i}" if i == 0 else f"only {i}")
    assert sum(map(len, runs.levels)) <= 3


def test_simhash(spark, docs):
    assert got(simhash.simhash_classes(docs), "doc_id", "fingerprint", "component_id") == want(brute.simhash(DOCS))


def test_keep_one_is_exact(spark):
    """Against all pairs: variants of one text near a similarity of 0.8, whose smallest id is unlike most others."""
    rng = random.Random(5)
    rows = []
    for _ in range(6):
        base = [f"t{rng.randrange(5000)}" for _ in range(200)]
        for _ in range(40):
            words = list(base)
            for at in rng.sample(range(200), rng.randrange(1, 12)):
                words[at] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    shingles = []
    for _, text in rows:
        w = text.split()
        shingles.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(shingles[i] & shingles[j])
            if 5 * shared >= 4 * (len(shingles[i]) + len(shingles[j]) - shared):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(out, "doc_id") == want([(i,) for i in range(len(rows)) if find(i) == i])


def test_simhash_links_crowded_keys(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {int(c) for c in centre}
    for c in centre:
        for _ in range(40):
            bits = rng.choice(64, rng.integers(1, 8), replace=False)
            fps.add(int(c) ^ sum(1 << int(b) for b in bits))
    fps = sorted(fps)
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long").withColumn("t", F.lit(0))

    def classes(pairs):
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        return sorted(sorted(g) for g in {find(f): [x for x in fps if find(x) == find(f)] for f in fps}.values())

    expected = classes((a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4)
    unsigned = lambda x: x & ((1 << 64) - 1)
    plain = [(unsigned(r.u), unsigned(r.v)) for r in simhash.edges(nodes).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in plain)
    assert classes(plain) == expected
    old, simhash.DIRECT = simhash.DIRECT, 3
    try:
        dense = [(unsigned(r.u), unsigned(r.v)) for r in simhash.edges(nodes).collect()]
    finally:
        simhash.DIRECT = old
    assert classes(dense) == expected


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(chain).collect()}
    assert all(got[i] == 1 for i in range(2, 61)) and got[101] == 100


def test_components_write_small_tables_in_few_files(spark, monkeypatch):
    """Not in one for each shuffle partition, each round again."""
    files, own = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda *args: files.append(len((out := own(*args)).inputFiles())) or out)
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.node: r.root for r in simhash.components(spark.range(1, 1000).select(F.col("id").alias("u"), F.when(F.col("id") % 10 == 0, F.col("id") - 10).otherwise(F.col("id") - F.col("id") % 10).alias("v"))).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert set(got) == set(range(1, 1000)) and set(got.values()) == {0}
    assert len(files) > 2 and max(files[1:]) <= spark.sparkContext.defaultParallelism < 64


def test_keep_one(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text), (2, text), (2, text), (3, "something else entirely here now"), (None, text)]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(out, "doc_id") == want([(1,), (3,), (None,)])


def test_keep_one_compares_what_fingerprints_link(spark, docs, monkeypatch):
    """Proposals connect the classes of op 8's fingerprints, and keep_one compares them."""
    texts = docs.select(F.col("doc_id").alias("rep"), "text")
    pairs = simhash.fingerprint_pairs(texts)
    assert pairs.where("u <= v").isEmpty()
    root = {r.node: r.root for r in simhash.components(pairs).collect()}
    whole = {r.doc_id: r.component_id for r in simhash.simhash_classes(docs).collect()}
    assert {i: root.get(i, i) for i in whole} == whole
    assert any(i != c for i, c in whole.items())
    compared, own = [], simhash.similar_pairs
    monkeypatch.setattr(simhash, "similar_pairs", lambda *args: compared.append({tuple(r) for r in args[4].collect()}) or own(*args))
    words = [f"word{i}" for i in range(400)]
    simhash.keep_one(spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, "unlike all of them")], "doc_id long, text string")).collect()
    assert compared == [{(2, 1)}]


def test_keep_one_loses_no_row_of_a_repeated_id(spark):
    """Rows of one id with unlike texts all stay, whatever the order of rows."""
    one, two = (" ".join(f"{p}{i}" for i in range(60)) for p in ("alpha", "beta"))
    rows = [(1, one, "x"), (1, two, "y"), (1, one, "z"), (2, two, "w"), (3, "short text", "v")]
    for order in (rows, rows[::-1]):
        out = simhash.keep_one(spark.createDataFrame(order, "doc_id long, text string, _place string").repartition(2))
        assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted([(1, one), (1, two), (3, "short text")])


def all_pairs_classes(texts, shingle=5):
    """Smallest index of each text's class, every pair compared."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) > shingle else ({tuple(w)} if w else set()) for w in words]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both * 5 >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_keep_one_is_exact_over_all_pairs(spark):
    """The whole table of the smallest scale: the documents that stay are those of an all-pairs comparison."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rng = random.Random(5)
    for i in range(0, 200, 4):  # near copies in chains, each of the one before
        words = (rows[i][1] or "").split()
        for k in range(3):
            for at in rng.sample(range(len(words)), max(1, len(words) // 60)) if words else []:
                words[at] = f"edit{i}{k}"
            rows.append((10_000 + 10 * i + k, " ".join(words)))
    root = all_pairs_classes([t for _, t in rows])
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).select("doc_id").collect()}
    assert kept == {rows[i][0] for i in range(len(rows)) if root[i] == i}


def test_keep_one_in_a_crowd(spark):
    """Many near copies of one text, edited each at its own places, and one passage in all other texts."""
    rng = random.Random(6)
    base = [f"c{rng.randrange(3000)}" for _ in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for at in rng.sample(range(150), 2):
            w[at] = f"e{i}x{at}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:20] + [f"o{rng.randrange(10**6)}" for _ in range(90)])) for i in range(120)]
    root = all_pairs_classes([t for _, t in rows])
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id").collect()}
    assert kept == {rows[i][0] for i in range(len(rows)) if root[i] == i}


def test_keep_one_finds_near_copies(spark):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        words = [f"t{rng.randrange(5000)}" for _ in range(300)]
        rows.append((2 * i, " ".join(words)))
        for at in rng.sample(range(300), 3 if i % 2 else 40):  # similarity of about 0.9, or about 0.3
            words[at] = "changed"
        rows.append((2 * i + 1, " ".join(words)))
    kept = {r[0] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    assert kept >= {2 * i for i in range(150)}
    assert all(2 * i + 1 in kept for i in range(0, 150, 2))
    assert sum(2 * i + 1 in kept for i in range(1, 150, 2)) <= 7


def test_suffix_dedup(spark, docs):
    cols = ["doc_id", "_cut.n_bytes", "_cut.n_removed", "_cut.n_spans", F.sha2("_cut.kept", 256)]
    expected = want(brute.substring_dedup(DOCS))
    assert sum(r[2] for r in expected) > 1000
    assert got(suffix_dedup.suffix_dedup(docs), *cols) == expected
    assert got(suffix_dedup.suffix_dedup(docs.select("doc_id", "text")), *cols) == expected
    assert got(suffix_dedup.suffix_dedup(docs, crowd=1), *cols) == expected  # windows dealt out


def test_suffix_dedup_frequent_anchors(spark):
    """One passage in every text, between different words, and many copies of one text."""
    rng = random.Random(9)
    passage = "a passage that nearly every text of this corpus quotes in full, once or twice. "
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    rows = [(i, " ".join(word() for _ in range(6)) + " " + passage * (1 + i % 2) + " ".join(word() for _ in range(6))) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    cols = ["doc_id", "_cut.n_bytes", "_cut.n_removed", "_cut.n_spans", F.sha2("_cut.kept", 256)]
    expected = want(brute.substring_dedup(rows))
    n = sum(len(t) for _, t in rows)
    assert len(suffix_dedup.frequent_anchors(df, n, suffix_dedup.WINDOW, suffix_dedup.GRAM)) > 3
    assert got(suffix_dedup.suffix_dedup(df), *cols) == expected
    assert got(suffix_dedup.suffix_dedup(df, crowd=100), *cols) == expected


def test_suffix_dedup_compares_bytes(spark, monkeypatch):
    """With hashes of contexts that agree by chance all the time, no byte goes that should stay."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    passage = " ".join(word() for _ in range(3))
    rows = [(i, f"{word()} {word()} {word()} {word()} {word()} {word()} {passage} {word()} {word()} {word()} {word()} {word()} {word()}") for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(20)]
    monkeypatch.setattr(suffix_dedup, "CTX_MASK", suffix_dedup.np.uint64(1))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r[0]: r[1] for r in suffix_dedup.suffix_dedup(df).select("doc_id", "_cut.n_removed").collect()}
    # The passage, 23 bytes and the spaces around it, is shared and shorter than a window.
    assert all(out[i] == 0 for i in range(150)) and sum(out[200 + i] for i in range(20)) > 0


def test_contexts_without_common_windows_stop_before_arrays():
    import numpy as np

    rng, sd = random.Random(14), suffix_dedup
    word = lambda n: bytes(rng.choice(b"abcdefghij") for _ in range(n))
    stopped = shared = 0
    for size in [*range(16, 90), *range(45, 55)] * 2:
        passage = word(size)
        texts = [word(rng.randint(0, 90)) + passage + word(rng.randint(0, 90)) for _ in range(2)]
        data, off = np.frombuffer(b"".join(texts), np.uint8), np.array([0, len(texts[0]), len(texts[0]) + len(texts[1])])
        text, p, h, ctx, side = sd.anchors(data, off, 50, 16)
        at, n = p - off[text], np.diff(off)[text]
        rows = sd.Rows(k=h & sd.K_MASK, side=side, head=np.minimum(at, 34), tail=np.minimum(n - at, 50))
        kept = sd.may_share(rows, 50, 16)
        for i in np.flatnonzero(text == 0):
            for j in np.flatnonzero((text == 1) & (h == h[i])):
                one, other = texts[0][at[i] - rows.head[i] : at[i] + rows.tail[i]], texts[1][at[j] - rows.head[j] : at[j] + rows.tail[j]]
                if any(one[x : x + 50] in other for x in range(len(one) - 49)):
                    shared += 1
                    assert kept[i] and kept[j]
                else:
                    stopped += not kept[i]
    assert shared > 50 and stopped > 5


def test_regions():
    import numpy as np

    cols = [np.array(x, np.int64) for x in ([1, 1, 2, 1, 1], [7, 7, 7, 8, 7], [0, 0, 0, 0, 5], [30, 10, 4, 2, 1], [40, 20, 9, 3, 2])]
    assert [x.tolist() for x in suffix_dedup.regions(*cols)] == [[1, 1, 1, 2], [7, 7, 8, 7], [0, 5, 0, 0], [10, 1, 2, 4], [40, 2, 3, 9]]
    assert [len(x) for x in suffix_dedup.regions(*[x[:0] for x in cols])] == [0] * 5


def test_agreeing_parts():
    a = bytes(range(200))
    assert suffix_dedup.agreeing(a, 10, 150, a[10:150], 50) == [(10, 150)]
    b = bytearray(a[10:150])
    b[60] ^= 1
    assert suffix_dedup.agreeing(a, 10, 150, bytes(b), 50) == [(10, 70), (71, 150)]
    b[30] ^= 1
    assert suffix_dedup.agreeing(a, 10, 150, bytes(b[:100]), 50) == []


def test_suffix_dedup_repeated_and_null_ids(spark):
    t = "the quick brown fox jumps over the lazy dog and runs far away from here at once"
    rows = [(2, t), (2, t), (2, "zz " + t), (None, t), (9, t), (1, "short")]
    out = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    n = len(t)
    assert got(out, "doc_id", "_cut.n_removed") == want([(1, 0), (2, 0), (2, 0), (2, 0), (9, n), (None, n)])


def test_suffix_array_order():
    import numpy as np

    rng = np.random.default_rng(1)
    for it in range(60):
        t = rng.integers(0, rng.integers(1, 5), rng.integers(1, 300)).astype(np.uint8) * np.uint8(rng.integers(1, 60))
        if it % 3 == 0:
            t = np.repeat(t, rng.integers(1, 30))[:900].copy()
        raw, order = t.tobytes(), suffix_dedup.suffix_array(t)
        assert sorted(order.tolist()) == list(range(len(t)))
        valid = np.array([i for i in order if i + 50 <= len(raw)], int)
        keys = [raw[i : i + 50] for i in valid]
        assert keys == sorted(keys)
        if len(valid) > 1:
            same = suffix_dedup.common_prefix(suffix_dedup.words(t), valid[:-1], valid[1:])
            assert [int(x) for x in same] == [next((i for i in range(50) if a[i] != b[i]), 50) for a, b in zip(keys, keys[1:], strict=False)]


def test_mixing(spark, docs):
    rows = [tuple(r) for r in mixing.mix(docs).select("source", "doc_id", "_mix.size", "_mix.target", "_mix.taken").collect()]
    sizes: dict = {}
    for s, _, size, _, _ in rows:
        sizes[s] = sizes.get(s, 0) + size
    expected = brute.water_fill(sizes, (5, 2, 1))
    assert len(rows) == len(ROWS)
    for s, _, size, target, taken in rows:
        assert abs(target - expected[s]) < 1e-6 and 0 <= taken <= 2 * size
    for s in sizes:
        assert abs(sum(r[4] for r in rows if r[0] == s) - expected[s]) <= len(sizes) * mixing.QUANTUM
    assert sum(r[4] for r in rows) == int(1.5 * sum(sizes.values()))  # the cut is where the budget ends
    again = [tuple(r) for r in mixing.mix(docs.repartition(5)).select("source", "doc_id", "_mix.size", "_mix.target", "_mix.taken").collect()]
    assert sorted(rows, key=repr) == sorted(again, key=repr)


def fair_queue(rows, weights=(5, 2, 1), share=1.5, epochs=2, quantum=mixing.QUANTUM):
    """Words taken of each (id, text, source), by sorting all quanta."""
    import hashlib

    by = {}
    for i, t, s in rows:
        turn = hashlib.md5("/".join(["" if i is None else str(i), "mix", t or ""]).encode()).hexdigest()
        by.setdefault(s, []).append((turn, len(brute.WORD.findall(t or "")), i))
    queue, starts = [], {}
    for place, s in enumerate(sorted(by, key=lambda s: (s is None, s or ""))):
        total = sum(n for _, n, _ in by[s])
        for e in range(epochs):
            at = 0
            for k, (_, n, _) in enumerate(sorted(by[s], key=lambda x: x[:2])):
                for o in range(0, n, quantum):
                    stop = at + min(n, o + quantum)
                    queue.append(((stop + e * total) / weights[place % len(weights)], place, e, stop, stop - at - o, s, k))
                at += n
    left, taken = int(share * sum(n for v in by.values() for _, n, _ in v)), {}
    for *_, n, s, k in sorted(queue, key=lambda x: x[:4]):
        taken[s, k] = taken.get((s, k), 0) + min(n, left)
        left -= min(n, left)
    return sorted((s, i, taken.get((s, k), 0)) for s in by for k, (_, _, i) in enumerate(sorted(by[s], key=lambda x: x[:2])))


def test_mixing_serves_by_finish_time(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randrange(1, 900)), rng.choice("abcd")) for i in range(80)] + [(200, "x " * 30000, "b"), (201, "", "a"), (202, None, "e")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert got(out, "source", "doc_id", "_mix.taken") == want(fair_queue(rows))


def test_mixing_repeated_ids(spark):
    """Rows of one id, and rows without one: the cut does not follow the order of rows."""
    rows = [(i, f"{w} b c d", "s") for i in (1, None) for w in "pqrt"]
    one = got(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)), "doc_id", "text", "_mix.taken")
    other = got(mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").coalesce(1)), "doc_id", "text", "_mix.taken")
    assert one == other and sum(x[2] for x in one) == 48


def test_secret_scan(docs):
    n = F.col("_secrets.counts")
    out = secret_scan.scan_secrets(docs)
    expected = want(brute.secrets(DOCS))
    assert any(r[1] for r in expected) and any(r[2] for r in expected) and any(r[3] for r in expected)
    cols = ["doc_id", n[0], n[1], n[2], F.sha2("_secrets.base", 256)]
    assert got(out, *cols) == expected
    assert got(secret_scan.scan_secrets(docs, broadcast_rows=0), *cols) == expected
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_secret_scan_many_matches_and_queries(spark):
    t = " é ".join(f"token={i:08d}x" for i in range(700))
    rows = [(1, t), (1, t), (None, t)]
    out = secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(out, "doc_id", F.sha2("_secrets.base", 256)) == want([(r[0], r[4]) for r in brute.secrets(rows)])
    assert secret_scan.trigram_query("[0-9a-f]{32,}") == secret_scan.ANY
    assert secret_scan.trigram_query("abcd|xyz") == [frozenset({"abc", "bcd"}), frozenset({"xyz"})]


def test_classifier(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 != 0
        words = [f"v{rng.randrange(200)}" for _ in range(rng.randint(20, 80))]
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words]), 5))
        labels.append((i, int(good)))
    rows += [(1000, None, None), (1001, "", 0), (None, "v1 v2", 3), (0, rows[0][1], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("score", F.lit("clash"))
    out = quality_classifier.quality_scores(docs, spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, quality int"), meta_cols=("n_chars",))
    r = [tuple(x) for x in out.select("doc_id", "_score.held_out", "_score.score", "_score.predicted").collect()]
    assert len(r) == len(rows) and all(0 <= x[2] <= 1 and x[3] == int(x[2] >= 0.7) for x in r)
    held = [x for x in r if x[1] and x[0] is not None and x[0] < 600]
    assert held and sum(x[3] == int(x[0] % 3 != 0) for x in held) / len(held) > 0.95
    import zlib

    assert all(x[1] == (x[0] is not None and zlib.crc32(str(x[0]).encode()) % 4 == 2) for x in r)
    none = quality_classifier.quality_scores(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert none.where("_score.score != 0.5").count() == 0


def test_pairwise_identity():
    import numpy as np

    rng = np.random.default_rng(0)
    m = quality_classifier.Machine(rng.normal(size=(10, 3)))
    m.w[:] = rng.normal(size=m.size)
    i, x = np.array([3, 9, 40]), np.array([0.5, -1.0, 2.0])
    direct = m.w0 + (m.w[i] * x).sum() + sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(3) for b in range(a))
    assert abs(m.forward(np.array([0]), i, x)[0][0] - direct) < 1e-9


def test_url_filter(spark):
    rng = random.Random(4)
    names = ["news", "blog", "docs", "home", "wiki"]
    urls = [f"https://{rng.choice(names)}{rng.randrange(50)}.example.net/fr/{rng.randrange(9999)}" for _ in range(400)]
    urls += [f"http://casino-{rng.choice(['win', 'big', 'max'])}.example.net/fr/{rng.randrange(9999)}" for _ in range(120)]
    urls += ["http://A.Example.COM/en/1", "https://example.com/en/7x?y#z", "https://sub.net/de/1", "https://example.net/de/81", "x://org/es/", "nothing", None, "http://", "http://h?q/p", "http://notcom/en/1", "http://é.com/en/" + "a" * 5000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    known = F.when(F.col("host").rlike("casino"), "block").otherwise(F.coalesce("by_rule", F.lit("allow")))
    out = url_filter.filter_urls(pages, URL_RULES, known)
    r = {x[0]: tuple(x)[1:] for x in out.select("page_id", "_url.host", "_url.path", "_url.rule", "_url.verdict").collect()}
    n = len(urls) - 11
    assert r[n] == ("a.example.com", "/en/1", "com/en/", "block")
    assert r[n + 1] == ("example.com", "/en/7x", "example.com/en/7", "allow")
    assert r[n + 2] == ("sub.net", "/de/1", "net/de/", "allow")
    assert r[n + 3] == ("example.net", "/de/81", "example.net/de/8", "block")
    assert r[n + 4][2:] == ("org/es/", "block")
    assert r[n + 5][:3] == r[n + 6][:3] == r[n + 7][:3] == ("", "", None)
    assert r[n + 8][:3] == ("h", "", None) and r[n + 9][2] is None
    assert all(r[i][3] == "allow" for i in range(400)) and all(r[i][3] == "block" for i in range(400, 520))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_url_verdicts(urls, rules, learn=lambda rule: True):
    """(verdict, score) of each URL: rules, then Witten-Bell models of what the rules do not name, thresholds on hosts set apart."""
    import math
    import re

    import xxhash

    lower = lambda t: re.sub("[A-Z]+", lambda m: m.group().lower(), t)
    parts = []
    for u in urls:
        rest = u.split("://", 1)[1] if u is not None and "://" in u else ""
        host = lower(re.match(r"(?s)[^/?#]*", rest).group())
        path = re.match(r"(?s)[^/?#]*([^?#]*)", rest).group(1)
        fits = [(len(r), r, k) for k, r in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        best = max(fits, default=None)
        labels = host.split(".")[: max(0, len(host.split(".")) - max(r.split("/", 1)[0].count(".") + 1 for _, r in rules))]
        deep, more = max(r.split("/", 1)[1].count("/") for _, r in rules), max(len(r.rsplit("/", 1)[1]) for _, r in rules)
        text = ".".join(labels) + "/" + re.sub(rf"^(?:/[^/]*){{0,{deep}}}/?[^/]{{0,{more}}}", "", path) + (re.search(r"(?s)[?#].*$", rest) or [""])[0]
        codes = [url_filter.ALPHABET.find(c) + 1 for c in (text if host else u or "").lower()]
        share = xxhash.xxh64_intdigest(host.encode(), 42)
        share = (share - (1 << 64) if share >> 63 else share) % url_filter.CALIBRATION
        parts.append((host, codes, best, share))
    n = url_filter.SYMBOLS
    grams = lambda codes: [((codes[i - 2] if i > 1 else 0), (codes[i - 1] if i else 0), c) for i, c in enumerate(codes)]
    seen = {k: [g for h, c, b, s in parts if h and b and b[2] == k and s and learn(b[1]) for g in grams(c)] for k in ("allow", "block")}
    tables = {}
    for k, own in seen.items():
        t = {"abc": {}, "bc": {}, "c": {}}
        for a, b, c in own:
            for name, key in (("abc", (a, b)), ("bc", (b,)), ("c", ())):
                t[name].setdefault(key, {}).setdefault(c, 0)
                t[name][key][c] += 1
        tables[k] = t

    def p(k, ctx, c):
        own = tables[k][{2: "abc", 1: "bc", 0: "c"}[len(ctx)]].get(ctx, {})
        total = sum(own.values())
        if not ctx:
            return (own.get(c, 0) + 0.5) / (total + 0.5 * n)
        return p(k, ctx[1:], c) if total < url_filter.MIN_CONTEXT else (own.get(c, 0) + len(own) * p(k, ctx[1:], c)) / (total + len(own))

    score = lambda codes: sum(math.log(p("allow", g[:2], g[2])) - math.log(p("block", g[:2], g[2])) for g in grams(codes)) / len(codes) if codes else 0.0
    bins = {}
    for h, c, b, s in parts:
        if h and b and not s and learn(b[1]):
            cell = bins.setdefault(math.floor(score(c) / url_filter.STEP), [0, 0])
            cell[b[2] == "allow"] += 1
    cut, good, bad = None, 0, 0
    total = sum(x[1] for x in bins.values())
    for at in sorted(bins):
        bad, good = bad + bins[at][0], good + bins[at][1]
        if total and good / total <= url_filter.MAX_LOSS and bad:
            cut = (at + 1) * url_filter.STEP
    return [(b[2] if b else "block" if cut is not None and score(c) < cut else "allow", score(c)) for h, c, b, s in parts]


def test_url_verdicts_equal_the_plain_version(spark):
    """Every URL of a whole table, by the query's own rules."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    rows = [(r.page_id, r.url) for r in pages.collect()] + [(-1, None), (-2, "nothing"), (-3, "http://Example.COM/EN/7#x?y")]
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    want = dict(zip([i for i, _ in rows], plain_url_verdicts([u for _, u in rows], URL_RULES), strict=True))
    for r in url_filter.filter_urls(df, URL_RULES).select("page_id", "_url.verdict", "_url.score").collect():
        assert r.verdict == want[r.page_id][0] and abs(r.score - want[r.page_id][1]) < 1e-9


def test_url_models_do_not_learn_the_rules(spark):
    """Where little but the rules tells the sides apart, models block few URLs; of a rule that is taken away they allow what it allowed, and block a part of what it blocked at most."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").cache()
    free = url_filter.filter_urls(pages, URL_RULES).where("_url.rule is null")
    n, blocked = free.count(), free.where("_url.verdict = 'block'").count()
    assert n > 100 and blocked / n < 0.1
    for left in URL_RULES:
        rest = [r for r in URL_RULES if r != left]
        of = url_filter.filter_urls(pages, rest).select("page_id", F.col("_url.rule").alias("now"), F.col("_url.verdict").alias("v")).join(url_filter.filter_urls(pages, URL_RULES).select("page_id", F.col("_url.rule").alias("was")), "page_id").where((F.col("was") == left[1]) & F.col("now").isNull())
        assert of.where("v = 'block'").count() <= (0.1 if left[0] == "allow" else 0.33) * of.count() + 1, left


def test_url_ratios_back_off(spark):
    """Every gram's ratio against a plain Witten-Bell model, those never seen included."""
    import math

    n = url_filter.SYMBOLS
    rng = random.Random(3)
    seen = {a: [[rng.randrange(1, 9 if a else 14) for _ in range(30)] for _ in range(20)] for a in (True, False)}
    rows = [(a, [(([0, 0] + x)[i] * n + ([0, 0] + x)[i + 1]) * n + c for i, c in enumerate(x)]) for a in seen for x in seen[a]]
    ratio = {r.gram: r.ratio for r in url_filter.log_ratios(spark.createDataFrame(rows, "accepted boolean, grams array<int>")).collect()}
    assert len(ratio) == n**3

    def model(texts):
        count = {}
        for x in texts:
            full = [0, 0] + x
            for i, c in enumerate(x):
                for k in range(3):
                    count.setdefault(tuple(full[i + 2 - k : i + 2]), {}).setdefault(c, 0)
                    count[tuple(full[i + 2 - k : i + 2])][c] += 1

        def p(ctx, c):
            own = count.get(ctx, {})
            total = sum(own.values())
            if not ctx:
                return (own.get(c, 0) + 0.5) / (total + 0.5 * n)
            return p(ctx[1:], c) if total < url_filter.MIN_CONTEXT else (own.get(c, 0) + len(own) * p(ctx[1:], c)) / (total + len(own))

        return p

    good, bad = model(seen[True]), model(seen[False])
    for g in range(0, n**3, 97):
        a, b, c = g // n // n, g // n % n, g % n
        assert abs(ratio[g] - math.log(good((a, b), c) / bad((a, b), c))) < 1e-9


def test_warc(spark):
    big = "<p>é</p>" * 200
    pages = [(1, "http://b.com/x", big), (5, None, big), (3, "http://a.com/?q=a b\r\nX: y", "small"), (4, "http://a.com/", "small"), (7, "http://www.a.com/", "WARC/1.1\r\n\r\n" * 100), (2, "http://c.com", None), (9, "http://b.com/x", "\r\n\r\n" + big), (5, None, big), (8, "u", "x" * 1000), (6, "u", "x" * 1000), (10, "u", "x" * 999)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("id", F.lit("clash"))
    out = warc.capture_history(df)
    assert got(out, "id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want(brute.warc(pages))
    order = [(r.key, r.date, r.id) for r in out.orderBy("range", "place").collect()]
    assert order == sorted(order)


def test_loser_tree():
    runs = [[1, 4, 9], [], [2, 2, 3], [0], [5, 6, 7, 8]]
    assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(sum(runs, []))
    assert list(warc.LoserTree([], lambda x: x)) == []


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert decontaminate.decontaminate(empty, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert quality_rules.quality_rules(empty).count() == 0
    assert line_dedup.line_dedup(empty).count() == 0
    assert simhash.simhash_classes(empty).count() == 0
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert secret_scan.scan_secrets(empty).count() == 0
    assert quality_classifier.quality_scores(empty, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.filter_urls(pages, URL_RULES).count() == 0
    assert warc.capture_history(pages).count() == 0


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)

    def prose(n):
        return " ".join(f"p{rng.randrange(3000)}" for _ in range(n))

    item = prose(40)
    rows = [(i, prose(150) + "\nA line of everywhere\n" + prose(20), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[0][1], "en", "s0"), (101, rows[1][1].replace(" ", " x ", 1), "de", "s1"), (102, prose(90) + " " + item + " " + prose(30), "en", "s2"), (103, "too short", "en", "s0"), (104, "again " * 200, "en", "s1"), (105, None, None, None), (106, prose(120), None, None)]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in out}
    assert kept <= {*range(60), 106} and not kept & {100, 101, 102, 103, 104, 105}
    assert all("A line of everywhere" not in r.text for r in out)
    assert all(r.n_chars == len(r.text) for r in out)
    clean = [brute.WORD.findall(r[1].replace("A line of everywhere", "")) for r in rows if r[0] in {*range(60), 106}]
    assert abs(sum(r.taken for r in out) - 1.5 * sum(map(len, clean))) <= 4
