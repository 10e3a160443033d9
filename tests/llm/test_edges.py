"""Clashing names, nulls, empty tables, and whether the dealt method decides the result."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import common, decontaminate, line_dedup, mixing, quality_classifier, quality_rules, secret_scan, simhash, suffix_dedup, url_filter
from parley.llm.queries import URL_RULES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
OWN = ("_quality", "_lines", "_mix", "_secrets", "_contamination", "_score", "_cut", "_kept", "_row", "_t", "_f", "_c", "_id", "rep")


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"some words of text number {i}\nand a line", "en", "a", 9) for i in range(12)] + [(None, None, None, None, None), (3, "", "de", None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in OWN:
        df = df.withColumn(c, F.lit("clash"))
    return df


def test_clashing_columns(spark, clashing):
    """A column by the name of the result is replaced; every other column comes back, whatever it is called."""
    bench = spark.createDataFrame([(1, "words of text number 5")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    results = {
        "_quality": quality_rules.quality_rules(clashing),
        "_lines": line_dedup.line_dedup(clashing),
        "_mix": mixing.mix(clashing),
        "_secrets": secret_scan.scan_secrets(clashing),
        "_contamination": decontaminate.decontaminate(clashing, bench),
        "_score": quality_classifier.quality_scores(clashing, labels),
        "_cut": suffix_dedup.suffix_dedup(clashing),
    }
    for name, out in results.items():
        assert out.columns.count(name) == 1 and out.schema[name].dataType.typeName() == "struct", name
        assert {c for c in clashing.columns if c not in (name, "text")} <= set(out.columns), name
        assert out.count() == 14, name
    assert simhash.keep_one(clashing).columns == clashing.columns
    pages = spark.createDataFrame([(1, "http://a.com/en/x", "clash")], "page_id long, url string, _url string")
    assert url_filter.filter_urls(pages, URL_RULES).select("_url.verdict").first()[0] == "block"


def test_pipeline_stages_on_empty_and_null_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    nothing = spark.createDataFrame([], SCHEMA)
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3 + [(1, None, None, None, None)], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0, name
        kept = stage(spark, nulls, str(tmp_path))
        # The rules reject texts without words, and the mix takes no words of them; the other stages have nothing against them.
        assert kept.count() == (0 if name in ("quality rules", "mixing") else 4), name


def test_fences_are_continuous_in_the_number_of_rows(spark):
    """A group's fence moves smoothly as it gets rows; no number of rows switches it."""

    def fence(n):
        rows = [("en", "big", 5000 + i % 40, 0, 0, 0) for i in range(400)] + [("en", "small", 7000 + i % 40, 0, 0, 0) for i in range(n)]
        df = spark.createDataFrame(rows, "lang string, source string, word_len long, symbol_rate long, dup_line_rate long, repeat_rate long")
        return quality_rules.fences(df).where("source = 'small'").select(F.col("fence")["word_len"]["high"]).first()[0]

    highs = [fence(n) for n in (30, 99, 100, 101, 199, 200, 201)]
    assert all(abs(a - b) < 0.02 * a for a, b in zip(highs[1:], highs[2:4], strict=False)) and abs(highs[-1] - highs[-3]) < 0.01 * highs[-1]
    assert highs[0] < highs[-1]


def test_line_batches_are_joined_against_the_runs(spark):
    """A settled key enters no further run, and runs are compacted in levels."""
    runs = line_dedup.LineRuns(spark, 3, 4)
    for b in range(4):
        docs = spark.createDataFrame([(i, f"everywhere\nbatch {b} line {i}") for i in range(4)], "doc_id long, text string")
        known = runs.add(line_dedup.batch_counts(docs, "text", 1, 1, 4).select("h", "n"))
        before = {r.before for r in known.where("n = 4").collect()}
        assert before == {0 if b == 0 else 4}
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    everywhere = runs.settled().collect()
    assert len(everywhere) == 1 and everywhere[0].n == 4  # of the first batch only: later ones left it out


def test_posting_lists_are_intersected(spark):
    docs = spark.createDataFrame([(1, "a token=abcdefgh12"), (2, "tok and ken"), (3, "AKIA1234567890ABCD"), (None, "secret: abcdefgh"), (5, None)], "doc_id long, text string")
    index = secret_scan.build_index(docs, "doc_id", F.col("text"), secret_scan.vocabulary(secret_scan.RULES))
    postings = {(r.term, r.key) for r in index.collect()}
    assert ("tok", 1) in postings and ("tok", 2) in postings and ("oke", 2) not in postings
    found = {r.key: r.rules for r in secret_scan.candidates(index, secret_scan.RULES).collect()}
    assert found == {1: 1, 3: 2, None: 1}
    out = secret_scan.scan_secrets(docs, index=index)
    assert {r.doc_id for r in out.where("_secrets.spans != ''").collect()} == {1, 3, None}
    none = secret_scan.scan_secrets(docs, index=index.limit(0)).where("_secrets.spans != ''")
    assert none.count() == 0  # without postings no rule but those without trigrams finds anything


def test_range_sums(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(5), i, rng.randrange(9)) for i in range(300)]
    out = common.range_sums(spark.createDataFrame(rows, "a int, b int, v long").repartition(7), ["a", "b"], ["v"], 5)
    got = {(r.a, r.b): r.before_v for r in out.collect()}
    total = 0
    for a, b, v in sorted(rows):
        assert got[a, b] == total
        total += v


def test_scratch_keeps_what_is_kept(spark):
    with common.scratch(spark):
        inner = common.materialize(spark.range(5), "inner")
        out = common.kept(inner.where("id > 2"), "outer")
    assert out.count() == 2
    with pytest.raises(Exception, match="(?i)not.?(found|exist)"):
        inner.where("id > 3").collect()


def test_factorisation_machine_against_plain_sums():
    """Scores of whole feature rows against the sum over all pairs."""
    import numpy as np

    rng = np.random.default_rng(4)
    m = quality_classifier.Machine(rng.normal(size=(20, 3)))
    m.w[:], m.v[:], m.w0 = rng.normal(size=m.size), rng.normal(size=m.v.shape), 0.3
    text, i, x = [], [], []
    for t in range(6):
        own = rng.choice(m.size, 5, replace=False)
        text += [t] * 5
        i += own.tolist()
        x += rng.normal(size=5).tolist()
    text, i, x = np.array(text), np.array(i), np.array(x)
    scores = m.forward(np.arange(0, 30, 5), i, x)[0]
    for t in range(6):
        at = np.flatnonzero(text == t)
        plain = m.w0 + sum(m.w[i[a]] * x[a] for a in at) + sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in at for b in at if b < a)
        assert abs(scores[t] - plain) < 1e-9


def test_a_scope_leaves_no_table_behind(spark):
    """Neither folders nor catalogue tables of operators whose results were read inside it."""
    docs = spark.createDataFrame([(i, f"line {i % 3}\nsome words of text {i}", "en", "s", 30) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    root = spark._jvm.org.apache.hadoop.fs.Path(common.work_root(spark))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda: ({s.getPath().getName() for s in fs.listStatus(root)}, {t.name for t in spark.catalog.listTables()})
    before = there()
    with common.scratch(spark):
        for out in (line_dedup.line_dedup(docs), simhash.keep_one(docs), suffix_dedup.suffix_dedup(docs), mixing.mix(docs), secret_scan.scan_secrets(docs)):
            assert out.count() > 0
        assert there() != before
    assert there() == before


def test_scopes_of_threads_are_apart(spark):
    import threading

    kept = spark.range(5)

    def other():
        with common.scratch(spark):
            common.materialize(kept, "other")

    with common.scratch(spark):
        mine = common.materialize(kept, "mine")
        t = threading.Thread(target=other)
        t.start()
        t.join()
        seen = mine.count()
    assert seen == 5
