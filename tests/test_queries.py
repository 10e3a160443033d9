"""Registered queries against their SQL."""

import duckdb
import pytest

from parley.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["interval_union", "interval_overlap_pairs", "density_metrics", "latest_by_key", "logical_turns", "hash_split_quota", "overlap_policy_rules", "overlap_metrics", "quality_flags", "completion_anchors", "audit_conversations", "timeline_windows", "synchronization_candidates", "audit_evidence", "review_items", "disfluency_recall", "misalignment_queue", "alignment_assessment", "usable_starts", "review_replacements", "live_turns", "batch_turns", "stream_sessions", "stream_evidence_join", "evidence_predictions", "reply_events", "offset_evaluation", "corpus_issues", "exported_rows", "source_intervals", "published_versions", "training_propositions", "audit_rejections", "overlap_anchors"]


def same(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    r = db.execute(ORACLES[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted((tuple(map(same, x)) for x in r.fetchall()), key=repr) == sorted((tuple(map(same, x)) for x in got.select(*cols).collect()), key=repr)


def test_imports_need_no_session():
    """The driver imports the entry before it makes a session."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], timeout=120).returncode == 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
