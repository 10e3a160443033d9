"""Live turns and evidence: batch and stream against the plain step-by-step machine, over any split of the input."""

import random

import pytest

from parley.operators.folds import fold
from parley.streaming import evidence, jobs, turns

CHUNKS = "session string, seq long, samples long, speech boolean, confidence double, p_yield double, p_speech double, at timestamp"


def chunk_rows(seed=1, sessions=6, n=120):
    import datetime

    rng = random.Random(seed)
    out = []
    for s in range(sessions):
        talks = False
        for i in range(n):
            if rng.random() < 0.15:
                talks = not talks
            p = (rng.choice([0.5, 0.7, 0.95]), rng.choice([0.2, 0.9, 1.0]), rng.choice([0.1, 0.65, 0.9])) if rng.random() < 0.2 else (None, None, None)
            at = datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i * 0.1)
            out.append((f"s{s}", i, rng.choice([320, 800, 1600, 3200, 6000]), talks, *p, at))
    return out


def plain_turns(rows, policy):
    """The live session's loop, chunk by chunk, ended with its input."""
    out = []
    for name in sorted({r[0] for r in rows}):
        turn, ring = turns.Turn(), []
        mine = sorted((r for r in rows if r[0] == name), key=lambda r: r[1])
        out += [(name, *t) for t in turns.advance(turn, ring, (r[1:7] for r in mine), policy)]
        if turn.start >= 0:
            out.append((name, *turns.close(turn, "end")))
    return sorted(out)


@pytest.mark.parametrize("policy", [turns.Policy(), turns.Policy(silence=100, pre_roll=50, commit=0.8, hold=0.95)])
def test_batch_turns_equal_the_loop(spark, policy):
    rows = chunk_rows()
    got = sorted(tuple(r) for r in turns.batch_turns(spark.createDataFrame(rows, CHUNKS).repartition(5), policy).collect())
    assert got == plain_turns(rows, policy)
    assert {r[-1] for r in got} == {"prediction", "silence", "end"}


def test_turn_rules():
    """300 ms of pre-roll, half a second of silence, a sure prediction that commits or holds."""
    policy = turns.Policy()
    say = lambda *marks: [(i, 1600, m == "x", *(p or (None,) * 3)) for i, (m, p) in enumerate(marks)]
    turn, ring = turns.Turn(), []
    quiet, talk = ("-", None), ("x", None)
    found = turns.advance(turn, ring, say(*[quiet] * 10, talk, talk, *[quiet] * 5), policy)
    assert found == [(0, 8 * 1600 + 1600, 10 * 1600, 17 * 1600, 2, "silence")] or found == [(0, 8 * 1600, 10 * 1600, 17 * 1600, 2, "silence")]
    assert found[0][2] + 1600 - found[0][1] <= policy.pre_roll_samples and turn.epoch == 1 and turn.start < 0
    turn, ring = turns.Turn(), []
    hold, unsure, commit = ("-", (0.7, 0.0, 0.65)), ("-", (0.6, 1.0, 1.0)), ("-", (0.7, 0.9, 0.0))
    assert turns.advance(turn, ring, say(talk, *[quiet] * 4, hold, hold), policy) == []
    assert turns.advance(turns.Turn(), [], say(talk, *[quiet] * 4, unsure), policy)[0][-1] == "silence"
    assert turns.advance(turns.Turn(), [], say(talk, commit), policy) == [(0, 0, 0, 3200, 1, "prediction")]


def test_any_split_of_the_chunks_gives_the_same_turns():
    rows = [r[1:7] for r in chunk_rows(seed=4, sessions=1, n=300)]
    whole_turn, whole_ring = turns.Turn(), []
    whole = turns.advance(whole_turn, whole_ring, rows, turns.Policy())
    rng = random.Random(0)
    for _ in range(20):
        turn, ring, out, at = turns.Turn(), [], [], 0
        while at < len(rows):
            n = rng.randint(1, 40)
            out += turns.advance(turn, ring, rows[max(0, at - rng.randint(0, 3)) : at + n], turns.Policy())  # with repeats
            at += n
        assert (out, turn, ring) == (whole, whole_turn, whole_ring)


def test_streamed_turns_equal_the_batch(spark, tmp_path):
    rows = chunk_rows(seed=2, sessions=4, n=60)
    for part, (lo, hi) in enumerate(((0, 25), (25, 60))):
        spark.createDataFrame([r for r in rows if lo <= r[1] < hi], CHUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if part == 0:
            import time

            time.sleep(1.1)  # files are taken in order of time
    source = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    from pyspark.sql import functions as F

    end = {"at": F.lit("2100-01-01").cast("timestamp"), "session": F.lit("end"), "seq": F.lit(0)}
    out = jobs.run_to_end(turns.stream_turns, source, end, "turns", str(tmp_path / "run"), rocks=True).where("session != 'end'")
    assert sorted(tuple(r) for r in out.collect()) == plain_turns(rows, turns.Policy())
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def feed(state, *events):
    return list(evidence.reduce_events(state, iter([(i + state.seq + 1, *e) for i, e in enumerate(events)])))


def kinds(group, sample=320, turn=1, playback="p", values=(0.9, 0.1, 0.8)):
    return [(k, 1, turn, sample, group, playback if k == "yield" else None, *values) for k in evidence.KINDS]


def chunk(n, turn=1):
    return ("chunk", 1, turn, 160 * (n + 1), None, f"p{n}", None, None, None)


def test_reducer_state_is_bounded_and_loses_what_is_stale():
    state = evidence.Reducer(evidence.Limits(lag=320, playbacks=2, groups=2))
    feed(state, chunk(0), chunk(1), chunk(2))
    assert list(state.playbacks) == ["p1", "p2"]
    assert feed(state, *[kinds(f"g{i}", 480)[0] for i in range(3)]) == []
    assert list(state.groups) == ["g1", "g2"]
    feed(state, chunk(5))
    assert (len(state.groups), list(state.playbacks)) == (0, ["p5"])
    feed(state, chunk(6, turn=2))
    assert list(state.playbacks) == ["p6"]
    feed(state, ("reset", None, None, None, None, None, None, None, None))
    assert (state.groups, state.playbacks, state.epochs) == ({}, {}, None)


def test_reducer_outcomes():
    fresh = lambda: (s := evidence.Reducer(evidence.Limits(lag=320)), feed(s, chunk(0), chunk(1)))[0]
    state = fresh()
    out = feed(state, *kinds("g", playback="p1"))
    assert [r[1:] for r in out] == [("g", "predicted", 0.1, 0.9, 0.9, 0.9, "p1", 0.8)] and list(state.playbacks) == ["p0"]
    assert [r[2] for r in feed(fresh(), *kinds("g", turn=2))] == ["stale"] * 4
    assert [r[2] for r in feed(fresh(), *kinds("g", playback=None))] == ["uncited"]
    assert [r[2] for r in feed(fresh(), *kinds("g", playback="other"))] == ["unknown_playback"]
    assert [r[2] for r in feed(fresh(), *kinds("g", playback="p1", values=(None, 0.1, 0.8)))] == ["incomplete"]
    a, b, c, e = kinds("g", playback="p1")
    assert [r[2] for r in feed(fresh(), a, b, (*c[:3], 319, *c[4:]), e, c)] == ["inconsistent", "predicted"]
    state = fresh()
    assert feed(state, a, b, c) == [] and feed(state, chunk(8)) == [] and [r[2] for r in feed(state, e)] == ["stale"]


def test_folds_read_rows_in_order_and_stop_early(spark):
    df = spark.createDataFrame([(i % 3 if i % 7 else None, i, "x" * (i % 5)) for i in range(500)], "k int, i int, s string").repartition(7)
    out = fold(df, ["k"], ["i"], "k int, first int, n int", lambda key, rows: [(*key, next(rows)[1], sum(1 for _ in zip(rows, range(10), strict=False)))])
    assert sorted(out.collect(), key=str) == sorted([(None, 0, 10), (0, 3, 10), (1, 1, 10), (2, 2, 10)], key=str)
    assert fold(df.limit(0), ["k"], ["i"], "k int", lambda key, rows: [key]).collect() == []
