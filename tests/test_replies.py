"""Replies in pieces: any split gives the rows of the whole."""

import random

import pytest

from parley.streaming import jobs, replies

CALL = '<tool_call>{"name": "find", "arguments": {"q": "é x", "n": [1, 2]}}</tool_call>'
TEXTS = {
    "plain words  here\n": [("word", "plain", 0, 5), ("word", "words", 6, 11), ("word", "here", 13, 17)],
    f"Let me look. {CALL}": [("word", "Let", 0, 3), ("word", "me", 4, 6), ("word", "look.", 7, 12), ("call", "find", '{"q":"é x","n":[1,2]}')],
    f"a{CALL} \n ": [("word", "a", 0, 1), ("call", "find", '{"q":"é x","n":[1,2]}')],
    f"{CALL}{CALL}": [("call", "find", '{"q":"é x","n":[1,2]}'), ("failed", "duplicate_call", "find")],
    CALL + '<tool_call>{"name": "b", "arguments": 1}</tool_call>': [("call", "find", '{"q":"é x","n":[1,2]}'), ("failed", "multiple_calls", "b")],
    f"{CALL} <tool_call>no</tool_call>": [("call", "find", '{"q":"é x","n":[1,2]}'), ("failed", "multiple_calls", None)],
    f"{CALL} and more": [("call", "find", '{"q":"é x","n":[1,2]}'), ("failed", "unexpected_content", None)],
    f"{CALL} <tool": [("call", "find", '{"q":"é x","n":[1,2]}'), ("failed", "incomplete_call", None)],
    "x <tool_call>{": [("word", "x", 0, 1), ("failed", "incomplete_call", None)],
    "x <tool_": [("word", "x", 0, 1), ("failed", "incomplete_call", None)],
    "a < b <tool> c<": [("word", "a", 0, 1), ("word", "<", 2, 3), ("word", "b", 4, 5), ("word", "<tool>", 6, 12)],
    '<tool_call>{"name": "f"}</tool_call> z': [("failed", "malformed_json", None)],
    '<tool_call>{"name": 1, "arguments": 2}</tool_call>': [("failed", "malformed_json", None)],
    '<tool_call>{"name": "f", "arguments": 2, "x": 0}</tool_call>': [("failed", "malformed_json", None)],
    "": [],
}


def brief(rows):
    return [r[1:5] if r[1] == "word" else (r[1], *r[5:7]) if r[1] == "call" else (r[1], r[7], r[5]) for r in rows]


def of(pieces):
    return replies.advance(replies.Reply(), [(i, p, i == len(pieces) - 1) for i, p in enumerate(pieces)])


@pytest.mark.parametrize("text", TEXTS)
def test_every_split_gives_the_rows_of_the_whole(text):
    whole = of([text])
    if text.endswith("c<"):
        assert brief(whole)[:4] == TEXTS[text] and brief(whole)[4:] == [("failed", "incomplete_call", None)]
    else:
        assert brief(whole) == TEXTS[text]
    for i in range(len(text) + 1):
        for j in range(i, len(text) + 1, 3):
            assert of([text[:i], text[i:j], text[j:]]) == whole
    assert of(list(text) or [""]) == whole


def test_streamed_and_batch_replies(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for n, text in enumerate(TEXTS):
        at = 0
        for seq in range(100):
            size = rng.randint(1, 9)
            rows.append((f"s{n}", seq, text[at : at + size] or None, at + size >= len(text)))
            at += size
            if at >= len(text):
                break
    schema = "session string, seq long, delta string, final boolean"
    want = sorted((f"s{n}", *r) for n, text in enumerate(TEXTS) for r in of([text]))
    batch = replies.batch_replies(spark.createDataFrame(rows, schema).repartition(4))
    assert sorted((tuple(r) for r in batch.collect()), key=str) == sorted(want, key=str)
    for lo, hi in ((0, 3), (2, 100)):  # with repeats
        spark.createDataFrame([r for r in rows if lo <= r[1] < hi], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = jobs.run_once(replies.stream_replies(source), "replies", str(tmp_path / "run"))
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(want, key=str)


def test_spoken_places():
    s = replies.Spoken()
    assert s.source([], 2) == []  # nothing was spoken yet
    assert s.source([True], 5) == [] and s.source([True, False, True], 9) == []
    assert s.source([False], 11) == []  # goes to the word that waits
    assert s.heard(100) == (5, 100) and s.heard(200) == (11, 200) and s.heard(210) is None
    assert s.source([], 14) == [(14, 200)]
    with pytest.raises(ValueError):
        s.heard(300)
    with pytest.raises(ValueError):
        s.source([True], 14)
