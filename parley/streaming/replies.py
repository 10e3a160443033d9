"""Replies as they are generated: words to speak and calls of tools, whatever pieces the text comes in.

A reply speaks, and may then call one tool: ``<tool_call>{"name": ..., "arguments": ...}</tool_call>``.
A word comes out once the space after it is there, with its place in the spoken text; a call once it
is closed. Of a delimiter that has only begun nothing is spoken. So any two splits of a reply give
the same rows. A second call, or anything else after the first, ends the reply with a failure.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parley.operators.folds import fold

# The delimiters of a call.
OPEN, CLOSE = "<tool_call>", "</tool_call>"
OUTPUT = "session string, number int, kind string, text string, start int, end int, name string, arguments string, reason string"


@dataclass
class Reply:
    """State of one reply: where it is (speech, call, after, second, failed), text not yet decided on, the word begun and its place, rows so far."""

    at: str = "speech"
    pending: str = ""
    word: str = ""
    place: int = 0
    number: int = 0
    first: list[str] = field(default_factory=list)
    seq: int = -1


def begun(text: str, mark: str) -> int:
    """Length of the longest end of ``text`` that could become ``mark``, but is not yet."""
    return max((n for n in range(1, min(len(text), len(mark) - 1) + 1) if mark.startswith(text[-n:])), default=0)


def call_of(payload: str) -> tuple[str, str] | None:
    """(name, arguments as compact JSON) of a call, or None if it is none."""
    try:
        got = json.loads(payload)
    except ValueError:
        return None
    if not isinstance(got, dict) or set(got) != {"name", "arguments"} or not isinstance(got["name"], str):
        return None
    return got["name"], json.dumps(got["arguments"], separators=(",", ":"), ensure_ascii=False)


def _words(r: Reply, text: str, last: bool = False) -> Iterator[tuple]:
    r.word += text
    used = 0
    for m in re.finditer(r"\S+(?=\s)" if not last else r"\S+", r.word):
        yield "word", m.group(), r.place + m.start(), r.place + m.end(), None, None, None
        used = m.end()
    r.word, r.place = r.word[used:], r.place + used


def _failed(r: Reply, reason: str, name: str | None = None) -> tuple:
    r.at, r.pending = "failed", ""
    return "failed", None, None, None, name, None, reason


def _step(r: Reply) -> tuple[list[tuple], bool]:
    """Rows that the pending text allows now, and whether more may follow from what is left."""
    if r.at == "speech":
        cut = r.pending.find(OPEN)
        said = r.pending[:cut] if cut >= 0 else r.pending[: len(r.pending) - begun(r.pending, OPEN)]
        rows = list(_words(r, said, last=cut >= 0))
        r.pending = r.pending[len(said) + (len(OPEN) if cut >= 0 else 0) :]
        r.at = "call" if cut >= 0 else r.at
        return rows, cut >= 0
    if r.at in ("call", "second"):
        cut = r.pending.find(CLOSE)
        if cut < 0:
            return [], False
        found = call_of(r.pending[:cut])
        if r.at == "second":
            return [_failed(r, "duplicate_call" if found and list(found) == r.first else "multiple_calls", found[0] if found else None)], False
        if found is None:
            return [_failed(r, "malformed_json")], False
        r.at, r.pending, r.first = "after", r.pending[cut + len(CLOSE) :], list(found)
        return [("call", None, None, None, *found, None)], True
    if r.at == "after":
        r.pending = r.pending.lstrip()
        if r.pending.startswith(OPEN):
            r.at, r.pending = "second", r.pending[len(OPEN) :]
            return [], True
        if r.pending and not OPEN.startswith(r.pending):
            return [_failed(r, "unexpected_content")], False
    return [], False


def feed(r: Reply, text: str) -> list[tuple]:
    """Rows (kind, text, start, end, name, arguments, reason) that ``text`` completes."""
    if r.at == "failed" or not text:
        return []
    r.pending += text
    out, more = [], True
    while more:
        rows, more = _step(r)
        out += rows
    return out


def finish(r: Reply) -> list[tuple]:
    """Rows that the end of the reply completes: the last word, or a failure if it ends inside a call or a delimiter."""
    if r.at in ("call", "second") or (r.pending and (r.at == "after" or OPEN.startswith(r.pending))):
        return [_failed(r, "incomplete_call")]
    rows = list(_words(r, r.pending, last=True)) if r.at == "speech" else []
    r.at, r.pending = "failed", ""
    return rows


def advance(r: Reply, pieces: Iterable[tuple]) -> list[tuple]:
    """Numbered rows for pieces (seq, delta, final) in order; repeats, and what follows the final piece, are passed over."""
    out = []
    for seq, delta, final in pieces:
        if seq <= r.seq:
            continue
        r.seq = seq
        for row in feed(r, delta or "") + (finish(r) if final else []):
            out.append((r.number, *row))
            r.number += 1
    return out


def stream_replies(deltas: DataFrame) -> DataFrame:
    """Rows of OUTPUT for streamed pieces (session, seq, delta, final); the state of a session goes with its final piece."""
    names = [c.split()[0] for c in OUTPUT.split(", ")]

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        r = Reply(**json.loads(held.get[0])) if held.exists else Reply()
        got = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = advance(r, zip(got["seq"].astype(int), got["delta"], got["final"].astype(bool), strict=True))
        if got["final"].any():
            held.remove()
        else:
            held.update((json.dumps(asdict(r)),))
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=names).astype({"start": "Int32", "end": "Int32"})

    d = deltas.where("seq is not null").selectExpr("session", "cast(seq as bigint) AS seq", "delta", "coalesce(final, false) AS final")
    return d.groupBy("session").applyInPandasWithState(step, OUTPUT, "state string", "append", GroupStateTimeout.NoTimeout)


def batch_replies(deltas: DataFrame) -> DataFrame:
    """The same rows of a whole table of pieces; a reply without a final piece stays open, and its last word unsaid."""

    def step(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        r = Reply()
        for row in rows:
            for out in advance(r, [row[1:]]):
                yield (*key, *out)

    d = deltas.where("seq is not null").selectExpr("session", "cast(seq as bigint) AS seq", "delta", "coalesce(final, false) AS final")
    return fold(d, ["session"], ["seq"], OUTPUT, step)


@dataclass
class Spoken:
    """Which place in the text each word that a voice reports stands for.

    A source word may become several entries of the voice, of which the first stands for it, or
    none; then its place goes to the word before it, spoken or not yet.
    """

    waiting: deque[int | None] = field(default_factory=deque)
    last: tuple[int, int] | None = None
    upto: int = 0

    def source(self, entries: Iterable[bool], place: int) -> list[tuple[int, int]]:
        """Boundaries (place, sample) that a source word ending at ``place`` gives at once; ``entries``: whether each of its parts has tokens."""
        if place <= self.upto:
            raise ValueError("places of source words must grow")
        self.upto = place
        n = sum(map(bool, entries))
        if n:
            self.waiting.extend([place, *[None] * (n - 1)])
            return []
        for i in range(len(self.waiting) - 1, -1, -1):
            if self.waiting[i] is not None:
                self.waiting[i] = place
                return []
        if self.last is None:
            return []
        self.last = place, self.last[1]
        return [self.last]

    def heard(self, sample: int) -> tuple[int, int] | None:
        """The boundary of the next word that the voice reports at ``sample``, None for the rest of a word."""
        if not self.waiting:
            raise ValueError("the voice reports a word that no source word stands for")
        place = self.waiting.popleft()
        if place is None:
            return None
        self.last = place, sample
        return self.last
