"""Predictions from evidence: four kinds that describe one observation, and the playback they heard.

Events of a session come in order of seq: an audio ``chunk`` (with its epochs, last sample and
playback condition), one kind of evidence (``yield``, ``future``, ``turn``, ``overlap``) or a
``reset`` when the turn is over. Evidence counts if its epochs are the last chunk's and its
observation is no older than the largest lag; the four kinds of one group make a prediction.

The state of a session is bounded: groups and playback conditions are maps that lose what is
stale with every chunk, and the least recently seen beyond their capacity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parley.operators.folds import fold

KINDS = ("yield", "future", "turn", "overlap")
COLUMNS = ("session", "seq", "kind", "stream_epoch", "turn_epoch", "sample", "group_id", "playback", "p", "p_speech", "confidence")
INPUT = "session string, seq bigint, kind string, stream_epoch int, turn_epoch int, sample bigint, group_id string, playback string, p double, p_speech double, confidence double"
OUTPUT = "session string, seq bigint, group_id string, outcome string, p_speech double, p_yield double, p_backchannel double, p_interruption double, playback string, confidence double"


@dataclass(frozen=True)
class Limits:
    lag: int = 1600
    playbacks: int = 128
    groups: int = 64


@dataclass
class Reducer:
    """State of one session. ``groups``: id to (stream epoch, turn epoch, sample, kind to its values); ``playbacks``: id to (stream epoch, turn epoch, sample)."""

    limits: Limits
    epochs: tuple | None = None
    least: int = 0
    seq: int = -1
    groups: dict[str, list] = field(default_factory=dict)
    playbacks: dict[str, list] = field(default_factory=dict)

    def chunk(self, epochs: tuple, sample: int, playback: str | None) -> None:
        self.epochs, self.least = epochs, max(0, sample - self.limits.lag)
        for known in (self.groups, self.playbacks):
            for name in [n for n, v in known.items() if tuple(v[:2]) != epochs or v[2] < self.least]:
                del known[name]
        if playback is not None:
            self.playbacks.pop(playback, None)
            self.playbacks[playback] = [*epochs, sample]
            while len(self.playbacks) > self.limits.playbacks:
                del self.playbacks[next(iter(self.playbacks))]

    def reset(self) -> None:
        self.epochs, self.least = None, 0
        self.groups.clear()
        self.playbacks.clear()

    def evidence(self, kind: str, epochs: tuple, sample: int, group: str, playback: str | None, values: tuple) -> tuple | None:
        """(outcome, prediction) where the event settles its group or breaks a rule; None while the group waits.

        Outcomes: ``stale`` (old epochs or observation), ``inconsistent`` (siblings of another
        observation), ``predicted``, or why a whole group makes no prediction: ``uncited`` (no
        playback named), ``unknown_playback``, ``incomplete`` (a needed value is null).
        """
        if epochs != self.epochs or sample < self.least:
            return "stale", None
        own = self.groups.get(group)
        if own is None:
            own = self.groups[group] = [*epochs, sample, {}]
            while len(self.groups) > self.limits.groups:
                del self.groups[next(iter(self.groups))]
        elif (*own[:3],) != (*epochs, sample):
            return "inconsistent", None
        else:
            self.groups[group] = self.groups.pop(group)  # seen last
        own[3][kind] = [playback, *values]
        if len(own[3]) < len(KINDS):
            return None
        del self.groups[group]
        cited, p_yield, p_speech, _ = own[3]["yield"]
        if cited is None:
            return "uncited", None
        heard = self.playbacks.pop(cited, None)
        backchannel, interruption = own[3]["turn"][1], own[3]["overlap"][1]
        if None in (p_speech, p_yield, backchannel, interruption):
            return "incomplete", None
        if heard is None:
            return "unknown_playback", None
        return "predicted", (p_speech, p_yield, backchannel, interruption, cited, min(own[3][k][3] for k in KINDS))


def _null(v):
    return None if v is None or v != v else v


def reduce_events(state: Reducer, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of OUTPUT, without their session, for events in order (COLUMNS from seq on)."""
    for seq, kind, stream_epoch, turn_epoch, sample, group, playback, *values in rows:
        if seq <= state.seq:
            continue  # a repeat
        state.seq = seq
        if kind == "reset":
            state.reset()
        elif kind == "chunk":
            state.chunk((stream_epoch, turn_epoch), sample, playback)
        elif kind in KINDS and group is not None:
            found = state.evidence(kind, (stream_epoch, turn_epoch), sample, group, playback, tuple(values))
            if found is not None:
                yield (seq, group, found[0], *(found[1] or (None,) * 6))


def stream_predictions(events: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Rows of OUTPUT for streamed events (INPUT): predictions, and evidence that came to nothing.

    A session's events come in order of seq from one trigger to the next; repeats are passed over.
    The state of a session holds at most ``limits`` groups and playback conditions.
    """
    kept = "epochs array<int>, least bigint, seq bigint, groups string, playbacks string"

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        import json

        state = Reducer(limits)
        if held.exists:
            epochs, state.least, state.seq, groups, playbacks = held.get
            state.epochs = tuple(epochs) if epochs is not None and len(epochs) else None
            state.groups, state.playbacks = json.loads(groups), json.loads(playbacks)
        got = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = list(reduce_events(state, ((int(r[0]), r[1], *(None if _null(v) is None else int(v) for v in r[2:5]), *map(_null, r[5:])) for r in got[list(COLUMNS[1:])].itertuples(index=False, name=None))))
        held.update(([] if state.epochs is None else list(state.epochs), state.least, state.seq, json.dumps(state.groups), json.dumps(state.playbacks)))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return events.select(*COLUMNS).groupBy("session").applyInPandasWithState(step, OUTPUT, kept, "append", GroupStateTimeout.NoTimeout)


def batch_predictions(events: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """The same rows of a whole table of events."""

    def step(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        for out in reduce_events(Reducer(limits), (r[1:] for r in rows)):
            yield (*key, *out)

    return fold(events.select(*COLUMNS), ["session"], ["seq"], OUTPUT, step)
