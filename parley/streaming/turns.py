"""Turns of live audio: when someone begins to speak, with the sound just before, and when their turn is over.

Chunks of sound come as (session, seq, samples, speech, confidence, p_yield, p_speech); the last
three are a prediction at that chunk, null where there is none. A turn begins at a chunk with speech
and reaches back over the pre-roll; it ends at a chunk without speech once the silence is long
enough, unless a sure prediction says that the speaker goes on, or as soon as a sure one says
that they yield. Each end raises the turn's epoch, and the next turn's pre-roll starts afresh.

:func:`stream_turns` keeps this as state (a list of chunks for the pre-roll, one value, a timer);
:func:`batch_turns` gives the same turns of a table by windows and aggregates.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from parley.streaming.jobs import RATE

TURNS = "session string, epoch int, start_sample bigint, speech_sample bigint, end_sample bigint, n_speech int, reason string"


@dataclass(frozen=True)
class Policy:
    """Limits of a turn; durations in milliseconds."""

    silence: int = 500
    pre_roll: int = 300
    confidence: float = 0.7
    commit: float = 0.9
    hold: float = 0.65

    @property
    def silence_samples(self) -> int:
        return self.silence * RATE // 1000

    @property
    def pre_roll_samples(self) -> int:
        return self.pre_roll * RATE // 1000


@dataclass
class Turn:
    """What a session carries from chunk to chunk besides its pre-roll; ``start`` is below 0 while nobody speaks."""

    seq: int = -1
    position: int = 0
    epoch: int = 0
    start: int = -1
    spoke: int = 0
    n_speech: int = 0
    silence: int = 0


STATE = "seq bigint, position bigint, epoch int, start bigint, spoke bigint, n_speech int, silence bigint"
RING = "start bigint, samples bigint"


def _sure(value, least: float) -> bool:
    return value is not None and value == value and value >= least


def close(turn: Turn, reason: str) -> tuple:
    """The finished turn's row, without its session; the next epoch begins."""
    row = turn.epoch, turn.start, turn.spoke, turn.position, turn.n_speech, reason
    turn.epoch, turn.start, turn.silence, turn.n_speech = turn.epoch + 1, -1, 0, 0
    return row


def advance(turn: Turn, ring: list[tuple[int, int]], chunks: Iterable[tuple], policy: Policy) -> list[tuple]:
    """Turns that ``chunks`` (seq, samples, speech, confidence, p_yield, p_speech) in order finish; ``turn`` and ``ring`` are brought up to date.

    A chunk that is not later than those seen is a repeat, and passed over.
    """
    out = []
    for seq, samples, speech, confidence, p_yield, p_speech in chunks:
        if seq <= turn.seq:
            continue
        turn.seq, at = seq, turn.position
        turn.position += samples
        if turn.start < 0:
            ring.append((at, samples))
            held = sum(n for _, n in ring)
            while held > policy.pre_roll_samples:
                held -= ring.pop(0)[1]
            if speech:
                turn.start, turn.spoke, turn.n_speech, turn.silence = (ring[0][0] if ring else turn.position), at, 1, 0
                ring.clear()
            continue
        if speech:
            turn.silence, turn.n_speech = 0, turn.n_speech + 1
            continue
        turn.silence += samples
        sure = _sure(confidence, policy.confidence)
        if sure and _sure(p_yield, policy.commit):
            out.append(close(turn, "prediction"))
        elif turn.silence >= policy.silence_samples and not (sure and _sure(p_speech, policy.hold)):
            out.append(close(turn, "silence"))
    return out


class TurnProcessor(StatefulProcessor):
    """State of one session: ring of the pre-roll, turn, and a timer that ends the turn if no sound comes any more."""

    def __init__(self, policy: Policy, idle: int) -> None:
        self.policy, self.idle = policy, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", RING)
        self.turn = handle.getValueState("turn", STATE)

    def _load(self) -> tuple[Turn, list[tuple[int, int]]]:
        turn = Turn(*self.turn.get()) if self.turn.exists() else Turn()
        return turn, [(int(a), int(n)) for a, n in self.ring.get()]

    def _store(self, turn: Turn, ring: list[tuple[int, int]]) -> None:
        self.turn.update(astuple(turn))
        if ring:
            self.ring.put(ring)
        else:
            self.ring.clear()

    def _frame(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=["session", "epoch", "start_sample", "speech_sample", "end_sample", "n_speech", "reason"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        turn, ring = self._load()
        got = pd.concat(list(rows)).sort_values("seq", kind="stable")
        some = got[["seq", "samples", "speech", "confidence", "p_yield", "p_speech"]].itertuples(index=False, name=None)
        out = advance(turn, ring, ((int(s), int(n), bool(x), c, y, p) for s, n, x, c, y, p in some), self.policy)
        self._store(turn, ring)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if turn.start >= 0:
            self.handle.registerTimer(int(got["at"].max().timestamp() * 1000) + self.idle)
        yield from self._frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        turn, ring = self._load()
        rows = [close(turn, "end")] if turn.start >= 0 else []
        self._store(turn, ring)
        yield from self._frame(key, rows)


def _clean(chunks: DataFrame) -> DataFrame:
    """Chunks without a seq are passed over; no length is none, and no verdict is silence."""
    rest = {"samples": F.coalesce("samples", F.lit(0)).cast("bigint"), "speech": F.coalesce("speech", F.lit(False))}
    return chunks.where("seq is not null").withColumns(rest | {p: F.col(p).cast("double") for p in ("confidence", "p_yield", "p_speech")})


def stream_turns(chunks: DataFrame, policy: Policy = Policy(), at: str = "at", lateness: str = "1 second", idle: str | int = 2000) -> DataFrame:  # noqa: B008
    """Turns (session, epoch, start_sample, speech_sample, end_sample, n_speech, reason) of streamed chunks with event time ``at``.

    A turn that no chunk ends is ended by a timer, ``idle`` milliseconds of event time after the
    session's last chunk (reason ``end``). Sessions must come in order of seq from one trigger to
    the next; repeats are passed over. Needs the RocksDB state store. State does not grow: a ring
    of the pre-roll's length and one row for each session.
    """
    c = _clean(chunks.withColumnRenamed(at, "at")).withWatermark("at", lateness).select("session", "seq", "samples", "speech", "confidence", "p_yield", "p_speech", "at")
    return c.groupBy("session").transformWithStateInPandas(TurnProcessor(policy, int(idle)), TURNS, "Append", "EventTime")


def batch_turns(chunks: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """The same turns of a whole table of chunks (one row for each session and seq); open ones end with their session.

    Whether a silence ends a turn depends only on the silence itself, so each run of chunks between
    two chunks with speech is judged alone.
    """
    order = Window.partitionBy("session").orderBy("seq")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    c = _clean(chunks).select("session", "seq", "samples", "speech", "confidence", "p_yield", "p_speech").withColumn("stop", F.sum("samples").over(so_far)).withColumn("begin", F.col("stop") - F.col("samples"))
    c = c.withColumn("run", F.sum(F.col("speech").cast("int")).over(so_far)).withColumn("quiet", F.col("stop") - F.max(F.when(F.col("speech"), F.col("stop"))).over(so_far))
    sure = F.coalesce(F.col("confidence") >= policy.confidence, F.lit(False))
    yields = sure & F.coalesce(F.col("p_yield") >= policy.commit, F.lit(False))
    silent = (F.col("quiet") >= policy.silence_samples) & ~(sure & F.coalesce(F.col("p_speech") >= policy.hold, F.lit(False)))
    ends = ~F.col("speech") & (F.col("run") > 0) & (yields | silent)
    first = F.min(F.when(ends, F.struct("stop", F.when(yields, "prediction").otherwise("silence").alias("reason"))))
    runs = c.withColumn("ends", ends).groupBy("session", "run").agg(first.alias("over"), F.min(F.when(F.col("speech"), F.col("begin"))).alias("spoke"), F.max("stop").alias("last"))
    by_run = Window.partitionBy("session").orderBy("run")
    # A turn is the runs after one that ended a turn, up to the next that does.
    turn = runs.where("run > 0").withColumn("epoch", F.coalesce(F.sum(F.col("over").isNotNull().cast("int")).over(by_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = turn.groupBy("session", "epoch").agg(F.min("spoke").alias("spoke"), F.count("*").alias("n"), F.max("over").alias("over"), F.max("last").alias("last"))
    t = t.withColumn("free", F.coalesce(F.lag("over.stop").over(Window.partitionBy("session").orderBy("epoch")), F.lit(0)))
    # The pre-roll: chunks since the last turn, as many before the first word as fit with its chunk. Dealt by time, so that turns meet only chunks near them.
    wide = max(1, policy.pre_roll_samples)
    starts = t.select("session", "epoch", F.col("spoke").alias("_spoke"), F.col("free").alias("_free"), F.explode(F.sequence(F.floor((F.col("spoke") - wide) / wide), F.floor(F.col("spoke") / wide))).alias("_slot"))
    near = c.withColumn("_slot", F.floor(F.col("begin") / wide)).join(starts, ["session", "_slot"])
    opening = near.where((F.col("begin") >= F.col("_free")) & (F.col("begin") <= F.col("_spoke")) & (F.col("begin") > F.col("_spoke") - wide))
    size = F.max(F.when(F.col("begin") == F.col("_spoke"), F.col("stop")))
    held = opening.groupBy("session", "epoch").agg(size.alias("_to"), F.collect_list("begin").alias("_at"))
    out = t.join(held, ["session", "epoch"]).withColumn("_in", F.array_min(F.filter("_at", lambda b: F.col("_to") - b <= policy.pre_roll_samples)))
    return out.select("session", F.col("epoch").cast("int").alias("epoch"), F.coalesce("_in", "_to").alias("start_sample"), F.col("spoke").alias("speech_sample"), F.coalesce("over.stop", "last").alias("end_sample"), F.col("n").cast("int").alias("n_speech"), F.coalesce("over.reason", F.lit("end")).alias("reason"))
