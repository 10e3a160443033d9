"""Streaming forms: sessions of speech, complete groups of evidence, revisions of transcripts, word chunks.

Event time is the sample position of the audio (16 kHz) turned into a timestamp, so watermarks
count in audio time. State is kept per session and goes with the watermark or the session's end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RATE = 16000


def at_sample(column: str) -> Column:
    """Sample position as event time."""
    return F.timestamp_micros(F.floor(F.col(column) * 1_000_000 / RATE).cast("bigint"))


def stream_sessions(events: DataFrame, keys: list[str], at: str, gap: str, lateness: str) -> DataFrame:
    """(keys, start, last, n) of runs of events with pauses shorter than ``gap``; a session comes out once the watermark passes its end."""
    w = events.withWatermark(at, lateness).groupBy(*keys, F.session_window(at, gap).alias("w"))
    return w.agg(F.min(at).alias("start"), F.max(at).alias("last"), F.count("*").alias("n")).drop("w")


def batch_sessions(events: DataFrame, keys: list[str], at: str, gap_seconds: float) -> DataFrame:
    """The same sessions of a batch."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys).orderBy(at)
    new = F.lag(at).over(w).isNull() | (F.unix_micros(at) - F.unix_micros(F.lag(at).over(w)) >= int(gap_seconds * 1e6))
    numbered = events.withColumn("_s", F.sum(new.cast("int")).over(w))
    return numbered.groupBy(*keys, "_s").agg(F.min(at).alias("start"), F.max(at).alias("last"), F.count("*").alias("n")).drop("_s")


def complete_evidence(events: DataFrame, group: str, kind: str, kinds: list[str], confidence: str, at: str, lateness: str) -> DataFrame:
    """(group, confidence, at) of groups that have evidence of every kind; confidence is the least of theirs.

    A group's events carry one event time; those behind the watermark are dropped, and a group comes
    out once, when the watermark passes it.
    """
    per = events.withWatermark(at, lateness).groupBy(group, at).agg(*[F.max(F.when(F.col(kind) == k, F.col(confidence))).alias(f"_{i}") for i, k in enumerate(kinds)])
    ok = F.lit(True)
    for i in range(len(kinds)):
        ok = ok & F.col(f"_{i}").isNotNull()
    return per.where(ok).select(group, at, F.least(*[F.col(f"_{i}") for i in range(len(kinds))]).alias("confidence"))


REVISION = "session string, seq bigint, stable string, volatile string, supersedes bigint"


def _prefix(a: str, b: str) -> str:
    if a == b:
        return b
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    cut = max((i + 1 for i, c in enumerate(b[:n]) if c in " .,!?;:\t\n"), default=0)
    return b[:cut]


def revise(rows: Iterator[tuple[int, str]], last: tuple[int, str] | None) -> tuple[list[tuple], tuple[int, str] | None]:
    """Revisions of one session's texts in order: unchanged texts are skipped; each names the one it supersedes."""
    out = []
    for seq, text in rows:
        if last is not None and text == last[1]:
            continue
        stable = _prefix(last[1], text) if last is not None else ""
        out.append((seq, stable, text[len(stable) :], None if last is None else last[0]))
        last = (seq, text)
    return out, last


def stream_revisions(updates: DataFrame) -> DataFrame:
    """Revision chains of streamed transcripts (session, seq, text), one text of state per session."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values("seq")
        last = state.get if state.exists else None
        seen = -1 if last is None else last[0]
        fresh = pdf[pdf["seq"] > seen]  # a late repeat of what is already told adds nothing
        out, last = revise(zip(fresh["seq"].astype(int), fresh["text"].fillna(""), strict=True), last)
        if last is not None:
            state.update((int(last[0]), last[1]))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["session", "seq", "stable", "volatile", "supersedes"]).astype({"supersedes": "Int64"})

    return updates.groupBy("session").applyInPandasWithState(step, REVISION, "seq bigint, text string", "append", GroupStateTimeout.NoTimeout)


def chunk_text(pending: str, delta: str, least: int = 6, most: int = 8, final: bool = False) -> tuple[list[str], str]:
    """Chunks of ``least`` to ``most`` words, ending at a sentence where one ends in between; the rest is carried, its last word perhaps incomplete."""
    text = pending + delta
    tail = "" if final or not text or text[-1].isspace() else text.split()[-1]
    body = text[: len(text) - len(tail)] if tail else text
    words, chunks = body.split(), []
    while len(words) >= most or (final and words):
        ends = [i for i in range(least, min(most, len(words)) + 1) if words[i - 1][-1] in ".!?"]
        n = ends[0] if ends else min(most, len(words))
        chunks.append(" ".join(words[:n]))
        words = words[n:]
    rest = " ".join([*words, tail]) if words and tail else " ".join(words) + (" " if words else "") if not tail else tail
    return chunks, rest


def stream_chunks(deltas: DataFrame) -> DataFrame:
    """(session, number, chunk) of streamed text (session, seq, delta, final)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, pending = state.get if state.exists else (0, "")
        out, done = [], False
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            chunks, pending = chunk_text(pending, r.delta or "", final=bool(r.final))
            for c in chunks:
                out.append((key[0], number, c))
                number += 1
            if r.final:
                pending = ""
            done = bool(r.final)
        if done:
            state.remove()
        else:
            state.update((number, pending))
        if out:
            yield pd.DataFrame(out, columns=["session", "number", "chunk"])

    return deltas.groupBy("session").applyInPandasWithState(step, "session string, number int, chunk string", "number int, pending string", "append", GroupStateTimeout.NoTimeout)


def vad_turns(chunks: DataFrame, keys: list[str], silence_seconds: float = 0.5, lateness: str = "1 second") -> DataFrame:
    """Turns of streamed voice activity (keys, start_sample, end_sample, speech): closed by half a second without speech, in audio time."""
    speech = chunks.where("speech").withColumn("_at", at_sample("end_sample"))
    w = speech.withWatermark("_at", lateness).groupBy(*keys, F.session_window("_at", f"{int(silence_seconds * 1000)} milliseconds").alias("w"))
    return w.agg(F.min("start_sample").alias("start_sample"), F.max("end_sample").alias("end_sample"), F.count("*").alias("n_chunks")).drop("w")


def run_once(stream: DataFrame, name: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream (append) over what is there and return its rows, written as Parquet under the shared checkpoint folder."""
    root = checkpoint or f"{shared_folder(stream.sparkSession)}/{name}"
    q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/rows")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(build: Callable[[DataFrame], DataFrame], source: DataFrame, marker: dict[str, Column], name: str, checkpoint: str | None = None, rocks: bool = False) -> DataFrame:
    """Run the stream ``build(source)`` over what is there and then end it, and return all its rows, those of the table's tail as well.

    After the rows of ``source`` one row follows, ``marker`` (columns by name; others are null), by a
    source of its own and in a second run of the same query; its event time, past all others by more than the
    lateness and any time-out, lets the watermark pass whatever is open. ``build`` sees it as a row
    among others, so its key should be one that can be told apart in the result. ``rocks``: use the
    RocksDB state store (transformWithState needs it).
    """
    spark = source.sparkSession
    root = checkpoint or f"{shared_folder(spark)}/{name}"
    row = spark.range(1).select(*[marker.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in source.schema])
    row.where("false").write.parquet(f"{root}/marker")
    markers = spark.readStream.schema(source.schema).parquet(f"{root}/marker")
    out = build(source.unionByName(markers))
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    try:
        if rocks:
            spark.conf.set(key, ROCKS)
        for at_end in (False, True):
            if at_end:
                row.write.mode("append").parquet(f"{root}/marker")
            q = out.writeStream.outputMode("append").format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.set(key, was)
    return spark.read.schema(out.schema).parquet(f"{root}/rows")


def shared_folder(spark) -> str:
    """``spark.checkpoint.dir``; where it is unset, the warehouse, which the executors share as well."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def acknowledgements(commands: DataFrame, acks: DataFrame, generation: str = "generation") -> DataFrame:
    """Each acknowledgement with its state: stale (unknown command, old generation, sequence or position going back), duplicate or applied.

    Commands are (command_id, generation, sequence, active); acks (command_id, generation, sequence, position, received).
    """
    from pyspark.sql.window import Window

    c = commands.select("command_id", F.col(generation).alias("_g"), "active")
    w = Window.partitionBy(generation).orderBy("received").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(generation, "command_id", "sequence", "position").orderBy("received")
    a = acks.join(c, "command_id", "left").withColumns({"_seq": F.max("sequence").over(w), "_pos": F.max("position").over(w), "_rep": F.row_number().over(same)})
    stale = F.col("_g").isNull() | (F.col("_g") != F.col(generation)) | ~F.coalesce(F.col("active"), F.lit(False)) | (F.col("sequence") < F.col("_seq")) | (F.col("position") < F.col("_pos"))
    return a.withColumn("state", F.when(F.col("_rep") > 1, "duplicate").when(F.coalesce(stale, F.lit(False)), "stale").otherwise("applied")).select(*acks.columns, "state")
