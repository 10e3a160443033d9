"""Maps between clocks, in whole frames: which source frames stand where on a repaired track.

A map is rows (keys, start, end, offset): output frames [start, end) come from the source frames
``start - offset`` on. Rows of one map do not overlap; output frames in none are silence. Maps
compose and invert as joins of intervals, so a track of any length costs as many rows as it has pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.operators import intervals


def _frames(seconds: Column) -> Column:
    """Seconds as whole frames, halves to even."""
    return F.bround(seconds * F.col("rate")).cast("bigint")


def repair_pieces(plans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, start, end, offset): the pieces of each repaired second track, offset null where it is silent; neighbours that go on are one.

    ``plans``: (keys, n_frames, rate, first_shift, second_shift, exclude_from, exclude_to). A plan
    without an excluded window moves the whole track by ``second_shift``; one with it moves what lies
    before by the first, what lies after by the second, and silences the window. The pieces cover
    [0, n_frames) exactly; a track without frames has none.
    """
    keys = list(keys)
    n, zero = F.col("n_frames").cast("bigint"), F.lit(0).cast("bigint")
    low, high = (F.least(n, F.greatest(zero, _frames(F.col(c)))) for c in ("exclude_from", "exclude_to"))
    first, second = _frames(F.col("first_shift")), _frames(F.col("second_shift"))
    whole = F.col("exclude_from").isNull()
    none = F.lit(None).cast("bigint")
    piece = lambda a, b, k: F.struct(a.alias("start"), b.alias("end"), k.alias("offset"))

    def moved(a: Column, b: Column, k: Column) -> list[Column]:
        """[a, b) moved by k: silence where the source has not begun, the source, silence where it has ended."""
        begin = F.least(b, F.greatest(a, k))
        stop = F.greatest(begin, F.least(b, n + k))
        return [piece(a, begin, none), piece(begin, stop, k), piece(stop, b, none)]

    late = F.greatest(low, high)
    parts = F.when(whole, F.array(*moved(zero, n, second))).otherwise(F.array(*moved(zero, low, first), piece(low, late, none), *moved(late, n, second)))
    each = plans.select(*keys, F.explode(F.filter(parts, lambda p: p["end"] > p["start"])).alias("_p")).select(*keys, "_p.*")
    w = Window.partitionBy(*keys).orderBy("start")
    run = F.sum((~F.col("offset").eqNullSafe(F.lag("offset").over(w)) | F.lag("start").over(w).isNull()).cast("int")).over(w)
    return each.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("offset").alias("offset")).drop("_run")


def sounding(pieces: DataFrame) -> DataFrame:
    """The pieces that have a source: a map."""
    return pieces.where("offset is not null")


def invert(m: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The map from source frames to output frames. Where pieces share source frames it has one row for each."""
    return m.select(*keys, (F.col("start") - F.col("offset")).alias("start"), (F.col("end") - F.col("offset")).alias("end"), (-F.col("offset")).alias("offset"))


def compose(outer: DataFrame, inner: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """The map that looks up ``outer`` first and ``inner`` at the frame found there; frames that either does not know are gone."""
    keys = list(keys)
    reach = outer.withColumns({"_from": F.col("start") - F.col("offset"), "_to": F.col("end") - F.col("offset")})
    met = intervals.overlap_join(reach, inner, keys, width, a_span=("_from", "_to"))
    offset = F.col("a.offset")
    return met.select(*keys, (F.col("from") + offset).alias("start"), (F.col("to") + offset).alias("end"), (offset + F.col("b.offset")).alias("offset"))


def carry(spans: DataFrame, m: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """``spans`` (keys, start, end and more) of output frames on the source's clock, once for each piece of the map that they meet."""
    keys = list(keys)
    met = intervals.overlap_join(spans, m, keys, width)
    rest = [c for c in spans.columns if c not in (*keys, "start", "end")]
    return met.select(*keys, *[F.col(f"a.{c}").alias(c) for c in rest], (F.col("from") - F.col("b.offset")).alias("start"), (F.col("to") - F.col("b.offset")).alias("end"))


def source_intervals(spans: DataFrame, m: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """``spans`` with source_start and source_end where one piece of the map holds all of a span, else null (it crosses a change, or meets silence)."""
    keys = list(keys)
    met = intervals.overlap_join(spans, m, keys, width)
    held = met.where((F.col("from") == F.col("a.start")) & (F.col("to") == F.col("a.end"))).select("a.*", (F.col("a.start") - F.col("b.offset")).alias("source_start"), (F.col("a.end") - F.col("b.offset")).alias("source_end"))
    known = held.select(*keys, "start", "end", "source_start", "source_end").distinct()
    return spans.join(known, [*keys, "start", "end"], "left").select(*spans.columns, "source_start", "source_end")
