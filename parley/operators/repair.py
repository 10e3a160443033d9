"""Timeline repair: one speaker's track moved, by one shift or by one before and another after a change; what lies in the excluded window is lost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators import intervals


@dataclass(frozen=True)
class Repair:
    """Shift of track 2 before and after ``change`` (the same if there is none), and the excluded window around it."""

    before: float
    after: float | None = None
    change: float | None = None
    exclude_from: float | None = None
    exclude_to: float | None = None

    @property
    def late(self) -> float:
        return self.before if self.after is None else self.after

    @property
    def boundary(self) -> float | None:
        """The change on the source's own clock."""
        return None if self.change is None else self.change - (self.before + self.late) / 2


def transition_window(change: Column, duration: Column, manual: Column) -> tuple[Column, Column]:
    """Excluded window around a change: 10 s to either side if a person set it, else 60 s; within the recording."""
    reach = F.when(manual, 10.0).otherwise(60.0)
    return F.greatest(F.lit(0.0), change - reach), F.least(duration, change + reach)


def segments(df: DataFrame, repair: Repair, track: str = "track") -> DataFrame:
    """Spans (track, start, end) on the repaired clock; a span across the boundary becomes two."""
    moved = F.col(track) == 2
    if repair.change is None:
        s = F.when(moved, repair.before).otherwise(0.0)
        return df.withColumns({"start": F.col("start") + s, "end": F.col("end") + s})
    b = F.lit(repair.boundary)
    part = lambda a, z, s: F.when(z > a, F.struct((a + s).alias("start"), (z + s).alias("end")))
    pieces = F.when(moved, F.array_compact(F.array(part(F.col("start"), F.least("end", b), F.lit(repair.before)), part(F.greatest("start", b), F.col("end"), F.lit(repair.late))))).otherwise(F.array(F.struct(F.col("start").alias("start"), F.col("end").alias("end"))))
    rest = [c for c in df.columns if c not in ("start", "end")]
    return df.select(*rest, F.explode(pieces).alias("_p")).select(*rest, "_p.start", "_p.end").select(*df.columns)


def words(df: DataFrame, repair: Repair, duration: float, track: str = "track") -> DataFrame:
    """Words on the repaired clock, cut to the recording; those across the boundary or in the excluded window vanish."""
    moved = F.col(track) == 2
    kept = df
    s = F.lit(repair.before)
    if repair.change is not None:
        b = repair.boundary
        kept = kept.where(~moved | (F.col("end") <= b) | (F.col("start") >= b))
        s = F.when(F.col("start") >= b, repair.late).otherwise(repair.before)
    s = F.when(moved, s).otherwise(0.0)
    out = kept.withColumns({"start": F.greatest(F.col("start") + s, F.lit(0.0)), "end": F.least(F.col("end") + s, F.lit(duration))}).where(F.col("end") > F.col("start"))
    return out if repair.exclude_from is None else out.where(~excluded(F.col("start"), F.col("end"), repair))


def excluded(start: Column, end: Column, repair: Repair) -> Column:
    """Whether a span shares more than a point with the excluded window."""
    if repair.exclude_from is None:
        return F.lit(False)
    return (start < repair.exclude_to) & (end > repair.exclude_from)


def source_interval(start: Column, end: Column, repair: Repair) -> Column:
    """struct start, end of a repaired interval on track 2's own clock; null where it meets the excluded window or crosses the change."""
    if repair.change is None:
        return F.struct((start - repair.before).alias("start"), (end - repair.before).alias("end"))
    s = F.when(end <= repair.change, repair.before).when(start >= repair.change, repair.late)
    return F.when(s.isNotNull() & ~excluded(start, end, repair), F.struct((start - s).alias("start"), (end - s).alias("end")))


def available(duration: float, repair: Repair) -> list[tuple[float, float]]:
    """Parts of the repaired clock for which both tracks have sound."""
    whole = (max(0.0, repair.before), min(duration, duration + repair.late))
    if repair.exclude_from is None:
        return [whole] if whole[1] > whole[0] else []
    return [(a, b) for a, b in ((whole[0], min(whole[1], repair.exclude_from)), (max(whole[0], repair.exclude_to), whole[1])) if b > a]


def copy_plan(n_frames: int, rate: int, repair: Repair) -> list[tuple[int, int, int | None]]:
    """(first, end, source) frames of the repaired track 2: copied from ``source`` on, or silence where it is None."""
    edges = [(0, n_frames, repair.before)] if repair.change is None else [(0, round(repair.exclude_from * rate), repair.before), (round(repair.exclude_from * rate), round(repair.exclude_to * rate), None), (round(repair.exclude_to * rate), n_frames, repair.late)]
    out: list[tuple[int, int, int | None]] = []
    for a, b, s in edges:
        a, b = max(0, a), min(n_frames, b)
        if b <= a:
            continue
        if s is None:
            parts = [(a, b, None)]
        else:
            k = round(s * rate)
            low, high = min(max(a, k), b), max(min(b, n_frames + k), a)
            parts = [(a, low, None), (low, high, low - k), (max(low, high), b, None)]
        for p in (p for p in parts if p[1] > p[0]):
            last = out[-1] if out else None
            joined = last and last[1] == p[0] and ((last[2] is None and p[2] is None) or (None not in (last[2], p[2]) and last[2] + last[1] - last[0] == p[2]))
            if joined:
                out[-1] = (last[0], p[1], last[2])
            else:
                out.append(p)
    return out


def masked_seconds(windows: DataFrame, regions: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Windows with seconds under regions, and the sorted reasons of those."""
    own = windows.withColumn("_id", F.struct(*keys, "start", "end"))
    met = intervals.overlap_join(own, regions, keys, width)
    per = met.groupBy(F.col("a._id").alias("_id")).agg(F.sum(F.col("to") - F.col("from")).alias("masked"), F.array_sort(F.collect_set("b.reason")).alias("reasons"))
    return own.join(per, "_id", "left").drop("_id").withColumn("masked", F.coalesce("masked", F.lit(0.0))).withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))
