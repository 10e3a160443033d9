"""Frame tables and arrays of samples: energy, voice activity, correlation, waveforms, labels per frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions.scalar import rms_db
from parley.operators import intervals


def frame_rms(df: DataFrame, keys: Sequence[str], samples: str, size: int, padded: bool = True) -> DataFrame:
    """(keys, frame, rms) of an array of samples; the last frame counts its missing samples as zeros if ``padded``."""
    n = F.ceil(F.size(samples) / F.lit(float(size))).cast("int")
    frames = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(F.col(samples), i * size + 1, F.lit(size)))
    rows = df.where(F.size(samples) > 0).select(*keys, F.posexplode(frames).alias("frame", "_x"))
    total = F.aggregate("_x", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.select(*keys, "frame", F.sqrt(total / (F.lit(float(size)) if padded else F.size("_x"))).alias("rms"))


def speech_mask(frames: DataFrame, keys: Sequence[str], rise: float = 12.0, floor: float = -50.0) -> DataFrame:
    """Frames with db and mask: at least ``rise`` above the track's 20th percentile, and ``floor`` at least."""
    db = frames.withColumn("db", rms_db("rms"))
    low = db.groupBy(*keys).agg(F.percentile("db", 0.2).alias("_p20"))
    return db.join(low, list(keys)).withColumn("mask", F.col("db") >= F.greatest(F.col("_p20") + rise, F.lit(floor))).drop("_p20")


def adaptive_mask(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mask by max(3 p20, 0.08 p90, 1), percentiles at the rounded index of the sorted energies."""
    at = lambda p: F.bround((F.col("_n") - 1) * p).cast("int") + 1
    w = Window.partitionBy(*keys).orderBy("rms")
    ranked = frames.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    cut = ranked.groupBy(*keys).agg(F.greatest(3 * F.max(F.when(F.col("_r") == at(0.2), F.col("rms"))), 0.08 * F.max(F.when(F.col("_r") == at(0.9), F.col("rms"))), F.lit(1.0)).alias("_cut"))
    return frames.join(cut, list(keys)).withColumn("mask", F.col("rms") >= F.col("_cut")).drop("_cut")


def baseline_db(masked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median level of active frames, else of all, else 0."""
    return masked.groupBy(*keys).agg(F.coalesce(F.percentile(F.when(F.col("mask"), F.col("db")), 0.5), F.percentile("db", 0.5), F.lit(0.0)).alias("baseline"))


def suppress_dominated(masked: DataFrame, keys: Sequence[str], dominance: float = 6.0, limit: float = 3.0) -> DataFrame:
    """Where both sides are active, drop the one that is ``dominance`` dB under the other, after a bounded baseline correction."""
    both = masked.join(baseline_db(masked, [*keys, "side"]), [*keys, "side"])
    pair = both.groupBy(*keys, "frame").agg(*[F.max(F.when(F.col("side") == n, F.struct("mask", "db", "baseline"))).alias(f"s{n}") for n in (1, 2)])
    shift = F.least(F.greatest(F.col("s1.baseline") - F.col("s2.baseline"), F.lit(-limit)), F.lit(limit))
    ahead = F.col("s1.db") - F.col("s2.db") - shift
    shared = F.coalesce(F.col("s1.mask") & F.col("s2.mask"), F.lit(False))
    one = F.coalesce(F.col("s1.mask"), F.lit(False)) & ~(shared & (ahead <= -dominance))
    two = F.coalesce(F.col("s2.mask"), F.lit(False)) & ~(shared & (ahead >= dominance))
    sides = F.array(F.struct(F.lit(1).alias("side"), one.alias("mask")), F.struct(F.lit(2).alias("side"), two.alias("mask")))
    return pair.select(*keys, "frame", F.explode(sides).alias("x")).select(*keys, "x.side", "frame", "x.mask")


def speech_segments(masked: DataFrame, keys: Sequence[str], frame: float = 0.03, minimum: float = 0.12, gap: float = 0.25, width: float = 60.0) -> DataFrame:
    """Spans (keys, side, start, end) of both sides' masks: short ones dropped, close ones merged unless the other side is active between."""
    own = suppress_dominated(masked, keys)
    spans = intervals.mask_segments(own, [*keys, "side"], frame, minimum=minimum)
    sides = [spans.where(F.col("side") == n).drop("side") for n in (1, 2)]
    out = [intervals.merge_unless_blocked(sides[n], sides[1 - n], keys, gap, width).withColumn("side", F.lit(n + 1)) for n in (0, 1)]
    return out[0].unionByName(out[1]).select(*keys, "side", "start", "end")


def correlation(df: DataFrame, a: str, b: str, out: str = "correlation") -> DataFrame:
    """Pearson correlation of two arrays, over their shared length; null for fewer than two samples or a constant."""
    n = F.least(F.size(a), F.size(b))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("x", "y", "xx", "yy", "xy")])
    sums = F.aggregate(F.zip_with(F.slice(F.col(a), 1, n), F.slice(F.col(b), 1, n), lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))), zero, lambda s, p: F.struct((s.x + p.x).alias("x"), (s.y + p.y).alias("y"), (s.xx + p.x * p.x).alias("xx"), (s.yy + p.y * p.y).alias("yy"), (s.xy + p.x * p.y).alias("xy")))
    m = df.withColumn("_n", n.cast("double")).withColumn("_s", sums)
    vx, vy = (F.greatest(F.col(f"_s.{k}{k}") / F.col("_n") - F.pow(F.col(f"_s.{k}") / F.col("_n"), 2), F.lit(0.0)) for k in "xy")
    cov = F.col("_s.xy") / F.col("_n") - F.col("_s.x") / F.col("_n") * F.col("_s.y") / F.col("_n")
    ok = (F.col("_n") >= 2) & (F.sqrt(vx) > 1e-8) & (F.sqrt(vy) > 1e-8)
    return m.withColumn(out, F.when(ok, cov / F.sqrt(vx * vy))).drop("_n", "_s")


def centered_mean(df: DataFrame, keys: Sequence[str], order: str, value: str, radius: int, out: str = "mean") -> DataFrame:
    """Moving average over ``radius`` neighbours to either side, fewer at the ends."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-radius, radius)
    return df.withColumn(out, F.avg(value).over(w))


def waveform(df: DataFrame, keys: Sequence[str], samples: str, points: int) -> DataFrame:
    """(keys, bucket, low, high): least and largest sample of at most ``points`` buckets of equal size."""
    size = F.greatest(F.ceil(F.size(samples) / F.lit(float(points))).cast("int"), F.lit(1))
    n = F.ceil(F.size(samples) / size).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(F.col(samples), i * size + 1, size))
    return df.where(F.size(samples) > 0).select(*keys, F.posexplode(parts).alias("bucket", "_x")).select(*keys, "bucket", F.array_min("_x").alias("low"), F.array_max("_x").alias("high"))


def track_statistics(df: DataFrame, keys: Sequence[str], samples: str) -> DataFrame:
    """(keys, rms, peak, clipping, near_zero) of arrays of samples; zeros for an empty one."""
    x = F.col(samples)
    n = F.greatest(F.size(x), F.lit(1))
    share = lambda f: F.size(F.filter(x, f)) / n
    rms = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")) / n)
    return df.select(*keys, rms.alias("rms"), F.coalesce(F.array_max(F.transform(x, lambda v: F.abs(v))), F.lit(0.0)).cast("double").alias("peak"), share(lambda v: F.abs(v) >= 0.999).alias("clipping"), share(lambda v: F.abs(v) <= 1e-4).alias("near_zero"))


def leakage_db(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median level of side 1's track where only side 2 speaks, less its own median where only it speaks. Frames have db, own, other."""
    return frames.groupBy(*keys).agg((F.percentile(F.when(F.col("other") & ~F.col("own"), F.col("db")), 0.5) - F.percentile(F.when(F.col("own") & ~F.col("other"), F.col("db")), 0.5)).alias("leakage_db"))


def crosstalk_words(words: DataFrame, powers: DataFrame, keys: Sequence[str], frame: float = 0.03, radius: float = 15.0, quiet: float = 12.0, dominance: float = 6.0) -> DataFrame:
    """Words (keys, start, end, ...) with ``keep``: false for one far under the level around it, or under both the other channel and that level.

    ``powers`` has (keys, frame, target, other). The level around a word is the mean power of frames
    with words within ``radius`` of it.
    """
    w = words.withColumn("_w", F.struct(*keys, "start", "end")).withColumn("_a", F.floor(F.col("start") / frame)).withColumn("_b", F.greatest(F.ceil(F.col("end") / frame), F.floor(F.col("start") / frame) + 1))
    touched = w.select("_w", *keys, F.explode(F.sequence(F.col("_a"), F.col("_b") - 1)).alias("frame"))
    level = touched.join(powers, [*keys, "frame"]).groupBy("_w").agg(F.avg("target").alias("_t"), F.avg("other").alias("_o"))
    active = powers.join(touched.select(*keys, "frame").distinct(), [*keys, "frame"], "left_semi")
    wide = w.select("_w", *keys, (F.col("start") - radius).alias("start"), (F.col("end") + radius).alias("end"))
    points = active.select(*keys, (F.col("frame") * frame).alias("start"), ((F.col("frame") + 1) * frame).alias("end"), "target")
    around = intervals.overlap_join(wide, points, keys, 2 * radius).groupBy(F.col("a._w").alias("_w")).agg(F.avg("b.target").alias("_base"))
    db = lambda c: 10 * F.log10(F.greatest(F.col(c), F.lit(1e-12)))
    out = w.join(level, "_w", "left").join(around, "_w", "left")
    outlier = db("_t") <= db("_base") - quiet
    dominated = (db("_o") - db("_t") >= dominance) & (db("_t") < db("_base"))
    return out.withColumn("keep", ~F.coalesce(outlier | dominated, F.lit(False))).select(*words.columns, "keep")


def frame_grid(windows: DataFrame, frame: float = 0.08, n: int = 250) -> DataFrame:
    """Each window's frames: frame number and midpoint time."""
    return windows.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("time", F.col("start") + (F.col("frame") + 0.5) * frame)


def future_occupancy(frames: DataFrame, spans: DataFrame, keys: Sequence[str], horizons: Sequence[tuple[float, float]], width: float, limit: Column | None = None) -> DataFrame:
    """Each frame with ``occupancy``: the share of each future horizon that spans cover; -1 where the horizon passes ``limit``."""
    n = F.array(*[F.struct(F.lit(i).alias("h"), (F.col("time") + a).alias("start"), (F.col("time") + b).alias("end")) for i, (a, b) in enumerate(horizons)])
    keyed = [*keys, "time"]
    # Frames of one time, however many, have one row.
    once = frames.select(*keyed, *([limit.alias("_limit")] if limit is not None else [])).distinct()
    long = once.withColumn("x", F.explode(n)).select(*keyed, *(["_limit"] if limit is not None else []), "x.*")
    merged = intervals.union(spans, keys)
    part = intervals.overlap_join(long.select(*keyed, "h", "start", "end").distinct(), merged, keys, width).groupBy(*keys, F.col("a.time").alias("time"), F.col("a.h").alias("h")).agg(F.sum(F.col("to") - F.col("from")).alias("_c"))
    share = F.coalesce(F.col("_c"), F.lit(0)) / (F.col("end") - F.col("start"))
    if limit is not None:
        share = F.when(F.col("end") <= F.col("_limit"), share).otherwise(F.lit(-1.0))
    return long.join(part, [*keyed, "h"], "left").withColumn("_v", share).groupBy(*keyed).agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "_v"))), lambda x: x["_v"]).alias("occupancy"))


def floor_state(frames: DataFrame, segments: DataFrame, connections: DataFrame, activity: DataFrame, keys: Sequence[str], width: float, edge: float = 0.08) -> DataFrame:
    """Frames with ``floor``: the segment's confidence, else the connection's, -1 (masked) in other activity, else 0.

    A connection's is merge * (1 - pause / 2) * the lesser confidence of the segments that end and start
    within ``edge`` of its bounds; -1 where either is missing. The first span counts where several hold.
    """
    value = lambda df, c, name: df.select(*keys, "start", "end", c.alias(name))
    point = lambda df: df.withColumn("start", F.col("time")).withColumn("end", F.col("time"))

    def at(points: DataFrame, spans: DataFrame, name: str) -> DataFrame:
        hit = intervals.overlap_join(point(points), spans, keys, width, closed=True).where("a.time < b.end")
        best = hit.groupBy(*keys, F.col("a.time").alias("time")).agg(F.min(F.struct("b.start", "b.end", f"b.{name}"))[name].alias(name))
        return points.join(best, [*keys, "time"], "left")

    def beside(bound: str, of: str) -> DataFrame:
        near = segments.select(*keys, (F.col(of) - edge).alias("start"), (F.col(of) + edge).alias("end"), F.struct("start", "end", "turn").alias("_o"))
        hit = intervals.overlap_join(point(connections.select(*keys, F.col(bound).alias("time")).distinct()), near, keys, width, closed=True)
        return hit.groupBy(*keys, F.col("a.time").alias(bound)).agg(F.min("b._o")["turn"].alias(f"_{bound}"))

    joined = connections.join(beside("start", "end"), [*keys, "start"], "left").join(beside("end", "start"), [*keys, "end"], "left")
    product = F.col("merge") * (1 - 0.5 * F.col("pause")) * F.least("_start", "_end")
    matched = F.when(F.col("_start").isNull() | F.col("_end").isNull(), -1.0).otherwise(product)
    out = at(at(at(frames, value(segments, F.col("turn"), "_s"), "_s"), value(joined, matched, "_c"), "_c"), value(activity, F.lit(1), "_a"), "_a")
    return out.withColumn("floor", F.coalesce(F.col("_s"), F.col("_c"), F.when(F.col("_a").isNotNull(), -1.0), F.lit(0.0))).drop("_s", "_c", "_a")
