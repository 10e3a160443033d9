"""How well two speakers' timelines fit: states, the shift that removes most overlap and silence, and candidates for repair.

Activity is one row for each recording (keys) and evidence source: arrays of booleans ``a`` and ``b``, a
frame each. Lags count in frames until ``frame`` turns them into seconds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.operators import intervals
from parley.operators.sync import likelihood, weighted_median

# Limits in seconds, shares, and steps.
LONG_OVERLAP, LONG_SILENCE, CYCLE_GAP = 0.8, 1.2, 5.0
LEAST_LAG, LEAST_IMPROVEMENT = 0.4, 0.02
AGREEMENT, VARIATION = 0.8, 1.5
STEP = 0.1
MINIMUM_CHANGE, MINIMUM_SHIFT = 1.0, 0.3


def activity(spans: DataFrame, durations: DataFrame, keys: Sequence[str], frame: float, out: str) -> DataFrame:
    """``durations`` (keys, duration) with array ``out``: whether any span touches each frame."""
    on = intervals.rasterize(spans, keys, frame).groupBy(*keys).agg(F.collect_set("frame").alias("_on"))
    n = F.ceil(F.col("duration") / frame).cast("int")
    grid = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.array_contains("_on", i.cast("bigint")), F.lit(False)))).otherwise(F.array().cast("array<boolean>"))
    return durations.join(on, list(keys), "left").withColumn(out, grid).drop("_on")


def states(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, state, first, last, length) of the runs of both, a, b, neither."""
    state = F.transform(F.arrays_zip("a", "b"), lambda p: F.when(p["a"] & p["b"], "both").when(p["a"], "a").when(p["b"], "b").otherwise("neither"))
    return intervals.runs(rows.select(*keys, F.posexplode(state).alias("i", "state")), keys, "i", ["state"])


def cycles(runs: DataFrame, keys: Sequence[str], frame: float) -> DataFrame:
    """(keys, cycles): changes between long overlap and long silence, whichever is first, that follow each other closely."""
    length = F.col("length") * frame
    long = runs.where(((F.col("state") == "both") & (length >= LONG_OVERLAP - 1e-9)) | ((F.col("state") == "neither") & (length >= LONG_SILENCE - 1e-9)))
    w = Window.partitionBy(*keys).orderBy("first")
    gap = (F.col("first") - F.lag("last").over(w) - 1) * frame
    seen = long.withColumn("_c", (F.lag("state").over(w) != F.col("state")) & (gap <= CYCLE_GAP + 1e-9))
    return seen.groupBy(*keys).agg(F.count_if("_c").alias("cycles"))


def shift_counts(a: np.ndarray, b: np.ndarray, reach: int, margin: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Frames of overlap and of silence away from the margins, for ``b`` moved by -reach to reach frames (what moves in is silent)."""
    n = len(a)
    if n <= 2 * margin:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    x = np.zeros(n)
    x[margin : n - margin] = a[margin : n - margin]
    inside = np.zeros(n)
    inside[margin : n - margin] = 1
    size = 1 << (2 * n - 1).bit_length()
    fb = np.fft.rfft(b.astype(float), size).conj()
    at = lambda v: np.rint(np.fft.irfft(np.fft.rfft(v, size) * fb, size)).astype(np.int64)[np.arange(-reach, reach + 1) % size]
    both, moved = at(x), at(inside)
    width = n - 2 * margin
    return both, width - int(x.sum()) - moved + both, width


def with_best_shift(rows: DataFrame, frame: float, reach: float, margin: float, out: str = "shift") -> DataFrame:
    """``rows`` with struct ``out``: lag (seconds), improvement, overlap_reduction, silence_reduction, joint_reduction, as shares of the frames compared.

    The lag of least overlap and silence together, the smallest of equals; zeros for a recording no longer than both margins.
    """
    far, edge = round(reach / frame), round(margin / frame)

    @F.arrow_udf("struct<lag:int,improvement:double,overlap_reduction:double,silence_reduction:double>")
    def best(a: pa.Array, b: pa.Array) -> pa.Array:
        cols: list[list] = [[], [], [], []]
        for x, y in zip(a, b, strict=True):
            both, neither, n = shift_counts(np.array(x.as_py(), bool), np.array(y.as_py(), bool), far, edge)
            if not n:
                values = (0, 0.0, 0.0, 0.0)
            else:
                i = int(np.argmin(both + neither))
                cut = (both[far] - both[i]) / n, (neither[far] - neither[i]) / n
                # From whole numbers: a sum of two quotients can be off by a bit, which decides where weights are even.
                values = (i - far, max(0.0, int(both[far] + neither[far] - both[i] - neither[i]) / n), *cut)
            for c, v in zip(cols, values, strict=True):
                c.append(v)
        return pa.StructArray.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.float64()) for c in cols[1:]]], ["lag", "improvement", "overlap_reduction", "silence_reduction"])

    x = rows.withColumn("_b", best("a", "b"))
    joint = F.greatest(F.lit(0.0), F.least("_b.overlap_reduction", "_b.silence_reduction"))
    return x.withColumn(out, F.struct((F.col("_b.lag") * frame).alias("lag"), "_b.improvement", "_b.overlap_reduction", "_b.silence_reduction", joint.alias("joint_reduction"))).drop("_b")


def metrics(rows: DataFrame, keys: Sequence[str], frame: float, reach: float, margin: float) -> DataFrame:
    """Per recording and source (all in ``keys``): overlap_ratio, silence_ratio, cycles and the best shift."""
    both = F.size(F.filter(F.zip_with("a", "b", lambda p, q: p & q), lambda v: v))
    neither = F.size(F.filter(F.zip_with("a", "b", lambda p, q: ~(p | q)), lambda v: v))
    n = F.nullif(F.size("a"), F.lit(0))
    x = with_best_shift(rows, frame, reach, margin).join(cycles(states(rows, keys), keys, frame), list(keys), "left")
    return x.select(*keys, (both / n).alias("overlap_ratio"), (neither / n).alias("silence_ratio"), F.coalesce("cycles", F.lit(0)).alias("cycles"), "shift.*")


def windows(rows: DataFrame, keys: Sequence[str], frame: float, length: float, least: float, reach: float, margin: float) -> DataFrame:
    """Best shifts of consecutive windows (the last one shorter, ``least`` long at least), and whether each is meaningful."""
    size = round(length / frame)
    cut = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.greatest(F.size("a") - 1, F.lit(0)), F.lit(size))))
    part = lambda c: F.slice(c, F.col("_i") + 1, F.lit(size)).alias(c)
    some = cut.select(*keys, (F.col("_i") * frame).alias("start"), part("a"), part("b")).where(F.size("a") >= round(least / frame))
    x = with_best_shift(some, frame, reach, margin).withColumn("end", F.col("start") + F.size("a") * frame)
    return x.select(*keys, "start", "end", "shift.*", (F.col("shift.improvement") >= LEAST_IMPROVEMENT).alias("meaningful"))


def meaningful(m: DataFrame) -> Column:
    """Whether a source's metrics call for a shift."""
    return (F.abs(m["lag"]) >= LEAST_LAG) & (m["improvement"] >= LEAST_IMPROVEMENT)


def robust_shift(of_sources: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, shift): the lower median of the sources' lags, weighed by what each improves; over meaningful sources only."""
    real = of_sources.where(meaningful(of_sources))
    weighed = real.withColumn("_w", F.greatest(F.lit(0.001), F.col("improvement") + 2.0 * F.col("joint_reduction")))
    return weighted_median(weighed, list(keys), "lag", "_w", "shift")


def patterns(of_sources: DataFrame, of_windows: DataFrame, keys: Sequence[str], source: str = "source") -> DataFrame:
    """Per recording: pattern (variable, constant, uncertain) and spreads of its lags.

    Variable if the meaningful windows of two sources or more each spread widely; constant if two
    meaningful sources or more agree. ``source_spread`` is over all sources, ``window_spread`` the widest of one source's windows.
    """
    spread = lambda c: F.max(c) - F.min(c)
    real = F.when(meaningful(of_sources), F.col("lag"))
    per = of_sources.groupBy(*keys).agg(F.count(real).alias("_n"), spread(real).alias("_s"), spread("lag").alias("source_spread"))
    one = of_windows.where("meaningful").groupBy(*keys, source).agg(spread("lag").alias("_s"))
    wide = one.groupBy(*keys).agg(F.count_if(F.col("_s") >= VARIATION - 1e-9).alias("_wide"), F.max("_s").alias("window_spread"))
    x = per.join(wide, list(keys), "left")
    agree = (F.col("_n") >= 2) & (F.col("_s") <= AGREEMENT + 1e-9)
    pattern = F.when(F.coalesce("_wide", F.lit(0)) >= 2, "variable").when(agree, "constant").otherwise("uncertain")
    return x.select(*keys, pattern.alias("pattern"), agree.alias("agree"), "source_spread", F.coalesce("window_spread", F.lit(0.0)).alias("window_spread"))


def candidates(of_sources: DataFrame, of_windows: DataFrame, keys: Sequence[str], source: str = "source") -> DataFrame:
    """Per recording: pattern, full and recommended shift, likelihood that it is misaligned, and confidence of the shift.

    The recommended shift is the first meaningful window's (or the first window's) where the pattern is
    variable, else the whole recording's, in steps of a tenth; without meaningful sources that is 0.
    """
    pattern = patterns(of_sources, of_windows, keys, source)
    strength = 0.5 * F.least(F.lit(1.0), F.col("improvement") / 0.20) + 0.5 * F.least(F.lit(1.0), F.col("joint_reduction") / 0.10)
    means = of_sources.groupBy(*keys).agg(*[F.avg(c).alias(f"_{c}") for c in ("overlap_ratio", "improvement", "joint_reduction", "cycles")], F.avg(strength).alias("_strength"))
    first = of_windows.groupBy(*keys).agg(F.min_by("lag", F.struct(~F.col("meaningful"), "start", source)).alias("_anchor"))
    x = pattern.join(means, list(keys)).join(robust_shift(of_sources, keys), list(keys), "left").join(first, list(keys), "left")
    full = F.coalesce("shift", F.lit(0.0))
    raw = F.when((F.col("pattern") == "variable") & F.col("_anchor").isNotNull(), F.col("_anchor")).otherwise(full)
    x = x.withColumn("full_shift", full).withColumn("recommended", F.round(F.bround(raw / STEP) * STEP, 1))
    chance = likelihood(F.col("_improvement"), F.col("_joint_reduction"), F.col("_overlap_ratio"), F.col("_cycles"), F.col("agree").cast("double"), (F.col("pattern") == "variable").cast("double"))
    near = lambda c, scale: F.exp(-c / scale)
    sure = F.col("_strength") * (0.35 + 0.65 * near(F.col("source_spread"), 1.5)) * (0.5 + 0.5 * near(F.abs(F.col("recommended") - F.col("full_shift")), 2.0)) * (0.6 + 0.4 * near(F.col("window_spread"), 4.0))
    return x.select(*keys, "pattern", "full_shift", "recommended", F.least(F.lit(1.0), chance).alias("likelihood"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)).alias("confidence"))


def anomaly(of_windows: DataFrame, keys: Sequence[str], recordings: DataFrame | None = None) -> DataFrame:
    """Per recording, from windows (keys, start, shift, confidence, persistence, reliable): kind and score of what is wrong.

    ``recordings`` (keys): those without any window are uncertain, all numbers 0; without it they are missing.

    The strongest window is the surest, its shift counted up to two seconds. Sure, lasting and reliable
    windows that spread make a temporal change; a strong shift that some neighbour shares a stable
    offset; all else is uncertain. ``reliable``: accepted, and not at the end of the lags tried.
    """
    lasting = F.when(F.col("reliable") & (F.col("persistence") >= 3) & (F.col("confidence") >= 0.65), F.col("shift"))
    size = F.abs("shift")
    top = F.max(F.struct((F.col("confidence") * F.least(F.lit(1.0), size / 2.0)).alias("rank"), size.alias("size"), (-F.col("start")).alias("_first"), "start", "shift", "confidence", "persistence"))
    x = of_windows.groupBy(*keys).agg(top.alias("_t"), F.coalesce(F.max(lasting) - F.min(lasting), F.lit(0.0)).alias("shift_range"))
    kind = F.when(F.col("shift_range") >= MINIMUM_CHANGE, "temporal_change").when((F.col("_t.persistence") >= 2) & (F.col("_t.size") >= MINIMUM_SHIFT), "stable_offset").otherwise("uncertain")
    size = F.when(kind == "temporal_change", F.col("shift_range")).otherwise(F.col("_t.size"))
    score = F.when(kind == "uncertain", F.least(F.lit(0.19), 0.19 * F.col("_t.confidence"))).otherwise(F.least(F.lit(1.0), F.col("_t.confidence") * (0.5 + 0.5 * (1 - F.exp(-size / 4.0)))))
    out = x.select(*keys, kind.alias("kind"), "shift_range", F.col("_t.start").alias("strongest"), F.col("_t.shift").alias("shift"), score.alias("score"))
    return out if recordings is None else recordings.select(*keys).distinct().join(out, list(keys), "left").fillna("uncertain", ["kind"]).fillna(0.0, ["shift_range", "strongest", "shift", "score"])
