"""Lag between two speakers' activity, its drift, and the evaluation of estimators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shifted(df: DataFrame, keys: Sequence[str], order: str, mask: str, lag: int, out: str = "shifted") -> DataFrame:
    """A mask moved by ``lag`` frames, false where nothing moves in."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(out, F.lag(mask, lag, False).over(w) if lag >= 0 else F.lead(mask, -lag, False).over(w))


def lag_loss(frames: DataFrame, keys: Sequence[str], a: str, b: str, order: str, lags: Sequence[int], margin: int) -> DataFrame:
    """(keys, lag, loss): frames, away from the margins, where both or neither is active with ``b`` moved by each lag."""
    lagged = frames.select(*keys, F.explode(F.array(*[F.lit(x) for x in lags])).alias("lag"), (F.col(order) + F.col("lag")).alias(order), b)
    limits = frames.groupBy(*keys).agg(F.min(order).alias("_low"), F.max(order).alias("_high"))
    inner = frames.select(*keys, order, a).join(limits, list(keys)).where((F.col(order) >= F.col("_low") + margin) & (F.col(order) <= F.col("_high") - margin))
    both = inner.join(lagged, [*keys, order])
    return both.groupBy(*keys, "lag").agg(F.sum(F.when(F.col(a) == F.col(b), 1).otherwise(0)).alias("loss"))


def best_lag(losses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, lag, loss) of the least loss; of equals the smallest lag."""
    return losses.groupBy(*keys).agg(F.min(F.struct("loss", "lag")).alias("_m")).select(*keys, "_m.lag", "_m.loss")


def lag_curve(a: np.ndarray, b: np.ndarray, reach: int, margin: int, overlap_weight: float = 1.5) -> tuple[np.ndarray, np.ndarray]:
    """Lags and the loss at each: weighted overlap plus silence, as shares of the frames compared. By FFT."""
    n = min(len(a), len(b))
    lags = np.arange(-reach, reach + 1)
    if n <= 2 * margin:
        return lags, np.ones(len(lags))
    inner = np.zeros(n)
    inner[margin : n - margin] = 1
    x, y = a[:n].astype(float) * inner, b[:n].astype(float)
    size = 1 << (2 * n - 1).bit_length()

    def matches(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        full = np.fft.irfft(np.fft.rfft(p, size) * np.conj(np.fft.rfft(q, size)), size)
        return full[lags % size]

    quiet_x, quiet_y = inner * (1 - a[:n]), 1 - y
    count = inner.sum()
    return lags, (overlap_weight * matches(x, y) + matches(quiet_x, quiet_y)) / count


def stable_lag(lags: np.ndarray, loss: np.ndarray, radius: int, exclusion: int, tolerance: float = 5e-4) -> dict:
    """Least loss after centred smoothing, its margin over lags further away, and the width of its basin."""
    kernel = np.ones(2 * radius + 1)
    smooth = np.convolve(loss, kernel, "same") / np.convolve(np.ones(len(loss)), kernel, "same")
    at = int(np.argmin(smooth))
    far = np.abs(lags - lags[at]) > exclusion
    low = high = at
    while low > 0 and smooth[low - 1] <= smooth[at] + tolerance:
        low -= 1
    while high < len(smooth) - 1 and smooth[high + 1] <= smooth[at] + tolerance:
        high += 1
    return {"lag": int(lags[at]), "loss": float(smooth[at]), "margin": float(smooth[far].min() - smooth[at]) if far.any() else 0.0, "basin": int(high - low + 1), "zero_loss": float(smooth[np.argmin(np.abs(lags))])}


def with_stable_lag(df: DataFrame, a: str, b: str, frame: float = 0.03, reach: float = 12.0, margin: float = 12.0, radius: float = 0.15, exclusion: float = 0.5, out: str = "estimate") -> DataFrame:
    """``df`` with the stable offset (in seconds) of two arrays of booleans; one row's arrays at a time."""
    f = lambda s: int(round(s / frame))

    @F.arrow_udf("struct<lag:int,loss:double,margin:double,basin:int,zero_loss:double>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        rows = [stable_lag(*lag_curve(np.array(p or [], bool), np.array(q or [], bool), f(reach), f(margin)), f(radius), f(exclusion)) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)]
        return pa.array(rows, pa.struct([("lag", pa.int32()), ("loss", pa.float64()), ("margin", pa.float64()), ("basin", pa.int32()), ("zero_loss", pa.float64())]))

    e = F.col("_e")
    accepted = (e["zero_loss"] - e["loss"] >= 0.002) & (e["margin"] >= 1e-4)
    return df.withColumn("_e", run(a, b)).withColumn(out, F.struct((e["lag"] * frame).alias("shift"), e["loss"].alias("loss"), (e["zero_loss"] - e["loss"]).alias("improvement"), e["margin"].alias("margin"), e["basin"].alias("basin"), accepted.alias("accepted"))).drop("_e")


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str, out: str = "weighted_median") -> DataFrame:
    """The first value at which the weights so far are at least half of all."""
    w = Window.partitionBy(*keys).orderBy(value)
    cum = df.withColumn("_cum", F.sum(weight).over(w)).withColumn("_all", F.sum(weight).over(Window.partitionBy(*keys)))
    return cum.where(F.col("_cum") * 2 >= F.col("_all")).groupBy(*keys).agg(F.min(value).alias(out))


def tumbling(df: DataFrame, at: str, width: float, out: str = "window") -> DataFrame:
    return df.withColumn(out, F.floor(F.col(at) / width))


def sliding(low: Column, high: Column, width: float, hop: float) -> Column:
    """Starts of windows of full length within [low, high)."""
    n = F.floor((high - low - width) / hop)
    return F.when(high - low >= width, F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(n, F.lit(0)).cast("bigint")), lambda i: low + i * hop)).otherwise(F.array().cast("array<double>"))


def drift(windows: DataFrame, keys: Sequence[str], at: str, shift: str) -> DataFrame:
    """Per key: number of windows, range of shifts, fitted slope and intercept, median residual and kind of drift."""
    fit = windows.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(shift) - F.min(shift)).alias("shift_range"), F.regr_slope(shift, at).alias("slope"), F.regr_intercept(shift, at).alias("intercept"), (F.max(at) - F.min(at)).alias("time_span"))
    res = windows.join(fit, list(keys)).groupBy(*keys).agg(F.percentile(F.abs(F.col(shift) - F.col("slope") * F.col(at) - F.col("intercept")), 0.5).alias("median_residual"))
    # Four windows and a range of 1.5 s; 1.0 s over the span with residuals up to 0.6 s is clock drift.
    clock = (F.abs(F.col("slope") * F.col("time_span")) >= 1.0) & (F.col("median_residual") <= 0.6)
    kind = F.when((F.col("n") < 4) | (F.col("shift_range") < 1.5), "none").when(clock, "clock_drift").otherwise("structural_disagreement")
    return fit.join(res, list(keys)).withColumn("kind", kind)


def offset_errors(df: DataFrame, keys: Sequence[str], error: str) -> DataFrame:
    """n, mean, median, root mean square and largest absolute error, shares within 0.05, 0.1, 0.2, 0.5."""
    a = F.abs(F.col(error))
    return df.groupBy(*keys).agg(F.count(error).alias("n"), F.avg(a).alias("mae"), F.percentile(a, 0.5).alias("median"), F.sqrt(F.avg(F.col(error) * F.col(error))).alias("rmse"), F.max(a).alias("largest"), *[F.avg((a <= x).cast("double")).alias(f"within_{int(x * 1000)}ms") for x in (0.05, 0.1, 0.2, 0.5)])


def folds(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """Fold of each row: round robin within a stratum in hash order."""
    w = Window.partitionBy(stratum).orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256), key)
    return df.withColumn("fold", ((F.row_number().over(w) - 1) % n).cast("int"))


def grid_select(examples: DataFrame, grid: Sequence[dict], error: Column, fold: str = "fold") -> DataFrame:
    """Per fold the configuration of least mean error over the other folds, and its mean error on the fold itself.

    Sums are made per (fold, configuration) in one pass; "all other folds" is the total less the fold.
    """
    spark = examples.sparkSession
    configs = spark.createDataFrame(grid)
    trial = examples.crossJoin(F.broadcast(configs)).withColumn("_e", error)  # the grid is a fixed list
    per = trial.groupBy(fold, *configs.columns).agg(F.sum("_e").alias("_sum"), F.count("_e").alias("_n"))
    every = Window.partitionBy(*configs.columns)
    rest = per.withColumn("train_error", (F.sum("_sum").over(every) - F.col("_sum")) / (F.sum("_n").over(every) - F.col("_n"))).withColumn("test_error", F.col("_sum") / F.col("_n"))
    best = rest.groupBy(fold).agg(F.min(F.struct("train_error", *configs.columns, "test_error")).alias("_b"))
    return best.select(fold, *[f"_b.{c}" for c in ("train_error", *configs.columns, "test_error")])


def persistence(windows: DataFrame, keys: Sequence[str], at: str, shift: str, hop: float, tolerance: float = 0.8) -> DataFrame:
    """Windows with how many others within two hops agree on the shift (itself included)."""
    w = windows.withColumn("_id", F.struct(*keys, at))
    b = w.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.floor(F.col(at) / (2 * hop)).alias("_bb"), F.col(at).alias("_bt"), F.col(shift).alias("_bs"))
    dealt = w.withColumn("_bucket", F.explode(F.expr(f"sequence(floor({at} / {2 * hop!r}D) - 1, floor({at} / {2 * hop!r}D) + 1)")))
    same = (F.col("_bucket") == F.col("_bb")) & (F.abs(F.col(at) - F.col("_bt")) <= 2 * hop) & (F.abs(F.col(shift) - F.col("_bs")) <= tolerance)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_b_{k}"))
    n = dealt.join(b, same).groupBy("_id").agg(F.count("*").alias("persistence"))
    return w.join(n, "_id").drop("_id")


def audit_confidence(improvement: Column, margin: Column, persistence_: Column, agreeing: Column) -> Column:
    # Fixed weights.
    one = F.lit(1.0)
    return 0.30 * F.sqrt(F.least(one, improvement / 0.01) * F.least(one, margin / 0.002)) + 0.35 * F.least(one, (persistence_ - 1) / 2) + 0.35 * agreeing / 2


def likelihood(improvement: Column, joint: Column, overlap: Column, cycles: Column, agree: Column, variable: Column) -> Column:
    # Fixed weights.
    return 1 - F.exp(-(4 * improvement + 8 * joint + 1.5 * overlap + 0.025 * cycles + 0.15 * agree + 0.10 * variable) / 1.2)


def shift_words(words: DataFrame, shift: Column, duration: Column) -> DataFrame:
    """Words moved by ``shift``, cut to [0, duration]; what is left empty vanishes."""
    zero = F.lit(0.0)
    moved = words.withColumns({"start": F.greatest(F.col("start") + shift, zero), "end": F.least(F.col("end") + shift, duration)})
    return moved.where(F.col("end") > F.col("start"))


def repair_words(words: DataFrame, change: Column, before: Column, after: Column) -> DataFrame:
    """Words moved by one shift before the change and another after it; words across it vanish."""
    late = F.col("start") >= change
    kept = words.where((F.col("end") <= change) | late)
    s = F.when(late, after).otherwise(before)
    return kept.withColumns({"start": F.col("start") + s, "end": F.col("end") + s})
