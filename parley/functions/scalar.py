"""Scores, ratios and other column expressions. Nothing here needs a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp(x: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def safe_ratio(n: Column | str, d: Column | str) -> Column:
    """n / d, 0 where d is not positive."""
    return F.when(col(d) > 0, col(n).cast("double") / col(d)).otherwise(F.lit(0.0))


def per_hour(count: Column | str, seconds: Column | str) -> Column:
    return safe_ratio(col(count) * 3600.0, seconds)


def score_between(x: Column | str, low: float, high: float) -> Column:
    """0 at ``low``, 1 at ``high``, linear between."""
    return clamp((col(x) - low) / (high - low))


def penalty_above(x: Column | str, allowed: float, rejected: float) -> Column:
    """1 up to ``allowed``, 0 from ``rejected`` on."""
    return F.when(col(x) <= allowed, F.lit(1.0)).otherwise(1.0 - score_between(x, allowed, rejected))


def trapezoid(x: Column | str, low: float, ideal_low: float, ideal_high: float, high: float) -> Column:
    x = col(x)
    rising, falling = (x - low) / (ideal_low - low), (high - x) / (high - ideal_high)
    return F.when((x <= low) | (x >= high), 0.0).when(x < ideal_low, rising).when(x > ideal_high, falling).otherwise(F.lit(1.0))


def smoothstep(low: float, high: float, x: Column | str) -> Column:
    t = clamp((col(x) - low) / (high - low))
    return t * t * (3.0 - 2.0 * t)


def binary_entropy(p: Column | str) -> Column:
    p = col(p)
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))


def weighted_ratio(first: Column | str, n1: Column | str, second: Column | str, n2: Column | str) -> Column:
    """Count-weighted mean, 0 without counts."""
    return safe_ratio(col(first) * col(n1) + col(second) * col(n2), col(n1) + col(n2))


def weighted_mean(terms: list[tuple[Column, float]]) -> Column:
    """Mean of the terms that are not null, by weight."""
    total = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in terms), F.lit(0.0))
    return safe_ratio(sum((F.coalesce(x, F.lit(0.0)) * w for x, w in terms), F.lit(0.0)), total)


def leakage_score(db: Column | str) -> Column:
    """1 up to -30 dB (and for no measurement), 0 from -12 dB on."""
    return F.when(col(db).isNull(), 1.0).otherwise(1.0 - score_between(db, -30.0, -12.0))


def power_db(power: Column | str) -> Column:
    return 10.0 * F.log10(F.greatest(col(power), F.lit(1e-12)))


def rms_db(rms: Column | str) -> Column:
    return (20.0 * F.log10(F.greatest(col(rms), F.lit(1e-8)))).cast("float")


def active_rms_dbfs(rms_dbfs: Column | str, speech_ratio: Column | str) -> Column:
    """Level while speaking, from the whole track's level and how much of it is speech."""
    return col(rms_dbfs) - 10.0 * F.log10(clamp(speech_ratio, 0.01, 1.0))


def gain_for(active_dbfs: Column | str, target: float = -20.0) -> Column:
    return clamp(F.pow(F.lit(10.0), (target - col(active_dbfs)) / 20.0), 0.1, 12.0)


def flags(*rules: tuple[Column, str]) -> Column:
    """Names of the rules that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in rules]))


def clip_window(start: Column, end: Column, duration: Column, length: float) -> tuple[Column, Column]:
    """A window of ``length`` centred on [start, end), moved into [0, duration)."""
    first = F.greatest(F.lit(0.0), F.least((start + end) / 2 - length / 2, duration - length))
    return first, F.least(duration, first + length)


def seconds_frame_range(start: Column, end: Column, frames: Column, frame: float) -> tuple[Column, Column]:
    """Frames [a, b) that a span touches: at least one, within the track."""
    a = F.least(F.greatest(F.floor(start / frame), F.lit(0)), frames)
    b = F.least(F.greatest(F.ceil(end / frame), a + 1), frames)
    return a, b


def hash_bucket(key: Column | str, n: int) -> Column:
    """First two bytes of SHA-256 as a number, modulo ``n``."""
    return (F.conv(F.substring(F.sha2(col(key).cast("string"), 256), 1, 4), 16, 10).cast("int") % n).cast("int")


def hash_seed(seed: str, key: Column | str) -> Column:
    """First eight bytes of SHA-256 of seed and key, as a decimal string."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), col(key).cast("string")), 256), 1, 16), 16, 10)


def hash_order(seed: str, *keys: Column | str) -> Column:
    """A repeatable random order."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *[col(k).cast("string") for k in keys]), 256)


def round_index_percentile(values: Column, p: float) -> Column:
    """The value at the rounded index (halves to even) of the sorted array; 0 for an empty one."""
    at = F.bround((F.size(values) - 1) * F.lit(p)).cast("int")
    return F.when(F.size(values) > 0, F.get(F.array_sort(values), at)).otherwise(F.lit(0.0))


def masked(value: Column, valid: Column) -> Column:
    return F.when(valid, value).otherwise(F.lit(-1.0))


def nearest_rank(x: Column | str, p: float) -> Column:
    """Aggregate: the value of rank ceil(p * n), 1 at least, among those that are not null; null without any."""
    values = F.array_sort(F.collect_list(col(x)))
    rank = F.greatest(F.ceil(F.lit(p) * F.size(values)), F.lit(1)).cast("int")
    return F.get(values, rank - 1)
