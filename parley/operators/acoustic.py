"""Offset of two tracks by their sound: onsets of energy, and where the two tracks' onsets correlate best."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Seconds, decibel floor, percentiles.
FRAME, REACH, EXCLUSION = 0.05, 12.0, 0.25
FLOOR, LOW, HIGH = 1e-12, 0.05, 0.95


def onset_envelope(powers: DataFrame, keys: Sequence[str], order: str = "frame", power: str = "power", out: str = "onset") -> DataFrame:
    """``powers`` (keys, frame, mean square) with ``out``: how far the energy in decibels, cut at its 5th and 95th percentile, moves from the frame before (the first: 0)."""
    keys = list(keys)
    db = powers.withColumn("_db", 10.0 * F.log10(F.greatest(F.col(power), F.lit(FLOOR))))
    limits = db.groupBy(*keys).agg(F.percentile("_db", LOW).alias("_low"), F.percentile("_db", HIGH).alias("_high"))
    cut = db.join(limits, keys).withColumn("_cut", F.greatest("_low", F.least("_high", "_db")))
    step = F.abs(F.col("_cut") - F.lag("_cut").over(Window.partitionBy(*keys).orderBy(order)))
    return cut.withColumn(out, F.coalesce(step, F.lit(0.0))).drop("_db", "_low", "_high", "_cut")


def lag_correlations(a: np.ndarray, b: np.ndarray, reach: int) -> np.ndarray:
    """Mean product of the standardized series for ``b`` moved by -reach to reach frames, over the frames that both have."""
    n = min(len(a), len(b))
    x, y = (np.asarray(v[:n], float) for v in (a, b))
    x, y = ((v - v.mean()) / v.std() for v in (x, y))
    size = 1 << (2 * n - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(y, size).conj(), size)
    lags = np.arange(-reach, reach + 1)
    return full[lags % size] / (n - np.abs(lags))


def with_offset(df: DataFrame, a: str, b: str, frame: float = FRAME, reach: float = REACH, out: str = "offset") -> DataFrame:
    """``df`` (arrays of onsets ``a`` and ``b``, a recording each) with struct ``out``: shift (seconds to move b by), peak, margin; null if too short or without variation.

    The smallest lag of the highest correlation; ``margin`` is its lead over the best lag that is not right beside it.
    """
    far, beside = round(reach / frame), max(1, round(EXCLUSION / frame))

    @F.arrow_udf("struct<shift:double,peak:double,margin:double>")
    def best(x: pa.Array, y: pa.Array) -> pa.Array:
        found = []
        for p, q in zip(x, y, strict=True):
            if not p.is_valid or not q.is_valid or min(len(p), len(q)) <= 2 * far:
                found.append(None)
                continue
            u, v = (np.array(z.as_py(), float) for z in (p, q))
            n = min(len(u), len(v))
            if u[:n].std() == 0 or v[:n].std() == 0:
                found.append(None)
                continue
            c = np.round(lag_correlations(u, v, far), 12)
            top = int(c.argmax())
            others = c[np.abs(np.arange(len(c)) - top) > beside]
            found.append({"shift": (top - far) * frame, "peak": float(c[top]), "margin": float(c[top] - others.max())})
        return pa.array(found, pa.struct([("shift", pa.float64()), ("peak", pa.float64()), ("margin", pa.float64())]))

    return df.withColumn(out, best(a, b))
