"""The offset of two tracks from evidence, and which of many configurations of the estimator errs least on recordings it has not seen.

Evidence is one row for each recording: ``full`` (of the whole recording, or of its beginning),
arrays of structs ``sources`` (source, shift, improvement, joint) and ``windows`` (source, start,
shift, improvement, joint). The estimator is one column expression over evidence and
configuration. To choose among many, :func:`errors` scores them all in one pass over arrays (numpy,
in Arrow batches; see :func:`grid_predictions`), and folds are chosen from sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Seconds; the source that whole recordings leave out; the grid.
STEP, SPREAD, NEAR = 0.1, 1.5, 0.1
LEAST_WEIGHT = 0.001
#: Cells of arrays that are held at once.
CELLS = 1 << 20
ANNOTATION = "conversation_annotation"
CONFIGURATION = ("least_lag", "least_improvement", "least_joint", "least_sources", "fallback")
GRID = [dict(zip(CONFIGURATION, c, strict=True)) for c in product((0.4, 0.8, 1.2), (0.02, 0.03, 0.05), (0.0, 0.008, 0.015), (1, 2), ("all_sources", "zero_shift"))]


def lower_weighted_median(sources: Column) -> Column:
    """The shift at which half of the weight is reached, in order of shift and weight; null without sources."""
    weighed = F.array_sort(F.transform(sources, lambda s: F.struct(s["shift"].alias("shift"), F.greatest(F.lit(LEAST_WEIGHT), s["improvement"] + 2.0 * s["joint"]).alias("w"))))
    half = F.aggregate(weighed, F.lit(0.0), lambda a, s: a + s["w"]) / 2.0
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("shift"))
    found = F.aggregate(weighed, start, lambda a, s: F.struct((a["sum"] + s["w"]).alias("sum"), F.when(a["shift"].isNotNull(), a["shift"]).when(a["sum"] + s["w"] >= half, s["shift"]).alias("shift")))
    return F.coalesce(found["shift"], F.element_at(weighed, -1)["shift"])


def strongest(windows: Column) -> Column:
    """A recording's windows, in order of start, of the source that improves most in sum (of equals the one whose name is last)."""
    gain = lambda w: w["improvement"] + 2.0 * w["joint"]
    of = lambda source: F.filter(windows, lambda w: w["source"].eqNullSafe(source))
    add = lambda a, v: F.when(v.isNull(), a).otherwise(F.coalesce(a, F.lit(0.0)) + v)
    names = F.array_distinct(F.transform(windows, lambda w: w["source"]))
    best = F.array_max(F.transform(names, lambda n: F.struct(F.aggregate(of(n), F.lit(None).cast("double"), lambda a, w: add(a, gain(w))).alias("total"), n.alias("source"))))
    # Within an array of one the best source is found once, not for each window.
    fields = ("start", "shift", "improvement", "joint")
    return F.get(F.transform(F.array(best), lambda b: F.array_sort(F.transform(of(b["source"]), lambda w: F.struct(*[w[c].alias(c) for c in fields])))), 0)


def strongest_series(evidence: DataFrame, key: str) -> DataFrame:
    """(key, series) of every recording, see :func:`strongest`."""
    return evidence.select(key, strongest(F.col("windows")).alias("series"))


def predicted(c: dict[str, Column]) -> Column:
    """The shift that configuration ``c`` predicts from columns full, sources and series (see :func:`strongest`), in tenths.

    Sources count if their shift, improvement and joint reduction are large enough. With too few of
    them the prediction is 0 or of all sources, as the fallback has it. A whole recording whose
    strongest windows spread widely takes its first one's shift, any other the weighted median.
    """
    static = F.when(F.col("full"), F.filter("sources", lambda s: s["source"] != ANNOTATION)).otherwise(F.col("sources"))
    large = lambda s: (s["improvement"] >= c["least_improvement"]) & (s["joint"] >= c["least_joint"])
    real = F.filter(static, lambda s: (F.abs(s["shift"]) >= c["least_lag"]) & large(s))
    few = F.size(real) < c["least_sources"]
    used = F.when(few, static).otherwise(real)
    series = F.coalesce(F.col("series"), F.array().cast("array<struct<start:double,shift:double,improvement:double,joint:double>>"))
    moving = F.transform(F.filter(series, large), lambda s: s["shift"])
    variable = F.col("full") & (F.size(moving) >= 2) & (F.array_max(moving) - F.array_min(moving) >= SPREAD)
    raw = F.when(variable, F.get(series, 0)["shift"]).otherwise(lower_weighted_median(used))
    shift = F.round(F.bround(raw / STEP) * STEP, 1)
    return F.when(few & (c["fallback"] == "zero_shift"), 0.0).when(F.size(used) == 0, 0.0).otherwise(shift)


def predict(evidence: DataFrame, key: str, configuration: dict) -> DataFrame:
    """(key, prediction) of every recording by one configuration."""
    x = evidence.withColumn("series", strongest(F.col("windows")))
    return x.select(key, predicted({n: F.lit(v) for n, v in configuration.items()}).alias("prediction"))


def _at_least(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    """a >= b as Spark has it: NaN is the largest number."""
    return np.isnan(a) | (a >= b)


def _table(column: pa.ListArray, fields: Sequence[str]) -> tuple[np.ndarray, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Lists of structs as arrays of rows by places: which places are filled, and of each field (values, whether known)."""
    column = column if column.null_count == 0 else pa.ListArray.from_arrays(*_without_nulls(column))
    n, flat = len(column), column.flatten()
    length = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    filled = np.arange(length.max(initial=0)) < length[:, None]
    out = {}
    for f in fields:
        child = flat.field(f) if flat.null_count == 0 else pc.struct_field(flat, f)
        known = np.zeros(filled.shape, bool)
        known[filled] = child.is_valid().to_numpy(zero_copy_only=False)
        if pa.types.is_floating(child.type):
            values = np.zeros((n, filled.shape[1]))
            values[filled] = child.fill_null(0.0).to_numpy(zero_copy_only=False)
        else:
            values = np.full(filled.shape, "", object)
            values[filled] = child.fill_null("").to_numpy(zero_copy_only=False)
        out[f] = values, known
    return filled, out


def _without_nulls(column: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    length = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), column.flatten()


def grid_predictions(full: pa.Array, sources: pa.ListArray, series: pa.ListArray, grid: Sequence[dict]) -> np.ndarray:
    """What :func:`predicted` gives for rows (down) and configurations (across); NaN where it gives null.

    Sources are sorted once; medians are made once for each three thresholds, and the spread of the windows once for each two.
    """
    filled, s = _table(sources, ("source", "shift", "improvement", "joint"))
    (shift, known), (gain, has_gain), (joint, has_joint) = s["shift"], s["improvement"], s["joint"]
    weight = np.where(has_gain & has_joint, gain + 2.0 * joint, LEAST_WEIGHT)
    weight = np.where(np.isnan(weight), weight, np.maximum(weight, LEAST_WEIGHT))
    order = np.lexsort((weight, shift, known, ~filled))
    sort = lambda a: np.take_along_axis(a, order, 1)
    named = s["source"][1] & (s["source"][0] != ANNOTATION)
    filled, named, shift, known, gain, has_gain, joint, has_joint, weight = map(sort, (filled, named, shift, known, gain, has_gain, joint, has_joint, weight))
    whole = full.fill_null(False).to_numpy(zero_copy_only=False)
    static = filled & (named | ~whole[:, None])
    rows, lost = np.arange(len(whole)), ~sources.is_valid().to_numpy(zero_copy_only=False)

    def median(used: np.ndarray) -> np.ndarray:
        if not used.shape[1]:
            return np.full(len(used), np.nan)
        sums = np.cumsum(np.where(used, weight, 0.0), 1)
        hit = used & known & _at_least(sums, sums[:, -1:] / 2.0)
        last = used.shape[1] - 1 - used[:, ::-1].argmax(1)
        at = np.where(hit.any(1), hit.argmax(1), last)
        return np.where(used.any(1) & known[rows, at], shift[rows, at], np.nan)

    there, w = _table(series, ("shift", "improvement", "joint"))
    (moved, seen), (g, has_g), (j, has_j) = w["shift"], w["improvement"], w["joint"]
    first = np.where(seen[:, 0], moved[:, 0], np.nan) if there.shape[1] else np.full(len(rows), np.nan)

    def variable(improvement: float, least_joint: float) -> np.ndarray:
        if not there.shape[1]:
            return np.zeros(len(rows), bool)
        large = there & has_g & has_j & _at_least(g, improvement) & _at_least(j, least_joint)
        some = large & seen
        top = np.where(some, np.where(np.isnan(moved), np.inf, moved), -np.inf).max(1)
        low = np.where(some, np.where(np.isnan(moved), np.inf, moved), np.inf).min(1)
        return whole & (large.sum(1) >= 2) & some.any(1) & (np.where(top == np.inf, np.inf, top - np.where(low == np.inf, 0.0, low)) >= SPREAD)

    rounded = lambda x: np.rint(x / STEP) / round(1 / STEP) + 0.0
    every, any_static, moves = median(static), static.any(1), {}
    reals: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    out = np.empty((len(rows), len(grid)))
    for n, c in enumerate(grid):
        pair, three = (c["least_improvement"], c["least_joint"]), (c["least_lag"], c["least_improvement"], c["least_joint"])
        if pair not in moves:
            moves[pair] = variable(*pair)
        if three not in reals:
            real = static & known & has_gain & has_joint & _at_least(np.abs(shift), three[0]) & _at_least(gain, three[1]) & _at_least(joint, three[2])
            reals[three] = real.sum(1), median(real)
        size, of_real = reals[three]
        few = (size < c["least_sources"]) & ~lost
        empty = np.where(few, ~any_static, size == 0) & ~lost
        x = rounded(np.where(moves[pair], first, np.where(few, every, of_real)))
        out[:, n] = np.where(empty | (few & (c["fallback"] == "zero_shift")), 0.0, x)
    return out


def errors(examples: DataFrame, grid: Sequence[dict], label: str, fold: str) -> DataFrame:
    """(fold, config, n, sum, squares, largest, near): errors of every configuration (by its place in ``grid``) on each fold of examples with ``series``."""
    grid, kind = list(grid), examples.select(fold).schema[0].dataType

    def score(batches):
        for whole in batches:
            for batch in _pieces(whole):
                found = grid_predictions(batch.column("full"), batch.column("sources"), batch.column("series"), grid)
                codes = batch.column("fold").dictionary_encode(null_encoding="encode")
                code = codes.indices.to_numpy()
                error = np.abs(found - batch.column("label").cast("float64").to_numpy(zero_copy_only=False)[:, None])
                order = np.argsort(code, kind="stable")
                present, start, n = np.unique(code[order], return_index=True, return_counts=True)
                error = error[order]
                none = np.isnan(error)
                e = np.where(none, 0.0, error)
                cut = lambda a, f=np.add: f.reduceat(a, start, 0).ravel()  # noqa: E731, B023
                known = cut((~none).astype(np.int64)) > 0
                value = lambda a: pa.array(a, pa.float64(), mask=~known)  # noqa: E731, B023
                yield pa.RecordBatch.from_pydict(
                    {
                        "fold": codes.dictionary.take(pa.array(np.repeat(present, len(grid)))),
                        "config": pa.array(np.tile(np.arange(len(grid), dtype=np.int32), len(present))),
                        "n": pa.array(np.repeat(n, len(grid)).astype(np.int64)),
                        "sum": value(cut(e)),
                        "squares": value(cut(e * e)),
                        "largest": value(cut(np.where(none, -1.0, error), np.maximum)),
                        "near": pa.array(cut((~none & (e <= NEAR)).astype(np.int64))),
                    }
                )

    x = examples.select("full", "sources", "series", F.col(label).alias("label"), F.col(fold).alias("fold"))
    per = x.mapInArrow(score, f"fold {kind.simpleString()}, config int, n bigint, sum double, squares double, largest double, near bigint")
    return per.groupBy("fold", "config").agg(*[F.sum(c).alias(c) for c in ("n", "sum", "squares", "near")], F.max("largest").alias("largest"))


def _pieces(batch: pa.RecordBatch):
    """A batch in parts whose arrays, as wide as the longest list, stay small."""
    widest = max([1, *(pc.max(batch.column(c).value_lengths()).as_py() or 0 for c in ("sources", "series"))])
    step = max(1, CELLS // widest)
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def evaluate(examples: DataFrame, key: str, label: str = "label", fold: str = "fold", grid: Sequence[dict] = GRID) -> tuple[DataFrame, DataFrame]:
    """(folds, samples) of labelled evidence whose rows have a fold.

    ``folds``: of each fold the configuration that errs least on all others (root mean square, then
    mean, largest error, share within a tenth, then its JSON) with train_rmse, train_mae, test_rmse and
    test_mae. ``samples``: (key, fold, label, prediction, error) by the configuration of its own fold,
    which has not seen it. A fold that holds every example has nothing to learn from, and no row.
    """
    spark = examples.sparkSession
    configs = spark.createDataFrame([{**c, "config": n} for n, c in enumerate(grid)], "least_lag double, least_improvement double, least_joint double, least_sources int, fallback string, config int")
    known = F.broadcast(configs.withColumn("json", F.to_json(F.struct(*CONFIGURATION))))  # a fixed list
    x = examples.withColumn("series", strongest(F.col("windows")))
    per = errors(x, grid, label, fold).join(known.select("config", "json"), "config")
    every = Window.partitionBy("config")
    other = lambda c: F.sum(c).over(every) - F.col(c)
    apart = F.filter(F.collect_list(F.struct("fold", "largest")).over(every), lambda s: s["fold"] != F.col("fold"))
    t = per.withColumns({"m": other("n"), "s": other("sum"), "q": other("squares"), "a": other("near"), "top": F.array_max(F.transform(apart, lambda s: s["largest"]))}).where("m > 0")
    # Differences of sums are exact to what errors in tenths need.
    rmse, mae = F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("m"))), 9), F.round(F.col("s") / F.col("m"), 9)
    rank = F.struct(rmse.alias("rmse"), mae.alias("mae"), "top", (-F.col("a") / F.col("m")).alias("near"), "json", "config")
    best = t.groupBy("fold").agg(F.min(F.struct(rank.alias("r"), "n", "sum", "squares")).alias("b"))
    chosen = best.select("fold", F.col("b.r.config").alias("config"), F.col("b.r.json").alias("json"), F.col("b.r.rmse").alias("train_rmse"), F.col("b.r.mae").alias("train_mae"), F.sqrt(F.col("b.squares") / F.col("b.n")).alias("test_rmse"), (F.col("b.sum") / F.col("b.n")).alias("test_mae"))
    folds = chosen.join(configs, "config").select("fold", *CONFIGURATION, "train_rmse", "train_mae", "test_rmse", "test_mae")
    # A row for each fold.
    own = x.withColumn("fold", F.col(fold)).join(F.broadcast(chosen.join(configs, "config").select("fold", *CONFIGURATION)), "fold")
    own = own.withColumn("prediction", predicted({n: F.col(n) for n in CONFIGURATION})).withColumn("error", F.abs(F.col("prediction") - F.col(label)))
    return folds, own.select(key, "fold", F.col(label).alias("label"), "prediction", "error")
