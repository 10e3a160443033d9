"""The training corpus as a whole: windows with their targets by frame, written in shards with a manifest, and checked again from what was written.

``recordings``: (dataset, dataset_name, sample, external_id, split, quality, duration, annotated,
audio1, audio2, sha1, sha2), one row each; ``annotated`` is how far the annotation reaches, ``audio`` and ``sha`` the
tracks' paths in the corpus and their hashes. Windows are of one user side (1 or 2).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parley.sources.readers import files
from parley.sources.writers import SPLITS, write_json, write_shards

# Versions, seconds, frames of a window, what stands for a masked target, targets of a frame in order.
SCHEMA_VERSION, LABEL_VERSION = "corpus-1", "labels-1"
FRAME, INPUT, N_FRAMES = 0.08, 20.0, 250
MASKED, TOLERANCE = -1.0, 0.001
INPUTS = ("assistant_has_floor",)
TARGETS = ("p_user_has_floor", "p_user_yield", "p_assistant_backchannel", "future_activity_0_200", "future_activity_200_500", "future_activity_500_1000", "future_activity_1000_1500", "turn_completion", "continuation_pause", "non_floor_feedback", "floor_take")
FIELDS = INPUTS + TARGETS
KEYS = ("dataset", "sample")


def window_id(side: Column, start: Column) -> Column:
    """Of the versions, the recording, the user's side and the frame that a window starts at."""
    return F.sha2(F.concat_ws(":", F.lit(SCHEMA_VERSION), F.lit(LABEL_VERSION), *[F.col(k).cast("string") for k in KEYS], side.cast("string"), F.bround(start / FRAME).cast("bigint").cast("string")), 256)


def masked_value(target: Column) -> Column:
    """A target (struct target, valid) as a number: MASKED where it is not valid; null, which is an error, where it is valid and has no value."""
    return F.when(target["valid"], target["target"]).otherwise(F.lit(MASKED))


def stretches(frames: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of one window (``by``) that follow each other as one row of arrays: (by, frame, FIELDS). Frames mostly come in order, so that few rows are left to shuffle."""
    by, lists = list(by), ("frame", *FIELDS)

    def gather(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            first = np.ones(n, bool)
            same = [pc.fill_null(pc.equal(b.column(k).slice(1), b.column(k).slice(0, n - 1)), False).to_numpy(zero_copy_only=False) for k in by]
            first[1:] = ~np.logical_and.reduce(same)
            at = np.flatnonzero(first)
            offsets = pa.array(np.append(at, n), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(at)) for k in by] + [pa.ListArray.from_arrays(offsets, b.column(c)) for c in lists], [*by, *lists])

    flat = frames.select(*by, *lists)
    schema = T.StructType([flat.schema[k] for k in by] + [T.StructField(c, T.ArrayType(flat.schema[c].dataType)) for c in lists])
    return flat.mapInArrow(gather, schema)


def assemble(windows: DataFrame, frames: DataFrame, recordings: DataFrame, n_frames: int = N_FRAMES) -> DataFrame:
    """Training rows of accepted ``windows`` (dataset, sample, user_side, start, end, category) and their ``frames``.

    ``frames``: (dataset, sample, user_side, start, frame) with the numbers INPUTS and the structs
    TARGETS (target, valid). Windows that go beyond their recording are left out. Windows whose frames
    are not 0 to n_frames - 1, each once, and those with a valid target that has no value, come with
    arrays that :func:`sample_issues` reports; nothing is filled in.
    """
    by = [*KEYS, "user_side", "start"]
    values = [F.col(c).cast("float").alias(c) for c in INPUTS] + [masked_value(F.col(c)).cast("float").alias(c) for c in TARGETS]
    parts = stretches(frames.select(*by, F.col("frame").cast("int").alias("frame"), *values), by).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("frame", *FIELDS))).alias("f"))
    rows = parts.select(*by, *[F.flatten(f"f.{c}").alias(c) for c in ("frame", *FIELDS)])
    every = F.sequence(F.lit(0), F.lit(n_frames - 1))
    # Only stretches that interleave have to be sorted frame by frame.
    rows = rows.withColumn("_whole", F.col("frame") == every)
    rows = rows.withColumn("_sorted", F.when(~F.col("_whole"), F.sort_array(F.arrays_zip("frame", *FIELDS))))
    rows = rows.withColumn("_mended", F.coalesce(F.col("_sorted.frame") == every, F.lit(False)))
    arrays = [F.when(F.col("_whole"), F.col(c)).when(F.col("_mended"), F.col(f"_sorted.{c}")).otherwise(F.array().cast("array<float>")).alias(c) for c in FIELDS]
    w = windows.join(recordings, list(KEYS)).where(F.col("end") <= F.col("duration")).join(rows, by)
    other = 3 - F.col("user_side")
    path = lambda side: F.when(side == 1, F.col("audio1")).otherwise(F.col("audio2"))
    return w.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit(LABEL_VERSION).alias("training_label_version"),
        window_id(F.col("user_side"), F.col("start")).alias("window_id"),
        "dataset",
        "dataset_name",
        "sample",
        "external_id",
        "user_side",
        other.cast("int").alias("assistant_side"),
        "split",
        path(F.col("user_side")).alias("user_audio_path"),
        path(other).alias("assistant_audio_path"),
        "start",
        "end",
        "quality",
        "category",
        *arrays,
    )


def split_totals(rows: DataFrame, recordings: DataFrame) -> DataFrame:
    """(split, n_recordings, n_samples, duration) of every split, zeros included."""
    every = rows.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    n = rows.groupBy("split").agg(F.count("*").alias("n_samples"))
    r = recordings.groupBy("split").agg(F.count("*").alias("n_recordings"), F.sum("duration").alias("duration"))
    return every.join(r, "split", "left").join(n, "split", "left").fillna(0).select("split", "n_recordings", "n_samples", "duration")


def export(rows: DataFrame, recordings: DataFrame, root: str, per_shard: int = 1000) -> DataFrame:
    """Write shards by split, the recordings, and last the manifest that names them all; the manifest's row. What is there already is an error.

    ``rows`` are read twice (to write, and from the shards to count), so what they come from should be cheap or written.
    """
    spark = rows.sparkSession
    shards = write_shards(rows, root, per_shard)
    recordings.write.mode("errorifexists").parquet(f"{root}/recordings")
    written = spark.read.parquet(f"{root}/training")
    totals = split_totals(written, recordings).agg(F.sort_array(F.collect_list(F.struct("split", "n_recordings", "n_samples", "duration"))).alias("splits"))
    inventory = shards.select(F.struct("split", F.concat(F.lit("training/split="), "split", F.lit("/"), "file").alias("path"), "rows", "bytes", "sha256").alias("s")).agg(F.sort_array(F.collect_list("s")).alias("shards"))
    one = totals.join(inventory)  # a row each
    add = lambda c: F.aggregate("splits", F.lit(0).cast("bigint"), lambda a, s: a + s[c])
    manifest = one.select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(LABEL_VERSION).alias("training_label_version"), F.lit(INPUT).alias("input_duration"), add("n_recordings").alias("n_recordings"), add("n_samples").alias("n_samples"), "splits", "shards")
    write_json(manifest.coalesce(1), f"{root}/manifest")
    return read_manifest(spark, root)


MANIFEST = "schema_version string, training_label_version string, input_duration double, n_recordings bigint, n_samples bigint, splits array<struct<split:string,n_recordings:bigint,n_samples:bigint,duration:double>>, shards array<struct<split:string,path:string,rows:bigint,bytes:bigint,sha256:string>>"


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{root}/manifest")


def _issues(df: DataFrame, subject: Column, rules: dict[str, Column]) -> DataFrame:
    """(code, subject) for every rule that holds on a row."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.select(F.explode(found).alias("code"), subject.cast("string").alias("subject"))


def manifest_issues(manifest: DataFrame) -> DataFrame:
    """(code, subject) of what does not add up within a manifest."""
    total = lambda of, c: F.aggregate(of, F.lit(0).cast("bigint"), lambda a, s: a + s[c])
    names, paths = F.transform("splits", lambda s: s["split"]), F.transform("shards", lambda s: s["path"])
    unsafe = lambda p: p.contains("\\") | F.startswith(p, F.lit("/")) | F.array_contains(F.split(p, "/"), "..") | (p == "")
    rules = {
        "split_summaries": F.array_sort(names) != F.array(*[F.lit(s) for s in sorted(SPLITS)]),
        "duplicate_shard": F.size(F.array_distinct(paths)) < F.size(paths),
        "unsafe_path": F.exists(paths, unsafe),
        "shard_rows": total("shards", "rows") != F.col("n_samples"),
        "split_samples": total("splits", "n_samples") != F.col("n_samples"),
        "split_recordings": total("splits", "n_recordings") != F.col("n_recordings"),
    }
    return _issues(manifest, F.lit("manifest"), rules)


def shard_issues(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """(code, subject) of shards that are missing, not as the manifest has them, or not named in it."""
    named = manifest.select(F.explode("shards").alias("s")).select("s.*")
    there = files(spark, f"{root}/training", "*.parquet", content=True).select(F.regexp_extract("path", "(training/split=[^/]+/[^/]+)$", 1).alias("path"), F.col("length").alias("_bytes"), F.sha2("content", 256).alias("_sha"))
    n = spark.read.parquet(f"{root}/training").groupBy(F.regexp_extract(F.input_file_name(), "(training/split=[^/]+/[^/]+)$", 1).alias("path")).agg(F.count("*").alias("_rows"))
    x = named.join(there.join(n, "path", "left"), "path", "full")
    rules = {"missing_shard": F.col("_bytes").isNull(), "unnamed_shard": F.col("sha256").isNull(), "shard_size": F.col("bytes") != F.col("_bytes"), "shard_hash": F.col("sha256") != F.col("_sha"), "shard_row_count": F.col("_bytes").isNotNull() & (F.col("rows") != F.coalesce("_rows", F.lit(0))), "wrong_split": ~F.contains("path", F.concat(F.lit("split="), "split", F.lit("/")))}
    return _issues(x, F.col("path"), rules)


def recording_issues(recordings: DataFrame) -> DataFrame:
    """(code, subject) of recordings that come twice, share both tracks with another, or are annotated beyond their end."""
    n = lambda *by: F.count("*").over(Window.partitionBy(*by))
    x = recordings.withColumns({"_same": n(*KEYS), "_tracks": n("sha1", "sha2")})
    rules = {"duplicate_recording": F.col("_same") > 1, "duplicate_audio": (F.col("_tracks") > 1) & F.col("sha1").isNotNull() & F.col("sha2").isNotNull(), "annotation_beyond_end": F.col("annotated") > F.col("duration") + TOLERANCE, "unknown_split": ~F.col("split").isin(*SPLITS)}
    return _issues(x, F.concat_ws("/", *KEYS), rules)


def sample_issues(rows: DataFrame, recordings: DataFrame, n_frames: int = N_FRAMES) -> DataFrame:
    """(code, subject) of training rows: versions, recording, sides, times, tracks, identity, and arrays of targets."""
    own = recordings.dropDuplicates(list(KEYS)).select(*KEYS, F.struct(*[c for c in recordings.columns if c not in KEYS]).alias("_r"))
    # Arrays are looked at where they are; what is counted over other rows goes without them, so that rows are made only once.
    # Searched for a number that it may not hold, an array with a null in it answers null; NaN is the largest number.
    slim = rows.withColumns({"_short": F.exists(F.array(*[F.size(c) for c in FIELDS]), lambda n: n != n_frames), "_all": F.flatten(F.array(*[F.col(c) for c in FIELDS]))})
    null = F.col("_all").isNotNull() & F.array_contains("_all", F.lit(MASKED - 1).cast("float")).isNull()
    slim = slim.withColumn("_wrong", null | (F.array_max("_all") > 1) | (F.array_min(F.array_remove("_all", F.lit(MASKED).cast("float"))) < 0)).drop("_all", *FIELDS)
    over = lambda f, by: F.when(F.forall(F.array(*[F.col(c).isNotNull() for c in by]), lambda b: b), f.over(Window.partitionBy(*by)))
    window = [*KEYS, "user_side", "start", "end"]
    x = slim.withColumns({"_ids": over(F.count("*"), ["window_id"]), "_same": over(F.count("*"), window), "_splits": F.size(over(F.collect_set("split"), list(KEYS)))})
    x = x.join(own, list(KEYS), "left")
    r = lambda c: F.col(f"_r.{c}")
    path = lambda side: F.when(side == 1, r("audio1")).otherwise(r("audio2"))
    rules = {
        "unknown_recording": F.col("_r").isNull(),
        "versions": (F.col("schema_version") != SCHEMA_VERSION) | (F.col("training_label_version") != LABEL_VERSION),
        "recording_fields": ~(F.col("dataset_name").eqNullSafe(r("dataset_name")) & F.col("external_id").eqNullSafe(r("external_id")) & F.col("split").eqNullSafe(r("split")) & F.col("quality").eqNullSafe(r("quality"))) & F.col("_r").isNotNull(),
        "sides": ~F.col("user_side").isin(1, 2) | (F.col("assistant_side") != 3 - F.col("user_side")),
        "window_duration": F.abs(F.col("end") - F.col("start") - INPUT) > 1e-9,
        "beyond_recording": F.col("end") > r("duration") + TOLERANCE,
        "beyond_annotation": F.col("end") > r("annotated") + TOLERANCE,
        "audio_paths": (F.col("user_audio_path") != path(F.col("user_side"))) | (F.col("assistant_audio_path") != path(3 - F.col("user_side"))),
        "window_identity": F.col("window_id") != window_id(F.col("user_side"), F.col("start")),
        "duplicate_window_id": F.col("_ids") > 1,
        "duplicate_window": F.col("_same") > 1,
        "recording_in_splits": F.col("_splits") > 1,
        "target_length": F.col("_short"),
        "target_range": F.col("_wrong"),
    }
    return _issues(x, F.col("window_id"), rules)


def validate(spark: SparkSession, root: str, n_frames: int = N_FRAMES) -> DataFrame:
    """(code, subject) of all that is wrong with an exported corpus; no rows if nothing is."""
    manifest, rows, recordings = read_manifest(spark, root), spark.read.parquet(f"{root}/training"), spark.read.parquet(f"{root}/recordings")
    told = manifest.select(F.explode("splits").alias("s")).select("s.*")
    now = split_totals(rows, recordings).select("split", *[F.col(c).alias(f"_{c}") for c in ("n_recordings", "n_samples", "duration")])
    off = (F.col("n_recordings") != F.col("_n_recordings")) | (F.col("n_samples") != F.col("_n_samples")) | (F.abs(F.col("duration") - F.col("_duration")) > TOLERANCE)
    sums = _issues(told.join(now, "split", "full"), F.col("split"), {"split_summary": off | F.col("n_samples").isNull() | F.col("_n_samples").isNull()})
    out = manifest_issues(manifest)
    for part in (shard_issues(spark, root, manifest), recording_issues(recordings), sample_issues(rows, recordings, n_frames), sums):
        out = out.unionByName(part)
    return out


def concentrations(rows: DataFrame, recordings: DataFrame, splits: Sequence[str] = SPLITS) -> DataFrame:
    """(dataset, split, n_recordings, n_windows, most, share): how much of a dataset's split one recording makes up, zeros included."""
    every = recordings.select("dataset").distinct().withColumn("split", F.explode(F.array(*[F.lit(s) for s in splits])))
    per = rows.groupBy(*KEYS, "split").agg(F.count("*").alias("_n")).groupBy("dataset", "split").agg(F.sum("_n").alias("n_windows"), F.max("_n").alias("most"))
    n = recordings.groupBy("dataset", "split").agg(F.count("*").alias("n_recordings"))
    x = every.join(n, ["dataset", "split"], "left").join(per, ["dataset", "split"], "left").fillna(0, ["n_recordings", "n_windows", "most"])
    return x.select("dataset", "split", "n_recordings", "n_windows", "most", F.when(F.col("n_windows") > 0, F.col("most") / F.col("n_windows")).otherwise(0.0).alias("share"))
