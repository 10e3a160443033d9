"""Sources: audio files, manifests, sessions, JSON lines, training shards.

Files come through Spark's own readers (binaryFile, json, parquet), so any store that Spark reads
will do; formats that Spark does not know are decoded from the bytes in Arrow batches.
"""

from __future__ import annotations

import io
import struct
import wave
import zipfile
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUDIO = "(?i)\\.(wav|flac|mp3|m4a|ogg)$"


def files(spark: SparkSession, root: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """(path, length[, content]) of all files under a root."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return df.select("path", "length", *(["content"] if content else []))


def speaker_order(path: Column) -> Column:
    """Sort key of a track: named speakers first in their order, others by name."""
    name = F.lower(F.regexp_extract(path, "([^/]+)\\.[^.]+$", 1))
    return F.struct(F.when(F.rlike(name, F.lit("speaker[_-]?(1|a)$")), 0).when(F.rlike(name, F.lit("speaker[_-]?(2|b)$")), 1).otherwise(2).alias("rank"), path.alias("path"))


def discover_samples(listing: DataFrame) -> DataFrame:
    """(folder, speaker1, speaker2) of folders with two audio files, or with three of which exactly one is a mix."""
    audio = listing.where(F.col("path").rlike(AUDIO)).withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]+$", 1))
    per = audio.groupBy("folder").agg(F.array_sort(F.collect_list(speaker_order(F.col("path")))).alias("all"))
    mix = lambda x: F.rlike(F.lower(F.regexp_extract(x["path"], "([^/]+)$", 1)), F.lit("mix"))
    per = per.withColumn("tracks", F.when(F.size("all") == 2, F.col("all")).when((F.size("all") == 3) & (F.size(F.filter("all", mix)) == 1), F.filter("all", lambda x: ~mix(x))))
    return per.where("tracks is not null").select("folder", F.get("tracks", 0)["path"].alias("speaker1"), F.get("tracks", 1)["path"].alias("speaker2"))


def compatible_durations(a: Column, b: Column) -> Column:
    """At most 20 s and 1 % of the shorter apart."""
    return (F.abs(a - b) <= 20.0) & (F.abs(a - b) <= 0.01 * F.least(a, b))


MANIFEST = "sample_count int, samples array<struct<id:string,files:array<struct<path:string,duration_seconds:double>>>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(id, speaker1, speaker2, duration, compatible) of a JSON manifest; a wrong count or number of files is an error."""
    m = spark.read.schema(MANIFEST).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    counted = m.withColumn("_ok", F.assert_true(F.size("samples") == F.col("sample_count"), F.lit("sample_count differs from the samples listed")))
    s = counted.where(F.col("_ok").isNull()).select(F.explode("samples").alias("s"))
    two = s.withColumn("_ok", F.assert_true(F.size("s.files") == 2, F.lit("a sample needs two files"))).where(F.col("_ok").isNull())
    t = two.select(F.col("s.id").alias("id"), F.array_sort(F.transform("s.files", lambda f: F.struct(speaker_order(f["path"]).alias("o"), f.alias("f")))).alias("t"))
    d = [F.get("t", i)["f"]["duration_seconds"] for i in (0, 1)]
    return t.select("id", F.get("t", 0)["f"]["path"].alias("speaker1"), F.get("t", 1)["f"]["path"].alias("speaker2"), F.greatest(*d).alias("duration"), compatible_durations(*d).alias("compatible"))


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Records of JSON lines; blank lines are skipped, any other malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


SESSION = "turns array<struct<speaker:string,start_seconds:double,end_seconds:double,text:string>>"


def read_sessions(spark: SparkSession, root: str) -> DataFrame:
    """(session, turns) of session folders that hold a metadata.json, by name."""
    meta = spark.read.schema(SESSION).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.json").json(root)
    return meta.select(F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]+$", 1).alias("session"), "turns")


def transcript_turns(sessions: DataFrame, offsets: DataFrame) -> DataFrame:
    """(session, speaker, start, end, text): turns with text, each speaker's moved by its offset (none: 0)."""
    t = sessions.select("session", F.explode("turns").alias("t")).select("session", "t.*").where(F.trim("text") != "")
    moved = t.join(offsets.select("session", "speaker", "offset"), ["session", "speaker"], "left")
    at = lambda c: (F.col(c) + F.coalesce("offset", F.lit(0.0))).alias(c.removesuffix("_seconds"))
    return moved.select("session", "speaker", at("start_seconds"), at("end_seconds"), "text")


def parse_s3(uri: Column) -> Column:
    """(bucket, key) of an s3:// address, null for anything else."""
    m = lambda g: F.regexp_extract(uri, "^s3a?://([^/]+)/(.+)$", g)
    return F.when(m(1) != "", F.struct(m(1).alias("bucket"), m(2).alias("key")))


def decode_pcm(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Mono samples in [-1, 1): channel mean of 8-, 16-, 24- or 32-bit PCM."""
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8)[: len(raw) // 3 * 3].reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000
        x = x / float(1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(float) / float(1 << (8 * width - 1))
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(1)


def resample(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation onto the target rate's grid."""
    if source == target or not len(x):
        return x
    n = round(len(x) * target / source)
    return np.interp(np.arange(n) * source / target, np.arange(len(x)), x)


WAVES = "path string, sample_rate int, channels int, n_frames bigint, duration double, start double, samples array<float>, error string"


def read_waves(content: DataFrame, rate: int = 16000, start: float = 0.0, seconds: float | None = None, chunk_seconds: float | None = None) -> DataFrame:
    """Decode WAV bytes (path, content): one row per file, or per ``chunk_seconds`` of it, mono at ``rate``.

    Only [start, start + seconds) is decoded. A file that is no WAV comes as one row with ``error``.
    """

    def decode(batches):
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                try:
                    with wave.open(io.BytesIO(raw.as_py())) as w:
                        sr, ch, n, width = w.getframerate(), w.getnchannels(), w.getnframes(), w.getsampwidth()
                        at, stop = min(n, int(start * sr)), n if seconds is None else min(n, int((start + seconds) * sr))
                        w.setpos(at)
                        while at < stop:
                            take = stop - at if chunk_seconds is None else min(stop - at, int(chunk_seconds * sr))
                            x = np.clip(resample(decode_pcm(w.readframes(take), width, ch), sr, rate), -1, 1)
                            rows.append((path, sr, ch, n, n / sr, at / sr, x.astype(np.float32), None))
                            at += take
                        if not rows:
                            rows.append((path, sr, ch, n, n / sr, start, np.zeros(0, np.float32), None))
                except (wave.Error, EOFError, struct.error, KeyError) as e:
                    rows.append((path, None, None, None, None, None, None, str(e) or type(e).__name__))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float32()), pa.string())
                names = ("path", "sample_rate", "channels", "n_frames", "duration", "start", "samples", "error")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

    return content.select("path", "content").mapInArrow(decode, WAVES)


def read_zip(content: DataFrame, suffix: str = "") -> DataFrame:
    """(path, member, size, sha256, content) of the members of ZIP archives (path, content)."""
    import hashlib

    def members(batches):
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with zipfile.ZipFile(io.BytesIO(raw.as_py())) as z:
                    for m in z.infolist():
                        if not m.is_dir() and m.filename.endswith(suffix):
                            b = z.read(m)
                            yield pa.RecordBatch.from_pydict({"path": [path], "member": [m.filename], "size": [len(b)], "sha256": [hashlib.sha256(b).hexdigest()], "content": [b]}, schema=pa.schema([("path", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("sha256", pa.string()), ("content", pa.binary())]))

    return content.select("path", "content").mapInArrow(members, "path string, member string, size bigint, sha256 string, content binary")


def numbered(df: DataFrame, order: Sequence[str], prefix: str = "sample_", out: str = "sample_id") -> DataFrame:
    """Rows named sample_001, sample_002, ... in order; numbers are dealt per partition after one range sort."""
    from pyspark.sql.window import Window

    parts = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    per = parts.groupBy("_p").agg(F.count("*").alias("_c"))
    before = per.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    return parts.join(F.broadcast(before), "_p").withColumn(out, F.format_string(prefix + "%03d", F.col("_before") + F.col("_n"))).drop("_p", "_n", "_before")


def annotation_tracks(df: DataFrame, prefix: str, annotators: Sequence[str]) -> Column:
    """Columns ``prefix``_annotator as an array of (annotator, events)."""
    return F.array(*[F.struct(F.lit(a).alias("annotator"), F.col(f"{prefix}_{a}").alias("events")) for a in annotators])


def read_shards(spark: SparkSession, root: str, split: str, inventory: DataFrame) -> DataFrame:
    """Rows of one split's shards, after their sizes, hashes and row counts have been held against the inventory."""
    path = f"{root}/training/split={split}"
    seen = files(spark, path, "*.parquet", content=True).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("_len"), F.sha2("content", 256).alias("_sha"))
    wrong = inventory.where(F.col("split") == split).join(seen, "file", "full_outer").where("bytes is null or _len is null or bytes != _len or sha256 != _sha")
    if not wrong.isEmpty():
        raise ValueError(f"shards of {split} differ from their inventory")
    rows = spark.read.parquet(path)
    expected = inventory.where(F.col("split") == split).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    if rows.count() != expected:
        raise ValueError(f"shards of {split} hold another number of rows than their inventory")
    return rows
