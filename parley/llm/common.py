"""Shared pieces of the corpus operators: work storage, row packing, skew-safe joins."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.shipping import ship

#: Bytes of text that one shuffle partition of a text-keyed exchange may carry.
PARTITION_BYTES = 16 << 20

#: Rows of text in an Arrow batch.
BATCH_ROWS = 1000

#: Rows of a few numbers in one file of a table whose size is known.
FILE_ROWS = 1 << 17

#: A key with at least 1/HOT_SHARE of all rows is joined by broadcast; there are at most HOT_SHARE of them.
HOT_SHARE = 1000


def work_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir``; a temporary folder stands in for it in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="parley-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


class _Frames(threading.local):
    """Of each thread: paths and catalogue tables made since each open scratch() began; at the bottom, those made outside any."""

    def __init__(self) -> None:
        self.open: list[list[tuple[str, str]]] = [[]]


_frames = _Frames()


def work_path(spark: SparkSession, name: str) -> str:
    path = f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"
    _frames.open[-1].append(("path", path))
    return path


def _remove(spark: SparkSession, made: list[tuple[str, str]]) -> None:
    for kind, what in made:
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {what}")
        else:
            p = spark._jvm.org.apache.hadoop.fs.Path(what)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes the intermediate tables made inside when it ends, but for those that :func:`kept` has handed out.

    Scopes nest, and each thread has its own. What an operator hands out with its result belongs to
    the scope around it: ``with scratch(spark): op(...).write...`` leaves nothing behind.
    """
    _frames.open.append([])
    try:
        yield
    finally:
        _remove(spark, _frames.open.pop())


def release(spark: SparkSession) -> None:
    """Delete what operators called outside any scope have handed out with their results, once those are read."""
    _remove(spark, _frames.open[0])
    _frames.open[0].clear()


def kept_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """:func:`written`, for a table that outlives the innermost scratch()."""
    inner = _frames.open.pop() if len(_frames.open) > 1 else None
    try:
        return written(df, name)
    finally:
        if inner is not None:
            _frames.open.append(inner)


def kept(df: DataFrame, name: str) -> DataFrame:
    """:func:`materialize`, for a table that outlives the innermost scratch()."""
    return kept_at(df, name)[0]


#: Spark's setting that deletes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _no_leftovers(spark: SparkSession):
    """Queries in here delete their shuffle files at their end: what they write is read back from the shared folder, so nobody needs them."""
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, was)


def written(df: DataFrame, name: str, rows: int | None = None) -> tuple[DataFrame, str]:
    """:func:`materialize`, and the path, for :func:`discard`."""
    path = work_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    with _no_leftovers(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete one intermediate table before its scope ends, so that rounds do not pile up."""
    _remove(spark, [("path", path)])
    for frame in _frames.open:
        if ("path", path) in frame:
            frame.remove(("path", path))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let Arrow batches of this session have ``rows`` rows at most, as both sides hold whole batches of texts; send the workers this package."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name) or 0)
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    ``rows``, if known, is how many rows of a few numbers ``df`` has at most: it is written in files
    of FILE_ROWS, as many as there are cores at least, not in one for each shuffle partition.
    """
    return written(df, name, rows)[0]


def bucketed(rows: DataFrame, buckets: int, key: str, name: str) -> DataFrame:
    """``rows`` written to the shared folder in buckets of ``key``, sorted in each, and read back: joins on it do not shuffle them again."""
    table = f"parley_{name}_{uuid.uuid4().hex}"
    _frames.open[-1].append(("table", table))
    with _no_leftovers(rows.sparkSession):
        rows.write.bucketBy(buckets, key).sortBy(key).option("path", work_path(rows.sparkSession, name)).saveAsTable(table)
    return rows.sparkSession.table(table)


def packed(docs: DataFrame, out: str) -> Column:
    """The columns of ``docs`` as struct ``_row``, but for one by the name of the result ``out``, which the result replaces."""
    names = [c for c in docs.columns if c.lower() != out.lower()]
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in names]).alias("_row")


def range_sums(rows: DataFrame, order: Sequence[str | Column], values: Sequence[str], n: int) -> DataFrame:
    """``rows`` with ``before_<value>``: the sum of each of ``values`` over all rows earlier in ``order`` (a total order).

    Rows are sorted by range, each range sums its own, and the sums of whole ranges (one row each,
    ``n`` at most) are added up apart; so no task holds more than a range.
    """
    dealt = materialize(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = dealt.groupBy("_range").agg(*[F.sum(v).alias(v) for v in values])
    start = whole.select("_range", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"_start_{v}") for v in values])
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumns({f"_own_{v}": F.coalesce(F.sum(v).over(own), F.lit(0)) for v in values})
    return placed.join(F.broadcast(start), "_range").select(*rows.columns, *[(F.col(f"_start_{v}") + F.col(f"_own_{v}")).alias(f"before_{v}") for v in values])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(spark: SparkSession, n_bytes: int, each: int = PARTITION_BYTES) -> int:
    return max(shuffle_partitions(spark), -(-n_bytes // each))


def join_unique(left: DataFrame, right: DataFrame, key: str, n_left: str, how: str = "left") -> DataFrame:
    """Join ``left`` to ``right`` (one row per non-null ``key``) without gathering a hot key in one task.

    ``right`` has a column ``n_left``: how many rows of ``left`` carry the key. Keys with at
    least one part in HOT_SHARE of the counted rows, of which at most HOT_SHARE can exist, are
    broadcast; all others meet in an ordinary shuffle join. ``how``: left or inner. ``right``
    should be materialized, as it is read three times. Null keys never match.
    """
    total = right.agg(F.sum(n_left)).first()[0] or 0
    cut = max(1, total // HOT_SHARE)
    if total == 0:
        return left.join(right.drop(n_left), key, how)
    hot = right.where(F.col(n_left) > cut)
    cold = right.where(F.col(n_left) <= cut).drop(n_left)
    tag = hot.select(F.col(key), F.struct(*[c for c in right.columns if c not in (key, n_left)]).alias("_hot"))
    tagged = left.join(F.broadcast(tag), key, "left")
    names = [c for c in right.columns if c not in (key, n_left)]
    kept = [c for c in left.columns]
    is_hot = F.col("_hot").isNotNull()
    a = tagged.where(is_hot).select(*kept, *[F.col(f"_hot.{c}").alias(c) for c in names])
    b = tagged.where(~is_hot).select(*kept).join(cold, key, how).select(*kept, *names)
    return a.unionByName(b)
