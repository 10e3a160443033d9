"""Interaction of filters over a corpus: what each removes, by every order in which they can be applied.

Duplicates come from a sort: rows are range-sorted by fingerprint, text and id, every row is
compared with its predecessor, and a run that a range boundary cuts is joined up afterwards from
the rows at the boundaries. Each document's failures become one mask, masks merge into counters
for each part of the corpus (at most 32 masks each), and all orders are read off the counters.
"""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from parley.llm.common import kept, materialize, partitions_for, scratch, small_batches

#: Filters by bit, and all orders of them.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Characters of which one is enough for filter D.
SYMBOLS = b"#$%&*|"

_CAPITALS = bytes(range(65, 91))


def failures(text: bytes) -> int:
    """Bits of the filters A to D that UTF-8 ``text`` fails."""
    words = text.split()  # bytes split at [\x20\x09-\x0D] only
    points = len(text.decode("utf-8", "replace"))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 3 * points) << 2 | (len(text.translate(None, SYMBOLS)) != len(text)) << 3


_SCHEMA = "p int, run int, edge boolean, fp bigint, text binary, id {id}, part string, mask int"


def _compare(id_type: pa.DataType):
    """Arrow task over one sorted range: masks of its rows, and its runs of equal texts that may go on in other ranges.

    ``run`` numbers the runs of the first fingerprint, which an earlier range may have begun; rows
    of later fingerprints have none. Edge rows hold text and smallest id of each run of the first
    and the last fingerprint.
    """
    kinds = pa.schema([("p", pa.int32()), ("run", pa.int32()), ("edge", pa.bool_()), ("fp", pa.int64()), ("text", pa.binary()), ("id", id_type), ("part", pa.string()), ("mask", pa.int32())])

    def edges(p, fp, runs):
        return [(p, run, True, fp, text, low, None, None) for run, text, low in runs]

    def task(batches):
        p, fp, first, runs = None, None, True, []  # runs of the fingerprint at hand
        for batch in batches:
            out = []
            for here, key, text, id_, part in zip(*(batch.column(n).to_pylist() for n in ("p", "fp", "text", "id", "part")), strict=True):
                if key != fp or p is None:
                    if p is not None and first:
                        out += edges(p, fp, runs)
                        first = False
                    p, fp, runs = here, key, []
                if not runs or runs[-1][1] != text:
                    runs.append((len(runs), text, id_))
                run, _, low = runs[-1]
                copy = low is not None and (id_ is None or id_ > low)
                out.append((p, run if first else None, False, None, None, id_, part, failures(text) | copy << 4))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(kinds)], schema=kinds)
        if p is not None:
            # The last fingerprint's runs; where it is the first as well, this is their one report.
            out = edges(p, fp, runs if first else [(None, *r[1:]) for r in runs])
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(kinds)], schema=kinds)

    return task


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask) of each row of ``docs``: bit i is set if it fails filter ``FILTERS[i]``.

    Null texts are empty; null parts the empty string. A row without an id stands after all others
    (it copies any equal text with an id, and nothing copies it). Rows that repeat an id and a text
    do not copy each other. Other columns are ignored, whatever their names. Texts pass through
    tasks one at a time, whole. Range bounds, which the driver samples, are of fingerprint and id
    only, so that no text goes through it; within ranges rows are sorted by all three.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")).withColumn("fp", F.xxhash64("text"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    last = F.col("id").asc_nulls_last()
    dealt = rows.repartitionByRange(partitions_for(spark, n_bytes), "fp", last).sortWithinPartitions("fp", "text", last)
    id_type = dealt.schema["id"].dataType
    sent = dealt.select(F.spark_partition_id().alias("p"), "fp", F.col("text").cast("binary").alias("text"), "id", "part")
    found = materialize(sent.mapInArrow(_compare(to_arrow_type(id_type)), _SCHEMA.format(id=id_type.simpleString())), "audited")
    edge = found.where("edge")
    low = edge.groupBy("fp", "text").agg(F.min("id").alias("low"))
    known = edge.where("run is not null").join(low, ["fp", "text"]).select("p", "run", "low")
    rows = found.where("not edge").select("p", "run", "id", "part", "mask")
    closed = rows.where("run is null").select("id", "part", "mask")
    copy = F.col("low").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("low")))
    opened = rows.where("run is not null").join(known, ["p", "run"]).select("id", "part", F.col("mask").bitwiseOR(F.when(copy, 16).otherwise(0)).alias("mask"))
    return closed.unionByName(opened)


def part_counters(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): rows, and those labelled quality 1 or toxic 1, of each part and mask.

    Counters of disjoint rows add up. Rows are counted by id before they meet the labels, so one id
    repeated without end is as many rows as it has parts and masks. Of several labels for one id, any
    that says 1 counts; ids without a label, and null ids, have none.
    """
    own = masks.groupBy("id", "part", "mask").agg(F.count("*").alias("n"))
    says = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    told = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), "quality", "toxic").groupBy("id").agg(says("quality"), says("toxic"))
    of = lambda c, name: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(name)
    named = own.where("id is not null").join(told, "id", "left").select("part", "mask", "n", "quality", "toxic")
    nameless = own.where("id is null").select("part", "mask", "n", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    return named.unionByName(nameless).groupBy("part", "mask").agg(F.sum("n").alias("n"), of("quality", "good"), of("toxic", "toxic"))


def interactions(counters: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: what the step's filter does there.

    ``kept`` passes this filter and all before; ``removed`` fails it and none before; ``redundant``
    fails it and one before; ``unique_fails`` fails it alone; ``good_lost`` and ``toxic_lost`` are
    labelled rows removed here; ``shapley`` is the filter's removed rows over all orders: of the
    120 orders, a row with k failures is removed by each of its filters in 120 / k.
    """
    bit = [1 << FILTERS.index(f) for order in ORDERS for f in order]
    before = [sum(1 << FILTERS.index(f) for f in order[:step]) for order in ORDERS for step in range(len(FILTERS))]
    at = lambda values: F.element_at(F.lit(values), F.col("at") + 1)
    rows = counters.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(len(bit) - 1)))).withColumns({"bit": at(bit), "before": at(before)})
    mask = F.col("mask")
    fails, earlier = mask.bitwiseAND(F.col("bit")) != 0, mask.bitwiseAND(F.col("before")) != 0
    total = lambda when, value, name: F.sum(F.when(when, value).otherwise(0)).cast("bigint").alias(name)
    n = F.col("n")
    share = (n * F.expr(f"{len(ORDERS)} div greatest(bit_count(mask), 1)")).cast("bigint")
    summed = rows.groupBy("part", "at").agg(
        total(~fails & ~earlier, n, "kept"),
        total(fails & ~earlier, n, "removed"),
        total(fails & earlier, n, "redundant"),
        total(mask == F.col("bit"), n, "unique_fails"),
        total(fails & ~earlier, F.col("good"), "good_lost"),
        total(fails & ~earlier, F.col("toxic"), "toxic_lost"),
        total(fails, share, "shapley"),
    )
    order: Column = F.element_at(F.lit(ORDERS), F.expr(f"int(at div {len(FILTERS)}) + 1"))
    return summed.select("part", order.alias("filter_order"), (F.col("at") % len(FILTERS) + 1).cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """:func:`interactions` of ``docs``, whose labels are in ``labels`` (id_col, quality, toxic). No documents give no rows."""
    with scratch(docs.sparkSession):
        counters = kept(part_counters(failure_masks(docs, id_col, text_col, part_col), labels, id_col), "counters")
    return interactions(counters)
