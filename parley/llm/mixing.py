"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its shuffled documents, gone through up to ``MAX_EPOCHS`` times and
served in quanta of at most ``QUANTUM`` words, so that a long document does not hold the others
up. A quantum's virtual finish time is its source's words up to its end divided by the source's
weight. All quanta of all sources are sorted by it, range by range, and the order is cut where
the budget is used up; the quantum at the cut is taken in part. A source that runs out leaves its
share to the others, as its quanta end before the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.llm.common import kept, materialize, packed, partitions_for, range_sums, scratch, shuffle_partitions

MAX_EPOCHS = 2
#: Words of a queue that are served at once.
QUANTUM = 256
#: Rows that one slice of a source's shuffle order aims at.
SLICE_ROWS = 4000
#: Bytes of a quantum's row in the shuffle.
ROW_BYTES = 48


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def weighted(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """``sizes`` with each source's place by code point, null last, and its weight; weights repeat."""
    order = [F.col("source").isNull(), F.col("source")]
    placed = range_sums(sizes.withColumn("one", F.lit(1).cast("bigint")), order, ["one"], shuffle_partitions(sizes.sparkSession))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("before_one") % len(weights)).cast("int") + 1)
    return placed.select("source", "source_size", F.col("before_one").alias("place"), w.alias("weight"))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float) -> DataFrame:
    """(source, source_size, place, weight, target) of (source, source_size): what fair queueing gives each source in the end.

    Sources stop at MAX_EPOCHS times their size in the order of size / weight; the first k having
    stopped, the others' common time is (budget - stopped) / weight left, and the right k is the
    first at which the next source does not stop.
    """
    one = materialize(weighted(sizes, weights).withColumn("cap", MAX_EPOCHS * F.col("source_size")), "sources")
    total, weight = one.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    run = range_sums(one, [F.col("cap") / F.col("weight"), F.col("place")], ["cap", "weight"], shuffle_partitions(sizes.sparkSession))
    time = (F.lit(total * share) - F.col("before_cap")) / (F.lit(weight) - F.col("before_weight"))
    stop = F.col("cap") / F.col("weight")
    first = run.where(time <= stop).agg(F.min(F.struct(stop.alias("stop"), "place", time.alias("time")))).first()[0]
    target = F.col("cap").cast("double")
    if first is not None:
        target = F.least(target, F.col("weight") * F.lit(first["time"]))
    return one.select("source", "source_size", "place", "weight", target.alias("target"))


def served(light: DataFrame, budget: int, quantum: int) -> DataFrame:
    """(place, words): words of each source that the cut queue serves, from rows (place, weight, source_size, start, size)."""
    spark = light.sparkSession
    end = F.col("start") + F.col("size")
    stops = F.transform(F.sequence(F.lit(1), F.ceil(F.col("size") / quantum)), lambda i: F.least(end, F.col("start") + i * quantum))
    pieces = light.where("size > 0").select("place", "weight", "source_size", "start", F.posexplode(stops).alias("i", "stop"))
    pieces = pieces.select("place", "weight", "source_size", "stop", (F.col("stop") - F.col("start") - F.col("i") * quantum).alias("n"))
    epoch = F.explode(F.sequence(F.lit(0), F.lit(MAX_EPOCHS - 1)))
    queue = pieces.withColumn("epoch", epoch).select("place", "n", ((F.col("stop") + F.col("epoch") * F.col("source_size")) / F.col("weight")).alias("finish"), "epoch", "stop")
    words = light.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    n = partitions_for(spark, MAX_EPOCHS * ROW_BYTES * (words[0] // quantum + words[1]))
    sums = range_sums(queue, ["finish", "place", "epoch", "stop"], ["n"], n)
    return sums.groupBy("place").agg(F.sum(F.greatest(F.lit(0), F.least(F.col("n"), F.lit(budget) - F.col("before_n")))).alias("words"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, seed: str = "mix", quantum: int = QUANTUM) -> DataFrame:
    """All columns of ``docs`` and struct ``_mix``: size, source_size, target, finish, taken.

    ``size`` counts a text's words (null: 0); ``target`` is the source's share; ``taken`` the words
    that the mix takes of the document, repeats counted (at most MAX_EPOCHS times its size); ``finish``
    its first virtual finish time. Each source gets its target but for a few quanta. Null is a source of
    its own, the last. The shuffle is a hash of id and text, so reruns agree whatever the order of
    rows; rows equal in both stand side by side in it and are each taken on their own, and which of
    them the cut hits does not show. An empty table, or one without words, takes nothing. Other
    columns are kept and not read; an input column ``_mix`` is replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    turn = F.md5(F.concat_ws("/", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(seed), text))
    rows = docs.select(packed(docs, "_mix"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), turn.alias("turn"))
    with scratch(docs.sparkSession):
        light = materialize(rows.select("source", "size", "turn"), "sizes")
        target = materialize(targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share), "targets")
        n_rows, total = light.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        depth = max(0, min(8, -(-((n_rows // SLICE_ROWS).bit_length()) // 4)))
        # Within a source rows follow each other by turn; a slice is what turns of one beginning have.
        slices = light.groupBy("source", F.substring("turn", 1, depth).alias("slice")).agg(F.sum("size").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        start = slices.select("source", "slice", before.alias("slice_start"))
        plan = start.alias("a").join(target.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "slice", "slice_start", "source_size", "place", "weight", "target")
        plan = materialize(plan, "slices").alias("p")
        within = Window.partitionBy("source", "slice").orderBy("turn", "size").rowsBetween(Window.unboundedPreceding, -1)
        own = light.withColumn("slice", F.substring("turn", 1, depth)).withColumn("cum", F.coalesce(F.sum("size").over(within), F.lit(0))).alias("r")
        both = own.join(plan, F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.slice") == F.col("p.slice")))
        got = materialize(served(both.select("place", "weight", "source_size", (F.col("slice_start") + F.col("cum")).alias("start"), "size"), int(total * share), quantum), "served")
        done = kept(plan.join(got, "place", "left").select("p.source", "p.slice", "slice_start", "source_size", "weight", "target", F.coalesce("words", F.lit(0)).alias("words")), "plan").alias("q")
    placed = rows.withColumn("slice", F.substring("turn", 1, depth)).withColumn("cum", F.coalesce(F.sum("size").over(within), F.lit(0))).alias("r")
    out = placed.join(done, F.col("r.source").eqNullSafe(F.col("q.source")) & (F.col("r.slice") == F.col("q.slice")))
    first = F.col("slice_start") + F.col("cum")
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - first - e * F.col("source_size"))) for e in range(MAX_EPOCHS)), F.lit(0))
    return out.select("r._row.*", F.struct("size", "source_size", "target", ((first + F.col("size")) / F.col("weight")).alias("finish"), taken.cast("bigint").alias("taken")).alias("_mix"))
