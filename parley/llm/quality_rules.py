"""Quality rules whose thresholds adapt to each language and source.

A fixed base rule rejects very short and very repetitive texts. Beyond it, four rates are
held against fences that come from mergeable quantile sketches, one per (lang, source):
counts of log-linear buckets with 32 steps per power of two (relative error at most
1/32), which add up exactly, in any order. The fences are a low and a high quantile of the group's
own sketch, moved apart by a multiple of their distance. A group's quantiles are weighed against
its language's by its number of rows, and those against the whole corpus's, so small groups lean
on larger ones without a break at any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.llm import textvec as tv
from parley.llm.common import kept, materialize, packed, scratch, small_batches

SUB_BITS = 6
#: Rows that the coarser sketch counts for beside a group's own.
PRIOR = 100
#: metric: (scale, quantile, reach). Rates are integers in parts of scale. Fences lie reach times the distance of the quantiles p and 1 - p outside them.
#: Junk that a quarter of a group may be sets the first two apart from the rest; of repetition only the extreme hundredth counts.
METRICS = {"word_len": (1000, 0.75, 4.0), "symbol_rate": (1000, 0.75, 4.0), "dup_line_rate": (1000, 0.99, 1.0), "repeat_rate": (1000, 0.99, 1.0)}
#: Groups whose fences are broadcast; with more, fences are joined by shuffle with salted groups.
BROADCAST_GROUPS = 20_000
SALTS = 64

FEATURES = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,n_lines:bigint>"
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def text_features(texts: pa.Array) -> pa.Array:
    """The base counts of each text; a null text is empty."""
    cols: list[list[int]] = [[] for _ in range(6)]
    for _, _, data, off in tv.chunks(texts):
        inside = tv.NOT_SPACE[data]
        s, e = tv.spans(inside, off)
        first = np.searchsorted(s, off)
        n = np.diff(first)
        cols[0].extend(n.tolist())
        cols[1].extend(tv.per_text(inside & ((data & 0xC0) != 0x80), off).tolist())
        cols[2].extend(tv.per_text(SYMBOL[data], off).tolist())
        cols[4].extend(repeated_words(tv.span_hash(tv.prefix_hash(data), s, e), first).tolist())
        raw = data.tobytes()
        for d in range(len(off) - 1):
            lines = raw[off[d] : off[d + 1]].split(b"\n")
            cols[5].append(len(lines))
            if len(lines) == len(set(lines)):
                cols[3].append(0)
            else:
                real = [x for x in lines if x.strip()]
                cols[3].append(len(real) - len(set(real)))
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"])


def repeated_words(h: np.ndarray, first: np.ndarray, k: int = 3) -> np.ndarray:
    """Per text, the words inside k-word windows that stand twice or more in it."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(len(first) - 1, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = text[:n] == text[k - 1 :]
    at = np.flatnonzero(whole)
    g = tv.mix(tv.gram_hash(h, k)[at] + text[at].astype(np.uint64) * tv.BASE)
    order = np.argsort(g, kind="stable")
    sg = g[order]
    same = sg[1:] == sg[:-1]
    twice = np.zeros(len(sg), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = at[order[twice]]
    covered = np.zeros(len(h), bool)
    for o in range(k):
        covered[hit + o] = True
    return tv.per_text(covered, first)


def bucket(v: Column) -> Column:
    """Log-linear bucket of a count of at least 0: exact below 2**SUB_BITS, then half as many steps per power of two."""
    e = F.greatest(F.length(F.bin(v)) - SUB_BITS, F.lit(0))
    return F.when(v < 0, F.lit(0)).otherwise(e.cast("bigint") * (1 << (SUB_BITS - 1)) + F.call_function("shiftright", v, e))


def bucket_low(b: Column) -> Column:
    """Smallest value of a bucket."""
    half = 1 << (SUB_BITS - 1)
    e = F.greatest(F.floor(b / half) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", b - e.cast("bigint") * half, e)


def rates(f: str) -> dict[str, Column]:
    """Integer rates of a features struct, 0 for a text without words."""
    n, lines = F.greatest(F.col(f"{f}.n_words"), F.lit(1)), F.greatest(F.col(f"{f}.n_lines"), F.lit(1))
    part = {"word_len": (f"{f}.word_chars", n), "symbol_rate": (f"{f}.n_symbols", n), "dup_line_rate": (f"{f}.n_dup_lines", lines), "repeat_rate": (f"{f}.n_repeat_words", n)}
    return {k: F.call_function("div", F.lit(METRICS[k][0]).cast("bigint") * F.col(c), d) for k, (c, d) in part.items()}


def base_failed(f: str) -> Column:
    n, r = F.col(f"{f}.n_words"), F.col(f"{f}.n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n) of rows with lang, source and a column for each metric."""
    long = rows.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in METRICS])).alias("x"))
    return long.groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser groups: counts add up."""
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def _of_metric(i: int) -> Column:
    return F.create_map(*[x for m, v in METRICS.items() for x in (F.lit(m), F.lit(v[i]))])[F.col("metric")]


def quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, metric, rows, q_low, q_high) of each sketch: the metric's quantile on either side."""
    group = [*keys, "metric"]
    w = Window.partitionBy(*group).orderBy("bucket")
    cum = sketch.withColumn("upto", F.sum("n").over(w)).withColumn("rows", F.sum("n").over(Window.partitionBy(*group))).withColumn("p", _of_metric(1))
    at = lambda p: F.min(F.when(F.col("upto") >= p * F.col("rows"), F.col("bucket")))
    return cum.groupBy(*group).agg(F.first("rows").alias("rows"), bucket_low(at(1 - F.col("p"))).alias("q_low"), (bucket_low(at(F.col("p")) + 1) - 1).alias("q_high"))


def fences(rows: DataFrame) -> DataFrame:
    """(lang, source, fence: map metric -> (low, high)) for each (lang, source) present."""
    sketch = materialize(sketches(rows), "sketch")
    by_group, by_lang, by_all = quantiles(sketch, "lang", "source"), quantiles(merge(sketch, "lang"), "lang"), quantiles(merge(sketch))
    pick = by_group.alias("g").join(by_lang.alias("l"), F.col("g.lang").eqNullSafe(F.col("l.lang")) & (F.col("g.metric") == F.col("l.metric"))).join(F.broadcast(by_all.alias("a")), F.col("g.metric") == F.col("a.metric"))
    weigh = lambda own, n, other: (n * own + PRIOR * other) / (n + PRIOR)
    q = lambda c: weigh(F.col(f"g.{c}"), F.col("g.rows"), weigh(F.col(f"l.{c}"), F.col("l.rows"), F.col(f"a.{c}"))).alias(c)
    own = pick.select("g.lang", "g.source", F.col("g.metric").alias("metric"), q("q_low"), q("q_high")).withColumn("reach", _of_metric(2))
    room = F.col("reach") * (F.col("q_high") - F.col("q_low"))
    return own.select("lang", "source", "metric", (F.col("q_low") - room).alias("low"), (F.col("q_high") + room).alias("high")).groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("low", "high")))).alias("fence"))


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """All columns of ``docs`` and struct ``_quality``: the counts, base_failed, kept.

    A null or empty text has no words and one line, and fails the base rule. Null languages
    and sources are groups of their own. Rows are judged one by one, so repeated rows and ties
    are all judged alike; an empty table gives an empty result. Other columns are kept, not read; an
    input column ``_quality`` is replaced.
    """
    small_batches(docs.sparkSession)
    # Called nondeterministic, or filters on its result run it a second time, in a second Python worker for each core.
    features = F.arrow_udf(text_features, FEATURES).asNondeterministic()
    own = docs.select(packed(docs, "_quality"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), features(F.col(text_col).cast("string")).alias("_f"))
    scored = own.select("*", *[c.alias(m) for m, c in rates("_f").items()])
    with scratch(docs.sparkSession):
        fence = kept(fences(scored.where(~base_failed("_f")).select("lang", "source", *METRICS)), "fences")
    small = fence.count() <= BROADCAST_GROUPS
    salt = F.lit(0) if small else F.pmod(F.xxhash64("_f", "lang", "source"), F.lit(SALTS)).cast("int")
    fence = fence.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(0 if small else SALTS - 1))))
    fence = (F.broadcast(fence) if small else fence).alias("t")
    joined = scored.withColumn("_salt", salt).alias("s").join(fence, F.col("s.lang").eqNullSafe(F.col("t.lang")) & F.col("s.source").eqNullSafe(F.col("t.source")) & (F.col("s._salt") == F.col("t._salt")), "left")
    good = F.lit(True)
    for m in METRICS:
        good &= F.coalesce(F.col(f"s.{m}").between(F.col("t.fence")[m]["low"], F.col("t.fence")[m]["high"]), F.lit(True))
    bad = base_failed("s._f")
    return joined.select("s._row.*", F.struct("s._f.*", bad.alias("base_failed"), (~bad & good).alias("kept")).alias("_quality"))
