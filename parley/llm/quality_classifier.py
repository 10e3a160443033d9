"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of features x is sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the
pairwise sum is taken in linear time as half of sum_f (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2.
It is fitted on the driver on at most ``MAX_ROWS`` labelled rows, those with the smallest hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import textvec as tv
from parley.llm.common import packed, small_batches
from parley.llm.quality_rules import SYMBOL, repeated_words

#: Labelled rows that a fit takes at most.
MAX_ROWS = 6000
WORD_BITS = 12
WORDS = 1 << WORD_BITS
RANK = 8
#: Steps that each statistic is cut to; a statistic gives one indicator for its step, and its own standardised value.
STEPS = 8
STATISTICS = ("log_words", "word_chars", "symbols", "upper", "digits", "marks", "bars", "lines", "repeated", "distinct", "non_ascii")
UPPER, DIGIT, MARK, BAR = (np.zeros(256, bool) for _ in range(4))
UPPER[0x41:0x5B] = True
DIGIT[0x30:0x3A] = True
MARK[[0x21, 0x3F, 0x2E, 0x2C]] = True
BAR[0x7C] = True


def statistics(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics of each text of a chunk, word buckets, and the first word of each text."""
    inside = tv.NOT_SPACE[data]
    s, e = tv.spans(inside, off)
    first = np.searchsorted(s, off)
    n = np.maximum(np.diff(first), 1).astype(float)
    chars = tv.per_text((data & 0xC0) != 0x80, off)
    h = tv.span_hash(tv.prefix_hash(tv.LOWER[data]), s, e)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    once = np.unique(tv.mix(h + text.astype(np.uint64) * tv.BASE), return_index=True)[1]
    distinct = np.bincount(text[once], minlength=len(off) - 1)
    per_char = np.maximum(chars, 1).astype(float)
    cols = [
        np.log1p(np.diff(first)),
        tv.per_text(inside & ((data & 0xC0) != 0x80), off) / n,
        tv.per_text(SYMBOL[data], off) / n,
        tv.per_text(UPPER[data], off) / per_char,
        tv.per_text(DIGIT[data], off) / per_char,
        tv.per_text(MARK[data], off) / n,
        tv.per_text(BAR[data], off) / n,
        tv.per_text(data == 0x0A, off) / n,
        repeated_words(h, first) / n,
        distinct / n,
        tv.per_text(data >= 0xC0, off) / per_char,
    ]
    return np.stack(cols, 1), (h >> np.uint64(64 - WORD_BITS)).astype(np.int64), text


def chunk_features(data: np.ndarray, off: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(statistics with metadata, text of each word feature, bucket, value); values of a text have norm 1."""
    stats, bucket, text = statistics(data, off)
    key, n = np.unique(text * WORDS + bucket, return_counts=True)
    value = np.log1p(n)
    text = key >> WORD_BITS
    norm = np.sqrt(np.bincount(text, value * value, minlength=len(off) - 1))
    return np.concatenate([stats, meta], 1), text, key & (WORDS - 1), value / np.maximum(norm, 1e-12)[text]


class Machine:
    """Weights and what turns statistics into features."""

    def __init__(self, stats: np.ndarray):
        m = stats.shape[1]
        self.mean = stats.mean(0) if len(stats) else np.zeros(m)
        self.std = stats.std(0) + 1e-9 if len(stats) else np.ones(m)
        q = np.linspace(0, 1, STEPS + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(stats[:, j], q)) if len(stats) else np.zeros(1) for j in range(m)]
        self.size = WORDS + m * (STEPS + 1)
        rng = np.random.default_rng(7)
        self.w0, self.w, self.v = 0.0, np.zeros(self.size), rng.normal(0, 0.02, (self.size, RANK))

    def rows(self, stats: np.ndarray, text: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All features as (text, index, value), sorted by text."""
        n, m = stats.shape
        z = np.clip((stats - self.mean) / self.std, -4, 4) / 4
        step = np.stack([np.searchsorted(self.cuts[j], stats[:, j], "right") for j in range(m)], 1)
        at = WORDS + np.arange(m) * (STEPS + 1)
        t = np.concatenate([text, np.repeat(np.arange(n), 2 * m)])
        i = np.concatenate([index, np.concatenate([at + step, np.broadcast_to(at + STEPS, step.shape)], 1).ravel()])
        x = np.concatenate([value, np.concatenate([np.full(z.shape, 0.3), z], 1).ravel()])
        order = np.argsort(t, kind="stable")
        return t[order], i[order], x[order]

    def forward(self, first: np.ndarray, i: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Margins, and the sums of v x that gradients need; each text has at least one feature."""
        vx = self.v[i] * x[:, None]
        total = np.add.reduceat(vx, first, axis=0)
        square = np.add.reduceat(vx * vx, first, axis=0)
        return self.w0 + np.add.reduceat(self.w[i] * x, first) + 0.5 * (total * total - square).sum(1), total, vx

    def score(self, stats: np.ndarray, text: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        if not len(stats):
            return np.zeros(0)
        t, i, x = self.rows(stats, text, index, value)
        return 1 / (1 + np.exp(-np.clip(self.forward(np.searchsorted(t, np.arange(len(stats))), i, x)[0], -30, 30)))

    def fit(self, stats: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 15, batch: int = 128, rate: float = 0.1, decay: float = 1e-4) -> None:
        """AdaGrad on the logistic loss, in a fixed random order."""
        rng = np.random.default_rng(11)
        g0, gw, gv = 1e-8, np.full(self.size, 1e-8), np.full((self.size, RANK), 1e-8)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), batch):
                own = order[lo : lo + batch]
                n = np.array([len(words[r][0]) for r in own])
                t, i, x = self.rows(stats[own], np.repeat(np.arange(len(own)), n), np.concatenate([words[r][0] for r in own]), np.concatenate([words[r][1] for r in own]))
                margin, total, vx = self.forward(np.searchsorted(t, np.arange(len(own))), i, x)
                d = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[own]) / len(own)
                dx = d[t] * x
                dv = dx[:, None] * (total[t] - vx)
                used, back = np.unique(i, return_inverse=True)
                grad = np.bincount(back, dx) + decay * self.w[used]
                gw[used] += grad * grad
                self.w[used] -= rate * grad / np.sqrt(gw[used])
                full = np.stack([np.bincount(back, dv[:, f]) for f in range(RANK)], 1) + decay * self.v[used]
                gv[used] += full * full
                self.v[used] -= rate * full / np.sqrt(gv[used])
                g0 += d.sum() ** 2
                self.w0 -= rate * d.sum() / np.sqrt(g0)


def held_out(id_col: Column) -> Column:
    """Rows that labels are never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _meta(cols: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))), F.lit(0.0)) for c in cols]) if cols else F.array().cast("array<double>")


def _meta_rows(meta: pa.Array, width: int) -> np.ndarray:
    return np.array(meta.to_pylist(), float).reshape(len(meta), width)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, meta_cols: Sequence[str], max_rows: int = MAX_ROWS) -> Machine:
    """Fit on labelled rows that are not held out: the ``max_rows`` of smallest hash, fetched as features."""
    width = len(meta_cols)

    @F.arrow_udf("struct<stats:array<double>,index:array<int>,value:array<float>>")
    def features(texts: pa.Array, meta: pa.Array) -> pa.Array:
        every, stats, index, value = _meta_rows(meta, width), [], [], []
        for lo, hi, data, off in tv.chunks(texts):
            s, t, i, x = chunk_features(data, off, every[lo:hi])
            cut = np.searchsorted(t, np.arange(hi - lo + 1))
            stats += s.tolist()
            index += [i[a:b] for a, b in zip(cut, cut[1:], strict=False)]
            value += [x[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        return pa.StructArray.from_arrays([pa.array(stats, pa.list_(pa.float64())), pa.array([x.astype(np.int32) for x in index], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for x in value], pa.list_(pa.float32()))], ["stats", "index", "value"])

    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col)).cast("double").alias("_y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    # Of rows that repeat an id one is learnt from, so that max_rows bounds what the driver gets.
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"), _meta(meta_cols).alias("_m")).join(F.broadcast(chosen), "_id")
    one = F.min_by(F.struct("_t", "_m"), F.struct(F.xxhash64("_t"), "_m"))
    own = own.groupBy("_id", "_y").agg(one.alias("_r")).select("_id", "_y", "_r.*")
    rows = own.select("_id", "_y", F.xxhash64("_t").alias("_h"), features("_t", "_m").alias("f")).select("_id", "_h", "_y", "f.*").toArrow().sort_by([("_id", "ascending"), ("_h", "ascending")])
    stats = np.array(rows["stats"].to_pylist(), float).reshape(len(rows), len(STATISTICS) + width)
    model = Machine(stats)
    words = [(np.asarray(i.values), np.asarray(x.values)) for i, x in zip(rows["index"], rows["value"], strict=True)]
    if not len(rows):
        model.v[:] = 0.0
    else:
        model.fit(stats, words, rows["_y"].to_numpy())
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_cols: Sequence[str] = (), threshold: float = 0.7, max_rows: int = MAX_ROWS) -> DataFrame:
    """All columns of ``docs`` and struct ``_score``: held_out, score, predicted.

    Labels, ids and whatever is not named in ``meta_cols`` never enter a score. A null text is an
    empty one and scored like it; null metadata count as 0; a null id is not held out; null labels
    and labels of null ids are ignored, of repeated labels the largest holds. Repeated rows score
    alike. Without labels every score is 0.5. An empty table gives an empty result. Other columns are
    kept and not read; an input column ``_score`` is replaced.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, meta_cols, max_rows))
    width = len(meta_cols)

    @F.arrow_udf("double")
    def score(texts: pa.Array, meta: pa.Array) -> pa.Array:
        every, out = _meta_rows(meta, width), [np.zeros(0)]
        for lo, hi, data, off in tv.chunks(texts):
            out.append(model.value.score(*chunk_features(data, off, every[lo:hi])))
        return pa.array(np.concatenate(out), pa.float64())

    scored = docs.select(packed(docs, "_score"), F.col(id_col).alias("_id"), score(F.col(text_col).cast("string"), _meta(meta_cols)).alias("_s"))
    return scored.select("_row.*", F.struct(held_out(F.col("_id")).alias("held_out"), F.col("_s").alias("score"), F.when(F.col("_s") >= threshold, 1).otherwise(0).alias("predicted")).alias("_score"))
