"""Benchmark decontamination by winnowed word-gram fingerprints.

Every run of ``GRAM + WINNOW - 1`` (10) consecutive words holds a window of ``WINNOW`` grams,
whose smallest hash is kept on either side; so a shared run of 10 words always shares a
kept fingerprint. Documents are probed against the benchmark's fingerprints, and each hit is
extended over equal words on its diagonal to the whole shared run.

A benchmark of at most ``BLOCK_WORDS`` words (counted first) is sent to every task, so documents are
read once and nothing is shuffled. A larger one is joined: fingerprints of both sides are rows,
documents that share one are read again, and their windows around it are joined with the
benchmark's. Words are compared by their 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import textvec as tv
from parley.llm.common import join_unique, materialize, packed, partitions_for, small_batches

GRAM, WINNOW = 5, 6
WINDOW = GRAM + WINNOW - 1
#: Benchmark words that one task holds at a time (about 40 bytes each).
BLOCK_WORDS = 2_000_000


def winnow(h: np.ndarray, w: int = WINNOW) -> np.ndarray:
    """Positions of the rightmost smallest hash of each window of ``w`` grams."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = h[:n].copy()
    for o in range(1, w):
        np.minimum(low, h[o : o + n], out=low)
    keep = np.zeros(len(h), bool)
    undecided = np.ones(n, bool)
    for o in range(w - 1, -1, -1):
        hit = undecided & (h[o : o + n] == low)
        keep[np.flatnonzero(hit) + o] = True
        undecided &= ~hit
    return np.flatnonzero(keep)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of a chunk, and the first word of each text."""
    low = tv.LOWER[data]
    s, e = tv.spans(tv.ALNUM[low], off)
    return tv.span_hash(tv.prefix_hash(low), s, e), np.searchsorted(s, off)


class Fingerprints:
    """A block of benchmark items: word hashes, winnowed grams, and whole short items by length."""

    def __init__(self, items: list[tuple[str | None, str]]):
        self.ids = [i for i, _ in items]
        hashes, first, n = [], [0], 0
        for _, _, data, off in tv.chunks(pa.array([t for _, t in items], pa.string())):
            h, at = words(data, off)
            hashes.append(h)
            first.extend(at[1:] + n)
            n += len(h)
        self.h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.first = np.array(first, np.int64)
        size = np.diff(self.first)
        keys, pos = [], []
        for i in np.flatnonzero(size >= WINDOW):
            own = tv.gram_hash(self.h[self.first[i] : self.first[i + 1]], GRAM)
            at = winnow(own)
            keys.append(own[at])
            pos.append(at + self.first[i])
        self.key, self.pos = self._sorted(keys, pos)
        self.short = {}
        for n in np.unique(size[(size > 0) & (size < WINDOW)]):
            at = self.first[:-1][size == n]
            own = [tv.gram_hash(self.h[p : p + n], int(n)) for p in at]
            self.short[int(n)] = self._sorted(own, [np.array([p]) for p in at])

    @staticmethod
    def _sorted(keys: list[np.ndarray], pos: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if not keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        k, p = np.concatenate(keys), np.concatenate(pos)
        order = np.argsort(k, kind="stable")
        return k[order], p[order]

    def hits(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, first word, end word, item) of each shared run in a chunk; word numbers count in the chunk."""
        found = self._long(h, first)
        for n, (key, pos) in self.short.items():
            g = tv.gram_hash(h, n)
            for i in tv.lookup(np.unique(key), g):
                d = int(np.searchsorted(first, i, "right")) - 1
                if i + n > first[d + 1]:
                    continue
                lo, hi = np.searchsorted(key, g[i], "left"), np.searchsorted(key, g[i], "right")
                for p in pos[lo:hi]:
                    if np.array_equal(h[i : i + n], self.h[p : p + n]):
                        found.append((d, int(i), int(i) + n, self._item(p)))
        return found

    def _item(self, p: int) -> int:
        return int(np.searchsorted(self.first, p, "right")) - 1

    def _long(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        g = tv.gram_hash(h, GRAM)
        at = winnow(g)
        at = at[tv.lookup(np.unique(self.key), g[at])]
        found, reach = [], {}
        for i in at:
            d = int(np.searchsorted(first, i, "right")) - 1
            lo, hi = np.searchsorted(self.key, g[i], "left"), np.searchsorted(self.key, g[i], "right")
            for p in self.pos[lo:hi]:
                item, key = self._item(p), (d, int(p) - int(i))
                if reach.get(key, -1) > i:
                    continue
                back = min(i - first[d], p - self.first[item])
                fore = min(first[d + 1] - i, self.first[item + 1] - p)
                if fore < 0 or not back + fore:
                    continue
                same = h[i : i + fore] == self.h[p : p + fore]
                b = i + (fore if same.all() else int(np.argmin(same)))
                same = (h[i - back : i] == self.h[p - back : p])[::-1]
                a = i - (back if same.all() else int(np.argmin(same)))
                reach[key] = int(b)
                if b - a >= WINDOW:
                    found.append((d, int(a), int(b), item))
        return found


def _tables(batches, pick):
    """Of (key, text) batches: what ``pick(word hashes)`` has of each text, as rows with the key."""
    for batch in batches:
        keys = batch.column(0)
        for lo, _, data, off in tv.chunks(batch.column(1)):
            h, first = words(data, off)
            for d in range(len(off) - 1):
                cols = pick(h[first[d] : first[d + 1]])
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays([pa.array([keys[lo + d].as_py()] * len(cols[0]), keys.type), *[pa.array(c) for c in cols]], ["key", *[f"c{i}" for i in range(len(cols))]])


def _prints(h: np.ndarray, short: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(words, hash) of a text's different fingerprints: winnowed grams (0 words), and all runs of each length in ``short``."""
    g = tv.gram_hash(h, GRAM)
    own = [(0, g[winnow(g)])] + [(n, tv.gram_hash(h, n)) for n in short]
    every = [(n, np.unique(x)) for n, x in own]
    return np.concatenate([np.full(len(x), n, np.int64) for n, x in every]), np.concatenate([x for _, x in every]).view(np.int64)


def _windows(h: np.ndarray, hits: list[dict]) -> list[dict]:
    """Windows of a text that hold one of the fingerprints ``hits``: words, start, hash."""
    out = []
    for n in {x["n"] for x in hits}:
        wanted = np.unique(np.array([x["fp"] for x in hits if x["n"] == n], np.int64).view(np.uint64))
        g = tv.gram_hash(h, n or GRAM)
        at = tv.lookup(wanted, g)
        if not n:  # each window of ten words around a gram
            kept = winnow(g)
            at = np.intersect1d(at, kept)
            at = np.unique((at[:, None] - np.arange(WINNOW)[None, :]).ravel())
            at = at[(at >= 0) & (at + WINDOW <= len(h))]
            g = tv.gram_hash(h, WINDOW)
        out += [{"n": n or WINDOW, "start": int(i), "g": int(g[i].view(np.int64))} for i in at]
    return out


def joined_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, spans: starts and ends in turn, items, nameless) of (key, text) that share a window with (item, text), by joins only."""
    spark = docs.sparkSession

    def item_windows(batches):
        def pick(h):
            n = min(len(h), WINDOW)
            g = np.unique(tv.gram_hash(h, n)) if n else np.zeros(0, np.uint64)
            return np.full(len(g), n, np.int64), g.view(np.int64)

        yield from _tables(batches, pick)

    windows = materialize(items.mapInArrow(item_windows, "key string, c0 bigint, c1 bigint").select(F.col("key").alias("item"), F.col("c0").alias("n"), F.col("c1").alias("g")).distinct(), "item-windows")
    short = [r[0] for r in windows.where(F.col("n") < WINDOW).select("n").distinct().collect()]  # fewer than ten numbers

    def item_prints(batches):
        yield from _tables(batches, lambda h: _prints(h, []) if len(h) >= WINDOW else (np.full(1, len(h), np.int64), tv.gram_hash(h, len(h)).view(np.int64)) if len(h) else (np.zeros(0, np.int64),) * 2)

    def doc_prints(batches):
        yield from _tables(batches, lambda h: _prints(h, short))

    of = lambda rows, f: rows.mapInArrow(f, "key string, c0 bigint, c1 bigint").select("key", F.col("c0").alias("n"), F.col("c1").alias("fp"))
    known = materialize(of(items, item_prints).select("n", "fp").distinct(), "item-prints")
    hits = of(docs, doc_prints).join(known, ["n", "fp"], "left_semi").groupBy("key").agg(F.collect_set(F.struct("n", "fp")).alias("hits"))
    texts = docs.join(materialize(hits, "hits"), "key").groupBy("key").agg(F.first("text").alias("text"), F.first("hits").alias("hits"))

    @F.arrow_udf("array<struct<n:bigint,start:bigint,g:bigint>>")
    def around(texts: pa.Array, hits: pa.Array) -> pa.Array:
        out = []
        for lo, _, data, off in tv.chunks(texts):
            h, first = words(data, off)
            out += [_windows(h[first[d] : first[d + 1]], hits[lo + d].as_py()) for d in range(len(off) - 1)]
        return pa.array(out, pa.list_(pa.struct([("n", pa.int64()), ("start", pa.int64()), ("g", pa.int64())])))

    own = texts.select("key", F.explode(around("text", "hits")).alias("w")).select("key", "w.*")
    found = own.join(windows, ["n", "g"]).groupBy("key").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("stop"))).alias("runs"), F.collect_set("item").alias("items"), F.max(F.col("item").isNull()).alias("nameless"))

    @F.arrow_udf("array<bigint>")
    def union(x: pa.Array) -> pa.Array:
        return pa.array([merged([(r["start"], r["stop"]) for r in v]) for v in x.to_pylist()], pa.list_(pa.int64()))

    return found.select("key", union("runs").alias("spans"), F.array_sort("items").alias("items"), "nameless")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """All columns of ``docs`` and, in struct ``_contamination``: n_words, n_hit, n_items, items (sorted ids), contaminated.

    Words are runs of ASCII letters and digits (A-Z lowered) and of non-ASCII characters. A null
    or empty text has no words and no hits, nor has a benchmark row of such a text. Rows of one item_id
    are one item in ``n_items``; those without an id count as one item that ``items`` does not name.
    Repeated documents are judged alike, row by row; an empty benchmark hits nothing. Other columns
    of ``docs`` are kept and not read; an input column ``_contamination`` is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    words_at_most = F.coalesce(F.sum(F.call_function("div", F.length("text"), F.lit(2)) + 1), F.lit(0))  # a word and its separator have two characters at least
    rows = docs.select(packed(docs, "_contamination"), F.col(text_col).cast("string").alias("_t"))
    if items.agg(words_at_most).first()[0] <= block_words:
        held = spark.sparkContext.broadcast(Fingerprints([(r.item, r.text) for r in items.toLocalIterator()]))

        @F.arrow_udf("struct<n_words:bigint,spans:array<bigint>,items:array<string>,nameless:boolean>")
        def judge(texts: pa.Array) -> pa.Array:
            fp, n_words, runs, names, nameless = held.value, [], [], [], []
            for _, _, data, off in tv.chunks(texts):
                h, first = words(data, off)
                n_words.extend(np.diff(first).tolist())
                own: list[list[tuple[int, int, int]]] = [[] for _ in range(len(off) - 1)]
                for d, a, b, item in fp.hits(h, first):
                    own[d].append((a - int(first[d]), b - int(first[d]), item))
                for x in own:
                    ids = {fp.ids[i] for _, _, i in x}
                    runs.append(merged([(a, b) for a, b, _ in x]))
                    nameless.append(None in ids)
                    names.append(sorted(ids - {None}))
            return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string())), pa.array(nameless, pa.bool_())], ["n_words", "spans", "items", "nameless"])

        base = rows.select("_row", judge("_t").alias("_j"))
    else:

        @F.arrow_udf("bigint")
        def count(texts: pa.Array) -> pa.Array:
            return pa.array([n for _, _, data, off in tv.chunks(texts) for n in np.diff(words(data, off)[1]).tolist()], pa.int64())

        keyed = rows.withColumn("key", F.concat(F.md5("_t"), F.hex(F.xxhash64("_t"))))
        sizes = keyed.groupBy("key").agg(F.count("*").alias("n"))
        found = materialize(joined_hits(keyed.where("key is not null").select("key", F.col("_t").alias("text")), items.repartition(partitions_for(spark, 0))).join(sizes, "key"), "contaminated")
        none = lambda kind: F.array().cast(f"array<{kind}>")
        base = join_unique(keyed, found, "key", "n").select("_row", F.struct(count("_t").alias("n_words"), F.coalesce("spans", none("bigint")).alias("spans"), F.coalesce("items", none("string")).alias("items"), F.coalesce("nameless", F.lit(False)).alias("nameless")).alias("_j"))
    n_hit = F.aggregate("_j.spans", F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-1).cast("bigint").alias("sign")), lambda acc, x: F.struct((acc.sum + acc.sign * x).alias("sum"), (-acc.sign).alias("sign")), lambda acc: acc.sum)
    n_items = F.size("_j.items").cast("bigint") + F.col("_j.nameless").cast("bigint")
    return base.select("_row.*", F.struct(F.col("_j.n_words").alias("n_words"), n_hit.alias("n_hit"), n_items.alias("n_items"), F.col("_j.items").alias("items"), (n_items > 0).alias("contaminated")).alias("_contamination"))


def merged(runs: list[tuple[int, int]]) -> list[int]:
    """Starts and ends, in turn, of the union of ``runs``."""
    out: list[int] = []
    for a, b in sorted(runs):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out
