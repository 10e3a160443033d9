"""Exact self-join of texts by the similarity of their shingle sets (Jaccard, SIMILAR / OF = 0.8 or more).

Shingles are put in one order: those that a sample shows to be frequent come last, each part in
order of hashes. Two sets of similarity 0.8 share their first common shingle within the first fifth
of the larger set and the first ninth of the smaller one, so all such pairs meet where prefixes are
joined. There the sizes and the positions of the shared shingle bound the similarity from above, and
so do sketches of both sets; what remains is compared shingle by shingle. A shingle is its 64-bit XXH64.

Classes, not pairs, are wanted. So pairs that the caller proposes, by fingerprints as in
:mod:`parley.llm.simhash`, are compared first, and each text is with three that share one of its first
shingles, the same three for all texts that do, and then with its neighbours in order of size under each shingle of its
prefix; texts in one class by that need no more comparison, and the join makes pairs of
different classes only. Crowded keys are dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import bucketed, join_unique, materialize, partitions_for

SIMILAR, OF = 4, 5
#: Pairs that a task holds before it drops their repetitions.
HELD = 1 << 20
#: One text in this many is looked at for frequent shingles: those that OFTEN of them hold, MOST at most (8 bytes each in every task). Only the order depends on it.
SAMPLE, OFTEN, MOST = 16, 4, 200_000
#: Shingles of smallest hash under which a text is compared with a few centres before the join.
STARS = 4
#: Rounds in which each text is compared with those of other classes beside it under each of its first shingles, and how many places count as beside.
CHAINS, BESIDE = 2, 2
#: Texts under one key that one task compares.
CROWD = 4096


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted hashes of a text's different shingles of lower-case words; a text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([h(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    return np.unique(np.array([h(joined[a:b], 42) for a, b in zip(start[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True)], np.uint64))


def ordered(h: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """A sorted set with the ``frequent`` shingles (sorted) behind the others."""
    if not len(frequent) or not len(h):
        return h
    often = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h
    return np.concatenate([h[~often], h[often]])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets have similarity SIMILAR / OF or more; empty sets are alike."""
    low, high = sorted((len(a), len(b)))
    if OF * low < SIMILAR * high:
        return False
    return (SIMILAR + OF) * len(np.intersect1d(a, b, assume_unique=True)) >= SIMILAR * (len(a) + len(b))


def sketch(h: np.ndarray) -> bytes:
    """Parity of a set's hashes in each of at least as many cells, a power of two: sets whose sketches differ in d cells differ in d shingles or more."""
    cells = max(64, 1 << (len(h) - 1).bit_length()) if len(h) else 64
    odd = np.bincount((h & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(a: bytes, b: bytes, n: int) -> bool:
    """Whether the sketches of two sets, of ``n`` shingles together, let them be similar."""
    if len(a) < len(b):
        a, b = b, a
    x, y, cells = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(a)
    while cells > 8 * len(b):
        cells //= 2
        x = (x >> cells) ^ (x & ((1 << cells) - 1))
    return (SIMILAR + OF) * (x ^ y).bit_count() <= (OF - SIMILAR) * n


def prefix_length(n: np.ndarray | int, part: int, whole: int):
    """How many first shingles of ``n`` must hold one of any ``part / whole`` of them."""
    return n - (part * n + whole - 1) // whole + 1


def meetings(key: np.ndarray, node: np.ndarray, n: np.ndarray, pos: np.ndarray, label: np.ndarray, other_label: np.ndarray | None = None, beside: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(larger id, smaller id) of pairs of different labels under equal keys that sizes and positions let be similar; each at its first common shingle at least.

    Rows of equal ``other_label`` that are not negative are not paired either. With ``beside``, of
    rows in order of size only those at most so many places apart.
    """
    order = np.lexsort((n, key))
    key, node, n, pos, label = key[order], node[order], n[order], pos[order], label[order]
    block = np.full(len(key), -1, np.int64) if other_label is None else other_label[order]
    if not len(key):
        return
    # Keys under which all have one label make no pairs.
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    mixed = np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first)
    keep = np.repeat(mixed, np.diff(np.append(first, len(key))))
    key, node, n, pos, label, block = (x[keep] for x in (key, node, n, pos, label, block))
    at = np.flatnonzero(pos < prefix_length(n, 2 * SIMILAR, SIMILAR + OF))
    d = 0
    while len(at) and d != beside:
        d += 1
        at = at[at + d < len(key)]
        other = at + d
        at = at[(key[at] == key[other]) & (OF * n[at] >= SIMILAR * n[other])]
        other = at + d
        apart = pos[at] + pos[other] + np.abs((n[at] - pos[at]) - (n[other] - pos[other]))
        ok = ((SIMILAR + OF) * apart <= (OF - SIMILAR) * (n[at] + n[other])) & (label[at] != label[other]) & ((block[at] < 0) | (block[at] != block[other]))
        if ok.any():
            a, b = node[at[ok]], node[other[ok]]
            yield np.maximum(a, b), np.minimum(a, b)


def frequent_shingles(texts: DataFrame, shingle: int) -> np.ndarray:
    """The most frequent shingles of a sample of (rep, text), sorted."""

    def emit(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column("text")]
            if sets:
                h, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    some = texts.where(F.pmod(F.xxhash64("rep"), F.lit(SAMPLE)) == 0).select("text")
    counts = some.mapInArrow(emit, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    most = counts.orderBy(F.col("n").desc(), "h").limit(MOST).select("h").toArrow()["h"].to_numpy()
    return np.sort(most.view(np.uint64))


def shingle_sets(texts: DataFrame, shingle: int, buckets: int) -> DataFrame:
    """(rep, n, bits, first, prefix) of (rep, text), in buckets of rep: number of shingles, sketch, those of smallest hash, and the prefix in the common order."""
    held = texts.sparkSession.sparkContext.broadcast(frequent_shingles(texts, shingle))

    @F.arrow_udf("struct<n:int,bits:binary,first:array<bigint>,prefix:array<bigint>>")
    def sets(text: pa.Array) -> pa.Array:
        n, bits, first, prefix = [], [], [], []
        for x in text:
            h = shingle_set(x.as_py(), shingle)
            n.append(len(h))
            bits.append(sketch(h))
            first.append(h[:STARS].view(np.int64))
            prefix.append(ordered(h, held.value)[: int(prefix_length(len(h), SIMILAR, OF)) if len(h) else 0].view(np.int64))
        return pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(bits, pa.binary()), pa.array(first, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64()))], ["n", "bits", "first", "prefix"])

    return bucketed(texts.select("rep", sets("text").alias("s")).select("rep", "s.*"), buckets, "rep", "shingle_sets")


def stars(sets: DataFrame) -> DataFrame:
    """(u, v), u > v: each text and three that share one of its first shingles, the same for all of these: the smallest, and the first and last by hash."""
    # By hash alone, as an edited copy's rarest shingles are its own.
    rows = sets.select("rep", F.explode("first").alias("key"))
    by = F.xxhash64("rep")
    centres = F.array_distinct(F.array(F.min("rep"), F.min_by("rep", by), F.max_by("rep", by)))
    low = materialize(rows.groupBy("key").agg(centres.alias("centres"), F.count("*").alias("n")).where("n > 1"), "stars")
    met = join_unique(rows, low, "key", "n", "inner").select("rep", F.explode("centres").alias("centre")).where("rep != centre")
    return met.select(F.greatest("rep", "centre").alias("u"), F.least("rep", "centre").alias("v")).distinct()


def candidates(sets: DataFrame, roots: DataFrame, buckets: int, beside: int | None = None) -> DataFrame:
    """(u, v), u > v, of different classes in ``roots`` (node, root) that may be similar: every such pair that is, and few others.

    With ``beside``, only pairs that stand so close under a shingle in order of size.
    """

    def compare(batches):
        whole = lambda batch, name: batch.column(name).to_numpy(zero_copy_only=False)
        parts = [[whole(b, c).copy() for c in ("key", "salt", "node", "n", "pos", "label", "odd")] for b in batches]
        if not parts:
            return
        key, salt, node, n, pos, label, odd = (np.concatenate(x) for x in zip(*parts, strict=True))
        # Rows that stand in several parts of a crowded key are paired with each other in the first only.
        key = key + salt * np.int64(0x5851F42D4C957F2D)
        block = np.where(odd & (salt > 0), 0, -1).astype(np.int64)
        held, size = [], 0

        def distinct():
            pair = np.unique(np.concatenate(held, axis=1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[0])), pa.array(np.ascontiguousarray(pair[1]))], ["u", "v"])

        for u, v in meetings(key, node, n, pos, label, block, beside):
            held.append(np.stack([u, v]))
            size += len(u)
            if size >= HELD:
                yield distinct()
                held, size = [], 0
        if held:
            yield distinct()

    labelled = sets.join(roots, F.col("rep") == F.col("node"), "left").select("rep", F.col("n").cast("bigint").alias("n"), F.coalesce("root", "rep").alias("label"), "prefix")
    rows = labelled.select(F.col("rep").alias("node"), "n", "label", F.posexplode("prefix").alias("pos", "key")).withColumn("pos", F.col("pos").cast("bigint"))
    # Under a crowded key, as a sample shows it, the texts of the most frequent label are dealt out, and all others meet each part of them.
    some = labelled.where(F.pmod(F.xxhash64("rep"), F.lit(SAMPLE)) == 0).select(F.explode("prefix").alias("key"), "label").groupBy("key", "label").count()
    full = some.groupBy("key").agg(F.sum("count").alias("rows"), F.max_by("label", "count").alias("bulk")).where(F.col("rows") * SAMPLE > CROWD)
    full = materialize(full.select("key", "bulk", F.ceil(F.col("rows") * SAMPLE / CROWD).cast("bigint").alias("parts")), "crowded")
    if not full.isEmpty():
        rows = rows.join(F.broadcast(full), "key", "left")  # of prefix entries / CROWD keys at most
        own = F.col("parts").isNotNull() & (F.col("label") == F.col("bulk"))
        salts = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("bigint"))).when(own, F.array(F.pmod(F.xxhash64("node"), F.col("parts")))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
        rows = rows.select("key", "node", "n", "pos", "label", (F.col("parts").isNotNull() & ~own).alias("odd"), F.explode(salts).alias("salt"))
    else:
        rows = rows.select("key", "node", "n", "pos", "label", F.lit(False).alias("odd"), F.lit(0).cast("bigint").alias("salt"))
    return rows.repartition(buckets, "key", "salt").mapInArrow(compare, "u bigint, v bigint").distinct()


def sketched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) without those that sketches rule out."""

    @F.arrow_udf("boolean")
    def may(a: pa.Array, b: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([may_be_similar(*x) for x in zip(a.to_pylist(), b.to_pylist(), n.to_pylist(), strict=True)], pa.bool_())

    end = lambda c: sets.select(F.col("rep").alias(c), F.struct("n", "bits").alias(f"{c}_s"))
    return pairs.join(end("u"), "u").join(end("v"), "v").where(may("u_s.bits", "v_s.bits", F.col("u_s.n") + F.col("v_s.n"))).select("u", "v")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Those of (u, v) whose texts are similar."""

    @F.arrow_udf("boolean")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        out, last, of = [], None, None
        for x, y in zip(a, b, strict=True):
            y = y.as_py()
            if of is None or y != last:
                last, of = y, shingle_set(y, shingle)
            out.append(similar(shingle_set(x.as_py(), shingle), of))
        return pa.array(out, pa.bool_())

    end = lambda c: texts.select(F.col("rep").alias(c), F.col("text").alias(f"{c}_text"))
    return pairs.join(end("u"), "u").join(end("v"), "v").where(alike("u_text", "v_text")).select("u", "v")


def similar_pairs(texts: DataFrame, shingle: int, components, buckets: int, proposed: DataFrame) -> DataFrame:
    """(u, v) of one class, enough to connect each class of (rep, text), which are in ``buckets`` of rep; ``components`` as in :mod:`parley.llm.simhash`.

    Pairs (u, v), u > v, that are ``proposed`` and stars are compared first, then neighbours under each shingle, then each
    candidate of another class with its smallest partner. Pairs that these connect need no comparison, all others get one.
    """
    sets = shingle_sets(texts, shingle, buckets)
    known = materialize(verified(sketched(proposed.unionByName(stars(sets)).distinct(), sets), texts, shingle), "proposed-pairs")
    roots = components(known)
    # Each text and the root of its class say what pairs so far do, in fewer rounds when more are added.
    flat = lambda roots: roots.where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    # Texts that crowd under one shingle are often one class that neither fingerprints nor centres show; neighbours find most of it, in as many pairs as there are rows.
    for i in range(CHAINS):
        near = materialize(verified(sketched(candidates(sets, roots, buckets, BESIDE), sets), texts, shingle), f"chain-pairs-{i}")
        if near.isEmpty():
            break  # the next round would compare the same texts
        roots = components(flat(roots).unionByName(near))
    pairs = materialize(sketched(candidates(sets, roots, buckets), sets), "candidates")
    first = materialize(verified(pairs.groupBy("u").agg(F.min("v").alias("v")), texts, shingle), "first-pairs")
    root = roots if first.isEmpty() else components(flat(roots).unionByName(first))
    of = lambda c: root.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    rest = pairs.join(first, ["u", "v"], "left_anti").join(of("u"), "u", "left").join(of("v"), "v", "left")
    rest = rest.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")
    # Pairs compared in vain come again here; they are few.
    return flat(root).unionByName(materialize(verified(rest, texts, shingle), "more-pairs"))
