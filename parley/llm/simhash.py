"""SimHash near-duplicates with pigeonring candidate filtering.

Two 64-bit fingerprints link at ``RADIUS`` (4) or fewer differing bits. The bits are dealt to
five segments on a ring. If a pair differs in at most 4 bits, some segment starts a chain
whose first l segments differ in at most floor(4 l / 5) bits, for every l: the first is equal
and the second differs in at most one bit. That two-segment prefix is the index key (26 bits):
each fingerprint resides under its own five keys, and one with an odd second segment also
visits the keys one bit flip away, so every such pair meets exactly where its chain starts.
Inside a key the chain's longer budgets prune before the last, whole-ring check.

Equal fingerprints are one node throughout, so copies never make pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import textvec as tv
from parley.llm.common import bucketed, join_unique, kept, materialize, partitions_for, scratch, small_batches
from parley.llm.shingle_join import similar_pairs

RADIUS = 4
WIDTHS = (13, 13, 13, 13, 12)
STARTS = (0, 13, 26, 39, 52)
RING = len(WIDTHS)
BUDGET = tuple(l * RADIUS // RING for l in range(1, RING + 1))
#: Fingerprints under one key that are compared directly; beyond it, ball points are used.
DIRECT = 16384
SMALL = 16


def fingerprint(words: list[bytes], shingle: int) -> list[int]:
    """XXH64 (seed 42) of each shingle of space-joined words."""
    n = len(words)
    if not n:
        return []
    joined = b" ".join(words)
    if n <= shingle:
        return [xxhash.xxh64_intdigest(joined, 42)]
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    start = end - size
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b], 42) for a, b in zip(start[: n - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True)]


def simhashes(texts: pa.Array, shingle: int, tables: int = 1) -> np.ndarray:
    """Fingerprints of each text, one for each table; those after the first mix the same hashes anew."""
    out = np.zeros((len(texts), tables), np.uint64)
    for lo, hi, data, off in tv.chunks(texts, tv.CHUNK_BYTES // 2):
        raw = data.tobytes().lower()
        hashes, n = [], []
        for d in range(hi - lo):
            own = fingerprint(raw[off[d] : off[d + 1]].split(), shingle)
            hashes.append(np.array(own, np.uint64))
            n.append(len(own))
        n = np.array(n)
        full = np.flatnonzero(n)
        if not len(full):
            continue
        h = np.concatenate(hashes)
        at = np.concatenate([[0], np.cumsum(n[full])[:-1]])
        for t in range(tables):
            g = h if t == 0 else tv.mix(h + np.uint64(t) * np.uint64(0xD6E8FEB86659FD93 >> 4))
            bits = np.unpackbits(g.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
            most = (2 * ones > n[full][:, None]).astype(np.uint8)
            out[lo + full, t] = np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()
    return out


def with_fingerprints(docs: DataFrame, text_col: str, shingle: int, out: str, tables: int = 1) -> DataFrame:
    """``docs`` with an array of fingerprints."""

    @F.arrow_udf("array<bigint>")
    def simhash(texts: pa.Array) -> pa.Array:
        flat = simhashes(texts, shingle, tables).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * tables), pa.array(flat.ravel()))

    return docs.withColumn(out, simhash(F.col(text_col).cast("string")))


def segment(fp: np.ndarray, i: int) -> np.ndarray:
    i %= RING
    return (fp >> np.uint64(STARTS[i])) & np.uint64((1 << WIDTHS[i]) - 1)


def index_rows(fp: np.ndarray, table: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(keys, fingerprints, resident) for each chain start; keys name table and start above the two segments."""
    for i in range(RING):
        a, b = segment(fp, i), segment(fp, i + 1)
        head = np.uint64((table * RING + i) << 26) | (a << np.uint64(13))
        yield head | b, fp, True
        odd = (np.bitwise_count(b) & 1) == 1
        for bit in range(WIDTHS[(i + 1) % RING]):
            yield (head | (b ^ np.uint64(1 << bit)))[odd], fp[odd], False


def chained(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether differences ``x`` stay within the budgets of the chain that begins at ``start``."""
    ok = np.ones(len(x), bool)
    for i in np.unique(start):
        at = np.flatnonzero(start == i)
        total = np.zeros(len(at), np.int64)
        for step, budget in enumerate(BUDGET):
            total = total + np.bitwise_count(segment(x[at], int(i) + step))
            keep = total <= budget
            ok[at[~keep]] = False
            at, total = at[keep], total[keep]
    return ok


def links(key: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int | np.ndarray, np.ndarray, np.ndarray]]:
    """(table, one, other) of linked pairs with equal keys: all of a small group's, spanning forests of a larger one's.

    At RADIUS the chain's budgets hold for every link; at a wider radius a chain's first two
    segments bring pairs together, and only the whole ring is checked.
    """
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
    size = np.diff(cut)
    small = np.repeat((size > 1) & (size <= SMALL), size)
    k, f = key[small], fp[small]
    for d in range(1, SMALL):
        at = np.flatnonzero(k[d:] == k[:-d])
        if not len(at):
            break
        x, chain = f[at] ^ f[at + d], (k[at] >> np.uint64(26)).astype(np.int64)
        near = chained(x, chain % RING) if radius == RADIUS else np.bitwise_count(x) <= radius
        ok = near & (x != 0)
        yield chain[ok] // RING, f[at[ok]], f[at[ok] + d]
    for g in np.flatnonzero(size > SMALL):
        own = np.unique(fp[cut[g] : cut[g + 1]])
        for reach in range(RADIUS, radius + 1, 4):  # tighter links first, as a later check may refuse some
            yield int(key[cut[g]] >> np.uint64(26)) // RING, *forest(own, reach)


def forest(fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within ``fp``: breadth first, each node against those not yet reached."""
    left, a, b = fp, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= radius
            found = left[near]
            left = left[~near]
            a.append(np.full(len(found), at, np.uint64))
            b.append(found)
            queue.extend(found)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def ball(fp: np.ndarray) -> np.ndarray:
    """All points at most RADIUS / 2 bits away: two fingerprints link exactly if their balls share a point."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    masks = np.concatenate([[np.uint64(0)], one, one[i] | one[j]])
    return (fp[:, None] ^ masks[None, :]).ravel()


def _pairs(table: int | np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    a, b = a.view(np.int64), b.view(np.int64)
    t = np.broadcast_to(np.asarray(table, np.int32), a.shape)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(t)), pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["t", "u", "v"])


def edges(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(t, u, v), u > v, of links between the distinct (t: table, fp) of ``nodes``, enough to connect each class of a table."""
    spark = nodes.sparkSession
    whole = lambda batch, name: batch.column(name).to_numpy(zero_copy_only=False)

    def emit(batches):
        for batch in batches:
            table, every = whole(batch, "t"), whole(batch, "fp").view(np.uint64)
            for t in np.unique(table):
                own = every[table == t]
                for lo in range(0, len(own), 65536):
                    for key, fp, resident in index_rows(own[lo : lo + 65536], int(t)):
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(np.full(len(fp), resident))], ["key", "fp", "resident"])

    def compare(batches):
        parts = [(whole(b, "key").view(np.uint64).copy(), whole(b, "fp").view(np.uint64).copy()) for b in batches]
        if parts:
            keys, fps = (np.concatenate(x) for x in zip(*parts, strict=True))
            for t, a, b in links(keys, fps, radius):
                yield _pairs(t, a, b)

    def points(batches):
        for batch in batches:
            table, every = whole(batch, "t"), whole(batch, "fp").view(np.uint64)
            for lo in range(0, len(every), 256):
                part = every[lo : lo + 256]
                y = ball(part)
                each = len(y) // len(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(table[lo : lo + 256], each).astype(np.int32)), pa.array(y.view(np.int64)), pa.array(np.repeat(part, each).view(np.int64))], ["t", "y", "fp"])

    rows = nodes.select(F.col("t").cast("int"), "fp").mapInArrow(emit, "key bigint, fp bigint, resident boolean")
    crowded = False
    if radius == RADIUS:
        big = materialize(rows.where("resident").groupBy("key").count().where(F.col("count") > DIRECT).select("key"), "crowded")
        crowded = not big.isEmpty()
    usual = rows.join(big, "key", "left_anti") if crowded else rows
    n = partitions_for(spark, nodes.count() * sum(1 + w / 2 for w in WIDTHS) * 24)
    found = usual.select("key", "fp").repartition(n, "key").mapInArrow(compare, "t int, u bigint, v bigint")
    if crowded:
        table = F.call_function("div", F.call_function("shiftright", "key", F.lit(26)), F.lit(RING)).cast("int").alias("t")
        dense = materialize(rows.join(big, "key", "left_semi").select(table, "fp").distinct(), "dense").mapInArrow(points, "t int, y bigint, fp bigint")
        low = dense.groupBy("t", "y").agg(F.min("fp").alias("v"), F.max("fp").alias("u"), F.collect_set("fp").alias("all")).where("u > v")
        found = found.unionByName(low.select("t", F.explode("all").alias("u"), "v").where("u > v"))
    return found.distinct()


def components(found: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over undirected (u, v), by alternating large and small stars."""
    now, state = materialize(found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges"), None
    rows = now.count()  # no round adds any
    while rows:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(small, "edges", rows)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state, rows = new, new[0]
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id_col, fingerprint, component_id), one row per row of ``docs``.

    ``fingerprint`` is 16 hex digits; ``component_id`` the smallest id reachable over links. A
    text with fewer words than a shingle is one shingle; one without words (null, empty, blank)
    has fingerprint zero and links like any other. Null ids never become a component's id unless
    it has no other (then null); repeated rows come back as often as they were given; an empty
    table gives an empty result. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    own = materialize(with_fingerprints(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", shingle, "_f").select("_id", F.col("_f")[0].alias("_fp")), "fingerprints")
    with scratch(docs.sparkSession):
        nodes = materialize(own.groupBy("_fp").agg(F.min("_id").alias("rep"), F.count("*").alias("n")), "nodes")
        roots = components(edges(nodes.select(F.lit(0).alias("t"), F.col("_fp").alias("fp"))))
        known = materialize(nodes.join(roots.withColumnRenamed("node", "_fp"), "_fp", "left").select("_fp", "rep", "n", F.coalesce("root", "_fp").alias("root")), "roots")
        low = materialize(known.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("members")), "classes")
        of = kept(join_unique(known, low, "root", "members").select("_fp", "n", "component_id"), "membership")
    out = join_unique(own, of, "_fp", "n")
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def fingerprint_pairs(texts: DataFrame, shingle: int = 4) -> DataFrame:
    """(u, v), u > v, of (rep, text) whose fingerprints link, enough to connect each class of fingerprints: each text and the smallest one of its fingerprint, and the smallest ones of two that link."""
    own = materialize(with_fingerprints(texts.select("rep", "text"), "text", shingle, "_f").select("rep", F.col("_f")[0].alias("fp")), "fingerprints")
    nodes = materialize(own.groupBy("fp").agg(F.min("rep").alias("lead"), F.count("*").alias("n")), "nodes")
    same = join_unique(own, nodes, "fp", "n", "inner").where("rep != lead").select(F.col("rep").alias("u"), F.col("lead").alias("v"))
    found = edges(nodes.select(F.lit(0).alias("t"), "fp")).select("u", "v")
    for end in ("u", "v"):
        of = materialize(found.groupBy(end).agg(F.count("*").alias("n")).join(nodes.select(F.col("fp").alias(end), "lead"), end), "ends")
        found = materialize(join_unique(found, of, end, "n", "inner").withColumn(f"{end}_lead", F.col("lead")).drop("lead"), "links")
    linked = found.select(F.greatest("u_lead", "v_lead").alias("u"), F.least("u_lead", "v_lead").alias("v"))
    return same.unionByName(linked).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``docs`` with one row for each class of near-duplicates (shingle sets of similarity 0.8 or more, exactly): that of smallest id.

    Fingerprints propose: texts whose fingerprints link, as :func:`edges` finds them, are compared
    shingle by shingle. Similar texts whose fingerprints differ in more bits are met by their shingles.
    Ids are integers. Rows that repeat an id are documents of their own: equal ones are one class,
    of others each stays that nothing smaller is like; among rows of one id, that of smaller text hash
    counts as smaller. Rows without an id are never dropped. Texts without words are alike; an empty
    table gives an empty result. Texts of any length are compared whole. Other columns are kept.
    """
    spark = docs.sparkSession
    small_batches(spark)
    named = F.col(id_col).isNotNull()
    rest, key = docs.where(named), id_col
    if not rest.groupBy(id_col).count().where("count > 1").isEmpty():
        # A number in order of id and text stands for the id.
        key, order = "_place", [F.col(id_col), F.xxhash64(F.col(text_col).cast("string"))]
        key += "_" * sum(c.lower().startswith(key) for c in docs.columns)
        size = rest.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
        rest = materialize(rest.repartitionByRange(partitions_for(spark, size), *order).sortWithinPartitions(*order).withColumn(key, F.monotonically_increasing_id()), "single-ids")
    n_bytes = rest.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    n = partitions_for(spark, n_bytes)
    # Dealt by id once; no join below moves texts again but for the pairs that are compared.
    base = bucketed(rest.repartition(n, key), n, key, "documents")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = base.select(F.col(key).alias("rep"), F.when(text.rlike(r"^\s*$"), "").otherwise(text).alias("text"))
    with scratch(spark):
        nodes = bucketed(own.groupBy(F.md5("text").alias("_m")).agg(F.min("rep").alias("rep")).select("rep").repartition(n, "rep"), n, "rep", "nodes")
        texts = own.join(nodes.hint("merge"), "rep", "left_semi")
        gone = components(similar_pairs(texts, shingle, components, n, fingerprint_pairs(texts))).where("root != node").select(F.col("node").alias("rep"))
        stay = kept(nodes.join(gone, "rep", "left_anti"), "kept").alias("_kept_ids")
    return base.alias("_all_rows").join(stay, F.col(f"_all_rows.{key}") == F.col("_kept_ids.rep"), "left_semi").select(*[F.col(f"_all_rows.`{c}`") for c in docs.columns]).unionByName(docs.where(~named))
