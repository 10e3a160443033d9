"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily from each query.

Nodes are the distinct vectors, so copies make no pairs. The graph begins with each node's nearest
within blocks of nodes that stand together along a few random orders. A round joins every node's
neighbours, and those that have it for a neighbour, with each other: whichever pair is nearer than
what one of them has becomes an edge, and only pairs with a new edge are looked at again.
Neighbours that many nodes share are dealt in blocks that each meet the node's own neighbours.

A search keeps each query's ``beam`` nearest nodes found, asks for the neighbours of those not
asked for yet, and ends when none is left. All steps are joins of rows; no task holds more than a
block. Rounds and steps are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import discard, join_unique, kept, materialize, partitions_for, scratch, small_batches, written
from parley.llm.vectors import blobs, finite, matrix, unblob

#: Neighbours of a node in the graph, nodes of a search's beam, random orders to begin with, and nodes of a block.
DEGREE = 24
BEAM = 256
ORDERS = 4
BLOCK = 1024
#: Rounds of NN-descent at most; it ends earlier if less than this share of the edges is new.
ROUNDS = 3
SETTLED = 0.05
#: Reverse neighbours of a node that are joined at once.
CROWD = 4 * DEGREE
#: Half-spaces that place a node in a random order.
CUTS = 12


def _np(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _flat(vector: pa.Array, width: int) -> np.ndarray:
    return unblob(vector, np.float16).astype(np.float64).reshape(-1, width)


def gaps(points: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, those of a point to itself infinite."""
    own = (points * points).sum(1)
    d = np.maximum(own[:, None] + own[None] - 2 * (points @ points.T), 0).astype(np.float32)
    np.fill_diagonal(d, np.inf)
    return d


def places(points: np.ndarray, order: int) -> np.ndarray:
    """(half-space cell, place within) along a random order: cells of one order that differ in one cut stand together."""
    planes = np.random.default_rng(order).normal(size=(points.shape[1], CUTS + 1))
    at = points @ planes
    cell = np.zeros(len(points), np.int64)
    for j in range(CUTS):
        cell = cell * 2 + (at[:, j] > 0)
    for step in (1, 2, 4, 8):
        cell ^= cell >> step  # the rank of a Gray code
    return cell + 1 / (1 + np.exp(-np.clip(at[:, CUTS] / (np.abs(at[:, CUTS]).mean() + 1e-300), -30, 30)))


_EDGES = pa.schema([("v", pa.int64()), ("w", pa.int64()), ("d", pa.float32())])


def _rows(v: np.ndarray, w: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)), pa.array(w.astype(np.int64)), pa.array(d.astype(np.float32))], schema=_EDGES)


def _nearest(v: np.ndarray, w: np.ndarray, d: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``degree`` nearest different w of each v."""
    order = np.lexsort((w, d, v))
    v, w, d = v[order], w[order], d[order]
    fresh = np.ones(len(v), bool)
    fresh[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    v, w, d = v[fresh], w[fresh], d[fresh]
    start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    rank = np.arange(len(v)) - np.repeat(start, np.diff(np.concatenate([start, [len(v)]])))
    return v[rank < degree], w[rank < degree], d[rank < degree]


def _within_blocks(width: int, degree: int, block: int):
    """Arrow task over nodes in order: edges to the nearest in blocks of ``block`` nodes, the last one up to twice as long."""

    def edges(n: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(n) < 2:
            return
        d = gaps(x)
        k = min(degree, len(n) - 1)
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        yield _rows(np.repeat(n, k), n[near].ravel(), np.take_along_axis(d, near, 1).ravel())

    def task(batches):
        n, x = np.zeros(0, np.int64), np.zeros((0, width))
        for batch in batches:
            n, x = np.concatenate([n, _np(batch.column("n"))]), np.concatenate([x, _flat(batch.column("x"), width)])
            while len(n) >= 2 * block:
                yield from edges(n[:block], x[:block])
                n, x = n[block:], x[block:]
        yield from edges(n, x)

    return task


def _join_locally(width: int, degree: int):
    """Arrow task over members sorted by the node they meet at: pairs of them, one edge new, that are nearer than what one has."""

    def pairs(m: np.ndarray, new: np.ndarray, reach: np.ndarray, x: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        v, w, d = [], [], []
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            if hi - lo < 2 or not new[lo:hi].any():
                continue
            order = np.lexsort((~new[lo:hi], m[lo:hi])) + lo
            order = order[np.concatenate([[True], m[order][1:] != m[order][:-1]])]  # a mutual neighbour comes twice
            own, fresh = m[order], new[order]
            gap = gaps(x[order])
            i, j = np.nonzero((gap < reach[order][:, None]) & (fresh[:, None] | fresh[None]))
            v.append(own[i])
            w.append(own[j])
            d.append(gap[i, j])
        if not v:
            return _rows(*(np.zeros(0),) * 3)
        return _rows(*_nearest(np.concatenate(v), np.concatenate(w), np.concatenate(d), degree))

    def task(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [_np(batch.column("u")), _np(batch.column("block")), _np(batch.column("m")), _np(batch.column("new")).astype(bool), _np(batch.column("reach")), _flat(batch.column("x"), width)]
            now = now if rest is None else [np.concatenate(p) for p in zip(rest, now, strict=True)]
            u, block = now[0], now[1]
            cut = np.flatnonzero((u[1:] != u[:-1]) | (block[1:] != block[:-1])) + 1
            end = cut[-1] if len(cut) else 0
            if end:
                yield pairs(*now[2:], np.concatenate([[0], cut]))
            rest = [p[end:] for p in now]
        if rest is not None:
            yield pairs(*rest[2:], np.array([0, len(rest[0])]))

    return task


def _distances(width: int):
    def task(batches):
        for batch in batches:
            if batch.num_rows:
                gap = _flat(batch.column("qx"), width) - _flat(batch.column("x"), width)
                yield _rows(_np(batch.column("q")), _np(batch.column("w")), (gap * gap).sum(1))

    return task


def nodes_of(rows: DataFrame, least: int) -> tuple[DataFrame, int]:
    """(n, vector, ids, x) of the distinct vectors of ``rows`` (id, vector), and their length; ``ids`` are the ``least`` smallest of their rows.

    ``x``: the vector less the mean, scaled to half precision. The graph and the search use it; scores do not.
    """
    spark = rows.sparkSession
    width = max(1, rows.agg(F.max(F.size("vector"))).first()[0] or 0)
    order = Window.partitionBy("vector").orderBy(F.col("id").asc_nulls_last())
    some = rows.select("id", "vector").withColumn("r", F.row_number().over(order)).where(F.col("r") <= least)
    single = materialize(some.groupBy("vector").agg(F.sort_array(F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id"))).alias("ids")).select(F.monotonically_increasing_id().alias("n"), "vector", F.col("ids.id").alias("ids")), "vectors")

    def sums(batches):
        total, count, most = np.zeros(width), 0, 0.0
        for batch in batches:
            x = matrix(batch.column("vector"), width)
            total, count, most = total + x.sum(0), count + len(x), max(most, float(np.abs(x).max()) if x.size else 0.0)
        yield pa.RecordBatch.from_pydict({"total": [total.tolist()], "count": [count], "most": [most]})

    parts = single.select("vector").mapInArrow(sums, "total array<double>, count bigint, most double")
    whole = parts.agg(F.sum("count"), F.max("most"), *[F.sum(F.col("total")[i]) for i in range(width)]).first()
    count, most = whole[0] or 0, whole[1] or 1.0
    grain = 2.0 ** np.floor(np.log2(most)) / 4096 if most else 1.0  # so that the order of summing does not show
    mean = np.array([round((whole[2 + i] or 0.0) / max(count, 1) / grain) * grain for i in range(width)])
    scale = 2.0 ** np.floor(np.log2(30000 / (2 * most)))

    def centred(batches):
        for batch in batches:
            x = (matrix(batch.column("vector"), width) - mean) * scale
            yield pa.RecordBatch.from_arrays([*batch.columns, blobs(x.astype(np.float16))], names=[*batch.schema.names, "x"])

    id_type, vector_type = (rows.schema[c].dataType.simpleString() for c in ("id", "vector"))
    return materialize(single.mapInArrow(centred, f"n bigint, vector {vector_type}, ids array<{id_type}>, x binary"), "nodes"), width


def _ranked(edges: DataFrame, key: str, other: str, most: int) -> DataFrame:
    """The ``most`` nearest different ``other`` of each ``key``; flags of an edge that comes twice are those of the older."""
    w = Window.partitionBy(key).orderBy("d", other)
    flags = [c for c in edges.columns if c not in (key, other, "d")]
    near = edges.withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= most)
    single = near.groupBy(key, other).agg(F.min("d").alias("d"), *[F.min(c).alias(c) for c in flags])
    return single.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def neighbour_graph(nodes: DataFrame, width: int, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """(v, w, d) with the ``degree`` nearest neighbours found of every node of ``nodes`` (n, x), ``d`` the squared distance of x."""
    spark = nodes.sparkSession
    own = nodes.select("n", "x")
    size = own.count()
    parts = partitions_for(spark, size * degree * (2 * width + 32))
    blocks = max(1, min(parts, size // BLOCK))

    def along(order: int) -> DataFrame:
        def place(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places(_flat(batch.column("x"), width), order))], names=["n", "x", "at"])

        placed = own.mapInArrow(place, "n bigint, x binary, at double").repartitionByRange(blocks, "at", "n").sortWithinPartitions("at", "n")
        return placed.select("n", "x").mapInArrow(_within_blocks(width, degree, BLOCK), "v bigint, w bigint, d float")

    first = along(0)
    for order in range(1, ORDERS):
        first = first.unionByName(along(order))
    edges, path = written(_ranked(first, "v", "w", degree).withColumn("new", F.lit(True)), "edges")
    for _ in range(rounds):
        has = edges.groupBy("v").agg(F.max("d").alias("worst"), F.count("*").alias("out"))
        into = edges.groupBy("w").agg(F.count("*").alias("into"))
        reach = F.when(F.col("out") >= degree, F.col("worst")).otherwise(F.lit(float("inf")).cast("float"))
        state, state_path = written(own.join(has, F.col("n") == F.col("v"), "left").join(into, F.col("n") == F.col("w"), "left").select("n", "x", reach.alias("reach"), F.coalesce("into", F.lit(0)).alias("into"), (F.coalesce("into", F.lit(0)) + F.coalesce("out", F.lit(0))).alias("times")), "state")
        # A node that many have for a neighbour meets them in blocks, its own neighbours in each.
        many = state.select(F.col("n").alias("u"), F.greatest(F.lit(1), F.ceil(F.col("into") / CROWD)).cast("int").alias("blocks"), F.col("times").alias("n_left"))
        ahead = edges.select(F.col("v").alias("u"), F.col("w").alias("m"), "new", F.lit(True).alias("own"))
        back = edges.select(F.col("w").alias("u"), F.col("v").alias("m"), "new", F.lit(False).alias("own"))
        met = join_unique(ahead.unionByName(back), many, "u", "n_left", "inner")
        block = F.when(F.col("own"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("m"), F.col("blocks")).cast("int")))
        members = met.select("u", F.explode(block).alias("block"), "m", "new")
        known = state.select(F.col("n").alias("m"), "x", "reach", F.col("times").alias("n_left"))
        sent = join_unique(members, known, "m", "n_left", "inner").select("u", "block", "m", "new", "reach", "x")
        found = sent.repartition(parts, "u", "block").sortWithinPartitions("u", "block").mapInArrow(_join_locally(width, degree), "v bigint, w bigint, d float")
        better = _ranked(edges.withColumn("new", F.lit(False)).unionByName(found.withColumn("new", F.lit(True))), "v", "w", degree)
        after, after_path = written(better, "edges")
        discard(spark, path)
        discard(spark, state_path)
        edges, path = after, after_path
        share = edges.agg(F.avg(F.col("new").cast("int"))).first()[0] or 0
        if share < SETTLED:
            break
    return edges.select("v", "w", "d")


def search(nodes: DataFrame, graph: DataFrame, starts: DataFrame, width: int, beam: int = BEAM, degree: int = DEGREE) -> DataFrame:
    """(q, w, d): the ``beam`` nearest nodes found from each node q of ``starts`` (n), itself included.

    The graph is walked both ways, backwards along a node's ``degree`` shortest edges at most, as
    a node in the middle of many must not be asked for all of them.
    """
    spark = nodes.sparkSession
    back = graph.select(F.col("w").alias("v"), F.col("v").alias("w"), "d")
    both = graph.unionByName(_ranked(back, "v", "w", degree))
    around = materialize(both.groupBy("v").agg(F.collect_set("w").alias("ws")), "around")
    x = nodes.select("n", "x")
    asking = materialize(x.join(starts.select("n").distinct(), "n", "left_semi").select(F.col("n").alias("q"), F.col("x").alias("qx")), "asking")
    found, path = written(asking.select("q", F.col("q").alias("w"), F.lit(0).cast("float").alias("d"), F.lit(True).alias("open")), "beam")
    while not found.where("open").isEmpty():
        ask = found.where("open").select("q", F.col("w").alias("v")).join(around, "v").select("q", F.explode("ws").alias("w")).distinct()
        fresh = ask.join(found.select("q", "w"), ["q", "w"], "left_anti")
        pairs = fresh.join(x, fresh["w"] == x["n"]).select("q", "w", "x").join(asking, "q")
        scored = pairs.select("q", "w", "qx", "x").mapInArrow(_distances(width), "v bigint, w bigint, d float").select(F.col("v").alias("q"), "w", "d", F.lit(True).alias("open"))
        after, after_path = written(_ranked(found.select("q", "w", "d", F.lit(False).alias("open")).unionByName(scored), "q", "w", beam), "beam")
        discard(spark, path)
        found, path = after, after_path
    return found.select("q", "w", "d")


def _exact(width: int):
    def task(batches):
        for batch in batches:
            if batch.num_rows:
                gap = matrix(batch.column("mine"), width) - matrix(batch.column("vector"), width)
                yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("w"), batch.column("ids"), pa.array(np.sqrt((gap * gap).sum(1)))], names=["q", "w", "ids", "score"])

    return task


def nearest(rows: DataFrame, every: int = 100, n: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``n`` nearest rows found of each row whose id is divisible by ``every``.

    ``score`` is the Euclidean distance of the original vectors in double precision; ties go to the
    smaller id, null ids last. Vectors that are null, empty, zero or hold a null or non-finite
    component take no part, neither as queries nor as neighbours; a shorter vector counts as ending
    in zeros. A row is no neighbour of itself, but its copies are, and rows that repeat its id.
    Where fewer than ``n`` other rows take part, all are returned. Null ids ask nothing. An empty
    table gives no rows. Other columns are ignored.
    """
    spark = rows.sparkSession
    small_batches(spark, 4096)
    vector = F.col(vector_col)
    kind = "array<float>" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    own = rows.select(F.col(id_col).alias("id"), vector.cast(kind).alias("vector")).where(finite(F.col("vector")) & F.exists("vector", lambda c: c != 0))
    # -0.0 and 0.0 are one value.
    own = own.withColumn("vector", F.transform("vector", lambda c: F.when(c == 0, F.lit(0).cast(kind[6:-1])).otherwise(c)))
    with scratch(spark):
        nodes, width = nodes_of(own, n + 1)
        asked = materialize(own.where(F.col("id") % every == 0).join(nodes.select("vector", F.col("n").alias("q")), "vector").select("id", "q"), "queries")
        graph = neighbour_graph(nodes, width)
        beams = search(nodes, graph, asked.select(F.col("q").alias("n")), width)
        mine = nodes.select(F.col("n").alias("q"), F.col("vector").alias("mine"))
        other = nodes.select(F.col("n").alias("w"), "vector", "ids")
        both = beams.select("q", "w").join(other, "w").join(mine.join(asked.select("q").distinct(), "q", "left_semi"), "q")
        id_type = rows.schema[id_col].dataType.simpleString()
        scored = both.mapInArrow(_exact(width), f"q bigint, w bigint, ids array<{id_type}>, score double")
        each = scored.select("q", "w", "score", F.explode("ids").alias("id"))
        order = ["score", F.col("id").isNull(), "id"]
        top = each.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(*order, "w"))).where(F.col("r") <= n + 1)
        lists = materialize(top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "w", "score", "id"))).alias("near")), "lists")
        # A query leaves out one entry: its own row.
        met = asked.join(lists, "q")
        me = F.filter("near", lambda s: (s["w"] == F.col("q")) & (s["id"] == F.col("id")))
        rest = F.when(F.size(me) > 0, F.filter("near", lambda s: s["r"] != me[0]["r"])).otherwise(F.col("near"))
        out = met.select(F.col("id").alias("query_id"), F.posexplode(F.slice(rest, 1, n)).alias("at", "s"))
        return kept(out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("s.id").alias("vec_id"), F.col("s.score").alias("score")), "nearest")
