"""Codes of vectors by part: a codebook for each part, made by Lloyd rounds in integers with Yinyang bounds.

A codebook's entries are clustered into groups once. Every part keeps an upper bound of the
distance to its entry and one lower bound for each group; after a round the bounds move with the
entries' drift, and a group is scanned only where its lower bound no longer exceeds the upper
one. Whatever is scanned is compared in integers, so equal distances go to the lower index.

A round is one pass over the rows, which carry their bounds; each task adds up its own parts for
each entry, and only those sums, as many as a codebook has components, reach the driver.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import discard, join_unique, kept, scratch, small_batches, written
from parley.llm.vectors import blobs, finite, matrix, unblob

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Entries of a codebook for each group with a bound of its own.
GROUP_SIZE = 4
#: Components are held to this, so that sums of 10^19 rows stay exact.
MOST = 1 << 60
#: Bounds within this share of each other are settled in integers.
MARGIN = 1e-9


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of ``points`` (n, w) and ``entries`` (k, w); Python integers where 64 bits could overflow."""
    largest = max((int(np.abs(x).max()) for x in (points, entries) if x.size), default=0)
    if largest > isqrt((1 << 62) // max(points.shape[1], 1)) // 2:
        points, entries = points.astype(object), entries.astype(object)
    return ((points[:, None, :] - entries[None]) ** 2).sum(-1)


def roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def grouped(entries: np.ndarray) -> np.ndarray:
    """The group of each entry: a few Lloyd rounds over the entries themselves, from evenly spaced ones."""
    x = entries.astype(np.float64)
    n = max(1, -(-len(x) // GROUP_SIZE))
    centres = x[:: max(1, len(x) // n)][:n].copy()
    for _ in range(5):
        own = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        for g in np.unique(own):
            centres[g] = x[own == g].mean(0)
    return np.unique(own, return_inverse=True)[1]


def first_assignment(points: np.ndarray, entries: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, upper bound, lower bound of each group) of each point, all entries scanned."""
    d = squared(points, entries)
    best = d.argmin(1)
    dist = roots(d)
    at = np.arange(len(points))
    upper = dist[at, best]
    dist[at, best] = np.inf
    lower = np.stack([dist[:, groups == g].min(1) for g in range(groups.max() + 1)], 1)
    return best, upper, lower


def next_assignment(points: np.ndarray, best: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, upper, lower) after the entries moved from ``old`` to ``new``, and how many distances were computed."""
    drift = roots(np.array([squared(old[i : i + 1], new[i : i + 1])[0, 0] for i in range(len(old))])) * (1 + MARGIN)
    upper = upper + drift[best]
    lower = lower - np.array([drift[groups == g].max() for g in range(groups.max() + 1)])
    reach = lambda u: u * (1 + MARGIN) + MARGIN
    open_ = np.flatnonzero(lower.min(1) <= reach(upper))
    if not len(open_):
        return best, upper, lower, 0
    scanned = len(open_)
    now = best[open_]
    exact = np.empty(len(open_), object)
    for e in np.unique(now):
        exact[now == e] = squared(points[open_[now == e]], new[e : e + 1])[:, 0]
    upper[open_] = roots(exact)
    was, was_exact = now.copy(), exact.copy()
    seen = {}
    for g in range(groups.max() + 1):
        rows = np.flatnonzero(lower[open_, g] <= reach(upper[open_]))
        members = np.flatnonzero(groups == g)
        if not len(rows):
            continue
        d = squared(points[open_[rows]], new[members])
        scanned += d.size
        seen[g] = rows, members, d
        low = d.argmin(1)
        value, entry = d[np.arange(len(rows)), low], members[low]
        better = (value < exact[rows]) | ((value == exact[rows]) & (entry < now[rows]))
        now[rows[better]], exact[rows[better]] = entry[better], value[better]
    moved = now != was
    for g in range(groups.max() + 1):
        left = np.flatnonzero(moved & (groups[was] == g))  # the entry that was left counts among its group's others
        lower[open_[left], g] = np.minimum(lower[open_[left], g], roots(was_exact[left]))
        if g in seen:
            rows, members, d = seen[g]
            others = roots(d)
            others[now[rows][:, None] == members[None]] = np.inf
            lower[open_[rows], g] = others.min(1)
    best = best.copy()
    best[open_] = now
    upper[open_] = roots(exact)
    return best, upper, lower, scanned


_STATE = "id {id}, label string, x binary, best binary, upper binary, lower binary, part int, entry int, n bigint, sums array<decimal(38,0)>"


def _parts(x: np.ndarray, width: int) -> np.ndarray:
    return x.reshape(len(x), PARTS, width)


def _integers(column: pa.ListArray, width: int) -> np.ndarray:
    """floor(SCALE x) of each component, held to MOST."""
    scaled = np.floor(matrix(column, PARTS * width) * SCALE)
    return np.clip(scaled, -float(MOST), float(MOST)).astype(np.int64)


def _pass(width: int, books: np.ndarray, before: np.ndarray | None, groups: list[np.ndarray], last: bool, id_type: pa.DataType):
    """Arrow task of one round: rows with entries and bounds under ``books`` and the sums of the task's parts, or at the end codes and errors.

    ``before``: the codebooks of the round before, whose bounds the rows carry; None in the first.
    """
    state = pa.schema([("id", id_type), ("label", pa.string()), ("x", pa.binary()), ("best", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))])
    final = pa.schema([("id", id_type), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])
    bounds = np.cumsum([0] + [int(g.max()) + 1 for g in groups])
    k = books.shape[1]

    def assign(batch):
        x = _parts(_integers(batch.column("vector"), width) if before is None else unblob(batch.column("x"), np.int64), width)
        n = len(x)
        best, upper, lower = np.zeros((n, PARTS), np.uint8), np.zeros((n, PARTS)), np.zeros((n, bounds[-1]))
        if before is not None:
            best, upper, lower = unblob(batch.column("best"), np.uint8), unblob(batch.column("upper"), np.float32).astype(np.float64), unblob(batch.column("lower"), np.float32).astype(np.float64)
        for p in range(PARTS):
            own = slice(bounds[p], bounds[p + 1])
            if before is None:
                found = first_assignment(x[:, p], books[p], groups[p])
            else:
                found = next_assignment(x[:, p], best[:, p].astype(np.int64), upper[:, p], lower[:, own], before[p], books[p], groups[p])
            best[:, p], upper[:, p], lower[:, own] = found[:3]
        return x, best, upper, lower

    def task(batches):
        count, total = np.zeros((PARTS, k), np.int64), np.zeros((PARTS, k, width), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, best, upper, lower = assign(batch)
            if last:
                error = sum(((x[:, p].astype(object) - books[p][best[:, p]]) ** 2).sum(-1) for p in range(PARTS))
                codes = ["".join(f"{e:02x}" for e in row) for row in best.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(codes, pa.string()), pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64())], schema=final)
                continue
            exact = x if not x.size or int(np.abs(x).max()) * len(x) < 1 << 62 else x.astype(object)
            for p in range(PARTS):
                for e in np.unique(best[:, p]):
                    rows = best[:, p] == e
                    count[p, e] += int(rows.sum())
                    total[p, e] += exact[rows, p].sum(0).astype(object)
            none = pa.nulls(len(x), pa.int32())
            up, down = np.nextafter(upper.astype(np.float32), np.float32(np.inf)), np.nextafter(lower.astype(np.float32), np.float32(-np.inf))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), blobs(x.reshape(len(x), -1)), blobs(best), blobs(up), blobs(down), none, none, pa.nulls(len(x), pa.int64()), pa.nulls(len(x), state.field("sums").type)], schema=state)
        if not last:
            p, e = np.nonzero(count)
            sums = [[Decimal(int(v)) for v in total[i, j]] for i, j in zip(p, e, strict=True)]
            gone = [pa.nulls(len(p), f.type) for f in list(state)[:6]]
            yield pa.RecordBatch.from_arrays([*gone, pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e], pa.int64()), pa.array(sums, state.field("sums").type)], schema=state)

    return task


def _moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after a round: the floored mean of each entry's parts; unused entries stay."""
    each = state.where("part is not null").select("part", "entry", "n", F.posexplode("sums").alias("at", "v"))
    out = books.copy()
    for r in each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():  # PARTS * ENTRIES * width rows
        out[r["part"], r["entry"], r["at"]] = int(r["v"]) // r["n"]
    return out


def vector_codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(id_col, code, error, label_error) of each row that takes part, and the codebooks (part, entry, component).

    Rows whose vector is null or holds a null or non-finite component are left out. Vectors are cut
    into 8 parts of one width, the longest vector's length over 8, rounded up, 1 at least; shorter vectors (an
    empty one too) count as ending in zeros. Components are floor(4096 x), held to 2^60 either way.
    The codebooks begin as the parts of the ``entries`` rows of smallest id (null ids last, then by
    vector; fewer rows make shorter codebooks). ``code`` has two hex digits for each part;
    ``error`` is the sum of squared distances, null beyond 64 bits; ``label_error`` sums it over
    rows of one label, nulls together. Repeated rows count as often as they stand there. An empty
    table gives no rows and codebooks without entries. Other columns are ignored.
    """
    spark = rows.sparkSession
    small_batches(spark)
    base = rows.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).where(finite(F.col("vector")))
    width = max(1, -(-(base.agg(F.max(F.size("vector"))).first()[0] or 0) // PARTS))
    start = base.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()["vector"]
    id_type = base.select("id").limit(0).toArrow().schema.field("id").type
    sql_id = base.schema["id"].dataType.simpleString()
    x = _parts(_integers(start, width), width)
    books = np.ascontiguousarray(x.transpose(1, 0, 2))
    if not books.shape[1]:
        return base.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error")).where("false"), books
    groups = [grouped(b) for b in books]
    state_schema = _STATE.format(id=sql_id)
    with scratch(spark):
        now, path, before = base, None, None
        for _ in range(rounds):
            state, new_path = written(now.mapInArrow(_pass(width, books, before, groups, False, id_type), state_schema), "codes")
            if path:
                discard(spark, path)
            path, now = new_path, state.where("part is null").select("id", "label", "x", "best", "upper", "lower")
            before, books = books, _moved(state, books)
            if (books == before).all():
                break  # all further rounds repeat this one
        own = kept(now.mapInArrow(_pass(width, books, before, groups, True, id_type), f"id {sql_id}, label string, code string, error bigint"), "coded")
        key = F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), "label")).alias("key")
        sums = kept(own.groupBy(key).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("members")), "labels")
    out = join_unique(own.select("id", key, "code", "error"), sums, "key", "members")
    return out.select(F.col("id").alias(id_col), "code", "error", F.expr("try_cast(sum AS bigint)").alias("label_error")), books


def digest(books: np.ndarray) -> str:
    """SHA-256 (hex) of the codebooks' components in decimal by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
