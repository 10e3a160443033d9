"""Exact substring dedup by suffix arrays.

A byte goes if a ``WINDOW``-byte (50) string over it also starts in a document with a smaller id.

1. Anchors: the smallest hash of ``GRAM``-byte grams in each window marks an anchor, chosen by the
   window's bytes alone, so equal windows hold the same anchor at the same place. All windows
   whose anchor it is lie within its context, at most ``2 * WINDOW - GRAM`` bytes.
2. Equal contexts under one anchor hash are collapsed: of a class only the smallest document
   stays, and every other member's context goes as a whole, as a smaller document has all of it.
   This is done within each batch before the shuffle, so copies do not gather anywhere. Anchors that
   a sample shows to be frequent are dealt by their contexts as well. Hashes only propose: within a
   batch a member's bytes are compared with those of the one that stays; between batches, contexts
   with one distance to one document are put together as one region, that document's bytes there
   are cut out and sent to the member's text, and what agrees there for a window or more goes.
3. What is left under an anchor hash is one representative for each different context. Two that hold
   equal windows agree in half the reach before the anchor's gram or in half the reach behind it; one
   that agrees with no other in either, by 16 bits of hash, has no window in common with any and stops here.
   Where there are two or more, their bytes are concatenated and their suffixes sorted in two stages:
   only suffixes smaller than their successors are sorted directly, the rest are induced by
   scanning the buckets in order; adjacent common prefixes of WINDOW bytes or more then join
   equal windows, and those of all but the smallest document go.
4. An anchor with more than ``CROWD`` different contexts does not go to one task: its windows are
   rows, dealt by all their bytes, and the smallest document of each is an aggregate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import textvec as tv
from parley.llm.common import materialize, packed, partitions_for, small_batches

WINDOW = 50
GRAM = 16
#: Bytes that are kept of gram and context hashes; contexts are compared byte by byte if both agree.
HASH_BYTES = (6, 7)
K_MASK, CTX_MASK = (np.uint64((1 << 8 * n) - 1) for n in HASH_BYTES)
#: Bits of the hashes of a context's two sides; beside a gram's hash they fill 64.
SIDE_BITS = np.uint64(64 - 8 * HASH_BYTES[0])
SIDE_BYTES = 2 * int(SIDE_BITS) // 8
#: Bytes of text whose anchors are collapsed together before the shuffle.
BATCH_BYTES = 12 << 20
#: Parts of a partition that are collapsed one after the other.
PARTS = 8
#: Bytes of contexts that one suffix array covers, but for a larger group.
ARRAY_BYTES = 1 << 20
#: Different contexts of one anchor that one suffix array covers.
CROWD = 30_000
#: Bytes of text that frequent anchors are looked for in, the share of its anchors that makes one frequent, and into how many parts those are dealt.
SAMPLE_BYTES, FREQUENT, SALTS = 8 << 20, 2000, 256
#: Crowded windows (24 bytes each) that are broadcast; more are joined by shuffle.
BROADCAST_WINDOWS = 200_000


def sliding(op: np.ufunc, x: np.ndarray, w: int) -> np.ndarray:
    """op over each window of ``w`` entries, by doubling."""
    size = 1
    while 2 * size <= w:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def halves(window: int, gram: int) -> tuple[int, int]:
    """Bytes before an anchor and bytes from it on, of which every window around it holds one or the other whole."""
    before = (window - gram + 1) // 2
    return before, window - before + 1


def anchors(data: np.ndarray, off: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position in the chunk, gram hash, context hash, hashes of its two sides) of each anchor of a chunk."""
    n, w = len(data), window - gram + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, *[none.astype(np.uint64)] * 3
    prefix = tv.prefix_hash(data)
    at = np.arange(n - gram + 1)
    h = tv.span_hash(prefix, at, at + gram)
    low = sliding(np.minimum, h, w)  # of the window that starts here
    ok = np.zeros(n - window + 1, bool)
    for a, b in zip(off[:-1], off[1:], strict=True):
        ok[a : max(a, b - window + 1)] = True
    low[~ok] = 0
    pad = np.zeros(w - 1, np.uint64)
    high = sliding(np.maximum, np.concatenate([pad, low, pad]), w)
    p = np.flatnonzero((high == h) & (high > 0))
    text = np.searchsorted(off, p, "right") - 1
    a, b = np.maximum(off[text], p - (window - gram)), np.minimum(off[text + 1], p + window)
    before, behind = halves(window, gram)
    left, right = (tv.span_hash(prefix, x, y) >> (np.uint64(64) - SIDE_BITS) for x, y in ((np.maximum(a, p - before), p), (p, np.minimum(b, p + behind))))
    return text, p, h[p], tv.mix(tv.span_hash(prefix, a, b) + (p - a).astype(np.uint64) * tv.BASE), left << SIDE_BITS | right


def words(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number that sorts like them; zeros follow the end."""
    p = np.concatenate([t, np.zeros(8 + WINDOW, np.uint8)]).astype(np.uint64)
    n = len(t) + WINDOW
    out = np.zeros(n, np.uint64)
    for i in range(8):
        out |= p[i : i + n] << np.uint64(56 - 8 * i)
    return out


def steps(depth: int) -> list[int]:
    """Offsets of 8-byte words that cover the first ``depth`` bytes (8 at least)."""
    return [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]


def suffix_array(t: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Positions of ``t`` (not empty) in order of their suffixes, by the first ``depth`` bytes at least."""
    n, w = len(t), words(t)
    # A suffix is smaller than its successor if the first byte unlike t[i] from i on is larger; the end is smallest.
    change = np.flatnonzero(t[1:] != t[:-1])
    rises = np.zeros(n, bool)
    if len(change):
        nxt = np.searchsorted(change, np.arange(n))
        some = nxt < len(change)
        at = change[nxt[some]]
        rises[some] = t[at + 1] > t[at]
    direct = np.flatnonzero(rises)
    direct = direct[np.lexsort([w[direct + o] for o in reversed(steps(depth))])]
    heads = np.searchsorted(t[direct], np.arange(257))  # direct is in order of first bytes
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[n - 1]].append(np.array([n - 1]))
    out = []

    def larger(entries: np.ndarray, c: int) -> None:
        before = entries[entries > 0] - 1
        before = before[t[before] > c]
        if not len(before):
            return
        first = t[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cut = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        for a, b in zip(cut, [*cut[1:], len(first)], strict=True):
            waiting[first[a]].append(before[a:b])

    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        own = []
        while len(wave):  # equal bytes: the next wave follows from this one
            own.append(wave)
            before = wave[wave > 0] - 1
            wave = before[t[before] == c]
        own.append(direct[heads[c] : heads[c + 1]])
        entries = np.concatenate(own)
        if len(entries):
            larger(entries, c)
            out.append(entries)
    return np.concatenate(out)


def common_prefix(w: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Length of the common prefix of suffixes ``a`` and ``b``, up to ``depth``; ``w`` are words()."""
    length = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for o in steps(depth):
        x = w[a[live] + o] ^ w[b[live] + o]
        zero = np.zeros(len(live), np.int64)
        rest = x.copy()
        for shift in (32, 16, 8):
            empty = (rest >> np.uint64(64 - shift)) == 0
            zero[empty] += shift // 8
            rest[empty] <<= np.uint64(shift)
        length[live] = o + np.where(x == 0, 8, zero)
        live = live[x == 0]
    return np.minimum(length, depth)


def repeated(contexts: list[bytes], doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of windows that also start in a context of a smaller document, in that order."""
    t = np.frombuffer(b"".join(contexts), np.uint8)
    size = np.array([len(c) for c in contexts])
    start = np.cumsum(size) - size
    own = np.repeat(np.arange(len(size)), size)
    order = suffix_array(t, window)
    order = order[order + window <= (start + size)[own[order]]]
    if len(order) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    split = common_prefix(words(t), order[:-1], order[1:], window) < window
    run = np.concatenate([[0], np.cumsum(split)])
    least = np.minimum.reduceat(doc[own[order]], np.flatnonzero(np.concatenate([[True], split])))
    hit = np.sort(order[least[run] < doc[own[order]]])
    return own[hit], hit - start[own[hit]]


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


class Rows:
    """Columns of anchors: gram hash, context hash, hashes of its sides, document, row, position, and the context's reach to either side."""

    NAMES = ("k", "ctx", "side", "doc", "row", "p", "head", "tail")

    def __init__(self, **cols: np.ndarray):
        self.cols = cols

    def __getattr__(self, name: str) -> np.ndarray:
        return self.__dict__["cols"][name]

    def __len__(self) -> int:
        return len(self.k)

    def __getitem__(self, at: np.ndarray) -> Rows:
        return Rows(**{c: x[at] for c, x in self.cols.items()})

    @classmethod
    def of(cls, parts: list[Rows]) -> Rows:
        return cls(**{c: np.concatenate([getattr(x, c) for x in parts]) for c in parts[0].cols})

    def agree(self, other: Rows, data: np.ndarray) -> np.ndarray:
        """Whether each row's context has the bytes of the other's; both have ``g``, the anchor's place in ``data``."""
        same = (self.head == other.head) & (self.tail == other.tail)
        for lo in range(0, len(self), 1 << 15):
            at = np.flatnonzero(same[lo : lo + (1 << 15)]) + lo
            if len(at):
                size = self.head[at] + self.tail[at]
                i = np.arange(int(size.max()))
                inside = i < size[:, None]
                place = lambda rows: np.where(inside, (rows.g[at] - rows.head[at])[:, None] + i, 0)  # noqa: B023, E731
                same[at] = ((data[place(self)] == data[place(other)]) | ~inside).all(1)
        return same

    def classes(self) -> tuple[Rows, np.ndarray, np.ndarray, np.ndarray]:
        """Rows in order of class and document; where a class begins; each row's class; rows of its class's smallest document."""
        rows = self[np.lexsort((self.p, self.row, self.doc, self.ctx, self.k))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows.k[1:] != rows.k[:-1]) | (rows.ctx[1:] != rows.ctx[:-1])
        cls = np.cumsum(new) - 1
        return rows, new, cls, rows.doc[new][cls] == rows.doc

    def pack(self) -> bytes:
        """The hashes' bytes as they are, for nothing makes them smaller; the rest by differences, compressed."""
        rows = self[np.lexsort((self.p, self.row))]
        n = len(rows)
        hashes = np.concatenate([rows.k.view(np.uint8).reshape(n, 8)[:, : HASH_BYTES[0]], rows.ctx.view(np.uint8).reshape(n, 8)[:, : HASH_BYTES[1]], rows.side.view(np.uint8).reshape(n, 8)[:, :SIDE_BYTES]], 1)
        change = lambda x: np.diff(x, prepend=np.int64(0)).view(np.uint8).reshape(n, 8).T.tobytes()
        rest = change(rows.doc) + (change(rows.row) if (rows.row != rows.doc).any() else b"") + rows.p.astype(np.int32).view(np.uint8).reshape(n, 4).T.tobytes() + rows.head.astype(np.uint8).tobytes() + rows.tail.astype(np.uint8).tobytes()
        return n.to_bytes(4, "little") + hashes.tobytes() + zstandard.ZstdCompressor(level=1).compress(rest)

    @classmethod
    def unpack(cls, raw: bytes) -> Rows:
        n, width = int.from_bytes(raw[:4], "little"), sum(HASH_BYTES) + SIDE_BYTES
        hashes = np.frombuffer(raw, np.uint8, n * width, 4).reshape(n, width)
        rest = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[4 + n * width :]), np.uint8)

        def wide(x: np.ndarray) -> np.ndarray:
            out = np.zeros((n, 8), np.uint8)
            out[:, : x.shape[1]] = x
            return out.view(np.uint64).ravel()

        turned = lambda x, kind: np.ascontiguousarray(x.reshape(-1, n).T).view(kind).ravel()
        doc = np.cumsum(turned(rest[: 8 * n], np.int64))
        at = 8 * n
        row = doc
        if len(rest) > 14 * n:
            row, at = np.cumsum(turned(rest[at : at + 8 * n], np.int64)), at + 8 * n
        p = turned(rest[at : at + 4 * n], np.int32).astype(np.int64)
        at += 4 * n
        return cls(k=wide(hashes[:, : HASH_BYTES[0]]), ctx=wide(hashes[:, HASH_BYTES[0] : sum(HASH_BYTES)]), side=wide(hashes[:, sum(HASH_BYTES) :]), doc=doc, row=row, p=p, head=rest[at : at + n].astype(np.int64), tail=rest[at + n :].astype(np.int64))


def _span_rows(row: np.ndarray, a: np.ndarray, b: np.ndarray, of: np.ndarray | None = None, shift: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(row)
    doc, p = (pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())) if of is None else (pa.array(of), pa.array(shift.astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), doc, pa.array(row), pa.array(a.astype(np.int32)), p, pa.array(b.astype(np.int32)), pa.nulls(n, pa.list_(pa.int32()))], ["k", "doc", "row", "a", "p", "b", "others"])


def _joined_spans(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Span rows, with those of one row that touch made one."""
    order = np.lexsort((a, row))
    row, a, b = row[order], a[order], b[order]
    if len(row):
        new = np.ones(len(row), bool)
        new[1:] = row[1:] != row[:-1]
        reach = b + (np.cumsum(new) << 40)
        reach = np.maximum.accumulate(reach)
        new[1:] |= a[1:] > (reach[:-1] & ((1 << 40) - 1))
        first = np.flatnonzero(new)
        last = np.append(first[1:] - 1, len(row) - 1)
        row, a, b = row[first], a[first], reach[last] & ((1 << 40) - 1)
    return _span_rows(row, a, b)


def regions(row: np.ndarray, of: np.ndarray, shift: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, of, shift, a, b) with one region, from the first to the last byte, for each row, other row and distance."""
    order = np.lexsort((shift, of, row))
    row, of, shift, a, b = (x[order] for x in (row, of, shift, a, b))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (of[1:] != of[:-1]) | (shift[1:] != shift[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return row, of, shift, a, b
    return row[first], of[first], shift[first], np.minimum.reduceat(a, first), np.maximum.reduceat(b, first)


def frequent_anchors(docs: DataFrame, n_bytes: int, window: int, gram: int) -> np.ndarray:
    """Hashes of anchors that make up a large share of a sample; how they are dealt depends on it, the result does not."""

    def count(batches):
        for batch in batches:
            for _, _, data, off in tv.chunks(batch.column("text")):
                k, n = np.unique(anchors(data, off, window, gram)[2] & K_MASK, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], ["k", "n"])

    few = docs.select("text") if n_bytes <= SAMPLE_BYTES else docs.select("text").sample(SAMPLE_BYTES / n_bytes, seed=7)
    every = materialize(few.mapInArrow(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")), "anchors")
    total = every.agg(F.sum("n")).first()[0] or 0
    hot = every.where((F.col("n") > 16) & (F.col("n") * FREQUENT > total)).select("k").collect()  # fewer than FREQUENT
    return np.sort(np.array([r[0] for r in hot], np.int64).view(np.uint64))


def anchor_rows(docs: DataFrame, window: int, gram: int, parts: int, hot: np.ndarray) -> DataFrame:
    """(part, anchors, spans): packed anchors by hash, those of ``hot`` by context as well, and Arrow bytes of spans already known to go."""

    def emit(batches):
        held, raw, size = [], [], 0
        for batch in batches:
            doc, row = _column(batch, "doc"), _column(batch, "row")
            for lo, _, data, off in tv.chunks(batch.column("text")):
                text, p, h, ctx, side = anchors(data, off, window, gram)
                at, n = p - off[text], np.diff(off)[text]
                held.append(Rows(k=h & K_MASK, ctx=ctx & CTX_MASK, side=side, doc=doc[lo + text], row=row[lo + text], p=at, head=np.minimum(at, window - gram), tail=np.minimum(n - at, window), g=p + size))
                raw.append(data.copy())
                size += len(data)
                if size >= BATCH_BYTES:
                    yield from collapsed(held, raw)
                    held, raw, size = [], [], 0
        if held:
            yield from collapsed(held, raw)

    def collapsed(held, raw):
        rows, new, cls, least = Rows.of(held).classes()
        # What stands for a class here may not be equal after all; such rows go on.
        other = np.flatnonzero(~least)
        least[other[~rows[other].agree(rows[np.flatnonzero(new)[cls[other]]], np.concatenate(raw))]] = True
        gone = rows[~least]
        rows = rows[least]
        at = rows.k + np.where(np.isin(rows.k, hot), rows.ctx % np.uint64(SALTS), np.uint64(0)) * np.uint64(0x9E3779B97F4A7C15)
        part = (at % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        packed = [(i, rows[order[cut[i] : cut[i + 1]]].pack(), None) for i in range(parts) if cut[i] < cut[i + 1]]
        if len(gone):
            out = _joined_spans(gone.row, gone.p - gone.head, gone.p + gone.tail)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, out.schema) as writer:
                writer.write_batch(out)
            packed.append((int(gone.row[0] % parts), None, sink.getvalue().to_pybytes()))
        for lo in range(0, len(packed), 64):
            i, x, y = zip(*packed[lo : lo + 64], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["part", "anchors", "spans"])

    return docs.mapInArrow(emit, "part bigint, anchors binary, spans binary")


CLASSES = "k bigint, doc bigint, row bigint, a int, p int, b int, others array<int>"


def may_share(lead: Rows, window: int, gram: int) -> np.ndarray:
    """Whether a class, given by one row of each, agrees with another one of its gram in a half that windows around the gram hold; those that do not have no window in common with others."""
    before, behind = halves(window, gram)
    out = np.zeros(len(lead), bool)
    for half, fits in ((lead.side >> SIDE_BITS, lead.head >= before), (lead.side & ((np.uint64(1) << SIDE_BITS) - np.uint64(1)), lead.tail >= behind)):
        at = np.flatnonzero(fits)
        x = lead.k[at] << SIDE_BITS | half[at]
        order = np.argsort(x)
        x, at = x[order], at[order]
        same = x[1:] == x[:-1]
        out[at[1:][same]] = True
        out[at[:-1][same]] = True
    return out


def classes(rows: DataFrame, n: int, hot: np.ndarray, window: int, gram: int) -> DataFrame:
    """Spans to go (k null), those with a doc as far as that row's bytes p further on agree, and of each anchor hash with several classes that may share windows one row for each, with the other places that hold it."""

    def reduce(batches):
        now, parts = None, []
        ask = [np.zeros(0, np.int64)] * 5  # regions of this task
        for batch in batches:
            for part, packed_rows, known in zip(batch.column("part").to_pylist(), batch.column("anchors"), batch.column("spans"), strict=True):
                if part != now:
                    ask = yield from collapsed(parts, ask)
                    now, parts = part, []
                if known.is_valid:
                    yield from pa.ipc.open_stream(known.as_buffer())
                else:
                    parts.append(Rows.unpack(packed_rows.as_buffer().to_pybytes()))
        row, of, shift, a, b = yield from collapsed(parts, ask)
        yield _span_rows(row, a, b, of, shift)

    def collapsed(parts, ask):
        if not parts:
            return ask
        rows, new, cls, least = Rows.of(parts).classes()
        parts.clear()
        gone, lead = rows[~least], rows[np.flatnonzero(new)[cls[~least]]]
        found = gone.row, lead.row, lead.p - gone.p, gone.p - gone.head, gone.p + gone.tail
        ask = list(regions(*[np.concatenate(x) for x in zip(ask, found, strict=True)]))
        hk = rows.k[new]
        several = np.isin(hk, hot)  # their other classes may be elsewhere
        same = np.zeros(len(hk) + 1, bool)
        same[1:-1] = hk[1:] == hk[:-1]
        mates = np.flatnonzero(same[1:] | same[:-1])
        several[mates] |= may_share(rows[np.flatnonzero(new)[mates]], window, gram)
        # One row for each class and row of its smallest document; further places of that row follow it.
        keep = np.flatnonzero(least & several[cls])
        if not len(keep):
            return ask
        first = np.ones(len(keep), bool)
        first[1:] = (cls[keep][1:] != cls[keep][:-1]) | (rows.row[keep][1:] != rows.row[keep][:-1])
        lead, rest = rows[keep[first]], keep[~first]
        count = np.diff(np.append(np.flatnonzero(first), len(keep))) - 1
        others = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(rows.p[rest].astype(np.int32)))
        ints = (pa.array(x.astype(np.int32)) for x in (lead.p - lead.head, lead.p, lead.p + lead.tail))
        yield pa.RecordBatch.from_arrays([pa.array(lead.k.view(np.int64)), pa.array(lead.doc), pa.array(lead.row), *ints, others], ["k", "doc", "row", "a", "p", "b", "others"])
        return ask

    return rows.repartition(n, "part").sortWithinPartitions("part").mapInArrow(reduce, CLASSES)


def sorted_out(contexts: DataFrame, n: int, window: int) -> DataFrame:
    """Spans (row, a, b) that suffix arrays find, from (k, doc, row, a, p, others, bytes)."""

    def search(batches):
        held, size = [], 0
        for batch in batches:
            k, upto = _column(batch, "k"), np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < len(k):
                room = ARRAY_BYTES - size + (upto[lo - 1] if lo else 0)
                hi = int(np.searchsorted(upto, room, "right"))
                last = held[-1].column("k")[-1].as_py() if held else None
                if hi <= lo and last is not None and k[lo] != last:
                    yield from found(pa.Table.from_batches(held))
                    held, size = [], 0
                    continue
                hi = max(lo + 1, hi)
                hi = int(np.searchsorted(k, k[hi - 1], "right"))  # never within a group
                held.append(batch.slice(lo, hi - lo))
                size += int(upto[hi - 1] - (upto[lo - 1] if lo else 0))
                lo = hi
        if held:
            yield from found(pa.Table.from_batches(held))

    def found(part):
        part = part.combine_chunks()
        doc, row, a, p = (part[c].to_numpy() for c in ("doc", "row", "a", "p"))
        own, o = repeated(part["bytes"].to_pylist(), doc, window)
        if not len(own):
            return
        first = np.concatenate([[True], (own[1:] != own[:-1]) | (o[1:] > o[:-1] + window)])
        last = np.append(np.flatnonzero(first)[1:] - 1, len(own) - 1)
        c, s, e = own[first], o[first] + a[own[first]], o[last] + window + a[own[first]]
        others = part["others"].to_pylist()
        shift = [(i, x - p[c[i]]) for i in range(len(c)) for x in others[c[i]]]
        i = np.concatenate([np.arange(len(c)), np.array([x for x, _ in shift], np.int64)])
        d = np.concatenate([np.zeros(len(c), np.int64), np.array([x for _, x in shift], np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(row[c[i]]), pa.array((s[i] + d).astype(np.int32)), pa.array((e[i] + d).astype(np.int32))], ["row", "a", "b"])

    return contexts.repartition(n, "k").sortWithinPartitions("k").mapInArrow(search, "row bigint, a int, b int")


def dealt_out(contexts: DataFrame, window: int) -> DataFrame:
    """Spans (row, a, b) of crowded anchors: every window a row, gone where a smaller document has the same bytes."""
    starts = F.transform(F.sequence(F.lit(0), F.octet_length("bytes") - window), lambda i: F.struct(i.alias("at"), F.substring("bytes", i + 1, F.lit(window)).alias("w")))
    windows = contexts.where(F.octet_length("bytes") >= window).select("doc", "row", "a", "p", "others", F.explode(starts).alias("x"))
    windows = windows.select("doc", "row", F.xxhash64("x.w").alias("h"), F.xxhash64(F.lit(1), "x.w").alias("i"), (F.col("a") + F.col("x.at")).alias("s"), "p", "others")
    low = materialize(windows.groupBy("h", "i").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("high > low").select("h", "i", "low"), "crowded-windows")
    if low.count() <= BROADCAST_WINDOWS:
        low = F.broadcast(low)
    gone = windows.join(low, ["h", "i"]).where("doc > low")
    places = F.concat(F.array(F.lit(0)), F.transform("others", lambda x: x - F.col("p")))
    gone = gone.select("row", F.col("s"), F.explode(places).alias("shift"))
    return gone.select("row", (F.col("s") + F.col("shift")).cast("int").alias("a"), (F.col("s") + F.col("shift") + window).cast("int").alias("b"))


def cut_runs(texts: pa.Array, wanted: pa.Array) -> pa.Array:
    """Of each text the bytes that regions of other rows are to be compared with."""
    out = []
    for text, rows in zip(texts, wanted.to_pylist(), strict=True):
        raw = (text.as_py() or "").encode()
        out.append([{"row": r["row"], "a": r["a"], "b": r["b"], "bytes": raw[max(0, r["a"] + r["p"]) : max(0, r["b"] + r["p"])]} for r in rows])
    return pa.array(out, pa.list_(pa.struct([("row", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("bytes", pa.binary())])))


RUNS = "array<struct<row:bigint,a:int,b:int,bytes:binary>>"
#: Parts that the regions which one text is compared with are dealt to.
RUN_PARTS = 64


def agreeing(raw: bytes, a: int, b: int, other: bytes, window: int) -> list[tuple[int, int]]:
    """Parts of [a, b), a window long at least, in which ``raw`` has the bytes of ``other``."""
    if raw[a:b] == other:
        return [(a, b)]
    n = min(b - a, len(other))
    same = np.frombuffer(raw[a : a + n], np.uint8) == np.frombuffer(other[:n], np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    return [(a + int(s), a + int(e)) for s, e in zip(edge[::2], edge[1::2], strict=True) if e - s >= window]


PIECES = "array<struct<k:bigint,doc:bigint,a:int,p:int,others:array<int>,bytes:binary>>"
CUT = "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary>"


def cut_contexts(texts: pa.Array, wanted: pa.Array) -> pa.Array:
    out = []
    for text, rows in zip(texts, wanted.to_pylist(), strict=True):
        raw = (text.as_py() or "").encode()
        out.append([{"k": r["k"], "doc": r["doc"], "a": r["a"], "p": r["p"], "others": r["others"], "bytes": raw[r["a"] : r["b"]]} for r in rows])
    kind = pa.struct([("k", pa.int64()), ("doc", pa.int64()), ("a", pa.int32()), ("p", pa.int32()), ("others", pa.list_(pa.int32())), ("bytes", pa.binary())])
    return pa.array(out, pa.list_(kind))


def cut_spans(texts: pa.Array, spans: pa.Array, window: int = WINDOW) -> pa.Array:
    n_bytes, n_removed, n_spans, kept = [], [], [], []
    for text, runs in zip(texts, spans, strict=True):
        raw = (text.as_py() or "").encode()
        n_bytes.append(len(raw))
        if not runs.is_valid:
            n_removed.append(0)
            n_spans.append(0)
            kept.append(raw)
            continue
        flat = runs.values
        a, b = flat.field("a").to_numpy(zero_copy_only=False), flat.field("b").to_numpy(zero_copy_only=False)
        held = flat.field("bytes")
        ask = np.flatnonzero(held.is_valid().to_numpy(zero_copy_only=False))
        if len(ask):
            parts = [x for i in ask.tolist() for x in agreeing(raw, int(a[i]), int(b[i]), held[i].as_py(), window)]
            more = np.array(parts, np.int64).reshape(-1, 2)
            a, b = (np.concatenate([np.delete(x, ask), y]) for x, y in ((a, more[:, 0]), (b, more[:, 1])))
        if not len(a):
            n_removed.append(0)
            n_spans.append(0)
            kept.append(raw)
            continue
        order = np.argsort(a, kind="stable")
        a, b = a[order], np.maximum.accumulate(b[order])
        first = np.concatenate([[True], a[1:] > b[:-1]])
        s, e = a[first], b[np.append(np.flatnonzero(first)[1:] - 1, len(a) - 1)]
        n_removed.append(int((e - s).sum()))
        n_spans.append(len(s))
        kept.append(b"".join(raw[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(raw)], strict=True)))
    return pa.StructArray.from_arrays([pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], ["n_bytes", "n_removed", "n_spans", "kept"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """The columns of ``docs`` but for the text, and struct ``_cut``: n_bytes, n_removed, n_spans, kept (bytes).

    Texts count as UTF-8 bytes; a null one is empty, and one of fewer than ``window`` bytes is never
    cut. Ids are integers; a null id is larger than all others. Rows with one id (repeated rows
    included) are not smaller than each other, so only smaller ids cut them, each row on its own. An
    empty table gives an empty result. Other columns are kept and not read; an input column ``_cut``
    is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit((1 << 63) - 1))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    total, rows, ids = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.count("*"), F.count_distinct(key)).first()
    # Where ids are unique they name rows; else a hash of id and text does, as equal rows have equal results.
    unique = rows == ids
    row = key if unique else F.xxhash64(key, text)
    own = docs.select(key.alias("doc"), row.alias("row"), text.alias("text"))
    if not unique:
        own = own.dropDuplicates(["row"])
    n = partitions_for(spark, total)
    hot = frequent_anchors(own, total, window, gram)
    found = materialize(classes(anchor_rows(own, window, gram, PARTS * n, hot), n, hot, window, gram), "classes")
    left = found.where(F.col("k").isNotNull())
    crowded = materialize(left.groupBy("k").count().where(F.col("count") > crowd).select("k"), "crowded")
    texts = own.select("row", "text").repartition(n, "row")

    def pieces(contexts):
        wanted = contexts.groupBy("row").agg(F.collect_list(F.struct("k", "doc", "a", "p", "b", "others")).alias("wanted"))
        return texts.join(wanted, "row").select("row", F.explode(F.arrow_udf(cut_contexts, PIECES)("text", "wanted")).alias("x")).select("row", "x.*")

    whole = found.where(F.col("k").isNull())
    spans = whole.where(F.col("doc").isNull()).select("row", "a", "b")
    # Contexts of one region lie in many parts.
    joined = whole.where(F.col("doc").isNotNull()).groupBy("row", "doc", "p").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    asked = joined.groupBy("doc", F.pmod(F.xxhash64("row"), F.lit(RUN_PARTS)).alias("_part")).agg(F.collect_list(F.struct("row", "a", "b", "p")).alias("wanted"))
    runs = texts.join(asked.select(F.col("doc").alias("row"), "wanted"), "row").select(F.explode(F.arrow_udf(cut_runs, RUNS)("text", "wanted")).alias("x")).select("x.*")
    if crowded.isEmpty():
        spans = spans.unionByName(sorted_out(pieces(left), n, window))
    else:  # of rows / crowd anchors at most, so they are broadcast
        few = F.broadcast(crowded)
        spans = spans.unionByName(sorted_out(pieces(left.join(few, "k", "left_anti")), n, window)).unionByName(dealt_out(pieces(left.join(few, "k", "left_semi")), window))
    spans = spans.withColumn("bytes", F.lit(None).cast("binary")).unionByName(runs)
    gone = spans.groupBy("row").agg(F.collect_list(F.struct("a", "b", "bytes")).alias("gone"))

    @F.arrow_udf(CUT)
    def cutting(text: pa.Array, gone: pa.Array) -> pa.Array:
        return cut_spans(text, gone, window)

    cut = texts.join(gone, "row", "left").select(F.col("row").alias("_key"), cutting("text", "gone").alias("_cut"))
    rest = docs.drop(text_col)
    light = docs.select(packed(rest, "_cut"), row.alias("_own"))
    if unique and rest.columns == [id_col] and docs.schema[id_col].dataType.simpleString() == "bigint":
        # The id is all there is besides the text, so it need not be joined back.
        return cut.select(F.when(F.col("_key") != F.lit((1 << 63) - 1), F.col("_key")).alias(id_col), "_cut")
    return light.join(cut, F.col("_own") == F.col("_key")).select("_row.*", "_cut")
