"""Words of transcripts: normal forms, alignment and error counts, disfluencies, merging of transcripts, chunks."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.operators import intervals
from parley.operators.folds import fold

# Fixed value: what a normal token looks like.
TOKEN = "[a-z0-9]+(?:[-'][a-z0-9]+)*-?"
# Fillers by class.
FILLERS = {"um": ("um", "umm", "uhm"), "uh": ("uh", "er", "eh"), "mhm_mm": ("mhm", "mm", "mm-hmm", "mmhm"), "hmm": ("hmm", "hm"), "uh_huh": ("uh-huh", "uhuh")}
# Probes of a recording's language.
PROBES, PROBE_SECONDS, PROBES_KEPT, PROBE_DB = 9, 8.0, 3, -55.0
OPS = ("equal", "delete", "insert", "substitute")


def normalize_token(text: Column) -> Column:
    """First token of the lowered text; '' without one. Text with compatibility characters goes through :func:`nfkc` first."""
    return F.regexp_extract(F.lower(text), TOKEN, 0)


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition; only texts with other than ASCII pass through Python."""

    @F.arrow_udf("string")
    def compose(x: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in x.to_pylist()], pa.string())

    return F.when(F.length(text) == F.octet_length(text), text).otherwise(compose(text))


def tokens(text: Column) -> Column:
    """Normal tokens of a text, empty ones left out."""
    return F.filter(F.transform(F.split(text, "\\s+"), normalize_token), lambda t: t != "")


def align(reference: Sequence[str], hypothesis: Sequence[str]) -> list[tuple[str, int, int]]:
    """Cheapest edits as (op, reference index, hypothesis index), -1 for none; among equally cheap ways back: equal, delete, insert, substitute."""
    vocabulary: dict[str, int] = {}
    r, h = (np.array([vocabulary.setdefault(w, len(vocabulary)) for w in x], np.int64) for x in (reference, hypothesis))
    n, m = len(r), len(h)
    steps = np.arange(m + 1, dtype=np.int32)
    last, ways = steps, []  # one row of costs; of each cell only its way back, in two bits
    for i in range(1, n + 1):
        best = np.empty(m + 1, np.int32)
        best[0] = i
        same = h == r[i - 1]
        np.minimum(last[1:] + 1, last[:-1] + ~same, out=best[1:])
        cost = np.minimum.accumulate(best - steps) + steps  # insertions chain from the left
        way = np.where(same & (cost[1:] == last[:-1]), 0, np.where(cost[1:] == last[1:] + 1, 1, np.where(cost[1:] == cost[:-1] + 1, 2, 3)))
        ways.append((np.packbits(way & 1), np.packbits(way >> 1)))
        last = cost
    out, i, j = [], n, m
    while i or j:
        if i and j:
            low, high = ways[i - 1]
            at, shift = (j - 1) >> 3, 7 - ((j - 1) & 7)
            op = OPS[(low[at] >> shift & 1) | (high[at] >> shift & 1) << 1]
        else:
            op = "delete" if i else "insert"
        i, j = i - (op != "insert"), j - (op != "delete")
        out.append((op, -1 if op == "insert" else i, -1 if op == "delete" else j))
    return out[::-1]


def with_alignment(df: DataFrame, reference: str, hypothesis: str, out: str = "alignment") -> DataFrame:
    """``df`` with the alignment of two arrays of tokens: array of (op, ref, hyp)."""
    kind = "array<struct<op:string,ref:int,hyp:int>>"

    @F.arrow_udf(kind)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = [[{"op": o, "ref": i, "hyp": j} for o, i, j in align(x or [], y or [])] for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
        return pa.array(rows, pa.list_(pa.struct([("op", pa.string()), ("ref", pa.int32()), ("hyp", pa.int32())])))

    return df.withColumn(out, run(reference, hypothesis))


def error_counts(alignment: str) -> dict[str, Column]:
    """substitutions, insertions, deletions, reference words, and the error rate (0 without reference words)."""
    def count(op: str) -> Column:
        return F.size(F.filter(alignment, lambda x: x["op"] == op)).cast("bigint")

    n = {o: count(o) for o in OPS}
    words = n["equal"] + n["delete"] + n["substitute"]
    errors = n["substitute"] + n["insert"] + n["delete"]
    return {"substitutions": n["substitute"], "insertions": n["insert"], "deletions": n["delete"], "n_words": words, "wer": F.when(words > 0, errors / words).otherwise(0.0)}


def class_metrics(df: DataFrame, reference: str, hypothesis: str, alignment: str, members: Sequence[str]) -> DataFrame:
    """``df`` with tp, fp, fn, precision, recall, f1 of a class of tokens over aligned pairs."""
    known = F.array(*[F.lit(m) for m in members])
    is_in = lambda arr, i: F.coalesce(F.array_contains(known, F.get(F.col(arr), i)), F.lit(False))
    count = lambda f: F.size(F.filter(alignment, f)).cast("bigint")
    a, b = (lambda x: is_in(reference, x["ref"])), (lambda x: is_in(hypothesis, x["hyp"]))
    out = df.withColumns({"tp": count(lambda x: a(x) & b(x)), "fp": count(lambda x: ~a(x) & b(x)), "fn": count(lambda x: a(x) & ~b(x))})
    ratio = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def repetitions(words: str) -> Column:
    """Tokens that equal the one before."""
    return F.filter(F.transform(F.col(words), lambda t, i: F.when((i > 0) & (F.get(F.col(words), i - 1) == t), t)), lambda t: t.isNotNull())


def partials(words: str) -> Column:
    """Tokens broken off: those that end in a hyphen."""
    return F.filter(F.col(words), lambda t: F.endswith(t, F.lit("-")) & (F.length(t) > 1))


def recalled(events: Column, found: Column) -> Column:
    """How many of an array's events another array has as well, each of its own once."""
    count = lambda arr, t: F.size(F.filter(arr, lambda x: x == t))
    return F.aggregate(F.array_distinct(events), F.lit(0), lambda n, t: n + F.least(count(events, t), count(found, t))).cast("bigint")


def disfluencies(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """``df`` with numbers of repetitions and broken-off words: expected, found, recalled, and their recall (0 without any)."""
    out = df
    for name, of in (("repetition", repetitions), ("partial", partials)):
        a, b = of(reference), of(hypothesis)
        hit = recalled(a, b)
        n = F.size(a).cast("bigint")
        out = out.withColumns({f"{name}_expected": n, f"{name}_found": F.size(b).cast("bigint"), f"{name}_recalled": hit, f"{name}_recall": F.when(n > 0, hit / n).otherwise(0.0)})
    return out


def evaluate(df: DataFrame, reference: str, hypothesis: str, alignment: str = "alignment") -> DataFrame:
    """``df`` with what is said of a transcript: word errors, each class of fillers and all together, disfluencies. Names end in the class."""
    out = with_alignment(df, reference, hypothesis, alignment)
    out = disfluencies(out.withColumns(error_counts(alignment)), reference, hypothesis)
    for name, members in {**FILLERS, "filler_any": sum(FILLERS.values(), ())}.items():
        out = class_metrics(out, reference, hypothesis, alignment, members)
        out = out.withColumnsRenamed({c: f"{c}_{name}" for c in ("tp", "fp", "fn", "precision", "recall", "f1")})
    return out


def largest_errors(pairs: DataFrame, keys: Sequence[str], k: int = 25) -> DataFrame:
    """The ``k`` pairs of equal words (ref_start, ref_end, start, end; null where unknown) of each key with the largest error of start or end."""
    a, b = F.col("start") - F.col("ref_start"), F.col("end") - F.col("ref_end")
    most = F.coalesce(F.greatest(F.abs(a), F.abs(b)), F.lit(0.0))
    x = pairs.withColumns({"start_error": a, "end_error": b, "largest": most})
    w = Window.partitionBy(*keys).orderBy(F.col("largest").desc(), "ref_start", "ref_end", "start", "end")
    return x.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def probe_windows(duration: Column, length: float = PROBE_SECONDS, n: int = PROBES) -> Column:
    """Evenly spread windows of a recording, the first at its start and the last at its end; one where there is no room for more."""
    size = F.least(duration, F.lit(float(length)))
    room = F.greatest(F.lit(0.0), duration - size)
    many = F.transform(F.sequence(F.lit(0), F.lit(max(1, n - 1))), lambda i: F.struct((room * i / max(1, n - 1)).alias("start"), size.alias("length")))
    return F.when((room == 0) | F.lit(n == 1), F.array(F.struct(F.lit(0.0).alias("start"), size.alias("length")))).otherwise(many)


def active_windows(windows: DataFrame, keys: Sequence[str], db: str = "db", k: int = PROBES_KEPT, least: float = PROBE_DB) -> DataFrame:
    """The ``k`` loudest windows of each key that are not too quiet."""
    w = Window.partitionBy(*keys).orderBy(F.col(db).desc(), "start")
    return windows.where(F.col(db) >= least).withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= k).drop("_place")


def placement(match: str, words: str, mode: str, milliseconds: Column) -> Column:
    """Where a reply goes by a match (first, end) in timed words: after the anchor, or before its end, its start or its last word.

    ``mode``: backchannel (delay after the end), at_anchor_end, at_anchor_start, before_last_word (lead, not before 0).
    """
    word = lambda i: F.get(F.col(words), i)
    last = word(F.col(f"{match}.end") - 1)
    at = {"backchannel": last["end"], "at_anchor_end": last["end"], "at_anchor_start": word(F.col(f"{match}.first"))["start"], "before_last_word": last["start"]}[mode]
    return at + milliseconds / 1000.0 if mode == "backchannel" else F.greatest(F.lit(0.0), at - milliseconds / 1000.0)


def pause_after(match: str, words: str) -> Column:
    """Milliseconds between the end of a match and the next word; null at the end of the transcript."""
    end = F.col(f"{match}.end")
    return F.round(F.greatest(F.lit(0.0), F.get(F.col(words), end)["start"] - F.get(F.col(words), end - 1)["end"]) * 1000).cast("int")


def multiset_recall(a: DataFrame, b: DataFrame, keys: Sequence[str], token: str) -> DataFrame:
    """(keys, expected, recalled): size of ``a``'s multiset of tokens, and of its intersection with ``b``'s."""
    n = lambda x, c: x.groupBy(*keys, token).agg(F.count("*").alias(c))
    both = n(a, "_a").join(n(b, "_b"), [*keys, token], "left").fillna(0, ["_b"])
    return both.groupBy(*keys).agg(F.sum("_a").alias("expected"), F.sum(F.least("_a", "_b")).alias("recalled"))


def timestamp_metrics(errors: DataFrame, keys: Sequence[str], error: str) -> DataFrame:
    """Count, median, mean and p90 of absolute errors, shares within 50, 100, 200 ms and over 500 ms, median bias."""
    a = F.abs(F.col(error))
    within = lambda x: F.avg((a <= x).cast("double"))
    return errors.groupBy(*keys).agg(F.count(error).alias("n"), F.percentile(a, 0.5).alias("median"), F.avg(a).alias("mean"), F.percentile(a, 0.9).alias("p90"), within(0.05).alias("within_50ms"), within(0.1).alias("within_100ms"), within(0.2).alias("within_200ms"), F.avg((a > 0.5).cast("double")).alias("over_500ms"), F.percentile(error, 0.5).alias("median_bias"))


def union_words(primary: DataFrame, secondary: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Primary words, and secondary ones that not even touch a primary one; words without times come last."""
    timed = secondary.where("start is not null and end is not null")
    extra = intervals.overlap_join(timed, primary.where("start is not null and end is not null"), keys, width, closed=True, how="left_anti")
    return primary.unionByName(extra).unionByName(secondary.where("start is null or end is null"))


def merge_aligned(df: DataFrame, primary: str, secondary: str, alignment: str, out: str = "merged") -> DataFrame:
    """Consensus of two arrays of words (text, start, end, confidence): equal ones get mean times, all others stay, by start."""
    p, s = (lambda i: F.get(F.col(primary), i)), (lambda i: F.get(F.col(secondary), i))
    mean = lambda a, b: F.coalesce((a + b) / 2, a, b)

    def words(x):
        a, b = p(x["ref"]), s(x["hyp"])
        both = F.struct(a["text"].alias("text"), *[mean(a[c], b[c]).alias(c) for c in ("start", "end", "confidence")])
        return F.when(x["op"] == "equal", F.array(both)).otherwise(F.array_compact(F.array(F.when(x["ref"] >= 0, a), F.when(x["hyp"] >= 0, b))))

    merged = F.flatten(F.transform(alignment, words))
    by_start = F.array_sort(F.transform(merged, lambda w, i: F.struct(w["start"].isNull().alias("n"), w["start"].alias("s"), i.alias("i"), w.alias("w"))))
    return df.withColumn(out, F.transform(by_start, lambda x: x["w"]))


def progressive_merge(transcripts: DataFrame, keys: Sequence[str], rank: str = "rank", words: str = "words") -> DataFrame:
    """(keys, place, text, start, end, confidence): the words of all of a recording's transcripts, merged one after the other by ``rank``.

    Every next transcript is aligned with what the ones before have become: equal words get the
    mean of both times and confidences (of the one that has any) and keep the first text; of unlike
    ones both stay, the earlier first; all others stay where the alignment has them. Words without a
    token vanish, as they cannot be aligned, from the second transcript on. ``words``: arrays of
    structs with text, start, end, confidence; null arrays are empty ones.
    """
    keys = list(keys)
    own = F.transform(F.coalesce(F.col(words), F.array().cast(transcripts.schema[words].dataType)), lambda w: F.struct(w["text"].alias("text"), *[w[c].cast("double").alias(c) for c in ("start", "end", "confidence")], F.coalesce(normalize_token(w["text"]), F.lit("")).alias("token")))
    rows = transcripts.select(*keys, rank, own.alias("_w"))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def mean(a, b):
        return b if a is None else a if b is None else (a + b) / 2

    def merge(key, models):
        merged, first = [], True
        for *_, own in models:
            if first:
                merged, first = own, False
                continue
            a, b, out = [w for w in merged if w["token"]], [w for w in own if w["token"]], []
            for op, i, j in align([w["token"] for w in a], [w["token"] for w in b]):
                if op == "equal":
                    out.append(a[i] | {c: mean(a[i][c], b[j][c]) for c in ("start", "end", "confidence")})
                elif op == "substitute":
                    out += sorted((a[i], b[j]), key=lambda w: float("inf") if w["start"] is None else w["start"])
                else:
                    out.append(a[i] if op == "delete" else b[j])
            merged = out
        for n, w in enumerate(merged):
            yield (*key, n, w["text"], w["start"], w["end"], w["confidence"])

    return fold(rows, keys, [rank], f"{kinds}, place int, text string, start double, end double, confidence double", merge)


def chunk_windows(duration: Column, length: float = 30.0, overlap: float = 1.0) -> Column:
    """Chunks of a recording: start, end, and the part whose words each keeps (up to the middle of what two share); the last one reaches the end."""
    hop = length - overlap
    n = F.greatest(F.ceil((duration - overlap) / hop), F.lit(1)).cast("int")
    first = lambda i: i * hop
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(first(i).alias("start"), F.least(duration, first(i) + length).alias("end"), F.when(i == 0, 0.0).otherwise(first(i) + overlap / 2).alias("keep_from"), F.when(i == n - 1, duration).otherwise(first(i + 1) + overlap / 2).alias("keep_to")))


def global_words(words: DataFrame) -> DataFrame:
    """Words of chunks (start, end within the chunk; chunk struct) on the recording's clock, kept where their middle is in the chunk's part."""
    middle = (F.col("start") + F.col("end")) / 2 + F.col("chunk.start")
    kept = words.where((middle >= F.col("chunk.keep_from")) & ((middle < F.col("chunk.keep_to")) | (F.col("chunk.keep_to") == F.col("chunk.end"))))
    return kept.withColumns({"start": F.col("start") + F.col("chunk.start"), "end": F.col("end") + F.col("chunk.start")})


def merge_pieces(pieces: DataFrame, keys: Sequence[str], order: str, text: str = "text") -> DataFrame:
    """Sub-word pieces made words: one that begins with a space begins a word."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = pieces.withColumn("_w", F.sum(F.when(F.startswith(text, F.lit(" ")) | (F.row_number().over(w) == 1), 1).otherwise(0)).over(w))
    return marked.groupBy(*keys, "_w").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "")).alias(text), F.min("start").alias("start"), F.max("end").alias("end")).drop("_w")


def stable_prefix(previous: Column, current: Column) -> Column:
    """Longest common prefix of two texts, cut after the last space or punctuation in it; all of it if they are equal."""
    n = F.least(F.length(previous), F.length(current))
    a, b = F.split(previous, ""), F.split(current, "")
    first = F.array_min(F.filter(F.transform(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda same, i: F.when(~same, i)), lambda i: i.isNotNull()))
    length = F.least(F.coalesce(first, n), n)
    common = F.substr(current, F.lit(1), length)
    return F.when(previous == current, current).otherwise(F.regexp_extract(common, "(?s)^.*[\\s.,!?;:]", 0))


def best_anchor(words: Sequence[str], anchor: Sequence[str], least: float = 0.55) -> tuple[int, int, float] | None:
    """(first, end, ratio) of the run of words most like ``anchor``, 2 words shorter to 3 longer; the first of equals."""
    from difflib import SequenceMatcher

    goal, best = " ".join(anchor), None
    for n in range(max(1, len(anchor) - 2), len(anchor) + 4):
        for i in range(len(words) - n + 1):
            ratio = SequenceMatcher(None, " ".join(words[i : i + n]), goal).ratio()
            if best is None or ratio > best[2]:
                best = (i, i + n, ratio)
    return best if best and best[2] >= least else None


def with_anchor(df: DataFrame, words: str, anchor: str, out: str = "match") -> DataFrame:
    """``df`` with the best fuzzy match of array ``anchor`` in array ``words``: struct first, end, ratio, or null."""

    @F.arrow_udf("struct<first:int,end:int,ratio:double>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = [best_anchor(x or [], y or []) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
        return pa.array([None if r is None else {"first": r[0], "end": r[1], "ratio": r[2]} for r in rows], pa.struct([("first", pa.int32()), ("end", pa.int32()), ("ratio", pa.float64())]))

    return df.withColumn(out, run(words, anchor))
