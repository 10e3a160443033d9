"""Secret scan over a trigram inverted index. DataFrame functions only.

From each rule's regex a Boolean query over trigrams follows: any match holds all trigrams of one
of the query's alternatives. The index holds a posting (trigram, document) for each trigram that
some query names, stored in order of trigram, then document. The posting lists of each alternative
are intersected, and only documents in one of its rule's intersections are searched with the regex.
A rule without mandatory trigrams searches every document.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import kept, materialize, packed, scratch, shuffle_partitions

#: Strings that a part of a regex may be spelled out to.
EXACT_LIMIT = 64
#: Candidate documents (8 bytes of bits and a key each) that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Matches of which one step of a running sum takes care.
STEP = 64


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``regex`` whose ``group`` has ``least`` characters or more."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


_NAMES = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])

#: A run of at least n characters is searched as such where a shorter run holds no longer one.
RULES = (
    Rule("assign", f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
    Rule("forge", "gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", "-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
)

Query = list[frozenset[str]]
ANY: Query = [frozenset()]


def _and(a: Query, b: Query) -> Query:
    return _least([x | y for x in a for y in b])


def _least(q: Query) -> Query:
    """Without alternatives that another one implies."""
    q = list(dict.fromkeys(q))
    return [x for x in q if not any(y < x for y in q)]


def _spelled(strings: set[str]) -> Query:
    """All trigrams of one of the strings; a string under three characters demands nothing."""
    return _least([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings)])


def _part(op: object, arg: object) -> tuple[set[str] | None, Query]:
    """What a part of a regex can match: its exact strings if they are few, and a query."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}, ANY
    if name == "IN":
        chars: set[str] = set()
        for kind, x in arg:
            if str(kind) == "LITERAL":
                chars.add(chr(x).lower())
            elif str(kind) == "RANGE" and x[1] - x[0] < 8:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, ANY
        return (chars, ANY) if len(chars) <= 8 else (None, ANY)
    if name == "SUBPATTERN":
        return _sequence(arg[-1])
    if name == "BRANCH":
        parts = [_sequence(x) for x in arg[1]]
        if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= EXACT_LIMIT:
            return set().union(*(e for e, _ in parts)), ANY
        return None, _least([x for e, q in parts for x in (_spelled(e) if e is not None else q)])
    if name == "MAX_REPEAT":
        low, high, inner = arg
        exact, query = _sequence(inner)
        if exact is not None and high == 1:
            return exact | {""} if low == 0 else exact, ANY
        return None, (_spelled(exact) if exact is not None else query) if low else ANY
    return None, ANY


def _sequence(parts: object) -> tuple[set[str] | None, Query]:
    run, query, whole = {""}, ANY, True
    for op, arg in parts:
        exact, own = _part(op, arg)
        if exact is not None and len(run) * len(exact) <= EXACT_LIMIT:
            run = {a + b for a, b in itertools.product(run, exact)}
        else:
            query, run, whole = _and(_and(query, _spelled(run)), own if exact is None else _spelled(exact)), {""}, False
    return (run, ANY) if whole else (None, _and(query, _spelled(run)))


def trigram_query(regex: str) -> Query:
    """Alternatives of mandatory lower-case trigrams; a demand of nothing is an empty alternative."""
    exact, query = _sequence(regex_parser.parse(regex))
    return _spelled(exact) if exact is not None else query


def vocabulary(rules: Sequence[Rule]) -> list[str]:
    return sorted({t for r in rules for alternative in trigram_query(r.regex) for t in alternative})


def build_index(docs: DataFrame, key: str, text: Column, terms: Sequence[str]) -> DataFrame:
    """Posting lists: (term, key) of the trigrams that queries name, sorted by both over all files, so a list is read without the others."""
    low = docs.select(key, F.lower(text).alias("_low"))
    found = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in terms]))
    postings = low.select(F.explode(found).alias("term"), F.col(key).alias("key"))
    n = shuffle_partitions(docs.sparkSession)
    return materialize(postings.repartitionByRange(n, "term", "key").sortWithinPartitions("term", "key"), "postings")


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(key, rules: bits of the rules whose query the document satisfies): posting lists of each alternative, intersected.

    Alternatives with an empty list fall away first. In an alternative's lists a document has one bit
    for each trigram, however often it is posted, and is in the intersection if it has all bits.
    """
    sizes = {r["term"]: r["count"] for r in index.groupBy("term").count().collect()}  # one row for each trigram of the queries
    lists = []
    for n, rule in enumerate(rules):
        for m, alternative in enumerate(trigram_query(rule.regex)):
            # The rarest lists first; beyond 62 trigrams (bits of a number) the others are left to the regex.
            wanted = sorted(alternative, key=lambda t: (sizes.get(t, 0), t))[:62]
            if wanted and sizes.get(wanted[0], 0):
                lists += [(t, n, m, 1 << i, (1 << len(wanted)) - 1) for i, t in enumerate(wanted)]
    wanted = index.sparkSession.createDataFrame(lists, "term string, rule int, alternative int, bit bigint, every bigint")
    postings = index.where(F.col("term").isin(sorted({x[0] for x in lists}))) if lists else index.limit(0)
    both = postings.join(F.broadcast(wanted), "term").groupBy("rule", "alternative", "key").agg(F.bit_or("bit").alias("bits"), F.first("every").alias("every"))
    hit = F.call_function("shiftleft", F.lit(1), F.col("rule"))
    return both.where("bits = every").groupBy("key").agg(F.bit_or(hit).alias("rules"))


def running_sum(steps: str) -> tuple[Column, Column]:
    """Sums of whole blocks of array column ``steps`` before each block, then (over them as ``_blocks``) the sums up to each entry."""
    s = F.col(steps)
    add = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    n = F.call_function("div", F.size(s) + (STEP - 1), F.lit(STEP)).cast("int")
    blocks = F.when(F.size(s) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda c: add(F.slice(s, 1, c * STEP))))
    block = lambda i: F.call_function("div", i, F.lit(STEP)).cast("int")
    return blocks, F.transform(s, lambda _, i: F.get(F.col("_blocks"), block(i)) + add(F.slice(s, block(i) * STEP + 1, i - block(i) * STEP + 1)))


def find(rows: DataFrame, rule: Rule, rank: int, on: Column, out: str) -> DataFrame:
    """Add ``out``: the rule's spans as array of (start, rank, end), in code points; null where ``on`` is false or nothing matches."""
    text, regex = F.col("_text"), F.lit(rule.regex)
    rows = rows.withColumn("_m", F.when(on, F.regexp_extract_all(text, regex, F.lit(0))))
    rows = rows.withColumn("_m", F.when(F.size("_m") > 0, F.col("_m")))
    rows = rows.withColumn("_p", F.when(F.col("_m").isNotNull(), F.split(text, rule.regex, -1)))
    rows = rows.withColumn("_s", F.transform("_m", lambda m, i: F.length(F.get(F.col("_p"), i)) + F.when(i > 0, F.length(F.get(F.col("_m"), i - 1))).otherwise(0)))
    blocks, sums = running_sum("_s")
    rows = rows.withColumn("_blocks", blocks).withColumn("_start", sums)
    spans = F.transform("_m", lambda m, i: F.struct(F.get(F.col("_start"), i).alias("start"), F.lit(rank).alias("rank"), (F.get(F.col("_start"), i) + F.length(m)).alias("end"), (F.length(F.regexp_extract(m, rule.regex, rule.group)) >= rule.least).alias("ok")))
    return rows.withColumn(out, F.filter(spans, lambda x: x["ok"])).drop("_m", "_p", "_s", "_blocks", "_start")


def joined(spans: Column, rules: Sequence[Rule]) -> Column:
    """kind:start:end of spans in order of start, then rank, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES, base: int = 3, broadcast_rows: int = BROADCAST_ROWS, index: DataFrame | None = None) -> DataFrame:
    """All columns of ``docs`` and struct ``_secrets``: counts (of the first ``base`` rules), base, spans.

    ``base`` and ``spans`` list kind:start:end of the base rules and of all rules, starts and ends in
    code points. Per rule, matches do not overlap, leftmost first, and those that are too short are
    dropped after that. A null or empty text has no spans. Rows with one id, or with none, share
    postings, which only adds candidates: each row is searched in its own text. An empty table
    gives an empty result. Other columns are kept and not read; an input column ``_secrets`` is
    replaced. ``index`` is an earlier result of :func:`build_index` over the same documents.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    with scratch(docs.sparkSession):
        if index is None:
            index = build_index(docs.select(F.col(id_col).alias("_key"), text.alias("_text")), "_key", F.col("_text"), vocabulary(rules))
        own = kept(candidates(index, rules).withColumnRenamed("key", "_key"), "candidates")
    rows = docs.select(packed(docs, "_secrets"), F.col(id_col).alias("_id"), text.alias("_text"))
    if own.count() <= broadcast_rows:
        own = F.broadcast(own)
    rows = rows.join(own, F.col("_id").eqNullSafe(F.col("_key")), "left").drop("_id", "_key")
    for n, rule in enumerate(rules):
        on = F.lit(True) if trigram_query(rule.regex) == ANY else F.coalesce(F.col("rules").bitwiseAND(F.lit(1 << n)) > 0, F.lit(False))
        rows = find(rows, rule, n, on, f"_spans{n}")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,ok:boolean>>")
    of = lambda part: F.concat(none, *[F.coalesce(F.col(f"_spans{n}"), none) for n in part])
    counts = F.array(*[F.coalesce(F.nullif(F.size(f"_spans{n}"), F.lit(-1)), F.lit(0)).cast("bigint") for n in range(base)])
    return rows.select("_row.*", F.struct(counts.alias("counts"), joined(of(range(base)), rules).alias("base"), joined(of(range(len(rules))), rules).alias("spans")).alias("_secrets"))
