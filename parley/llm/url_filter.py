"""URL filter: host and path rules, then a character language-model ratio. DataFrame functions only.

Two smoothed Markov models, of accepted and of rejected URLs, predict each character from up to
two before it: a context's estimate is interpolated with that of the next shorter context in
proportion to how many different characters followed it (Witten-Bell), so contexts are as long
as the data bear, down to none. The models learn from the URLs that the rules allow and block, and
carry that over to URLs without a rule. A URL's score is the sum of log ratios divided by its
length; the threshold is the highest that costs at most ``MAX_LOSS`` of the accepted URLs in the
calibration share.

Characters are dealt to 41 symbols, so both models together are one table of 41**3 log ratios,
whatever the corpus: it enters the plan as one array, and scoring needs no join.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.llm.common import packed

#: Symbols 1 to 40; symbol 0 is any other character, and stands before the first.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./-?"
SYMBOLS = len(ALPHABET) + 1
#: One host in this many calibrates the threshold; its URLs are not learnt from.
CALIBRATION = 5
#: Share of accepted URLs that the threshold may cost.
MAX_LOSS = 0.01
#: Steps of the score that thresholds are searched in.
STEP = 0.01
#: A context counts from this many characters on.
MIN_CONTEXT = 4

#: (verdict, rule): a rule is a host and the start of a path, as ``example.com/en/7``.
Rule = tuple[str, str]


def rest_of(url: Column) -> Column:
    """After the first ``://``; empty without one, or for a null."""
    at = F.call_function("locate", F.lit("://"), url)
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def host_of(url: Column) -> Column:
    """Up to the first ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    return F.translate(F.regexp_extract(rest_of(url), "(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(rest_of(url), "(?s)^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    text = verdict = F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of, slash, start = rule.partition("/")
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(slash + start))
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def unnamed(url: Column, host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The URL after its ``://`` without what rules look at: as many last labels of the host, first segments of the path and characters after them as any rule names, whatever they are."""
    starts = [r.partition("/")[2] for _, r in rules]
    labels = max((r.partition("/")[0].count(".") + 1 for _, r in rules), default=0)
    segments, chars = max((s.count("/") for s in starts), default=0), max((len(s.rpartition("/")[2]) for s in starts), default=0)
    host_rest = F.array_join(F.slice(F.split(host, r"\."), 1, F.greatest(F.lit(0), F.size(F.split(host, r"\.")) - labels)), ".")
    path_rest = F.regexp_replace(path, f"^(?:/[^/]*){{0,{segments}}}/?[^/]{{0,{chars}}}", "")
    return F.concat(host_rest, F.lit("/"), path_rest, F.regexp_extract(rest_of(url), "(?s)[?#].*$", 0))


def symbols(url: Column) -> Column:
    """The URL as an array of symbols."""
    chars = F.filter(F.split(F.lower(F.coalesce(url, F.lit(""))), ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.call_function("locate", c, F.lit(ALPHABET)))


def grams(codes: str) -> Column:
    """Index of each symbol of column ``codes``, with the two before it, in the table of log ratios."""
    at = lambda i: F.coalesce(F.get(F.col(codes), i), F.lit(0))
    return F.transform(F.col(codes), lambda c, i: at(i - 2) * (SYMBOLS * SYMBOLS) + at(i - 1) * SYMBOLS + c)


def log_ratios(labelled: DataFrame) -> DataFrame:
    """(gram, ratio): log P(accepted) - log P(rejected) of each of the SYMBOLS**3 grams, as learnt from ``labelled`` (grams, accepted)."""
    seen = labelled.select("accepted", F.explode("grams").alias("gram")).groupBy("accepted", "gram").agg(F.count("*").alias("n"))
    every = labelled.sparkSession.range(SYMBOLS**3).select(F.col("id").cast("int").alias("gram"))
    both = every.withColumn("accepted", F.explode(F.array(F.lit(True), F.lit(False)))).join(seen, ["accepted", "gram"], "left").fillna(0, ["n"])
    c, ab = F.col("gram") % SYMBOLS, F.call_function("div", F.col("gram"), F.lit(SYMBOLS))
    t = both.withColumns({"c": c, "ab": ab, "b": ab % SYMBOLS})
    of = lambda *k: Window.partitionBy("accepted", *k)
    t = t.withColumns({"n_ab": F.sum("n").over(of("ab")), "t_ab": F.sum((F.col("n") > 0).cast("int")).over(of("ab")), "n_bc": F.sum("n").over(of("b", "c")), "n_c": F.sum("n").over(of("c")), "n_all": F.sum("n").over(of())})
    t = t.withColumns({"n_b": F.sum("n").over(of("b")), "t_b": F.size(F.collect_set(F.when(F.col("n_bc") > 0, F.col("c"))).over(of("b")))})
    p0 = (F.col("n_c") + 0.5) / (F.col("n_all") + 0.5 * SYMBOLS)
    p1 = F.when(F.col("n_b") < MIN_CONTEXT, p0).otherwise((F.col("n_bc") + F.col("t_b") * p0) / (F.col("n_b") + F.col("t_b")))
    p2 = F.when(F.col("n_ab") < MIN_CONTEXT, p1).otherwise((F.col("n") + F.col("t_ab") * p1) / (F.col("n_ab") + F.col("t_ab")))
    return t.groupBy("gram").agg((F.sum(F.when(F.col("accepted"), F.log(p2)).otherwise(-F.log(p2)))).alias("ratio"))


def score(grams_col: str, ratios: Column) -> Column:
    """Length-normalised log-likelihood difference, 0 for an empty URL."""
    total = F.aggregate(F.col(grams_col), F.lit(0.0), lambda acc, g: acc + F.get(ratios, g))
    return F.coalesce(total / F.nullif(F.size(grams_col), F.lit(0)), F.lit(0.0))


def best_threshold(scored: DataFrame) -> float | None:
    """The highest score, in steps, under which at most MAX_LOSS of the accepted lie, where any rejected do; None without both."""
    bins = scored.groupBy(F.floor(F.col("score") / STEP).alias("bin")).agg(F.sum((~F.col("accepted")).cast("long")).alias("bad"), F.sum(F.col("accepted").cast("long")).alias("good"))
    every, upto = Window.partitionBy(), Window.orderBy("bin")
    cost = F.sum("good").over(upto) / F.nullif(F.sum("good").over(every), F.lit(0))
    best = bins.select("bin", cost.alias("cost"), F.sum("bad").over(upto).alias("found")).where((F.col("cost") <= MAX_LOSS) & (F.col("found") > 0)).orderBy(F.col("bin").desc()).first()
    return None if best is None else (best["bin"] + 1) * STEP


def filter_urls(pages: DataFrame, rules: Sequence[Rule], label: Column | None = None, url_col: str = "url") -> DataFrame:
    """All columns of ``pages`` and struct ``_url``: host, path, rule, verdict (allow, block), score.

    The longest rule that fits decides; else the model does, and blocks URLs that score under the
    threshold. The models learn from the verdicts of the rules, or from ``label`` (allow, block or
    null, an expression over columns host, path and by_rule) where one is given. A null URL, or one
    without ``://``, has an empty host and path, meets no rule and trains no model; scored on its
    characters, all of them however many, a null scores 0. Repeated rows are judged alike, each on its own. An empty table gives
    an empty result; with nothing to learn rejected or accepted URLs from, the models block nothing.
    Other columns are kept and not read; an input column ``_url`` is replaced.
    """
    url = F.col(url_col).cast("string")
    own = pages.select(packed(pages, "_url"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    text = F.when(F.col("host") == "", F.col("url")).otherwise(unnamed(F.col("url"), F.col("host"), F.col("path"), rules))
    own = own.select("_row", "host", "path", symbols(text).alias("codes"), F.pmod(F.xxhash64("host"), F.lit(CALIBRATION)).alias("share"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    own = own.select("_row", "host", "path", "share", grams("codes").alias("grams"), rule.alias("rule"), verdict.alias("by_rule"))
    kind = F.col("by_rule") if label is None else label
    labelled = own.where((F.col("host") != "") & kind.isin("allow", "block")).select("grams", "share", (kind == "allow").alias("accepted"))
    ratios = [0.0] * SYMBOLS**3
    for r in log_ratios(labelled.where("share > 0")).collect():  # SYMBOLS**3 numbers, whatever the input
        ratios[r["gram"]] = r["ratio"]
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")  # folded to a literal
    cut = best_threshold(labelled.where("share = 0").select("accepted", score("grams", table).alias("score")))
    scored = own.withColumn("score", score("grams", table))
    low = F.lit(False) if cut is None else F.col("score") < cut
    verdict = F.coalesce(F.col("by_rule"), F.when(low, "block").otherwise("allow"))
    return scored.select("_row.*", F.struct("host", "path", "rule", verdict.alias("verdict"), "score").alias("_url"))
