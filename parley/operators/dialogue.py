"""Nested dialogues (arrays of messages): statistics, validity, cases for evaluation, composition of long histories."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions.scalar import hash_order


def normalize_phrase(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(text)), "\\s+", " ")


def nest(messages: DataFrame, key: str, order: str, columns: Sequence[str], out: str = "messages") -> DataFrame:
    """One row per dialogue with its messages as an array in order."""
    return messages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias(out))


def statistics(dialogues: DataFrame, group: Sequence[str], messages: str = "messages") -> DataFrame:
    """Per group: dialogues, messages of each role, and characters."""
    n = lambda role: F.sum(F.size(F.filter(messages, lambda m: m["role"] == role))).alias(f"n_{role}")
    return dialogues.groupBy(*group).agg(F.count("*").alias("n_dialogues"), n("system"), n("user"), n("assistant"), F.sum(F.aggregate(messages, F.lit(0), lambda a, m: a + F.length(m["text"]))).alias("n_chars"))


def phrase_counts(dialogues: DataFrame, messages: str = "messages", role: str = "assistant", words: int = 2) -> DataFrame:
    """How often replies of a role begin with each phrase of ``words`` words."""
    said = dialogues.select(F.explode(messages).alias("m")).where(F.col("m.role") == role)
    phrase = F.array_join(F.slice(F.split(normalize_phrase(F.col("m.text")), " "), 1, words), " ")
    return said.groupBy(phrase.alias("phrase")).agg(F.count("*").alias("n"))


def heldout_cases(dialogues: DataFrame, key: str, messages: str = "messages") -> DataFrame:
    """A case for each assistant message: what came before it, and what it should say."""
    rows = dialogues.select(key, messages, F.posexplode(messages).alias("position", "m")).where("m.role = 'assistant'")
    w = Window.partitionBy(key).orderBy("position")
    return rows.select(key, "position", (F.row_number().over(w) - 1).alias("case"), F.slice(F.col(messages), 1, F.col("position")).alias("prefix"), F.col("m.text").alias("target"))


def violations(dialogues: DataFrame, key: str, messages: str = "messages") -> DataFrame:
    """Dialogues whose order of roles is broken: a system message after the first, or two messages of one role in a row."""
    m = F.col(messages)
    bad = F.transform(m, lambda x, i: ((i > 0) & (x["role"] == "system")) | ((i > 0) & (F.get(m, i - 1)["role"] == x["role"])))
    return dialogues.where(F.exists(bad, lambda b: b)).select(key)


def pending_calls(messages: DataFrame, key: str, order: str) -> DataFrame:
    """Messages with the calls that are open before each: calls so far less results so far (columns n_calls, n_results)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("open_calls", F.coalesce(F.sum(F.col("n_calls") - F.col("n_results")).over(w), F.lit(0)))


def concatenate(composed: DataFrame, dialogues: DataFrame, key: str, group: Sequence[str], messages: str = "messages") -> DataFrame:
    """Each composition's messages in order, renumbered, with the first system message alone."""
    by = [*group, "composition"]
    joined = composed.join(dialogues.select(key, messages), key)
    every = joined.groupBy(*by).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", messages))), lambda x: x[messages])).alias("_m"))
    first = F.get(F.filter("_m", lambda m: m["role"] == "system"), 0)
    rest = F.filter("_m", lambda m: m["role"] != "system")
    whole = F.concat(F.when(first.isNotNull(), F.array(first)).otherwise(F.slice(rest, 1, 0)), rest)
    return every.select(*by, F.transform(whole, lambda m, i: F.struct(i.alias("number"), m["role"].alias("role"), m["text"].alias("text"))).alias(messages))


def stratified(df: DataFrame, bucket: str, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows: one of each bucket first, then at random; repeatable."""
    order = hash_order(seed, key)
    w = Window.partitionBy(bucket).orderBy(order, key)
    ranked = df.withColumn("_o", order).withColumn("_first", (F.row_number().over(w) > 1).cast("int"))
    return ranked.orderBy("_first", "_o", key).limit(n).drop("_o", "_first")


def calculate(expression: str) -> str | None:
    """Value of an arithmetic expression in decimals: + - * / and brackets; None if it is malformed, too long, or divides by zero."""
    import ast
    from decimal import Context, Decimal, DecimalException

    if len(expression) > 160:
        return None
    context = Context(prec=28)
    ops = {ast.Add: context.add, ast.Sub: context.subtract, ast.Mult: context.multiply, ast.Div: context.divide}

    def value(node: ast.expr) -> Decimal:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return Decimal(str(node.value))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -value(node.operand) if isinstance(node.op, ast.USub) else value(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in ops:
            return ops[type(node.op)](value(node.left), value(node.right))
        raise ValueError

    try:
        return f"{value(ast.parse(expression.strip(), mode='eval').body).normalize():f}"
    except (ValueError, SyntaxError, DecimalException, RecursionError):
        return None


def calculated(text: Column) -> Column:
    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if t is None else calculate(t) for t in x.to_pylist()], pa.string())

    return run(text)
