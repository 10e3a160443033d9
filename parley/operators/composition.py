"""Longer histories out of short dialogues: packed by numbers of alike dialogues, not dialogue by dialogue.

Dialogues of one bucket and one number of user turns are alike for packing. So each group is planned
on its table of counts, which is small whatever the corpus: patterns of a few kinds that add up to a
history, and how often each is used. Then every dialogue takes the slot that its rank among the
alike ones points to. Ranks come from hashes, in slices, so no kind gathers in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions.scalar import hash_order

#: Slices that the dialogues of one kind are ranked in.
SLICES = 256

Kind = tuple[str, int]


def _next(counts: dict[Kind, int], used: dict[Kind, int], seen: list[str], room: int) -> Kind | None:
    """The kind to go on with: of a bucket not seen yet, else of another than the last, else any; of those the most numerous that fits."""
    fits = [k for k, n in counts.items() if n > used.get(k, 0) and k[1] <= room]
    fresh = [k for k in fits if k[0] not in seen] or [k for k in fits if not seen or k[0] != seen[-1]] or fits
    return max(fresh, key=lambda k: (counts[k] - used.get(k, 0), k), default=None)


def plan(counts: dict[Kind, int], least: int, most: int) -> list[tuple[list[Kind], int, bool]]:
    """Patterns (kinds in order, times, whole) that place each of ``counts`` once: of two buckets or more and ``least`` to ``most`` turns where ``whole``.

    Targets go round from most to least. A pattern is used for half of what its scarcest kind
    allows, so that patterns stay mixed. What makes no pattern of its own joins, kind by kind, the
    patterns with the most room left, those without its bucket first; what fits nowhere stands
    alone, not whole.
    """
    left = {k: n for k, n in sorted(counts.items()) if n > 0}
    made: list[tuple[list[Kind], int]] = []
    target = most
    while left:
        used: dict[Kind, int] = {}
        pattern: list[Kind] = []
        turns = 0
        while turns < target and (k := _next(left, used, [b for b, _ in pattern], most - turns)) is not None:
            pattern.append(k)
            used[k] = used.get(k, 0) + 1
            turns += k[1]
        if turns < least or len({b for b, _ in pattern}) < 2:
            break
        times = max(1, min(left[k] // n for k, n in used.items()) // 2)
        made.append((pattern, times))
        for k, n in used.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
        target = target - 1 if target > least else most
    alone: list[tuple[list[Kind], int, bool]] = []
    for kind in sorted(left, key=lambda k: (-k[1], k)):
        n = left[kind]
        while n:
            room = [(kind[0] not in {b for b, _ in p}, most - sum(t for _, t in p), -i) for i, (p, m) in enumerate(made) if m]
            room = [r for r in room if r[1] >= kind[1]]
            if not room:
                alone.append(([kind], n, False))
                break
            i = -max(room)[2]
            pattern, times = made[i]
            take = min(n, times)
            made[i] = (pattern, times - take)
            made.append((pattern + [kind], take))
            n -= take
    return [(p, m, True) for p, m in made if m] + alone


def ranked(df: DataFrame, kind: Sequence[str], key: str, seed: str, out: str = "rank") -> DataFrame:
    """``df`` with the rank (from 0) of each row among those of its ``kind``, by a hash of ``key``."""
    kind = list(kind)
    own = df.withColumn("_order", hash_order(seed, key)).withColumn("_slice", F.conv(F.substring("_order", 1, 8), 16, 10).cast("bigint") % SLICES)
    sizes = own.groupBy(*kind, "_slice").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*kind).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*kind, "_slice").orderBy("_order", key)) - 1
    return own.withColumn("_within", within).join(before, [*kind, "_slice"]).withColumn(out, (F.col("_before") + F.col("_within")).cast("bigint")).drop("_order", "_slice", "_within", "_before")


def plans(kinds: DataFrame, group: Sequence[str], least: int, most: int) -> DataFrame:
    """(group, bucket, turns, first, times, base, place, whole) of ``kinds`` (group, bucket, turns, n): which ranks of a kind take which slot.

    Ranks first, first + 1, ... of ``times`` dialogues stand at ``place`` of compositions base, base + 1, ...
    """
    group = list(group)
    schema = kinds.select(*group, "bucket", "turns").schema
    whole_schema = schema.add("first", "long").add("times", "long").add("base", "long").add("place", "integer").add("whole", "boolean")

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        counts = {(r["bucket"], r["turns"]): r["n"] for r in rows}
        out = []
        next_rank = dict.fromkeys(counts, 0)
        base = 0
        for pattern, times, whole in plan(counts, least, most):
            for place, kind in enumerate(pattern):
                out.append({g: rows[0][g] for g in group} | {"bucket": kind[0], "turns": kind[1], "first": next_rank[kind], "times": times, "base": base, "place": place, "whole": whole})
                next_rank[kind] += times
            base += times
        return pa.Table.from_pylist(out, table.select([*group, "bucket", "turns"]).schema.append(pa.field("first", pa.int64())).append(pa.field("times", pa.int64())).append(pa.field("base", pa.int64())).append(pa.field("place", pa.int32())).append(pa.field("whole", pa.bool_())))

    return kinds.groupBy(*group).applyInArrow(run, whole_schema)


def compose(dialogues: DataFrame, key: str, group: Sequence[str], bucket: str, turns: str, seed: str, least: int = 8, most: int = 16) -> DataFrame:
    """(group, composition, place, key, bucket, turns, whole): each dialogue once, in histories of ``least`` to ``most`` turns of two buckets or more.

    Where ``whole`` is false a dialogue fits no history and stands alone. The same for any
    partitioning; ``seed`` decides who meets whom. Keys are unique; null buckets count as one bucket
    of their own; dialogues without turns (null or none) count as one turn.
    """
    group = list(group)
    d = dialogues.select(F.col(key).alias("key"), *group, F.coalesce(F.col(bucket).cast("string"), F.lit("")).alias("bucket"), F.greatest(F.lit(1), F.coalesce(F.col(turns).cast("int"), F.lit(1))).alias("turns"))
    kind = [*group, "bucket", "turns"]
    slots = plans(d.groupBy(*kind).agg(F.count("*").alias("n")), group, least, most)
    ranges = slots.groupBy(*kind).agg(F.collect_list(F.struct("first", "times", "base", "place", "whole")).alias("slots"))  # of a kind, as many as there are patterns
    hit = F.filter("slots", lambda s: (F.col("rank") >= s["first"]) & (F.col("rank") < s["first"] + s["times"]))
    met = ranked(d, kind, "key", seed).join(ranges, kind).withColumn("s", F.get(hit, 0))
    return met.select(*group, (F.col("s.base") + F.col("rank") - F.col("s.first")).alias("composition"), F.col("s.place").alias("place"), F.col("key").alias(key), "bucket", "turns", F.col("s.whole").alias("whole"))
