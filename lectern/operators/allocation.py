"""Balanced choice of error types: which to inject how often."""

from __future__ import annotations

import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.storage import numbered
from lectern.taxonomy import ERROR_TYPES


def seeded(seed: int, *parts: object) -> int:
    """A number that stands for a random draw: the same for the same seed and parts."""
    return zlib.crc32("\x1f".join(map(str, (seed, *parts))).encode())


def allocate(dims: list[str], num: int, used: dict[str, int] | None = None, seed: int = 0) -> dict[str, int]:
    """How many of num errors each dimension gets: always the least used type next, then the least used dimension."""
    if num < len(dims):
        raise ValueError(f"{num} errors do not suffice for {len(dims)} dimensions")
    used = used or {}
    types = [(d, t) for d in dims for t in ERROR_TYPES.get(d, [])]
    counts, local = dict.fromkeys(dims, 0), {t: 0 for _, t in types}
    for step in range(num if types else 0):
        dim, kind = min(types, key=lambda x: (used.get(x[1], 0) + local[x[1]], counts[x[0]], seeded(seed, step, x[1])))
        counts[dim] += 1
        local[kind] += 1
    return counts


def least_used_order(types: Iterable[str], used: dict[str, int], seed: int = 0) -> list[str]:
    return sorted(types, key=lambda t: (used.get(t, 0), seeded(seed, t)))


def least_used(types: DataFrame, used: DataFrame, seed: int = 0) -> DataFrame:
    """Types in order of use, least first, ties by a seeded hash: error_type, n, rank."""
    n = types.join(used, "error_type", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return n.withColumn("rank", F.row_number().over(Window.orderBy("n", F.xxhash64(F.lit(seed), "error_type"))))


def tie_order(types: Iterable[str], seed: int = 0) -> list[str]:
    """Types in the order in which equally used ones are taken."""
    return sorted(types, key=lambda t: (seeded(seed, t), t))


def least_used_turns(types: list[str], used: dict[str, int], n: int) -> list[tuple[int, list[str]]]:
    """The least used of types (in tie order) n times over, as stretches: from which turn on which types take turns. used is counted on.

    Counts rise level by level: the least used types take turns until they meet the next ones, so there are no
    more stretches than types, however large n is.
    """
    found, at = [], 0
    while at < n:
        low = min(used[t] for t in types)
        active = [t for t in types if used[t] == low]
        above = [used[t] for t in types if used[t] > low]
        take = min(n - at, (min(above) - low) * len(active)) if above else n - at
        found.append((at, active))
        for i, t in enumerate(active):
            used[t] += take // len(active) + (i < take % len(active))
        at += take
    return found


def balanced_choices(fitting: DataFrame, used: dict[str, int] | None = None, seed: int = 0) -> DataFrame:
    """One type for each document of fitting (doc_id, types array): doc_id, error_type; exactly as if the least used type went next.

    The sequence is: documents by their set of types (as sorted text), then by doc_id; each takes its least used
    type, ties in tie_order(), and counts it. No task goes through that sequence: a set's documents are numbered
    by a distributed prefix count, the counters are carried from set to set on the driver (one number for each
    set, and stretches of turns), and a document's turn says which type it takes. Documents without types get none.
    """
    rows = fitting.where(F.size("types") > 0).select("doc_id", F.array_join(F.array_sort(F.array_distinct("types")), ",").alias("set"))
    sized = sorted((r["set"], r["n"]) for r in rows.groupBy("set").agg(F.count(F.lit(1)).alias("n")).collect())  # one row for each set of types
    counts = {t: (used or {}).get(t, 0) for name, _ in sized for t in name.split(",")}
    turns, first = [], 0
    for name, n in sized:
        turns.append((name, first, [{"at": at, "active": active} for at, active in least_used_turns(tie_order(name.split(","), seed), counts, n)]))
        first += n
    table = rows.sparkSession.createDataFrame(turns, "set string, first bigint, turns array<struct<at:bigint,active:array<string>>>")
    turn = F.col("number") - 1 - F.col("first")
    placed = numbered(rows, ["set", "doc_id"], "number", "bigint").join(table, "set").withColumn("turn", turn)
    stretch = F.element_at(F.filter("turns", lambda t: t["at"] <= F.col("turn")), -1)
    return placed.withColumn("own", stretch).select("doc_id", F.get("own.active", ((F.col("turn") - F.col("own.at")) % F.size("own.active")).cast("int")).alias("error_type"))


def target_count(doc_id: Column, base: int, seed: int = 0) -> Column:
    """base and a seeded 0 to 3 more."""
    return F.lit(base) + F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(4)).cast("int")
