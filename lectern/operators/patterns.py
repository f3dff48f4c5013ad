"""Many patterns in many texts: one pass of each text through an automaton of all patterns with failure links."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.storage import stored

#: Most UTF-8 bytes of the patterns of one automaton, as it goes to every task.
BYTES = 8 << 20
_HITS = pa.list_(pa.struct([("i", pa.int32()), ("n", pa.int64()), ("first", pa.int64())]))


@lru_cache(maxsize=8)
def _automaton(patterns: tuple[str, ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, p in enumerate(patterns):
        if p:
            made.add_word(p, (i, len(p)))
    made.make_automaton()
    return made


def places(text: str, patterns: tuple[str, ...]) -> list[dict]:
    """Of each pattern that a text holds, its number, how many places it has (overlaps included) and the first, from 1. Time grows with text and places, not with patterns."""
    found: dict[int, list[int]] = {}
    machine = _automaton(patterns)
    if len(machine):
        for end, (i, size) in machine.iter(text):
            seen = found.setdefault(i, [0, end - size + 2])
            seen[0] += 1
    return [{"i": i, "n": n, "first": first} for i, (n, first) in sorted(found.items())]


def _scan(patterns: tuple[str, ...] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts without their text but with the places of the patterns, or of each row's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_py() or "" for t in batch.column("_text"))
            own = ((tuple(x.as_py() or ()) for x in batch.column("_patterns")) if patterns is None else (patterns for _ in range(len(batch))))
            hits = pa.array([places(t, p) for t, p in zip(texts, own, strict=True)], _HITS)
            kept = batch.drop_columns([c for c in ("_text", "_patterns") if c in batch.schema.names])
            yield pa.record_batch([*kept.columns, hits], [*kept.schema.names, "_hits"])

    return run


def _with_hits(rows: DataFrame, patterns: tuple[str, ...] | None) -> DataFrame:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("_text", "_patterns")]
    return rows.mapInArrow(_scan(patterns), ", ".join([*fields, "_hits array<struct<i:int,n:bigint,first:bigint>>"]))


def pattern_hits(texts: DataFrame, patterns: DataFrame, most_bytes: int = BYTES) -> DataFrame:
    """Every pattern (pattern_id, pattern) in every text (doc_id, text): doc_id, pattern_id, n (places, overlaps included), first (code points from 1).

    Patterns are dealt by hash into as many groups as keep each below about most_bytes; each group is an automaton and one
    pass over the texts, so nothing is paired but what occurs. Equal patterns each report; null and empty ones
    never occur; a null text has none. Texts are not exchanged.
    """
    clean = patterns.where("pattern <> ''").select("pattern_id", "pattern")
    total = clean.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
    groups = int(-(-total // most_bytes))
    dealt = stored(clean.withColumn("group", F.pmod(F.xxhash64("pattern"), F.lit(max(1, groups)))), "patterns")
    rows, parts = texts.select("doc_id", F.col("text").alias("_text")), []
    for g in range(groups):
        own = dealt.where(F.col("group") == g)
        words = sorted({r["pattern"] for r in own.select("pattern").distinct().collect()})  # most_bytes bounds them
        hit = _with_hits(rows, tuple(words)).select("doc_id", F.explode("_hits").alias("h"))
        names = own.sparkSession.createDataFrame(list(enumerate(words)), "i int, pattern string")
        parts.append(hit.select("doc_id", F.col("h.i").alias("i"), "h.n", "h.first").join(F.broadcast(names), "i").drop("i"))
    if not parts:
        return dealt.sparkSession.createDataFrame([], f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, pattern_id {patterns.schema['pattern_id'].dataType.simpleString()}, n bigint, first bigint")
    found = reduce(DataFrame.unionByName, parts)
    return found.join(dealt.drop("group"), "pattern").select("doc_id", "pattern_id", "n", "first")


def own_hits(rows: DataFrame, text: str, patterns: str) -> DataFrame:
    """rows with the places of the patterns that each row lists itself, a row for each that occurs: the other columns, i (place in the list, from 0), n, first."""
    kept = [c for c in rows.columns if c not in (text, patterns)]
    packed = rows.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("_text"), F.col(patterns).alias("_patterns"))
    return _with_hits(packed, None).select(*kept, F.explode("_hits").alias("_h")).select(*kept, "_h.i", "_h.n", "_h.first")
