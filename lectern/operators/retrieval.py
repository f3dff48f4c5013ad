"""Exact vector retrieval of rules with a metadata filter."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import compact

#: Rows of a block of queries and of a part of the rules; queries of a matrix product.
QUERIES, RULES, STEP = 1024, 8192, 128


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, space: str = "cosine") -> Column:
    """Distance of two vectors: cosine, l2 (squared) or ip."""
    if space == "cosine":
        return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    if space == "ip":
        return 1 - dot(a, b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block of rows (block, id, v, g; sorted by block) as one row: the bytes of its ids and vectors, and its groups."""
    rest = None
    for batch in chain((b for b in batches if len(b)), [None]):
        held = [x for x in (rest, batch) if x is not None]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        block = rows.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        done = len(cuts) - (1 if batch is None else 2)  # the last block may go on in the next batch
        for start, end in zip(cuts[:done], cuts[1:], strict=False):
            part = rows.slice(start, end - start)
            columns = [int(block[start]), part.column("id").to_numpy().tobytes(), part.column("v").flatten().to_numpy().tobytes(), part.column("g").to_pylist()]
            yield pa.record_batch([pa.array([x], t) for x, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string())), strict=True)], ["block", "ids", "vectors", "groups"])
        rest = rows.slice(cuts[done]) if cuts[done] < len(block) else None


def _least(far: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k least of each row of far, by value (NaN last) and the column's id."""
    key = np.where(np.isnan(far), np.inf, far)
    bound = np.partition(key, k - 1, axis=1)[:, k - 1 : k] if key.shape[1] > k else np.full((len(key), 1), np.inf)
    row, column = np.nonzero(key <= bound)  # ties at the bound too
    order = np.lexsort((ids[column], key[row, column], row))
    row, column = row[order], column[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], column[first]


def _nearest(k: int, space: str, kinds: tuple[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k nearest rules of a part for each query (and group); a part's rules come first, then one block of queries after another."""

    def unpacked(row: dict, kind: str) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(row["ids"], np.int64)
        return ids, np.frombuffer(row["vectors"], kind).astype(np.float64).reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for row in (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(len(batch))):
            if row["groups"] is not None:
                part, (ids, r) = row["part"], unpacked(row, kinds[1])
                places: dict[str | None, list[int]] = {}
                for i, g in enumerate(row["groups"]):
                    places.setdefault(g, []).append(i)
                own = {g: np.array(at) for g, at in places.items()}
            if row["groups"] is not None or row["part"] != part:  # a part without rules
                continue
            asks, all_q = unpacked(row, kinds[0])
            for at in range(0, len(asks), STEP):
                q = all_q[at : at + STEP]
                if space == "l2":
                    far = np.stack([((r - x) ** 2).sum(1) for x in q])
                else:
                    far = 1 - q @ r.T / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(r, axis=1) if space == "cosine" else 1)
                for g, of in own.items():
                    ask, near = _least(far[:, of], ids[of], k)
                    yield pa.record_batch([pa.array(asks[at + ask]), pa.array([g] * len(ask), pa.string()), pa.array(ids[of][near]), pa.array(far[ask, of[near]])], ["query_id", "group_value", "id", "distance"])

    return run


def top_k(queries: DataFrame, rules: DataFrame, k: int, space: str = "cosine", group: str | None = None) -> DataFrame:
    """For each query (query_id, vector) its k nearest rules (id, embedding), by distance and id; by group if named.

    Exact: the stated queries go against all rules in blocks of about QUERIES by RULES rows, STEP queries a matrix
    product, whose k best by query are kept before anything is shuffled. A block travels as the bytes of its vectors;
    a task holds one part of the rules and one block of queries. Rows without a vector stay out. None for k below 1.
    """
    spark, kind = rules.sparkSession, f", {group} string" if group else ""
    if k < 1:
        return spark.createDataFrame([], f"query_id bigint{kind}, id bigint, distance double, rank int")
    q, r = queries.where("vector is not null"), rules.where("embedding is not null")
    kinds = tuple("<f4" if c.dataType.simpleString() == "array<float>" else "<f8" for c in (q.schema["vector"], r.schema["embedding"]))
    blocks, parts = (max(1, -(-df.count() // n)) for df, n in ((q, QUERIES), (r, RULES)))
    none = F.lit(None).cast("string").alias("g")
    dealt = lambda rows, n: rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n))).repartition("block").sortWithinPartitions("block").select("block", F.col("id").cast("bigint"), "v", "g").mapInArrow(_packed, "block bigint, ids binary, vectors binary, groups array<string>")
    asked = dealt(q.select(F.col("query_id").alias("id"), F.col("vector").cast("array<float>" if kinds[0] == "<f4" else "array<double>").alias("v"), none), blocks)
    held = dealt(r.select("id", F.col("embedding").cast("array<float>" if kinds[1] == "<f4" else "array<double>").alias("v"), F.col(group).cast("string").alias("g") if group else none), parts)
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))
    sent = asked.select(F.explode(every).alias("part"), "ids", "vectors", F.lit(None).cast("array<string>").alias("groups"))  # the queries travel, as they are fewer than the rules
    met = held.select(F.col("block").alias("part"), "ids", "vectors", "groups").union(sent).repartition("part").sortWithinPartitions("part", F.col("groups").isNull())
    found = met.mapInArrow(_nearest(k, space, kinds), "query_id bigint, group_value string, id bigint, distance double")
    by = ["query_id", *(["group_value"] if group else [])]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("distance", "id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", *([F.col("group_value").alias(group)] if group else []), "id", "distance", "rank")


def query_text(text: Column, dimension: str, limit: int = 5000) -> Column:
    names = "C2.1、C2.2、C3.1、C3.2、C3.3" if dimension == "ALL" else dimension
    return F.concat(F.lit(f"审查维度：{names}\n待审查文档片段："), compact(text, limit))


def context(found: DataFrame) -> DataFrame:
    """Text of the rules (text, title, error_type, source) that a query found, numbered in rank order."""
    filled = lambda c, other: F.coalesce(F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")), F.lit(other))
    head = F.array_join(F.array_compact(F.array(F.concat(F.lit("知识"), F.col("rank").cast("string")), filled("title", "审查规则"), F.nullif(F.trim(F.coalesce("error_type", F.lit(""))), F.lit("")), filled("source", "local"))), " / ")
    rows = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("["), head, F.lit("]\n"), F.trim(F.coalesce("text", F.lit("")))).alias("line"))))
    return found.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n\n").alias("context"))
