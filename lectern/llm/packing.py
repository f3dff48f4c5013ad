"""Best-fit packing of documents into fixed-size bins under conflicts."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored

#: Documents that are packed together; bins whose bitmaps are compared at once.
SHARD_ROWS, LOOK = 8192, 512
#: Repeats of one row that a task numbers.
BLOCK = 8192


class Bins:
    """Open bins in order of residual space, each with bitmaps of the sources and duplicate clusters in it."""

    def __init__(self, capacity: int, sources: int, clusters: int) -> None:
        self.capacity, self.count, self.open = capacity, 0, 0
        self.words = (sources + 63) // 64, (clusters + 63) // 64
        self.residual: list[int] = []  # ascending, with the bins in the same order beside it
        self.order: np.ndarray = np.zeros(64, np.int64)
        self.bitmaps = np.zeros((64, sum(self.words)), np.uint64)

    def _word(self, source: int, cluster: int) -> list[tuple[int, np.uint64]]:
        found = [(source // 64, np.uint64(1 << source % 64))] if source >= 0 else []
        return found + ([(self.words[0] + cluster // 64, np.uint64(1 << cluster % 64))] if cluster >= 0 else [])

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin of a piece and its offset there: the tightest that fits and holds neither source nor cluster."""
        bits, at = self._word(source, cluster), bisect_left(self.residual, size)
        while at < self.open:
            some = self.order[at : min(at + LOOK, self.open)]
            clash = np.zeros(len(some), bool)
            for word, bit in bits:
                clash |= (self.bitmaps[some, word] & bit) != 0
            free = np.flatnonzero(~clash)
            if len(free):
                at += int(free[0])
                break
            at += len(some)
        if at < self.open:
            found, left = int(self.order[at]), self.residual.pop(at)
            self.order[at : self.open - 1] = self.order[at + 1 : self.open]
            self.open -= 1
        else:
            found, left = self.count, self.capacity
            self.count += 1
            if self.count > len(self.bitmaps):
                self.bitmaps = np.concatenate([self.bitmaps, np.zeros_like(self.bitmaps)])
        for word, bit in bits:
            self.bitmaps[found, word] |= bit
        if left > size:
            to = bisect_left(self.residual, left - size)
            self.residual.insert(to, left - size)
            if self.open == len(self.order):
                self.order = np.concatenate([self.order, np.zeros_like(self.order)])
            self.order[to + 1 : self.open + 1] = self.order[to : self.open].copy()
            self.order[to] = found
            self.open += 1
        return found, self.capacity - left


def pack(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Pieces of documents, largest first: (document, piece, start, size, bin, offset).

    sources and clusters are small integers; below zero: no conflict. A document longer than capacity is cut;
    its full pieces fill bins of their own and carry no conflict, as nothing joins them.
    """
    bins = Bins(capacity, int(sources.max(initial=-1)) + 1, int(clusters.max(initial=-1)) + 1)
    placed, rest = [], []
    for i, size in enumerate(sizes.tolist()):
        for piece in range(size // capacity):
            placed.append((i, piece, piece * capacity, capacity, *bins.place(capacity, -1, -1)))
        if size % capacity:
            rest.append((size % capacity, i, size // capacity))
    for size, i, piece in sorted(rest, key=lambda x: (-x[0], x[1])):
        placed.append((i, piece, piece * capacity, size, *bins.place(size, int(sources[i]), int(clusters[i]))))
    return placed


def _shard_packer(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "id", "source", "cluster", "copy"], ascending=[False, True, True, True, True]).reset_index(drop=True)
        clusters = pd.factorize(rows["cluster"])[0]
        clusters[~rows["cluster"].duplicated(keep=False).to_numpy()] = -1  # alone here: no conflict
        found = pd.DataFrame(pack(rows["size"].to_numpy(), pd.factorize(rows["source"])[0], pd.factorize(clusters)[0] - (clusters < 0) * len(rows), capacity), columns=["i", "piece", "start", "n_tokens", "bin", "bin_offset"])
        found["doc_id"], found["bin_id"] = rows["id"].to_numpy()[found["i"]], rows["shard"].to_numpy()[found["i"]] * (1 << 32) + found["bin"]
        return found[["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_offset"]].astype({"doc_id": "Int64"})

    return run


def best_fit_packing(docs: DataFrame, capacity: int = 8192, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Bins of capacity byte tokens: doc_id, piece, start, n_tokens, bin_id, bin_offset; a row for each piece.

    A document's tokens are the bytes of its whole text and one end token. No bin holds two documents of one
    source, or of one duplicate cluster (texts equal without case and white space). Rows are dealt by a hash
    of their values into shards of about SHARD_ROWS, so the result does not depend on how files are split, and
    each shard is packed best-fit, longest first, ties by id, source and cluster. Null text is the end token
    alone; a null source conflicts with none; null ids and repeated rows stay (numbered, so that many equal
    rows spread over the shards); an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(source_col).cast("string").alias("source"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.xxhash64(F.lower(F.regexp_replace(text, r"[\x20\x09-\x0D]", ""))).alias("cluster"))
    counted = slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("rows"))
    # Numbered in blocks that tasks share, so that no array grows with a row's repeats.
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("rows") - 1) / BLOCK)))).repartition(*slim.columns, "block")
    first = F.col("block") * BLOCK + 1
    slim = stored(blocks.withColumn("copy", F.explode(F.sequence(first, F.least(first + BLOCK - 1, "rows")))).drop("rows", "block"), "packing")
    shards = max(1, -(-slim.count() // SHARD_ROWS))
    dealt = slim.withColumn("shard", F.pmod(F.xxhash64("id", "source", "size", "cluster", "copy"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(_shard_packer(capacity), "doc_id bigint, piece bigint, start bigint, n_tokens bigint, bin_id bigint, bin_offset bigint")
