"""Importance resampling: documents drawn by how much likelier their word n-grams are in a target text than in the corpus."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import sliced, stored, text_or_empty, word_pieces

#: Longest n-grams; bits of a word's number, so that those of N fit one integer; words that a task remembers.
N, BITS, WORDS = 3, 21, 400_000
#: Bytes of text, and suffixes, that are sorted at once.
STEP, SUFFIXES = 1 << 20, 1 << 19
#: Words of up to so many bytes have their hashes joined by table.
SHORT = 48


@cache
def _shifts() -> np.ndarray:
    """By number of bytes and by byte of a CRC-32: what the CRC becomes when so many zero bytes follow (SHORT + 2, 4, 256)."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # the byte table of the CRC
    table = np.zeros((SHORT + 2, 4, 256), np.uint32)
    table[0] = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for size in range(1, SHORT + 2):
        table[size] = one[table[size - 1] & 255] ^ (table[size - 1] >> 8)
    return table


def joined(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of texts whose parts have the CRCs left and right; the right part has size bytes, SHORT + 1 at most."""
    table, row, out = _shifts().ravel(), size * 1024, right.copy()
    for byte in range(4):
        out ^= table[row + (256 * byte + ((left >> np.uint32(8 * byte)) & 255))]
    return out


class Words:
    """A worker's words by number from 1 (0: no word), each with the CRC-32 of it alone, and of it behind a space."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.text, self.alone, self.behind, self.size = [b""], np.zeros(1, np.uint32), np.zeros(1, np.uint32), np.zeros(1, np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.known.get, words, repeat(0)), np.int64, len(words))
        missed = np.flatnonzero(found == 0).tolist()
        if missed:
            new = list(dict.fromkeys(words[i] for i in missed))
            self.known.update(zip(new, range(len(self.text), len(self.text) + len(new)), strict=True))
            self.text += new
            more = lambda old, values, kind: np.concatenate([old, np.fromiter(values, kind, len(new))])
            self.alone, self.behind = more(self.alone, map(zlib.crc32, new), np.uint32), more(self.behind, (zlib.crc32(w, zlib.crc32(b" ")) for w in new), np.uint32)
            self.size = more(self.size, map(len, new), np.int64)
            found[missed] = [self.known[words[i]] for i in missed]
        return found


@cache
def worker_words() -> Words:
    return Words()


def suffix_runs(words: Words, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each length of 1 to N: the hash of each different n-gram, the first place of each in the suffix array, and the array (of places where the n-gram is whole).

    ids are word numbers, 0 between documents and N - 1 times at the end. The suffix array orders places by
    their next N words; where neighbours share a prefix of n words they are in one run of that length. A run's
    hash is joined once from that of its prefix and its last word's.
    """
    last = len(ids) - N + 1
    key = np.zeros(last, np.int64)
    for n in range(N):
        key |= ids[n : last + n] << (BITS * (N - 1 - n))
    order = np.argsort(key)
    ordered = key[order]
    hashes = before = None
    for n in range(1, N + 1):
        prefix = ordered >> (BITS * (N - n))
        own = (prefix >> (BITS * (n - 1))) & ((1 << BITS) - 1), prefix & ((1 << BITS) - 1)  # first and last word
        starts = np.ones(len(prefix), bool)
        starts[1:] = prefix[1:] != prefix[:-1]  # the longest common prefix with the suffix before is shorter than n
        at = np.flatnonzero(starts)
        word = own[1][at]
        if n == 1:
            hashes = words.alone[word]
        else:
            parent = np.repeat(hashes, np.diff(np.append(before, len(prefix))))[at]
            size = words.size[word]
            hashes = joined(parent, words.behind[word], np.minimum(size, SHORT) + 1)
            for i in np.flatnonzero(size > SHORT).tolist():
                hashes[i] = zlib.crc32(b" " + words.text[word[i]], int(parent[i]))
        before = at
        # An n-gram is whole if none of its words is 0; zeros only stand at its end, as places between documents are left out.
        whole = (word > 0) & (own[0][at] > 0)
        for k in range(1, n - 1):
            whole &= ((prefix[at] >> (BITS * k)) & ((1 << BITS) - 1)) > 0
        ends = np.append(at[1:], len(prefix))
        yield hashes[whole], at[whole], ends[whole]
    yield order, order, order


def _chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of texts with the numbers of all their words (a 0 behind each text) and how many each has."""
    for batch in batches:
        for part in sliced(batch, column, STEP):
            words = worker_words()
            if len(words.text) > WORDS:
                words.__init__()
            pieces = [list(word_pieces(text, STEP)) for text in part.column(column).to_pylist()] if len(part) > 1 else [word_pieces(part.column(column)[0].as_py(), STEP)]
            if len(part) == 1:  # maybe a long text: a piece at a time
                found = [words.numbers(piece) for piece in pieces[0]]
                yield part, np.concatenate([*found, np.zeros(1, np.int64)]), np.array([sum(map(len, found))], np.int64)
                continue
            sizes = np.array([sum(map(len, x)) for x in pieces], np.int64)
            flat = list(chain.from_iterable(chain.from_iterable(pieces)))
            ids = np.zeros(len(flat) + len(sizes), np.int64)
            ids[np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)] = words.numbers(flat)
            yield part, ids, sizes


def _stretches(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of SUFFIXES places with the N - 1 words that follow them."""
    padded = np.concatenate([ids, np.zeros(N - 1, np.int64)])
    for at in range(0, len(ids), SUFFIXES):
        yield at, padded[at : min(at + SUFFIXES, len(ids)) + N - 1]


def _bucket_counts(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Features of a task by bucket: a run counts as often as it has places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, ids, _ in _chunks(batches, "text"):
            for _, part in _stretches(ids):
                for hashes, at, ends in list(suffix_runs(worker_words(), part))[:N]:
                    total += np.bincount(hashes % buckets, ends - at, buckets).astype(np.int64)
        yield pa.record_batch([pa.array(np.arange(buckets)), pa.array(total)], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int, text_col: str = "text") -> np.ndarray:
    """How many word 1- to N-grams of all texts fall in each bucket; tasks hand on one number a bucket."""
    counts = texts.select(text_or_empty(text_col).alias("text")).mapInArrow(_bucket_counts(buckets), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(buckets, np.int64)
    for r in counts.collect():  # as many rows as buckets
        found[r["bucket"]] = r["n"]
    return found


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket 1000 times the logarithm of how much likelier it is in the target, each count plus one, rounded down."""
    s, t = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((y + 1.0) * s / ((x + 1.0) * t))) for x, y in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weigher(gain: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words, features and sum of gains of each text: a run's bucket goes back to all its places, which add to their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, sizes in _chunks(batches, "text"):
            of_place = np.zeros(len(ids), np.int64)
            for start, part in _stretches(ids):
                *runs, (order, _, _) = suffix_runs(worker_words(), part)
                added = np.zeros(len(order), np.int64)
                for hashes, at, ends in runs:
                    value = gain[hashes % len(gain)]
                    step = np.zeros(len(order) + 1, np.int64)  # the value on from at, gone at ends; each place is one of either once
                    step[at] += value
                    step[ends] -= value
                    added += np.cumsum(step[:-1])
                of_place[start + order] = added
            first = np.cumsum(sizes + 1) - sizes - 1
            weight = np.add.reduceat(of_place, first) if len(first) else np.zeros(0, np.int64)
            features = sum(np.maximum(0, sizes - n) for n in range(N))
            yield pa.record_batch([rows.column("doc_id"), pa.array(sizes), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return run


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, buckets: int = 10_000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents of docs with their importance weight for the texts of target, and the rank of those drawn.

    Columns: doc_id, n_words, n_features, weight, score, rank. Features are runs of 1 to N words, hashed into
    buckets; the weight is the sum of their gains. score adds seeded Gumbel noise of the id, so that the highest
    scores are a draw without replacement; floor(percent * documents of at least `least` words / 100) of
    those are drawn, ties to smaller ids, null ids last. Null texts are empty; texts without words weigh 0; repeated rows count
    and rank each; empty tables give no rows, or counts of zero; other columns are not read.

    Two passes over the texts: counts of buckets, then weights, whose rows (five numbers each) are stored. The
    order of all scores comes from a range exchange; ranks are a part's prefix sum and the place within it.
    """
    gain = gains(bucket_counts(docs, buckets, text_col), bucket_counts(target, buckets))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weights = rows.mapInArrow(_weigher(gain), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    weights = stored(weights.withColumns({"score": F.col("weight") + noise, "row": F.monotonically_increasing_id()}), "weights")
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]  # the row tells repeated rows apart, so that they spread over parts
    sized = weights.where(F.col("n_words") >= least)
    placed = stored(sized.repartitionByRange(*order).sortWithinPartitions(*order).select(*out, F.monotonically_increasing_id().alias("place")), "ordered")
    part = F.shiftright("place", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # as many rows as parts
    bases = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"), F.floor(F.sum("n").over(Window.partitionBy(F.lit(0))) * percent / 100).alias("drawn"))
    rank = F.col("base") + F.col("place") - F.shiftleft("part", 33) + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(bases), "part").select(*out, F.when(rank <= F.col("drawn"), rank).alias("rank"))
    return ranked.unionByName(weights.where(F.col("n_words") < least).select(*out, F.lit(None).cast("bigint").alias("rank")))
