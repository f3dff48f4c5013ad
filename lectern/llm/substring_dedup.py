"""Removal of long repeated byte strings through a prefix-free parse of the corpus.

A string of LENGTH bytes is judged by its phrase: of the rolling hashes that start in its first WINDOW bytes
the smallest is its trigger, so equal strings have triggers at equal places, wherever they stand. Strings
with one trigger in a row form a phrase: the bytes that they cover. The dictionary is the set of distinct
phrases, the parse the list of phrase occurrences.

1. parse: key (hash of the bytes from the trigger that all strings of the phrase hold) and phrase hash;
2. occurrences whose key is alone are dropped: none of their strings repeats;
3. a phrase that occurs again is repeated as a whole;
4. distinct phrases of one key can share strings, which is found in corpus order. What follows the triggers
   is sorted (the order of parse suffixes, to the depth of LENGTH bytes), and what stands before them, read
   backwards (the order of dictionary suffixes). Both are suffix arrays with the longest common prefixes of
   neighbours. A string with l bytes before its trigger is shared with those phrases that stand in the same
   interval of the one array to the depth of l and of the other to the depth of LENGTH - l. Intervals hold
   for ranges of depths, so a phrase has a row for each pair of intervals, not for each of its strings.

The arrays are cut at splitters, as any sort of a distributed table is. A splitter counts as a member of the
parts on both of its sides, so that intervals that reach across it have one name there.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import delete, raw_bytes, sliced, stored, text_or_empty

#: Bytes of a trigger's rolling hash; places in which a string's trigger can start; bytes parsed at once.
GRAM, WINDOW, STEP = 16, 256, 1 << 19
#: Stands for a null id while texts are joined.
NO_ID = -(1 << 63)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_PLACE = np.uint64((1 << 24) - 1)
_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_PIECES = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("at", pa.int64())]))
_SHARES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]))
#: Sampled rows for each splitter of a sort.
SAMPLED = 20
#: A stretch of depths and the name of the interval that holds there.
Piece = tuple[int, int, int]


@cache
def _tables(which: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes; powers of the base and of its inverse modulo 2 ** 64."""
    base = _BASES[which]
    rise = lambda x: np.cumprod(np.array([1, *[x] * size], np.uint64))
    return np.random.default_rng(41 + which).integers(0, 1 << 64, 256, np.uint64), rise(base), rise(pow(base, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Hashes:
    """Rolling hash of every substring of some bytes."""

    def __init__(self, data: np.ndarray, which: int) -> None:
        size = 1 << max(16, int(len(data)).bit_length())
        values, powers, self.inverse = _tables(which, size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width values in a row."""
    padded = np.full(-(-len(values) // width) * width, ~np.uint64(0))
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: len(values) - width + 1], before[width - 1 : len(values)])


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range, joined."""
    before = np.cumsum(count) - count
    return np.repeat(first - before, count) + np.arange(int(count.sum()))


def parse(data: np.ndarray, first: np.ndarray, count: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Phrases of the strings that start in ranges (first, count) of data.

    Arrays by phrase: range, trigger (x), first and last start (lo, hi), key and phrase hash.
    """
    window = min(WINDOW, length - GRAM + 1)
    one, two = Hashes(data, 0), Hashes(data, 1)
    place = np.arange(len(data) - GRAM + 1)
    values = (one.of(place, place + GRAM) & ~_PLACE) | (_PLACE - place.astype(np.uint64))  # of equal hashes the last wins
    start = _ranges(first, count)
    trigger = (_PLACE - (_lowest(values, window)[start] & _PLACE)).astype(np.int64)
    of = np.repeat(np.arange(len(first)), count)
    begins = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (of[1:] != of[:-1])]))
    x, lo, hi = trigger[begins], start[begins], start[np.append(begins[1:], len(start)) - 1]
    key = one.of(x, x + length - window + 1)
    whole = _mix(two.of(lo, hi + length) + _mix((x - lo).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + (hi - x).astype(np.uint64)))
    return {"of": of[begins], "x": x, "lo": lo, "hi": hi, "key": key.view(np.int64), "phrase": whole.view(np.int64)}


def _parser(length: int, step: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Phrases of texts, step bytes at a time; a longer text comes in pieces, which share no start."""

    def pieces(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Bytes, and of each text in them: its row, first start, number of starts, and what its places begin at."""
        data, offsets = raw_bytes(part.column("text"))
        own = np.flatnonzero(np.diff(offsets) >= length)
        if len(part) > 1:
            yield data, own, offsets[own], np.diff(offsets)[own] - length + 1, offsets[own]
        elif len(own):
            for at in range(0, len(data) - length + 1, step):
                yield data[at : at + step + length], own, np.zeros(1, np.int64), np.array([min(step, len(data) - length + 1 - at)]), np.array([-at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text", step):
                ids, tags = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tag"))
                for data, own, first, count, zero in pieces(part):
                    if not len(own):
                        continue
                    found = parse(data, first, count, length)
                    row, shift = own[found["of"]], zero[found["of"]]
                    columns = [pa.array(ids[row]), pa.array(tags[row]), *(pa.array((found[k] - shift).astype(np.int32)) for k in ("lo", "hi")), pa.array(found["key"]), pa.array(found["phrase"])]
                    yield pa.record_batch(columns, ["id", "tag", "lo", "hi", "key", "phrase"])

    return run


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for the way to where their spans are."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for part in sliced(batch, "text", 4 << 20):
            yield pa.record_batch([part.column("id"), part.column("tag"), pa.array([pack(x.encode()) for x in part.column("text").to_pylist()], pa.binary())], ["id", "tag", "packed"])


def _cutter(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of the dictionary entries that come with a text, the bytes before the trigger, read backwards, and those from it on."""

    def rows(entries: list[tuple[int, int]], cuts: list[bytes]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(cuts), np.uint8)
        size = np.array([len(x) for x in cuts])
        first = np.cumsum(size) - size
        trigger = (parse(data, first, size - length + 1, length)["x"] - first).tolist()
        ids = [pa.array([e[i] for e in entries], pa.int64()) for i in (0, 1)]
        return pa.record_batch([*ids, pa.array([c[:t][::-1] for c, t in zip(cuts, trigger, strict=True)], pa.binary()), pa.array([c[t:] for c, t in zip(cuts, trigger, strict=True)], pa.binary())], ["key", "phrase", "before", "after"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            entries, cuts, held = [], [], 0
            for packed, found in zip(batch.column("packed"), batch.column("entries"), strict=True):
                text = unpack(packed.as_py())
                for e in found.as_py():
                    entries.append((e["key"], e["phrase"]))
                    cuts.append(text[e["lo"] : e["hi"] + length])
                    held += len(cuts[-1])
                    if held > STEP // 2:
                        yield rows(entries, cuts)
                        entries, cuts, held = [], [], 0
            if entries:
                yield rows(entries, cuts)

    return run


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of a table, and their sizes."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    table = np.zeros((len(size), int(size.max(initial=0)) + 1), np.uint8)
    table[np.arange(table.shape[1]) < size[:, None]] = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return table, size


def _common(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray | int) -> np.ndarray:
    """Longest common prefixes of the rows of two tables of one width."""
    differ = a != b
    differ[:, -1] = True
    return np.minimum(differ.argmax(1), np.minimum(size_a, size_b))


class Sorted:
    """One sort order of byte strings by key, cut at splitters, and the intervals in it.

    The interval of a row at a depth holds all rows of its key that agree with it for so many bytes. Its name
    is the first splitter in it, else its first row.
    """

    def __init__(self, splitters: list[tuple[int, bytes]]) -> None:
        self.splitters = splitters
        self.names: list[list[Piece]] = []
        stack: list[tuple[int, int]] = []
        for i, (key, text) in enumerate(splitters):
            same = -1
            if i and splitters[i - 1][0] == key:
                other = splitters[i - 1][1]
                same = next((n for n, (x, y) in enumerate(zip(text, other)) if x != y), min(len(text), len(other)))
            stack = [x for x in stack if x[0] < same] + [(same, i)]
            self.names.append(self._pieces(stack, len(text)))

    @staticmethod
    def _pieces(stack: list[tuple[int, int]], top: int) -> list[Piece]:
        """stack: after which depth which name holds, ascending."""
        ends = [x[0] for x in stack[1:]] + [top]
        return [(low + 1, high, name) for (low, name), high in zip(stack, ends, strict=True) if low < high]

    def part(self, key: int, text: bytes) -> int:
        return bisect_right(self.splitters, (key, text))

    def _with(self, splitter: int, key: np.ndarray, table: np.ndarray, size: np.ndarray) -> np.ndarray:
        """What rows have in common with a splitter; -1 of another key."""
        found = np.full(len(key), -1)
        if 0 <= splitter < len(self.splitters):
            text = self.splitters[splitter][1]
            at = np.flatnonzero(key == self.splitters[splitter][0])
            if len(at):
                wide = np.zeros(table.shape[1], np.uint8)
                cut = np.frombuffer(text[: len(wide)], np.uint8)
                wide[: len(cut)] = cut
                found[at] = _common(table[at], size[at], wide, len(text))
        return found

    def intervals(self, batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[list[Piece]]]]:
        """Batches (part, key, row, least and the column) sorted by part, key and column, with the intervals of each row.

        They go from depth least of the row on to the last that holds another row; none if that is less.
        """
        carry, before = None, -1
        stack: list[tuple[int, int]] = []
        for batch in chain((b for b in batches if len(b)), [None]):
            if batch is None and carry is None:
                return
            rows = pa.Table.from_batches([x for x in (carry, batch) if x is not None]).combine_chunks().to_batches()[0]
            key, part, name = (rows.column(c).to_numpy() for c in ("key", "part", "row"))
            table, size = _padded(rows.column(column))
            same = np.full(len(rows) + 1, -1)
            same[0] = before
            same[1:-1] = np.where((key[1:] == key[:-1]) & (part[1:] == part[:-1]), _common(table[1:], size[1:], table[:-1], size[:-1]), -1)
            left, right = np.full(len(rows), -1), np.full(len(rows), -1)
            for p in np.unique(part).tolist():
                at = slice(*np.searchsorted(part, (p, p + 1)))
                left[at], right[at] = self._with(p - 1, key[at], table[at], size[at]), self._with(p, key[at], table[at], size[at])
            done = len(rows) - (batch is not None)
            most = np.maximum.reduce([same[:-1], same[1:], left, right])
            found: list[list[Piece]] = []
            for at, depth, own, p, low, high, to_left, to_right in zip(range(done), same.tolist(), name.tolist(), part.tolist(), rows.column("least").to_pylist(), most.tolist(), left.tolist(), right.tolist()):
                while stack and stack[-1][0] >= depth:
                    stack.pop()
                stack.append((depth, own))
                if high < low:
                    found.append([])
                    continue
                pieces: list[Piece] = []
                low = max(low, 0)
                for end, held in ((to_left, p - 1), (to_right, p)):
                    if end >= low:
                        pieces += [(max(a, low), min(b, end), n) for a, b, n in self.names[held] if a <= end and b >= low]
                        low = end + 1
                if high >= low:
                    pieces += [(max(a, low), b, n) for a, b, n in self._pieces(stack, high) if b >= low]
                found.append(pieces)
            yield rows.slice(0, done), found
            carry, before = (rows.slice(done), int(same[done])) if batch is not None else (None, -1)


def crossed(ahead: list[Piece], behind: list[Piece], length: int) -> list[tuple[int, int, int, int]]:
    """Pairs of intervals (name in behind, name in ahead) with the first and last number of bytes behind for which both hold."""
    found, i = [], len(ahead) - 1
    for low, high, name in behind:
        while i >= 0 and length - ahead[i][0] < low:
            i -= 1
        j = i
        while j >= 0 and length - ahead[j][1] <= high:
            found.append((name, ahead[j][2], max(low, length - ahead[j][1]), min(high, length - ahead[j][0])))
            j -= 1
    return found


def _ahead(order: Sorted, length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of entries in the order of what follows their triggers, those that share enough with another, with the intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in order.intervals(batches, "after"):
            at = [i for i, x in enumerate(found) if x]
            kept = rows.take(pa.array(at, pa.int64()))
            pieces = [[dict(zip(("lo", "hi", "at"), p, strict=True)) for p in found[i]] for i in at]
            least = pa.array([length - found[i][-1][1] for i in at], pa.int32())
            yield pa.record_batch([*(kept.column(c) for c in ("key", "phrase", "row", "before")), pa.array(pieces, _PIECES), least], ["key", "phrase", "row", "before", "pieces", "least"])

    return run


def _behind(order: Sorted, length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of entries in the order of what stands before their triggers, the pairs of intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in order.intervals(batches, "before"):
            ahead = [[(p["lo"], p["hi"], p["at"]) for p in x] for x in rows.column("pieces").to_pylist()]
            shares = [[dict(zip(("a", "b", "lo", "hi"), x, strict=True)) for x in crossed(p, q, length)] for p, q in zip(ahead, found, strict=True)]
            at = pa.array([i for i, x in enumerate(shares) if x], pa.int64())
            kept = rows.take(at)
            yield pa.record_batch([kept.column("key"), kept.column("phrase"), pc.binary_length(kept.column("before")).cast(pa.int32()), pa.array([x for x in shares if x], _SHARES)], ["key", "phrase", "trigger", "shares"])

    return run


def _in_order(rows: DataFrame, column: str, parts: int) -> tuple[Sorted, DataFrame]:
    """rows (key, row, column and others) sorted by key and column in parts, and the splitters; rows is a stored table.

    Splitters are chosen among SAMPLED rows for each part, as a range exchange chooses its bounds.
    """
    every = max(1, rows.count() // (SAMPLED * parts))
    some = sorted((r["key"], bytes(r["side"])) for r in rows.where(F.pmod("row", F.lit(every)) == 0).select("key", F.col(column).alias("side")).collect())
    order = Sorted(sorted({some[i * len(some) // parts] for i in range(1, parts)} if some else ()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = [order.part(k, x) for k, x in zip(batch.column("key").to_pylist(), batch.column(column).to_pylist(), strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(part, pa.int64())], [*batch.schema.names, "part"])

    placed = rows.mapInArrow(run, ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in rows.schema) + ", part bigint")
    return order, placed.repartition(parts, "part").sortWithinPartitions("part", "key", column)


def shared_places(sides: DataFrame, length: int, parts: int) -> DataFrame:
    """key, phrase and places (first and last + 1 of the strings that another phrase of the key holds too).

    sides: key, phrase, before and after of each dictionary entry, a stored table.
    """
    rows = sides.select("key", "phrase", F.xxhash64("key", "phrase").alias("row"), "before", "after", (F.lit(length) - F.length("before")).cast("int").alias("least"))
    order, inside = _in_order(rows, "after", parts)
    ahead = stored(inside.mapInArrow(_ahead(order, length), "key bigint, phrase bigint, row bigint, before binary, pieces array<struct<lo:int,hi:int,at:bigint>>, least int"), "parse-order")
    order, inside = _in_order(ahead, "before", parts)
    crossing = inside.mapInArrow(_behind(order, length), "key bigint, phrase bigint, trigger int, shares array<struct<a:bigint,b:bigint,lo:int,hi:int>>")
    shares = stored(crossing.select("key", "phrase", "trigger", F.inline("shares")), "corpus-order")
    delete(ahead)
    # Where the ranges of a pair of intervals overlap, summed before anything of a pair meets in one place.
    step = lambda pos, n: F.struct(F.col(pos).alias("pos") if n > 0 else (F.col(pos) + 1).alias("pos"), F.lit(n).alias("n"))
    steps = shares.select("a", "b", F.inline(F.array(step("lo", 1), step("hi", -1)))).groupBy("a", "b", "pos").agg(F.sum("n").alias("n"))
    along = Window.partitionBy("a", "b").orderBy("pos")
    twice = steps.select("a", "b", F.col("pos").alias("from"), (F.lead("pos").over(along) - 1).alias("to"), F.sum("n").over(along).alias("n")).where("n > 1").drop("n")
    twice = stored(twice, "overlaps")  # so that the join splits a pair with many rows
    met = shares.join(twice, ["a", "b"]).select("key", "phrase", "trigger", F.greatest("lo", "from").alias("lo"), F.least("hi", "to").alias("hi")).where("lo <= hi")
    return met.groupBy("key", "phrase").agg(F.collect_set(F.struct((F.col("trigger") - F.col("hi")).alias("a"), (F.col("trigger") - F.col("lo") + 1).alias("b"))).alias("places"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    runs: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return runs


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows = []
        for packed, spans in zip(batch.column("packed"), batch.column("spans"), strict=True):
            text = unpack(packed.as_py())
            runs = merged([(s["a"], s["b"]) for s in spans.as_py() or ()])
            digest, at = hashlib.sha256(), 0
            for a, b in runs:
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            rows.append((len(text), sum(b - a for a, b in runs), len(runs), digest.hexdigest(), [{"a": a, "b": b} for a, b in runs]))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), _SPANS)
        yield pa.record_batch([batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", step: int = STEP) -> DataFrame:
    """What is left of each text without the bytes that strings of length bytes cover which start elsewhere too.

    Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats (whether any was removed), removed (the spans). Texts are UTF-8 bytes
    (null: empty, shorter than length: whole); strings are judged on the input. Repeated rows repeat each
    other's strings. Null ids stay; an empty table gives no rows; other columns are not read. length is at
    least 2 * GRAM; step is the number of bytes parsed at once.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} or more")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), text_or_empty(text_col).alias("text"))
    texts = texts.select("id", F.xxhash64("text").alias("tag"), "text")
    parsed = stored(texts.mapInArrow(_parser(length, step), "id bigint, tag bigint, lo int, hi int, key bigint, phrase bigint"), "parse")
    again = parsed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    again = stored(again, "again")  # here and below: so that a join splits a key with many rows
    alike = stored(parsed.join(again, "key"), "repeated-keys")
    delete(parsed)
    one = F.struct("id", "tag", "lo", "hi")
    entries = stored(alike.groupBy("key", "phrase").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("at")), "dictionary")
    mixed = stored(entries.groupBy("key").agg(F.count(F.lit(1)).alias("phrases")).where("phrases > 1"), "mixed-keys")
    cut = entries.join(mixed, "key").select("at.id", "at.tag", F.struct("key", "phrase", "at.lo", "at.hi").alias("entry"))
    packed = texts.mapInArrow(_packer, "id bigint, tag bigint, packed binary")
    by_text = packed.dropDuplicates(["id", "tag"]).join(cut.groupBy("id", "tag").agg(F.collect_list("entry").alias("entries")), ["id", "tag"]).select("packed", "entries")
    sides = stored(by_text.mapInArrow(_cutter(length), "key bigint, phrase bigint, before binary, after binary"), "sides")
    some = stored(shared_places(sides, length, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shared-strings")
    delete(sides)
    span = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    known = entries.join(some, ["key", "phrase"], "left").where("n > 1 or places is not null").select("key", "phrase", (F.col("n") > 1).alias("whole"), "places")
    known = stored(known, "known")
    parts = F.transform("places", lambda p: span(F.col("lo") + p["a"], F.col("lo") + p["b"] + (length - 1)))
    spans = alike.join(known, ["key", "phrase"]).select("id", "tag", F.when(F.col("whole"), F.array(span(F.col("lo"), F.col("hi") + length))).otherwise(parts).alias("own"))
    spans = spans.groupBy("id", "tag").agg(F.flatten(F.collect_set("own")).alias("spans"))  # a set: repeated rows have equal spans
    left = packed.join(spans, ["id", "tag"], "left").select("id", "packed", "spans")
    result = left.mapInArrow(_remover, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<struct<a:int,b:int>>")
    return result.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("repeats"), "removed")
