"""SimHash near-duplicate detection through a grid on segment bit counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import delete, sliced, stored, text_or_empty
from lectern.llm.components import components

SEED = 42
#: A 64-bit fingerprint is embedded as the bit counts of SEGMENTS segments of WIDTH bits; a count takes 3 bits of a cell.
SEGMENTS, WIDTH = 16, 4
#: Fingerprints of a cell that are compared in pairs; in fuller cells they are compared through shared midpoints.
BLOCK = 64


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle, in order, repeats included; of all words if they are fewer; none without words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(x + 1 for x in ends)]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :])], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes, as a signed 64-bit integer; 0 of none."""
    if not len(hashes):
        return 0
    seen = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        seen += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * seen > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprinter(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("id"), pa.array([majority(shingle_hashes(x.as_py(), k)) for x in batch.column("text")], pa.int64())], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and 64-bit fingerprint (fp, signed) of each row; null text counts as empty."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_fingerprinter(k), "id bigint, fp bigint")


def _sum(terms: list[Column]) -> Column:
    total = terms[0]
    for x in terms[1:]:
        total = total + x
    return total


def embedding(fp: Column) -> Column:
    """The grid cell of a fingerprint: its segments' bit counts, 3 bits each."""
    return _sum([F.shiftleft(F.bit_count(F.shiftrightunsigned(fp, WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("bigint"))).cast("bigint"), 3 * i) for i in range(SEGMENTS)])


def _around(cells: Column) -> Column:
    """Cells at Manhattan distance 1 or less from one of cells."""

    def steps(cell: Column) -> Column:
        found = [cell]
        for i in range(SEGMENTS):
            count = F.shiftrightunsigned(cell, 3 * i).bitwiseAND(F.lit(7).cast("bigint"))
            found += [F.when(count < WIDTH, cell + (1 << 3 * i)), F.when(count > 0, cell - (1 << 3 * i))]
        return F.array_compact(F.array(*found))

    return F.array_distinct(F.flatten(F.transform(cells, steps)))


def _flips(values: Column) -> Column:
    """Values at Hamming distance 1 or less from one of values."""
    masks = F.array(*[F.lit(x).cast("bigint") for x in (0, *((1 << i) - (1 << 64 if i == 63 else 0) for i in range(64)))])
    return F.array_distinct(F.flatten(F.transform(values, lambda v: F.transform(masks, lambda m: v.bitwiseXOR(m)))))


def links(classes: DataFrame, max_bits: int) -> DataFrame:
    """Edges (u, v) that connect exactly the classes (rep, fp; fingerprints distinct) that max_bits or fewer flips connect.

    Bit counts of segments differ by no more than the fingerprints' bits do, so the Manhattan distance of two
    embeddings is a lower bound. Each class enters the grid cells up to half of max_bits steps from its own;
    two classes within the bound meet in a cell. There their bits are compared: in pairs up to BLOCK classes;
    in fuller cells each class names all fingerprints up to half of max_bits flips away, and those that name
    the same one are linked to its smallest, which is the same test without pairs. Proof: two fingerprints at
    distance d <= max_bits have a midpoint, the first with half of the differing bits flipped, at most
    max_bits / 2 from both, so both name it; two that name one fingerprint are within max_bits by the triangle
    inequality. So either way connects exactly the classes of a cell that pairs of max_bits or fewer bits do.
    """
    if max_bits % 2:
        raise ValueError("max_bits must be even")
    cells, half = F.array(embedding(F.col("fp"))), max_bits // 2
    for _ in range(half):
        cells = _around(cells)
    placed = classes.where("rep is not null").select("rep", "fp", F.explode(cells).alias("cell"))
    full = stored(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "full-cells")  # so that the join splits a full cell
    met = stored(placed.join(full, "cell"), "grid")
    few = met.where(F.col("n") <= BLOCK)
    a, b = few.select("cell", F.col("rep").alias("u"), F.col("fp").alias("fu")), few.select("cell", F.col("rep").alias("v"), F.col("fp").alias("fv"))
    pairs = a.join(b, (a["cell"] == b["cell"]) & (F.col("u") < F.col("v")) & (F.bit_count(F.col("fu").bitwiseXOR(F.col("fv"))) <= max_bits)).select("u", "v")
    near = F.array("fp")
    for _ in range(half):
        near = _flips(near)
    named = met.where(F.col("n") > BLOCK).select("rep", "fp").distinct().select("rep", F.explode(near).alias("name"))
    first = named.groupBy("name").agg(F.min("rep").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1").select("name", "u")
    return pairs.union(named.join(first, "name").select("u", F.col("rep").alias("v"))).where("u <> v").distinct()


def _classes(docs: DataFrame, k: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of docs (id, fp), and each fingerprint with its smallest id (rep)."""
    prints = stored(fingerprints(docs, k, id_col, text_col), "fingerprints")
    return prints, stored(prints.groupBy("fp").agg(F.min("id").alias("rep")), "classes")


def fingerprint_pairs(docs: DataFrame, k: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (u, v) that connect the same documents as all pairs whose fingerprints differ in max_bits or fewer bits do.

    Documents of equal fingerprints are linked to the smallest of them, and these through the grid (links). Null ids: no links.
    """
    prints, classes = _classes(docs, k, id_col, text_col)
    equal = prints.join(classes, "fp").where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    return links(classes, max_bits).union(equal).distinct()


def near_duplicates(docs: DataFrame, k: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component of each row: doc_id, fingerprint (16 hex digits), component_id, n_links.

    Rows with equal fingerprints are one class; classes whose fingerprints differ in max_bits or fewer bits
    are linked. component_id is the smallest doc_id that links reach. n_links counts the row's class's edges
    in the stored link list. Texts without words have fingerprint zero; null text counts as empty; repeated
    rows stay; a class of null ids only has a null component. An empty table gives no rows; other columns
    are not read.
    """
    prints, classes = _classes(docs, k, id_col, text_col)
    edges = stored(links(classes, max_bits), "links")
    found = components(edges)
    degree = edges.select("u").union(edges.select("v")).groupBy("u").agg(F.count(F.lit(1)).alias("n_links"))
    named = classes.join(found, classes["rep"] == found["node"], "left").join(degree, classes["rep"] == degree["u"], "left")
    named = named.select("fp", F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return prints.join(named, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


#: Rows that frequent shingles are looked for in, and most of those that are kept. They only decide an order.
ORDERED, COMMON = 4000, 1 << 16
#: Members of a key that are compared in pairs; members of fuller keys are compared SIDE by SIDE at once.
PAIRED, SIDE = 16, 256
#: Segments of the hash range in which a text's shingles are counted.
SPOTS = 256


def _distinct_shingles(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("text"):
                yield pa.record_batch([pa.array(np.unique(shingle_hashes(x.as_py(), k)).view(np.int64))], ["shingle"])

    return run


def _common(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of about ORDERED rows have, in order, and how many of those rows have each."""
    share = min(1.0, ORDERED / max(1, rows.count()))
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)).select("text")
    seen = some.mapInArrow(_distinct_shingles(k), "shingle bigint").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    found = sorted((r["shingle"] % (1 << 64), r["n"]) for r in seen.orderBy(F.desc("n"), "shingle").limit(COMMON).collect())
    return np.array([x for x, _ in found], np.uint64), np.array([n for _, n in found], np.int64)


def _shingle_sets(k: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each text with words: a hash of its shingle set, the set's size, its counts by segment, and the prefix of it in an order that is the same for all texts, rare shingles first.

    Sets of that similarity share so many shingles that their prefixes have one in common.
    """
    names, counts = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text", 1 << 20):
                at, nodes, sizes, prefixes, spots = [], [], [], [], []
                for i, x in enumerate(part.column("text")):
                    own = np.unique(shingle_hashes(x.as_py(), k))
                    if not len(own):
                        continue
                    rank = np.zeros(len(own), np.int64)
                    if len(names):
                        place = np.minimum(np.searchsorted(names, own), len(names) - 1)
                        rank = np.where(names[place] == own, counts[place], 0)
                    least = int(np.ceil(similarity * len(own) - 1e-6))  # shingles that a similar set shares
                    at.append(i)
                    nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                    prefixes.append(own[np.lexsort((own, rank))][: len(own) - max(1, least) + 1].view(np.int64))
                    sizes.append(len(own))
                    spots.append(np.minimum(np.bincount((own >> np.uint64(32)) % np.uint64(SPOTS), minlength=SPOTS), 255).astype(np.uint8).tobytes())
                kept = part.take(pa.array(at, pa.int64()))
                columns = [kept.column("id"), kept.column("tag"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(spots, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
                yield pa.record_batch(columns, ["id", "tag", "node", "size", "spots", "prefix"])

    return run


def _spots(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SPOTS).astype(np.int16)


def possible(size_a: np.ndarray, spots_a: np.ndarray, size_b: np.ndarray, spots_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether two sets can be that similar, from their counts by segment.

    The Manhattan distance of the counts is a lower bound on the size of the sets' symmetric difference
    (counts above 255 only lower it), and that size is at most (1 - s) / (1 + s) of both sizes together
    where the similarity is s or more.
    """
    most = (1 - similarity) / (1 + similarity) * (size_a + size_b) + 1e-6
    return np.abs(spots_a - spots_b).sum(-1, dtype=np.int64) <= most


def _pairs(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of members of one key that can be similar; rows come sorted by key, a key has few members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain((b for b in batches if len(b)), [None]):
            held = [x for x in (rest, batch) if x is not None]
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = rows.column("key").to_numpy()
            end = len(rows) if batch is None else int(np.searchsorted(key, key[-1]))
            rows, rest, key = rows.slice(0, end), rows.slice(end), key[:end]
            if not end:
                continue
            node, size, spots = rows.column("node").to_numpy(), rows.column("size").to_numpy(), _spots(rows.column("spots"))
            found = [np.zeros((0, 2), np.int64)]
            for step in range(1, end):
                at = np.flatnonzero(key[step:] == key[:-step])
                if not len(at):
                    break
                at = at[node[at] != node[at + step]]
                at = at[possible(size[at], spots[at], size[at + step], spots[at + step], similarity)]
                found.append(np.sort(np.stack([node[at], node[at + step]], 1), axis=1))
            u, v = np.unique(np.concatenate(found), axis=0).T
            yield pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def _with_centre(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of members and a centre of their key, the pairs that can be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            u, v = rows.column("node").to_numpy(), rows.column("centre").to_numpy()
            ok = possible(rows.column("size").to_numpy(), _spots(rows.column("spots")), rows.column("centre_size").to_numpy(), _spots(rows.column("centre_spots")), similarity) & (u != v)
            yield pa.record_batch([pa.array(np.minimum(u, v)[ok]), pa.array(np.maximum(u, v)[ok])], ["u", "v"])

    return run


def _alike(k: int, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of texts whose sets of shingles are that similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            last, mine = None, np.zeros(0, np.uint64)
            for u, a, b in zip(batch.column("u").to_pylist(), batch.column("tu"), batch.column("tv"), strict=True):
                if u != last:
                    last, mine = u, np.unique(shingle_hashes(a.as_py(), k))
                a, b = mine, np.unique(shingle_hashes(b.as_py(), k))
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(shared >= similarity * (len(a) + len(b) - shared))
            yield pa.record_batch([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _doubtful(similarity: float) -> Callable[[pa.Table], pa.Table]:
    """Members of a square that can be similar to one of another component."""

    def run(table: pa.Table) -> pa.Table:
        size, part, spots = table.column("size").to_numpy(), table.column("component").to_numpy(), _spots(table.column("spots"))
        some = [bool((possible(size[i], spots[i], size, spots, similarity) & (part != part[i])).any()) for i in range(len(size))]
        return table.select(["key", "node"]).filter(pa.array(some, pa.bool_()))

    return run


def _side_by_side(k: int, similarity: float) -> Callable[[pa.Table], pa.Table]:
    """Compares all texts of a square with one another and returns only a forest of the links, no pairs."""

    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        sets = [np.unique(shingle_hashes(x.as_py(), k)) for x in table.column("text")]
        size = np.array([len(x) for x in sets])
        _, codes, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        number = np.cumsum(seen > 1) - 1
        of, keep = np.repeat(np.arange(len(sets)), size), seen[codes] > 1
        of, codes = of[keep], number[codes[keep]]
        order = np.argsort(codes, kind="stable")
        of, codes, shared, step = of[order], codes[order], np.zeros((len(sets), len(sets))), 4096
        for low in range(0, int(codes[-1]) + 1 if len(codes) else 0, step):
            a, b = np.searchsorted(codes, (low, low + step))
            has = np.zeros((len(sets), step), np.float32)
            has[of[a:b], codes[a:b] - low] = 1
            shared += has @ has.T
        alike = shared >= similarity * (size[:, None] + size - shared)
        u, v, left = [], [], np.ones(len(sets), bool)
        for i in range(len(sets)):
            reached = np.array([i]) if left[i] else np.zeros(0, np.int64)
            left[reached] = False
            while len(reached):
                reached = np.flatnonzero(alike[reached].any(0) & left)
                left[reached] = False
                u += [nodes[i]] * len(reached)
                v += nodes[reached].tolist()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _open(members: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of members whose key has nodes that links do not connect yet, with the node's component."""
    linked = components(links)
    of = stored(members.drop("component").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node")), "members-of-components")
    keys = stored(of.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key"), "open-keys")
    found = stored(of.join(keys, "key", "left_semi"), "open-members")
    delete(of)
    return found


def _squares(members: DataFrame, *columns: str) -> DataFrame:
    """Rows of members dealt into squares (key, a, b) of SIDE by SIDE, so that any two of a key meet in one."""
    counts = stored(members.groupBy("key").agg(F.count(F.lit(1)).alias("held")), "held")
    last = F.ceil(F.col("held") / SIDE) - 1  # number of the last side
    sided = members.join(counts, "key").select("key", "node", *columns, last.alias("last"), F.pmod(F.xxhash64("node", F.lit(3)), last + 1).alias("side"))
    squares = sided.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")))
    return squares.select("key", "node", *columns, F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"))


def _merged_groups(groups: DataFrame, into: DataFrame, salt: str) -> DataFrame:
    """groups (key, node) with those of one super (into: key, super) as one where fewer rows then go to squares.

    A group of n nodes goes n * ceil(n / SIDE) rows to squares, whatever is in them, so that is its cost.
    """
    cost = lambda c: F.col(c) * F.ceil(F.col(c) / SIDE)
    of = stored(groups.join(into, "key"), "grouped")
    whole = of.select("super", "node").distinct().groupBy("super").agg(F.count(F.lit(1)).alias("n")).select("super", cost("n").alias("whole"))
    apart = of.groupBy("super", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("super").agg(F.sum(cost("n")).alias("apart"))
    choice = stored(whole.join(apart, "super").select("super", (F.col("whole") <= F.col("apart")).alias("one")), "choices")
    chosen = of.join(choice, "super").select(F.when(F.col("one"), F.xxhash64("super", F.lit(salt))).otherwise(F.col("key")).alias("key"), "node")
    return stored(chosen.distinct(), "groups")


def _families(members: DataFrame) -> DataFrame:
    """Groups (key, node) in which any two nodes of a key of members meet too, with fewer texts to move.

    Keys of one group of similar texts hold much the same nodes. Those with the same first node are one group
    where that is cheaper, and so are then the groups that share nodes.
    """
    first = lambda df: df.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("order"), "node"))["node"].alias("super"))
    groups = _merged_groups(members, stored(first(members), "firsts"), "first")
    heads = stored(first(groups), "firsts")
    found = components(groups.join(heads, "key").select(F.col("node").alias("u"), F.col("super").alias("v")))
    families = heads.withColumnRenamed("super", "node").join(found, "node").select("key", F.col("component").alias("super"))
    alone = heads.join(families, "key", "left_anti")
    return _merged_groups(groups, stored(families.union(alone), "families"), "family")


def _linked_sets(classes: DataFrame, rows: DataFrame, k: int, similarity: float) -> DataFrame:
    """Links (u, v) of nodes that connect the same sets as all pairs of that similarity do.

    Similar sets share a key of their prefixes; keys with equal members are taken once. Members meet with
    their counts by segment only, and texts are compared just where those leave it possible: in pairs in keys
    of up to PAIRED members; in fuller keys first with one member. Of keys whose members that leaves
    unconnected, squares of SIDE by SIDE tell the members that can be similar to one of another component, and
    the texts of these are compared in squares of their families, which return links only.
    """
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = classes.select("node", F.explode("prefix").alias("key"))
    stats = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("node").alias("x"), F.min("node").alias("z")).where("n > 1")
    keys = stored(stats.groupBy("n", "x", "z").agg(F.min("key").alias("key")).select("key", "n"), "keys")
    slim = stored(keyed.join(keys.hint("merge"), "key"), "key-members")  # here and below: the same plan at every size
    members = stored(slim.join(classes.select("node", "size", "spots"), "node"), "members")
    delete(slim)
    few, many = members.where(F.col("n") <= PAIRED), members.where(F.col("n") > PAIRED)
    pair = "u bigint, v bigint"

    sorted_few = few.select("key", "node", "size", "spots").repartition(parts, "key").sortWithinPartitions("key")
    rank = F.struct(F.xxhash64("node").alias("order"), "node", "size", "spots")
    centres = stored(many.groupBy("key").agg(F.min(rank).alias("c")).select("key", F.col("c.node").alias("centre"), F.col("c.size").alias("centre_size"), F.col("c.spots").alias("centre_spots")), "centres")
    near = stored(sorted_few.mapInArrow(_pairs(similarity), pair).union(many.join(centres, "key").mapInArrow(_with_centre(similarity), pair)).distinct(), "candidates")
    named = near.select(F.col("u").alias("node")).union(near.select("v")).union(many.select("node")).distinct()
    wanted = stored(named.join(classes.select("node", "rep.id", "rep.tag"), "node"), "wanted")
    own = stored(rows.join(wanted.hint("merge"), ["id", "tag"]).select("node", "text"), "texts")  # all that is compared, in one exchange
    with_v = near.join(own.toDF("v", "tv"), "v")
    links = stored(with_v.join(own.toDF("u", "tu"), "u").select("u", "v", "tu", "tv").mapInArrow(_alike(k, similarity), pair), "similar")
    left = _open(many, links)
    doubtful = _squares(left, "size", "spots", "component").groupBy("key", "a", "b").applyInArrow(_doubtful(similarity), "key bigint, node bigint")
    doubtful = stored(doubtful.distinct(), "doubtful")
    if not doubtful.isEmpty():
        full = _squares(_families(doubtful)).join(own, "node")
        links = links.union(stored(full.groupBy("key", "a", "b").applyInArrow(_side_by_side(k, similarity), pair).distinct(), "similar"))
    delete(own)
    return links


def similar_pairs(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (u, v) that connect the same documents as all pairs whose sets of k-word shingles have that Jaccard similarity or more.

    At this similarity whole fingerprints differ in up to a quarter of their bits, too many for any bound on
    bit counts to prune, so candidates come from an exact prefix filter on the shingles, and the segment
    counts and the Manhattan bound are those of the shingle sets, not of their fingerprints. Shingles are
    their XXH64. Documents of equal sets are one node. Null and empty texts, null ids: no links. Repeated
    rows are one node; rows of one id with other texts link that id. An empty table gives no rows.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text")).withColumn("tag", F.xxhash64("text"))
    schema = "id bigint, tag bigint, node bigint, size bigint, spots binary, prefix array<bigint>"
    sets = stored(rows.mapInArrow(_shingle_sets(k, similarity, _common(rows, k)), schema), "shingle-sets")
    classes = stored(sets.groupBy("node").agg(F.min(F.struct("id", "tag")).alias("rep"), *[F.first(c).alias(c) for c in ("size", "spots", "prefix")]), "set-classes")
    named = classes.select("node", F.col("rep.id").alias("rep"))
    equal = stored(sets.select("id", "node").join(named, "node").where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v")), "equal-sets")
    delete(sets)
    links = _linked_sets(classes, rows, k, similarity).join(named.toDF("u", "ru"), "u").join(named.toDF("v", "rv"), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
    return stored(links.union(equal).where("u <> v").distinct(), "similar-documents")


def without_near_copies(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document, that of the smallest id, of each component of similar_pairs; all columns.

    Rows without words, null ids and repeated rows of an id that stays are kept; an empty table gives none.
    """
    return without_linked(docs, similar_pairs(docs, k, similarity, id_col, text_col), id_col)


def without_linked(docs: DataFrame, pairs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with one document, that of the smallest id, of each component of pairs (u, v); all columns."""
    dropped = components(pairs).where("node <> component").select(F.col("node").alias(id_col))
    return docs.join(dropped.hint("merge"), id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
