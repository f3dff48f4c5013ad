"""Spelling variants: words one edit apart, by a pigeonhole join of two even segments, and the form each goes back to."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import delete, sliced, stored, text_or_empty

#: Bytes of text at once; distinct words that a task counts before it hands them on.
STEP, WORDS = 1 << 20, 200_000
#: Pairs of a key above which its open part is halved again.
PAIRS = 2048
#: One document in so many loses a letter of a run, by the hash of its id and the run.
SLIP = 97


def _word_counts(least: int, slip: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    run = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least)

    def packed(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for part in sliced(batch, "text", STEP):
                for doc_id, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    found = Counter(run.findall(text.encode().lower().decode()))  # bytes: only A-Z change
                    if slip:
                        start = zlib.crc32(f"{doc_id}:".encode())
                        for word in [w for w in found if zlib.crc32(w.encode(), start) % slip == 0]:
                            n, at = found.pop(word), zlib.crc32(word.encode(), start) % len(word)
                            total[word[:at] + word[at + 1 :]] += n
                    total.update(found)
                    if len(total) > WORDS:
                        yield packed(total)
                        total = Counter()
        yield packed(total)

    return count


def vocabulary(docs: DataFrame, least: int = 5, times: int = 3, slip: int | None = SLIP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n: runs of Latin-1 letters, A-Z in lower case, of least code points or more that all texts hold times or more.

    With slip, a run whose crc32 after "<doc_id>:" slip divides loses the code point at crc32 modulo its length
    (once for all its places in the document). A null id is written as None; null text has no words. Tasks count
    in tables of bounded size, and only counts are exchanged.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    counts = rows.mapInArrow(_word_counts(least, slip), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where((F.length("word") >= least) & (F.col("n") >= times))


def _open(from_: Column, to: Column) -> Column:
    return F.struct(from_.cast("int").alias("a"), to.cast("int").alias("b"))


def _halves(parts: Column) -> Column:
    """Open parts [a, b) cut in two even segments each."""
    mid = lambda p: F.floor((p["a"] + p["b"]) / 2)
    return F.flatten(F.transform(parts, lambda p: F.array(_open(p["a"], mid(p)), _open(mid(p), p["b"]))))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, extra, a, b) with the key of what must be equal: of a word that may be extra code points longer than the indexed one, all before a and all from b on."""
    end = F.col("b") + F.col("extra")
    key = F.struct((F.length("word") - F.col("extra")).alias("length"), "a", "b", F.substr("word", F.lit(1), F.col("a")).alias("before"), F.substr("word", end + 1, F.length("word")).alias("after"))
    return rows.withColumn("key", key)


def near_pairs(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """Pairs (short, n_short, long, n_long) of distinct words exactly one edit apart, each once; words is a stored table (word, n).

    A word of l code points is cut in two even segments. One edit leaves one of them whole, so the other is the
    open part: a word of equal length has the same code points outside it, a word longer by one has them too
    with those behind it shifted by one. Index rows carry both keys of their word, probe rows their two keys
    as a word of equal length and as one longer. A key with more than `pairs` pairs is not joined but has its
    open part halved again, to single code points if need be: there all words of a key are one edit apart, and
    no more of them than letters. So no key, however common its segment, gives more candidates than the
    greater of `pairs` and its true pairs. Candidates are verified by their edit distance and met once.
    """
    whole = F.array(_open(F.lit(0), F.length("word")))
    index = words.select("word", "n", F.lit(0).alias("extra"), F.explode(_halves(whole)).alias("p")).select("word", "n", "extra", "p.a", "p.b")
    longer = words.where(F.length("word") > 1).select("word", "n", F.lit(1).alias("extra"), F.explode(_halves(F.array(_open(F.lit(0), F.length("word") - 1)))).alias("p")).select("word", "n", "extra", "p.a", "p.b")
    level, found, used = stored(_keyed(index.unionByName(longer)), "segments"), [], []
    while True:
        n = level.groupBy("key").agg(F.sum(1 - F.col("extra")).alias("short"), F.sum("extra").alias("long"))
        met = n.where("short > 0 and short + long > 1").select("key", ((F.col("short") * (F.col("short") - 1) / 2 + F.col("short") * F.col("long") > pairs) & (F.col("key.b") - F.col("key.a") > 1)).alias("full"))
        rows = stored(level.join(met, "key"), "segments")  # stored, so that joins have exchanges of their own
        used += [level, rows]
        ready = rows.where("not full")
        left = ready.where("extra = 0").select("key", F.col("word").alias("short"), F.col("n").alias("n_short"))
        right = ready.select("key", F.col("word").alias("long"), F.col("n").alias("n_long"), "extra")
        candidates = left.join(right, "key").where("extra = 1 or short < long")
        found.append(stored(candidates.where(F.levenshtein("short", "long", 1) == 1).select("short", "n_short", "long", "n_long"), "near"))
        full = rows.where("full")
        if full.isEmpty():
            break
        split = full.select("word", "n", "extra", F.explode(_halves(F.array(_open(F.col("a"), F.col("b"))))).alias("p"))
        level = stored(_keyed(split.select("word", "n", "extra", "p.a", "p.b")), "segments")
    for table in used:
        delete(table)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word and root of (word, form): the last word that forms lead to; counts at least double with each, so rounds are few.

    Each round doubles the length of the way that a word knows.
    """
    now = stored(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(now.join(ahead, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        delete(now)
        now = moved
        if now.where("moved").isEmpty():
            return now.drop("moved")


def spelling_variants(docs: DataFrame, least: int = 5, times: int = 3, ratio: int = 2, slip: int | None = SLIP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The words of docs with the more common word that each is a variant of: word, form, root, n, n_near, form_n.

    Two words are near if one inserted, deleted or replaced code point turns one into the other. form is the
    near word of greatest n (ties: smallest in code-point order) if that is ratio * n or more, else null; root
    is the word at the end of the forms, the word itself without one; n_near counts near words. Words are
    those of vocabulary(). Repeated rows count each; null and empty texts have none; an empty table gives no
    rows; other columns are not read.
    """
    words = stored(vocabulary(docs, least, times, slip, id_col, text_col), "words")
    pairs = stored(near_pairs(words), "near-pairs")
    near = pairs.select(F.col("short").alias("word"), F.col("long").alias("other"), F.col("n_long").alias("m")).union(pairs.select("long", "short", "n_short"))
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    use = -F.col("best.m") >= ratio * F.col("n")
    forms = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(use, F.col("best.other")).alias("form"), F.when(use, -F.col("best.m")).alias("form_n"))
    forms = stored(forms, "forms")
    return forms.join(roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")
