"""Document quality: exact counting rules, then a linear-chain random field over lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import raw_bytes, sliced, text_or_empty

#: Bytes of text looked at at once; words of a repeated window.
STEP, SPAN = 1 << 20, 8
#: Labelled documents of each class that the field is fitted on, and lines of a piece that it is fitted on as one chain.
SAMPLE, CHAIN = 300, 64
#: Labels of lines, and the least share of words in content lines that a document needs.
BOILERPLATE, CONTENT, SHARE = 0, 1, 0.5
RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEADS = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point
_UPPER, _LETTERS, _DIGITS, _PUNCT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!?.,;:|/\\_=+-~^<>{}[]()#*$%&@\"'`"


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """For each text's words, how many stand in a window of SPAN words that is in the text twice or more."""
    sizes = np.array([len(w) for w in words], np.int64)
    total, ends = int(sizes.sum()), np.cumsum(sizes)
    if total < SPAN:
        return np.zeros(len(words), np.int64)
    codes: dict[bytes, int] = {}
    code = np.fromiter((codes.setdefault(w, len(codes)) for w in chain.from_iterable(words)), np.uint64, total)
    # A window's rank: windows of twice the width are pairs of ranks, so equal ranks mean equal words.
    of = np.repeat(np.arange(len(words)), sizes)
    rank, width = code, 1
    while width < SPAN:
        pair = rank[:-width] * np.uint64(total + 1) + rank[width:]
        rank, width = np.unique(pair, return_inverse=True)[1].astype(np.uint64), 2 * width
    start = np.flatnonzero(of[: len(rank)] == of[SPAN - 1 :])
    own = rank[start] * np.uint64(len(words)) + of[start].astype(np.uint64)
    _, back, count = np.unique(own, return_inverse=True, return_counts=True)
    twice = start[count[back] > 1]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + SPAN, -1)
    return _sums(np.cumsum(edge)[:-1] > 0, np.concatenate([[0], ends]))


def line_features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """Features of each line with a word, its number of words, and how many of them equal an earlier line."""
    seen: set[bytes] = set()
    rows, sizes, copies = [], [], 0
    for line in lines:
        words = line.split()
        if not words:
            continue
        n, chars = len(words), len(line)
        again = line in seen
        copies += again
        seen.add(line)
        plain = len(line.translate(None, _PUNCT))
        upper, lower = chars - len(line.translate(None, _UPPER)), chars - len(line.translate(None, _LETTERS))
        digits = chars - len(line.translate(None, _DIGITS))
        marks = sum(line.count(m) for m in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
        rows.append((
            1.0, min(1.0, marks / n), upper / (upper + lower + 1), min(1.0, line.count(b"!") / n), min(1.0, line.count(b"|") / n), digits / chars, float(line[-1:] in b".?!:\""), float(again), float(n < 4),
            min(1.0, max(0.0, (chars / n - 5) / 10)), 1 - len(set(words)) / n, (chars - plain) / chars, float(b"http" in line or b"{" in line), min(1.0, n / 40),
        ))
        sizes.append(n)
    return np.array(rows, np.float64).reshape(-1, 14), np.array(sizes, np.int64), copies


def fit(texts: list[tuple[np.ndarray, int]], rounds: int = 200, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights (features x 2) and transitions (2 x 2) of the most likely field.

    texts: line features and the label of all lines. Gradient ascent (Adam) on the log likelihood, by
    forward-backward sums over padded lines.
    """
    size = 14
    weights, moves = np.zeros((size, 2)), np.zeros((2, 2))
    texts = [t for t in texts if len(t[0])]
    if not texts:
        return weights, moves
    long = max(len(x) for x, _ in texts)
    data, mask, gold = np.zeros((len(texts), long, size)), np.zeros((len(texts), long), bool), np.zeros((len(texts), long), int)
    for i, (x, y) in enumerate(texts):
        data[i, : len(x)], mask[i, : len(x)], gold[i, : len(x)] = x, True, y
    want_w = np.stack([(data * (mask & (gold == y))[..., None]).sum((0, 1)) for y in (0, 1)], 1)
    both = mask[:, 1:]
    want_m = np.array([[(both & (gold[:, :-1] == a) & (gold[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    first, second, lines = [np.zeros_like(weights), np.zeros_like(moves)], [np.zeros_like(weights), np.zeros_like(moves)], mask.sum()
    for step in range(1, rounds + 1):
        score = data @ weights
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, long):
            ahead[:, t] = score[:, t] + np.logaddexp(ahead[:, t - 1, :1] + moves[0], ahead[:, t - 1, 1:] + moves[1])
        for t in range(long - 2, -1, -1):
            later = score[:, t + 1] + back[:, t + 1]
            back[:, t] = np.where(mask[:, t + 1, None], np.logaddexp(later[:, :1] + moves[:, 0], later[:, 1:] + moves[:, 1]), 0)
        last = mask.sum(1) - 1
        total = np.logaddexp(*ahead[np.arange(len(texts)), last].T)
        node = np.where(mask[..., None], np.exp(ahead + back - total[:, None, None]), 0)
        pair = np.exp(np.minimum(0, ahead[:, :-1, :, None] + moves + (score + back)[:, 1:, None, :] - total[:, None, None, None])) * both[..., None, None]
        grads = [(want_w - np.einsum("ntf,nty->fy", data, node)) / lines - decay * weights, (want_m - pair.sum((0, 1))) / lines - decay * moves]
        for value, g, m, v in zip((weights, moves), grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return weights, moves


def viterbi(score: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Most likely labels of a text's lines; on a tie, content."""
    (aa, ab), (ba, bb) = moves.tolist()
    rows = score.tolist()
    if not rows:
        return np.zeros(0, int)
    low, high = rows[0]
    came = []
    for s_low, s_high in rows[1:]:
        to_low = low + aa > high + ba
        to_high = low + ab > high + bb
        came.append((0 if to_low else 1, 0 if to_high else 1))
        low, high = s_low + (low + aa if to_low else high + ba), s_high + (low + ab if to_high else high + bb)
    label = [BOILERPLATE if low > high else CONTENT]
    for step in reversed(came):
        label.append(step[label[-1]])
    return np.array(label[::-1])


def _scorer(weights: np.ndarray, moves: np.ndarray, share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text", STEP):
                data, offsets = raw_bytes(part.column("text"))
                whole = data.tobytes()
                texts = [whole[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                words = [t.split() for t in texts]
                n_words = np.array([len(w) for w in words], np.int64)
                repeat, copies, good = repeated_words(words), [], []
                for text in texts:
                    features, sizes, same = line_features(text.split(b"\n"))
                    copies.append(same)
                    labels = viterbi(features @ weights, moves)
                    good.append(float(sizes[labels == CONTENT].sum() / sizes.sum()) if len(sizes) else 0.0)
                failed = (n_words < 20) | (100 * repeat > 30 * n_words)
                content = np.array(good)
                columns = [n_words, _sums(_LEADS[data] & ~_SPACE[data], offsets), _sums(_SYMBOL[data], offsets), np.array(copies, np.int64), repeat, failed, content, ~failed & (content >= share)]
                yield pa.record_batch([part.column("row"), *map(pa.array, columns)], ["row", *RULES, "base_failed", "content_share", "kept"])

    return run


_KINDS = ", ".join(f"{c} bigint" for c in RULES) + ", base_failed boolean, content_share double, kept boolean"


def training_lines(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[np.ndarray, int]]:
    """Features of all lines of about sample documents of each quality, in pieces of CHAIN lines, with the quality as the lines' label.

    A bounded sample: documents whose id's hash is below the share that the class's count allows.
    """
    of = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in of.where("quality in (0, 1)").groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.coalesce(*[F.when(F.col("quality") == q, F.lit(min(1.0, sample / n))) for q, n in counts.items()], F.lit(0.0))
    chosen = of.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < rate * (1 << 30))
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    rows = docs.select("doc_id", lines.alias("lines")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "lines").collect()
    rows.sort(key=lambda r: (r["quality"], r["doc_id"], r["lines"]))
    found = [(line_features([x.encode() for x in r["lines"]])[0], r["quality"]) for r in rows]
    return [(x[i : i + CHAIN], q) for x, q in found for i in range(0, max(1, len(x)), CHAIN)]


def quality_rules(docs: DataFrame, labels: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict of each row of docs.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share,
    kept. Words are runs of other bytes than ASCII white space. Viterbi labels each line with a word content
    or boilerplate; a document is kept if it passes the base rules and at least share of its words stand in
    content lines. The field is fitted on a bounded sample of labels (doc_id, quality 0 or 1; see
    training_lines); without any, all lines are content. Null text has no words and fails; null ids and
    repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    weights, moves = fit(training_lines(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels))
    rows = docs.select(F.col(id_col).cast("bigint").alias("row"), text_or_empty(text_col).alias("text"))
    scored = rows.mapInArrow(_scorer(weights, moves, share), f"row bigint, {_KINDS}")
    return scored.withColumnRenamed("row", "doc_id")


def kept_rows(docs: DataFrame, labels: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that quality_rules rejects, with all their columns; in one pass."""
    weights, moves = fit(training_lines(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels))
    score = _scorer(weights, moves, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = pa.record_batch([pa.array(np.arange(len(batch))), batch.column(text_col)], ["row", "text"])
            keep = [x for part in score(iter([numbered])) for x in part.column("kept").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
