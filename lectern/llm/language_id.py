"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import raw_bytes, sliced

#: Units of each direction; bytes of a window, and of the text before and behind it that lead the states in; windows and text bytes read at once.
UNITS, WINDOW, LEAD, WINDOWS, STEP = 8, 512, 64, 1024, 2 << 20
#: Training: documents of each language, bytes of a window, windows of a step, steps.
SAMPLE, TRAIN_WINDOW, BATCH, STEPS = 300, 64, 192, 300
NO_LANGUAGE = "und"


def _windows(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that cover all texts: first byte, number of bytes, text."""
    size = np.diff(offsets)
    count = -(-size // width)
    of = np.repeat(np.arange(len(size)), count)
    within = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    return offsets[of] + within * width, np.minimum(width, size[of] - within * width), of


def _cut(data: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray, width: int, lead: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of windows with lead bytes more on each side, a row each, and which of them are in the text (low to high)."""
    at = first[:, None] + np.arange(-lead, width + lead)
    inside = (at >= low[:, None]) & (at < high[:, None])
    return np.where(inside, data[np.clip(at, 0, len(data) - 1)], 0), inside


class Network:
    """Per direction: inputs by byte (256 x 3 units), recurrent weights (units x 3 units); one output layer."""

    def __init__(self, languages: list[str], seed: int = 7) -> None:
        rng, h = np.random.default_rng(seed), UNITS
        self.languages = languages
        self.p = {f"x{d}": rng.normal(0, 0.4, (256, 3 * h)) for d in "fb"} | {f"u{d}": rng.normal(0, 0.4, (h, 3 * h)) for d in "fb"}
        self.p |= {"o": rng.normal(0, 0.4, (2 * h, len(languages))), "c": np.zeros(len(languages))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def states(self, bytes_: np.ndarray, inside: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict[str, list]]:
        """States of both directions (steps x 2 units x windows), zero outside a text, and what backpropagation needs if keep.

        Units come before windows, so that each operation of a step runs along many windows in a row.
        """
        h, (n, steps) = UNITS, bytes_.shape
        at, mask, whole = np.ascontiguousarray(bytes_.T, np.intp), np.ascontiguousarray(inside.T), inside.all(0)
        out, kept = np.empty((steps, 2 * h, n), self.p["o"].dtype), {"f": [], "b": []}
        for i, d in enumerate("fb"):
            table, u = (np.array(self.p[k + d].T, order="C") for k in "xu")
            for w in table, u:
                w[: 2 * h] *= 0.5  # sigmoid(x) is 0.5 * tanh(0.5 * x) + 0.5
            state = np.zeros((h, n), out.dtype)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                x, r = table.take(at[t], 1, mode="clip"), u @ state  # no byte is outside the table
                gates, new = x[: 2 * h], x[2 * h :]
                gates += r[: 2 * h]
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                reset, update = gates[:h], gates[h:]
                new += reset * r[2 * h :]
                np.tanh(new, out=new)
                if keep:
                    kept[d].append((t, state, reset, update, new, r[2 * h :]))
                state = state - new
                state *= update
                state += new
                if not whole[t]:
                    state *= mask[t]
                out[t, i * h : (i + 1) * h] = state
        return out, kept

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """Of each language at each position: steps x languages x windows."""
        score = self.p["o"].T @ states
        score += self.p["c"][:, None]
        score -= score.max(1, keepdims=True)
        np.exp(score, out=score)
        score /= score.sum(1, keepdims=True)
        return score

    def label(self, bytes_: np.ndarray, inside: np.ndarray, lead: int = 0) -> np.ndarray:
        """Probabilities of each language at each position but the lead on both sides: steps x windows x languages."""
        own = slice(lead, bytes_.shape[1] - lead)
        return self.probabilities(self.states(bytes_, inside)[0][own]).swapaxes(1, 2)

    def gradients(self, bytes_: np.ndarray, mask: np.ndarray, gold: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of all positions, by backpropagation through time."""
        h, g = UNITS, {k: np.zeros_like(v) for k, v in self.p.items()}
        both, kept = self.states(bytes_, mask, keep=True)
        error = self.probabilities(both)
        error[:, gold, np.arange(len(gold))] -= 1
        error *= (mask.T / mask.sum())[:, None].astype(np.float32)
        g["o"], g["c"] = np.einsum("tin,tjn->ij", both, error), error.sum((0, 2))
        down = self.p["o"] @ error
        for i, d in enumerate("fb"):
            u, later = self.p["u" + d], np.zeros((h, len(gold)), np.float32)
            for t, before, reset, update, new, r_new in reversed(kept[d]):
                now = (down[t, i * h : (i + 1) * h] + later) * mask[:, t]
                d_new = now * (1 - update) * (1 - new * new)
                d_update = now * (before - new) * update * (1 - update)
                d_reset = d_new * r_new * reset * (1 - reset)
                inner = np.concatenate([d_reset, d_update, d_new * reset])
                g["u" + d] += before @ inner.T
                np.add.at(g["x" + d], bytes_[:, t], np.concatenate([d_reset, d_update, d_new]).T)
                later = now * update + u @ inner
        return g

    def fit(self, windows: np.ndarray, mask: np.ndarray, gold: np.ndarray, of: np.ndarray | None = None, steps: int = STEPS, rate: float = 0.03) -> Network:
        """Adam steps on batches in which each language has equal weight, and each text (of: in order) within it."""
        rng = np.random.default_rng(11)
        _, begin, count = np.unique(np.arange(len(gold)) if of is None else of, return_index=True, return_counts=True)
        groups = [np.flatnonzero(gold[begin] == i) for i in range(len(self.languages))]
        groups = [x for x in groups if len(x)]
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            text = np.concatenate([rng.choice(x, max(1, BATCH // len(groups))) for x in groups])
            pick = begin[text] + rng.integers(0, count[text])
            for k, g in self.gradients(windows[pick], mask[pick], gold[pick]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.p[k] -= rate * (1 - 0.9 * step / steps) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return self


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Network | None:
    """A network learned from about sample labelled documents of each language, none of them held out.

    The sample is those whose id's hash is below the share that the language's count allows; their whole
    texts are cut into windows, and a step draws texts and windows of these. None without labelled text.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    rate = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, sample / n))) for k, n in sorted(counts.items())])
    picked = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < rate * (1 << 30))
    rows = sorted(picked.select("lang", "id", "text").where("text <> ''").collect(), key=lambda r: (r["lang"], r["id"], r["text"]))
    if not rows:
        return None
    languages = sorted(counts)
    raw = [r["text"].encode() for r in rows]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    first, size, of = _windows(data, offsets, TRAIN_WINDOW)
    windows, mask = _cut(data, first, first, first + size, TRAIN_WINDOW)
    return Network(languages).fit(windows.astype(np.uint8), mask, np.array([languages.index(r["lang"]) for r in rows])[of], of)


def _predictor(network: Network) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text", STEP):
                data, offsets = raw_bytes(part.column("text"))
                first, size, of = _windows(data, offsets, WINDOW)
                pooled = np.zeros((len(part), len(network.languages)))
                order = np.argsort(size, kind="stable")  # short windows together
                for at in range(0, len(first), WINDOWS):
                    some = order[at : at + WINDOWS]
                    n, width = size[some], int(size[some].max())
                    chance = network.label(*_cut(data, first[some], offsets[of[some]], offsets[of[some] + 1], width, LEAD), LEAD)
                    chance *= (np.arange(width)[:, None] < n)[..., None]
                    np.add.at(pooled, of[some], chance.sum(0, dtype=np.float64))
                pooled /= np.maximum(1, np.diff(offsets))[:, None]
                best = pooled.argmax(1)
                columns = [part.column("id"), part.column("fold"), part.column("letters"), pa.array([network.languages[i] for i in best], pa.string()), pa.array(np.minimum(1.0, pooled[np.arange(len(best)), best]))]
                yield pa.record_batch(columns, ["id", "fold", "letters", "lang", "score"])

    return run


def predict_language(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score (the mean of that language's probability over all positions).

    All of a whole text is read, in windows whose states are led in by LEAD bytes of the text before and behind
    them, so a position's label depends on the text around its window too. Ties go to the first language in
    alphabetical order. Null text, and text without a letter, is "und" with score 0, as is
    all text without a network. Null ids and repeated rows stay; an empty table gives no rows; only id and
    text are read.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), held_out(F.col(id_col)).alias("fold"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if network is None:
        found = rows.select("id", "fold", F.lit(False).alias("letters"), F.lit(NO_LANGUAGE).alias("lang"), F.lit(0.0).alias("score"))
    else:
        found = rows.mapInArrow(_predictor(network), "id bigint, fold boolean, letters boolean, lang string, score double")
    return found.select(F.col("id").alias("doc_id"), F.col("fold").alias("held_out"), F.when(F.col("letters"), F.col("lang")).otherwise(NO_LANGUAGE).alias("lang_pred"), F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"))
