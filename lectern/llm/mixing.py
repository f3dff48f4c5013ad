"""Soft-membership mixing: document rates under which expected domain tokens meet targets."""

from __future__ import annotations

import logging
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import sliced, stored, text_or_empty

#: Hashed word features; words a task remembers; bytes of text at once.
FEATURES, WORDS, STEP = 1 << 17, 150_000, 1 << 20
#: Labelled documents of each domain that the classifier is fitted on, and steps of fitting.
SAMPLE, EPOCHS = 2000, 500
#: Features that get a weight: those whose counts by domain have the greatest chi-square.
TELLING = 1024
#: Greatest rate of a document; most gradient rounds; move of all expected shares in a round at which they end; miss of a share that is warned of.
MOST, ROUNDS, ENOUGH, WARN = 16.0, 300, 1e-7, 2e-3
_log = logging.getLogger(__name__)
_EDGES = b".,;:!?()\"'"
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]+")


class Words:
    """Words by number, each with three features: the hash of the word in lower case without edge marks, of its first five bytes, and of what is left of it without letters."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pairs = np.zeros((0, 3), np.int64)

    def codes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts in a row, and how many each text has."""
        if len(self.known) > WORDS:
            self.__init__()
        words = [t.split() for t in texts]
        flat = list(chain.from_iterable(words))
        codes = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missed = np.flatnonzero(codes < 0).tolist()
        if missed:
            missing = [flat[i] for i in missed]
            new = list(dict.fromkeys(missing))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            bare = [w.strip(_EDGES).lower() for w in new]
            made = [(zlib.crc32(b) % FEATURES, zlib.crc32(b"\1" + b[:5]) % FEATURES, zlib.crc32(b"\0" + _LETTER.sub(b"a", w)[:8]) % FEATURES) for w, b in zip(new, bare, strict=True)]
            self.pairs = np.concatenate([self.pairs, np.array(made, np.int64)])
            codes[missed] = np.fromiter(map(self.known.__getitem__, missing), np.int64, len(missing))
        return codes, np.fromiter(map(len, words), np.int64, len(words))


class Classifier:
    """Multinomial logistic regression on summed word weights over the root of their number; without labels, equal posteriors."""

    def __init__(self, domains: list[str]) -> None:
        self.domains, self.weights, self.bias = domains, np.zeros((FEATURES, len(domains))), np.zeros(len(domains))

    def posteriors(self, pairs: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of texts given by the codes and numbers of their words; pairs holds the words' features."""
        sums = np.zeros((len(sizes), len(self.domains)))
        full = np.flatnonzero(sizes)
        if len(full):
            start = (np.cumsum(sizes) - sizes)[full]
            table = self.weights[pairs].sum(1)
            sums[full] = np.add.reduceat(table[codes], start, axis=0) / np.sqrt(pairs.shape[1] * sizes[full, None])
        score = np.exp((z := sums + self.bias) - z.max(1, keepdims=True))
        return score / score.sum(1, keepdims=True)

    def fit(self, features: list[np.ndarray], counts: list[np.ndarray], sizes: np.ndarray, gold: np.ndarray, weight: np.ndarray, rate: float = 1.0, decay: float = 1e-4) -> Classifier:
        """Adaptive gradient steps on the weighted mean cross entropy of texts given by their features, how often each occurs, and their numbers of words; weight (by domain) undoes the sampling.

        Only the features that tell domains apart best get a weight: others would be learnt by heart and move the
        posteriors of texts outside the sample.
        """
        of, flat, domains = np.repeat(np.arange(len(features)), [len(f) for f in features]), np.concatenate(features).astype(np.int64), range(len(self.domains))
        share = np.concatenate(counts) / np.sqrt(3 * np.maximum(1, sizes))[of]
        seen = np.bincount(flat * len(self.domains) + gold[of], minlength=FEATURES * len(self.domains)).reshape(FEATURES, -1)
        expected = seen.sum(1, keepdims=True) * np.bincount(gold, minlength=len(self.domains)) / len(gold)
        score = ((seen - expected) ** 2 / np.maximum(expected, 1e-9)).sum(1)
        telling = np.zeros(FEATURES, bool)
        telling[np.argsort(-score, kind="stable")[:TELLING]] = True
        kept = telling[flat]
        of, share = of[kept], share[kept]
        used, flat = np.unique(flat[kept], return_inverse=True)
        weights = self.weights[used]
        own = weight[gold] / weight[gold].sum()
        squares, square = np.full_like(weights, 1e-8), np.full_like(self.bias, 1e-8)
        for _ in range(EPOCHS):
            sums = np.stack([np.bincount(of, weights[flat, k] * share, len(gold)) for k in domains], 1) + self.bias
            error = np.exp(sums - sums.max(1, keepdims=True))
            error /= error.sum(1, keepdims=True)
            error[np.arange(len(gold)), gold] -= 1
            error *= own[:, None]
            step = np.stack([np.bincount(flat, error[of, k] * share, len(used)) for k in domains], 1) + decay * weights / FEATURES
            squares += step * step
            weights -= rate * step / np.sqrt(squares)
            square += error.sum(0) ** 2
            self.bias -= rate * error.sum(0) / np.sqrt(square)
        self.weights[used] = weights
        return self


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each whole text, its number of words, its features and how often each occurs, as 32-bit integers: no more than FEATURES of them."""
    for batch in batches:
        for text, doc_id, domain in zip(*[batch.column(c) for c in ("text", "doc_id", "domain")], strict=True):
            codes, sizes = words().codes([text.as_py().encode()])
            features, counts = np.unique(words().pairs[codes], return_counts=True)
            columns = [pa.array([doc_id.as_py()], pa.int64()), pa.array([domain.as_py()]), pa.array(sizes), *(pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (features, counts))]
            yield pa.record_batch(columns, ["doc_id", "domain", "n_tokens", "features", "counts"])


def train(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Fit on the whole texts of about sample documents of each domain of labelled (doc_id, domain), chosen by their id's hash."""
    of = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    counts = {r["domain"]: r["n"] for r in of.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    domains = sorted(counts)
    if not domains:
        return Classifier(["all"])
    rate = F.coalesce(*[F.when(F.col("domain") == d, F.lit(min(1.0, sample / n))) for d, n in sorted(counts.items())])
    chosen = of.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < rate * (1 << 30))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "domain", "text")
    rows = texts.mapInArrow(_feature_counts, "doc_id bigint, domain string, n_tokens bigint, features binary, counts binary")
    # One row of each id, however often it is repeated: as many as the sample has, of bounded size.
    rows = rows.groupBy("doc_id", "domain").agg(F.min(F.struct("n_tokens", "features", "counts")).alias("x")).select("doc_id", "domain", "x.*").collect()
    rows.sort(key=lambda r: (r["domain"], r["doc_id"], r["n_tokens"], r["features"], r["counts"]))
    if not rows:
        return Classifier(domains)
    gold = np.array([domains.index(r["domain"]) for r in rows])
    weight = np.array([counts[d] for d in domains]) / np.maximum(1, np.bincount(gold, minlength=len(domains)))
    return Classifier(domains).fit(*[[np.frombuffer(r[c], "<i4") for r in rows] for c in ("features", "counts")], np.array([r["n_tokens"] for r in rows]), gold, weight)


class Steps:
    """Gradient rounds so far: what each took from the rates by domain, and how far it then ran on (momentum).

    A document's rate depends on its own posteriors and these few numbers only, so any task can redo all rounds.
    """

    def __init__(self, most: float = MOST) -> None:
        self.most, self.taken, self.momentum = most, [], []

    def rates(self, posterior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rates after all rounds, within 0 and most, and the point that the next round starts from."""
        rate = ahead = np.ones(len(posterior))
        for step, on in zip(self.taken, self.momentum, strict=True):
            before, rate = rate, np.clip(ahead - posterior @ step, 0.0, self.most)
            ahead = rate + on * (rate - before)
        return rate, ahead


@cache
def words() -> Words:
    """A worker's words, which later tasks find."""
    return Words()


def _classifier_stage(model: Classifier) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text", STEP):
                codes, sizes = words().codes([x.encode() for x in part.column("text").to_pylist()])
                columns = [pa.array(sizes), pa.array(model.posteriors(words().pairs, codes, sizes).tolist(), pa.list_(pa.float64()))]
                yield pa.record_batch([part.column("id"), part.column("row_key"), *columns], ["id", "row_key", "n_tokens", "posterior"])

    return run


def _sums(steps: Steps, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each task: its tokens, and by domain those expected at the rates and at the next round's start; before the first round the second moments of its posteriors too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + 2 * size + size * size)
        for batch in batches:
            p, n = np.array(batch.column("posterior").flatten()).reshape(-1, size), np.array(batch.column("n_tokens"))
            rate, ahead = steps.rates(p)
            moments = np.zeros(size * size) if steps.taken else ((p * n[:, None]).T @ p).ravel()
            total += np.concatenate([[n.sum()], (n * rate) @ p, (n * ahead) @ p, moments])
        yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total)], ["place", "value"])

    return run


def reachable(targets: np.ndarray, now: np.ndarray, gram: np.ndarray, most: float) -> np.ndarray:
    """Targets with none higher than nine tenths of the rise that the domain's own rows give at the greatest rate; the others share what that leaves.

    A row's part in that rise is its posterior, so a domain to which hardly any row belongs is not made up
    of many copies of others' rows.
    """
    limit, aim, held = now + 0.9 * (most - 1) * np.diag(gram), targets.copy(), np.zeros(len(targets), bool)
    while (over := ~held & (aim > limit)).any():
        held |= over
        aim[held] = limit[held]
        rest = targets * ~held
        if not rest.sum():
            return now
        aim = np.where(held, aim, rest / rest.sum() * (1 - aim[held].sum()))
    return aim


def fit_rates(members: DataFrame, size: int, targets: np.ndarray, most: float = MOST) -> tuple[Steps, np.ndarray]:
    """Gradient rounds to the rates, and by how much the expected shares of tokens then miss the targets, over all rows of members.

    Minimises the squared misses by projected gradient with momentum (dropped where it points uphill), starting
    from rates of 1, each round projected to 0..most. Misses are measured in the metric of the posteriors' own second
    moments, so that a full step is stable and a domain of few tokens moves as fast as others. A round
    is one pass over the stored posteriors and brings back a few numbers.

    Targets are those of reachable().
    """

    def summed(steps: Steps) -> np.ndarray:
        total = np.zeros(1 + 2 * size + size * size)
        for r in members.mapInArrow(_sums(steps, size), "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
            total[r["place"]] = r["value"]
        return total

    steps, first = Steps(most), summed(Steps(most))
    if not first[0]:
        return steps, np.zeros(size)
    now, gram = first[1 : size + 1] / first[0], first[2 * size + 1 :].reshape(size, size) / first[0]
    metric = np.linalg.pinv(gram, rcond=1e-10, hermitian=True)
    aim = reachable(targets, now, gram, most)
    ahead, t = now, 1.0
    for _ in range(ROUNDS):
        steps.taken.append(metric @ (ahead - aim))
        grown = (1 + (1 + 4 * t * t) ** 0.5) / 2
        steps.momentum.append((t - 1) / grown)
        x = summed(steps)
        before, now, ahead, t = now, x[1 : size + 1] / x[0], x[size + 1 : 2 * size + 1] / x[0], grown
        if (now - aim) @ metric @ (now - aim) > (before - aim) @ metric @ (before - aim):
            ahead, t, steps.momentum[-1] = now, 1.0, 0.0
        if np.abs(now - before).max() < ENOUGH or np.abs(now - aim).max() < ENOUGH:
            break
    miss = now - targets
    (_log.warning if np.abs(miss).max() > WARN else _log.info)("expected shares miss the targets by %s", miss.tolist())
    return steps, miss


def copies_of(rate: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whole copies at a rate: its floor, and one more where the row's key, a uniform number, is below the rest."""
    return (np.floor(rate) + (keys < rate - np.floor(rate))).astype(np.int64)


def _uniform(id_col: str, text_col: str):
    return (F.pmod(F.xxhash64(F.lit(5), F.col(id_col), text_or_empty(text_col)), F.lit(1 << 52)) / float(1 << 52)).alias("row_key")


def _shares(domains: list[str], targets: dict[str, float]) -> np.ndarray:
    values = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    return values / values.sum() if values.sum() else np.full(len(domains), 1 / len(domains))


def mixture(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], most: float = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Domain posteriors, fitted rate and copies of each row of docs.

    Columns: doc_id, n_tokens (words), posterior (by domain, in alphabetical order), rate, copies, miss. targets are
    the wanted shares of the corpus's tokens by domain; a domain without one has target 0. Null text is empty
    and has the classifier's prior; repeated rows get equal rates; null ids stay; an empty table gives no
    rows; other columns are not read. Without labels there is one domain, and all rates are 1. No rate is above
    most. miss is by how much the expected shares of tokens miss the targets at worst, the same in all rows;
    above WARN it is also logged.
    """
    model = train(docs, labelled, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), _uniform(id_col, text_col), text_or_empty(text_col).alias("text"))
    members = stored(rows.mapInArrow(_classifier_stage(model), "id bigint, row_key double, n_tokens bigint, posterior array<double>"), "posteriors")
    steps, miss = fit_rates(members, len(model.domains), _shares(model.domains, targets), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate, _ = steps.rates(np.array(batch.column("posterior").flatten()).reshape(-1, len(model.domains)))
            columns = [batch.column(c) for c in ("id", "n_tokens", "posterior")]
            yield pa.record_batch([*columns, pa.array(rate), pa.array(copies_of(rate, np.array(batch.column("row_key"))))], ["doc_id", "n_tokens", "posterior", "rate", "copies"])

    mixed = members.mapInArrow(run, "doc_id bigint, n_tokens bigint, posterior array<double>, rate double, copies bigint")
    return mixed.withColumn("miss", F.lit(float(np.abs(miss).max(initial=0.0))))


def mixed_rows(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], most: float = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each row as often as mixture() says (so most times at most), with all columns; no shuffle of texts.

    Null and empty texts have the classifier's prior; repeated rows get equal copies; null ids stay; an empty table gives no rows.
    """
    model = train(docs, labelled, id_col=id_col, text_col=text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no name of docs clashes or has dots
    of = dict(zip(docs.columns, names, strict=True))
    text, key = of[text_col], "row_key"
    slim = docs.select(F.lit(0).cast("bigint").alias("id"), _uniform(id_col, text_col), text_or_empty(text_col).alias("text"))
    members = stored(slim.mapInArrow(_classifier_stage(model), "id bigint, row_key double, n_tokens bigint, posterior array<double>"), "posteriors")
    steps, _ = fit_rates(members, len(model.domains), _shares(model.domains, targets), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, text, STEP):
                codes, sizes = words().codes([(x or "").encode() for x in part.column(text).to_pylist()])
                copies = copies_of(steps.rates(model.posteriors(words().pairs, codes, sizes))[0], np.array(part.column(key)))
                yield part.take(pa.array(np.repeat(np.arange(len(part)), copies))).drop_columns([key])

    plain = docs.toDF(*names)
    return plain.withColumn(key, _uniform(of[id_col], text)).mapInArrow(run, plain.schema).toDF(*docs.columns)
