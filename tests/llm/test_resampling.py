"""Importance resampling against brute force."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from lectern.llm import queries, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, rank string, score string"
LONG = "one two three " * 30_000


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target):
    every = [(d, *features(t)) for d, t in docs]
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for _, _, f in every:
        np.add.at(s, np.array(f, int), 1)
    for x in target:
        np.add.at(t, np.array(features(x)[1], int), 1)
    big, small = int(s.sum()) + 10_000, int(t.sum()) + 10_000
    gain = [math.floor(1000 * math.log((y + 1) * big / ((x + 1) * small))) for x, y in zip(s.tolist(), t.tolist())]
    rows = []
    for d, w, f in every:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    drawn = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(drawn[: 5 * len(drawn) // 100]):
        r[4] = i + 1
    return sorted(map(str, (r[:5] for r in rows)))


def found(df):
    return sorted(str([r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]]) for r in df.collect())


def test_query(spark, sf_dir, duck):
    docs, target = duck.sql("SELECT doc_id, text FROM documents").fetchall(), [t for (t,) in duck.sql("SELECT text FROM benchmark").fetchall()]
    assert found(queries.op12_importance_resampling(spark, sf_dir)) == brute(docs, target)


@pytest.mark.parametrize("places", [7, 1 << 19])
def test_edges(spark, monkeypatch, places):
    monkeypatch.setattr(resampling, "SUFFIXES", places)  # n-grams across stretches
    monkeypatch.setattr(resampling, "STEP", 200)
    rng = np.random.default_rng(2)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 9, rng.integers(15, 60)))
    docs = [(1, None), (2, ""), (3, "Été, x" * 9), (None, text()), (None, text()), (7, "same words " * 12), (7, "same words " * 12), (8, "z" * 70 + " a " + "z" * 49), (9, LONG if places > 7 else "q " * 300), *((i, text()) for i in range(20, 70))]
    target = spark.createDataFrame([(1, "w1 w2 w3 Words", "x", "y"), (2, None, "x", "y")], SCHEMA)
    rows = spark.createDataFrame([(*d, "x", "y") for d in docs], SCHEMA).repartition(3)
    assert found(resampling.resampled(rows, target)) == brute(docs, ["w1 w2 w3 Words"])
    none = spark.createDataFrame([], SCHEMA)
    assert found(resampling.resampled(none, target)) == [] and len(found(resampling.resampled(rows, none))) == len(docs)


def test_joined_hashes():
    rng = np.random.default_rng(1)
    left, right = [rng.bytes(int(n)) for n in rng.integers(0, 90, 300)], [rng.bytes(int(n)) for n in rng.integers(1, resampling.SHORT + 2, 300)]
    crc = lambda x: np.array(list(map(zlib.crc32, x)), np.uint32)
    assert (resampling.joined(crc(left), crc(right), np.array(list(map(len, right)))) == crc([a + b for a, b in zip(left, right)])).all()
