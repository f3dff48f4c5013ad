"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

from lectern.llm import queries, spelling
from lectern.llm.common import stored

SCHEMA = "doc_id bigint, text string, word string, key string"


def brute(docs):
    counts = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{d}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near, gaps = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            gaps[i, shorter].add(w)
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda x: (-words[x], x)) if near[w] else None for w in words}
    form = {w: b if b and words[b] >= 2 * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def found(df):
    rows = df.collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_query(spark, sf_dir, duck):
    assert found(queries.op13_spelling_variants(spark, sf_dir)) == brute(duck.sql("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("pairs", [0, 5, 2048])
def test_full_keys_are_halved(spark, monkeypatch, pairs):
    letters = "abcdefghijklmnopqrstuvwxyzéÿ"
    words = [f"stem{a}{b}" for a in letters for b in letters[:9]] + [f"{a}{b}tail" for a in letters[:5] for b in letters] + ["aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "×÷aaa"]
    docs = [(i, " ".join(words[i::3] * (i + 1))) for i in range(3)] + [(None, "aaaaa AAAAAa")]
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (pairs,))
    rows = spark.createDataFrame([(*d, "x", "y") for d in docs * 2], SCHEMA)
    assert found(spelling.spelling_variants(rows)) == brute(docs * 2)


def test_no_candidate_of_a_common_segment_is_pointless(spark):
    words = stored(spark.createDataFrame([(f"common{i:04d}"[:10], 3) for i in range(3000)], "word string, n bigint"), "words")
    assert spelling.near_pairs(words, pairs=64).count() == sum(1 for i in range(3000) for p in range(4) for d in "0123456789" if (x := f"{i:04d}"[:p] + d + f"{i:04d}"[p + 1 :]) > f"{i:04d}" and int(x) < 3000)


def test_edges(spark):
    rows = [(1, None, "w", "k"), (2, "", "w", "k"), (3, "1234 ¿Ā abc", "w", "k"), (4, "Wort " * 70_000, "w", "k"), (None, "worte worte worte", "w", "k"), (4, "Wort " * 70_000, "w", "k")]
    assert found(spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA))) == {"worte": (None, "worte", 3, 0, None)}
    assert found(spelling.spelling_variants(spark.createDataFrame([], SCHEMA))) == {}
    long = "x" * 50_000
    chain = spark.createDataFrame([(1, " ".join([long] * 3 + [long + "y"] * 6 + [long + "yz"] * 12), "w", "k")], SCHEMA)
    assert {w[-2:]: r[0] and r[0][-2:] for w, r in found(spelling.spelling_variants(chain, slip=None)).items()} == {"xx": "xy", "xy": "yz", "yz": None}
    assert len(spelling.roots(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", None)], "word string, form string")).where("root = 'e'").collect()) == 5
