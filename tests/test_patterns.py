"""Patterns in texts against a search for each pair."""

import random

import pytest

from lectern.operators import patterns

TEXTS = ["aaaa", "", None, "abcabcab", "ü漢字漢字", "no hit", "ab" * 40_000]
WORDS = ["a", "aa", "ab", "abc", "bcab", "漢字", "字", "zz", "", "ab"]


def brute(texts, words):
    count = lambda t, w: [i + 1 for i in range(len(t) - len(w) + 1) if t.startswith(w, i)]
    return sorted((d, i, len(at), at[0]) for d, t in enumerate(texts) for i, w in enumerate(words) if w and (at := count(t or "", w)))


@pytest.mark.parametrize("most", [3, 1 << 20])
def test_all_patterns_in_all_texts(spark, most):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    words = spark.createDataFrame([*enumerate(WORDS), (99, None)], "pattern_id int, pattern string")
    assert sorted(map(tuple, patterns.pattern_hits(texts, words, most).collect())) == brute(TEXTS, WORDS)
    assert patterns.pattern_hits(texts, words.where("pattern is null"), most).count() == patterns.pattern_hits(texts.where("false"), words, most).count() == 0


def test_own_patterns(spark):
    rows = [(0, "abcab", ["ab", "x", "cab"]), (1, None, ["a"]), (2, "abc", None), (3, "abc", [])]
    got = patterns.own_hits(spark.createDataFrame(rows, "doc_id int, t string, own array<string>"), "t", "own").collect()
    assert sorted(map(tuple, got)) == [(0, 0, 2, 1), (0, 2, 1, 3)]


def test_time_does_not_grow_with_patterns():
    rng = random.Random(1)
    words = tuple({"".join(rng.choices("abcdefgh", k=9)) for _ in range(20_000)})
    text = "".join(rng.choices("abcdefgh", k=300_000))
    assert {words[x["i"]] for x in patterns.places(text, words)} == {text[i : i + 9] for i in range(len(text) - 8)} & set(words)
