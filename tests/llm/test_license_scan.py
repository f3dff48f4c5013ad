"""License scan against brute force over all blocks and notices."""

import math
import re

import pytest

from lectern.llm import license_scan, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, label string, words string"
NAMED = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, notices=license_scan.NOTICES, threshold=0.9):
    w, base, places = words(text), set(), []
    for phrase, label in license_scan.PHRASES.items():
        p = words(phrase)
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    sets = [(label, set(words(t)), max(8, 1 << (len(words(t)) - 1).bit_length())) for label, t in notices]
    wider = lambda label, s: [x for x in sets if s < x[1] and x[0] != label]
    least = lambda s: math.ceil(threshold * len(s) - 1e-9)
    labels, score = set(), 1.0 if places else 0.0
    for label, s, size in sets:
        size = max([size, *(x[2] for x in wider(label, s))])
        for at in range(0, len(w), size):
            block = set(w[at : at + 2 * size])
            if len(s & block) >= least(s) and not any(len(x[1] & block) >= least(x[1]) for x in wider(label, s)):
                labels.add(label)
                score = max(score, len(s & block) / len(s))
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels | base)), score)


def found(df):
    return sorted(str((r["doc_id"], *(r[c] for c in NAMED))) for r in df.collect())


def test_query(spark, sf_dir, duck):
    assert found(queries.op11_license_scan(spark, sf_dir)) == sorted(str((d, *brute(t))) for d, t in duck.sql("SELECT doc_id, text FROM documents").fetchall())


def test_query_finds_more_than_phrases(spark):
    rows = queries.op11_license_scan(spark, "/root/testdata/sf0.01").where("labels <> base_labels").collect()
    assert rows and all("gpl-3" in r["labels"] for r in rows)


@pytest.mark.parametrize("step", [40, 1 << 20])
def test_edges(spark, monkeypatch, step):
    monkeypatch.setattr(license_scan, "STEP", step)
    mit, apache = license_scan.NOTICES[0][1], license_scan.NOTICES[3][1]
    texts = [
        None, "", "...", mit, "x " * 777 + mit.upper() + " y" * 50, mit[: len(mit) // 2], apache.replace("Version", "Vers."), "cc by nc cc by nc, CC-BY-NC", "UNDER the MIT\nlicense", "under the mit", "license version 2 apache license version 2",
        "licensed under the GNU Lesser General Public License, version 3", "licensed under the GNU General Public License, version 3", "Licensed under CC BY-NC-SA 4.0", license_scan.NOTICES[11][1], license_scan.NOTICES[12][1], "wort " * 60_000 + apache, "é" * 90 + " licensed under CC BY 4.0",
    ]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, mit), (None, mit), (3, mit)]
    rows = spark.createDataFrame([(*d, "x", "y") for d in docs], SCHEMA).repartition(3)
    assert found(license_scan.license_scan(rows)) == sorted(str((d, *brute(t))) for d, t in docs)
    assert found(license_scan.license_scan(spark.createDataFrame([], SCHEMA))) == []
    own = [("a", "one two three four"), ("b", "two three four five six"), ("c", "one two three four seven")]
    texts = ["one two three four", "four three seven two", "six five four three two one seven", "zero"]
    assert found(license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), own, threshold=0.75)) == sorted(str((d, *brute(t, own, 0.75))) for d, t in enumerate(texts))


def test_notices_are_bounded(spark):
    docs = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        license_scan.license_scan(docs, [("a", "w " * 30_000)])
    with pytest.raises(ValueError):
        license_scan.license_scan(docs, [("a", "...")])
