"""Corpus queries against brute force, on the supplied small tables."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from lectern.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(duck):
    return [(d, t or "") for d, t in duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()]


def found(query, spark, sf_dir, *columns, key="doc_id"):
    rows = query(spark, sf_dir).collect()
    assert len({r[key] for r in rows}) == len(rows)
    return {r[key]: tuple(r[c] for c in columns) for r in rows}


def test_token_counts(spark, sf_dir, documents):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = found(queries.op1_token_counts, spark, sf_dir, "n_bytes", "n_tokens", "over_limit")
    assert got == {d: (len(t.encode()), n := len(model.encode(t)), n > 4096) for d, t in documents}


def test_language_accuracy(spark, sf_dir, duck):
    lang = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    rows = queries.op2_language_id(spark, sf_dir).collect()
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_token_files(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    model, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, {}
    for d, t in documents:
        ids = np.array([*model.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want[d] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert found(queries.op4_token_files, spark, sf_dir, "start", "n_tokens", "ids_crc32") == want


def test_exact_dedup(agree):
    agree(queries.op5_exact_dedup, queries.ORACLES["op5_exact_dedup"])


def test_warc(spark, sf_dir, duck):
    pages = [(p, (h or "").encode()) for p, h in duck.sql("SELECT page_id, html FROM pages ORDER BY page_id").fetchall()]
    first: dict = {}
    for p, b in pages:
        first.setdefault(b, p)
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    want = {p: (len(b), digest(b), "response" if first[b] == p else "revisit", None if first[b] == p else first[b]) for p, b in pages}
    assert found(queries.op6_warc, spark, sf_dir, "payload_bytes", "payload_digest", "record_type", "refers_to", key="page_id") == want


def test_simhash(spark, sf_dir, documents):
    prints = {}
    for d, t in documents:
        w = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    group = {d: d for d in prints}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2 and root(a) != root(b):
                group[max(root(a), root(b))] = min(root(a), root(b))
    assert found(queries.op7_simhash, spark, sf_dir, "fingerprint", "component_id") == {d: (f"{f:016x}", root(d)) for d, f in prints.items()}


def test_substrings(spark, sf_dir, documents):
    texts = {d: t.encode() for d, t in documents}
    seen = collections.Counter(t[i : i + 400] for t in texts.values() for i in range(len(t) - 399))
    want = {}
    for d, t in texts.items():
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i + 1 : i + 401] = True
        kept = bytes(x for x, g in zip(t, gone[1:]) if not g)
        want[d] = (len(t), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest())
    assert found(queries.op8_substring_dedup, spark, sf_dir, "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_quality_counts(spark, sf_dir, documents, duck):
    want = {}
    for d, t in documents:
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        want[d] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w))
    assert found(queries.op9_quality_rules, spark, sf_dir, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    kept = found(queries.op9_quality_rules, spark, sf_dir, "base_failed", "kept")
    assert not any(failed and k for failed, k in kept.values())
    good = [kept[d] for d, q in duck.sql("SELECT doc_id, quality FROM labels").fetchall() if q == 1 and not kept[d][0]]
    assert sum(k for _, k in good) >= 0.98 * len(good)


def test_packing(spark, sf_dir, duck):
    size = dict(duck.sql("SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 FROM documents").fetchall())
    source = dict(duck.sql("SELECT doc_id, source FROM documents").fetchall())
    rows = queries.op3_packing(spark, sf_dir).collect()
    whole, bins = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        whole[r["doc_id"]] += r["n_tokens"]
        bins[r["bin_id"]].append(r)
    assert dict(whole) == size
    for pieces in bins.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["n_tokens"]
        assert at <= 8192
        held = [source[r["doc_id"]] for r in pieces if r["n_tokens"] < 8192]
        assert len(held) == len(set(held))


def test_mixing(spark, sf_dir, duck):
    rows = queries.op10_mixing(spark, sf_dir).collect()
    assert len(rows) == duck.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    p, n, r = (np.array([x[c] for x in rows]) for c in ("posterior", "n_tokens", "rate"))
    target = np.array([queries.TARGETS[k] for k in sorted(queries.TARGETS)])
    assert (r >= 0).all() and np.abs((n * r) @ p / n.sum() - target).max() < 0.002
    c = np.array([x["copies"] for x in rows])
    spread = np.sqrt(((n[:, None] * p) ** 2 * 0.25).sum(0)) / n.sum()  # of independent draws of the last copy
    assert (np.abs((n * c) @ p / n.sum() - target) < 0.002 + 4 * spread).all()
    assert all(x["copies"] in (int(x["rate"]), int(x["rate"]) + 1) for x in rows)
