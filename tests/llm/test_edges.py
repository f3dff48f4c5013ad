"""Corpus operators on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import components, exact_dedup, language_id, mixing, packing, quality_rules, simhash, substring_dedup, token_counts, token_files, warc
from lectern.llm.common import scratch_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, key string"
LONG = "wort " * 60_000
ROWS = [
    (1, "ein Satz mit acht oder neun Worten steht hier und dort. " * 12, "de", "a", 0, "x", "y"), (2, None, "de", None, None, None, None), (3, "", None, "a", 0, "x", "y"), (None, "text ohne nummer", "de", "a", 0, "x", "y"),
    (5, LONG, "de", "b", 0, "x", "y"), (6, "kurz", "en", "b", 0, "x", "y"), (6, "kurz", "en", "b", 0, "x", "y"), (7, " ku rz\n", "en", "b", 0, "x", "y"), (8, "123 456", "en", "c", 0, "x", "y"), (9, "Été 日本 <|endoftext|> \x00", "fr", "c", 0, "x", "y"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 0, 0), (8, 0, 1), (None, 1, 0), (5, None, None)], "doc_id bigint, quality int, toxic int")


def test_token_counts(spark, docs, none):
    path, cache = public_tokenizers.path("piece_bpe_32k.model"), scratch_path(spark, "cache")
    count = lambda d: sorted(map(str, token_counts.count_tokens(d, path, cache).collect()))
    first = count(docs)
    assert len(first) == len(ROWS) and count(docs) == first
    stored = spark.read.parquet(f"{cache}/tokenizer={token_counts.tokenizer_digest(path)}")
    assert stored.count() == stored.select("digest").distinct().count() == len({r[1] or "" for r in ROWS})
    assert count(none) == []


def test_token_counts_of_json(spark, docs):
    rows = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), scratch_path(spark, "cache")).where("doc_id in (2, 3)").collect()
    assert [r["n_tokens"] for r in rows] == [0, 0]


def test_language(docs, none):
    net = language_id.train(docs)
    rows = language_id.predict_language(docs, net).collect()
    assert len(rows) == len(ROWS)
    assert {r["doc_id"]: r["lang_pred"] for r in rows if r["lang_pred"] == "und"} == {2: "und", 3: "und", 8: "und"}
    assert language_id.train(none) is None and language_id.predict_language(none, None).count() == 0
    assert {r["lang_pred"] for r in language_id.predict_language(docs, None).collect()} == {"und"}


def test_gradients_by_difference():
    net, rng = language_id.Network(["a", "b"]), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data, mask, gold = rng.integers(0, 256, (3, 5)), np.arange(5) < np.array([[5], [3], [5]]), np.array([0, 1, 0])
    loss = lambda: -np.log(np.take_along_axis(net.label(data, mask), gold[None, :, None], 2))[..., 0][mask.T].mean()
    grads = net.gradients(data, mask, gold)
    for k in net.p:
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        old, step = net.p[k][at], 1e-3
        net.p[k][at] = old + step
        up = loss()
        net.p[k][at] = old - step
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / (2 * step) - grads[k][at]) < 1e-3


def test_windows_are_led_in(spark):
    rng, lead = np.random.default_rng(1), language_id.LEAD
    net = language_id.Network(["a", "b"])
    data = rng.integers(0, 256, 1500)
    whole = net.label(data[None], np.ones((1, 1500), bool))[:, 0]
    first = np.array([0, 512, 1024])
    cut, inside = language_id._cut(data, first, np.zeros(3, int), np.full(3, 1500), 512, lead)
    parts = net.label(cut, inside, lead)
    assert np.abs(np.concatenate([parts[:, i] for i in range(3)])[:1500] - whole).max() < 0.01


def test_packing_ignores_partitions(spark):
    rows = [(i, "x" * (i % 37 + 1), f"s{i % 5}") for i in range(300)] + [(7, "y" * 20, "s1")] * 4
    pack = lambda n: sorted(map(str, packing.best_fit_packing(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(n), 100).collect()))
    assert pack(1) == pack(5)


def test_packing_numbers_repeats_in_blocks(spark, monkeypatch):
    d = spark.createDataFrame([(1, "ab", "s")] * 50 + [(None, None, None)] * 23, "doc_id bigint, text string, source string")
    pack = lambda: sorted(map(str, packing.best_fit_packing(d, 100).collect()))
    whole = pack()
    monkeypatch.setattr(packing, "BLOCK", 7)
    assert pack() == whole and len(whole) == 73


def test_packing(docs, none):
    rows = packing.best_fit_packing(docs, 1000).collect()
    assert sum(r["n_tokens"] for r in rows) == sum(len((r[1] or "").encode()) + 1 for r in ROWS)
    assert packing.best_fit_packing(none).count() == 0


def test_tightest_compatible_bin():
    placed = packing.pack(np.array([6, 5, 4, 3, 3]), np.array([0, 1, 0, 1, 2]), np.array([-1] * 5), 10)
    where = {p[0]: p[4] for p in placed}
    assert where[0] != where[1] and where[2] == where[1] and where[3] == where[0] and where[4] == len({where[0], where[1]})


def test_packing_ends_no_bin_early():
    rng = np.random.default_rng(3)
    sizes, sources, clusters = rng.integers(1, 50, 400), rng.integers(0, 5, 400), rng.integers(-1, 70, 400)
    bins: dict = {}
    for i, _, _, size, b, at in packing.pack(sizes, sources, clusters, 100):
        fits = [x for x, held in bins.items() if sum(s for _, s in held) + size <= 100 and all(sources[j] != sources[i] and (clusters[i] < 0 or clusters[j] != clusters[i]) for j, _ in held)]
        free = lambda x: 100 - sum(s for _, s in bins[x])
        assert (b not in bins and not fits) or (b in fits and free(b) == min(map(free, fits)))
        bins.setdefault(b, []).append((i, size))


def test_token_files(spark, docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    folder = scratch_path(spark, "files")
    manifest = token_files.write_token_files(docs, path, folder, 1, parts=3)
    rows = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 5, 6, 6, 7, 8, 9]
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
    assert token_files.tokens_of(folder, manifest["segments"][0], manifest["dtype"], 0)[-1] == 1
    empty = scratch_path(spark, "files")
    assert token_files.write_token_files(none, path, empty, 1)["segments"] == [] and token_files.read_token_files(spark, empty).count() == 0


def test_word_encoder_is_the_library():
    coder = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", " ", "A, b. it's we'll 12,3 x.y\tz", "ÉTÉ ßẞ İΣς é 　漢字", "<|endoftext|> a<|endoftext|>B <|ENDOFTEXT|>", "\x00\x7f%%$.,,", "wo rd" * 200]
    for _ in range(2):
        ids, sizes = coder.encode(texts)
        assert np.split(ids, np.cumsum(sizes)[:-1])[2].tolist() == coder.tokenizer.encode(texts[2], add_special_tokens=False).ids
        assert ids.tolist() == [i for t in texts for i in coder.tokenizer.encode(t, add_special_tokens=False).ids]


def test_exact_dedup(docs, none):
    rows = {(r["doc_id"], r["kept"]): r for r in exact_dedup.exact_dedup(docs).collect()}
    assert rows[(7, True)]["group_size"] == 3 and rows[(6, False)]["keep_id"] == 7
    assert rows[(2, True)]["group_size"] == 2 and rows[(3, False)]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "5", "7", "8", "9", "None"]
    assert exact_dedup.exact_dedup(none).count() == 0


def test_repeated_rows_keep_one(spark):
    d = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "doc_id bigint, text string")
    assert sorted(r["kept"] for r in exact_dedup.exact_dedup(d).collect()) == [False, True, True]
    assert exact_dedup.without_copies(d).count() == 2


def test_warc(spark):
    rows = [(3, "http://B.example/a?x#f", "same"), (1, "https://a.example/", "same"), (2, None, None), (None, "http://[bad", "x" * 100_000), (5, "http://a.example/", ""), (5, "http://a.example/", "")]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id bigint, url string, html string, key string").repartition(3)
    folder = scratch_path(spark, "warc")
    warc.write_archives(pages, folder)
    got = sorted(warc.read_archives(spark, folder).collect(), key=lambda r: r["capture_rank"])
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in sorted(got, key=lambda r: str(r["page_id"]))] == [(1, "response", None), (2, "response", None), (3, "revisit", 1), (5, "revisit", 2), (5, "revisit", 2), (None, "response", None)]
    assert [r["capture_rank"] for r in got] == list(range(6)) and [(r["url_key"], r["captured"]) for r in got] == sorted((r["url_key"], r["captured"]) for r in got)
    warc.write_archives(pages.where("false"), folder := scratch_path(spark, "warc"))
    assert warc.read_archives(spark, folder).count() == 0


def test_small_payloads_do_not_revisit(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id bigint, url string, html string")
    warc.write_archives(pages, folder := scratch_path(spark, "warc"), least=3)
    assert {r["page_id"] for r in warc.read_archives(spark, folder).where("record_type = 'revisit'").collect()} == {4}


def test_loser_tree():
    rng = np.random.default_rng(5)
    for k in (0, 1, 2, 3, 7, 64):
        runs = [sorted(rng.integers(0, 50, rng.integers(0, 30)).tolist()) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_runs_are_read_from_a_key_on(tmp_path, monkeypatch):
    from pyarrow import fs

    monkeypatch.setattr(warc, "BLOCK", 128)
    rng = np.random.default_rng(8)
    entries = sorted((f"k{rng.integers(0, 40):03d}" * int(rng.integers(1, 9)), "2020", int(rng.integers(0, 9)), "f", i, 1) for i in range(300))
    system, path = fs.LocalFileSystem(), str(tmp_path / "run")
    assert warc._write_run(system, path, entries) == 300
    for low in [None, ("", "", 0), ("z", "", 0), *(e[:3] for e in entries[::17]), ("k01", "2020", 3)]:
        assert list(warc._read_run(system, path, low)) == [e for e in entries if low is None or e[:3] >= low]


def test_merges_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(warc, "FAN", 2)
    pages = spark.range(40).selectExpr("id as page_id", "concat('http://h', id % 7, '.example/') as url", "cast(id as string) as html").repartition(7)
    warc.write_archives(pages, folder := scratch_path(spark, "warc"))
    got = sorted(warc.read_archives(spark, folder).collect(), key=lambda r: r["capture_rank"])
    assert len(got) == 40 and [(r["url_key"], r["captured"]) for r in got] == sorted((r["url_key"], r["captured"]) for r in got)


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    empty = {r["doc_id"]: r for r in rows if r["fingerprint"] == "0" * 16}
    assert len(rows) == len(ROWS) and empty.keys() == {2, 3} and {r["component_id"] for r in empty.values()} == {2}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.without_near_copies(docs)
    assert kept.columns == docs.columns and simhash.without_near_copies(none).count() == 0


@pytest.mark.parametrize("block", [64, 1])
def test_links_are_exact(spark, monkeypatch, block):
    """Pairs within a block and midpoints of full cells connect the same fingerprints."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(2)
    prints = {int(x) for x in rng.integers(-(1 << 62), 1 << 62, 40)}
    for x in list(prints)[:12]:
        for _ in range(6):
            x ^= 1 << int(rng.integers(0, 62))
            prints.add(x)
    prints = sorted(prints)
    classes = spark.createDataFrame(list(enumerate(prints)), "rep bigint, fp bigint")
    found = simhash.links(classes, 2).collect()
    flips = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    assert all(flips(prints[r["u"]], prints[r["v"]]) <= 2 for r in found)
    group = {r["node"]: r["component"] for r in components.components(simhash.links(classes, 2)).collect()}
    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if flips(a, b) <= 2:
                assert group[i] == group[j]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(30)] + [(50, 40), (None, 3)], "u bigint, v bigint")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == dict.fromkeys(range(31), 0) | {40: 40, 50: 40}
    assert components.components(edges.where("false")).count() == 0


def test_similar_groups(spark):
    base = [f"w{i}" for i in range(200)]
    near = base[:100] + ["neu"] + base[101:]
    far = [f"v{i}" for i in range(200)]
    d = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, "kurz"), (5, "KURZ")], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in simhash.without_near_copies(d).collect()) == [1, 3, 4]


@pytest.mark.parametrize("side", [256, 40])
def test_similar_groups_are_whole(spark, monkeypatch, side):
    """Edited copies of one text, a family with a shared passage and small groups keep what brute force keeps."""
    monkeypatch.setattr(simhash, "SIDE", side, raising=False)
    rng, fresh = np.random.default_rng(7), iter(range(10**6))
    edited = lambda words, n: [f"e{next(fresh)}" if i in at else w for at in [set(rng.choice(len(words), n, replace=False).tolist())] for i, w in enumerate(words)]
    base, shared = [f"w{i}" for i in range(200)], [f"p{i}" for i in range(90)]
    texts = [edited(base, 4) for _ in range(120)] + [base]
    family = [shared + [f"f{next(fresh)}" for _ in range(60)] for _ in range(60)]
    texts += family + [edited(x, 2) for x in family[:15]] + [edited(edited(base, 60), 3) for _ in range(5)]
    texts += [texts[3], *[[f"s{next(fresh)}" for _ in range(50)]] * 2]
    order = rng.permutation(len(texts)).tolist()
    sets = {d: set(simhash.shingle_hashes(" ".join(texts[i]), 5).tolist()) for d, i in enumerate(order)}
    group = {d: d for d in sets}
    for a in sets:
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    d = spark.createDataFrame([(d, " ".join(texts[i])) for d, i in enumerate(order)], "doc_id bigint, text string").repartition(3)
    assert sorted(r["doc_id"] for r in simhash.without_near_copies(d).collect()) == sorted(set(group.values()))


def test_word_table_is_bounded():
    path = public_tokenizers.path("word_bpe_49k.json")
    small, rng = token_files.WordEncoder(path, table=200_000), np.random.default_rng(2)
    texts = [chr(97 + i % 26) * 1_000_000 for i in range(5)] + [" ".join("".join(rng.choice(list("abcdeé,."), 9)) for _ in range(400)) for _ in range(30)]
    for text in texts * 2:
        ids, sizes = small.encode([text, "the end, of 5, it. "])
        want = [x.ids for x in small.tokenizer.encode_batch_fast([text, "the end, of 5, it. "], add_special_tokens=False)]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == want[0] + want[1]
        assert max(map(len, small.known), default=0) <= token_files.LONG
        assert len(small.known) * token_files.ENTRY <= small.table and len(small.pool) * 4 <= small.table
        assert len(small.starts) == len(small.sizes) == len(small.known)
    assert small.base


def test_substrings(spark, docs, none):
    rng = np.random.default_rng(4)
    text = lambda n: "".join(rng.choice(list("abé "), n))
    a, b = text(300), text(120)
    texts = [a, text(50) + a[40:200] + text(30), b + "x" * 90 + b, a[:150] + b[:80], text(39), None, "y" * 200]
    d = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(d, 64).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, t in enumerate(raw):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 63):
            if sum(o[q : q + 64] == t[p : p + 64] for o in raw for q in range(len(o) - 63)) > 1:
                gone[p : p + 64] = True
        assert got[i if i else None] == (int(gone.sum()), hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest())
    assert substring_dedup.remove_repeats(docs).count() == len(ROWS) and substring_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_shared_places_across_splitters(spark, parts):
    rng, length = np.random.default_rng(8), 12
    side = lambda n: bytes(rng.choice(list(b"aab"), int(n)).tolist())
    entries = sorted({(int(rng.integers(0, 3)) - 1, b"k" + side(rng.integers(0, 8)), side(rng.integers(5, 12))) for _ in range(150)})
    entries = [(k, b, a, p) for p, (k, b, a) in enumerate(entries) if len(b) + len(a) >= length]
    strings = [{(n, b[:n], a[: length - n]) for n in range(len(b) + 1) if length - n <= len(a)} for _, b, a, _ in entries]
    want = {}
    for (k, b, _, p), own in zip(entries, strings):
        others = set().union(*(o for (k2, *_, p2), o in zip(entries, strings) if k2 == k and p2 != p))
        if places := {len(b) - n for n, *_ in own & others}:
            want[k, p] = places
    rows = spark.createDataFrame([(k, p, bytearray(b), bytearray(a)) for k, b, a, p in entries], "key bigint, phrase bigint, before binary, after binary").repartition(3)
    got = {(r["key"], r["phrase"]): set().union(*(range(x["a"], x["b"]) for x in r["places"])) for r in substring_dedup.shared_places(substring_dedup.stored(rows, "sides"), length, parts).collect()}
    assert want and got == want


def test_very_long_text_in_pieces(spark):
    rng = np.random.default_rng(6)
    t = "".join(rng.choice(list("abcd"), 5000))
    d = spark.createDataFrame([(1, t), (2, t[700:3100])], "doc_id bigint, text string")
    got = {r["doc_id"]: r["removed"] for r in substring_dedup.remove_repeats(d, 400, step=1000).collect()}
    assert [tuple(x) for x in got[1]] == [(700, 3100)] and [tuple(x) for x in got[2]] == [(0, 2400)]


def test_quality(docs, none, labels):
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert rows[2]["n_words"] == 0 and rows[2]["base_failed"] and not rows[2]["kept"] and rows[5]["base_failed"] and rows[1]["n_repeat_words"] > 0
    assert quality_rules.quality_rules(none, labels).count() == 0
    kept = quality_rules.kept_rows(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["kept"] for r in quality_rules.quality_rules(docs, labels).collect())
    assert quality_rules.quality_rules(docs, labels.where("false")).count() == len(ROWS)


def test_quality_trains_on_all_lines(spark):
    rows = [(i, "\n".join(f"line {j} of many words" if j < 100 else "$$ || ##" for j in range(150)), i % 2) for i in range(8)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    pieces = quality_rules.training_lines(d.select("doc_id", "text"), d.select("doc_id", "quality"))
    for q in (0, 1):
        got, want = np.concatenate([x for x, y in pieces if y == q]), quality_rules.line_features([x.encode() for x in rows[q][1].split("\n")])[0]
        assert len(want) == 150 and np.array_equal(got, np.tile(want, (4, 1)))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for n in (1, 2, 6):
        score, moves = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        value = lambda y: sum(score[i, v] for i, v in enumerate(y)) + sum(moves[a, b] for a, b in zip(y[:-1], y[1:]))  # noqa: B023, E731
        best = max(([k >> i & 1 for i in range(n)] for k in range(1 << n)), key=value)
        assert quality_rules.viterbi(score, moves).tolist() == best


def test_mixing(docs, none, labels):
    from lectern.llm.queries import TARGETS, domains

    rows = mixing.mixture(docs, domains(labels), TARGETS).collect()
    assert len(rows) == len(ROWS) and all(r["rate"] >= 0 and abs(sum(r["posterior"]) - 1) < 1e-9 for r in rows)
    mixed = mixing.mixed_rows(docs, domains(labels), TARGETS)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.mixture(none, domains(labels), TARGETS).count() == 0
    assert {r["rate"] for r in mixing.mixture(docs, domains(labels).where("false"), {}).collect()} == {1.0}


@pytest.mark.parametrize("shares", [(0.767, 0.113, 0.12), (0.985, 0.01, 0.005)])
def test_mixing_meets_targets(spark, monkeypatch, shares):
    """Domain totals are within 1e-4 of the targets, for nearly one-hot posteriors of small domains too."""
    rng, targets = np.random.default_rng(11), {"a": 0.92, "b": 0.04, "c": 0.04}
    kind = rng.choice(3, 4000, p=shares)
    made = 0.98 * np.eye(3)[kind] + 0.02 * rng.dirichlet([1, 1, 1], 4000)
    fixed = mixing.Classifier(sorted(targets))
    monkeypatch.setattr(mixing, "train", lambda *a, **b: fixed)
    rows = [(i, 0.5, int(n), p.tolist()) for i, (n, p) in enumerate(zip(rng.integers(20, 2000, 4000), made, strict=True))]
    members = spark.createDataFrame(rows, "id bigint, row_key double, n_tokens bigint, posterior array<double>").repartition(3)
    monkeypatch.setattr(mixing, "stored", lambda df, name: members)
    got = mixing.mixture(spark.createDataFrame([], DOCS), None, targets).collect()
    p, n, r = (np.array([x[c] for x in got]) for c in ("posterior", "n_tokens", "rate"))
    assert len(got) == 4000 and (r >= 0).all() and np.abs((n * r) @ p / n.sum() - np.array([0.92, 0.04, 0.04])).max() < 1e-4


def test_mixing_learns_from_the_end_of_long_texts(spark):
    tail = {"clean": "friendly", "toxic": "hateful"}
    rows = [(i, "same words " * 3000 + f"{tail[d]} " * 300, d) for i, d in enumerate(["clean", "toxic"] * 20)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, domain string")
    model, known = mixing.train(d, d), mixing.Words()
    codes, sizes = known.codes([b"friendly " * 50, b"hateful " * 50])
    assert (model.posteriors(known.pairs, codes, sizes).diagonal() > 0.9).all()


def test_pipeline(spark, sf_dir, duck):
    from lectern.llm.common import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if name in ("quality rules", "exact dedup", "simhash near dedup"):
            assert docs.columns == columns and docs.join(before, columns, "left_anti").count() == 0
        if name == "exact dedup":
            assert docs.select(exact_dedup.normalised(F.col("text"))).distinct().count() == docs.count() == before.select(exact_dedup.normalised(F.col("text"))).distinct().count()
        if name == "packing":
            sizes = before.agg(F.sum(F.octet_length("text") + 1)).first()[0]
            assert docs.agg(F.sum("n_tokens")).first()[0] == sizes
    good = [d for d, in duck.sql("SELECT doc_id FROM labels WHERE quality = 1").fetchall()]
    assert good and corpus_pipeline.run(spark, sf_dir).columns == docs.columns


@pytest.mark.parametrize("target, alpha, most", [((0.6, 0.3, 0.1), 0.4, 4.0), ((0.6, 0.3, 0.1), 0.05, 4.0), ((0.98, 0.01, 0.01), 0.3, 1.7), ((0.1, 0.1, 0.8), 0.2, 1.5)])
def test_rates_are_the_least_squares_solution(spark, target, alpha, most):
    """The misses against those of a dense solver of the same bounded least squares; they are unique, also where the targets are out of reach."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([alpha] * 3, 60)
    n, target = rng.integers(1, 50, 60).astype(np.float64), np.array(target)
    members = spark.createDataFrame([(i, 0.5, int(a), b.tolist()) for i, (a, b) in enumerate(zip(n, p))], "id bigint, row_key double, n_tokens bigint, posterior array<double>")
    steps, miss = mixing.fit_rates(members, 3, target, most)
    rate, _ = steps.rates(p)
    a, w, x = (n[:, None] * p / n.sum()).T, n / n.sum(), np.ones(60)
    assert rate.min() >= 0 and rate.max() <= most and np.abs(a @ rate - target - miss).max() < 1e-9
    gram = np.einsum("i,ij,ik->jk", w, p, p)
    aim = mixing.reachable(target, a @ x, gram, most)
    assert abs(aim.sum() - 1) < 1e-9 and (aim <= a @ x + (most - 1) * np.diag(gram)).all()
    for _ in range(20_000):
        x = np.clip(x - p @ np.linalg.solve(gram, a @ x - aim), 0, most)
    assert np.abs(a @ x - a @ rate).max() < 1e-4


def test_targets_out_of_reach_move_little(spark):
    """Hardly a row of a domain that has a target: others are not repeated in its stead."""
    rng = np.random.default_rng(4)
    p = rng.dirichlet([8, 0.05, 0.4], 3000)
    n = rng.integers(1, 500, 3000)
    members = spark.createDataFrame([(i, 0.5, int(a), b.tolist()) for i, (a, b) in enumerate(zip(n, p))], "id bigint, row_key double, n_tokens bigint, posterior array<double>")
    steps, miss = mixing.fit_rates(members, 3, np.array([0.92, 0.04, 0.04]), 4)
    rate, _ = steps.rates(p)
    assert np.abs(miss).max() > mixing.WARN and rate.max() <= 4 and (mixing.copies_of(rate, rng.random(3000)) > 0).mean() > 0.9


def test_pipeline_keeps_documents_in_mixing(spark, duck):
    """At a size with a few hundred labels: no document more often than the bound, nine in ten still there, targets met."""
    import corpus_pipeline
    from lectern.llm.queries import domains

    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = corpus_pipeline.exact_stage(spark, corpus_pipeline.quality_stage(spark, docs, sf_dir), sf_dir).cache()
    mixed = corpus_pipeline.mixing_stage(spark, docs, sf_dir).groupBy("doc_id").count().collect()
    assert max(r["count"] for r in mixed) <= corpus_pipeline.COPIES and len(mixed) >= 0.9 * docs.count()
    labelled = domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = mixing.mixture(docs, labelled.where("domain <> 'poor'"), corpus_pipeline.TARGETS, corpus_pipeline.COPIES).collect()
    assert rows[0]["miss"] < mixing.WARN
    clean = {d for d, in duck.sql(f"SELECT doc_id FROM '{sf_dir}/labels.parquet' WHERE quality = 1 AND toxic = 0").fetchall()}
    assert clean & {r["doc_id"] for r in rows} <= {r["doc_id"] for r in mixed}
    docs.unpersist()


def test_clashing_and_dotted_columns(spark, labels):
    from lectern.llm.queries import TARGETS, domains

    d = spark.createDataFrame([(1, "ein Satz mit Worten", 1, 2.0, "k"), (6, "kurz", 3, 4.0, "k"), (8, None, 5, 6.0, None)], "doc_id bigint, text string, row_key int, `a.b` double, tag string")
    mixed = mixing.mixed_rows(d, domains(labels), TARGETS)
    assert mixed.columns == d.columns and {r["row_key"] for r in mixed.collect()} <= {1, 3, 5}
    assert sorted(r["a.b"] for r in simhash.without_near_copies(d).collect()) == [2.0, 4.0, 6.0]
    assert sorted(r["a.b"] for r in exact_dedup.without_copies(d).collect()) == [2.0, 4.0, 6.0]


def test_near_copies_by_families(spark):
    """Groups whose keys overlap are compared as one, others key by key; either way as brute force does."""
    rng, members = np.random.default_rng(9), []
    for key in range(40):
        members += [(key, int(x)) for x in rng.choice(30 if key < 30 else 3000, 12, replace=False)]
    groups = simhash._families(simhash.stored(spark.createDataFrame(members, "key bigint, node bigint").distinct(), "members")).collect()
    met, want = set(), set()
    for rows, pairs in ((groups, met), (members, want)):
        held = {}
        for key, node in rows:
            held.setdefault(key, set()).add(node)
        pairs.update((a, b) for x in held.values() for a in x for b in x if a < b)
    assert want <= met and len(groups) < len(set(members))
