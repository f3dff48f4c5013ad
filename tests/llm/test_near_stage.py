"""The pipeline's near stage against brute force over fingerprints and shingle sets."""

import corpus_pipeline
from lectern.llm import simhash


def test_near_stage_links_by_fingerprints_and_by_shingles(spark, sf_dir):
    tail = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    prose = [f"w{i}" for i in range(300)]
    texts = {
        1: "alpha beta gamma " * 200 + tail("a", 40), 2: "alpha beta gamma " * 200 + tail("b", 40), 3: "beta delta gamma " * 200 + tail("c", 40),  # 1 and 2: one fingerprint, few shingles in common
        4: " ".join(prose), 5: " ".join([*prose[:140], "neu", *prose[141:220], "alt", *prose[221:]]), 6: tail("x", 80), 7: None,
    }
    prints = {d: simhash.majority(simhash.shingle_hashes(t or "", 3)) for d, t in texts.items()}
    sets = {d: set(simhash.shingle_hashes(t or "", 5).tolist()) for d, t in texts.items()}
    linked = lambda a, b: ((prints[a] ^ prints[b]) & ((1 << 64) - 1)).bit_count() <= 2 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0
    assert len(sets[1] & sets[2]) < 0.8 * len(sets[1] | sets[2]) and linked(1, 2) and linked(4, 5) and not linked(1, 3)
    group = {d: d for d in texts}
    for a in texts:
        for b in range(1, a):
            if linked(a, b):
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    kept = corpus_pipeline.near_stage(spark, docs, sf_dir)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(group.values()))
