"""Judged matching against plain augmenting paths, and on a key of many edges."""

import random
import time

import pytest

from lectern.operators import components, matching


def plain(edges, have, give):
    """Copies one by one along augmenting paths."""
    left = [a for a, n in enumerate(have) for _ in range(n)]
    right = [b for b, n in enumerate(give) for _ in range(n)]
    near = [[j for j, b in enumerate(right) if (a, b) in edges] for a in left]
    owner = {}

    def place(i, seen):
        for j in near[i]:
            if j not in seen:
                seen.add(j)
                if j not in owner or place(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(left)))


@pytest.mark.parametrize("seed", range(40))
def test_largest_matching(seed):
    rng = random.Random(seed)
    n, m = rng.randint(1, 14), rng.randint(1, 14)
    edges = {(a, b) for a in range(n) for b in range(m) if rng.random() < rng.choice((0.1, 0.3, 0.6))}
    have, give = [rng.randint(0, 4) for _ in range(n)], [rng.randint(0, 4) for _ in range(m)]
    assert matching._largest_matching(list(edges), have, give) == plain(edges, have, give)


def test_many_edges_take_seconds():
    rng, n = random.Random(7), 3000
    edges = list({(rng.randrange(n), rng.randrange(n)) for _ in range(100_000)} | {(i, (i * 7 + 3) % n) for i in range(n)})
    began = time.time()
    assert matching._largest_matching(edges, [2] * n, [2] * n) == 2 * n  # the added edges are a perfect match
    assert time.time() - began < 60


def test_hot_key_is_split(spark):
    """One document and diagnosis with 100,000 judged edges in components, and other keys beside it."""
    rng = random.Random(3)
    base = "doc_id string, section string, dimension string, error_type string, description string"
    gt = [("d", "1", "x", "t", f"g{i}") for i in range(4000)] + [("d", None, "x", "t", " 甲 a"), ("e", "1", "x", "t", "g2"), ("e", "1", "x", "t", "g2"), ("e", "1", "x", "t", "")]
    pred = [("d", "1", "x", "t", f"p{i}") for i in range(4000)] + [("d", None, "x", "t", "甲a"), ("e", "1", "x", "t", "p2"), ("e", "1", "x", "t", " g2"), ("e", "1", "x", "t", "")]
    judged = list({(f"g{i}", f"p{i // 200 * 200 + rng.randrange(200)}") for i in range(4000) for _ in range(25)} | {(f"g{i}", f"p{i}") for i in range(0, 4000, 2)})
    assert len(judged) > 90_000
    frames = (spark.createDataFrame(gt, base), spark.createDataFrame(pred, base), spark.createDataFrame(judged, "gt_text string, pred_text string"))
    got = {(r["doc_id"], r["section"]): (r["items"], r["matched"]) for r in matching.described_matches(*frames).collect()}
    assert got == {("d", "1"): (4000, 4000), ("d", None): (1, 1), ("e", "1"): (3, 2)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(500, 700)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in root if any(a != b and x in (a, b) for a, b in edges)}
