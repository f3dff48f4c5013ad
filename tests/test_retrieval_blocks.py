"""Exact search in blocks."""

import numpy as np
import pytest

from lectern.operators import retrieval


@pytest.mark.parametrize("group", [None, "label"])
def test_blocks_and_groups_are_exact(spark, monkeypatch, group):
    """Several parts of rules, blocks of queries, ties by id, null labels, zero vectors last."""
    for name, n in (("QUERIES", 7), ("RULES", 30), ("STEP", 4)):
        monkeypatch.setattr(retrieval, name, n, raising=False)
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, size=(200, 4)).astype(float)  # many equal ones
    label = [None if i % 9 == 0 else str(i % 3) for i in range(200)]
    rows = [(i, v[i].tolist(), label[i]) for i in range(200)] + [(200, None, "1")]
    e = spark.createDataFrame(rows, "id bigint, embedding array<double>, label string").repartition(3)
    asked = e.where("id % 10 = 1 and id < 200").selectExpr("id as query_id", "embedding as vector")
    stated = set()
    for q in [i for i in range(200) if i % 10 == 1 and v[i].any()]:
        with np.errstate(invalid="ignore"):
            far = np.round(1 - v @ v[q] / (np.linalg.norm(v, axis=1) * np.linalg.norm(v[q])), 12)
        for g in set(label) if group else {None}:
            own = sorted((i for i in range(200) if not group or label[i] == g), key=lambda i: (bool(np.isnan(far[i])), 0 if np.isnan(far[i]) else far[i], i))
            stated |= {(q, g, float(far[i])) for i in own[:3]}
    zero = {i for i in range(200) if not v[i].any()}
    found = [r for r in retrieval.top_k(asked, e, 3, group=group).collect() if r["query_id"] not in zero]
    assert {(r["query_id"], r[group] if group else None, round(r["distance"], 12) + 0.0) for r in found} == {(q, g, d + 0.0) for q, g, d in stated}
