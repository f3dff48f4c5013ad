"""Running values over documents in parts against one pass in order."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import scans, sections
from lectern.plans import table_queries

OUTLINE = ["封面", "目次", "1 范围....1", "2 要求....2", "[1] 范围", "甲", "乙", "前言", "丙", "[2] 要求", "丁"]


def parts(monkeypatch, part, fan):
    monkeypatch.setattr(scans, "PART", part)
    monkeypatch.setattr(scans, "FAN", fan)


@pytest.mark.parametrize("part, fan", [(12, 8), (3, 1), (1, 1), (0, 3)])
def test_scan_is_a_pass_in_order(spark, monkeypatch, part, fan):
    parts(monkeypatch, part, fan)
    rng = random.Random(part)
    texts = {"a": 77, "b": 1, "c": 40, None: 30}
    docs = {d: [rng.choice("xyz") + str(i) for i in range(n)] for d, n in texts.items()}
    rows = scans.in_parts(spark.createDataFrame([(d, "\n".join(x)) for d, x in docs.items()], "doc_id string, text string"), "text", "\n")
    run = scans.scanned(rows, "pos", n=(scans.ADDED, F.when(F.col("line").startswith("x"), 1)), last=(scans.LATEST, F.when(F.col("line").startswith("y"), F.col("line"))))
    want = []
    for d, x in docs.items():
        n, last = None, None
        for i, line in enumerate(x):
            n, last = (n or 0) + 1 if line[0] == "x" else n, line if line[0] == "y" else last
            want.append((d, i, n or 0, last))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["pos"], r["n"] or 0, r["last"])) for r in run.collect())


def test_ten_parts_are_as_one(spark, monkeypatch):
    docs = spark.createDataFrame([("d", "\n".join(OUTLINE * 4)), ("e", "\n".join(OUTLINE[:5])), ("f", None), (None, "[1] x\ny")], "doc_id string, source_text string")
    read = lambda: (sorted(map(str, sections.parse_sections(docs).collect())), sorted(str((r["doc_id"], r["pos"])) for r in sections.without_contents_table(sections.lines(docs)).collect()))
    whole = read()
    parts(monkeypatch, 2, 1)
    assert max(r["_part"] for r in sections.lines(docs).collect()) >= 10
    assert read() == whole and len(whole[0]) == 4 * 4 + 2 + 1


@pytest.mark.parametrize("name", ["wn1_islands", "wn7_running_heads", "wn12_contents_skip"])
def test_no_window_spans_a_document(spark, sf_dir, name):
    plan = table_queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    lines = [x for x in windows if "pos#" in x]
    assert lines and all("_part#" in x.split("windowspecdefinition(")[1].split("ASC")[0] for x in lines)
