"""Properties of metrics, candidates and injections."""

import pytest
from fixture_queries import INJECTED, TREE, _documents, _items, _sections
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import numbers
from lectern.operators import allocation, candidates, injectors, matching, metrics, review, sections
from lectern.plans.table_queries import bags
from lectern.taxonomy import ERROR_TYPES


def test_hits_nest_and_stay_within_both_bags(spark, sf_dir):
    r = metrics.item_recall(*bags(spark, sf_dir))
    assert r.where("diagnosis_hits > dimension_hits or dimension_hits > location_hits or location_hits > least(gt_count, pred_count)").count() == 0


def test_hits_at_k_fall(spark, sf_dir):
    h = metrics.hits_at(metrics.item_recall(*bags(spark, sf_dir)))
    assert h.where(" or ".join(f"(h{k + 1} and not h{k})" for k in range(1, 10))).count() == 0


def test_group_diagnosis_adds_up(spark, sf_dir):
    docs, gt, pred = bags(spark, sf_dir)
    whole = metrics.item_recall(docs, gt, pred).agg(F.sum("diagnosis_hits")).first()[0]
    for by in ("dimension", "error_type"):
        assert metrics.grouped_recall(docs, gt, pred, by).agg(F.sum("diagnosis_hits")).first()[0] == whole


def test_location_hits_of_groups_can_overlap(spark):
    docs = spark.createDataFrame([("d",)], "doc_id string")
    gt = spark.createDataFrame([("d", "5", "C2.2", "E-SC-01"), ("d", "5", "C3.1", "E-T-01")], "doc_id string, section string, dimension string, error_type string")
    pred = gt.limit(1)
    assert metrics.item_recall(docs, gt, pred).first()["location_hits"] == 1
    assert metrics.grouped_recall(docs, gt, pred, "dimension").agg(F.sum("location_hits")).first()[0] == 2


def test_deduplication_is_idempotent(spark):
    items = _items(spark, ("C3.1", "E-T-01", "5"), ("C3.1", "E-T-01", "[5]"), ("C3.1", "E-T-02", "5"))
    once = candidates.first_of_key(items, ["ord"])
    assert [r["ord"] for r in once.orderBy("ord").collect()] == [0, 2]
    assert candidates.first_of_key(once, ["ord"]).count() == 2


def test_expansion_keeps_its_input(spark):
    items = _items(spark, ("C3.1", "E-T-01", "5.1"), ("C3.3", "E-R-04", None))
    assert candidates.spread_sections(items, _sections(spark, TREE)).where("spread_rank = 0").count() == 2


@pytest.mark.parametrize("code", sorted(injectors.INJECTORS))
def test_injection_is_repeatable_and_leaves_others_alone(spark, code):
    s = _sections(spark, INJECTED, "[1] 概况\n无内容可改")
    made = injectors.INJECTORS[code](s, 3)
    notes, rows = made.annotations.collect(), made.sections.select(*s.columns).collect()
    assert {r["error_type"] for r in notes} == {code} and any(r["doc_id"] == "d1" for r in notes)
    if code in ("E-R-04", "E-T-05"):
        assert sorted(map(str, rows)) == sorted(map(str, injectors.INJECTORS[code](s, 3).sections.select(*s.columns).collect()))
    if not any(r["doc_id"] == "d2" for r in notes):
        assert [r["content"] for r in rows if r["doc_id"] == "d2"] == ["无内容可改"]


def test_block_swap_renumbers(spark):
    s = _sections(spark, "[4] 甲\n正文甲\n[4.1] 甲一\n正文\n[5] 乙\n正文乙")
    out = injectors.swapped_blocks(s, 1).sections.orderBy("ord").collect()
    assert [(r["section_number"], r["title"]) for r in out] == [("4", "乙"), ("5", "甲"), ("5.1", "甲一")]


def test_contents_table_swaps_with_its_blocks(spark):
    rows = [("d", 0, "4", "甲", "1"), ("d", 1, "5", "乙", "2"), ("d", 2, "4", "甲", "正文甲"), ("d", 3, "5", "乙", "正文乙")]
    s = spark.createDataFrame(rows, "doc_id string, ord int, section_number string, title string, content string")
    out = injectors.swapped_blocks(s, 1).sections.orderBy("ord").collect()
    assert [(r["section_number"], r["title"], r["content"]) for r in out] == [("4", "乙", "2"), ("5", "甲", "1"), ("4", "乙", "正文乙"), ("5", "甲", "正文甲")]


def test_balanced_rounds_touch_each_document(spark):
    s = _sections(spark, INJECTED, INJECTED, INJECTED)
    made = injectors.inject_balanced(s, 2, 5, ["E-T-01", "E-S-06", "E-R-04"])
    assert made.annotations.select("doc_id", "round").distinct().count() == 6


def test_model_rewrites_are_guarded(spark):
    s = _sections(spark, "[1] 范围\n本文件适用于甲")
    rewrite = lambda t: spark.createDataFrame([("d1", 0, t)], "doc_id string, ord int, content string")
    assert injectors.rewritten(s, rewrite("本文件适用于甲，应检查"), "E-SC-03").annotations.count() == 1
    assert injectors.rewritten(s, rewrite("本文件适用于乙"), "E-SC-03").annotations.count() == 0
    assert injectors.rewritten(s, rewrite("本文件适用于乙"), "E-SC-01").annotations.count() == 1


def test_allocation_rules():
    with pytest.raises(ValueError):
        allocation.allocate(["C2.1", "C2.2"], 1)
    counts = allocation.allocate(list(ERROR_TYPES), 25)
    assert counts == {d: len(t) for d, t in ERROR_TYPES.items()}
    assert allocation.allocate(["C2.2", "C3.3"], 2, {"E-SC-01": 5, "E-SC-02": 5, "E-SC-03": 5}) == {"C2.2": 0, "C3.3": 2}


def test_high_recall_review(spark):
    docs = _documents(spark, "[2] 规范性引用文件\nGB/T 1\n[5] 要求\n按 ISO 2\n[5.1] 细则\n宜检查")
    direct = spark.createDataFrame([("d1", 0, "C3.1", "E-T-01", "5.1", "r", "e"), ("d1", 1, "C3.1", "E-X", "5.1", "r", "e")], "doc_id string, pred_index int, dimension string, error_type string, section_number string, reason string, error_description string")
    found = review.high_recall(docs, {"direct": direct}).collect()
    assert {(r["error_type"], r["section_number"]) for r in found if r["source_agent"] == "direct"} == {(t, s) for t in ("E-T-01", "E-T-02", "E-T-03", "E-T-07") for s in ("5", "5.1")}
    assert {"E-R-01", "E-R-02"} <= {r["error_type"] for r in found}


def test_model_reviews(spark):
    prompts = spark.createDataFrame([("a", "list"), ("b", "null"), ("c", "boom")], "doc_id string, prompt string")

    def client(prompt):
        return {"list": '[{"error_type":"E-T-01","dimension":"C3.1"}]', "null": "null"}[prompt]

    replied = review.asked(prompts, client)
    assert [r["error_type"] for r in review.predictions_of(replied).collect()] == ["E-T-01"]
    assert {r["doc_id"]: r["reviewed"] for r in review.review_status(replied).collect()} == {"a": True, "b": False, "c": False}


def test_tools(spark):
    assert "规范性引用文件" in review.call_tool(spark, "check_mandatory_sections", '{"source_text": "[1] 范围"}')
    assert "error" in review.call_tool(spark, "no_tool", "{}")
    review.register_functions(spark)
    assert spark.sql("SELECT review_reference_base('GB/T1-2020'), review_section_depth('5.1.2'), review_same_text('a b', 'ab')").first()[:] == ("GB/T1", 3, True)


def test_readable_lines(spark):
    assert spark.range(1).select(sections.is_noise(F.lit("GB/T 1.1—2020"))).first()[0]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(0, 7.9), min_size=1, max_size=50))
def test_rounding_is_exact(spark, values):
    values += [0.03125, 0.00125, 1 / 800, 3 / 800, 5 / 32, 0.00005, 0.5, 1.0, 0.0, 1 / 200_000]
    d = spark.createDataFrame([(x,) for x in values], "x double").select("x", *[numbers.rounded("x", n).alias(f"r{n}") for n in (4, 6)])
    for r in d.collect():
        assert r["r4"] == round(r["x"], 4) and r["r6"] == round(r["x"], 6)


def test_groups_are_in_order(spark):
    gt = spark.createDataFrame([("d", 0, "5", c, "E") for c in "cab"] + [("d", 1, "5", None, "E")], "doc_id string, gt_index int, section string, dimension string, error_type string")
    found = metrics.grouped_recall(gt.select("doc_id").distinct(), gt, gt.withColumnRenamed("gt_index", "pred_index"), "dimension").collect()
    assert [r["group"] for r in found] == ["<NULL>", "a", "b", "c"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), max_size=10), st.lists(st.integers(0, 3), min_size=4, max_size=4), st.lists(st.integers(0, 3), min_size=4, max_size=4))
def test_largest_matching_of_kinds(edges, have, give):
    left, right = [i for i, n in enumerate(have) for _ in range(n)], [i for i, n in enumerate(give) for _ in range(n)]
    owner: dict[int, int] = {}

    def placed(a: int, seen: set[int]) -> bool:
        for b, kind in enumerate(right):
            if (left[a], kind) in edges and b not in seen:
                seen.add(b)
                if b not in owner or placed(owner[b], seen):
                    owner[b] = a
                    return True
        return False

    want = sum(placed(a, set()) for a in range(len(left)))
    assert matching._largest_matching(list(set(edges)), have, give) == want
