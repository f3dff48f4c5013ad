"""Cases over small inline documents in the reviewed language; their SQL states the rows worked out by hand."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import taxonomy
from lectern.functions import replies, text
from lectern.operators import allocation, candidates, injectors, matching, metrics, retrieval, review, rules, sections, worded
from lectern.sources import benchmark, config, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return str(x).lower() if isinstance(x, bool) else repr(x)


def rows_sql(columns: str, rows: list[tuple]) -> str:
    """SQL of stated rows; columns are "name TYPE" with commas between."""
    named = [c.strip().split(" ", 1) for c in columns.split(",")]
    if not rows:
        return "SELECT " + ", ".join(f"NULL::{t} AS {n}" for n, t in named) + " WHERE false"
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return "SELECT " + ", ".join(f"{n}::{t} AS {n}" for n, t in named) + f" FROM (VALUES {values}) v({', '.join(n for n, _ in named)})"


def golden(columns: str, rows: list[tuple]):
    """Register a case whose result is stated."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark)
        QUERIES[f.__name__].__name__ = f.__name__
        ORACLES[f.__name__] = rows_sql(columns, rows)
        return f

    return add


def _documents(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame([(f"d{i + 1}", t) for i, t in enumerate(texts)], "doc_id string, source_text string")


def _sections(spark: SparkSession, *texts: str) -> DataFrame:
    return sections.parse_sections(_documents(spark, *texts))


KEYS = [(0, None, None), (1, "", ""), (2, " 5.1 ", "5.1"), (3, "[5.1]", "5.1"), (4, "[]", "[]"), (5, "附录A", "A"), (6, "附 录　B.1", "B.1"), (7, "[附录 C]", "C"), (8, "附录", ""), (9, "[1][2]", "1][2")]


@golden("i INTEGER, key VARCHAR", [(i, k) for i, _, k in KEYS])
def pf1_section_key(spark):
    """PF1: comparable section numbers."""
    return spark.createDataFrame([(i, n) for i, n, _ in KEYS], "i int, n string").select("i", text.section_key(F.col("n")).alias("key"))


OUTLINE = "封面文字\n前言\n本文件说明\n[1] 范围\n本文件适用于甲\n[5.1]无空格标题\n正文\n参考文献\n[1] GB/T 1—2020\n[附录A]（规范性）"


@golden("ord INTEGER, section_number VARCHAR, title VARCHAR, content VARCHAR", [(0, None, "前言", "本文件说明"), (1, "1", "范围", "本文件适用于甲"), (2, "5.1", "无空格标题", "正文"), (3, None, "参考文献", ""), (4, "1", "GB/T 1—2020", ""), (5, "附录A", "（规范性）", "")])
def wn1_sections(spark):
    """WN1: texts cut at headings; a bibliography's [1] is taken for one."""
    return _sections(spark, OUTLINE).select("ord", "section_number", "title", "content")


@golden("section VARCHAR, first_title VARCHAR, last_title VARCHAR", [(None, "前言", "参考文献"), ("1", "范围", "GB/T 1—2020"), ("5.1", "无空格标题", "无空格标题"), ("A", "（规范性）", "（规范性）")])
def jn5_section_lookup(spark):
    """JN5, JN6: first and last section of each key."""
    s = _sections(spark, OUTLINE)
    first, last = (matching.section_lookup(s, x).select("section", F.col("title").alias(n)) for x, n in ((False, "first_title"), (True, "last_title")))
    return first.alias("f").join(last.alias("l"), F.col("f.section").eqNullSafe(F.col("l.section"))).select("f.section", "first_title", "last_title")


@golden("doc_id VARCHAR, source_text VARCHAR", [("d1", "[1] 范围\n甲\n\n前言\n乙\n")])
def io19_section_text(spark):
    """IO19: sections as text again."""
    return sections.section_text(spark.createDataFrame([("d1", 0, "1", "范围", "甲"), ("d1", 1, None, "前言", "乙")], "doc_id string, ord int, section_number string, title string, content string"))


@golden("ord INTEGER, section_number VARCHAR, title VARCHAR, content VARCHAR", [(0, "5", "总则章", "总则"), (1, "5.1", "试验要求", "内容\n6.1 其他\nx"), (2, "5.2", "试品状态", "y")])
def wn9_nested_split(spark):
    """WN9: subsections in a content cut out; others' numbers stay text."""
    s = spark.createDataFrame([("d1", 0, "5", "总则章", "总则\n5.1 试验要求\n内容\n6.1 其他\nx\n5.2 试品状态\ny")], "doc_id string, ord int, section_number string, title string, content string")
    return sections.split_nested(s).select(F.col("ord").cast("int").alias("ord"), "section_number", "title", "content")


CITED = "[2] 规范性引用文件\nGB/T 1.1-2020 标准化\nGB/T 2000—2019 甲\nISO 9001 质量\n[4] 要求\n应符合 GB/T 1.1-2020 的规定\n按 GB/T 2000-2015 试验\n见 IEC 60068-2005"


@golden("rank INTEGER, error_type VARCHAR, section_number VARCHAR, name VARCHAR, confidence DOUBLE", [(1, "E-R-01", "4", "GB/T2000-2015", 0.6), (2, "E-R-01", "4", "IEC60068-2005", 0.6), (3, "E-R-02", "2", "GB/T2000-2019", 0.58), (4, "E-R-02", "2", "ISO9001", 0.58), (5, "E-R-03", "4", "GB/T2000", 0.52)])
def tk4_reference_findings(spark):
    """JN8 to JN10, TK4: missing, redundant and mismatched references in order."""
    return rules.reference_findings(_sections(spark, CITED)).select("rank", "error_type", "section_number", "name", "confidence")


@golden("t VARCHAR, refs VARCHAR", [("符合GB/T 1234的规定", ""), ("（GB/T 1234）和gb/t 5-2001", "GB/T1234"), ("按 ISO/IEC 27001:2013 与 DL/T 5—2001", "ISO/IEC27001,DL/T5-2001")])
def fs2_reference_ids(spark):
    """FS2, FS3: references of a text; none right behind a letter of any script."""
    d = spark.createDataFrame([("符合GB/T 1234的规定",), ("（GB/T 1234）和gb/t 5-2001",), ("按 ISO/IEC 27001:2013 与 DL/T 5—2001",)], "t string")
    return d.select("t", F.array_join(text.reference_ids(F.col("t")), ",").alias("refs"))


@golden("t VARCHAR, base VARCHAR", [("GB/T1-2020", "GB/T1"), ("ISO9001", "ISO9001")])
def fs4_reference_base(spark):
    """FS4: references without their year."""
    return spark.createDataFrame([("GB/T1-2020",), ("ISO9001",)], "t string").select("t", text.reference_base(F.col("t")).alias("base"))


@golden("t VARCHAR, ids VARCHAR", [("GB/T 1.1—2020、IEC 60068 及 GB/T 1.1—2009", "GB/T1.1,IEC60068")])
def fs5_injected_ids(spark):
    """FS5: references as the injectors read them."""
    return spark.createDataFrame([("GB/T 1.1—2020、IEC 60068 及 GB/T 1.1—2009",)], "t string").select("t", F.array_join(text.injected_ids(F.col("t")), ",").alias("ids"))


TERMS = "[3] 术语和定义\n[3.1] 试样 specimen\n[3.2] 容量\n[3.4] 负荷\n[5] 要求\n试样的容量"


@golden("rank INTEGER, term VARCHAR, section_number VARCHAR, used_count BIGINT, used_sections VARCHAR", [(1, "试样", "3.1", 1, "5"), (2, "容量", "3.2", 1, "5"), (3, "负荷", "3.4", 0, "")])
def ag21_term_usage(spark):
    """WN4, JN11, AG21: terms and the sections that use them."""
    s = _sections(spark, TERMS)
    return rules.term_usage(rules.term_entries(s), s).select("rank", "term", "section_number", "used_count", F.array_join("used_sections", ",").alias("used_sections"))


@golden("error_type VARCHAR, section_number VARCHAR, what VARCHAR, confidence DOUBLE", [("E-TM-02", "3.4", "负荷", 0.55), ("E-TM-05", "3", "3.3", 0.75)])
def tk9_term_findings(spark):
    """TK9, WN6: unused terms and gaps in their numbers."""
    s = _sections(spark, TERMS)
    terms = rules.term_entries(s)
    unused = rules.unused_terms(rules.term_usage(terms, s)).select("error_type", "section_number", F.col("term").alias("what"), "confidence")
    return unused.union(rules.number_gaps(terms).select("error_type", "section_number", "missing", "confidence"))


@golden("doc_id VARCHAR, next_number VARCHAR", [("d1", "3.5")])
def wn11_next_number(spark):
    """WN11: the number after the last term."""
    return rules.next_number(rules.term_entries(_sections(spark, TERMS)))


@golden("term VARCHAR, section_number VARCHAR, definition VARCHAR", [("试样", "3.1", "用于试验的 样品"), ("负荷", "3.2", "所加的力")])
def fs9_terms_in_content(spark):
    """FS8, FS9: term lines within a content, with what follows as definition."""
    return rules.term_entries(_sections(spark, "[3] 术语和定义\n3.1 试样 test specimen\n用于试验的\n样品\n[3.2] 负荷\n所加的力")).select("term", "section_number", F.when(F.col("term") == "试样", F.substring("definition", 1, 8)).otherwise(F.col("definition")).alias("definition"))


@golden("rank INTEGER, section_number VARCHAR, sentence VARCHAR, modal_words VARCHAR, batch INTEGER", [(1, "5.1", "产品不应使用劣质材料", "不应,应", 0), (2, "5.1", "应符合GB/T 1的要求", "应", 0)])
def wn3_modal_sentences(spark):
    """WN3, FS6, FS7: sentences with modal words; short ones do not count."""
    s = _sections(spark, "[5.1] 材料\n产品不应使用劣质材料。宜检查；外观\n应符合GB/T 1的要求")
    return rules.modal_sentences(s).select("rank", "section_number", "sentence", F.array_join("modal_words", ",").alias("modal_words"), "batch")


TREE = "[5] 甲\n[5.1] 乙\n[5.1.1] 丙\n[5.1.2] 丁\n[5.1.2.1] 戊"


def _items(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame([("d1", i, *r, "r", "e") for i, r in enumerate(rows)], "doc_id string, ord int, dimension string, error_type string, section_number string, reason string, error_description string")


@golden("ord INTEGER, n BIGINT, sections VARCHAR, types VARCHAR", [(0, 16, "5,5.1,5.1.1,5.1.2", "E-T-01,E-T-02,E-T-03,E-T-07"), (1, 2, "5.1", "E-S-02,E-S-03"), (2, 4, "5,5.1,5.1.1,5.1.2", "E-R-04")])
def jn12_candidate_expansion(spark):
    """JN12 to JN14, PF5, WN2: valid items spread to ancestors, children and related types, once for each key."""
    items = _items(spark, ("C3.1", "E-T-01", "5.1"), ("C2.1", "E-S-02", "5.1"), ("C3.3", "E-R-04", "5.1"), ("C3.3", "E-R-05", "5.1"))
    found = candidates.final_candidates(items, _sections(spark, TREE), ["ord"])
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return found.groupBy("ord").agg(F.count(F.lit(1)).alias("n"), join("section_number").alias("sections"), join("error_type").alias("types"))


@golden("section_number VARCHAR, reason VARCHAR, error_description VARCHAR", [("5.1", "r", "e"), ("5", "r（section 扩展父章节 5）", "e；补充：section 扩展父章节 5"), ("5.1.1", "r（section 扩展子章节 5.1.1）", "e；补充：section 扩展子章节 5.1.1"), ("5.1.2", "r（section 扩展子章节 5.1.2）", "e；补充：section 扩展子章节 5.1.2")])
def fs17_reason_notes(spark):
    """FS17: notes of spread candidates."""
    return candidates.spread_sections(_items(spark, ("C2.2", "E-SC-01", "5.1")), _sections(spark, TREE)).select("section_number", "reason", "error_description")


@golden("ord INTEGER, dimension VARCHAR, error_type VARCHAR, section_number VARCHAR, reason VARCHAR, error_description VARCHAR", [(0, "C3.1", "E-T-01", None, "因", "因"), (2, "C2.1", "E-S-01", "1", "述", "述")])
def pf2_normalised_items(spark):
    """PF2, PF3, PF4: items trimmed, incomplete ones dropped, reason and description standing in for one another."""
    rows = [(0, " C3.1 ", "E-T-01", "", " 因 ", None), (1, "", "E-T-01", "1", "x", "y"), (2, "C2.1", "E-S-01", "1", "", "述"), (3, "C2.1", None, "1", "x", "y")]
    return candidates.output_columns(candidates.normalised(spark.createDataFrame(rows, "ord int, dimension string, error_type string, section_number string, reason string, error_description string")), "ord")


@golden("c VARCHAR, confidence DOUBLE", [("0.8", 0.8), ("7", 1.0), ("-1", 0.0), ("x", 0.0), (None, 0.0)])
def pf6_confidence(spark):
    """PF6: confidences within 0 and 1."""
    return spark.createDataFrame([("0.8",), ("7",), ("-1",), ("x",), (None,)], "c string").select("c", candidates.clamped_confidence(F.col("c")).alias("confidence"))


@golden("dimension VARCHAR, error_type VARCHAR, rank INTEGER", [("C3.1", "E-T-02", 1), ("C3.1", "E-T-03", 2)])
def tk1_supplements(spark):
    """TK1: confident items that are not direct ones."""
    items = _items(spark, ("C3.1", "E-T-01", "1"), ("C3.1", "E-T-02", "1"), ("C3.1", "E-T-03", "1"), ("C3.1", "E-T-04", "1")).withColumn("confidence", F.element_at(F.array(F.lit("0.99"), F.lit("0.9"), F.lit("0.8"), F.lit("0.7")), F.col("ord") + 1))
    return candidates.supplements(items, _items(spark, ("C3.1", "E-T-01", "[1]"))).select("dimension", "error_type", "rank")


ODD_OUTLINE = "[2] 术语\n[1] 适用范围\n[5.1.1.1.1.1] x\n前言\n[附录A] 试验（资料性）\n[附录B] 记录"


@golden("check_name VARCHAR, what VARCHAR", [("missing", "规范性引用文件"), ("order", "2 术语 > 1 适用范围"), ("name", "术语 > 术语和定义"), ("name", "适用范围 > 范围"), ("depth", "5.1.1.1.1.1=6"), ("appendix", "附录A 资料性"), ("appendix", "附录B -")])
def jn15_structure_checks(spark):
    """JN15, JN16, WN5, FS18 to FS20: checks of the headings."""
    docs = _documents(spark, ODD_OUTLINE)
    h = sections.tool_headings(docs)
    row = lambda df, name, what: df.select(F.lit(name).alias("check_name"), what.alias("what"))
    parts = [
        row(rules.missing_sections(docs, h), "missing", F.col("category")), row(rules.order_issues(h).where("kind = 'sequence'"), "order", F.concat("prev", F.lit(" > "), "curr")), row(rules.name_issues(h), "name", F.concat("title", F.lit(" > "), "standard_title")),
        row(rules.depth_issues(h), "depth", F.concat("section_number", F.lit("="), F.col("depth").cast("string"))), row(rules.appendix_types(h), "appendix", F.concat("section_number", F.lit(" "), F.coalesce("attribute", F.lit("-")))),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


GT = [("d1", 0, "5.1", "C3.1", "E-T-01"), ("d1", 1, "5.1", "C3.1", "E-T-01"), ("d1", 2, None, "C2.1", "E-S-04"), ("d2", 0, "1", "C2.2", "E-SC-03")]
PRED = [("d1", 0, "[5.1]", "C3.1", "E-T-01"), ("d1", 1, "附录A", "C2.1", "E-S-05"), ("d1", 2, None, "C2.1", "E-S-04"), ("d1", 3, "5.1", "C3.1", "E-T-02"), ("d3", 0, "1", "C3.1", "E-T-01"), ("d3", 1, "2", "C3.1", "E-T-01")]


def _bags(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "doc_id string")
    make = lambda rows, i: matching.keyed(spark.createDataFrame(rows, f"doc_id string, {i} int, section_number string, dimension string, error_type string")).withColumn("description", F.lit("x"))
    return docs, make(GT, "gt_index"), make(PRED, "pred_index")


@golden("doc_id VARCHAR, gt_count BIGINT, pred_count BIGINT, location_hits BIGINT, dimension_hits BIGINT, diagnosis_hits BIGINT, mcs DOUBLE, penalty DOUBLE, np_mcs DOUBLE", [("d1", 3, 4, 3, 3, 2, 0.477688, 0.997059, 0.476283), ("d2", 1, 0, 0, 0, 0, 0.0, 1.0, 0.0), ("d3", 0, 2, 0, 0, 0, 0.0, 0.997059, 0.0)])
def ag1_small_recall(spark):
    """AG1 to AG6 on three documents: repeated keys, null sections, no items."""
    m = metrics.derived(metrics.item_recall(*_bags(spark)))
    return m.select("doc_id", "gt_count", "pred_count", "location_hits", "dimension_hits", "diagnosis_hits", *[F.round(c, 6).alias(c) for c in ("mcs", "penalty", "np_mcs")])


@golden("doc_id VARCHAR, precision_hit BOOLEAN, location_hit BOOLEAN, diagnosis_hit BOOLEAN", [("d1", False, True, False), ("d2", False, False, False), ("d3", True, True, True)])
def ag11_small_hits(spark):
    """AG11 on three documents; one without items hits all."""
    return metrics.document_hits(*_bags(spark))


@golden("gt_count BIGINT, diagnosis_hits BIGINT, mcs DOUBLE, np_mcs DOUBLE, doc_weighted_mcs DOUBLE, avg_penalty DOUBLE, doc_weighted_np_mcs DOUBLE", [(4, 2, 0.303265, 0.301516, 0.358266, 0.997794, 0.357212)])
def ag8_small_corpus(spark):
    """AG7, AG8 on three documents."""
    m = metrics.corpus_metrics(metrics.item_recall(*_bags(spark)))
    return m.select("gt_count", "diagnosis_hits", *[F.round(c, 6).alias(c) for c in ("mcs", "np_mcs", "doc_weighted_mcs", "avg_penalty", "doc_weighted_np_mcs")])


@golden('position INTEGER, section VARCHAR, gt_index INTEGER, preds VARCHAR, title VARCHAR', [(1, "5.1", 0, "0", "乙"), (2, "5.1", 1, "0", "乙"), (3, None, 2, "2", None)])
def jn7_hit_sections(spark):
    """JN7: diagnosed items with the predictions that mark them, in section order."""
    _, gt, pred = _bags(spark)
    h = matching.hit_sections(gt, pred, _sections(spark, TREE))
    return h.select("position", "section", "gt_index", F.array_join(F.transform("pred_indexes", lambda i: i.cast("string")), ",").alias("preds"), "title")


@golden("doc_id VARCHAR, marked VARCHAR", [("d1", "[5.1] 乙 | C3.1/E-T-01 | #0\n[5.1] 乙 | C3.1/E-T-01 | #0\n[-]  | C2.1/E-S-04 | #2")])
def fs21_marked_text(spark):
    """FS21: hit sections as text."""
    _, gt, pred = _bags(spark)
    return matching.marked_text(matching.hit_sections(gt, pred, _sections(spark, TREE)))


@golden("items BIGINT, matched BIGINT", [(3, 2)])
def jn3_judged_matches(spark):
    """JN3, FS16: one-to-one matches where a table of judged pairs adds to equality without white space."""
    base = "doc_id string, section string, dimension string, error_type string, description string"
    gt = spark.createDataFrame([("d", "1", "C3.1", "E-T-01", t) for t in ("错误：A b", "y", "z")], base)
    pred = spark.createDataFrame([("d", "1", "C3.1", "E-T-01", t) for t in ("错误：Ab", "q")], base)
    judged = spark.createDataFrame([("y", "q"), ("z", "q")], "gt_text string, pred_text string")
    return matching.described_matches(gt, pred, judged).select("items", "matched")


@golden("a VARCHAR, b VARCHAR, same BOOLEAN", [("错误：A b", "错误：Ab", True), ("", "", False), ("x", "y", False)])
def fs16_same_description(spark):
    """FS16: descriptions equal without white space; empty ones never."""
    return spark.createDataFrame([("错误：A b", "错误：Ab"), ("", ""), ("x", "y")], "a string, b string").select("a", "b", text.same_description(F.col("a"), F.col("b")).alias("same"))


REPLIES = [(0, "<think>x</think>\n```json\n[{\"error_type\":\"E\"}]\n```"), (1, "note [1,2] and {\"a\":1}"), (2, "not json"), (3, ""), (4, "null"), (5, "说明 {\"a\":1} 完"), (6, "[{\"error_type\":\"E\"},3,\"x\",null]")]


@golden("i INTEGER, json VARCHAR, skipped BOOLEAN, n INTEGER", [(0, '[{"error_type":"E"}]', False, 1), (1, "[1,2]", False, 0), (2, "{}", False, 0), (3, "{}", False, 0), (4, "null", True, None), (5, '{"a":1}', False, 0), (6, '[{"error_type":"E"},3,"x",null]', False, 1)])
def fj1_reply_json(spark):
    """FJ1, FJ2: the JSON of model replies, and how many objects it lists."""
    r = spark.createDataFrame(REPLIES, "i int, reply string")
    return r.select("i", replies.json_text(F.col("reply")).alias("json"), replies.is_skipped(F.col("reply")).alias("skipped"), F.when(replies.items(F.col("reply")).isNotNull(), F.size(replies.items(F.col("reply")))).alias("n"))


@golden("section_number VARCHAR, title VARCHAR, content VARCHAR", [("1", "范围", "甲"), (None, "前言", "")])
def fj4_section_rows(spark):
    """FJ4: sections that a reply lists."""
    r = spark.createDataFrame([('[{"section_number":"1","title":"范围","content":"甲"},{"title":" "},5,{"section_number":"","title":"前言"}]',)], "reply string")
    return r.select(F.explode(replies.section_rows(F.col("reply"))).alias("s")).select("s.*")


@golden("t VARCHAR, joined VARCHAR", [("见5.\n1.\n2和甲.\n3", "见5.1.2和甲.\n3")])
def fs11_joined_numbers(spark):
    """FS11: numbers that a line end broke."""
    return spark.createDataFrame([("见5.\n1.\n2和甲.\n3",)], "t string").select("t", text.joined_numbers(F.col("t")).alias("joined"))


@golden("line VARCHAR, noise BOOLEAN, kind VARCHAR", [("12", True, None), ("", True, None), ("GB/T 1.1—2020", True, None), ("5.1 要求", False, "numbered"), ("附 录 A", False, "appendix"), ("## 范围", False, "markdown"), ("[1] 范围", False, "bracket"), ("前言", False, "plain"), ("正文内容", False, None)])
def fs13_heading_kinds(spark):
    """PF13, FS13: page furniture and kinds of headings."""
    d = spark.createDataFrame([(x,) for x in ("12", "", "GB/T 1.1—2020", "5.1 要求", "附 录 A", "## 范围", "[1] 范围", "前言", "正文内容")], "line string")
    noise = sections.is_noise(F.col("line"))
    return d.select("line", noise.alias("noise"), F.when(~noise, sections.heading_kind(F.col("line"))).alias("kind"))


@golden("doc_id VARCHAR, kept VARCHAR", [("d1", "封面|1 范围|正文")])
def wn12_contents_table(spark):
    """WN12: lines of a contents table fall away."""
    d = spark.createDataFrame([("d1", "封面\n目次\n1 范围........1\n2 要求........3\n1 范围\n正文")], "doc_id string, source_text string")
    rows = sections.without_contents_table(sections.lines(d))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda r: r["line"]), "|").alias("kept"))


@golden("ord INTEGER, section_number VARCHAR, title VARCHAR, content VARCHAR", [(0, "5", "要求", "甲\n乙"), (1, "6", "试验", "丙")])
def wn8_continued(spark):
    """WN8: a section that a page chunk continues."""
    s = spark.createDataFrame([("d1", 0, 0, "5", "要求", "甲"), ("d1", 1, 0, "5", "要求", "乙"), ("d1", 1, 1, "6", "试验", "丙")], "doc_id string, chunk int, ord int, section_number string, title string, content string")
    return sections.continued(s).select("ord", "section_number", "title", "content")


@golden("chunks VARCHAR", [("一二。三。|四五六七八九|十。",)])
def wn13_packed_sentences(spark):
    """WN13: sentences packed up to a length."""
    parts = sections.sentence_parts(F.col("t"), 6)
    return spark.createDataFrame([("一二。 三。四五六七八九十。",)], "t string").select(F.array_join(sections.packed_sentences(parts, 6), "|").alias("chunks"))


@golden("number VARCHAR, first INTEGER, last INTEGER, contents_first INTEGER", [("1", 2, 3, 0), ("2", 4, 4, 1)])
def jn19_contents_blocks(spark):
    """WN10, JN19: top-level blocks with a body, and their blocks in the contents table."""
    rows = [("d1", 0, "1", "范围", "1"), ("d1", 1, "2", "要求", "3"), ("d1", 2, "1", "范围", "正文"), ("d1", 3, "1.1", "细则", "正文"), ("d1", 4, "2", "要求", "正文")]
    s = spark.createDataFrame(rows, "doc_id string, ord int, section_number string, title string, content string")
    return sections.contents_block(sections.top_blocks(s)).join(sections.top_blocks(s).select("doc_id", "first", "last"), ["doc_id", "first"]).select("number", "first", "last", "contents_first")


@golden("context VARCHAR", [("【全文章节目录】\n[5.1] 材料\n[6] 试验\n\n【C3.1 高风险语气候选章节：含必须/须/宜/可/不应/不宜/模糊语气词等】\n[6] 试验\n宜干燥\n\n【C3.1 普通“应”候选章节：优先级较低，仅用于补充核对】\n[5.1] 材料\n应检查",)])
def lm12_modal_context(spark):
    """LM12, PF9: the context of a modal review."""
    return rules.modal_context(_sections(spark, "[5.1] 材料\n应检查\n[6] 试验\n宜干燥")).select("context")


@golden("context VARCHAR", [("【本地引用抽取结果】\n清单引用：GB/T1\n正文引用：ISO2\n疑似漏列（正文有、清单无）：ISO2\n疑似冗余（清单有、正文无）：GB/T1\n\n【规范性引用文件章节】\n[2] 规范性引用文件\nGB/T 1\n\n【正文中含标准引用的章节】\n[4] 要求\n按 ISO 2",)])
def lm12_reference_context(spark):
    """LM12: the context of a reference review."""
    return rules.reference_context(_sections(spark, "[2] 规范性引用文件\nGB/T 1\n[4] 要求\n按 ISO 2")).select("context")


@golden("context VARCHAR", [("【术语编号序列】\n3.1\n\n【术语和定义相关章节】\n[3] 术语和定义\n\n\n[3.1] 试样\n样\n\n【C3.2 技术要素重点章节：标题含要求/试验方法/检验规则/标志包装运输贮存等】\n[5] 要求\n甲\n\n【C3.2 技术要素关键词章节：含限值/指标/单位/试样/设备/步骤/计算/判定等】\n[6] 其他\n按规定",)])
def lm12_technical_context(spark):
    """LM12, PF10, PF12: the context of a term review."""
    return rules.technical_context(_sections(spark, "[3] 术语和定义\n[3.1] 试样\n样\n[5] 要求\n甲\n[6] 其他\n按规定")).select("context")


@golden("dimension VARCHAR, n BIGINT", [("C2.1", 2), ("C2.2", 3), ("C3.1", 1), ("C3.2", 5), ("C3.3", 1)])
def pf11_focus(spark):
    """PF11: how many lines each dimension's review looks at."""
    s = _sections(spark, "[1] 范围\n甲\n[3] 术语\n乙\n[5] 要求\n应按 GB/T 1\n[6] 其他\n丁")
    parts = [rules.focus(s, d).agg(F.count(F.lit(1)).alias("n")).select(F.lit(d).alias("dimension"), "n") for d in ("C2.1", "C2.2", "C3.1", "C3.2", "C3.3")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


@golden("t VARCHAR, short VARCHAR", [(None, "（空）"), ("none", "（空）"), (" 甲\n 乙 ", "甲 乙"), ("一二三四五六七八九十", "一二三四五...")])
def pf17_brief(spark):
    """PF17: short forms for messages."""
    return spark.createDataFrame([(None,), ("none",), (" 甲\n 乙 ",), ("一二三四五六七八九十",)], "t string").select("t", text.brief(F.col("t"), 5).alias("short"))


@golden("t VARCHAR, hidden VARCHAR", [(None, "<empty>"), ("abcd", "****"), ("abcdefghijkl", "abcd...ijkl")])
def fs23_masked(spark):
    """FS23: secrets masked."""
    return spark.createDataFrame([(None,), ("abcd",), ("abcdefghijkl",)], "t string").select("t", text.masked(F.col("t")).alias("hidden"))


@golden("query VARCHAR", [("审查维度：C3.1\n待审查文档片段：甲 乙",)])
def fs22_query_text(spark):
    """FS22: the text that rules are looked up by."""
    return spark.createDataFrame([(" 甲 \n乙 ",)], "t string").select(retrieval.query_text(F.col("t"), "C3.1").alias("query"))


@golden("dims VARCHAR, num INTEGER, counts VARCHAR", [("C2.2", 3, "C2.2=3"), ("C2.1,C2.2", 2, "C2.1=1,C2.2=1"), ("C2.1,C2.2", 9, "C2.1=6,C2.2=3")])
def ce28_allocation(spark):
    """CE28: errors dealt to dimensions, least used type first."""
    rows = [(",".join(d), n, ",".join(f"{k}={v}" for k, v in allocation.allocate(d, n).items())) for d, n in ((["C2.2"], 3), (["C2.1", "C2.2"], 2), (["C2.1", "C2.2"], 9))]
    return spark.createDataFrame(rows, "dims string, num int, counts string")


INJECTED = "前言\n编制情况说明。\n引言\n背景情况介绍。\n[1] 范围\n本文件适用于甲。\n[2] 规范性引用文件\n下列文件必不可少。\nGB/T 1.1—2020 标准化\nISO 9001 质量\nIEC 60068 环境\n[3] 术语和定义\n3.1 甲术语\n3.2 乙术语\n3.3 丙术语\n[5] 要求\n产品应安全，不应泄漏，宜检查，按 ISO 9001。\n[5.1.2] 细则\n可选用。\n[附录A] 附录A 试验方法（规范性）\n步骤。\n参考文献\n[1] GB/T 5—2001"


#: By error type, section rows (number, title, content), and those that change; marks stand for what is drawn.
CASES = [
    ("E-S-03", [("1", "本文件的范围", "甲"), ("2", "其他", "乙"), ("1", "本文件的范围", "丙")], {0: ("1", "<form>", "甲"), 2: ("1", "<form>", "丙")}),
    ("E-S-03", [("B", "附录 B（资料性）方法", "甲"), ("附录C", "方法（规范性）", "乙")], {0: ("B", "<form>", "甲")}),
    ("E-S-04", [(None, "前 言", "甲"), (None, "引言", "乙")], {0: (None, "前 言", "乙"), 1: (None, "引言", "甲")}),
    ("E-S-05", [("附录A", "附录A（规范性）规范性方法", "甲"), ("附录B", "方法（资料性）", "乙"), ("附录C", "附录C 规范性或资料性", "丙"), (None, "附录A（规范性）规范性方法", "丁")], {0: ("附录A", "附录A（资料性）规范性方法", "甲"), 3: (None, "附录A（资料性）规范性方法", "丁")}),
    ("E-S-06", [("5", "甲", "一"), ("5.1.2", "乙", "二")], {1: ("5.1.2.1.1.1", "乙", "二")}),
    ("E-T-01", [("5", "甲", "应先，应后")], {0: ("5", "甲", "宜先，应后")}),
    ("E-T-02", [("5", "甲", "宜先，宜后")], {0: ("5", "甲", "应先，宜后")}),
    ("E-T-03", [("5", "甲", "应先")], {0: ("5", "甲", "可先")}),
    ("E-T-04", [("5", "甲", "应先")], {0: ("5", "甲", "须先")}),
    ("E-T-05", [("5", "甲", "可先")], {0: ("5", "甲", "一般先")}),
    ("E-T-06", [("5", "甲", "应先，不应后")], {0: ("5", "甲", "应先，不宜后")}),
    ("E-T-07", [("5", "甲", "应先"), ("6", "乙", "为安全应先")], {1: ("6", "乙", "为安全宜先")}),
    ("E-TM-05", [("3", "术语和定义", "……\n"), ("3", "术语和定义", "导语\n3.1 甲\n\n3.2 乙\n定义\n3.3 丙"), ("3", "术语", "3.1 a\n3.2 b\n3.3 c")], {1: ("3", "术语和定义", "导语\n3.1 甲\n\n定义\n3.3 丙")}),
    ("E-R-01", [("2", "规范性引用文件", "……"), ("2", "规范性引用", "下列文件。\nGB/T 1—2020 甲\nISO 2 乙"), ("5", "要求", "按 ISO 2 试验")], {1: ("2", "规范性引用", "下列文件。\nGB/T 1—2020 甲")}),
    ("E-R-02", [("2", "规范性引用文件", "GB/T 1 甲")], {0: ("2", "规范性引用文件", "GB/T 1 甲<fakes>")}),
    ("E-R-03", [("2", "规范性引用文件", "GB/T 1 甲"), (None, "参考文献", "说明文字\n[1] GB/T 5—2001 丙\n")], {0: ("2", "规范性引用文件", "GB/T 1 甲\nGB/T 5—2001 丙"), 1: (None, "参考文献", "说明文字")}),
    ("E-R-03", [("2", "规范性引用文件", "GB/T 1 甲"), (None, "参考文献", "只有说明")], {0: ("2", "规范性引用文件", "GB/T 1 甲<fakes>")}),
    ("E-R-04", [("2", "规范性引用文件", "下列文件。\nGB/T 1 甲\nISO 2 乙\nIEC 3 丙")], {0: ("2", "规范性引用文件", "<shuffled>")}),
    ("E-S-05", [("附录A", "方法（规范性）", "甲")], {}),
    ("E-TM-05", [("3", "术语和定义", "3.1 甲\n3.2 乙")], {}),
]


def _marked(made: DataFrame) -> DataFrame:
    """What is drawn, as marks."""
    forms = [w.replace("X", "B") for words in (*taxonomy.INJECTED_TITLES.values(), *taxonomy.INJECTED_APPENDIX_TITLES.values()) for w in words]
    fakes = "|".join(x.replace("(", "\\(") for x in taxonomy.FAKE_STANDARDS)
    lines = F.array_sort(F.split("content", "\n"))
    shuffled = (lines == F.array_sort(F.array(*map(F.lit, ("下列文件。", "GB/T 1 甲", "ISO 2 乙", "IEC 3 丙")))))
    return made.withColumns({"title": F.when(F.col("title").isin(forms) & ~F.col("title").isin("前言", "引言"), "<form>").otherwise(F.col("title")), "content": F.when(shuffled, "<shuffled>").otherwise(F.regexp_replace("content", f"(\n({fakes}))+$", "<fakes>"))})


@golden("case_no INTEGER, error_type VARCHAR, ord INTEGER, section_number VARCHAR, title VARCHAR, content VARCHAR", [(i, code, o, *row) for i, (code, _, changed) in enumerate(CASES) for o, row in changed.items()])
def ce_injections(spark):
    """CE3 to CE25, CE26: the sections that each injector changes, whole, where only one choice fits or what is drawn is marked."""
    parts = []
    for i, (code, rows, _) in enumerate(CASES):
        s = spark.createDataFrame([("d", o, *r) for o, r in enumerate(rows)], "doc_id string, ord int, section_number string, title string, content string")
        columns = ["ord", "section_number", "title", "content"]
        parts.append(injectors.INJECTORS[code](s, 7).sections.select(*columns).exceptAll(s.select(*columns)).select(F.lit(i).alias("case_no"), F.lit(code).alias("error_type"), *columns))
    return _marked(reduce(DataFrame.unionByName, parts))


#: Of a case, the drawn section alone is annotated, but for the exchange of two.
NOTED = {0: [], 1: [0], 2: [0, 1], 4: [1], 12: [1], 13: [1], 14: [0], 15: [0], 16: [0], 17: [0]}


@golden("case_no INTEGER, dimension VARCHAR, error_type VARCHAR, original_title VARCHAR, original_content VARCHAR, title VARCHAR, content VARCHAR", [(i, injectors.DIMENSION_OF[CASES[i][0]], CASES[i][0], CASES[i][1][o][1], CASES[i][1][o][2], *CASES[i][2][o][1:]) for i, ords in NOTED.items() for o in ords])
def ce_annotations(spark):
    """CE3 to CE26: what injectors note of the section that they drew, before and after."""
    parts = []
    for i in [i for i, ords in NOTED.items() if ords]:
        code, rows, _ = CASES[i]
        s = spark.createDataFrame([("d", o, *r) for o, r in enumerate(rows)], "doc_id string, ord int, section_number string, title string, content string")
        a = injectors.INJECTORS[code](s, 7).annotations
        parts.append(a.select(F.lit(i).alias("case_no"), "dimension", "error_type", F.col("original.title").alias("original_title"), F.col("original.content").alias("original_content"), "corrupted.title", "corrupted.content"))
    return _marked(reduce(DataFrame.unionByName, parts))


@golden("name VARCHAR, ord INTEGER, section_number VARCHAR, title VARCHAR, content VARCHAR", [("year", 0, "2", "规范性引用文件", "GB/T 1—<year> 甲"), ("form", 0, "2", "规范性引用文件", "GB/T 1-2020 甲"), ("more", 1, None, "编制说明", "本文件的编制过程说明。")])
def cex_unused_injectors(spark):
    """CEx1 to CEx3: a wrong year, a wrong date form, a section too many."""
    s = spark.createDataFrame([("d", 0, "2", "规范性引用文件", "GB/T 1—2020 甲")], "doc_id string, ord int, section_number string, title string, content string")
    columns = ["ord", "section_number", "title", "content"]
    made = {"year": injectors.wrong_year(s, 1), "form": injectors.wrong_date_form(s, 1), "more": injectors.redundant_section(s, 1)}
    rows = [m.sections.select(*columns).withColumn("ord", F.col("ord").cast("int")).exceptAll(s.select(*columns)).select(F.lit(n).alias("name"), *columns) for n, m in made.items()]
    year = F.when(F.col("name") == "year", F.regexp_replace("content", "20(2[1-9]|3[0-5])", "<year>")).otherwise(F.col("content"))
    return reduce(DataFrame.unionByName, rows).withColumn("content", year)


WORDED_ROWS = [("1", "范围", "本文件规定了甲的要求，适用于甲。"), ("3", "术语和定义", "3.1 甲\n装置\n3.2 乙\n部件"), ("5", "要求", "甲的外壳应符合设计图样的规定，并能承受运输过程中的各种振动与冲击。")]


def _answer(prompt: str) -> str:
    """A stub model: answers by what it is asked."""
    if "最有代表性" in prompt:
        return " 甲 "
    if "失败" in prompt:
        raise TimeoutError
    if "只返回这一句" in prompt:
        return "```text\n范围声明：高原用乙\n```"
    if "新术语条目" in prompt:
        return prompt[prompt.index("编号为 ") + 4 : prompt.index(" 的新术语")] + " 丙"
    if "含“应”或“宜”" in prompt:
        return "本文件规定了甲的要求，适用于甲，使用者应培训。"
    return "改写后的正文"


@golden("error_type VARCHAR, dimension VARCHAR, title VARCHAR, content VARCHAR", [("E-SC-01", "C2.2", "要求", "改写后的正文"), ("E-SC-02", "C2.2", "范围", "本文件规定了甲的要求，适用于甲。\n本文件也适用于高原用乙。"), ("E-SC-03", "C2.2", "范围", "本文件规定了甲的要求，适用于甲，使用者应培训。"), ("E-TM-01", "C3.2", "要求", "改写后的正文"), ("E-TM-02", "C3.2", "术语和定义", "3.1 甲\n装置\n3.2 乙\n部件\n3.3 丙"), ("E-TM-03", "C3.2", "要求", "改写后的正文"), ("E-TM-04", "C3.2", "要求", "改写后的正文")])
def ce_worded(spark):
    """CE7 to CE9, CE17 to CE20: errors that a model words, with a stub in its place; a failed call changes nothing."""
    rows = [("d", o, *r) for o, r in enumerate(WORDED_ROWS)] + [("e", o, n, t, c.replace("甲的", "甲的失败")) for o, (n, t, c) in enumerate(WORDED_ROWS)]
    s = spark.createDataFrame(rows, "doc_id string, ord int, section_number string, title string, content string")
    parts = [worded.inject_worded(s, code, 3, _answer).annotations.where("doc_id = 'd' or error_type <> 'E-TM-02'").select("error_type", "dimension", "corrupted.title", "corrupted.content") for code in worded.WORDED]
    return reduce(DataFrame.unionByName, parts)


@golden("doc_id VARCHAR, ord INTEGER, section_number VARCHAR, title VARCHAR, content VARCHAR", [("d1", 1, "2", "换", "新")])
def io22_merged_sections(spark):
    """IO22: corrupted sections in place of the originals; null deletes."""
    s = spark.createDataFrame([("d1", 0, "1", "甲", "x"), ("d1", 1, "2", "乙", "y")], "doc_id string, ord int, section_number string, title string, content string")
    c = spark.createDataFrame([("d1", 0, None), ("d1", 1, ("2", "换", "新"))], "doc_id string, ord int, corrupted struct<section_number:string,title:string,content:string>")
    return injectors.merged_sections(s, c)


@golden("gt_index INTEGER, section_number VARCHAR, title VARCHAR", [(0, "1", "范围"), (1, None, "新")])
def pf7_ground_truth(spark):
    """PF7: items of examples; a deletion keeps its original's place, another takes the corrupted one's whole."""
    kind = "array<struct<dimension:string,error_type:string,original:struct<section_number:string,title:string,content:string>,corrupted:struct<section_number:string,title:string,content:string>,error_description:string>>"
    rows = [("d1", [("C2.1", "E-S-01", ("1", "范围", "甲"), None, "x"), ("C2.1", "E-S-03", ("2", "旧", "乙"), (None, "新", "乙"), "y")])]
    return benchmark.ground_truth(spark.createDataFrame(rows, f"doc_id string, examples {kind}")).select("gt_index", "section_number", "title")


@golden("doc_id VARCHAR", [("d1",)])
def pf8_scored_documents(spark):
    """PF8: documents with text and an answer."""
    docs = _documents(spark, "甲", "  ", "乙")
    return benchmark.scored_documents(docs, spark.createDataFrame([("d1", True), ("d2", True), ("d3", False)], "doc_id string, reviewed boolean")).select("doc_id")


@golden("t VARCHAR, garbled BOOLEAN", [("本标准规定", False), ("\u25a1\u25a1 abc", True), (None, True)])
def pf14_garbled(spark):
    """PF14: text layers without any expected word."""
    return spark.createDataFrame([("本标准规定",), ("\u25a1\u25a1 abc",), (None,)], "t string").select("t", files.is_garbled(F.col("t")).alias("garbled"))


BODIES = [(0, None, False, False, False), (1, "none", False, False, False), (2, "……", False, False, False), (3, "12", True, False, False), (4, "…… 12", True, True, False), (5, "[续]", False, False, False), (6, "正文", True, True, True), (7, "IV", True, False, False)]


@golden("i INTEGER, has_text BOOLEAN, body BOOLEAN, scope_body BOOLEAN", [(i, a, b, c) for i, _, a, b, c in BODIES])
def pf15_bodies(spark):
    """PF15: three degrees of what counts as a body."""
    c = F.col("c")
    return spark.createDataFrame([(i, t) for i, t, *_ in BODIES], "i int, c string").select("i", sections.has_text(c).alias("has_text"), sections.is_body(c).alias("body"), sections.is_scope_body(c).alias("scope_body"))


@golden("what VARCHAR, ord INTEGER", [("scope", 1), ("term", 2), ("body", 3), ("technical", 3)])
def pf20_section_lookups(spark):
    """PF16, PF20, PF21: first scope and term sections, body and technical ones."""
    rows = [("d1", 0, "1", "范围", "…… 1"), ("d1", 1, "1", "范 围", "本文件适用于甲"), ("d1", 2, "3", "术语和定义", "甲术语" * 12), ("d1", 3, "5", "要求", "应符合" * 12), ("d1", 4, None, "前言", "短")]
    s = spark.createDataFrame(rows, "doc_id string, ord int, section_number string, title string, content string")
    found = {"scope": sections.scope_section(s), "term": sections.term_section(s), "body": sections.body_sections(s), "technical": sections.technical_sections(s).where("ord = 3")}
    parts = [df.select(F.lit(name).alias("what"), "ord") for name, df in found.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@golden("t VARCHAR, clean VARCHAR", [("GB/T 1.1—2020\n 5.\n1 要求 \n12\n\n正文", "5.1 要求\n正文")])
def fs12_preprocessed(spark):
    """FS12: numbers repaired, lines trimmed, furniture dropped."""
    return spark.createDataFrame([("GB/T 1.1—2020\n 5.\n1 要求 \n12\n\n正文",)], "t string").select("t", sections.preprocessed(F.col("t")).alias("clean"))


@golden("t VARCHAR, replaced VARCHAR, place INTEGER", [("不应用，应检查", "不宜用，应检查", 1), ("无", "无", 0)])
def fs14_replace_first(spark):
    """FS14, WN15: the first occurrence replaced, and where the texts then differ."""
    new = text.replace_first(F.col("t"), F.lit("应"), F.lit("宜"))
    return spark.createDataFrame([("不应用，应检查",), ("无",)], "t string").select("t", new.alias("replaced"), sections.first_difference(F.col("t"), new).alias("place"))


@golden("parts VARCHAR", [("下列文件必不可少。以下|GB/T 1—2020 甲|ISO 2 乙",), ("|IEC 3",)])
def fs15_reference_lines(spark):
    """FS15: introduction and standards of a list of references."""
    d = spark.createDataFrame([("下列文件必不可少。\nGB/T 1—2020 甲\n以下\nISO 2 乙",), ("IEC 3",)], "c string")
    return d.select(F.array_join(injectors.reference_lines(F.col("c")), "|").alias("parts"))


@golden("number VARCHAR, title VARCHAR, line VARCHAR", [("5.1", "要求", "[5.1] 要求\n甲 乙"), (None, "前言", "前言\n")])
def fs10_section_line(spark):
    """FS1, FS10: a section as two lines."""
    d = spark.createDataFrame([("5.1", "要求", " 甲 \n 乙"), (None, "前言", None)], "number string, title string, content string")
    return d.select("number", "title", text.section_line(F.col("number"), F.col("title"), F.col("content")).alias("line"))


@golden("ord INTEGER, section_number VARCHAR, title VARCHAR", [(0, "4", "乙"), (1, "5", "甲"), (2, "5.1", "甲一")])
def ce2_swapped_blocks(spark):
    """CE2: two blocks change places and numbers."""
    return injectors.swapped_blocks(_sections(spark, "[4] 甲\n正文甲\n[4.1] 甲一\n正文\n[5] 乙\n正文乙"), 1).sections.select("ord", "section_number", "title")


@golden("titles VARCHAR, gone VARCHAR", [("总则", "文件一,文件一,规范性引用文件,规范性引用文件")])
def ce1_missing_section(spark):
    """CE1, JN17: a mandatory section goes with what is numbered below it; this one stands for two categories."""
    made = injectors.missing_mandatory(_sections(spark, "[2] 规范性引用文件\n甲\n[2.1] 文件一\n乙\n[9] 总则\n丙"), 1)
    join = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    return made.sections.agg(join("title").alias("titles")).crossJoin(made.annotations.agg(join("original.title").alias("gone")))


@golden("listed VARCHAR, books VARCHAR", [("GB/T 1\nGB/T 5—2001", "")])
def ce24_informative_reference(spark):
    """CE24: a line of the bibliography moves to the list."""
    s = spark.createDataFrame([("d1", 0, "2", "规范性引用文件", "GB/T 1"), ("d1", 1, None, "参考文献", "[1] GB/T 5—2001")], "doc_id string, ord int, section_number string, title string, content string")
    out = injectors.informative_reference(s, 1).sections
    return out.agg(F.max(F.when(F.col("ord") == 0, F.col("content"))).alias("listed"), F.max(F.when(F.col("ord") == 1, F.col("content"))).alias("books"))


@golden("n BIGINT, low INTEGER, high INTEGER", [(1000, 5, 8)])
def ce29_target_counts(spark):
    """CE29: 0 to 3 more than the base."""
    n = spark.range(1000).select(allocation.target_count(F.col("id"), 5, 7).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("n"), F.min("n").alias("low"), F.max("n").alias("high"))


@golden("doc_id VARCHAR, round INTEGER, n BIGINT, ours BOOLEAN", [*[(f"d{i}", r, 1, True) for i in range(1, 7) for r in (0, 1)], ("d7", 0, 1, True), ("d7", 1, 1, True)])
def ce27_balanced_rounds(spark):
    """CE27: two errors for each document; types that do not fit are replaced, as for d7, which only one of them fits."""
    s = _sections(spark, *[INJECTED] * 6, "[5] 甲\n应先，应后，应再")
    made = injectors.inject_balanced(s, 2, 5, ["E-T-01", "E-S-05", "E-R-04"])
    return made.annotations.groupBy("doc_id", "round").agg(F.countDistinct("error_type").alias("n"), F.bool_and(F.col("error_type").isin("E-T-01", "E-S-05", "E-R-04")).alias("ours"))


@golden("few BOOLEAN, n BIGINT", [(True, 40)])
def ce27_least_used_first(spark):
    """CE27: a type that was used often before is drawn seldom."""
    s = _sections(spark, *["[5] 甲\n应先，宜后"] * 40)
    made = injectors.inject_balanced(s, 1, 5, ["E-T-01", "E-T-02"], {"E-T-01": 1000}).annotations
    return made.agg((F.count_if(F.col("error_type") == "E-T-01") <= 2).alias("few"), F.count(F.lit(1)).alias("n"))


@golden("total_files BIGINT, total_examples BIGINT, kinds VARCHAR", [(2, 3, "E-S-01=2,UNKNOWN=1")])
def io5_construction_totals(spark):
    """IO5, IO6, AG14: totals of a construction."""
    records = spark.createDataFrame([("d1", [("E-S-01",), ("",)]), ("d2", [("E-S-01",)])], "doc_id string, examples array<struct<error_type:string>>")
    t = benchmark.construction_totals(records)
    return t.select("total_files", "total_examples", F.array_join(F.transform(F.map_entries("error_type_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("kinds"))


@golden("doc_id VARCHAR, section_count INTEGER", [("d1", 2), ("d2", 0)])
def io7_source_records(spark):
    """IO7: texts with their number of sections."""
    docs = _documents(spark, "[1] 甲\n[2] 乙", "无")
    return benchmark.source_records(sections.parse_sections(docs), docs).select("doc_id", "section_count")


@golden("annotation VARCHAR", [("# 反例标注清单\n\n## [1] 维度: C2.1  错误类型: E-S-01\n位置: [1] 范围\n说明: 缺\n",)])
def io21_annotation_text(spark):
    """IO21: annotations as text."""
    a = spark.createDataFrame([("d", 0, "C2.1", "E-S-01", ("1", "范围", "甲"), "缺")], "doc_id string, ord int, dimension string, error_type string, original struct<section_number:string,title:string,content:string>, error_description string")
    return benchmark.annotation_text(a).select("annotation")


@golden("section_number VARCHAR, title VARCHAR, content VARCHAR", [("1", "范围", "甲"), ("1.1", "细则", "乙"), (None, "附录A 方法", "丙")])
def io10_page_sections(spark):
    """IO10, WN12, PF13: sections of page texts."""
    pages = spark.createDataFrame([("d", 0, "封面"), ("d", 1, "目次\n1 范围.....1\n1 范围\n甲\n1.1 细则\n乙\n附录A 方法\n丙")], "doc_id string, page int, text string")
    return files.sections_of_pages(pages).select("section_number", "title", "content")


@golden("section_number VARCHAR, title VARCHAR, content VARCHAR", [("1", "范围", "甲"), ("附录A", "方法", "乙")])
def io14_markdown_sections(spark):
    """IO14: sections of Markdown."""
    return files.sections_of_markdown(spark.createDataFrame([("d", "前文\n# 1 范围\n甲\n## 附录A 方法\n乙")], "doc_id string, markdown string")).select("section_number", "title", "content")


@golden("backend VARCHAR, model_id VARCHAR", [("a", "x"), ("b", "y")])
def io24_capable_models(spark):
    """IO24: models with a capability."""
    m = spark.createDataFrame([("b", "y", {"chat": True}), ("a", "x", {"chat": True}), ("a", "z", {"chat": False})], "backend string, model_id string, capabilities map<string,boolean>")
    return config.capable_models(m, "chat").select("backend", "model_id")


@golden("tool VARCHAR, n INTEGER", [("check_mandatory_sections", 1), ("check_section_order", 1), ("check_section_names", 2), ("check_appendix_types", 2), ("check_section_depth", 1)])
def ud1_rule_tools(spark):
    """UD1, UD2: results of all rule tools by name."""
    found = review.tool_findings(_documents(spark, ODD_OUTLINE))
    return found.select("tool", F.json_array_length("result").alias("n"))


@golden("source_agent VARCHAR, error_type VARCHAR, n BIGINT", [("direct", "E-T-01", 2), ("direct", "E-T-02", 2), ("direct", "E-T-03", 2), ("direct", "E-T-07", 2), ("reference_rules", "E-R-01", 2), ("reference_rules", "E-R-02", 1)])
def lm9_high_recall(spark):
    """LM9, ST1, PF19: streams and rule reviewers combined, spread and deduplicated."""
    docs = _documents(spark, "[2] 规范性引用文件\nGB/T 1\n[5] 要求\n按 ISO 2\n[5.1] 细则\n宜检查")
    direct = spark.createDataFrame([("d1", 0, "C3.1", "E-T-01", "5.1", "r", "e"), ("d1", 1, "C3.1", "E-X", "5.1", "r", "e")], "doc_id string, pred_index int, dimension string, error_type string, section_number string, reason string, error_description string")
    return review.high_recall(docs, {"direct": direct}).groupBy("source_agent", "error_type").agg(F.count(F.lit(1)).alias("n"))


@golden("context VARCHAR", [("[知识1 / 标题 / E-T-01 / 源]\n甲\n\n[知识2 / 审查规则 / local]\n乙",)])
def fs22_rule_context(spark):
    """FS22: rules as numbered text."""
    d = spark.createDataFrame([(1, 1, "标题", "E-T-01", "源", " 甲 "), (1, 2, None, None, None, "乙")], "query_id int, rank int, title string, error_type string, source string, text string")
    return retrieval.context(d).select("context")
