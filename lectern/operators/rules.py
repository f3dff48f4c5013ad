"""Rule checks over section rows: references, terms, modal wording, structure; and contexts for model review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import WS, compact, depth, has_any, label, modal_words, reference_base, reference_ids, section_key, section_line, sentences, term_text, is_term_section
from lectern.operators.patterns import own_hits
from lectern.operators.sections import batch_number
from lectern.taxonomy import MANDATORY, MAX_DEPTH, MODALS, RISKY_MODALS, STANDARD_ORDER, TECHNICAL_TITLES, TECHNICAL_WORDS, TERM_WORDS, WRONG_TITLES



def _whole(title: str = "title", content: str = "content") -> Column:
    return F.concat(F.coalesce(F.col(title), F.lit("")), F.lit("\n"), F.coalesce(F.col(content), F.lit("")))


# References


def references(sections: DataFrame) -> DataFrame:
    """doc_id, ord, section_number, ref and whether it stands in the list of references; bibliographies do not count."""
    title = F.coalesce("title", F.lit(""))
    listed = title.contains("规范性引用文件")
    rows = sections.where(listed | ~title.contains("参考文献")).select("doc_id", "ord", "section_number", listed.alias("listed"), reference_ids(_whole()).alias("refs"))
    return rows.where(F.size("refs") > 0).select("doc_id", "ord", "section_number", "listed", F.explode("refs").alias("ref"))


def reference_findings(sections: DataFrame, most: int = 80) -> DataFrame:
    """Missing, redundant and mismatched references: at most `most` of a document, in that order, each by reference.

    One aggregation by (document, reference) serves both anti joins.
    """
    refs = references(sections)
    at = lambda on: F.min(F.when(F.col("listed") == on, F.struct("ord", "section_number")))["section_number"]
    by_ref = refs.groupBy("doc_id", "ref").agg(F.bool_or("listed").alias("in_list"), F.bool_or(~F.col("listed")).alias("in_body"), at(False).alias("body_section"))
    lists = sections.where(F.coalesce("title", F.lit("")).contains("规范性引用文件")).groupBy("doc_id").agg(F.min(F.struct("ord", "section_number")).alias("s")).select("doc_id", F.col("s.section_number").alias("list_section"), F.lit(True).alias("has_list"))
    missing = by_ref.where("in_body and not in_list").select("doc_id", F.lit(1).alias("rule"), F.col("ref").alias("name"), F.lit("E-R-01").alias("error_type"), F.col("body_section").alias("section_number"), F.lit(0.6).alias("confidence"))
    extra = by_ref.where("in_list and not in_body").join(lists, "doc_id", "left").select("doc_id", F.lit(2).alias("rule"), F.col("ref").alias("name"), F.lit("E-R-02").alias("error_type"), F.when(F.col("has_list"), F.col("list_section")).otherwise("2").alias("section_number"), F.lit(0.58).alias("confidence"))
    base = by_ref.groupBy("doc_id", reference_base(F.col("ref")).alias("name")).agg(
        F.bool_or("in_list").alias("l"), F.bool_or("in_body").alias("b"), F.bool_or(F.col("in_list") & F.col("in_body")).alias("shared"),
        F.min(F.when(F.col("in_body"), F.struct("ref", "body_section")))["body_section"].alias("section_number"),
    )
    other = base.where("l and b and not shared").select("doc_id", F.lit(3).alias("rule"), "name", F.lit("E-R-03").alias("error_type"), "section_number", F.lit(0.52).alias("confidence"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("rule", "name"))
    return missing.unionByName(extra).unionByName(other).withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", "rank", "error_type", F.lit("C3.3").alias("dimension"), "section_number", "name", "confidence")


# Terms


def term_entries(sections: DataFrame, most: int = 120) -> DataFrame:
    """Terms with the number and definition where each is defined first: titles of 3.x sections, then 3.x lines in contents."""
    number, title = F.coalesce("section_number", F.lit("")), F.coalesce("title", F.lit(""))
    own = sections.where(is_term_section(F.col("section_number"), F.col("title")))
    by_title = own.where(number.startswith("3.")).select("doc_id", "ord", F.lit(-1).alias("pos"), term_text(title).alias("term"), "section_number", compact(F.col("content"), 260).alias("definition")).where(~F.col("term").isin("", "术语和定义", "术语", "定义"))
    entry = f"^{WS}*(3(?:\\.\\d+)+){WS}+(.{{2,100}})$"
    parts = own.select("doc_id", "ord", "content", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("pos", "line")).where(F.col("line").rlike(entry))
    rest = F.array_join(F.slice(F.split("content", "\n"), F.col("pos") + 2, F.lit(1 << 20)), "\n")
    by_line = parts.select("doc_id", "ord", "pos", term_text(F.regexp_extract("line", entry, 2)).alias("term"), F.regexp_extract("line", entry, 1).alias("section_number"), compact(F.substring(F.concat(F.lit("\n"), rest), 1, 260)).alias("definition")).where("term <> ''")
    first = by_title.unionByName(by_line).groupBy("doc_id", "term").agg(F.min(F.struct("ord", "pos", "section_number", "definition")).alias("e"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("e.ord", "e.pos"))
    return first.withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", "rank", "term", "e.section_number", "e.definition")


def term_usage(terms: DataFrame, sections: DataFrame, most: int = 12) -> DataFrame:
    """For each term of two code points or more, the sections outside the term section that hold it.

    A document's terms (120 at most) go to its sections as one list; each section's text passes once through the
    automaton of the list, however many terms there are.
    """
    t = terms.where(F.length("term") >= 2).select(F.struct("doc_id").alias("doc"), "doc_id", "rank", "term", "section_number")
    listed = t.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("own"))
    body = sections.where(~is_term_section(F.col("section_number"), F.col("title"))).select(F.struct("doc_id").alias("doc"), F.col("ord").alias("b_ord"), F.col("section_number").alias("b_number"), _whole().alias("text"))
    rows = body.join(listed, "doc").select("doc", "b_ord", "b_number", "text", F.transform("own", lambda x: x["rank"]).alias("ranks"), F.transform("own", lambda x: x["term"]).alias("words"))
    hits = own_hits(rows, "text", "words").select("doc", F.get("ranks", F.col("i")).alias("rank"), "b_ord", "b_number")
    found = F.array_sort(F.collect_list(F.struct("b_ord", "b_number")))
    used = hits.groupBy("doc", "rank").agg(F.count(F.lit(1)).alias("used_count"), F.slice(F.transform(found, lambda s: F.coalesce(s["b_number"], F.lit(""))), 1, most).alias("used_sections"))
    none = F.array().cast("array<string>")
    return t.join(used, ["doc", "rank"], "left").select("doc_id", "rank", "term", "section_number", F.coalesce("used_count", F.lit(0)).alias("used_count"), F.coalesce("used_sections", none).alias("used_sections"))


def unused_terms(usage: DataFrame, most: int = 30) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("rank"))
    return usage.where("used_count = 0").withColumn("n", rank).where(F.col("n") <= most).select("doc_id", F.lit("E-TM-02").alias("error_type"), F.lit("C3.2").alias("dimension"), "section_number", "term", F.lit(0.55).alias("confidence"))


def number_gaps(terms: DataFrame) -> DataFrame:
    """Missing numbers between the least and greatest 3.N of a document's terms."""
    number = F.regexp_extract("section_number", r"^3\.(\d+)$", 1)
    have = terms.where(number != "").groupBy("doc_id").agg(F.collect_set(number.cast("int")).alias("have"))
    gaps = have.select("doc_id", F.array_except(F.sequence(F.array_min("have"), F.array_max("have")), "have").alias("gaps")).where("size(gaps) > 0")
    shown = F.array_join(F.transform(F.slice(F.array_sort("gaps"), 1, 8), lambda n: F.concat(F.lit("3."), n.cast("string"))), ", ")
    return gaps.select("doc_id", F.lit("E-TM-05").alias("error_type"), F.lit("C3.2").alias("dimension"), F.lit("3").alias("section_number"), shown.alias("missing"), F.lit(0.75).alias("confidence"))


def next_number(entries: DataFrame) -> DataFrame:
    """By document the number after its last term entry; 3.99 where that is no number."""
    last = entries.groupBy("doc_id").agg(F.max_by("section_number", "rank").alias("n"))
    tail = F.regexp_extract("n", r"^(.*\.)(\d+)$", 2)
    return last.select("doc_id", F.when(tail != "", F.concat(F.regexp_extract("n", r"^(.*\.)(\d+)$", 1), (tail.try_cast("int") + 1).cast("string"))).otherwise("3.99").alias("next_number"))


# Modal wording


def modal_sentences(sections: DataFrame, most: int = 220, limit: int = 360) -> DataFrame:
    """Distinct sentences with modal words, in order, at most `most` of a document."""
    rows = sections.where(has_any(F.coalesce("content", F.lit("")), MODALS)).select("doc_id", "ord", "section_number", "title", section_key(F.col("section_number")).alias("section"), F.posexplode(sentences(F.col("content"))).alias("pos", "sentence")).where(has_any(F.col("sentence"), MODALS))
    once = F.row_number().over(Window.partitionBy("doc_id", "section", "sentence").orderBy("ord", "pos"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "pos"))
    kept = rows.withColumn("once", once).where("once = 1").withColumn("rank", rank).where(F.col("rank") <= most)
    kept = kept.withColumn("modal_words", modal_words(F.col("sentence")))  # of the whole sentence: in one select, the lambda would see the cut one
    return kept.select("doc_id", "rank", "section_number", "title", F.substring("sentence", 1, limit).alias("sentence"), "modal_words", batch_number(F.col("rank"), 70).alias("batch"))


def modal_class(content: Column) -> Column:
    """high-risk, ordinary, or null."""
    text = F.coalesce(content, F.lit(""))
    return F.when(has_any(text, RISKY_MODALS), "high").when(text.contains("应"), "ordinary")


def technical_class(number: Column, title: Column, content: Column) -> Column:
    """term, title or keyword section, in that order; null for others."""
    t, whole = F.coalesce(title, F.lit("")), F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit("")))
    return F.when(is_term_section(number, title), "term").when(has_any(t, TECHNICAL_TITLES), "title").when(has_any(whole, TECHNICAL_WORDS + TERM_WORDS), "keyword")


# Contexts of a review


def _joined(condition: Column, text: Column, between: str, none: str) -> Column:
    rows = F.array_sort(F.collect_list(F.when(condition, F.struct("ord", text.alias("t")))))
    return F.when(F.size(rows) > 0, F.array_join(F.transform(rows, lambda r: r["t"]), between)).otherwise(none)


def _line(limit: int) -> Column:
    return section_line(F.col("section_number"), F.col("title"), F.col("content"), limit)


def modal_context(sections: DataFrame, limit: int = 18_000) -> DataFrame:
    kind = modal_class(F.col("content"))
    parts = [
        F.lit("【全文章节目录】\n"), _joined(F.col("ord") < 240, label(F.col("section_number"), F.col("title")), "\n", ""),
        F.lit("\n\n【C3.1 高风险语气候选章节：含必须/须/宜/可/不应/不宜/模糊语气词等】\n"), _joined(kind == "high", _line(900), "\n\n", "（未检出高风险语气候选章节）"),
        F.lit("\n\n【C3.1 普通“应”候选章节：优先级较低，仅用于补充核对】\n"), _joined(kind == "ordinary", _line(900), "\n\n", "（未检出仅含普通“应”的候选章节）"),
    ]
    return sections.groupBy("doc_id").agg(F.substring(F.concat(*parts), 1, limit).alias("context"))


def technical_context(sections: DataFrame, limit: int = 18_000) -> DataFrame:
    number = F.coalesce("section_number", F.lit(""))
    kind = technical_class(F.col("section_number"), F.col("title"), F.col("content"))
    row = sections.withColumn("kind", kind)
    row = row.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("ord")))
    term = F.col("kind") == "term"
    parts = [
        F.lit("【术语编号序列】\n"), _joined(term & ~number.isin("", "3"), number, ", ", "（未检出术语编号）"),
        F.lit("\n\n【术语和定义相关章节】\n"), _joined(term, F.when(number.isin("3", ""), _line(2500)).otherwise(_line(800)), "\n\n", "（未找到术语和定义章节）"),
        F.lit("\n\n【C3.2 技术要素重点章节：标题含要求/试验方法/检验规则/标志包装运输贮存等】\n"), _joined(F.col("kind") == "title", _line(1200), "\n\n", "（未检出技术要素标题章节）"),
        F.lit("\n\n【C3.2 技术要素关键词章节：含限值/指标/单位/试样/设备/步骤/计算/判定等】\n"), _joined((F.col("kind") == "keyword") & (F.col("nth") <= 30), _line(700), "\n\n", "（未检出技术要素关键词章节）"),
    ]
    return row.groupBy("doc_id").agg(F.substring(F.concat(*parts), 1, limit).alias("context"))


def reference_context(sections: DataFrame, limit: int = 18_000) -> DataFrame:
    listed = F.coalesce("title", F.lit("")).contains("规范性引用文件")
    row = sections.withColumns({"listed": listed, "refs": reference_ids(_whole())})
    row = row.withColumn("in_body", ~F.col("listed") & (F.size("refs") > 0))
    ids = lambda on: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col(on), F.col("refs"))))))
    d = row.groupBy("doc_id").agg(ids("listed").alias("l"), ids("in_body").alias("b"), _joined(F.col("listed"), _line(2500), "\n\n", "（未找到规范性引用文件章节）").alias("lists"), _joined(F.col("in_body"), _line(900), "\n\n", "（未检出正文引用章节）").alias("bodies"))
    shown = lambda x: F.when(F.size(x) > 0, F.array_join(x, ", ")).otherwise("（未检出）")
    parts = [
        F.lit("【本地引用抽取结果】\n清单引用："), shown("l"), F.lit("\n正文引用："), shown("b"), F.lit("\n疑似漏列（正文有、清单无）："), shown(F.array_except("b", "l")),
        F.lit("\n疑似冗余（清单有、正文无）："), shown(F.array_except("l", "b")), F.lit("\n\n【规范性引用文件章节】\n"), F.col("lists"), F.lit("\n\n【正文中含标准引用的章节】\n"), F.col("bodies"),
    ]
    return d.select("doc_id", F.substring(F.concat(*parts), 1, limit).alias("context"))


def focus(sections: DataFrame, dimension: str) -> DataFrame:
    """Sections that a dimension's review looks at, as lines: doc_id, rank, line."""
    title, number, content = (F.coalesce(c, F.lit("")) for c in ("title", "section_number", "content"))
    dots = F.length(number) - F.length(F.replace(number, F.lit(".")))
    wanted, limit = {
        "C2.1": (has_any(title, ["前言", "引言", "附录", "范围", "规范性引用文件", "术语"]) | (dots >= 4), 500),
        "C2.2": (has_any(title, ["范围", "试验", "要求", "判定", "方法", "报告"]) | F.split_part(number, F.lit("."), F.lit(1)).isin(list("1456789")), 420),
        "C3.1": (has_any(content, ["应", "宜", "可", "须", "尽量", "最好", "一般"]), 520),
        "C3.2": (has_any(title, ["术语", "定义"]) | number.startswith("3"), 600),
        "C3.3": (title.contains("规范性引用文件") | (F.size(reference_ids(content)) > 0), 650),
    }[dimension]
    row = sections.withColumn("hit", wanted)
    hits = row.where("hit").select("doc_id", F.lit(0).alias("part"), "ord", _line(limit).alias("line"))
    if dimension == "C3.2":  # topped up with leading sections where there are few
        n = F.sum(F.col("hit").cast("int")).over(Window.partitionBy("doc_id"))
        hits = hits.unionByName(row.withColumn("n", n).where("n < 8 and ord < 20").select("doc_id", F.lit(1).alias("part"), "ord", _line(220).alias("line")))
    return hits.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "ord")).alias("rank"), "line")


# Structure (the rule tools)


def missing_sections(docs: DataFrame, headings: DataFrame) -> DataFrame:
    """Mandatory categories none of whose keywords is in a title; a document without headings misses all four."""
    hit = [F.bool_or(has_any(F.col("title"), words)).alias(name) for name, words in MANDATORY.items()]
    have = docs.select("doc_id").join(headings.groupBy("doc_id").agg(*hit), "doc_id", "left")
    missing = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(f"`{name}`"), F.lit(False)), F.struct(F.lit(i).alias("rank"), F.lit(name).alias("category"))) for i, name in enumerate(MANDATORY)]))
    return have.select("doc_id", F.explode(missing).alias("m")).select("doc_id", "m.rank", "m.category")


def order_issues(headings: DataFrame) -> DataFrame:
    """Top-level numbers that do not grow, and standard sections in the wrong order."""
    top = headings.where(F.col("section_number").rlike(r"^\d+$")).withColumn("number", F.col("section_number").cast("int"))
    w = Window.partitionBy("doc_id").orderBy("ord")
    steps = top.withColumns({"before": F.lag("number").over(w), "before_title": F.lag("title").over(w)}).where("number <= before")
    named = lambda n, t: F.concat(F.col(n).cast("string"), F.lit(" "), F.col(t))
    grown = steps.select("doc_id", F.lit("sequence").alias("kind"), "ord", named("before", "before_title").alias("prev"), named("number", "title").alias("curr"))
    last = top.groupBy("doc_id").agg(*[F.max_by("number", F.when(F.col("title").contains(t), F.col("ord"))).alias(f"n{i}") for i, t in enumerate(STANDARD_ORDER)])
    pairs = [F.when(F.col(f"n{i}") > F.col(f"n{i + 1}"), F.struct(F.lit(i).alias("ord"), F.concat(F.col(f"n{i}").cast("string"), F.lit(f" {STANDARD_ORDER[i]}")).alias("prev"), F.concat(F.col(f"n{i + 1}").cast("string"), F.lit(f" {STANDARD_ORDER[i + 1]}")).alias("curr"))) for i in range(len(STANDARD_ORDER) - 1)]
    swapped = last.select("doc_id", F.explode(F.array_compact(F.array(*pairs))).alias("p")).select("doc_id", F.lit("standard").alias("kind"), "p.ord", "p.prev", "p.curr")
    return grown.unionByName(swapped)


def wrong_titles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w, s) for s, words in WRONG_TITLES.items() for w in words], "title string, standard_title string")


def name_issues(headings: DataFrame) -> DataFrame:
    return headings.join(F.broadcast(wrong_titles(headings.sparkSession)), "title").select("doc_id", "ord", "section_number", "title", "standard_title")


def appendix_types(headings: DataFrame) -> DataFrame:
    number, title = F.coalesce("section_number", F.lit("")), F.coalesce("title", F.lit(""))
    attribute = F.when(title.contains("规范性"), "规范性").when(title.contains("资料性"), "资料性")
    return headings.where(number.contains("附录") | (title.contains("附录") & attribute.isNotNull())).select("doc_id", "ord", "section_number", "title", attribute.alias("attribute"), attribute.isNull().alias("missing_attribute"))


def depth_issues(headings: DataFrame) -> DataFrame:
    return headings.withColumn("depth", depth(F.col("section_number"))).where(F.col("depth") > MAX_DEPTH).select("doc_id", "ord", "section_number", "title", "depth")
