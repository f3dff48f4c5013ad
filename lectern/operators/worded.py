"""Injected errors that a model words: what it is asked, and what becomes of its answer.

targets() draws the section of each document that an error type changes and states the question; a client that
the caller brings answers (review.asked); rewrites() turns answers into new contents for injectors.rewritten().
Documents without a fitting section, and failed or empty answers, change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import WS, label, section_line, trimmed
from lectern.operators import review
from lectern.operators.injectors import Injection, pick, rewritten, term_list
from lectern.operators.sections import body_sections, scope_section, technical_sections

WORDED = ["E-SC-01", "E-SC-02", "E-SC-03", "E-TM-01", "E-TM-02", "E-TM-03", "E-TM-04"]
_WHOLE = "只返回修改后的全部正文。"


def _asking(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("prompt")


def _shown() -> Column:
    return F.concat(F.lit("【"), label(F.col("section_number"), F.col("title")), F.lit("】\n"), F.col("content"))


def next_entry_number(lines: Column, entries: Column) -> Column:
    """One more than the last two-part number that begins an entry; 3.99 without one."""
    number = F.regexp_extract(trimmed(F.element_at(F.transform(entries, lambda i: F.get(lines, i)), -1)), r"^(\d+)\.(\d+)", 0)
    head, last = F.split_part(number, F.lit("."), F.lit(1)), F.split_part(number, F.lit("."), F.lit(2))
    return F.when(F.size(entries) > 0, F.concat(head, F.lit("."), (last.cast("bigint") + 1).cast("string"))).otherwise("3.99")


def scope_summary(sections: DataFrame, limit: int = 6000) -> DataFrame:
    """By document the technical sections as short lines, up to the first that would pass limit."""
    line = F.concat(F.lit("【"), label(F.col("section_number"), F.col("title")), F.lit("】"), F.substring(section_line(F.lit(None).cast("string"), F.lit(""), F.col("content"), 220), 2, 220))
    rows = technical_sections(sections).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("rows"))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(True).alias("open"))
    add = lambda acc, r: F.when(acc["open"] & (acc["n"] + F.length(r["line"]) <= limit), F.struct(F.concat(acc["text"], F.when(acc["text"] == "", "").otherwise("\n"), r["line"]).alias("text"), (acc["n"] + F.length(r["line"])).alias("n"), F.lit(True).alias("open"))).otherwise(F.struct(acc["text"].alias("text"), acc["n"].alias("n"), F.lit(False).alias("open")))
    return rows.select("doc_id", F.aggregate("rows", start, add, lambda acc: acc["text"]).alias("summary"))


def term_question(sections: DataFrame) -> DataFrame:
    """The question for a document's most telling term, which E-TM-03 and E-TM-04 need first: doc_id, prompt."""
    rows = term_list(sections).where("size(entries) > 0")
    shown = F.array_join(F.slice(F.transform("entries", lambda i: trimmed(F.get("lines", i))), 1, 10), "\n")
    return rows.select("doc_id", _asking("术语条目如下：\n", shown, "\n选出其中最有代表性的一个术语，只返回术语本身。"))


def targets(sections: DataFrame, code: str, seed: int, terms: DataFrame | None = None) -> DataFrame:
    """By document the drawn section and the question: doc_id, ord, section_number, title, content, prompt.

    terms (doc_id, term) are the answers to term_question(). Candidates: E-SC-01 sections of more than 30 code
    points that are not the scope; E-SC-02 and E-SC-03 the scope's body; E-TM-01 body sections; E-TM-02 the
    term section; E-TM-03 and E-TM-04 body sections that use the term.
    """
    scope = sections.where(F.coalesce("title", F.lit("")).contains("范围")).groupBy("doc_id").agg(F.min_by("content", "ord").alias("scope"))
    glossary = term_list(sections).select("doc_id", F.col("content").alias("glossary"))
    if code == "E-SC-01":
        long_ = sections.where(~F.coalesce("title", F.lit("")).contains("范围") & (F.length(F.coalesce("content", F.lit(""))) > 30))
        row = pick(long_.join(scope, "doc_id"), seed, code)
        prompt = _asking("本文件的范围：\n", F.coalesce("scope", F.lit("")), "\n\n章节：\n", _shown(), "\n\n在章节末尾加一到两句超出上述范围的内容。", _WHOLE)
    elif code == "E-SC-02":
        row = scope_section(sections).join(scope_summary(sections), "doc_id")
        prompt = _asking("本文件的范围：\n", F.col("content"), "\n\n技术章节摘要：\n", F.col("summary"), "\n\n写一句本文件适用于某对象或场景的陈述，该对象与领域相关而摘要未作规定，不用应、宜、可等助动词。只返回这一句。")
    elif code == "E-SC-03":
        row = scope_section(sections)
        prompt = _asking("本文件的范围：\n", F.col("content"), "\n\n保留原意，加入或改写出一句含“应”或“宜”的具体要求。", _WHOLE)
    elif code == "E-TM-01":
        row = pick(body_sections(sections).join(glossary, "doc_id", "left"), seed, code)
        prompt = _asking("已定义的术语：\n", F.coalesce("glossary", F.lit("（无）")), "\n\n章节：\n", _shown(), "\n\n在章节中用上一个未定义的技术术语。", _WHOLE)
    elif code == "E-TM-02":
        row = term_list(sections)
        prompt = _asking("术语章节：\n", F.col("content"), "\n\n仿照上文写一个编号为 ", next_entry_number(F.col("lines"), F.col("entries")), " 的新术语条目，正文不使用该术语。只返回这一条目。")
    elif code in ("E-TM-03", "E-TM-04"):
        if terms is None:
            raise ValueError(f"{code} needs a term for each document")
        using = body_sections(sections).join(terms.where("term <> ''"), "doc_id").where(F.contains("content", "term")).join(glossary, "doc_id")
        row = pick(using, seed, code)
        change = ("改写术语「", "」的用法，使其含义与定义不符。") if code == "E-TM-03" else ("把一处「", "」换成近义的非标准说法。")
        prompt = _asking("术语章节：\n", F.col("glossary"), "\n\n章节：\n", _shown(), f"\n\n{change[0]}", F.col("term"), change[1], _WHOLE)
    else:
        raise ValueError(f"{code} is not worded by a model")
    return row.select("doc_id", "ord", "section_number", "title", "content", prompt)


def scope_sentence(reply: Column) -> Column:
    """The one statement in a reply: without fences, lead and quotes, as a sentence that says what the document applies to; null if empty."""
    bare = trimmed(F.regexp_replace(trimmed(F.coalesce(reply, F.lit(""))), "^`+|`+$", ""))
    bare = F.regexp_replace(bare, r"^(?i:json|text)(?=\n)", "")
    line = F.coalesce(F.get(F.filter(F.transform(F.split(bare, r"\r\n|[\n\r]"), trimmed), lambda x: x != ""), F.lit(0)), F.lit(""))
    line = trimmed(F.regexp_replace(line, f"^(?:新增适用对象|适用对象|新增范围声明|范围声明)[:：]{WS}*", ""))
    line = F.regexp_replace(line, "^[\"'“”]+|[\"'“”]+$", "")
    whole = F.when(~line.contains("适用"), F.concat(F.lit("本文件也适用于"), F.regexp_replace(line, "[。；;]+$", ""), F.lit("。"))).when(~line.rlike("[。；;]$"), F.concat(line, F.lit("。"))).otherwise(line)
    return F.when(line != "", whole)


def rewrites(asked: DataFrame, code: str) -> DataFrame:
    """New contents (doc_id, ord, content) from targets with their reply; answers that add nothing fall away."""
    reply = trimmed(F.coalesce("reply", F.lit("")))
    rows = asked.where(reply != "")
    if code == "E-SC-02":
        rows = rows.withColumn("added", scope_sentence(F.col("reply"))).where("added is not null and not contains(content, added)")
    else:
        rows = rows.withColumn("added", reply)
    below = F.concat(F.regexp_replace("content", f"{WS}+$", ""), F.lit("\n"), F.col("added"))
    return rows.select("doc_id", "ord", (below if code in ("E-SC-02", "E-TM-02") else F.col("added")).alias("content"))


def inject_worded(sections: DataFrame, code: str, seed: int, client: Callable[[str], str]) -> Injection:
    """One error of a type for each document where it fits, worded by a client; failed calls change nothing."""
    terms = None
    if code in ("E-TM-03", "E-TM-04"):
        terms = review.asked(term_question(sections), client).where("not failed").select("doc_id", trimmed(F.coalesce("reply", F.lit(""))).alias("term"))
    drawn = targets(sections, code, seed, terms)
    replies = review.asked(drawn.select("doc_id", "prompt"), client).where("not failed").select("doc_id", "reply")
    return rewritten(sections, rewrites(drawn.drop("prompt").join(replies, "doc_id"), code), code)
