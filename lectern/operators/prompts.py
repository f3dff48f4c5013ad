"""What reviewing models are asked: prompts as rows, in our own words.

A row has doc_id, source_agent, dimension and error_type (null: any), system and prompt. review.asked() puts
them to a client, agentic_review() runs the whole high-recall review.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import label, section_key, section_line
from lectern.operators import candidates, review, rules
from lectern.operators.sections import parse_sections
from lectern.operators.storage import stored
from lectern.taxonomy import ERROR_TYPES

# Error types with a reviewer of their own.
TYPE_AGENTS = [("C3.1", "E-T-02"), ("C3.1", "E-T-07"), ("C3.2", "E-TM-01"), ("C3.2", "E-TM-02"), ("C3.2", "E-TM-03"), ("C3.2", "E-TM-04"), ("C3.3", "E-R-01")]
#: What each dimension covers.
GUIDES = {"C2.1": "结构：必备章节、顺序、标题写法、前言与引言、附录性质、层次", "C2.2": "范围：正文与范围的界限、承诺与要求", "C3.1": "语气：应、宜、可、须等助动词的强弱", "C3.2": "术语：定义、使用、一致、编号", "C3.3": "引用：清单与正文的对应、性质、次序"}
FIELDS = "error_type、dimension、section_number、reason、error_description、evidence、confidence"
_ANSWER = f"只返回 JSON 数组，元素含 {FIELDS}；没有问题时返回 []。"
_COLUMNS = ["doc_id", "source_agent", "dimension", "error_type", "system", "prompt"]


def _rows(base: DataFrame, agent: str, dimension: str | None, error_type: str | None, system: str, prompt: Column) -> DataFrame:
    text = lambda x: F.lit(x).cast("string")
    return base.select("doc_id", text(agent).alias("source_agent"), text(dimension).alias("dimension"), text(error_type).alias("error_type"), text(system).alias("system"), prompt.alias("prompt"))


def dimension_context(sections: DataFrame, dimension: str, limit: int = 18_000) -> DataFrame:
    """By document the local findings and sections that a dimension's reviewer should see: doc_id, context."""
    made = {"C3.1": rules.modal_context, "C3.2": rules.technical_context, "C3.3": rules.reference_context}.get(dimension)
    if made:
        return made(sections, limit)
    lines = rules.focus(sections, dimension).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("r"))
    heads = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", label(F.col("section_number"), F.col("title")).alias("t")))).alias("h"))
    shown = F.concat(F.lit("【章节标题列表】\n"), F.array_join(F.transform(F.slice("h", 1, 240), lambda x: x["t"]), "\n"), F.lit("\n\n【重点章节】\n"), F.coalesce(F.array_join(F.transform("r", lambda x: x["line"]), "\n\n"), F.lit("")))
    return heads.join(lines, "doc_id", "left").select("doc_id", F.substring(shown, 1, limit).alias("context"))


def direct_prompts(docs: DataFrame, rule_context: DataFrame | None = None) -> DataFrame:
    """One question over all dimensions for each document; rule_context (doc_id, context) goes before the text."""
    system = "审查 GB/T 标准文本，维度如下。\n" + "\n".join(f"{d} {g}（{'、'.join(ERROR_TYPES[d])}）" for d, g in GUIDES.items()) + f"\n{_ANSWER}"
    base = docs.select("doc_id", "source_text")
    if rule_context is None:
        return _rows(base, "direct", None, None, system, F.concat(F.lit("【正文】\n"), F.col("source_text")))
    known = base.join(rule_context.select("doc_id", "context"), "doc_id", "left")
    return _rows(known, "direct", None, None, system, F.concat(F.coalesce(F.concat(F.lit("【参考规则】\n"), F.nullif("context", F.lit("")), F.lit("\n\n")), F.lit("")), F.lit("【正文】\n"), F.col("source_text")))


def specialist_prompts(docs: DataFrame, sections: DataFrame, full_scan: bool = True) -> DataFrame:
    """A question for each document and dimension: its local context, then the whole text."""
    aim = "尽量找全，证据可核对即可报告，允许中等把握。" if full_scan else "只报告证据充分的新问题。"
    made = []
    for d, guide in GUIDES.items():
        base = docs.select("doc_id", "source_text").join(dimension_context(sections, d), "doc_id", "left")
        system = f"只审查维度 {d}（{guide}）。error_type 只能是 {'、'.join(ERROR_TYPES[d])}，section_number 用文中的编号或 null。{aim}{_ANSWER}"
        made.append(_rows(base, f"specialist_{d}", d, None, system, F.concat(F.lit("【重点】\n"), F.coalesce("context", F.lit("（无）")), F.lit("\n\n【正文】\n"), F.col("source_text"))))
    return reduce(DataFrame.unionByName, made)


def error_type_prompts(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """A question for each document and each of TYPE_AGENTS."""
    made = []
    for d in sorted({d for d, _ in TYPE_AGENTS}):
        base = docs.select("doc_id", "source_text").join(dimension_context(sections, d), "doc_id", "left")
        for t in [t for x, t in TYPE_AGENTS if x == d]:
            system = f"只查找 {d} 的 {t}（{GUIDES[d]}），不报告其他类型；跨章节的问题可给出多个位置，尽量找全。{_ANSWER}"
            made.append(_rows(base, f"type_{t}", d, t, system, F.concat(F.lit("【重点】\n"), F.coalesce("context", F.lit("（无）")), F.lit("\n\n【正文】\n"), F.col("source_text"))))
    return reduce(DataFrame.unionByName, made)


def sentence_prompts(sections: DataFrame) -> DataFrame:
    """A question for each document and batch of sentences with modal words (rules.modal_sentences)."""
    item = F.struct("rank", "section_number", "title", "sentence", "modal_words")
    batches = rules.modal_sentences(sections).groupBy("doc_id", "batch").agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(*[x[c].alias(c) for c in ("section_number", "title", "sentence", "modal_words")])), {"ignoreNullFields": "false"}).alias("s"))
    return _rows(batches, "sentences", "C3.1", None, f"逐句判断语气是否有误，一句可对应多个类型（{'、'.join(ERROR_TYPES['C3.1'])}）。{_ANSWER}", F.col("s"))


def term_index_prompts(sections: DataFrame) -> DataFrame:
    """A question for each document with its terms, where they are used, and its technical sections."""
    terms = rules.term_entries(sections, 100)
    listed = terms.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term", "section_number", "definition"))).alias("t"))
    used = rules.term_usage(terms, sections).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term", "section_number", "used_sections", "used_count"))).alias("u"))
    base = sections.select("doc_id").distinct().join(listed, "doc_id", "left").join(used, "doc_id", "left").join(rules.technical_context(sections, 9000), "doc_id", "left")
    shown = F.concat(F.lit("【术语表】\n"), F.coalesce(F.to_json("t"), F.lit("[]")), F.lit("\n\n【使用】\n"), F.coalesce(F.to_json("u"), F.lit("[]")), F.lit("\n\n【技术章节】\n"), F.coalesce("context", F.lit("")))
    return _rows(base, "term_index_model", "C3.2", None, f"据术语表和使用情况查找术语问题（{'、'.join(ERROR_TYPES['C3.2'])}）。{_ANSWER}", F.substring(shown, 1, 18_000))


# Later steps: prompts on candidates


def evidence_sections(found: DataFrame, sections: DataFrame) -> DataFrame:
    """The sections that candidates (doc_id, cand_index, section_number) name, each once in order of candidates: doc_id, rank, section, line."""
    wanted = found.select("doc_id", "cand_index", section_key(F.col("section_number")).alias("section")).groupBy("doc_id", "section").agg(F.min("cand_index").alias("cand_index"))
    known = sections.withColumn("section", section_key(F.col("section_number"))).where("section is not null").groupBy("doc_id", "section").agg(F.max(F.struct("ord", "section_number", "title", "content")).alias("s"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("cand_index"))
    return wanted.join(known, ["doc_id", "section"]).select("doc_id", rank.alias("rank"), "section", section_line(F.col("s.section_number"), F.col("s.title"), F.col("s.content"), 900).alias("line"))


def evidence_context(docs: DataFrame, found: DataFrame, sections: DataFrame, limit: int = 22_000) -> DataFrame:
    """By document with candidates: headings, the sections they name, and the contexts of their dimensions; the text where it has no sections."""
    lines = evidence_sections(found, sections).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("r"))
    heads = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", label(F.col("section_number"), F.col("title")).alias("t")))).alias("h"))
    has = found.where(F.col("dimension").isin(list(ERROR_TYPES))).select("doc_id", "dimension").distinct()
    parts = [has.where(F.col("dimension") == d).join(dimension_context(sections, d, 5000), "doc_id").select("doc_id", F.struct(F.lit(d).alias("d"), F.concat(F.lit(f"【{d} 相关片段】\n"), F.col("context")).alias("c")).alias("p")) for d in ERROR_TYPES]
    dims = reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    base = docs.select("doc_id", "source_text").join(found.select("doc_id").distinct(), "doc_id").join(heads, "doc_id", "left").join(lines, "doc_id", "left").join(dims, "doc_id", "left")
    joined = lambda c, f, mark: F.coalesce(F.array_join(F.transform(c, lambda x: x[f]), mark), F.lit(""))
    shown = F.concat(F.lit("【章节标题列表】\n"), joined(F.slice("h", 1, 240), "t", "\n"), F.lit("\n\n【候选错误所在章节】\n"), joined("r", "line", "\n\n"), F.lit("\n\n"), joined("p", "c", "\n\n"))
    bare = F.trim(F.regexp_replace("source_text", r"\s+", " "))
    return base.select("doc_id", F.substring(F.when(F.col("h").isNull(), bare).otherwise(shown), 1, limit).alias("context"))


#: What each later step does with candidates.
STEPS = {
    "verify": "复核候选是否成立，删除证据不足、类型或位置不对的，可润色文字。", "critic": "只反驳和过滤：保留证据支持、类型与位置相符、不重复、非抽取噪声的候选，附 critic_note。",
    "arbiter": "裁决：合并重复，改正类型和位置，删除过度推断的；error_description 写成“错误：…；修改建议：…；依据：…”。", "formatter": "整理成最终结果，只留 error_type、dimension、section_number、reason、error_description，不增不改。",
    "judge": "判断结果是否足够。只返回 JSON 对象：is_best、reason、feedback、suggested_dimensions。",
}


def step_prompts(step: str, docs: DataFrame, found: DataFrame, sections: DataFrame) -> DataFrame:
    """A question for each document with candidates (doc_id, cand_index and item fields): evidence (but for the formatter), then the candidates as JSON."""
    fields = [c for c in ("error_type", "dimension", "section_number", "reason", "error_description", "evidence", "confidence", "critic_note") if c in found.columns]
    rows = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("cand_index", *fields))).alias("c"))
    listed = rows.select("doc_id", F.to_json(F.transform("c", lambda x: F.struct(*[x[f].alias(f) for f in fields])), {"ignoreNullFields": "false"}).alias("json"))
    system = STEPS[step] + ("" if step in ("formatter", "judge") else _ANSWER)
    if step == "formatter":
        return _rows(listed, step, None, None, system, F.col("json"))
    known = listed.join(evidence_context(docs, found, sections, 18_000 if step == "judge" else 22_000), "doc_id")
    return _rows(known, step, None, None, system, F.concat(F.lit("【文档证据】\n"), F.col("context"), F.lit("\n\n【候选】\n"), F.col("json")))


def step_answers(step: str, replied: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates after a step: those of the replies; the old ones where the call failed or its reply is null."""
    counts = ~F.col("failed") & ~review.replies.is_skipped(F.col("reply"))
    new = candidates.normalised(review.predictions_of(replied.where(counts)).withColumnRenamed("pred_index", "cand_index"))
    old = found.join(replied.where(~counts).select("doc_id"), "doc_id", "left_semi")
    kept = new.select("doc_id", "cand_index", *candidates.OUTPUT).unionByName(old.select("doc_id", "cand_index", *candidates.OUTPUT))
    return candidates.first_of_key(kept, ["cand_index"]) if step == "formatter" else kept


def verdicts(replied: DataFrame) -> DataFrame:
    """Judgements: doc_id, is_best, reason, feedback and suggested_dimensions; other replies than objects judge no."""
    v = F.from_json(review.replies.json_text(F.col("reply")), "is_best boolean, reason string, feedback string, suggested_dimensions array<string>")
    row = replied.select("doc_id", v.alias("v"))
    dims = F.filter(F.coalesce("v.suggested_dimensions", F.array().cast("array<string>")), lambda d: d.isin(list(ERROR_TYPES)))
    text = lambda *c: F.trim(F.coalesce(*[F.nullif(x, F.lit("")) for x in c], F.lit("")))
    return row.select("doc_id", F.coalesce("v.is_best", F.lit(False)).alias("is_best"), text("v.reason").alias("reason"), text("v.feedback", "v.reason").alias("feedback"), dims.alias("suggested_dimensions"))


def found_by(replied: DataFrame) -> DataFrame:
    """Findings of answered prompts, of their prompt's dimension and error type only where these are stated."""
    rows = replied.where(~F.col("failed")).select("doc_id", "source_agent", F.col("dimension").alias("own_dimension"), F.col("error_type").alias("own_type"), "part", F.posexplode(review.replies.items(F.col("reply"))).alias("at", "i"))
    found = candidates.normalised(rows.select("doc_id", "source_agent", "own_dimension", "own_type", F.struct("part", "at").alias("place"), "i.*"))
    kept = found.where("(own_dimension is null or own_dimension = dimension) and (own_type is null or own_type = error_type)")
    rank = F.row_number().over(Window.partitionBy("doc_id", "source_agent").orderBy("place")) - 1
    return kept.withColumn("pred_index", rank).drop("own_dimension", "own_type", "place")


def agentic_review(docs: DataFrame, client: Callable[..., str], direct: bool = True, specialists: bool = True, type_agents: bool = True, local: bool = True, replies: str | None = None) -> DataFrame:
    """Final candidates of documents (doc_id, source_text) by the high-recall review, with a client that the caller brings.

    All prompts are put in one pass over the cluster, several at once in a task. With a folder of replies, prompts that
    have one there are not asked again, by retries or later reviews (review.asked_once); else replies are stored for this review.
    A failed call adds no findings and is told apart from an empty answer in the stored replies (failed).
    """
    s = parse_sections(docs)
    made = []
    if direct:
        made.append(direct_prompts(docs))
    if specialists:
        made.append(specialist_prompts(docs, s))
    if type_agents:
        made.append(error_type_prompts(docs, s))
    if local:
        made += [sentence_prompts(s), term_index_prompts(s)]
    local_only = {} if local else {"reviewers": []}
    if not made:
        return review.high_recall(docs, {}, **local_only)
    asked = reduce(DataFrame.unionByName, made).withColumn("part", F.row_number().over(Window.partitionBy("doc_id", "source_agent").orderBy("prompt")))
    found = found_by(stored(review.asked_once(asked, client, replies) if replies else review.asked(asked, client), "replies"))
    order = [*(["direct"] if direct else []), *([f"specialist_{d}" for d in GUIDES] if specialists else []), *([f"type_{t}" for _, t in TYPE_AGENTS] if type_agents else []), *(["sentences", "term_index_model"] if local else [])]
    return review.high_recall(docs, {a: found.where(F.col("source_agent") == a).drop("source_agent") for a in order}, **local_only)
