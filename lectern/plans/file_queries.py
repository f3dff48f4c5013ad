"""Queries of file formats, page texts, injections and lookups over whole tables, each with its SQL.

Files are made of the rows of `documents`, one for each: the contents that a folder scan would give. What a PDF library, OCR
or a model answers is a small function of those contents.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import injectors, matching, prompts, sections
from lectern.operators.storage import scratch, stored
from lectern.plans.corpus_queries import _LISTS, _S, parsed, standards
from lectern.plans.table_queries import _BAGS, ORACLES, QUERIES, bags, query, read
from lectern.sources import clients, files, rules

__all__ = ["ORACLES", "QUERIES"]

_OWN = r"regexp_replace(line, '[^\p{Ll} ]', '')"
#: A document as a printed one: every fourth line a numbered heading, the letters of the others behind a word; in SQL of either engine.
_PRINTED = "CASE WHEN p % 4 = 0 THEN concat({k} % 90 + 1, '.1 ', {title}) ELSE concat('正文', {own}) END"
_TITLE = "CASE {k} % 3 WHEN 0 THEN '要求' WHEN 1 THEN '范围' ELSE '试验方法' END"
_P = rf"""l AS (SELECT doc_id, unnest(range(len(x))) AS p, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
    q AS (SELECT doc_id, p, p // 4 AS k, rtrim('正文' || regexp_replace(line, '[^\p{{Ll}} ]', '', 'g')) AS line, p // 4 % 90 + 1 || '.1' AS number, {_TITLE.format(k='(p // 4)')} AS title FROM l)"""


def printed(spark, sf_dir) -> DataFrame:
    """doc_id and text of documents as printed pages would have it."""
    own, k = _OWN.replace("\\", "\\\\"), "(p div 4)"
    made = _PRINTED.format(k=k, title=_TITLE.format(k=k), own=own)
    return read(spark, sf_dir, "documents").select("doc_id", F.expr(f"array_join(transform(split(coalesce(text, ''), '\\n'), (line, p) -> {made}), '\\n')").alias("text"))


def _files(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("path"), F.encode(F.col(text), "UTF-8").alias("content"))


def _ids(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_id").cast("bigint"))


@query(f"WITH {_P} SELECT doc_id, k::INT AS ord, number AS section_number, title, coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (p % 4 > 0), '') AS content FROM q GROUP BY ALL")
def io10_printed_sections(spark, sf_dir):
    """IO10, WN12, PF13: sections of page texts by patterns, pages of eight lines, over all documents."""
    line = printed(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    pages = line.groupBy("doc_id", F.floor(F.col("p") / 8).cast("int").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "line"))), lambda r: r["line"]), "\n").alias("text"))
    return files.sections_of_pages(pages)


@query(f"WITH {_P} SELECT doc_id, p::INT AS index, CASE WHEN p % 4 = 0 THEN number || ' ' || title ELSE line END AS text, number AS section, title AS section_title FROM q")
def io16_printed_blocks(spark, sf_dir):
    """IO16, WN7: text blocks of files with the section they stand in."""
    found = files.pdf_blocks(_files(printed(spark, sf_dir), "text"), _blocks)
    return _ids(found).select("doc_id", "index", "text", "section", "section_title")


def _blocks(content: bytes) -> list[tuple]:
    """A stub of a PDF library: a block for each line."""
    return [(0, t, 0.0, float(i), 9.0, float(i + 1), "F", 10.0) for i, t in enumerate(content.decode().split("\n"))]


def _docx(paragraphs: list[str], cell: str) -> bytes:
    """A DOCX file of paragraphs and a table of one cell."""
    out, space = io.BytesIO(), 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{escape(t)}</w:t></w:r></w:p>"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:document {space}><w:body>{''.join(map(p, paragraphs))}<w:tbl><w:tr><w:tc>{p(cell)}</w:tc></w:tr></w:tbl></w:body></w:document>")
    return out.getvalue()


def _word_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), files.FILES):
            part = b.slice(at, files.FILES)
            made = [_docx(t.as_py().split("\n"), f"格{i}") for i, t in zip(part.column("path"), part.column("text"), strict=True)]
            yield pa.record_batch([part.column("path"), pa.array(made, pa.binary())], ["path", "content"])


def _documents_as_docx(spark, sf_dir) -> DataFrame:
    rows = printed(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), "text")
    return stored(rows.mapInArrow(_word_files, "path string, content binary"), "docx")


@query(f"WITH {_P} SELECT doc_id, p::INT AS index, CASE WHEN p % 4 = 0 THEN number || ' ' || title ELSE line END AS text, number AS section FROM q")
def io15_docx_paragraphs(spark, sf_dir):
    """IO15, IO17: the paragraphs of all documents as DOCX files, with their sections."""
    return _ids(files.docx_paragraphs(_documents_as_docx(spark, sf_dir))).select("doc_id", "index", F.rtrim("text").alias("text"), "section")


@query("SELECT doc_id, '格' || doc_id AS text, 'paragraphs=' || len(string_split(coalesce(text, ''), chr(10))) || ',tables=1' AS properties FROM documents")
def io15_docx_tables(spark, sf_dir):
    """IO15: table cells and properties of all documents as DOCX files."""
    made = _documents_as_docx(spark, sf_dir)
    shown = files.docx_properties(made).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "name", "value"))), ",").alias("properties"))
    return _ids(files.docx_cells(made).join(shown, "doc_id").select("doc_id", "text", "properties"))


_READABLE = f"regexp_matches(t, '{'|'.join(files.READABLE)}')"


def _text_model(prompt: str) -> str:
    """A stub model that answers one section: the number of lines and the size of its text."""
    body = prompt[prompt.index("\n") + 1 :]
    return json.dumps([{"section_number": str(body.count("\n") + 1), "title": "文", "content": str(len(body))}], ensure_ascii=False)


def _image_model(prompt: str, images: list[bytes]) -> str:
    return json.dumps([{"section_number": str(len(images)), "title": "图", "content": str(sum(map(len, images)))}], ensure_ascii=False)


@query(f"""WITH {_S}, d AS (SELECT doc_id, string_agg('[' || section_number || '] ' || title || CASE WHEN content <> '' THEN chr(10) || content ELSE '' END, chr(10) ORDER BY ord) AS t FROM s GROUP BY 1)
    SELECT doc_id, 0 AS ord, CASE WHEN {_READABLE} THEN (length(t) - length(replace(t, chr(10), '')) + 1)::VARCHAR ELSE '2' END AS section_number, CASE WHEN {_READABLE} THEN '文' ELSE '图' END AS title,
      (CASE WHEN {_READABLE} THEN length(t) ELSE octet_length(encode(t)) END)::VARCHAR AS content FROM d""")
def io9_document_routes(spark, sf_dir):
    """IO9, IO11: readable texts to a model, the others' two page images to one that sees."""
    half = lambda content: [content[: len(content) // 2], content[len(content) // 2 :]]
    found = files.sections_of_pdfs(_files(standards(spark, sf_dir), "source_text"), lambda content: [content.decode()], _text_model, _image_model, half)
    return _ids(found)


def _pages_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Turns of a conversation as pages, a row of points for each line and a point for each word of its first, stitched."""
    for b in batches:
        found = []
        for texts in b["texts"]:
            pages = [np.full((t.count("\n") + 1, len(t.split("\n")[0].split(" ")), 3), i % 200, np.uint8) for i, t in enumerate(texts)]
            whole = files.stitched(pages)
            found.append((*whole.shape[:2], int(whole[-1, 0, 0]), int((whole[..., 0] == 255).sum())))
        yield pd.concat([b[["conv_id"]].reset_index(drop=True), pd.DataFrame(found, columns=["height", "width", "last", "white"])], axis=1)


@query("""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, len(string_split(text, chr(10))) AS h, len(string_split(string_split(text, chr(10))[1], ' ')) AS w FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations))
    SELECT conv_id, sum(h)::BIGINT AS height, max(w)::BIGINT AS width, arg_max(i % 200, i)::BIGINT AS last, (sum(h) * max(w) - sum(h * w))::BIGINT AS white FROM t GROUP BY 1""")
def io13_stitched_turns(spark, sf_dir):
    """IO13: page images one below the other on white, one for each turn of all conversations."""
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    pages = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["text"]).alias("texts"))
    return pages.mapInPandas(_pages_of, "conv_id bigint, height bigint, width bigint, last bigint, white bigint")


@query("SELECT CASE WHEN item_id % 3 = 0 THEN 'rule_' || (item_id + 1) ELSE 'b' || item_id END AS id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, CASE WHEN item_id % 2 = 0 THEN 'C3.1' END AS dimension FROM benchmark")
def io18_benchmark_rules(spark, sf_dir):
    """IO18: the benchmark texts as a file of rules; those without an id are named after their line."""
    b = read(spark, sf_dir, "benchmark")
    meta = F.when(F.col("item_id") % 2 == 0, F.create_map(F.lit("dimension"), F.lit("C3.1")))
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    line = F.to_json(F.struct(F.when(F.col("item_id") % 3 != 0, F.concat(F.lit("b"), F.col("item_id").cast("string"))).alias("id"), F.concat(F.lit(" "), flat).alias("text"), meta.alias("metadata")))
    path = scratch(spark, "rules")
    b.orderBy("item_id").coalesce(1).select(line.alias("value")).write.text(path)  # a rule file is one file
    return rules.read_rules(spark, path).select("id", "text", F.col("metadata")["dimension"].alias("dimension"))


def _vectors(url: str, headers: dict, body: bytes | None) -> bytes:
    """A stub of an embedding service: the size of each text."""
    return json.dumps({"data": [{"index": i, "embedding": [len(x), 1.0]} for i, x in reversed(list(enumerate(json.loads(body)["input"])))]}).encode()


@query("SELECT doc_id, length(coalesce(text, ''))::DOUBLE AS first FROM documents")
def lm11_embedded_documents(spark, sf_dir):
    """LM11: all documents with embeddings of a model service, 16 at a time."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    return clients.embedded(d, "http://m", "x", post=_vectors, size=16).select("doc_id", F.col("embedding")[0].cast("double").alias("first"))


@query(f"WITH {_S} SELECT doc_id, '【正文】' || chr(10) || string_agg('[' || section_number || '] ' || title || CASE WHEN content <> '' THEN chr(10) || content ELSE '' END, chr(10) ORDER BY ord) AS prompt FROM s GROUP BY 1")
def lm1_document_prompts(spark, sf_dir):
    """LM1: the question on each document."""
    return prompts.direct_prompts(standards(spark, sf_dir)).select("doc_id", "prompt")


@query(f"""WITH {_S}, n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1) SELECT doc_id, agent AS source_agent FROM n CROSS JOIN (VALUES {", ".join(f"('{a}')" for a in [*(f"specialist_{d}" for d in prompts.GUIDES), *(f"type_{t}" for _, t in prompts.TYPE_AGENTS), "term_index_model"])}) v(agent)""")
def lm2_agent_prompts(spark, sf_dir):
    """LM2, LM3, LM5: each agent's question on each document that has sections."""
    docs = stored(standards(spark, sf_dir), "standards")
    s = sections.parse_sections(docs)
    made = [prompts.specialist_prompts(docs, s), prompts.error_type_prompts(docs, s), prompts.term_index_prompts(s)]
    return reduce(DataFrame.unionByName, [m.where("prompt <> ''").select("doc_id", "source_agent") for m in made])


_HIT = f"""{_BAGS}, k AS (SELECT doc_id, section, dimension, error_type, list(pred_index ORDER BY pred_index) AS p FROM pred GROUP BY ALL),
    o AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS ord FROM lineitem WHERE l_linenumber < 6),
    h AS (SELECT g.doc_id, row_number() OVER (PARTITION BY g.doc_id ORDER BY coalesce(o.ord, 1000000000), coalesce(g.section, ''), g.gt_index) AS position, g.section, g.dimension, g.error_type, g.gt_index, k.p, 't' || o.ord AS title
      FROM gt g JOIN k ON g.doc_id = k.doc_id AND g.section IS NOT DISTINCT FROM k.section AND g.dimension = k.dimension AND g.error_type = k.error_type LEFT JOIN o ON o.doc_id = g.doc_id AND o.ord::VARCHAR = g.section)"""


def _hits(spark, sf_dir) -> DataFrame:
    _, gt, pred = bags(spark, sf_dir)
    s = read(spark, sf_dir, "lineitem").where("l_linenumber < 6").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.col("l_linenumber").cast("string").alias("section_number"), F.concat(F.lit("t"), F.col("l_linenumber").cast("string")).alias("title"), F.lit("").alias("content")).distinct()
    return matching.hit_sections(gt, pred, s)


@query(f"WITH {_HIT} SELECT doc_id, position, section, gt_index, array_to_string(p, ',') AS preds, title FROM h")
def jn7_hit_lines(spark, sf_dir):
    """JN7, TK5: diagnosed items with the predictions that mark them, in section order."""
    preds = F.array_join(F.transform("pred_indexes", lambda i: i.cast("string")), ",")
    return _hits(spark, sf_dir).select("doc_id", F.col("position").cast("bigint").alias("position"), "section", F.col("gt_index").cast("bigint").alias("gt_index"), preds.alias("preds"), "title")


@query(f"WITH {_HIT} SELECT doc_id, string_agg('[' || coalesce(section, '-') || '] ' || coalesce(title, '') || ' | ' || dimension || '/' || error_type || ' | #' || array_to_string(p, ','), chr(10) ORDER BY position) AS marked FROM h GROUP BY 1")
def fs21_marked_lines(spark, sf_dir):
    """FS21: the hit sections of all documents as text."""
    return matching.marked_text(_hits(spark, sf_dir))


_GENERAL = ", ".join(f"'{t}'" for t in sections.GENERAL_TITLES)


@query(f"""WITH {_S}, scope AS (SELECT doc_id, min(ord) AS ord FROM s WHERE title = '范围' AND content <> '' GROUP BY 1), term AS (SELECT doc_id, min(ord) AS ord FROM s WHERE contains(title, '术语') AND content <> '' GROUP BY 1)
    SELECT doc_id, 'scope' AS what, ord FROM scope UNION ALL SELECT doc_id, 'term', ord FROM term UNION ALL SELECT s.doc_id, 'body', s.ord FROM s LEFT JOIN term USING (doc_id) WHERE length(content) > 30 AND s.ord IS DISTINCT FROM term.ord
    UNION ALL SELECT doc_id, 'technical', ord FROM s WHERE content <> '' AND title NOT IN ({_GENERAL})""")
def pf20_standard_lookups(spark, sf_dir):
    """PF16, PF20, PF21: first scope and term sections, body and technical ones, of all documents."""
    s = parsed(spark, sf_dir)
    found = {"scope": sections.scope_section(s), "term": sections.term_section(s), "body": sections.body_sections(s), "technical": sections.technical_sections(s)}
    return reduce(DataFrame.unionByName, [df.select("doc_id", F.lit(name).alias("what"), "ord") for name, df in found.items()])


@query(f"WITH {_S}, d AS (SELECT doc_id, ord, instr(content, '限') AS spot, content FROM s) SELECT doc_id, ord, greatest(spot - 1, 0)::INT AS place FROM d")
def wn15_edit_places(spark, sf_dir):
    """WN15: where all contents first differ from an edit of theirs."""
    new = F.regexp_replace("content", "限", "极")
    return parsed(spark, sf_dir).select("doc_id", "ord", sections.first_difference(F.col("content"), new).alias("place"))


@query(f"""WITH {_S}, {_LISTS}, x AS (SELECT doc_id, arg_min(content, ord) FILTER (title = '标志') AS f, arg_min(content, ord) FILTER (title = '检验规则') AS i FROM s WHERE content <> '' AND title IN ('标志', '检验规则') GROUP BY 1)
    SELECT 'E-S-04' AS what, doc_id, 2::BIGINT AS changed FROM x WHERE f IS NOT NULL AND i IS NOT NULL AND f <> i UNION ALL SELECT 'year', doc_id, 1 FROM lists UNION ALL SELECT 'form', doc_id, 1 FROM lists UNION ALL SELECT 'more', doc_id, 1 FROM (SELECT DISTINCT doc_id FROM s)""")
def ce4_changed_sections(spark, sf_dir):
    """CE4, CEx1 to CEx3: how many sections of each document an exchange of foreword and introduction, a wrong year, a wrong date form or a section too many touches."""
    s = stored(parsed(spark, sf_dir), "sections")
    named = s.withColumn("title", F.when(F.col("title") == "标志", "前言").when(F.col("title") == "检验规则", "引言").otherwise(F.col("title")))
    made = [("E-S-04", injectors.swapped_foreword(named, 7), named), ("year", injectors.wrong_year(s, 7), s), ("form", injectors.wrong_date_form(s, 7), s), ("more", injectors.redundant_section(s, 7), s)]
    columns = ["doc_id", "title", "content"]  # a new section moves the places of those behind it
    return reduce(DataFrame.unionByName, [m.sections.select(*columns).exceptAll(old.select(*columns)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("changed")).select(F.lit(n).alias("what"), "doc_id", "changed") for n, m, old in made])
