"""Queries of sources, sinks, prompts and plug-ins on small files and stub models; their SQL states the rows."""

from __future__ import annotations

import io
import json
import zipfile
from functools import reduce

import numpy as np
from fixture_queries import _documents, golden
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import injectors, metrics, prompts, review, sections
from lectern.operators.storage import scratch
from lectern.sources import benchmark, clients, config, files, rules

SECTION_ROWS = "doc_id string, ord int, section_number string, title string, content string"


def _put(spark: SparkSession, folder: str, contents: dict[str, bytes]) -> str:
    """Files written to a folder of the shared store."""
    for name, content in contents.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(content))
        out.close()
    return folder


def _name(c: str):
    return F.regexp_extract(c, "([^/]+)$", 1)


def _example(dimension: str, kind: str, corrupted: tuple | None) -> dict:
    part = lambda x: None if x is None else dict(zip(("section_number", "title", "content"), x, strict=True))
    return {"dimension": dimension, "error_type": kind, "original": part(("1", "范围", "甲")), "corrupted": part(corrupted), "error_description": "述"}


def _benchmark(spark: SparkSession) -> str:
    record = lambda name, text, *e: {"file_name": name, "source_text": text, "examples": list(e)}
    one = {"total_files": 2, "documents": [record("a.pdf", "甲\t乙", _example("C2.1", "E-S-01", None)), record("b.pdf", " ")]}
    two = {"total_files": 1, "documents": [record("c.pdf", "丙", _example("C3.1", "E-T-01", (None, "新", "宜")))]}
    return _put(spark, scratch(spark, "benchmark"), {n: json.dumps(x, ensure_ascii=False).replace("\\t", "\t").encode() for n, x in (("one.json", one), ("two.json", two))})


@golden("doc_id VARCHAR, pos INTEGER, file_name VARCHAR, n INTEGER", [("one.json#0", 0, "a.pdf", 1), ("one.json#1", 1, "b.pdf", 0), ("two.json#0", 0, "c.pdf", 1)])
def io1_benchmark_scan(spark):
    """IO1: documents of benchmark files, raw control characters within strings too."""
    return benchmark.read_benchmark(spark, _benchmark(spark)).select("doc_id", "pos", "file_name", F.size("examples").alias("n"))


@golden("doc_id VARCHAR", [("one.json#0",), ("two.json#0",)])
def io2_head_limit(spark):
    """IO2: the first document of each file."""
    return benchmark.read_benchmark(spark, _benchmark(spark), 1).select("doc_id")


@golden("batch INTEGER, doc_id VARCHAR, hits BIGINT", [(0, "a", 1), (1, "b", 2), (1, "c", 3)])
def io3_record_sink(spark):
    """IO3: records flushed batch by batch; a batch that comes again replaces itself."""
    path = scratch(spark, "records")
    write = benchmark.record_sink(path)
    for batch, rows in ((0, [("a", 1)]), (1, [("b", 9)]), (1, [("b", 2), ("c", 3)])):
        write(spark.createDataFrame(rows, "doc_id string, hits long"), batch)
    return spark.read.schema("doc_id string, hits long, batch int").json(path).select("batch", "doc_id", "hits")


@golden("documents BIGINT, precision_rate DOUBLE, files BIGINT", [(3, 0.6667, 1)])
def io4_summary_sink(spark):
    """IO4: a summary as one file, read back."""
    path = scratch(spark, "summary")
    hits = spark.createDataFrame([(True, True, True), (True, True, False), (False, True, True)], "precision_hit boolean, location_hit boolean, diagnosis_hit boolean")
    benchmark.write_summary(metrics.corpus_rates(hits), path)
    one = spark.read.json(path).withColumn("file", F.input_file_name())
    return one.groupBy("documents", "precision_rate").agg(F.countDistinct("file").alias("files"))


@golden("doc_id VARCHAR, record_index INTEGER, example_count INTEGER", [(f"d{i}", i + 1, i % 3) for i in range(40)])
def io6_record_stats(spark):
    """IO6: records numbered in order of place, with their number of examples."""
    rows = [(f"d{i}", i, [("x",)] * (i % 3)) for i in reversed(range(40))]
    records = spark.createDataFrame(rows, "doc_id string, pos int, examples array<struct<e:string>>").repartition(5)
    return benchmark.with_stats(records).select("doc_id", "record_index", "example_count")


@golden("name VARCHAR, n INTEGER", [("a.pdf", 3), ("b.pdf", 1)])
def io8_file_scan(spark):
    """IO8: PDF files of a folder."""
    folder = _put(spark, scratch(spark, "scan"), {"b.pdf": b"y", "a.pdf": b"abc", "c.txt": b"x"})
    return files.scan(spark, folder).select(_name("path").alias("name"), F.length("content").alias("n"))


_PAGES = {"good": ["本标准规定甲", "[1] 范围\n甲用"], "bad": ["@@ ##", "@@"]}


def _pages(content: bytes) -> list[str]:
    return _PAGES[content.decode()]


def _parser(prompt: str) -> str:
    """A stub model that answers one section of its text, numbered by its first digit."""
    if "标准规定" not in prompt:
        raise TimeoutError
    return json.dumps([{"section_number": "1", "title": "范围", "content": prompt[prompt.index("\n") + 1 :][:6]}], ensure_ascii=False)


def _look(prompt: str, images: list[bytes]) -> str:
    return json.dumps([{"section_number": str(len(images)), "title": "图", "content": images[0].decode()}], ensure_ascii=False)


@golden("doc_id VARCHAR, ord INTEGER, section_number VARCHAR, title VARCHAR, content VARCHAR", [("bad.pdf", 0, "2", "图", "p1"), ("good.pdf", 0, "1", "范围", "本标准规定甲")])
def io9_pdf_routes(spark):
    """IO9, IO11: readable text to a model, the others' page images to one that sees."""
    folder = _put(spark, scratch(spark, "pdf"), {"good.pdf": b"good", "bad.pdf": b"bad"})
    made = files.sections_of_pdfs(files.scan(spark, folder), _pages, _parser, _look, lambda content: [b"p1", b"p2"])
    return made.withColumn("doc_id", _name("doc_id"))


@golden("doc_id VARCHAR, ord INTEGER, section_number VARCHAR, title VARCHAR, content VARCHAR", [("bad.pdf", 0, "1", "范围", "甲"), ("good.pdf", 0, "1", "范围", "本标准规定甲")])
def io12_ocr(spark):
    """IO12: unreadable files by OCR of their page images, then by patterns."""
    folder = _put(spark, scratch(spark, "pdf"), {"good.pdf": b"good", "bad.pdf": b"bad"})
    made = files.sections_of_pdfs(files.scan(spark, folder), _pages, _parser, None, lambda content: [b"1"], lambda image: "1 范围\n甲")
    return made.withColumn("doc_id", _name("doc_id"))


@golden("doc_id VARCHAR, ord INTEGER, section_number VARCHAR, title VARCHAR, content VARCHAR", [("d", 0, "1", "范围", "甲\n乙"), ("d", 1, "2", "要求", "丙")])
def io11_chunk_replies(spark):
    """IO11: sections of page chunks, one that goes on in the next chunk whole; a chunk whose call fails is left out."""
    texts = {"p0": [("1", "范围", "甲")], "p1": [("1", "范围", "乙"), ("2", "要求", "丙")]}

    def client(prompt: str) -> str:
        return json.dumps([dict(zip(("section_number", "title", "content"), x, strict=True)) for x in texts[prompt[-2:]]])

    chunks = spark.createDataFrame([("d", 0, "p0"), ("d", 1, "p1"), ("d", 2, "p2")], "doc_id string, chunk int, text string")
    return files.sections_of_chunks(chunks, client).select("doc_id", F.col("ord").cast("int").alias("ord"), "section_number", "title", "content")


@golden("height INTEGER, width INTEGER, first VARCHAR, last VARCHAR", [(5, 4, "10,20,30", "255,255,255")])
def io13_stitched_pages(spark):
    """IO13: page images one below the other on white."""
    a, b = np.full((2, 4, 3), (10, 20, 30), np.uint8), np.full((3, 2, 3), (1, 2, 3), np.uint8)
    whole = files.stitched([a, b])
    shown = lambda x: ",".join(map(str, x.tolist()))
    return spark.createDataFrame([(whole.shape[0], whole.shape[1], shown(whole[0, 0]), shown(whole[-1, -1]))], "height int, width int, first string, last string")


def _docx() -> bytes:
    out, w = io.BytesIO(), 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('前言')}{p('1 范围')}{p('甲')}<w:tbl><w:tr><w:tc>{p('格')}</w:tc></w:tr></w:tbl></w:body></w:document>")
        z.writestr("docProps/core.xml", '<c:p xmlns:c="c" xmlns:d="d"><d:title>题</d:title><d:creator>人</d:creator></c:p>')
    return out.getvalue()


@golden("name VARCHAR, value VARCHAR", [("creator", "人"), ("paragraphs", "3"), ("tables", "1"), ("title", "题")])
def io15_docx_properties(spark):
    """IO15: metadata of a DOCX file."""
    folder = _put(spark, scratch(spark, "docx"), {"a.docx": _docx()})
    return files.docx_properties(files.scan(spark, folder, "*.docx")).select("name", "value")


@golden('"table" INTEGER, "row" INTEGER, col INTEGER, text VARCHAR', [(0, 0, 0, "格")])
def io15_docx_cells(spark):
    """IO15: cells of a DOCX file's tables."""
    folder = _put(spark, scratch(spark, "docx"), {"a.docx": _docx()})
    return files.docx_cells(files.scan(spark, folder, "*.docx")).drop("doc_id")


def _blocks(content: bytes) -> list[tuple]:
    return [(0, t, 0.0, float(i), 9.0, float(i + 1), "F", 10.0) for i, t in enumerate(content.decode().split("|"))]


@golden("index INTEGER, text VARCHAR, y0 DOUBLE, section VARCHAR, section_title VARCHAR", [(0, "题", 0.0, "", ""), (1, "2.1 要求", 1.0, "2.1", "要求"), (2, "甲", 3.0, "2.1", "要求")])
def io16_pdf_blocks(spark):
    """IO16: text blocks of a PDF file with the section they stand in."""
    folder = _put(spark, scratch(spark, "pdf"), {"a.pdf": "题|2.1 要求| |甲".encode()})
    return files.pdf_blocks(files.scan(spark, folder), _blocks).select("index", "text", "y0", "section", "section_title")


@golden("doc_id VARCHAR, index INTEGER, text VARCHAR, section VARCHAR", [("a.DOCX", 0, "前言", ""), ("a.DOCX", 1, "1 范围", "1"), ("a.DOCX", 2, "甲", "1"), ("b.pdf", 0, "3 x", "3")])
def io17_format_dispatch(spark):
    """IO17: files of two formats by their suffix."""
    folder = _put(spark, scratch(spark, "mixed"), {"a.DOCX": _docx(), "b.pdf": b"3 x"})
    return files.load(spark, folder, _blocks).select(_name("doc_id").alias("doc_id"), "index", "text", "section")


@golden("id VARCHAR, text VARCHAR, dimension VARCHAR", [("a", "x", "C3.1"), ("rule_3", "y", None)])
def io18_rule_lines(spark):
    """IO18: rules of JSON lines; one without id is named after its line."""
    folder = _put(spark, scratch(spark, "rules"), {"r.jsonl": b'{"id":"a","text":" x ","metadata":{"dimension":"C3.1"}}\n\n{"text":"y"}\n'})
    return rules.read_rules(spark, f"{folder}/r.jsonl").select("id", "text", F.col("metadata")["dimension"].alias("dimension"))


@golden("doc_id VARCHAR, source_text VARCHAR", [("d1", "[1] 范围\n甲\n"), ("d2", "乙\n")])
def io20_text_files(spark):
    """IO20: a text file for each document, found again by its name."""
    path = scratch(spark, "texts")
    s = spark.createDataFrame([("d1", 0, "1", "范围", "甲"), ("d2", 0, None, "乙", "")], SECTION_ROWS)
    benchmark.write_texts(sections.section_text(s), path)
    return benchmark.read_texts(spark, path)


@golden("name VARCHAR, value VARCHAR", [("A", "x y"), ("B", '"z'), ("C", "1"), ("D", "")])
def io23_settings(spark):
    """IO23: settings of KEY=VALUE lines."""
    return spark.createDataFrame(list(config.parse_env("# c\nexport A = 'x y'\nB=\"z\nnone\n =q\nC= 1 \nD=\n").items()), "name string, value string")


def _models(url: str, headers: dict, body: bytes | None) -> bytes:
    if "down" in url:
        raise OSError
    return json.dumps({"data": [{"id": "y", "capabilities": {"chat": 1}}, {"id": "x", "capabilities": {"chat": True}}, {"id": "z"}]}).encode()


@golden("backend VARCHAR, model_id VARCHAR", [("a", "x"), ("a", "y")])
def io24_listed_models(spark):
    """IO24: models of services that can chat; a service that is down lists none."""
    return config.capable_models(clients.listed_models(spark, {"a": ("http://up", "k"), "b": ("http://down", "")}, _models), "chat").select("backend", "model_id")


@golden("doc_id VARCHAR, total_errors INTEGER, title VARCHAR, deleted BOOLEAN, what VARCHAR", [("d", 1, "范围", True, "E-S-01")])
def fj3_example_json(spark):
    """FJ3: sections and annotations as JSON, and read again."""
    kind = "struct<section_number:string,title:string,content:string>"
    a = spark.createDataFrame([("d", 0, "C2.1", "E-S-01", ("1", "范围", "甲"), None, "缺")], f"doc_id string, ord int, dimension string, error_type string, original {kind}, corrupted {kind}, error_description string")
    made = benchmark.example_json(a, spark.createDataFrame([("d", 0, "1", "范围", "甲")], SECTION_ROWS))
    at = lambda path: F.get_json_object("json", path)
    return made.select("doc_id", at("$.total_errors").cast("int").alias("total_errors"), at("$.corrupted_document[0].title").alias("title"), at("$.annotations[0].corrupted").isNull().alias("deleted"), at("$.annotations[0].error_type").alias("what"))


# Reviews by models

REVIEWED = "[2] 规范性引用文件\nGB/T 1\n[3] 术语和定义\n[3.1] 试样\n样品\n[5] 要求\n按 ISO 2，试样宜检查，应干燥。"


def _sections(spark: SparkSession) -> DataFrame:
    return sections.parse_sections(_documents(spark, REVIEWED))


@golden("rank INTEGER, section VARCHAR, line VARCHAR", [(1, "5", "[5] 要求\n按 ISO 2，试样宜检查，应干燥。"), (2, "2", "[2] 规范性引用文件\nGB/T 1")])
def jn20_evidence_sections(spark):
    """JN20: the sections that candidates name, each once, in their order."""
    found = spark.createDataFrame([("d1", 0, "[5]"), ("d1", 1, "9"), ("d1", 2, "2"), ("d1", 3, "5"), ("d1", 4, None)], "doc_id string, cand_index int, section_number string")
    return prompts.evidence_sections(found, _sections(spark)).select("rank", "section", "line")


_PROMPTS = [("direct", None, None, 1), *[(f"specialist_{d}", d, None, 1) for d in prompts.GUIDES], *[(f"type_{t}", d, t, 1) for d, t in prompts.TYPE_AGENTS], ("sentences", "C3.1", None, 1), ("term_index_model", "C3.2", None, 1)]


@golden("source_agent VARCHAR, dimension VARCHAR, error_type VARCHAR, n BIGINT, asks BOOLEAN", [(*x, True) for x in _PROMPTS])
def lm2_prompts(spark):
    """LM1 to LM5: what the reviewers of a document are asked, and that each prompt holds what it is about."""
    docs, s = _documents(spark, REVIEWED), _sections(spark)
    made = [prompts.direct_prompts(docs), prompts.specialist_prompts(docs, s), prompts.error_type_prompts(docs, s), prompts.sentence_prompts(s), prompts.term_index_prompts(s)]
    asks = F.col("prompt").contains("试样") & F.col("system").contains("JSON") & (F.col("dimension").isNull() | F.col("system").rlike("C[23]|E-T")) & (F.col("error_type").isNull() | F.contains("system", "error_type"))
    return reduce(DataFrame.unionByName, made).groupBy("source_agent", "dimension", "error_type").agg(F.count(F.lit(1)).alias("n"), F.bool_and(asks).alias("asks"))


def _reviewer(prompt: str, system: str | None = None) -> str:
    """A stub model: the structure's reviewer fails, the sentences' finds one, all others find one of another dimension."""
    if "C2.1（" in system:
        raise TimeoutError
    if "逐句" in system:
        return json.dumps([{"error_type": "E-T-02", "dimension": "C3.1", "section_number": "5", "reason": "宜"}, {"error_type": "E-S-01", "dimension": "C2.1", "section_number": "5"}])
    return json.dumps([{"error_type": "E-SC-03", "dimension": "C2.2", "section_number": "5", "reason": "要求"}])


@golden("source_agent VARCHAR, error_type VARCHAR, section_number VARCHAR", [("direct", "E-SC-03", "5"), ("sentences", "E-T-01", "5"), ("sentences", "E-T-02", "5"), ("sentences", "E-T-07", "5"), ("reference_rules", "E-R-01", "5"), ("reference_rules", "E-R-02", "2")])
def lm9_agentic_review(spark):
    """LM9: the whole review with a stub model; findings of a wrong dimension and failed calls do not count."""
    return prompts.agentic_review(_documents(spark, REVIEWED), _reviewer).select("source_agent", "error_type", "section_number")


@golden("step VARCHAR, error_type VARCHAR, section_number VARCHAR", [("verify", "E-T-02", "5"), ("critic", "E-T-02", "5"), ("arbiter", "E-T-01", "5"), ("arbiter", "E-T-02", "5"), ("formatter", "E-T-02", "5")])
def lm6_later_steps(spark):
    """LM6, LM7: candidates after each later step; those of a failed one stay."""
    docs, s = _documents(spark, REVIEWED), _sections(spark)
    found = spark.createDataFrame([("d1", 0, "E-T-02", "C3.1", "5", "r", "e"), ("d1", 1, "E-T-01", "C3.1", "5", "r", "e")], "doc_id string, cand_index int, error_type string, dimension string, section_number string, reason string, error_description string")

    def client(prompt: str, system: str) -> str:
        if "裁决" in system:
            raise TimeoutError
        one = {"error_type": "E-T-02", "dimension": "C3.1", "section_number": "5", "reason": "r", "error_description": "e"}
        return json.dumps([one] * (2 if "整理" in system else 1)) if "E-T-01" in prompt else "[]"

    made = [prompts.step_answers(x, review.asked(prompts.step_prompts(x, docs, found, s), client), found).select(F.lit(x).alias("step"), "error_type", "section_number") for x in ("verify", "critic", "arbiter", "formatter")]
    return reduce(DataFrame.unionByName, made)


@golden("doc_id VARCHAR, is_best BOOLEAN, feedback VARCHAR, dims VARCHAR", [("a", True, "好", "C2.1"), ("b", False, "", ""), ("c", False, "", "")])
def lm7_verdicts(spark):
    """LM7: judgements; other replies than objects judge no."""
    d = spark.createDataFrame([("a", '{"is_best": true, "reason": "好", "suggested_dimensions": ["C2.1", "C9"]}'), ("b", "[1]"), ("c", None)], "doc_id string, reply string")
    return prompts.verdicts(d).select("doc_id", "is_best", "feedback", F.array_join("suggested_dimensions", ",").alias("dims"))


def _service(url: str, headers: dict, body: bytes | None) -> bytes:
    """A stub service: echoes chats, calls a tool once, embeds by length."""
    asked = json.loads(body)
    if url.endswith("/embeddings"):
        return json.dumps({"data": [{"index": i, "embedding": [len(x), 1.0]} for i, x in reversed(list(enumerate(asked["input"])))]}).encode()
    last = asked["messages"][-1]
    said = {"content": f"{len(asked['messages'])}:{last['content'] if isinstance(last['content'], str) else len(last['content'])}"}
    if "tools" in asked and last["role"] == "user":
        said = {"tool_calls": [{"id": "1", "function": {"name": "f", "arguments": "{}"}}]}
    return json.dumps({"choices": [{"message": said}]}).encode()


@golden("name VARCHAR, reply VARCHAR", [("chat", "2:甲"), ("look", "1:3"), ("tools", "4:f{}")])
def lm10_clients(spark):
    """LM10: chat, images and tools of a model service."""
    made = [("chat", clients.chat("http://m", "x", post=_service)("甲", "系")), ("look", clients.look("http://m", "x", post=_service)("甲", [b"1", b"2"])), ("tools", clients.chat_with_tools("http://m", "x", review.tool_schemas("C2.1"), lambda n, a: n + a, post=_service)("甲", "系"))]
    return spark.createDataFrame(made, "name string, reply string")


@golden("i INTEGER, first DOUBLE", [(i, float(i)) for i in range(5)])
def lm11_embedded(spark):
    """LM11: texts with embeddings of a model service, two at a time."""
    d = spark.createDataFrame([(i, "x" * i) for i in range(5)], "i int, text string")
    return clients.embedded(d, "http://m", "x", post=_service, size=2).select("i", F.col("embedding")[0].cast("double").alias("first"))


# Plug-ins


@golden("dimension VARCHAR, name VARCHAR", [("C2.1", n) for n in review.STRUCTURE_TOOLS])
def ud2_tool_schemas(spark):
    """UD2: tools of each dimension's reviewer; only the structure has any."""
    return spark.createDataFrame([(d, t["function"]["name"]) for d in prompts.GUIDES for t in review.tool_schemas(d)], "dimension string, name string")


class _WordReviewer(review.ReviewerBase):
    reviewer_id = "words"

    def review(self, sections_: DataFrame) -> DataFrame:
        return sections_.where(F.contains("content", F.lit("宜"))).select("doc_id", F.lit("E-T-02").alias("error_type"), F.lit("C3.1").alias("dimension"), "section_number", F.lit("r").alias("reason"), F.lit("e").alias("error_description"))


@golden("reviewer_id VARCHAR, total_issues BIGINT, kinds VARCHAR, section_number VARCHAR", [("words", 1, "E-T-02=1", "5")])
def ud3_reviewer(spark):
    """UD3: a reviewer of one's own, with its summary."""
    found, summary = _WordReviewer().reviewed(_sections(spark))
    kinds = F.array_join(F.transform(F.map_entries("by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return summary.select("reviewer_id", "total_issues", kinds.alias("kinds")).join(found.select("reviewer_id", "section_number"), "reviewer_id")


@golden("doc_id VARCHAR, content VARCHAR", [("a", "宜甲"), ("b", "可甲"), ("c", "应甲")])
def ud4_generators(spark):
    """UD4: each document through the generator that is chosen for it; one without a choice stays."""
    s = spark.createDataFrame([(d, 0, "5", "甲", "应甲") for d in "abc"], SECTION_ROWS)
    choices = spark.createDataFrame([("a", "E-T-01"), ("b", "E-T-03")], "doc_id string, error_type string")
    return injectors.inject(s, choices, 1).sections.select("doc_id", "content")


@golden("doc_id VARCHAR, page INTEGER, text VARCHAR", [("a.pdf", 0, "甲"), ("a.pdf", 1, "乙")])
def ud5_parser(spark):
    """UD5: a parser of one's own: page texts by a function of a file's bytes."""
    folder = _put(spark, scratch(spark, "pdf"), {"a.pdf": "甲|乙".encode()})
    return files.page_texts(files.scan(spark, folder), lambda content: content.decode().split("|")).withColumn("doc_id", _name("doc_id"))


@golden("doc_id VARCHAR, reply VARCHAR, failed BOOLEAN", [("a", "x!", False), ("b", None, True), ("c", "", False)])
def ud6_client(spark):
    """UD6: a client of one's own; a failed call is told apart from an empty answer."""

    def client(prompt: str) -> str:
        if prompt == "bad":
            raise OSError
        return prompt and prompt + "!"

    return review.asked(spark.createDataFrame([("a", "x"), ("b", "bad"), ("c", "")], "doc_id string, prompt string"), client)
