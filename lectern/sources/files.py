"""Document files: PDF, DOCX, Markdown and page text as section rows."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import replies
from lectern.operators import review
from lectern.operators.scans import in_parts
from lectern.operators.sections import NUMBERED_HEADING, PLAIN_HEADING, carried, continued, is_noise, islands, preprocessed, split_nested, without_contents_table
from lectern.operators.storage import stored

# Words of which a readable first part of a standard holds one.
READABLE = ["前言", "引言", "范围", "规范性", "标准", "要求", "术语"]
#: Files whose rows leave a task at once.
FILES = 32
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def scan(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files of a folder, or one file: path and content, in order of path where that matters."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def file_format(path: Column) -> Column:
    """docx or pdf; other suffixes raise an error."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))
    return F.when(suffix.isin("docx", "pdf"), suffix).otherwise(F.raise_error(F.concat(F.lit("unsupported file: "), path)).cast("string"))


def is_garbled(sample: Column) -> Column:
    """Whether none of the expected words is in the text of the first pages."""
    return ~F.coalesce(sample, F.lit("")).rlike("|".join(READABLE))


def strategy(text: Column, has_model: bool) -> Column:
    """How a PDF is parsed: by its text layer or its images with a model, else by patterns."""
    if not has_model:
        return F.lit("regex")
    return F.when(is_garbled(text), "vision").otherwise("text")


def page_texts(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """doc_id, page and text of each page, by a function of a file's bytes that the caller brings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i, t) for p, c in zip(b["path"], b["content"], strict=True) for i, t in enumerate(extract(bytes(c)))]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text"])

    return files.mapInPandas(run, "doc_id string, page int, text string")


def sections_of_pages(pages: DataFrame) -> DataFrame:
    """Sections of page texts by patterns: furniture and contents table dropped, cut at headings."""
    rows = F.array_sort(F.collect_list(F.struct("page", "text")))
    docs = pages.groupBy("doc_id").agg(preprocessed(F.array_join(F.transform(rows, lambda r: r["text"]), "\n")).alias("text"))
    line = in_parts(docs, "text", "\n").where(~is_noise(F.col("line")))
    line = without_contents_table(line)
    number, title = (F.regexp_extract("line", NUMBERED_HEADING, i) for i in (1, 2))
    row = line.withColumns({"number": number, "title": F.trim(title), "head": (number != "") | F.col("line").rlike(PLAIN_HEADING)})
    row = islands(row, F.col("head"))
    head = F.max(F.when(F.col("head"), F.struct("number", "title", "line"))).alias("h")
    body = F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line"))))
    made = row.groupBy("doc_id", "sid").agg(head, F.array_join(F.transform(body, lambda r: r["line"]), "\n").alias("content"))
    bare = F.when(F.col("h.number") != "", F.col("h.title")).otherwise(F.col("h.line"))
    return made.select("doc_id", (F.col("sid") - 1).cast("int").alias("ord"), F.nullif("h.number", F.lit("")).alias("section_number"), bare.alias("title"), "content")


def sections_of_markdown(docs: DataFrame, text: str = "markdown") -> DataFrame:
    """Sections of Markdown: # headings, with a leading number as the section number; nested numbers split."""
    line = in_parts(docs, text, "\n")
    row = islands(line.withColumn("head", F.col("line").rlike(r"^#{1,6}\s+\S")), F.col("head"))
    title = F.trim(F.regexp_replace(F.max(F.when(F.col("head"), F.col("line"))), r"^#{1,6}\s+", ""))
    body = F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line"))))
    made = row.groupBy("doc_id", "sid").agg(title.alias("t"), F.trim(F.array_join(F.transform(body, lambda r: r["line"]), "\n")).alias("content"))
    number = F.regexp_extract("t", r"^(\d+(?:\.\d+)*|附录[A-Z])\s*", 1)
    found = made.select("doc_id", (F.col("sid") - 1).cast("int").alias("ord"), F.nullif(number, F.lit("")).alias("section_number"), F.trim(F.regexp_replace("t", r"^(?:\d+(?:\.\d+)*|附录[A-Z])\s*", "")).alias("title"), "content")
    return split_nested(found)


def _paragraphs(content: bytes) -> list[tuple]:
    """(index, text, style, font, size, bold, italic) of a DOCX body's paragraphs."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    rows = []
    for i, p in enumerate(body.findall(f"{_W}p")):
        style, props = p.find(f"{_W}pPr/{_W}pStyle"), p.find(f"{_W}r/{_W}rPr")
        value = lambda tag, attr="val": None if props is None or (x := props.find(f"{_W}{tag}")) is None else x.get(f"{_W}{attr}", "true")  # noqa: B023, E731
        text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
        rows.append((i, text, style.get(f"{_W}val") if style is not None else "", value("rFonts", "ascii") or "", float(value("sz") or 0) / 2, value("b") not in (None, "0", "false"), value("i") not in (None, "0", "false")))
    return rows


def _cells(content: bytes) -> list[tuple]:
    """(table, row, col, text) of a DOCX body's table cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    return [(n, i, j, "".join(t.text or "" for t in c.iter(f"{_W}t")).strip()) for n, table in enumerate(body.iter(f"{_W}tbl")) for i, r in enumerate(table.findall(f"{_W}tr")) for j, c in enumerate(r.findall(f"{_W}tc"))]


def _by_file(files: DataFrame, read: Callable[[bytes], list[tuple]], columns: str) -> DataFrame:
    """Rows that read finds in each file (path, content), with its path as doc_id; those of FILES files leave at once."""
    fields = [("doc_id", "string"), *(c.split() for c in columns.split(", "))]
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), FILES):
                part = b.slice(at, FILES)
                rows = [(p.as_py(), *r) for p, c in zip(part.column("path"), part.column("content"), strict=True) for r in read(c.as_py())]
                yield pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return files.select("path", "content").mapInArrow(run, f"doc_id string, {columns}")


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """Paragraphs of DOCX files, each with the number and title of the section it stands in."""
    rows = _by_file(files, _paragraphs, "index int, text string, style string, font_name string, font_size double, is_bold boolean, is_italic boolean")
    return in_sections(rows)


def in_sections(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, index, text) with the number and title of the last numbered heading up to each."""
    number, title = (F.nullif(F.regexp_extract("text", r"^(\d+(?:\.\d+)*)\s+(.+)$", i), F.lit("")) for i in (1, 2))
    marked = rows.withColumns({"n": number, "t": F.when(number.isNotNull(), title)})
    return marked.withColumns({"section": F.coalesce(carried("n", ["doc_id"], ["index"]), F.lit("")), "section_title": F.coalesce(carried("t", ["doc_id"], ["index"]), F.lit(""))}).drop("n", "t")


def docx_cells(files: DataFrame) -> DataFrame:
    """Cells of DOCX tables in long form."""
    return _by_file(files, _cells, "table int, row int, col int, text string")


def stitched(pages: list[np.ndarray]) -> np.ndarray:
    """Page images (height, width, 3; bytes) one below the other, on white; a single white point for none."""
    whole = np.full((max(1, sum(len(x) for x in pages)), max([1, *(x.shape[1] for x in pages)]), 3), 255, np.uint8)
    y = 0
    for x in pages:
        whole[y : y + len(x), : x.shape[1]] = x
        y += len(x)
    return whole


def page_chunks(pages: DataFrame, size: int) -> DataFrame:
    """Pages in chunks of size, for models that read a few at a time: doc_id, chunk, text."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) - 1
    rows = pages.withColumn("chunk", F.floor(nth / size).cast("int"))
    return rows.groupBy("doc_id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda r: r["text"]), "\n").alias("text"))


def sections_of_pdfs(files: DataFrame, extract: Callable[[bytes], list[str]], client: Callable[..., str] | None = None, look: Callable[[str, list[bytes]], str] | None = None, render: Callable[[bytes], list[bytes]] | None = None, ocr: Callable[[bytes], str] | None = None, chunk: int = 5) -> DataFrame:
    """Sections of PDF files (path, content) by the route that fits each: doc_id, ord, section_number, title, content.

    extract gives a file's page texts. Without client: patterns. With one, readable text goes to it, chunk
    pages at a time; the pages of unreadable files are rendered to images for look, or read by ocr and parsed
    by patterns where there is no look. Repeated sections at chunk borders merge; files whose calls all fail
    have no rows.
    """
    pages = page_texts(files, extract)
    sample = pages.where("page < 3").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda r: r["text"]), "\n").alias("sample"))
    route = stored(sample.select("doc_id", strategy(F.col("sample"), client is not None).alias("route")), "routes")
    by = lambda name: pages.join(route.where(F.col("route") == name).select("doc_id"), "doc_id", "left_semi")
    made = [sections_of_pages(by("regex"))]
    if client is not None:
        made.append(sections_of_chunks(page_chunks(by("text"), chunk), client))
        unread = files.join(route.where("route = 'vision'").select(F.col("doc_id").alias("path")), "path", "left_semi")
        if render is not None and look is not None:
            made.append(sections_of_images(unread, render, look, chunk))
        elif render is not None and ocr is not None:
            made.append(sections_of_pages(page_texts(unread, lambda content: [ocr(image) for image in render(content)])))
    return reduce(DataFrame.unionByName, [m.select("doc_id", F.col("ord").cast("int").alias("ord"), "section_number", "title", "content") for m in made])


_SPLIT = "把下面的标准文本按章节切分，只返回 JSON 数组，元素含 section_number（无编号为 null）、title、content，正文保持原样。\n"


def _of_replies(replied: DataFrame) -> DataFrame:
    rows = replied.where(~F.col("failed")).select("doc_id", "chunk", F.posexplode(replies.section_rows(F.col("reply"))).alias("ord", "s"))
    return continued(rows.select("doc_id", "chunk", "ord", "s.*"))


def sections_of_chunks(chunks: DataFrame, client: Callable[..., str]) -> DataFrame:
    """Sections that a model finds in chunks (doc_id, chunk, text), merged at chunk borders."""
    return _of_replies(stored(review.asked(chunks.select("doc_id", "chunk", F.concat(F.lit(_SPLIT), "text").alias("prompt")), client), "parsed-chunks"))


def sections_of_images(files: DataFrame, render: Callable[[bytes], list[bytes]], look: Callable[[str, list[bytes]], str], chunk: int) -> DataFrame:
    """Sections that a model reads off page images, chunk pages at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                images = render(bytes(content))
                for n, at in enumerate(range(0, len(images), chunk)):
                    try:
                        reply, failed = look(_SPLIT, images[at : at + chunk]), False
                    except Exception:  # noqa: BLE001  any failure of a service is no answer
                        reply, failed = None, True
                    yield pd.DataFrame({"doc_id": [path], "chunk": [n], "reply": [reply], "failed": [failed]})

    return _of_replies(stored(files.mapInPandas(run, "doc_id string, chunk int, reply string, failed boolean"), "read-images"))


def pdf_blocks(files: DataFrame, blocks: Callable[[bytes], list[tuple]]) -> DataFrame:
    """Text blocks of PDF files, each with the section it stands in.

    blocks gives a file's (page, text, x0, y0, x1, y1, font_name, font_size) in reading order. Blank blocks fall away.
    """
    rows = _by_file(files, lambda content: [(i, *x) for i, x in enumerate(y for y in blocks(content) if (y[1] or "").strip())], "index int, page int, text string, x0 double, y0 double, x1 double, y1 double, font_name string, font_size double")
    return in_sections(rows.withColumn("text", F.trim("text")))


def _properties(content: bytes) -> list[tuple]:
    """(name, value) of a DOCX file's core properties and the number of its paragraphs and tables."""
    found = {"paragraphs": str(len(_paragraphs(content)))}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        found["tables"] = str(len(body.findall(f"{_W}tbl")))
        if "docProps/core.xml" in z.namelist():
            found |= {x.tag.rpartition("}")[2]: (x.text or "").strip() for x in ET.fromstring(z.read("docProps/core.xml"))}
    return sorted(found.items())


def docx_properties(files: DataFrame) -> DataFrame:
    """Core properties of DOCX files in long form: doc_id, name, value."""
    return _by_file(files, _properties, "name string, value string")


def load(spark: SparkSession, path: str, blocks: Callable[[bytes], list[tuple]] | None = None) -> DataFrame:
    """Paragraphs or blocks of all files of a folder by their suffix: doc_id, index, text, section, section_title.

    .docx and .pdf in any case; others fail the query. PDF needs blocks (see pdf_blocks).
    """
    found = scan(spark, path, "*").withColumn("format", file_format(F.col("path")))
    docs = stored(found, "loaded", by="format")
    columns = ["doc_id", "index", "text", "section", "section_title"]
    made = docx_paragraphs(docs.where("format = 'docx'")).select(*columns)
    pdf = docs.where("format = 'pdf'")
    if blocks is None:
        return made.unionByName(pdf.select(F.raise_error(F.lit("PDF files need a function of their blocks")).cast("string").alias("doc_id"), F.lit(0).alias("index"), F.lit("").alias("text"), F.lit("").alias("section"), F.lit("").alias("section_title")))
    return made.unionByName(pdf_blocks(pdf, blocks).select(*columns))
