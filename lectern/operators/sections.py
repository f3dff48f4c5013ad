"""Documents as ordered section rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import WS, joined_numbers, label, trimmed
from lectern.operators.scans import ADDED, LATEST, in_parts, scanned
from lectern.taxonomy import PLAIN_HEADINGS, TOOL_HEADINGS

#: Line ends as text tools see them.
# Titles of general sections; page numbers.
GENERAL_TITLES = ["范围", "前言", "引言", "目录", "目次", "规范性引用文件", "术语和定义", "参考文献", "索引"]
PAGE = "^[0-9IVXLCDMⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
NUMBERED = r"^\[([^\]]+)\]" + WS + r"*(.*)$"
# Lines that are page furniture, and forms of headings.
NOISE = r"^\d{1,4}$|^(?:GB/?T\s*\d+(?:\.\d+)?(?:[-—]\d{4})?|ICS\s+\S+|CCS\s+.+)\s*$|版权|©|All rights reserved"
NUMBERED_HEADING = r"^(\d{1,2}(?:\.\d{1,2})*)" + WS + r"+([\x{4e00}-\x{9fff}A-Za-z].{0,60})$"
NESTED_HEADING = r"^(\d{1,2}(?:\.\d{1,2})+)" + WS + r"+[\x{4e00}-\x{9fff}A-Za-z（(].{0,80}$"
PLAIN_HEADING = f"^(前{WS}*言|引{WS}*言|参{WS}*考{WS}*文{WS}*献|索{WS}*引|附{WS}*录{WS}*[A-Z].{{0,30}})$"
CONTENTS_LINE = r"[…\.]{3,}" + WS + r"*\d+" + WS + r"*$"


def lines(docs: DataFrame, text: str = "source_text") -> DataFrame:
    """doc_id, pos and line of each line of a text, in parts that scans can take one by one."""
    return in_parts(docs, text, LINE_END)


def islands(rows: DataFrame, is_start: Column, order: str = "pos") -> DataFrame:
    """Rows from the first start on, with the number of their start (sid); a document in parts is scanned in parts."""
    if "_part" in rows.columns:
        return scanned(rows, order, sid=(ADDED, is_start.cast("int"))).where("sid > 0")
    sid = F.sum(is_start.cast("int")).over(Window.partitionBy("doc_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("sid", sid).where("sid > 0")


def parse_sections(docs: DataFrame, text: str = "source_text") -> DataFrame:
    """Sections of [number] title texts: doc_id, ord, section_number, title, content.

    A heading opens a section; lines before the first fall away; content is joined and trimmed.
    """
    row = lines(docs, text)
    row = row.withColumn("bare", trimmed(F.col("line")))
    numbered, plain = F.col("bare").rlike(NUMBERED), F.col("bare").isin(PLAIN_HEADINGS)
    marked = islands(row.withColumn("head", numbered | plain), F.col("head"))
    head = F.max_by("bare", F.col("head").cast("int"))
    body = F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line"))))
    found = marked.groupBy("doc_id", "sid").agg(head.alias("bare"), F.array_join(F.transform(body, lambda r: r["line"]), "\n").alias("content"))
    is_numbered = F.col("bare").rlike(NUMBERED)
    return found.select(
        "doc_id", (F.col("sid") - 1).cast("int").alias("ord"), F.when(is_numbered, trimmed(F.regexp_extract("bare", NUMBERED, 1))).alias("section_number"),
        F.when(is_numbered, trimmed(F.regexp_extract("bare", NUMBERED, 2))).otherwise(F.col("bare")).alias("title"), trimmed(F.col("content")).alias("content"),
    )


def tool_headings(docs: DataFrame, text: str = "source_text") -> DataFrame:
    """Headings as the rule tools list them: all bracketed ones with a space after them, then the plain ones."""
    row = lines(docs, text)
    bracketed = row.where(F.col("line").rlike(r"^\[[^\]]+\]" + WS + r"+\S")).select("doc_id", "pos", F.lit(0).alias("kind"), F.regexp_extract("line", r"^\[([^\]]+)\]", 1).alias("section_number"), trimmed(F.regexp_extract("line", r"^\[[^\]]+\]" + WS + r"+(.+)$", 1)).alias("title"))
    bare = trimmed(F.col("line"))
    plain = row.where(bare.isin(TOOL_HEADINGS)).select("doc_id", "pos", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("section_number"), F.replace(bare, F.lit("  "), F.lit("")).alias("title"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("kind", "pos")) - 1
    return bracketed.unionByName(plain).select("doc_id", order.alias("ord"), "section_number", "title")


def split_nested(sections: DataFrame) -> DataFrame:
    """Sections with the subsections that stand in their content cut out as sections of their own.

    A line "5.1 Title" opens one if its number lies under the section's own, any number where that has none. The
    section itself stays with what stands before the first, which may be nothing.
    """
    under = F.coalesce("section_number", F.lit(""))
    rows = F.concat(F.array(F.lit("")), F.split(F.coalesce("content", F.lit("")), "\n"))  # an empty line keeps a section whose content begins with a subsection
    row = sections.select("doc_id", "ord", "section_number", "title", F.posexplode(rows).alias("pos", "line"))
    number = F.regexp_extract(trimmed(F.col("line")), NESTED_HEADING, 1)
    row = row.withColumn("sub", F.when((number != "") & ((under == "") | number.startswith(F.concat(under, F.lit(".")))), number))
    sid = F.sum(F.col("sub").isNotNull().cast("int")).over(Window.partitionBy("doc_id", "ord").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    parts = row.withColumn("sid", sid).groupBy("doc_id", "ord", "sid", "section_number", "title").agg(
        F.max("sub").alias("sub"), F.min_by("line", "pos").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("sub").isNull(), F.struct("pos", "line")))), lambda r: r["line"]), "\n").alias("content")
    )
    title = trimmed(F.regexp_replace("first", f"^{WS}*[\\d.]+{WS}+", ""))
    made = parts.select("doc_id", "ord", "sid", F.coalesce("sub", "section_number").alias("section_number"), F.when(F.col("sub").isNull(), F.col("title")).otherwise(title).alias("title"), trimmed(F.col("content")).alias("content"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "sid")) - 1
    return made.select("doc_id", order.alias("ord"), "section_number", "title", "content")


def is_noise(line: Column) -> Column:
    bare = trimmed(line)
    return (bare == "") | bare.rlike(NOISE)


def preprocessed(text: Column) -> Column:
    """Text with broken numbers repaired, lines trimmed and page furniture dropped."""
    return F.array_join(F.filter(F.transform(F.split(joined_numbers(text), "\n"), trimmed), lambda x: ~is_noise(x)), "\n")


def heading_kind(line: Column) -> Column:
    """numbered, appendix, bracket, markdown or plain heading; null for body text."""
    bare = trimmed(line)
    return (
        F.when(bare.rlike(r"^#{1,6}\s+\S"), "markdown").when(bare.rlike(r"^\[[^\]]+\]"), "bracket").when(bare.rlike(f"^附{WS}*录{WS}*[A-Z]"), "appendix")
        .when(bare.rlike(NUMBERED_HEADING), "numbered").when(bare.rlike(PLAIN_HEADING), "plain")
    )


def without_contents_table(rows: DataFrame) -> DataFrame:
    """Lines (of lines()) without those that lead to a page, and those from a contents heading up to the next other heading."""
    bare = trimmed(F.col("line"))
    starts, leads = bare.rlike(f"^目{WS}*次$"), bare.rlike(CONTENTS_LINE)
    heads = (bare.rlike(NUMBERED_HEADING) | bare.rlike(PLAIN_HEADING)) & ~leads
    state = scanned(rows, "pos", skipping=(LATEST, F.when(starts, True).when(heads, False)))
    return state.where(~(starts | leads | F.coalesce("skipping", F.lit(False)))).drop("skipping")


def top_blocks(sections: DataFrame) -> DataFrame:
    """Runs that begin with a top-level number: doc_id, block, number, first and last place, whether any has a body."""
    top = (F.coalesce("section_number", F.lit("")) != "") & ~F.contains("section_number", F.lit("."))
    row = islands(sections.withColumn("top", top), F.col("top"), "ord")
    return row.groupBy("doc_id", F.col("sid").alias("block")).agg(F.min_by("section_number", "ord").alias("number"), F.min("ord").alias("first"), F.max("ord").alias("last"), F.bool_or(is_body(F.col("content"))).alias("is_body"))


def contents_block(blocks: DataFrame) -> DataFrame:
    """For each body block the latest earlier block of the same number that has no body (an as-of match)."""
    before = Window.partitionBy("doc_id", "number").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("contents_first", F.max(F.when(~F.col("is_body"), F.col("first"))).over(before)).where("is_body").select("doc_id", "number", "first", "contents_first")


def has_text(content: Column) -> Column:
    """More than blanks, a bare none, continuation marks and dots."""
    bare = trimmed(F.coalesce(content, F.lit("")))
    return (bare != "") & (F.lower(bare) != "none") & (F.regexp_replace(F.replace(bare, F.lit("[续]"), F.lit("")), f"[…．。]|{WS}", "") != "")


def has_real_text(content: Column) -> Column:
    """More than white space around dots and leaders."""
    return trimmed(F.coalesce(content, F.lit(""))).rlike("[^…．。 \\t\\n]")


def is_body(content: Column) -> Column:
    """Text of a body: has_text, and neither leaders nor a page number alone."""
    bare = trimmed(F.coalesce(content, F.lit("")))
    return has_text(content) & ~bare.rlike(r"^[.…·•\-—\s]+$") & ~bare.rlike(PAGE + "$")


def is_scope_body(content: Column) -> Column:
    """As is_body, and no page number behind leaders."""
    return is_body(content) & ~trimmed(F.coalesce(content, F.lit(""))).rlike(r"^[.…·•\-—\s]*" + PAGE[1:] + "$")


def is_top_level(number: Column) -> Column:
    return (F.coalesce(number, F.lit("")) != "") & ~F.contains(F.coalesce(number, F.lit("")), F.lit("."))


def bare_title(title: Column) -> Column:
    return F.regexp_replace(F.coalesce(title, F.lit("")), f"{WS}+", "")


def scope_section(sections: DataFrame) -> DataFrame:
    """By document the first scope section with a body."""
    return first_match(sections, (bare_title(F.col("title")) == "范围") & is_scope_body(F.col("content")))


def term_section(sections: DataFrame) -> DataFrame:
    """By document the first section on terms with text."""
    return first_match(sections, F.coalesce("title", F.lit("")).contains("术语") & has_text(F.col("content")))


def body_sections(sections: DataFrame, least: int = 30) -> DataFrame:
    """Titled sections with more than least code points, but for the term section."""
    terms = term_section(sections).select("doc_id", F.col("ord").alias("term_ord"))
    rows = sections.where((F.coalesce("title", F.lit("")) != "") & (F.length(F.coalesce("content", F.lit(""))) > least)).join(terms, "doc_id", "left")
    return rows.where("term_ord is null or ord <> term_ord").drop("term_ord")


def technical_sections(sections: DataFrame) -> DataFrame:
    """Numbered sections with a body whose title is none of the general ones."""
    return sections.where(F.coalesce("section_number", F.lit("")).rlike(r"^\d") & is_scope_body(F.col("content")) & ~bare_title(F.col("title")).isin(GENERAL_TITLES))


def first_difference(a: Column, b: Column) -> Column:
    """Place, from 0, of the first code point in which two texts differ within their common length; 0 without one.

    Common prefixes are compared by halving steps, so the work is that of comparing the texts some thirty times.
    """
    n = F.least(F.length(a), F.length(b))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(30))])
    same = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.substr(a, F.lit(1), at + step) == F.substr(b, F.lit(1), at + step)), at + step).otherwise(at))
    return F.coalesce(F.when(same < n, same), F.lit(0))


def carried(column: str, partition: list[str], order: list[str]) -> Column:
    """The last value up to a row that is not null."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def continued(chunks: DataFrame) -> DataFrame:
    """Sections of page chunks, one that a chunk's start repeats from the end of the one before merged with it."""
    order = Window.partitionBy("doc_id").orderBy("chunk", "ord")
    same = (F.lag("chunk").over(order) < F.col("chunk")) & F.lag("section_number").over(order).eqNullSafe(F.col("section_number")) & (F.lag("title").over(order) == F.col("title"))
    sid = F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    row = chunks.withColumn("same", F.coalesce(same, F.lit(False))).withColumn("sid", sid)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ord", "content"))), lambda r: r["content"]), "\n")
    return row.groupBy("doc_id", "sid").agg(F.min_by("section_number", F.struct("chunk", "ord")).alias("section_number"), F.min_by("title", F.struct("chunk", "ord")).alias("title"), text.alias("content")).select("doc_id", (F.col("sid") - 1).cast("int").alias("ord"), "section_number", "title", "content")


def ordered_concat(rows: DataFrame, by: str, order: list[str], part: Column, mark: str, name: str) -> DataFrame:
    """By group its parts in order, joined by mark."""
    sorted_ = F.array_sort(F.collect_list(F.struct(*order, part.alias("_part"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(sorted_, lambda r: r["_part"]), mark).alias(name))


def section_text(sections: DataFrame) -> DataFrame:
    """By document the text of its sections: heading, content, blank line."""
    part = F.concat(label(F.col("section_number"), F.col("title")), F.lit("\n"), F.when(F.coalesce("content", F.lit("")) != "", F.concat("content", F.lit("\n"))).otherwise(""))
    return ordered_concat(sections, "doc_id", ["ord"], part, "\n", "source_text")


def batches(rows: DataFrame, by: str, order: list[str], size: int) -> DataFrame:
    """Rows of each group with rank (from 1, in order) and the batch of size that it falls into."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("rank", rank).withColumn("batch", batch_number(F.col("rank"), size))


def batch_number(rank: Column, size: int) -> Column:
    return F.floor((rank - 1) / size).cast("int")


def first_match(sections: DataFrame, condition: Column) -> DataFrame:
    """By document the first section that meets a condition."""
    return sections.where(condition).groupBy("doc_id").agg(F.min(F.struct("ord", "section_number", "title", "content")).alias("s")).select("doc_id", "s.*")


def budgeted(sections: DataFrame, limit: int = 6000) -> DataFrame:
    """Leading sections whose contents have limit code points together; the first that would pass it ends the run."""
    run = F.sum(F.length(F.coalesce("content", F.lit("")))).over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return sections.withColumn("running", run).where(F.col("running") <= limit)


def sentence_parts(text: Column, limit: int) -> Column:
    """Trimmed sentences of a text with their end marks; longer ones cut at limit."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[。！？.!?；;])"), trimmed), lambda s: s != "")
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / limit).cast("int")), lambda i: F.substr(s, i * limit + 1, F.lit(limit)))
    return F.flatten(F.transform(parts, cut))


def packed_sentences(parts: Column, limit: int) -> Column:
    """Sentences joined greedily into chunks of at most limit code points."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    add = lambda acc, s: F.when((acc["open"] == "") | (F.length(acc["open"]) + F.length(s) <= limit), F.struct(acc["done"].alias("done"), F.concat(acc["open"], s).alias("open"))).otherwise(F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), s.alias("open")))
    return F.aggregate(parts, start, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))
