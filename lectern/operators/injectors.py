"""Seeded injection of labelled errors into section rows.

An injector takes sections (doc_id, ord, section_number, title, content) of any number of documents and gives
an Injection: annotations (doc_id, dimension, error_type, original, corrupted, error_description; corrupted
is null for a deletion) and the changed sections. A document without a fitting section stays as it is and
has no annotation. A choice is the candidate of the smallest seeded hash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import INJECTED_REFERENCE, WS, brief, error_text, has_any, injected_ids, replace_first, trimmed
from lectern.operators.sections import first_match, has_real_text, has_text, top_blocks
from lectern.operators.allocation import balanced_choices
from lectern.operators.storage import stored
from lectern.taxonomy import ERROR_TYPES, FAKE_STANDARDS, INJECTED_APPENDIX_TITLES, INJECTED_MANDATORY, INJECTED_TITLES, SAFETY, VAGUE

SECTION = ["section_number", "title", "content"]
DIMENSION_OF = {t: d for d, types in ERROR_TYPES.items() for t in types}


@dataclass
class Injection:
    annotations: DataFrame
    sections: DataFrame


def _struct(number: Column, title: Column, content: Column) -> Column:
    return F.struct(number.cast("string").alias("section_number"), title.cast("string").alias("title"), content.cast("string").alias("content"))


def _own() -> Column:
    return _struct(*map(F.col, SECTION))


def _draw(seed: int, code: str, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(code), "doc_id", *columns)


def pick(candidates: DataFrame, seed: int, code: str, n: int = 1, *by: str) -> DataFrame:
    """n candidates of each document, drawn by hash."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(_draw(seed, code, "ord", *by), "ord", *by))
    return candidates.withColumn("draw", rank).where(F.col("draw") <= n)


def _annotated(rows: DataFrame, code: str, original: Column, corrupted: Column | None, text: Column) -> DataFrame:
    none = F.lit(None).cast("struct<section_number:string,title:string,content:string>")
    return rows.select("doc_id", F.lit(DIMENSION_OF.get(code, "C3.3")).alias("dimension"), F.lit(code).alias("error_type"), original.alias("original"), (none if corrupted is None else corrupted).alias("corrupted"), text.alias("error_description"))


def _changed(sections: DataFrame, rows: DataFrame, code: str, what: str) -> Injection:
    """Sections at the rows' ord with the rows' new_* columns in place of their own."""
    new = [c for c in SECTION if f"new_{c}" in rows.columns]
    made = _struct(*[F.col(f"new_{c}") if c in new else F.col(c) for c in SECTION])
    text = error_text(F.concat(F.lit(f"{what}「"), F.coalesce("title", F.lit("")), F.lit("」由「"), brief(F.col(new[0])), F.lit("」变为「"), brief(F.col(f"new_{new[0]}")), F.lit("」")), F.lit("恢复原有内容"), F.lit("GB/T 1.1"))
    at = rows.select("doc_id", "ord", *[F.col(f"new_{c}") for c in new], F.lit(True).alias("is_new"))
    out = sections.join(at, ["doc_id", "ord"], "left")
    for c in new:
        out = out.withColumn(c, F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c)))
    return Injection(_annotated(rows, code, _own(), made, text), out.select("doc_id", "ord", *SECTION))


def missing_mandatory(sections: DataFrame, seed: int) -> Injection:
    """One or two mandatory categories and what is numbered below them go; every section of a gone title goes."""
    found = [sections.where(has_any(F.coalesce("title", F.lit("")), words)).groupBy("doc_id").agg(F.min(F.struct("ord", *SECTION)).alias("s")).select("doc_id", F.lit(name).alias("category"), "s.*") for name, words in INJECTED_MANDATORY.items()]
    number = F.pmod(F.xxhash64(F.lit(seed), F.lit("count"), "doc_id"), F.lit(2)) + 1
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(_draw(seed, "E-S-01", "category"), "category"))
    chosen = reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= number)
    below = sections.alias("s").join(chosen.select(F.col("doc_id").alias("p_doc"), F.col("section_number").alias("p_number"), "category"), (F.col("doc_id") == F.col("p_doc")) & F.col("section_number").startswith(F.concat("p_number", F.lit("."))))
    gone = chosen.select("doc_id", "category", *SECTION).unionByName(below.select("doc_id", "category", *SECTION))
    text = error_text(F.concat(F.lit("章节「"), F.concat_ws(" ", "section_number", "title"), F.lit("」被删除")), F.lit("恢复该章节"), F.concat(F.lit("缺失「"), "category", F.lit("」")))
    titles = gone.select("doc_id", "title").distinct()
    return Injection(_annotated(gone, "E-S-01", _own(), None, text), sections.join(titles, ["doc_id", "title"], "left_anti").select("doc_id", "ord", *SECTION))


def swapped_blocks(sections: DataFrame, seed: int) -> Injection:
    """Two top-level blocks with bodies change places and numbers; so do their contents-table blocks if both have one."""
    blocks = top_blocks(sections)
    two = pick(blocks.where("is_body").withColumn("ord", F.col("first")), seed, "E-S-02", 2)
    pair = two.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "last", "number"))).alias("b")).where("size(b) = 2").select("doc_id", F.col("b")[0].alias("a"), F.col("b")[1].alias("b"))
    toc = lambda x: F.max(F.when(~F.col("is_body") & (F.col("n") == F.col(f"{x}.number")) & (F.col("f") < F.col(f"{x}.first")), F.struct(F.col("f").alias("first"), F.col("l").alias("last"), F.col("n").alias("number"))))
    other = blocks.select(F.col("doc_id").alias("k_doc"), F.col("number").alias("n"), F.col("first").alias("f"), F.col("last").alias("l"), "is_body")
    plan = pair.join(other, F.col("doc_id") == F.col("k_doc")).groupBy("doc_id", "a", "b").agg(toc("a").alias("ta"), toc("b").alias("tb"))
    apart = F.col("ta").isNotNull() & F.col("tb").isNotNull() & (F.col("ta") != F.col("tb"))
    first = lambda x, y: F.when(F.col(f"{x}.first") < F.col(f"{y}.first"), F.col(x)).otherwise(F.col(y))
    moves = plan.select("doc_id", F.array_compact(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.when(apart, F.struct(first("ta", "tb").alias("x"), F.when(F.col("ta.first") < F.col("tb.first"), F.col("tb")).otherwise(F.col("ta")).alias("y"))))).alias("m"))
    row = sections.join(moves, "doc_id", "left")
    inside = lambda b: (F.col("ord") >= b["first"]) & (F.col("ord") <= b["last"])
    renumber = lambda old, new: F.when(F.col("section_number") == old, new).when(F.col("section_number").startswith(F.concat(old, F.lit("."))), F.concat(new, F.substr("section_number", F.length(old) + 1))).otherwise(F.col("section_number"))
    place, number = F.struct(F.col("ord").alias("slot"), F.lit(0).alias("sub"), F.col("ord").alias("o")), F.col("section_number")
    for i in (0, 1):
        x, y = F.get("m", F.lit(i))["x"], F.get("m", F.lit(i))["y"]
        there = F.coalesce(F.size("m") > i, F.lit(False))
        place = F.when(there & inside(x), F.struct(y["first"].alias("slot"), F.lit(0).alias("sub"), F.col("ord").alias("o"))).when(there & inside(y), F.struct(x["first"].alias("slot"), F.lit(0).alias("sub"), F.col("ord").alias("o"))).otherwise(place)
        number = F.when(there & inside(x), renumber(x["number"], y["number"])).when(there & inside(y), renumber(y["number"], x["number"])).otherwise(number)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("place.slot", "place.sub", "place.o")) - 1
    out = row.withColumns({"place": place, "new_number": number}).select("doc_id", order.alias("ord"), F.col("new_number").alias("section_number"), "title", "content")
    heads = pair.select("doc_id", F.explode(F.array(F.struct(F.col("a.first").alias("ord"), F.col("b.number").alias("to")), F.struct(F.col("b.first").alias("ord"), F.col("a.number").alias("to")))).alias("h")).select("doc_id", "h.*")
    marked = heads.join(sections, ["doc_id", "ord"])
    text = error_text(F.concat(F.lit("章节「"), "title", F.lit("」被放到编号「"), "to", F.lit("」处")), F.concat(F.lit("恢复编号「"), "section_number", F.lit("」")), F.lit("章节按逻辑顺序组织"))
    return Injection(_annotated(marked, "E-S-02", _own(), _struct(F.col("to"), F.col("title"), F.col("content")), text), out)


def _retitled(sections: DataFrame, row: DataFrame, code: str, what: str) -> Injection:
    """All sections that bear the drawn row's title get its new_title; the row is annotated."""
    same = sections.join(row.select("doc_id", "title", "new_title"), ["doc_id", "title"], "left").withColumn("title", F.coalesce("new_title", "title"))
    return Injection(_changed(sections, row, code, what).annotations, same.select("doc_id", "ord", *SECTION))


def wrong_title(sections: DataFrame, seed: int) -> Injection:
    """A title that holds a standard one, or names an appendix's attribute, becomes a wrong form of it, in all sections that bear it."""
    title = F.coalesce("title", F.lit(""))
    forms = reduce(lambda w, x: w.when(title.contains(x[0]), F.array(*map(F.lit, x[1]))), list(INJECTED_TITLES.items())[1:], F.when(title.contains(next(iter(INJECTED_TITLES))), F.array(*map(F.lit, next(iter(INJECTED_TITLES.values()))))))
    letter = F.coalesce(F.nullif(F.regexp_extract(title, f"附录{WS}*([A-Z])", 1), F.lit("")), F.lit("A"))
    for attribute, words in INJECTED_APPENDIX_TITLES.items():
        forms = forms.when(title.contains("附录") & title.contains(attribute), F.transform(F.array(*map(F.lit, words)), lambda w: F.replace(w, F.lit("X"), letter)))
    row = pick(sections.withColumn("forms", forms).where("forms is not null"), seed, "E-S-03")
    return _retitled(sections, row.withColumn("new_title", F.get("forms", F.pmod(_draw(seed, "form"), F.size("forms").cast("bigint")).cast("int"))), "E-S-03", "标题")


def swapped_foreword(sections: DataFrame, seed: int) -> Injection:
    """Foreword and introduction exchange their contents."""
    name = F.regexp_replace(F.coalesce("title", F.lit("")), f"{WS}+", "")
    ends = sections.where(name.isin("前言", "引言") & has_text(F.col("content"))).groupBy("doc_id", name.alias("name")).agg(F.min(F.struct("ord", *SECTION)).alias("s"))
    pair = ends.groupBy("doc_id").agg(*[F.max(F.when(F.col("name") == n, F.col("s"))).alias(c) for n, c in (("前言", "f"), ("引言", "i"))]).where("f is not null and i is not null")
    rows = pair.select("doc_id", F.explode(F.array(F.struct("f.*", F.col("i.content").alias("new_content")), F.struct("i.*", F.col("f.content").alias("new_content")))).alias("r")).select("doc_id", "r.*")
    return _changed(sections, rows, "E-S-04", "内容互换的章节")


def flipped_appendix(sections: DataFrame, seed: int) -> Injection:
    """An appendix whose title names one attribute gets the other, in all sections of that title."""
    title = F.coalesce("title", F.lit(""))
    normative, informative = title.contains("规范性"), title.contains("资料性")
    row = pick(sections.where(title.contains("附录") & (normative != informative)), seed, "E-S-05")
    flipped = F.when(normative, replace_first(F.col("title"), F.lit("规范性"), F.lit("资料性"))).otherwise(replace_first(F.col("title"), F.lit("资料性"), F.lit("规范性")))
    return _retitled(sections, row.withColumn("new_title", flipped), "E-S-05", "附录")


def too_deep(sections: DataFrame, seed: int) -> Injection:
    """A number gets five dots, or two more if it has them; numbers with two or three dots first."""
    numbered = sections.where(F.coalesce("section_number", F.lit("")) != "").withColumn("dots", F.length("section_number") - F.length(F.replace("section_number", F.lit("."))))
    best = numbered.withColumn("fits", F.col("dots").between(2, 3).cast("int")).withColumn("most", F.max("fits").over(Window.partitionBy("doc_id"))).where("fits = most")
    extra = F.when(F.col("dots") < 5, 5 - F.col("dots")).otherwise(2)
    row = pick(best, seed, "E-S-06").withColumn("new_section_number", F.concat("section_number", F.repeat(F.lit(".1"), extra)))
    same = sections.join(row.select("doc_id", "section_number", "new_section_number"), ["doc_id", "section_number"], "left").withColumn("section_number", F.coalesce("new_section_number", "section_number"))
    return Injection(_changed(sections, row, "E-S-06", "编号").annotations, same.select("doc_id", "ord", *SECTION))


def replaced_word(sections: DataFrame, seed: int, code: str, pairs: list[tuple[str, str]], first: list[str] = ()) -> Injection:
    """The first occurrence of a word becomes another; sections with words of first come first."""
    content = F.coalesce("content", F.lit(""))
    options = F.array_compact(F.array(*[F.when(content.contains(a), F.struct(F.lit(i).alias("option"), F.lit(a).alias("old"), F.lit(b).alias("new"))) for i, (a, b) in enumerate(pairs)]))
    rows = sections.select("*", F.explode(options).alias("o")).select("*", "o.*")
    if first:
        rows = rows.withColumn("fits", has_any(content, list(first)).cast("int")).withColumn("most", F.max("fits").over(Window.partitionBy("doc_id"))).where("fits = most")
    return _changed(sections, pick(rows, seed, code, 1, "option").withColumn("new_content", replace_first(F.col("content"), F.col("old"), F.col("new"))), code, "用词")


def term_list(sections: DataFrame) -> DataFrame:
    """By document the first section on terms with text, with its lines and the places of those that begin an entry."""
    row = first_match(sections, F.coalesce("title", F.lit("")).contains("术语") & has_real_text(F.col("content"))).withColumn("lines", F.split("content", r"\r\n|[\n\r]"))
    return row.withColumn("entries", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: trimmed(F.get("lines", i)).rlike(r"^\d+\.\d+")))


def dropped_term_line(sections: DataFrame, seed: int) -> Injection:
    """A middle entry of the term section goes, which leaves a gap in the numbers; it needs three entries."""
    row = term_list(sections).where("size(entries) >= 3")
    row = row.withColumn("at", F.get("entries", F.pmod(_draw(seed, "line"), (F.size("entries") - 2).cast("bigint")).cast("int") + 1))
    return _changed(sections, row.withColumn("new_content", F.array_join(F.filter("lines", lambda x, i: i != F.col("at")), "\n")), "E-TM-05", "术语")


def reference_lines(content: Column) -> Column:
    """The list of references: its introduction as item 0 (maybe empty), then a line for each standard."""
    rows = F.filter(F.split(F.coalesce(content, F.lit("")), "\n"), lambda x: trimmed(x) != "")
    standard = lambda x: trimmed(x).rlike(f"^{INJECTED_REFERENCE}")
    return F.concat(F.array(F.array_join(F.transform(F.filter(rows, lambda x: ~standard(x)), trimmed), "")), F.filter(rows, standard))


def _list_section(sections: DataFrame) -> DataFrame:
    """By document the first list of normative references with text."""
    found = first_match(sections, F.coalesce("title", F.lit("")).contains("规范性引用") & has_real_text(F.col("content")))
    return found.withColumn("parts", reference_lines(F.col("content")))


def missing_reference(sections: DataFrame, seed: int) -> Injection:
    """A listed line that a body cites goes; any line, the introduction too, where none is cited."""
    lists = _list_section(sections).where("size(parts) >= 2")
    cited = sections.where("title <> '' and content <> ''").join(lists.select("doc_id", F.col("ord").alias("l_ord")), "doc_id").where("ord <> l_ord").groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list(injected_ids(F.col("content"))))).alias("cited"))
    hit = F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.arrays_overlap(injected_ids(F.get("parts", i)), F.coalesce("cited", F.array().cast("array<string>"))))
    row = lists.join(cited, "doc_id", "left").withColumn("hit", hit).withColumn("pool", F.when(F.size("hit") > 0, F.col("hit")).otherwise(F.sequence(F.lit(0), F.size("parts") - 1)))
    row = row.withColumn("at", F.get("pool", F.pmod(_draw(seed, "E-R-01"), F.size("pool").cast("bigint")).cast("int")))
    return _changed(sections, row.withColumn("new_content", F.array_join(F.filter("parts", lambda x, i: i != F.col("at")), "\n")), "E-R-01", "引用清单")


def fake_references(sections: DataFrame, seed: int) -> Injection:
    """One to three standards that do not exist join the list."""
    fakes = F.array(*map(F.lit, FAKE_STANDARDS))
    n = F.pmod(_draw(seed, "E-R-02"), F.lit(3)).cast("int") + 1
    chosen = F.slice(F.transform(F.array_sort(F.transform(fakes, lambda x: F.struct(F.xxhash64(F.lit(seed), "doc_id", x).alias("h"), x.alias("x")))), lambda s: s["x"]), F.lit(1), n)
    row = _list_section(sections).withColumn("new_content", F.concat(F.rtrim("content"), F.lit("\n"), F.array_join(chosen, "\n")))
    return _changed(sections, row, "E-R-02", "引用清单")


def informative_reference(sections: DataFrame, seed: int) -> Injection:
    """An entry of the bibliography moves to the list, without its [N]; a standard that does not exist where there is none.

    Lines are entries if they begin with [N] or a standard; lines equal to the moved one go with it.
    """
    books = first_match(sections, F.coalesce("title", F.lit("")).contains("参考文献") & has_real_text(F.col("content"))).select("doc_id", F.struct("ord", "content").alias("b"))
    lines = F.filter(F.split(F.coalesce("b.content", F.lit("")), r"\r\n|[\n\r]"), lambda x: trimmed(x) != "")
    row = _list_section(sections).join(books, "doc_id", "left").withColumn("lines", lines)
    row = row.withColumn("entries", F.filter("lines", lambda x: trimmed(x).rlike(f"^\\[\\d+\\]|^(?:GB(?:/T)?|IEC|ISO|YD/T|JG/T|HJ|QB|SJ|JB|NB){WS}*\\d+")))
    draw = lambda n: F.pmod(_draw(seed, "E-R-03"), F.greatest(F.lit(1), n).cast("bigint")).cast("int")
    fakes = F.array(*map(F.lit, FAKE_STANDARDS))
    row = row.withColumn("moved", F.get("entries", draw(F.size("entries"))))
    added = F.coalesce(trimmed(F.regexp_replace("moved", f"^\\[\\d+\\]{WS}*", "")), F.get(fakes, draw(F.size(fakes))))
    row = row.withColumn("new_content", F.concat(F.rtrim("content"), F.lit("\n"), added))
    made = _changed(sections, row, "E-R-03", "引用清单")
    rest = row.where("moved is not null").select("doc_id", F.col("b.ord").alias("ord"), F.array_join(F.filter("lines", lambda x: x != F.col("moved")), "\n").alias("left"))
    out = made.sections.join(rest, ["doc_id", "ord"], "left").withColumn("content", F.coalesce("left", "content"))
    return Injection(made.annotations, out.select("doc_id", "ord", *SECTION))


def shuffled_references(sections: DataFrame, seed: int) -> Injection:
    """The list of three lines or more in another order, drawn by hash; reversed where the draw keeps it."""
    drawn = F.transform(F.array_sort(F.transform("parts", lambda x, i: F.struct(F.xxhash64(F.lit(seed), "doc_id", i).alias("h"), i.alias("i"), x.alias("x")))), lambda s: s["x"])
    row = _list_section(sections).where("size(parts) >= 3").withColumn("drawn", drawn)
    other = F.when(F.col("drawn") == F.col("parts"), F.reverse("parts")).otherwise(F.col("drawn"))
    return _changed(sections, row.withColumn("new_content", F.array_join(other, "\n")), "E-R-04", "引用清单")


def wrong_year(sections: DataFrame, seed: int) -> Injection:
    """A listed standard's year moves by 1 to 15 years."""
    row = _list_section(sections).withColumn("year", F.regexp_extract("content", r"[—\-](\d{4})", 1)).where("year <> ''")
    shift = F.pmod(_draw(seed, "year"), F.lit(15)).cast("int") + 1
    return _changed(sections, row.withColumn("new_content", replace_first(F.col("content"), F.col("year"), (F.col("year").cast("int") + shift).cast("string"))), "E-R-03", "引用年代号")


def wrong_date_form(sections: DataFrame, seed: int) -> Injection:
    """A listed standard's dash before the year becomes a hyphen."""
    row = _list_section(sections).where(F.col("content").rlike(r"—\d{4}"))
    return _changed(sections, row.withColumn("new_content", replace_first(F.col("content"), F.lit("—"), F.lit("-"))), "E-R-03", "引用格式")


def redundant_section(sections: DataFrame, seed: int, title: str = "编制说明", content: str = "本文件的编制过程说明。") -> Injection:
    """A section that does not belong there follows a drawn one."""
    row = pick(sections, seed, "E-S-X")
    new = row.select("doc_id", (F.col("ord") + 0.5).alias("place"), F.lit(None).cast("string").alias("section_number"), F.lit(title).alias("title"), F.lit(content).alias("content"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("place")) - 1
    out = sections.select("doc_id", F.col("ord").cast("double").alias("place"), *SECTION).unionByName(new).select("doc_id", order.alias("ord"), *SECTION)
    return Injection(_annotated(new, "E-S-02", _own(), _own(), error_text(F.lit("多余章节"), F.lit("删除"), F.lit("GB/T 1.1"))), out)


def rewritten(sections: DataFrame, rewrites: DataFrame, code: str) -> Injection:
    """Errors that a model words: rewrites (doc_id, ord, content) are a table; see worded.py for where they come from."""
    row = sections.join(rewrites.select("doc_id", "ord", F.col("content").alias("new_content")), ["doc_id", "ord"]).where("new_content <> content")
    if code == "E-SC-03":  # more requirements than before
        n = lambda c: F.regexp_count(F.col(c), F.lit("应|宜"))
        row = row.where(n("new_content") > n("content"))
    return _changed(sections, row, code, "改写的章节")


#: What each rule-based error type does.
INJECTORS: dict[str, Callable[[DataFrame, int], Injection]] = {
    "E-S-01": missing_mandatory, "E-S-02": swapped_blocks, "E-S-03": wrong_title, "E-S-04": swapped_foreword, "E-S-05": flipped_appendix, "E-S-06": too_deep,
    "E-T-01": partial(replaced_word, code="E-T-01", pairs=[("应", "宜")]), "E-T-02": partial(replaced_word, code="E-T-02", pairs=[("宜", "应")]), "E-T-03": partial(replaced_word, code="E-T-03", pairs=[("应", "可")]),
    "E-T-04": partial(replaced_word, code="E-T-04", pairs=[("应", "须")]), "E-T-05": partial(replaced_word, code="E-T-05", pairs=VAGUE), "E-T-06": partial(replaced_word, code="E-T-06", pairs=[("不应", "不宜")]),
    "E-T-07": partial(replaced_word, code="E-T-07", pairs=[("应", "宜")], first=SAFETY), "E-TM-05": dropped_term_line, "E-R-01": missing_reference, "E-R-02": fake_references, "E-R-03": informative_reference, "E-R-04": shuffled_references,
}


def inject(sections: DataFrame, choices: DataFrame, seed: int, types: list[str] | None = None) -> Injection:
    """One error for each document of choices (doc_id, error_type), of types if named; the others stay as they are.

    The sections are stored by chosen type, so each injector reads its own documents only.
    """
    types = types or list(INJECTORS)
    marked = stored(sections.join(choices.select("doc_id", "error_type"), "doc_id", "left"), "chosen", by="error_type")
    done = [INJECTORS[code](marked.where(F.col("error_type") == code).drop("error_type"), seed) for code in types]
    rest = marked.where(~F.coalesce(F.col("error_type").isin(types), F.lit(False))).select("doc_id", "ord", *SECTION)
    parts = [rest, *(d.sections.select("doc_id", F.col("ord").cast("int").alias("ord"), *SECTION) for d in done)]
    return Injection(reduce(DataFrame.unionByName, (d.annotations for d in done)), reduce(DataFrame.unionByName, parts))


def fitting_types(sections: DataFrame, seed: int, types: list[str] | None = None) -> DataFrame:
    """doc_id and the types that can be injected into each document, with the draws of seed; documents without any are left out."""
    found = [INJECTORS[t](sections, seed).annotations.select("doc_id", F.lit(t).alias("type")).distinct() for t in types or list(INJECTORS)]
    return reduce(DataFrame.unionByName, found).groupBy("doc_id").agg(F.collect_list("type").alias("types"))


def inject_balanced(sections: DataFrame, rounds: int, seed: int, types: list[str] | None = None, used: dict[str, int] | None = None) -> Injection:
    """rounds errors for each document where so many fit; the least used types first.

    In each round every document that some type fits takes one: exactly the least used of those that fit it, as if
    documents came one after another (balanced_choices gives the order). Counts of used and of earlier
    rounds go on. All annotations of one round are one error (column round counts them from 0), and the next round
    meets the sections that it left. A round is two passes over the sections, whatever the number of types
    that fail; its results are stored in the checkpoint folder.
    """
    types = types or list(INJECTORS)
    counts = dict.fromkeys(types, 0) | {t: n for t, n in (used or {}).items() if t in types}
    sections, notes = stored(sections.select("doc_id", "ord", *SECTION), "sections"), []
    for step in range(rounds):
        chosen = stored(balanced_choices(fitting_types(sections, seed + step, types), counts, seed), "choices")
        made = inject(sections, chosen, seed + step, types)
        notes.append(stored(made.annotations.withColumn("round", F.lit(step)), "annotations"))
        sections = stored(made.sections, "injected")
        for r in chosen.groupBy("error_type").agg(F.count(F.lit(1)).alias("n")).collect():
            counts[r["error_type"]] += r["n"]
    return Injection(reduce(DataFrame.unionByName, notes), sections)


def merged_sections(sections: DataFrame, corrupted: DataFrame) -> DataFrame:
    """Sections with those of corrupted (doc_id, ord, corrupted) replaced; a null one is deleted."""
    row = sections.join(corrupted.select("doc_id", "ord", "corrupted", F.lit(True).alias("hit")), ["doc_id", "ord"], "left").where("hit is null or corrupted is not null")
    return row.select("doc_id", "ord", *[F.when(F.col("hit"), F.col(f"corrupted.{c}")).otherwise(F.col(c)).alias(c) for c in SECTION])
