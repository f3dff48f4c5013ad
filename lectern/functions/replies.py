"""Decoding of model replies that should hold JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a prediction may hold; all text, coerced where it is used.
ITEM = "array<struct<error_type:string,dimension:string,section_number:string,reason:string,error_description:string,evidence:string,confidence:string,critic_note:string>>"
SECTION = "array<struct<section_number:string,title:string,content:string>>"


def json_text(reply: Column) -> Column:
    """The JSON in a reply: no thoughts, no code fence, the widest [..], else the widest {..}; {} where nothing parses."""
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    plain = bare(F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?s)<think>.*?</think>", ""))
    fenced = F.regexp_extract(plain, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = bare(F.when(fenced != "", fenced).otherwise(plain))
    parses = lambda x: F.try_parse_json(x).isNotNull()
    whole, listed, single = body, F.regexp_extract(body, r"(?s)\[.*\]", 0), F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.when(parses(whole), whole).when((listed != "") & parses(listed), listed).when((listed == "") & (single != "") & parses(single), single).otherwise("{}")


def is_skipped(reply: Column) -> Column:
    """A literal null: the document is not scored."""
    return json_text(reply) == "null"


def items(reply: Column, schema: str = ITEM) -> Column:
    """Members of a list reply that are objects; none for other replies, null for a skipped one."""
    text = json_text(reply)
    rows = F.filter(F.from_json(text, schema), lambda x: x.isNotNull())
    listed = F.filter(F.from_json(text, "array<string>"), lambda x: F.trim(x).startswith("{"))
    members = F.from_json(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")), schema)
    return F.when(text == "null", F.lit(None)).when(text.startswith("["), F.coalesce(members, rows, F.from_json(F.lit("[]"), schema))).otherwise(F.from_json(F.lit("[]"), schema))


def section_rows(reply: Column) -> Column:
    """Sections of a list reply: without title none, an empty number as null."""
    titled = F.filter(items(reply, SECTION), lambda s: F.trim(F.coalesce(s["title"], F.lit(""))) != "")
    return F.transform(titled, lambda s: F.struct(F.nullif(F.trim(F.coalesce(s["section_number"], F.lit(""))), F.lit("")).alias("section_number"), F.trim(s["title"]).alias("title"), F.trim(F.coalesce(s["content"], F.lit(""))).alias("content")))
