"""Candidate findings: cleaning, validity, spreading to neighbours, first-wins deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import empty_to_null, section_key, trimmed, with_note, with_supplement
from lectern.taxonomy import ERROR_TYPES, RELATED_TYPES, SPREADING

OUTPUT = ["error_type", "dimension", "section_number", "reason", "error_description"]


def taxonomy(spark: SparkSession) -> DataFrame:
    """The 25 valid (dimension, error_type)."""
    return spark.createDataFrame([(d, t) for d, types in ERROR_TYPES.items() for t in types], "dimension string, error_type string")


def related_types(spark: SparkSession) -> DataFrame:
    rows = [(d, t, other, i) for (d, t), types in RELATED_TYPES.items() for i, other in enumerate(types)]
    return spark.createDataFrame(rows, "dimension string, error_type string, other string, other_rank int")


def normalised(items: DataFrame) -> DataFrame:
    """Items with both codes, text trimmed, and reason and description standing in for one another."""
    text = lambda c: empty_to_null(trimmed(F.coalesce(F.col(c), F.lit(""))))
    cleaned = items.withColumns({"error_type": text("error_type"), "dimension": text("dimension"), "section_number": text("section_number")})
    kept = cleaned.where("error_type is not null and dimension is not null")
    return kept.withColumns({"reason": F.coalesce(text("reason"), text("error_description"), F.lit("")), "error_description": F.coalesce(text("error_description"), text("reason"), F.lit(""))})


def output_columns(items: DataFrame, *more: str) -> DataFrame:
    return items.select(*more, *OUTPUT)


def description(items: DataFrame) -> Column:
    return trimmed(F.coalesce(empty_to_null(items["error_description"]), items["reason"], F.lit("")))


def valid(items: DataFrame) -> DataFrame:
    """Items whose error type belongs to their dimension; the taxonomy has 25 rows."""
    return items.join(F.broadcast(taxonomy(items.sparkSession)), ["dimension", "error_type"], "left_semi")


def clamped_confidence(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(x.try_cast("double"), F.lit(0.0))))


def first_of_key(items: DataFrame, order: list[str]) -> DataFrame:
    """The first item of each (document, dimension, error type, section) in the total order given."""
    keys = ["doc_id", "dimension", "error_type", section_key(F.col("section_number"))]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return items.withColumn("key_rank", rank).where("key_rank = 1").drop("key_rank")


def union_streams(streams: dict[str, DataFrame]) -> DataFrame:
    """All streams in one bag, tagged with source_agent and their rank."""
    tagged = [df.withColumns({"source_agent": F.lit(name), "src_rank": F.lit(i)}) for i, (name, df) in enumerate(streams.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def last_section(sections: DataFrame) -> DataFrame:
    """Section number by key of each document; the last of equal keys wins."""
    keyed = sections.withColumn("section", section_key(F.col("section_number"))).where("section is not null")
    return keyed.groupBy("doc_id", "section").agg(F.max_by("section_number", "ord").alias("known_number"))


def parent_keys(sections: DataFrame) -> DataFrame:
    """Direct children of each dotted key in document order: doc_id, parent, child, child_rank; a child counts once."""
    keyed = sections.withColumn("child", section_key(F.col("section_number"))).where("contains(child, '.')")
    once = keyed.groupBy("doc_id", "child").agg(F.min("ord").alias("ord")).withColumn("parent", F.regexp_replace("child", r"\.[^.]*$", ""))
    rank = F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("ord"))
    return once.select("doc_id", "parent", "child", rank.alias("child_rank"))


def _noted(items: DataFrame, note: Column) -> DataFrame:
    return items.withColumn("note", note).withColumns({"reason": with_note(F.col("reason"), F.col("note")), "error_description": with_supplement(F.col("error_description"), F.col("note"))}).drop("note")


def ancestors(section: Column, most: int = 3) -> Column:
    """Keys above a dotted key, nearest first, null where it has fewer."""
    parts = F.split(section, r"\.")
    return F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: F.when(F.size(parts) > i, F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - i)), ".")))


def spread_sections(items: DataFrame, sections: DataFrame, parents: int = 3, children: int = 5) -> DataFrame:
    """Items, and copies of those of SPREADING at up to parents ancestors (nearest first) and children direct children.

    spread_rank orders an item's copies. Ancestors need not exist as sections; existing ones give their own
    way of writing the number.
    """
    names = items.columns
    base = items.withColumn("section", section_key(F.col("section_number")))
    from_ = base.where(F.col("dimension").isin(SPREADING) & (F.coalesce("section", F.lit("")) != ""))
    known = last_section(sections)
    up = from_.select("*", F.posexplode(ancestors(F.col("section"), parents)).alias("step", "target")).where("target is not null").withColumns({"spread_rank": F.col("step") + 1, "note": F.concat(F.lit("section 扩展父章节 "), "target")}).drop("step")
    down = from_.join(parent_keys(sections).where(F.col("child_rank") <= children), ["doc_id"]).where("section = parent")
    down = down.withColumns({"target": F.col("child"), "spread_rank": F.col("child_rank") + parents, "note": F.concat(F.lit("section 扩展子章节 "), "child")}).drop("parent", "child", "child_rank")
    moved = up.unionByName(down).join(known.withColumnRenamed("section", "target"), ["doc_id", "target"], "left")
    moved = _noted(moved.withColumn("section_number", F.coalesce("known_number", "target")).withColumnRenamed("note", "note_text"), F.col("note_text"))
    return items.withColumn("spread_rank", F.lit(0)).unionByName(moved.select(*names, "spread_rank"))


def spread_types(items: DataFrame) -> DataFrame:
    """Items, and a copy for each related error type; type_rank orders them."""
    names = items.columns
    edges = related_types(items.sparkSession)
    more = _noted(items.join(F.broadcast(edges), ["dimension", "error_type"]), F.concat(F.lit("相近错误类型扩展："), "error_type", F.lit(" -> "), "other"))
    more = more.withColumns({"error_type": F.col("other"), "type_rank": F.col("other_rank") + 1})
    return items.withColumn("type_rank", F.lit(0)).unionByName(more.select(*names, "type_rank"))


def final_candidates(items: DataFrame, sections: DataFrame, order: list[str]) -> DataFrame:
    """The tail of a review: valid items, spread to sections and types, valid again, first of each key."""
    spread = spread_types(spread_sections(valid(normalised(items)), sections))
    return first_of_key(valid(spread), [*order, "spread_rank", "type_rank"])


def supplements(items: DataFrame, direct: DataFrame, most: int = 5, least_confidence: float = 0.75) -> DataFrame:
    """By dimension the most confident items that are not direct ones already, ties in order of ord."""
    key = lambda df: df.withColumn("section", section_key(F.col("section_number")))
    have = key(direct).select("doc_id", F.col("dimension").alias("d"), F.col("error_type").alias("t"), F.col("section").alias("s"), F.lit(True).alias("have")).distinct()
    left = key(items).withColumn("confidence", clamped_confidence(F.col("confidence")))
    new = left.join(have.withColumnRenamed("doc_id", "h"), (left["doc_id"] == F.col("h")) & left["dimension"].eqNullSafe(F.col("d")) & left["error_type"].eqNullSafe(F.col("t")) & left["section"].eqNullSafe(F.col("s")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("doc_id", "dimension").orderBy(F.desc("confidence"), "ord"))
    return new.where(F.col("confidence") >= least_confidence).withColumn("rank", rank).where(F.col("rank") <= most).drop("section")
