"""Benchmark files: nested documents with labelled examples, and the files that evaluation and construction write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.metrics import histogram
from lectern.operators.storage import numbered
from lectern.schemas import BENCHMARK


def read_benchmark(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Documents of benchmark files with their place: doc_id, pos and the document's fields; the first limit if not 0.

    Raw control characters within strings are accepted.
    """
    files = spark.read.schema(BENCHMARK).option("multiLine", True).option("allowUnquotedControlChars", True).json(path)
    docs = files.select(F.input_file_name().alias("file"), F.posexplode("documents").alias("pos", "d")).select("file", "pos", "d.*")
    kept = docs.where(F.col("pos") < limit) if limit else docs
    return kept.withColumn("doc_id", F.concat_ws("#", F.regexp_extract("file", "([^/]+)$", 1), F.col("pos").cast("string"))).drop("file")


def ground_truth(docs: DataFrame) -> DataFrame:
    """Labelled examples of documents as items: the corrupted section, the original one where it was deleted."""
    e = docs.select("doc_id", F.posexplode("examples").alias("gt_index", "e"))
    at = F.coalesce("e.corrupted", "e.original")
    return e.select("doc_id", "gt_index", at["section_number"].alias("section_number"), F.coalesce("e.dimension", F.lit("")).alias("dimension"), F.coalesce("e.error_type", F.lit("")).alias("error_type"), at["title"].alias("title"), at["content"].alias("content"), F.coalesce("e.error_description", F.lit("")).alias("error_description"))


def scored_documents(docs: DataFrame, status: DataFrame) -> DataFrame:
    """Documents with text whose review (doc_id, reviewed) gave an answer; others leave all denominators."""
    return docs.where(F.trim(F.coalesce("source_text", F.lit(""))) != "").join(status.where("reviewed"), "doc_id", "left_semi")


def with_stats(records: DataFrame) -> DataFrame:
    """Records with record_index (from 1, by pos) and example_count."""
    counted = records.withColumn("example_count", F.size(F.coalesce("examples", F.array().cast(records.schema["examples"].dataType))))
    return numbered(counted.drop("record_index"), ["pos"], "record_index")


def source_records(sections: DataFrame, texts: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """By document its text, number of sections and parse usage."""
    n = sections.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("section_count"))
    made = texts.join(n, "doc_id", "left").withColumn("section_count", F.coalesce("section_count", F.lit(0)))
    return made.join(usage, "doc_id", "left") if usage is not None else made


def write_records(records: DataFrame, path: str) -> None:
    """One JSON object a line."""
    records.write.mode("overwrite").json(path)


def record_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A writer for foreachBatch, or for batches by hand: each batch is flushed to its own folder, a repeated one replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={batch_id}")

    return write


def write_summary(summary: DataFrame, path: str) -> None:
    """A summary of few rows as one file."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def construction_totals(records: DataFrame) -> DataFrame:
    """Files, examples, and examples by error type in order."""
    kinds = histogram(records.select(F.explode("examples.error_type").alias("error_type")), "error_type")
    by_type = kinds.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("error_type_counts"))
    return records.agg(F.count(F.lit(1)).alias("total_files"), F.sum(F.size("examples")).alias("total_examples")).crossJoin(by_type)


def write_construction(records: DataFrame, parsed: DataFrame, texts: DataFrame, folder: str) -> None:
    """The three outputs of a construction and the totals of each."""
    for name, df in (("benchmark", with_stats(records)), ("parsed_sections", parsed), ("source_texts", texts)):
        write_records(df, f"{folder}/{name}")
    write_summary(construction_totals(records), f"{folder}/benchmark_totals")
    write_summary(texts.agg(F.count(F.lit(1)).alias("total_files")), f"{folder}/source_totals")


def annotation_text(annotations: DataFrame) -> DataFrame:
    """By document a list of its annotations (ord gives their order) as Markdown."""
    place = F.concat(F.lit("位置: ["), F.coalesce("original.section_number", F.lit("None")), F.lit("] "), F.coalesce("original.title", F.lit("")))
    part = F.struct("ord", F.col("dimension"), F.col("error_type"), place.alias("place"), F.col("error_description").alias("text"))
    rows = F.array_sort(F.collect_list(part))
    shown = F.transform(rows, lambda r, i: F.concat(F.lit("## ["), (i + 1).cast("string"), F.lit("] 维度: "), r["dimension"], F.lit("  错误类型: "), r["error_type"], F.lit("\n"), r["place"], F.lit("\n说明: "), r["text"], F.lit("\n")))
    return annotations.groupBy("doc_id").agg(F.concat(F.lit("# 反例标注清单\n\n"), F.array_join(shown, "\n")).alias("annotation"))


def example_json(annotations: DataFrame, sections: DataFrame) -> DataFrame:
    """By document its changed sections and annotations as JSON."""
    body = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "section_number", "title", "content"))).alias("s"))
    notes = annotations.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "dimension", "error_type", "original", "corrupted", "error_description"))).alias("a"))
    drop = lambda c, *f: F.transform(c, lambda r: F.struct(*[r[x].alias(x) for x in f]))
    made = body.join(notes, "doc_id", "left")
    return made.select("doc_id", F.to_json(F.struct(F.coalesce(F.size("a"), F.lit(0)).alias("total_errors"), drop("s", "section_number", "title", "content").alias("corrupted_document"), drop("a", "dimension", "error_type", "original", "corrupted", "error_description").alias("annotations")), {"ignoreNullFields": "false"}).alias("json"))


def write_texts(texts: DataFrame, path: str) -> None:
    """doc_id and source_text of each document as JSON lines, in as many files as texts has partitions (read_texts, or format review_sections, reads them)."""
    texts.select("doc_id", "source_text").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """What write_texts wrote; ids are strings, so "007" is not "7"."""
    return spark.read.schema("doc_id string, source_text string").json(path)
