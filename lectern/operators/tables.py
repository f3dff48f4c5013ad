"""Table functions of SQL: a document's outline by lateral join, and a structure review over sections by document."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SkipRestOfInputTableException, udtf
from pyspark.sql.types import StringType, StructType

from lectern.functions.outline import outline
from lectern.taxonomy import MAX_DEPTH, WRONG_TITLES

_STANDARD = {wrong: right for right, words in WRONG_TITLES.items() for wrong in words}


class ParseOutline:
    """parse_outline(text): ord, section_number, title, content of each section; none for a null text."""

    def eval(self, text: str):
        yield from outline(text)


class ReviewStructure:
    """review_structure(TABLE(sections), most): findings on the numbers and titles of each document's sections.

    The table has doc_id, ord, section_number and title; other columns are not read. It is partitioned by doc_id and
    ordered by ord, which analyze asks for, so that a task sees one document after another and holds the
    number before, not the document. Findings are doc_id (of its own type), error_type, ord, section_number and
    reason; after `most` of a document (null: all) the rest of its rows is skipped.
    """

    def __init__(self) -> None:
        self.before, self.found = None, 0

    @staticmethod
    def analyze(sections: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        if not sections.isTable:
            raise ValueError("review_structure needs a table of sections")
        named = {f.name.lower(): f for f in sections.dataType.fields}
        if missing := [c for c in ("doc_id", "ord", "section_number", "title") if c not in named]:
            raise ValueError(f"sections lack the columns {missing}")
        schema = StructType().add("doc_id", named["doc_id"].dataType).add("error_type", StringType()).add("ord", named["ord"].dataType).add("section_number", StringType()).add("reason", StringType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("doc_id")], orderBy=[OrderingColumn("ord")])

    def eval(self, row: Row, most: int):
        for kind, reason in self._findings(row["section_number"] or "", row["title"] or ""):
            if most is not None and self.found >= most:
                raise SkipRestOfInputTableException(f"{most} findings")
            self.found += 1
            yield row["doc_id"], kind, row["ord"], row["section_number"], reason

    def _findings(self, number: str, title: str) -> Iterator[tuple[str, str]]:
        if re.fullmatch("[0-9]+", number):
            before, self.before = self.before, (int(number), title)
            if before and int(number) <= before[0]:
                yield "E-S-02", f"{before[0]} {before[1]} > {int(number)} {title}"
        if title in _STANDARD:
            yield "E-S-03", f"{title} > {_STANDARD[title]}"
        if re.match(r"[0-9.]", number) and number.count(".") + 1 > MAX_DEPTH:
            yield "E-S-06", f"{number.count('.') + 1}"


def register_tables(spark: SparkSession) -> list[str]:
    """Register the table functions for SQL and return their names."""
    spark.udtf.register("parse_outline", udtf(ParseOutline, returnType="ord int, section_number string, title string, content string"))
    spark.udtf.register("review_structure", udtf(ReviewStructure))
    return ["parse_outline", "review_structure"]
