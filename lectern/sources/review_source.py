"""A Python data source of reviewed documents: spark.read and spark.readStream of folders of source texts, as sections."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith
from pyspark.sql.types import StructType

from lectern.functions.outline import outline
from lectern.operators.storage import open_store

#: Bytes of files that one task reads, where no option bytes_per_task says otherwise.
TASK_BYTES = 32 << 20
SCHEMA = "doc_id string, ord int, section_number string, title string, content string"
_COLUMNS = ["doc_id", "ord", "section_number", "title", "content"]


@dataclass
class Files(InputPartition):
    """Files that one task reads, and what it keeps of them."""

    paths: list[str]
    doc_ids: list[str] | None = None
    numbers: list[str] | None = None


def _listed(uri: str) -> list[pafs.FileInfo]:
    """JSON files below a folder, oldest first; those that a writer has not finished begin with _ or a dot."""
    store, path = open_store(uri)
    found = store.get_file_info(pafs.FileSelector(path, recursive=True))
    shown = [f for f in found if f.is_file and f.extension == "json" and not any(p[:1] in "_." for p in f.path[len(path) :].split("/") if p)]
    return sorted(shown, key=lambda f: (f.mtime_ns, f.path))


def _dealt(files: list[pafs.FileInfo], most: int) -> list[list[str]]:
    """Files in runs of most bytes; a larger file comes alone."""
    runs, size = [], 0
    for f in files:
        if not runs or size + f.size > most:
            runs.append([])
            size = 0
        runs[-1].append(f.path)
        size += f.size
    return runs


def _read(uri: str, part: Files) -> Iterator[tuple]:
    store, _ = open_store(uri)
    for path in part.paths:
        with store.open_input_stream(path) as file:
            rest = b""
            while True:  # a line at a time, whatever the size of the file
                block = file.read(1 << 20)
                *lines, rest = (rest + block).split(b"\n") if block else (rest, b"")
                for line in filter(None, lines):
                    record = json.loads(line)
                    if part.doc_ids is None or record.get("doc_id") in part.doc_ids:
                        for ord_, number, title, content in outline(record.get("source_text")):
                            if part.numbers is None or any((number or "").startswith(n) for n in part.numbers):
                                yield record.get("doc_id"), ord_, number, title, content
                if not block:
                    break


class _Reader(DataSourceReader):
    def __init__(self, uri: str, most: int) -> None:
        self.uri, self.most, self.doc_ids, self.numbers = uri, most, None, None

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Equal doc_ids and leading section numbers are kept here, before a document is cut; other filters stay Spark's."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("doc_id",) and self.doc_ids is None:
                self.doc_ids = [f.value] if isinstance(f, EqualTo) else list(f.value)
            elif isinstance(f, StringStartsWith) and f.attribute == ("section_number",) and self.numbers is None:
                self.numbers = [f.value]
            elif not (isinstance(f, IsNotNull) and f.attribute == ("doc_id",) and self.doc_ids is not None):
                yield f

    def partitions(self) -> list[Files]:
        return [Files(run, self.doc_ids, self.numbers) for run in _dealt(_listed(self.uri), self.most)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from _read(self.uri, partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the time and path of the newest file of a batch, so a restart goes on where the checkpoint ends."""

    def __init__(self, uri: str, most: int) -> None:
        self.uri, self.most = uri, most

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = _listed(self.uri)
        return {"time": files[-1].mtime_ns, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        at = lambda x: (x["time"], x["path"])
        return [Files(run) for run in _dealt([f for f in _listed(self.uri) if at(start) < (f.mtime_ns, f.path) <= at(end)], self.most)]

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from _read(self.uri, partition)

    def commit(self, end: dict) -> None:
        """Files stay: another query may read them."""


class ReviewSections(DataSource):
    """Format review_sections: sections of the source texts in a folder of JSON lines (doc_id, source_text).

    Options: path, and bytes_per_task. A text without headings gives no rows; a null doc_id stays null.
    """

    @classmethod
    def name(cls) -> str:
        return "review_sections"

    def schema(self) -> str:
        return SCHEMA

    def _own(self) -> tuple[str, int]:
        if "path" not in self.options:
            raise ValueError("review_sections needs a path")
        return self.options["path"], int(self.options.get("bytes_per_task", TASK_BYTES))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(*self._own())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(*self._own())


def register_sources(spark: SparkSession) -> list[str]:
    spark.dataSource.register(ReviewSections)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return [ReviewSections.name()]
