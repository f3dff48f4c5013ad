"""Helpers that the corpus operators share: shared scratch space, Arrow batches as bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as a Java, RE2 and Python class.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset."""
    context = spark.sparkContext
    set_already = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if set_already:
        return set_already.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lectern-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lectern-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: later steps and retries start from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def delete(df: DataFrame) -> None:
    """Remove a table that stored() wrote, when no later step reads it."""
    spark, path = df.sparkSession, df._stored_at
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, True)


def exists(spark: SparkSession, uri: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow file system and path of a URI, or of a plain local path."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def sliced(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows whose texts have max_bytes together; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        base = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    if pa.types.is_large_string(column.type) or not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[offsets[0] : offsets[-1]], offsets - offsets[0]


# Each byte of a text as a byte of a word (A-Z in lower case) or as a space between words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def word_pieces(text: str, step: int) -> Iterator[list[bytes]]:
    """The words [0-9a-z] and above ASCII of a text with A-Z in lower case, a list for each step bytes; no word is cut."""
    data = text.encode().translate(_WORD_BYTES)
    at = 0
    while at < len(data):
        to = len(data) if len(data) - at <= step else data.find(b" ", at + step)
        to = to if to >= 0 else len(data)
        yield data[at:to].split()
        at = to
