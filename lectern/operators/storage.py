"""Tables in the folder that driver and executors share: later steps and retries start from there."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where none is set and the session is local."""
    context = spark.sparkContext
    known = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not known:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lectern-"))
        known = context.getCheckpointDir()
    return known.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lectern-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written to the shared folder, in a folder for each value of a column if named, and read back."""
    path = scratch(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and path of a URI, or of a plain local path."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def numbered(df: DataFrame, order: list[str], name: str, kind: str = "int") -> DataFrame:
    """df with its rows numbered from 1 in order, in parts: each part's count moves the numbers of those behind it."""
    parts = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))  # as many rows as parts
    before = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(before, "_part").withColumn(name, (own + F.col("_before")).cast(kind)).drop("_part", "_before")
