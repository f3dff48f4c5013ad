"""Running review metrics over a stream of scored documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.metrics import corpus_totals, derived, rate


def running_metrics(recall: DataFrame, by: str) -> DataFrame:
    """Totals and weighted means by a column of a stream of item recalls; for complete or update output."""
    d = derived(recall, digits=False)
    w = F.col("gt_count")
    sums = d.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), F.sum("gt_count").alias("gt_count"), F.sum("diagnosis_hits").alias("diagnosis_hits"), F.sum(F.col("np_mcs") * w).alias("np_mcs_weight"))
    return sums.select(by, "documents", "gt_count", "diagnosis_hits", rate(F.col("diagnosis_hits"), F.col("gt_count")).alias("diagnosis_recall"), rate(F.col("np_mcs_weight"), F.col("gt_count")).alias("doc_weighted_np_mcs"))


def windowed_counts(findings: DataFrame, time: str, length: str, lateness: str, by: str) -> DataFrame:
    """Findings by tumbling window and type; those later than lateness fall away with their window's state."""
    return findings.withWatermark(time, lateness).groupBy(F.window(time, length), by).agg(F.count(F.lit(1)).alias("n")).select("window.start", by, "n")


def append_totals(recall: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the additive totals of each micro-batch under its id, so that a batch run again replaces its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        corpus_totals(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return recall.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def windowed_updates(findings: DataFrame, time: str, length: str, lateness: str, by: str, path: str, checkpoint: str) -> StreamingQuery:
    """windowed_counts over all that is there, each batch's changed windows under its id; a batch run again replaces its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    made = windowed_counts(findings, time, length, lateness, by)
    return made.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_windows(spark: SparkSession, path: str, by: str) -> DataFrame:
    """The last count of each window that windowed_updates wrote: start, by, n."""
    rows = spark.read.parquet(path)
    return rows.groupBy("start", by).agg(F.max_by("n", "batch").alias("n"))
