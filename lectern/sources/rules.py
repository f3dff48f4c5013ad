"""Review rules from JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """id, text and metadata of each line that is not blank; a rule without id is named after its line.

    A rule file is one whole file, so that its lines have numbers.
    """
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line")).where(F.trim("line") != "")
    rule = lines.select("at", F.from_json("line", "id string, text string, metadata map<string,string>").alias("r"))
    return rule.select(F.coalesce(F.nullif("r.id", F.lit("")), F.concat(F.lit("rule_"), (F.col("at") + 1).cast("string"))).alias("id"), F.trim("r.text").alias("text"), F.coalesce("r.metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def seed(rules: DataFrame, path: str) -> None:
    """Store rules unless there are some already."""
    rules.write.mode("ignore").parquet(path)
