"""Exact deduplication by a binomial tree merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import SPACE, stored, text_or_empty

KEY = ["digest", "size", "check"]
#: Stands for a null id while rows are joined.
NO_ID = -(1 << 63)


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One slim row per row of docs, stored for all later rounds; each partition of docs is a run.

    A text's key is the SHA-256 digest of its normalised form, verified by that form's length and an
    independent 64-bit hash. row_id tells repeated rows apart.
    """
    short = docs.select(F.col(id_col).cast("bigint").alias("id"), normalised(F.col(text_col)).alias("t"), F.length(text_or_empty(text_col)).alias("points"))
    slim = short.select(
        "id", "points", F.unhex(F.sha2("t", 256)).alias("digest"), F.octet_length("t").alias("size"), F.xxhash64("t").alias("check"), F.monotonically_increasing_id().alias("row_id"),
        F.spark_partition_id().alias("run"),
    )
    return stored(slim, "digest-runs")


def tree_merge(runs: DataFrame) -> DataFrame:
    """The winner and size of each group of equal keys, by a binomial tree of exchanges between runs.

    First each run is sorted by key and reduced to one entry per key. In each round run 2 i and run 2 i + 1
    exchange entries: of each part of the digests one of two tasks gets both runs' entries and merges them,
    the other the next part, so that runs halve, parts double, and as many tasks are busy as before. A merge
    keeps the best entry of equal keys (digest, length and second hash): most code points, then smallest id.
    There are log2(runs) rounds; a group of any size reaches a task as one entry per run.
    """
    best = F.struct((-F.col("points")).alias("points"), F.col("id").isNull().alias("no_id"), "id", "row_id")
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = runs.select("run", F.lit(0).cast("bigint").alias("part"), *KEY, best.alias("best"), F.lit(1).cast("bigint").alias("n"))
    merge = lambda df: df.repartition(parts, "run", "part").groupBy("run", "part", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    level, last = merge(level), runs.agg(F.max("run")).first()[0] or 0
    for bits in range(1, last.bit_length() + 1):
        level = merge(level.withColumns({"run": F.shiftright("run", 1), "part": F.shiftrightunsigned("check", 64 - bits)}))
    return level.drop("run", "part")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of docs with the row that stays of its group of equal texts.

    Columns: doc_id, keep_id, group_size, kept, text_sha256. Null text counts as empty; empty texts are one
    group. Of repeated rows with one id, one is kept. A null id wins over no other id. An empty table gives no
    rows; other columns of docs are not read.
    """
    runs = digest_runs(docs, id_col, text_col)
    winners = tree_merge(runs).select(*KEY, F.col("best.id").alias("keep_id"), F.col("best.row_id").alias("keep_row"), F.col("n").alias("group_size"))
    return runs.join(winners, KEY).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops, with all their columns; nulls, repeated rows and empty tables as there."""
    own = F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own.alias("id"), F.sha2(normalised(F.col(text_col)), 256).alias("sha"))
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("text_sha256").alias("sha"))
    # One exchange of texts: repeated rows of one id meet under the join's own keys, sorted already.
    return packed.join(kept.hint("merge"), ["id", "sha"], "left_semi").dropDuplicates(["id", "sha"]).select("row.*")
