"""Corpus pipeline: quality rules, exact and near deduplication, mixing to target weights, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import exact_dedup, mixing, packing, quality_rules, simhash
from lectern.llm.common import stored
from lectern.llm.queries import domains

#: Wanted shares of the tokens that the quality rules leave. Poor documents are no domain here: those rules have removed them.
TARGETS = {"clean": 0.96, "toxic": 0.04}
#: Greatest number of copies of a document.
COPIES = 4


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.kept_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.without_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    Those are linked by fingerprints that differ in two bits or fewer, as op7 finds them through its grid. Copies whose
    fingerprints are further apart are linked by what an exact comparison adds: five-word shingles, similarity 0.8.
    """
    pairs = simhash.fingerprint_pairs(docs, k=3, max_bits=2).union(simhash.similar_pairs(docs, k=5, similarity=0.8))
    return simhash.without_linked(docs, pairs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says, COPIES times at most."""
    labelled = domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mixed_rows(docs, labelled.where(labelled["domain"].isin(list(TARGETS))), TARGETS, COPIES)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins."""
    return packing.best_fit_packing(docs, capacity=8192)


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The line labelling, sampling and fitting of the stages have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
