"""Token counts through a digest cache: only texts whose count is not stored yet are encoded."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import exists, sliced, stored, text_or_empty

#: Bytes of text that are encoded at once.
STEP = 4 << 20
#: Stands for a null id while texts are looked up.
NO_ID = -(1 << 63)


def load_encoder(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts: sentencepiece for .model, tokenizers for .json."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    json_model = Tokenizer.from_file(path)
    json_model.no_truncation()
    json_model.no_padding()
    return lambda texts: [len(x.ids) for x in json_model.encode_batch(texts, add_special_tokens=False)]


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: digest of its file and of its library's version."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    return hashlib.sha256(Path(path).read_bytes() + library.__version__.encode()).hexdigest()


def _encode(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = load_encoder(path)
        for batch in batches:
            for part in sliced(batch, "text", STEP):
                yield pa.record_batch([part.column("digest"), pa.array(counts(part.column("text").to_pylist()), pa.int64())], ["digest", "n_tokens"])

    return run


def _cached(spark, cache: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version; one row per digest, also where two runs stored it."""
    path, schema = f"{cache}/tokenizer={version}", "digest binary, n_tokens bigint"
    rows = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit (more than limit tokens).

    cache is a folder of counts by tokenizer version and SHA-256 digest of the text (null: empty; no other
    normalisation, as it could change a count). Digests found there are not encoded again. Of the others each
    distinct one is encoded once, and the new counts are appended. Nulls in id_col and repeated rows stay; an
    empty table gives no rows; other columns are not read.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    whole = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    digests = stored(whole.select("id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes")), "text-digests")
    first = digests.groupBy("digest").agg(F.coalesce(F.min("id"), F.lit(NO_ID)).alias("id"))
    misses = first.join(_cached(spark, cache, version), "digest", "left_anti")
    here = whole.withColumn("id", F.coalesce("id", F.lit(NO_ID))).join(misses.hint("merge"), ["id", "digest"], "left_semi")
    missing = here.dropDuplicates(["id", "digest"])  # repeated rows, in the join's own partitions
    missing.select("digest", "text").mapInArrow(_encode(tokenizer), "digest binary, n_tokens bigint").write.mode("append").parquet(f"{cache}/tokenizer={version}")
    # Stored, so that the last join has an exchange on either side and splits a digest with many rows.
    counts = stored(digests.select("digest").distinct().join(_cached(spark, cache, version), "digest"), "token-counts")
    return digests.join(counts, "digest").select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
