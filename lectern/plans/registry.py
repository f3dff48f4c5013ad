"""Named queries of the engine: name -> callable(spark, sf_dir), and the SQL they are checked against."""

from __future__ import annotations

from lectern.plans import corpus_queries, file_queries, review_queries, table_queries

QUERIES: dict = {**table_queries.QUERIES, **corpus_queries.QUERIES, **review_queries.QUERIES, **file_queries.QUERIES}
ORACLES: dict = {**table_queries.ORACLES, **corpus_queries.ORACLES, **review_queries.ORACLES, **file_queries.ORACLES}
