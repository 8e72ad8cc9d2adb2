"""The engine's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import corpus_queries, draft_queries, index_queries, overlap_queries, registry_queries, retrieval_queries, review_queries, structure_queries, unit_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (retrieval_queries, overlap_queries, corpus_queries, review_queries, structure_queries, draft_queries, registry_queries, unit_queries, index_queries)


def queries() -> dict[str, Query]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
