"""Registered queries on near-duplicates of chunk texts and feed titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import neardup as N
from palimpsest.runtime import table

CHUNKS = N.Kind("memory_chunk", run=3, least=5, distinct=False, threshold=0.6, rows=3)
TITLES = N.Kind("feed_entry", run=1, least=4, distinct=True, threshold=0.6, rows=5)


def _similar(spark: SparkSession, root: str) -> N.Similar:
    return N.similar_sets(
        [
            (table(spark, root, "memory_chunk"), CHUNKS, "id", "text", None),
            (table(spark, root, "feed_entry"), TITLES, "version_id", "title", "document_id"),
        ]
    )


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return N.record_pairs(_similar(spark, root))


def p1_links(spark: SparkSession, root: str) -> DataFrame:
    """Alike sets, one row for each pair of them; `p1_groups` has the records of each set."""
    return _similar(spark, root).pairs


def p1_groups(spark: SparkSession, root: str) -> DataFrame:
    return N.record_groups(_similar(spark, root))


QUERIES = {f.__name__: f for f in (p1_found, p1_links, p1_groups)}
SQL: dict[str, str] = {}
