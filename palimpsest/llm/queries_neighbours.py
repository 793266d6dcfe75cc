"""Registered queries on similar vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.neighbours import nearest
from palimpsest.runtime import table

GROUPS = ["tenant_id", "model_key"]


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    near = nearest(table(spark, root, "memory_embedding"), "chunk_id", "embedding", GROUPS, at_least=0.88)
    return near.select(F.least("id", "neighbour").alias("chunk_id_a"), F.greatest("id", "neighbour").alias("chunk_id_b")).distinct()


def p4_nearest(spark: SparkSession, root: str) -> DataFrame:
    return nearest(table(spark, root, "memory_embedding"), "chunk_id", "embedding", GROUPS)


QUERIES = {f.__name__: f for f in (p4_found, p4_nearest)}
SQL: dict[str, str] = {}
