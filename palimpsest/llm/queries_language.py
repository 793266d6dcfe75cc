"""Registered queries on languages of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import language as L
from palimpsest.runtime import table


def _segments(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return L.label_segments(docs, L.fit_sample(docs), keep=("lang",)).toDF("doc_id", "label", "segment", "start", "end", "lang", "confidence", "sentences", "words")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    s = _segments(spark, root).where("sentences > 0")
    return s.where(~F.col("lang").eqNullSafe(L.named_language(F.col("label")))).select("doc_id", "lang").distinct()


def p8_segments(spark: SparkSession, root: str) -> DataFrame:
    return _segments(spark, root).drop("label")


def p8_documents(spark: SparkSession, root: str) -> DataFrame:
    """Every document: its label's language, its main language with confidence (null without a sentence in any)."""
    docs = table(spark, root, "documents").select("doc_id", L.named_language(F.col("lang")).alias("label_lang"))
    return docs.join(L.document_languages(_segments(spark, root)), "doc_id", "left")


QUERIES = {f.__name__: f for f in (p8_found, p8_segments, p8_documents)}
SQL: dict[str, str] = {}
