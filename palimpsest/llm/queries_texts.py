"""Registered queries: splitting, encoding, packing and choosing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.pack import CAPACITY, best_fit, fill_containers, lower_bound
from palimpsest.llm.split import split_texts
from palimpsest.llm.subset import choose_varied
from palimpsest.llm.tokenize import count_tokens, encode_texts
from palimpsest.runtime import table


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return choose_varied(table(spark, root, "mmr_item"), table(spark, root, "mmr_pool"), alike=0.9, fill=False).select("pool_id", "id")


def p3_subset(spark: SparkSession, root: str) -> DataFrame:
    return choose_varied(table(spark, root, "mmr_item"), table(spark, root, "mmr_pool"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    pieces = split_texts(table(spark, root, "memory_chunk"))
    return pieces.groupBy(F.col("id").alias("chunk_id")).agg(F.when(F.bool_or(F.col("cut") == "forced"), "forced").otherwise("natural").alias("cut"))


def p5_pieces(spark: SparkSession, root: str) -> DataFrame:
    return split_texts(table(spark, root, "memory_chunk")).dropDuplicates(["id", "ordinal"]).withColumnRenamed("id", "chunk_id")


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return encode_texts(table(spark, root, "documents"))


def p6_offsets(spark: SparkSession, root: str) -> DataFrame:
    return encode_texts(table(spark, root, "documents"), offsets="offsets")


def p7_containers(spark: SparkSession, root: str) -> DataFrame:
    return fill_containers(count_tokens(table(spark, root, "documents")))


def p7_summary(spark: SparkSession, root: str) -> DataFrame:
    """One row: containers, items and unused space, beside the lower bound and the count of the best-fit packing."""
    placed = p7_containers(spark, root)
    counts = np.zeros(CAPACITY + 1, np.int64)
    for size, n in placed.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect():  # at most CAPACITY rows
        counts[size] = n
    per = placed.groupBy("container").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("n_items"))
    return per.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("n_items").alias("n_items"),
        F.sum("used").alias("used"),
        (F.count(F.lit(1)) * CAPACITY - F.sum("used")).alias("unused"),
        F.lit(lower_bound(counts, CAPACITY)).alias("lower_bound"),
        F.lit(sum(times for _, times in best_fit(counts, CAPACITY))).alias("best_fit_containers"),
    )


_LONG = r"'[^\s\x{3002}]{1000}[^\s\x{3002}]{1000}[^\s\x{3002}]{801}'"
QUERIES = {f.__name__: f for f in (p3_found, p3_subset, p5_found, p5_pieces, p6_ids, p6_offsets, p7_containers, p7_summary)}
SQL = {
    "p5_found": f"select distinct id as chunk_id, case when regexp_matches(text, {_LONG}) then 'forced' else 'natural' end as cut from memory_chunk where length(text) > 2800",
}
