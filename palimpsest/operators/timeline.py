"""Timelines and feeds of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.corpus import LIVE


def timeline(document: DataFrame, version: DataFrame, limit: int = 20, visible: DataFrame | None = None, generation: str = LIVE) -> DataFrame:
    """Newest active versions of each tenant: tenant_id, document_id, version_id, kind, title, source, at, rank.

    Four times the limit (400 at most) are fetched before access is checked against `visible` (document_id), then cut to
    the limit; so fewer than `limit` may come out. Ties go to the smaller version id.
    """
    limit = max(1, min(100, int(limit)))
    v = version.where((F.col("status") == "active") & (F.col("generation") == generation)).select("tenant_id", "document_id", F.col("id").alias("version_id"), F.col("occurred_at").alias("at"))
    d = document.select("tenant_id", F.col("id").alias("document_id"), "kind", "title", F.concat_ws(":", "adapter", "external_ref").alias("source"))
    newest = Window.partitionBy("tenant_id").orderBy(F.desc("at"), "version_id")
    fetched = v.join(d, ["tenant_id", "document_id"]).withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= min(4 * limit, 400))
    if visible is not None:
        fetched = fetched.join(visible.select("document_id").distinct(), "document_id", "left_semi").withColumn("rank", F.row_number().over(newest))
    return fetched.where(F.col("rank") <= limit).select("tenant_id", "document_id", "version_id", "kind", "title", "source", "at", "rank")


def feed_rows(document: DataFrame, version: DataFrame, exclude_generator: Column | str | None = None) -> DataFrame:
    """Live versions that are active or superseded, as feed entries. A version without a generator is never excluded."""
    v = version.where((F.col("generation") == LIVE) & F.col("status").isin("active", "superseded") & F.col("feed_seq").isNotNull())
    if exclude_generator is not None:
        v = v.where(F.col("generator_agent_id").isNull() | (F.col("generator_agent_id") != exclude_generator))
    d = document.select("tenant_id", F.col("id").alias("document_id"), "kind", "title", "access_tags")
    v = v.select("tenant_id", "feed_seq", F.col("id").alias("version_id"), "document_id", "status", "created_by_kind", "generator_agent_id", "provenance", "occurred_at", F.col("ingested_at").alias("created_at"))
    return v.join(d, ["tenant_id", "document_id"]).select("feed_seq", "tenant_id", "version_id", "document_id", "kind", "title", "status", "created_by_kind", "generator_agent_id", "provenance", "occurred_at", "created_at", "access_tags")


def feed_page(feed: DataFrame, cursors: DataFrame, limit: int = 50) -> DataFrame:
    """The next page of each tenant after its cursor. cursors: tenant_id, after. The cursor for the page after it,
    `next_cursor`, is the page's last sequence number, whatever is filtered from the page later."""
    limit = max(1, min(100, int(limit)))
    w = Window.partitionBy("tenant_id").orderBy("feed_seq")
    page = feed.join(cursors, "tenant_id").where(F.col("feed_seq") > F.col("after")).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit)
    return page.withColumn("next_cursor", F.max("feed_seq").over(Window.partitionBy("tenant_id"))).drop("nth", "after")


def withheld(fetched: DataFrame, visible: DataFrame) -> DataFrame:
    """(tenant_id, withheld): rows of a timeline that access keeps back."""
    gone = fetched.join(visible.select("document_id").distinct(), "document_id", "left_anti")
    return fetched.select("tenant_id").distinct().join(gone.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("withheld")), "tenant_id", "left").fillna(0, ["withheld"])
