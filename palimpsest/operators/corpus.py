"""The tables of a corpus with rows delivered twice removed, and the predicates that every read begins with."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.runtime import table

LIVE = "live"


@dataclass
class Corpus:
    document: DataFrame
    version: DataFrame
    chunk: DataFrame
    embedding: DataFrame
    edge: DataFrame
    entity: DataFrame


def load(spark: SparkSession, root: str) -> Corpus:
    """The corpus under `root`. Rows are told apart by their ids, so that only ids decide what is shuffled where."""
    t = lambda n, *keys: table(spark, root, f"memory_{n}").dropDuplicates(list(keys))
    return Corpus(t("document", "id"), t("version", "id"), t("chunk", "id"), t("embedding", "chunk_id", "model_key"), t("edge", "id"), t("entity", "id"))


def scan(df: DataFrame, tenant: str | None = None, kinds: list[str] | None = None, statuses: list[str] | None = None, generation: str | None = None) -> DataFrame:
    """Tenant, kind, status and generation predicates; None or an empty list is no predicate. All reach the scan."""
    out = df
    for column, wanted in (("tenant_id", [tenant] if tenant is not None else None), ("kind", kinds), ("status", statuses), ("generation", [generation] if generation is not None else None)):
        if wanted:
            out = out.where(F.col(column).isin(*wanted))
    return out


def searchable(version: DataFrame, generation: str = LIVE, include_deprecated: bool = False) -> DataFrame:
    """Versions that search may return."""
    return scan(version, statuses=["active", "deprecated"] if include_deprecated else ["active"], generation=generation)


def linked_documents(documents: DataFrame, edge: DataFrame, entity_ids: DataFrame) -> DataFrame:
    """Documents with an edge to one of `entity_ids` (column entity_id), each once."""
    links = edge.where((F.col("from_type") == "document") & (F.col("to_type") == "entity")).select(F.col("tenant_id"), F.col("from_ref").alias("id"), F.col("to_ref").alias("entity_id"))
    return documents.join(links.join(entity_ids, "entity_id", "left_semi"), ["tenant_id", "id"], "left_semi")


def search_rows(corpus: Corpus, generation: str = LIVE, kinds: list[str] | None = None, include_deprecated: bool = False, entity_ids: DataFrame | None = None) -> DataFrame:
    """Chunks of searchable versions with what ranking needs, without their texts; with `entity_ids` (entity_id) only of
    documents that lead to one of them."""
    v = searchable(corpus.version, generation, include_deprecated).select(
        "tenant_id", F.col("id").alias("version_id"), "document_id", "occurred_at", "authority", "temporal_class", "valid_until", "provenance", "created_by_kind", "created_by_principal_id"
    )
    d = scan(corpus.document, kinds=kinds)
    if entity_ids is not None:
        d = linked_documents(d, corpus.edge, entity_ids)
    d = d.select("tenant_id", F.col("id").alias("document_id"), "title", "adapter", "external_ref")
    c = corpus.chunk.select("tenant_id", F.col("id").alias("chunk_id"), "version_id", "document_id")
    return c.join(v, ["tenant_id", "version_id", "document_id"]).join(d, ["tenant_id", "document_id"])


def open_target(adapter: Column, external_ref: Column, document_id: Column) -> Column:
    """What a citation opens: the record an adapter of the host stands for, else the document itself."""
    own = adapter.isin("artifact", "task", "workflow_run", "mail") & F.startswith(external_ref, F.concat(adapter, F.lit(":")))
    kind = F.when(own, adapter).otherwise("memory")
    ident = F.when(own, F.expr("substring(external_ref, length(adapter) + 2)")).otherwise(document_id)
    return F.struct(kind.alias("type"), ident.alias("id"))
