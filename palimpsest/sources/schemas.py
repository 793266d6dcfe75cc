"""Tables of the engine as explicit types, and the closed sets of values their columns may take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, I, L, D, B, TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType()
TAGS = T.ArrayType(S)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


DOCUMENT = _table(id=S, tenant_id=S, kind=S, title=S, adapter=S, external_ref=S, access_tags=TAGS, attributes=S, created_at=TS, last_seen_at=TS)
RAW_CAPTURE = _table(id=S, tenant_id=S, adapter=S, external_ref=S, fetched_at=TS, content_type=S, raw_text=S, metadata=S, source_hash=S)
VERSION = _table(
    id=S, tenant_id=S, document_id=S, version=I, supersedes_version_id=S, status=S, content_hash=S, occurred_at=TS, ingested_at=TS, deprecated_at=TS, deprecated_reason=S, created_by_principal_id=S,
    created_by_kind=S, generator_agent_id=S, authority=D, actor_count=I, has_social_signal=B, source_class=S, generation=S, provenance=S, temporal_class=S, valid_from=TS, valid_until=TS, feed_seq=L, retention_class=S,
)
CHUNK = _table(id=S, tenant_id=S, version_id=S, document_id=S, ordinal=I, text=S, role=S, created_at=TS)
ENTITY = _table(id=S, tenant_id=S, kind=S, identifiers=S, created_at=TS, updated_at=TS)
EDGE = _table(id=S, tenant_id=S, rel=S, from_type=S, from_ref=S, to_type=S, to_ref=S, created_at=TS)
EMBED_MODEL = _table(id=S, tenant_id=S, model_key=S, model_id=S, dims=I, status=S, created_at=TS, updated_at=TS)
EMBEDDING = _table(chunk_id=S, tenant_id=S, model_key=S, embedding=T.ArrayType(T.FloatType()))
TRANSFORM_CONFIG = _table(id=S, tenant_id=S, name=S, version=I, params=S, created_at=TS)
TRANSFORM_RUN = _table(id=S, tenant_id=S, config_id=S, generation=S, scope=S, status=S, raw_count=I, version_count=I, error=S, created_at=TS, completed_at=TS, archived_live_generation=S, archived_live_model_key=S, promoted_at=TS)
GRANT = _table(id=S, principal_id=S, resource=S, action=S, effect=S, origin=S, role_id=S, expires_at=TS, conditions=S)
FEED_LOG = _table(feed_seq=L, tenant_id=S, version_id=S, document_id=S, kind=S, title=S, status=S, created_by_kind=S, generator_agent_id=S, provenance=S, occurred_at=TS, created_at=TS, access_tags=TAGS)
TABLES = {
    "document": DOCUMENT, "raw_capture": RAW_CAPTURE, "version": VERSION, "chunk": CHUNK, "entity": ENTITY, "edge": EDGE, "embed_model": EMBED_MODEL, "embedding": EMBEDDING,
    "transform_config": TRANSFORM_CONFIG, "transform_run": TRANSFORM_RUN, "grant": GRANT, "feed_log": FEED_LOG,
}

#: Closed sets of values (fixed values).
REL = ("mentions", "about", "authored_by", "involves", "part_of", "derived_from", "supports", "contradicts", "supersedes")
REF_TYPE = ("document", "version", "chunk", "entity")
LINEAGE = ("native", "imported", "derived")
SOURCE_CLASS = ("native", "thread", "channel", "call", "record")
PROVENANCE = ("stated", "inferred", "unknown")
TEMPORAL_CLASS = ("event", "deadline", "state", "lesson")
RETENTION_CLASS = ("durable", "standard", "ephemeral", "source_only")
STATUS = ("active", "superseded", "deprecated", "archived", "tombstoned")
CREATED_BY_KIND = ("human", "agent", "system", "adapter")
CHANNEL = ("lexical", "dense", "structured")
EVIDENCE = ("strong", "weak", "none")
DEGRADE_FLAG = ("dense_unavailable", "rerank_unavailable", "rerank_query_too_long", "live_timeout", "live_error", "memory_unavailable", "lexical_only")
CAPTURE_DEGRADE = ("embed_unavailable", "lexical_only")
ENUMS: dict[tuple[str, str], tuple[str, ...]] = {
    ("edge", "rel"): REL,
    ("edge", "from_type"): REF_TYPE,
    ("edge", "to_type"): REF_TYPE,
    ("version", "status"): STATUS,
    ("version", "created_by_kind"): CREATED_BY_KIND,
    ("version", "source_class"): LINEAGE,
    ("version", "provenance"): PROVENANCE,
    ("version", "temporal_class"): TEMPORAL_CLASS,
    ("version", "retention_class"): RETENTION_CLASS,
    ("transform_run", "status"): ("running", "completed", "failed"),
    ("embed_model", "status"): ("ready", "active", "retired"),
}


def enum_violation(name: str) -> Column:
    """Name of the first column of table `name` whose value is outside its closed set; null if all are inside."""
    checks = [F.when(F.col(c).isNull() | ~F.col(c).isin(*v), F.lit(c)) for (t, c), v in ENUMS.items() if t == name]
    return F.coalesce(*checks) if checks else F.lit(None).cast("string")


def conform(df: DataFrame, name: str) -> DataFrame:
    """`df` with exactly the columns and types of table `name`; columns it lacks are null, extra ones are dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name].fields])
