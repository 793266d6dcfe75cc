"""Capture, versions, retention and re-derivation as functions from tables to tables.

Every verb takes the state before and gives the rows after; writing them is the store's part. Nothing is updated in
place, identifiers derive from content, and a verb done twice gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.hashing import record_id
from palimpsest.functions.scoring import authority
from palimpsest.operators.corpus import LIVE

EPHEMERAL_DAYS = 7


def defaults(adds: DataFrame) -> DataFrame:
    """Requests with write-time defaults filled in.

    A generator makes the actor an agent, the provenance inferred and the lineage derived; else human, stated, native.
    The temporal class is the one given, state for inferred records, else event.
    """
    agent = F.col("generator_agent_id").isNotNull()
    out = adds.withColumn("created_by_kind", F.when(agent, "agent").otherwise("human"))
    out = out.withColumn("provenance", F.coalesce("provenance", F.when(agent, "inferred").otherwise("stated"))).withColumn("lineage_class", F.coalesce("lineage_class", F.when(agent, "derived").otherwise("native")))
    out = out.withColumn("temporal_class", F.coalesce("temporal_class", F.when(F.col("provenance") == "inferred", "state").otherwise("event")))
    return out.withColumn("kind", F.coalesce("kind", F.lit("note"))).withColumn("authority", F.round(authority(F.col("created_by_kind"), F.lit(1), F.lit("native"), F.lit(False)), 7))


def rejects(adds: DataFrame) -> Column:
    """Why a request is refused, or null: title and kind must not be blank, a text must be there."""
    blank = lambda c: F.coalesce(F.regexp_replace(c, r"\s+", ""), F.lit("")) == ""
    return F.when(blank(F.col("title")), "title").when(F.col("kind").isNotNull() & blank(F.col("kind")), "kind").when(blank(F.col("text")), "text")


def dedupe_raw(captures: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New raw captures: the first of each tenant and source hash (by fetched_at, id) that is not there yet."""
    w = Window.partitionBy("tenant_id", "source_hash").orderBy("fetched_at", "id")
    one = captures.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
    return one if existing is None else one.join(existing.select("tenant_id", "source_hash"), ["tenant_id", "source_hash"], "left_anti")


def versions_of(log: DataFrame) -> DataFrame:
    """Successive versions of each document from a capture log: key columns, seq, version, status, supersedes_seq.

    log: tenant_id, document_id, seq, content_hash. A capture whose hash equals the one before is no new version. The
    last version is active, the others superseded; one log of a document is folded by a window in its own order.
    """
    w = Window.partitionBy("tenant_id", "document_id").orderBy("seq")
    changed = log.withColumn("before", F.lag("content_hash").over(w)).where(F.col("before").isNull() | (F.col("before") != F.col("content_hash"))).drop("before")
    out = changed.withColumn("version", F.row_number().over(w)).withColumn("supersedes_seq", F.lag("seq").over(w))
    return out.withColumn("status", F.when(F.lead("seq").over(w).isNull(), "active").otherwise("superseded"))


def capture(captures: DataFrame, version: DataFrame, generation: str = LIVE) -> DataFrame:
    """Version rows that a batch of captures adds, and the change to those they supersede.

    captures: tenant_id, document_id, seq, content_hash. version: the state. Result: tenant_id, document_id, id, version,
    content_hash, status, supersedes_version_id, is_new. Numbers go on from the greatest of any status, so a document
    whose versions were all withdrawn gets a fresh number. A capture equal to the active version is a no-op.
    """
    state = version.where(F.col("generation") == generation)
    key = ["tenant_id", "document_id"]
    active = state.where("status = 'active'").groupBy(*key).agg(F.max_by(F.struct("id", "content_hash"), "version").alias("active"))
    top = state.groupBy(*key).agg(F.max("version").alias("top"))
    log = captures.select(*key, "seq", "content_hash").join(active, key, "left").join(top, key, "left")
    w = Window.partitionBy(*key).orderBy("seq")
    before = F.coalesce(F.lag("content_hash").over(w), F.col("active.content_hash"))
    new = log.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("content_hash")))
    new = new.withColumn("version", F.coalesce("top", F.lit(0)) + F.row_number().over(w)).withColumn("id", record_id("kver", F.col("tenant_id"), F.col("document_id"), F.lit(generation), F.col("version")))
    new = new.withColumn("supersedes_version_id", F.coalesce(F.lag("id").over(w), F.col("active.id"))).withColumn("status", F.when(F.lead("seq").over(w).isNull(), "active").otherwise("superseded"))
    made = new.select(*key, "id", "version", "content_hash", "status", "supersedes_version_id", F.lit(True).alias("is_new"))
    old = state.where("status = 'active'").join(new.select(*key).distinct(), key, "left_semi").select(*key, "id", "version", "content_hash", F.lit("superseded").alias("status"), "supersedes_version_id", F.lit(False).alias("is_new"))
    return made.unionByName(old)


def latest_active(version: DataFrame) -> DataFrame:
    """The active version with the greatest number of each document and generation."""
    w = Window.partitionBy("tenant_id", "document_id", "generation").orderBy(F.desc("version"), "id")
    return version.where("status = 'active'").withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def owners(version: DataFrame) -> DataFrame:
    """(tenant_id, document_id, owner): who created the first version (by number, then time, then id)."""
    return version.groupBy("tenant_id", "document_id").agg(F.min_by("created_by_principal_id", F.struct("version", "ingested_at", "id")).alias("owner"))


def expired(now: Column) -> Column:
    """Whether an ephemeral version is past its end, or, without one, was ingested over a week ago."""
    return F.when(F.col("valid_until").isNotNull(), F.col("valid_until") < now).otherwise(F.col("ingested_at") < now - F.expr(f"interval {EPHEMERAL_DAYS} days"))


def _deprecated(version: DataFrame, which: Column, now: Column, reason: str | None) -> DataFrame:
    which = F.coalesce(which, F.lit(False))
    return (
        version.withColumn("changed", which)
        .withColumn("status", F.when(F.col("changed"), "deprecated").otherwise(F.col("status")))
        .withColumn("deprecated_at", F.when(F.col("changed"), now).otherwise(F.col("deprecated_at")))
        .withColumn("deprecated_reason", F.when(F.col("changed"), F.lit(reason)).otherwise(F.col("deprecated_reason")))
    )


def sweep_ephemeral(version: DataFrame, now: Column) -> DataFrame:
    """Deprecates active ephemeral versions that have expired; adds changed."""
    return _deprecated(version, (F.col("retention_class") == "ephemeral") & (F.col("status") == "active") & expired(now), now, "ephemeral_ttl")


def deprecate(version: DataFrame, ids: DataFrame, now: Column, reason: str | None = None) -> DataFrame:
    """Deprecates the named versions (tenant_id, id) that are active or superseded; adds changed."""
    named = version.join(ids.select("tenant_id", "id").distinct().withColumn("named", F.lit(True)), ["tenant_id", "id"], "left")
    return _deprecated(named, F.col("named") & F.col("status").isin("active", "superseded"), now, reason).drop("named")


def tombstone(version: DataFrame, chunk: DataFrame, documents: DataFrame, now: Column, reason: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Tombstones all versions of the named documents (tenant_id, document_id) and redacts their chunks: the changed
    versions and the changed chunks."""
    key = ["tenant_id", "document_id"]
    named = documents.select(*key).distinct()
    v = version.where(F.col("status").isin("active", "deprecated", "superseded")).join(named, key, "left_semi")
    v = v.withColumn("status", F.lit("tombstoned")).withColumn("deprecated_at", now).withColumn("deprecated_reason", F.lit(reason))
    c = chunk.join(v.select("tenant_id", F.col("id").alias("version_id")), ["tenant_id", "version_id"], "left_semi").withColumn("text", F.lit("[redacted]"))
    return v, c


def deletable(version: DataFrame, documents: DataFrame) -> DataFrame:
    """The named documents without a durable version that isn't tombstoned; only these may be deleted."""
    durable = version.where((F.col("retention_class") == "durable") & (F.col("status") != "tombstoned"))
    return documents.select("tenant_id", "document_id").distinct().join(durable, ["tenant_id", "document_id"], "left_anti")


def hard_delete(tables: dict[str, DataFrame], documents: DataFrame) -> dict[str, DataFrame]:
    """What is left of document, version, chunk and embedding after the named documents and all below them are gone.
    Documents that may not be deleted stay whole. Edges and raw captures stay."""
    gone = deletable(tables["version"], documents)
    chunks = tables["chunk"].join(gone, ["tenant_id", "document_id"], "left_semi").select("tenant_id", F.col("id").alias("chunk_id"))
    return {
        "document": tables["document"].join(gone.withColumnRenamed("document_id", "id"), ["tenant_id", "id"], "left_anti"),
        "version": tables["version"].join(gone, ["tenant_id", "document_id"], "left_anti"),
        "chunk": tables["chunk"].join(gone, ["tenant_id", "document_id"], "left_anti"),
        "embedding": tables["embedding"].join(chunks, ["tenant_id", "chunk_id"], "left_anti"),
    }


def set_retention(version: DataFrame, wanted: DataFrame) -> DataFrame:
    """Versions with the retention classes of `wanted` (tenant_id, id, retention_class), in all generations; adds changed."""
    w = wanted.select("tenant_id", "id", F.col("retention_class").alias("wanted"))
    return version.join(w, ["tenant_id", "id"], "left").withColumn("changed", F.coalesce(F.col("wanted") != F.col("retention_class"), F.lit(False))).withColumn("retention_class", F.coalesce("wanted", "retention_class")).drop("wanted")


def upsert_entities(hints: DataFrame, entity: DataFrame) -> DataFrame:
    """New entities for hints (tenant_id, kind, identifier) that no entity with that kind and identifier stands for."""
    known = entity.select("tenant_id", "kind", F.get_json_object("identifiers", "$.value").alias("identifier"))
    new = hints.select("tenant_id", "kind", "identifier").where("identifier is not null").distinct().join(known, ["tenant_id", "kind", "identifier"], "left_anti")
    return new.select(record_id("kent", F.col("tenant_id"), F.col("kind"), F.col("identifier")).alias("id"), "tenant_id", "kind", F.to_json(F.struct(F.col("identifier").alias("value"))).alias("identifiers"))


def upsert_edges(new: DataFrame, edge: DataFrame) -> DataFrame:
    """Edges of `new` whose six fields no stored edge has, each once, with their identifiers."""
    key = ["tenant_id", "rel", "from_type", "from_ref", "to_type", "to_ref"]
    return new.select(*key).distinct().join(edge.select(*key), key, "left_anti").select(record_id("kedg", *[F.col(k) for k in key]).alias("id"), *key)


def next_config_version(configs: DataFrame) -> DataFrame:
    """(tenant_id, name, next_version): one more than the greatest version so far."""
    return configs.groupBy("tenant_id", "name").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def promotable(run_status: str) -> bool:
    return run_status == "completed"


def promoted(version: DataFrame, tenant: Column, generation: Column, archive: Column) -> DataFrame:
    """Generations after a promotion: what was live becomes the archive, the staged one becomes live; adds changed."""
    mine = F.col("tenant_id") == tenant
    to = F.when(mine & (F.col("generation") == LIVE), archive).when(mine & (F.col("generation") == generation), F.lit(LIVE)).otherwise(F.col("generation"))
    return version.withColumn("changed", to != F.col("generation")).withColumn("generation", to)


def run_progress(rows: DataFrame) -> DataFrame:
    """Counts of a replay: run_id, raw_count, version_count, failed, status, error (the first by order).
    rows: run_id, ord, error (null: derived), made (a version came of it)."""
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("raw_count"), F.count_if("made").alias("version_count"), F.count("error").alias("failed"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("ord"))).alias("first")).select(
        "run_id", "raw_count", "version_count", "failed", F.when(F.col("failed") > 0, "failed").otherwise("completed").alias("status"), F.when(F.col("failed") > 0, F.concat(F.col("failed"), F.lit("/"), F.col("raw_count"), F.lit(" raw_capture row(s) failed: "), F.col("first"))).alias("error")
    )


def raw_scan(raw: DataFrame, tenant: str, adapter: str | None = None, since=None, until=None) -> DataFrame:
    """Raw captures of a tenant within a scope, both times inclusive; the predicates reach the scan."""
    out = raw.where(F.col("tenant_id") == tenant)
    if adapter is not None:
        out = out.where(F.col("adapter") == adapter)
    if since is not None:
        out = out.where(F.col("fetched_at") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        out = out.where(F.col("fetched_at") <= F.lit(until).cast("timestamp_ntz"))
    return out


def append_tags(document: DataFrame, more: DataFrame) -> DataFrame:
    """Documents with the tags of `more` (tenant_id, id, tags) added, each once, after their own."""
    out = document.join(more.select("tenant_id", "id", "tags"), ["tenant_id", "id"], "left")
    none = F.array().cast("array<string>")
    return out.withColumn("access_tags", F.when(F.col("tags").isNotNull(), F.array_union(F.coalesce("access_tags", none), "tags")).otherwise(F.col("access_tags"))).drop("tags")


def parse_raw(raw: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Raw captures whose payload parses, with the parsed `payload`, and those whose payload doesn't."""
    parsed = raw.withColumn("payload", F.from_json("raw_text", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("payload").isNull() | F.col("payload._bad").isNotNull()
    return parsed.where(~bad), parsed.where(bad).drop("payload")


def inferred_to_state(version: DataFrame) -> DataFrame:
    """Inferred versions that were taken for events become states; adds changed."""
    which = F.coalesce((F.col("provenance") == "inferred") & (F.col("temporal_class") == "event"), F.lit(False))
    return version.withColumn("changed", which).withColumn("temporal_class", F.when(which, "state").otherwise(F.col("temporal_class")))
