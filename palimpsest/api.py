"""The plane: adding, searching, listing and feeding documents of a store, and the verbs of their lifecycle.

A thin layer: it checks arguments, builds the DataFrames of one call, and commits what the operators give. Batches of
many requests or queries should use the operators themselves.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import validate as V
from palimpsest.functions import hashing as H
from palimpsest.functions import scoring as S
from palimpsest.functions.text import lexemes, snippet
from palimpsest.operators import access, chunker, lifecycle, search, timeline
from palimpsest.operators.corpus import LIVE, Corpus, search_rows
from palimpsest.runtime import durable
from palimpsest.sources import schemas as T
from palimpsest.sources.embedding import Embedder, Models, embed_chunks, probe_dims, upsert_embeddings
from palimpsest.sources.live import SourceProvider, collect_live, live_frame
from palimpsest.sources.store import SnapshotStore


class Memory:
    """One store with what it is searched by. `conditions` says which named conditions of grants hold just now."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        embedder: Embedder | None = None,
        model: tuple[str, str] = ("local", "default"),
        reranker: Callable | None = None,
        sources: Sequence[SourceProvider] = (),
        language: str = "simple",
        clock: Callable[[], datetime] = datetime.utcnow,
        conditions: dict[str, Callable[[], bool]] | None = None,
    ):
        self.conditions = conditions
        self.spark, self.store, self.embedder, self.reranker, self.sources, self.language, self.clock = spark, SnapshotStore(spark, root), embedder, reranker, list(sources), language, clock
        self.store.bootstrap(language)
        self.dims = probe_dims(embedder) if embedder else None
        self.model_key = H.model_key(*model) if embedder else None
        self.model = model

    def close(self) -> None:
        self.sources = []

    @property
    def capabilities(self) -> dict:
        return {"embeddings_configured": self.embedder is not None}

    def _now(self):
        return F.lit(self.clock()).cast("timestamp_ntz")

    def _corpus(self, tenant_id: str) -> Corpus:
        return Corpus(*(self.store.versions(tenant_id) if n == "version" else self.store.read(n, tenant_id) for n in ("document", "version", "chunk", "embedding", "edge", "entity")))

    # adding -----------------------------------------------------------------------------------------------------------

    def add(self, tenant_id: str, principal_id: str, title: str, text: str, kind: str = "note", external_ref: str | None = None, adapter: str = "http", access_tags: Sequence[str] = (), peers: Sequence[str] = (), attributes: dict | None = None,
            generator_agent_id: str | None = None, provenance: str | None = None, temporal_class: str | None = None, valid_until: str | None = None, derived_from: Sequence[str] = (), occurred_at: datetime | None = None, entities: Sequence[tuple[str, str]] = (), edges: Sequence[tuple[str, str, str]] = ()) -> dict:
        """Adds one document or a new version of it; gives its ids, `captured` or `noop`, and what was degraded.

        entities: (kind, identifier) that must be known. edges: (rel, type, ref) from the document; a ref of type `native`
        is a principal's identifier and leads to its entity. Document, raw capture, version, chunks, entities and edges
        become visible in one commit.
        """
        for rel, kind_, _ in edges:
            V.one_of(rel, T.REL, "rel"), V.one_of(kind_, (*T.REF_TYPE, "native"), "to_type")
        V.non_blank(tenant_id, "tenant_id"), V.non_blank(principal_id, "principal_id")
        V.bounded(V.non_blank(title, "title"), "title", V.TITLE), V.bounded(V.non_blank(kind, "kind"), "kind", V.KIND), V.non_blank(text, "text")
        if provenance is not None:
            V.one_of(provenance, T.PROVENANCE, "provenance")
        if temporal_class is not None:
            V.one_of(temporal_class, T.TEMPORAL_CLASS, "temporal_class")
        now = self.clock()
        reference = external_ref or f"{adapter}:{uuid.uuid4().hex}"
        bag = json.dumps(attributes or {}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        row = self.spark.createDataFrame(
            [(tenant_id, principal_id, title, kind, adapter, reference, list(access_tags), list(peers), bag, text, generator_agent_id, provenance, None, temporal_class, V.moment(valid_until, "valid_until"), occurred_at or now)],
            "tenant_id string, principal string, title string, kind string, adapter string, external_ref string, explicit array<string>, peers array<string>, attributes string, text string, generator_agent_id string, provenance string, lineage_class string, temporal_class string, valid_until timestamp_ntz, occurred_at timestamp_ntz",
        )
        row = lifecycle.defaults(row).withColumn("document_id", H.record_id("kdoc", F.col("tenant_id"), F.col("adapter"), F.col("external_ref")))
        row = row.withColumn("access_tags", access.access_tags(F.col("principal"), F.col("explicit"), F.lit(None).cast("string"), F.col("peers"), F.array().cast("array<string>")))
        row = row.withColumn("chunks", chunker.chunk_udf()(F.col("text"))).withColumn("content_hash", H.content_hash(F.col("title"), F.col("kind"), F.col("external_ref"), F.col("attributes"), F.transform("chunks", lambda c: c["text"]))).withColumn("seq", F.lit(1))
        row = row.cache()
        versions = self.store.read("version", tenant_id)
        plan = lifecycle.capture(row.select("tenant_id", "document_id", "seq", "content_hash"), versions).collect()  # one document: at most two rows
        new = [p for p in plan if p.is_new]
        first = row.select("document_id").first()
        payload = F.to_json(F.struct("title", "kind", "external_ref", "attributes", "text", "access_tags", "principal", "generator_agent_id", "provenance", "temporal_class", "valid_until"))
        raw = row.select("*", payload.alias("raw_text")).withColumn("source_hash", H.source_hash(F.col("adapter"), F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.col("raw_text")))
        raw = raw.select(H.record_id("kraw", F.col("tenant_id"), F.col("source_hash")).alias("id"), "tenant_id", "adapter", "external_ref", F.col("occurred_at").alias("fetched_at"), F.lit("application/json").alias("content_type"), "raw_text", F.lit("{}").alias("metadata"), "source_hash")
        raw = lifecycle.dedupe_raw(raw, self.store.read("raw_capture", tenant_id))
        old_docs = self.store.read("document", tenant_id)
        touched = row.select(F.col("document_id").alias("id"), "tenant_id", "kind", "title", "adapter", "external_ref", "access_tags", "attributes", F.lit(now).cast("timestamp_ntz").alias("created_at"), F.lit(now).cast("timestamp_ntz").alias("last_seen_at"))
        before = old_docs.where(F.col("id") == first.document_id).select("created_at", "access_tags").head(1)
        if before:
            touched = touched.withColumn("created_at", F.lit(before[0].created_at).cast("timestamp_ntz"))
            if not new:  # an unchanged text leaves the document as it is, but for the time it was seen
                touched = old_docs.where(F.col("id") == first.document_id).withColumn("last_seen_at", F.lit(now).cast("timestamp_ntz"))
        docs = old_docs.where(F.col("id") != first.document_id).unionByName(touched)
        if not new:
            self.store.commit(tenant_id, replace={"document": docs}, append={"raw_capture": raw})
            row.unpersist()
            return {"status": "noop", "document_id": first.document_id, "version_id": next((p.id for p in plan), None), "chunks": 0, "degraded": []}
        v = new[-1]
        seq = self.store.last_feed_seq() + 1
        made = row.select(
            F.lit(v.id).alias("id"), "tenant_id", "document_id", F.lit(v.version).alias("version"), F.lit(v.supersedes_version_id).alias("supersedes_version_id"), F.lit("active").alias("status"), "content_hash", "occurred_at", F.lit(now).cast("timestamp_ntz").alias("ingested_at"),
            F.col("principal").alias("created_by_principal_id"), "created_by_kind", "generator_agent_id", "authority", F.lit(1).alias("actor_count"), F.lit(False).alias("has_social_signal"), F.col("lineage_class").alias("source_class"), F.lit(LIVE).alias("generation"), "provenance",
            "temporal_class", "valid_until", F.lit(seq).alias("feed_seq"), F.lit("standard").alias("retention_class"),
        )
        kept = versions.withColumn("status", F.when(F.col("id") == v.supersedes_version_id, "superseded").otherwise(F.col("status"))) if v.supersedes_version_id else versions
        chunks = row.select("tenant_id", F.lit(v.id).alias("version_id"), "document_id", F.inline("chunks")).select(H.record_id("kchk", F.col("document_id"), F.col("version_id"), F.col("ordinal")).alias("id"), "tenant_id", "version_id", "document_id", "ordinal", "text", F.lit(None).cast("string").alias("role"), F.lit(now).cast("timestamp_ntz").alias("created_at"))
        entry = made.select("feed_seq", "tenant_id", F.col("id").alias("version_id"), "document_id", F.lit(kind).alias("kind"), F.lit(title).alias("title"), "status", "created_by_kind", "generator_agent_id", "provenance", "occurred_at", F.col("ingested_at").alias("created_at"))
        entry = entry.join(row.select("document_id", "access_tags"), "document_id")
        hints = [(tenant_id, k, i) for k, i in (*entities, *(("principal", ref) for _, kind_, ref in edges if kind_ == "native"))]
        asked = self.spark.createDataFrame(hints, "tenant_id string, kind string, identifier string")
        known = self.store.read("entity", tenant_id)
        fresh = lifecycle.upsert_entities(asked, known).withColumn("created_at", F.lit(now).cast("timestamp_ntz")).withColumn("updated_at", F.col("created_at"))
        all_ = T.conform(known, "entity").unionByName(T.conform(fresh, "entity"))
        person = all_.where("kind = 'principal'").select(F.get_json_object("identifiers", "$.value").alias("ref"), "id").groupBy("ref").agg(F.min("id").alias("id"))
        ends = self.spark.createDataFrame([(tenant_id, rel, "document", first.document_id, kind_, ref) for rel, kind_, ref in edges], "tenant_id string, rel string, from_type string, from_ref string, to_type string, ref string")
        ends = ends.join(person, "ref", "left").withColumn("native", F.col("to_type") == "native")
        ends = ends.select("tenant_id", "rel", "from_type", "from_ref", F.when(F.col("native"), "entity").otherwise(F.col("to_type")).alias("to_type"), F.when(F.col("native"), F.col("id")).otherwise(F.col("ref")).alias("to_ref"))
        edges = self.spark.createDataFrame([(tenant_id, "derived_from", "version", v.id, "version", d) for d in derived_from], "tenant_id string, rel string, from_type string, from_ref string, to_type string, to_ref string")
        edges = lifecycle.upsert_edges(edges.unionByName(ends), self.store.read("edge", tenant_id)).withColumn("created_at", F.lit(now).cast("timestamp_ntz"))
        self.store.commit(tenant_id, replace={"document": docs, "version": kept.unionByName(T.conform(made, "version"))}, append={"raw_capture": raw, "chunk": chunks, "edge": edges, "entity": fresh, "feed_log": entry}, feed_seq=seq)
        degraded = self._embed(tenant_id, v.id, now)
        n = self.store.read("chunk", tenant_id).where(F.col("version_id") == v.id).count()
        row.unpersist()
        return {"status": "captured", "document_id": first.document_id, "version_id": v.id, "chunks": n, "degraded": degraded}

    def _embed(self, tenant_id: str, version_id: str, now: datetime) -> list[str]:
        """Embeds a version's chunks after its commit; a failure degrades the document to lexical search only."""
        if self.embedder is None:
            return ["lexical_only"]
        chunks = self.store.read("chunk", tenant_id).where(F.col("version_id") == version_id).withColumnRenamed("id", "chunk_id")
        done = embed_chunks(chunks, self.embedder, self.model_key, self.dims).cache()
        failed = done.where("rejected").count()
        models = Models(self.spark, self.store.read("embed_model", tenant_id))
        models.ensure(tenant_id, *self.model, self.dims, now)
        if models.active(tenant_id) is None:
            models.activate(tenant_id, self.model_key, now)
        self.store.commit(tenant_id, replace={"embedding": upsert_embeddings(self.store.read("embedding", tenant_id), done), "embed_model": models.rows})
        done.unpersist()
        return ["embed_unavailable"] if failed else []

    # searching --------------------------------------------------------------------------------------------------------

    def search(self, tenant_id: str, principal_id: str, query: str = "", limit: int | None = None, kinds: Sequence[str] = (), sources: Sequence[str] = (), grants: DataFrame | None = None, generation: str = LIVE, include_deprecated: bool = False, entity_ids: Sequence[str] = ()) -> dict:
        """Hits of one query, best first, with how good the evidence is and what was degraded. Of `grants`, or else of those
        that the store holds, and of what the principal created depends what is shown; evidence that rests on nothing
        shown is none."""
        k = V.limit(limit, V.SEARCH_LIMIT, 8)
        query = query.strip()
        if not query and not kinds and not entity_ids:
            raise V.PlaneError(400, "a query or a filter is needed")
        local = not sources or "local" in sources
        out, flags = {"hits": [], "evidence": "none", "degraded": flags_of([])}, []
        c = self._corpus(tenant_id)
        one = lambda name: getattr(c, name).where(F.col("tenant_id") == tenant_id)
        c = Corpus(*[one(n) for n in ("document", "version", "chunk", "embedding", "edge", "entity")])
        hits = None
        if local:
            q = self.spark.createDataFrame([(1, tenant_id, query)], "query_id long, tenant_id string, query_text string").withColumn("terms", lexemes(F.col("query_text"), self.language))
            wanted = self.spark.createDataFrame([(e,) for e in entity_ids], "entity_id string") if entity_ids else None
            rows = search_rows(c, generation, list(kinds) or None, include_deprecated, wanted)
            texts = c.chunk.select("tenant_id", F.col("id").alias("chunk_id"), "text")
            n = S.overfetch(k)
            if query:
                lexical = search.lexical_topk(search.lexical_matches(q, texts, self.language), rows, n)
            else:
                newest = rows.orderBy(F.desc("occurred_at"), "chunk_id").limit(n).select(F.lit(1).cast("long").alias("query_id"), "chunk_id", F.lit(0.0).alias("ts_rank"))
                lexical = search.lexical_topk(newest.select("query_id", "chunk_id", "ts_rank"), rows, n)
            if self.embedder is not None and query:
                try:
                    vector = [float(x) for x in self.embedder([query])[0]]
                    active = Models(self.spark, self.store.read("embed_model", tenant_id)).active(tenant_id)
                    key = active.model_key if generation == LIVE and active else self.model_key
                    qv = self.spark.createDataFrame([(1, tenant_id, key, vector)], "query_id long, tenant_id string, model_key string, vector array<float>")
                    dense = search.dense_topk(qv, c.embedding.join(rows.select("chunk_id"), "chunk_id", "left_semi"), n, self.dims)
                except Exception:
                    flags.append("dense_unavailable")
                    dense = None
            else:
                flags.append("dense_unavailable")
                dense = None
            if dense is None:
                dense = self.spark.createDataFrame([], "query_id long, chunk_id string, cosine double, rank int")
            cand = search.attach_corroboration(search.fuse(lexical, dense).join(rows, "chunk_id"), c.edge).cache()
            if self.reranker is not None and query:
                raw = search.dedupe_documents(cand, F.col("fused")).where("rank <= 50")
                ranked = raw.join(search.rerank(raw.join(texts.drop("tenant_id"), "chunk_id"), q, self.reranker), ["query_id", "chunk_id"])
                final = search.boosted(ranked.withColumn("score", F.col("rerank_score")), self._now())
                vectors = c.embedding.groupBy("chunk_id").agg(F.min_by("embedding", "model_key").alias("vector"))
                order = search.mmr(final.select("query_id", "chunk_id", F.col("final").alias("score")).join(vectors, "chunk_id", "left"), k, dims=self.dims or 64)
                top = final.drop("score", "rank").withColumnRenamed("final", "score").join(order.withColumnRenamed("position", "rank"), ["query_id", "chunk_id"])
                best = top.where("rank = 1")
            else:
                flags.append("rerank_unavailable")
                top, best = search.dedupe_documents(cand, S.authority_weighted(F.col("fused"), F.col("authority"))).where(F.col("rank") <= k), None
            n_hits = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
            label = search.evidence(cand, n_hits, best).head(1)
            out["evidence"] = label[0].evidence if label else "none"
            shown = top.join(texts.select("chunk_id", snippet(F.col("text")).alias("snippet")), "chunk_id").join(search.entity_ids(c.edge), ["tenant_id", "document_id"], "left").join(search.derived_from(c.edge), ["tenant_id", "version_id"], "left")
            hits = shown.join(self._visible(c, principal_id, grants).select("document_id"), "document_id", "left_semi")
        if self.sources and (not sources or any(s != "local" for s in sources)):
            live = collect_live(self.sources, query, tenant_id, principal_id, k, [s for s in sources if s != "local"] or None)
            flags += live.degraded
            mine = (hits if hits is not None else None)
            items = live_frame(self.spark, live).select(F.lit(1).cast("long").alias("query_id"), F.lit("live").alias("channel"), F.monotonically_increasing_id().alias("pos"), "source_id", "adapter", "external_ref", "title", "score", "updated_at")
            if mine is not None:
                items = mine.select("query_id", F.lit("local").alias("channel"), F.col("rank").cast("long").alias("pos"), F.lit("local").alias("source_id"), "adapter", "external_ref", "title", "score", F.lit(None).cast("timestamp_ntz").alias("updated_at")).unionByName(items)
            out["merged"] = [r.asDict() for r in search.merge_local_live(items, self._now(), list(sources) or None, k).orderBy("rank").collect()]
        if hits is not None:
            names = ("rank", "chunk_id", "document_id", "version_id", "title", "adapter", "external_ref", "score", "channels", "supports", "contradicts", "snippet", "entity_ids", "derived_from")
            out["hits"] = [r.asDict() for r in hits.select(*names).orderBy("rank").collect()]
            cand.unpersist()
        if not out["hits"]:
            out["evidence"] = "none"
        out["degraded"] = flags_of(flags)
        return out

    # reading ----------------------------------------------------------------------------------------------------------

    def list(self, tenant_id: str, principal_id: str, limit=None, grants: DataFrame | None = None) -> list[dict]:
        n = V.limit(limit, V.LIST_LIMIT, 20)
        c = self._corpus(tenant_id)
        visible = self._visible(c, principal_id, grants)
        return [r.asDict() for r in timeline.timeline(c.document.where(F.col("tenant_id") == tenant_id), c.version, n, visible).orderBy("rank").collect()]

    def _visible(self, c: Corpus, principal_id: str, grants: DataFrame | None) -> DataFrame:
        """The documents that a principal may see by the grants given, or else by the store's; always those it created."""
        d = access.creators(c.document, c.version).select(F.col("id").alias("document_id"), "access_tags", "creator")
        held = access.effective_grants(self.store.read("grant") if grants is None else grants, self._now(), self.conditions)
        return access.visible_documents(d, held, self.spark.createDataFrame([(principal_id,)], "principal_id string"))

    def feed(self, tenant_id: str, principal_id: str, after=None, limit=None, exclude_generator: str | None = None, grants: DataFrame | None = None) -> dict:
        n, start = V.limit(limit, V.FEED_LIMIT, 50), V.cursor(after)
        c = self._corpus(tenant_id)
        rows = timeline.feed_rows(c.document.where(F.col("tenant_id") == tenant_id), c.version, exclude_generator)
        page = timeline.feed_page(rows, self.spark.createDataFrame([(tenant_id, start)], "tenant_id string, after long"), n).cache()
        end = page.agg(F.max("next_cursor")).first()[0]
        shown = page.join(self._visible(c, principal_id, grants).select("document_id"), "document_id", "left_semi")
        entries = [r.asDict() for r in shown.drop("next_cursor", "access_tags").orderBy("feed_seq").collect()]
        page.unpersist()
        return {"entries": entries, "next_cursor": end}

    # lifecycle --------------------------------------------------------------------------------------------------------

    def _owned(self, tenant_id: str, principal_id: str, document_id: str) -> None:
        row = lifecycle.owners(self.store.read("version", tenant_id).where((F.col("tenant_id") == tenant_id) & (F.col("document_id") == document_id))).head(1)
        if not row:
            raise V.PlaneError(404, "no such document")
        if row[0].owner != principal_id:
            raise V.PlaneError(403, "only the owner may do this")

    def _version(self, tenant_id: str, version_id: str):
        row = self.store.read("version", tenant_id).where((F.col("tenant_id") == tenant_id) & (F.col("id") == version_id)).head(1)
        if not row:
            raise V.PlaneError(404, "no such version")
        return row[0]

    def deprecate_version(self, tenant_id: str, principal_id: str, version_id: str, reason: str | None = None) -> dict:
        self._owned(tenant_id, principal_id, self._version(tenant_id, version_id).document_id)
        ids = self.spark.createDataFrame([(tenant_id, version_id)], "tenant_id string, id string")
        after = lifecycle.deprecate(self.store.read("version", tenant_id), ids, self._now(), reason)
        changed = after.where("changed").count()
        self.store.commit(tenant_id, replace={"version": after})
        return {"changed": changed}

    def tombstone_document(self, tenant_id: str, principal_id: str, document_id: str, reason: str | None = None) -> dict:
        self._owned(tenant_id, principal_id, document_id)
        named = self.spark.createDataFrame([(tenant_id, document_id)], "tenant_id string, document_id string")
        version, chunk = self.store.read("version", tenant_id), self.store.read("chunk", tenant_id)
        v, c = lifecycle.tombstone(version, chunk, named, self._now(), reason)
        n = v.count()
        gone = self.store.read("embedding", tenant_id).join(c.select("tenant_id", F.col("id").alias("chunk_id")), ["tenant_id", "chunk_id"], "left_anti")
        keep = lambda all_, new, name: T.conform(all_, name).join(new.select("id"), "id", "left_anti").select(*T.TABLES[name].names).unionByName(T.conform(new, name))
        self.store.commit(tenant_id, replace={"version": keep(version, v, "version"), "chunk": keep(chunk, c, "chunk"), "embedding": gone})
        return {"versions": n}

    def hard_delete_document(self, tenant_id: str, principal_id: str, document_id: str) -> dict:
        self._owned(tenant_id, principal_id, document_id)
        named = self.spark.createDataFrame([(tenant_id, document_id)], "tenant_id string, document_id string")
        if not lifecycle.deletable(self.store.read("version", tenant_id), named).head(1):
            return {"deleted": False, "reason": "a durable version is not tombstoned"}
        self.store.commit(tenant_id, replace=lifecycle.hard_delete({n: self.store.read(n) for n in ("document", "version", "chunk", "embedding")}, named))
        return {"deleted": True}

    def sweep_ephemeral(self, tenant_id: str) -> dict:
        v = self.store.read("version", tenant_id)
        mine = lifecycle.sweep_ephemeral(v.where(F.col("tenant_id") == tenant_id), self._now())
        n = mine.where("changed").count()
        self.store.commit(tenant_id, replace={"version": v.where(F.col("tenant_id") != tenant_id).unionByName(mine.drop("changed"))})
        return {"versions_deprecated": n}

    def set_retention_class(self, tenant_id: str, principal_id: str, version_id: str, retention_class: str) -> dict:
        V.one_of(retention_class, T.RETENTION_CLASS, "retention_class")
        self._owned(tenant_id, principal_id, self._version(tenant_id, version_id).document_id)
        wanted = self.spark.createDataFrame([(tenant_id, version_id, retention_class)], "tenant_id string, id string, retention_class string")
        after = lifecycle.set_retention(self.store.read("version", tenant_id), wanted)
        n = after.where("changed").count()
        self.store.commit(tenant_id, replace={"version": after})
        return {"changed": n}

    def share(self, tenant_id: str, principal_id: str, document_id: str, principals: Sequence[str]) -> dict:
        """Lets peers find a document: tags it with its own tag and writes a grant on that tag for each of them."""
        self._owned(tenant_id, principal_id, document_id)
        named = self.spark.createDataFrame([(tenant_id, document_id, principal_id, list(principals))], "tenant_id string, document_id string, sharer string, principals array<string>")
        new = access.share_grants(named).cache()
        tags = named.select("tenant_id", F.col("document_id").alias("id"), F.array(access.document_tag(F.col("document_id"))).alias("tags"))
        grants = access.put_grants(self.store.read("grant", tenant_id), T.conform(new, "grant"))
        self.store.commit(tenant_id, replace={"document": lifecycle.append_tags(self.store.read("document", tenant_id), tags), "grant": grants})
        n = new.count()
        new.unpersist()
        return {"written": n}

    def grants(self) -> DataFrame:
        """The grants the store holds."""
        return self.store.read("grant")

    # re-derivation ----------------------------------------------------------------------------------------------------

    def create_transform_config(self, tenant_id: str, name: str, params: dict) -> dict:
        mine = self.store.read("transform_config", tenant_id).where((F.col("tenant_id") == tenant_id) & (F.col("name") == V.non_blank(name, "name")))
        number = (mine.agg(F.max("version")).first()[0] or 0) + 1
        ident = f"tcfg_{uuid.uuid4().hex[:22]}"
        self.store.commit(tenant_id, append={"transform_config": self.spark.createDataFrame([(ident, tenant_id, name, number, json.dumps(params, sort_keys=True), self.clock())], T.TRANSFORM_CONFIG)})
        return {"id": ident, "version": number}

    def list_transform_configs(self, tenant_id: str) -> list[dict]:
        return [r.asDict() for r in self.store.read("transform_config", tenant_id).where(F.col("tenant_id") == tenant_id).orderBy(F.desc("created_at"), "id").collect()]

    def run_transform(self, tenant_id: str, config_id: str, adapter: str | None = None, since: datetime | None = None, until: datetime | None = None) -> dict:
        """Derives a new generation from the raw captures under a configuration. Captures that don't parse are counted and
        don't stop the others; documents that were tombstoned stay out, and document rows are not touched."""
        config = self.store.read("transform_config", tenant_id).where((F.col("tenant_id") == tenant_id) & (F.col("id") == config_id)).head(1)
        if not config:
            raise V.PlaneError(404, "no such configuration")
        caps = json.loads(config[0].params).get("chunk", {})
        run, now = f"trun_{uuid.uuid4().hex[:22]}", self.clock()

        def record(status: str, done: int, made: int, error: str | None) -> DataFrame:
            return self.spark.createDataFrame([(run, tenant_id, config_id, run, json.dumps({"adapter": adapter} if adapter else {}), status, done, made, error, now, self.clock(), None, None, None)], T.TRANSFORM_RUN)

        if self.embedder is None:
            error = "1/1 raw_capture row(s) failed to re-derive; first error: no embedder is configured"
            self.store.commit(tenant_id, append={"transform_run": record("failed", 0, 0, error)})
            return {"run_id": run, "generation": run, "status": "failed", "raw_count": 0, "version_count": 0, "error": error}
        raw = lifecycle.raw_scan(self.store.read("raw_capture", tenant_id), tenant_id, adapter, since, until)
        raw = raw.withColumn("seq", F.row_number().over(_order("tenant_id", "adapter", "external_ref")))
        good, bad = lifecycle.parse_raw(raw, "title string, kind string, external_ref string, attributes string, text string, access_tags array<string>, principal string, generator_agent_id string, provenance string, temporal_class string, valid_until timestamp_ntz")
        dead = self.store.read("version", tenant_id).where("status = 'tombstoned'").select("tenant_id", "document_id").distinct()
        p = good.select("tenant_id", "adapter", "seq", "fetched_at", "payload.*").withColumn("lineage_class", F.lit(None).cast("string"))
        p = lifecycle.defaults(p).withColumn("document_id", H.record_id("kdoc", F.col("tenant_id"), F.col("adapter"), F.col("external_ref"))).join(dead, ["tenant_id", "document_id"], "left_anti")
        cut = chunker.chunk_udf(caps.get("max_tokens", chunker.MAX_TOKENS), caps.get("min_tokens", chunker.MIN_TOKENS), caps.get("overlap_tokens", chunker.OVERLAP_TOKENS))
        p = p.withColumn("chunks", cut(F.col("text"))).withColumn("content_hash", H.content_hash(F.col("title"), F.col("kind"), F.col("external_ref"), F.col("attributes"), F.transform("chunks", lambda c: c["text"])))
        made = lifecycle.versions_of(p).withColumn("id", H.record_id("kver", F.col("tenant_id"), F.col("document_id"), F.lit(run), F.col("version")))
        last = self.store.last_feed_seq()
        kept = self.store.read("version", tenant_id).groupBy("tenant_id", "document_id").agg(F.max_by("retention_class", "version").alias("retention_class"))
        from palimpsest.streaming.feed import numbered

        v = numbered(made.withColumn("ingested_at", F.lit(now).cast("timestamp_ntz")), last).join(kept, ["tenant_id", "document_id"], "left").cache()
        rows = v.select("id", "tenant_id", "document_id", "version", "status", "content_hash", F.col("fetched_at").alias("occurred_at"), "ingested_at", F.col("principal").alias("created_by_principal_id"), "created_by_kind", "generator_agent_id", "authority", F.lit(1).alias("actor_count"), F.lit(False).alias("has_social_signal"), F.col("lineage_class").alias("source_class"), F.lit(run).alias("generation"), "provenance", "temporal_class", "valid_until", "feed_seq", F.coalesce("retention_class", F.lit("standard")).alias("retention_class"))
        chunks = v.select("tenant_id", F.col("id").alias("version_id"), "document_id", "ingested_at", F.inline("chunks")).select(H.record_id("kchk", F.col("document_id"), F.col("version_id"), F.col("ordinal")).alias("id"), "tenant_id", "version_id", "document_id", "ordinal", "text", F.col("ingested_at").alias("created_at"))
        # a version of which a chunk can't be embedded is left out, and its capture counts as failed
        vectors = durable(embed_chunks(chunks.withColumnRenamed("id", "chunk_id"), self.embedder, self.model_key, self.dims))
        owner = chunks.select(F.col("id").alias("chunk_id"), "version_id")
        lost = durable(vectors.where("rejected").join(owner, "chunk_id").groupBy("version_id").agg(F.min("error").alias("error")))
        good_rows = rows.join(lost, F.col("id") == F.col("version_id"), "left_anti")
        good_chunks = chunks.join(lost, "version_id", "left_anti")
        good_vectors = vectors.join(owner.join(lost, "version_id", "left_anti"), "chunk_id", "left_semi")
        n_bad, n_lost, total, versions = bad.count(), lost.count(), raw.count(), good_rows.count()
        failed, error = n_bad + n_lost, None
        if failed:
            first = [f"the payload of {r.id} can't be read" for r in bad.orderBy("fetched_at", "id").select("id").head(1)] or [r.error or "a vector was refused" for r in lost.orderBy("version_id").head(1)]
            error = f"{failed}/{max(total, failed)} raw_capture row(s) failed to re-derive; first error: {first[0]}"
        status = "failed" if failed else "completed"
        models = Models(self.spark, self.store.read("embed_model", tenant_id))
        models.ensure(tenant_id, *self.model, self.dims, now)
        self.store.commit(
            tenant_id,
            replace={"embedding": upsert_embeddings(self.store.read("embedding", tenant_id), good_vectors), "embed_model": models.rows},
            append={"version": good_rows, "chunk": good_chunks, "transform_run": record(status, total - failed, versions, error)},
            feed_seq=good_rows.agg(F.max("feed_seq")).first()[0],
        )
        v.unpersist()
        return {"run_id": run, "generation": run, "status": status, "raw_count": total - failed, "version_count": versions, "error": error}

    def _run(self, tenant_id: str, generation: str):
        runs = self.store.read("transform_run", tenant_id)
        run = runs.where((F.col("tenant_id") == tenant_id) & (F.col("generation") == generation)).head(1)
        if not run:
            raise V.PlaneError(404, "no such generation")
        return runs, run[0]

    def _promoted(self, runs: DataFrame, run, archive: str | None, model_key: str | None) -> DataFrame:
        """The runs with what a promotion (or, with None, a demotion) of one of them notes there."""
        mine = F.col("id") == run.id
        at = self._now() if archive else F.lit(None)
        noted = {"archived_live_generation": F.lit(archive), "archived_live_model_key": F.lit(model_key), "promoted_at": at}
        return runs.withColumns({c: F.when(mine, x.cast(T.TRANSFORM_RUN[c].dataType)).otherwise(F.col(c)) for c, x in noted.items()})

    def promote_generation(self, tenant_id: str, generation: str) -> dict:
        """Makes a completed generation live and its model the active one; keeps what was live under a name of its own."""
        if generation == LIVE:
            raise V.PlaneError(400, "the live generation can't be promoted onto itself")
        runs, run = self._run(tenant_id, generation)
        if run.promoted_at is not None:
            raise V.PlaneError(400, f"generation {generation} is already promoted")
        if not lifecycle.promotable(run.status):
            raise V.PlaneError(400, f"a run that is {run.status} can't be promoted")
        if not self.store.read("transform_config", tenant_id).where(F.col("id") == run.config_id).head(1):
            raise V.PlaneError(404, "no such configuration")
        if self.embedder is None:
            raise V.PlaneError(400, "no embedder is configured")
        models, now = Models(self.spark, self.store.read("embed_model", tenant_id)), self.clock()
        before = models.active(tenant_id)
        models.ensure(tenant_id, *self.model, self.dims, now)
        models.activate(tenant_id, self.model_key, now)
        archive = f"archive_{run.id}_{self.store.number()}"
        self.store.commit(tenant_id, replace={"transform_run": self._promoted(runs, run, archive, before.model_key if before else None), "embed_model": models.rows}, aliases=self.store.promoting(tenant_id, generation, archive))
        return {"archived_as": archive}

    def demote_generation(self, tenant_id: str, generation: str) -> dict:
        """Makes live again what the promotion of a generation archived, and the model that was active then."""
        runs, run = self._run(tenant_id, generation)
        if run.promoted_at is None or run.archived_live_generation is None:
            raise V.PlaneError(400, f"generation {generation} is not promoted")
        models, now = Models(self.spark, self.store.read("embed_model", tenant_id)), self.clock()
        if run.archived_live_model_key is None:
            models.clear(tenant_id, now)
        else:
            try:
                models.activate(tenant_id, run.archived_live_model_key, now)
            except KeyError as error:
                raise V.PlaneError(400, f"the model that was active can't be restored: {error}") from error
        self.store.commit(tenant_id, replace={"transform_run": self._promoted(runs, run, None, None), "embed_model": models.rows}, aliases=self.store.demoting(tenant_id, run.archived_live_generation))
        return {"live": self.store.generation(tenant_id)}


def flags_of(flags: Sequence[str]) -> list[str]:
    """Each flag once, in order of first occurrence."""
    return list(dict.fromkeys(flags))


def _order(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy("fetched_at", "id")
