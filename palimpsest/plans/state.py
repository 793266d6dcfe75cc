"""Registered queries of access, timelines, feeds, capture, retention, re-derivation and degradation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import hashing as H
from palimpsest.operators import access as A
from palimpsest.operators import chunker, degrade, timeline
from palimpsest.operators import corpus as C
from palimpsest.operators import lifecycle as M
from palimpsest.plans.search import NOW, chain, now
from palimpsest.runtime import table

#: Grants of the access queries: id, principal, resource, effect.
GRANTS = [("g1", "u1", "memory.space:s*", "allow"), ("g2", "u2", "memory.owner:u3", "allow"), ("g3", "u3", "memory.space:*", "allow"), ("g4", "u3", "memory.space:s1", "deny")]


def _grants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, p, r, "search", e) for i, p, r, e in GRANTS], "id string, principal_id string, resource string, action string, effect string")


def _picked(c: C.Corpus) -> DataFrame:
    """Versions that the retention queries act on: those whose sequence number is divisible by 50."""
    return c.version.where(F.col("feed_seq") % 50 == 0)


def _at(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def access_tags_resolve(spark, root):
    c = C.load(spark, root)
    d = A.creators(c.document, c.version)
    none = F.array().cast("array<string>")
    tags = A.access_tags(F.coalesce("creator", F.lit("nobody")), F.col("access_tags"), F.when(F.col("kind") == "note", F.col("tenant_id")), F.array(F.lit(" u1 "), F.lit("")), F.array(F.lit("memory.space:s1")))
    return d.select("id", F.array_join(tags, ",").alias("tags"), F.size(F.coalesce("access_tags", none)).alias("n_before"))


def acl_filter(spark, root):
    c = C.load(spark, root)
    d = A.creators(c.document, c.version).select(F.col("id").alias("document_id"), "access_tags", "creator")
    return A.visible_documents(d, _grants(spark), spark.createDataFrame([("u1",), ("u2",), ("u3",)], "principal_id string"))


def acl_default(spark, root):
    """Without grants a document is its creator's only."""
    c = C.load(spark, root)
    d = A.creators(c.document, c.version).select(F.col("id").alias("document_id"), "access_tags", "creator")
    return A.own_documents(d, spark.createDataFrame([("u1",), ("u2",), ("u3",)], "principal_id string"))


def audience_split(spark, root):
    d = C.load(spark, root).document
    s = A.split_audience(F.concat("access_tags", F.array(F.lit("memory.space:s1"))), F.filter("access_tags", lambda t: F.startswith(t, F.lit("memory.owner"))))
    return d.select("id", F.array_join(s["allowed"], ",").alias("allowed"), F.array_join(s["needs_approval"], ",").alias("needs_approval"))


def share_grants(spark, root):
    d = C.load(spark, root).document
    people = F.transform("access_tags", lambda t: F.concat(F.lit(" "), F.element_at(F.split(t, ":"), -1)))
    return A.share_grants(d.select(F.col("id").alias("document_id"), F.lit("s1").alias("sharer"), people.alias("principals"))).select("id", "principal_id", "resource")


def timeline_list(spark, root):
    c = C.load(spark, root)
    return timeline.timeline(c.document, c.version).select("tenant_id", "document_id", "version_id", "source", _at("at"), "rank")


def timeline_visible(spark, root):
    c = C.load(spark, root)
    visible = acl_filter(spark, root).where("principal_id = 'u1'")
    return timeline.timeline(c.document, c.version, visible=visible).select("tenant_id", "document_id", "version_id", "rank")


def _feed(spark, root, **kw):
    c = C.load(spark, root)
    return timeline.feed_rows(c.document, c.version, **kw)


def feed_rows(spark, root):
    return _feed(spark, root).select("feed_seq", "tenant_id", "version_id", "document_id", "status", _at("created_at"))


def feed_page(spark, root):
    f = _feed(spark, root)
    cursors = f.groupBy("tenant_id").agg((F.min("feed_seq") + 10).alias("after"))
    return timeline.feed_page(f, cursors, 20).select("tenant_id", "feed_seq", "version_id", "next_cursor")


def feed_exclude_generator(spark, root):
    c = C.load(spark, root)
    some = c.version.agg(F.min("generator_agent_id").alias("agent"))
    f = timeline.feed_rows(c.document, c.version)
    return f.crossJoin(F.broadcast(some)).where(F.col("generator_agent_id").isNull() | (F.col("generator_agent_id") != F.col("agent"))).select("feed_seq", "version_id", "generator_agent_id")


def content_hash(spark, root):
    c = C.load(spark, root)
    live = M.latest_active(c.version.where(F.col("generation") == C.LIVE)).select("tenant_id", "document_id", F.col("id").alias("version_id"))
    texts = c.chunk.join(live, ["tenant_id", "document_id", "version_id"]).groupBy("tenant_id", "document_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", F.coalesce("text", F.lit("")).alias("text")))).alias("c"))
    d = c.document.withColumnRenamed("id", "document_id").join(texts, ["tenant_id", "document_id"])
    return d.select("document_id", H.content_hash(F.col("title"), F.col("kind"), F.col("external_ref"), H.canonical_json("attributes"), F.transform("c", lambda x: x["text"])).alias("content_hash"))


def model_key(spark, root):
    return C.load(spark, root).document.select("adapter", "kind").distinct().select("adapter", "kind", H.model_key_column(F.col("adapter"), F.col("kind")).alias("model_key"))


def raw_dedupe(spark, root):
    a = table(spark, root, "memory_add").dropDuplicates(["request_id"])
    raw = a.select(F.col("request_id").alias("id"), "tenant_id", F.col("received_at").alias("fetched_at"), F.sha2(F.concat_ws("|", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))), 256).alias("source_hash"))
    return M.dedupe_raw(raw).select("id", "tenant_id", "source_hash")


def add_defaults(spark, root):
    a = table(spark, root, "memory_add").dropDuplicates(["request_id"])
    return M.defaults(a.withColumn("refused", M.rejects(a))).select("request_id", "refused", "created_by_kind", "provenance", "lineage_class", "temporal_class", F.round("authority", 6).alias("authority"))


def _log(c: C.Corpus) -> DataFrame:
    """Captures: two for each live version, of which the second is a repetition."""
    v = c.version.where(F.col("generation") == C.LIVE).select("tenant_id", "document_id", "version", "content_hash")
    return v.select("tenant_id", "document_id", F.explode(F.array(F.col("version") * 2, F.col("version") * 2 + 1)).alias("seq"), "content_hash")


def scd2_versions(spark, root):
    return M.versions_of(_log(C.load(spark, root))).select("tenant_id", "document_id", "seq", "version", "status", "supersedes_seq")


def capture_batch(spark, root):
    c = C.load(spark, root)
    batch = _log(c).withColumn("content_hash", F.when(F.col("seq") % 3 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")))
    return M.capture(batch, c.version).select("tenant_id", "document_id", "version", "status", "is_new")


def latest_active(spark, root):
    return M.latest_active(C.load(spark, root).version).select("tenant_id", "document_id", "generation", "id", "version")


def owner_lookup(spark, root):
    return M.owners(C.load(spark, root).version)


def ephemeral_sweep(spark, root):
    return M.sweep_ephemeral(C.load(spark, root).version, now()).where("changed").select("id", "status", "deprecated_reason")


def deprecate(spark, root):
    c = C.load(spark, root)
    return M.deprecate(c.version, _picked(c), now(), "asked").select("id", "status", "deprecated_reason", "changed")


def tombstone(spark, root):
    c = C.load(spark, root)
    v, ch = M.tombstone(c.version, c.chunk, _picked(c), now(), "asked")
    return v.select(F.lit("version").alias("tbl"), "id", F.col("status").alias("now")).unionByName(ch.select(F.lit("chunk").alias("tbl"), "id", F.col("text").alias("now")))


def hard_delete_cascade(spark, root):
    c = C.load(spark, root)
    left = M.hard_delete({"document": c.document, "version": c.version, "chunk": c.chunk, "embedding": c.embedding}, _picked(c))
    out = None
    for name, df in left.items():
        one = df.agg(F.lit(name).alias("tbl"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def set_retention(spark, root):
    c = C.load(spark, root)
    return M.set_retention(c.version, _picked(c).select("tenant_id", "id", F.lit("durable").alias("retention_class"))).where("changed").select("id", "retention_class")


def entity_upsert(spark, root):
    c = C.load(spark, root)
    hints = c.document.select("tenant_id", F.lit("principal").alias("kind"), F.explode(F.transform("access_tags", lambda t: F.element_at(F.split(t, ":"), -1))).alias("identifier"))
    return M.upsert_entities(hints, c.entity).select("tenant_id", F.get_json_object("identifiers", "$.value").alias("identifier"))


def edge_upsert(spark, root):
    c = C.load(spark, root)
    new = c.version.select("tenant_id", F.lit("supersedes").alias("rel"), F.lit("document").alias("from_type"), F.col("document_id").alias("from_ref"), F.lit("version").alias("to_type"), F.col("supersedes_version_id").alias("to_ref")).where("to_ref is not null")
    return M.upsert_edges(new, c.edge).select("tenant_id", "from_ref", "to_ref")


def transform_next_version(spark, root):
    return M.next_config_version(C.load(spark, root).version.select("tenant_id", F.col("retention_class").alias("name"), "version"))


def promote_swap(spark, root):
    v = M.promoted(C.load(spark, root).version, F.lit("tenant_01"), F.lit("archive_run1"), F.lit("archive_run2"))
    return v.groupBy("tenant_id", "generation").agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("n_changed"))


def transform_progress(spark, root):
    v = C.load(spark, root).version
    rows = v.select(F.col("tenant_id").alias("run_id"), F.col("feed_seq").alias("ord"), F.when(F.col("status") == "tombstoned", F.concat(F.lit("gone "), F.col("id"))).alias("error"), (F.col("status") != "tombstoned").alias("made"))
    return M.run_progress(rows)


def _calls(spark, root):
    return table(spark, root, "events").dropDuplicates(["event_id"]).select((F.col("user_id") % 5).cast("string").alias("tenant_id"), F.col("event_id").alias("seq"), "event_type")


def degrade_rolling_rate(spark, root):
    r = degrade.rolling_rates(_calls(spark, root), F.col("event_type") == "error")
    return r.select("tenant_id", "seq", "samples", F.round("rate", 6).alias("rate"))


def degrade_hysteresis(spark, root):
    swing = (F.floor(F.col("seq") / 1000) % 2 == 0) & F.col("event_type").isin("error", "click", "view")
    return degrade.escalation(degrade.rolling_rates(_calls(spark, root), swing)).select("tenant_id", "seq", "escalated")


def degrade_lifetime(spark, root):
    return degrade.lifetime_counts(_calls(spark, root), {"dense_unavailable": F.col("event_type") == "error", "live_timeout": F.col("event_type") == "click"})


def inferred_to_state(spark, root):
    return M.inferred_to_state(C.load(spark, root).version).select("id", "temporal_class", "changed")


def timeline_withheld(spark, root):
    c = C.load(spark, root)
    return timeline.withheld(timeline.timeline(c.document, c.version, 100), acl_filter(spark, root).where("principal_id = 'u1'"))


def chunk_token_recursive(spark, root):
    docs = table(spark, root, "documents").select("doc_id", F.lit(0).alias("ordinal"), "text", F.lit(None).cast("string").alias("role"))
    return chunker.rechunk(docs, "doc_id")


def distill_tick(spark, root):
    from palimpsest.streaming.distill import distil_page, sample_distiller

    return distil_page(_feed(spark, root), sample_distiller)


_N = f"timestamp '{NOW}'"
_FEED = """select v.feed_seq, v.tenant_id, v.id as version_id, v.document_id, v.status, v.generator_agent_id, v.ingested_at as created_at from ver v join doc d on v.tenant_id = d.tenant_id and v.document_id = d.id
    where v.generation = 'live' and v.status in ('active', 'superseded') and v.feed_seq is not null"""
_CREATOR = "select d.*, v.created_by_principal_id as creator from doc d left join (select * from ver where status = 'active' and generation = 'live') v on v.tenant_id = d.tenant_id and v.document_id = d.id"
_ACL = f"""select distinct principal_id, document_id from (
    select principal_id, document_id from (select principal_id, t.document_id, t.tag, arg_max(effect, length(split_part(resource, '*', 1)) * 2 + (effect <> 'allow')::int) as e
      from (select id as document_id, unnest(list_distinct(access_tags)) as tag from doc) t
      join (values {", ".join(f"('{p}', '{r}', '{e}')" for _, p, r, e in GRANTS)}) g(principal_id, resource, effect) on t.tag like replace(resource, '*', '%') group by 1, 2, 3) where e = 'allow'
    union all select creator, id from ({_CREATOR}) where creator in ('u1', 'u2', 'u3'))"""
_TIMELINE = """select tenant_id, document_id, version_id, source, "at", row_number() over (partition by tenant_id order by "at" desc, version_id) as rank from (
    select v.tenant_id, v.document_id, v.id as version_id, d.adapter || ':' || d.external_ref as source, v.occurred_at as "at" from ver v join doc d on v.tenant_id = d.tenant_id and v.document_id = d.id where v.status = 'active' and v.generation = 'live')"""
_LOG = "select tenant_id, document_id, unnest([version * 2, version * 2 + 1]) as seq, content_hash from ver where generation = 'live'"
_PICK = "select distinct tenant_id, document_id from ver where feed_seq % 50 = 0"
_GONE = f"select * from ({_PICK}) p where not exists (select 1 from ver v where v.tenant_id = p.tenant_id and v.document_id = p.document_id and v.retention_class = 'durable' and v.status <> 'tombstoned')"
_RATE = """select *, count(*) over w as samples, sum(hit) over w / count(*) over w as rate from (select distinct (user_id %% 5)::varchar as tenant_id, event_id as seq, (%s)::int as hit from events)
    window w as (partition by tenant_id order by seq rows between 199 preceding and current row)"""

QUERIES = {
    f.__name__: f
    for f in (
        access_tags_resolve, acl_filter, acl_default, audience_split, share_grants, timeline_list, timeline_visible, feed_rows, feed_page, feed_exclude_generator, content_hash, model_key, raw_dedupe, add_defaults, scd2_versions, capture_batch,
        latest_active, owner_lookup, ephemeral_sweep, deprecate, tombstone, hard_delete_cascade, set_retention, entity_upsert, edge_upsert, transform_next_version, promote_swap, transform_progress, degrade_rolling_rate,
        degrade_hysteresis, degrade_lifetime, inferred_to_state, timeline_withheld, chunk_token_recursive, distill_tick,
    )
}

SQL = {
    "access_tags_resolve": chain(
        f"""select id, array_to_string(list_filter(list_distinct_ordered, lambda t: t <> ''), ',') as tags, n_before from (
        select id, len(coalesce(access_tags, [])) as n_before, list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda x: list_position(l, x[1]) = x[2]), lambda x: x[1]) as list_distinct_ordered from (
        select id, access_tags, list_concat(['memory.owner:' || coalesce(creator, 'nobody')], coalesce(access_tags, []), case when kind = 'note' then ['memory.tenant:' || tenant_id] else [] end, ['memory.owner:u1'], ['memory.space:s1']) as l from ({_CREATOR})))"""
    ),
    "acl_filter": chain(_ACL),
    "acl_default": chain(f"select distinct creator as principal_id, id as document_id from ({_CREATOR}) where creator in ('u1', 'u2', 'u3')"),
    "audience_split": chain(
        """select id, array_to_string(list_filter(p, lambda t: list_contains(s, t)), ',') as allowed, array_to_string(list_filter(p, lambda t: not list_contains(s, t)), ',') as needs_approval
        from (select id, list_concat(access_tags, ['memory.space:s1']) as p, list_filter(access_tags, lambda t: starts_with(t, 'memory.owner')) as s from doc)"""
    ),
    "share_grants": chain(
        """select 'mgrt_' || substr(sha256(document_id || chr(31) || principal_id), 1, 22) as id, principal_id, 'memory.doc:' || document_id as resource from (
        select distinct document_id, trim(split_part(t, ':', -1)) as principal_id from (select id as document_id, unnest(access_tags) as t from doc)) where principal_id not in ('', 's1')"""
    ),
    "timeline_list": chain(f"""select tenant_id, document_id, version_id, source, strftime("at", '%Y-%m-%d %H:%M:%S') as "at", rank from ({_TIMELINE}) where rank <= 20"""),
    "timeline_visible": chain(
        f"""select tenant_id, document_id, version_id, rank from (select * exclude (rank), row_number() over (partition by tenant_id order by "at" desc, version_id) as rank from ({_TIMELINE}) where rank <= 80
        and document_id in (select document_id from ({_ACL}) where principal_id = 'u1')) where rank <= 20"""
    ),
    "feed_rows": chain(f"select feed_seq, tenant_id, version_id, document_id, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at from ({_FEED})"),
    "feed_page": chain(
        f"""select tenant_id, feed_seq, version_id, max(feed_seq) over (partition by tenant_id) as next_cursor from (select *, row_number() over (partition by tenant_id order by feed_seq) as nth from
        (select *, min(feed_seq) over (partition by tenant_id) + 10 as after_seq from ({_FEED})) where feed_seq > after_seq) where nth <= 20"""
    ),
    "feed_exclude_generator": chain(f"select feed_seq, version_id, generator_agent_id from ({_FEED}) where generator_agent_id is null or generator_agent_id <> (select min(generator_agent_id) from ver)"),
    "content_hash": chain(
        """select document_id, sha256(coalesce(title, '') || ' ' || coalesce(kind, '') || ' ' || coalesce(external_ref, '') || ' ' || coalesce(replace(replace(attributes, ': ', ':'), ', ', ','), '') || ' ' || texts) as content_hash
        from (select c.tenant_id, c.document_id, string_agg(coalesce(text, ''), '' order by ordinal) as texts from chk c join (select * from (select *, row_number() over (partition by tenant_id, document_id order by version desc, id) as nth
          from ver where generation = 'live' and status = 'active') where nth = 1) v on c.tenant_id = v.tenant_id and c.document_id = v.document_id and c.version_id = v.id group by 1, 2) t join doc d on t.tenant_id = d.tenant_id and t.document_id = d.id"""
    ),
    "model_key": chain("select distinct adapter, kind, substr(sha256(adapter || '|' || kind), 1, 16) as model_key from doc"),
    "raw_dedupe": """select id, tenant_id, source_hash from (select *, row_number() over (partition by tenant_id, source_hash order by received_at, id) as nth from (
        select distinct request_id as id, tenant_id, received_at, sha256(coalesce(title, '') || '|' || coalesce(text, '')) as source_hash from memory_add)) where nth = 1""",
    "add_defaults": r"""select request_id, case when regexp_replace(coalesce(title, ''), '\s+', '', 'g') = '' then 'title' when kind is not null and regexp_replace(kind, '\s+', '', 'g') = '' then 'kind' when regexp_replace(coalesce(text, ''), '\s+', '', 'g') = '' then 'text' end as refused,
        k as created_by_kind, p as provenance, coalesce(lineage_class, case when k = 'agent' then 'derived' else 'native' end) as lineage_class, coalesce(temporal_class, case when p = 'inferred' then 'state' else 'event' end) as temporal_class,
        round((0.3 * case when k = 'agent' then 0.6 else 1 end + 0.12)::double, 6) as authority from (select distinct *, case when generator_agent_id is not null then 'agent' else 'human' end as k, coalesce(provenance, case when generator_agent_id is not null then 'inferred' else 'stated' end) as p from memory_add)""",
    "scd2_versions": chain(
        f"""select tenant_id, document_id, seq, row_number() over w as version, case when lead(seq) over w is null then 'active' else 'superseded' end as status, lag(seq) over w as supersedes_seq from (
        select *, lag(content_hash) over (partition by tenant_id, document_id order by seq) as b from ({_LOG})) where b is null or b <> content_hash window w as (partition by tenant_id, document_id order by seq)"""
    ),
    "capture_batch": chain(
        f"""select tenant_id, document_id, version, status, is_new from (
        with b as (select tenant_id, document_id, seq, case when seq % 3 = 0 then content_hash || 'x' else content_hash end as h from ({_LOG})),
        act as (select tenant_id, document_id, arg_max(content_hash, version) as ah from ver where generation = 'live' and status = 'active' group by 1, 2),
        tp as (select tenant_id, document_id, max(version) as top from ver where generation = 'live' group by 1, 2),
        n as (select * from (select b.*, ah, coalesce(top, 0) as top, coalesce(lag(h) over (partition by tenant_id, document_id order by seq), ah) as bef from b left join act using (tenant_id, document_id) left join tp using (tenant_id, document_id)) where bef is null or bef <> h)
        select tenant_id, document_id, top + row_number() over w as version, case when lead(seq) over w is null then 'active' else 'superseded' end as status, true as is_new from n window w as (partition by tenant_id, document_id order by seq)
        union all select tenant_id, document_id, version, 'superseded', false from ver where generation = 'live' and status = 'active' and (tenant_id, document_id) in (select (tenant_id, document_id) from n))"""
    ),
    "latest_active": chain("select tenant_id, document_id, generation, id, version from (select *, row_number() over (partition by tenant_id, document_id, generation order by version desc, id) as nth from ver where status = 'active') where nth = 1"),
    "owner_lookup": chain("select tenant_id, document_id, created_by_principal_id as owner from (select *, row_number() over (partition by tenant_id, document_id order by version, ingested_at, id) as nth from ver) where nth = 1"),
    "ephemeral_sweep": chain(f"select id, 'deprecated' as status, 'ephemeral_ttl' as deprecated_reason from ver where retention_class = 'ephemeral' and status = 'active' and case when valid_until is not null then valid_until < {_N} else ingested_at < {_N} - interval 7 days end"),
    "deprecate": chain("select id, case when c then 'deprecated' else status end as status, case when c then 'asked' else deprecated_reason end as deprecated_reason, c as changed from (select *, coalesce(feed_seq % 50 = 0 and status in ('active', 'superseded'), false) as c from ver)"),
    "tombstone": chain(
        f"""select 'version' as tbl, id, 'tombstoned' as now from ver where status in ('active', 'deprecated', 'superseded') and (tenant_id, document_id) in (select (tenant_id, document_id) from ({_PICK}))
        union all select 'chunk', id, '[redacted]' from chk where (tenant_id, version_id) in (select (tenant_id, id) from ver where status in ('active', 'deprecated', 'superseded') and (tenant_id, document_id) in (select (tenant_id, document_id) from ({_PICK})))"""
    ),
    "hard_delete_cascade": chain(
        f"""select 'document' as tbl, count(*) as n from doc where (tenant_id, id) not in (select (tenant_id, document_id) from ({_GONE})) union all select 'version', count(*) from ver where (tenant_id, document_id) not in (select (tenant_id, document_id) from ({_GONE}))
        union all select 'chunk', count(*) from chk where (tenant_id, document_id) not in (select (tenant_id, document_id) from ({_GONE}))
        union all select 'embedding', count(*) from (select distinct chunk_id, model_key, tenant_id from memory_embedding) where (tenant_id, chunk_id) not in (select (tenant_id, id) from chk where (tenant_id, document_id) in (select (tenant_id, document_id) from ({_GONE})))"""
    ),
    "set_retention": chain("select id, 'durable' as retention_class from ver where feed_seq % 50 = 0 and retention_class <> 'durable'"),
    "entity_upsert": chain("select distinct tenant_id, split_part(t, ':', -1) as identifier from (select tenant_id, unnest(access_tags) as t from doc) x where not exists (select 1 from memory_entity e where e.tenant_id = x.tenant_id and e.kind = 'principal' and json_extract_string(e.identifiers, '$.value') = split_part(t, ':', -1))"),
    "edge_upsert": chain(
        """select distinct tenant_id, document_id as from_ref, supersedes_version_id as to_ref from ver v where supersedes_version_id is not null and not exists (select 1 from edg e where e.tenant_id = v.tenant_id and e.rel = 'supersedes'
        and e.from_type = 'document' and e.from_ref = v.document_id and e.to_type = 'version' and e.to_ref = v.supersedes_version_id)"""
    ),
    "transform_next_version": chain("select tenant_id, retention_class as name, max(version) + 1 as next_version from ver group by 1, 2"),
    "promote_swap": chain(
        """select tenant_id, g as generation, count(*) as n, count(*) filter (where g <> generation) as n_changed from (select *, case when tenant_id = 'tenant_01' and generation = 'live' then 'archive_run2'
        when tenant_id = 'tenant_01' and generation = 'archive_run1' then 'live' else generation end as g from ver) group by 1, 2"""
    ),
    "transform_progress": chain(
        """select run_id, raw_count, version_count, failed, case when failed > 0 then 'failed' else 'completed' end as status, case when failed > 0 then failed || '/' || raw_count || ' raw_capture row(s) failed: ' || f end as error from (
        select tenant_id as run_id, count(*) as raw_count, count(*) filter (where status <> 'tombstoned') as version_count, count(*) filter (where status = 'tombstoned') as failed, arg_min('gone ' || id, feed_seq) filter (where status = 'tombstoned') as f from ver group by 1)"""
    ),
    "degrade_lifetime": "select (user_id % 5)::varchar as tenant_id, count(*) as total, count(*) filter (where event_type = 'error') as dense_unavailable, count(*) filter (where event_type = 'click') as live_timeout from (select distinct event_id, user_id, event_type from events) group by 1",
    "inferred_to_state": chain("select id, case when c then 'state' else temporal_class end as temporal_class, c as changed from (select *, coalesce(provenance = 'inferred' and temporal_class = 'event', false) as c from ver)"),
    "timeline_withheld": chain(f"select tenant_id, count(*) filter (where document_id not in (select document_id from ({_ACL}) where principal_id = 'u1')) as withheld from ({_TIMELINE}) where rank <= 100 group by 1"),
    "degrade_rolling_rate": f"select tenant_id, seq, samples, round(rate, 6) as rate from ({_RATE % chr(39).join(['event_type = ', 'error', ''])})",
    "degrade_hysteresis": """select tenant_id, seq, coalesce(last_value(case when samples >= 32 and rate >= 0.2 then true when samples >= 32 and rate <= 0.1 then false end ignore nulls) over (partition by tenant_id order by seq rows between unbounded preceding and current row), false) as escalated
        from ("""
    + _RATE % "(event_id // 1000) %% 2 = 0 and event_type in ('error', 'click', 'view')".replace("%%", "%")
    + ")",
}
