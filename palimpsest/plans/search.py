"""Registered queries of retrieval: a batch of hybrid searches, stage by stage, with their SQL.

The batch holds a query for every feed entry whose sequence number is divisible by 50: one to four words of its title as
terms, and the vector of its version's first chunk. Every query is asked of all rows of its tenant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.functions.text import snippet as snippet_of
from palimpsest.functions.vectors import usable
from palimpsest.operators import corpus as C
from palimpsest.operators import search as R
from palimpsest.runtime import durable, stored, table

NOW = "2024-12-01 00:00:00"
K, DIMS = 8, 64
LIMIT = S.overfetch(K)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


class Batch:
    """The stages of one batch, each a DataFrame that is planned when asked for."""

    def __init__(self, spark: SparkSession, root: str):
        self.corpus = C.load(spark, root)
        # compared where they lie: vectors delivered twice are told apart among the best of a query, not before
        self.vectors = table(spark, root, "memory_embedding")
        self._candidates, self._rows = None, None
        self.texts = table(spark, root, "memory_chunk").select("tenant_id", F.col("id").alias("chunk_id"), "text")
        feed = table(spark, root, "feed_entry").where(F.col("feed_seq") % 50 == 0).dropDuplicates(["feed_seq"])
        words = F.regexp_extract_all("title", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
        plain = F.filter(F.transform(words, F.lower), lambda w: (F.length(w) >= 4) & ~w.rlike("[0-9]"))
        self.queries = feed.select(F.col("feed_seq").alias("query_id"), "tenant_id", "version_id", F.col("title").alias("query_text"), F.array_distinct(F.slice(F.coalesce(plain, F.array().cast("array<string>")), F.lit(1), (F.col("feed_seq") / 50 % 4).cast("int") + 1)).alias("terms"))

    @property
    def rows(self):
        """What search may return, without texts; several stages read it, so it is written once."""
        if self._rows is None:
            self._rows = stored(C.search_rows(self.corpus))
        return self._rows

    def matches(self):
        return R.lexical_matches(self.queries, self.texts)

    def lexical(self):
        return R.lexical_topk(self.matches(), self.rows, LIMIT)

    def query_vectors(self):
        c = self.corpus
        first = c.chunk.groupBy("version_id").agg(F.min_by("id", F.struct("ordinal", "id")).alias("chunk_id"))
        asked = self.queries.join(first, "version_id").select("query_id", "tenant_id", "chunk_id")
        return asked.join(self.first_vectors(asked), "chunk_id").select("query_id", "tenant_id", "v.model_key", "v.vector")

    def first_vectors(self, pool):
        """(chunk_id, v: model_key and vector) of the chunks in `pool`, by the first model that has a usable vector."""
        mine = self.vectors.where(usable(F.col("embedding"), DIMS)).join(pool.select("chunk_id").distinct(), "chunk_id", "left_semi")
        return mine.groupBy("chunk_id").agg(F.min_by(F.struct("model_key", F.col("embedding").alias("vector")), "model_key").alias("v"))

    def dense(self):
        return R.dense_topk(self.query_vectors(), self.vectors.join(self.rows.select("chunk_id"), "chunk_id", "left_semi"), LIMIT, DIMS)

    def fused(self):
        return R.fuse(self.lexical(), self.dense())

    def candidates(self):
        """At most two channels' candidates per query; later stages read them several times, so they are written once."""
        if self._candidates is None:
            self._candidates = durable(R.attach_corroboration(self.fused().join(self.rows, "chunk_id"), self.corpus.edge))
        return self._candidates

    def fallback(self):
        return R.dedupe_documents(self.candidates(), S.authority_weighted(F.col("fused"), F.col("authority"))).where(F.col("rank") <= K)

    def boosted(self):
        raw = R.dedupe_documents(self.candidates(), F.col("fused")).where(F.col("rank") <= 50)
        return R.boosted(raw, now())

    def evidence(self):
        hits = self.queries.select("query_id").join(self.fallback().groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("hits"))
        return R.evidence(self.candidates(), hits)


def _r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def tenant_scan(spark, root):
    return C.scan(C.load(spark, root).document, tenant="tenant_03").select("id", "kind", "title")


def kind_filter(spark, root):
    return C.scan(C.load(spark, root).document, kinds=["note", "claim"]).select("id", "tenant_id", "kind")


def entity_semi_join(spark, root):
    c = C.load(spark, root)
    people = c.entity.where("kind = 'person'").select(F.col("id").alias("entity_id"))
    return C.linked_documents(c.document, c.edge, people).select("id", "tenant_id")


def lexical_match(spark, root):
    return Batch(spark, root).matches().select("query_id", "chunk_id", "ts_rank")


def lexical_topk(spark, root):
    return Batch(spark, root).lexical().select("query_id", "chunk_id", "ts_rank", "rank")


def dense_topk(spark, root):
    return Batch(spark, root).dense()


def channel_rank(spark, root):
    b = Batch(spark, root)
    one = lambda df, c: df.groupBy("query_id").agg(F.lit(c).alias("channel"), F.count(F.lit(1)).alias("n"), F.max("rank").alias("last_rank"))
    return one(b.lexical(), "lexical").unionByName(one(b.dense(), "dense"))


def channel_union(spark, root):
    return Batch(spark, root).fused().select("query_id", "chunk_id", "pos", F.array_join("channels", ",").alias("channels"))


def rrf_fuse(spark, root):
    return Batch(spark, root).fused().select("query_id", "chunk_id", _r("fused", 8).alias("fused"))


def minmax_normalize(spark, root):
    f = Batch(spark, root).fused()
    return f.select("query_id", "chunk_id", _r(R.unit_scores(F.col("fused"), ["query_id"])).alias("norm"))


def dedupe_per_document(spark, root):
    b = Batch(spark, root)
    return R.dedupe_documents(b.candidates(), F.col("fused")).select("query_id", "document_id", "chunk_id", _r("score", 8).alias("score"), "rank")


def authority_weighted_topk(spark, root):
    return Batch(spark, root).fallback().select("query_id", "document_id", "chunk_id", _r("score", 8).alias("score"), "rank")


def hybrid_fallback_topk(spark, root):
    b = Batch(spark, root)
    top = b.fallback().join(R.entity_ids(b.corpus.edge), ["tenant_id", "document_id"], "left").join(b.evidence(), "query_id")
    target = C.open_target(F.col("adapter"), F.col("external_ref"), F.col("document_id"))
    return top.select(
        "query_id", "rank", "chunk_id", "document_id", "version_id", _r("score", 8).alias("score"), F.array_join("channels", ",").alias("channels"), "supports", "contradicts",
        F.coalesce(F.array_join("entity_ids", ","), F.lit("")).alias("entity_ids"), target["type"].alias("open_type"), target["id"].alias("open_id"), "evidence",
    )


def final_boosted_score(spark, root):
    return Batch(spark, root).boosted().select("query_id", "document_id", "chunk_id", _r("norm").alias("norm"), _r("final").alias("final"))


def evidence_label(spark, root):
    return Batch(spark, root).evidence()


def _per_version(spark, root):
    c = C.load(spark, root)
    return R.attach_corroboration(c.version.withColumnRenamed("id", "version_id"), c.edge)


def corroboration_counts(spark, root):
    return _per_version(spark, root).select("version_id", "supports", "contradicts")


def corroboration_factor(spark, root):
    return _per_version(spark, root).select("version_id", _r(S.corroboration_factor(F.col("supports"), F.col("contradicts"))).alias("factor"))


def effective_authority(spark, root):
    return _per_version(spark, root).select("version_id", _r(S.effective_authority(F.col("authority"), F.col("supports"), F.col("contradicts"))).alias("effective"))


def strong_gate(spark, root):
    return _per_version(spark, root).select("version_id", S.strong_gate(F.col("authority"), F.col("supports"), F.col("provenance"), F.col("created_by_kind")).alias("strong"))


def authority_score(spark, root):
    v = C.load(spark, root).version
    return v.select("id", _r(S.authority(F.col("created_by_kind"), F.col("actor_count"), F.col("source_class"), F.col("has_social_signal"))).alias("authority"))


def authority_boost(spark, root):
    return C.load(spark, root).version.select("id", _r(S.boost(F.col("authority"))).alias("boost"))


def recency_boost(spark, root):
    return C.load(spark, root).version.select("id", _r(S.recency_boost(F.col("occurred_at"), now())).alias("boost"))


def temporal_recency(spark, root):
    v = C.load(spark, root).version
    return v.select("id", _r(S.temporal_boost(F.col("temporal_class"), F.col("occurred_at"), F.col("valid_until"), now())).alias("boost"))


def recency_prior(spark, root):
    return C.load(spark, root).document.select("id", _r(S.recency_prior(F.col("last_seen_at"), now())).alias("prior"))


def entity_ids_agg(spark, root):
    return R.entity_ids(C.load(spark, root).edge).select("tenant_id", "document_id", F.array_join("entity_ids", ",").alias("entity_ids"))


def derived_from_agg(spark, root):
    return R.derived_from(C.load(spark, root).edge).select("tenant_id", "version_id", F.array_join("derived_from", ",").alias("derived_from"))


def open_target(spark, root):
    t = C.open_target(F.col("adapter"), F.col("external_ref"), F.col("id"))
    return C.load(spark, root).document.select("id", t["type"].alias("open_type"), t["id"].alias("open_id"))


def snippet(spark, root):
    return C.load(spark, root).chunk.select("id", snippet_of(F.col("text")).alias("snippet"))


def merge_local_live(spark, root):
    b = Batch(spark, root)
    local = b.fallback().select("query_id", F.lit("local").alias("channel"), F.col("rank").alias("pos"), F.lit("local").alias("source_id"), "adapter", "external_ref", F.coalesce("title", F.lit("")).alias("title"), "score", F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    words = b.queries.where(F.size("terms") > 0).select("query_id", "tenant_id", F.col("terms")[0].alias("term"))
    live = (
        b.corpus.document.where("adapter = 'tracker'").join(words, "tenant_id").where(F.contains(F.lower("title"), F.col("term")))
        .select("query_id", F.lit("live").alias("channel"), F.lit(1).alias("pos"), F.lit("tracker").alias("source_id"), "adapter", "external_ref", "title", F.length("title").cast("double").alias("score"), F.col("last_seen_at").alias("updated_at"))
    )
    m = R.merge_local_live(local.unionByName(live), now())
    return m.select("query_id", "rank", "channel", "adapter", "external_ref", _r("combined").alias("combined"))


def lexical_english(spark, root):
    b = Batch(spark, root)
    from palimpsest.functions.text import english_lexemes

    q = b.queries.withColumn("terms", english_lexemes(F.col("terms")))
    return R.lexical_matches(q, b.texts, "english")


def mmr_rerank(spark, root):
    b = Batch(spark, root)
    v = b.corpus.embedding.groupBy("chunk_id").agg(F.min_by("embedding", "model_key").alias("vector"))
    rows = b.boosted().select("query_id", "chunk_id", F.col("final").alias("score")).join(v, "chunk_id", "left")
    return R.mmr(rows, K, dims=DIMS)


def rerank_pipeline(spark, root):
    b = Batch(spark, root)
    raw = R.dedupe_documents(b.candidates(), F.col("fused")).where(F.col("rank") <= 50)
    texts = raw.join(b.corpus.chunk.select(F.col("id").alias("chunk_id"), "text"), "chunk_id")
    scored = raw.join(R.rerank(texts, b.queries, R.overlap_reranker), ["query_id", "chunk_id"]).withColumn("score", F.col("rerank_score"))
    v = b.first_vectors(raw).select("chunk_id", "v.vector")
    final = durable(R.boosted(scored, now()))
    chosen = R.mmr(final.select("query_id", "chunk_id", F.col("final").alias("score")).join(v, "chunk_id", "left"), K, dims=DIMS)
    return chosen.join(final.select("query_id", "chunk_id", "document_id", "rerank_score", "final"), ["query_id", "chunk_id"])


_CHAIN = {
    "doc": "select distinct * from memory_document",
    "ver": "select distinct * from memory_version",
    "chk": "select distinct * from memory_chunk",
    "edg": "select distinct * from memory_edge",
    "emb": """select distinct * from memory_embedding where embedding is not null and len(embedding) = 64
        and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64 and len(list_filter(embedding, lambda x: x <> 0)) > 0""",
    "q": r"""select query_id, tenant_id, version_id, list_distinct(w[1:(query_id // 50 % 4 + 1)::int]) as terms, w[1] as term1 from (
        select distinct feed_seq as query_id, tenant_id, version_id, list_filter(regexp_extract_all(lower(coalesce(title, '')), '[\p{L}\p{N}]+'),
        lambda x: length(x) >= 4 and not regexp_matches(x, '[0-9]')) as w from feed_entry where feed_seq % 50 = 0)""",
    "rws": """select c.tenant_id, c.id as chunk_id, c.version_id, c.document_id, occurred_at, authority, temporal_class, valid_until, provenance, created_by_kind, title, adapter, external_ref
        from chk c join ver v on c.tenant_id = v.tenant_id and c.version_id = v.id and c.document_id = v.document_id
        join doc d on c.tenant_id = d.tenant_id and c.document_id = d.id where v.status = 'active' and v.generation = 'live'""",
    "qt": "select query_id, tenant_id, len(terms) as n_terms, unnest(terms) as term from q",
    "hit": r"""select query_id, n_terms, chunk_id, term, pos from (select tenant_id, id as chunk_id, unnest(tok) as term, generate_subscripts(tok, 1) as pos
        from (select tenant_id, id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as tok from chk)) join qt using (tenant_id, term)""",
    "hold": "select query_id, n_terms, chunk_id from hit group by all having count(distinct term) = n_terms",
    "one": "select query_id, chunk_id, sum(0.1 / (j * j)) / 1.64493406685 as r from (select *, row_number() over (partition by query_id, chunk_id order by pos) as j from hit) join hold using (query_id, n_terms, chunk_id) where n_terms = 1 group by all",
    "two": """select a.query_id, a.chunk_id, 1 - exp(sum(ln(1 - 0.1 * sqrt(case when abs(a.pos - b.pos) > 100 then 1e-30 else 1 / (1.005 + 0.05 * exp(abs(a.pos - b.pos) / 1.5 - 2)) end)))) as r
        from hit a join hit b on a.query_id = b.query_id and a.chunk_id = b.chunk_id and a.term < b.term join hold h on a.query_id = h.query_id and a.chunk_id = h.chunk_id group by all""",
    "mat": "select query_id, chunk_id, round(r, 6) as ts_rank from (select * from one union all select * from two)",
    "lex": "select * from (select query_id, chunk_id, ts_rank, row_number() over (partition by query_id order by ts_rank desc, occurred_at desc, chunk_id) as rank from mat join rws using (chunk_id)) where rank <= 40",
    "qv": """select query_id, q.tenant_id, model_key, embedding as vec from q join (select version_id, arg_min(id, ordinal) as chunk_id from chk group by 1) f on q.version_id = f.version_id
        join (select chunk_id, min(model_key) as model_key, arg_min(embedding, model_key) as embedding from emb group by 1) e on e.chunk_id = f.chunk_id""",
    "den": """select query_id, chunk_id, cosine, rank from (select *, row_number() over (partition by query_id order by cosine desc, chunk_id) as rank from (
        select query_id, e.chunk_id, round(list_cosine_similarity(e.embedding::double[], vec::double[]), 6) as cosine from emb e join qv using (tenant_id, model_key) where e.chunk_id in (select chunk_id from rws))) where rank <= 40""",
    "fus": """select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 9) as fused, min(case when ch = 'lexical' then rank else coalesce(nl, 0) + rank end) as pos,
        case when count(*) = 2 then 'lexical,dense' else min(ch) end as channels, max(ts_rank) as ts_rank
        from (select query_id, chunk_id, rank, 'lexical' as ch, ts_rank from lex union all select query_id, chunk_id, rank, 'dense', null from den) left join (select query_id, max(rank) as nl from lex group by 1) using (query_id) group by 1, 2""",
    "cor": "select tenant_id, to_ref as version_id, count(*) filter (where rel = 'supports') as supports, count(*) filter (where rel = 'contradicts') as contradicts from edg where to_type = 'version' group by 1, 2",
    "cnd": "select f.*, rws.* exclude (chunk_id), coalesce(supports, 0) as supports, coalesce(contradicts, 0) as contradicts from fus f join rws using (chunk_id) left join cor using (tenant_id, version_id)",
    "ded0": "select *, row_number() over (partition by query_id, document_id order by fused desc, pos) as nth, min(pos) over (partition by query_id, document_id) as doc_pos from cnd",
    "ded": "select * exclude (nth, doc_pos), fused as score, row_number() over (partition by query_id order by fused desc, occurred_at desc, doc_pos) as rank from ded0 where nth = 1",
    "fal0": "select *, round(fused * (1 + 0.5 * authority), 9) as score, min(pos) over (partition by query_id, document_id) as doc_pos from cnd",
    "fal1": "select *, row_number() over (partition by query_id, document_id order by score desc, pos) as nth from fal0",
    "fal": "select * from (select * exclude (nth, doc_pos), row_number() over (partition by query_id order by score desc, occurred_at desc, doc_pos) as rank from fal1 where nth = 1) where rank <= 8",
    "evi": """select q.query_id, case when n is null then 'none' when b.ts_rank >= 0.05 and round(b.authority, 7) >= 0.3 and ((coalesce(b.provenance, '') = 'stated' and coalesce(b.created_by_kind, '') = 'human') or b.supports >= 2) then 'strong' else 'weak' end as evidence
        from q left join (select query_id, count(*) as n from fal group by 1) using (query_id)
        left join (select * from (select *, row_number() over (partition by query_id order by ts_rank desc, pos) as nth from cnd where ts_rank is not null) where nth = 1) b using (query_id)""",
    "ent": "select tenant_id, from_ref as document_id, string_agg(to_ref, ',' order by to_ref) as entity_ids from edg where from_type = 'document' and to_type = 'entity' and from_ref is not null and to_ref is not null group by 1, 2",
    "vc": "select v.*, v.id as version_id, coalesce(supports, 0) as supports, coalesce(contradicts, 0) as contradicts from ver v left join cor c on v.tenant_id = c.tenant_id and v.id = c.version_id",
}


def chain(final: str) -> str:
    return "with " + ",\n".join(f"{n} as ({s})" for n, s in _CHAIN.items()) + "\n" + final


_NOW = f"timestamp '{NOW}'"
_FACTOR = "case when supports = 0 and contradicts = 0 then 1.0 else greatest(0.7, least(1.3, 0.7 + 0.6 * greatest(0, least(1, 0.5 + 0.5 * least(1, ln(1 + supports) / ln(5)) - 0.5 * least(1, ln(1 + contradicts) / ln(5)))))) end"
_EFF = f"greatest(0, least(1, authority * ({_FACTOR})))"
_REC = f"greatest(0.7, least(1.3, 0.7 + 0.6 * pow(2, -greatest(0, (epoch_ms({_NOW}) - epoch_ms(occurred_at)) / 86400000.0) / 30)))"
_LEFT = f"((epoch_ms(valid_until) - epoch_ms({_NOW})) / 86400000.0)"
_TEMP = f"case when temporal_class in ('state', 'lesson') then 1.0 when temporal_class = 'deadline' then case when valid_until is null then 1.0 when {_LEFT} <= 0 then 0.7 when {_LEFT} >= 7 then 1.0 else greatest(0.7, least(1.3, 1 + 0.3 * (1 - {_LEFT} / 7))) end else {_REC} end"
_PRIOR = f"case when %s is null then 0.5 else exp(-ln(2) * greatest(0, (epoch_ms({_NOW}) - epoch_ms(%s)) / 86400000.0) / 30) end"
_OPEN = "adapter in ('artifact', 'task', 'workflow_run', 'mail') and starts_with(external_ref, adapter || ':')"
_NORM = "case when max(%s) over w = min(%s) over w then 1.0 else (%s - min(%s) over w) / (max(%s) over w - min(%s) over w) end"

QUERIES = {
    f.__name__: f
    for f in (
        tenant_scan, kind_filter, entity_semi_join, lexical_match, lexical_topk, dense_topk, channel_rank, channel_union, rrf_fuse, minmax_normalize, dedupe_per_document, authority_weighted_topk, hybrid_fallback_topk,
        final_boosted_score, evidence_label, corroboration_counts, corroboration_factor, effective_authority, strong_gate, authority_score, authority_boost, recency_boost, temporal_recency, recency_prior, entity_ids_agg,
        derived_from_agg, open_target, snippet, merge_local_live, lexical_english, mmr_rerank, rerank_pipeline,
    )
}

SQL = {
    "tenant_scan": chain("select id, kind, title from doc where tenant_id = 'tenant_03'"),
    "kind_filter": chain("select id, tenant_id, kind from doc where kind in ('note', 'claim')"),
    "entity_semi_join": chain("select id, tenant_id from doc d where exists (select 1 from edg e where e.tenant_id = d.tenant_id and e.from_type = 'document' and e.to_type = 'entity' and e.from_ref = d.id and e.to_ref in (select id from memory_entity where kind = 'person'))"),
    "lexical_match": chain("select * from mat"),
    "lexical_topk": chain("select * from lex"),
    "dense_topk": chain("select * from den"),
    "channel_rank": chain("select query_id, 'lexical' as channel, count(*) as n, max(rank) as last_rank from lex group by 1 union all select query_id, 'dense', count(*), max(rank) from den group by 1"),
    "channel_union": chain("select query_id, chunk_id, pos, channels from fus"),
    "rrf_fuse": chain("select query_id, chunk_id, round(fused, 8) as fused from fus"),
    "minmax_normalize": chain(f"select query_id, chunk_id, round({_NORM % (('fused',) * 6)}, 6) as norm from fus window w as (partition by query_id)"),
    "dedupe_per_document": chain("select query_id, document_id, chunk_id, round(score, 8) as score, rank from ded"),
    "authority_weighted_topk": chain("select query_id, document_id, chunk_id, round(score, 8) as score, rank from fal"),
    "hybrid_fallback_topk": chain(
        f"""select query_id, rank, chunk_id, f.document_id, version_id, round(score, 8) as score, channels, supports, contradicts, coalesce(entity_ids, '') as entity_ids,
        case when {_OPEN} then adapter else 'memory' end as open_type, case when {_OPEN} then substr(external_ref, length(adapter) + 2) else f.document_id end as open_id, evidence
        from fal f join evi using (query_id) left join ent using (tenant_id, document_id)"""
    ),
    "final_boosted_score": chain(
        f"""select query_id, document_id, chunk_id, round(norm, 6) as norm, round(norm * greatest(0.7, least(1.3, 0.7 + 0.6 * {_EFF})) * ({_FACTOR}) * ({_TEMP}), 6) as final
        from (select *, {_NORM % (('score',) * 6)} as norm from ded where rank <= 50 window w as (partition by query_id))"""
    ),
    "evidence_label": chain("select * from evi"),
    "corroboration_counts": chain("select version_id, supports, contradicts from vc"),
    "corroboration_factor": chain(f"select version_id, round({_FACTOR}, 6) as factor from vc"),
    "effective_authority": chain(f"select version_id, round({_EFF}, 6) as effective from vc"),
    "strong_gate": chain("select version_id, round(authority, 7) >= 0.3 and ((coalesce(provenance, '') = 'stated' and coalesce(created_by_kind, '') = 'human') or supports >= 2) as strong from vc"),
    "authority_score": chain(
        """select id, round(greatest(0, least(1, 0.3 * case created_by_kind when 'human' then 1.0 when 'agent' then 0.6 when 'system' then 0.4 when 'adapter' then 0.3 else 0 end + 0.3 * least(1, ln(greatest(1, coalesce(actor_count, 1))) / ln(8))
        + 0.3 * case source_class when 'channel' then 1.0 when 'thread' then 0.8 when 'call' then 0.7 when 'native' then 0.4 when 'record' then 0.3 else 0 end + 0.1 * coalesce(has_social_signal, false)::int)), 6) as authority from ver"""
    ),
    "authority_boost": chain("select id, round(greatest(0.7, least(1.3, 0.7 + 0.6 * authority)), 6) as boost from ver"),
    "recency_boost": chain(f"select id, round({_REC}, 6) as boost from ver"),
    "temporal_recency": chain(f"select id, round({_TEMP}, 6) as boost from ver"),
    "recency_prior": chain(f"select id, round({_PRIOR % (('last_seen_at',) * 2)}, 6) as prior from doc"),
    "entity_ids_agg": chain("select * from ent"),
    "derived_from_agg": chain("select tenant_id, from_ref as version_id, string_agg(to_ref, ',' order by to_ref) as derived_from from edg where from_type = 'version' and to_type = 'version' and rel = 'derived_from' and from_ref is not null group by 1, 2"),
    "open_target": chain(f"select id, case when {_OPEN} then adapter else 'memory' end as open_type, case when {_OPEN} then substr(external_ref, length(adapter) + 2) else id end as open_id from doc"),
    "snippet": chain(r"select id, case when length(t) <= 240 then t else substr(t, 1, 240) || '…' end as snippet from (select id, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from chk)"),
    "merge_local_live": chain(
        f"""select query_id, rank, channel, adapter, external_ref, round(combined, 6) as combined from (select *, row_number() over (partition by query_id order by combined desc, channel = 'local' desc, title, adapter, external_ref) as rank from (
        select *, round(0.85 * norm + 0.15 * ({_PRIOR % (('updated_at',) * 2)}), 9) as combined from (
        select *, case when max(score) over (partition by query_id, channel) > 0 then score / max(score) over (partition by query_id, channel) else 0 end as norm,
          row_number() over (partition by query_id, adapter, external_ref order by channel = 'local' desc, pos desc) as nth from (
          select query_id, 'local' as channel, rank as pos, adapter, external_ref, coalesce(title, '') as title, score, null::timestamp as updated_at from fal
          union all select query_id, 'live', 1, adapter, external_ref, title, length(title)::double, last_seen_at from doc join q using (tenant_id) where adapter = 'tracker' and term1 is not null and contains(lower(title), term1))) where nth = 1)) where rank <= 8"""
    ),
}
