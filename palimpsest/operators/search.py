"""Batches of hybrid queries: a lexical and a dense channel, fused, deduplicated, weighted and labelled.

Every stage takes and gives DataFrames keyed by query_id, so any number of queries share one plan. Predicates come
before ranks, and each rank filter becomes a group limit ahead of its shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.functions.text import lexemes, lexical_rank

#: Queries whose vectors one pass over the embeddings compares; more take further passes.
QUERY_BLOCK = 4_096


def _rank(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank", limit: int | None = None) -> DataFrame:
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out.where(F.col(name) <= limit) if limit is not None else out


def lexical_matches(queries: DataFrame, chunks: DataFrame, language: str = "simple") -> DataFrame:
    """(query_id, chunk_id, ts_rank) for chunks of the query's tenant that hold all its lexemes.

    queries: query_id, tenant_id, terms (lexemes). chunks: tenant_id, chunk_id, text. A query without terms matches
    nothing, nor does a null text. Terms are spread over an inverted list of positions and counted back; positions are
    sets, so rows delivered twice do no harm and no text is shuffled to remove them.
    """
    terms = queries.select("query_id", "tenant_id", F.array_distinct(F.filter("terms", lambda t: t.isNotNull())).alias("terms")).where(F.size("terms") > 0)
    wanted = terms.select("query_id", "tenant_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    postings = chunks.select("tenant_id", "chunk_id", F.posexplode(lexemes(F.col("text"), language)).alias("position", "term"))
    hits = postings.join(wanted, ["tenant_id", "term"]).groupBy("query_id", "n_terms", "chunk_id", "term").agg(F.sort_array(F.collect_set(F.col("position") + 1)).alias("positions"))
    per = hits.groupBy("query_id", "n_terms", "chunk_id").agg(F.sort_array(F.collect_list(F.struct("term", "positions"))).alias("found"))
    return per.where(F.size("found") == F.col("n_terms")).select("query_id", "chunk_id", F.round(lexical_rank(F.transform("found", lambda f: f["positions"])), 6).alias("ts_rank"))


def lexical_topk(matches: DataFrame, rows: DataFrame, limit: int) -> DataFrame:
    """The best `limit` matches of each query that are searchable: rank descending, then newest, then chunk id."""
    joined = matches.join(rows.select("chunk_id", "occurred_at"), "chunk_id")
    return _rank(joined, ["query_id"], [F.desc("ts_rank"), F.desc("occurred_at"), F.col("chunk_id")], limit=limit).select("query_id", "chunk_id", "ts_rank", "rank")


def dense_topk(query_vectors: DataFrame, embeddings: DataFrame, limit: int, dims: int = 64) -> DataFrame:
    """The `limit` vectors most similar to each query's among those of its tenant and model: query_id, chunk_id, cosine,
    rank. Exact; ties go to the smaller chunk id. query_vectors: query_id, tenant_id, model_key, vector. embeddings:
    tenant_id, model_key, chunk_id, embedding, of which unusable ones are left out and rows delivered twice count once.

    Queries go over the embeddings in blocks; a block's vectors are sent to all tasks (QUERY_BLOCK x dims x 8 bytes at
    most). No vector is shuffled: each task compares its own and keeps its best `limit` for each query.
    """
    from palimpsest.functions.vectors import usable

    narrow = embeddings.where(usable(F.col("embedding"), dims)).select("tenant_id", "model_key", "chunk_id", "embedding")
    asked = query_vectors.where(usable(F.col("vector"), dims)).select("query_id", "tenant_id", "model_key", "vector")
    n = asked.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, chunk_id string, cosine double"

    def over(block: list) -> DataFrame:
        groups: dict[tuple, list] = {}
        for r in block:
            groups.setdefault((r.tenant_id, r.model_key), []).append(r)
        ids = [r.query_id for rs in groups.values() for r in rs]
        packed, first = {}, 0
        for key, rs in groups.items():
            m = np.array([r.vector for r in rs], np.float64)
            packed[key] = (first, m / np.linalg.norm(m, axis=1, keepdims=True))
            first += len(rs)
        shared = narrow.sparkSession.sparkContext.broadcast((ids, packed))

        def best(query: np.ndarray, cos: np.ndarray, name: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
            """The first `limit` different names of each query by cosine, then name."""
            t = pa.table({"query": query, "cos": -cos, "name": name})
            order = pc.sort_indices(t, [("query", "ascending"), ("cos", "ascending"), ("name", "ascending")])
            query, cos, name = query[order], cos[order], name.take(order)
            code = name.dictionary_encode().indices.to_numpy()
            fresh = np.append(True, (query[1:] != query[:-1]) | (code[1:] != code[:-1]))[: len(query)]
            at = np.flatnonzero(fresh)
            place = np.arange(len(at)) - np.searchsorted(query[at], query[at])
            at = at[place < limit]
            return query[at], cos[at], name.take(pa.array(at))

        def run(batches):
            numbers, queries = shared.value
            query, cos, name = np.zeros(0, np.int64), np.zeros(0), pa.array([], pa.string())
            for b in batches:
                b = b.set_column(2, "chunk_id", b.column("chunk_id").cast(pa.string()))
                keys = pa.table([b.column("tenant_id"), b.column("model_key")], names=["t", "m"]).group_by(["t", "m"]).aggregate([])
                for key in keys.to_pylist():
                    if (key["t"], key["m"]) not in queries:
                        continue
                    base, q = queries[key["t"], key["m"]]
                    part = b.filter(pc.and_(pc.equal(b.column("tenant_id"), key["t"]), pc.equal(b.column("model_key"), key["m"])))
                    _, once = np.unique(part.column("chunk_id").dictionary_encode().indices.to_numpy(), return_index=True)
                    part = part.take(pa.array(once))
                    x = np.asarray(part.column("embedding").flatten(), np.float64).reshape(-1, dims)
                    s = np.round(q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 6)
                    least = -np.partition(-s, limit - 1, axis=1)[:, limit - 1 : limit] if s.shape[1] > limit else np.full((len(q), 1), -2.0)
                    i, j = np.nonzero(s >= least)  # ties at the end included
                    new = best(base + i, s[i, j], part.column("chunk_id").take(pa.array(j)))
                    query, cos, name = np.concatenate([query, new[0]]), np.concatenate([cos, new[1]]), pa.concat_arrays([name, new[2]])
                    if len(query) > 4 * limit * len(numbers):
                        query, cos, name = best(query, cos, name)
            if len(query):
                query, cos, name = best(query, cos, name)
                yield pa.RecordBatch.from_arrays([pa.array([numbers[i] for i in query.tolist()]), name, pa.array(cos)], names=["query_id", "chunk_id", "cosine"])

        return narrow.mapInArrow(run, schema)

    if blocks == 1:
        found = over(asked.collect())  # at most QUERY_BLOCK rows
    else:
        found = None
        for i in range(blocks):
            part = over(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect())
            found = part if found is None else found.unionByName(part)
    found = found.dropDuplicates(["query_id", "chunk_id"])
    return _rank(found, ["query_id"], [F.desc("cosine"), F.col("chunk_id")], limit=limit).select("query_id", "chunk_id", "cosine", "rank")


def fuse(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion: query_id, chunk_id, fused, pos (place of first encounter: lexical ranks, then dense ones),
    channels (lexical before dense), ts_rank (null off the lexical channel)."""
    l = lexical.select("query_id", "chunk_id", "rank", F.lit("lexical").alias("channel"), F.col("ts_rank"))
    d = dense.select("query_id", "chunk_id", "rank", F.lit("dense").alias("channel"), F.lit(None).cast("double").alias("ts_rank"))
    size = l.groupBy("query_id").agg(F.max("rank").alias("n_lexical"))
    both = l.unionByName(d).join(size, "query_id", "left")
    place = F.when(F.col("channel") == "lexical", F.col("rank")).otherwise(F.coalesce("n_lexical", F.lit(0)) + F.col("rank"))
    return both.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(S.rrf(F.col("rank"))), 9).alias("fused"), F.min(place).alias("pos"), F.reverse(F.sort_array(F.collect_set("channel"))).alias("channels"), F.max("ts_rank").alias("ts_rank")
    )


def dedupe_documents(rows: DataFrame, score: Column) -> DataFrame:
    """The best chunk of each document (the first one on ties), ordered by score, then newest, then the document's first
    place: adds `score` and `rank`. rows: query_id, document_id, pos, occurred_at and more."""
    doc = Window.partitionBy("query_id", "document_id")
    best = rows.withColumn("score", F.round(score, 9)).withColumn("doc_pos", F.min("pos").over(doc)).withColumn("nth", F.row_number().over(doc.orderBy(F.desc("score"), F.col("pos")))).where("nth = 1").drop("nth")
    return _rank(best, ["query_id"], [F.desc("score"), F.desc("occurred_at"), F.col("doc_pos")]).drop("doc_pos")


def attach_corroboration(rows: DataFrame, edge: DataFrame) -> DataFrame:
    """Adds supports and contradicts: edges of these kinds that lead to the row's version, 0 if none. One aggregate per
    version, so a much-referred version is one row when joined."""
    counts = edge.where((F.col("to_type") == "version") & F.col("rel").isin("supports", "contradicts")).groupBy("tenant_id", F.col("to_ref").alias("version_id")).agg(F.count_if(F.col("rel") == "supports").alias("supports"), F.count_if(F.col("rel") == "contradicts").alias("contradicts"))
    return rows.join(counts, ["tenant_id", "version_id"], "left").fillna(0, ["supports", "contradicts"])


def entity_ids(edge: DataFrame) -> DataFrame:
    """(tenant_id, document_id, entity_ids): the entities each document leads to, sorted, with repetitions."""
    e = edge.where((F.col("from_type") == "document") & (F.col("to_type") == "entity") & F.col("from_ref").isNotNull())
    return e.groupBy("tenant_id", F.col("from_ref").alias("document_id")).agg(F.sort_array(F.collect_list("to_ref")).alias("entity_ids"))


def derived_from(edge: DataFrame) -> DataFrame:
    """(tenant_id, version_id, derived_from): the versions each version is derived from, sorted."""
    e = edge.where((F.col("from_type") == "version") & (F.col("to_type") == "version") & (F.col("rel") == "derived_from") & F.col("from_ref").isNotNull())
    return e.groupBy("tenant_id", F.col("from_ref").alias("version_id")).agg(F.sort_array(F.collect_list("to_ref")).alias("derived_from"))


def unit_scores(c: Column, keys: list[str]) -> Column:
    """Scores scaled to [0, 1] within each query; all equal give 1."""
    w = Window.partitionBy(*keys)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high == low, 1.0).otherwise((c - low) / (high - low))


def boosted(rows: DataFrame, now: Column) -> DataFrame:
    """Adds `final`: the scaled score times the boosts by authority, corroboration and time."""
    auth = S.effective_authority(F.col("authority"), F.col("supports"), F.col("contradicts"))
    return rows.withColumn("norm", unit_scores(F.col("score"), ["query_id"])).withColumn(
        "final",
        F.round(F.col("norm") * S.boost(auth) * S.corroboration_factor(F.col("supports"), F.col("contradicts")) * S.temporal_boost(F.col("temporal_class"), F.col("occurred_at"), F.col("valid_until"), now), 9),
    )


def evidence(lexical_rows: DataFrame, n_hits: DataFrame, reranked: DataFrame | None = None) -> DataFrame:
    """(query_id, evidence). lexical_rows: query_id, ts_rank, pos, authority, supports, provenance, created_by_kind.
    n_hits: query_id, hits. reranked (optional): query_id, rerank_score and the same attributes of the best hit.

    none without hits; strong if the best lexical row (the first on ties), or the best reranked hit, is good enough and
    passes the gate; weak otherwise.
    """
    fields = ("authority", "supports", "provenance", "created_by_kind")
    gate = lambda p: S.strong_gate(*[F.col(f"{p}.{f}") for f in fields])
    best = lexical_rows.where("ts_rank is not null").groupBy("query_id").agg(F.max_by(F.struct("ts_rank", *fields), F.struct("ts_rank", -F.col("pos"))).alias("b"))
    out = n_hits.join(best, "query_id", "left")
    strong = F.coalesce((F.col("b.ts_rank") >= S.STRONG_RANK) & gate("b"), F.lit(False))
    if reranked is not None:
        out = out.join(reranked.select("query_id", F.struct("rerank_score", *fields).alias("r")), "query_id", "left")
        strong = strong | F.coalesce((F.col("r.rerank_score") >= S.STRONG_RERANK) & gate("r"), F.lit(False))
    return out.select("query_id", F.when(F.col("hits") == 0, "none").when(strong, "strong").otherwise("weak").alias("evidence"))


def mmr(rows: DataFrame, k: int, trade: float = 0.7, pool: int = 20, dims: int = 64) -> DataFrame:
    """Of the best `pool` rows of each query, k in order of score minus `trade` times the greatest similarity to those
    before: query_id, chunk_id, position. rows: query_id, chunk_id, score, vector (null: similar to nothing).

    A row without a vector ranks after all with one; ties keep the order of score, then of chunk id. A query's pool is
    bounded, so one small group per query goes to Python.
    """
    top = _rank(rows.select("query_id", "chunk_id", F.col("score").cast("double").alias("score"), F.col("vector").cast("array<double>").alias("vector")), ["query_id"], [F.desc("score"), F.col("chunk_id")], limit=pool)

    def choose(t: pa.Table) -> pa.Table:
        rs = sorted(t.to_pylist(), key=lambda r: r["rank"])
        v = np.zeros((len(rs), dims))
        for i, r in enumerate(rs):
            if r["vector"] is not None and len(r["vector"]) == dims:
                v[i] = r["vector"]
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        u = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
        have = [i for i, r in enumerate(rs) if r["vector"] is not None]
        order: list[int] = []
        worst = np.full(len(rs), -np.inf)
        while have and len(order) < k:
            gain = [rs[i]["score"] - trade * (worst[i] if order else 0.0) for i in have]
            i = have.pop(int(np.argmax(gain)))
            order.append(i)
            worst = np.maximum(worst, u @ u[i])
        order += [i for i, r in enumerate(rs) if r["vector"] is None][: k - len(order)]
        return pa.table({"query_id": t.column("query_id").take(pa.array([0] * len(order), pa.int64())), "chunk_id": [rs[i]["chunk_id"] for i in order], "position": pa.array(range(1, len(order) + 1), pa.int32())})

    kind = rows.schema["query_id"].dataType.simpleString()
    return top.groupBy("query_id").applyInArrow(choose, f"query_id {kind}, chunk_id string, position int")


def rerank_budget(query: str, token_limit: int = 512, max_chars: int | None = None) -> int | None:
    """Characters of a text that fit next to a query in a reranker's window; None if too few are left."""
    left = (max_chars if max_chars is not None else (token_limit - 12) * 3) - len(query)
    return left if left >= 200 else None


def rerank(rows: DataFrame, queries: DataFrame, reranker, cut: int = 50, token_limit: int = 512) -> DataFrame:
    """`rows` of the best `cut` of each query with `rerank_score`; rows the reranker leaves out are dropped.

    reranker(query_text, [texts]) -> [scores]. rows: query_id, chunk_id, text, score. queries: query_id, query_text.
    One bounded group per query. A query too long for the window gives no rows.
    """
    top = _rank(rows.select("query_id", "chunk_id", "text", "score"), ["query_id"], [F.desc("score"), F.col("chunk_id")], limit=cut).join(queries.select("query_id", "query_text"), "query_id")

    def score(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        query = t.column("query_text")[0].as_py() or ""
        room = rerank_budget(query, token_limit)
        if room is None:
            t = t.slice(0, 0)
        texts = [(x or "").strip()[:room] for x in t.column("text").to_pylist()]
        scores = reranker(query, texts) if texts else []
        return pa.table({"query_id": t.column("query_id"), "chunk_id": t.column("chunk_id"), "rerank_score": pa.array([float(s) for s in scores], pa.float64())})

    kind = rows.schema["query_id"].dataType.simpleString()
    return top.groupBy("query_id").applyInArrow(score, f"query_id {kind}, chunk_id string, rerank_score double")


def overlap_reranker(query: str, texts: list[str]) -> list[float]:
    """A reranker for tests: the share of the query's words that a text holds."""
    import re

    words = set(re.findall(r"[^\W_]+", query.lower()))
    return [len(words & set(re.findall(r"[^\W_]+", t.lower()))) / len(words) if words else 0.0 for t in texts]


def generation_tuning(runs: DataFrame, configs: DataFrame) -> DataFrame:
    """(tenant_id, generation, params): the parameters that each derived generation is searched with. A configuration of
    another tenant is none; a generation without a configuration has null parameters."""
    c = configs.select("tenant_id", F.col("id").alias("config_id"), "params")
    return runs.select("tenant_id", "generation", "config_id").join(c, ["tenant_id", "config_id"], "left").select("tenant_id", "generation", "params")


def merge_local_live(items: DataFrame, now: Column, sources: list[str] | None = None, limit: int = 8) -> DataFrame:
    """Local and live items ranked as one list per query.

    items: query_id, channel ('local' or 'live'), pos, source_id, adapter, external_ref, title, score, updated_at.
    Scores are scaled by the greatest of their query and channel; of items with one adapter and reference the local one
    stays, else the last; order: combined score, local first, title, then reference.
    """
    if sources:
        items = items.where(F.col("source_id").isin(*sources))
    top = F.max("score").over(Window.partitionBy("query_id", "channel"))
    norm = F.when(top > 0, F.col("score") / top).otherwise(0.0)
    key = Window.partitionBy("query_id", "adapter", "external_ref").orderBy((F.col("channel") == "local").desc(), F.desc("pos"))
    one = items.withColumn("norm", norm).withColumn("nth", F.row_number().over(key)).where("nth = 1").drop("nth")
    scored = one.withColumn("combined", F.round(S.merged_score(F.col("norm"), S.recency_prior(F.col("updated_at"), now)), 9))
    return _rank(scored, ["query_id"], [F.desc("combined"), (F.col("channel") == "local").desc(), F.col("title"), F.col("adapter"), F.col("external_ref")], limit=limit)
