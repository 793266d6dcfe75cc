"""Embedding chunks through a pluggable function, and the registry of models."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.hashing import embedding_table, model_key, record_id
from palimpsest.sources.schemas import EMBED_MODEL

#: Bounds of dimensions, texts per request and seconds per request (fixed values).
LEAST_DIMS, MOST_DIMS, BATCH, TIMEOUT = 64, 4_000, 32, 10.0
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def hashing_embedder(dims: int = 64) -> Embedder:
    """A deterministic embedder for tests: signed hashes of words, at length 1."""

    def embed(texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % dims] += 1 if h >> 32 & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0).tolist()

    return embed


def request_body(style: str, model: str, texts: Sequence[str]) -> tuple[str, dict]:
    """(path, body) of a request in one of three dialects."""
    if style == "openai":
        return "/v1/embeddings", {"model": model, "input": list(texts)}
    if style == "tei":
        return "/embed", {"inputs": list(texts)}
    if style == "ollama":
        return "/api/embed", {"model": model, "input": list(texts)}
    raise ValueError(f"unknown style {style!r}")


def response_vectors(style: str, answer) -> list[list[float]]:
    if style == "openai":
        return [d["embedding"] for d in sorted(answer["data"], key=lambda d: d["index"])]
    return answer["embeddings"] if style == "ollama" else answer


def http_embedder(base_url: str, model: str, style: str = "openai", api_key: str | None = None, timeout: float = TIMEOUT) -> Embedder:
    """An embedder that asks an endpoint, some texts at a time; an answer of another count is an error."""

    def embed(texts: Sequence[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), BATCH):
            part = texts[at : at + BATCH]
            path, body = request_body(style, model, part)
            headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
            with urllib.request.urlopen(urllib.request.Request(base_url.rstrip("/") + path, json.dumps(body).encode(), headers), timeout=timeout) as r:
                got = response_vectors(style, json.load(r))
            if len(got) != len(part):
                raise ValueError(f"asked for {len(part)} vectors, got {len(got)}")
            out += got
        return out

    return embed


def probe_dims(embed: Embedder) -> int:
    """Dimensions an embedder gives; refuses what lies outside the bounds."""
    dims = len(embed(["probe"])[0])
    if not LEAST_DIMS <= dims <= MOST_DIMS:
        raise ValueError(f"{dims} dimensions; allowed are {LEAST_DIMS} to {MOST_DIMS}")
    return dims


def embed_chunks(chunks: DataFrame, embed: Embedder, key: str, dims: int) -> DataFrame:
    """Embedding rows of chunks (tenant_id, chunk_id, text) with `rejected`: true for a vector of other length, whose
    vector is null, and for all of a batch on which the embedder fails (`error` says why)."""
    embedding_table(key)

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            try:
                vectors, error = embed(texts), None
            except Exception as e:
                vectors, error = [None] * len(texts), f"{type(e).__name__}: {e}"
            good = [v if v is not None and len(v) == dims else None for v in vectors]
            yield pa.RecordBatch.from_arrays(
                [b.column("tenant_id"), b.column("chunk_id"), pa.array(good, pa.list_(pa.float32())), pa.array([g is None for g in good]), pa.array([error] * len(good), pa.string())], names=["tenant_id", "chunk_id", "embedding", "rejected", "error"]
            )

    done = chunks.select("tenant_id", "chunk_id", "text").mapInArrow(run, "tenant_id string, chunk_id string, embedding array<float>, rejected boolean, error string")
    return done.withColumn("model_key", F.lit(key))


def upsert_embeddings(old: DataFrame, new: DataFrame) -> DataFrame:
    """`old` with `new` put in; a new vector replaces that of its chunk and model."""
    key = ["chunk_id", "model_key"]
    one = new.where("not rejected").dropDuplicates(key).select("chunk_id", "tenant_id", "model_key", "embedding")
    return old.join(one.select(*key), key, "left_anti").select("chunk_id", "tenant_id", "model_key", "embedding").unionByName(one)


def chunk_vectors(ids: DataFrame, embeddings: DataFrame, key: str) -> DataFrame:
    """The vectors of a pool of chunks (tenant_id, chunk_id), null without one."""
    return ids.join(embeddings.where(F.col("model_key") == key).select("tenant_id", "chunk_id", "embedding"), ["tenant_id", "chunk_id"], "left")


class Models:
    """The registry of embedding models as a small table; every change gives the table after it."""

    def __init__(self, spark: SparkSession, rows: DataFrame | None = None):
        self.spark = spark
        self.rows = rows if rows is not None else spark.createDataFrame([], EMBED_MODEL)

    def ensure(self, tenant: str, base_url: str, model_id: str, dims: int, now) -> str:
        """Registers a model as ready unless the tenant has it; its key."""
        key = model_key(base_url, model_id)
        new = self.spark.range(1).select(
            record_id("kemb", F.lit(tenant), F.lit(key)).alias("id"), F.lit(tenant).alias("tenant_id"), F.lit(key).alias("model_key"), F.lit(model_id).alias("model_id"), F.lit(dims).alias("dims"), F.lit("ready").alias("status"), F.lit(now).cast("timestamp_ntz").alias("created_at"), F.lit(now).cast("timestamp_ntz").alias("updated_at")
        )
        w = Window.partitionBy("tenant_id", "model_key").orderBy("created_at")
        self.rows = self.rows.unionByName(new).withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
        return key

    def activate(self, tenant: str, key: str, now) -> None:
        """Makes one model of a tenant the active one and the former one ready."""
        if not self.rows.where((F.col("tenant_id") == tenant) & (F.col("model_key") == key)).head(1):
            raise KeyError(f"tenant {tenant!r} has no model {key!r}")
        self._set(tenant, F.when(F.col("model_key") == key, "active").when(F.col("status") == "active", "ready").otherwise(F.col("status")), now)

    def clear(self, tenant: str, now) -> None:
        self._set(tenant, F.when(F.col("status") == "active", "ready").otherwise(F.col("status")), now)

    def _set(self, tenant: str, status, now) -> None:
        mine = F.col("tenant_id") == tenant
        changed = mine & (status != F.col("status"))
        self.rows = self.rows.withColumn("updated_at", F.when(changed, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("updated_at"))).withColumn("status", F.when(mine, status).otherwise(F.col("status")))

    def active(self, tenant: str):
        """The row of the tenant's active model, or None."""
        got = self.rows.where((F.col("tenant_id") == tenant) & (F.col("status") == "active")).head(1)
        return got[0] if got else None

    def by_key(self, tenant: str, key: str):
        got = self.rows.where((F.col("tenant_id") == tenant) & (F.col("model_key") == key)).head(1)
        return got[0] if got else None
