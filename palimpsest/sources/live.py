"""Live sources asked at query time, in parallel, each within a time limit; stores and sources for tests."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Seconds a source may take.
TIMEOUT = 0.8
ITEM = "source_id string, adapter string, external_ref string, title string, snippet string, score double, updated_at timestamp_ntz"


class SourceProvider(Protocol):
    id: str

    def search_live(self, query: str, tenant_id: str, principal_id: str, limit: int) -> Sequence[dict]: ...


class DocumentStore(Protocol):
    """What the plane needs from a store of documents."""

    def add(self, **request) -> dict: ...

    def search(self, query: str, tenant_id: str, principal_id: str, limit: int) -> DataFrame: ...

    def list(self, tenant_id: str, principal_id: str, limit: int) -> DataFrame: ...


@dataclass
class Live:
    items: list[dict]
    degraded: list[str] = field(default_factory=list)


def collect_live(providers: Iterable[SourceProvider], query: str, tenant_id: str, principal_id: str, limit: int, wanted: Sequence[str] | None = None, timeout: float = TIMEOUT) -> Live:
    """Items of all wanted sources. One that is late or fails adds a flag, each flag once, and no items."""
    asked = [p for p in providers if not wanted or p.id in wanted]
    if not asked:
        return Live([])
    pool = ThreadPoolExecutor(len(asked))
    try:
        jobs = {pool.submit(p.search_live, query, tenant_id, principal_id, limit): p for p in asked}
        done, _ = wait(jobs, timeout)
        items, flags = [], []
        for job, p in jobs.items():
            if job not in done:
                flags.append("live_timeout")
            elif job.exception() is not None:
                flags.append("live_error")
            else:
                items += [{"source_id": p.id, **i} for i in job.result()[:limit]]
        return Live(items, list(dict.fromkeys(flags)))
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def live_frame(spark: SparkSession, live: Live) -> DataFrame:
    names = [x.split(" ")[0] for x in ITEM.split(", ")]
    return spark.createDataFrame([tuple(i.get(n) for n in names) for i in live.items], ITEM)


@dataclass
class CatalogSource:
    """A source for tests: entries whose title or snippet holds the query; all for an empty one."""

    id: str
    catalog: list[dict]

    def search_live(self, query: str, tenant_id: str, principal_id: str, limit: int) -> list[dict]:
        q = query.strip().lower()
        return [i for i in self.catalog if not q or q in (i.get("title") or "").lower() or q in (i.get("snippet") or "").lower()][:limit]


class FrameStore:
    """A store for tests over a DataFrame (document_id, tenant_id, title, text): a title that holds the query scores 1, a
    text that does 0.5, others are left out."""

    def __init__(self, documents: DataFrame):
        self.documents = documents

    def search(self, query: str, tenant_id: str, principal_id: str = "", limit: int = 8) -> DataFrame:
        q = F.lit(query.strip().lower())
        score = F.when(F.contains(F.lower("title"), q), 1.0).when(F.contains(F.lower("text"), q), 0.5)
        return self.documents.where(F.col("tenant_id") == tenant_id).withColumn("score", score).where("score is not null").orderBy(F.desc("score"), "document_id").limit(limit)


class _Part(InputPartition):
    def __init__(self, source: str):
        self.source = source


class LiveDataSource(DataSource):
    """`spark.read.format("palimpsest_live").option("catalogs", json)`: the entries of sources (a JSON object of lists by
    source) that match the option `query`; one partition for each source."""

    @classmethod
    def name(cls) -> str:
        return "palimpsest_live"

    def schema(self) -> str:
        return ITEM

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options.get("catalogs", "{}")), self.options.get("query", ""))


class _Reader(DataSourceReader):
    def __init__(self, catalogs: dict[str, list[dict]], query: str):
        self.catalogs, self.query = catalogs, query

    def partitions(self):
        return [_Part(s) for s in sorted(self.catalogs)] or [_Part("")]

    def read(self, partition):
        names = [x.split(" ")[0] for x in ITEM.split(", ")]
        for i in CatalogSource(partition.source, self.catalogs.get(partition.source, [])).search_live(self.query, "", "", 1 << 30):
            yield tuple({"source_id": partition.source, **i}.get(n) for n in names)
