"""A loop-safe processor of the feed: each entry is written as a claim, skipped, or set aside as poison.

Entries of the processor's own generator are never read again. The function that judges entries gets batches; an entry
on which it fails is poison and does not stop the others. The cursor is the page's last sequence number, whatever became
of its entries.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGENT = "resident-distiller"
CLAIM = "feed_seq long, tenant_id string, outcome string, title string, text string, error string, access_tags array<string>, derived_from array<string>, provenance string, lineage_class string, generator_agent_id string"


def should_process(feed: DataFrame, agent: str = AGENT) -> DataFrame:
    return feed.where(F.col("generator_agent_id").isNull() | (F.col("generator_agent_id") != agent))


def distil_page(feed: DataFrame, distil: Callable[[dict], dict | None], agent: str = AGENT) -> DataFrame:
    """Outcome of every entry: processed ones as `write` (with the claim) or `skip`, failed ones as `poison` with the error.

    distil(entry) -> {"title", "text"} or None to skip. A claim copies the entry's tags and names its version as its
    source; it is inferred and derived.
    """

    def run(batches):
        for b in batches:
            out = []
            for e in b.to_pylist():
                row = dict.fromkeys(("title", "text", "error", "access_tags", "derived_from", "provenance", "lineage_class", "generator_agent_id")) | {"feed_seq": e["feed_seq"], "tenant_id": e["tenant_id"]}
                try:
                    claim = distil(e)
                    if claim is None:
                        row |= {"outcome": "skip"}
                    else:
                        row |= {"outcome": "write", "title": claim["title"], "text": claim["text"], "access_tags": e["access_tags"], "derived_from": [e["version_id"]], "provenance": "inferred", "lineage_class": "derived", "generator_agent_id": agent}
                except Exception as error:
                    row |= {"outcome": "poison", "error": f"{type(error).__name__}: {error}"}
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    text, texts = pa.string(), pa.list_(pa.string())
    schema = pa.schema([("feed_seq", pa.int64()), *((n, text) for n in ("tenant_id", "outcome", "title", "text", "error")), ("access_tags", texts), ("derived_from", texts), *((n, text) for n in ("provenance", "lineage_class", "generator_agent_id"))])
    cols = ["feed_seq", "tenant_id", "version_id", "document_id", "kind", "title", "status", "created_by_kind", "generator_agent_id", "provenance", "access_tags"]
    return should_process(feed, agent).select(*cols).mapInArrow(run, CLAIM)


def sample_distiller(entry: dict) -> dict | None:
    """Claims the titles of notes, skips other kinds, fails on missing titles."""
    if entry["kind"] != "note":
        return None
    return {"title": f"Claim: {entry['title'].strip()}", "text": entry["title"]}


def tick(spark, feed: DataFrame, after: dict[str, int], distil, write: Callable[[DataFrame], None], limit: int = 50, agent: str = AGENT) -> tuple[dict[str, int], dict[str, int]]:
    """One run over the next page of each tenant: writes the claims, returns counts by outcome and the new cursors."""
    from palimpsest.operators.timeline import feed_page

    cursors = spark.createDataFrame(list(after.items()), "tenant_id string, after long")
    page = feed_page(feed, cursors, limit)
    ends = {r.tenant_id: r.c for r in page.groupBy("tenant_id").agg(F.max("next_cursor").alias("c")).collect()}
    done = distil_page(page, distil, agent).persist()
    counts = {r.outcome: r["count"] for r in done.groupBy("outcome").count().collect()}
    write(done.where("outcome = 'write'"))
    done.unpersist()
    return counts, {t: ends.get(t, a) for t, a in after.items()}


def folder_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch to a folder of its own under `path`; a batch that is done again replaces its folder, so a
    retry writes nothing twice."""
    return lambda df, number: df.write.mode("overwrite").parquet(f"{path}/batch={number}")


def start(stream: DataFrame, distil, write: Callable[[DataFrame, int], None], quarantine: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "5 minutes", agent: str = AGENT):
    """The same as a stream: every micro-batch of feed entries is judged once and dealt to the two sinks. A sink gets the
    rows and the batch's number; after a failure a batch comes again with the same number and rows, which tells the sink
    what it has written already (`folder_sink` does that)."""

    def batch(df: DataFrame, number: int) -> None:
        done = distil_page(df, distil, agent).persist()
        write(done.where("outcome = 'write'"), number)
        quarantine(done.where("outcome = 'poison'"), number)
        done.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
