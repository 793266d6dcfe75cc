"""The feed as a stream over the append-only feed log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.schemas import FEED_LOG


def feed_stream(spark: SparkSession, path: str, files_per_batch: int = 16, exclude_generator: str | None = None) -> DataFrame:
    """Feed entries of active or superseded live versions, as they are appended to the feed log under `path` (see
    `SnapshotStore.feed_path`). The checkpoint of the query that reads the stream is its cursor. Rows without a sequence
    number are left out."""
    v = spark.readStream.schema(FEED_LOG).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).parquet(path)
    v = v.where(F.col("feed_seq").isNotNull() & F.col("status").isin("active", "superseded"))
    if exclude_generator is not None:
        v = v.where(F.col("generator_agent_id").isNull() | (F.col("generator_agent_id") != exclude_generator))
    return v


def numbered(batch: DataFrame, after: int) -> DataFrame:
    """Sequence numbers for a batch that is about to be committed, on from `after`, by time and id.

    A global order needs one sequence: the batch is range-partitioned by its order, counted per partition and numbered
    with the counts before it, so nothing is gathered in one task.
    """
    parts = batch.repartitionByRange("ingested_at", "id").sortWithinPartitions("ingested_at", "id")
    from palimpsest.runtime import durable

    placed = durable(parts.withColumn("_p", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    sizes = {r[0]: r[1] for r in placed.groupBy("_p").count().collect()}  # one row per partition
    starts, total = [], after
    for p in sorted(sizes):
        starts += [F.lit(p), F.lit(total)]
        total += sizes[p]
    if not starts:
        return placed.withColumn("feed_seq", F.lit(None).cast("long")).drop("_p", "_n")
    return placed.withColumn("feed_seq", F.create_map(*starts)[F.col("_p")] + F.col("_n") + 1).drop("_p", "_n")
