"""Rolling rates of degraded calls per tenant, with hysteresis."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.runtime import durable

#: Calls of the window, and the rates at which a flag escalates and is released (fixed values).
WINDOW, HIGH, LOW = 200, 0.20, 0.10
#: Calls of one tenant that are worked through in one piece.
BLOCK_ROWS = 1_000_000


def least_samples(watermark: float) -> int:
    """Calls needed before a rate near the watermark says anything."""
    return ceil(5 / (watermark * (1 - watermark)))


def validate_config(window: int = WINDOW, high: float = HIGH, low: float = LOW, most_tenants: int = 1000) -> None:
    """Refuses settings under which escalation could never happen or never end."""
    if not 0 < low < high < 1:
        raise ValueError("watermarks must satisfy 0 < low < high < 1")
    if window < max(least_samples(high), least_samples(low)):
        raise ValueError("the window holds too few calls for its watermarks")
    if most_tenants < 1:
        raise ValueError("at least one tenant must be kept")


def _in_blocks(calls: DataFrame, context: int, block_rows: int) -> DataFrame:
    """`calls` in blocks of `block_rows` of each tenant's history: adds block and _own, which is false for the `context`
    last calls of a block that are repeated at the start of the next.

    Places in a tenant's history come from a range partitioning, counts of its parts and the counts before them, so no
    task holds more than a part or a block of any tenant.
    """
    ranged = durable(calls.repartitionByRange("tenant_id", "seq").withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("tenant_id", "_p").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("tenant_id").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("tenant_id").alias("_t"), F.col("_p").alias("_q"), F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("tenant_id", "_p").orderBy("seq")) - 1
    placed = ranged.withColumn("_at", local).join(starts, F.col("tenant_id").eqNullSafe(F.col("_t")) & (F.col("_p") == F.col("_q"))).withColumn("_at", F.col("_at") + F.col("_before"))
    home = F.floor(F.col("_at") / block_rows)
    late = F.col("_at") % block_rows >= block_rows - context
    blocks = F.when(late, F.array(home, home + 1)).otherwise(F.array(home))
    return placed.withColumn("_home", home).withColumn("block", F.explode(blocks)).withColumn("_own", F.col("block") == F.col("_home")).drop("_p", "_t", "_q", "_before", "_at", "_home")


def rolling_rates(calls: DataFrame, flagged: Column, window: int = WINDOW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds samples and rate over the tenant's last `window` calls, this one included, and the block of its history that
    a call was worked through in. calls: tenant_id, seq (unique within a tenant), ...; a tenant with more than
    `block_rows` calls is worked through in blocks, which changes nothing in the rates."""
    marked = calls.withColumn("_hit", F.coalesce(flagged.cast("int"), F.lit(0)))
    most = calls.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    placed = _in_blocks(marked, window - 1, block_rows) if most > block_rows else marked.withColumn("block", F.lit(0).cast("long")).withColumn("_own", F.lit(True))
    w = Window.partitionBy("tenant_id", "block").orderBy("seq").rowsBetween(-(window - 1), 0)
    return placed.withColumn("samples", F.count(F.lit(1)).over(w)).withColumn("rate", F.sum("_hit").over(w) / F.count(F.lit(1)).over(w)).where("_own").drop("_hit", "_own")


def escalation(rates: DataFrame, high: float = HIGH, low: float = LOW) -> DataFrame:
    """Adds escalated: on from the high watermark, off from the low one, unchanged between and before enough samples.
    The state after each call is the last decisive event so far: that of its block, or else of the blocks before, of
    each of which one row is looked at. `rates`: see `rolling_rates`."""
    enough = F.col("samples") >= least_samples(high)
    event = F.when(enough & (F.col("rate") >= high), True).when(enough & (F.col("rate") <= low), False)
    rates = rates.withColumn("_event", event)
    last = rates.where("_event is not null").groupBy("tenant_id", "block").agg(F.max_by("_event", "seq").alias("_last"))
    every = rates.select("tenant_id", "block").distinct().join(last, ["tenant_id", "block"], "left")
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy("tenant_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    carried = every.select(F.col("tenant_id").alias("_t"), F.col("block").alias("_b"), before.alias("_carried"))
    w = Window.partitionBy("tenant_id", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    own = rates.withColumn("_event", F.last("_event", ignorenulls=True).over(w))
    joined = own.join(carried, F.col("tenant_id").eqNullSafe(F.col("_t")) & (F.col("block") == F.col("_b")), "left")
    return joined.withColumn("escalated", F.coalesce("_event", "_carried", F.lit(False))).drop("_event", "_t", "_b", "_carried")


def lifetime_counts(calls: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Calls of each tenant in all, and how many had each flag."""
    return calls.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])
