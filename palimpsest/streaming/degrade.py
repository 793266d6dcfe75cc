"""Rolling rates of degraded calls with hysteresis as a stateful stream: one state per tenant and flag."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from palimpsest.operators.degrade import HIGH, LOW, WINDOW, least_samples, validate_config

OUTPUT = "tenant_id string, seq long, samples int, rate double, escalated boolean"
#: Time after which an idle tenant's state goes, in place of a bound on the number of tenants.
IDLE_MS = 24 * 3600 * 1000


class RollingRate(StatefulProcessor):
    """Keeps a tenant's last calls as a string of 0 and 1 and whether it is escalated."""

    def __init__(self, window: int = WINDOW, high: float = HIGH, low: float = LOW, idle_ms: int = IDLE_MS):
        validate_config(window, high, low)
        self.window, self.high, self.low, self.idle = window, high, low, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("calls", "hits string, escalated boolean", ttlDurationMs=self.idle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hits, on = tuple(self.state.get()) if self.state.exists() else ("", False)
        calls = pd.concat(list(rows)).sort_values("seq")
        out = []
        for seq, hit in zip(calls["seq"], calls["hit"], strict=True):
            hits = (hits + ("1" if hit else "0"))[-self.window :]
            rate = hits.count("1") / len(hits)
            if len(hits) >= least_samples(self.high):
                on = True if rate >= self.high else False if rate <= self.low else on
            out.append((key[0], int(seq), len(hits), rate, bool(on)))
        self.state.update((hits, bool(on)))
        yield pd.DataFrame(out, columns=["tenant_id", "seq", "samples", "rate", "escalated"])

    def close(self) -> None:
        pass


def degrade_stream(calls: DataFrame, **settings) -> DataFrame:
    """calls: a stream of tenant_id, seq, hit. Calls of one tenant within a micro-batch are taken in order of seq."""
    return calls.groupBy("tenant_id").transformWithStateInPandas(RollingRate(**settings), StructType.fromDDL(OUTPUT), "Append", "ProcessingTime")
