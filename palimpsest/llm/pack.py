"""Filling containers of fixed capacity with items of varying size: bin completion over the histogram of sizes.

Sizes are whole numbers up to the capacity, so the whole collection, however large, is a histogram of at most
`capacity` counts. The packing is planned on that histogram: around the largest size left, undominated fillings are
enumerated, branches whose waste exceeds what the best solution so far allows are pruned, and a filling is applied as
often as the counts allow. Best-fit fillings are the first incumbent. The plan, a bounded list of (filling, times), is
then dealt out to the items by their rank within their size; ranks come from salted buckets, so no size, however
common, meets in one task.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.runtime import durable

CAPACITY = 2_048
#: Steps of one enumeration at most, branches kept of it, and steps of all enumerations after which the search ends with
#: the incumbent. They bound the planning time, whatever the number of items.
FILL_NODES, BRANCHES, SEARCH_NODES = 3_000, 6, 400_000
#: Parts of a filling that are enumerated; beyond, the rest of the container is filled by best fit.
DEEP = 40
#: Items that one bucket of a size holds at most, about.
BUCKET_ROWS = 1_000_000

Filling = tuple[tuple[int, int], ...]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing takes fewer containers: the largest of the bounds by volume and by sizes above each threshold."""
    size = np.arange(len(counts))
    best = -(-int((size * counts).sum()) // capacity)
    below = np.cumsum(size * counts)
    above = np.cumsum(counts[::-1])[::-1]
    for a in np.flatnonzero(counts[: capacity // 2 + 1]):
        if a == 0:
            continue
        large = int(above[capacity - a + 1]) if capacity - a + 1 < len(counts) else 0
        half = capacity // 2
        mid = int(above[half + 1] - (above[capacity - a + 1] if capacity - a + 1 < len(counts) else 0)) if half + 1 < len(counts) else 0
        mid_volume = int(below[min(capacity - a, len(counts) - 1)] - below[half])
        small = int(below[half] - below[a - 1])
        best = max(best, large + mid + max(0, -(-(small - (mid * capacity - mid_volume)) // capacity)))
    return best


def fillings(counts: np.ndarray, capacity: int, keep: int = BRANCHES, nodes: int = FILL_NODES) -> tuple[list[tuple[int, Filling]], int]:
    """(waste, filling) of undominated fillings around the largest size, the least waste first; the steps it took.

    Larger parts are tried first: the first leaf is the best-fit filling. A filling is dominated, and left out, if one of
    its parts beside the largest, or two of them, could make way for one larger part at hand that still fits (for two,
    one as large as both will do): what is freed fits wherever the other part would have gone. The search ends early at
    a filling without waste.
    """
    rising = np.flatnonzero(counts).tolist()
    sizes = np.flatnonzero(counts)[::-1]
    largest = int(sizes[0])
    sizes, counts = sizes.tolist(), counts.tolist()
    found: list[tuple[int, Filling]] = []
    budget = nodes

    def at_hand(low: int, high: int, f: dict[int, int]) -> bool:
        for x in rising[bisect_left(rising, low) :]:
            if x > high:
                return False
            if counts[x] > f.get(x, 0):
                return True
        return False

    def leaf(room: int, parts: list[int]) -> None:
        f: dict[int, int] = {}
        for p in parts:
            f[p] = f.get(p, 0) + 1
        free = {s: c - (s == largest) for s, c in f.items()}
        if not found or not (
            any(c > 0 and at_hand(s + 1, s + room, f) for s, c in free.items())
            or any(at_hand(s + t, s + t + room, f) for s in free for t in free if s <= t and free[s] > (s == t) and free[t] > 0)
        ):
            found.append((room, tuple(f.items())))

    def go(room: int, at: int, parts: list[int]) -> bool:
        nonlocal budget
        budget -= 1
        smallest = sizes[-1]
        if len(parts) >= DEEP:  # of many small parts, the rest is filled by best fit
            parts = list(parts)
            for x in sizes[at:]:
                n = min(counts[x] - parts.count(x), room // x)
                if n > 0:
                    parts += [x] * n
                    room -= n * x
            leaf(room, parts)
            return room == 0
        if room < smallest or budget <= 0:
            leaf(room, parts)
            return room == 0 or budget <= 0
        if room <= sizes[at] and counts[room] > parts.count(room):  # one part that fits exactly dominates all else
            leaf(0, [*parts, room])
            return True
        tried = False
        lo, hi = at, len(sizes)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if sizes[mid] > room else (lo, mid)
        for i in range(lo, len(sizes)):
            s = sizes[i]
            if counts[s] <= parts.count(s):
                continue
            tried = True
            if go(room - s, i, [*parts, s]):
                return True
            if budget <= 0:
                return True
        if not tried:
            leaf(room, parts)
        return False

    go(capacity - largest, 0, [largest])
    found.sort(key=lambda x: (x[0], [(-s, -c) for s, c in x[1]]))
    return found[:keep], nodes - budget


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Filling, int]]:
    """(filling, times): around the largest size left, always the largest that still fits, as often as counts allow."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[Filling, int]] = []
    while left.any():
        room, f, spare = capacity, {}, left.copy()
        while room > 0 and (fit := np.flatnonzero(spare[: room + 1])).size:
            s = int(fit[-1])
            n = min(int(spare[s]), room // s)
            f[s], spare[s], room = n, 0, room - n * s
        times = min(int(left[s]) // c for s, c in f.items())
        for s, c in f.items():
            left[s] -= c * times
        out.append((tuple(f.items()), times))
    return out


def plan(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = SEARCH_NODES) -> list[tuple[Filling, int]]:
    """(filling, times) that use each size as often as counted, in as few containers as the search finds.

    Depth-first bin completion: at each node the fillings of least waste around the largest size left, each applied as
    often as possible. A branch ends when its waste so far leaves no room for a better total than the incumbent's. The
    search stops at the lower bound, or after `nodes` steps with the incumbent. The first incumbent is the best-fit packing.
    """
    total = int((np.arange(len(counts)) * counts).sum())
    bound = lower_bound(counts, capacity)
    best: list[tuple[Filling, int]] | None = best_fit(counts, capacity)
    best_n = sum(t for _, t in best)
    if best_n <= bound:
        return best
    start = counts.astype(np.int64).copy()
    stack: list[tuple[list[tuple[int, Filling]], int]] = []  # (fillings still to try, waste before)
    path: list[tuple[Filling, int]] = []
    left, waste, used = start.copy(), 0, 0
    while True:
        if not left.any():
            n = sum(t for _, t in path)
            if n < best_n:
                best, best_n = list(path), n
            options: list[tuple[int, Filling]] = []
        elif used >= nodes:
            options = []
        else:
            options, steps = fillings(left, capacity)
            used += steps
        if best_n <= bound or used >= nodes:
            return best
        stack.append((options, waste))
        while True:
            options, waste = stack[-1]
            allowed = (best_n - 1) * capacity - total
            step = None
            while options:
                w, f = options.pop(0)
                times = min(int(left[s]) // c for s, c in f)
                if waste + w * times <= allowed:
                    step = (f, times, w)
                    break
            if step:
                break
            stack.pop()
            if not path:
                return best
            f, times = path.pop()
            for s, c in f:
                left[s] += c * times
        f, times, w = step
        for s, c in f:
            left[s] -= c * times
        path.append((f, times))
        waste += w * times


@dataclass
class Slots:
    """Where the item of each rank within a size goes: from rank `lo[i]` on, container `base[i] + (rank - lo[i]) // per[i]`;
    `first[s]` is the first entry of size s."""

    first: np.ndarray
    lo: np.ndarray
    base: np.ndarray
    per: np.ndarray

    def containers(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        width = int(self.lo.max(initial=0)) + int(rank.max(initial=0)) + 2
        key = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)).astype(np.int64) * width + self.lo
        at = np.searchsorted(key, size.astype(np.int64) * width + rank, "right") - 1
        return self.base[at] + (rank - self.lo[at]) // self.per[at]


def slots(packing: list[tuple[Filling, int]], capacity: int) -> Slots:
    per_size: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
    taken = np.zeros(capacity + 1, np.int64)
    base = 0
    for f, times in packing:
        for s, c in f:
            per_size[s].append((int(taken[s]), base, c))
            taken[s] += c * times
        base += times
    flat = [x for xs in per_size for x in xs]
    first = np.append(0, np.cumsum([len(x) for x in per_size]))
    cols = np.array(flat, np.int64).reshape(-1, 3)
    return Slots(first, cols[:, 0], cols[:, 1], cols[:, 2])


def fill_containers(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY, pack: Callable = plan) -> DataFrame:
    """Where each item goes: container (from 0), id, piece (from 0), start (offset of the piece in the item), size.

    An item above the capacity is split into full pieces and a rest; no other item is split. Items of null or no size
    are left out. Repeated ids are items of their own. An empty input gives an empty result. `sizes` is written to the
    checkpoint folder once, so that ranks don't change when a lost executor's work is done again.
    """
    whole = F.expr(f"int(({size_col} - 1) div {capacity})")
    items = durable(
        sizes.where(F.col(size_col) > 0)
        .select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias(size_col))
        .select("id", F.explode(F.sequence(F.lit(0), whole)).alias("piece"), F.col(size_col).alias("n"))
        .select("id", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece").cast("long") * capacity).cast("int").alias("size"))
    )
    buckets = 16 + items.count() // BUCKET_ROWS
    items = items.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)).cast("int"))
    per_bucket = items.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for s, n in per_bucket.groupBy("size").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[s] = n
    to = slots(pack(counts, capacity), capacity)
    before = per_bucket.select("size", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    in_bucket = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("id", "piece")) - 1
    ranked = items.withColumn("r", in_bucket).join(before, ["size", "bucket"]).select("id", "piece", "size", (F.col("before") + F.col("r")).alias("rank"))

    def run(batches):
        for b in batches:
            c = to.containers(b.column("size").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), *b.columns[:3]], names=["container", "id", "piece", "size"])

    kind = ranked.schema["id"].dataType.simpleString()
    placed = ranked.mapInArrow(run, f"container long, id {kind}, piece int, size int")
    return placed.select("container", F.col("id").alias(id_col), "piece", (F.col("piece").cast("long") * capacity).alias("start"), "size")
