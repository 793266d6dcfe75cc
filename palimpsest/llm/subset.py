"""Choosing a varied subset of given size: greedy selection of the largest kernel determinant.

The kernel is L_ij = q_i q_j S_ij with quality q = exp(score) and S = RIDGE I + (1 - RIDGE) cosine, which is positive
definite, so the determinant stays above zero beyond as many items as there are dimensions. Each step takes the item
that multiplies the determinant most and subtracts the square of its row of the incremental Cholesky factor from the
others' residuals. Since S is of low rank but for the ridge, a row comes from a matrix of dims x dims that is updated
with it; earlier rows are not kept, so memory grows with the items, not with items times k.

With `alike`, S is 1 within a class and 0 between classes. An item's class is that of the first chosen item with a cosine
of at least `alike`: an equivalence, hence a positive semidefinite kernel; items of one class are fully redundant.

Large pools are cut into parts by a hash of the id; each part yields a composable core-set of at most k items, and
core-sets are merged and reduced, some parts at a time, until one greedy pass over the last of them gives the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a pool that one task looks at, at most about; larger pools are cut. Core-sets merged at a time.
PART_ROWS, FAN_IN = 2_048, 8
#: Share of an item's variance that no other item can explain: the floor of its gain, and the gain of a second copy is
#: about twice that.
RIDGE = 0.01


def greedy(vectors: np.ndarray, scores: np.ndarray, k: int, alike: float | None = None, fill: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(chosen rows in order, gain of each: its residual variance, 0 for items added only to reach k). Ties go to the
    earlier row. A zero vector is like nothing else."""
    n, dims = vectors.shape
    k = min(k, n)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norm, out=np.zeros_like(vectors, dtype=np.float64), where=norm > 0)
    q2 = np.exp(2 * (scores - scores.max())) if n else scores
    left = np.ones(n)  # residual variance as a share of the own one
    inverse = np.eye(dims)
    free, unclassed = np.ones(n, bool), np.ones(n, bool)
    chosen, gain = [], []
    while len(chosen) < k:
        worth = np.where(free & (left > 0), q2 * left, -1.0)
        j = int(worth.argmax())
        if worth[j] <= 0:
            break
        chosen.append(j)
        gain.append(worth[j])
        free[j] = False
        if alike is not None:
            mine = unclassed & (unit @ unit[j] >= alike)
            unclassed &= ~mine
            left[mine] = 0.0
        elif norm[j, 0] > 0:
            w = inverse @ unit[j]
            row = (1 - RIDGE) * (unit @ w) / np.sqrt(left[j])
            left = np.maximum(left - row * row, RIDGE * 1e-3)
            inverse -= (1 - RIDGE) / (RIDGE + (1 - RIDGE) * (unit[j] @ w)) * np.outer(w, w)
    if fill and len(chosen) < k:
        rest = np.flatnonzero(free)
        rest = rest[np.argsort(-q2[rest], kind="stable")][: k - len(chosen)]
        chosen.extend(rest.tolist())
        gain.extend([0.0] * len(rest))
    return np.array(chosen, np.int64), np.array(gain)


def log_determinant(vectors: np.ndarray, scores: np.ndarray, chosen: np.ndarray) -> float:
    """Logarithm of the kernel determinant of a choice, without the common factor of the scores' maximum."""
    unit = vectors[chosen] / np.linalg.norm(vectors[chosen], axis=1, keepdims=True)
    kernel = RIDGE * np.eye(len(chosen)) + (1 - RIDGE) * unit @ unit.T
    return float(np.linalg.slogdet(kernel)[1] + 2 * (scores[chosen] - scores.max()).sum())


def _pass(df: DataFrame, keys: list[str], dims: int, alike: float | None, fill: bool) -> DataFrame:
    schema = df.schema

    def run(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, [("score", "descending"), ("id", "ascending")])
        table = table.take(order)
        ids = table.column("id").to_pylist()
        first = list({x: i for i, x in reversed(list(enumerate(ids)))}.values())[::-1]  # repeated rows count once, at their best score
        first.sort()
        table = table.take(pa.array(first, pa.int64()))
        flat = table.column("vector").combine_chunks().flatten()
        v = np.asarray(flat, np.float64).reshape(-1, dims)
        s = table.column("score").to_numpy().astype(np.float64)
        pick, gain = greedy(v, s, int(table.column("k")[0].as_py()), alike, fill)
        out = table.take(pa.array(pick, pa.int64()))
        out = out.set_column(out.schema.get_field_index("gain"), "gain", pa.array(gain, pa.float64()))
        return out.set_column(out.schema.get_field_index("position"), "position", pa.array(np.arange(len(pick)), pa.int32()))

    return df.groupBy(*keys).applyInArrow(run, schema)


def choose_varied(items: DataFrame, pools: DataFrame, dims: int = 64, alike: float | None = None, fill: bool = True, part_rows: int = PART_ROWS) -> DataFrame:
    """For each pool of `pools` (pool_id, k), k items of `items` (pool_id, id, vector, score): pool_id, id, score,
    position (order of choice, from 0) and gain.

    Items with a null id, vector or score, or a vector of other length or with non-finite values, are never chosen.
    Items delivered twice count once. A pool with fewer items than k gives all of them (with `fill`), an empty pool or
    one with k below 1 or null gives none, and items of an unknown pool are left out. With `fill=False` items that add
    nothing to the determinant are not added.
    """
    usable = items.select("pool_id", "id", "vector", F.col("score").cast("double").alias("score")).where(
        F.col("id").isNotNull() & (F.size("vector") == dims) & F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    sizes = usable.groupBy("pool_id").agg(F.count(F.lit(1)).alias("n"))
    wanted = pools.select("pool_id", F.col("k").cast("int").alias("k")).where("k >= 1").dropDuplicates(["pool_id"])
    plan = wanted.join(sizes, "pool_id").select("pool_id", "k", F.ceil(F.col("n") / part_rows).cast("int").alias("parts"))
    most = plan.agg(F.max("parts")).first()[0] or 1
    work = usable.join(plan, "pool_id").select("pool_id", "id", "vector", "score", "k", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("position"), F.lit(0.0).alias("gain"))
    while True:
        # in core-sets, items without gain may still be needed to reach k, so they are kept there
        work = _pass(work, ["pool_id", "part"], dims, alike, fill)
        if most <= 1:
            return work.select("pool_id", "id", "score", "position", "gain")
        most = -(-most // FAN_IN)
        work = work.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
