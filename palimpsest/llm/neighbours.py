"""The k most similar vectors of every vector: hierarchical k-means trees searched best bin first.

Every group (here tenant and model) has one tree. A group too large for one task is cut level by level: a k-means tree,
fitted on a bounded sample, whose leaves are dealt into cells of about `SHARD_ROWS` vectors; every vector is indexed in
the cell of its nearest leaf, and cells that are still too large are cut again. So no level sees more than a bounded
sample, and a vector is compared with some tree nodes, never with all centres. As a query a vector also visits other
cells whose leaves are nearly as near as its nearest; how nearly is calibrated on the sample, and their number is
bounded, so what is shuffled grows in proportion to the vectors.

The last levels of the tree are built by the task that holds a cell, over all its vectors. There a priority queue of
tree nodes, one for each query, is worked off best first, whole batches of queries in step, and the number of leaves
visited is widened until a calibration set of queries, compared with brute force over the cell, reaches the recall
asked for.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.runtime import durable, stored

#: Vectors of a cell, about (one of up to half as many more is not cut); of a leaf at most; branches of a node at most.
SHARD_ROWS, LEAF_ROWS, BRANCHES = 48_000, 256, 256
#: Cells that one level cuts a cell into at most; sampled vectors for each of them, and at least; sampled ones of a leaf.
FAN_OUT, FIT_PER_CELL, FIT_LEAST, FIT_LEAF = 256, 256, 8_192, 16
#: Cells that a vector visits as a query at most on one level (its own included), and leaves it looks at to find them.
VISITS, LOOKS = 8, 48
#: Visiting queries of a cell that one task answers, about, as a multiple of the cell's rows.
VISITORS = 8
#: Bytes of fitted levels that are sent to every task; more meet their vectors in a shuffle, ROUTE_ROWS vectors a task.
BROADCAST_BYTES, ROUTE_ROWS = 64 << 20, 100_000
#: Recall at which widening stops in a cell, and of visits between cells; calibration queries of a cell and of a level.
RECALL, MARGIN_RECALL, CALIBRATION, FIT_CALIBRATION = 0.97, 0.98, 192, 512
#: With a least cosine, so many queries calibrate a level, by neighbours of that cosine alone if the sample has so many,
#: and to this recall: near neighbours are reached by few visits.
NEAR_CALIBRATION, NEAR_LEAST, NEAR_RECALL = 4_096, 100, 0.998
ROUNDS = 6


def unit_rows(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are usable, their vectors at length 1). Usable: `dims` finite values, not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    have = np.flatnonzero(size == dims)
    if not len(have):
        return have, np.zeros((0, dims), np.float32)
    flat = pc.fill_null(column.take(pa.array(have)).flatten().cast(pa.float64()), float("nan"))
    v = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)
    good = np.isfinite(v).all(1) & (v != 0).any(1)
    v = v[good]
    v = v / np.abs(v).max(1, keepdims=True)  # else the squares of very large values overflow
    return have[good], (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def nearest_centre(x: np.ndarray, c: np.ndarray, block: int = 8_192) -> np.ndarray:
    """The number of the centre most similar to each vector; a block of similarities at a time."""
    return np.concatenate([(x[i : i + block] @ c.T).argmax(1) for i in range(0, len(x), block)]) if len(x) else np.zeros(0, np.int64)


def k_means(x: np.ndarray, k: int, seed: int = 0, rounds: int = ROUNDS) -> np.ndarray:
    """Centres, at length 1, of at most k clusters by cosine."""
    g = np.random.default_rng(seed)
    c = x[g.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = nearest_centre(x, c)
        order = np.argsort(a, kind="stable")
        n = np.bincount(a, minlength=len(c))
        full = np.flatnonzero(n)
        c = x[g.integers(0, len(x), len(c))].copy()  # a centre without vectors starts anew
        c[full] = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


class Tree:
    """A hierarchical k-means tree over unit vectors. Node 0 is the root; `kids` of a leaf is empty and `rows` its members."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF_ROWS, branches: int = BRANCHES):
        self.x = x
        self.centre: list[np.ndarray] = [np.zeros(x.shape[1], np.float32)]
        self.kids: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop(0)
            while len(self.kids) <= node:
                self.kids.append(np.zeros(0, np.int64))
                self.rows.append(np.zeros(0, np.int64))
            if len(rows) <= leaf:
                self.rows[node] = rows
                continue
            k = min(branches, -(-len(rows) // (leaf // 2)))
            c = k_means(x[rows[:: max(1, len(rows) // (96 * k))]], k, node)
            a = nearest_centre(x[rows], c)
            n = np.bincount(a, minlength=len(c))
            if n.max() == len(rows):  # copies of one vector: no centre parts them
                c, a = c[:1].repeat(-(-len(rows) // leaf), 0), np.arange(len(rows)) // leaf
                n = np.bincount(a)
            kids = []
            for j in np.flatnonzero(n):
                kids.append(len(self.centre))
                self.centre.append(c[j])
                todo.append((kids[-1], rows[a == j]))
            self.kids[node] = np.array(kids)
        self.centres = np.vstack(self.centre)
        self.is_leaf = np.array([not len(k) for k in self.kids], bool)

    def visits(self, q: np.ndarray, leaves: int) -> np.ndarray:
        """The first `leaves` leaves of each query, best bin first; -1 where the tree has no more."""
        n = len(q)
        out = np.full((n, leaves), -1, np.int64)
        if not len(self.kids[0]):
            out[:, 0] = 0
            return out
        width = len(self.kids[0]) + 16
        score, node = np.full((n, width), -np.inf, np.float32), np.zeros((n, width), np.int64)
        used, got = np.zeros(n, np.int64), np.zeros(n, np.int64)

        def push(who: np.ndarray, parent: int) -> None:
            nonlocal score, node
            kids = self.kids[parent]
            while used[who].max() + len(kids) > score.shape[1]:
                score = np.hstack([score, np.full((n, 32), -np.inf, np.float32)])
                node = np.hstack([node, np.zeros((n, 32), np.int64)])
            at = used[who][:, None] + np.arange(len(kids))
            score[who[:, None], at] = q[who] @ self.centres[kids].T
            node[who[:, None], at] = kids
            used[who] += len(kids)

        push(np.arange(n), 0)
        live = np.arange(n)
        while len(live):
            best = score[live].argmax(1)
            top = node[live, best]
            some = score[live, best] > -np.inf
            score[live, best] = -np.inf
            live, top = live[some], top[some]
            leaf = self.is_leaf[top]
            out[live[leaf], got[live[leaf]]] = top[leaf]
            got[live[leaf]] += 1
            for t in np.unique(top[~leaf]):
                push(live[~leaf][top[~leaf] == t], int(t))
            live = live[got[live] < leaves]
        return out

    def search(self, q: np.ndarray, own: np.ndarray, k: int, leaves: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the k most similar of the vectors in the leaves visited; own[i] is left out for query i."""
        lists = self.visits(q, leaves)
        n = len(q)
        found, cos = np.full((n, leaves * k), -1, np.int64), np.full((n, leaves * k), -2, np.float32)
        who, slot = np.nonzero(lists >= 0)
        order = np.argsort(lists[who, slot], kind="stable")
        who, slot = who[order], slot[order]
        leaf = lists[who, slot]
        cuts = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1])) if len(leaf) else []
        for a, b in zip(cuts, [*cuts[1:], len(leaf)], strict=True):
            rows, w = self.rows[leaf[a]], who[a:b]
            s = q[w] @ self.x[rows].T
            s[rows[None, :] == own[w][:, None]] = -2
            m = min(k, len(rows))
            top = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < len(rows) else np.broadcast_to(np.arange(m), (len(w), m))
            at = (slot[a:b] * k)[:, None] + np.arange(m)
            found[w[:, None], at] = rows[top]
            cos[w[:, None], at] = np.take_along_axis(s, top, 1)
        m = min(k, found.shape[1])
        top = np.argpartition(-cos, m - 1, axis=1)[:, :m] if m < found.shape[1] else np.broadcast_to(np.arange(m), (n, m))
        return np.take_along_axis(found, top, 1), np.take_along_axis(cos, top, 1)

    def calibrated(self, k: int, recall: float, seed: int = 1) -> int:
        """Leaves to visit so that a calibration set finds the share `recall` of its true neighbours in this tree."""
        n = len(self.x)
        total = sum(1 for r in self.rows if len(r))
        pick = np.random.default_rng(seed).choice(n, min(CALIBRATION, n), replace=False)
        s = self.x[pick] @ self.x.T
        s[np.arange(len(pick)), pick] = -2
        m = min(k, n - 1)
        if m < 1:
            return 1
        true = -np.partition(-s, m - 1, axis=1)[:, :m]
        leaves = 2
        while leaves < total:
            _, cos = self.search(self.x[pick], pick, m, leaves)
            # counted by cosine, so that equal vectors may stand for one another
            if (cos >= true.min(1, keepdims=True) - 1e-6).sum() >= recall * true.size:
                return leaves
            leaves = min(total, leaves + max(2, leaves // 2))
        return total


def deal(c: np.ndarray, mass: np.ndarray, shards: int) -> np.ndarray:
    """A shard for each centre: halves of about equal mass across the main axis of the centres, again and again."""
    out = np.zeros(len(c), np.int64)
    todo, made = [(np.arange(len(c)), shards)], 0
    while todo:
        at, parts = todo.pop()
        if parts <= 1 or len(at) <= 1:
            out[at] = made
            made += 1
            continue
        x = c[at] - c[at].mean(0)
        axis = np.linalg.svd(x, full_matrices=False)[2][0]
        order = at[np.argsort(x @ axis, kind="stable")]
        share = np.cumsum(mass[order]) / mass[order].sum()
        cut = min(max(1, int(np.searchsorted(share, (parts // 2) / parts)) + 1), len(at) - 1)
        todo += [(order[:cut], parts // 2), (order[cut:], parts - parts // 2)]
    return out


@dataclass
class Level:
    """One cut of a cell: a tree over a sample, and the parts that its leaves belong to.

    Leaf l belongs to the parts first[l] to first[l] + spread[l] - 1; more than one if it holds very many copies of one
    vector, which no centre can part and a hash of the id does. `rows` estimates the vectors of each part and `blocks`
    says among how many tasks the queries that visit it are shared out.
    """

    tree: Tree
    first: np.ndarray
    spread: np.ndarray
    margin: float
    rows: np.ndarray
    blocks: np.ndarray

    def near_parts(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(home part of each vector, similarity of the nearest leaf of each part that it looked at, else -9)."""
        leaves = self.tree.visits(x, LOOKS)
        best = np.full((len(x), len(self.rows)), -9, np.float32)
        at = np.arange(len(x))
        for leaf in leaves.T:
            sim = np.where(leaf >= 0, np.einsum("ij,ij->i", x, self.tree.centres[leaf]), -9)
            part = self.first[leaf] + h % self.spread[leaf]
            best[at, part] = np.maximum(best[at, part], sim)
        return best.argmax(1), best

    def visits(self, home: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, part) for the other parts that each vector visits: at most VISITS - 1, within the margin."""
        m = min(VISITS, best.shape[1])
        top = np.argpartition(-best, m - 1, axis=1)[:, :m]
        sim = np.take_along_axis(best, top, 1)
        i, j = np.nonzero((sim >= sim.max(1, keepdims=True) - self.margin) & (sim > -9) & (top != home[:, None]))
        return i, top[i, j]


def fit_level(x: np.ndarray, h: np.ndarray, n: int, shard_rows: int, k: int, at_least: float | None = None) -> Level:
    """The cut of a cell of about n vectors, of which x is a sample and h their hashes."""
    limit = shard_rows * 3 // 2
    # the margin is set by vectors that the tree wasn't fitted on
    held_out = np.random.default_rng(3).permutation(len(x))[: len(x) // 4]
    fitted = np.delete(x, held_out, axis=0)
    tree = Tree(fitted, FIT_LEAF, BRANCHES)
    leaf = np.flatnonzero(tree.is_leaf)
    size = np.array([len(tree.rows[i]) for i in leaf])
    # copies of a vector fill several leaves, whose centres differ by rounding at most
    centre, same = np.unique(np.round(tree.centres[leaf], 5), axis=0, return_inverse=True)
    same = same.reshape(-1)
    mass = np.bincount(same, size, len(centre)) * (n / len(fitted))
    crowd = mass > limit
    first, spread = np.zeros(len(centre), np.int64), np.ones(len(centre), np.int64)
    parts = 0
    if (~crowd).any():
        wanted = max(1, min(FAN_OUT, -(-int(mass[~crowd].sum()) // shard_rows)))
        dealt = deal(centre[~crowd], mass[~crowd], wanted)
        first[~crowd], parts = dealt, int(dealt.max()) + 1
    for c in np.flatnonzero(crowd):
        first[c], spread[c] = parts, min(FAN_OUT, -(-int(mass[c]) // shard_rows))
        parts += int(spread[c])
    node_first, node_spread = np.zeros(len(tree.centres), np.int64), np.ones(len(tree.centres), np.int64)
    node_first[leaf], node_spread[leaf] = first[same], spread[same]
    tree.x, tree.rows, tree.centre = x[:0], [], []
    level = Level(tree, node_first, node_spread, 9.0, np.zeros(parts), np.ones(parts, np.int64))
    home, best = (np.concatenate(z) for z in zip(*(level.near_parts(x[i : i + 8_192], h[i : i + 8_192]) for i in range(0, len(x), 8_192)), strict=True))
    pick = held_out[: FIT_CALIBRATION if at_least is None else NEAR_CALIBRATION]
    m = min(k, len(x) - 1)
    if m > 0 and len(pick):
        near, cos = [], []
        for i in range(0, len(pick), 128):
            s = x[pick[i : i + 128]] @ x.T
            s[np.arange(len(s)), pick[i : i + 128]] = -2
            near.append(np.argpartition(-s, m - 1, axis=1)[:, :m])
            cos.append(np.take_along_axis(s, near[-1], 1))
        gap = best[pick].max(1, keepdims=True) - np.take_along_axis(best[pick], home[np.concatenate(near)], 1)
        if at_least is not None and (strong := np.concatenate(cos) >= at_least).sum() >= NEAR_LEAST:
            level.margin = float(np.quantile(gap[strong], NEAR_RECALL)) + 1e-6
        else:
            level.margin = float(np.quantile(gap, MARGIN_RECALL)) + 1e-6
    level.rows = np.bincount(home, minlength=parts) * (n / len(x))
    _, seen = level.visits(home, best)
    visitors = np.bincount(seen, minlength=parts) * (n / len(x))
    level.blocks = np.where(level.rows > limit, 1, np.maximum(1, np.ceil(visitors / (VISITORS * shard_rows)))).astype(np.int64)
    return level


def nearest(df: DataFrame, id_col: str, vector: str, groups: list[str], k: int = 5, dims: int = 64, at_least: float | None = None, shard_rows: int = SHARD_ROWS, recall: float = RECALL) -> DataFrame:
    """(group columns, id, neighbour, cosine, rank): the k most similar other vectors of the same group, for every usable
    vector.

    Usable is a vector of `dims` finite values, not all zero, with an id; all others, and rows delivered twice, are left
    out. `at_least` keeps only neighbours of at least this cosine, before anything further is shuffled. Equal vectors are
    neighbours of cosine 1; ties are broken by the smaller id. A group of one vector, and an empty table, give nothing.
    """
    names = [f"g{i}" for i in range(len(groups))]
    narrow = df.select(*[F.col(g).cast("string").alias(n) for g, n in zip(groups, names, strict=True)], F.col(id_col).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dims))
    gs = "".join(f"{n} string, " for n in names)
    columns = [*names, "id", "h", "cell", "block", "member", "ask", "x"]
    schema = f"{gs}id string, h long, cell string, block int, member boolean, ask boolean, x binary"

    def clean(batches):
        for b in batches:
            have, x = unit_rows(b.column("v"), dims)
            t = b.take(pa.array(have))
            yes = pa.array(np.ones(len(have), bool))
            yield pa.RecordBatch.from_arrays([*(t.column(n) for n in (*names, "id", "h")), pa.array([""] * len(have), pa.string()), pa.array(np.zeros(len(have), np.int32)), yes, yes, _binary(x)], names=columns)

    # a hash of the id picks samples, parts copies and shares out queries
    rows = narrow.withColumn("h", F.xxhash64("id").bitwiseAND(F.lit((1 << 63) - 1))).mapInArrow(clean, schema)
    limit = shard_rows * 3 // 2
    large = narrow.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).withColumn("cell", F.lit(""))
    while True:
        large = durable(large.select(*names, "cell", "n"))
        n_large = large.count()
        if not n_large:
            break
        rows, large = _cut(rows, large, n_large, names, columns, schema, gs, dims, shard_rows, k, at_least)

    def search(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, [("id", "ascending"), ("member", "descending"), ("ask", "descending")])
        table = table.take(order)
        name = pc.dictionary_encode(table.column("id").combine_chunks())
        code = (name.chunk(0) if isinstance(name, pa.ChunkedArray) else name).indices.to_numpy()
        table = table.take(pa.array(np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])))
        x = _vectors(table.column("x"), dims)
        member = np.flatnonzero(table.column("member").to_numpy(zero_copy_only=False))
        asks = np.flatnonzero(table.column("ask").to_numpy(zero_copy_only=False))
        a, b, c = [], [], []
        if len(member):
            tree = Tree(x[member])
            leaves = tree.calibrated(k, recall)
            place = np.full(len(x), -1)
            place[member] = np.arange(len(member))
            for at in range(0, len(asks), 4096):
                part = asks[at : at + 4096]
                found, cos = tree.search(x[part], place[part], k, leaves)
                i, j = np.nonzero((found >= 0) & (cos >= (-1.5 if at_least is None else at_least - 1e-4)))
                p, q = part[i], member[found[i, j]]
                exact = np.einsum("ij,ij->i", x[p].astype(np.float64), x[q].astype(np.float64))
                keep = slice(None) if at_least is None else exact >= at_least - 1e-7
                a.append(p[keep])
                b.append(q[keep])
                c.append(exact[keep])
        a, b, c = (np.concatenate(z) if z else np.zeros(0, t) for z, t in ((a, np.int64), (b, np.int64), (c, float)))
        t = table.take(pa.array(a))
        return pa.table([*(t.column(n) for n in (*names, "id")), table.column("id").take(pa.array(b)), pa.array(c)], names=[*names, "id", "neighbour", "cosine"])

    found = rows.groupBy(*names, "cell", "block").applyInArrow(search, f"{gs}id string, neighbour string, cosine double").where("id <> neighbour")
    best = Window.partitionBy(*names, "id").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).toDF(*groups, "id", "neighbour", "cosine", "rank")


def _binary(x: np.ndarray) -> pa.Array:
    """One binary value for each row of x."""
    width = x.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x, np.float32))])


def _vectors(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dims)


def _cut(rows: DataFrame, large: DataFrame, n_large: int, names: list[str], columns: list[str], schema: str, gs: str, dims: int, shard_rows: int, k: int, at_least: float | None) -> tuple[DataFrame, DataFrame]:
    """(`rows` with those of the cells in `large` (names, cell, n) moved into their parts, the parts to cut again)."""
    on = [*names, "cell"]
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in on]
    parts = F.least(F.lit(FAN_OUT), F.ceil(F.col("n") / shard_rows))
    wanted = large.withColumn("fit", F.greatest(F.lit(FIT_LEAST), parts * FIT_PER_CELL))
    wanted = F.broadcast(wanted) if n_large <= 100_000 else wanted
    drawn = rows.where("member and block = 0").alias("r").join(wanted.alias("w"), same("r", "w")).select(*[F.col(f"r.{c}") for c in on], "h", "x", "n", "fit").where(F.pmod("h", F.col("n")) < F.col("fit"))
    # repeated ids share a hash; the rank bounds the sample whatever their number
    sample = drawn.withColumn("nth", F.row_number().over(Window.partitionBy(*on).orderBy("h", "x"))).where(F.col("nth") <= 2 * F.lit(FAN_OUT * FIT_PER_CELL))

    def fit(t: pa.Table) -> pa.Table:
        level = fit_level(_vectors(t.column("x"), dims), t.column("h").to_numpy(), t.column("n")[0].as_py(), shard_rows, k, at_least)
        first = t.slice(0, 1)
        return pa.table([*(first.column(c) for c in on), pa.array([pickle.dumps(level)], pa.binary()), pa.array([level.rows.tolist()], pa.list_(pa.float64()))], names=[*on, "level", "estimate"])

    fitted = durable(sample.groupBy(*on).applyInArrow(fit, f"{gs}cell string, level binary, estimate array<double>"))
    limit = shard_rows * 3 // 2

    def moved(level: Level, t: pa.Table) -> list[pa.Array]:
        x, h = _vectors(t.column("x"), dims), t.column("h").to_numpy()
        member, ask = (t.column(c).to_numpy(zero_copy_only=False) for c in ("member", "ask"))
        home, best = level.near_parts(x, h)
        # members go to their home, once for each block there; they ask in the block that their hash names
        times = np.where(member, level.blocks[home], 1)
        who = np.repeat(np.arange(len(x)), times)
        block = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
        mine = h % level.blocks[home]
        block = np.where(member[who], block, mine[who])
        part, asks, members = home[who], ask[who] & (block == mine[who]), member[who]
        i, j = level.visits(home, best)
        go = member[i] & ask[i]  # a visitor goes on to its nearest part alone
        i, j = i[go], j[go]
        who, part = np.concatenate([who, i]), np.concatenate([part, j])
        block, asks, members = np.concatenate([block, h[i] % level.blocks[j]]), np.concatenate([asks, np.ones(len(i), bool)]), np.concatenate([members, np.zeros(len(i), bool)])
        out = t.take(pa.array(who))
        cell = pc.binary_join_element_wise(out.column("cell").cast(pa.string()), pa.array(part.astype(str).tolist(), pa.string()), "/")
        return [*(out.column(c) for c in (*names, "id", "h")), cell, pa.array(block.astype(np.int32)), pa.array(members), pa.array(asks), out.column("x")]

    sent = fitted.agg(F.sum(F.length("level"))).first()[0] or 0
    if sent <= BROADCAST_BYTES:
        levels = {tuple(r[c] for c in on): pickle.loads(bytes(r.level)) for r in fitted.select(*on, "level").collect()}
        shared = rows.sparkSession.sparkContext.broadcast(levels)

        def route(batches):
            for b in batches:
                t = pa.Table.from_batches([b])
                key = list(zip(*(t.column(c).to_pylist() for c in on), strict=True))
                at: dict[tuple, list[int]] = {}
                for i, x in enumerate(key):
                    at.setdefault(x if x in shared.value else (), []).append(i)
                for x, i in at.items():
                    part = t.take(pa.array(i))
                    yield from (pa.table(moved(shared.value[x], part), names=columns) if x else part.select(columns)).combine_chunks().to_batches()

        out = rows.mapInArrow(route, schema)
    else:
        salts = F.ceil(F.col("n") / ROUTE_ROWS).cast("int")
        tagged = rows.alias("r").join(wanted.alias("w"), same("r", "w"), "left").select(*[F.col(f"r.{c}") for c in columns], F.pmod("h", salts).cast("int").alias("salt"))
        models = fitted.alias("f").join(wanted.alias("w"), same("f", "w")).select(*[F.col(f"f.{c}") for c in on], "level", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))

        def meet(t: pa.Table, model: pa.Table) -> pa.Table:
            if not len(t) or not len(model):
                return t.select(columns)
            return pa.table(moved(pickle.loads(model.column("level")[0].as_py()), t), names=columns)

        hit = tagged.where("salt is not null").groupBy(*on, "salt").cogroup(models.groupBy(*on, "salt")).applyInArrow(meet, schema)
        out = hit.unionByName(tagged.where("salt is null").drop("salt"))
    again = fitted.select(*on, F.posexplode("estimate").alias("part", "rows")).where(F.col("rows") > limit)
    next_large = again.select(*names, F.concat_ws("/", "cell", F.col("part").cast("string")).alias("cell"), F.ceil("rows").alias("n"))
    return stored(out) if not next_large.isEmpty() else out, next_large
