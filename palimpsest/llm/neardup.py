"""Near-duplicate records: banded MinHash candidates, sequential Bayesian verification, exact check.

Texts become sets (runs of consecutive words, or words). Equal sets collapse to one key first, so copies cost nothing
later. Band buckets of MinHash values give candidate pairs of keys; their signatures are compared batch by batch, and
a pair is dropped as soon as the posterior probability that its similarity reaches the threshold is below the chosen
miss probability; survivors are verified exactly on their texts. Only keys and signatures are shuffled on the way.

Buckets of very many different sets are not joined with themselves: longer bands part their members first, and what is
still hot then is dealt into blocks that are verified where they meet, so that only survivors are written. These bands
may miss a pair at the threshold, all of whose buckets are hot, once in 170 besides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.scan import LETTER, NUMBER, Block, blocks, class_table, slice_hashes
from palimpsest.runtime import durable, stored

#: Chance that a pair at the threshold shares no band, at most; and that a batch drops a pair that reaches it.
BAND_MISS, BATCH_MISS = 0.005, 0.001
#: Values of a signature and of one batch of the sequential comparison; a value is the low byte of a MinHash.
SIGNATURE, BATCH = 64, 16
#: Bits of a bucket's number. Two buckets that share a number only add candidates, which the comparison drops.
BUCKET_BITS = 48
#: Different sets in a bucket from which on it is parted by longer bands, of so many signature bytes more, and then
#: verified in blocks; keys of a block; keys of which one is looked at to tell hot buckets.
HOT_BUCKET, SUB_ROWS, BLOCK_KEYS, HEAT = 2_000, 3, 1_000, 16
#: Records of one set that meet in one place at most, about.
BLOCK_RECORDS = 1_000
#: Rows of ids, keys or buckets that are sent to all tasks at most (some 100 bytes each); more take a shuffled join.
BROADCAST_IDS = 500_000
#: Keys that a task remembers so as to give each key's bands and signature once (a saving only).
SEEN = 500_000
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Kind:
    """How records of one table are compared: runs of `run` words; texts with fewer words (or, with `distinct`,
    different words) than `least` are left out; pairs from `threshold` on; `rows` MinHash values form a band."""

    name: str
    run: int
    least: int
    distinct: bool
    threshold: float
    rows: int

    @property
    def bands(self) -> int:
        """Bands that are enough for the chance BAND_MISS at the threshold."""
        return int(np.ceil(np.log(BAND_MISS) / np.log(1 - self.threshold**self.rows)))


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return _WORD.findall((text or "").lower())


def elements(text: str | None, kind: Kind) -> frozenset:
    """The set that stands for a text, for one text (`hashed_sets` has it for many); empty if the text is left out."""
    w = words(text)
    if (len(set(w)) if kind.distinct else len(w)) < kind.least:
        return frozenset()
    return frozenset(zip(*(w[i:] for i in range(kind.run)), strict=False))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed_sets(texts: pa.Array, kind: Kind):
    """For runs of rows: (sorted distinct element hashes of all texts, first element of each text, number of each)."""
    lowered = pa.array([None if t is None else t.lower() for t in texts.to_pylist()], pa.large_string())
    for _, n, data, offsets in blocks(lowered):
        if not len(data):
            yield np.zeros(0, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            continue
        b = Block(data, offsets)
        cls = class_table()[b.cp]
        word = (cls == LETTER) | (cls == NUMBER)
        first = b.text_starts()
        start = np.flatnonzero(word & (first | ~np.append(False, word[:-1])))
        stop = np.flatnonzero(word & np.append(first[1:] | ~word[1:], True)) + 1
        h = _mix(slice_hashes(b.data, b.byte[start], b.byte[stop]))
        doc = np.searchsorted(b.doc, start, "right") - 1
        n_words = np.bincount(doc, minlength=n)
        if kind.run > 1:
            last = max(0, len(h) - kind.run + 1)
            whole = doc[:last] == doc[kind.run - 1 :][:last]
            e = np.zeros(last, np.uint64)
            for i in range(kind.run):
                e = _mix(e * np.uint64(0x9E3779B97F4A7C15) + h[i : i + last])
            e, owner = e[whole], doc[:last][whole]
        else:
            e, owner = h, doc
        order = np.lexsort((e, owner))
        e, owner = e[order], owner[order]
        fresh = np.append(True, (e[1:] != e[:-1]) | (owner[1:] != owner[:-1]))[: len(e)]
        e, owner = e[fresh], owner[fresh]
        size = np.bincount(owner, minlength=n)
        few = (size if kind.distinct else n_words) < kind.least
        e = e[~few[owner]] if len(owner) else e
        size = np.where(few, 0, size)
        yield e, np.cumsum(size) - size, size


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng(20240101)
    return g.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), g.integers(0, 2**63, n, dtype=np.uint64)


def minhashes(e: np.ndarray, head: np.ndarray, n: int) -> np.ndarray:
    """The n smallest-hash values (uint32) of each set; no set may be empty."""
    a, b = _functions(n)
    out = np.empty((len(head), n), np.uint32)
    for k in range(n):
        out[:, k] = np.minimum.reduceat((e * a[k] + b[k]) >> np.uint64(32), head).astype(np.uint32)
    return out


def signatures(df: DataFrame, kind: Kind, number: int, id_col: str, text: str, group_col: str | None = None) -> DataFrame:
    """(tbl, id, grp, key, bands, sig) of every record whose text has a set. `key` stands for the set; `bands` and
    `sig` are null where the same task has given them for this key before. A sig begins with the kind's number."""
    src = df.select(F.col(id_col).cast("string").alias("id"), (F.col(group_col) if group_col else F.lit(None)).cast("string").alias("grp"), F.col(text).alias("text"))
    n_hash = max(kind.bands * kind.rows, SIGNATURE)

    def run(batches):
        seen: set[int] = set()
        salt = np.frombuffer(kind.name.encode().ljust(8)[:8], np.uint64)[0]
        for batch in batches:
            row = 0
            for e, head, size in hashed_sets(batch.column("text"), kind):
                part = batch.slice(row, len(size))
                row += len(size)
                have = np.flatnonzero(size)
                if not len(have):
                    continue
                key = _mix(np.add.reduceat(_mix(e + np.uint64(1)), head[have]) + size[have].astype(np.uint64) + salt).view(np.int64)
                new = np.array([k not in seen and (len(seen) >= SEEN or not seen.add(k)) for k in key.tolist()], bool)
                bands, sig = [None] * len(have), [None] * len(have)
                if new.any():
                    keep = np.zeros(len(size), bool)
                    keep[have[new]] = True
                    mask = np.repeat(keep, size)
                    s = size[have[new]]
                    m = minhashes(e[mask], np.cumsum(s) - s, n_hash)
                    grouped = m[:, : kind.bands * kind.rows].reshape(len(m), kind.bands, kind.rows).astype(np.uint64)
                    bucket = np.arange(kind.bands, dtype=np.uint64) + salt
                    bucket = np.broadcast_to(_mix(bucket), (len(m), kind.bands)).copy()
                    for r in range(kind.rows):
                        bucket = _mix(bucket * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, r])
                    low = (m[:, :SIGNATURE] & 0xFF).astype(np.uint8)
                    bucket >>= np.uint64(64 - BUCKET_BITS)
                    for i, x, y in zip(np.flatnonzero(new), bucket.view(np.int64), low, strict=True):
                        bands[i], sig[i] = x, bytes([number]) + y.tobytes()
                part = part.take(pa.array(have))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("grp"), pa.array(key), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=["id", "grp", "key", "bands", "sig"])

    out = src.mapInArrow(run, "id string, grp string, key long, bands array<long>, sig binary")
    return out.select(F.lit(kind.name).alias("tbl"), "*")


def least_matches(n: int, threshold: float, miss: float = BATCH_MISS) -> int:
    """Matches among n signature bytes below which a similarity of `threshold` has a posterior probability under
    `miss`, from a uniform prior. Bytes of different values also match by chance, once in 256."""
    p = threshold + (1 - threshold) / 256
    below = 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)  # P(Bin(n + 1, p) <= m) = P(similarity >= threshold | m of n)
        if below >= miss:
            return m
    return n


def bayes_keep(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of two signature arrays survive all batches."""
    alive = np.arange(len(a))
    same = np.zeros(len(a), np.int64)
    for end in range(BATCH, SIGNATURE + 1, BATCH):
        same[alive] += (a[alive, end - BATCH : end] == b[alive, end - BATCH : end]).sum(1)
        alive = alive[same[alive] >= least_matches(end, threshold)]
    return alive


def _as_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the kinds, signatures)."""
    x = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SIGNATURE + 1)
    return x[:, 0], x[:, 1:]


def _parted(member: DataFrame, hot_bucket: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of member in buckets that may be joined with themselves, rows (key, bucket, n) of those that hold hot_bucket
    keys or more, None without any).

    The sizes of buckets are estimated on one key in HEAT; they only decide how a bucket is worked through, and either
    way gives all its pairs. There are at most keys x bands / hot_bucket hot ones.
    """
    rate = max(1, min(HEAT, hot_bucket // 125))
    seen = member.where(F.pmod(F.xxhash64("key"), F.lit(rate)) == 0).groupBy("bucket").agg((F.count(F.lit(1)) * rate).alias("n"))
    heavy = durable(seen.where(F.col("n") >= hot_bucket))
    n = heavy.count()
    if not n:
        return member, None
    heavy = F.broadcast(heavy) if n <= BROADCAST_IDS else heavy
    return member.join(heavy, "bucket", "left_anti"), member.join(heavy, "bucket")


def runs_to_pairs(bucket: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of different keys of each bucket, smaller key first, of rows in order of bucket and key."""
    fresh = np.append(True, (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1]))[: len(key)]
    bucket, key = bucket[fresh], key[fresh]
    at, apart, a, b = np.arange(len(key)), 0, [], []
    while len(at):
        apart += 1
        at = at[at + apart < len(key)]
        at = at[bucket[at] == bucket[at + apart]]
        a.append(key[at])
        b.append(key[at + apart])
    return (np.concatenate(a), np.concatenate(b)) if a else (key, key)


def _meeting(cool: DataFrame) -> DataFrame:
    """Pairs of keys (key_a, key_b), key_a < key_b, that share a bucket; a pair may come out once for each. One exchange
    and one sort; a task holds some ten thousand rows and the rows of one bucket, which is not hot."""

    def pair(batches):
        bucket, key = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            bucket, key = (np.concatenate([old, batch.column(c).to_numpy()]) for old, c in ((bucket, "bucket"), (key, "key")))
            if not len(bucket):
                continue
            open_ = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in runs_to_pairs(bucket[:open_], key[:open_])], names=["key_a", "key_b"])
            bucket, key = bucket[open_:], key[open_:]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in runs_to_pairs(bucket, key)], names=["key_a", "key_b"])

    return cool.select("bucket", "key").repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(pair, "key_a long, key_b long")


def candidate_pairs(sigs: DataFrame, kinds: list[Kind], hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Distinct pairs (tbl, key_a, key_b), key_a < key_b, that share a bucket and survive the Bayesian comparison.

    The members of a hot bucket are parted again by bands of SUB_ROWS signature values; what is still hot then is dealt
    into blocks of BLOCK_KEYS, and pairs of blocks are compared where they meet.
    """
    known = sigs.where("bands is not null")
    member = known.select("key", F.explode("bands").alias("bucket")).where("bucket is not null")
    sig = known.groupBy("key").agg(F.min("sig").alias("sig"))
    cool, hot = _parted(member, hot_bucket)
    pairs = _meeting(cool)
    hottest = None
    if hot is not None:
        bands = F.explode(F.sequence(F.lit(0), F.lit(SIGNATURE // SUB_ROWS - 1))).alias("i")
        values = F.expr(f"substring(sig, 2 + {SUB_ROWS} * i, {SUB_ROWS})")
        again = hot.join(sig, "key").select("key", "bucket", "sig", bands).select("key", F.xxhash64("bucket", "i", values).alias("bucket"))
        cool, hottest = _parted(again, hot_bucket)
        pairs = pairs.unionByName(_meeting(cool))

    def compare(batches):
        for b in batches:
            (number, x), (_, y) = _as_arrays(b.column("sig_a")), _as_arrays(b.column("sig_b"))
            for i, kind in enumerate(kinds):
                mine = np.flatnonzero(number == i)
                keep = pa.array(mine[bayes_keep(x[mine], y[mine], kind.threshold)])
                yield pa.RecordBatch.from_arrays([pa.array([kind.name] * len(keep), pa.string()), b.column("key_a").take(keep), b.column("key_b").take(keep)], names=["tbl", "key_a", "key_b"])

    signed = pairs.distinct().join(sig.toDF("key_a", "sig_a"), "key_a").join(sig.toDF("key_b", "sig_b"), "key_b")
    survivors = signed.select("key_a", "key_b", "sig_a", "sig_b").mapInArrow(compare, "tbl string, key_a long, key_b long")
    if hottest is None:
        return survivors

    def compare_blocks(table: pa.Table) -> pa.Table:
        key, part, sides = table.column("key").to_numpy(), table.column("part").to_numpy(), (table.column("i")[0].as_py(), table.column("j")[0].as_py())
        number, s = _as_arrays(table.column("sig").combine_chunks())
        kind = kinds[number[0]]
        at = [np.flatnonzero(part == x) for x in sides]
        out_a, out_b = [], []
        for r in at[0]:
            others = at[1] if sides[0] != sides[1] else at[1][at[1] > r]
            hit = others[bayes_keep(np.broadcast_to(s[r], (len(others), SIGNATURE)), s[others], kind.threshold)]
            hit = hit[key[hit] != key[r]]
            out_a.append(np.minimum(key[r], key[hit]))
            out_b.append(np.maximum(key[r], key[hit]))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
        return pa.table({"tbl": pa.array([kind.name] * len(a), pa.string()), "key_a": a, "key_b": b})

    parts = F.ceil(F.col("n") / BLOCK_KEYS).cast("int")
    blocks = (
        hottest.dropDuplicates(["bucket", "key"])
        .join(sig, "key")
        .withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("i", F.least("part", "other"))
        .withColumn("j", F.greatest("part", "other"))
        .select("bucket", "i", "j", "part", "key", "sig")
        .groupBy("bucket", "i", "j")
        .applyInArrow(compare_blocks, "tbl string, key_a long, key_b long")
    )
    return survivors.unionByName(blocks).distinct()


def key_sets(texts: DataFrame, kind: Kind) -> DataFrame:
    """(key, set) of rows (key, text): the hashes of the text's elements, 8 bytes each, in order."""

    def run(batches):
        for b in batches:
            row = 0
            for e, _, size in hashed_sets(b.column("text"), kind):
                offsets = np.append(0, np.cumsum(size) * 8).astype(np.int32)
                sets = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(e))])
                yield pa.RecordBatch.from_arrays([b.column("key").slice(row, len(size)), sets], names=["key", "set"])
                row += len(size)

    return texts.select("key", "text").mapInArrow(run, "key long, set binary")


def in_common(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(elements in common, elements of a, elements of b) for each row of two arrays of sets, all rows at once."""

    def flat(x: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(v) for v in x.to_pylist()], np.int64) // 8
        row = np.repeat(np.arange(len(size), dtype=np.uint64), size)
        values = np.frombuffer(b"".join(x.to_pylist()), np.uint64)
        return size, row, _mix(values + row * np.uint64(0x9E3779B97F4A7C15))  # a row's elements are told from another's

    (n_a, row_a, x), (n_b, _, y) = flat(a), flat(b)
    _, i, _ = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return np.bincount(row_a[i].astype(np.int64), minlength=len(n_a)), n_a, n_b


def verified_pairs(pairs: DataFrame, sets: DataFrame, kinds: list[Kind]) -> DataFrame:
    """The pairs (tbl, key_a, key_b, similarity) whose exact similarity reaches the threshold. `sets`: (key, set) with one
    row for each key. Elements are compared by hashes of 64 bits, whose chance to collide within a pair is negligible."""
    least = {k.name: k.threshold for k in kinds}

    def exact(batches):
        for b in batches:
            both, n_a, n_b = in_common(b.column("set_a"), b.column("set_b"))
            sims = both / np.maximum(n_a + n_b - both, 1)
            reach = pa.array(sims >= np.array([least[t] for t in b.column("tbl").to_pylist()]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("tbl", "key_a", "key_b")), pa.array(sims, pa.float64())], names=["tbl", "key_a", "key_b", "similarity"]).filter(reach)

    joined = pairs.join(sets.toDF("key_a", "set_a"), "key_a").join(sets.toDF("key_b", "set_b"), "key_b").select("tbl", "key_a", "key_b", "set_a", "set_b")
    return joined.mapInArrow(exact, "tbl string, key_a long, key_b long, similarity double")


@dataclass
class Similar:
    """Members (tbl, id, grp, key) of records with a set, repeated where records are, and verified pairs of different keys."""

    members: DataFrame
    pairs: DataFrame


def similar_sets(sources: list[tuple[DataFrame, Kind, str, str, str | None]], hot_bucket: int = HOT_BUCKET) -> Similar:
    """All pairs of different sets that reach their kind's threshold, and which records have which set.

    sources: (table, kind, id column, text column, group column). Null and short texts have no set and appear nowhere.
    Records delivered twice count once. Empty tables give empty results.
    """
    kinds = [k for _, k, *_ in sources]
    sigs = None
    for number, (df, kind, i, t, g) in enumerate(sources):
        s = signatures(df, kind, number, i, t, g)
        sigs = s if sigs is None else sigs.unionByName(s)
    sigs = stored(sigs)
    members = sigs.select("tbl", "id", "grp", "key")
    pairs = durable(candidate_pairs(sigs, kinds, hot_bucket))
    wanted = pairs.select("tbl", F.explode(F.array("key_a", "key_b")).alias("key")).distinct()
    few = 2 * pairs.count() <= BROADCAST_IDS
    heads = sigs.where("bands is not null").join(F.broadcast(wanted) if few else wanted, ["tbl", "key"], "left_semi").groupBy("tbl", "key").agg(F.min("id").alias("id"))
    sets = None
    for df, kind, i, t, _ in sources:
        mine = heads.where(F.col("tbl") == kind.name).select("tbl", "key", "id")
        # texts of the few records to verify are picked out where they lie; of many, by a shuffled join
        x = df.select(F.col(i).cast("string").alias("id"), F.col(t).alias("text")).join(F.broadcast(mine) if few else mine, "id")
        x = key_sets(x, kind)
        sets = x if sets is None else sets.unionByName(x)
    sets = sets.groupBy("key").agg(F.first("set").alias("set"))  # records delivered twice
    return Similar(members, verified_pairs(pairs, sets, kinds))


def record_pairs(s: Similar, block: int = BLOCK_RECORDS) -> DataFrame:
    """Every pair of records (tbl, id_a, id_b), id_a < id_b, that are alike: those of alike sets and those of one set.
    Records of one group (where groups are given) are no pair.

    As many rows as the definition asks for: a set of n copies gives n squared. `Similar.pairs` and `record_groups` say
    the same with one row for each pair of sets and for each record. Here the copies of a set are dealt into blocks by a
    hash of the id, and blocks meet in pairs, so that no task holds all copies of a set.
    """
    m = s.members.where("id is not null and key is not null")
    counts = m.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    many = durable(counts.where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))  # at most records / block
    many = F.broadcast(many) if many.count() <= BROADCAST_IDS else many
    blocks = lambda df, key, name: df.join(many.toDF(key, f"{name}s"), key, "left").withColumn(f"{name}s", F.coalesce(f"{name}s", F.lit(1)))
    dealt = blocks(m, "key", "block").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    one, two = (dealt.select(F.col("tbl").alias(f"tbl_{p}"), F.col("id").alias(f"id_{p}"), F.col("grp").alias(f"grp_{p}"), F.col("key").alias(f"key_{p}"), F.col("block").alias(f"block_{p}")) for p in "ab")
    shared = counts.where("n > 1").select(F.col("key").alias("key_a"), F.col("key").alias("key_b"))  # a set is alike to itself
    met = blocks(blocks(s.pairs.select("key_a", "key_b").unionByName(shared), "key_a", "block_a"), "key_b", "block_b")
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(f"{name}s") - 1)).alias(name)
    met = met.select("key_a", "key_b", "block_bs", each("block_a")).select("key_a", "key_b", "block_a", each("block_b")).where("key_a <> key_b or block_a <= block_b")
    both = met.join(one, ["key_a", "block_a"]).join(two, ["key_b", "block_b"])
    both = both.where("tbl_a = tbl_b and (key_a <> key_b or block_a <> block_b or id_a < id_b) and (grp_a is null or grp_b is null or grp_a <> grp_b)")
    return both.select(F.col("tbl_a").alias("tbl"), F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).where("id_a <> id_b").distinct()


def record_groups(s: Similar) -> DataFrame:
    """One row for each record with a set: tbl, id, class_id (the smallest key of its group) and n_links, the number of
    other sets that its set is alike to. Groups are the connected components of alike sets."""
    pairs = durable(s.pairs.select("tbl", "key_a", "key_b"))
    ends = pairs.select("tbl", F.explode(F.array("key_a", "key_b")).alias("key")).groupBy("tbl", "key").agg(F.count(F.lit(1)).alias("n_links"))
    label = components(pairs.select(F.col("key_a").alias("u"), F.col("key_b").alias("v")))
    joined = s.members.select("tbl", "id", "key").distinct().join(label, F.col("key") == F.col("u"), "left").join(ends, ["tbl", "key"], "left")
    return joined.select("tbl", "id", F.coalesce("root", "key").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def components(edges: DataFrame) -> DataFrame:
    """(u, root): the smallest node of the connected component of each node, by alternating large and small stars.

    Every round is written to the checkpoint folder; rounds grow with the logarithm of the longest path.
    """
    e = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        e = durable(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select("u", F.col("v").alias("root"))
        before = now
