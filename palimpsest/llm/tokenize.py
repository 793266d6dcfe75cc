"""Encoding of texts by a byte-level BPE vocabulary file (rank format), and its inverse.

Boundaries of pre-tokens come from a scan over the transition functions of a finite automaton: every code point has a
symbol (its class, or one of the few letters that contractions are made of), every symbol a function from states to
states. Functions are composed within blocks of code points, all blocks at once, then across blocks by doubling, which
is where associativity is used; so the state at every code point is known without a regex or a loop over characters.
Distinct pre-tokens go through pair merging once and are kept in a bounded cache; the merging itself works on all of a
block's new pre-tokens at once. Offsets of tokens are kept on request.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from palimpsest.llm.scan import Block, blocks, class_table, distinct_slices, ragged

#: Where the vocabulary of the named tokenizer lies; a parameter of every entry point.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct pre-tokens kept with their ids per process; the cache is emptied when full.
CACHE = 120_000
#: Pre-tokens of more bytes are merged one by one with a heap.
LONG = 192
#: Contractions that form a pre-token of their own (fixed values of the split pattern).
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


#: States: before a text, in letters, numbers or other signs, after a blank or another white space, at an apostrophe that
#: may open a contraction, at a first letter of two, at the end of a contraction.
BEFORE, LETTERS, NUMBERS, SIGNS, BLANK, WHITE, QUOTE, FIRST_R, FIRST_V, FIRST_L, CLOSED = range(11)
STATES = 11
#: Symbols: classes of code points, the apostrophe, and letters of contractions.
_S_LETTER, _S_NUMBER, _S_SIGN, _S_BLANK, _S_WHITE, _S_QUOTE, _S_ONE, _S_R, _S_V, _S_E, _S_L = range(11)
SYMBOLS = 11
#: Code points of a block of the scan.
SCAN = 64


@lru_cache(maxsize=1)
def transitions() -> np.ndarray:
    """(2 x SYMBOLS, STATES) table: the state after each symbol from each state; in the second half for the first code
    point of a text, which makes the function constant."""
    t = np.zeros((SYMBOLS, STATES), np.uint8)
    t[[_S_LETTER, _S_ONE, _S_R, _S_V, _S_E, _S_L]] = LETTERS
    t[_S_NUMBER], t[_S_SIGN], t[_S_BLANK], t[_S_WHITE], t[_S_QUOTE] = NUMBERS, SIGNS, BLANK, WHITE, QUOTE
    t[_S_QUOTE, [SIGNS, QUOTE, BLANK]] = SIGNS  # the apostrophe joins signs and a blank before it
    t[_S_ONE, QUOTE] = CLOSED
    t[_S_R, QUOTE], t[_S_V, QUOTE], t[_S_L, QUOTE] = FIRST_R, FIRST_V, FIRST_L
    t[_S_E, [FIRST_R, FIRST_V]] = CLOSED
    t[_S_L, FIRST_L] = CLOSED
    return np.vstack([t, np.repeat(t[:, [BEFORE]], STATES, 1)])


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """uint8 symbol of every code point."""
    t = np.array([_S_SIGN, _S_LETTER, _S_NUMBER, _S_WHITE], np.uint8)[class_table()]
    t[0x20], t[0x27] = _S_BLANK, _S_QUOTE
    ends = {c[1:] for c in CONTRACTIONS}
    t[[ord(c) for c in ends if len(c) == 1]] = _S_ONE
    t[[ord(c) for c in "rvel"]] = [_S_R, _S_V, _S_E, _S_L]
    return t


def compose(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The functions "first f, then g", row by row."""
    return np.take_along_axis(g, f, 1)


def scan_states(symbol: np.ndarray) -> np.ndarray:
    """The state after each symbol of a sequence that begins before a text."""
    n = len(symbol)
    table = transitions()
    blocks_ = -(-n // SCAN)
    padded = np.zeros(blocks_ * SCAN, np.int64)
    padded[:n] = symbol
    steps = np.ascontiguousarray((padded * STATES).reshape(blocks_, SCAN).T)
    flat = table.reshape(-1)
    f = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (blocks_, STATES))
    for step in steps:  # one function for each block
        f = flat.take(step[:, None] + f)
    width = 1
    while width < blocks_:  # prefixes of functions, by doubling
        f = np.concatenate([f[:width], compose(f[:-width], f[width:])])
        width *= 2
    state = np.append(np.uint8(BEFORE), f[:-1, BEFORE])
    out = np.empty((SCAN, blocks_), np.uint8)
    for i, step in enumerate(steps):
        state = out[i] = flat.take(step + state)
    return out.T.reshape(-1)[:n]


def boundaries(block: Block) -> np.ndarray:
    """Code-point positions at which a pre-token starts, over all texts of the block."""
    n = len(block.cp)
    if not n:
        return np.zeros(0, np.int64)
    first = block.text_starts()
    symbol = symbol_table()[block.cp]
    state = scan_states(symbol + SYMBOLS * first.astype(np.uint8))
    before = np.append(np.uint8(BEFORE), state[:-1])
    group = np.array([0, 1, 2, 3, 4, 4, 3, 1, 1, 1, 5], np.uint8)  # states by the token that they are in
    here, there = group[state], group[before]
    here = np.where(here == 5, 1, here)
    start = first | ((here != there) & (before != BLANK))
    # the last white space before other text begins a token, which a blank shares with that text
    edge = np.flatnonzero((here[:-1] == 4) & (here[1:] != 4) & ~first[1:])
    start[edge] = True
    # a contraction is one token: no start at its first letter
    closed = np.flatnonzero(state == CLOSED)
    start[closed - (before[closed] != QUOTE)] = False
    return np.flatnonzero(start)


class Encoder:
    """Byte-level BPE from a rank file of lines `base64 rank`."""

    def __init__(self, lines: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.token = {i: b for b, i in self.rank.items()}
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.size = max(self.rank.values()) + 1
        keys, ids = [], []
        for piece, i in self.rank.items():
            for cut in range(1, len(piece)):
                a, b = self.rank.get(piece[:cut]), self.rank.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    ids.append(i)
        self.length = np.zeros(self.size, np.int64)
        for piece, i in self.rank.items():
            self.length[i] = len(piece)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self._build_table(np.array(keys, np.int64)[order], np.array(ids, np.int32)[order])
        self.cache: dict[bytes, np.ndarray] = {}

    def _build_table(self, keys: np.ndarray, ids: np.ndarray) -> None:
        """An open-addressing table pair -> merged id, probed by whole arrays."""
        self.bits = int(np.ceil(np.log2(len(keys) * 4)))
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_id = np.full(1 << self.bits, np.iinfo(np.int32).max, np.int32)
        at = self._slot(keys)
        left = np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            _, pick = np.unique(at[left], return_index=True)
            pick = pick[self.slot_key[at[left[pick]]] < 0]
            won = left[pick]
            self.slot_key[at[won]], self.slot_id[at[won]] = keys[won], ids[won]
            left = np.delete(left, pick)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of the merge of each pair, the largest int32 where there is none."""
        keys = a.astype(np.int64) * self.size + b
        at = self._slot(keys)
        out = np.full(len(keys), np.iinfo(np.int32).max, np.int32)
        left = np.arange(len(keys))
        while len(left):
            here = self.slot_key[at[left]]
            hit = here == keys[left]
            out[left[hit]] = self.slot_id[at[left[hit]]]
            left = left[~hit & (here >= 0)]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        return out

    def merge_many(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """The ids of each byte slice by pair merging: every round merges, in each slice, the leftmost runs of its
        lowest-ranked pair; slices without a pair left drop out."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(start)
        length = (end - start).astype(np.int64)
        for k in np.flatnonzero(length > LONG):
            out[k] = self.merge_one(data[start[k] : end[k]].tobytes())
        live = np.flatnonzero(length <= LONG)
        size = length[live]
        sym = self.byte_id[data[ragged(start[live].astype(np.int64), size)]]
        none = np.iinfo(np.int32).max
        while len(live):
            owner = np.repeat(np.arange(len(live)), size)
            head = np.cumsum(size) - size
            pair = np.full(len(sym), none, np.int32)
            if len(sym) > 1:
                inner = np.flatnonzero(owner[:-1] == owner[1:])
                pair[inner] = self.merged(sym[inner], sym[inner + 1])
            low = np.minimum.reduceat(pair, head)
            done = low == none
            if done.any():
                for k in np.flatnonzero(done):
                    out[live[k]] = sym[head[k] : head[k] + size[k]]
                keep = ~done[owner]
                sym, pair, live, size, low = sym[keep], pair[keep], live[~done], size[~done], low[~done]
                if not len(live):
                    break
                owner = np.repeat(np.arange(len(live)), size)
            hit = np.flatnonzero(pair == low[owner])
            # of hits in a row (a a a) every second one is merged
            fresh = np.append(True, np.diff(hit) != 1)
            rank_in_run = np.arange(len(hit)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[rank_in_run % 2 == 0]
            sym[hit] = pair[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            size = size - np.bincount(owner[hit], minlength=len(live))
            sym = sym[keep]
        return out

    def merge_one(self, piece: bytes) -> np.ndarray:
        """The same for one long slice, with a heap of pairs: O(n log n)."""
        n = len(piece)
        sym = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        text = [piece[i : i + 1] for i in range(n)]
        get = self.rank.get
        heap = [(r, i, 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, width = heapq.heappop(heap)
            j = after[i] if text[i] is not None else n
            if j >= n or len(text[i]) + len(text[j]) != width or get(text[i] + text[j]) != r:
                continue
            text[i], sym[i], text[j] = text[i] + text[j], r, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := get(text[i] + text[after[i]])) is not None:
                    heapq.heappush(heap, (x, i, len(text[i]) + len(text[after[i]])))
            if (p := before[i]) >= 0 and (x := get(text[p] + text[i])) is not None:
                heapq.heappush(heap, (x, p, len(text[p]) + len(text[i])))
        return np.array([s for s, t in zip(sym, text, strict=True) if t is not None], np.int32)

    def _pieces(self, block: Block, start: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """(ids of each distinct pre-token, its number for each pre-token)."""
        a, b = block.byte[start], np.append(block.byte[start[1:]], block.byte[-1])
        first, inverse = distinct_slices(block.data, a, b)
        raw = block.data.tobytes()
        keys = [raw[i:j] for i, j in zip(a[first].tolist(), b[first].tolist(), strict=True)]
        ids = [self.cache.get(k) for k in keys]
        new = [i for i, x in enumerate(ids) if x is None]
        if new:
            at = first[np.array(new)]
            if len(self.cache) + len(new) > CACHE:
                self.cache.clear()
            for i, x in zip(new, self.merge_many(block.data, a[at], b[at]), strict=True):
                ids[i] = x
                if len(self.cache) < CACHE and len(keys[i]) <= LONG:
                    self.cache[keys[i]] = x.copy()
        return ids, inverse

    def encode(self, column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of rows: (ids of all their texts one after another, number of ids of each text)."""
        for _, n, data, offsets in blocks(column):
            if not len(data):
                yield np.zeros(0, np.int32), np.zeros(n, np.int64)
                continue
            block = Block(data, offsets)
            start = boundaries(block)
            ids, inverse = self._pieces(block, start)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat, head = np.concatenate(ids), np.cumsum(size) - size
            per = size[inverse]
            total = np.append(0, np.cumsum(per))
            per_text = np.diff(total[np.searchsorted(start, block.doc)])
            yield flat[ragged(head[inverse], per)], per_text

    def counts(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """Number of ids of each text."""
        out = [np.zeros(0, np.int64)]
        for _, n, data, offsets in blocks(column):
            if not len(data):
                out.append(np.zeros(n, np.int64))
                continue
            block = Block(data, offsets)
            start = boundaries(block)
            ids, inverse = self._pieces(block, start)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            total = np.append(0, np.cumsum(size[inverse]))
            out.append(np.diff(total[np.searchsorted(start, block.doc)]))
        return np.concatenate(out)

    def offsets(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The byte of its text at which each token starts; n: number of ids of each text."""
        before = np.append(0, np.cumsum(self.length[ids]))
        head = np.cumsum(n) - n
        return (before[:-1] - np.repeat(before[head], n)).astype(np.int32)

    def decode(self, ids) -> str:
        """The text of a list of ids."""
        return b"".join(self.token[int(i)] for i in ids).decode("utf-8")


#: Bytes of a vocabulary file at most; it is read by the driver and sent to every task.
MOST_BYTES = 64 << 20
_ENCODERS: dict[str, Encoder] = {}


def vocabulary_file(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} is no vocabulary: it has more than {MOST_BYTES} bytes")
    return data


def encoder(path: str = VOCABULARY, lines: bytes | None = None) -> Encoder:
    """The encoder of a vocabulary, one per process; of `lines` where they are given, else of the file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(vocabulary_file(path) if lines is None else lines)
    return _ENCODERS[path]


def encode_texts(df, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY, out: str = "ids", offsets: str | None = None):
    """`keep` and the token ids of the whole of column `text`, without special tokens; strings that look like special
    tokens are plain text. An empty and a null text both give an empty list. With `offsets`, a column of that name has the
    byte of the text's UTF-8 form at which each token starts. Other columns, whatever their names, are dropped first. No
    shuffle: one pass of Arrow batches."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    narrow = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("t"))
    lists = ["v", "o"] if offsets else ["v"]
    schema = T.StructType([*narrow.schema.fields[:-1], *(T.StructField(c, T.ArrayType(T.IntegerType(), False), False) for c in lists)])
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_file(vocabulary))  # at most MOST_BYTES

    def run(batches):
        e = encoder(vocabulary, shared.value)
        for b in batches:
            row = 0
            for ids, n in e.encode(b.column("t")):
                ends = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
                values = [ids, e.offsets(ids, n)] if offsets else [ids]
                part = b.slice(row, len(n))
                row += len(n)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in values)], names=[*part.schema.names[:-1], *lists])

    return narrow.mapInArrow(run, schema).toDF(*keep, out, *([offsets] if offsets else []))


def count_tokens(df, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY, out: str = "n_tokens"):
    """`keep` and the number of token ids of the whole of column `text` (0 for an empty and a null text)."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    narrow = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("t"))
    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField("v", T.LongType(), False)])
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_file(vocabulary))

    def run(batches):
        e = encoder(vocabulary, shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(e.counts(b.column("t")), pa.int64())], names=[*b.schema.names[:-1], "v"])

    return narrow.mapInArrow(run, schema).toDF(*keep, out)
