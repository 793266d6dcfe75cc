"""Splitting, encoding, packing and choosing, against brute force and on bad rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import pack, split, subset, tokenize

ALPHABET = "a'strevmld  \n\t　 é日1½_-<|>😀́"


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=tokenize.encoder().rank, special_tokens={})


def encode(texts):
    out = []
    for ids, n in tokenize.encoder().encode(pa.array(texts, pa.string())):
        ends = np.append(0, np.cumsum(n))
        out += [ids[ends[i] : ends[i + 1]].tolist() for i in range(len(n))]
    return out


def test_encoding_equals_library_and_decodes(library):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["", "<|endoftext|>", "a" * 3000, "ab" * 150, "日本" * 300, "'s's 's\n's", " ", "\n\n x", "x" * (tokenize.LONG + 1)]
    got = encode(texts)
    assert got == [library.encode_ordinary(t) for t in texts]
    assert [tokenize.encoder().decode(g) for g in got] == texts


def test_scan_is_the_composition_of_transitions():
    rnd = np.random.default_rng(4)
    table = tokenize.transitions()
    for n in (1, 63, 64, 65, 5000):
        symbol = rnd.integers(0, tokenize.SYMBOLS, n) + tokenize.SYMBOLS * (rnd.random(n) < 0.01)
        state, want = tokenize.BEFORE, []
        for x in symbol:
            state = table[x, state]
            want.append(state)
        assert tokenize.scan_states(symbol).tolist() == want
    f, g, h = (table[rnd.integers(0, len(table), 200)] for _ in range(3))
    assert (tokenize.compose(tokenize.compose(f, g), h) == tokenize.compose(f, tokenize.compose(g, h))).all()


def test_offsets(spark):
    texts = ["Ärger's day 日本 12", "", "'s x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    for r in tokenize.encode_texts(df, offsets="at").collect():
        raw = ((texts + [None])[r.doc_id] or "").encode()
        parts = [raw[a:b] for a, b in zip(r["at"], [*r["at"][1:], len(raw)], strict=True)] if r.ids else []
        assert parts == [tokenize.encoder().token[i] for i in r.ids] and b"".join(parts) == raw


def test_encoding_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "hello world", "z"), (3, "hello world", "z")], "doc_id long, text string, ids string")
    rows = sorted((r.doc_id, r.ids) for r in tokenize.encode_texts(df).collect())
    assert rows == [(1, []), (2, []), (3, encode(["hello world"])[0]), (3, encode(["hello world"])[0])]
    assert tokenize.encode_texts(df.limit(0)).collect() == []
    assert sorted(tuple(r) for r in tokenize.count_tokens(df).collect()) == [(1, 0), (2, 0), (3, 2), (3, 2)]


def check_pieces(text, limit, overlap):
    pieces = split.split(text, limit, overlap)
    assert "".join(text[s:e] for _, s, e, _ in pieces) == text
    for k, (start, own, end, _) in enumerate(pieces):
        assert end - start <= limit and own - start <= overlap and end > own
        if k:
            assert start >= pieces[k - 1][1]
    run = longest = 0
    for c in text:
        run = 0 if c.isspace() or c == "。" else run + 1
        longest = max(longest, run)
    assert any(p[3] == "forced" for p in pieces) == (longest > limit)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n#-。　", max_size=400), st.integers(8, 60))
def test_split_is_whole_and_within_limit(text, limit):
    check_pieces(text, limit, limit // 4)


def test_pieces_keep_sections_apart():
    text = "# A\n" + "one two. " * 50 + "\n# B\n" + "three four. " * 400 + "\n# C\nshort.\n# D\nshort too.\n## D1\n" + "five. " * 700
    heads = [i for i in range(len(text)) if text.startswith("#", i) and (i == 0 or text[i - 1] == "\n")]
    pieces = split.split(text, 1000, 100)
    for _, s, e, _ in pieces:
        if any(s < h < e for h in heads):
            assert (s == 0 or s in heads) and (e == len(text) or e in heads)
    assert pieces[0][2] == text.index("# B") and any(s <= text.index("# C") and e >= text.index("# D") for _, s, e, _ in pieces)


def test_split_edges():
    for n in (27, 28, 29, 25, 24):
        check_pieces("x" * n + "\n" + "y " * 40, 28, 3)
        check_pieces("z " * 20 + "x" * n, 28, 3)
    assert split.split("") == []
    assert split.split("short") == [(0, 0, 5, "end")]
    text = "# A\n" + "one two. " * 8 + "\n# B\n" + "three. " * 8
    assert [text[s:e][:3] for _, s, e, _ in split.split(text, 90, 10)] == ["# A", "# B"]


def test_split_texts_bad_rows(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", "", 2), ("c", "word " * 1000, 3), ("c", "word " * 1000, 3)], "id string, text string, ordinal int")
    rows = split.split_texts(df).collect()
    assert {r.id for r in rows} == {"c"} and len(rows) == 2 * len({r.ordinal for r in rows})
    assert split.split_texts(df.limit(0)).collect() == []


def brute_groups(v, s, ids, k, alike):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    order = sorted(range(len(s)), key=lambda i: (-s[i], ids[i]))
    heads = []
    for i in order:
        if all(u[i] @ u[j] < alike for j in heads):
            heads.append(i)
    return {ids[i] for i in heads[:k]}


@pytest.mark.parametrize("part_rows", [1000, 7])
def test_varied_subset(spark, part_rows):
    rnd = np.random.default_rng(1)
    rows, want = [], set()
    for pool in range(3):
        centre = np.linalg.qr(rnd.normal(size=(8, 8)))[0]
        g = rnd.integers(0, 8, 60) * (rnd.random(60) < 0.6)
        v, s, ids = centre[g] + rnd.normal(scale=0.01, size=(60, 8)), rnd.random(60), [f"i{j:02}" for j in range(60)]
        rows += [(pool, i, x.tolist(), float(y)) for i, x, y in zip(ids, v, s, strict=True)]
        want |= {(pool, i) for i in brute_groups(v, s, ids, 5, 0.9)}
    rows += rows[:10] + [(0, "n", None, 9.0), (0, "m", [1.0] * 8, None), (0, "o", [1.0], 9.0), (9, "u", [1.0] * 8, 1.0), (0, "p", [float("nan")] * 8, 9.0), (4, "z", [0.0] * 8, 1.0)]
    items = spark.createDataFrame(rows, "pool_id long, id string, vector array<double>, score double")
    pools = spark.createDataFrame([(p, 5) for p in range(4)] + [(4, None), (5, 0)], "pool_id long, k int")
    got = subset.choose_varied(items, pools, dims=8, alike=0.9, fill=False, part_rows=part_rows)
    assert {(r.pool_id, r.id) for r in got.collect()} == want
    filled = subset.choose_varied(items, pools, dims=8, part_rows=part_rows).groupBy("pool_id").count().collect()
    assert {r.pool_id: r["count"] for r in filled} == {0: 5, 1: 5, 2: 5}
    assert subset.choose_varied(items.limit(0), pools, dims=8).collect() == []


def test_greedy_maximises_determinant_stepwise():
    rnd = np.random.default_rng(5)
    v, s = rnd.normal(size=(12, 6)), rnd.random(12)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    kernel = np.exp(s - s.max())[:, None] * (subset.RIDGE * np.eye(12) + (1 - subset.RIDGE) * u @ u.T) * np.exp(s - s.max())
    chosen, gain = subset.greedy(v, s, 9)
    for t in range(9):  # beyond the number of dimensions too
        best = max((i for i in range(12) if i not in chosen[:t]), key=lambda i: np.linalg.det(kernel[np.ix_([*chosen[:t], i], [*chosen[:t], i])]))
        assert best == chosen[t]
    assert np.isclose(np.prod(gain), np.linalg.det(kernel[np.ix_(chosen, chosen)]))
    assert np.isclose(np.log(gain).sum(), subset.log_determinant(v, s, chosen))


def test_core_sets_keep_the_determinant(spark):
    rnd = np.random.default_rng(6)
    kinds = rnd.normal(size=(60, 16))
    v = kinds[np.minimum(rnd.geometric(0.08, 3000) - 1, 59)] + rnd.normal(scale=0.3, size=(3000, 16))
    s = rnd.random(3000)
    items = spark.createDataFrame([(1, f"i{i:04}", x.tolist(), float(y)) for i, (x, y) in enumerate(zip(v, s, strict=True))], "pool_id long, id string, vector array<double>, score double")
    pools = spark.createDataFrame([(1, 12)], "pool_id long, k int")
    got = [int(r.id[1:]) for r in subset.choose_varied(items, pools, dims=16, part_rows=200).collect()]
    one, _ = subset.greedy(v, s, 12)
    assert len(got) == 12 and subset.log_determinant(v, s, np.array(got)) >= subset.log_determinant(v, s, one) - 0.1 * 12


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_packing_is_optimal_when_small(sizes):
    counts = np.bincount(sizes, minlength=21)
    plan = pack.plan(counts, 20)
    used = np.zeros(21, np.int64)
    for f, times in plan:
        assert sum(s * c for s, c in f) <= 20
        for s, c in f:
            used[s] += c * times
    assert (used == counts).all()
    n = sum(t for _, t in plan)
    assert n >= pack.lower_bound(counts, 20)

    def fits(left, bins):
        if not left:
            return True
        seen = set()
        for i, b in enumerate(bins):
            if b >= left[0] and b not in seen:
                seen.add(b)
                if fits(left[1:], [*bins[:i], b - left[0], *bins[i + 1 :]]):
                    return True
        return False

    assert n == next(m for m in range(1, 10) if fits(sorted(sizes, reverse=True), [20] * m))


def test_dominated_fillings_are_left_out():
    counts = np.bincount([12, 8, 5, 3, 2, 2], minlength=21)
    found, _ = pack.fillings(counts, 20, keep=100)
    assert found[0] == (0, ((12, 1), (8, 1))) and len(found) == 1
    found, _ = pack.fillings(np.bincount([12, 7, 5, 4, 2], minlength=21), 20, keep=100)
    assert ((12, 1), (4, 1), (2, 1)) not in [f for _, f in found]  # 4 could make way for 5


def test_packing_of_many_small_items():
    counts = np.zeros(2049, np.int64)
    counts[1], counts[3], counts[1500], counts[1100] = 100_000, 7, 40, 33
    n = sum(t for _, t in pack.plan(counts))
    assert n == pack.lower_bound(counts, 2048)


def test_fill_containers(spark):
    rows = [(i, int(n)) for i, n in enumerate(np.random.default_rng(2).integers(0, 70, 500))] + [(1000, None), (1001, 0)] + [(2000, 7)] * 300
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int")
    got = pack.fill_containers(df, capacity=32).collect()
    used, have = {}, {}
    for r in got:
        used[r.container] = used.get(r.container, 0) + r.size
        have.setdefault(r.doc_id, []).append((r.start, r.size))
    assert max(used.values()) <= 32 and sorted(used) == list(range(len(used)))
    assert sum(used.values()) == sum(n for _, n in rows if n) and len(have[2000]) == 300
    for i, n in rows[:500]:
        parts = sorted(have.get(i, []))
        assert sum(s for _, s in parts) == n and (n > 32 or len(parts) == (n > 0))
        assert [s for s, _ in parts] == [32 * j for j in range(len(parts))]
    counts = np.bincount([s for parts in have.values() for _, s in parts], minlength=33)
    best_fit = sum(t for _, t in pack.best_fit(counts, 32))
    assert pack.lower_bound(counts, 32) <= len(used) <= best_fit
    assert pack.fill_containers(df.limit(0)).collect() == []
