"""Near-duplicates, neighbours and languages, against brute force and on bad rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import language as L
from palimpsest.llm import neardup as N
from palimpsest.llm import neighbours as K

RUNS = N.Kind("chunks", run=3, least=5, distinct=False, threshold=0.6, rows=3)
SETS = N.Kind("titles", run=1, least=4, distinct=True, threshold=0.6, rows=5)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def texts(seed=1):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(60):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(8, 60))]
        out.append(" ".join(base))
        for _ in range(rnd.randint(0, 3)):
            copy = list(base)
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            out.append(" ".join(copy))
    return out + [out[0]] * 25 + [out[0].upper() + "!!"]


def test_words_and_sets():
    assert N.words("Don't_stop — Ärger 12½x") == ["don", "t", "stop", "ärger", "12½x"]
    assert N.elements("a b c d", RUNS) == frozenset() == N.elements(None, SETS) == N.elements("a a a a b", SETS)
    rows = ["a b c d e", None, "", "x", "A  b\nc d e", "日本 a b c d", "İstanbul a b c d e"]
    sizes = [n for _, _, size in N.hashed_sets(pa.array(rows), RUNS) for n in size.tolist()]
    assert sizes == [len(N.elements(r, RUNS)) for r in rows]


def test_sets_in_common():
    rows = [("a b c d e f", "a b c d e x"), ("a b c d e", "a b c d e"), ("", "a b c d e"), ("p q r s t u", "a b c d e f")] * 3
    sets = [[e[h : h + n].tobytes() for e, head, size in N.hashed_sets(pa.array([r[k] for r in rows]), RUNS) for h, n in zip(head, size, strict=True)] for k in (0, 1)]
    both, a, b = N.in_common(*(pa.array(x, pa.binary()) for x in sets))
    want = [(len(N.elements(x, RUNS) & N.elements(y, RUNS)), len(N.elements(x, RUNS)), len(N.elements(y, RUNS))) for x, y in rows]
    assert list(zip(both, a, b, strict=True)) == want


def test_pairs_of_runs():
    rnd = np.random.default_rng(1)
    rows = sorted((int(b), int(k)) for b, k in zip(rnd.integers(0, 20, 200), rnd.integers(0, 30, 200), strict=True))
    got = set(zip(*(x.tolist() for x in N.runs_to_pairs(np.array([b for b, _ in rows]), np.array([k for _, k in rows]))), strict=True))
    assert got == {(k, j) for b, k in rows for c, j in rows if b == c and k < j}
    assert [len(x) for x in N.runs_to_pairs(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


def test_pruning_bound():
    n = N.least_matches(32, 0.6)
    assert 8 < n < 18 and N.least_matches(64, 0.6) > n
    rnd = np.random.default_rng(0)
    a = rnd.integers(0, 256, (4000, N.SIGNATURE), dtype=np.uint8)
    same = rnd.random(a.shape) < 0.6
    b = np.where(same, a, rnd.integers(0, 256, a.shape, dtype=np.uint8)).astype(np.uint8)
    assert len(N.bayes_keep(a, b, 0.6)) > 0.99 * len(a)
    assert len(N.bayes_keep(a, rnd.integers(0, 256, a.shape, dtype=np.uint8), 0.6)) == 0


@pytest.mark.parametrize("hot,block", [(2000, 1000), (2, 3)])
def test_pairs_equal_brute_force(spark, monkeypatch, hot, block):
    monkeypatch.setattr(N, "BLOCK_KEYS", block)
    t = texts()
    chunks = [(f"c{i:04}", x, i) for i, x in enumerate(t)] + [("n1", None, 0), ("n2", "", 0), ("n3", "too short", 0), ("c0001", t[1], 1)]
    titles = [(f"v{i:04}", " ".join(x.split()[:9]), f"d{i % 40}") for i, x in enumerate(t)]
    df1 = spark.createDataFrame(chunks, "id string, text string, key long").repartition(5)
    df2 = spark.createDataFrame(titles, "version_id string, title string, document_id string").repartition(3)
    similar = N.similar_sets([(df1, RUNS, "id", "text", None), (df2, SETS, "version_id", "title", "document_id")], hot)
    got = {tuple(r) for r in N.record_pairs(similar).collect()}
    assert got == {tuple(r) for r in N.record_pairs(similar, 7).collect()}
    want = set()
    for kind, rows in ((RUNS, [(i, x, None) for i, x, _ in {c[0]: c for c in chunks}.values()]), (SETS, titles)):
        s = [(i, N.elements(x, kind), g) for i, x, g in rows]
        for a in range(len(s)):
            for b in range(a):
                if jaccard(s[a][1], s[b][1]) >= 0.6 and (s[a][2] is None or s[a][2] != s[b][2]):
                    want.add((kind.name, min(s[a][0], s[b][0]), max(s[a][0], s[b][0])))
    assert not got - want and len(got) >= 0.98 * len(want) and len(want) > 300
    groups = {(r.tbl, r.id): r.class_id for r in N.record_groups(similar).collect()}
    assert len({groups["chunks", f"c{i:04}"] for i in range(len(t)) if t[i].lower().startswith(t[0])}) == 1
    assert all(groups[k, a] == groups[k, b] for k, a, b in got) and ("chunks", "n1") not in groups


def test_pairs_of_empty_tables(spark):
    none = spark.createDataFrame([], "id string, text string")
    similar = N.similar_sets([(none, RUNS, "id", "text", None)])
    assert N.record_pairs(similar).collect() == [] and N.record_groups(similar).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (300, 200), (300, 400)]
    got = {r.u: r.root for r in N.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 200: 100, 300: 100, 400: 100}


def clustered(n, dims, seed):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(40, dims))[rnd.integers(0, 40, n)] * 0.7 + rnd.normal(size=(n, dims))
    x[: n // 10] = x[n // 10 : 2 * (n // 10)] + rnd.normal(scale=0.02, size=(n // 10, dims))
    return x


@pytest.mark.parametrize("shard_rows,fan_out,broadcast", [(100_000, 256, 1 << 26), (400, 256, 1 << 26), (200, 4, 0)])
def test_neighbours_recall(spark, shard_rows, fan_out, broadcast, monkeypatch):
    """In one cell, in cells of one level, and in cells of several levels whose trees meet the vectors in a shuffle."""
    monkeypatch.setattr(K, "FIT_LEAST", 2048)
    monkeypatch.setattr(K, "FAN_OUT", fan_out)
    monkeypatch.setattr(K, "BROADCAST_BYTES", broadcast)
    x = clustered(3000, 64, 3)
    rows = [("t", f"k{i:05}", v.tolist(), None) for i, v in enumerate(x)] + [("u", "u1", x[0].tolist(), "q"), ("u", "u2", (x[0] * 1e3).tolist(), "q"), ("w", "w1", x[0].tolist(), None)]
    bad = [("t", "b0", None, None), ("t", "b1", [1.0], None), ("t", "b2", [0.0] * 64, None), ("t", "b3", [float("nan")] * 64, None), ("t", "b4", [float("inf")] * 64, None), ("t", None, x[0].tolist(), None), rows[5], rows[5]]
    df = spark.createDataFrame(rows + bad, "tenant string, id string, v array<float>, neighbour string").repartition(4)
    got: dict = {}
    for r in K.nearest(df, "id", "v", ["tenant"], shard_rows=shard_rows).collect():
        got.setdefault(r.id, {})[r.neighbour] = r.cosine
    assert set(got) == {r[1] for r in rows if r[0] != "w"} and got["u1"].keys() == {"u2"} and got["u1"]["u2"] == pytest.approx(1)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    hit = 0
    for i in range(len(x)):
        fifth = np.sort(s[i])[-5]
        assert len(got[f"k{i:05}"]) == 5
        hit += sum(c >= fifth - 1e-5 for c in got[f"k{i:05}"].values())
    assert hit / (5 * len(x)) >= 0.9
    strong = {tuple(sorted((f"k{i:05}", f"k{j:05}"))) for i, j in zip(*np.nonzero(s >= 0.95), strict=True)}
    near = K.nearest(df.where("tenant = 't'"), "id", "v", ["tenant"], at_least=0.95, shard_rows=shard_rows).collect()
    assert {tuple(sorted((r.id, r.neighbour))) for r in near} == strong
    assert K.nearest(df.limit(0), "id", "v", ["tenant"]).collect() == []


def test_copies_of_one_vector_are_shared_out(spark):
    rnd = np.random.default_rng(8)
    x = np.vstack([np.tile(rnd.normal(size=64), (900, 1)), rnd.normal(size=(900, 64))]).astype(np.float32)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    level = K.fit_level(u, np.arange(len(u)) * 7919, len(u), 200, 5)
    home, best = level.near_parts(u, np.arange(len(u)) * 7919)
    assert len(set(home[:900])) == 5 and np.bincount(home).max() < 450
    df = spark.createDataFrame([(f"k{i:04}", v.tolist()) for i, v in enumerate(x)], "id string, v array<float>")
    got = K.nearest(df, "id", "v", [], shard_rows=200).where("id < 'k0900'").collect()
    assert len(got) == 4500 and all(r.cosine > 0.9999 and r.neighbour < "k0900" for r in got)


def test_tree_of_copies():
    tree = K.Tree(np.tile(np.eye(1, 64, dtype=np.float32), (1000, 1)))
    rows, cos = tree.search(tree.x[:3], np.arange(3), 5, 3)
    assert (cos > 0.999).all() and all(i not in rows[i] for i in range(3))


SENTENCES = {
    "en": "the meeting was moved because every customer asked about that invoice",
    "de": "die besprechung wurde verschoben weil jeder kunde nach dieser rechnung fragte",
    "fr": "cette réunion fut déplacée parce que chaque cliente demandait une facture",
}


def corpus(n=60, seed=4):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(list(SENTENCES))
        body = []
        for _ in range(6):
            w = SENTENCES[lang].split()
            rnd.shuffle(w)
            w.insert(3, "".join(rnd.choice("BCDFG") for _ in range(1)) + "".join(rnd.choice("aeioulrn") for _ in range(7)))
            body.append(" ".join(w).capitalize() + ".")
        out.append((i, " ".join(body), lang if rnd.random() > 0.1 else "en"))
    return out


def test_labels(spark):
    cases = [("de", "de"), (" DEU ", "de"), ("ger", "de"), ("German", "de"), ("en-US", "en"), ("en_GB", "en"), ("xx", None), ("und", None), ("", None), (None, None), ("unknown", None), ("English-US", None), ("jpn", "ja")]
    df = spark.createDataFrame(cases, "label string, want string")
    assert all(r.got == r.want for r in df.select("want", L.named_language(F.col("label")).alias("got")).collect())


def test_forward_backward_equals_enumeration():
    rnd = np.random.default_rng(2)
    k = 3
    f = L.Field(np.zeros((1, k)), rnd.normal(size=k), rnd.normal(size=(k, k)), rnd.normal(size=(k, k)))
    emit, chain, sentence = rnd.normal(size=(7, k)), np.array([0, 0, 0, 0, 1, 1, 2]), np.array([0, 0, 1, 1, 2, 2, 2])
    post, starts, inner, across = L.forward_backward(emit, chain, sentence, f, expect=True)
    for c in range(3):
        at = np.flatnonzero(chain == c)
        total, want = 0.0, np.zeros((len(at), k))
        for path in np.ndindex(*[k] * len(at)):
            w = f.start[path[0]] + sum(emit[i, y] for i, y in zip(at, path, strict=True))
            w += sum((f.inner if sentence[at[j]] == sentence[at[j - 1]] else f.across)[path[j - 1], path[j]] for j in range(1, len(at)))
            total += np.exp(w)
            for j, y in enumerate(path):
                want[j, y] += np.exp(w)
        assert np.allclose(post[at], want / total, atol=1e-5)
    assert np.isclose(starts.sum(), 3, atol=1e-4) and np.isclose(inner.sum() + across.sum(), 4, atol=1e-4)


def test_held_out_sentences_and_mixed_documents():
    docs = corpus()
    field = L.fit([t for _, t, _ in docs], [lang for *_, lang in docs])
    labeller = L.Labeller(field)
    right = total = 0
    for i, (_, text, _) in enumerate(corpus(30, 9)):
        truth = max(SENTENCES, key=lambda k: sum(w in SENTENCES[k].split() for w in text.lower().replace(".", "").split()))
        for _, _, data, offsets in L.blocks(pa.array([text])):
            s = labeller.runs(data, offsets)
            right += sum(L.NAMES[x] == truth for x in s["lang"][s["whole"]])
            total += 6
    assert right >= 0.97 * total
    mixed = "The meeting was moved because every customer asked about that invoice.\n\nDie Besprechung wurde verschoben weil jeder Kunde nach dieser Rechnung fragte.\n```\nfor i in range(3):\n```\n12 34 {\"k\": [1]} Xyzq"
    for _, _, data, offsets in L.blocks(pa.array([mixed])):
        s = labeller.runs(data, offsets)
        assert [L.NAMES[x] for x in s["lang"]] == ["en", "de"] and s["whole"].all()
        assert mixed[s["start"][1] : s["end"][1]].strip().startswith("Die Besprechung")
    switched = "The meeting was moved because every Kunde nach dieser Rechnung fragte jeder. " + " ".join(["the meeting was moved because"] * 100)
    for _, _, data, offsets in L.blocks(pa.array([switched])):
        s = labeller.runs(data, offsets)
        assert [L.NAMES[x] for x in s["lang"]] == ["en", "de", "en"] and s["whole"].tolist() == [False, False, True]
        assert switched[s["start"][1] : s["end"][1]].startswith("Kunde") and s["end"][1] == switched.index("fragte jeder.") + 13
        w = L.find_words(L.Block(data, offsets))
        cut = labeller.posteriors(w)
        whole = L.forward_backward(labeller._emissions(w.distinct)[w.uid], w.line, w.sentence, field)
        assert len(cut) > 2 * L.CHAIN - 20 and np.abs(cut - whole).max() < 1e-4


def test_sample_at_any_size(spark, monkeypatch):
    assert all(L.sample_rate(n, 60) / 2**63 * n == pytest.approx(300, rel=1e-3) for n in (10**3, 62_900_000, 10**9, 10**15))
    assert L.sample_rate(10, 60) == 2**63 - 1
    df = spark.createDataFrame(corpus(60), "doc_id long, text string, lang string")
    taken = []
    monkeypatch.setattr(L, "fit", lambda t, label: taken.append(label))
    L.fit_sample(df, documents=7)
    assert sorted(taken[0]) == sorted(list(SENTENCES) * 7)
    monkeypatch.setattr(L, "sample_rate", lambda n, d: -1)
    with pytest.raises(RuntimeError):
        L.fit_sample(df)


def test_long_words_keep_all_features():
    assert len(L.features("ab" * 200)) > 700


def test_segments_bad_rows(spark):
    docs = corpus(40)
    rows = [*docs, (100, None, "en"), (101, "", None), (102, "   \n", "xx"), (103, "12 34", "de"), (104, docs[0][1], "zz"), (104, docs[0][1], "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("start", F.lit("clash"))
    seg = L.label_segments(df, L.fit_sample(df), keep=("lang", "start")).toDF("doc_id", "label", "clash", "segment", "start", "end", "lang", "confidence", "sentences", "words")
    got = seg.collect()
    assert {r.doc_id for r in got} == {*range(40), 104} and all(0 <= r.confidence <= 1 and r.start < r.end for r in got)
    assert sum(r.doc_id == 104 for r in got) == 2
    assert L.document_languages(seg).where("doc_id = 0").first().share == 1
    empty = df.limit(0)
    assert L.label_segments(empty, L.fit_sample(empty)).collect() == []
