"""Scores against hand-computed values and their invariants."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.functions import text as T
from palimpsest.functions import vectors as X
from palimpsest.operators import search as R

NOW = datetime(2026, 1, 1)


def value(spark, column, row=(1,), schema="x int"):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first().v


def test_rrf_order(spark):
    lexical = spark.createDataFrame([(1, c, 0.1, i + 1) for i, c in enumerate("ABCD")], "query_id int, chunk_id string, ts_rank double, rank int")
    dense = spark.createDataFrame([(1, c, 0.5, i + 1) for i, c in enumerate("CAEF")], "query_id int, chunk_id string, cosine double, rank int")
    rows = {r.chunk_id: r for r in R.fuse(lexical, dense).collect()}
    assert rows["A"].fused == pytest.approx(1 / 61 + 1 / 62, abs=1e-8) and rows["C"].fused == pytest.approx(1 / 63 + 1 / 61, abs=1e-8) and rows["B"].fused == pytest.approx(1 / 62, abs=1e-8)
    assert sorted(rows, key=lambda c: (-rows[c].fused, rows[c].pos))[:4] == ["A", "C", "B", "E"]
    assert rows["A"].channels == ["lexical", "dense"] and rows["E"].channels == ["dense"] and rows["E"].pos == 7 and rows["E"].ts_rank is None
    assert R.fuse(lexical.limit(0), dense).count() == 4 and R.fuse(lexical.limit(0), dense.limit(0)).count() == 0


def test_unit_scores(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, 3.0), (2, 5.0), (2, 5.0)], "query_id int, s double")
    assert sorted((r.query_id, r.u) for r in df.select("query_id", R.unit_scores(F.col("s"), ["query_id"]).alias("u")).collect()) == [(1, 0.0), (1, 0.5), (1, 1.0), (2, 1.0), (2, 1.0)]


@pytest.mark.parametrize("kind,actors,source,social,want", [("human", 8, "channel", True, 1.0), ("human", 1, "native", False, 0.42), ("agent", 1, "native", False, 0.30), ("system", 1, "native", False, 0.24), ("adapter", None, "native", None, 0.21), (None, 0, "?", None, 0.0)])
def test_authority(spark, kind, actors, source, social, want):
    c = S.authority(F.col("k"), F.col("n"), F.col("s"), F.col("b"))
    assert value(spark, c, (kind, actors, source, social), "k string, n int, s string, b boolean") == pytest.approx(want)


def test_corroboration_envelope(spark):
    pairs = [(s, c) for s in (0, 1, 2, 8, 100) for c in (0, 1, 2, 8, 100)]
    df = spark.createDataFrame(pairs, "s long, c long").withColumn("f", S.corroboration_factor(F.col("s"), F.col("c")))
    f = {(r.s, r.c): r.f for r in df.collect()}
    assert f[0, 0] == 1 and all(0.7 <= x <= 1.3 for x in f.values())
    assert all(f[a, c] <= f[b, c] + 1e-12 for c in (1, 2, 8) for a, b in ((0, 1), (1, 2), (2, 8), (8, 100)))
    assert all(f[s, a] >= f[s, b] - 1e-12 for s in (1, 2, 8) for a, b in ((0, 1), (1, 2), (2, 8), (8, 100)))


@pytest.mark.parametrize("auth,supports,provenance,kind,want", [(0.1, 10, "stated", "human", False), (0.5, 0, "stated", "human", True), (0.5, 2, "inferred", "agent", True), (0.5, 1, "inferred", "agent", False), (0.3, 2, None, None, True), (0.30000001192, 2, "x", "x", True)])
def test_strong_gate(spark, auth, supports, provenance, kind, want):
    c = S.strong_gate(F.col("a"), F.col("s"), F.col("p"), F.col("k"))
    assert value(spark, c, (auth, supports, provenance, kind), "a double, s int, p string, k string") is want


def test_time_boosts(spark):
    def temporal(kind, occurred, until=None):
        c = S.temporal_boost(F.col("k"), F.col("o"), F.col("u"), F.lit(NOW).cast("timestamp_ntz"))
        return value(spark, c, (kind, occurred, until), "k string, o timestamp_ntz, u timestamp_ntz")

    day = timedelta(days=1)
    assert temporal("event", NOW) == pytest.approx(1.3) and temporal("event", NOW - 30 * day) == pytest.approx(1.0) and temporal("event", NOW + 5 * day) <= 1.3
    assert temporal("state", NOW - 900 * day) == 1 == temporal("lesson", NOW - 900 * day)
    assert [temporal("deadline", NOW, u) for u in (None, NOW, NOW - day, NOW + 8 * day)] == [1.0, 0.7, 0.7, 1.0]
    assert temporal("deadline", NOW, NOW + timedelta(seconds=1)) == pytest.approx(1.3, abs=1e-4)
    prior = S.recency_prior(F.col("u"), F.lit(NOW).cast("timestamp_ntz"))
    assert value(spark, prior, (None,), "u timestamp_ntz") == 0.5 and value(spark, prior, (NOW - 30 * day,), "u timestamp_ntz") == pytest.approx(0.5) and value(spark, prior, (NOW,), "u timestamp_ntz") == 1


def test_bounds():
    assert [S.overfetch(8, m) for m in (1, 20, 6)] == [24, 80, 48] and S.overfetch(100, 10) == 500
    assert [S.clamp_k(k) for k in (None, 0, 3.9, 500)] == [8, 1, 3, 100] and [S.ef_search(n) for n in (1, 64, 5000)] == [40, 64, 1000]
    assert R.rerank_budget("q" * 10) == 1490 and R.rerank_budget("q" * 1400) is None


def mmr(spark, items, k, trade=0.7):
    rows = spark.createDataFrame([(1, *i) for i in items], "query_id int, chunk_id string, vector array<double>, score double")
    return [r.chunk_id for r in R.mmr(rows, k, trade, dims=3).orderBy("position").collect()]


def test_mmr(spark):
    assert mmr(spark, [("best", [1.0, 0.0, 0.0], 1.0), ("duplicate", [0.99, 0.01, 0.0], 0.9), ("diverse", [0.0, 1.0, 0.0], 0.5)], 3) == ["best", "diverse", "duplicate"]
    v = [1.0, 0.0, 0.0]
    assert mmr(spark, [("low-v", v, 0.3), ("no-v-high", None, 0.8), ("high-v", v, 0.9), ("no-v-low", None, 0.1)], 4) == ["high-v", "low-v", "no-v-high", "no-v-low"]
    assert mmr(spark, [("a", v, 1.0), ("b", None, 0.9), ("c", v, 0.1)], 1) == ["a"]


def test_dedupe(spark):
    t = datetime(2026, 1, 1)
    rows = spark.createDataFrame([(1, "c1", "a", 1, 0.5, 0.2, t), (1, "c2", "a", 2, 0.9, 0.1, t), (1, "c3", "b", 3, 0.3, 0.9, t), (2, "d1", "a", 1, 0.5, 0.0, t), (2, "d2", "b", 2, 0.5, 0.0, t + timedelta(days=1))], "query_id int, chunk_id string, document_id string, pos int, fused double, authority double, occurred_at timestamp_ntz")
    got = [(r.query_id, r.chunk_id) for r in R.dedupe_documents(rows, S.authority_weighted(F.col("fused"), F.col("authority"))).orderBy("query_id", "rank").collect()]
    assert got == [(1, "c2"), (1, "c3"), (2, "d2"), (2, "d1")]


def test_evidence(spark):
    lexical = spark.createDataFrame([(1, 0.06, 1, 0.5, 0, "stated", "human"), (2, 0.04, 1, 0.5, 0, "stated", "human"), (3, 0.06, 1, 0.1, 9, "stated", "human"), (4, None, 1, 0.9, 9, "stated", "human")], "query_id int, ts_rank double, pos int, authority double, supports int, provenance string, created_by_kind string")
    hits = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (5, 0)], "query_id int, hits int")
    assert {r.query_id: r.evidence for r in R.evidence(lexical, hits).collect()} == {1: "strong", 2: "weak", 3: "weak", 4: "weak", 5: "none"}
    ranked = spark.createDataFrame([(4, 0.7, 0.9, 0, "stated", "human"), (2, 0.5, 0.9, 9, "stated", "human")], "query_id int, rerank_score double, authority double, supports int, provenance string, created_by_kind string")
    assert {r.query_id: r.evidence for r in R.evidence(lexical, hits, ranked).collect()}[4] == "strong"


def test_merge(spark):
    def merged(rows, **kw):
        items = spark.createDataFrame([(1, *r) for r in rows], "query_id int, channel string, pos int, source_id string, adapter string, external_ref string, title string, score double, updated_at timestamp_ntz")
        return [(r.channel, r.external_ref) for r in R.merge_local_live(items, F.lit(datetime(2026, 3, 8, 12)).cast("timestamp_ntz"), **kw).orderBy("rank").collect()]

    for a, b in ((0.4, 0.99), (0.01, 100.0)):
        assert merged([("local", 1, "local", "mcp", "x", "t", a, None), ("live", 1, "linear", "mcp", "x", "t", b, None)]) == [("local", "x")]
    both = [("live", 1, "linear", "linear", "old", "a", 1.0, datetime(2025, 1, 1)), ("live", 2, "linear", "linear", "new", "b", 1.0, datetime(2026, 3, 1)), ("local", 1, "local", "mcp", "l", "c", 0.0, None), ("live", 3, "drive", "drive", "d", "d", 1.0, None)]
    assert merged(both, sources=["linear"]) == [("live", "new"), ("live", "old")]
    assert merged(both)[-1] == ("local", "l")


def test_lexical_bad_rows(spark):
    chunks = spark.createDataFrame([("t", "a", "One two, two"), ("t", "b", None), ("t", "c", ""), ("u", "d", "one two"), ("t", "e", "two")], "tenant_id string, chunk_id string, text string")
    q = spark.createDataFrame([(1, "t", ["two"]), (2, "t", ["one", "two"]), (3, "t", []), (4, "t", None), (5, "t", ["two", "two", None])], "query_id int, tenant_id string, terms array<string>")
    got = {(r.query_id, r.chunk_id): r.ts_rank for r in R.lexical_matches(q, chunks).collect()}
    assert set(got) == {(1, "a"), (1, "e"), (2, "a"), (5, "a"), (5, "e")}
    assert got[1, "e"] == pytest.approx(0.1 / 1.64493406685, abs=1e-6) and got[1, "a"] == pytest.approx(0.125 / 1.64493406685, abs=1e-6)


def test_text_functions(spark):
    assert value(spark, T.snippet(F.lit("\t x " + "y" * 300 + "\n"))) == "x " + "y" * 238 + "…"
    words = "caresses ponies ties cats feed agreed plastered motoring sing conflated hopping falling happy sky relational conditional rationalization triplicate formalize hopefulness revival adjustment adoption controlling rolling".split()
    assert [T.stem(w) for w in words] == "caress poni ti cat feed agre plaster motor sing conflat hop fall happi sky relat condit ration triplic formal hope reviv adjust adopt control roll".split()
    assert value(spark, X.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0
