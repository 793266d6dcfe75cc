"""Chunks, hashes, captures, retention, access, feeds, streams, sources and the plane."""

import json
import time
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest import validate as V
from palimpsest.api import Memory
from palimpsest.functions import hashing as H
from palimpsest.operators import access as A
from palimpsest.operators import chunker as C
from palimpsest.operators import degrade, timeline
from palimpsest.operators import lifecycle as M
from palimpsest.operators import references as R
from palimpsest.sources import embedding, files, live, schemas
from palimpsest.streaming import degrade as stream_degrade
from palimpsest.streaming import distill
from palimpsest.streaming.feed import feed_stream, numbered


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=300), st.integers(2, 20), st.integers(0, 4), st.integers(0, 3))
def test_chunks_cover_and_fit(text, most, least, overlap):
    chunks = C.chunk_texts(text, most, least, overlap)
    spans = [(a, b) for a, b, _ in chunks]
    assert (not text) == (not spans) and all(c == text[a:b] for a, b, c in chunks[:-1])
    if spans:
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(a[1] >= b[0] >= a[0] and b[1] > a[1] for a, b in zip(spans, spans[1:], strict=False))
        assert all(b - a <= (most + overlap) * 4 for a, b in spans[:-1]) and spans[-1][1] - spans[-1][0] <= (most + overlap + least) * 4


def test_chunker_cases():
    long = "This is a sentence of the text. " * 400
    spans = [(a, b) for a, b, _ in C.chunk_texts(long)]
    assert len(spans) > 1 and all(b - a <= 2800 for a, b in spans)
    assert C.chunk_texts("A short note.") == [(0, 13, "A short note.")] and C.chunk_texts("") == []
    # worked out by hand, with bounds of 8, 4 and 4 characters
    assert [c for *_, c in C.chunk_texts("aa bb cc dd ee", 2, 1, 1)] == ["aa bb ", "bb cc ", "cc dd ee"]
    assert C.chunk_texts("aaaa bb ccccccc d", 2, 1, 1) == [(0, 8, "aaaa bb "), (5, 17, "bb ccccccc d")]
    assert C.chunk_texts("aaa bbb cc", 2, 1, 1) == [(0, 8, "aaa bbb "), (4, 10, "bbb cc")] and C.chunk_texts("aaa bbb cc", 2, 2, 1) == [(0, 10, "aaa bbb bbb cc")]
    words = " ".join(f"w{i} alpha beta." for i in range(200))
    spans = [(a, b) for a, b, _ in C.chunk_texts(words, 100, 10, 20)]
    assert all(words[a:b].split()[-3:] == [x for x in words[a:b].split()[-3:] if x in words[c:d].split()] for (a, b), (c, d) in zip(spans, spans[1:], strict=False))
    text = "alpha beta gamma-delta-epsilon-zeta-eta-theta-iota z"
    last = C.chunk_texts(text, 10, 3, 0)[-1]
    assert last[1] - last[0] >= 12 and text[last[0] : last[1]].endswith("z")


def test_rechunk(spark):
    parts = spark.createDataFrame([("d", 0, "a b c", "summary"), ("d", 1, "x " * 30, None), ("d", 2, "", None), ("e", 0, None, None)], "document_id string, ordinal int, text string, role string")
    rows = C.rechunk(parts, chunks=C.chunk_udf(5, 1, 0)).orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(len(rows))) and rows[0].role == "summary" and {r.document_id for r in rows} == {"d"}


def test_hashes(spark):
    df = spark.createDataFrame([('{"b":1,"a":{"d":2,"c":3}}',), ('{"a":{"c":3,"d":2},"b":1}',), ("no json",), (None,)], "j string")
    a, b, c, d = [r.v for r in df.select(H.canonical_json("j").alias("v")).collect()]
    assert a == b == '{"a":{"c":3,"d":2},"b":1}' and c == "no json" and d is None
    h = lambda title, chunks: spark.range(1).select(H.content_hash(F.lit(title), F.lit("k"), F.lit("r"), F.lit("{}"), F.array(*[F.lit(x) for x in chunks])).alias("v")).first().v
    assert h("t", ["a", "b"]) == h("t", ["ab"]) != h("t", ["ac"]) != h("u", ["ab"])
    assert len(H.model_key("http://x", "m")) == 16
    with pytest.raises(ValueError):
        H.embedding_table("x; drop")


def test_versions_fold(spark):
    log = spark.createDataFrame([("t", "d", i, h) for i, h in enumerate("aabba")] + [("t", "e", 0, "x")], "tenant_id string, document_id string, seq int, content_hash string")
    got = [(r.document_id, r.seq, r.version, r.status, r.supersedes_seq) for r in M.versions_of(log).orderBy("document_id", "seq").collect()]
    assert got == [("d", 0, 1, "superseded", None), ("d", 2, 2, "superseded", 0), ("d", 4, 3, "active", 2), ("e", 0, 1, "active", None)]
    assert M.versions_of(log.limit(0)).count() == 0


def test_capture_after_withdrawal(spark):
    state = schemas.conform(spark.createDataFrame([("v1", "t", "d", 1, "tombstoned", "a", "live"), ("w1", "t", "e", 1, "active", "a", "live")], "id string, tenant_id string, document_id string, version int, status string, content_hash string, generation string"), "version")
    batch = spark.createDataFrame([("t", "d", 1, "a"), ("t", "e", 1, "a"), ("t", "e", 2, "b"), ("t", "f", 1, "z")], "tenant_id string, document_id string, seq int, content_hash string")
    got = {(r.document_id, r.version, r.status, r.is_new) for r in M.capture(batch, state).collect()}
    assert got == {("d", 2, "active", True), ("e", 2, "active", True), ("e", 1, "superseded", False), ("f", 1, "active", True)}


def test_access(spark):
    g = spark.createDataFrame([("u", "a:*", "search", "allow"), ("u", "a:b", "search", "deny"), ("u", "c+*", "search", "allow"), ("v", "a:*", "search", "allow"), ("v", "a:*", "search", "deny"), ("u", "a:x", "read", "allow")], "principal_id string, resource string, action string, effect string")
    docs = spark.createDataFrame([("1", ["a:b"], None), ("2", ["a:b", "a:c"], None), ("3", [], "u"), ("4", None, "v"), ("5", ["c+d"], None), ("6", ["ccd"], None)], "document_id string, access_tags array<string>, creator string")
    who = spark.createDataFrame([("u",), ("v",), ("w",)], "principal_id string")
    got = {(r.principal_id, r.document_id) for r in A.visible_documents(docs, g, who).collect()}
    assert got == {("u", "2"), ("u", "3"), ("u", "5"), ("v", "4")}
    shared = A.share_grants(spark.createDataFrame([("d1", "alice", ["alice", "  ", "bob", " bob"])], "document_id string, sharer string, principals array<string>")).collect()
    assert [(r.principal_id, r.resource) for r in shared] == [("bob", "memory.doc:d1")]
    s = spark.range(1).select(A.split_audience(F.array(F.lit("x"), F.lit("y"), F.lit("x")), F.array(F.lit("x"))).alias("s")).first().s
    assert s.allowed == ["x", "x"] and s.needs_approval == ["y"]


def test_feed_cursor_goes_on_when_all_is_denied(spark):
    feed = spark.createDataFrame([(i, "t", f"d{i}") for i in range(1, 8)], "feed_seq long, tenant_id string, document_id string")
    page = timeline.feed_page(feed, spark.createDataFrame([("t", 2)], "tenant_id string, after long"), 3)
    assert sorted(r.feed_seq for r in page.collect()) == [3, 4, 5] and {r.next_cursor for r in page.collect()} == {5}


def references_fixture(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    doc = spark.createDataFrame([("D", "t", t(1)), ("E", "u", t(1))], "id string, tenant_id string, created_at timestamp_ntz")
    ver = spark.createDataFrame([("V", "t", t(1), "active"), ("W", "t", t(1), "tombstoned"), ("X", "t", t(9), None)], "id string, tenant_id string, ingested_at timestamp_ntz, status string")
    none = spark.createDataFrame([], "id string, tenant_id string, created_at timestamp_ntz")
    edge = [("e1", "t", "document", " D\t", "version", "V"), ("e2", "t", "document", "d", "version", "W"), ("e3", "t", "document", "E", "version", "X"), ("e4", "t", "document", None, "version", "  \n"), ("e5", "t", None, "D", "chunk", "C"), ("e6", None, "document", "D", "version", "V")]
    edges = spark.createDataFrame([(*e, t(5)) for e in edge + edge[:3]], "id string, tenant_id string, from_type string, from_ref string, to_type string, to_ref string, created_at timestamp_ntz")
    add = spark.createDataFrame([("r1", "t", ["V", None, " ", "Q ", "Q"], t(5)), ("r2", "t", None, t(5)), ("r3", "t", [], None), ("r4", "t", ["X"], None)], "request_id string, tenant_id string, derived_from array<string>, received_at timestamp_ntz")
    return edges, add, R.parents(doc, ver, none, none)


@pytest.mark.parametrize("hot,hot_keys", [(R.HOT, R.HOT_KEYS), (1, 100), (1, 3)])
def test_broken_references(spark, hot, hot_keys):
    edges, add, parents = references_fixture(spark)
    children = R.edge_references(edges).unionByName(R.derived_references(add))
    got = {(r.src_id, r.src_field, r.ref): "".join(x[0] for x in ("missing", "foreign", "deleted", "late") if r[x]) for r in R.broken_references(children, parents, hot, hot_keys).collect()}
    assert got == {
        ("e2", "from_ref", "d"): "m", ("e2", "to_ref", "W"): "d", ("e3", "from_ref", "E"): "f", ("e3", "to_ref", "X"): "l", ("e5", "from_ref", "D"): "m", ("e5", "to_ref", "C"): "m",
        ("e6", "from_ref", "D"): "f", ("e6", "to_ref", "V"): "f", ("r1", "derived_from", "Q"): "m",
    }
    assert R.broken_references(children.limit(0), parents, hot).count() == 0
    assert {tuple(r) for r in R.broken_references(children, parents.limit(0), hot).select("missing").distinct().collect()} == {(True,)}


def sequential(hits):
    on, out = False, []
    for i in range(len(hits)):
        w = hits[max(0, i - 199) : i + 1]
        rate = sum(w) / len(w)
        if len(w) >= 32:
            on = True if rate >= 0.2 else False if rate <= 0.1 else on
        out.append(on)
    return out


def test_degrade_batch_and_stream(spark, tmp_path):
    hits = [int(i % 3 == 0) for i in range(60)] + [0] * 400 + [1] * 80
    calls = spark.createDataFrame([("t", i, h) for i, h in enumerate(hits)] + [("u", 1, 1)], "tenant_id string, seq long, hit int")
    want = sequential(hits)
    got = [r.escalated for r in degrade.escalation(degrade.rolling_rates(calls, F.col("hit") == 1)).where("tenant_id = 't'").orderBy("seq").collect()]
    assert got == want and True in want and False in want[40:]
    parts = degrade.rolling_rates(calls, F.col("hit") == 1, block_rows=230)
    assert parts.where("tenant_id = 't'").agg(F.max("block")).first()[0] == 2
    assert [r.escalated for r in degrade.escalation(parts).where("tenant_id = 't'").orderBy("seq").collect()] == want
    for i, (a, b) in enumerate(((0, 200), (200, 540))):
        calls.where((F.col("seq") >= a) & (F.col("seq") < b)).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    s = spark.readStream.schema(calls.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_degrade.degrade_stream(s).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.escalated for r in spark.read.parquet(str(tmp_path / "out")).where("tenant_id = 't'").orderBy("seq").collect()] == want
    with pytest.raises(ValueError):
        degrade.validate_config(window=10)


def feed_frame(spark):
    return spark.createDataFrame(
        [(1, "t", "v1", "d1", "note", "Raw", "active", "human", None, "stated", ["memory.owner:u1"]), (2, "t", "v2", "d2", "note", None, "active", "human", None, "stated", None), (3, "t", "v3", "d3", "mail", "M", "active", "human", None, "stated", None), (4, "t", "v4", "d4", "note", "Own", "active", "agent", distill.AGENT, "inferred", None)],
        "feed_seq long, tenant_id string, version_id string, document_id string, kind string, title string, status string, created_by_kind string, generator_agent_id string, provenance string, access_tags array<string>",
    )


def test_distill_tick(spark):
    written = []
    counts, cursors = distill.tick(spark, feed_frame(spark), {"t": 0}, distill.sample_distiller, lambda df: written.extend(df.collect()))
    assert counts == {"write": 1, "poison": 1, "skip": 1} and cursors == {"t": 4}
    assert written[0].derived_from == ["v1"] and written[0].access_tags == ["memory.owner:u1"] and written[0].provenance == "inferred"
    assert distill.distil_page(feed_frame(spark).limit(0), distill.sample_distiller).count() == 0


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(f"v{i}", "t", "d", "active" if i % 2 else "archived", i if i < 7 else None, datetime(2024, 1, 1)) for i in range(1, 8)], "id string, tenant_id string, document_id string, status string, feed_seq long, ingested_at timestamp_ntz")
    schemas.conform(rows, "feed_log").write.parquet(str(tmp_path / "log" / "t=1" / "v=1"))
    rows = rows.where("feed_seq is not null")
    q = feed_stream(spark, str(tmp_path / "log")).writeStream.format("memory").queryName("feed_out").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(60)
    assert sorted(r.feed_seq for r in spark.table("feed_out").collect()) == [1, 3, 5]
    feed_frame(spark).write.parquet(str(tmp_path / "feed"))
    good, bad = [], []
    q = distill.start(spark.readStream.schema(feed_frame(spark).schema).parquet(str(tmp_path / "feed")), distill.sample_distiller, lambda d, _: good.extend(d.collect()), lambda d, _: bad.extend(d.collect()), str(tmp_path / "c2"), every=None)
    q.awaitTermination(60)
    sink = distill.folder_sink(str(tmp_path / "claims"))
    for _ in range(2):  # a retried batch
        sink(spark.createDataFrame([("x",)], "title string"), 0)
    assert spark.read.parquet(str(tmp_path / "claims")).count() == 1
    assert [r.feed_seq for r in good] == [1] and [r.feed_seq for r in bad] == [2]
    n = numbered(rows.drop("feed_seq").repartition(3), 10).orderBy("feed_seq").collect()
    assert [(r.id, r.feed_seq) for r in n] == [(f"v{i}", 10 + i) for i in range(1, 7)]


def test_live_sources(spark):
    class Slow:
        id = "slow"

        def search_live(self, *a):
            time.sleep(1)
            return []

    class Broken:
        id = "broken"

        def search_live(self, *a):
            raise OSError("down")

    catalog = live.CatalogSource("linear", [{"adapter": "linear", "external_ref": "1", "title": "Alpha"}, {"adapter": "linear", "external_ref": "2", "title": "Beta", "snippet": "alpha"}, {"title": None}])
    got = live.collect_live([catalog, Slow(), Broken(), Broken()], "alpha", "t", "u", 5, timeout=0.2)
    assert [i["external_ref"] for i in got.items] == ["1", "2"] and sorted(got.degraded) == ["live_error", "live_timeout"]
    assert live.live_frame(spark, got).count() == 2 and live.live_frame(spark, live.Live([])).count() == 0
    spark.dataSource.register(live.LiveDataSource)
    assert spark.read.format("palimpsest_live").option("catalogs", json.dumps({"linear": catalog.catalog})).option("query", "beta").load().count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<html><title> T </title><body>Hello <b>you</b><script>x</script></body></html>")
    (tmp_path / "b.txt").write_bytes(b"\n")  # Spark's source leaves files without any byte out
    rows = {r.path.rsplit("/", 1)[-1]: (r.title, r.text) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert rows == {"a.html": ("T", "Hello you"), "b.txt": ("b.txt", "")}
    with pytest.raises(ValueError):
        files.one_of("x", {})


def test_embedding(spark):
    chunks = spark.createDataFrame([("t", "c1", "a b"), ("t", "c2", None)], "tenant_id string, chunk_id string, text string")
    key = H.model_key("x", "y")
    assert embedding.embed_chunks(chunks, embedding.hashing_embedder(64), key, 64).where("not rejected").count() == 2
    assert embedding.embed_chunks(chunks, embedding.hashing_embedder(65), key, 64).where("rejected and embedding is null").count() == 2

    def broken(texts):
        raise OSError("down")

    assert {r.error for r in embedding.embed_chunks(chunks, broken, key, 64).collect()} == {"OSError: down"}
    m = embedding.Models(spark)
    a, b = m.ensure("t", "x", "1", 64, datetime(2024, 1, 1)), m.ensure("t", "x", "2", 64, datetime(2024, 1, 2))
    m.ensure("t", "x", "1", 64, datetime(2024, 1, 3))
    m.activate("t", a, datetime(2024, 1, 4))
    m.activate("t", b, datetime(2024, 1, 5))
    assert m.rows.count() == 2 and m.active("t").model_key == b and m.by_key("t", a).status == "ready"
    m.clear("t", datetime(2024, 1, 6))
    assert m.active("t") is None
    with pytest.raises(KeyError):
        m.activate("t", "nope", datetime(2024, 1, 6))
    assert embedding.request_body("tei", "m", ["x"]) == ("/embed", {"inputs": ["x"]}) and embedding.response_vectors("openai", {"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}) == [[1], [2]]


def test_validation():
    assert V.limit(" 7 ", V.SEARCH_LIMIT, 8) == 7 and V.limit(None, V.SEARCH_LIMIT, 8) == 8 and V.cursor("") == 0
    for bad in (lambda: V.limit("x", V.SEARCH_LIMIT, 8), lambda: V.limit(51, V.SEARCH_LIMIT, 8), lambda: V.cursor("-1"), lambda: V.non_blank(" ", "x"), lambda: V.moment("soon", "x")):
        with pytest.raises(V.PlaneError):
            bad()
    assert V.moment("2024-01-01T02:00:00+02:00", "x") == datetime(2024, 1, 1)


def test_enums(spark):
    df = spark.createDataFrame([("mentions", "document", "entity"), ("likes", "document", "entity"), (None, "document", "entity")], "rel string, from_type string, to_type string")
    assert [r.v for r in df.select(schemas.enum_violation("edge").alias("v")).collect()] == [None, "rel", "rel"]


def test_plane(spark, tmp_path):
    clock = {"now": datetime(2024, 6, 1)}
    catalog = live.CatalogSource("linear", [{"adapter": "linear", "external_ref": "L1", "title": "Renewal ticket", "score": 2.0}])
    m = Memory(spark, str(tmp_path / "store"), embedding.hashing_embedder(64), sources=[catalog], clock=lambda: clock["now"])
    tick = lambda day: clock.update(now=datetime(2024, 6, day))
    one = m.add("t", "alice", "Q3 renewal call", "The renewal is due in March. The customer asked twice.", external_ref="call:1", access_tags=["memory.space:s1"], entities=[("person", "dana")], edges=[("authored_by", "native", "alice"), ("part_of", "entity", "e9")])
    assert {(r.kind, r.identifiers) for r in m.store.read("entity", "t").collect()} == {("person", '{"value":"dana"}'), ("principal", '{"value":"alice"}')}
    assert {(r.rel, r.to_type) for r in m.store.read("edge", "t").where("from_type = 'document'").collect()} == {("authored_by", "entity"), ("part_of", "entity")}
    assert m.search("t", "alice", entity_ids=["e9"], sources=["local"])["hits"][0]["document_id"] == one["document_id"]
    assert one["status"] == "captured" and one["degraded"] == [] and one["chunks"] == 1
    tick(2)
    again = m.add("t", "alice", "Q3 renewal call", "The renewal is due in March. The customer asked twice.", external_ref="call:1")
    assert again["status"] == "noop"
    tick(3)
    two = m.add("t", "alice", "Q3 renewal call", "The renewal moved to April.", external_ref="call:1", derived_from=[one["version_id"]])
    other = m.add("t", "bob", "Garden", "Nothing about that.", kind="page")
    got = m.search("t", "alice", "renewal")
    assert [h["version_id"] for h in got["hits"]][0] == two["version_id"] and got["evidence"] == "strong" and got["hits"][0]["derived_from"] == [one["version_id"]]
    assert {(i["channel"], i["external_ref"]) for i in got["merged"]} >= {("live", "L1"), ("local", "call:1")}
    grants = spark.createDataFrame([("bob", "memory.space:*", "search", "allow", None, None)], "principal_id string, resource string, action string, effect string, expires_at timestamp_ntz, conditions string")
    assert [h["document_id"] for h in m.search("t", "bob", "renewal", sources=["local"], grants=grants.limit(0))["hits"]] in ([], [other["document_id"]])
    assert m.search("t", "bob", "", kinds=["page"], sources=["local"])["hits"][0]["document_id"] == other["document_id"]
    nobody = m.search("t", "x", "renewal", sources=["local"])
    assert nobody["hits"] == [] and nobody["evidence"] == "none"
    page = m.feed("t", "alice", 0)
    assert [e["version_id"] for e in page["entries"]] == [one["version_id"], two["version_id"]] and page["next_cursor"] == 3
    assert [r["document_id"] for r in m.list("t", "alice")] == [one["document_id"]] and m.list("u", "alice") == [] == m.list("t", "x")
    # the feed of the store as a stream, through the distiller into folders; what comes later is picked up by the next run
    claims = lambda: distill.start(feed_stream(spark, m.store.feed_path(), exclude_generator=distill.AGENT), lambda e: {"title": e["title"], "text": e["kind"]}, distill.folder_sink(str(tmp_path / "claims")), distill.folder_sink(str(tmp_path / "poison")), str(tmp_path / "ck"), every=None).awaitTermination(120)
    claims()
    assert sorted(r.derived_from[0] for r in spark.read.parquet(str(tmp_path / "claims")).collect()) == sorted([one["version_id"], two["version_id"], other["version_id"]])
    third = m.add("t", "carol", "Note of another tag", "Some text.", external_ref="n:3", access_tags=["memory.space:s2"], generator_agent_id=distill.AGENT)
    claims()
    assert spark.read.parquet(str(tmp_path / "claims")).count() == 3 and third["status"] == "captured"
    with pytest.raises(V.PlaneError) as e:
        m.deprecate_version("t", "bob", two["version_id"])
    assert e.value.code == 403
    assert m.share("t", "alice", one["document_id"], ["bob", "alice", " "])["written"] == 1
    assert one["document_id"] in {h["document_id"] for h in m.search("t", "bob", "renewal", sources=["local"])["hits"]}
    config = m.create_transform_config("t", "small", {"chunk": {"max_tokens": 3, "min_tokens": 1, "overlap_tokens": 0}})
    assert config["version"] == 1 and len(m.list_transform_configs("t")) == 1
    run = m.run_transform("t", config["id"])
    assert run["status"] == "completed" and run["version_count"] == 4 and run["raw_count"] == 5 and run["error"] is None
    staged = m.store.read("chunk", "t").join(m.store.read("version", "t").where(F.col("generation") == run["generation"]).select(F.col("id").alias("version_id")), "version_id").select(F.col("id").alias("chunk_id"))
    assert staged.count() > 4 and staged.join(m.store.read("embedding", "t"), "chunk_id", "left_anti").count() == 0
    m.promote_generation("t", run["generation"])
    assert m.search("t", "alice", "april", sources=["local"])["hits"][0]["version_id"] != two["version_id"]
    for generation in (run["generation"], "live"):
        with pytest.raises(V.PlaneError) as e:
            m.promote_generation("t", generation)
        assert e.value.code == 400
    m.demote_generation("t", run["generation"])
    with pytest.raises(V.PlaneError):
        m.demote_generation("t", run["generation"])
    bare = Memory(spark, str(tmp_path / "store"), clock=lambda: clock["now"]).run_transform("t", config["id"])
    assert bare["status"] == "failed" and bare["version_count"] == 0 and "embedder" in bare["error"]
    assert m.search("t", "alice", "april", sources=["local"])["hits"][0]["version_id"] == two["version_id"]
    assert m.set_retention_class("t", "alice", two["version_id"], "ephemeral")["changed"] == 1
    clock["now"] = datetime(2024, 7, 1)
    assert m.sweep_ephemeral("t")["versions_deprecated"] == 1
    assert m.set_retention_class("t", "alice", two["version_id"], "durable")["changed"] == 1
    assert m.hard_delete_document("t", "alice", one["document_id"])["deleted"] is False
    assert m.tombstone_document("t", "alice", one["document_id"])["versions"] >= 2
    assert m.hard_delete_document("t", "alice", one["document_id"])["deleted"] is True
    assert all(h["document_id"] != one["document_id"] for h in m.search("t", "alice", "renewal", sources=["local"])["hits"])
    for bad in (lambda: m.search("t", "a", ""), lambda: m.add("t", "a", " ", "x"), lambda: m.search("t", "a", "x", limit=99)):
        with pytest.raises(V.PlaneError):
            bad()
    with pytest.raises(ValueError):
        m.store.bootstrap("english")
    with pytest.raises(ValueError):
        m.store.bootstrap("x; drop")
    m.close()


def test_reranking_dialects():
    from palimpsest.sources import reranking

    assert reranking.response_scores("tei", [{"index": 1, "score": 0.2}, {"index": 0, "score": 0.9}], 2) == [0.9, 0.2]
    assert reranking.response_scores("cohere", {"results": [{"index": 0, "relevance_score": 0.5}]}, 1) == [0.5] == reranking.response_scores("voyage", {"data": [{"index": 0, "relevance_score": 0.5}]}, 1)
    assert reranking.request_body("voyage", "m", "q", ["a"])[1] == {"model": "m", "query": "q", "documents": ["a"]}
    assert reranking.window("BAAI/bge-reranker-v2-m3") == 8192 and reranking.window(None) == 512
    for bad in ([{"index": 2, "score": 1}], [{"index": 0, "score": 1}]):
        with pytest.raises(ValueError):
            reranking.response_scores("tei", bad, 2)


def test_grants_and_tuning(spark):
    from palimpsest.operators.search import generation_tuning

    g = spark.createDataFrame([("1", "allow"), ("2", "allow")], "id string, effect string")
    assert {(r.id, r.effect) for r in A.put_grants(g, spark.createDataFrame([("2", "deny"), ("3", "allow")], "id string, effect string")).collect()} == {("1", "allow"), ("2", "deny"), ("3", "allow")}
    runs = spark.createDataFrame([("t", "r1", "c1"), ("t", "r2", "c2")], "tenant_id string, generation string, config_id string")
    configs = spark.createDataFrame([("t", "c1", "{}"), ("u", "c2", "{}")], "tenant_id string, id string, params string")
    assert {(r.generation, r.params) for r in generation_tuning(runs, configs).collect()} == {("r1", "{}"), ("r2", None)}
