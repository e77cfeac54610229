"""Facts of the stored entities, chunkers, graphs, retrieval, sources and sessions on small inputs."""

import json
import random

import numpy as np
import pytest
from corvid.config import ChunkConfig, GraphConfig, SearchConfig
from corvid.functions import location as L
from corvid.functions import text as T
from corvid.functions import url as U
from corvid.functions import vectors as V
from corvid.operators import chunking, communities, graph, rag, retrieval, storage, vector
from corvid.sources import files, html, pdf
from corvid.streaming import sessions
from pyspark.sql import functions as F


def one(spark, column, **values):
    """The value of a column over one row of string literals."""
    return spark.range(1).select(*(F.lit(v).cast("string").alias(k) for k, v in values.items()) if values else [F.lit(1).alias("x")]).select(column.alias("r")).first()["r"]


def units(spark, n, **more):
    return spark.createDataFrame([(f"u{k}", "d", f"text {k}", "paragraph", k, *(v[k] for v in more.values())) for k in range(n)], "unit_id string, document_id string, text string, unit_type string, index int" + "".join(f", {k} {'array<double>' if k == 'embedding' else 'string'}" for k in more))


def pairs(df):
    return sorted((r["src"], r["dst"]) for r in df.collect())


def test_edges(spark):
    assert len(pairs(graph.structural_edges(units(spark, 3)))) == 4
    assert pairs(graph.structural_edges(units(spark, 3).limit(0))) == []
    h = graph.hierarchical_edges(units(spark, 3, section=["1", "1", "2"])).collect()
    assert [(r["src"], r["dst"], r["weight"]) for r in h] == [("u0", "u1", 0.5)]
    assert pairs(vector.semantic_edges(units(spark, 2, embedding=[[1.0, 0.0], [0.0, 1.0]]), 0.99)) == []
    assert pairs(vector.semantic_edges(units(spark, 2, embedding=[[1.0, 0.0], [1.0, 0.0]]), 0.5)) == [("u0", "u1")]


def test_keyword_edges(spark):
    rows = [("d", "u0", w) for w in ("machine", "learning", "models")] + [("d", "u1", w) for w in ("machine", "learning", "data")] + [("d", "u2", w) for w in ("weather", "rain")]
    got = graph.keyword_edges(spark.createDataFrame(rows, "document_id string, unit_id string, word string"), 2)
    assert pairs(got) == [("u0", "u1"), ("u1", "u0")]
    assert {r["weight"] for r in got.collect()} == {0.5}


def test_neighbours_and_expansion(spark):
    e = spark.createDataFrame([("u0", "u1", 1.0), ("u1", "u2", 1.0), ("u0", "u9", 0.4)], "src string, dst string, weight double")
    seed = spark.createDataFrame([("u0",)], "id string")
    assert {r["id"] for r in graph.neighbours(e.where("weight = 1"), seed, 1).collect()} == {"u1"}
    assert {r["id"] for r in graph.neighbours(e.where("weight = 1"), seed, 2).collect()} == {"u1", "u2"}
    assert {r["id"]: r["hop"] for r in graph.expand(e, seed, 2, 0.5).collect()} == {"u0": 0, "u1": 1, "u2": 2}


def test_modularity():
    assert communities.modularity(["a"], [], 1.0) == [["a"]]
    assert communities.modularity(["a", "b"], [], 1.0) == [["a"], ["b"]]
    assert communities.modularity(["a", "b"], [("a", "b", 10.0), ("b", "a", 10.0)], 0.0) == [["a", "b"]]
    rng = random.Random(1)
    for _ in range(50):
        nodes = list(range(rng.randrange(1, 15)))
        found = communities.modularity(nodes, [(rng.choice(nodes), rng.choice(nodes), rng.random()) for _ in range(20)], 1.0)
        assert sorted(x for g in found for x in g) == nodes
        assert [g[0] for g in found] == sorted(g[0] for g in found)
    two = [(a, b, 1.0) for g in ((0, 1, 2, 3), (4, 5, 6, 7)) for a in g for b in g if a < b] + [(3, 4, 0.1)]
    assert communities.modularity(list(range(8)), two, 1.0) == [[0, 1, 2, 3], [4, 5, 6, 7]]


def test_linear_pieces():
    assert chunking.linear_pieces("") == [] and chunking.linear_pieces("  short ") == ["short"]
    assert chunking.linear_pieces("a" * 300 + "\n\n" + "b" * 300) == ["a" * 300, "b" * 300]
    sentences = " ".join("x" * 99 + "." for _ in range(30))
    sizes = [len(p) for p in chunking.linear_pieces(sentences)]
    assert len(sizes) == 27 and sizes[:3] == [403, 504, 605] and max(sizes) == 1312
    assert ChunkConfig().overlap_units == 12
    forced = chunking.linear_pieces("Hello " + "a" * 600)
    assert all(0 < len(p) <= 500 for p in forced) and forced[-1].endswith("a")
    words = " ".join("w" * 9 for _ in range(200))
    assert all(len(p) <= 500 for p in chunking.forced_pieces(words))


def test_units_and_chunks(spark):
    docs = spark.createDataFrame([("d", "One two. " * 60 + "\n\nShort one."), ("e", ""), ("f", None)], "id string, content string")
    rows = chunking.text_units(docs).orderBy("index").collect()
    assert [r["unit_type"] for r in rows] == ["sentence"] * 60 + ["paragraph"]
    assert rows[-1]["unit_id"] == "d_unit_60"
    u = units(spark, 4)
    e = graph.structural_edges(u)
    chunks = chunking.graph_chunks(u, e).collect()
    assert sorted(x for c in chunks for x in c["unit_ids"]) == ["u0", "u1", "u2", "u3"]
    assert all(c["content"] == " ".join(f"text {i[1:]}" for i in c["unit_ids"]) for c in chunks)
    adj = graph.chunk_adjacency(e, spark.createDataFrame([("u0", "A"), ("u1", "A"), ("u2", "B"), ("u3", "B")], "unit_id string, chunk_id string"))
    assert {r["chunk_id"]: [(c["chunk_id"], c["weight"]) for c in r["connected_chunk_ids"]] for r in graph.connected(adj).collect()} == {"A": [("B", 1.0)], "B": [("A", 1.0)]}


def test_dedup_and_hybrid(spark):
    rows = spark.createDataFrame([("d", 0.9, "A  b", 1), ("d", 0.8, "a B", 2)], "doc string, score double, text string, seq int")
    assert [r["score"] for r in retrieval.dedup_chunks(rows, "doc", "text", "seq").collect()] == [0.9]
    assert abs(one(spark, V.hybrid_score(F.lit(0.5), F.lit(1.0), 0.1)) - 0.55) < 1e-12
    assert one(spark, V.keyword_score(F.lit("The cat, naïve."), F.array(F.lit("cat"), F.lit("naïve"), F.lit("na")))) == pytest.approx(2 / 3)
    assert one(spark, V.cosine(F.array().cast("array<double>"), F.array(F.lit(1.0)))) == 0.0


def test_text_functions(spark):
    assert one(spark, T.content_hash(F.lit(" a \n b "))) == one(spark, F.sha2(F.lit("a b"), 256))
    assert one(spark, T.normalize_ocr(F.lit("see a cat"))) == "see acat"
    assert one(spark, T.strip_tags(F.lit("<thinking>x\ny</thinking> a <REASONING>b"))) == "a"
    assert one(spark, T.strip_leading_ref(F.lit("job 2:11 - text"), F.lit("Job 2:11"))) == "text"
    assert one(spark, T.citations(F.lit("[Job 2:11] [2 Kings 3] [Mark 4]"))) == ["Job 2:11", "Mark 4"]
    assert one(spark, T.chapter_info(F.lit("x\nChapter 3: on"))) == "Chapter 3:"
    assert one(spark, T.chapter_info(F.lit("THE BIG TITLE\nbody"))) == "The Big Title"
    assert one(spark, T.chapter_info(F.lit("plain"))) is None
    assert one(spark, T.book_title(F.lit("my_book-one.pdf"))) == "my book one"
    assert not one(spark, T.is_text(F.lit("%PDF-1.4"))) and not one(spark, T.is_text(F.lit(" "))) and one(spark, T.is_text(F.lit("ok")))
    assert one(spark, T.query_terms(F.lit("The big the Été"))) == ["the", "big", "été"]


def test_locations(spark):
    n = F.lit(None).cast("string")
    assert one(spark, L.format_location(F.lit("Job"), F.lit("2"), F.lit("11"), n)) == "Job 2:11"
    assert one(spark, L.format_location(F.lit("Job"), n, n, F.lit("s"))) == "Job s" and one(spark, L.format_location(n, F.lit("2"), n, n)) == ""
    code = one(spark, L.chapter_id(F.lit("h"), F.lit("a#page=3"), F.lit("B"), F.lit("C")))
    assert json.loads(one(spark, L.decode_chapter_id(F.lit(code)))) == {"h": "h", "s": "a", "b": "B", "c": "C"}
    assert one(spark, L.categories(F.lit("GDPR"), F.lit("c"), F.lit("s"), n, F.lit(None).cast("array<string>"))) == ["GDPR", "c", "s"]


def test_urls(spark):
    for given, want in (("https://www.example.com/path", "https://example.com/path"), ("https://example.com", "https://example.com/"), ("HTTP://A.b/c/?q#f", "http://a.b/c"), ("ftp://x/y", "ftp://x/y")):
        assert one(spark, U.canonical_url(F.lit(given))) == want
    assert one(spark, U.resolve_url(F.lit("https://a.b/c/d"), F.lit("e?x"))) == "https://a.b/c/e"
    assert one(spark, U.resolve_url(F.lit("https://a.b/c/d"), F.lit("mailto:x"))) == ""
    assert one(spark, U.resolve_url(F.lit("https://a.b/c"), F.lit("http://www.q.r/"))) == "https://q.r/"


def test_storage(spark):
    old = spark.createDataFrame([("a", "d1", "x"), ("b", "d1", "y")], "id string, document_id string, content string")
    new = spark.createDataFrame([("b", "d2", "z"), ("c", "d2", "w")], old.schema)
    assert sorted(map(tuple, storage.upsert(old, new).collect())) == [("a", "d1", "x"), ("b", "d2", "z"), ("c", "d2", "w")]
    assert sorted(map(tuple, storage.merge(old, new, "id", ("document_id",)).collect())) == [("a", "d1", "x"), ("b", "d1", "z"), ("c", "d2", "w")]
    assert storage.delete_documents(old, spark.createDataFrame([("d1",)], "document_id string")).count() == 0
    assert one(spark, storage.metadata_set(F.create_map(F.lit("a"), F.lit("1")), "a", F.lit("2"))) == {"a": "2"}


def test_vector_search_and_embedding(spark):
    m = np.zeros((3, 384), np.float32)
    m[0, 0], m[1, 0], m[2, 0] = 1.0, 0.5, 0.3
    rows = spark.createDataFrame([(str(k), v.tolist()) for k, v in enumerate(m)], "chunk_id string, embedding array<float>")
    q = [1.0] + [0.0] * 383
    got = vector.top_k(vector.scored(rows, q), 3).collect()
    assert [r["chunk_id"] for r in got] == ["0", "1", "2"] and got[0]["score"] >= 0.9
    assert vector.top_k(vector.scored(rows.limit(0), q), 3).count() == 0
    texts = spark.createDataFrame([("a", "big cat"), ("b", "big cat"), ("c", None)], "id string, content string")
    e = {r["chunk_id"]: r["embedding"] for r in vector.embed(texts, vector.HashedWords()).collect()}
    assert e["a"] == e["b"] and len(e["c"]) == 384 and abs(sum(x * x for x in e["a"]) - 1) < 1e-5
    assert vector.HashedWords().encode([]).shape == (0, 384)


def test_recommend_with_expansion(spark):
    chunks = spark.createDataFrame([(f"c{k}", f"d{k // 3}", f"text number {k}", ["En"]) for k in range(9)], "id string, document_id string, content string, categories array<string>")
    vectors = spark.createDataFrame([(f"c{k}", [1.0 - k / 10, 0.1]) for k in range(9)], "chunk_id string, embedding array<float>")
    got = retrieval.recommend(chunks, vectors, [1.0, 0.0], ["number"], SearchConfig(top_k=2)).orderBy("rank").collect()
    assert [r["document_id"] for r in got] == ["d0", "d1"] and got[0]["best_chunk"] == "c0"
    adjacency = spark.createDataFrame([("c0", "c8", 0.9)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("c0",)], "id string")
    wide = {r["id"]: r["is_seed"] for r in retrieval.expand_candidates(chunks, seeds, adjacency, [F.col("id")]).collect()}
    assert wide == {"c0": True, "c1": False, "c8": False}
    assert {r["id"] for r in retrieval.expand_candidates(chunks, seeds, adjacency, [F.col("id")], intended=False).collect()} == {"c0", "c8"}
    assert retrieval.recommend(chunks, vectors, [1.0, 0.0], [], SearchConfig(), ["none"]).count() == 0


def test_pages(spark):
    rows = spark.createDataFrame([(k,) for k in range(1, 24)], "n int")
    got = retrieval.page_of(rows, 9, 10, F.col("n")).collect()
    assert [r["n"] for r in got] == [21, 22, 23] and {r["page"] for r in got} == {3}
    pages = spark.createDataFrame([(1, "Chapter 1"), (2, "Chapter 1"), (3, "Chapter 2"), (4, None)], "page int, chapter string")
    chosen = lambda *a: sorted(r["page"] for r in pdf.allowed_pages(pages, *a).collect())
    assert chosen(["Chapter 1"]) == [1, 2] and chosen(None, [1, 3]) == [1, 3] and chosen(["Chapter 1"], [1, 2]) == [1, 2] and chosen(["Nothing"]) == [1, 2, 3, 4]
    for spec, total, want in (("1,3,5", 10, [1, 3, 5]), ("1-3,5-7", 10, [1, 2, 3, 5, 6, 7]), ("1-100", 5, [1, 2, 3, 4, 5]), ("", 5, None), ("abc,xyz", 5, None), ("4-2", 9, [4])):
        assert one(spark, pdf.page_ranges(F.lit(spec), total)) == want
    rows = [(1, 0, 0.0, 50.0, 100.0, 60.0, "c"), (1, 1, 300.0, 0.0, 400.0, 10.0, "d"), (1, 2, 2.0, 0.0, 102.0, 10.0, "a"), (1, 3, 0.0, 5.0, 100.0, 6.0, " "), (1, 4, 4.0, 90.0, 104.0, 99.0, "e"), (1, 5, 302.0, 50.0, 402.0, 60.0, "f")]
    blocks = spark.createDataFrame(rows, "page int, block_no int, x0 double, y0 double, x1 double, y1 double, text string")
    assert [r["block_no"] for r in pdf.reading_order(blocks).orderBy("position").collect()] == [2, 0, 4, 1, 5]


def test_html(spark, tmp_path):
    title, heads, text = html.page_parts("<html><head><title>T &amp; U</title></head><body><nav>menu</nav><h1>Head <b>x</b></h1><article><p>One<br>two</p><script>no</script></article><footer>f</footer></body></html>")
    assert (title, heads, text) == ("T & U", ["Head x"], "One two")
    assert html.page_parts(None) == ("No Title", [], "")
    pages = spark.createDataFrame([(1, "https://www.a.b/x/", "<a href='/y'>1</a><a class=q href=\"https://c.d/z\">2</a><a href='mailto:q'>")], "page_id long, url string, html string")
    assert sorted(r["link"] for r in html.links(pages).collect()) == ["https://a.b/y", "https://c.d/z"]
    assert [r["link"] for r in html.internal_links(pages).collect()] == ["https://a.b/y"]
    assert [r["url"] for r in html.allowed(spark.createDataFrame([("https://a.b/x",), ("https://a.b/no/y",)], "url string"), "User-agent: *\nDisallow: /no").collect()] == ["https://a.b/x"]


def test_json_files(spark, tmp_path):
    items = [{"url": "https://example.com/test", "title": "T", "body": "This is a test document." * 10}, {"id": "2", "source": "s", "content": "%PDF x"}, {"id": "3", "content": "ok", "headers": ["b", "c"]}]
    (tmp_path / "a.json").write_text(json.dumps(items))
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, items)))
    for name in ("a.json", "l.json"):
        rows = {r["source"]: r for r in files.documents_from_json(spark, str(tmp_path / name)).collect()}
        assert set(rows) == {"https://example.com/test", ""}
        assert (rows[""]["book"], rows[""]["chapter"], rows[""]["verse"]) == ("b", "c", None)
    (tmp_path / "e.json").write_text("[]")
    with pytest.raises(ValueError):
        files.documents_from_json(spark, str(tmp_path / "e.json"))
    (tmp_path / "c.json").write_text(json.dumps({"id": "c1", "document_id": "d", "content": "x"}))
    row = files.chunks_from_json(spark, str(tmp_path / "c.json")).first()
    assert row["unit_ids"] == [] and row["graph_id"] is None


def test_context_and_citations(spark):
    results = spark.createDataFrame([(1, "Job 2", ["Job 2 - a  b", ""]), (2, "", ["c"]), (3, "x", [" "])], "position int, location string, chunks array<string>")
    assert rag.format_context(results).first()["context"] == "[Job 2]\na b\n\n---\n\n[2]\nc"
    assert rag.format_context(results.limit(0)).first()["context"] == rag.NO_CONTEXT
    assert rag.ask("why?", results.limit(0), rag.Extractive()) == rag.NO_ANSWER == "No relevant information found in the database."
    assert rag.NO_CONTEXT == "No relevant context found."
    assert "[Job 2]" in rag.ask("why?", results, rag.Extractive())
    sources = spark.createDataFrame([("q", k, [f"Job {k}"]) for k in range(8)], "answer_id string, position int, refs array<string>")
    answer = lambda t: spark.createDataFrame([("q", t)], "answer_id string, text string")
    assert [(r["position"], r["cited"]) for r in rag.cited_sources(answer("[Job 2] and [Job 1]"), sources).collect()] == [(1, True), (2, True)]
    assert [r["position"] for r in rag.cited_sources(answer("none"), sources).collect()] == [0, 1, 2, 3, 4]


def test_session_stream(spark, tmp_path):
    """Batches without data, which processing-time timeouts ask for without end, are off, so that the stream ends with its input."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    schema = "session_id string, role string, content string"
    for k in range(3):
        rows = [("s", role, f"{k}{i}") for i in range(4) for role in ("user", "assistant")] + [("t", "user", str(k))]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sessions.stream_histories(stream).writeStream.outputMode("update").format("memory").queryName("histories").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert q.awaitTermination(120)
    most = {r["session_id"]: r["n"] for r in spark.sql("SELECT session_id, max(n) AS n FROM histories GROUP BY session_id").collect()}
    assert most == {"s": 20, "t": 3}


def test_communities_follow_unit_numbers(spark):
    """More than ten units: edges are visited by the units' numbers, not by their ids as text."""
    ids = [f"d_unit_{k}" for k in range(14)]
    units = spark.createDataFrame([("d", u, k) for k, u in enumerate(ids)], "document_id string, unit_id string, index int")
    pairs = [(a, b) for a in range(14) for b in range(14) if a != b and (a * b + a) % 5 == 1] + [(k, k + 1) for k in range(13)]
    edges = spark.createDataFrame([("d", ids[a], ids[b], "keyword", 0.5) for a, b in reversed(pairs)], "document_id string, src string, dst string, edge_type string, weight double")
    want = communities.modularity(ids, [(ids[a], ids[b], 0.5) for a, b in sorted(pairs)], GraphConfig().resolution)
    rows = chunking.communities(units, edges).collect()
    got = [sorted((r["unit_id"] for r in rows if r["community"] == k), key=ids.index) for k in range(len(want))]
    assert got == [sorted(g, key=ids.index) for g in want]
