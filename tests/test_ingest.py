"""Stored tables, ingest in batches and streams, graphs again, and answers."""

import json

import pytest
from corvid.__main__ import main
from corvid.config import ChunkConfig, Features, SearchConfig, SessionConfig, layered
from corvid.functions import text as T
from corvid.operators import ingest, rag, storage
from corvid.operators.store import Store
from corvid.operators.vector import HashedWords
from corvid.sources import files
from pyspark.sql import functions as F

DOCS = "id string, source string, title string, content string, book string, chapter string, verse string, section string"
WORDS = HashedWords(32)


def docs(spark, *rows):
    return spark.createDataFrame([(i, f"s/{i}", f"t {i}", text, book, "2", None, None) for i, text, book in rows], DOCS)


def long(word, n=8):
    return "\n\n".join(f"The {word} river bends {k} times under old bridges near {word} town. It never freezes over." for k in range(n))


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_store(spark, store):
    assert store.read("documents").count() == 0
    store.create()
    store.upsert("documents", docs(spark, ("a", "1", "B"), ("b", "2", "B")))
    store.upsert("documents", docs(spark, ("b", "3", "B"), ("c", "4", "B")))
    assert {r["id"]: r["content"] for r in store.read("documents").collect()} == {"a": "1", "b": "3", "c": "4"}
    store.delete("documents", spark.createDataFrame([("a",), ("zz",)], "id string"))
    assert ids(store.read("documents")) == ["b", "c"]
    store.compact("documents")
    store.upsert("documents", docs(spark, ("a", "5", "B")))
    store.compact("documents")
    assert ids(store.read("documents")) == ["a", "b", "c"]
    # A write that was cut short does not count.
    store.read("documents").where("id = 'a'").withColumn("_gone", F.lit(True)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{store.root}/documents/99999999")
    assert ids(store.read("documents")) == ["a", "b", "c"]
    store.clear()
    assert store.read("documents").count() == 0
    built = store.load_or_build("embeddings", lambda: spark.createDataFrame([("x", [1.0])], "chunk_id string, embedding array<float>"), lambda d: True)
    assert built.count() == 1
    assert store.load_or_build("embeddings", lambda: built.limit(0), lambda d: True).count() == 1


def test_ingest(spark, store):
    first = docs(spark, ("a", long("north"), "Job"), ("b", long("south"), None), ("b", long("south"), None), ("e", "", "X"), ("n", None, None))
    n = ingest.ingest(store, first, WORDS)
    assert n["documents"] == 4 and n["chunks"] == n["embeddings"] == store.read("chunks").count() > 2
    assert ids(store.read("chunks")) == ids(store.read("embeddings"), "chunk_id")
    rows = {r["id"]: r for r in store.read("chunks").collect()}
    assert rows["a_chunk_0"]["path"] == ["t a", "Job", "2"] and rows["a_chunk_0"]["categories"] == ["Job", "2"]
    # A shorter version leaves none of the old chunks behind; other documents stay.
    ingest.ingest(store, docs(spark, ("a", "Now short.", "Job")), WORDS)
    again = store.read("chunks")
    assert ids(again.where("document_id = 'a'")) == ["a_chunk_0"] and again.where("document_id = 'b'").count() == sum(r["document_id"] == "b" for r in rows.values())
    assert ids(again) == ids(store.read("embeddings"), "chunk_id")


def test_keywords_stand_in_for_categories(spark):
    rows = spark.createDataFrame([("a", "dog cat cat bird bird bird", []), ("b", "dog", ["x"]), ("c", "", [])], "id string, content string, categories array<string>")
    from corvid.operators.chunking import filled_categories

    assert {r["id"]: r["categories"] for r in filled_categories(rows).collect()} == {"a": ["bird", "cat", "dog"], "b": ["x"], "c": []}


def test_stream(spark, store, tmp_path):
    for k, d in enumerate("abc"):
        docs(spark, (d, long(d), "B")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(DOCS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ingest.ingest_stream(store, stream, WORDS, str(tmp_path / "cp"))
    assert q.awaitTermination(240) and q.exception() is None
    assert ids(store.read("documents")) == ["a", "b", "c"] and ids(store.read("chunks")) == ids(store.read("embeddings"), "chunk_id")


def test_regraph_and_ask(spark, store):
    ingest.ingest(store, docs(spark, ("a", long("north"), "Job"), ("b", long("south"), "Ruth"), ("e", "", None)), WORDS)
    stats = ingest.regraph(store, WORDS, semantic=True)
    chunks = store.read("chunks")
    assert stats["processed"] == 2 and stats["skipped"] == 1 and stats["total_chunks"] == chunks.count()
    assert all(r["graph_id"] == r["id"] for r in chunks.collect()) and ids(chunks) == ids(store.read("embeddings"), "chunk_id")
    assert ingest.regraph(store, WORDS)["processed"] == 0
    heard = []

    class Model:
        def generate(self, messages):
            heard.extend(messages)
            return "It bends [Ruth 2]."

    out = ingest.ask(store, "Where does the south river bend?", WORDS, Model(), [{"role": "user", "content": "Hi"}, {"role": "tool", "content": "no"}], SearchConfig(top_k=2))
    assert [m["content"] for m in heard[1:-1]] == ["Hi"] and "Question: Where" in heard[-1]["content"]
    assert [(s["location"], s["cited"]) for s in out["sources"]] == [("Ruth 2", True)]
    assert [r["n"] for r in ingest.stored_view(store, "a").orderBy("n").collect()] == list(range(1, chunks.where("document_id = 'a'").count() + 1))
    store.clear()
    assert ingest.ask(store, "Anything?", WORDS, Model()) == {"answer": rag.NO_ANSWER, "sources": []}


def test_command_line(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"id": "a", "title": "A", "content": long("north"), "book": "Job", "chapter": "1"}, {"id": "b", "title": "B", "content": long("south"), "book": "Ruth", "chapter": "4"}]))
    run = lambda *a: main(["--root", str(tmp_path / "s"), *a], spark)
    assert run("ingest", str(tmp_path / "d.json"))["documents"] == 2
    assert run("search", "north town")[0]["document_id"] == "a"
    assert run("ask", "north town")["sources"]
    assert run("view", "b")[0]["location"] == "Ruth 4"
    run("export", "chunks", str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() > 2
    with pytest.raises(SystemExit):
        run("clear")
    run("clear", "--yes")
    assert run("search", "north town") == []


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"chunk": {"size": 300, "overlap": "x"}, "features": {"ask": false}}')
    assert layered(ChunkConfig, str(tmp_path / "c.json"), {"CORVID_CHUNK_SIZE": "700"}) == ChunkConfig(700, 50)
    assert layered(SessionConfig, None, {}) == SessionConfig()
    with pytest.raises(PermissionError):
        layered(Features, str(tmp_path / "c.json"), {}).require("ask")


def test_small_forms(spark, tmp_path):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(T.format_bytes(F.lit(256 * 5))) == "1.2KB" and one(T.format_bytes(F.lit(1023))) == "1023.0B" and one(T.format_bytes(F.lit(1 << 52))) == "4096.0TB"
    assert one(T.normalized_path(F.array(F.lit(" ﬁne É "), F.lit(""), F.lit(None).cast("string")))) == ["fine e\u0301"]
    assert list(rag.clean_pieces(["a<thinking>x</REASONING>", "<reasoning>y</reasoning>", "<thinking>z"])) == ["a", "<thinking>z"]
    with pytest.raises(ValueError):
        rag.provider("none")
    (tmp_path / "c.jsonl").write_text('{"id": "x", "content": 1}\n{"id": "y"}\n')
    assert ids(files.chunk_ids(spark, str(tmp_path / "c.jsonl"))) == ["x", "y"]
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(10).write.jdbc(url, "numbers", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    assert files.read_table(spark, url, "numbers", "id", (0, 10), 3, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").count() == 10
    base = spark.createDataFrame([("m", 3)], "title string, page int")
    assert storage.overlaid(base, {"n": F.lit(1)}, {"title": F.lit(""), "page": F.lit(0), "book": F.lit("B")}).first().asDict() == {"title": "m", "page": 3, "n": 1, "book": "B"}
