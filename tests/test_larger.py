"""What larger tables brought up: queries on small tables with large keys, and plans against plain models."""

import math
import random

import __spark_entry__  # noqa: F401  it registers the queries
import duckdb
import numpy as np
from corvid.operators import chunking, graph, rag, vector
from corvid.plans.catalog import ORACLES, QUERIES
from pyspark.sql import functions as F


def test_format_bytes_of_large_keys(spark, tmp_path):
    keys = [5_999_999, 3_037_000_500, 31]
    spark.createDataFrame([(k,) for k in keys], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r["size"] for r in QUERIES["format_bytes"](spark, str(tmp_path)).collect()}
    assert got == {k: f"{k * k * (1 + 100000 * (k % 4)) / 1024**p:.1f}{unit}" for k, p, unit in zip(keys, (4, 4, 2), ("TB", "TB", "MB"))}


def test_context_streams_by(spark, tmp_path):
    """No group's texts are gathered in a row; empty results count as positions, groups of nothing else have no row, as in the SQL, and a null id comes last."""
    rows = [(6, " ", "fr", "s"), (5, "five  5", "en", "s"), (11, None, "en", "s"), (17, "src", "en", "s"), (None, "x", "en", "s"), (23, "null", None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["format_context"](spark, str(tmp_path))
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    sql = duckdb.connect()
    sql.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, by_lang = {tuple(r) for r in out.collect()}, lambda r: str(r[0])
    assert sorted(got, key=by_lang) == sorted(sql.sql(ORACLES["format_context"]).fetchall(), key=by_lang) and len(got) == 2
    whole = spark.createDataFrame([("a", k, "" if k % 3 else "Job 2", [f"t{k}", " "] if k % 4 else []) for k in range(1, 9)] + [("b", 1, None, [""])], "g string, position int, location string, chunks array<string>")
    want = {tuple(r) for r in rag.format_context(whole, "g").select("g", F.md5("context")).collect()}
    assert {(r["g"], r["context_md5"]) for r in rag.context_md5(whole.repartition(3), "g", F.col("position")).collect()} == want


def alike(rows, threshold):
    """(document, i, j, weight) of all pairs of rows (document, id, index, vector), one at a time."""
    out = set()
    for d, u, i, x in rows:
        for e, v, j, y in rows:
            if d is None or d != e or x is None or y is None or not i < j:
                continue
            if len(x) != len(y):
                w = 0.0
            elif None in x or None in y:
                continue
            else:
                norm = math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(a * a for a in y))
                w = sum(a * b for a, b in zip(x, y)) / norm if norm else 0.0
            if round(w, 6) >= threshold:
                out.add((d, u, v, round(w, 6)))
    return out


def test_semantic_edges_by_blocks(spark, monkeypatch):
    """Blocks meet each other and themselves once; odd vectors keep what pairs of rows give; no row is joined to a row."""
    rng = random.Random(5)
    rows = [("abc"[k % 3] if k % 7 else "a", f"u{k}", k // 2 if k < 4 else k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(60)]
    rows += [("a", "short", 100, [1.0]), ("a", "zero", 101, [0.0] * 4), ("a", "hole", 102, [None, 1.0, 0.0, 0.0]), ("a", "none", 103, None), (None, "lost", 104, [1.0] * 4), ("a", "empty", 105, [])]
    units = spark.createDataFrame(rows, "document_id string, unit_id string, index int, embedding array<float>")
    rows = [(d, u, i, x and [a if a is None else float(np.float32(a)) for a in x]) for d, u, i, x in rows]
    assert "CartesianProduct" not in (plan := vector.semantic_edges(units, 0.3)._jdf.queryExecution().executedPlan().toString()) and "MapInArrow" in plan
    for block in (1024, 5):
        monkeypatch.setattr(vector, "BLOCK", block)
        for threshold in (0.3, -0.2):
            got = [tuple(r) for r in vector.semantic_edges(units, threshold).collect()]
            assert len(got) == len(set(got)) and set(got) == alike(rows, threshold)


def test_expansion_by_fronts(spark, monkeypatch, tmp_path):
    """A front meets its own documents alone; what it reaches is what all pairs would."""
    monkeypatch.setattr(vector, "BLOCK", 4)
    rng = random.Random(6)
    rows = [(k, [rng.gauss(0, 1) for _ in range(6)], k % 4) for k in range(50)] + [(50, None, 1), (51, [0.0] * 6, 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    units = table.select(F.col("label").alias("document_id"), F.col("vec_id").alias("unit_id"), F.col("vec_id").alias("index"), "embedding")
    front = spark.createDataFrame([(0,), (13,), (13,), (50,), (99,)], "id long")
    one = {(r["src"], r["dst"], r["weight"]) for r in vector.semantic_edges(units, 0.2).collect()}
    both = one | {(b, a, w) for a, b, w in one}
    got = [tuple(r) for r in vector.edges_from(units, 0.2)(front).collect()]
    assert len(got) == len(set(got)) and set(got) == {e for e in both if e[0] in (0, 13)}
    whole = graph.expand(spark.createDataFrame(sorted(both), "src long, dst long, weight double"), front, 2, 0.25).collect()
    assert sorted(map(tuple, graph.expand(vector.edges_from(units, 0.2), front, 2, 0.25).collect())) == sorted(map(tuple, whole))
    monkeypatch.setattr(vector, "semantic_edges", None)
    table.where("embedding is not null").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert all(QUERIES[name](spark, str(tmp_path)).count() >= 4 for name in ("graph_expand", "expand_candidates"))


def test_graph_chunks_of_documents(spark):
    """No row leaves its document, and the chunks are those of tables of units and edges."""
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("north", "città", "Über", "this", "town", "bread") for b in ("", "ward", "land", "2")]
    line = lambda: " ".join(rng.choice(words) + rng.choice(("", "", ".", "?")) for _ in range(rng.choice((2, 9, 90))))
    docs = [(str(k), "\n".join(line() for _ in range(rng.choice((1, 4, 14))))) for k in range(12)] + [("e", ""), ("n", None), (None, "lost words here"), ("b", " \n \n a. \n\n.\n")]
    docs = spark.createDataFrame(docs, "id string, content string")
    u = chunking.text_units(docs, "\n")
    e = graph.structural_edges(u).unionByName(graph.hierarchical_edges(u.withColumn("section", F.lit(None).cast("string")))).unionByName(graph.keyword_edges(graph.unit_keywords(u)))
    assert e.where("edge_type = 'keyword'").count() > 50
    out = chunking.graph_chunks_of(docs, "\n")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, chunking.graph_chunks(u, e).collect()))
    assert "Exchange" not in QUERIES["graph_chunks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
