"""From documents to stored chunks and vectors, in batches, streams and again with graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvid.config import ChunkConfig, GraphConfig, SearchConfig
from corvid.functions import location as L
from corvid.functions.text import content_hash, document_hash, query_terms
from corvid.operators import chunking, graph, rag, retrieval, vector
from corvid.operators.store import Store

_PARTS = ("book", "chapter", "verse", "section")


def unit_graph(units: DataFrame, embedder: vector.Embedder | None, config: GraphConfig) -> DataFrame:
    """All edges of text units; those by meaning only with an embedder."""
    edges = graph.structural_edges(units).unionByName(graph.hierarchical_edges(units.withColumn("section", F.lit(None).cast("string"))))
    edges = edges.unionByName(graph.keyword_edges(graph.unit_keywords(units), config.min_shared, config.max_per_unit))
    if embedder is None:
        return edges
    vectors = vector.embed(units.select(F.col("unit_id").alias("id"), F.col("text").alias("content")), embedder).withColumnRenamed("chunk_id", "unit_id")
    alike = vector.semantic_edges(units.join(vectors, "unit_id"), config.semantic_threshold)
    return edges.unionByName(alike.withColumn("edge_type", F.lit("semantic")))


def described(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with their document's metadata, path, categories (keywords where there are none) and hashes. Documents' texts are not shuffled, only hashes of them."""
    none = F.array().cast("array<string>")
    about = docs.select(F.col("id").alias("document_id"), "source", "title", *_PARTS, content_hash(F.col("content")).alias("source_hash"), document_hash(F.col("title"), F.col("content")).alias("document_hash"))
    rows = chunks.join(about, "document_id", "left")
    rows = rows.withColumns({"path": L.chunk_path(F.col("title"), F.col("book"), F.col("chapter"), F.col("verse"), none), "categories": L.categories(F.col("book"), F.col("chapter"), F.col("section"), F.col("verse"), none)})
    return chunking.filled_categories(rows)


def chunk_documents(docs: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Linear chunks of documents (id, source, title, content, book, chapter, verse, section), described."""
    return described(chunking.linear_chunks(docs, config).withColumn("graph_id", F.lit(None).cast("string")), docs)


def one_of_each(docs: DataFrame) -> DataFrame:
    """A row for each id: of several, the smallest by their columns, whatever the order of rows."""
    rest = [c for c in docs.columns if c != "id"]
    return docs.groupBy("id").agg(F.min(F.struct(*rest)).alias("_r")).select("id", "_r.*")


def store_vectors(store: Store, chunks: DataFrame, embedder: vector.Embedder, gone: DataFrame | None = None) -> int:
    """Embeds written chunks and stores the vectors; an error unless there is one for each."""
    made = store.upsert("embeddings", vector.embed(chunks, embedder), gone)
    n, want = made.where(F.size("embedding") == embedder.dim).count(), chunks.count()
    if n != want:
        raise ValueError(f"{n} vectors of {embedder.dim} components for {want} chunks")
    return n


def ingest(store: Store, docs: DataFrame, embedder: vector.Embedder, config: ChunkConfig = ChunkConfig()) -> dict[str, int]:
    """Stores documents, their chunks and vectors, each table in one write; chunks that a new version of a document no longer has go. Returns how many of each were written."""
    written = store.upsert("documents", one_of_each(docs))
    made = store.scratch(chunk_documents(written, config))
    old = store.read("chunks").join(written.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("id")
    gone = store.scratch(old.join(made.select("id"), "id", "left_anti"))
    chunks = store.upsert("chunks", made, gone)
    out = {"documents": written.count(), "chunks": chunks.count(), "embeddings": store_vectors(store, chunks, embedder, gone.withColumnRenamed("id", "chunk_id"))}
    store.swept()
    return out


def ingest_stream(store: Store, docs: DataFrame, embedder: vector.Embedder, checkpoint: str, config: ChunkConfig = ChunkConfig()) -> StreamingQuery:
    """Ingests a stream of documents by micro-batch until its input ends. A batch that runs again after a loss writes the same rows over themselves."""
    writer = docs.writeStream.foreachBatch(lambda batch, _: ingest(store, batch, embedder, config) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def regraph(store: Store, embedder: vector.Embedder, config: GraphConfig = GraphConfig(), force: bool = False, semantic: bool = False) -> dict:
    """Rebuilds documents from their chunks, groups their units by the whole graph, and replaces their chunks and vectors. Returns the run's counts."""
    docs, chunks = store.read("documents"), store.read("chunks")
    todo = store.scratch(chunking.regraph_candidates(docs.select("id"), chunks, force))
    own = chunks.join(todo.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    rebuilt = chunking.rejoined(own).withColumnRenamed("document_id", "id")
    units = store.scratch(chunking.text_units(rebuilt))
    made = chunking.graph_chunks(units, unit_graph(units, embedder if semantic else None, config), config)
    made = made.withColumn("chunk_index", F.substring_index("id", "_graph_", -1).cast("int"))
    made = store.scratch(described(made, docs))
    gone = store.scratch(own.select("id").join(made.select("id"), "id", "left_anti"))
    new = store.upsert("chunks", made, gone)
    store_vectors(store, new, embedder, gone.withColumnRenamed("id", "chunk_id"))
    stats = chunking.regraph_stats(docs, todo, new).first().asDict()
    store.swept()
    return stats


def found(store: Store, query: str, embedder: vector.Embedder, config: SearchConfig = SearchConfig(), categories: list[str] | None = None) -> DataFrame:
    """(position, document_id, score, location, chunks): the documents a query finds with the texts of their best chunks."""
    chunks = store.read("chunks")
    terms = store.spark.range(1).select(query_terms(F.lit(query)).alias("t")).first()["t"]
    vectors = store.read("embeddings")
    ranked = retrieval.recommend(chunks.select("id", "document_id", "content", "categories"), vectors, [float(x) for x in embedder.encode([query])[0]], terms, config, categories)
    each = ranked.select("document_id", "score", F.col("rank").alias("position"), F.posexplode("chunks").alias("n", "id"))
    rows = chunks.select("id", "content", L.format_location(*(F.col(c) for c in _PARTS)).alias("location")).join(F.broadcast(each), "id")
    out = rows.groupBy("position", "document_id", "score").agg(F.array_sort(F.collect_list(F.struct("n", "content", "location"))).alias("c"))
    return out.select("position", "document_id", "score", F.col("c")[0]["location"].alias("location"), F.transform("c", lambda x: x["content"]).alias("chunks"))


def ask(store: Store, query: str, embedder: vector.Embedder, generator: rag.Generator, history: list[dict] | None = None, config: SearchConfig = SearchConfig()) -> dict:
    """Finds, generates with the history, and cites: {"answer", "sources"}; at most top_k documents reach the driver."""
    results = store.scratch(found(store, query, embedder, config))
    answer = rag.ask(query, results, generator, history=history)
    said = store.spark.range(1).select(F.lit("a").alias("answer_id"), F.lit(answer).alias("text"))
    refs = results.select(F.lit("a").alias("answer_id"), "position", F.array("location").alias("refs"))
    cited = rag.cited_sources(said, refs)
    rows = cited.join(results, "position").select("position", "document_id", "location", "score", "cited").orderBy("position").collect()
    out = {"answer": answer, "sources": [] if answer == rag.NO_ANSWER else [r.asDict() for r in rows]}
    store.swept()
    return out


def stored_view(store: Store, document_id: str) -> DataFrame:
    """A stored document's chunks as they are shown, in order."""
    rows = store.read("chunks").where(F.col("document_id") == document_id)
    return retrieval.document_view(rows, "document_id", F.col("chunk_index").asc_nulls_last(), F.col("id"))
