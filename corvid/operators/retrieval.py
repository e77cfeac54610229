"""From scored chunks to ranked documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.config import GraphConfig, SearchConfig
from corvid.functions import location as L
from corvid.functions.text import clean_content, dedup_key
from corvid.functions.url import canonical_url
from corvid.functions.vectors import hybrid_score, keyword_score
from corvid.operators.graph import expand
from corvid.operators.vector import in_categories, scored, top_k


def dedup_chunks(rows: DataFrame, group: str, text: str, *seq: str) -> DataFrame:
    """Of a group's chunks with the same text but for case and white space, the one of the highest score, then the first."""
    w = Window.partitionBy(group, dedup_key(F.col(text))).orderBy(F.col("score").desc(), *seq)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def best_per_group(rows: DataFrame, group: str, k: int, *ties: str) -> DataFrame:
    """The k chunks of the highest score in each group, with their rank."""
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), *ties)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def group_by_document(rows: DataFrame, key: str, order: str, best: list[str], first: list[str]) -> DataFrame:
    """One row for each key: score, attributes of the best chunk (the first of the highest score), and those of the first chunk."""
    top = F.max_by(F.struct(*best), F.struct("score", (-F.col(order)).alias("o")))
    head = F.min_by(F.struct(*first), F.col(order))
    out = rows.groupBy(key).agg(F.max("score").alias("score"), F.count("*").alias("n_chunks"), top.alias("_b"), head.alias("_f"))
    return out.select(key, "score", "n_chunks", *(F.col(f"_b.{c}").alias(c) for c in best), *(F.col(f"_f.{c}").alias(f"first_{c}") for c in first))


def first_k(rows: DataFrame, key: str, k: int, order: str) -> DataFrame:
    """The first k chunks of each document in scan order, and the largest score of all of them."""
    w = Window.partitionBy(key)
    return rows.withColumn("doc_score", F.max("score").over(w)).withColumn("rank", F.row_number().over(w.orderBy(order))).where(F.col("rank") <= k)


def context_window(chunks: DataFrame, doc: str, order: list[Column], key: str = "id", width: int = 1) -> DataFrame:
    """Each chunk with the ids of those up to width before and after it in its document."""
    w = Window.partitionBy(doc).orderBy(*order).rowsBetween(-width, width)
    return chunks.withColumn("window_ids", F.collect_list(key).over(w))


def expand_candidates(chunks: DataFrame, seeds: DataFrame, adjacency: DataFrame | Callable[[DataFrame], DataFrame], order: list[Column], config: GraphConfig = GraphConfig(), intended: bool = True) -> DataFrame:
    """(id, is_seed): seeds, their neighbours in the text, and what the graph reaches.

    As intended, neighbours come from the whole document; otherwise only from among the seeds
    themselves, which adds none.
    """
    base = chunks if intended else chunks.join(seeds.select("id"), "id", "left_semi")
    around = context_window(base, "document_id", order).join(seeds.select("id"), "id", "left_semi").select(F.explode("window_ids").alias("id"))
    reached = expand(adjacency, seeds, config.hops, config.decay).select("id")
    every = seeds.select("id").unionByName(around).unionByName(reached).distinct()
    return every.join(seeds.select("id", F.lit(True).alias("is_seed")), "id", "left").select("id", F.coalesce("is_seed", F.lit(False)).alias("is_seed"))


def rank(chunks: DataFrame, candidates: DataFrame, scores: DataFrame, terms: list[str], config: SearchConfig, categories: list[str] | None = None) -> DataFrame:
    """Documents (document_id, score, best_chunk, chunks, rank) of chunks (id, document_id, content, categories).

    A candidate without a score counts 0. Seeds under min_score go, expanded chunks don't;
    then each document keeps its chunk_k best different texts, and the best documents that
    reach min_score stay.
    """
    rows = chunks.join(candidates, "id").join(scores.select("id", "score"), "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    if categories:
        rows = rows.where(in_categories(F.col("categories"), categories))
    if config.hybrid and terms:
        rows = rows.withColumn("score", hybrid_score(F.col("score"), keyword_score(F.col("content"), F.array(*map(F.lit, terms))), config.hybrid_weight))
    rows = rows.withColumn("score", F.round("score", 6)).where(~F.col("is_seed") | (F.col("score") >= config.min_score))
    kept = best_per_group(dedup_chunks(rows, "document_id", "content", "id"), "document_id", config.chunk_k, "id")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "id", "score", "content")))
    docs = kept.groupBy("document_id").agg(ordered.alias("c")).select("document_id", F.col("c")[0]["score"].alias("score"), F.col("c")[0]["id"].alias("best_chunk"), F.transform("c", lambda x: x["id"]).alias("chunks"))
    docs = docs.where(F.col("score") >= config.min_score).orderBy(F.col("score").desc(), "document_id").limit(config.top_k)
    return docs.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "document_id")))


def recommend(chunks: DataFrame, embeddings: DataFrame, query: list[float], terms: list[str], config: SearchConfig = SearchConfig(), categories: list[str] | None = None, adjacency: DataFrame | None = None, order: list[Column] | None = None) -> DataFrame:
    """Search end to end: over-fetched vector top-k (categories first), expansion if asked, ranking."""
    vectors = embeddings
    if categories:
        vectors = vectors.join(chunks.where(in_categories(F.col("categories"), categories)).select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    found = top_k(scored(vectors, query, config.score_mode, None).select("chunk_id", "score"), config.overfetch * config.top_k, config.min_score)
    # At most overfetch x top_k rows; what the graph reaches from them has no such bound and gets no hint.
    scores = F.broadcast(found.select(F.col("chunk_id").alias("id"), "score"))
    if config.expand and adjacency is not None:
        candidates = expand_candidates(chunks, scores, adjacency, order or [F.col("id")])
    else:
        candidates = scores.select("id", F.lit(True).alias("is_seed"))
    return rank(chunks, candidates, scores, terms, config, categories)


def page_of(results: DataFrame, page: int, size: int, *order: Column) -> DataFrame:
    """A page of ranked results with total, total_pages and the page after clamping. Only the rows up to its end are sorted into one task."""
    total = results.count()
    pages = max(1, -(-total // size))
    page = max(1, min(page, pages))
    head = results.orderBy(*order).limit(page * size).withColumn("position", F.row_number().over(Window.orderBy(*order))).where(F.col("position") > (page - 1) * size)
    return head.withColumns({"total": F.lit(total).cast("long"), "total_pages": F.lit(pages), "page": F.lit(page)})


def document_entry(rows: DataFrame) -> DataFrame:
    """What a found document shows, from its scored chunk (id, document_id, content, path, metadata map, headers, categories, score, and the metadata columns named below)."""
    shown = F.filter(F.coalesce("headers", F.array().cast("array<string>")), lambda h: F.trim(h) != "")
    part = {c: F.coalesce(L.given(F.col(c)), F.get(shown, F.lit(k))) for k, c in enumerate(("book", "chapter", "verse"))}
    return rows.select(
        F.col("document_id").alias("id"), canonical_url(F.coalesce("source", F.lit(""))).alias("source"), F.coalesce("title", F.lit("")).alias("title"), *(c.alias(n) for n, c in part.items()), "section", "path",
        L.location_map(**part).alias("location"), L.other_metadata(F.col("metadata")).alias("metadata"), F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), "score",
        F.col("content").alias("best_chunk"), F.array(F.struct("score", "content")).alias("chunks"),
    )


def document_view(chunks: DataFrame, document: str, *order: Column) -> DataFrame:
    """A document's chunks, numbered in order, with location, short reference and cleaned content."""
    loc = L.view_location(*(F.col(c) for c in ("book", "chapter", "verse", "section")))
    n = F.row_number().over(Window.partitionBy(document).orderBy(*order))
    return chunks.select("*", loc.alias("location"), L.short_ref(*(F.col(c) for c in ("chapter", "verse", "section"))).alias("ref"), n.alias("n")).withColumn("content", clean_content(F.col("content"), F.col("location")))
