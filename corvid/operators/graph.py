"""Edges between text units, adjacency between chunks, and expansion along it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions.text import significant_tokens


def keyword_top(units: DataFrame, id_cols: str | list[str], tokens, n: int, longest_first: bool = False) -> DataFrame:
    """(*ids, word, count, rank): a text's n most frequent tokens; among equals the longer first, if asked, then the first used."""
    ids = [id_cols] if isinstance(id_cols, str) else id_cols
    words = units.select(*ids, F.posexplode(tokens).alias("pos", "word")).groupBy(*ids, "word").agg(F.count("*").alias("count"), F.min("pos").alias("first"))
    order = [F.col("count").desc(), *([F.length("word").desc()] if longest_first else []), F.col("first")]
    return words.withColumn("rank", F.row_number().over(Window.partitionBy(*ids).orderBy(*order))).where(F.col("rank") <= n).select(*ids, "word", "count", "rank")


def unit_keywords(units: DataFrame, n: int = 12) -> DataFrame:
    """(document_id, unit_id, word, count, rank)"""
    return keyword_top(units.select("document_id", "unit_id", "text"), ["document_id", "unit_id"], significant_tokens(F.col("text")), n, longest_first=True)


def structural_edges(units: DataFrame) -> DataFrame:
    """Both directions between a unit and the next, weight 1."""
    nxt = F.lead("unit_id").over(Window.partitionBy("document_id").orderBy("index"))
    pairs = units.select("document_id", F.col("unit_id").alias("a"), nxt.alias("b")).where("b is not null")
    both = pairs.select("document_id", F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"))
    return both.select("document_id", "e.src", "e.dst", F.lit("structural").alias("edge_type"), F.lit(1.0).alias("weight"))


def hierarchical_edges(units: DataFrame, section: str = "section") -> DataFrame:
    """From a unit to the next of its section, weight 0.5; a null section is the root's."""
    nxt = F.lead("unit_id").over(Window.partitionBy("document_id", F.coalesce(section, F.lit("root"))).orderBy("index"))
    return units.select("document_id", F.col("unit_id").alias("src"), nxt.alias("dst"), F.lit("hierarchical").alias("edge_type"), F.lit(0.5).alias("weight")).where("dst is not null")


def keyword_edges(keywords: DataFrame, min_shared: int = 3, max_per_unit: int = 5) -> DataFrame:
    """Of (document_id, unit_id, word): from each unit to the max_per_unit others with the most shared words, ties to the later id."""
    a, b = keywords.alias("a"), keywords.alias("b")
    same = (F.col("a.document_id") == F.col("b.document_id")) & (F.col("a.word") == F.col("b.word")) & (F.col("a.unit_id") < F.col("b.unit_id"))
    once = a.join(b, same).groupBy(F.col("a.document_id").alias("document_id"), F.col("a.unit_id").alias("src"), F.col("b.unit_id").alias("dst")).agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    shared = once.select("document_id", "shared", both.alias("e")).select("document_id", "e.src", "e.dst", "shared")
    best = Window.partitionBy("src").orderBy(F.col("shared").desc(), F.col("dst").desc())
    kept = shared.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= max_per_unit)
    return kept.select("document_id", "src", "dst", F.lit("keyword").alias("edge_type"), F.round(F.least(F.lit(0.6), 0.3 + 0.1 * F.col("shared")), 6).alias("weight"))


def unit_degree(edges: DataFrame) -> DataFrame:
    ends = edges.select("document_id", F.explode(F.array("src", "dst")).alias("unit_id"), "weight")
    return ends.groupBy("document_id", "unit_id").agg(F.round(F.sum("weight"), 6).alias("degree"))


def chunk_adjacency(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst, weight) between the chunks (unit_id, chunk_id) of edges' units: the largest weight, no loops."""
    s = members.select(F.col("unit_id").alias("src"), F.col("chunk_id").alias("a"))
    d = members.select(F.col("unit_id").alias("dst"), F.col("chunk_id").alias("b"))
    return edges.select("src", "dst", "weight").join(s, "src").join(d, "dst").where("a != b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.max("weight").alias("weight"))


def connected(adjacency: DataFrame) -> DataFrame:
    """(chunk_id, connected_chunk_ids) by falling weight, then id."""
    order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("dst").alias("chunk_id")))), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), (-x["w"]).alias("weight")))
    return adjacency.groupBy(F.col("src").alias("chunk_id")).agg(order.alias("connected_chunk_ids"))


def expand(adjacency: DataFrame | Callable[[DataFrame], DataFrame], seeds: DataFrame, hops: int = 2, least: float | None = 0.5) -> DataFrame:
    """(id, hop): what edges (src, dst, weight), those not under the least weight, reach from the seeds (id) in so many hops; seeds have hop 0.

    The adjacency is a table of edges, or makes those of a front (id) when they are needed.
    """
    seen = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        edges = adjacency(front) if callable(adjacency) else adjacency
        kept = (edges if least is None else edges.where(F.col("weight") >= least)).select("src", "dst")
        reached = kept if callable(adjacency) else front.join(kept, front["id"] == kept["src"])
        front = reached.select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """Units within so many undirected hops of the seeds, seeds themselves left out."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0)).distinct()
    return expand(both, seeds, hops, None).where("hop > 0")
