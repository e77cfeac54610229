"""Documents to chunks: text units, linear splitting, and communities of a unit graph."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.config import ChunkConfig, GraphConfig
from corvid.functions.text import keyword_tokens, sentences, significant_tokens
from corvid.operators import communities as C
from corvid.operators.graph import keyword_top

_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def text_units(docs: DataFrame, separator: str = "\n\n", long: int = 400) -> DataFrame:
    """(document_id, unit_id, text, unit_type, index) of (id, content): a segment between separators is a paragraph unit, or sentence units if it is long and has several."""
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    seg = docs.select(F.col("id").alias("document_id"), F.posexplode(F.split(F.coalesce("content", F.lit("")), re.escape(separator))).alias("seg", "s")).withColumn("s", trim(F.col("s"))).where("s != ''")
    seg = seg.withColumn("parts", sentences(F.col("s"))).withColumn("many", (F.length("s") > long) & (F.size("parts") > 1))
    units = seg.select("document_id", "seg", "many", F.posexplode(F.when(F.col("many"), F.col("parts")).otherwise(F.array("s"))).alias("pos", "text"))
    order = Window.partitionBy("document_id").orderBy("seg", "pos")
    units = units.withColumn("index", F.row_number().over(order) - 1)
    return units.select("document_id", F.concat_ws("_unit_", "document_id", F.col("index").cast("string")).alias("unit_id"), "text", F.when(F.col("many"), "sentence").otherwise("paragraph").alias("unit_type"), "index")


def linear_pieces(text: str, config: ChunkConfig = ChunkConfig()) -> list[str]:
    """Pieces of a text, by paragraphs, or sentences packed up to the size.

    When a sentence does not fit, the piece ends and the next begins with its last sentences,
    however long; a last piece over the size with an oversized sentence in it is cut by force.
    """
    text = text.strip()
    if len(text) <= config.size:
        return [text] if text else []
    paragraphs = [p for p in map(str.strip, text.split("\n\n" if "\n\n" in text else "\n")) if p]
    if len(paragraphs) > 1:
        return [piece for p in paragraphs for piece in linear_pieces(p, config)]
    parts = [s for s in map(str.strip, _SENTENCE.split(text)) if s]
    out: list[str] = []
    held: list[str] = []
    for s in parts:
        if held and len(" ".join(held)) + 1 + len(s) > config.size:
            out.append(" ".join(held))
            held = held[-config.overlap_units :]
        held.append(s)
    last = " ".join(held)
    if len(last) > config.size and max(map(len, parts)) > config.size:
        return out + forced_pieces(last, config)
    return [*out, last]


def forced_pieces(text: str, config: ChunkConfig = ChunkConfig()) -> list[str]:
    """Windows of the size, each ending at its last space and overlapping the one before. A window whose space would not move it on is cut at its full size."""
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + config.size)
        if end < len(text):
            space = text.rfind(" ", start, end)
            if space - config.overlap > start:
                end = space
        if piece := text[start:end].strip():
            out.append(piece)
        if end >= len(text):
            break
        start = end - config.overlap
    return out


def linear_chunks(docs: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """(id, document_id, chunk_index, content) of (id, content)."""

    def run(frames):
        for f in frames:
            rows = [(f"{d}_chunk_{k}", d, k, piece) for d, t in zip(f["id"], f["content"].fillna("")) for k, piece in enumerate(linear_pieces(t, config))]
            yield pd.DataFrame(rows, columns=["id", "document_id", "chunk_index", "content"])

    return docs.select("id", "content").mapInPandas(run, "id string, document_id string, chunk_index int, content string")


def graph_chunks(units: DataFrame, edges: DataFrame, config: GraphConfig = GraphConfig()) -> DataFrame:
    """(id, document_id, graph_id, content, unit_ids): a chunk for each community of a document's units, its texts in order."""
    members = communities(units, edges, config)
    rows = members.join(units, ["document_id", "unit_id"])
    grouped = rows.groupBy("document_id", "community").agg(F.array_sort(F.collect_list(F.struct("index", "text", "unit_id"))).alias("u"))
    gid = F.concat_ws("_graph_", "document_id", F.col("community").cast("string"))
    return grouped.select(gid.alias("id"), "document_id", gid.alias("graph_id"), F.array_join(F.transform("u", lambda x: x["text"]), " ").alias("content"), F.transform("u", lambda x: x["unit_id"]).alias("unit_ids"))


def graph_chunks_of(docs: DataFrame, separator: str = "\n\n", config: GraphConfig = GraphConfig(), long: int = 400) -> DataFrame:
    """(id, document_id, graph_id, content, unit_ids) of (id, content): what graph_chunks makes of the text units, with their structural, hierarchical (one section) and keyword edges.

    A document stays one row until its chunks are made, so nothing is shuffled or joined.
    """
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    segments = F.filter(F.transform(F.split(F.coalesce("content", F.lit("")), re.escape(separator)), trim), lambda s: s != "")
    # A trimmed segment that is not split is its only sentence.
    units = F.flatten(F.transform(segments, lambda s: F.when(F.length(s) > long, sentences(s)).otherwise(F.array(s))))

    @F.arrow_udf("array<array<int>>")
    def groups(tokens: pa.Array) -> pa.Array:
        out = []
        for k in range(0, len(tokens), 256):
            out += [unit_groups(words, config.resolution) for words in tokens.slice(k, 256).to_pylist()]
        return pa.array(out, pa.list_(pa.list_(pa.int32())))

    rows = docs.where("id is not null").select(F.col("id").alias("document_id"), units.alias("u")).withColumn("g", groups(F.transform("u", significant_tokens)))
    text = lambda g: F.array_join(F.transform(g, lambda i: F.get(F.col("u"), i)), " ")
    ids = lambda g: F.transform(g, lambda i: F.concat_ws("_unit_", "document_id", i.cast("string")))
    chunks = rows.select("document_id", F.posexplode(F.transform("g", lambda g: F.struct(text(g).alias("content"), ids(g).alias("unit_ids")))).alias("community", "c"))
    gid = F.concat_ws("_graph_", "document_id", F.col("community").cast("string"))
    return chunks.select(gid.alias("id"), "document_id", gid.alias("graph_id"), "c.content", "c.unit_ids")


def unit_groups(tokens: list[list[str]], resolution: float, most: int = 12, min_shared: int = 3, max_per_unit: int = 5) -> list[list[int]]:
    """Communities of a document's units, given by their significant words: the edges are those of graph.structural_edges, hierarchical_edges in one section, and keyword_edges of unit_keywords, in the order that communities takes them in."""
    n = len(tokens)
    edges = [(i, j, 1.0) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n] + [(i, i + 1, 0.5) for i in range(n - 1)]
    holders: dict[str, list[int]] = {}
    for u, words in enumerate(tokens):
        count: dict[str, int] = {}
        for w in words:
            count[w] = count.get(w, 0) + 1
        # Sorting is stable: among equals the first used comes first.
        for w in sorted(count, key=lambda w: (-count[w], -len(w)))[:most]:
            holders.setdefault(w, []).append(u)
    shared: dict[tuple[int, int], int] = {}
    for units in holders.values():
        for k, a in enumerate(units):
            for b in units[k + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    near: dict[int, list[tuple[int, int]]] = {}
    for (a, b), c in shared.items():
        if c >= min_shared:
            near.setdefault(a, []).append((c, b))
            near.setdefault(b, []).append((c, a))
    for a in sorted(near):
        # Ties go to the later id, and ids end in the number as text.
        best = sorted(near[a], key=lambda x: (x[0], str(x[1])), reverse=True)[:max_per_unit]
        edges += sorted((a, b, round(min(0.6, 0.3 + 0.1 * c), 6)) for c, b in best)
    return C.modularity(list(range(n)), edges, resolution)


def communities(units: DataFrame, edges: DataFrame, config: GraphConfig = GraphConfig()) -> DataFrame:
    """(document_id, unit_id, community): one level of modularity moves in each document, whose units and edges come as one row; edges follow by type, then by their units' numbers."""
    rank = F.when(F.col("edge_type") == "structural", 0).when(F.col("edge_type") == "hierarchical", 1).when(F.col("edge_type") == "semantic", 2).otherwise(3)
    nodes = units.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("index", "unit_id"))).alias("nodes"))
    links = edges.groupBy("document_id").agg(F.collect_list(F.struct(rank.alias("r"), "src", "dst", "weight")).alias("links"))

    def run(frames):
        for f in frames:
            out = []
            for d, nodes, links in zip(f["document_id"], f["nodes"], f["links"]):
                ids = [n["unit_id"] for n in nodes]
                at = {u: k for k, u in enumerate(ids)}
                order = sorted((x["r"], at[x["src"]], at[x["dst"]], x["weight"]) for x in (links if links is not None else []) if x["src"] in at and x["dst"] in at)
                found = C.modularity(ids, [(ids[a], ids[b], w) for _, a, b, w in order], config.resolution)
                out += [(d, u, k) for k, group in enumerate(found) for u in group]
            yield pd.DataFrame(out, columns=["document_id", "unit_id", "community"])

    return nodes.join(links, "document_id", "left").mapInPandas(run, "document_id string, unit_id string, community int")


def rejoined(chunks: DataFrame, lexicographic: bool = False) -> DataFrame:
    """(document_id, content): a document's chunks joined again, in the order of chunk_index or, as text, of id."""
    key = "id" if lexicographic else "chunk_index"
    return chunks.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), "content"))), lambda x: x["content"]), "\n\n").alias("content"))


def regraph_candidates(docs: DataFrame, chunks: DataFrame, force: bool = False) -> DataFrame:
    """Documents that have content and, unless forced, no graph chunk yet."""
    filled = chunks.where(F.coalesce(F.trim("content"), F.lit("")) != "").select(F.col("document_id").alias("id"))
    out = docs.join(filled, "id", "left_semi")
    graphed = chunks.where(F.col("graph_id").isNotNull()).select(F.col("document_id").alias("id"))
    return out if force else out.join(graphed, "id", "left_anti")


def regraph_stats(docs: DataFrame, done: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents processed and skipped, chunks made of them, and chunks a document."""
    n = docs.select(F.lit(1).alias("docs"), F.lit(0).alias("done"), F.lit(0).alias("chunks"))
    n = n.unionByName(done.select(F.lit(0).alias("docs"), F.lit(1).alias("done"), F.lit(0).alias("chunks")))
    made = chunks.join(done.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    n = n.unionByName(made.select(F.lit(0).alias("docs"), F.lit(0).alias("done"), F.lit(1).alias("chunks")))
    out = n.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("docs", "done", "chunks")))
    return out.select(F.col("done").alias("processed"), (F.col("docs") - F.col("done")).alias("skipped"), F.col("chunks").alias("total_chunks"), F.round(F.when(F.col("done") > 0, F.col("chunks") / F.col("done")).otherwise(0.0), 6).alias("average"))


def filled_categories(rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose categories are empty get their content's three keywords; only those rows are counted."""
    words = keyword_top(rows.where(F.size("categories") == 0), key, keyword_tokens(F.col("content")), 3)
    words = words.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("_w"))
    found = F.transform("_w", lambda x: x["word"])
    return rows.join(words, key, "left").withColumn("categories", F.when(F.col("_w").isNotNull(), found).otherwise(F.col("categories"))).drop("_w")
