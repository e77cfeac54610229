"""Exact vector search and the joins around it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions.vectors import inner_product, literal


def scored(embeddings: DataFrame, query: list[float], mode: str = "cosine", digits: int | None = 6) -> DataFrame:
    """score of each row against a query vector, rounded if digits are given: the inner product, or one more in the mode one_plus_ip."""
    s = inner_product(F.col("embedding"), literal(query))
    s = s + 1.0 if mode == "one_plus_ip" else s
    return embeddings.withColumn("score", s if digits is None else F.round(s, digits))


def top_k(rows: DataFrame, k: int, min_score: float | None = None, key: str = "chunk_id") -> DataFrame:
    """The k rows of the highest score that is not under min_score; ties go to the smaller id."""
    kept = rows if min_score is None else rows.where(F.col("score") >= min_score)
    return kept.orderBy(F.col("score").desc(), key).limit(k)


def in_categories(categories: Column, wanted: list[str]) -> Column:
    return F.exists(categories, lambda c: F.lower(c).isin([w.lower() for w in wanted]))


#: Units of a document that are compared as one block with another block.
BLOCK = 1024


def _vectors(units: DataFrame) -> DataFrame:
    return units.where("document_id is not null and index is not null and embedding is not null").select("document_id", "unit_id", F.col("index").cast("long").alias("index"), "embedding")


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """(document_id, name): how many blocks a document's rows make."""
    return rows.groupBy("document_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))


def _block(n: str) -> Column:
    return F.pmod(F.xxhash64("unit_id", "index"), F.col(n)).cast("int")


def semantic_edges(units: DataFrame, threshold: float) -> DataFrame:
    """(document_id, src, dst, weight) for i < j in a document whose cosine reaches the threshold."""
    rows = _vectors(units)
    dealt = rows.join(_blocks(rows, "n"), "document_id").withColumn("b", _block("n")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    p, q = F.least("b", "o"), F.greatest("b", "o")
    return _alike(dealt.select("document_id", p.alias("p"), q.alias("q"), (F.col("b") == p).alias("left"), (F.col("b") == q).alias("right"), "unit_id", "index", "embedding"), threshold)


def edges_from(units: DataFrame, threshold: float) -> Callable[[DataFrame], DataFrame]:
    """For the units of a front (id), (src, dst, weight) to all others of their documents whose cosine reaches the threshold: what semantic_edges has, in both directions, of those alone."""
    rows = _vectors(units)

    def edges(front: DataFrame) -> DataFrame:
        near = rows.join(front.select(F.col("id").alias("unit_id")).distinct(), "unit_id", "left_semi")
        blocks = _blocks(near, "f").join(_blocks(rows, "n"), "document_id")
        own = near.join(blocks, "document_id").withColumn("p", _block("f")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        every = rows.join(blocks, "document_id").withColumn("q", _block("n")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("f") - 1)))
        sides = [x.select("document_id", "p", "q", F.lit(left).alias("left"), F.lit(not left).alias("right"), "unit_id", "index", "embedding") for x, left in ((own, True), (every, False))]
        return _alike(sides[0].unionByName(sides[1]), threshold, directed=True).select("src", "dst", "weight")

    return edges


def _alike(dealt: DataFrame, threshold: float, directed: bool = False) -> DataFrame:
    """(document_id, src, dst, weight) of units (document_id, p, q, left, right, unit_id, index, embedding): those of a block pair (p, q) on its left with those on its right. Undirected, the smaller index is the source."""

    def run(batches):
        for parts in _runs(batches, 3):
            t = pa.Table.from_batches(parts).combine_chunks()
            left, right, index = (t[c].to_numpy() for c in ("left", "right", "index"))
            x, size, holes = _matrix(t["embedding"].chunk(0))
            a, b = np.flatnonzero(left), np.flatnonzero(right)
            with np.errstate(all="ignore"):
                length = np.sqrt((x * x).sum(1))
                norm, same = np.outer(length[a], length[b]), size[a][:, None] == size[b]
                cosine = np.where((norm == 0) | ~same, 0.0, x[a] @ x[b].T / norm)
                # A little wide: the rounded weight decides. NaN counts as the greatest, as in SQL.
                kept = ~(cosine < threshold - 1e-6) & ~(same & (holes[a][:, None] | holes[b]))
            ia, ib = index[a][:, None], index[b]
            kept &= ia < ib if t["p"][0] == t["q"][0] and not directed else ia != ib
            i, j = np.nonzero(kept)
            weight, i, j = cosine[i, j], a[i], b[j]
            src, dst = (i, j) if directed else (np.where(index[i] < index[j], i, j), np.where(index[i] < index[j], j, i))
            for k in range(0, len(i), 1 << 16):
                s, d = (pa.array(v[k : k + (1 << 16)]) for v in (src, dst))
                unit = t["unit_id"].chunk(0)
                yield pa.RecordBatch.from_arrays([t["document_id"].chunk(0).take(s), unit.take(s), unit.take(d), pa.array(weight[k : k + (1 << 16)])], ["document_id", "src", "dst", "weight"])

    kind = {c: dealt.schema[c].dataType.simpleString() for c in ("document_id", "unit_id")}
    keys = ["document_id", "p", "q"]
    found = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"document_id {kind['document_id']}, src {kind['unit_id']}, dst {kind['unit_id']}, weight double")
    return found.withColumn("weight", F.round("weight", 6)).where(F.col("weight") >= threshold)


def _runs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[list[pa.RecordBatch]]:
    """Consecutive rows with the same first n columns."""
    held, key = [], None
    for batch in batches:
        keys, start = list(zip(*(batch.column(c).to_pylist() for c in range(n)))), 0
        for at, k in enumerate(keys):
            if k != key:
                if at > start:
                    held.append(batch.slice(start, at - start))
                if held:
                    yield held
                held, key, start = [], k, at
        if start < len(keys):
            held.append(batch.slice(start))
    if held:
        yield held


def _matrix(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as rows, shorter ones filled with zeros; their lengths, and which of them hold a null."""
    size, flat = vectors.value_lengths().to_numpy(zero_copy_only=False), vectors.flatten()
    within = np.arange(max(size, default=0)) < size[:, None]
    x, null = np.zeros(within.shape), np.zeros(within.shape, bool)
    x[within] = flat.fill_null(0).to_numpy(zero_copy_only=False)
    null[within] = flat.is_null().to_numpy(zero_copy_only=False)
    return x, size, null.any(1)


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashedWords:
    """A stand-in for a model: hashed bags of words of unit length, the same everywhere."""

    def __init__(self, dim: int = 384):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        import re
        import zlib

        out = np.zeros((len(texts), self.dim), np.float32)
        for k, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                out[k, h % self.dim] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def embed(chunks: DataFrame, embedder: Embedder, batch: int = 64) -> DataFrame:
    """(chunk_id, embedding) of (id, content); a batch that does not fit memory is halved."""

    def encode(texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, embedder.dim), np.float32)
        try:
            return embedder.encode(texts)
        except MemoryError:
            if len(texts) == 1:
                raise
            half = len(texts) // 2
            return np.concatenate([encode(texts[:half]), encode(texts[half:])])

    def run(frames):
        for f in frames:
            for a in range(0, len(f), batch):
                part = f.iloc[a : a + batch]
                yield pd.DataFrame({"chunk_id": part["id"], "embedding": list(encode(part["content"].fillna("").tolist()))})

    return chunks.select("id", "content").mapInPandas(run, "chunk_id string, embedding array<float>")
