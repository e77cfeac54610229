"""Exact top-k inner products: blocks in the order of their bounds, until no bound reaches the kth score."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm.common import RID, lean, settled

#: Vectors in a block, blocks in a shard, queries in a group.
BLOCK, SHARD, GROUP = 256, 32, 4096
_PACKED = "block long, dim int, n int, rids binary, ids binary, data binary"


def quantized(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(RID, id, v array<long>): floor(scale * x) of each component, x as double. Vectors that are null or empty, or hold null or non-finite components, are left out; so are null ids."""
    rows = embeddings.select(F.monotonically_increasing_id().alias(RID), F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"))
    ok = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    return rows.where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & ok).select(RID, "id", F.transform("x", lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to so many consecutive vectors of one dimension, with their ids, as bytes."""

    def run(batches):
        for k, batch in enumerate(batches):
            sizes = pa.compute.list_value_length(batch.column("v")).to_numpy()
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                for a in range(0, len(own), size):
                    part = batch.take(pa.array(own[a : a + size]))
                    first = int(part.column(RID)[0].as_py())
                    data = part.column("v").flatten().to_numpy().astype("<i8").tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([first]), pa.array([dim], pa.int32()), pa.array([part.num_rows], pa.int32()), *(pa.array([x], pa.binary()) for x in (part.column(RID).to_numpy().tobytes(), part.column("id").to_numpy().tobytes(), data))],
                        ["block", "dim", "n", "rids", "ids", "data"],
                    )

    return rows.mapInArrow(lean(run), _PACKED)


def _matrix(row) -> np.ndarray:
    return np.frombuffer(row.data, "<i8").reshape(row.n, row.dim)


def search_shard(blocks: list, queries: list, k: int) -> pd.DataFrame:
    """The k best of a shard's vectors for each query of the same dimension, by score, then smaller id.

    A block's bound for a query sums, over the components, the largest product that the
    block's extremes allow. Each query takes the blocks by falling bound and stops when the
    next is below its kth score. All queries whose turn falls on the same block share one
    product with the block's rows.
    """
    out = []
    for dim in {q.dim for q in queries} & {b.dim for b in blocks}:
        own = [b for b in blocks if b.dim == dim]
        data = [_matrix(b) for b in own]
        ids, rids = (np.concatenate([np.frombuffer(getattr(b, x), "<i8") for b in own]) for x in ("ids", "rids"))
        starts = np.concatenate([[0], np.cumsum([len(m) for m in data])])
        q = np.concatenate([_matrix(x) for x in queries if x.dim == dim])
        q_ids, q_rids = (np.concatenate([np.frombuffer(getattr(x, c), "<i8") for x in queries if x.dim == dim]) for c in ("ids", "rids"))
        largest = max(int(np.abs(q).max()), *(int(np.abs(m).max()) for m in data))
        kind = np.float64 if largest**2 * int(dim) < 1 << 52 else np.int64
        q, data = q.astype(kind), [m.astype(kind) for m in data]
        high, low = np.array([m.max(0) for m in data]), np.array([m.min(0) for m in data])
        bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        order = np.argsort(-bound, axis=1, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((rids, ids))] = np.arange(len(ids))
        back = np.argsort(rank)
        nothing = np.iinfo(np.int64).min + 1
        top_s, top_r = np.full((len(q), k), nothing), np.full((len(q), k), len(ids))
        live = np.arange(len(q))
        for turn in range(len(own)):
            at = order[live, turn]
            going = bound[live, at] >= top_s[live, -1]
            live, at = live[going], at[going]
            if not len(live):
                break
            for b in np.unique(at):
                who = live[at == b]
                s = (q[who] @ data[b].T).astype(np.int64)
                s[q_rids[who][:, None] == rids[starts[b] : starts[b + 1]][None, :]] = nothing
                r = np.broadcast_to(rank[starts[b] : starts[b + 1]], s.shape)
                s, r = np.concatenate([top_s[who], s], 1), np.concatenate([top_r[who], r], 1)
                best = np.lexsort((r, -s), axis=1)[:, :k]
                top_s[who], top_r[who] = np.take_along_axis(s, best, 1), np.take_along_axis(r, best, 1)
        a, b = np.nonzero(top_s > nothing)
        hit = back[top_r[a, b]]
        out.append(pd.DataFrame({"query_rid": q_rids[a], "query_id": q_ids[a], "vec_id": ids[hit], "vec_rid": rids[hit], "score": top_s[a, b]}))
    columns = ["query_rid", "query_id", "vec_id", "vec_rid", "score"]
    return pd.concat(out)[columns] if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k best of all other rows (all, if fewer); only vectors of the query's dimension count.

    Vectors are packed in blocks, blocks dealt into shards, and queries into groups; each pair
    of a shard and a group is a task of bounded size. Their local results, k a query, meet by
    query.
    """
    blocks = packed(vectors, BLOCK)
    counts = vectors.count()
    shards, groups = max(1, -(-counts // (BLOCK * SHARD))), max(1, -(-counts // (20 * GROUP)))
    left = blocks.withColumn("shard", F.pmod(F.xxhash64("block", "dim"), F.lit(shards)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = packed(queries, BLOCK).withColumn("group", F.pmod(F.xxhash64("block", "dim"), F.lit(groups)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return search_shard(list(a.itertuples()), list(b.itertuples()), k)

    found = left.groupBy("shard", "group").cogroup(right.groupBy("shard", "group")).applyInPandas(run, "query_rid long, query_id long, vec_id long, vec_rid long, score long")
    best = Window.partitionBy("query_rid").orderBy(F.col("score").desc(), "vec_id", "vec_rid")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(embeddings: DataFrame) -> DataFrame:
    """The 20 best other rows for each row whose vec_id is divisible by 20."""
    vectors = quantized(settled(embeddings))
    return search(vectors, vectors.where(F.col("id") % 20 == 0))
