"""Rows that share a key, dealt to tasks in blocks, and the classes that links make, as tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm.common import Workspace, partitions


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links enough to connect what the links (a, b) among n nodes connect, fewer than n."""
    root = list(range(n))
    one, other = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        i, j = find(root, x), find(root, y)
        if i != j:
            root[max(i, j)] = min(i, j)
            one.append(x), other.append(y)
    return np.array(one, np.int64), np.array(other, np.int64)


def find(root: list[int], x: int) -> int:
    while root[x] != x:
        root[x] = x = root[root[x]]
    return x


def sharing(rows: DataFrame, size: Column, limit: int) -> DataFrame:
    """(key, id, blocks) of rows (key, id, ...) whose key some other id has, too; each once.

    blocks is what the rows of the key, by the sum of their sizes, need for blocks of the
    limit. One shuffle of the rows, by key: most keys have one row, which goes no further.
    """
    by = Window.partitionBy("key")
    known = rows.select("key", "id", F.min("id").over(by).alias("low"), F.max("id").over(by).alias("high"), F.sum(size).over(by).alias("size"))
    return known.where("low != high").dropDuplicates(["key", "id"]).select("key", "id", F.ceil(F.col("size") / limit).cast("int").alias("blocks"))


def in_blocks(rows: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """Rows (key, p, q, own, *columns) of rows (key, blocks, *columns): a group (key, p, q) has the rows of blocks p and q, by a hash of their id, so each two rows of a key meet once, but those of one block.

    Groups are whole within partitions, and sorted. p = q only in keys of one block, or as the
    pairs within block p.
    """
    cut = rows.withColumn("own", F.pmod(F.xxhash64(id_col), F.col("blocks")).cast("int")).withColumn("far", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = cut.select("key", F.least("own", "far").alias("p"), F.greatest("own", "far").alias("q"), "own", *columns)
    return dealt.repartition(partitions(rows.sparkSession), "key", "p", "q").sortWithinPartitions("key", "p", "q")


def whole_groups(batches, columns: tuple[str, ...] = ("key", "p", "q")):
    """The rows of sorted batches, cut where a group ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(c).to_numpy() for c in columns]
        change = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        if held and any(v[0] != held[-1].column(c)[held[-1].num_rows - 1].as_py() for v, c in zip(values, columns, strict=True)):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if len(change):
            yield pa.Table.from_batches([*held, batch.slice(0, change[-1])]).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(change[-1] if len(change) else 0))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def group_heads(batch: pa.RecordBatch, columns: tuple[str, ...] = ("key", "p", "q")) -> np.ndarray:
    """Index of the first row of each group, and the number of rows."""
    values = [batch.column(c).to_numpy() for c in columns]
    change = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
    return np.concatenate([[0], change, [batch.num_rows]])


def once(keys: np.ndarray, x: np.ndarray, y: np.ndarray, key: np.ndarray, none: np.uint64) -> np.ndarray:
    """Whether key is the smallest key that rows x and y of a table of keys share; none fills up the table."""
    common = (keys[x][:, :, None] == keys[y][:, None, :]).any(2)
    return np.where(common, keys[x], none).min(1) == key


def classes(links: DataFrame, work: Workspace) -> DataFrame:
    """(id, root): of each id in links (a, b), the smallest id that it is connected to.

    Each round takes the smallest label among an id's neighbours and then the label of that
    label, so chains halve. Every round is a written table.
    """
    both = work.put(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = work.put(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        hooked = label.join(near, "id").select("id", F.least("root", "near").alias("new"), "root")
        jump = label.select(F.col("id").alias("new"), F.col("root").alias("far"))
        step = work.put(hooked.join(jump, "new").select("id", F.least("new", "far").alias("root"), (F.least("new", "far") != F.col("root")).alias("moved")), "labels")
        work.drop(label)
        if not step.where("moved").take(1):
            work.drop(both)
            return step.select("id", "root")
        label = step
