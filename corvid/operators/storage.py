"""Stored tables as rewrites: upserts, deletes, look-ups, indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import types as T
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows replace old ones of their key."""
    return old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)


def merge(old: DataFrame, new: DataFrame, key: str, keep_old: tuple[str, ...] = ()) -> DataFrame:
    """As upsert, but columns of keep_old stay as they were where the key existed and they were set."""
    o, n = old.alias("o"), new.alias("n")
    columns = [F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key)]
    for c in old.columns:
        if c != key:
            a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
            columns.append((F.coalesce(a, b) if c in keep_old else F.when(F.col(f"n.{key}").isNotNull(), b).otherwise(a)).alias(c))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*columns)


def newest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row of each key, the last by the order."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert_jobs(old: DataFrame, new: DataFrame) -> DataFrame:
    """started_at stays once set; everything else is the new row's."""
    return merge(old, new, "id", keep_old=("started_at",))


def delete_documents(rows: DataFrame, document_ids: DataFrame, key: str = "document_id") -> DataFrame:
    return rows.join(document_ids.select(key), key, "left_anti")


def delete_embeddings(embeddings: DataFrame, chunks: DataFrame, document_ids: DataFrame) -> DataFrame:
    gone = chunks.join(document_ids.select("document_id"), "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
    return embeddings.join(gone, "chunk_id", "left_anti")


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def chapter_chunks(chunks: DataFrame, source_hash: str, book: str, chapter: str) -> DataFrame:
    return chunks.where((F.col("source_hash") == source_hash) & (F.col("book") == book) & (F.col("chapter") == chapter)).orderBy(F.col("page").cast("int"), "id")


def list_documents(docs: DataFrame, source: str | None = None, limit: int | None = None) -> DataFrame:
    out = (docs if source is None else docs.where(F.col("source") == source)).orderBy("id")
    return out if limit is None else out.limit(limit)


def metadata_set(metadata, key: str, value):
    """A map with one key set; null counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    base = F.map_filter(F.coalesce(metadata, empty), lambda k, _: k != key)
    return F.map_concat(base, F.create_map(F.lit(key), value))


def chunk_offsets(rows: DataFrame, group: str, order: str, line) -> DataFrame:
    """The byte at which each line of a file (group) begins, one more than the bytes of a line apart."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("n_bytes", F.octet_length(line).cast("long")).withColumn("offset", F.coalesce(F.sum(F.col("n_bytes") + 1).over(w), F.lit(0)))


def embedding_validate(embeddings: DataFrame, dim: int) -> DataFrame:
    """One row: rows, distinct ids, least and most components, and whether all have dim."""
    size = F.size("embedding")
    return embeddings.agg(F.count("*").alias("n_rows"), F.countDistinct("chunk_id").alias("n_ids"), F.min(size).alias("min_dim"), F.max(size).alias("max_dim"), (F.coalesce(F.min(size) == dim, F.lit(True)) & F.coalesce(F.max(size) == dim, F.lit(True))).alias("valid"))


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def metadata_index(records: DataFrame, order: str = "index") -> DataFrame:
    """A record for each id, the last by the order."""
    rest = [c for c in records.columns if c != "id"]
    return records.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("id", "r.*")


def overlaid(rows: DataFrame, computed: dict[str, Column], bases: dict[str, Column]) -> DataFrame:
    """The rows' metadata columns under computed ones, under bases where those are not null, empty or 0."""
    kinds = {f.name: f.dataType for f in rows.select(*(c.alias(n) for n, c in bases.items())).schema}
    below = {c: F.col(c) for c in rows.columns} | computed
    over = {}
    for n, c in bases.items():
        known = F.nullif(c, F.lit(0 if isinstance(kinds[n], T.NumericType) else ""))
        over[n] = F.coalesce(known, below[n]) if n in below else known
    return rows.select(*(c.alias(n) for n, c in (below | over).items()))
