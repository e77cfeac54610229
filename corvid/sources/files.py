"""Documents and chunks from and to files."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions.location import derived_categories
from corvid.functions.text import content_hash, is_text
from corvid.functions.url import canonical_url
from corvid.schemas import CHUNK

_ITEM = "id string, url string, source string, title string, body string, content string, headers array<string>, book string, chapter string, verse string, section string"


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A JSON array or JSON lines, told apart by the first character."""
    head = spark.read.text(path, wholetext=False).where(F.trim("value") != "").first()
    many = head is not None and head["value"].lstrip().startswith("[")
    reader = spark.read.option("multiLine", many)
    return (reader.schema(schema) if schema else reader).json(path)


def documents_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Valid text documents; an error if there is none."""
    out = document_rows(read_json(spark, path, _ITEM))
    if not out.take(1):
        raise ValueError(f"no valid document in {path}")
    return out


def document_rows(items: DataFrame) -> DataFrame:
    """id, canonical source, title, content, and book, chapter and verse with headers to fall back on."""
    items = items.withColumn("content", F.coalesce("content", "body", F.lit(""))).where(is_text(F.col("content")))
    source = canonical_url(F.coalesce("source", "url", F.lit("")))
    header = lambda k: F.get(F.coalesce("headers", F.array().cast("array<string>")), F.lit(k))
    return items.select(F.coalesce("id", F.sha2(F.concat_ws("\n", source, "title", "content"), 256)).alias("id"), source.alias("source"), F.coalesce("title", F.lit("")).alias("title"), "content", *(F.coalesce(F.nullif(F.col(n), F.lit("")), header(k)).alias(n) for k, n in enumerate(("book", "chapter", "verse"))), "section")


def chunks_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Chunks, absent lists as empty ones."""
    rows = read_json(spark, path, CHUNK)
    return rows.withColumn("unit_ids", F.coalesce("unit_ids", F.array().cast("array<string>"))).withColumn("path", F.coalesce("path", F.array().cast("array<string>")))


def write_chunks(chunks: DataFrame, path: str, kind: str = "json") -> None:
    chunks.write.mode("overwrite").format(kind).save(path)


def by_index(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose idx is wanted."""
    return rows.join(wanted.select("idx").distinct(), "idx", "left_semi")


def chunk_ids(spark: SparkSession, path: str) -> DataFrame:
    """Only the ids: nothing else is parsed."""
    return read_json(spark, path, "id string")


def chunk_defaults(rows: DataFrame) -> DataFrame:
    """Chunks with what a stored one may lack: categories from its headers and metadata, and hashes of its content."""
    own = content_hash(F.col("content"))
    derived = derived_categories(F.col("headers"), *(F.col(c) for c in ("book", "chapter", "section", "verse", "source", "title")))
    return rows.withColumns({"categories": F.coalesce("categories", derived), "source_hash": F.coalesce("source_hash", own), "document_hash": F.coalesce("document_hash", own)})


def in_batches(rows: DataFrame, size: int, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f over batches of at most size rows, as the partitions hold them."""

    def run(frames):
        for frame in frames:
            for a in range(0, len(frame), size):
                yield f(frame.iloc[a : a + size])

    return rows.mapInPandas(run, schema)


def export_json(rows: DataFrame, path: str) -> None:
    """JSON lines, a file for each partition."""
    rows.write.mode("overwrite").json(path)


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1, **properties: str) -> DataFrame:
    """A database table over JDBC; with a numeric key, in so many ranges of it at once. A lost connection costs its task, which Spark runs again."""
    if key is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(url, table, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, properties=properties)
