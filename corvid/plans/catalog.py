"""Registered queries: each a Spark plan over the standard tables, with SQL for the same rows where SQL can tell them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


class Tables:
    """The standard tables, and the shapes of stored entities over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, str(sf_dir).rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def embedded(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "label", "vec_id")

    @property
    def chunks(self) -> DataFrame:
        return self.documents.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("document_id"), F.col("text").alias("content"), "lang", "source", F.array("lang", "source").alias("categories"), "doc_id")

    @property
    def meta(self) -> DataFrame:
        d, k = self.documents, F.col("doc_id")
        return d.select(
            "doc_id", k.cast("string").alias("id"), F.col("source"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("content"), "lang",
            F.when(k % 6 == 5, "").otherwise(F.col("source")).alias("book"), F.when(k % 4 != 3, F.col("lang")).alias("chapter"), F.when(k % 3 == 0, (k % 50).cast("string")).alias("verse"),
            F.when(k % 5 == 0, F.concat(F.lit("part "), (k % 7).cast("string"))).alias("section"), F.when(k % 4 != 0, (k % 40).cast("int")).alias("page"), F.when(k % 2 == 0, F.array("lang", "source")).alias("headers"),
        )

    def query_vector(self) -> list[float]:
        """The vector that stands for the query: that of the smallest id."""
        return list(self.embeddings.where("embedding is not null").orderBy("vec_id").first()["embedding"])

    def query_text(self) -> str:
        return self.benchmark.where("text is not null").orderBy("item_id").first()["text"]


#: SQL for the same shapes.
EMB = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1), e AS (SELECT CAST(vec_id AS VARCHAR) AS chunk_id, vec_id, label, round(list_inner_product(CAST(embedding AS DOUBLE[]), (SELECT v FROM q)), 6) AS score, list_inner_product(CAST(embedding AS DOUBLE[]), (SELECT v FROM q)) AS raw FROM embeddings)"
CHUNKS = "c AS (SELECT CAST(doc_id AS VARCHAR) AS id, source AS document_id, text AS content, lang, source, [lang, source] AS categories, doc_id FROM documents)"
META = """m AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, source, string_split(text, chr(10))[1] AS title, text AS content, lang,
  CASE WHEN doc_id % 6 = 5 THEN '' ELSE source END AS book, CASE WHEN doc_id % 4 <> 3 THEN lang END AS chapter, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 50 AS VARCHAR) END AS verse,
  CASE WHEN doc_id % 5 = 0 THEN 'part ' || CAST(doc_id % 7 AS VARCHAR) END AS section, CASE WHEN doc_id % 4 <> 0 THEN CAST(doc_id % 40 AS INTEGER) END AS page, CASE WHEN doc_id % 2 = 0 THEN [lang, source] END AS headers FROM documents)"""
LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS pos FROM documents)"
#: Words and their first places, for keywords.
WORD = r"[\p{L}\p{N}_]+"


def squashed(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("doc_id", "text", F.col("pos").cast("long").alias("pos"))


def joined(c: Column | str, sep: str = "|") -> Column:
    return F.array_join(c, sep)
