"""Stored tables under one folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables with their keys.
TABLES = {
    "documents": ("id", "id string, source string, title string, content string, book string, chapter string, verse string, section string"),
    "chunks": ("id", "id string, document_id string, chunk_index int, content string, graph_id string, source string, title string, book string, chapter string, verse string, section string, path array<string>, categories array<string>, source_hash string, document_hash string"),
    "embeddings": ("chunk_id", "chunk_id string, embedding array<float>"),
}
#: Increments that one read merges before they are written together.
MERGED = 32


class Store:
    """Tables as increments of Parquet: a write adds its own rows alone, however large the table; a read takes the newest row of each key.

    An increment counts once it is finished, so a reader never sees half of one, and a write
    that is lost is simply made again. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, name: str) -> list[str]:
        fs, p = self._fs(f"{self.root}/{name}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _finished(self, name: str) -> list[str]:
        """Paths of the finished increments that count: those from the last whole one on."""
        out: list[str] = []
        for n in self._names(name):
            fs, done = self._fs(f"{self.root}/{name}/{n}/_SUCCESS")
            if fs.exists(done):
                out = [*([] if n.endswith("-whole") else out), f"{self.root}/{name}/{n}"]
        return out

    def _add(self, name: str, rows: DataFrame, whole: bool = False) -> str:
        last = max((int(n.split("-")[0]) for n in self._names(name)), default=0)
        at = f"{self.root}/{name}/{last + 1:08d}" + ("-whole" if whole else "")
        rows.write.parquet(at)
        return at

    def create(self) -> None:
        for name, (_, schema) in TABLES.items():
            if not self._finished(name):
                self._add(name, self.spark.createDataFrame([], f"{schema}, _gone boolean"), whole=True)

    def drop(self) -> None:
        for name in TABLES:
            fs, p = self._fs(f"{self.root}/{name}")
            fs.delete(p, True)

    def clear(self) -> None:
        self.drop()
        self.create()

    def _rows(self, paths: list[str], name: str) -> DataFrame:
        return self.spark.read.schema(f"{TABLES[name][1]}, _gone boolean").parquet(*paths)

    def read(self, name: str) -> DataFrame:
        key, schema = TABLES[name]
        paths = self._finished(name)
        if not paths:
            return self.spark.createDataFrame([], schema)
        if len(paths) == 1:
            rows = self._rows(paths, name)
        else:
            rows = self._rows(paths[:1], name).withColumn("_n", F.lit(0))
            for k, p in enumerate(paths[1:], 1):
                rows = rows.unionByName(self._rows([p], name).withColumn("_n", F.lit(k)))
            rest = [c for c in rows.columns if c not in (key, "_n")]
            rows = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "_n").alias("_r")).select(key, "_r.*")
        return rows.where("not _gone").drop("_gone").select(*self.spark.createDataFrame([], schema).columns)

    def upsert(self, name: str, rows: DataFrame, gone: DataFrame | None = None) -> DataFrame:
        """Writes rows, one of each key, over the old ones of their keys, and in the same step takes out those whose key is in gone; returns the rows as written."""
        key, schema = TABLES[name]
        empty = self.spark.createDataFrame([], schema)
        new = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema), F.lit(False).alias("_gone"))
        if gone is not None:
            lost = gone.select(key).distinct().join(rows.select(key), key, "left_anti")
            new = new.unionByName(lost.withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        at = self._add(name, new)
        if len(self._finished(name)) > MERGED:
            self.compact(name)
        return self._rows([at], name).where("not _gone").drop("_gone")

    def delete(self, name: str, keys: DataFrame) -> None:
        none = self.spark.createDataFrame([], TABLES[name][1])
        self.upsert(name, none, keys)

    def compact(self, name: str) -> None:
        """Writes all increments as one. Those it holds stay for readers that began before, until the next."""
        held = self._names(name)
        before = [n for n in held if n.endswith("-whole")]
        self._add(name, self.read(name).withColumn("_gone", F.lit(False)), whole=True)
        for n in held:
            if before and n < before[-1]:
                fs, p = self._fs(f"{self.root}/{name}/{n}")
                fs.delete(p, True)

    def load_or_build(self, name: str, build: Callable[[], DataFrame], valid: Callable[[DataFrame], bool]) -> DataFrame:
        """The table if it has rows and is valid, else as built anew."""
        rows = self.read(name)
        if rows.take(1) and valid(rows):
            return rows
        self._add(name, build().withColumn("_gone", F.lit(False)), whole=True)
        return self.read(name)

    def scratch(self, rows: DataFrame) -> DataFrame:
        """Rows written once because several steps read them; see swept."""
        at = f"{self.root}/_scratch/{uuid.uuid4().hex}"
        rows.write.parquet(at)
        return self.spark.read.parquet(at)

    def swept(self) -> None:
        fs, p = self._fs(f"{self.root}/_scratch")
        fs.delete(p, True)
