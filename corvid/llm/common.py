"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name of the row identity that operators add; a clashing input column is never read.
RID = "__rid"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def text_rows(docs: DataFrame) -> DataFrame:
    """(RID, doc_id, text) of a table of documents; a null text is the empty text.

    The identity comes from the scan's partitioning, so it is the same each time that the
    table is read; repeated rows and repeated or null ids stay apart.
    """
    return docs.select(
        F.monotonically_increasing_id().alias(RID), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )


def settled(docs: DataFrame) -> DataFrame:
    """The table, written first unless it comes straight from files: after a shuffle, reading it again may deal rows otherwise, and their identities with them."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    moved = re.search("Repartition|Rebalance|Join|Aggregate|Sort|Sample|Limit|Offset|Window|Union", plan)
    return Workspace(docs.sparkSession).put(docs, "input") if moved else docs


def whole_rows(docs: DataFrame) -> DataFrame:
    """(RID, own, text): the identity, all own columns as a struct, so that no name can clash, and the text, empty for null."""
    return docs.select(F.monotonically_increasing_id().alias(RID), F.struct(*docs.columns).alias("own"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def retexted(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of docs from (own, text): the text is the new one, and n_chars counts it."""
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(changed[c].alias(c) if c in changed else F.col(f"own.`{c}`").alias(c) for c in docs.columns))


def give_back() -> None:
    """Returns to the system what this process has freed: Arrow's pool and, where the C library can, its heap."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable, encodes: bool = False) -> Callable:
    """The function of batches, for workers that live on from stage to stage: they would hold the most that any stage took.

    Those of an operator that encodes nothing begin by forgetting the encoders of earlier stages; each ends by giving memory back.
    """

    def wrapped(batches: Iterator) -> Iterator:
        vocab = sys.modules.get("corvid.llm.vocab")
        if vocab and not encodes:
            vocab.forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local one is set here, but only for a session within one machine's JVM: on a cluster that is an error."""
    jsc = spark.sparkContext._jsc.sc()
    if (known := jsc.getCheckpointDir()).isDefined():
        return known.get()
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="corvid-")
    spark.sparkContext.setCheckpointDir(at)
    return jsc.getCheckpointDir().get()


#: Lets Spark delete an execution's shuffle files as soon as it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Tables written as Parquet to the shared folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/corvid-{uuid.uuid4().hex}"
        self.made = 0

    def path(self, name: str = "t") -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{name}"

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        at, before = self.path(name), self.spark.conf.get(_CLEAN, None)
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.parquet(at)
        finally:
            self.spark.conf.set(_CLEAN, before) if before else self.spark.conf.unset(_CLEAN)
        out = self.spark.read.parquet(at)
        out._at = at
        return out

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            self._delete(df._at)

    def clear(self) -> None:
        """Deletes all tables put here."""
        self._delete(self.root)
