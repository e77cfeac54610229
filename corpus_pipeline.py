"""A training corpus from documents: clean, deduplicated and packed. Each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvid.llm import lines, ordermin, packing, suffix, toxicity
from corvid.llm.common import Workspace, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score under 0.5; the classifier learns from the labels that are not held out."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first line of each class of near-duplicate lines; every document stays."""
    return lines.without_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return ordermin.one_of_each(docs)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out the bytes under strings of 400 bytes or of 50 words that start elsewhere, too; every document stays."""
    return suffix.without_repeats(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_strings),
    ("packing", pack_tokens),
]

#: No stage but the rows of the first can be told in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents."""
    work, docs = Workspace(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.put(stage(spark, docs, sf_dir), name)
    return docs
