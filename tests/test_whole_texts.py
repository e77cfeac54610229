"""Queries over whole texts: no line of a document is cut."""

import hashlib
import re

import __spark_entry__  # noqa: F401  it registers the queries
from corvid.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_whole_texts(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert any("\n" in t.strip() for t in texts.values())
    for name, column in (("strip_tags", "stripped"), ("strip_leading_ref", "stripped"), ("clean_content", "cleaned"), ("document_view", "content")):
        got = {r["doc_id"]: r[column].strip() for r in QUERIES[name](spark, SF).collect()}
        assert got == {k: t.strip() for k, t in texts.items()}, name


def test_whole_context(spark):
    m = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "doc_id", "text", "source").orderBy("doc_id").collect()
    got = {r["lang"]: r["context_md5"] for r in QUERIES["format_context"](spark, SF).collect()}
    for lang in {r["lang"] for r in m}:
        blocks = []
        for n, r in enumerate(x for x in m if x["lang"] == lang):
            k, body = r["doc_id"], re.sub(r"\s+", " ", r["text"]).strip()
            book, chapter, verse = "" if k % 6 == 5 else r["source"], lang if k % 4 != 3 else None, str(k % 50) if k % 3 == 0 else None
            tail = (f" {chapter}" + (f":{verse}" if verse else "")) if chapter else f" part {k % 7}" if k % 5 == 0 else ""
            if body:
                blocks.append(f"[{book + tail if book else n + 1}]\n{body}")
        assert got[lang] == hashlib.md5("\n\n---\n\n".join(blocks).encode()).hexdigest()
