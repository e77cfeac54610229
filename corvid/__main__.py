"""Command line: python -m corvid ingest, regraph, search, ask, view, export or clear over a folder of stored tables."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from corvid.config import ChunkConfig, Features, GraphConfig, SearchConfig, layered
from corvid.operators import ingest, rag
from corvid.operators.store import TABLES, Store
from corvid.operators.vector import HashedWords
from corvid.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corvid")
    p.add_argument("--root", required=True, help="folder of the stored tables")
    p.add_argument("--config", help="JSON file of settings")
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("ingest").add_argument("file")
    for name in ("search", "ask"):
        sub.add_parser(name).add_argument("query")
    sub.choices["ask"].add_argument("--provider", default="extractive")
    sub.add_parser("regraph").add_argument("--force", action="store_true")
    sub.add_parser("view").add_argument("document")
    export = sub.add_parser("export")
    export.add_argument("table", choices=list(TABLES))
    export.add_argument("to")
    sub.add_parser("clear").add_argument("--yes", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    """Runs a command and returns what it printed."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("corvid").getOrCreate()
    store, embedder, offered = Store(spark, a.root), HashedWords(), layered(Features, a.config)
    search = layered(SearchConfig, a.config)
    if a.what == "ingest":
        out = ingest.ingest(store, files.documents_from_json(spark, a.file), embedder, layered(ChunkConfig, a.config))
    elif a.what == "regraph":
        out = ingest.regraph(store, embedder, layered(GraphConfig, a.config), a.force)
    elif a.what == "search":
        offered.require("search")
        out = [r.asDict() for r in ingest.found(store, a.query, embedder, search).orderBy("position").collect()]
    elif a.what == "ask":
        offered.require("ask")
        out = ingest.ask(store, a.query, embedder, rag.provider(a.provider), config=search)
    elif a.what == "view":
        offered.require("view")
        out = [r.asDict() for r in ingest.stored_view(store, a.document).select("n", "location", "ref", "content").orderBy("n").toLocalIterator()]
    elif a.what == "export":
        files.export_json(store.read(a.table), a.to)
        out = {"exported": a.table, "to": a.to}
    else:
        if not a.yes:
            raise SystemExit("clear deletes all stored tables; say --yes")
        store.clear()
        out = {"cleared": a.root}
    print(json.dumps(out, ensure_ascii=False, indent=1))
    return out


if __name__ == "__main__":
    main()
