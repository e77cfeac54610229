"""Chunks and documents as they are stored, read back and shown, and what runs over them report."""

from pyspark.sql import functions as F

from corvid.functions import location as L
from corvid.functions import text as T
from corvid.operators import chunking, ingest, retrieval, storage
from corvid.plans.catalog import LINES, META, Tables, joined, lines, query, squashed
from corvid.plans.entities import KEY3
from corvid.sources import files
from corvid.streaming import sessions

HASH = f"sha256({squashed('content')})"


@query(f"""WITH {META}, p AS (SELECT doc_id, content, coalesce(headers, CAST([] AS VARCHAR[])) AS h, [book, chapter, section, verse, source, title] AS k FROM m),
u AS (SELECT doc_id, h, unnest(k) AS x, unnest(generate_series(1, 6)) AS n FROM p), d AS (SELECT doc_id, x, min(n) AS n FROM u WHERE x IS NOT NULL AND x <> '' AND NOT list_contains(h, x) GROUP BY doc_id, x),
s AS (SELECT doc_id, string_agg(x, '|' ORDER BY n) AS x FROM d GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'own' ELSE concat_ws('|', nullif(array_to_string(h, '|'), ''), s.x) END AS categories, CASE WHEN doc_id % 3 = 0 THEN 'h' || CAST(doc_id AS VARCHAR) ELSE {HASH} END AS source_hash, {HASH} AS document_hash FROM p LEFT JOIN s USING (doc_id)""")
def chunk_defaults(t: Tables):
    k = F.col("doc_id")
    rows = t.meta.withColumns({"categories": F.when(k % 7 == 0, F.array(F.lit("own"))), "source_hash": F.when(k % 3 == 0, F.concat(F.lit("h"), k.cast("string"))), "document_hash": F.lit(None).cast("string")})
    return files.chunk_defaults(rows).select("doc_id", joined("categories").alias("categories"), "source_hash", "document_hash")


@query(f"WITH {META} SELECT doc_id, coalesce(nullif(book, ''), lang) AS book, coalesce(nullif(page, 0), -1) AS page, doc_id % 5 AS chunk_index, nullif(chapter, '') AS chapter FROM m")
def metadata_overlay(t: Tables):
    m = t.meta
    own = m.select("doc_id", F.col("book").alias("b"), F.col("page").alias("p"), F.col("chapter").alias("c"), F.col("lang").alias("book"), F.lit(-1).alias("page"), F.lit(9).cast("long").alias("chunk_index"))
    return storage.overlaid(own, {"chunk_index": F.col("doc_id") % 5}, {"book": F.col("b"), "page": F.col("p"), "chapter": F.col("c")}).select("doc_id", "book", "page", "chunk_index", "chapter")


@query(f"""WITH {META}, c AS (SELECT doc_id, array_to_string(list_filter(list_concat([book, chapter, section, verse], coalesce(headers, CAST([] AS VARCHAR[]))), lambda x: x IS NOT NULL AND trim(x) <> ''), '|') AS own FROM m), k AS ({KEY3}), s AS (SELECT doc_id, string_agg(word, '|' ORDER BY rank) AS words FROM k GROUP BY doc_id)
SELECT doc_id, CASE WHEN own <> '' THEN own ELSE coalesce(words, '') END AS categories FROM c LEFT JOIN s USING (doc_id)""")
def categories_filled(t: Tables):
    rows = t.meta.select("doc_id", "content", L.categories(*(F.col(c) for c in ("book", "chapter", "section", "verse", "headers"))).alias("categories"))
    return chunking.filled_categories(rows, "doc_id").select("doc_id", joined("categories").alias("categories"))


@query("SELECT event_id, 'k=' || json_extract_string(props, '$.k') || '|page=' || CAST(event_id % 9 AS VARCHAR) AS metadata FROM events")
def metadata_drop(t: Tables):
    named = {"source": F.col("event_type"), "k": F.get_json_object("props", "$.k"), "title": F.lit("t"), "chunk_index": F.lit("1"), "book": F.lit("b"), "page": (F.col("event_id") % 9).cast("string"), "verse": F.lit("2")}
    m = L.other_metadata(F.create_map(*(x for k, v in named.items() for x in (F.lit(k), v))))
    return t.events.select("event_id", joined(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("metadata"))


@query(f"""WITH {META}, p AS (SELECT *, coalesce(nullif(book, ''), headers[1]) AS b, coalesce(chapter, headers[2]) AS c, coalesce(verse, headers[3]) AS v FROM m)
SELECT doc_id, source, b AS book, c AS chapter, v AS verse, title, section, concat_ws('|', 'book=' || nullif(b, ''), 'chapter=' || nullif(c, ''), 'verse=' || nullif(v, '')) AS location, lang AS page_lang, doc_id / 10.0 AS score, md5(content) AS best_md5, CAST(1 AS INTEGER) AS n_chunks FROM p""")
def document_entry(t: Tables):
    rows = t.meta.withColumns({"document_id": F.col("doc_id"), "path": F.array("source"), "metadata": F.create_map(F.lit("title"), F.col("title"), F.lit("lang"), F.col("lang")), "categories": F.array("lang"), "score": F.col("doc_id") / 10.0})
    out = retrieval.document_entry(rows)
    return out.select(F.col("id").alias("doc_id"), "source", "book", "chapter", "verse", "title", "section", joined(F.transform(F.array_sort(F.map_entries("location")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("location"), F.array_join(F.map_values("metadata"), "|").alias("page_lang"), "score", F.md5("best_chunk").alias("best_md5"), F.size("chunks").alias("n_chunks"))


@query(f"WITH {META}, x AS (SELECT *, book || CASE WHEN chapter IS NOT NULL THEN ' ' || chapter || coalesce(':' || verse, '') ELSE coalesce(' ' || section, '') END AS whole, book || CASE WHEN chapter IS NOT NULL THEN ' ' || chapter || coalesce(':' || verse, '') ELSE '' END AS short FROM m) SELECT doc_id, CASE WHEN book <> '' THEN whole ELSE coalesce(section, '') END AS shown, CASE WHEN book <> '' THEN short ELSE '' END AS line FROM x")
def location_variants(t: Tables):
    book, chapter, verse, section = (F.col(c) for c in ("book", "chapter", "verse", "section"))
    return t.meta.select("doc_id", L.view_location(book, chapter, verse, section).alias("shown"), L.line_location(book, chapter, verse).alias("line"))


@query("""WITH n AS (SELECT event_id, event_id * event_id * (1 + 100000 * (event_id % 4)) AS n FROM events)
SELECT event_id, CASE WHEN n < 1024 THEN printf('%.1fB', n * 1.0::DOUBLE) WHEN n < 1048576 THEN printf('%.1fKB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1fMB', n / 1048576.0::DOUBLE) WHEN n < 1099511627776 THEN printf('%.1fGB', n / 1073741824.0::DOUBLE) ELSE printf('%.1fTB', n / 1099511627776.0::DOUBLE) END AS size FROM n""")
def format_bytes(t: Tables):
    # Doubles: a product of longs overflows from an id of some 5.5 million on. While it does not, both give the same rows.
    k = F.col("event_id").cast("double")
    return t.events.select("event_id", T.format_bytes(k * k * (1 + 100000 * (F.col("event_id") % 4))).alias("size"))


@query("""WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '<Thinking>' || role || chr(10) || '</reasoning>' || text WHEN turn % 3 = 1 THEN '<thinking>' || text ELSE '<reasoning>' || text || '</reasoning>' END AS p FROM conversations),
c AS (SELECT conv_id, turn, regexp_replace(p, '<(?:environment_details|thinking|reasoning)>.*?</(?:environment_details|thinking|reasoning)>', '', 'gis') AS p FROM p) SELECT conv_id, turn, md5(p) AS piece_md5 FROM c WHERE p <> ''""")
def clean_stream(t: Tables):
    own, turn = F.col("text"), F.col("turn")
    piece = F.when(turn % 3 == 0, F.concat(F.lit("<Thinking>"), "role", F.lit("\n</reasoning>"), own)).when(turn % 3 == 1, F.concat(F.lit("<thinking>"), own)).otherwise(F.concat(F.lit("<reasoning>"), own, F.lit("</reasoning>")))
    return t.conversations.select("conv_id", "turn", T.clean_piece(piece).alias("p")).where("p != ''").select("conv_id", "turn", F.md5("p").alias("piece_md5"))


def uuid_sql(x: str) -> str:
    return rf"regexp_replace(md5({x}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5')"


def uuid_of(c):
    return F.regexp_replace(F.md5(c), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


@query(f"WITH r AS (SELECT DISTINCT conv_id AS n FROM conversations) SELECT n AS conv_id, CASE WHEN n % 3 <> 1 AND n % 2 = 0 THEN {uuid_sql('CAST(n AS VARCHAR)')} ELSE {uuid_sql("'new' || CAST(n AS VARCHAR)")} END AS session_id, NOT (n % 3 <> 1 AND n % 2 = 0) AS is_new FROM r")
def session_get_or_create(t: Tables):
    n = F.col("conv_id")
    every = t.conversations.select("conv_id").distinct()
    requests = every.withColumn("session_id", F.when(n % 3 == 1, F.lit("abc")).otherwise(uuid_of(n.cast("string"))))
    stored = every.where(n % 2 == 0).select(uuid_of(n.cast("string")).alias("id")).unionByName(every.where(n == 1).select(F.lit("abc").alias("id")))
    return sessions.get_or_create(requests, stored, uuid_of(F.concat(F.lit("new"), n.cast("string")))).select("conv_id", "session_id", "is_new")


@query(f"WITH {LINES}, d AS (SELECT doc_id FROM documents WHERE trim(text) <> '' AND doc_id NOT IN (SELECT doc_id FROM labels)), n AS (SELECT (SELECT count(*) FROM d) AS processed, (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM l WHERE doc_id IN (SELECT doc_id FROM d)) AS chunks) SELECT processed, total - processed AS skipped, chunks AS total_chunks, round(CASE WHEN processed > 0 THEN chunks / processed ELSE 0 END, 6) AS average FROM n")
def regraph_stats(t: Tables):
    docs = t.documents.select(F.col("doc_id").alias("id"))
    stored = t.documents.join(t.labels, "doc_id", "left").select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"), F.col("quality").alias("graph_id"))
    return chunking.regraph_stats(docs, chunking.regraph_candidates(docs, stored), lines(t).select(F.col("doc_id").alias("document_id")))


@query(f"WITH {LINES}, r AS (SELECT md5(text) AS id, doc_id, pos, doc_id * 100000 + pos AS n FROM l) SELECT id, arg_max(doc_id, n) AS document_id, arg_max(pos, n) AS pos FROM r GROUP BY id")
def metadata_index(t: Tables):
    rows = lines(t).select(F.md5("text").alias("id"), F.col("doc_id").alias("document_id"), "pos", (F.col("doc_id") * 100000 + F.col("pos")).alias("index"))
    return storage.metadata_index(rows).select("id", "document_id", "pos")


@query("SELECT doc_id, TRUE AS small, length(text) AS n FROM documents")
def batched_scan(t: Tables):
    return files.in_batches(t.documents.select("doc_id", "text"), 64, lambda f: f.assign(small=len(f) <= 64, n=f["text"].str.len())[["doc_id", "small", "n"]], "doc_id long, small boolean, n long")


@query()
def normalized_path(t: Tables):
    return t.meta.select("doc_id", T.normalized_path(F.array("title", "book", "chapter")).alias("path"))


@query()
def chunk_documents(t: Tables):
    """Chunks of the whole table as ingest stores them."""
    docs = t.meta.select("id", "source", "title", "content", "book", "chapter", "verse", "section")
    return ingest.chunk_documents(docs)
