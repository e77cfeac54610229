"""Storage operations over orders, customers, documents and events."""

from pyspark.sql import functions as F

from corvid.operators import chunking, storage
from corvid.plans.catalog import CHUNKS, LINES, META, Tables, lines, query
from corvid.streaming import sessions

DOCS = "SELECT doc_id AS id, source, lang AS title FROM documents"
FRESH = "SELECT doc_id AS id, 'new ' || source AS source, lang AS title FROM documents JOIN labels USING (doc_id) UNION ALL SELECT item_id - 1000000 AS id, 'added' AS source, 'x' AS title FROM benchmark"


def docs(t: Tables):
    return t.documents.select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("title"))


def fresh(t: Tables):
    changed = t.documents.join(t.labels.select("doc_id"), "doc_id").select(F.col("doc_id").alias("id"), F.concat(F.lit("new "), "source").alias("source"), F.col("lang").alias("title"))
    return changed.unionByName(t.benchmark.select((F.col("item_id") - 1000000).alias("id"), F.lit("added").alias("source"), F.lit("x").alias("title")))


@query(f"WITH o AS ({DOCS}), n AS ({FRESH}) SELECT * FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n")
def upsert_documents(t: Tables):
    return storage.upsert(docs(t), fresh(t))


@query(f"WITH o AS ({DOCS}), n AS ({FRESH}) SELECT coalesce(o.id, n.id) AS id, coalesce(o.source, n.source) AS source, CASE WHEN n.id IS NOT NULL THEN n.title ELSE o.title END AS title FROM o FULL JOIN n ON o.id = n.id")
def upsert_chunks(t: Tables):
    # The document that a chunk belongs to (source) stays on conflict.
    return storage.merge(docs(t), fresh(t), "id", keep_old=("source",))


@query("WITH n AS (SELECT doc_id AS vec_id, toxic AS label FROM labels) SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM n) UNION ALL SELECT * FROM n")
def upsert_embeddings(t: Tables):
    return storage.upsert(t.embeddings.select("vec_id", "label"), t.labels.select(F.col("doc_id").alias("vec_id"), F.col("toxic").alias("label")), "vec_id")


@query("""WITH j AS (SELECT user_id AS id, event_type AS status, epoch_us(ts) AS us, event_id FROM events), h AS (SELECT id, arg_min(status, (us, event_id)) AS status, min(us) AS started_at FROM j GROUP BY id),
n AS (SELECT id, arg_max(status, (us, event_id)) AS status, max(us) AS started_at FROM j GROUP BY id) SELECT id, n.status, h.started_at FROM h JOIN n USING (id)""")
def upsert_jobs(t: Tables):
    j = t.events.select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    old = j.groupBy("id").agg(F.min_by("status", F.struct("at", "event_id")).alias("status"), F.min("at").alias("started_at"))
    new = j.groupBy("id").agg(F.max_by("status", F.struct("at", "event_id")).alias("status"), F.max("at").alias("started_at"))
    return storage.upsert_jobs(old, new)


@query("SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status, epoch_us(max(ts)) AS updated_us FROM events GROUP BY user_id")
def job_latest(t: Tables):
    rows = sessions.job_latest(t.events.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("updated_at"), "event_id"))
    return rows.select("job_id", "status", F.unix_micros("updated_at").alias("updated_us"))


@query("SELECT event_id, user_id, epoch_us(ts) AS at FROM events ORDER BY ts DESC, event_id LIMIT 20")
def recent_jobs(t: Tables):
    return t.events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).orderBy(F.col("at").desc(), "event_id").limit(20)


@query(f"WITH {CHUNKS} SELECT id, document_id FROM c WHERE document_id NOT IN (SELECT document_id FROM c JOIN labels ON labels.doc_id = c.doc_id WHERE toxic = 1 AND quality = 0)")
def delete_document(t: Tables):
    c = t.chunks
    gone = c.join(t.labels.where("toxic = 1 and quality = 0").select("doc_id"), "doc_id", "left_semi").select("document_id").distinct()
    return storage.delete_documents(c.select("id", "document_id"), gone)


@query(f"WITH {CHUNKS}, g AS (SELECT id FROM c WHERE document_id IN (SELECT max(document_id) FROM c)) SELECT vec_id FROM embeddings WHERE CAST(vec_id AS VARCHAR) NOT IN (SELECT id FROM g)")
def delete_embeddings(t: Tables):
    gone = t.chunks.agg(F.max("document_id").alias("document_id"))
    return storage.delete_embeddings(t.embedded.select("chunk_id", "vec_id"), t.chunks.select("id", "document_id"), gone).select("vec_id")


@query("SELECT o_orderkey AS id, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100")
def list_documents(t: Tables):
    return storage.list_documents(t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey"), limit=100)


@query(f"WITH {CHUNKS} SELECT id, document_id FROM c WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def chunks_by_ids(t: Tables):
    return storage.by_ids(t.chunks.select("id", "document_id"), t.embedded.select(F.col("chunk_id").alias("id")))


@query(f"WITH {LINES} SELECT doc_id, text, pos FROM l WHERE pos IN (SELECT item_id FROM benchmark)")
def chunks_by_index(t: Tables):
    from corvid.sources.files import by_index

    return by_index(lines(t).withColumnRenamed("pos", "idx"), t.benchmark.select(F.col("item_id").alias("idx"))).select("doc_id", "text", F.col("idx").alias("pos"))


@query(f"WITH {CHUNKS} SELECT id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY id) AS n FROM c")
def document_chunks(t: Tables):
    from pyspark.sql import Window

    return t.chunks.select("id", "document_id", F.row_number().over(Window.partitionBy("document_id").orderBy("id")).cast("long").alias("n"))


@query(f"WITH {META} SELECT id, page, CAST(row_number() OVER (ORDER BY page NULLS FIRST, id) AS INTEGER) AS n FROM m WHERE source = 'src10' AND book = 'src10' AND chapter = 'en'")
def chapter_chunks(t: Tables):
    from pyspark.sql import Window

    rows = storage.chapter_chunks(t.meta.withColumn("source_hash", F.col("source")), "src10", "src10", "en")
    return rows.select("id", "page", F.row_number().over(Window.orderBy(F.col("page").asc_nulls_first(), "id")).alias("n"))


@query("SELECT source AS document_id, CAST(max(CASE WHEN lang = 'es' THEN 1 ELSE 0 END) AS INTEGER) = 1 AS has_graph FROM documents GROUP BY source")
def has_graph_chunks(t: Tables):
    graph_id = F.when(F.col("lang") == "es", F.col("doc_id"))
    return t.documents.groupBy(F.col("source").alias("document_id")).agg((F.count(graph_id) > 0).alias("has_graph"))


@query("SELECT count(*) AS n FROM documents")
def count_chunks(t: Tables):
    return t.documents.agg(F.count("*").alias("n"))


@query("SELECT source AS document_id, count(*) AS n FROM documents GROUP BY source")
def chunks_per_document(t: Tables):
    return t.documents.groupBy(F.col("source").alias("document_id")).agg(F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT doc_id, pos, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(coalesce(sum(strlen(text) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM l")
def chunk_offsets(t: Tables):
    return storage.chunk_offsets(lines(t), "doc_id", "pos", F.col("text")).select("doc_id", "pos", "n_bytes", "offset")


@query("SELECT source AS document_id, arg_min(doc_id, doc_id) AS first_id, arg_min(lang, doc_id) AS title FROM documents GROUP BY source")
def documents_from_chunks(t: Tables):
    return storage.first_of_each(t.documents.select(F.col("source").alias("document_id"), F.col("doc_id").alias("first_id"), F.col("lang").alias("title")), "document_id", "first_id")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 20")
def history_window(t: Tables):
    return sessions.history_window(t.conversations, "conv_id", "turn", 20).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 4")
def history_window_4(t: Tables):
    return sessions.history_window(t.conversations, "conv_id", "turn", 4).select("conv_id", "turn", "role")


@query("SELECT conv_id, count(*) AS n, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS history_md5 FROM conversations GROUP BY conv_id")
def session_history(t: Tables):
    rows = sessions.session_history(t.conversations, "conv_id", "turn")
    return rows.select("conv_id", F.size("history").cast("long").alias("n"), F.md5(F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")).alias("history_md5"))


@query("WITH g AS (SELECT event_id, user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, user_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g")
def session_ttl(t: Tables):
    rows = sessions.session_ttl(t.events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts")
    return rows.select("event_id", "user_id", F.col("session").cast("long").alias("session"))


@query("SELECT user_id AS id, epoch_us(max(ts)) AS last_access FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 50")
def session_cap(t: Tables):
    used = t.events.groupBy(F.col("user_id").alias("id")).agg(F.unix_micros(F.max("ts").cast("timestamp")).alias("last_access"))
    return sessions.session_cap(used, 50)


@query("WITH h AS (SELECT doc_id, source, md5(text) AS content_hash FROM documents) SELECT doc_id FROM h WHERE NOT EXISTS (SELECT 1 FROM h s JOIN labels USING (doc_id) WHERE s.source = h.source AND s.content_hash = h.content_hash)")
def incremental_skip(t: Tables):
    rows = t.documents.select("doc_id", "source", F.md5("text").alias("content_hash"))
    return sessions.incremental_skip(rows, rows.join(t.labels.select("doc_id"), "doc_id", "left_semi")).select("doc_id")


@query("SELECT source AS document_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS content_md5 FROM documents GROUP BY source")
def rejoin_document(t: Tables):
    rows = t.documents.select(F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_index"), F.col("text").alias("content"))
    return chunking.rejoined(rows).select("document_id", F.md5("content").alias("content_md5"))


@query("SELECT doc_id AS id FROM documents WHERE trim(text) <> '' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def regraph_candidates(t: Tables):
    d = t.documents.select(F.col("doc_id").alias("id"))
    chunks = t.documents.join(t.labels, "doc_id", "left").select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"), F.col("quality").alias("graph_id"))
    return chunking.regraph_candidates(d, chunks)


@query(f"""WITH {META}, k AS (SELECT *, coalesce(page, TRY_CAST(verse AS INTEGER), TRY_CAST(section AS INTEGER)) AS key FROM m) SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY key NULLS LAST, id) AS INTEGER) AS n FROM k""")
def ordering_key(t: Tables):
    from pyspark.sql import Window

    from corvid.functions.location import ordering_key as keys

    none = F.lit(None)
    order = keys(F.col("page"), none.cast("int"), F.col("verse"), F.col("section"), none.cast("string"))
    return t.meta.select("doc_id", "source", F.row_number().over(Window.partitionBy("source").orderBy(*order, "id")).alias("n"))


@query(f"WITH {META}, w AS (SELECT doc_id, lag(id) OVER o AS a, id AS b, lead(id) OVER o AS c FROM m WINDOW o AS (PARTITION BY source ORDER BY page NULLS LAST, doc_id)) SELECT doc_id, concat_ws('|', a, b, c) AS window_ids FROM w")
def context_window(t: Tables):
    from corvid.operators.retrieval import context_window as around

    return around(t.meta, "source", [F.col("page").asc_nulls_last(), F.col("doc_id")]).select("doc_id", F.array_join("window_ids", "|").alias("window_ids"))


@query(f"""WITH {META}, x AS (SELECT doc_id, source, CASE WHEN book <> '' THEN book || CASE WHEN chapter IS NOT NULL THEN ' ' || chapter || coalesce(':' || verse, '') ELSE coalesce(' ' || section, '') END ELSE coalesce(section, '') END AS location, coalesce(chapter || ':' || verse, chapter, section, '') AS ref, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS content, row_number() OVER (PARTITION BY source ORDER BY page NULLS LAST, doc_id) AS n FROM m) SELECT doc_id, source, location, ref, content, CAST(n AS INTEGER) AS n FROM x""")
def document_view(t: Tables):
    from corvid.operators.retrieval import document_view as view

    return view(t.meta, "source", F.col("page").asc_nulls_last(), F.col("doc_id")).select("doc_id", "source", "location", "ref", "content", "n")
