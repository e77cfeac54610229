"""Scalars over documents and pages."""

from pyspark.sql import functions as F

from corvid.functions import location as L
from corvid.functions import text as T
from corvid.functions import url as U
from corvid.operators import graph, storage
from corvid.plans.catalog import META, WORD, Tables, joined, query, squashed

SQ = squashed("text")


@query(f"SELECT doc_id, sha256({SQ}) AS hash FROM documents")
def content_hash(t: Tables):
    return t.documents.select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query(f"SELECT doc_id, len(list_filter(string_split({SQ}, ' '), lambda w: w <> '')) AS n_words FROM documents")
def word_count(t: Tables):
    return t.documents.select("doc_id", T.word_count(F.col("text")).cast("long").alias("n_words"))


@query(rf"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '{WORD}'), lambda w: length(w) > 2))), '|') AS terms FROM benchmark")
def query_terms(t: Tables):
    return t.benchmark.select("item_id", joined(F.array_sort(T.query_terms(F.col("text")))).alias("terms"))


@query()
def normalize_ocr(t: Tables):
    return t.documents.select("doc_id", F.md5(T.normalize_ocr(F.col("text"))).alias("normal"))


def tagged(t: Tables):
    """Texts with reasoning blocks around them."""
    return t.documents.select("doc_id", F.concat(F.lit("<thinking>so "), F.col("lang"), F.lit("\nthen</thinking> "), "text", F.when(F.col("doc_id") % 2 == 0, " <reasoning>never closed").otherwise("")).alias("text"), "source")


#: A whole text without the white space at its ends.
STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, {STRIPPED} AS stripped FROM documents")
def strip_tags(t: Tables):
    return tagged(t).select("doc_id", T.strip_tags(F.col("text")).alias("stripped"))


@query(r"SELECT doc_id, regexp_replace(text, '^\s+', '') AS stripped FROM documents")
def strip_leading_ref(t: Tables):
    return t.documents.select("doc_id", T.strip_leading_ref(F.concat(F.upper("source"), F.lit(" – "), "text"), F.col("source")).alias("stripped"))


@query(f"SELECT doc_id, {STRIPPED} AS cleaned FROM documents")
def clean_content(t: Tables):
    body = F.concat(F.lit("<thinking>x</thinking>"), F.col("source"), F.lit(" - "), "text")
    return t.documents.select("doc_id", T.clean_content(body, F.col("source")).alias("cleaned"))


@query(f"WITH w AS (SELECT doc_id, list_filter(string_split({SQ}, ' '), lambda w: w <> '') AS w FROM documents) SELECT doc_id, len(w) AS words, len(list_filter(w, lambda x: length(x) <= 3)) AS short_words, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: length(x) <= 3)) / len(w) ELSE 0.0 END, 6) AS short_ratio FROM w")
def split_stats(t: Tables):
    return t.documents.select("doc_id", *T.split_stats(F.col("text"))).select("doc_id", F.col("words").cast("long").alias("words"), F.col("short_words").cast("long").alias("short_words"), "short_ratio")


@query(f"SELECT doc_id, CASE WHEN length({SQ}) <= 240 THEN {SQ} ELSE left({SQ}, 240) || '...' END AS sample FROM documents")
def text_sample(t: Tables):
    return t.documents.select("doc_id", T.text_sample(F.col("text")).alias("sample"))


@query(f"SELECT doc_id, CASE WHEN length({SQ}) <= 220 THEN {SQ} ELSE left({SQ}, 217) || '...' END AS preview FROM documents")
def preview(t: Tables):
    return t.documents.select("doc_id", T.preview(F.col("text")).alias("preview"))


@query(f"SELECT doc_id FROM documents WHERE {SQ} <> '' AND NOT starts_with(text, '%PDF') AND NOT starts_with(text, 'GIF8') AND length(regexp_replace(text, '[^\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')) / length(text) <= 0.05")
def text_filter(t: Tables):
    return t.documents.where(T.is_text(F.col("text"))).select("doc_id")


CANON = "CASE WHEN regexp_matches({0}, '(?i)^https?://[^/?#]') THEN lower(regexp_extract({0}, '(?i)^(https?)://', 1)) || '://' || regexp_replace(lower(regexp_extract({0}, '(?i)^https?://([^/?#]*)', 1)), '^www\\.', '') || CASE WHEN regexp_replace(regexp_extract({0}, '(?i)^https?://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract({0}, '(?i)^https?://[^/?#]*([^?#]*)', 1), '/+$', '') END ELSE {0} END"


@query(f"SELECT page_id, {CANON.format('url')} AS url FROM pages")
def canonical_url(t: Tables):
    return t.pages.select("page_id", U.canonical_url(F.col("url")).alias("url"))


@query("SELECT page_id, url AS source, 'Title ' || CAST(page_id AS VARCHAR) AS title FROM pages")
def strip_page_suffix(t: Tables):
    return t.pages.select("page_id", L.strip_page(F.concat("url", F.lit("#page="), "page_id")).alias("source"), L.strip_title_page(F.concat(F.lit("Title "), "page_id", F.lit(" (page "), "page_id", F.lit(")"))).alias("title"))


def cols(*names):
    return [F.col(n) for n in names]


@query(f"WITH {META} SELECT doc_id, CASE WHEN book <> '' THEN book || CASE WHEN chapter IS NOT NULL THEN ' ' || chapter || coalesce(':' || verse, '') ELSE coalesce(' ' || section, '') END ELSE '' END AS location FROM m")
def format_location(t: Tables):
    return t.meta.select("doc_id", L.format_location(*cols("book", "chapter", "verse", "section")).alias("location"))


@query(f"WITH {META} SELECT doc_id, coalesce(chapter || ':' || verse, chapter, section, '') AS ref FROM m")
def short_ref(t: Tables):
    return t.meta.select("doc_id", L.short_ref(*cols("chapter", "verse", "section")).alias("ref"))


@query(f"WITH {META}, r AS (SELECT doc_id, source, coalesce(chapter || ':' || verse, chapter, section, '') AS ref FROM m), x AS (SELECT *, lag(ref) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM r) SELECT doc_id, source, ref FROM x WHERE before IS DISTINCT FROM ref")
def short_ref_change(t: Tables):
    from pyspark.sql import Window

    rows = t.meta.select("doc_id", "source", L.short_ref(*cols("chapter", "verse", "section")).alias("ref"))
    return rows.withColumn("before", F.lag("ref").over(Window.partitionBy("source").orderBy("doc_id"))).where(~F.col("before").eqNullSafe(F.col("ref"))).select("doc_id", "source", "ref")


@query(f"WITH {META}, k AS (SELECT doc_id, unnest(['book', 'chapter', 'verse']) AS k, unnest([book, chapter, verse]) AS v FROM m) SELECT m.doc_id, coalesce(string_agg(k || '=' || v, '|' ORDER BY k) FILTER (v IS NOT NULL AND v <> ''), '') AS location FROM m LEFT JOIN k ON m.doc_id = k.doc_id GROUP BY m.doc_id")
def location_map(t: Tables):
    m = L.location_map(**{c: F.col(c) for c in ("book", "chapter", "verse")})
    return t.meta.select("doc_id", joined(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("location"))


def ordered_sql(parts: str) -> str:
    return f"WITH {META}, p AS (SELECT doc_id, {parts} AS a FROM m), u AS (SELECT doc_id, unnest(a) AS x, unnest(generate_series(1, len(a))) AS n FROM p), d AS (SELECT doc_id, x, min(n) AS n FROM u WHERE x IS NOT NULL AND trim(x) <> '' GROUP BY ALL) SELECT p.doc_id, coalesce(string_agg(x, '|' ORDER BY n), '') AS path FROM p LEFT JOIN d ON p.doc_id = d.doc_id GROUP BY p.doc_id"


@query(ordered_sql("list_concat([title, book, chapter, verse], coalesce(headers, CAST([] AS VARCHAR[])))"))
def chunk_path(t: Tables):
    return t.meta.select("doc_id", joined(L.chunk_path(*cols("title", "book", "chapter", "verse", "headers"))).alias("path"))


@query(ordered_sql("list_concat(coalesce(headers, CAST([] AS VARCHAR[])), [book, chapter, verse, section, title])"))
def doc_path(t: Tables):
    return t.meta.select("doc_id", joined(L.doc_path(*cols("headers", "book", "chapter", "verse", "section", "title"))).alias("path"))


@query(f"WITH {META} SELECT doc_id, array_to_string(list_filter(list_concat([book, chapter, section, verse], coalesce(headers, CAST([] AS VARCHAR[]))), lambda x: x IS NOT NULL AND trim(x) <> ''), '|') AS categories FROM m")
def categories(t: Tables):
    return t.meta.select("doc_id", joined(L.categories(*cols("book", "chapter", "section", "verse", "headers"))).alias("categories"))


@query(f"WITH {META} SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 7 = 0 THEN id ELSE '' END, ''), nullif(array_to_string(headers, '/'), ''), nullif(array_to_string(list_filter([book, chapter, verse, section], lambda x: x IS NOT NULL AND x <> ''), '/'), '')) AS document_id FROM m")
def document_id_fallback(t: Tables):
    none = F.lit(None).cast("string")
    return t.meta.select("doc_id", L.document_id_fallback(F.when(F.col("doc_id") % 7 == 0, F.col("id")).otherwise(""), none, none, *cols("headers", "book", "chapter", "verse", "section")).alias("document_id"))


@query(f"""WITH {META} SELECT doc_id, CASE WHEN book <> '' AND chapter IS NOT NULL THEN 'chapter:' || replace(replace(to_base64(encode('{{"h": "' || sha256({squashed("content")}) || '", "s": "' || source || '", "b": "' || book || '", "c": "' || chapter || '"}}')), '+', '-'), '/', '_') END AS chapter_id FROM m""")
def chapter_id(t: Tables):
    return t.meta.select("doc_id", L.chapter_id(T.content_hash(F.col("content")), *cols("source", "book", "chapter")).alias("chapter_id"))


@query("SELECT doc_id, 'Job ' || CAST(doc_id % 9 AS VARCHAR) || '|Mark ' || CAST(doc_id % 4 AS VARCHAR) || ':' || CAST(doc_id % 30 AS VARCHAR) AS refs FROM documents")
def citations(t: Tables):
    k = F.col("doc_id")
    text = F.concat(F.lit("See [Job "), k % 9, F.lit("] and [Mark "), k % 4, F.lit(":"), k % 30, F.lit("], not [2 Kings 3] or [none]."))
    return t.documents.select("doc_id", joined(T.citations(text)).alias("refs"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_extract(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"seen":"' || event_type || '"}' AS props FROM events""")
def metadata_set(t: Tables):
    m = storage.metadata_set(F.from_json("props", "map<string,string>"), "seen", F.col("event_type"))
    return t.events.select("event_id", F.concat(F.lit('{"k":'), m["k"], F.lit(',"seen":"'), m["seen"], F.lit('"}')).alias("props"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_roundtrip(t: Tables):
    back = F.from_json(F.to_json(F.from_json("props", "struct<k:int>")), "struct<k:int>")
    return t.events.select("event_id", back["k"].alias("k"))


@query("SELECT event_id, event_type AS chunk_id, CAST(CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE event_id % 3 + 0.5 END AS DOUBLE) AS weight FROM events")
def parse_connections(t: Tables):
    k = F.col("event_id")
    bare = F.concat(F.lit('["'), "event_type", F.lit('"]'))
    full = F.concat(F.lit('[{"chunk_id":"'), "event_type", F.lit('","weight":'), (k % 3).cast("string"), F.lit(".5}]"))
    rows = t.events.select("event_id", F.when(k % 4 == 0, bare).otherwise(full).alias("j"))
    each = rows.select("event_id", F.explode(F.from_json("j", "array<string>")).alias("c"))
    own = F.from_json("c", "struct<chunk_id:string,weight:double>")
    return each.select("event_id", F.coalesce(own["chunk_id"], F.col("c")).alias("chunk_id"), F.coalesce(own["weight"], F.lit(1.0)).alias("weight"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_concat([doc_id % 9], generate_series(greatest(1, doc_id % 5), least(7, doc_id % 5 + 3))), lambda x: x >= 1 AND x <= 7))), '|') AS pages FROM documents")
def page_ranges(t: Tables):
    from corvid.sources.pdf import page_ranges as parse

    k = F.col("doc_id")
    spec = F.concat(k % 9, F.lit(", abc, "), k % 5, F.lit("-"), k % 5 + 3)
    return t.documents.select("doc_id", joined(parse(spec, 7).cast("array<string>")).alias("pages"))


KEY3 = rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS a FROM documents), u AS (SELECT doc_id, unnest(list_filter(a, lambda x: length(x) > 2)) AS word, unnest(generate_series(1, len(list_filter(a, lambda x: length(x) > 2)))) AS pos FROM w),
c AS (SELECT doc_id, word, count(*) AS count, min(pos) AS first FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, first) AS rank FROM c) SELECT doc_id, word, count, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""


@query(KEY3)
def keyword_top3(t: Tables):
    return graph.keyword_top(t.documents.select("doc_id", "text"), "doc_id", T.keyword_tokens(F.col("text")), 3)

