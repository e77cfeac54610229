"""Pages: text, links, the crawl's frontier, and pages of scanned documents."""

from pyspark.sql import functions as F

from corvid.functions import text as T
from corvid.functions import url as U
from corvid.plans.catalog import Tables, query, squashed
from corvid.plans.entities import CANON
from corvid.sources import files, html, pdf


@query(r"SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), ''), 'No Title') AS title FROM pages")
def page_title(t: Tables):
    return t.pages.select("page_id", html.page_title(F.col("html")).alias("title"))


@query()
def page_headers(t: Tables):
    return html.parsed(t.pages).select("page_id", F.array_join("headers", "|").alias("headers"))


@query()
def page_content(t: Tables):
    return html.parsed(t.pages).select("page_id", "title", "content")


HREF = r"""h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href=["'']([^"'']*)["'']', 1)) AS href FROM pages)"""
ROOT = "regexp_extract(url, '(?i)^(https?://[^/?#]*)', 1)"
FULL = f"CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN regexp_matches(href, '(?i)^[a-z][a-z0-9+.-]*:') THEN '' WHEN starts_with(href, '//') THEN lower(regexp_extract(url, '(?i)^(https?):', 1)) || ':' || href WHEN starts_with(href, '/') THEN {ROOT} || href WHEN href = '' OR starts_with(href, '#') THEN url ELSE {ROOT} || CASE WHEN regexp_replace(regexp_extract(url, '(?i)^https?://[^/?#]*([^?#]*)', 1), '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '(?i)^https?://[^/?#]*([^?#]*)', 1), '[^/]*$', '') END || href END"
LINKS = f"{HREF}, f AS (SELECT page_id, url, {FULL} AS full_ FROM h), k AS (SELECT DISTINCT page_id, url, regexp_replace({CANON.format('full_')}, '^https?', lower(regexp_extract(url, '(?i)^(https?):', 1))) AS link FROM f WHERE full_ <> '')"
HOST = "regexp_replace(lower(regexp_extract({0}, '(?i)^https?://([^/?#]*)', 1)), '^www\\.', '')"


@query(f"WITH {LINKS} SELECT page_id, link FROM k")
def page_links(t: Tables):
    return html.links(t.pages).select("page_id", "link")


#: A link to another host, which every page has besides its own.
OUTSIDE = "<a href='https://elsewhere.example/p'>"


@query(f"WITH {LINKS} SELECT page_id, link FROM (SELECT * FROM k UNION ALL SELECT page_id, url, 'https://elsewhere.example/p' FROM pages) WHERE {HOST.format('url')} = {HOST.format('link')}")
def internal_links(t: Tables):
    """Of the links of all pages, with one to another host on each."""
    return html.internal_links(t.pages.withColumn("html", F.concat("html", F.lit(OUTSIDE)))).select("page_id", "link")


@query(f"WITH f AS (SELECT page_id, {ROOT} || CASE page_id % 5 WHEN 0 THEN '/b' WHEN 1 THEN '/c/d' WHEN 2 THEN '/' WHEN 3 THEN '/x/z' ELSE '/e' END AS full_ FROM pages) SELECT page_id, {CANON.format('full_')} AS link FROM f")
def resolve_url(t: Tables):
    """Links with dot segments and queries, from a page /x/y; the SQL has what they must come to."""
    hrefs = F.array(*map(F.lit, ("/a/../b?q=1", "../c/./d#top", "../../..", "z?x=../..", "./../e/")))
    base = F.concat(F.regexp_extract("url", r"(?i)^(https?://[^/?#]*)", 1), F.lit("/x/y"))
    return t.pages.select("page_id", U.resolve_url(base, F.get(hrefs, (F.col("page_id") % 5).cast("int"))).alias("link"))


@query(f"WITH {LINKS} SELECT DISTINCT link AS url FROM k WHERE link NOT IN (SELECT {CANON.format('url')} FROM pages)")
def frontier_except(t: Tables):
    seen = t.pages.select(U.canonical_url(F.col("url")).alias("url"))
    return html.links(t.pages).select(F.col("link").alias("url")).distinct().join(seen, "url", "left_anti")


@query()
def crawl_frontier(t: Tables):
    k = html.links(t.pages).select(U.canonical_url(F.col("url")).alias("url"), "link")
    return html.crawl(k, k.agg(F.min("url").alias("url")), 200)


@query(f"WITH {LINKS} SELECT link AS url, min(page_id) AS first_page FROM k GROUP BY link")
def ordered_dedup(t: Tables):
    return html.links(t.pages).groupBy(F.col("link").alias("url")).agg(F.min("page_id").alias("first_page"))


@query(f"WITH x AS (SELECT 1 AS position, '<urlset>' || string_agg('<url><loc> ' || url || ' </loc></url>', '' ORDER BY page_id) || '</urlset>' AS xml FROM pages) SELECT {CANON.format('url')} AS url, min(page_id) AS first_page FROM pages GROUP BY 1")
def sitemap_urls(t: Tables):
    xml = t.pages.select(F.col("page_id").alias("position"), F.concat(F.lit("<urlset><url><loc> "), "url", F.lit(" </loc></url></urlset>")).alias("xml"))
    return html.sitemap_urls(xml).select("url", F.col("position.file").alias("first_page"))


@query("SELECT count(*) AS discovered, count(*) FILTER (html <> '') AS fetched, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages")
def crawl_metrics(t: Tables):
    return t.pages.agg(F.count("*").alias("discovered"), F.count_if(F.col("html") != "").alias("fetched"), F.sum(F.octet_length("html")).cast("long").alias("bytes"))


@query(f"SELECT page_id, sha256({CANON.format('url')}) AS id, {CANON.format('url')} AS source, 'p' || CAST(page_id % 3 AS VARCHAR) AS book, 'c' AS chapter FROM pages")
def document_from_page(t: Tables):
    none = F.lit(None).cast("string")
    rows = t.pages.select("page_id", F.sha2(U.canonical_url(F.col("url")), 256).alias("id"), "url", none.alias("source"), F.col("page_id").cast("string").alias("title"), F.col("html").alias("body"), none.alias("content"), F.array(F.concat(F.lit("p"), F.col("page_id") % 3), F.lit("c")).alias("headers"), *(none.alias(c) for c in ("book", "chapter", "verse", "section")))
    out = files.document_rows(rows)
    return out.select(F.col("title").cast("long").alias("page_id"), "id", "source", "book", "chapter")


# Scanned pages: a document's lines are its pages; every seventh line opens a chapter.
PAGED = "g AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, unnest(generate_series(1, len(string_split(text, chr(10))))) AS page FROM documents), pg AS (SELECT doc_id, page, CASE WHEN page % 7 = 3 THEN 'Chapter ' || CAST(page // 7 + 1 AS VARCHAR) || ':' END AS chapter FROM g)"


def paged(t: Tables):
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "body")).withColumn("page", (F.col("pos") + 1).cast("long"))
    rows = rows.withColumn("text", F.when(F.col("page") % 7 == 3, F.concat(F.lit("Chapter "), F.floor(F.col("page") / 7) + 1, F.lit(": on\n"), "body")).otherwise(F.lower("body")))
    return rows.withColumn("chapter", F.when(F.col("page") % 7 == 3, T.chapter_info(F.col("text"))))


@query(f"WITH {PAGED} SELECT doc_id, page, chapter FROM pg WHERE chapter IS NOT NULL")
def chapter_info(t: Tables):
    return paged(t).where("chapter is not null").select("doc_id", "page", "chapter")


@query(f"WITH {PAGED} SELECT doc_id, page, last_value(chapter IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chapter FROM pg")
def chapter_ffill(t: Tables):
    return pdf.chapter_ffill(paged(t).select("doc_id", "page", "chapter"), "doc_id")


@query(f"WITH {PAGED}, x AS (SELECT doc_id, page, last_value(chapter IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chapter FROM pg WHERE page <= 50) SELECT doc_id, chapter, min(page) AS page, max(page) AS pages_span FROM x WHERE chapter IS NOT NULL GROUP BY doc_id, chapter")
def chapter_islands(t: Tables):
    return pdf.chapter_islands(paged(t).select("doc_id", "page", "chapter"), "doc_id")


@query(f"WITH {PAGED} SELECT chapter, array_to_string(list_sort(list_distinct(list(page))), '|') AS pages FROM pg WHERE chapter IS NOT NULL GROUP BY chapter")
def chapter_pages(t: Tables):
    return pdf.chapter_pages(paged(t).select("chapter", "page")).select("chapter", F.array_join(F.col("pages").cast("array<string>"), "|").alias("pages"))


@query("SELECT doc_id, source || ' vol ' || lang AS title FROM documents")
def book_title(t: Tables):
    return t.documents.select("doc_id", T.book_title(F.concat("source", F.lit("_vol-"), "lang", F.lit(".PDF"))).alias("title"))


@query(f"WITH g AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, unnest(generate_series(1, len(string_split(text, chr(10))))) AS page FROM documents) SELECT 'f' || CAST(doc_id AS VARCHAR) || '#page=' || CAST(page AS VARCHAR) AS source, 'a_b' || ' (page ' || CAST(page AS VARCHAR) || ')' AS title, 'a b' AS book, sha256({squashed('body')}) AS page_hash, page FROM g WHERE trim(body) <> ''")
def pdf_page_document(t: Tables):
    rows = t.documents.select(F.concat(F.lit("f"), "doc_id").alias("base"), F.lit("a_b").alias("title"), F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("page", (F.col("pos") + 1).cast("long"))
    return pdf.page_documents(rows)


@query()
def pdf_reading_order(t: Tables):
    """Lines as blocks in two columns."""
    rows = t.documents.select(F.col("doc_id").cast("int").alias("page"), F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    x0 = F.when(F.col("block_no") % 2 == 0, 50.0).otherwise(320.0)
    return pdf.reading_order(rows.select("page", "block_no", x0.alias("x0"), (F.col("block_no") * 12.0).alias("y0"), (x0 + 200.0).alias("x1"), (F.col("block_no") * 12.0 + 10).alias("y1"), "text"))
