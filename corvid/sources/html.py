"""Raw pages to text, headings and links."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions.text import squash
from corvid.functions.url import canonical_url, is_internal, resolve_url

#: Elements whose text is not content, and those that never have any.
_DROPPED = {"script", "style", "nav", "footer", "header", "aside", "form", "iframe"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Page(HTMLParser):
    """Texts with the elements they stand in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str | None]] = []
        self.texts: list[tuple[str, tuple[int, ...]]] = []
        self.order: list[tuple[str, str | None]] = []
        self.stack: list[int] = []

    def handle_starttag(self, tag, attrs):
        if tag not in _VOID:
            self.order.append((tag, dict(attrs).get("id")))
            self.stack.append(len(self.order) - 1)

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.order[self.stack[k]][0] == tag:
                del self.stack[k:]
                break

    def handle_data(self, data):
        self.texts.append((data, tuple(self.stack)))

    def under(self, wanted) -> int | None:
        return next((k for k, (tag, own) in enumerate(self.order) if wanted(tag, own)), None)


def page_parts(html: str) -> tuple[str, list[str], str]:
    """Title, texts of h1 to h3, and the main text of a page."""
    page = _Page()
    page.feed(html or "")
    page.close()
    text_of = lambda k: "".join(t for t, at in page.texts if k in at).strip()
    title = next((text_of(k) for k, (tag, _) in enumerate(page.order) if tag == "title"), "") or "No Title"
    heads = [text_of(k) for k, (tag, _) in enumerate(page.order) if tag in ("h1", "h2", "h3")]
    gone = {k for k, (tag, _) in enumerate(page.order) if tag in _DROPPED}
    root = next((k for k in (page.under(lambda t, i: t == "main"), page.under(lambda t, i: t == "article"), page.under(lambda t, i: t == "div" and i == "content")) if k is not None and k not in gone), None)
    kept = [t.strip() for t, at in page.texts if not gone & set(at) and (root is None or root in at)]
    return title, heads, " ".join(t for t in kept if t)


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, headers, content)."""

    def run(frames):
        for f in frames:
            parts = [page_parts(h) for h in f["html"]]
            yield pd.DataFrame({"page_id": f["page_id"], "url": f["url"], "title": [p[0] for p in parts], "headers": [p[1] for p in parts], "content": [p[2] for p in parts]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, title string, headers array<string>, content string")


def page_title(html: Column) -> Column:
    """By an expression, for pages whose title has no entities."""
    return F.coalesce(F.nullif(squash(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")), F.lit("No Title"))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url, link): distinct anchors in canonical form; schemes but http and https are left out."""
    hrefs = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*?href=["']([^"']*)["']"""), F.lit(1))).alias("href"))
    return hrefs.select("page_id", "url", resolve_url(F.col("url"), F.col("href")).alias("link")).where("link != ''").distinct()


def internal_links(pages: DataFrame) -> DataFrame:
    return links(pages).where(is_internal(F.col("url"), F.col("link")))


def documents(pages: DataFrame) -> DataFrame:
    """Documents of parsed pages: canonical source, and book, chapter and verse from the headings where there are any."""
    return parsed(pages).select(F.sha2(canonical_url(F.col("url")), 256).alias("id"), canonical_url(F.col("url")).alias("source"), "title", "content", *(F.get("headers", F.lit(k)).alias(n) for k, n in enumerate(("book", "chapter", "verse"))))


def crawl(links_: DataFrame, start: DataFrame, max_pages: int) -> DataFrame:
    """(url, depth) from links (url, link): breadth first from start (url), up to max_pages, nearest and then smallest first. Each round is an anti-join with what has been seen."""
    seen = start.select("url").distinct().withColumn("depth", F.lit(0))
    front, depth, n = seen, 0, seen.count()
    while n < max_pages:
        depth += 1
        front = front.select("url").join(links_, "url").select(F.col("link").alias("url")).distinct().join(seen.select("url"), "url", "left_anti").orderBy("url").limit(max_pages - n).withColumn("depth", F.lit(depth)).persist()
        found = front.count()
        if not found:
            break
        seen, n = seen.unionByName(front), n + found
    return seen.orderBy("depth", "url").limit(max_pages)


def sitemap_urls(texts: DataFrame) -> DataFrame:
    """(url, position) from (position, xml): <loc> entries in canonical form, each at its first place."""
    locs = texts.select(F.col("position").alias("file"), F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("pos", "loc"))
    return locs.groupBy(canonical_url(F.col("loc")).alias("url")).agg(F.min(F.struct("file", "pos")).alias("position"))


def robots_sitemaps(robots: Column) -> Column:
    return F.regexp_extract_all(robots, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))


def allowed(urls: DataFrame, robots: str, agent: str = "*") -> DataFrame:
    """The URLs that a robots.txt lets the agent fetch."""

    def run(frames):
        from urllib.robotparser import RobotFileParser

        parser = RobotFileParser()
        parser.parse(robots.splitlines())
        for f in frames:
            yield f[[parser.can_fetch(agent, u) for u in f["url"]]]

    return urls.mapInPandas(run, urls.schema)
