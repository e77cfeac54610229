"""Locations, paths, categories and ids from metadata columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def given(c: Column) -> Column:
    """Null where a value is empty."""
    return F.nullif(c, F.lit(""))


def format_location(book: Column, chapter: Column, verse: Column, section: Column) -> Column:
    """Book, and chapter:verse or else the section; empty without a book."""
    book, chapter, verse, section = map(given, (book, chapter, verse, section))
    tail = F.when(chapter.isNotNull(), F.concat(F.lit(" "), chapter, F.coalesce(F.concat(F.lit(":"), verse), F.lit("")))).otherwise(F.coalesce(F.concat(F.lit(" "), section), F.lit("")))
    return F.when(book.isNull(), F.lit("")).otherwise(F.concat(book, tail))


def view_location(book: Column, chapter: Column, verse: Column, section: Column) -> Column:
    """As format_location, but the section alone where there is no book."""
    return F.when(given(book).isNull(), F.coalesce(section, F.lit(""))).otherwise(format_location(book, chapter, verse, section))


def line_location(book: Column, chapter: Column, verse: Column) -> Column:
    """As format_location, but sections are never looked at."""
    return format_location(book, chapter, verse, F.lit(None).cast("string"))


def short_ref(chapter: Column, verse: Column, section: Column) -> Column:
    """chapter:verse, chapter, or section; else empty."""
    chapter, verse, section = map(given, (chapter, verse, section))
    return F.coalesce(F.concat(chapter, F.lit(":"), verse), chapter, section, F.lit(""))


def location_map(**parts: Column) -> Column:
    pairs = [x for k, c in parts.items() for x in (F.lit(k), c)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull() & (v != ""))


def _ordered(*parts: Column) -> Column:
    return F.array_distinct(F.filter(F.concat(*parts), lambda x: x.isNotNull() & (F.trim(x) != "")))


def _own(*cs: Column) -> Column:
    return F.array(*cs)


def _headers(h: Column) -> Column:
    return F.transform(F.coalesce(h, F.array().cast("array<string>")), lambda x: F.trim(x))


def chunk_path(title: Column, book: Column, chapter: Column, verse: Column, headers: Column) -> Column:
    return _ordered(_own(title, book, chapter, verse), _headers(headers))


def doc_path(headers: Column, book: Column, chapter: Column, verse: Column, section: Column, title: Column) -> Column:
    return _ordered(_headers(headers), _own(book, chapter, verse, section, title))


def categories(book: Column, chapter: Column, section: Column, verse: Column, headers: Column) -> Column:
    """Structural categories, repeats kept."""
    return F.filter(F.concat(_own(book, chapter, section, verse), _headers(headers)), lambda x: x.isNotNull() & (F.trim(x) != ""))


def derived_categories(headers: Column, *values: Column) -> Column:
    """Categories of a stored chunk that has none: its headers, repeats kept, then each value that is not among them."""
    own = F.filter(_headers(headers), lambda x: x.isNotNull() & (x != ""))
    return F.concat(own, F.array_except(F.filter(_own(*values), lambda x: x.isNotNull() & (x != "")), own))


#: Metadata that a document's entry shows apart.
SHOWN = ("source", "title", "chunk_index", "book", "chapter", "verse", "section")


def other_metadata(metadata: Column) -> Column:
    return F.map_filter(metadata, lambda k, _: ~k.isin(*SHOWN))


def strip_page(source: Column) -> Column:
    return F.regexp_replace(source, r"#page=\d+$", "")


def strip_title_page(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, r"\s*\(page \d+\)$", ""))


def chapter_id(source_hash: Column, source: Column, book: Column, chapter: Column) -> Column:
    """chapter: and the URL-safe base64 of a JSON object; null without a book and a chapter. Texts are taken as ASCII without quotes."""
    q = lambda k, v: F.concat(F.lit(f'"{k}": "'), F.replace(F.replace(F.coalesce(v, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    body = F.concat(F.lit("{"), q("h", source_hash), F.lit(", "), q("s", strip_page(source)), F.lit(", "), q("b", book), F.lit(", "), q("c", chapter), F.lit("}"))
    return F.when(given(book).isNotNull() & given(chapter).isNotNull(), F.concat(F.lit("chapter:"), F.translate(F.regexp_replace(F.base64(F.encode(body, "utf-8")), r"\s", ""), "+/", "-_")))


def decode_chapter_id(c: Column) -> Column:
    return F.decode(F.unbase64(F.translate(F.regexp_replace(c, "^chapter:", ""), "-_", "+/")), "utf-8")


def document_id_fallback(document_id: Column, meta_document_id: Column, meta_id: Column, headers: Column, book: Column, chapter: Column, verse: Column, section: Column) -> Column:
    parts = F.filter(F.array(book, chapter, verse, section), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(given(document_id), given(meta_document_id), given(meta_id), given(F.array_join(_headers(headers), "/")), given(F.array_join(parts, "/")))


def ordering_key(page: Column, chunk_index: Column, verse: Column, section: Column, path_tail: Column) -> list[Column]:
    """Columns to order chunks of a document by: page, chunk index, verse, section or the number at the end of the path, those without any last."""
    number = lambda c: c.try_cast("int")
    return [F.coalesce(page, chunk_index, number(verse), number(section), number(path_tail)).asc_nulls_last(), F.when(page.isNotNull(), chunk_index).asc_nulls_last()]
