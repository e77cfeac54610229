"""Text functions, Column to Column. White space and words are Unicode's, as (?U) says."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def squash(t: Column) -> Column:
    """Runs of white space as one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)\s+", " "))


def content_hash(t: Column) -> Column:
    return F.sha2(squash(t), 256)


def document_hash(title: Column, content: Column) -> Column:
    return content_hash(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit(""))))


def word_count(t: Column) -> Column:
    return F.size(F.filter(F.split(squash(t), " "), lambda w: w != ""))


def dedup_key(t: Column) -> Column:
    return F.lower(squash(t))


def query_terms(q: Column) -> Column:
    """Distinct words of more than two characters, in lower case and order of first use."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(q), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.length(w) > 2))


def normalize_ocr(t: Column) -> Column:
    """A letter that stands alone is joined to the word after it."""
    return F.regexp_replace(t, r"(?iU)\b([a-z])\s+(\w+)", "$1$2")


def strip_tags(t: Column) -> Column:
    """Takes out reasoning blocks: closed ones, then what follows a tag that is never closed."""
    for tag in ("environment_details", "thinking", "reasoning"):
        t = F.regexp_replace(t, f"(?is)<{tag}>.*?</{tag}>", "")
    for tag in ("environment_details", "thinking", "reasoning"):
        t = F.regexp_replace(t, f"(?is)<{tag}>.*$", "")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def strip_leading_ref(t: Column, ref: Column) -> Column:
    """Takes a text's own location from its start, with the dash behind it. A null or empty ref changes nothing."""
    quoted = F.concat(F.lit(r"(?i)^\Q"), F.replace(ref, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\s*[-–—]?\s*"))
    return F.when(F.coalesce(ref, F.lit("")) == "", t).otherwise(F.regexp_replace(t, quoted, F.lit("")))


def clean_content(t: Column, ref: Column) -> Column:
    return F.trim(strip_leading_ref(strip_tags(F.coalesce(t, F.lit(""))), ref))


def shortened(t: Column, most: int, kept: int) -> Column:
    """At most so many characters, else the first kept and three dots."""
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, kept), F.lit("...")))


def preview(t: Column) -> Column:
    return shortened(squash(t), 220, 217)


def text_sample(t: Column) -> Column:
    return shortened(squash(t), 240, 240)


def is_text(t: Column) -> Column:
    """Not blank, no binary signature, at most 5 % control characters."""
    other = F.length(F.regexp_replace(t, r"[^\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    signature = F.startswith(t, F.lit("%PDF")) | F.startswith(t, F.lit("\x89PNG")) | F.startswith(t, F.lit("GIF8"))
    return (F.trim(squash(t)) != "") & ~signature & (other / F.length(t) <= 0.05)


def sentences(t: Column) -> Column:
    """Split after . ! or ? and white space; pieces trimmed, blank ones left out."""
    return F.filter(F.transform(F.split(t, r"(?U)(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def keyword_tokens(t: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(t), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.length(w) > 2)


#: Words that never are a unit's keywords.
STOPWORDS = [
    "this", "that", "with", "from", "they", "them", "were", "been", "have", "has",
    "will", "would", "could", "should", "their", "there", "here", "what", "when",
    "where", "which", "while", "about", "after", "before", "because", "been",
    "being", "into", "than", "then", "over", "also", "some", "such", "only",
    "very", "just", "like", "more", "most", "other", "these", "those", "them",
]


def significant_tokens(t: Column) -> Column:
    words = F.regexp_extract_all(F.lower(t), F.lit("[a-zA-Z0-9à-ỹÀ-Ỹ]{4,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOPWORDS))


def split_stats(t: Column) -> list[Column]:
    """words, short words of up to three characters, and their ratio."""
    w = F.filter(F.split(squash(t), " "), lambda x: x != "")
    short = F.size(F.filter(w, lambda x: F.length(x) <= 3))
    return [F.size(w).alias("words"), short.alias("short_words"), F.round(F.when(F.size(w) > 0, short / F.size(w)).otherwise(0.0), 6).alias("short_ratio")]


def citations(t: Column) -> Column:
    """References in square brackets: a one-word book, a number, and perhaps a verse."""
    return F.regexp_extract_all(t, F.lit(r"\[([A-Za-z]+\s*\d+(?::\d+)?)\]"), F.lit(1))


def book_title(t: Column) -> Column:
    """A file name as a title: no .pdf, spaces for _ and -."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(?i)\.pdf$", ""), "[_-]", " "), r"\s+", " "))


def chapter_info(t: Column) -> Column:
    """The chapter a page's text names: a numbered heading, a heading line, or a line of capitals among its first three lines; else null."""
    numbered = F.trim(F.regexp_extract(t, r"(?im)^(\d+\.?\s*Chapter\s*\d+|\bChapter\s+\d+[:\s]|\bSection\s+\d+[:\s]|\bArticle\s+\d+[:\s])", 1))
    heading = F.trim(F.regexp_extract(t, r"(?im)^([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s*(?:Chapter|Section|Article)\s*\d+)$", 1))
    shouted = F.filter(F.transform(F.slice(F.split(t, "\n"), 1, 3), lambda x: F.trim(x)), lambda x: (F.length(x) > 3) & (F.length(x) < 80) & (F.upper(x) == x) & (F.lower(x) != x) & x.contains(" "))
    return F.coalesce(F.nullif(numbered, F.lit("")), F.nullif(heading, F.lit("")), F.initcap(F.get(shouted, F.lit(0))))


#: Fixed value: a reasoning block that is closed within one piece of a stream.
CLOSED_BLOCK = r"(?is)<(?:environment_details|thinking|reasoning)>.*?</(?:environment_details|thinking|reasoning)>"


def clean_piece(t: Column) -> Column:
    """A piece of a streamed answer without the blocks that it holds whole; a block cut over pieces stays."""
    return F.regexp_replace(t, CLOSED_BLOCK, "")


def format_bytes(n: Column) -> Column:
    """A size in B, KB, MB, GB or TB with one decimal, ties to the even digit."""
    text = lambda power, unit: F.concat(F.replace(F.format_number(n.cast("double") / 1024**power, 1), F.lit(","), F.lit("")), F.lit(unit))
    out = F.when(n < 1024, text(0, "B"))
    for power, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(n < 1024 ** (power + 1), text(power, unit))
    return out.otherwise(text(4, "TB"))


@F.pandas_udf(ArrayType(StringType()))
def normalized_path(paths: pd.Series) -> pd.Series:
    """A path's parts that are not empty in compatibility form (NFKD), lower case and trimmed. No built-in function normalises Unicode."""
    return paths.map(lambda p: None if p is None else [unicodedata.normalize("NFKD", x).lower().strip() for x in p if x])
