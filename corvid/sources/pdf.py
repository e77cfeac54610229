"""Pages of scanned documents, modelled as tables of text and of blocks."""

from __future__ import annotations

from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions.text import book_title, content_hash


def reading_order(blocks: DataFrame) -> DataFrame:
    """(page, block_no, position) of (page, block_no, x0, y0, x1, y1, text): columns by the gaps between the blocks' centres, top to bottom in each; blank blocks are left out."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f[f["text"].str.strip() != ""].copy()
        f["center"] = (f["x0"] + f["x1"]) / 2
        f = f.sort_values(["center", "block_no"])
        gaps = [g for g in f["center"].diff().dropna() if g > 0]
        limit = max(2 * median(gaps) if gaps else 0.0, 50.0)
        f["column"] = (f["center"].diff().fillna(0) > limit).cumsum()
        f = f.sort_values(["column", "y0", "block_no"])
        f["position"] = range(len(f))
        return f[["page", "block_no", "position"]]

    return blocks.groupBy("page").applyInPandas(run, "page int, block_no int, position int")


def page_ranges(spec: Column, total: int) -> Column:
    """Sorted pages of "1,3-5,8": junk ignored, pages clamped, a reversed range counts as its start; null if none is left."""
    part = F.transform(F.split(spec, ","), lambda p: F.trim(p))
    low = lambda p: F.regexp_extract(p, r"^(\d+)", 1).try_cast("int")
    high = lambda p: F.regexp_extract(p, r"^\d+\s*-\s*(\d+)$", 1).try_cast("int")
    clamped = lambda n: F.greatest(F.lit(1), F.least(n, F.lit(total)))
    span = lambda p: F.sequence(clamped(low(p)), F.greatest(clamped(low(p)), F.least(high(p), F.lit(total))))
    each = F.transform(F.filter(part, lambda p: p.rlike(r"^\d+(\s*-\s*\d+)?$")), lambda p: F.when(p.contains("-"), span(p)).otherwise(F.array(low(p))))
    pages = F.array_sort(F.array_distinct(F.filter(F.flatten(each), lambda n: (n >= 1) & (n <= total))))
    return F.when(F.size(pages) > 0, pages)


def chapter_pages(pages: DataFrame) -> DataFrame:
    return pages.where("chapter is not null").groupBy("chapter").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def allowed_pages(pages: DataFrame, chapters: list[str] | None = None, listed: list[int] | None = None) -> DataFrame:
    """Pages of the chapters that are also listed; all of them where nothing is left or asked for."""
    kept = pages
    if chapters:
        own = pages.where(F.col("chapter").isin(chapters))
        kept = own if own.take(1) else pages
    if listed:
        both = kept.where(F.col("page").isin(listed))
        kept = both if both.take(1) else (kept if not chapters else pages)
    return kept


def chapter_ffill(pages: DataFrame, doc: str) -> DataFrame:
    """Each page with the last chapter named up to it."""
    w = Window.partitionBy(doc).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("chapter", F.last("chapter", ignorenulls=True).over(w))


def chapter_islands(pages: DataFrame, doc: str, most: int = 50) -> DataFrame:
    """(doc, chapter, page, pages_span): a row wherever the chapter changes within the first pages; pages without one go on with it."""
    w = Window.partitionBy(doc).orderBy("page")
    filled = chapter_ffill(pages.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most), doc).where("chapter is not null")
    new = F.coalesce((F.col("chapter") != F.lag("chapter").over(w)).cast("int"), F.lit(1))
    islands = filled.withColumn("new", new).withColumn("island", F.sum("new").over(w))
    return islands.groupBy(doc, "island", "chapter").agg(F.min("page").alias("page"), F.max("page").alias("pages_span")).drop("island")


def page_documents(pages: DataFrame) -> DataFrame:
    """Documents of (base, title, page, text): a source and title per page, and hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return pages.where(F.trim(text) != "").select(F.concat("base", F.lit("#page="), "page").alias("source"), F.concat("title", F.lit(" (page "), "page", F.lit(")")).alias("title"), book_title(F.col("title")).alias("book"), content_hash(text).alias("page_hash"), "page")
