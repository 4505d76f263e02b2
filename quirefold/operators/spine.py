"""The hierarchy of books, chapters, sections, pages and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.operators.ranking import carried


def walk(chunks: DataFrame, pages: DataFrame, books: DataFrame) -> DataFrame:
    """Chunks with their pages (inner) and books (left): parents are joined on their keys, so no row is multiplied."""
    p = pages.select(F.col("id").alias("pageId"), F.col("documentId").alias("book"), "sectionId", "chapterId", "docPageIndex")
    b = books.select(F.col("id").alias("book"), "title", F.col("tier").alias("bookTier"), "publicationYear")
    return chunks.join(p, "pageId").join(b, "book", "left")


def citation(title: Column, chapter: Column, section: Column, index: Column) -> Column:
    """A label of a place in a book; missing parts are left out."""
    return F.concat(F.lit("《"), F.concat_ws("·", title, chapter, section, F.concat(F.lit("p."), (index + 1).cast("string"))), F.lit("》"))


def section_ranges(pages: DataFrame) -> DataFrame:
    """(documentId, sectionId, first, last): a section ends before the next one starts, the last at the book's end."""
    starts = pages.where("sectionId IS NOT NULL").groupBy("documentId", "sectionId").agg(F.min("docPageIndex").alias("first"))
    ends = pages.groupBy("documentId").agg(F.max("docPageIndex").alias("end"))
    order = W.partitionBy("documentId").orderBy("first", "sectionId")
    last = F.greatest(F.col("first"), F.coalesce(F.lead("first").over(order) - 1, F.col("end")))
    return starts.join(ends, "documentId").select("documentId", "sectionId", "first", last.alias("last"))


def pages_in(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """(id, section): the section whose range a page's place lies in, the first by start; null before them all.

    An as-of join: pages and starts of a book are merged in order, and each page
    takes the last start at or before it, so no page meets all sections.
    """
    starts = ranges.groupBy("documentId", F.col("first").alias("at")).agg(F.min("sectionId").alias("section"))
    events = pages.select("documentId", F.col("docPageIndex").alias("at"), "id", F.lit(None).cast("string").alias("section"), F.lit(1).alias("kind")).unionByName(
        starts.select("documentId", "at", F.lit(None).cast("string").alias("id"), "section", F.lit(0).alias("kind"))
    )
    return carried(events, "documentId", ["at", "kind"], "section", "at").where("id IS NOT NULL").select("id", "section")


def ordinals(sections: DataFrame) -> DataFrame:
    """(documentId, chapterId, sectionId, chapter_no, section_no): numbers by first page, sections anew in each chapter."""
    starts = sections.where("sectionId IS NOT NULL AND chapterId IS NOT NULL").groupBy("documentId", "chapterId", "sectionId").agg(F.min("docPageIndex").alias("at"))
    chapter = F.min("at").over(W.partitionBy("documentId", "chapterId"))
    held = starts.withColumn("chapter_at", chapter)
    return held.select(
        "documentId", "chapterId", "sectionId",
        F.dense_rank().over(W.partitionBy("documentId").orderBy("chapter_at", "chapterId")).alias("chapter_no"),
        F.row_number().over(W.partitionBy("documentId", "chapterId").orderBy("at", "sectionId")).alias("section_no"),
    )


def text_choice(structured: Column, layout_status: Column, fused: Column, fusion_status: Column, native: Column) -> Column:
    """struct<text, strategy>: the laid-out text where the layout is sound, else the fused one, else the page's own; an empty text counts as none."""
    has = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    pick = lambda s, c: F.struct(c.alias("text"), F.lit(s).alias("strategy"))
    laid = has(structured) & F.coalesce(layout_status == "ok", F.lit(False))
    good = has(fused) & F.coalesce(fusion_status.isin("ok", "single"), F.lit(False))
    return F.when(laid, pick("markdown", structured)).when(good, pick("fused", fused)).when(has(native), pick("native", native)).otherwise(pick("none", F.lit(None).cast("string")))


def canonical_text(canonical: Column, text: Column) -> Column:
    """The canonical form of a text where there is one, else the text."""
    return F.coalesce(canonical, text)
