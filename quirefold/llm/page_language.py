"""Language labels of pages: what each is written in, and which labels are missing or wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import map_rows
from quirefold.llm.languages import detect
from quirefold.llm.page_lines import Furniture
from quirefold.session import spread
from quirefold.tables import latest

MISSING = ["", "unknown", "und"]
SEGMENTS = "array<struct<start:int,end:int,language:string,confidence:double>>"


def label_of(label: Column) -> Column:
    """A label as it is compared; null where it is missing."""
    folded = F.regexp_replace(F.lower(F.trim(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))), "_", "-")
    return F.when(~folded.isin(MISSING), folded)


def with_titles(pages: DataFrame, books: DataFrame) -> DataFrame:
    """Adds ``title``, that of the page's book, null if it isn't known."""
    titles = books.where("id is not null").groupBy("id").agg(F.max("title").alias("title")).withColumnRenamed("id", "documentId")
    return pages.drop("title").join(titles, "documentId", "left")


def page_languages(pages: DataFrame, books: DataFrame) -> DataFrame:
    """(id, label, language, confidence, parts, segments, length) of the pages that hold, one row a page.

    ``language`` is null for null and blank texts only; ``length`` is that of the
    text without white space at both ends; headers and page numbers of scanned pages are not counted;
    offsets of segments count within the text without them.
    """
    rows = with_titles(spread(pages.select("id", "documentId", "docPageIndex", "mode", "textFused", F.col("language").alias("label"), "fusionAt")), books)

    def run(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"language": [], "confidence": [], "parts": [], "segments": [], "length": []}
        for text, mode, title, index in zip(c["textFused"], c["mode"], c["title"], c["docPageIndex"]):
            length = len(text.strip()) if text else 0
            found = (None, None, [], [], length)
            if length:
                body = "\n".join(Furniture(text, title, index).body()) if mode == "scan" else text
                language, confidence, runs, parts = detect(body if body.strip() else text)
                found = (language, confidence, parts, [{"start": a, "end": b, "language": x, "confidence": p} for a, b, x, p, _ in runs], length)
            for k, v in zip(out, found):
                out[k].append(v)
        return {k: c[k] for k in ("id", "fusionAt", "label")} | out

    done = map_rows(rows, f"id string, fusionAt timestamp, label string, language string, confidence double, parts array<string>, segments {SEGMENTS}, length int", run)
    return latest(done, "id", "fusionAt")


def label_cases(languages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(src, page_id, language): missing and wrong labels of pages and outcomes, and the parts of mixed pages."""
    known = languages.where("language is not null and language <> 'und'")
    wrong = lambda label: label_of(label).isNull() | (label_of(label) != F.col("right"))
    page = known.withColumn("right", F.col("language")).where(wrong(F.col("label"))).select(F.lit("page").alias("src"), F.col("id").alias("page_id"), F.col("right").alias("language"))
    own = outcomes.select("page_id", F.col("language").alias("_label")).distinct()
    fuse = known.select(F.col("id").alias("page_id"), F.col("language").alias("right")).join(own, "page_id").where(wrong(F.col("_label")))
    part = known.where("language = 'mixed'").select(F.lit("segment").alias("src"), F.col("id").alias("page_id"), F.explode("parts").alias("language"))
    return page.unionByName(fuse.select(F.lit("fuse").alias("src"), "page_id", F.col("right").alias("language")).distinct()).unionByName(part)
