"""Regions and lines that recognisers give for a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions.text import html_text

LINES = "array<struct<text:string,confidence:double,bbox:array<int>,order:int>>"
REGIONS = "array<struct<type:string,text:string,bbox:array<double>>>"


def lines_of(x: Column) -> Column:
    """Lines from JSON, an empty array if it can't be read; blank lines are left out."""
    return F.filter(F.coalesce(F.from_json(x, LINES), F.array().cast(LINES)), lambda r: F.length(F.trim(r["text"])) > 0)


def json_of(lines: Column) -> Column:
    return F.to_json(lines)


def text_of(lines: Column) -> Column:
    """The text of lines in their order."""
    return F.array_join(F.transform(F.array_sort(F.transform(lines, lambda r: F.struct(r["order"].alias("order"), r["text"].alias("text")))), lambda r: r["text"]), "\n")


def regions_of(x: Column) -> Column:
    """Regions from JSON that have a box."""
    return F.filter(F.coalesce(F.from_json(x, REGIONS), F.array().cast(REGIONS)), lambda r: r["bbox"].isNotNull() & (F.size(r["bbox"]) == 4))


def markdown(regions: Column) -> Column:
    """Regions as markdown: titles as headings, tables as they are, figures as links; headers and footers are left out."""
    kept = F.filter(regions, lambda r: ~r["type"].isin("header", "footer", "page_number"))
    part = lambda r: (
        F.when(r["type"] == "title", F.concat(F.lit("# "), r["text"])).when(r["type"] == "figure", F.lit("![figure]()")).otherwise(r["text"])
    )
    return F.array_join(F.filter(F.transform(kept, part), lambda s: F.length(s) > 0), "\n\n")


def box(corners: Column) -> Column:
    """[left, top, right, bottom] as [left, top, width, height]."""
    at = lambda i: F.element_at(corners, i)
    return F.when(F.size(corners) == 4, F.array(at(1), at(2), at(3) - at(1), at(4) - at(2)))


def hull(points: Column) -> Column:
    """The box [left, top, width, height] round an array of [x, y]."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))


def table_text(x: Column) -> Column:
    """The text of a table given as HTML."""
    return html_text(x)
