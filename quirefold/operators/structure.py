"""Contents, links between files, plans and their checks, summaries of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.operators.ranking import followers


def suffixes(x: Column) -> Column:
    """All ends of a short text, itself first."""
    return F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.substring(x, i, F.length(x)))


def resolved(links: DataFrame, files: DataFrame, group: str, href: str, place: str) -> DataFrame:
    """``links`` with ``place``: that of the file a link leads to, and ``how``.

    A link is looked for as it stands ('exact'), then without its fragment ('bare'),
    then by one's being the end of the other ('end'); of several files the first by
    place.  Ends meet by a join on all of them.  Links that lead nowhere are left out.
    """
    held = files.where(F.length(href) > 0).groupBy(group, href).agg(F.min(place).alias(place))
    asked = links.where(F.length(href) > 0).withColumn("_bare", F.split_part(F.col(href), F.lit("#"), F.lit(1)))
    exact = asked.join(held, [group, href]).withColumn("how", F.lit("exact"))
    rest = asked.join(held.select(group, href), [group, href], "left_anti")
    named = held.withColumnRenamed(href, "_bare")
    bare = rest.join(named, [group, "_bare"]).withColumn("how", F.lit("bare"))
    last = rest.join(named.select(group, "_bare"), [group, "_bare"], "left_anti")
    ends = held.select(group, F.explode(suffixes(F.col(href))).alias(href), place)
    inner = last.join(ends, [group, href]).select(*last.columns, place)
    outer = last.withColumn("_end", F.explode(suffixes(F.col(href)))).join(held.withColumnRenamed(href, "_end"), [group, "_end"]).select(*last.columns, place)
    end = inner.unionByName(outer).groupBy(*last.columns).agg(F.min(place).alias(place)).withColumn("how", F.lit("end"))
    return exact.unionByName(bare.select(*exact.columns)).unionByName(end.select(*exact.columns)).drop("_bare")


def outline(entries: DataFrame, group: str, level: str, title: str, place: str, pages: DataFrame, synthetic: str = "all") -> DataFrame:
    """(group, chapter_no, section_no, title, first, last) from a table of contents (level, title, place from 0).

    Entries of level 1 or less begin chapters, deeper ones sections; those before the first
    chapter are in chapter 1.  An entry ends before the next one begins, the last with the
    book; negative places are 0.  A group of ``pages`` (group, n) without entries is one section.
    """
    rows = entries.select(group, level, title, F.greatest(F.lit(0), F.col(place)).alias("first")).join(pages.select(group, "n"), group)
    order = W.partitionBy(group).orderBy("first", level, title)
    chapter = F.greatest(F.lit(1), F.sum((F.col(level) <= 1).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    last = F.greatest(F.col("first"), F.coalesce(F.lead("first").over(order) - 1, F.col("n") - 1))
    held = rows.withColumn("chapter_no", chapter).withColumn("last", last)
    numbered = held.withColumn("section_no", F.row_number().over(W.partitionBy(group, "chapter_no").orderBy("first", level, title)))
    bare = pages.join(entries.select(group).distinct(), group, "left_anti")
    one = bare.select(group, F.lit(1).alias("chapter_no"), F.lit(1).alias("section_no"), F.lit(synthetic).alias(title), F.lit(0).alias("first"), F.greatest(F.lit(0), F.col("n") - 1).alias("last"))
    return numbered.select(*one.columns).unionByName(one)


def orphans(children: DataFrame, parent: str, parents: DataFrame, key: str) -> DataFrame:
    """The rows whose parent is named but does not exist."""
    return children.where(F.col(parent).isNotNull()).join(parents.select(F.col(key).alias(parent)).distinct(), parent, "left_anti")


def checked(children: DataFrame, parent: str, parents: DataFrame, key: str) -> DataFrame:
    """``children``, to be written only if all their parents exist; an orphan is an error that names it."""
    found = orphans(children, parent, parents, key).select(parent).limit(5).collect()
    if found:
        raise ValueError(f"no parent for {[r[0] for r in found]}")
    return children


def source_summary(pages: DataFrame, group: str, place: str, mode: str, text: str, sample: int = 20) -> DataFrame:
    """(group, pages, native_share, mean_chars): how many pages a source has, and what its first ones are like."""
    first = F.col(place) < sample
    native = F.avg(F.when(first, (F.col(mode) == "native").cast("double")))
    chars = F.avg(F.when(first, F.coalesce(F.length(text), F.lit(0))))
    return pages.groupBy(group).agg(F.count(F.lit(1)).alias("pages"), F.round(native, 4).alias("native_share"), F.round(chars, 2).alias("mean_chars"))


def ingest_plan(found: DataFrame, key: str, size: str, held: DataFrame, most: int | None = None, dry: bool = False) -> DataFrame:
    """``found`` with ``status``: skipped (held already), failed (empty), beyond (over ``most`` documents), else ingested or would-ingest.

    The most documents are taken in the order of their keys.
    """
    known = found.join(held.select(key).distinct().withColumn("_held", F.lit(True)), key, "left")
    open_ = known.where(F.col("_held").isNull() & (F.col(size) > 0)).select(key)
    chosen = (open_ if most is None else open_.orderBy(key).limit(most)).withColumn("_take", F.lit(True))
    done = known.join(chosen, key, "left")
    status = (
        F.when(F.col("_held"), "skipped").when(F.coalesce(F.col(size), F.lit(0)) <= 0, "failed").when(F.col("_take").isNull(), "beyond").otherwise("would-ingest" if dry else "ingested")
    )
    return done.withColumn("status", status).drop("_held", "_take")


def ingested(pages: DataFrame, document: str, place: str, key: str) -> dict[str, DataFrame]:
    """The tables one source gives: its document, its pages, and the links from page to page."""
    return {
        "documents": pages.groupBy(F.col(document).alias("id")).agg(F.count(F.lit(1)).alias("pages"), F.max(place).alias("last")),
        "pages": pages,
        "next": followers(pages.where(F.col(place).isNotNull()), document, place, key),
    }


def status_counts(df: DataFrame, group: str, status: Column, values: list[str]) -> DataFrame:
    """(group, a count for each status)."""
    return df.select(group, status.alias("_s")).groupBy(group).agg(*[F.count_if(F.col("_s") == v).alias(v) for v in values])
