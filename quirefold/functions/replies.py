"""Reading JSON that was not quite written as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions.text import PASSING, REFUSED, REVIEWED

KEYWORDS = "array<struct<name:string,type:string,weight:double>>"
KINDS = ["PERSON", "PLACE", "WORK", "OFFICE", "EVENT", "CONCEPT", "DATE", "OBJECT", "LAW", "OTHER"]


def json_array(x: Column) -> Column:
    """The text of the first array in a reply: code fences dropped, commas before closing brackets too."""
    bare = F.regexp_replace(x, r"```[a-z]*", "")
    found = F.regexp_extract(bare, r"(?s)(\[.*\])", 1)
    return F.regexp_replace(F.when(found != "", found), r",[ \n\t]*([\]}])", "$1")


def keywords(x: Column) -> Column:
    """Keywords of a reply: named, each with a known type and a weight within [0, 1]; an empty array if unreadable.

    An array that can't be read (cut off, say) is salvaged object by object.
    """
    none = F.array().cast(KEYWORDS)
    loose = F.filter(F.transform(F.regexp_extract_all(x, F.lit(r"(\{[^{}]*\})"), F.lit(1)), lambda o: F.from_json(F.regexp_replace(o, r",[ \n\t]*\}", "}"), KEYWORDS[6:-1])), lambda k: k.isNotNull() & k["name"].isNotNull())
    rows = F.coalesce(F.from_json(json_array(x), KEYWORDS), loose, none)
    kept = F.filter(rows, lambda k: F.length(F.trim(k["name"])) > 0)
    return F.transform(
        kept,
        lambda k: F.struct(
            F.trim(k["name"]).alias("name"),
            F.when(F.upper(k["type"]).isin(KINDS), F.upper(k["type"])).otherwise("OTHER").alias("type"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(k["weight"], F.lit(0.7)))).alias("weight"),
        ),
    )


def page_class(x: Column) -> Column:
    """struct<kind, confidence, reason> of a classifier's reply; OK at 0.5 where it can't be read, OK for an unknown kind."""
    bare = F.regexp_extract(F.regexp_replace(x, r"```(?:json)?\s*", ""), r"(?s)(\{.*\})", 1)
    read = F.from_json(bare, "problem_class string, confidence double, reasoning string", {"mode": "PERMISSIVE"})
    kind = F.upper(F.trim(F.coalesce(read["problem_class"], F.lit("OK"))))
    known = [*PASSING, *REVIEWED, *REFUSED]
    return F.struct(
        F.when(kind.isin(known), kind).otherwise("OK").alias("kind"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(read["confidence"], F.lit(0.5)))).alias("confidence"),
        F.substring(F.trim(F.coalesce(read["reasoning"], F.lit("parse failed"))), 1, 300).alias("reason"),
    )


def review_verdict(x: Column) -> Column:
    """struct<ok, issues, revised> of a reviewer's reply: read strictly, then with double quotes for single ones, then field by field; ok where nothing can be read."""
    kind = "ok boolean, issues array<string>, revised string"
    clean = F.regexp_replace(x, r"[\x00-\x1f]", " ")
    double = F.regexp_replace(clean, r"(?<![\\])'([^']*)'", '"$1"')
    strict, loose = (F.from_json(t, kind) for t in (clean, double))
    field = lambda p: F.nullif(F.regexp_extract(double, p, 1), F.lit(""))
    single = F.struct(
        F.coalesce(F.lower(field('(?i)"?ok"?\\s*:\\s*(true|false)')) == "true", F.lit(True)).alias("ok"),
        F.coalesce(F.from_json(field('(?s)"?issues"?\\s*:\\s*(\\[.*?\\])'), "array<string>"), F.array().cast("array<string>")).alias("issues"),
        F.coalesce(field('(?s)"?revised"?\\s*:\\s*"(.*?)"(?=\\s*[,}])'), F.lit("")).alias("revised"),
    )
    whole = lambda r: F.struct(r["ok"].alias("ok"), F.coalesce(r["issues"], F.array().cast("array<string>")).alias("issues"), F.coalesce(r["revised"], F.lit("")).alias("revised"))
    return F.when(strict["ok"].isNotNull(), whole(strict)).when(loose["ok"].isNotNull(), whole(loose)).otherwise(single)


def evidence(relevance: Column, found: Column, score: Column) -> dict[str, Column]:
    """verification (the mean of both, of ten) and combined (its tenth part times the score of retrieval)."""
    verification = F.round(0.5 * relevance + 0.5 * found, 3)
    return {"verification": verification, "combined": F.round(verification / 10.0 * score, 6)}


def prompt_blocks(texts: Column) -> Column:
    """Texts as numbered blocks of a prompt."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(t, F.lit("")))), "\n\n")


def scores(x: Column, most: int) -> Column:
    """array<struct<id, score>> of a reply: ids 1 to ``most``, the first of each, scores within 0 to 10."""
    kind = "array<struct<id:int,score:double>>"
    rows = F.filter(F.coalesce(F.from_json(json_array(x), kind), F.array().cast(kind)), lambda r: (r["id"] >= 1) & (r["id"] <= most))
    ids = F.array_distinct(F.transform(rows, lambda r: r["id"]))
    return F.transform(ids, lambda i: F.struct(i.alias("id"), F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.element_at(F.filter(rows, lambda r: r["id"] == i), 1)["score"])).alias("score")))


def missing(scored: Column, most: int) -> Column:
    """The ids of 1 to ``most`` that a reply left out."""
    return F.array_except(F.sequence(F.lit(1), F.lit(most)), F.transform(scored, lambda r: r["id"]))
