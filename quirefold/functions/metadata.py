"""What the name of a file, and the package of a book, tell of an edition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 0.7
#: Words that name the work of an editor, and the layer they stand for, in order.
CUES = [("疏議", "疏議"), ("疏议", "疏議"), ("箋解", "箋解"), ("笺解", "箋解"), ("箋注", "箋解"), ("校訂", "校訂"), ("校订", "校訂"), ("点校", "校點"), ("點校", "校點"), ("校點", "校點"), ("校点", "校點"), ("補編", "校訂")]
ROLES = "撰|著|編|编|注|校點|校点|點校|点校|校訂|校订|箋解|笺解|譯|译"
WEIGHTS = {"title": 0.2, "publisher": 0.15, "year": 0.15, "layers": 0.1, "author": 0.1}


def stem(path: Column) -> Column:
    """The name without its folder and suffix, and without marks at its ends."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[A-Za-z0-9]{1,5}$", "")
    return F.trim(F.regexp_replace(name, r"^[ _.-]+|[ _.-]+$", ""))


def year_of(x: Column) -> Column:
    """The last year from 1000 to 2029 in a text."""
    years = F.regexp_extract_all(x, F.lit(r"(1[0-9]{3}|20[0-2][0-9])"), F.lit(1))
    return F.when(F.size(years) > 0, F.element_at(years, -1).cast("int"))


def publisher_of(x: Column, publishers: list[str]) -> Column:
    """The first publisher of a list that a text names."""
    return F.coalesce(*[F.when(F.contains(x, F.lit(p)), F.lit(p)) for p in publishers]) if publishers else F.lit(None).cast("string")


def layers_of(x: Column) -> Column:
    """The editors' layers a text names, each once, in the order of the cues."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(x, F.lit(cue)), layer) for cue, layer in CUES])))


def author_of(x: Column) -> Column:
    """A name of two to six characters, none of them ASCII, after dynasty and role are taken off; null for anything else, editions and houses among them."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(x, r"[（(][^（）()]*[）)]", ""), f"({ROLES})+$", ""))
    return F.when(F.length(bare).between(2, 6) & ~bare.rlike(r"[\x00-\x7f]") & ~bare.rlike("(本|版|刊|社|局|館|馆)$"), bare)


def edition(path: Column, publishers: list[str]) -> Column:
    """struct<title, groups, publisher, year, layers, author, confidence>: each part found adds to the confidence.

    A name is a title and groups in brackets; without any, what stands before an
    underscore is the author.
    """
    name = stem(path)
    groups = F.filter(F.transform(F.regexp_extract_all(name, F.lit(r"[(\[（【]([^()\[\]（）【】]+)[)\]）】]"), F.lit(1)), F.trim), lambda g: F.length(g) > 0)
    bare = F.trim(F.regexp_replace(F.regexp_replace(name, r"[(\[（【][^()\[\]（）【】]*[)\]）】]", " "), " +", " "))
    inner = F.regexp_extract(bare, "^《([^》]+)》$", 1)
    whole = F.when(inner != "", inner).otherwise(bare)
    by = F.when((F.size(groups) == 0) & whole.rlike("^[^_]+_.+$"), F.regexp_extract(whole, "^([^_]+)_(.+)$", 1))
    title = F.when(by.isNotNull(), F.trim(F.regexp_extract(whole, "^([^_]+)_(.+)$", 2))).otherwise(whole)
    tokens = F.flatten(F.transform(groups, lambda g: F.split(g, r"\s+")))
    year, publisher, layers = year_of(name), publisher_of(name, publishers), layers_of(name)
    author = F.coalesce(author_of(by), F.get(F.filter(F.transform(tokens, author_of), lambda a: a.isNotNull()), F.lit(0)))
    has = {"title": F.length(title) > 0, "publisher": publisher.isNotNull(), "year": year.isNotNull(), "layers": F.size(layers) > 0, "author": author.isNotNull()}
    points = sum((F.when(h, WEIGHTS[k]).otherwise(0.0) for k, h in has.items()), F.lit(0.0))
    named = F.when(F.length(title) > 0, title).otherwise(name)
    return F.struct(named.alias("title"), groups.alias("groups"), publisher.alias("publisher"), year.alias("year"), layers.alias("layers"), author.alias("author"), F.round(F.least(F.lit(MOST), points), 2).alias("confidence"))


def merged(own: Column, hint: Column, confidence: Column) -> tuple[Column, Column]:
    """(value, confidence): a hint fills what the name leaves open and then adds 0.15."""
    return F.coalesce(own, hint), F.when(own.isNull() & hint.isNotNull(), F.least(F.lit(1.0), confidence + 0.15)).otherwise(confidence)


def enriched(own: Column, hints: Column, publishers: list[str]) -> Column:
    """An ``edition`` with what its package says (struct<creators, publishers, dates>: arrays) put into its gaps; +0.15 once if anything changed."""
    creators = F.coalesce(F.array_join(hints["creators"], " "), F.lit(""))
    layers = F.array_distinct(F.concat(own["layers"], layers_of(creators)))
    said = F.filter(F.transform(hints["publishers"], lambda p: F.coalesce(publisher_of(p, publishers), F.lit(""))), lambda p: p != "")
    publisher = F.coalesce(own["publisher"], F.get(said, F.lit(0)), F.trim(F.get(hints["publishers"], F.lit(0))))
    year = F.coalesce(own["year"], F.get(F.filter(F.transform(hints["dates"], year_of), lambda y: y.isNotNull()), F.lit(0)))
    names = F.filter(F.transform(F.flatten(F.transform(hints["creators"], lambda c: F.split(F.trim(F.regexp_replace(c, r"[（(][^（）()]*[）)]", "")), r"\s+"))), author_of), lambda a: a.isNotNull())
    author = F.coalesce(own["author"], F.get(names, F.lit(0)))
    changed = (F.size(layers) > F.size(own["layers"])) | (own["publisher"].isNull() & publisher.isNotNull()) | (own["year"].isNull() & year.isNotNull()) | (own["author"].isNull() & author.isNotNull())
    confidence = F.when(changed, F.round(F.least(F.lit(1.0), own["confidence"] + 0.15), 2)).otherwise(own["confidence"])
    return F.struct(own["title"].alias("title"), own["groups"].alias("groups"), publisher.alias("publisher"), year.alias("year"), layers.alias("layers"), author.alias("author"), confidence.alias("confidence"))
