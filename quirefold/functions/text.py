"""Text functions as Catalyst expressions.

All take and give columns, so that they stay inside generated code; only the
Unicode normal form needs Python.  Character classes are written out, since
``\\s`` and ``\\w`` mean different things to different engines.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
KANA = r"\x{3040}-\x{30ff}"
KUNTEN = r"\x{3190}-\x{319f}"
BLANK = r" \t\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
SPACE = BLANK + r"\n\r\x{b}\x{c}\x{85}\x{2028}\x{2029}"
ZERO_WIDTH = "​‌‍⁠﻿"

GRAM_SIZES = (3, 4)
CHUNK, OVERLAP = 500, 50
QUOTES = (("「", "」"), ("『", "』"), ("“", "”"), ("‘", "’"), ("《", "》"), ("〈", "〉"))
ELLIPSIS, AROUND = "[…⋯]{1,3}(?:省略|省)?", 100


def count_of(x: Column, chars: str) -> Column:
    """How many characters of the class ``chars`` a text has."""
    return F.length(x) - F.length(F.regexp_replace(x, f"[{chars}]", ""))


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 where the whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def tidy_space(x: Column) -> Column:
    """Zero-width characters dropped, runs of horizontal space made one, spaces at the ends cut; line breaks stay."""
    return F.trim(F.regexp_replace(F.translate(x, ZERO_WIDTH, ""), f"[{BLANK}]+", " "))


def strip(x: Column) -> Column:
    """White space of any kind cut at both ends."""
    return F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", "")


@F.pandas_udf(StringType())
def nfc(x: pd.Series) -> pd.Series:
    """The composed normal form."""
    return x.str.normalize("NFC")


def translate_map(x: Column, pairs: dict[str, str]) -> Column:
    """Single characters replaced by a map."""
    return F.translate(x, "".join(pairs), "".join(pairs.values()))


def canonical_variants(rows: list[tuple[str, str]]) -> dict[str, str]:
    """variant -> canonical form from (variant, canonical) rows, by classes.

    Of a class the form named most often as canonical stands, the greater of equals.
    """
    parent: dict[str, str] = {}

    def find(c: str) -> str:
        while parent.setdefault(c, c) != c:
            c = parent[c]
        return c

    named: dict[str, int] = {}
    for variant, canon in rows:
        named[canon] = named.get(canon, 0) + 1
        parent[find(variant)] = find(canon)
    groups: dict[str, list[str]] = {}
    for c in list(parent):
        groups.setdefault(find(c), []).append(c)
    out = {}
    for members in groups.values():
        best = max(members, key=lambda c: (named.get(c, 0), c))
        out |= {c: best for c in members if c != best}
    return out


def wide_kana(x: Column) -> Column:
    """Half-width katakana made full-width, voiced pairs first."""
    voiced = dict(zip("ｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾊﾋﾌﾍﾎ", "ガギグゲゴザジズゼゾダヂヅデドバビブベボ"))
    half = dict(zip("ﾊﾋﾌﾍﾎ", "パピプペポ"))
    for c, w in voiced.items():
        x = F.replace(x, F.lit(c + "ﾞ"), F.lit(w))
    for c, w in half.items():
        x = F.replace(x, F.lit(c + "ﾟ"), F.lit(w))
    plain = "".join(chr(c) for c in range(0xFF61, 0xFFA0))
    full = "。「」、・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン゛゜"
    return F.translate(x, plain, full)


def _grams(x: Column, n: int) -> Column:
    """The n-grams of a text, none if it is shorter, in one pass: each match looks ahead by n and moves on by one."""
    return F.regexp_extract_all(x, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def char_grams(x: Column, sizes: tuple[int, ...] = GRAM_SIZES) -> Column:
    """All character n-grams of a text without its white space."""
    bare = F.regexp_replace(x, f"[{SPACE}]+", "")
    return F.concat(*[_grams(bare, n) for n in sizes])


def han_terms(x: Column, sizes: tuple[int, ...] = (2, 3, 4), most: int = 30) -> Column:
    """The first ``most`` different n-grams of a text's runs of ideographs, by run and size."""
    runs = F.regexp_extract_all(x, F.lit(f"([{HAN}]+)"), F.lit(1))
    return F.slice(F.array_distinct(F.flatten(F.transform(runs, lambda run: F.concat(*[_grams(run, n) for n in sizes])))), 1, most)


def longest_run(x: Column, chars: str = HAN, least: int = 4) -> Column:
    """The first of the longest runs of a class of characters, null below ``least``."""
    runs = F.regexp_extract_all(x, F.lit(f"([{chars}]{{{least},}})"), F.lit(1))
    return F.aggregate(runs, F.lit(None).cast("string"), lambda best, r: F.when(best.isNull() | (F.length(r) > F.length(best)), r).otherwise(best))


def quoted_spans(x: Column, low: int = 5, high: int = 300, most: int = 10) -> Column:
    """Candidate quotations, each once, the first ``most``: the texts between quotation marks, pair by pair, then 100 characters on both sides of each ellipsis."""
    found = [F.regexp_extract_all(x, F.lit(f"(?s){a}(.+?){b}"), F.lit(1)) for a, b in QUOTES]
    parts, marks = F.split(x, ELLIPSIS), F.regexp_extract_all(x, F.lit(f"({ELLIPSIS})"), F.lit(1))

    def around(i: Column) -> Column:
        # the text before a mark ends with the parts and marks before it; only as much as the window needs is put together
        before = F.aggregate(F.sequence(F.lit(0), i), F.lit(""), lambda t, j: F.right(F.concat(t, F.when(j > 0, F.get(marks, j - 1)).otherwise(""), F.get(parts, j)), F.lit(AROUND)))
        after = F.aggregate(F.sequence(i + 1, F.size(marks)), F.lit(""), lambda t, j: F.left(F.concat(t, F.get(parts, j), F.coalesce(F.get(marks, j), F.lit(""))), F.lit(AROUND)))
        return F.concat(before, F.get(marks, i), after)

    windows_ = F.when(F.size(marks) > 0, F.transform(F.sequence(F.lit(0), F.size(marks) - 1), around)).otherwise(F.array().cast("array<string>"))
    spans = F.transform(F.concat(*found, windows_), strip)
    return F.slice(F.array_distinct(F.filter(spans, lambda s: (F.length(s) >= low) & (F.length(s) <= high))), 1, most)


def windows(x: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """array<struct<no, text>>: sliding windows; the last is the first to reach the end."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(x) - size) / F.lit(float(step))).cast("int"))
    return F.when(
        F.length(x) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("no"), F.substring(x, i * step + 1, F.lit(size)).alias("text")))
    ).otherwise(F.array().cast("array<struct<no:int,text:string>>"))


def fixed_pages(x: Column, size: int = 4000) -> Column:
    """array<struct<no, text>>: a text in pages of a fixed number of characters."""
    return windows(x, size, 0)


def token_estimate(x: Column) -> Column:
    """Characters by one and a half, cut to a whole number."""
    return (F.length(x) / F.lit(1.5)).cast("int")


def html_text(x: Column) -> Column:
    """The text of a page: scripts and styles dropped, tags made line breaks, entities of the core set resolved."""
    bare = F.regexp_replace(x, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", "")
    bare = F.regexp_replace(bare, r"(?s)<[^>]+>", "\n")
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(c))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[ \t]*\n[ \t\n]*", "\n"), r"^\n+|\n+$", ""))


def latin_words(x: Column) -> Column:
    """Lower-case words of Latin letters and digits."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"([a-z0-9]+)"), F.lit(1))


def tokens(x: Column, language: Column) -> Column:
    """The tokens of a text by its language: English words, Arabic words without marks, single characters for all others (no segmenter is at hand for them)."""
    lang = F.lower(F.coalesce(language, F.lit("zh-classical")))
    english = F.regexp_extract_all(x, F.lit(r"([A-Za-z](?:[A-Za-z'\-]*[A-Za-z])?)"), F.lit(1))
    arabic = F.filter(F.transform(F.split(x, f"[{SPACE}،؛؟؍]+"), lambda w: F.regexp_replace(w, r"^[\x{200e}\x{200f}.,;:!?()\"']+|[\x{200e}\x{200f}.,;:!?()\"']+$", "")), lambda w: F.length(w) > 0)
    single = F.filter(F.split(F.regexp_replace(x, f"[{SPACE}]+", ""), ""), lambda c: F.length(c) > 0)
    blank = x.isNull() | (F.length(strip(x)) == 0)
    return F.when(blank, F.array().cast("array<string>")).when(lang == "en", english).when(lang == "ar", arabic).otherwise(single)


NEAR = 64


def edits(a: Column, b: Column) -> Column:
    """The edit distance: first within a band of NEAR edits, which suffices for most readings of one page, and in full only beyond."""
    near = F.levenshtein(a, b, NEAR)
    return F.when(a == b, 0).when(near >= 0, near).otherwise(F.levenshtein(a, b))


def error_rate(text: Column, truth: Column) -> Column:
    """Edit distance by the length of the truth, both trimmed; 0 for an empty truth."""
    a, b = strip(text), strip(truth)
    return share(edits(a, b), F.length(b))


def heading_sections(x: Column, size: int = CHUNK, least: int = 10, overlap: int = OVERLAP) -> Column:
    """Markdown cut at its headings, neighbours put together while they stay within ``size``.

    A section longer than ``size`` is cut into sliding windows; a text without
    headings is, as a whole.  What is left shorter than ``least`` is dropped.  Sections
    put together are joined by a line break, which their lengths leave out of account.
    """
    parts = F.filter(F.split(x, r"(?m)(?=^#{1,6}\s)"), lambda s: F.length(s) > 0)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    left = lambda s: F.regexp_replace(s, f"^[{SPACE}]+", "")
    pieces = lambda s: F.transform(windows(s, size, overlap), lambda w: w["text"])

    def step(a: Column, s: Column) -> Column:
        closed = F.when(F.length(a["open"]) > 0, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])
        return (
            F.when(F.length(a["open"]) + F.length(s) <= size, F.struct(a["done"].alias("done"), left(F.concat(a["open"], F.lit("\n"), s)).alias("open")))
            .when(F.length(s) > size, F.struct(F.concat(closed, pieces(s)).alias("done"), F.lit("").alias("open")))
            .otherwise(F.struct(closed.alias("done"), s.alias("open")))
        )

    merged = F.aggregate(parts, start, step, lambda a: F.when(F.length(a["open"]) > 0, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))
    whole = F.when(x.rlike(r"(?m)^#{1,6}\s"), F.filter(merged, lambda s: F.length(s) >= least)).otherwise(pieces(x))
    return whole


def han_validity(x: Column) -> Column:
    """Ideographs by the characters that are not blank."""
    return share(count_of(x, HAN), F.length(F.regexp_replace(x, f"[{SPACE}]", "")))


#: Kinds of pages by what is to be done with them.
REVIEWED = ["LAYOUT_AMBIGUITY", "READING_ORDER", "ANNOTATION", "EDITORIAL_VS_SOURCE", "KANBUN_KUNTEN", "OKURIGANA", "HENTAIGANA", "MIXED_SCRIPT"]
REFUSED = ["RARE_GLYPH", "DEGRADATION"]
PASSING = ["OK", "POLYSEMY", "CULTURAL_REFERENCE"]
SURE_BELOW, PASS_BELOW, REVIEW_BELOW = 0.02, 0.05, 0.15


def page_route(rate: Column, kind: Column) -> Column:
    """pass, needs_review or failed by error rate and kind of page; what fails by either fails."""
    return F.when(kind.isin(REFUSED) | (rate >= REVIEW_BELOW), "failed").when(kind.isin(REVIEWED) | (rate >= PASS_BELOW), "needs_review").otherwise("pass")
