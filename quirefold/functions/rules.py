"""Rules that decide about a text by its characters: scripts, language, noise, and what a recogniser got wrong.

Everything is a Catalyst expression.  A class of characters is counted by taking
it out, so one pass of a compiled pattern a class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import SPACE, count_of, share, strip

#: Character classes, in the order in which they claim a character.
CLASSES = {
    "whitespace": SPACE + r"\x{0}-\x{8}\x{e}-\x{1f}\x{7f}-\x{9f}\x{ad}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}",
    "kanbun_marks": r"\x{3190}-\x{319f}",
    "hiragana": r"\x{3040}-\x{309f}",
    "katakana": r"\x{30a0}-\x{30ff}\x{31f0}-\x{31ff}\x{ff66}-\x{ff9f}",
    "kanji": r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2ebef}\x{30000}-\x{323af}",
    "digits": r"0-9\x{ff10}-\x{ff19}",
    "latin": r"A-Za-z\x{c0}-\x{24f}",
    "cjk_punct": r"\p{P}\x{3001}-\x{303f}\x{fe30}-\x{fe4f}\x{ff00}-\x{ff0f}\x{ff1a}-\x{ff20}\x{ff3b}-\x{ff40}\x{ff5b}-\x{ff65}",
}
#: What the class of punctuation would take from katakana.
KANA_PUNCT = r"\x{30a0}\x{30fb}"
#: Simplified forms that old texts do not have.
SIMPLIFIED = "国学这个们时实选举论经历来关说让见业应么发东车马鸟鱼鸡龙龟为从对开门间问没传话头条种试爱设认请书会议体礼乐医纸厂买卖热爱写读练习汉语义师术现现状权"
SIMPLIFIED = "".join(dict.fromkeys(SIMPLIFIED))

#: Traditional forms and the simplified ones they are turned into.
TRADITIONAL = "議書國會發傳體當說時學從應經處總關節點問兩術難號實開長貞頒編歷陽樣達線劉劍軍農廣觀漢華來對"
TURNED = "议书国会发传体当说时学从应经处总关节点问两术难号实开长贞颁编历阳样达线刘剑军农广观汉华来对"

#: Fixed values of the checks on recognised text.
BLANK_PAGE = ["（空页）", "（空頁）", "(空页)", "(空頁）", "（空）", "（空頁)", "(空頁)", "（空白页）", "（空白頁）"]
DESCRIBES = ["This image", "The image", "I cannot", "I'm unable", "I am unable", "This appears", "This page", "This photograph", "This is an image", "This is a page"]
HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2a6df}"
HAN_WIDE = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2a6df}\x{2a700}-\x{2ebef}"
LONG_ENOUGH = 100


def script_mix(x: Column) -> dict[str, Column]:
    """Counts of the nine disjoint classes of a text's characters."""
    counts = {k: count_of(x, v) for k, v in CLASSES.items()}
    counts["cjk_punct"] = counts["cjk_punct"] - count_of(x, KANA_PUNCT)
    return counts | {"other": F.length(x) - sum(counts.values(), F.lit(0))}


def with_language(df: DataFrame, text: str) -> DataFrame:
    """Adds ``language``, ``rule`` and ``confidence`` by the scripts of a text; the first rule that holds decides.

    Shares are of all characters of the text without white space at its ends.  The
    counts are columns of their own first, so that each is taken once.
    """
    bare = df.withColumn("_s", strip(F.col(text)))
    mix = script_mix(F.col("_s"))
    counted = bare.withColumns({f"_{k}": mix[k] for k in ("kanbun_marks", "hiragana", "katakana", "kanji", "digits", "latin")} | {"_n": F.length("_s"), "_simple": count_of(F.col("_s"), SIMPLIFIED)})
    part = lambda *names: share(sum((F.col(f"_{n}") for n in names), F.lit(0)), F.col("_n"))
    han, kana = part("kanji", "kanbun_marks"), part("hiragana", "katakana")
    simple = share(F.col("_simple"), F.col("_kanji"))
    answer = lambda lang, rule, conf: F.struct(F.lit(lang).alias("language"), F.lit(rule).alias("rule"), F.round(conf, 4).alias("confidence"))
    ceiling = F.lit(0.95)
    found = (
        F.when(F.col(text).isNull() | (F.length(text) == 0), answer("unknown", "empty", F.lit(0.0)))
        .when(F.col("_n") < 8, answer("unknown", "too-short", F.lit(0.0)))
        .when(F.col("_kanbun_marks") > 0, answer("kanbun", "kunten-marks", ceiling))
        .when(kana >= 0.05, answer("ja", "kana-density", F.least(ceiling, 0.6 + 2.0 * kana)))
        .when((part("latin") >= 0.30) & (han >= 0.05), answer("mixed", "latin-mix", F.lit(0.85)))
        .when((han >= 0.30) & (part("digits") >= 0.03) & (simple >= 0.03), answer("zh-modern", "modern-digit", F.lit(0.85)))
        .when((han >= 0.30) & (simple >= 0.15), answer("zh-modern", "simplified-sniff", F.lit(0.80)))
        .when(han >= 0.30, answer("zh-classical", "classical-default", F.least(ceiling, 0.5 + han)))
        .otherwise(answer("unknown", "no-rule-matched", F.lit(0.0)))
    )
    named = counted.withColumn("_found", found)
    kept = [c for c in df.columns if c not in ("language", "rule", "confidence")]
    return named.select(*kept, *[F.col(f"_found.{c}").alias(c) for c in ("language", "rule", "confidence")])


def han_share(x: Column) -> Column:
    """Ideographs by all characters."""
    return share(count_of(x, HAN_WIDE), F.length(x))


def han_of_meaning(x: Column) -> Column:
    """Ideographs by the characters that are neither blank, digit nor a mark of tables."""
    return share(count_of(x, HAN), F.length(F.regexp_replace(x, r"[ \t\n|\-./:0-9]", "")))


def noise_index(x: Column) -> Column:
    """0 for a clean text (and an empty one) to 1: foreign characters, tags, tables, and tables of successive numbers."""
    of = lambda pattern, most: F.least(F.lit(1.0), F.size(F.regexp_extract_all(x, F.lit(f"({pattern})"), F.lit(1))) / F.lit(float(most)))
    return F.when(F.length(x) > 0, 0.4 * (1 - han_share(x)) + 0.2 * of("<[^>]+>", 5) + 0.2 * of(r"\|[^|\n]*\|", 10) + 0.2 * of(r"\|\s*\d+\s*\|\s*\d+\s*\|", 3)).otherwise(F.lit(0.0))


def quality_fault(reading: Column, anchor: Column) -> Column:
    """Why a reading is not to be fused with the anchor, null if it is: thrice its length, foreign, or noisy.

    A missing anchor sets no length; texts of up to 100 characters are taken by their length alone.
    """
    n, a = F.length(reading), F.coalesce(F.length(anchor), F.lit(0))
    return (
        F.when((a > 0) & (n / a > 3.0), "char_ratio")
        .when((n > LONG_ENOUGH) & (han_share(reading) < 0.40), "cjk_ratio")
        .when((n > LONG_ENOUGH) & (noise_index(reading) > 0.30), "noise_index")
    )


def most_common(x: Column) -> Column:
    """The character that makes up more than half of a text, if one does: it stands in the middle of them in order."""
    chars = F.array_sort(F.filter(F.split(x, ""), lambda c: F.length(c) > 0))
    return F.get(chars, F.floor(F.size(chars) / 2).cast("int"))


def recognition_fault(x: Column) -> Column:
    """The first fault of a text given by a model that reads images, null for a sound (or empty) one."""
    s = strip(x)
    compact = F.replace(F.replace(s, F.lit("\n"), F.lit("")), F.lit(" "), F.lit(""))
    top = most_common(compact)
    common = share(F.length(compact) - F.length(F.replace(compact, top, F.lit(""))), F.length(compact))
    ratio = han_of_meaning(s)
    begins = F.lit(False)
    for p in DESCRIBES:
        begins = begins | s.startswith(p)
    return (
        F.when(x.isNull() | (F.length(x) == 0) | s.isin(BLANK_PAGE), F.lit(None).cast("string"))
        .when(begins, "english_image_description")
        .when(s.rlike(r"<\|/?(ref|det)\|>"), "internal_token_leakage")
        .when(F.contains(s, F.lit("<table>")) | F.contains(s, F.lit("<td>")), "html_table_markup")
        .when(s.rlike(r"\|\s*1\s*\|\s*2\s*\|"), "sequential_number_table")
        .when(F.length(s) < LONG_ENOUGH, F.lit(None).cast("string"))
        .when(ratio < 0.02, F.format_string("low_cjk_ratio:%.3f", ratio))
        .when((F.length(compact) >= 20) & (common > 0.55), F.concat(F.lit("repeated_char:'"), top, F.lit("'")))
        .when(share(count_of(s, r"\p{Nd}"), F.length(s)) > 0.40, "digit_dominated")
    )


def script_fault(x: Column) -> Column:
    """A text that should be traditional but has been turned into simplified characters: at least three, and over 30 % of those that tell."""
    simple, old = count_of(x, TURNED), count_of(x, TRADITIONAL)
    bad = (simple >= 3) & (share(simple, simple + old) > 0.30)
    return F.when(bad, F.concat(F.lit("simplified_conversion:"), simple.cast("string"), F.lit("/"), (simple + old).cast("string")))


def untagged(x: Column) -> Column:
    """A text without tags and entities, runs of spaces made one."""
    bare = F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]+>", " "), r"&(#[0-9]+|#x[0-9a-fA-F]+|[a-zA-Z]+);", " ")
    return strip(F.regexp_replace(bare, " {2,}", " "))


def with_validation(df: DataFrame, text: str, traditional: Column) -> DataFrame:
    """Adds ``valid_text`` and ``error``: what may be used of a recognised text, empty with the reason where nothing.

    A text in table tags is tried again without them.  Where ``traditional`` holds, a
    text turned into simplified characters is refused too.
    """
    x = F.col(text)
    first = df.withColumn("_fault", recognition_fault(x)).withColumn("_bare", F.when(F.col("_fault") == "html_table_markup", untagged(x)))
    fit = (F.length("_bare") > 0) & (han_of_meaning(F.col("_bare")) >= 0.05) & recognition_fault(F.col("_bare")).isNull()
    rescued = first.withColumn("_fit", F.coalesce(fit, F.lit(False)))
    blank = F.coalesce(strip(x).isin(BLANK_PAGE), F.lit(False))
    body = F.when(F.col("_fault").isNull(), F.when(blank, "").otherwise(x)).when(F.col("_fit"), F.col("_bare"))
    turned = F.when(traditional, script_fault(body))
    error = F.when(F.col("_fault").isNotNull() & ~F.col("_fit"), F.col("_fault")).otherwise(turned)
    out = rescued.withColumn("_error", error).withColumn("_body", body)
    return out.select(*df.columns, F.when(F.col("_error").isNull(), F.col("_body")).otherwise("").alias("valid_text"), F.concat(F.lit("validation_failed:"), "_error").alias("error"))


def recognition_status(text: Column, error: Column) -> Column:
    """ok, empty (nothing, or refused by the checks), or failed (any other error)."""
    return F.when(error.startswith("validation_failed"), "empty").when(error.isNotNull(), "failed").when(F.length(F.trim(text)) > 0, "ok").otherwise("empty")


def layout_status(regions: Column, error: Column) -> Column:
    """ok with regions, empty without, failed on an error."""
    return F.when(error.isNotNull(), "failed").when(F.coalesce(regions, F.lit(0)) > 0, "ok").otherwise("empty")


def is_manuscript(first_status: Column, second_status: Column, chars: Column) -> Column:
    """A page on which both recognisers found nothing and whose fused text holds at most ten characters."""
    nothing = lambda c: c.isNull() | (c == "empty")
    return nothing(first_status) & nothing(second_status) & (F.coalesce(chars, F.lit(0)) <= 10)


def script_hint(tier: Column, language: Column) -> Column:
    """The script a recogniser is told to expect; null for Japanese, whose reading is chosen by language."""
    return (
        F.when(language.isin("ja", "kanbun", "japan", "jpn"), F.lit(None).cast("string"))
        .when(language == "zh-modern", "simplified")
        .when(tier == "primary", "traditional")
        .otherwise("classical")
    )
