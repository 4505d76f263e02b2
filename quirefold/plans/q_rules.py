"""Queries of the character rules, the canonical form and old calendars, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import canon, dates, rules
from quirefold.functions import text as T
from quirefold.operators import fusion
from quirefold.plans.q_corpus import pages_now
from quirefold.plans.registry import PAGES, query
from quirefold.tables import load

ENGINES = {"paddle": "paddleOcrText", "deepseek": "deepseekOcrText", "qwen": "qwenVlOcrText"}
_SPACE = r" \t\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\n\r\x{b}\x{c}\x{85}\x{2028}\x{2029}"
_BLANK = r" \t\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
_CONTROL = r"\x{0}-\x{8}\x{e}-\x{1f}\x{7f}-\x{9f}\x{ad}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}"
_KANJI = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2ebef}\x{30000}-\x{323af}"
_KATAKANA = r"\x{30a0}-\x{30ff}\x{31f0}-\x{31ff}\x{ff66}-\x{ff9f}"
_LATIN = r"A-Za-z\x{c0}-\x{24f}"
_FULL_DIGITS = r"0-9\x{ff10}-\x{ff19}"
_HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2a6df}"
_SIMPLE = "国学这个们时实选举论经历来关说让见业应么发东车马鸟鱼鸡龙龟为从对开门间问没传话头条种试爱设认请书会议体礼乐医纸厂买卖热写读练习汉语义师术现状权"
_ZW = "​‌‍⁠﻿"


def n_of(x: str, chars: str) -> str:
    return f"(length({x}) - length(regexp_replace({x}, '[{chars}]', '', 'g')))"


def strip_of(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


_PUNCT = r"\p{P}\x{3001}-\x{303f}\x{fe30}-\x{fe4f}\x{ff00}-\x{ff0f}\x{ff1a}-\x{ff20}\x{ff3b}-\x{ff40}\x{ff5b}-\x{ff65}"


@query(f"""WITH {PAGES}, c AS (SELECT id, length(textFused) AS n, {n_of('textFused', _SPACE + _CONTROL)} AS whitespace, {n_of('textFused', r'\x{3190}-\x{319f}')} AS kanbun_marks, {n_of('textFused', r'\x{3040}-\x{309f}')} AS hiragana,
  {n_of('textFused', _KATAKANA)} AS katakana, {n_of('textFused', _KANJI)} AS kanji, {n_of('textFused', _FULL_DIGITS)} AS digits, {n_of('textFused', _LATIN)} AS latin,
  {n_of('textFused', _PUNCT)} - {n_of('textFused', r'\x{30a0}\x{30fb}')} AS cjk_punct FROM page_now WHERE textFused IS NOT NULL)
SELECT id, whitespace, kanbun_marks, hiragana, katakana, kanji, digits, latin, cjk_punct, n - whitespace - kanbun_marks - hiragana - katakana - kanji - digits - latin - cjk_punct AS other FROM c""")
def script_mix(spark: SparkSession, d: str) -> DataFrame:
    c = rules.script_mix(F.col("textFused"))
    return pages_now(spark, d, ["textFused"]).where("textFused IS NOT NULL").select("id", *[x.cast("bigint").alias(k) for k, x in c.items()])


@query(f"""WITH {PAGES}, s AS (SELECT id, textFused AS t, {strip_of('textFused')} AS s FROM page_now),
c AS (SELECT id, t, length(s) AS n, {n_of('s', r'\x{3190}-\x{319f}')} AS ku, {n_of('s', r'\x{3040}-\x{309f}')} + {n_of('s', _KATAKANA)} AS ka, {n_of('s', _KANJI)} AS ha, {n_of('s', _LATIN)} AS la, {n_of('s', _FULL_DIGITS)} AS di, {n_of('s', _SIMPLE)} AS si FROM s),
r AS (SELECT id, t, n, ku, ka / n AS ka, (ha + ku) / n AS ha, la / n AS la, di / n AS di, CASE WHEN ha > 0 THEN si / ha ELSE 0 END AS si FROM c),
k AS (SELECT *, CASE WHEN t IS NULL OR length(t) = 0 THEN 'empty' WHEN n < 8 THEN 'too-short' WHEN ku > 0 THEN 'kunten-marks' WHEN ka >= 0.05 THEN 'kana-density' WHEN la >= 0.3 AND ha >= 0.05 THEN 'latin-mix'
  WHEN ha >= 0.3 AND di >= 0.03 AND si >= 0.03 THEN 'modern-digit' WHEN ha >= 0.3 AND si >= 0.15 THEN 'simplified-sniff' WHEN ha >= 0.3 THEN 'classical-default' ELSE 'no-rule-matched' END AS rule FROM r)
SELECT id, CASE rule WHEN 'kunten-marks' THEN 'kanbun' WHEN 'kana-density' THEN 'ja' WHEN 'latin-mix' THEN 'mixed' WHEN 'modern-digit' THEN 'zh-modern' WHEN 'simplified-sniff' THEN 'zh-modern' WHEN 'classical-default' THEN 'zh-classical' ELSE 'unknown' END AS language, rule,
  round(CASE rule WHEN 'kunten-marks' THEN 0.95 WHEN 'kana-density' THEN least(0.95, 0.6 + 2 * ka) WHEN 'latin-mix' THEN 0.85 WHEN 'modern-digit' THEN 0.85 WHEN 'simplified-sniff' THEN 0.8 WHEN 'classical-default' THEN least(0.95, 0.5 + ha) ELSE 0 END, 4) AS confidence FROM k""")
def language_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules.with_language(pages_now(spark, d, ["textFused"]), "textFused").select("id", "language", "rule", "confidence")


_HAN_WIDE = _HAN + r"\x{2a700}-\x{2ebef}"


def noise_of(x: str) -> str:
    return (
        f"CASE WHEN length({x}) > 0 THEN 0.4 * (1 - {n_of(x, _HAN_WIDE)} / length({x})) + 0.2 * least(1.0, len(regexp_extract_all({x}, '<[^>]+>')) / 5.0) + 0.2 * least(1.0, len(regexp_extract_all({x}, '\\|[^|\\n]*\\|')) / 10.0)"
        f" + 0.2 * least(1.0, len(regexp_extract_all({x}, '\\|\\s*\\d+\\s*\\|\\s*\\d+\\s*\\|')) / 3.0) ELSE 0 END"
    )


@query(f"""WITH {PAGES} SELECT id, round({noise_of('textFused')}, 6) AS noise FROM page_now WHERE textFused IS NOT NULL""")
def noise_index(spark: SparkSession, d: str) -> DataFrame:
    return pages_now(spark, d, ["textFused"]).where("textFused IS NOT NULL").select("id", F.round(rules.noise_index(F.col("textFused")), 6).alias("noise"))


def gate_of(x: str, a: str) -> str:
    return f"CASE WHEN length({a}) > 0 AND length({x}) / length({a}) > 3 THEN 'char_ratio' WHEN length({x}) > 100 AND {n_of(x, _HAN_WIDE)} / length({x}) < 0.4 THEN 'cjk_ratio' WHEN length({x}) > 100 AND {noise_of(x)} > 0.3 THEN 'noise_index' END"


def full(x: str) -> str:
    return f"coalesce(length(trim({x}, ' ')) > 0, false)"


@query(f"""WITH {PAGES}, p AS (SELECT id, paddleOcrText AS a, deepseekOcrText AS b, qwenVlOcrText AS c FROM page_now WHERE mode = 'scan'),
g AS (SELECT id, {full('a')} AS a, {full('b')} AND {gate_of('b', 'a')} IS NULL AS b, {full('c')} AND {gate_of('c', 'a')} IS NULL AS c, CASE WHEN {full('b')} THEN {gate_of('b', 'a')} END AS fault_b, CASE WHEN {full('c')} THEN {gate_of('c', 'a')} END AS fault_c FROM p)
SELECT id, CASE WHEN a AND c THEN 'anchor+second' WHEN a AND b THEN 'anchor+first' WHEN a THEN 'anchor' WHEN c THEN 'second' WHEN b THEN 'first' ELSE 'none' END AS policy, fault_b AS deepseek_fault, fault_c AS qwen_fault FROM g""")
def fusion_policy(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = (F.col(x) for x in ENGINES.values())
    p = pages_now(spark, d, ["mode", *ENGINES.values()]).where("mode = 'scan'")
    fault = lambda x: F.when(fusion.has_text(x), rules.quality_fault(x, a))
    return p.select("id", fusion.source_of(a, b, c).alias("policy"), fault(b).alias("deepseek_fault"), fault(c).alias("qwen_fault"))


@query()
def fuse_readings(spark: SparkSession, d: str) -> DataFrame:
    """The fused text of every scanned page, with the language of what came out."""
    rows = load(spark, d, "page").where("mode = 'scan' AND id IS NOT NULL").select("id", "fusionAt", *ENGINES.values())
    fused = fusion.fused(rows, *ENGINES.values())
    named = rules.with_language(fused, "text")
    state = F.max(F.struct("fusionAt", "policy", "text", "agreement", "edits", "language", "rule"))
    return named.groupBy("id").agg(state.alias("s")).select("id", "s.policy", "s.text", "s.agreement", "s.edits", "s.language", "s.rule")


_MEANING = r" \t\n|\-./:0-9"
_FAULT = f"""CASE WHEN t IS NULL OR length(t) = 0 OR s IN ({', '.join(f"'{x}'" for x in rules.BLANK_PAGE)}) THEN NULL
  WHEN {' OR '.join(f"starts_with(s, '{x.replace(chr(39), chr(39) * 2)}')" for x in rules.DESCRIBES)} THEN 'english_image_description'
  WHEN regexp_matches(s, '<\\|/?(ref|det)\\|>') THEN 'internal_token_leakage' WHEN contains(s, '<table>') OR contains(s, '<td>') THEN 'html_table_markup'
  WHEN regexp_matches(s, '\\|\\s*1\\s*\\|\\s*2\\s*\\|') THEN 'sequential_number_table' WHEN length(s) < 100 THEN NULL
  WHEN coalesce({n_of('s', _HAN)} / nullif(length(regexp_replace(s, '[{_MEANING}]', '', 'g')), 0), 0) < 0.02 THEN 'low_cjk_ratio'
  WHEN length(k) >= 20 AND (SELECT max(n) FROM (SELECT count(*) AS n FROM (SELECT unnest(string_split(k, '')) AS c) GROUP BY c)) / length(k) > 0.55 THEN 'repeated_char'
  WHEN {n_of('s', chr(92) + 'p{Nd}')} / length(s) > 0.4 THEN 'digit_dominated' END"""
_READINGS = "r AS (" + " UNION ALL ".join(f"SELECT id, tier, '{e}' AS engine, {c} AS t FROM page_now WHERE mode = 'scan'" for e, c in ENGINES.items()) + f"), s AS (SELECT *, {strip_of('t')} AS s FROM r), k AS (SELECT *, replace(replace(s, chr(10), ''), ' ', '') AS k FROM s)"


def readings(spark: SparkSession, d: str) -> DataFrame:
    """(id, tier, engine, reading): a row for each recogniser of each scanned page."""
    p = pages_now(spark, d, ["mode", "tier", *ENGINES.values()]).where("mode = 'scan'")
    return p.select("id", "tier", *[F.col(c).alias(e) for e, c in ENGINES.items()]).unpivot(["id", "tier"], list(ENGINES), "engine", "reading")


@query(f"""WITH {PAGES}, {_READINGS} SELECT id, engine, {_FAULT} AS fault FROM k""")
def ocr_validate(spark: SparkSession, d: str) -> DataFrame:
    fault = F.split_part(rules.recognition_fault(F.col("reading")), F.lit(":"), F.lit(1))
    return readings(spark, d).select("id", "engine", fault.alias("fault"))


@query(f"""WITH {PAGES}, {_READINGS}, f AS (SELECT *, {_FAULT} AS fault, {n_of('t', rules.TURNED)} AS simple, {n_of('t', rules.TRADITIONAL)} AS old FROM k),
e AS (SELECT id, engine, t, s, CASE WHEN fault IS NOT NULL THEN 'validation_failed:' || fault WHEN tier = 'primary' AND simple >= 3 AND simple / (simple + old) > 0.3 THEN 'validation_failed:simplified_conversion' END AS error FROM f)
SELECT id, engine, error, CASE WHEN error IS NOT NULL THEN 0 ELSE coalesce(length(t), 0) END AS chars, CASE WHEN error IS NOT NULL OR NOT {full('t')} THEN 'empty' ELSE 'ok' END AS status FROM e""")
def validated_readings(spark: SparkSession, d: str) -> DataFrame:
    """What may be used of each reading; on pages of primary sources the script is checked too."""
    done = rules.with_validation(readings(spark, d), "reading", F.col("tier") == "primary")
    short = F.regexp_extract("error", r"^(validation_failed:[a-z_]+)", 1)
    return done.select(
        "id", "engine", F.when(F.col("error").isNotNull(), short).alias("error"), F.coalesce(F.length("valid_text"), F.lit(0)).cast("bigint").alias("chars"), rules.recognition_status(F.col("valid_text"), F.col("error")).alias("status")
    )


@query(f"""WITH {PAGES}, r AS (SELECT id, tier, language, CASE WHEN paddleOcrText IS NULL THEN NULL WHEN {full('paddleOcrText')} THEN 'ok' ELSE 'empty' END AS p, CASE WHEN deepseekOcrText IS NULL THEN NULL WHEN {full('deepseekOcrText')} THEN 'ok' ELSE 'empty' END AS q, coalesce(length(textFused), 0) AS n FROM page_now)
SELECT id, coalesce(p <> 'empty', false) = false AND coalesce(q <> 'empty', false) = false AND n <= 10 AS manuscript, CASE WHEN language IN ('ja', 'kanbun', 'japan', 'jpn') THEN NULL WHEN language = 'zh-modern' THEN 'simplified' WHEN tier = 'primary' THEN 'traditional' ELSE 'classical' END AS hint FROM r""")
def page_hints(spark: SparkSession, d: str) -> DataFrame:
    """Which pages look like handwriting, and the script a recogniser is told to expect."""
    p = pages_now(spark, d, ["tier", "language", "paddleOcrText", "deepseekOcrText", "textFused"])
    status = lambda c: F.when(F.col(c).isNotNull(), F.when(fusion.has_text(F.col(c)), "ok").otherwise("empty"))
    return p.select("id", rules.is_manuscript(status("paddleOcrText"), status("deepseekOcrText"), F.length("textFused")).alias("manuscript"), rules.script_hint(F.col("tier"), F.col("language")).alias("hint"))


def _sql_map(x: str, table: dict[str, str]) -> str:
    return f"translate({x}, '{''.join(table)}', '{''.join(table.values())}')"


_VOICED = dict(zip("ｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾊﾋﾌﾍﾎ", "ガギグゲゴザジズゼゾダヂヅデドバビブベボ"))
_HALF = dict(zip("ﾊﾋﾌﾍﾎ", "パピプペポ"))


def _sql_kana(x: str) -> str:
    for c, w in _VOICED.items():
        x = f"replace({x}, '{c}ﾞ', '{w}')"
    for c, w in _HALF.items():
        x = f"replace({x}, '{c}ﾟ', '{w}')"
    half = "".join(chr(c) for c in range(0xFF61, 0xFFA0))
    return f"translate({x}, '{half}', '。「」、・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン゛゜')"


_ERA = "CASE WHEN tier = 'primary' THEN 'Tang' WHEN tier = 'secondary' THEN '宋' END"
_STEPS = f"""s0 AS (SELECT id, coalesce(textFused, '') AS x, lower(coalesce(language, '')) AS lang, {_ERA} AS era FROM page_now), s1 AS (SELECT *, nfc_normalize(x) AS a FROM s0),
s2 AS (SELECT *, trim(regexp_replace(translate(a, '{_ZW}', ''), '[{_BLANK}]+', ' ', 'g'), ' ') AS b FROM s1), s3 AS (SELECT *, translate(b, '{rules.TURNED}', '{rules.TRADITIONAL}') AS c FROM s2),
s4 AS (SELECT *, {_sql_map('c', T.canonical_variants(canon.VARIANTS))} AS d FROM s3),
s5 AS (SELECT *, CASE era WHEN 'Tang' THEN {_sql_map('d', canon.taboo_map('tang'))} WHEN '宋' THEN {_sql_map('d', canon.taboo_map('song'))} ELSE d END AS e FROM s4),
s6 AS (SELECT *, {_sql_map('e', canon.loan_map())} AS f FROM s5), s7 AS (SELECT *, lang LIKE 'ja%' OR lang IN ('mixed', 'kanbun') AS wide FROM s6), s8 AS (SELECT *, CASE WHEN wide THEN {_sql_kana('f')} ELSE f END AS g FROM s7)"""
_TRACE = " UNION ALL ".join(f"SELECT id, '{n}' AS step, {applied} AS applied, {a} <> {b} AS changed, md5({b}) AS after FROM s8" for n, applied, a, b in (("nfc", "true", "x", "a"), ("whitespace", "true", "a", "b"), ("tsc", "true", "b", "c"), ("variants", "true", "c", "d"), ("taboo", "era IS NOT NULL", "d", "e"), ("loan", "true", "e", "f"), ("kana", "wide", "f", "g")))


@query(f"WITH {PAGES}, {_STEPS} {_TRACE}")
def normalize_trace(spark: SparkSession, d: str) -> DataFrame:
    """The seven steps of every page's text, with the taboo table its tier asks for and loan characters resolved."""
    p = pages_now(spark, d, ["textFused", "language", "tier"])
    era = F.when(F.col("tier") == "primary", "Tang").when(F.col("tier") == "secondary", "宋")
    rows = p.select("id", F.inline(canon.trace(F.col("textFused"), F.col("language"), era, loan=True)))
    return rows.select("id", "step", "applied", (F.col("before") != F.col("after")).alias("changed"), F.md5("after").alias("after"))


@query(" UNION ALL ".join(f"SELECT doc_id, '{e}' AS dynasty, text <> t AS changed, md5(t) AS canonical FROM (SELECT doc_id, text, {_sql_map('text', canon.taboo_map(e, True))} AS t FROM documents WHERE text IS NOT NULL)" for e in canon.TABOO))
def taboo_by_dynasty(spark: SparkSession, d: str) -> DataFrame:
    """Every text under the table of each dynasty, unsafe rows included."""
    docs = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text", F.explode(F.array(*[F.lit(e) for e in canon.TABOO])).alias("dynasty"))
    t = canon.without_taboo(F.col("text"), F.col("dynasty"), unsafe=True)
    return docs.select("doc_id", "dynasty", (F.col("text") != t).alias("changed"), F.md5(t).alias("canonical"))


@query(f"""WITH {PAGES}, c AS (SELECT id, textFused AS x, CASE WHEN language IN ('en', 'ar', 'ja') THEN language ELSE 'zh' END AS code FROM page_now),
n AS (SELECT *, nfc_normalize(coalesce(x, '')) AS a FROM c), b AS (SELECT *, trim(regexp_replace(translate(a, '{_ZW}', ''), '[{_BLANK}]+', ' ', 'g'), ' ') AS b FROM n),
v AS (SELECT *, {_sql_map(f"translate(b, '{rules.TURNED}', '{rules.TRADITIONAL}')", T.canonical_variants(canon.VARIANTS))} AS v FROM b)
SELECT id, code, md5(CASE WHEN code IN ('en', 'ar') THEN trim(regexp_replace(a, '[{_SPACE}\\x{{1c}}-\\x{{1f}}]+', ' ', 'g'), ' ') WHEN code = 'ja' THEN {_sql_kana('v')} ELSE v END) AS canonical FROM v""")
def language_rule_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every page's text by the rule registered for its language."""
    code = F.when(F.col("language").isin("en", "ar", "ja"), F.col("language")).otherwise("zh")
    p = pages_now(spark, d, ["textFused", "language"])
    return p.select("id", code.alias("code"), F.md5(canon.by_language(F.col("textFused"), code, F.lit(None).cast("string"))).alias("canonical"))


_CALENDAR = ", ".join(f"({i}, '{n}', '{y}', {a}, {b})" for i, (n, y, a, b) in enumerate(dates.eras()))
_CYCLE = "substring('甲乙丙丁戊己庚辛壬癸', CAST(({y} - 4) % 10 AS INTEGER) + 1, 1) || substring('子丑寅卯辰巳午未申酉戌亥', CAST(({y} - 4) % 12 AS INTEGER) + 1, 1)"


def _han(n):
    """A whole number below 100 in ideographs, 1 as the first year."""
    digit = lambda x: F.substring(F.lit("一二三四五六七八九"), x.cast("int"), F.lit(1))
    tens, ones = F.floor(n / 10), n % 10
    return F.when(n == 1, "元").otherwise(F.concat(F.when(tens > 1, digit(tens)).otherwise(""), F.when(tens > 0, "十").otherwise(""), F.when(ones > 0, digit(ones)).otherwise("")))


@query(f"""WITH era(no, name, dynasty, a, b) AS (VALUES {_CALENDAR}), y AS (SELECT doc_id, 618 + doc_id % 290 AS year FROM documents),
p AS (SELECT doc_id, year, arg_max(name, no) AS name, year - arg_max(a, no) + 1 AS off FROM y JOIN era ON year BETWEEN a AND b GROUP BY 1, 2),
f AS (SELECT doc_id, year, p.name, off, arg_min(era.a, no) AS a, arg_min(dynasty, no) AS dynasty, count(*) AS n FROM p JOIN era ON era.name = p.name AND era.a + off - 1 <= era.b GROUP BY ALL)
SELECT doc_id, name AS era, off AS "offset", a + off - 1 AS ce, dynasty, {_CYCLE.format(y='year')} AS named, CASE WHEN {_CYCLE.format(y='year')} <> {_CYCLE.format(y='(a + off - 1)')} THEN 0.6 WHEN n > 1 THEN 0.85 ELSE 1.0 END AS confidence FROM f""")
def era_to_ce(spark: SparkSession, d: str) -> DataFrame:
    """A year of an era, written for every document with its name in the cycle of sixty, and read again."""
    calendar = spark.createDataFrame([(i, *e) for i, e in enumerate(dates.eras())], "no int, name string, dynasty string, a int, b int")
    docs = load(spark, d, "documents").select("doc_id", (618 + F.col("doc_id") % 290).alias("year"))
    of = docs.join(F.broadcast(calendar), (F.col("year") >= F.col("a")) & (F.col("year") <= F.col("b"))).groupBy("doc_id", "year").agg(F.max(F.struct("no", "name", "a")).alias("e"))
    text = F.concat(F.lit("是歲大旱，"), F.col("e.name"), _han(F.col("year") - F.col("e.a") + 1), F.lit("年"), dates.cycle_year(F.col("year")), F.lit("，民飢。"))
    return dates.era_years(of.select("doc_id", text.alias("t")), ["doc_id"], "t").select("doc_id", "era", "offset", "ce", "dynasty", "named", "confidence")


@query("SELECT doc_id, doc_id % 99 + 1 AS n FROM documents")
def han_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers to 99, written in ideographs for every document and read again."""
    return load(spark, d, "documents").select("doc_id", dates.han_number(_han(F.col("doc_id") % 99 + 1)).cast("bigint").alias("n"))
