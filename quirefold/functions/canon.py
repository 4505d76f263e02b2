"""The canonical form of a text: seven steps, each with a trace.

nfc, whitespace, tsc (simplified to traditional), variants, taboo (by dynasty), loan
(on request), kana (width, for Japanese).  All but the first are maps of single
characters and stay in generated code.  Tables of other projects can be read from
files with ``sources.readers`` and passed in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.functions.rules import TRADITIONAL, TURNED

STEPS = ["nfc", "whitespace", "tsc", "variants", "taboo", "loan", "kana"]

#: Variant and the form it is counted to, in the order of the table.
VARIANTS = [
    tuple(p)
    for p in (
        "爲為 眾众 眾衆 衆眾 著着 卻却 麽么 麼么 裡裏 裏裡 群羣 羣群 峰峯 峯峰 床牀 牀床 笔筆 回囘 氷冰 凉涼 洒灑 匈胸 廼乃 迺乃 旡無 無无 万萬 従從 從从 礼禮 体體 学學 说說 为為 帝帝 皆皆 "
        "吗嗎 门門 里裏 里裡 歲岁 歳歲 舉举 擧舉 擧举 書书 證证 証證 辭辞 辞辭 歩步 讓让 讓譲 譲讓 譲让"
    ).split()
]

#: Forms written to avoid a name, by dynasty: the name's character, what stands for it, whether it is safe to turn back.
TABOO = {
    "tang": "淵 泉 +,淵 深 -,世 代系 -,民 人 -,治 理持 -,顯 明 -,隆 崇興 +,基 根業 -,亨 通 +,豫 預悅 +,适 達 +,誦 諷 +,純 淳 +,恆 常 -,湛 沈沉 +,昂 仰 +,忱 沉 +",
    "song": "匡 正康 +,胤 嗣允 +,恆 常 -,禎 貞 +",
    "ming": "璋 章 +,棣 弟 +,翊 輔 +,鈞 均 +",
    "qing": "玄 元 +,燁 煜 +,胤 允 +,禛 真 +,弘 宏 +,曆 歷 -,寧 寕甯 +",
}
#: Names by which a dynasty is asked for.
ERA_NAMES = {"tang": "tang", "唐": "tang", "song": "song", "宋": "song", "ming": "ming", "明": "ming", "qing": "qing", "清": "qing"}

#: Characters written for others of like sound, and the direction: > the first for the second, = either.
LOANS = (
    "早蚤= 反返> 知智= 信伸> 說悅> 女汝> 無毋= 亡無> 弟悌> 卒猝> 畔叛> 惠慧> 歸饋> 乎於= 焉於> 而爾> 莫暮> 舍捨> 直值> 尊樽> 止趾> 要邀> 共供> 共恭> 責債> 亦奕> 辟避> 辟闢> 辟僻> 從縱> 與歟>"
).split()


def taboo_map(dynasty: str, unsafe: bool = False, table: dict[str, str] | None = None) -> dict[str, str]:
    """substitution -> original of a dynasty; of several originals the first stands, unsafe rows only when asked for."""
    out: dict[str, str] = {}
    for row in (table or TABOO).get(dynasty, "").split(","):
        original, _, rest = row.strip().partition(" ")
        written, _, safe = rest.partition(" ")
        if len(original) == 1 and (safe == "+" or unsafe):
            for c in written:
                if c != original:
                    out.setdefault(c, original)
    return out


def loan_map(rows: list[str] | None = None, either: bool = False) -> dict[str, str]:
    """character -> the one meant; pairs that go either way only when asked for, the first row of a character stands."""
    out: dict[str, str] = {}
    for a, b, way in rows or LOANS:
        if way == ">" or way == "=" and either:
            out.setdefault(a, b)
        elif way == "<":
            out.setdefault(b, a)
    return out


def dynasty_of(era: Column) -> Column:
    """The dynasty a name of an era asks for, null for none or an unknown one."""
    known = F.create_map(*[F.lit(v) for kv in ERA_NAMES.items() for v in kv])
    return F.when(F.length(F.trim(era)) > 0, F.coalesce(F.try_element_at(known, F.lower(F.trim(era))), F.try_element_at(known, F.trim(era))))


def composed(x: Column) -> Column:
    """The composed normal form; a text of ASCII characters is in it and isn't sent to Python."""
    ascii_ = x.rlike(r"\A[\x00-\x7f]*\z")
    return F.coalesce(T.nfc(F.when(~ascii_, x)), x)


def without_taboo(x: Column, dynasty: Column, unsafe: bool = False) -> Column:
    out = F.when(F.lit(False), x)
    for name in TABOO:
        table = taboo_map(name, unsafe)
        out = out.when(dynasty == name, T.translate_map(x, table) if table else x)
    return out.otherwise(x)


def is_japanese(lang: Column) -> Column:
    low = F.lower(F.coalesce(lang, F.lit("")))
    return low.startswith("ja") | low.isin("mixed", "kanbun")


def trace(x: Column, lang: Column, era: Column, loan: bool = False, unsafe: bool = False, variants: list[tuple[str, str]] | None = None) -> Column:
    """array<struct<step, applied, before, after>> of the seven steps of a text."""
    x = F.coalesce(x, F.lit(""))
    dynasty = dynasty_of(era)
    steps = {
        "nfc": (F.lit(True), composed),
        "whitespace": (F.lit(True), T.tidy_space),
        "tsc": (F.lit(True), lambda s: F.translate(s, TURNED, TRADITIONAL)),
        "variants": (F.lit(True), lambda s: T.translate_map(s, T.canonical_variants(variants or VARIANTS))),
        "taboo": (era.isNotNull(), lambda s: without_taboo(s, dynasty, unsafe)),
        "loan": (F.lit(loan), lambda s: T.translate_map(s, loan_map()) if loan else s),
        "kana": (is_japanese(lang), T.wide_kana),
    }
    rows, now = [], x
    for name in STEPS:
        applied, f = steps[name]
        after = F.when(applied, f(now)).otherwise(now) if name in ("taboo", "kana") else f(now)
        rows.append(F.struct(F.lit(name).alias("step"), applied.alias("applied"), now.alias("before"), after.alias("after")))
        now = after
    return F.array(*rows)


def canonical(x: Column, lang: Column, era: Column, loan: bool = False, unsafe: bool = False) -> Column:
    """The last step's text."""
    return F.element_at(trace(x, lang, era, loan, unsafe), -1)["after"]


def by_language(x: Column, code: Column, era: Column) -> Column:
    """A text by the rule of its language: Chinese and Japanese by the seven steps, English and Arabic composed with single spaces; unknown codes as Chinese."""
    code = F.coalesce(code, F.lit("zh"))
    single = F.trim(F.regexp_replace(composed(F.coalesce(x, F.lit(""))), f"[{T.SPACE}\\x1c-\\x1f]+", " "))
    return F.when(code.isin("en", "ar"), single).when(code == "ja", canonical(x, F.lit("ja"), era)).otherwise(canonical(x, F.lit("zh"), era))
