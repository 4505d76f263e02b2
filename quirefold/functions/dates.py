"""Years of old calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEMS, BRANCHES = "甲乙丙丁戊己庚辛壬癸", "子丑寅卯辰巳午未申酉戌亥"
CYCLE = [STEMS[i % 10] + BRANCHES[i % 12] for i in range(60)]
CYCLE_START = 4  # the year 4 begins a cycle

#: Eras with their first and last years, by dynasty, in the order of the calendar.
CALENDAR = {
    "隋": "大業:605-618",
    "唐": (
        "武德:618-626 貞觀:627-649 永徽:650-655 顯慶:656-661 龍朔:661-663 麟德:664-665 乾封:666-668 總章:668-670 咸亨:670-674 上元:674-676 儀鳳:676-679 調露:679-680 永隆:680-681 開耀:681-682 "
        "永淳:682-683 弘道:683-683 嗣聖:684-684 文明:684-684 光宅:684-684 垂拱:685-688 永昌:689-689 載初:689-690 天授:690-692 如意:692-692 長壽:692-694 延載:694-694 證聖:695-695 天冊萬歲:695-696 "
        "萬歲登封:696-696 萬歲通天:696-697 神功:697-697 聖曆:698-700 久視:700-701 大足:701-701 長安:701-705 神龍:705-707 景龍:707-710 唐隆:710-710 景雲:710-712 太極:712-712 延和:712-712 先天:712-713 "
        "開元:713-741 天寶:742-756 至德:756-758 乾元:758-760 上元:760-761 寶應:762-763 廣德:763-764 永泰:765-766 大曆:766-779 建中:780-783 興元:784-784 貞元:785-805 永貞:805-805 元和:806-820 "
        "長慶:821-824 寶曆:825-827 大和:827-835 開成:836-840 會昌:841-846 大中:847-860 咸通:860-874 乾符:874-879 廣明:880-881 中和:881-885 光啟:885-888 文德:888-888 龍紀:889-889 大順:890-891 "
        "景福:892-893 乾寧:894-898 光化:898-901 天復:901-904 天祐:904-907"
    ),
    "北宋": "建隆:960-963 乾德:963-968 開寶:968-976 太平興國:976-984 雍熙:984-987 端拱:988-989 淳化:990-994 至道:995-997",
}
#: The digits of years.
DIGITS = {"〇": 0, "零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "壹": 1, "貳": 2, "弍": 2, "參": 3, "肆": 4, "伍": 5, "陸": 6, "柒": 7, "捌": 8, "玖": 9, "兩": 2}
AROUND = 6


def eras(calendar: dict[str, str] | None = None) -> list[tuple[str, str, int, int]]:
    """(era, dynasty, first year, last year) in the order of the calendar."""
    out = []
    for dynasty, names in (calendar or CALENDAR).items():
        for item in names.split():
            name, _, years = item.partition(":")
            first, _, last = years.partition("-")
            out.append((name, dynasty, int(first), int(last)))
    return out


def cycle_year(year: Column) -> Column:
    """The name of a year in the cycle of sixty."""
    return F.element_at(F.array(*[F.lit(c) for c in CYCLE]), (F.pmod(year - CYCLE_START, F.lit(60)) + 1).cast("int"))


def han_number(x: Column) -> Column:
    """1 to 99 in ideographs, 元 being 1; digits alone are read by position."""
    plain = F.translate(x, "".join(DIGITS), "".join(map(str, DIGITS.values())))
    digits = F.when(plain == "元", "1").otherwise(plain)
    head, tail = F.split_part(digits, F.lit("十"), F.lit(1)), F.split_part(digits, F.lit("十"), F.lit(2))
    tens = F.when(head == "", 1).otherwise(F.coalesce(head.try_cast("int"), F.lit(1))) * 10 + F.when(tail == "", 0).otherwise(F.coalesce(tail.try_cast("int"), F.lit(0)))
    return F.when(F.contains(digits, F.lit("十")), tens).otherwise(digits.try_cast("int"))


def era_years(df: DataFrame, keys: list[str], text: str, calendar: dict[str, str] | None = None) -> DataFrame:
    """(keys, nth, raw, era, offset, ce, dynasty, candidates, named, expected, confidence): every year of an era named in a text.

    The longest name stands.  Of several eras of one name those that lasted so long
    are candidates, in the order of the calendar; the first is taken.  A name of the
    cycle of sixty within six characters is compared with the year's own.  The
    confidence is 1, 0.85 with several candidates, 0.6 if the cycle disagrees, 0.5 if
    no era of the name lasted so long.  The calendar, a row a name, is broadcast.
    """
    rows: dict[str, list[tuple[int, int, str]]] = {}
    for name, of, first, last in eras(calendar):
        rows.setdefault(name, []).append((first, last, of))
    names = "|".join(sorted(rows, key=lambda n: (-len(n), n)))
    pattern = f"({names})([元十{''.join(DIGITS)}0-9]{{1,4}})年"
    # A text is cut before each named year: a piece begins with one, what stands before it is the end of the piece before.
    cut = df.select(*keys, F.split(text, f"(?={pattern})").alias("_p"))
    each = cut.select(*keys, "_p", F.posexplode("_p").alias("nth", "_piece")).where(F.col("_piece").rlike(f"^{pattern}"))
    of = lambda i: F.get("_p", F.col("nth") + i)
    raw = F.regexp_extract("_piece", f"^{pattern}", 0)
    parts = each.select(*keys, "nth", raw.alias("raw"), F.regexp_extract("_piece", f"^{pattern}", 1).alias("era"), han_number(F.regexp_extract("_piece", f"^{pattern}", 2)).cast("int").alias("offset"),
        F.concat(F.when(F.col("nth") > 0, F.right(of(-1), F.lit(AROUND))).otherwise(""), raw, F.left(F.concat(F.substring("_piece", F.length(raw) + 1, F.lit(AROUND)), F.coalesce(of(1), F.lit(""))), F.lit(AROUND))).alias("_w"),
    ).where("offset > 0")
    known = df.sparkSession.createDataFrame(list(rows.items()), "era string, _of array<struct<a:int,b:int,d:string>>")
    met = parts.join(F.broadcast(known), "era")
    met = met.withColumn("_fit", F.filter("_of", lambda r: r["a"] + F.col("offset") - 1 <= r["b"]))
    met = met.withColumn("_one", F.get(F.when(F.size("_fit") > 0, F.col("_fit")).otherwise(F.col("_of")), F.lit(0))).withColumn("ce", F.col("_one.a") + F.col("offset") - 1)
    met = met.withColumn("named", F.nullif(F.regexp_extract("_w", "|".join(CYCLE), 0), F.lit(""))).withColumn("expected", cycle_year(F.col("ce")))
    apart = F.coalesce(F.col("named") != F.col("expected"), F.lit(False))
    sure = F.when(F.size("_fit") == 0, 0.5).when(apart, 0.6).when(F.size("_fit") > 1, 0.85).otherwise(1.0)
    return met.select(*keys, "nth", "raw", "era", "offset", "ce", F.col("_one.d").alias("dynasty"), F.when(F.size("_fit") > 0, F.size("_fit")).otherwise(F.size("_of")).alias("candidates"), "named", "expected", sure.alias("confidence"))


def first_era(df: DataFrame, keys: list[str], text: str, calendar: dict[str, str] | None = None) -> DataFrame:
    """(keys, ce, dynasty) of the first named year of each text that has one."""
    found = era_years(df, keys, text, calendar)
    return found.groupBy(*keys).agg(F.min(F.struct("nth", "ce", "dynasty")).alias("f")).select(*keys, "f.ce", "f.dynasty")


def period(year: Column) -> Column:
    """The period of publication of a year, empty without one (or for the year 0)."""
    return (
        F.when(year.isNull() | (year == 0), "")
        .when(year >= 2000, "modern-zh-reprint-2000s")
        .when(year >= 1980, "modern-zh-reprint-1980s-1990s")
        .when(year >= 1949, "modern-zh-reprint-PRC")
        .otherwise(F.concat(F.lit("pre-1949-"), (F.floor(year / 10) * 10).cast("string"), F.lit("s")))
    )
