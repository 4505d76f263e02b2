"""The lines of a printed page: which are its header and its page number."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

#: How many lines at the head and at the foot can be furniture.
EDGE = 2
_ROMAN = re.compile(r"m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
_ORNAMENT = re.compile(r"[\s\-–—―‐·•.,*~|/\\()（）\[\]［］【】<>〈〉《》「」]+")
_NUMBER_WORDS = re.compile(r"^(?:page|pag|pp|p|第|頁|页|葉|叶)+|(?:頁|页|葉|叶|丁|ページ|of)+$|(?<=\d)(?:of|頁|页)(?=\d)")
_HAN_DIGITS = {c: i for i, c in enumerate("〇一二三四五六七八九")}
_LOOKS = str.maketrans({"0": "o", "1": "l", "5": "s", "9": "g", "!": "i", "|": "l"})


def roman(text: str) -> int:
    """The value of a lower-case roman number, 0 if it is none."""
    if not text or not _ROMAN.match(text):
        return 0
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    total = 0
    for a, b in zip(text, text[1:] + " "):
        total += -value[a] if b != " " and value[a] < value[b] else value[a]
    return total


def han_number(text: str) -> int:
    """The value of a number in ideographs (二三 or 二十三), 0 if it is none."""
    if not text or any(c not in _HAN_DIGITS and c not in "十百" for c in text):
        return 0
    if "十" not in text and "百" not in text:
        return int("".join(str(_HAN_DIGITS[c]) for c in text))
    total, digit = 0, 0
    for c in text:
        if c in _HAN_DIGITS:
            digit = _HAN_DIGITS[c]
        else:
            total, digit = total + max(1, digit) * (10 if c == "十" else 100), 0
    return total + digit


@lru_cache(maxsize=20_000)
def numbers(line: str) -> list[int] | None:
    """The numbers of a line that consists of a page number and ornaments, None for any other line."""
    text = unicodedata.normalize("NFKC", line).lower()
    parts = [p for p in _ORNAMENT.split(text) if p]
    out: list[int] = []
    for p in parts:
        p = _NUMBER_WORDS.sub("", p)
        if not p:
            continue
        value = int(p) if p.isdecimal() and len(p) < 8 else roman(p) or han_number(p)
        if not value and p.translate(str.maketrans("olisg", "01159")).isdecimal() and any(c.isdigit() for c in p) and len(p) < 6:
            value = int(p.translate(str.maketrans("olisg", "01159")))
        if not value:
            return None
        out.append(value)
    return out or None


@lru_cache(maxsize=20_000)
def plain(text: str) -> str:
    """Letters and digits, folded so that an altered line is like its title."""
    folded = unicodedata.normalize("NFKC", text).lower().translate(_LOOKS)
    return "".join(c for c in folded if c.isalnum() or c in "□■�")


_TAIL = re.compile(r"[\s,，.·]*(?:(?:book|b[o0]{2}k|vol|volume|part|bk)\.?\s*[ivxlcd1!|0-9]+|卷[〇一二三四五六七八九十百\d□■�]+|[ivxlc]+)[\s.]*$", re.I)


@lru_cache(maxsize=20_000)
def header_number(line: str, title: str) -> tuple[bool, list[int]]:
    """Whether a line carries the title (whole, shortened or altered), and the numbers beside it."""
    bare = unicodedata.normalize("NFKC", line).strip()
    nums: list[int] = []
    core = bare
    for pattern in (r"^[\[(]?(\d{1,6})[\])]?\s{1,}(?=\S)", r"\s{1,}[\[(]?(\d{1,6})[\])]?[\s.]*$"):
        m = re.search(pattern, core)
        if m:
            nums.append(int(m.group(1)))
            core = core[: m.start()] + " " + core[m.end() :]
    want, spaced = plain(title), core.strip()
    got = plain(spaced)
    cut = plain(_TAIL.sub("", spaced))
    if not want or not got:
        return False, nums
    for g in (got, cut):
        if len(g) < 2:
            continue
        if want.startswith(g) and len(g) >= max(4 if g.isascii() else 2, 0.2 * len(want)):
            return True, nums
        if len(g) <= 1.25 * len(want) + 1 and len(set(g) & set(want)) >= 0.6 * len(set(g)):
            m = SequenceMatcher(None, g, want[: len(g)] if len(g) < len(want) else want, autojunk=False)
            need = 0.75 if len(want) <= 6 else 0.8
            if len(g) >= max(4 if g.isascii() else 2, 0.2 * len(want)) and m.real_quick_ratio() >= need and m.ratio() >= need:
                return True, nums
    return False, nums


def edge_numbers(text: str) -> set[int]:
    """The numbers that stand alone in a line at the head or foot of a page, or before or after such a line's words."""
    lines = [x for x in text.split("\n") if x.strip()]
    out: set[int] = set()
    for line in {*lines[:EDGE], *lines[-EDGE:]}:
        if len(line) <= 120:
            out.update(numbers(line) or ())
            beside = _BESIDE.search(unicodedata.normalize("NFKC", line))
            if beside:
                out.add(int(beside.group(1) or beside.group(2)))
    return out


_BESIDE = re.compile(r"^\W*(\d{1,6})\W*\s+\S|\S\s+\W*(\d{1,6})[\W\s]*$")


class Furniture:
    """The head and foot lines of a page that are not its text.

    The page's number is its place in the book, from 1, or that shifted by one of
    ``offsets``: what the numbers of the pages around it say of how the book is
    numbered (a further volume that begins anew, say).
    """

    def __init__(self, text: str, title: str | None, index: int | None, offsets: list[int] | tuple = ()):
        self.lines = text.split("\n")
        at = [i for i, x in enumerate(self.lines) if x.strip()]
        edge = dict.fromkeys([*at[:EDGE], *at[-EDGE:]])
        self.header: set[int] = set()
        self.number: set[int] = set()
        printed = () if index is None else (index + 1, *(index + 1 + o for o in offsets or ()))
        first, last = at[:1], at[-1:]
        for i in edge:
            line = self.lines[i]
            if len(line) > 120:
                continue
            nums = numbers(line)
            if nums:
                # of a long roman number the hundreds may be left out
                short = any(p > 100 and p % 100 in nums for p in printed) and line.strip(" -–—·.[]()").isalpha()
                if any(p in nums for p in printed) or short or (index is None and i in first + last):
                    self.number.add(i)
                continue
            if title:
                is_header, beside = header_number(line, title)
                if is_header:
                    self.header.add(i)
                    if any(p in beside for p in printed):
                        self.number.add(i)
        # furniture is a run from the edge inwards
        good: set[int] = set()
        for run in (at[:EDGE], at[::-1][:EDGE]):
            for i in run:
                if i in self.header or i in self.number:
                    good.add(i)
                else:
                    break
        self.header &= good
        self.number &= good

    def body(self) -> list[str]:
        return [x for i, x in enumerate(self.lines) if i not in self.header and i not in self.number]
