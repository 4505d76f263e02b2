"""The language of a text and of the stretches of a mixed one.

Script ranges first narrow what a word can be: letters of the Latin script,
kana, ideographs with or without marks for reading, simplified or traditional
forms.  Each word (a Latin word, or a clause of other script) then has a score
for each language, and a Viterbi search with a penalty for switching labels the
words; runs of one label are the segments.  A text is mixed if two languages
each hold at least a quarter of its letters.

Whether a form is simplified or traditional is read off two published character
sets: a character of GB 2312 that Big5 lacks is simplified, one of Big5 that
GB 2312 lacks traditional, one that only JIS X 0208 has Japanese.

The confidence of a segment is the logistic of its score's lead over the next
best language, by word; that of a text the mean of its segments' by letters.

Defined cases: null and blank texts, and texts without letters, have no language
(``und``, confidence 0, no segments); repeated rows count once.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np

from quirefold.llm.common import code_points

LANGUAGES = ["en", "zh-classical", "zh-modern", "ja", "kanbun"]
SWITCH = 7.0
SHARE = 0.25

#: Words and particles by which the two written forms of Chinese differ.
MODERN = "的了們们這这我你他她它很到和跟把被让讓吗嗎呢吧着是就都还還没沒给給个個些什么麼么对對从從在"
CLASSICAL = "之其於矣哉乎焉也耳曰無而以者乃遂蓋惟咸皆嘗尤凡既且竟悉豈孰弗毋爾汝吾與所為可"

_TOKEN = re.compile(r"[A-Za-zÀ-ɏ][A-Za-zÀ-ɏ'’-]*|[぀-ヿ㐀-鿿㆐-㆟豈-﫿ｦ-ﾟ々〆ー]+")
_UNIT = 14


@lru_cache(maxsize=65536)
def _form(c: str) -> str:
    """'s', 't', 'j' for a simplified, traditional or Japanese form, else ''."""

    def has(codec: str) -> bool:
        try:
            c.encode(codec)
            return True
        except UnicodeEncodeError:
            return False

    gb, big, jis = has("gb2312"), has("big5"), has("euc_jp")
    if gb and not big:
        return "" if jis else "s"
    if big and not gb:
        return "t"
    return "j" if jis and not gb and not big else ""


@lru_cache(maxsize=65536)
def _char_scores(c: str) -> tuple[float, ...]:
    """Scores of one character for LANGUAGES."""
    en, zc, zm, ja, kb = 0.0, 0.0, 0.0, 0.0, 0.0
    if "㆐" <= c <= "㆟":
        return -1.0, -4.0, -4.0, -4.0, 3.0
    if "ぁ" <= c <= "ゟ" or "ァ" <= c <= "ヿ" or "ｦ" <= c <= "ﾟ":
        return -3.0, -2.5, -2.5, 1.5, -2.0
    en = -3.0
    form = _form(c)
    if form == "s":
        zm, zc, ja, kb = 1.2, -1.2, -0.8, -1.2
    elif form == "t":
        zc, zm, ja, kb = 0.3, -0.2, -0.5, 0.3
    elif form == "j":
        ja, zc, zm, kb = 0.8, -0.5, -0.5, -0.5
    if c in MODERN:
        zm, zc, ja, kb = zm + 1.0, zc - 0.6, ja - 0.6, kb - 0.6
    if c in CLASSICAL:
        zc, zm, ja, kb = zc + 0.8, zm - 0.5, ja - 0.7, kb + 0.8
    return en, zc, zm, ja, kb


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """Scores of every character of the first plane, then whether it is a mark, kana, a reading's kana."""
    table = np.zeros((0x10000, len(LANGUAGES) + 3), dtype=np.float64)
    for lo, hi in ((0x3005, 0x3008), (0x3040, 0x3100), (0x3190, 0x31A0), (0x3400, 0xA000), (0xF900, 0xFB00), (0xFF66, 0xFFA0)):
        for p in range(lo, hi):
            c = chr(p)
            table[p] = (*_char_scores(c), "㆐" <= c <= "㆟", "ぁ" <= c <= "ヿ", "ァ" <= c <= "ヺ")
    return table


def units(text: str) -> list[tuple[int, int, int, list[float]]]:
    """(start, end, letters, scores) of the words of a text."""
    k = len(LANGUAGES)
    points = code_points(text)
    score = _table()[np.minimum(points, 0xFFFF)]
    score[points > 0xFFFF] = (*_char_scores("㐀"), 0, 0, 0)
    if len(points) > 1:
        # kana beside a reading mark belong to the mark
        reads = np.flatnonzero((score[1:, k + 2] > 0) & (score[:-1, k] > 0)) + 1
        score[reads] = (0.0, 0.0, 0.0, 0.0, 0.5, 1.0, 0.0, 0.0)
    run = np.concatenate([np.zeros((1, k + 3)), np.cumsum(score, axis=0)])
    spans, latin = [], []
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        if text[a] < "\u0250":
            spans.append((a, b))
            latin.append(True)
        else:
            for x in range(a, b, _UNIT):
                spans.append((x, min(b, x + _UNIT)))
                latin.append(False)
    if not spans:
        return []
    at = np.array(spans)
    total = run[at[:, 1]] - run[at[:, 0]]
    total[total[:, k] == 0, 4] -= 1.0
    total[total[:, k + 1] == 0, 3] -= 0.3
    out = []
    for (a, b), is_latin, t in zip(spans, latin, total[:, :k].tolist()):
        if is_latin:
            n = b - a
            t = [(1.0 if text[a].islower() else 0.5) * min(n, 8) * 0.4, -2.0, -2.0, -2.0, -2.0]
            out.append((a, b, n - sum(text.count(c, a, b) for c in "'’-"), t))
        else:
            out.append((a, b, b - a, t))
    return out


def label(words: list[tuple[int, int, int, list[float]]], switch: float = SWITCH) -> list[int]:
    """The best language of each word under the switching penalty."""
    if not words:
        return []
    k = len(LANGUAGES)
    tops = {max(range(k), key=w[3].__getitem__) for w in words}
    if len(tops) == 1:  # the best of every word without a switch
        return list(tops) * len(words)
    best, back = list(words[0][3]), []
    for w in words[1:]:
        top = max(range(k), key=best.__getitem__)
        jump = best[top] - switch
        step = [i if best[i] >= jump else top for i in range(k)]
        best = [max(best[i], jump) + w[3][i] for i in range(k)]
        back.append(step)
    state = max(range(k), key=best.__getitem__)
    path = [state]
    for step in reversed(back):
        state = step[state]
        path.append(state)
    return path[::-1]


def segments(text: str) -> list[tuple[int, int, str, float, int]]:
    """(start, end, language, confidence, letters) of the stretches of one language."""
    words = units(text)
    path = label(words)
    out = []
    i = 0
    while i < len(words):
        j = i
        while j < len(words) and path[j] == path[i]:
            j += 1
        total = [sum(w[3][x] for w in words[i:j]) for x in range(len(LANGUAGES))]
        lead = total[path[i]] - max(t for x, t in enumerate(total) if x != path[i])
        confidence = 1 / (1 + math.exp(-max(-30.0, min(30.0, lead / math.sqrt(j - i)))))
        out.append((words[i][0], words[j - 1][1], LANGUAGES[path[i]], confidence, sum(w[2] for w in words[i:j])))
        i = j
    return out


def detect(text: str) -> tuple[str, float, list[tuple[int, int, str, float, int]], list[str]]:
    """(language or ``mixed`` or ``und``, confidence, segments, languages of a quarter or more)."""
    runs = segments(text)
    letters = sum(r[4] for r in runs)
    if not letters:
        return "und", 0.0, [], []
    by: dict[str, int] = {}
    for r in runs:
        by[r[2]] = by.get(r[2], 0) + r[4]
    confidence = sum(r[3] * r[4] for r in runs) / letters
    main = sorted((x for x, n in by.items() if n >= SHARE * letters), key=lambda x: (-by[x], x))
    if len(main) >= 2:
        return "mixed", confidence, runs, main
    best = max(by, key=lambda x: (by[x], x))
    return best, confidence, runs, [best]
