"""Sentence boundaries in any of the corpus's scripts, by a finite transducer.

The transducer's states are the outermost pair of quotation marks or brackets
that stands open (none, or its kind and whether a colon introduced it); its
inputs are the marks that can matter.  Whether an opening mark's closing mark
follows in the paragraph is learned by a second machine that runs from the right;
its state is one bit a kind of closing mark, and one for an end mark ahead.

A text is cut into stretches of at most ``STRETCH`` characters.  Each is turned
into its state-transition function, for either machine; the functions are composed
by a prefix scan, and each stretch then emits its boundaries from the states it is
now known to start in.  A text of more than ``RANGE`` characters doesn't stay in
one task: it is cut between two letters, where no rule looks across, into ranges
that are rows of their own.  Their functions are composed once a text and joined
back, and each range emits by itself.

Rules.  A full stop, exclamation or question mark ends a sentence unless it
stands within a pair, in a number, after an abbreviation or initial, or is
followed by the sentence's going on (a small letter, a comma).  An ellipsis ends
one only before a capital or an ideograph.  After a closing quote whose text
ended with such a mark the sentence ends unless it goes on there: with a small
letter, hiragana, a particle or comma, or an ideograph where the quote was
embedded without a colon.  Paragraphs end sentences.  In a paragraph without any
end mark each stretch between ideographic spaces or line breaks is a sentence.

Defined cases: null and blank texts have none; the end of the text, without its
trailing white space, always ends one; repeated rows count once.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import map_rows
from quirefold.session import cut

ENDS = ".!?。！？｡．…"
WIDE = "。！？｡．"
PAIRS = {"“": "”", "「": "」", "『": "』", "‘": "’", '"': '"', "(": ")", "（": "）", "[": "]", "［": "］", "《": "》", "〈": "〉", "【": "】", "{": "}", "«": "»"}
CLOSERS = "".join(dict.fromkeys(PAIRS.values()))
BRACKETS = "(（[［《〈【{"
#: Words after whose stop a sentence goes on.
SHORT = set(
    "dr mr mrs ms prof st capt gen col lt rev hon sr jr messrs ed eds vol vols cf vs v no nos p pp fol fols ch chap sec art op cit ibid "
    "c ca approx e.g i.e eg ie viz al fig figs bk pt trans repr esp incl ms mss n nn l ll d b r".split()
)
GOES_ON = "的之等者，、；：,;:)）"
STRETCH, RANGE = 512, 8192
HALO = 48

_NONE = ("", False)
_EVENT = re.compile(r"[%s]+(?:[ \t]\.)*|[%s%s]|[ \t　]*\n[\s　]*\n[\s　]*" % (re.escape(ENDS), re.escape("".join(PAIRS)), re.escape(CLOSERS)))
_WORD = re.compile(r"[A-Za-z][A-Za-z.]*$")
_VISIBLE = re.compile(r"\S")
_ONLY_NUMBERS = re.compile(r"(?<=\d)[.．](?=\d)")


def _kana(c: str) -> bool:
    return "ぁ" <= c <= "ゟ"


def _wide(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㆐" <= c <= "㆟" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿" or c > "\U0001ffff"


_BIT = {c: 1 << i for i, c in enumerate(CLOSERS)}
#: The bit of the machine from the right that says an end mark follows in the paragraph.
END_AHEAD = 1 << len(CLOSERS)
_EVERY = (END_AHEAD << 1) - 1


class Text:
    """The marks of a text, or of a range of one that begins after ``lead`` characters of context."""

    def __init__(self, text: str, lead: int = 0):
        self.text = text
        self.events = [(m.start(), m.group()) for m in _EVENT.finditer(text) if m.start() >= lead]
        self.closed: set[int] = set()

    def back(self, lo: int, hi: int, ahead: int, mark_closed: bool = True) -> int:
        """The state of the machine from the right before the events lo to hi, from that behind them; notes opening marks that are closed."""
        for at, mark in reversed(self.events[lo:hi]):
            c = mark[0]
            if "\n" in mark:
                ahead = 0
            elif c in ENDS:
                if not self._number(at, mark):
                    ahead |= END_AHEAD
            elif c == '"':
                # a straight mark opens before a visible character at a start or after a space, and then needs another
                if ahead & _BIT[c] and self._opens(at):
                    if mark_closed:
                        self.closed.add(at)
                    ahead &= ~_BIT[c]
                else:
                    ahead |= _BIT[c]
            elif c == "’" and self._apostrophe(at):
                continue
            elif c in PAIRS and ahead & _BIT[PAIRS[c]]:
                if mark_closed:
                    self.closed.add(at)
            elif c in _BIT:
                ahead |= _BIT[c]
        return ahead

    def _number(self, at: int, mark: str) -> bool:
        return mark in (".", "．") and self.text[at - 1 : at].isdecimal() and self.text[at + 1 : at + 2].isdecimal()

    def _opens(self, at: int) -> bool:
        before, after = self.text[at - 1 : at], self.text[at + 1 : at + 2]
        return bool(after.strip()) and (not before.strip() or before in "(（[「“‘：:—-" or _wide(before)) and not (before in ENDS and before)

    def _apostrophe(self, at: int) -> bool:
        return self.text[at - 1 : at].isalpha() and self.text[at + 1 : at + 2].isalpha() and not _wide(self.text[at + 1])

    def next_visible(self, at: int) -> tuple[int, str]:
        m = _VISIBLE.search(self.text, at)
        return (m.start(), m.group()) if m else (len(self.text), "")

    def after_closers(self, at: int) -> int:
        t = self.text
        while at < len(t) and t[at] in CLOSERS and at not in self.closed:
            at += 1
        return at

    def stop(self, at: int, mark: str) -> int:
        """The end of the sentence that an end mark outside all pairs ends, or -1."""
        t = self.text
        end = self.after_closers(at + len(mark))
        shut = end > at + len(mark)
        k, nxt = self.next_visible(end)
        if not nxt:
            return end
        gap = k > end
        before = t[at - 1 : at]
        if mark in (".", "．") and before.isdigit() and not gap and not shut and nxt.isdigit():
            return -1
        if mark[-1] in WIDE:
            return -1 if shut and not gap and (_kana(nxt) or nxt in GOES_ON) else end
        if nxt.islower() or nxt in ",;:)）,，、；：":
            return -1
        if len(mark) > 1 and set(mark) <= set(". ") or "…" in mark:
            return end if nxt.isupper() or _wide(nxt) or nxt in PAIRS else -1
        if mark[-1] == ".":
            word = _WORD.search(t, max(0, at - HALO), at)
            w = word.group() if word else ""
            if w.lower() in SHORT or (len(w) == 1 and w.isupper()) or re.fullmatch(r"(?:[A-Z]\.)+[A-Z]", w):
                return -1
            if not gap and not shut and not (_wide(nxt) or nxt in PAIRS) and not (nxt.isupper() and (before.islower() or before in ")）")):
                return -1
        return end

    def shut(self, at: int, state: tuple[str, bool]) -> int:
        """The end of the sentence that the mark closing ``state`` ends, or -1."""
        t = self.text
        kind, colon = state
        inner = t[max(0, at - HALO) : at].rstrip(CLOSERS)
        if kind in BRACKETS or not inner or inner[-1] not in ENDS:
            return -1
        end = self.after_closers(at + 1)
        k, nxt = self.next_visible(end)
        if not nxt or "\n" in t[end:k]:
            return end
        if nxt in ENDS or nxt.islower() or k == end and (nxt in GOES_ON or _kana(nxt)):
            return -1
        if not colon and _wide(nxt) and k == end:
            return -1
        return end


def states() -> list[tuple[str, bool]]:
    return [_NONE, *[(c, f) for c in PAIRS for f in (False, True)]]


STATES = states()
_NUMBER_OF = {s: i for i, s in enumerate(STATES)}


def _opening(text: Text, at: int, c: str) -> tuple[str, bool]:
    before = text.text[max(0, at - 2) : at].strip()
    return c, not before or before[-1] in "：:" or not _wide(before[-1])


def run(text: Text, lo: int, hi: int, state: tuple[str, bool], out: list[int]) -> tuple[str, bool]:
    """The state after the events lo to hi; the boundaries met are put into ``out``, paragraphs' ends as negative numbers."""
    for at, mark in text.events[lo:hi]:
        c = mark[0]
        if "\n" in mark:
            state = _NONE
            out.append(-at)  # a paragraph's end, wherever its last visible character stands
        elif c in ENDS:
            if not state[0]:
                end = text.stop(at, mark)
                if end > 0:
                    out.append(end)
        elif not state[0]:
            if at in text.closed:
                state = _opening(text, at, c)
        elif c == PAIRS[state[0]] and not (c == "’" and text._apostrophe(at)):
            end = text.shut(at, state)
            if end > 0:
                out.append(end)
            state = _NONE
    return state


def transition(text: Text, lo: int, hi: int) -> list[int]:
    """The state-transition function of the events lo to hi, as the number of the state each state leads to.

    Read from the right: ``free[i]`` is where event i leads if nothing stands open before it, ``shut[c]`` the
    first event that closes c; a state with c open leads to where that event's follower leads if free.
    """
    free = 0
    shut: dict[str, int] = {c: _NUMBER_OF[c, False] for c in PAIRS}
    shut_colon: dict[str, int] = {c: _NUMBER_OF[c, True] for c in PAIRS}
    for at, mark in reversed(text.events[lo:hi]):
        c = mark[0]
        if "\n" in mark:
            shut = dict.fromkeys(PAIRS, free)
            shut_colon = dict.fromkeys(PAIRS, free)
        elif c in ENDS or c == "’" and text._apostrophe(at):
            continue
        else:
            after = free
            if at in text.closed and c in PAIRS:
                kind, colon = _opening(text, at, c)
                free = shut_colon[kind] if colon else shut[kind]
            for kind in PAIRS:
                if PAIRS[kind] == c:
                    shut[kind] = shut_colon[kind] = after
    return [free, *[x[c] for c in PAIRS for x in (shut, shut_colon)]]


def compose(f: list[int], g: list[int]) -> list[int]:
    return [g[x] for x in f]


def compose_bits(f: tuple[int, int], g: tuple[int, int]) -> tuple[int, int]:
    """``f`` then ``g``, each the masks that a mask of no bits and one of all bits lead to."""
    return tuple(g[1] & x | g[0] & ~x & _EVERY for x in f)


def prefix_scan(functions: list, then=compose) -> list:
    """Inclusive scan of transition functions, doubling the reach in each round."""
    out, reach = list(functions), 1
    while reach < len(out):
        out = [then(out[i - reach], f) if i >= reach else f for i, f in enumerate(out)]
        reach *= 2
    return out


def _spans(text: Text, begin: int, stretch: int) -> list[tuple[int, int]]:
    at = [e[0] for e in text.events]
    cuts = [bisect_left(at, p) for p in range(begin, max(len(text.text), begin + 1), stretch)] + [len(at)]
    return list(zip(cuts, cuts[1:]))


def look_back(text: Text, spans: list[tuple[int, int]], ahead: int) -> None:
    """Learns which opening marks are closed, from the state ``ahead`` behind the text."""
    behind = [ahead]
    if len(spans) > 1:
        functions = [(text.back(lo, hi, 0, False), text.back(lo, hi, _EVERY, False)) for lo, hi in reversed(spans[1:])]
        behind += [f[1] & ahead | f[0] & ~ahead & _EVERY for f in prefix_scan(functions, compose_bits)]
    for (lo, hi), state in zip(reversed(spans), behind):
        text.back(lo, hi, state)


def range_back(part: str, lead: int) -> tuple[int, int]:
    """The function of a range for the machine from the right."""
    text = Text(part, lead)
    n = len(text.events)
    return text.back(0, n, 0, False), text.back(0, n, _EVERY, False)


def _ended(body: str) -> bool:
    return any(c in ENDS for c in _ONLY_NUMBERS.sub("", body))


def range_forth(part: str, lead: int, ahead: int, stretch: int) -> tuple[list[int], bool, bool]:
    """The function of a range for the machine from the left; whether its last paragraph has an end mark if the one before it has none, or has."""
    text = Text(part, lead)
    spans = _spans(text, lead, stretch)
    look_back(text, spans, ahead)
    breaks = [at for at, mark in text.events if "\n" in mark]
    own = _ended(part[breaks[-1] if breaks else lead :])
    return prefix_scan([transition(text, lo, hi) for lo, hi in spans])[-1], own, own or not breaks


def emit(part: str, lead: int, last: bool, ahead: int, state: int, so_far: bool, stretch: int) -> list[int]:
    """The ends of the sentences that end in a range, counted from the start of ``part``."""
    text = Text(part, lead)
    spans = _spans(text, lead, stretch)
    look_back(text, spans, ahead)
    starts = [state]
    if len(spans) > 1:
        starts += [f[state] for f in prefix_scan([transition(text, lo, hi) for lo, hi in spans[:-1]])]
    found: list[int] = []
    for (lo, hi), at in zip(spans, starts):
        run(text, lo, hi, STATES[at], found)
    ends: set[int] = set()
    begin, length = lead, len(part.rstrip()) if last else len(part)
    for p in [-p for p in found if p < 0] + [len(part)]:
        body = part[begin:p]
        open_ = p == len(part) and not last
        if body.strip():
            if not open_:
                ends.add(begin + len(body.rstrip()))
            if not (_ended(body) or begin == lead and so_far or open_ and ahead & END_AHEAD):
                for m in re.finditer(r"[　\r\n]+", body):
                    head = body[: m.start()].rstrip()
                    if head:
                        ends.add(begin + len(head))
        begin = p
    ends.update(p for p in found if 0 < p <= length)
    return sorted(ends)


def boundaries(raw: str, stretch: int = STRETCH) -> list[int]:
    """The end of every sentence of a text, as the number of characters from its start."""
    return emit(raw, 0, True, 0, 0, False, stretch) if raw.strip() else []


def ranges(raw: str, size: int) -> Iterator[tuple[int, int, str, bool]]:
    """(offset, characters of context, context and range, last?) of a text's ranges: cut between two letters, of ``size`` characters or the fewest more."""
    plain = lambda c: c.isalnum() and c not in CLOSERS
    at, n = 0, len(raw)
    while at < n:
        end = at + size
        while end < n and not (plain(raw[end - 1]) and plain(raw[end])):
            end += 1
        end = min(end, n)
        lead = min(HALO, at)
        yield at, lead, raw[at - lead : end], end == n
        at = end


def _ranged(long: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, ends, length) of long texts, each range a row."""
    types = dict(long.dtypes)
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)
    cols = ["_t", "_no", "_off", "_lead", "_part", "_last", "_n"]

    def slices(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in (*keys, *cols)}
        for i, x in enumerate(c[text]):
            for no, (off, lead, part, last) in enumerate(ranges(x, RANGE)):
                for k, v in zip(out, (*[c[k][i] for k in keys], c["_t"][i], no, off, lead, part, last, len(x.strip()))):
                    out[k].append(v)
        return out

    # Equal rows are one text; a text's number serves as its key from here on.
    once = long.select(*keys, text).distinct().withColumn("_t", F.xxhash64(*keys, text))
    rows = cut(map_rows(once, f"{head}, _t bigint, _no int, _off bigint, _lead int, _part string, _last boolean, _n int", slices))

    def back(c: dict[str, list]) -> dict[str, list]:
        r = [range_back(p, n) for p, n in zip(c["_part"], c["_lead"])]
        return {"_t": c["_t"], "_no": c["_no"], "none": [x for x, _ in r], "all": [x for _, x in r]}

    def scan_back(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"_t": [], "_no": [], "_ahead": []}
        for t, fs in zip(c["_t"], c["f"]):
            done = prefix_scan([(f["none"], f["all"]) for f in reversed(fs)], compose_bits)
            for f, ahead in zip(reversed(fs), [0, *[x for x, _ in done[:-1]]]):
                for k, v in zip(out, (t, f["_no"], ahead)):
                    out[k].append(v)
        return out

    functions = map_rows(rows.select("_t", "_no", "_lead", "_part"), "_t bigint, _no int, `none` int, `all` int", back)
    gathered = functions.groupBy("_t").agg(F.array_sort(F.collect_list(F.struct("_no", "none", "all"))).alias("f"))
    ahead = rows.join(map_rows(gathered, "_t bigint, _no int, _ahead int", scan_back), ["_t", "_no"])

    def forth(c: dict[str, list]) -> dict[str, list]:
        r = [range_forth(p, n, a, STRETCH) for p, n, a in zip(c["_part"], c["_lead"], c["_ahead"])]
        return {"_t": c["_t"], "_no": c["_no"], "to": [x for x, *_ in r], "none": [x for _, x, _ in r], "some": [x for *_, x in r]}

    def scan_forth(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"_t": [], "_no": [], "_state": [], "_so_far": []}
        for t, fs in zip(c["_t"], c["f"]):
            done = [0, *[f[0] for f in prefix_scan([f["to"] for f in fs])[:-1]]]
            so_far = False
            for f, state in zip(fs, done):
                for k, v in zip(out, (t, f["_no"], state, so_far)):
                    out[k].append(v)
                so_far = f["some"] if so_far else f["none"]
        return out

    functions = map_rows(ahead.select("_t", "_no", "_lead", "_part", "_ahead"), "_t bigint, _no int, to array<int>, `none` boolean, `some` boolean", forth)
    gathered = functions.groupBy("_t").agg(F.array_sort(F.collect_list(F.struct("_no", "to", "none", "some"))).alias("f"))
    known = ahead.join(map_rows(gathered, "_t bigint, _no int, _state int, _so_far boolean", scan_forth), ["_t", "_no"])

    def ends(c: dict[str, list]) -> dict[str, list]:
        found = [
            [off - lead + e for e in emit(part, lead, last, ahead, state, so_far, STRETCH)]
            for off, lead, part, last, ahead, state, so_far in zip(*[c[k] for k in ("_off", "_lead", "_part", "_last", "_ahead", "_state", "_so_far")])
        ]
        return {k: c[k] for k in (*keys, "_t", "_n")} | {"ends": found}

    emitted = map_rows(known, f"{head}, _t bigint, _n int, ends array<int>", ends)
    return emitted.groupBy(*keys, "_t", "_n").agg(F.array_sort(F.flatten(F.collect_list("ends"))).alias("ends")).select(*keys, "ends", F.col("_n").alias("length"))


def sentences(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, ends array<int>, length int) of every text, however long; blank ones and nulls have null ends.

    ``length`` is that of the text without white space at both ends.
    """
    types = dict(df.dtypes)
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def rows(c: dict[str, list]) -> dict[str, list]:
        lengths = [len(x.strip()) if x else 0 for x in c[text]]
        ends = [boundaries(x) if n else None for x, n in zip(c[text], lengths)]
        return {k: c[k] for k in keys} | {"ends": ends, "length": lengths}

    long = F.length(text) > RANGE
    short = map_rows(df.where(F.coalesce(~long, F.lit(True))).select(*keys, text), f"{head}, ends array<int>, length int", rows)
    return short.unionByName(_ranged(df.where(long), keys, text))


def sentence_rows(ends: DataFrame, keys: list[str]) -> DataFrame:
    return ends.select(*keys, F.explode(F.col("ends").cast("array<bigint>")).alias("end_pos"))


def sentence_spans(ends: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place, start_pos, end_pos): a sentence and the white space before it lie from start_pos to end_pos."""
    each = ends.select(*keys, "ends", F.posexplode("ends").alias("at", "end"))
    start = F.when(F.col("at") > 0, F.expr("ends[at - 1]")).otherwise(0)
    return each.select(*keys, (F.col("at") + 1).cast("bigint").alias("place"), start.cast("bigint").alias("start_pos"), F.col("end").cast("bigint").alias("end_pos"))
