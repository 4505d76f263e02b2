"""Repairing text from scanned pages.

Three passes.  The first counts the words, the pairs of neighbouring words and
the pairs of neighbouring ideographs and kana of the whole corpus: the frequency
lexicon.  The second goes over the pages: it sets aside running headers and page
numbers, rejoins words cut at line ends, replaces characters whose look-alike fits
the neighbouring pairs far better, and notes, with the words beside them, the words
that are not known to be sound.  The third finds their repairs: each word of the
lexicon is indexed under itself and every form with one character left out (a
symmetric-delete index, after folding the confusions that change the length); words
that meet there are compared by an edit distance in which known confusions are
cheap.  Of several candidates the counts of the pairs with the words beside them
pick the repair.  A word of the lexicon that one confusion turns into another word
of it is never taken as sound: it is a misreading where the other one's pairs are
far more frequent.

Only bounded tables are broadcast: the ``HEAD_WORDS`` most frequent sound words and
compounds and the ``HEAD_PAIRS`` most frequent pairs of ideographs.  What is not
decided by them (words, look-alikes, words broken at what may be their own hyphen)
travels to the full tables by a join, so the bounds change no result.

How a book is numbered is learned from the numbers at the edges of its pages: a
volume that begins anew shifts them all alike.

Defined cases: null and blank texts have no defects and stay as they are; a book
without a title has no headers; a bare number counts as the page's number only
at the head or foot and if it is the printed one; repeated rows count once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.common import beyond, head, map_rows
from quirefold.llm.page_lines import Furniture, edge_numbers
from quirefold.session import cut
from quirefold.tables import latest

FIELDS = ["textFused", "paddleOcrText", "deepseekOcrText", "qwenVlOcrText"]
HEAD_WORDS, HEAD_PAIRS = 120_000, 300_000
RATIO, LEAST = 6, 4
FIT = 3.2
#: What a unit of distance weighs against a natural logarithm of pairs; texts tallied at once.
COST_WEIGHT, SLICE = 8.0, 512
#: Places of a book that are numbered alike, and the pages that must say how.
STRETCH, SUPPORT = 50, 3

#: Pairs that character recognition confuses.
LATIN_PAIRS = [("m", "rn"), ("d", "cl"), ("h", "b"), ("t", "f"), ("e", "c"), ("i", "!"), ("l", "1"), ("s", "5"), ("o", "0"), ("g", "9"), ("i", "l"), ("w", "vv"), ("b", "6"), ("z", "2"), ("B", "8")]
WIDE_PAIRS = "的旳 这迖 從従 从丛 田由 日曰 簿薄 官宮 はほ 土士 商啇 書晝 大太 ただ 度渡 史吏 千干 夫天 己已 戶尸 未末 シツ ー一 志忘 人入 口囗 目日 王玉 木本 未木 力刀 土工 問間 問閒 開閉 ロ口 ニ二 ハ八 カ力 夕タ ソン".split()
LOST = "□■�"

LOOKALIKES: dict[str, str] = {}
for _a, _b in WIDE_PAIRS:
    LOOKALIKES[_a] = LOOKALIKES.get(_a, "") + _b
    LOOKALIKES[_b] = LOOKALIKES.get(_b, "") + _a

_WIDE = "぀-ヿ㐀-鿿豈-﫿々〆"
_IS_WIDE = re.compile(f"[{_WIDE}]")
_READING = re.compile("[㆐-㆟][ァ-ヺ]?")
_SUSPECT = re.compile("[" + "".join(LOOKALIKES) + "]")
_WORD = re.compile(rf"(?:(?<![^\W{_WIDE}])!(?=[a-z]))?[A-Za-z0-9À-ɏ{LOST}](?:[A-Za-z0-9À-ɏ^|{LOST}]|!(?=[A-Za-z])|['’](?=[A-Za-z]))*")
_HYPHENS = "-‐‑¬\xad⁃"
_BROKEN = re.compile(rf"([A-Za-zÀ-ɏ0-9!{LOST}][A-Za-zÀ-ɏ0-9!{LOST}’'-]*)([{_HYPHENS}])[ \t]*$")
_GOES_ON = re.compile(rf"\s*([A-Za-zÀ-ɏ0-9!{LOST}]+)")
_COMPOUND = re.compile(r"[A-Za-zÀ-ɏ]+(?:[-‐‑][A-Za-zÀ-ɏ]+)+")
_LOST = re.compile(f"[{LOST}]")
_NUMBERISH = re.compile(r"\d+(?:st|nd|rd|th|r|v|a|b|s|f|ff)?$", re.I)
_DIGITS = str.maketrans("0159!68", "olsgibb")


def is_compound(left: str, right: str, compounds: set[str]) -> bool:
    """Whether a break after ``left`` stands at a compound's own hyphen."""
    return f"{left.rsplit('-', 1)[-1]}-{right}".lower() in compounds


def breaks(lines: list[str]) -> Iterator[tuple[int, str, str]]:
    """(line, word's first part, second part) of the line ends that cut a word."""
    for i, line in enumerate(lines[:-1]):
        tail = line.rstrip(" \t")
        m = _BROKEN.search(line) if tail and tail[-1] in _HYPHENS else None
        if m:
            n = _GOES_ON.match(lines[i + 1])
            if n:
                yield i, m.group(1), n.group(1)


def rejoin(lines: list[str], compounds: set[str], cuts_made: list[dict] | None = None) -> tuple[list[str], bool]:
    """Paragraphs of continuous text, and whether a word was cut by a mark that isn't its own.

    ``cuts_made`` takes (paragraph, place, left-right) of every mark taken out.
    """
    found = False
    paragraphs: list[str] = []
    open_ = ""
    cuts = {i: (a, b) for i, a, b in breaks(lines)}
    joined = True
    for i, line in enumerate(lines):
        text = line.strip()
        if not text:
            if open_:
                paragraphs.append(open_)
            open_, joined = "", True
            continue
        if open_ and not joined:
            wide = _IS_WIDE.match(open_[-1]) or _IS_WIDE.match(text[0]) or open_[-1] in "，。、！？；：「」『』（）“”｡．" or text[0] in "，。、！？；：」』）”｡．㆐㆑㆒㆓㆔㆖㆘"
            open_ += "" if wide and not (open_[-1].isascii() and text[0].isascii()) else " "
        open_ += text
        joined = False
        if i in cuts:
            left, right = cuts[i]
            body = open_.rstrip()
            if not is_compound(left, right, compounds):
                found = True
                body = body[:-1]
                if cuts_made is not None:
                    cuts_made.append({"p": len(paragraphs), "i": len(body) - (len(open_) - len(open_.lstrip())), "token": f"{left.rsplit('-', 1)[-1]}-{right}".lower()})
            open_, joined = body, True
    if open_:
        paragraphs.append(open_)
    return paragraphs, found


def words_of(text: str) -> list[str]:
    return _WORD.findall(text)


_RUN = re.compile("[\u3000-\uffff\U00010000-\U0003ffff]{2,}")


def pairs_of(text: str) -> list[str]:
    """Neighbouring wide characters, reading marks left out."""
    bare = _READING.sub("", text) if "\u3190" <= max(text) else text
    return [r[i : i + 2] for r in _RUN.findall(bare) for i in range(len(r) - 1)]


def tally(texts: list[tuple[str, str | None, int | None, str, list[int] | None]]) -> tuple[Counter, Counter, Counter, Counter]:
    """Counts of the words, compounds, pairs of ideographs and pairs of words of texts given with title, index, mode and offsets of page numbers."""
    beside: Counter = Counter()
    words: Counter = Counter()
    compounds: Counter = Counter()
    pairs: Counter = Counter()
    for text, title, index, mode, offsets in texts:
        lines = Furniture(text, title, index, offsets).body() if mode == "scan" else text.split("\n")
        for line in lines:
            if "-" in line or "‐" in line or "‑" in line:
                compounds.update(re.sub("[‐‑]", "-", x).lower() for x in _COMPOUND.findall(line))
        body = "\n".join(rejoin(lines, set())[0])
        if not body:
            continue
        row = words_of(body.lower())
        words.update(w for w in row if w.isalpha())
        beside.update(f"{v} {w}" for v, w in zip(row, row[1:]) if v.isalpha() and w.isalpha())
        if max(body) > "\u2fff":
            pairs.update(pairs_of(body))
    return words, compounds, pairs, beside


def deletes(word: str) -> set[str]:
    """The keys of a word in the symmetric-delete index."""
    folded = word.replace("rn", "m").replace("cl", "d").replace("vv", "w")
    keys = {folded}
    for base in {folded, word}:
        keys.add(base)
        keys.update(base[:i] + base[i + 1 :] for i in range(len(base)))
    return keys


def distance(wrong: str, right: str) -> float:
    """Edit distance in which a known confusion costs 0.3, any other edit 1."""
    cheap = {(b, a) for a, b in LATIN_PAIRS}
    both = {(x.lower(), y.lower()) for x, y in cheap} | {(y.lower(), x.lower()) for x, y in cheap}
    rows = [[math.inf] * (len(right) + 1) for _ in range(len(wrong) + 1)]
    rows[0][0] = 0.0
    for i in range(len(wrong) + 1):
        for j in range(len(right) + 1):
            here = rows[i][j]
            if here > 2:
                continue
            for di, dj in ((1, 1), (1, 0), (0, 1), (2, 1), (1, 2)):
                a, b = wrong[i : i + di], right[j : j + dj]
                if len(a) < di or len(b) < dj:
                    continue
                cost = 0.0 if a == b else 0.3 if (a, b) in both else 1.0 if max(di, dj) == 1 else math.inf
                if here + cost < rows[i + di][j + dj]:
                    rows[i + di][j + dj] = here + cost
    return rows[-1][-1]


def first_text() -> Column:
    """One text of a page: the fused one, or the first of FIELDS there is."""
    return F.coalesce(*[F.when(F.length(F.trim(f)) > 0, F.col(f)) for f in FIELDS]).alias("text")


def with_numbering(pages: DataFrame) -> DataFrame:
    """Adds ``offsets``: how far the printed numbers of the pages around a page lie from their places in the book.

    An offset counts where at least ``SUPPORT`` pages of a stretch of ``STRETCH`` places of
    the book show a number at that distance; it holds for that stretch and the ones beside
    it.  Only numbers travel, and a stretch is a row of its own, so that a book of any length is.
    """
    if "documentId" not in pages.columns:
        return pages.withColumn("offsets", F.array().cast("array<int>"))

    def rows(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"documentId": [], "docPageIndex": [], "offset": []}
        for book, index, text in zip(c["documentId"], c["docPageIndex"], c["text"]):
            for n in edge_numbers(text) if text else ():
                if n != index + 1:
                    for k, v in zip(out, (book, index, n - 1 - index)):
                        out[k].append(v)
        return out

    known = pages.where("mode = 'scan' and documentId is not null and docPageIndex is not null")
    seen = map_rows(known.select("documentId", F.col("docPageIndex").cast("int").alias("docPageIndex"), first_text()), "documentId string, docPageIndex int, offset int", rows).distinct()
    stretch = F.floor(F.col("docPageIndex") / STRETCH)
    runs = seen.groupBy("documentId", stretch.alias("_s"), "offset").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT)
    wide = runs.select("documentId", "offset", F.explode(F.array(F.col("_s") - 1, F.col("_s"), F.col("_s") + 1)).alias("_s"))
    offsets = cut(wide.groupBy("documentId", "_s").agg(F.array_sort(F.collect_set("offset")).alias("offsets")))
    return pages.withColumn("_s", stretch).join(offsets, ["documentId", "_s"], "left").drop("_s")


def lexicon(pages: DataFrame) -> DataFrame:
    """(kind, token, n) over one text of every page: the fused one, or the first of FIELDS there is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                c = {n: part.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
                found = tally([r for r in zip(c["text"], c["title"], c["docPageIndex"], c["mode"], c["offsets"]) if r[0]])
                for kind, counts in zip("wcpb", found):
                    keys = list(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(keys), pa.string()), pa.array(keys, pa.string()), pa.array([counts[k] for k in keys], pa.int64())], names=["kind", "token", "n"])

    return pages.select("title", "docPageIndex", "mode", "offsets", first_text()).mapInArrow(run, "kind string, token string, n bigint").groupBy("kind", "token").agg(F.sum("n").alias("n"))


def candidates(words: DataFrame, known: DataFrame) -> DataFrame:
    """(word, repair, m, cost): for words (token, n) the much more frequent ones of ``known`` at a confusion's distance."""

    def index(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"key": [], "token": [], "n": []}
        for t, n in zip(c["token"], c["n"]):
            for k in deletes(t):
                out["key"].append(k)
                out["token"].append(t)
                out["n"].append(n)
        return out

    def keyed(table: DataFrame) -> DataFrame:
        fit = table.where((F.length("token") >= 3) & (F.length("token") <= 24)).select("token", "n")
        return map_rows(fit, "key string, token string, n bigint", index).withColumn("key", F.xxhash64("key"))

    right = keyed(known.where(F.col("n") >= LEAST)).select("key", F.col("token").alias("repair"), F.col("n").alias("m"))
    met = keyed(words).join(right, "key").where((F.col("m") >= RATIO * F.col("n")) & (F.col("token") != F.col("repair")) & (F.abs(F.length("token") - F.length("repair")) <= 1))
    met = met.select("token", "n", "repair", "m").distinct()

    def score(c: dict[str, list]) -> dict[str, list]:
        return {k: c[k] for k in ("token", "repair", "m")} | {"cost": [distance(a, b) for a, b in zip(c["token"], c["repair"])]}

    scored = map_rows(met, "token string, repair string, m bigint, cost double", score).where("cost <= 0.6")
    return scored.withColumnRenamed("token", "word")


def repairs(words: DataFrame, known: DataFrame) -> DataFrame:
    """(word, repair): the candidate of the least distance, of equals the most frequent."""
    best = candidates(words, known).groupBy("word").agg(F.max(F.struct(-F.col("cost"), "m", "repair")).alias("b"))
    return best.select("word", F.col("b.repair").alias("repair"))


def confusable(sound: DataFrame) -> DataFrame:
    """(word, repair, m): the words of the lexicon that one confusion turns into another one."""
    both = {(x.lower(), y.lower()) for a, b in LATIN_PAIRS for x, y in ((a, b), (b, a)) if a.isalpha() and b.isalpha()}

    def turned(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"word": [], "token": []}
        for t in c["token"]:
            made = {t[:i] + y + t[i + len(x) :] for x, y in both for i in range(len(t)) if t.startswith(x, i)}
            out["word"] += [t] * len(made)
            out["token"] += made
        return out

    fit = sound.where((F.length("token") >= 3) & F.col("token").rlike("^[a-z]+$"))
    return map_rows(fit.select("token"), "word string, token string", turned).join(sound, "token").select("word", F.col("token").alias("repair"), F.col("n").alias("m"))


def picked(asked: DataFrame, found: DataFrame, beside: DataFrame) -> DataFrame:
    """(word, before, after, repair) of asked (word, before, after), from candidates (word, repair, m, cost, own).

    ``own``: whether the word itself stands in the lexicon; it is replaced only where
    the pairs with its neighbours speak for the candidate far more than for itself.  A
    word with one candidate that isn't in the lexicon needs no pairs.
    """
    several = found.groupBy("word").agg(F.count(F.lit(1)).alias("_of"))
    rows = asked.join(found.join(several, "word"), "word")
    plain = rows.where("_of = 1 and not own").select("word", "before", "after", "repair")
    open_ = rows.where("_of > 1 or own").drop("_of")
    pair = lambda a, b: F.concat_ws(" ", a, b)
    tokens = F.array(*[F.struct(F.lit(t).alias("t"), pair(a, b).alias("token")) for t, a, b in (("rb", "before", "repair"), ("ra", "repair", "after"), ("wb", "before", "word"), ("wa", "word", "after"))])
    keys = ["word", "before", "after", "repair", "m", "cost", "own"]
    counted = open_.select(*keys, F.inline(tokens)).join(beside, "token", "left").groupBy(*keys).agg(*[F.log(F.coalesce(F.max(F.when(F.col("t") == t, F.col("n"))), F.lit(0)) + 0.5).alias(t) for t in ("rb", "ra", "wb", "wa")])
    fit = F.col("rb") + F.col("ra")
    worth = counted.where(~F.col("own") | (fit - F.col("wb") - F.col("wa") > FIT))
    best = worth.groupBy("word", "before", "after").agg(F.max(F.struct(fit - COST_WEIGHT * F.col("cost"), "m", "repair")).alias("b"))
    return plain.unionByName(best.select("word", "before", "after", F.col("b.repair").alias("repair")))


class Lookup:
    """The bounded tables a page is read with."""

    def __init__(self, words: set[str], compounds: set[str], pairs: dict[str, int], most: int = 0, whole: bool = True, all_compounds: bool = True):
        """``most``: what a pair that isn't in ``pairs`` can count; ``whole``, ``all_compounds``: whether ``words`` and ``compounds`` are all there are."""
        self.words, self.compounds, self.pairs, self.most, self.whole, self.all_compounds = words, compounds, pairs, most, whole, all_compounds
        self.seen: dict[tuple[str, str, str], str | None] = {}  # verdicts on look-alikes in their contexts

    def fit(self, before: str, c: str, after: str, unseen: int = 0) -> float:
        return math.log(self.pairs.get(before + c, unseen) + 0.5) * bool(before) + math.log(self.pairs.get(c + after, unseen) + 0.5) * bool(after)

    def better(self, before: str, c: str, after: str) -> str | None:
        """The look-alike that fits far better than ``c``."""
        key = (before, c, after)
        if key not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            best, than = max((self.fit(before, x, after), x) for x in LOOKALIKES[c])
            self.seen[key] = than if best - self.fit(before, c, after) > FIT else None
        return self.seen[key]

    def open_to(self, before: str, c: str, after: str) -> bool:
        """Whether a look-alike could fit far better, and pairs that aren't known here decide."""
        near = [p for x in c + LOOKALIKES[c] for p in (before and before + x, after and x + after) if p]
        if all(p in self.pairs for p in near):
            return False
        return max(self.fit(before, x, after, self.most) for x in LOOKALIKES[c]) - self.fit(before, c, after) > FIT

    def wide_repairs(self, text: str, unsure: list[tuple[int, str]] | None = None) -> list[tuple[int, str]]:
        """(place, better character) where a look-alike fits its neighbours far better.

        Those for which the pairs known here don't suffice are put into ``unsure``
        as (place, context).
        """
        out = []
        keep = [i for i, c in enumerate(text)] if "㆐" not in text and not _READING.search(text) else None
        bare = text
        if keep is None:
            gone = {i for m in _READING.finditer(text) for i in range(*m.span())}
            keep = [i for i in range(len(text)) if i not in gone]
            bare = "".join(text[i] for i in keep)
        for m in _SUSPECT.finditer(bare):
            i, c = m.start(), m.group()
            before = bare[i - 1] if i and bare[i - 1] > "⿿" else ""
            after = bare[i + 1] if i + 1 < len(bare) and bare[i + 1] > "⿿" else ""
            if not before and not after:
                continue
            if self.most and unsure is not None and self.open_to(before, c, after):
                unsure.append((keep[i], "\x1f".join((before, c, after))))
                continue
            than = self.better(before, c, after)
            if than:
                out.append((keep[i], than))
        return out

    def word_kind(self, word: str) -> str:
        """'sound', 'misread' or 'unknown', which the full tables decide."""
        low = word.lower()
        if low in self.words:
            return "sound"
        if _LOST.search(word):
            return "misread"
        if len(word) < 3 and word.isalpha() or word.isdigit() or _NUMBERISH.fullmatch(word):
            return "sound"
        if word.isalpha():
            return "unknown"
        if "!" in word or "^" in word or "|" in word:
            return "misread"
        bare = word.replace("’", "").replace("'", "")
        if any(c.isdigit() for c in bare):
            if re.search(r"[A-Za-z]\d[A-Za-z]", bare) and bare.translate(_DIGITS).isalpha():
                return "misread"
            return "misread" if bare.lower().translate(_DIGITS) in self.words else "sound" if self.whole else "unknown"
        return "sound" if bare.isalpha() else "unknown"


def neighbours_of(words: list[str]) -> list[tuple[str, str, str]]:
    """(word, the one before, the one after) in lower case; empty where there is none of letters only."""
    low = [w.lower() for w in words]
    side = [w if w.isalpha() else "" for w in low]
    return list(zip(low, ["", *side], [*side[1:], ""]))


def read_page(look: Lookup, text: str, title: str | None, index: int | None, offsets: list[int] | None = None) -> tuple[list[str], list[dict], list[str], list[dict], list[dict]]:
    """(defects that are sure, words to be looked up with their neighbours, paragraphs, look-alikes and broken words to be looked up) of one scanned text."""
    page = Furniture(text, title, index, offsets)
    found = []
    if page.header:
        found.append("header")
    if page.number:
        found.append("page_number")
    lines = page.body()
    cuts: list[dict] = []
    paragraphs, cutting = rejoin(lines, look.compounds, None if look.all_compounds else cuts)
    if cutting and not cuts or _cut_at_foot(lines):
        found.append("hyphen")
        cuts = [c | {"sure": True} for c in cuts]
    unknown: set[tuple[str, str, str]] = set()
    misread = False
    out = []
    contexts: list[dict] = []
    for p in paragraphs:
        words = words_of(p)
        strange = []
        for at, w in enumerate(words):
            if w.lower() not in look.words:
                kind = look.word_kind(w)
                misread = misread or kind == "misread"
                if kind == "unknown":
                    strange.append(at)
        if strange:
            around = neighbours_of(words)
            unknown.update(around[at] for at in strange)
        if not misread and _LOST.search(p):
            misread = True
        unsure: list[tuple[int, str]] = []
        better = look.wide_repairs(p, unsure) if _SUSPECT.search(p) else []
        contexts += [{"p": len(out), "i": i, "context": x} for i, x in unsure]
        if better:
            misread = True
            chars = list(p)
            for i, c in better:
                chars[i] = c
            p = "".join(chars)
        out.append(p)
    if misread:
        found.append("misread")
    return found, [dict(zip(("word", "before", "after"), u)) for u in sorted(unknown)], out, contexts, cuts


def _cut_at_foot(lines: list[str]) -> bool:
    """Whether the text itself ends in a cut word."""
    full = [x for x in lines if x.strip()]
    m = _BROKEN.search(full[-1]) if full and full[-1].rstrip(" \t")[-1:] in _HYPHENS else None
    return bool(m and len(m.group(1)) > 1)


def tables(pages: DataFrame) -> tuple[Broadcast, dict[str, DataFrame]]:
    """The lookup tables, broadcast, and in full (token, n) the words, the sound ones, the pairs of ideographs and of words, the compounds; the confusable words."""
    spark: SparkSession = pages.sparkSession
    counted = cut(lexicon(pages))
    kind = lambda k: counted.where(F.col("kind") == k).select("token", "n")
    words, pairs, compounds = kind("w"), kind("p"), kind("c").where("n >= 2")
    wrong = repairs(words, words).select(F.col("word").alias("token"))
    sound = cut(words.where((F.length("token") <= 24) & (F.col("n") >= 2)).join(wrong, "token", "left_anti"))
    alike = cut(confusable(sound))
    clear = sound.join(alike.select(F.col("word").alias("token")).distinct(), "token", "left_anti")
    top = set(head(clear, "n", "token", HEAD_WORDS).select("token").toPandas()["token"])
    known = dict(head(pairs, "n", "token", HEAD_PAIRS).toPandas().itertuples(index=False, name=None))
    hyphened = set(head(compounds, "n", "token", HEAD_WORDS).select("token").toPandas()["token"])
    look = (top, hyphened, known, beyond(pairs, "n", list(known.values())), sound.count() <= len(top), compounds.count() <= len(hyphened))
    return spark.sparkContext.broadcast(look), {"words": words, "sound": sound, "pairs": pairs, "beside": kind("b"), "compounds": compounds, "alike": alike}


def choices(contexts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(context, than): the contexts (before, character, after) whose look-alike fits far better by the counts of all pairs."""

    def needed(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"context": [], "token": []}
        for x in c["context"]:
            before, own, after = x.split("\x1f")
            for pair in {p for y in own + LOOKALIKES[own] for p in (before and before + y, after and y + after) if p}:
                out["context"].append(x)
                out["token"].append(pair)
        return out

    def choose(c: dict[str, list]) -> dict[str, list]:
        return {"context": c["context"], "than": [Lookup(set(), set(), {r["token"]: r["n"] for r in k}).better(*x.split("\x1f")) for x, k in zip(c["context"], c["known"])]}

    asked = map_rows(contexts.select("context").distinct(), "context string, token string", needed)
    counted = asked.join(pairs, "token", "left").groupBy("context").agg(F.collect_list(F.struct("token", F.coalesce("n", F.lit(0)).alias("n"))).alias("known"))
    return map_rows(counted, "context string, than string", choose).where("than is not null")


READ = "id string, fusionAt timestamp, field string, defects array<string>, unknown array<struct<word:string,before:string,after:string>>, paragraphs array<string>, contexts array<struct<p:int,i:int,context:string>>, cuts array<struct<p:int,i:int,token:string,sure:boolean>>"


def read_pages(pages: DataFrame, look: Broadcast) -> DataFrame:
    """(id, fusionAt, field, defects, unknown, paragraphs, contexts, cuts) of the fields of scanned pages."""

    def rows(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("id", "fusionAt", "field", "defects", "unknown", "paragraphs", "contexts", "cuts")}
        lookup = Lookup(*look.value)
        for i, key in enumerate(c["id"]):
            known: dict[str, tuple] = {}
            for f in FIELDS:
                text = c[f][i]
                read = ([], [], None, [], [])
                if text and text.strip():
                    if text not in known:
                        known[text] = read_page(lookup, text, c["title"][i], c["docPageIndex"][i], c["offsets"][i])
                    read = known[text]
                for k, v in zip(out, (key, c["fusionAt"][i], f, *read)):
                    out[k].append(v)
        return out

    source = pages.where("mode = 'scan' and id is not null").select("id", "fusionAt", "title", "docPageIndex", "offsets", *FIELDS)
    return map_rows(source, READ, rows)


def scanned(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The read fields of scanned pages, of the states that hold; the repairs (word, before, after, repair) of their words, (context, than) of their look-alikes, and the compounds (token) among their broken words."""
    pages = with_numbering(pages)
    look, t = tables(pages)
    read = cut(read_pages(pages, look))
    asked = cut(read.select(F.inline("unknown")).distinct())
    single = asked.select(F.col("word").alias("token")).distinct()
    digits = single.where(F.col("token").rlike("[0-9]"))
    strange = single.join(t["words"], "token", "left").select("token", F.coalesce("n", F.lit(1)).alias("n")).join(digits, "token", "left_anti")
    bare = F.translate(F.regexp_replace("token", "['’]", ""), "0159!68", "olsgibb")
    read_as = digits.select(F.col("token").alias("word"), bare.alias("token")).join(t["sound"], "token").select("word", F.col("token").alias("repair"), F.col("n").alias("m"), F.lit(0.0).alias("cost"), F.lit(False).alias("own"))
    found = candidates(strange, t["words"]).withColumn("own", F.lit(False)).unionByName(read_as)
    both = found.unionByName(t["alike"].select("word", "repair", "m", F.lit(0.3).alias("cost"), F.lit(True).alias("own")))
    fixes = cut(picked(asked, both, t["beside"]))
    better = cut(choices(read.select(F.explode("contexts.context").alias("context")), t["pairs"]))
    hyphened = read.select(F.explode("cuts.token").alias("token")).distinct().join(t["compounds"].select("token"), "token", "left_semi")
    return latest(read, ["id", "field"], "fusionAt"), fixes, better, cut(hyphened)


WORD_KEY = ["word", "before", "after"]


def defects(held: DataFrame, fixes: DataFrame, better: DataFrame, hyphened: DataFrame) -> DataFrame:
    """(page_id, field, defect), each once."""
    own = held.select(F.col("id").alias("page_id"), "field", "defects", "unknown", "contexts", "cuts")
    sure = own.select("page_id", "field", F.explode("defects").alias("defect"))
    words = own.select("page_id", "field", F.inline("unknown")).join(fixes, WORD_KEY, "left_semi")
    wide = own.select("page_id", "field", F.explode("contexts.context").alias("context")).join(better, "context", "left_semi")
    misread = words.select("page_id", "field").unionByName(wide.select("page_id", "field")).withColumn("defect", F.lit("misread"))
    broken = own.select("page_id", "field", F.explode("cuts.token").alias("token")).join(hyphened, "token", "left_anti")
    return sure.unionByName(misread).unionByName(broken.select("page_id", "field", F.lit("hyphen").alias("defect"))).distinct()


def repaired(held: DataFrame, fixes: DataFrame, better: DataFrame, hyphened: DataFrame) -> DataFrame:
    """(page_id, field, text): every field as continuous paragraphs with its words repaired."""
    keys = ["id", "field"]
    own = held.select(*keys, F.inline("unknown")).join(fixes, WORD_KEY).groupBy(*keys).agg(F.collect_set(F.struct(*WORD_KEY, "repair")).alias("fixes"))
    wide = held.select(*keys, F.inline("contexts")).join(better, "context").groupBy(*keys).agg(F.collect_list(F.struct("p", "i", "than")).alias("wide"))
    marks = held.select(*keys, F.inline("cuts")).join(hyphened, "token", "left_semi").groupBy(*keys).agg(F.collect_list(F.struct("p", "i")).alias("marks"))

    def rows(c: dict[str, list]) -> dict[str, list]:
        texts = []
        for paragraphs, fix, places, own_marks in zip(c["paragraphs"], c["fixes"], c["wide"], c["marks"]):
            known = {(x["word"], x["before"], x["after"]): x["repair"] for x in fix or ()}
            for x in places or ():
                line = paragraphs[x["p"]]
                paragraphs[x["p"]] = line[: x["i"]] + x["than"] + line[x["i"] + 1 :]
            done = []
            for no, p in enumerate(paragraphs or ()):
                words = words_of(p)
                around = iter(neighbours_of(words))

                def mended(m: re.Match) -> str:
                    w = m.group()
                    r = known.get(next(around))
                    if r is None and not w.isalpha() and re.search(r"[A-Za-z][0159!][A-Za-z]", w):
                        r = w.translate(_DIGITS)
                        return r if r.isalpha() else w
                    return w if r is None else r.capitalize() if w[:1].isupper() else r

                for i in sorted((x["i"] for x in own_marks or () if x["p"] == no), reverse=True):
                    p, around = p[:i] + "-" + p[i:], iter(())
                if own_marks and any(x["p"] == no for x in own_marks):
                    around = iter(neighbours_of(words_of(p)))
                done.append(_WORD.sub(mended, p))
            texts.append(None if paragraphs is None else "\n\n".join(done))
        return {"page_id": c["id"], "field": c["field"], "text": texts}

    joined = held.select(*keys, "paragraphs").join(own, keys, "left").join(wide, keys, "left").join(marks, keys, "left")
    return map_rows(joined, "page_id string, field string, text string", rows)
