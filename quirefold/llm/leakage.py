"""Held-out items in corpus texts: one automaton, one scan of each text.

Texts and items are compared by their letters, digits and ideographs only, in
lower case and normal width (NFKC).  A stretch of ``window`` such characters that a
text shares with an item holds an anchor: a piece of half a window that begins at a
multiple of the other half.  The anchors of all items are the patterns of one
Aho-Corasick automaton; a text is read once, each hit is extended to the whole
stretch both share, and stretches of a window or more mark the item's characters
they cover and, through a table of offsets, where in the raw text they stand.  A
text holds an item if the marked characters are at least ``share`` of it.

Anchors instead of all windows make the automaton some twenty times smaller, so
``BLOCK_CHARS`` characters of items fit one of a bounded size.  A larger set is
dealt into blocks by hash, each a file in the shared folder that the workers read;
the driver sees their number only.  A further block costs a further scan.

Defined cases: null, empty and blank texts hold nothing; an item with fewer
characters than a window is a pattern as a whole; null items are ignored, equal
items under several ids are all reported; repeated rows count once.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import map_rows
from quirefold.session import scratch

WINDOW, WINDOW_LATIN, SHARE = 12, 40, 0.5
BLOCK_CHARS = 2_000_000

_PLAIN = re.compile(r"[^a-z0-9]+")


def normal(text: str) -> str:
    """The compared characters of a text."""
    if text.isascii():
        return _PLAIN.sub("", text.lower())
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if c.isalnum())


def offsets(text: str) -> list[int]:
    """For each character of ``normal(text)`` the offset of the raw character it comes from.

    Normalisation works on a base with its marks, so raw characters are taken by such groups.
    """
    out: list[int] = []
    start = 0
    for end in range(1, len(text) + 1):
        if end == len(text) or not (unicodedata.combining(text[end]) or text[end] in "゙゚ﾞﾟ"):
            out += [start] * len(normal(text[start:end]))
            start = end
    return out


def is_latin(item: str) -> bool:
    letters = [c for c in item if c.isalpha()]
    return 2 * sum("LATIN" in unicodedata.name(c, "") for c in letters) > len(letters)


def window_of(body: str) -> int:
    return min(len(body), WINDOW_LATIN if is_latin(body) else WINDOW)


def same(a: str, b: str) -> int:
    """How many characters two texts have in common at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


class Scanner:
    """The automaton of one block of items (key, normalised text), read and built where it is first used."""

    def __init__(self, folder: str, share: float):
        self.folder, self.share = folder, share
        self.automaton = None

    def __getstate__(self):
        return {"folder": self.folder, "share": self.share, "automaton": None}

    def _items(self) -> list[tuple[object, str]]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(self.folder) if ":" in self.folder.split("/", 1)[0] else (fs.LocalFileSystem(), self.folder)
        if system.get_file_info(inner).type == fs.FileType.NotFound:
            return []  # no item has this hash
        table = ds.dataset(inner, filesystem=system, format="parquet", exclude_invalid_files=True).to_table()
        return sorted(zip(table.column("key").to_pylist(), table.column("body").to_pylist()))

    def build(self, items: list[tuple[object, str]]) -> None:
        import ahocorasick

        self.block = [(key, body, window_of(body)) for key, body in items]
        table: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, body, w) in enumerate(self.block):
            size = (w + 1) // 2
            for a in range(0, len(body) - size + 1, w - size + 1):
                table[body[a : a + size]].append((i, a))
        automaton = ahocorasick.Automaton()
        for pattern, where in table.items():
            automaton.add_word(pattern, (len(pattern), where))
        automaton.make_automaton()
        self.automaton = automaton

    def scan(self, text: str) -> list[tuple[object, float, int, int]]:
        """(item, share of it found, raw start, raw end of the stretch) of the items a text holds."""
        if self.automaton is None:
            self.build(self._items())
        body = normal(text)
        marks: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        done: dict[tuple[int, int], int] = {}  # how far a diagonal is known
        for end, (size, where) in self.automaton.iter(body):
            at = end - size + 1
            for i, a in where:
                line = (i, at - a)
                if done.get(line, -1) >= a + size:
                    continue
                item, w = self.block[i][1:]
                right = size + same(item[a + size :], body[at + size : at + len(item) - a])
                left = same(item[:a][::-1], body[max(0, at - a) : at][::-1])
                done[line] = a + right
                if left + right >= w:
                    marks[i].append((a - left, a + right, at - left))
        found, places = [], None
        for i, hits in marks.items():
            hits.sort()
            covered, reach = 0, 0
            for lo, hi, _ in hits:
                covered += max(0, hi - max(lo, reach))
                reach = max(reach, hi)
            key, whole, _ = self.block[i]
            if covered >= self.share * len(whole):
                if places is None and len(offsets_ := offsets(text)) == len(body):
                    places = offsets_
                first, last = min(t for *_, t in hits), max(t + hi - lo - 1 for lo, hi, t in hits)
                found.append((key, covered / len(whole), places[first] if places else -1, places[last] + 1 if places else -1))
        return found


def blocks(items: DataFrame, key: str, text: str) -> list[str]:
    """Folders of the items (key, body), normalised, of about BLOCK_CHARS characters each."""
    kind = dict(items.dtypes)[key]

    def rows(c: dict[str, list]) -> dict[str, list]:
        return {"key": c[key], "body": [normal(x) for x in c[text]]}

    held = items.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    bodies = map_rows(held, f"key {kind}, body string", rows).where(F.length("body") > 0).distinct()
    chars = bodies.agg(F.sum(F.length("body"))).first()[0] or 0
    count = math.ceil(chars / BLOCK_CHARS)
    folder = scratch(items.sparkSession, "items")
    if count:
        bodies.withColumn("block", F.pmod(F.xxhash64("key", "body"), F.lit(count))).write.partitionBy("block").parquet(folder)
    return [os.path.join(folder, f"block={b}") for b in range(count)] if count > 1 else [os.path.join(folder, "block=0")][:count]


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, share: float = SHARE) -> DataFrame:
    """(key, item_key, covered, start, end): the items each document holds."""
    types = dict(docs.dtypes), dict(items.dtypes)
    schema = f"`{key}` {types[0][key]}, `{item_key}` {types[1][item_key]}, covered double, start int, end int"
    source = docs.where(F.length(text) > 0).select(key, text)

    def of(folder: str) -> DataFrame:
        scanner = Scanner(folder, share)

        def rows(c: dict[str, list]) -> dict[str, list]:
            out: list[list] = [[], [], [], [], []]
            for k, x in zip(c[key], c[text]):
                for hit in scanner.scan(x):
                    for o, v in zip(out, (k, *hit)):
                        o.append(v)
            return dict(zip((key, item_key, "covered", "start", "end"), out))

        return map_rows(source, schema, rows)

    parts = [of(folder) for folder in blocks(items, item_key, item_text)]
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    # A document may stand in several rows; of equal findings one is kept, the widest first.
    return reduce(DataFrame.unionByName, parts).groupBy(key, item_key).agg(F.max(F.struct("covered", "start", "end")).alias("_f")).select(key, item_key, "_f.covered", "_f.start", "_f.end")
