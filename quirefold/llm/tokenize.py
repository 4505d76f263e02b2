"""Encoding a whole corpus with a public tokenizer by way of a table of distinct words.

Byte-level BPE never merges across the borders of its splitting pattern, so a
text's ids are the ids of its words in order.  Every text is split into words, each
distinct word is encoded once, and the ids go back to the places of the word.  No
text is shuffled: the words are counted where the texts are read.  The most frequent
words (at most ``HEAD`` of at most ``HEAD_CHARS`` characters and ``HEAD_LONG`` longer ones
of at most ``LONG_CHARS``, so of a known size) are broadcast with their ids: these are
the keys that would make a shuffle uneven.  A second reading puts their ids in place
and leaves a gap for any other word; only the gaps, each with its word, are joined to
the table and come back to their text by its key.  Words too long for the short list
are spread over ``SALTS`` copies of their row, so that not even a very long word that
stands everywhere makes one task.

Defined cases: a null or an empty text has an empty list; white space is encoded
like any other text; special tokens' strings are ordinary text; a null key is a
key like others; repeated rows of a key must agree and give one row; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import os
from collections import Counter
from functools import lru_cache

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.common import head, map_rows
from quirefold.session import cut

FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
HEAD, HEAD_CHARS = 65_536, 24
HEAD_LONG, LONG_CHARS = 512, 1000
SALTS, SLICE = 32, 1024

#: The published splitting pattern.  White space is that of Unicode, which Python's own class goes beyond.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def _encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


@lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(PATTERN.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))


def split(text: str) -> list[str]:
    """The words of a text; put together they are the text."""
    return _splitter().findall(text)


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) over all texts; each task adds up before the shuffle."""

    def rows(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"word": [], "n": []}
        for at in range(0, len(c[text]), SLICE):
            found: Counter = Counter()
            for x in c[text][at : at + SLICE]:
                found.update(split(x))
            out["word"] += found.keys()
            out["n"] += found.values()
        return out

    return map_rows(docs.select(text), "word string, n bigint", rows).groupBy("word").agg(F.sum("n").alias("n"))


def encode_words(distinct: DataFrame, path: str) -> DataFrame:
    """(word, n, ids): each row's word encoded."""

    def rows(c: dict[str, list]) -> dict[str, list]:
        encode_one = _encoder(path).encode_ordinary  # a pool of threads for each batch of words would cost more than the words
        return {"word": c["word"], "n": c["n"], "ids": [encode_one(w) for w in c["word"]]}

    return map_rows(distinct.select("word", "n"), "word string, n bigint, ids array<int>", rows)


def gapped(docs: DataFrame, key: str, text: str, known: Broadcast) -> DataFrame:
    """(key, print, parts, gaps): the ids of the stretches between words that aren't ``known``, and these words."""
    kind = dict(docs.dtypes)[key]

    def rows(c: dict[str, list]) -> dict[str, list]:
        ids_of = known.value
        parts, gaps = [], []
        for x in c[text]:
            run: list[int] = []
            own, missing = [run], []
            for w in split(x):
                ids = ids_of.get(w)
                if ids is None:
                    missing.append({"at": len(own) - 1, "word": w})
                    run = []
                    own.append(run)
                else:
                    run += ids
            parts.append(own)
            gaps.append(missing)
        return {key: c[key], "print": c["print"], "parts": parts, "gaps": gaps}

    source = docs.select(key, F.xxhash64(text).alias("print"), text)
    return map_rows(source, f"`{key}` {kind}, print bigint, parts array<array<int>>, gaps array<struct<at:int,word:string>>", rows)


def encode(docs: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids) of every document."""
    spark = docs.sparkSession
    full = docs.where(F.length(text) > 0).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    vocabulary = cut(encode_words(word_counts(full, "_text"), path))
    size = F.length("word")
    often = [head(vocabulary.where(fit), "n", "word", most) for fit, most in ((size <= HEAD_CHARS, HEAD), ((size > HEAD_CHARS) & (size <= LONG_CHARS), HEAD_LONG))]
    known = spark.sparkContext.broadcast({r["word"]: list(r["ids"]) for part in often for r in part.select("word", "ids").collect()})
    placed = cut(gapped(full, "_key", "_text", known))
    salts = F.when(size > HEAD_CHARS, SALTS).otherwise(1)
    gaps = placed.select("_key", "print", F.inline("gaps")).withColumn("salt", F.pmod(F.xxhash64("_key", "print"), salts.cast("bigint")).cast("int"))
    rare = vocabulary.select("word", "ids", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    filled = gaps.join(rare, ["word", "salt"]).select("_key", F.lit(None).cast("struct<print:bigint,parts:array<array<int>>>").alias("whole"), F.struct("print", "at", "ids").alias("gap"))
    rows = placed.select("_key", F.struct("print", "parts").alias("whole"), F.lit(None).cast("struct<print:bigint,at:int,ids:array<int>>").alias("gap")).unionByName(filled)
    texts = rows.groupBy("_key").agg(F.max("whole").alias("w"), F.collect_set("gap").alias("g"))
    own = F.transform(F.array_sort(F.filter("g", lambda x: x["print"] == F.col("w.print"))), lambda x: x["ids"])
    mended = F.transform("w.parts", lambda p, i: F.when(i < F.size("own"), F.concat(p, F.get("own", i))).otherwise(p))
    done = texts.withColumn("own", own).select(F.col("_key").alias(key), F.flatten(mended).alias("ids"))
    empty = docs.where(F.coalesce(F.length(text), F.lit(0)) == 0).select(key).distinct().select(key, F.array().cast("array<int>").alias("ids"))
    return done.unionByName(empty)


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece): the bytes of every id; its size is that of the vocabulary."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in read_ranks(path).items()], "id int, piece binary")


def decode(encoded: DataFrame, key: str, ids: str, pieces: DataFrame) -> DataFrame:
    """(key, text): ids joined to their bytes and put together."""
    each = encoded.select(key, F.posexplode(ids).alias("pos", "id"))
    parts = each.join(F.broadcast(pieces), "id").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("h")))).alias("p"))
    whole = parts.select(key, F.unhex(F.concat_ws("", F.col("p.h"))).cast("string").alias("text"))
    return encoded.select(key).join(whole, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))
