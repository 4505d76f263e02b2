"""Lexical and vector retrieval, rank fusion, verification and the parts of a result page."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from quirefold.functions import text as T
from quirefold.operators.ranking import places
from quirefold.session import cut, read_folder, scratch, spread

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF = 60
BROADCAST_ROWS, BROADCAST_CHARS, BLOCK = 200_000, 4_000_000, 10_000
ASKED, DOCS = 25_000, 16_384


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_CHARS) -> DataFrame:
    """``df`` marked for broadcast if it is shown to have at most ``rows`` rows and ``size`` characters, else as it is."""
    wide = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    n, chars = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(wide), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and chars <= size else df


class _Best:
    """The ``k`` best items of each of ``n`` queries, with all that lie within ``margin`` of the last of them; ``least`` bounds what can still count."""

    def __init__(self, n: int, k: int, margin: float, least: float):
        self.k, self.margin, self.least = k, margin, np.full(n, least)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = self.new = 0

    def add(self, q: np.ndarray, item: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((q, item, score))
        self.new += len(q)
        if self.new > max(self.held, 1 << 18):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, item, score = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *self.parts))
        order = np.lexsort((-score, q))
        q, item, score = q[order], item[order], score[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(q)])
        full = sizes >= self.k
        self.least[q[starts[full]]] = np.maximum(self.least[q[starts[full]]], score[starts[full] + self.k - 1] - self.margin)
        keep = score >= self.least[q]
        self.parts = [(q[keep], item[keep], score[keep])]
        self.held, self.new = int(keep.sum()), 0
        return self.parts[0]


_SPACES = np.zeros(0x110000, bool)
_SPACES[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True  # text.SPACE
_SPACES[0x2000:0x200B] = True


class _Grams:
    """The trigrams and tetragrams of texts as numbers: a trigram by its place among the wanted ones, a tetragram by its trigram's place and its last character."""

    def __init__(self, three: np.ndarray, four: np.ndarray):
        self.three, self.four = three, four
        self.size = len(three) + len(four)

    @staticmethod
    def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text's number, character) without white space, and the lengths so counted."""
        c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
        keep = ~_SPACES[c]
        at, c = at[keep], c[keep].astype(np.int64)
        return at, c, np.bincount(at, minlength=len(texts))

    @staticmethod
    def triples(at: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a trigram begins, and its three characters in one number."""
        begins = np.flatnonzero(at[2:] == at[:-2])
        return begins, c[begins] << 42 | c[begins + 1] << 21 | c[begins + 2]

    @staticmethod
    def place(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The places of keys in a sorted table, -1 for those it hasn't."""
        if not len(table):
            return np.full(len(keys), -1)
        i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[i] == keys, i, -1)

    @classmethod
    def of(cls, texts: list[str]) -> _Grams:
        """All grams of some texts."""
        at, c, _ = cls.characters(texts)
        begins, triple = cls.triples(at, c)
        three = np.unique(triple)
        four = np.flatnonzero(at[begins] == np.r_[at, -1][begins + 3])
        return cls(three, np.unique(cls.place(three, triple[four]) << 21 | c[begins[four] + 3]))

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text's number, gram) of each wanted gram where it stands, and the texts' lengths."""
        at, c, sizes = self.characters(texts)
        begins, triple = self.triples(at, c)
        i = self.place(self.three, triple)
        begins, i = begins[i >= 0], i[i >= 0]
        longer = np.flatnonzero(at[begins] == np.r_[at, -1][begins + 3])
        j = self.place(self.four, i[longer] << 21 | c[begins[longer] + 3])
        longer, j = longer[j >= 0], j[j >= 0]
        return np.r_[at[begins], at[begins[longer]]], np.r_[i, j + len(self.three)], sizes


def _length(bare: np.ndarray) -> np.ndarray:
    """How many grams a text of so many characters has."""
    return sum(np.maximum(bare - n + 1, 0) for n in T.GRAM_SIZES)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together or cut to blocks of at most so many rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, rows - size)
            held, size, at = [*held, part], size + part.num_rows, at + part.num_rows
            if size == rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k: int, digits: int = 9) -> DataFrame:
    """(query_key, key, score, place): the k best texts of each query by BM25 over character n-grams.

    Equal texts and equal queries are one each until the end.  The queries are dealt
    into blocks of about ASKED, which lie in the shared folder; a task numbers the grams of
    a block's queries, reads only those in its texts, and adds up a query's scores over
    DOCS texts at a time.  What leaves a task is a count a gram, and the k best of each query.
    A negative inverse frequency is raised to EPSILON times the mean over the whole
    vocabulary of the corpus, which is counted only where some gram asked for needs it; so
    a score doesn't hang on what else is asked.
    """
    spark, kind, query_kind = docs.sparkSession, dict(docs.dtypes)[key], dict(queries.dtypes)[query_key]
    held = docs.select(key, text).where(F.length(text) >= 3)
    held = cut(held.groupBy(text).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("_n")))
    asked = cut(queries.where(F.length(query_text) >= 3).groupBy(query_text).agg(F.min(query_key).alias("_q")))
    blocks = max(1, math.ceil(asked.count() / ASKED))
    folder = scratch(spark, "asked")
    asked.withColumn("block", F.pmod(F.xxhash64(query_text), F.lit(blocks))).write.partitionBy("block").parquet(folder)
    cores, splits = spark.sparkContext.defaultParallelism, held.rdd.getNumPartitions()
    rows = held.select(key, text, "_n").repartition(cores * max(1, splits // cores))  # no last task alone
    total = held.agg(F.sum("_n")).first()[0] or 0
    types = [to_arrow_type(_parse_datatype_string(t)) for t in (query_kind, kind)]

    def wanted(block: int) -> tuple[list, list[str], _Grams]:
        table = read_folder(os.path.join(folder, f"block={block}"), ["_q", query_text])
        names, texts = ([], []) if table is None else (table.column(0).to_pylist(), table.column(1).to_pylist())
        order = sorted(range(len(texts)), key=texts.__getitem__)
        return [names[i] for i in order], [texts[i] for i in order], _Grams.of(texts)

    def count(block: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams = wanted(block)[2]
            df, size = np.zeros(grams.size, np.int64), 0
            for b in _blocks(batches, 4096):
                at, g, bare = grams.read(b.column(1).to_pylist())
                n = b.column(2).to_numpy()
                one = np.unique(at * grams.size + g)
                df += np.bincount(one % grams.size, n[one // grams.size], grams.size).astype(np.int64) if len(one) else 0
                size += int((_length(bare) * n).sum())
            found = np.flatnonzero(df)
            out = pa.table({"gram": np.r_[-1, found], "df": np.r_[size, df[found]]})
            yield from out.to_batches(10_000)

        return rows.mapInArrow(run, "gram bigint, df bigint").groupBy("gram").agg(F.sum("df").alias("df"))

    counted = scratch(spark, "counted")
    for b in range(blocks):
        count(b).write.parquet(os.path.join(counted, f"block={b}"))
    counts = spark.read.schema("gram bigint, df bigint, block int").parquet(counted)
    size = counts.where("gram < 0 AND block = 0").agg(F.max("df")).first()[0] or 0
    mean = size / total if total and size else 1.0
    least = 0.0
    if total and not counts.where((F.col("gram") >= 0) & (F.log(F.lit(total) - F.col("df") + 0.5) < F.log(F.col("df") + 0.5))).isEmpty():
        n = F.col("df")
        least = EPSILON * vocabulary(rows, text, "_n").agg(F.avg(F.log(F.lit(total) - n + 0.5) - F.log(n + 0.5))).first()[0]

    def of(block: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, texts, grams = wanted(block)
            if not names or not grams.size:
                return
            df = np.zeros(grams.size)
            table = read_folder(os.path.join(counted, f"block={block}"), ["gram", "df"])
            g, n = table.column("gram").to_numpy(), table.column("df").to_numpy()
            df[g[g >= 0]] = n[g >= 0]
            idf = np.log(total - df + 0.5) - np.log(df + 0.5)
            idf = np.where(idf < 0, least, idf)
            q, g, _ = grams.read(texts)
            order = np.lexsort((g, q))
            q, g = q[order], g[order]
            ends = np.searchsorted(q, np.arange(len(names) + 1))
            best = _Best(len(names), k, 2 * 10.0**-digits, 5e-324)
            ids: list = []
            for b in _blocks(batches, DOCS):
                m = b.num_rows
                at, gram, bare = grams.read(b.column(1).to_pylist())
                both, tf = np.unique(gram * m + at, return_counts=True)
                gram, at = both // m, both % m
                w = idf[gram] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * _length(bare)[at] / mean))
                begin = np.searchsorted(gram, np.arange(grams.size + 1))
                spare = np.zeros(0, np.int64), np.zeros(0)  # used again and again, as fresh memory costs more than the sums
                one: tuple[list, list, list] = ([], [], [])
                for j in range(len(names)):
                    own = g[ends[j] : ends[j + 1]]
                    x, y = begin[own], begin[own + 1]
                    n = int((y - x).sum())
                    if not n:
                        continue
                    if n > len(spare[0]):
                        spare = np.zeros(2 * n, np.int64), np.zeros(2 * n)
                    spans = [slice(u, v) for u, v in zip(x.tolist(), y.tolist()) if u < v]
                    score = np.bincount(np.concatenate([at[s] for s in spans], out=spare[0][:n]), np.concatenate([w[s] for s in spans], out=spare[1][:n]), m)
                    near = np.flatnonzero(score >= best.least[j])
                    score = score[near]
                    if len(near) > k:
                        kth = np.partition(score, len(score) - k)[len(score) - k] - best.margin
                        near, score = near[score >= kth], score[score >= kth]
                        best.least[j] = max(best.least[j], kth)
                    if len(near):
                        one[0].append(np.full(len(near), j))
                        one[1].append(near + len(ids))
                        one[2].append(score)
                ids += b.column(0).to_pylist()
                if one[0]:
                    best.add(*map(np.concatenate, one))
                    best.settle()
            q, item, score = best.settle()
            for x in range(0, len(q), 10_000):
                p = slice(x, x + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q[p]], type=types[0]), pa.array([ids[i] for i in item[p]], type=types[1]), pa.array(score[p])], names=["_q", key, "score"])

        return rows.select(key, text).mapInArrow(run, f"_q {query_kind}, `{key}` {kind}, score double")

    found = reduce(DataFrame.unionByName, [of(b) for b in range(blocks)]).withColumn("score", F.round("score", digits)).where("score > 0")
    best = cut(top(found, ["_q"], "score", key, k).drop("place"))
    copies = held.where("_n > 1").select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    met = best.select(F.col(key).alias("_k")).distinct().join(copies, "_k")
    others = docs.select(key, F.col(text).alias("_t")).join(met, "_t").select("_k", key)
    first = others.withColumn("_c", F.row_number().over(W.partitionBy("_k").orderBy(key))).where(F.col("_c") <= k).where(F.col("_k") != F.col(key)).drop("_c")
    every = best.unionByName(best.withColumnRenamed(key, "_k").join(first, "_k").select("_q", key, "score"))
    ranked = top(every, ["_q"], "score", key, k)
    same = queries.select(query_key, query_text).join(asked, query_text).select(query_key, "_q")
    return ranked.join(small(same), "_q").select(query_key, key, "score", "place")


def vocabulary(docs: DataFrame, text: str, times: str) -> DataFrame:
    """(triple, last, df): every gram of some texts and how many texts have it, each text counted ``times``; ``last`` is -1 for a trigram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, 8192):
            texts, n = b.column(0).to_pylist(), b.column(1).to_numpy()
            grams = _Grams.of(texts)
            at, g, _ = grams.read(texts)
            one = np.unique(at * max(grams.size, 1) + g)
            df = np.bincount(one % grams.size, n[one // grams.size], grams.size).astype(np.int64) if len(one) else np.zeros(0, np.int64)
            triple = np.r_[grams.three, grams.three[grams.four >> 21]]
            last = np.r_[np.full(len(grams.three), -1), grams.four & 0x1FFFFF]
            yield from pa.table({"triple": triple, "last": last, "df": df}).to_batches(50_000)

    return docs.select(text, times).mapInArrow(run, "triple bigint, last bigint, df bigint").groupBy("triple", "last").agg(F.sum("df").alias("df"))


def top(df: DataFrame, group: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group with their ``place``; only k rows of a group leave a task."""
    place = F.row_number().over(W.partitionBy(*group).orderBy(F.desc(score), tie))
    return df.withColumn("place", place).where(F.col("place") <= k)


def knn(rows: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, k: int, least: float | None = None, query_vector: str | None = None, itself: bool = False) -> DataFrame:
    """(query, hit, score, place): for each of a stated set of queries the k most similar rows, by exact cosine.

    The queries are dealt into blocks of about BLOCK, which lie in the shared folder;
    every row meets each block in one matrix product, and only a query's k best of a
    task leave it.  Vectors with nulls, of all zeros or of another length than the
    queries' are left out, and so are pairs of equal keys unless ``itself``.
    """
    kind, query_kind = dict(rows.dtypes)[key], dict(queries.dtypes)[query_key]
    clean = lambda df, i, v: df.select(F.col(i).alias("i"), F.col(v).cast("array<double>").alias("v")).where(F.col("i").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    asked = clean(queries, query_key, query_vector or vector)
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    folder = scratch(rows.sparkSession, "queries")
    asked.withColumn("block", F.pmod(F.xxhash64("i"), F.lit(blocks))).write.partitionBy("block").parquet(folder)
    schema = f"query {query_kind}, hit {kind}, score double"

    def of(block: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = read_folder(os.path.join(folder, f"block={block}"), ["i", "v"])
            names = [] if table is None else table.column("i").to_pylist()
            if not names:
                return
            lengths = [len(v) for v in table.column("v").to_pylist()]
            dims = max(lengths)
            fit = [j for j, n in enumerate(lengths) if n == dims]
            values = table.column("v").to_pylist()
            q = np.array([values[j] for j in fit])
            norms = np.linalg.norm(q, axis=1)
            q, names = q[norms > 0] / norms[norms > 0, None], [names[j] for j, n in zip(fit, norms) if n > 0]
            best = _Best(len(names), k, 2e-9, -2.0 if least is None else least - 1e-9)
            kept: list = []
            own: dict = {}
            for j, name in enumerate(names):
                own.setdefault(name, []).append(j)
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    part = b.slice(at, 4096)
                    ids, column = part.column(0).to_pylist(), part.column(1)
                    sizes = np.diff(column.offsets.to_numpy())
                    right = np.flatnonzero(sizes == dims)
                    if not len(right):
                        continue
                    x = column.values.to_numpy()[column.offsets.to_numpy()[right][:, None] + np.arange(dims)]
                    n = np.linalg.norm(x, axis=1)
                    x, ids = x[n > 0] / n[n > 0, None], [ids[j] for j in right[n > 0]]
                    if not ids:
                        continue
                    for lo in range(0, len(names), 512):
                        score = q[lo : lo + 512] @ x.T
                        low = best.least[lo : lo + 512]
                        if len(ids) > k and (low < -1.5).any():
                            np.maximum(low, np.partition(score, -k - 1, axis=1)[:, -k - 1] - best.margin, out=low)  # one more, as the query itself may be among them
                        row, item = np.nonzero(score >= low[:, None])
                        found = score[row, item]
                        if not itself:
                            same = [(j - lo, i) for i, x_ in enumerate(ids) for j in own.get(x_, ()) if lo <= j < lo + 512]
                            if same:
                                other = ~np.isin(row * len(ids) + item, [j * len(ids) + i for j, i in same])
                                row, item, found = row[other], item[other], found[other]
                        best.add(row + lo, item + len(kept), found)
                    kept += ids
            query, item, score = best.settle()
            score = np.round(score, 9)
            if least is not None:
                query, item, score = query[score >= least], item[score >= least], score[score >= least]
            for at in range(0, len(query), 10_000):
                p = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array([names[j] for j in query[p]], type=types[0]), pa.array([kept[i] for i in item[p]], type=types[1]), pa.array(score[p])], names=["query", "hit", "score"])

        types = [to_arrow_type(_parse_datatype_string(t)) for t in (query_kind, kind)]
        return clean(rows, key, vector).mapInArrow(run, schema)

    pairs = reduce(DataFrame.unionByName, [of(b) for b in range(blocks)])
    return top(pairs, ["query"], "score", "hit", k)


def rrf(hits: DataFrame, query: str, leg: str, item: str, score: str, k: int = RRF, most: int = 100) -> DataFrame:
    """(query, item, rrf, place): the sum over legs of 1 / (k + rank), ranks by score and item."""
    best = hits.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(query, leg, item).agg(F.max(score).alias("_s"))
    ranked = places(best, [query, leg], "_s", item)
    fused = ranked.groupBy(query, item).agg(F.sum(1.0 / (k + F.col("place"))).alias("rrf"))
    return top(fused.withColumn("rrf", F.round("rrf", 12)), [query], "rrf", item, most)


def minmax(df: DataFrame, group: list[str], score: str) -> DataFrame:
    """Adds ``scaled``: scores from 0 to 1 within a group; 1 where all are equal."""
    ends = df.groupBy(*group).agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    low, high = F.col("_low"), F.col("_high")
    return df.join(ends, group).withColumn("scaled", F.when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low))).drop("_low", "_high")


def boosted(df: DataFrame, query: str, score: str, item: str, tier: str, favoured: str, by: float = 0.15) -> DataFrame:
    """Scores of the favoured tier raised, and places anew."""
    up = F.col(score) + F.when(F.col(tier) == favoured, by).otherwise(0.0)
    return places(df.withColumn("boosted", up), [query], "boosted", item).drop("of")


def ribbons(df: DataFrame, query: str, tier: str, place: str, quota: dict[str, int], rest: str) -> DataFrame:
    """The first of each tier by place up to its quota; rows of no known tier fall to ``rest`` and its quota."""
    ribbon = F.when(F.col(tier).isin(list(quota)), F.col(tier)).otherwise(rest)
    held = df.withColumn("ribbon", ribbon)
    nth = F.row_number().over(W.partitionBy(query, "ribbon").orderBy(place))
    most = F.create_map(*[F.lit(v) for kv in quota.items() for v in kv])
    return held.withColumn("nth", nth).where(F.col("nth") <= most[F.col("ribbon")])


def comparable(x: Column) -> Column:
    """A text as the verifier compares it: white space and zero-width characters dropped."""
    return F.regexp_replace(F.translate(x, T.ZERO_WIDTH, ""), f"[{T.SPACE}]+", "")


def verdict(span: Column, text: Column, second: Column | None = None) -> Column:
    """How a quoted span stands to a text; the first rule that holds decides."""
    quote, body = comparable(span), comparable(text)
    out = (
        F.when(span.isNull() | (F.length(F.trim(span)) == 0), "no_span")
        .when(F.length(F.trim(span)) < 4, "span_too_short")
        .when(text.isNull(), "no_text")
        .when(F.length(quote) < 4, "span_too_short")
        .when(F.contains(body, quote), "verified")
    )
    if second is not None:
        out = out.when(F.contains(comparable(second), quote), "translation_match")
    return out.otherwise("span_not_found")


def trust(tier: Column, layers: Column) -> Column:
    """1 for primary sources, 0.7 for others, a tenth less for commentary."""
    noted = F.contains(layers, F.lit("箋解")) | F.contains(layers, F.lit("疏議"))
    return F.round(F.when(tier == "primary", 1.0).otherwise(0.7) * F.when(noted, 0.9).otherwise(1.0), 3)


def expanded(hits: DataFrame, extra: DataFrame, query: str, item: str) -> DataFrame:
    """Hits and further items found by keyword, which have the score 0 unless they are hits already."""
    new = extra.select(query, item).distinct().join(hits, [query, item], "left_anti")
    return hits.select(query, item, "score").unionByName(new.withColumn("score", F.lit(0.0)))


def parts_of(x: Column, most: int | None = None) -> Column:
    """All different parts of a short text, those of up to ``most`` characters where it is given."""
    n = F.length(x)
    ends = lambda i: n - i + 1 if most is None else F.least(n - i + 1, F.lit(most))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), ends(i)), lambda k: F.substring(x, i, k)))))


def lookup(words: DataFrame, word: str, entries: DataFrame, term: str, most: int = 5, least: int = 2) -> DataFrame:
    """(word, term, how): words among the terms of a dictionary: 'exact', else 'part' (up to ``most`` terms that hold the word, the shortest first), else 'none'.

    Terms meet the words they hold by a join on their parts, not by comparing each with each.
    """
    exact = words.join(entries, F.col(word) == F.col(term)).select(word, term)
    rest = words.join(exact.select(word), word, "left_anti")
    parts = entries.where(F.length(term) > 0).select(term, F.explode(parts_of(F.col(term))).alias(word)).where(F.length(word) >= least)
    nth = F.row_number().over(W.partitionBy(word).orderBy(F.length(term), term))
    part = rest.join(parts, word).withColumn("_n", nth).where(F.col("_n") <= most).select(word, term)
    none = rest.join(part.select(word).distinct(), word, "left_anti").select(word, F.lit(None).cast("string").alias(term))
    out = exact.withColumn("how", F.lit("exact")).unionByName(part.withColumn("how", F.lit("part")))
    return out.unionByName(none.withColumn("how", F.lit("none")))


def by_keyword(terms: DataFrame, mentions: DataFrame, query: str, item: str, keyword: str, most: int, items: int) -> DataFrame:
    """(query, item): items that mention one of the ``most`` most frequent keywords which hold a term of the query.

    ``terms`` is (query, term), ``mentions`` (item, keyword), once for each mention;
    at most ``items`` items a query, in order of their keys.  Keywords hold a term
    where one of their own parts is it, so the two meet by a join on parts.

    A query's best keywords are among the best of its terms, and its first items among
    the first of its keywords, so each different term keeps ``most`` keywords and each
    chosen keyword ``items`` items before queries are put in; neither a term that
    stands in all keywords nor a keyword that stands in all items is multiplied by the queries.
    Of a query's keywords that have so many, the least last item bounds the items that count.
    """
    asked = terms.select(query, "term").distinct()
    wanted = asked.select("term").distinct()
    longest = wanted.agg(F.max(F.length("term"))).first()[0] or 1
    tasks = 4 * mentions.sparkSession.sparkContext.defaultParallelism
    frequency = mentions.groupBy(keyword).agg(F.count(F.lit(1)).alias("_n")).repartition(tasks)  # few rows, but long words have many parts
    parts = frequency.where(F.length(keyword) > 0).select(keyword, "_n", F.explode(parts_of(F.col(keyword), longest)).alias("term"))
    best = cut(top(parts.join(small(wanted), "term"), ["term"], "_n", keyword, most).select("term", keyword, "_n"))
    chosen = cut(top(asked.join(best, "term").select(query, keyword, "_n").distinct(), [query], "_n", keyword, most).select(query, keyword))
    nth = F.dense_rank().over(W.partitionBy(keyword).orderBy(item))
    met = mentions.select(item, keyword).join(small(chosen.select(keyword).distinct()), keyword)
    first = cut(met.withColumn("_r", nth).where(F.col("_r") <= items).distinct())
    bounds = chosen.join(first.where(F.col("_r") == items).select(keyword, F.col(item).alias("_last")), keyword).groupBy(query).agg(F.min("_last").alias("_last"))
    found = chosen.join(bounds, query, "left").join(first.drop("_r"), keyword).where(F.col("_last").isNull() | (F.col(item) <= F.col("_last"))).select(query, item).distinct()
    return found.withColumn("_r", F.row_number().over(W.partitionBy(query).orderBy(item))).where(F.col("_r") <= items).drop("_r")


def intent(text: Column) -> Column:
    """What a question asks for, by its words: facts, readings by others, a survey, or unknown (a model can stand in for this rule)."""
    return (
        F.when(text.rlike("(?i)何時|何年|幾年|誰|卒|生於|\\b(when|who|where|date|year)\\b"), "factual")
        .when(text.rlike("(?i)考證|評|注釋|解|研究|\\b(why|how|meaning|interpret|commentary)"), "interpretive")
        .when(text.rlike("(?i)制度|總論|概論|\\b(overview|system|history of)\\b"), "synthesis")
        .otherwise("unknown")
    )


def raised_by_intent(score: Column, tier: Column, intent_: Column, by: float = 0.15) -> Column:
    """A score raised for primary sources where facts are asked, for others where readings are."""
    favoured = F.when(intent_ == "factual", "primary").when(intent_ == "interpretive", "secondary")
    return score + F.when(tier == favoured, by).otherwise(0.0)


def boosted_by_intent(df: DataFrame, query: str, score: str, item: str, tier: str, intent_: str, by: float = 0.15) -> DataFrame:
    """Scores raised by intent, and places anew."""
    return places(df.withColumn("boosted", raised_by_intent(F.col(score), F.col(tier), F.col(intent_), by)), [query], "boosted", item).drop("of")


def header(title: Column, chapter: Column, ordinal: Column, text: Column) -> Column:
    """A text with the place it stands at, as it is reranked; a chapter is named by its ordinal where it has one."""
    named = lambda c: F.when(F.length(c) > 0, c)
    at = F.when(named(chapter).isNotNull() & (ordinal > 0), F.concat(F.lit("卷"), ordinal.cast("string"))).otherwise(named(chapter))
    parts = F.concat_ws("·", named(title), at)
    return F.concat(F.when(F.length(parts) > 0, F.concat(F.lit("《"), parts, F.lit("》\n"))).otherwise(""), F.coalesce(text, F.lit("")))


def badge(tier: Column, layer: Column) -> Column:
    """How strong the evidence of a source is."""
    commentary = layer.isin("校點", "校訂", "箋解")
    return F.when(tier == "primary", F.when(layer == "疏議", "primary_疏議").when(commentary, "editorial_commentary").otherwise("primary_source")).otherwise("scholarly_interpretation")


def members_of(scored: DataFrame, members: DataFrame, group: str, item: str, most: int) -> DataFrame:
    """(item, group, score): the members of scored groups, each in its best group, at most ``most`` of a group."""
    joined = members.join(scored, group)
    best = joined.withColumn("_n", F.row_number().over(W.partitionBy(item).orderBy(F.desc("score"), group))).where("_n = 1").drop("_n")
    return best.withColumn("_m", F.row_number().over(W.partitionBy(group).orderBy(item))).where(F.col("_m") <= most).drop("_m")
