"""Long exact spans shared between records, by a log-structured fingerprint index.

Fingerprints.  Every window of ``GRAM`` = 32 characters has a polynomial hash; of
any ``SPAN - GRAM + 1`` = 33 successive windows those with the least hash are
kept (winnowing).  Two records with 64 successive characters in common keep the
same window of that stretch, so none is missed, at about 6 % of all positions.
Each fingerprint also carries short hashes of the 16 characters before and after
it: of a common stretch of 64 at least one side must agree, which removes nearly
all chance hits before any text is looked at.

Index.  A batch of records becomes an immutable run: a table bucketed and sorted
by hash in the shared folder.  A new batch is merge-joined with every older run
and with itself, bucket by bucket, without moving the older runs; when there are
more than ``FAN`` runs they are compacted into one.  The folder keeps the list of
its runs and the texts, so that a later call, or a later session, opens the index
and adds a batch to what stands there.

Hot windows.  A window that more than ``HOT`` texts hold is not joined each with
each.  Its occurrences are told apart by the whole stretches of ``SPAN`` characters
they lie in; all occurrences of one stretch are linked to the first text that holds
it.  Two texts with a common stretch thus meet in the same first text, with which
both have that stretch in common: the links name a class.  Whoever needs the pairs
themselves takes ``grouped``, which gives the sets of texts that hold a hot stretch
and the places of these stretches, for ``every_pair`` and ``coverage``; or
``shared`` with ``hot="each"``, whose links are those of every two texts.  Both deal
large groups into blocks, so no task joins more than ``HOT`` rows with as many.

Candidates are verified on the texts: the common stretch round each anchor is
measured, and only stretches of ``SPAN`` characters or more count.

Exact copies of a text are one entry of the index, however many records hold it;
``shared`` gives links between distinct texts and the membership of records.
``record_pairs`` expands them: records of two linked texts each with each, and
copies with one another, up to ``COPIES`` records a text; a further copy is linked to
the first record of its own text and of each linked text, which name the classes.
``every_pair`` has no such bound.

Defined cases: null and short texts share nothing (their coverage is 0); repeated
rows are one record; a record is never paired with itself; an empty table gives an
empty result.
"""

from __future__ import annotations

import os
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.llm.common import map_rows
from quirefold.session import cut, exists, remove, scratch

SPAN, GRAM, SIDE = 64, 32, 16
WINDOW = SPAN - GRAM + 1
FAN, COPIES, HOT = 8, 1000, 1000
BASE = 0x9E3779B97F4A7C15
BLOCK = 1_000_000
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def fingerprints(points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash, sides) of the kept windows of texts laid end to end."""
    n = len(points)
    start = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    none = np.zeros(0, np.int64)
    if n < SPAN:
        return none, none, none.astype(np.uint64), none.astype(np.int32)
    h, base, width = points.astype(np.uint64) + np.uint64(1), BASE, 1
    half = None
    while width < GRAM:
        h = h[:-width] * np.uint64(base) + h[width:]
        base, width = base * base % 2**64, 2 * width
        if width == SIDE:
            half = h
    h = _mixed(h)
    left = np.repeat(start + lengths, lengths) - np.arange(n)  # characters from here to the end of the text
    whole = left[: n - SPAN + 1] >= SPAN
    low, reach = h, 1
    while 2 * reach <= WINDOW:
        low, reach = np.minimum(low[:-reach], low[reach:]), 2 * reach
    rest = WINDOW - reach
    if rest:
        low = np.minimum(low[: len(low) - rest], low[rest:])
    low = np.where(whole, low[: len(whole)], np.uint64(0))
    # a window is kept if it is the least of some stretch it lies in, so if it equals the greatest of their minima
    high = np.concatenate([np.zeros(WINDOW - 1, np.uint64), low, np.zeros(WINDOW - 1, np.uint64)])
    reach = 1
    while 2 * reach <= WINDOW:
        high, reach = np.maximum(high[:-reach], high[reach:]), 2 * reach
    if rest:
        high = np.maximum(high[: len(high) - rest], high[rest:])
    m = min(len(h), len(high))
    at = np.flatnonzero((h[:m] == high[:m]) & (left[:m] >= GRAM) & (high[:m] > 0))
    if len(at) > 1:  # of a run of one repeated window every SIDE-th is enough to anchor it
        same = np.concatenate([[False], (h[at[1:]] == h[at[:-1]]) & (np.diff(at) == 1)])
        run = np.arange(len(at)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))
        last = np.concatenate([~same[1:], [True]])
        at = at[(run % SIDE == 0) | last]
    text = np.searchsorted(start, at, side="right") - 1
    while len(text) and (lengths[text] == 0).any():
        text = np.where(lengths[text] == 0, text - 1, text)
    pos = at - start[text]
    side = _mixed(half)
    before = np.where(pos >= SIDE, (side[np.maximum(at - SIDE, 0)] >> np.uint64(49)).astype(np.int64) + 1, 0)
    after_ok = left[at] >= GRAM + SIDE
    after = np.where(after_ok, (side[np.minimum(at + GRAM, len(side) - 1)] >> np.uint64(49)).astype(np.int64) + 1, 0)
    return text, pos, h[at], ((before << 16) | after).astype(np.int64)


def fingerprint_rows(records: DataFrame) -> DataFrame:
    """(hash, rid, pos, before, after) of records (rid, text)."""

    def rows(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"hash": [], "rid": [], "pos": [], "before": [], "after": []}
        lo = 0
        while lo < len(c["text"]):
            hi, size = lo, 0
            while hi < len(c["text"]) and (hi == lo or size + len(c["text"][hi]) <= BLOCK):
                size += len(c["text"][hi])
                hi += 1
            texts = c["text"][lo:hi]
            points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            text, pos, h, sides = fingerprints(points, np.array([len(x) for x in texts], dtype=np.int64))
            rid = np.array(c["rid"][lo:hi], dtype=np.int64)
            for name, v in zip(out, (h.view(np.int64), rid[text], pos.astype(np.int32), (sides >> 16).astype(np.int16), (sides & 0xFFFF).astype(np.int16))):
                out[name].append(v)
            lo = hi
        return {k: np.concatenate(v) if v else np.zeros(0) for k, v in out.items()}

    return map_rows(records.where(F.length("text") >= SPAN).select("rid", "text"), "hash bigint, rid bigint, pos int, before smallint, after smallint", rows)


def stretches(rows: DataFrame) -> DataFrame:
    """(stretch, rid, pos, at): for windows (rid, pos, text) every stretch of SPAN characters that holds the window, by hash, with its place ``at``."""

    def run(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("stretch", "rid", "pos", "at")}
        for rid, pos, text in zip(c["rid"], c["pos"], c["text"]):
            for at in range(max(0, pos - SPAN + GRAM), min(pos, len(text) - SPAN) + 1):
                for k, v in zip(out, (text[at : at + SPAN], rid, pos, at)):
                    out[k].append(v)
        return out

    return map_rows(rows.select("rid", "pos", "text"), "stretch string, rid bigint, pos int, at int", run).withColumn("stretch", F.sha1("stretch"))


class FingerprintIndex:
    """Sorted immutable runs of fingerprints, and the texts, in a folder that outlives the session.

    Opening a folder that holds an index goes on with it.  Without a folder the index
    is one call's: its runs go into a scratch folder and its list isn't kept.
    """

    COLUMNS = "hash BIGINT, rid BIGINT, pos INT, before SMALLINT, after SMALLINT"

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.folder = folder or scratch(spark, "runs")
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.runs: list[str] = []
        self.texts: list[str] = []
        self.frames: list[DataFrame] = []
        self.apart: DataFrame | None = None
        self.state, self.kept = 0, folder is not None
        if folder and exists(spark, self.folder):
            self._open()

    def _open(self) -> None:
        known = self.spark.read.schema("state long, kind string, at long, name string, buckets int").json(os.path.join(self.folder, "state-*"))
        last = known.agg(F.max("state")).first()[0]
        if last is None:
            return
        rows = sorted(known.where(F.col("state") == last).collect(), key=lambda r: r["at"])  # a row a run, FAN at most but for texts
        self.state = last
        for r in rows:
            self.buckets = r["buckets"]
            (self.runs if r["kind"] == "run" else self.texts).append(r["name"])
            if r["kind"] == "run":
                place = os.path.join(self.folder, r["name"])
                self.spark.sql(f"CREATE TABLE IF NOT EXISTS {r['name']} ({self.COLUMNS}) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {r['buckets']} BUCKETS LOCATION '{place}'")

    def _keep(self) -> None:
        """Writes the list of runs as a new state; a reader takes the greatest one."""
        if not self.kept:
            return
        self.state += 1
        rows = [(self.state, k, i, n, self.buckets) for k, names in (("run", self.runs), ("text", self.texts)) for i, n in enumerate(names)]
        self.spark.createDataFrame(rows, "state long, kind string, at long, name string, buckets int").coalesce(1).write.json(os.path.join(self.folder, f"state-{self.state}"))

    def _write(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        laid = rows.repartition(self.buckets, "hash")
        laid.write.format("parquet").bucketBy(self.buckets, "hash").sortBy("hash").option("path", os.path.join(self.folder, name)).saveAsTable(name)
        return name

    def held(self) -> DataFrame:
        """(rid, text) of all records so far."""
        if not self.kept:
            return reduce(DataFrame.unionByName, self.frames)
        return self.spark.read.schema("rid bigint, text string").parquet(*[os.path.join(self.folder, n) for n in self.texts])

    @staticmethod
    def _meet(old: DataFrame, new: DataFrame, itself: bool, on: tuple[str, ...] = ("hash",)) -> DataFrame:
        o = old.select(*on, *[F.col(c).alias(f"o_{c}") for c in old.columns if c in ("rid", "pos", "before", "after", "prev")])
        n = new.select(*on, *[F.col(c).alias(f"n_{c}") for c in new.columns if c in ("rid", "pos", "before", "after", "prev")])
        side = ((F.col("o_before") == F.col("n_before")) & (F.col("o_before") != 0)) | ((F.col("o_after") == F.col("n_after")) & (F.col("o_after") != 0))
        pair = o.hint("merge").join(n, list(on)).where(side & ((F.col("o_rid") < F.col("n_rid")) if itself else (F.col("o_rid") != F.col("n_rid"))))
        if "prev" in old.columns:
            pair = pair.where(F.coalesce(F.col("o_prev") != F.col("n_prev"), F.lit(True)))
        swap = F.col("o_rid") > F.col("n_rid")
        pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
        return pair.select(pick("o_rid", "n_rid").alias("ra"), pick("n_rid", "o_rid").alias("rb"), pick("o_pos", "n_pos").alias("pa"), pick("n_pos", "o_pos").alias("pb"))

    def _meet_blocks(self, old: DataFrame, new: DataFrame, itself: bool) -> DataFrame:
        """``_meet`` of rows with a column ``n``, how many rows hold their hash: each block of them with each.

        Two windows whose predecessors are alike too, and as near, lie in the stretch that those anchor: long
        repeating texts thus give an anchor a diagonal, not one for each of their windows.
        """
        order = W.partitionBy("rid").orderBy("pos")
        gap = F.col("pos") - F.lag("pos").over(order)
        chained = lambda run: run.withColumn("prev", F.when(gap <= GRAM, F.struct(F.lag("hash").over(order).alias("hash"), gap.alias("gap"))))
        blocks = F.ceil(F.col("n") / HOT).cast("int")
        own = F.pmod(F.xxhash64("rid", "pos"), blocks).cast("int")
        others = F.explode(F.sequence(F.lit(0), blocks - 1))
        on, parts = ("hash", "i", "j"), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        o, n = chained(old).withColumn("i", own).withColumn("j", others), chained(new).withColumn("j", own).withColumn("i", others)
        return self._meet(o.repartition(parts, *on), n.repartition(parts, *on), itself, on)

    def add(self, records: DataFrame, hot: str = "first") -> DataFrame:
        """Adds a batch of records (rid, text); its candidate anchors (ra, rb, pa, pb) with all records so far.

        Texts with a ``hot`` window meet the ``first`` text of each stretch, ``each`` other, or not at all:
        ``apart`` leaves the occurrences (rid, pos) of such windows in all runs in ``self.apart``.
        """
        batch = records.select("rid", "text")
        if self.kept:
            text = f"text_{uuid.uuid4().hex}"
            batch.write.parquet(os.path.join(self.folder, text))
            batch = self.spark.read.schema("rid bigint, text string").parquet(os.path.join(self.folder, text))
            self.texts.append(text)
        self.frames.append(batch)
        name = self._write(fingerprint_rows(batch))
        new, older = self.spark.table(name), [self.spark.table(r) for r in self.runs]
        every = new
        for run in older:
            every = every.unionByName(run)
        # The hashes lie by bucket, so counting them and setting the hot ones aside moves few rows.
        often = cut(every.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT))
        cool = lambda run: run.join(often, "hash", "left_anti")
        none = often.isEmpty()
        if none:
            cool = lambda run: run
        met = self._meet(cool(new), cool(new), True)
        for run in older:
            met = met.unionByName(self._meet(cool(run), cool(new), False))
        if not none and hot == "each":
            busy = lambda run: run.join(often, "hash")
            met = met.unionByName(self._meet_blocks(busy(new), busy(new), True))
            for run in older:
                met = met.unionByName(self._meet_blocks(busy(run), busy(new), False))
        elif not none:
            occurrences = every.join(often, "hash", "left_semi").select("rid", "pos").distinct()
            if hot == "first":
                met = met.unionByName(self._star(occurrences, batch.select("rid")))
            else:
                self.apart = occurrences  # a later batch's holds them too: a hot window stays hot
        self.runs.append(name)
        self._keep()
        return met

    def _star(self, occurrences: DataFrame, added: DataFrame) -> DataFrame:
        """Anchors of hot windows: every occurrence of a stretch with its first text; those among older texts alone are known already."""
        each = cut(stretches(occurrences.join(self.held(), "rid")))
        first = each.groupBy("stretch").agg(F.min(F.struct("rid", "at")).alias("f"))
        to = each.join(first, "stretch").select(F.col("f.rid").alias("x"), F.col("rid").alias("y"), F.col("f.at").alias("px"), F.col("at").alias("py")).where("x <> y")
        line = to.groupBy("x", "y", (F.col("px") - F.col("py")).alias("d")).agg(F.min("px").alias("pa"))
        fresh = added.distinct()
        new = line.join(fresh.withColumnRenamed("rid", "y"), "y", "left_semi").unionByName(line.join(fresh.withColumnRenamed("rid", "x"), "x", "left_semi")).distinct()
        return new.select(F.col("x").alias("ra"), F.col("y").alias("rb"), "pa", (F.col("pa") - F.col("d")).alias("pb"))

    def compact(self) -> None:
        """Merges the runs into one once there are more than FAN; the old ones are dropped."""
        if len(self.runs) > FAN:
            whole = self.spark.table(self.runs[0])
            for run in self.runs[1:]:
                whole = whole.unionByName(self.spark.table(run))
            old, self.runs = self.runs, [self._write(whole)]
            self._keep()
            for run in old:
                self.spark.sql(f"DROP TABLE {run}")
                remove(self.spark, os.path.join(self.folder, run))


def common_stretch(a: str, b: str, pa: int, pb: int) -> tuple[int, int]:
    """(start in a, length) of the common stretch round the anchor; 0 long if it isn't one."""
    if a[pa : pa + GRAM] != b[pb : pb + GRAM]:
        return pa, 0

    def run(x: str, y: str) -> int:
        n = min(len(x), len(y))
        if x[:n] == y[:n]:
            return n
        lo, hi = 0, n
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if x[:mid] == y[:mid] else (lo, mid)
        return lo

    right = run(a[pa + GRAM :], b[pb + GRAM :])
    left = run(a[:pa][::-1], b[:pb][::-1])
    return pa - left, left + GRAM + right


def verify(anchors: DataFrame, records: DataFrame) -> DataFrame:
    """(ra, rb, spans array<struct<a, b, n>>): the stretches of SPAN or more of each pair of records."""
    diagonal = anchors.groupBy("ra", "rb", (F.col("pa") - F.col("pb")).alias("d")).agg(F.array_sort(F.collect_set("pa")).alias("pas"))
    pairs = diagonal.groupBy("ra", "rb").agg(F.collect_list(F.struct("d", "pas")).alias("lines"))
    a, b = records.toDF("ra", "ta"), records.toDF("rb", "tb")
    schema = "ra bigint, rb bigint, spans array<struct<a:int,b:int,n:int>>"

    def rows(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"ra": [], "rb": [], "spans": []}
        for ra, rb, ta, tb, lines in zip(c["ra"], c["rb"], c["ta"], c["tb"], c["lines"]):
            spans = []
            for line in lines:
                done = -1
                for pa in line["pas"]:
                    if pa >= done:
                        at, n = common_stretch(ta, tb, pa, pa - line["d"])
                        done = at + n if n else done
                        if n >= SPAN:
                            spans.append({"a": at, "b": at - line["d"], "n": n})
            if spans:
                for k, v in zip(out, (ra, rb, sorted(spans, key=lambda s: (s["a"], s["b"])))):
                    out[k].append(v)
        return out

    return map_rows(pairs.join(a, "ra").join(b, "rb").select("ra", "rb", "ta", "tb", "lines"), schema, rows)


def classes(batches: list[DataFrame]) -> DataFrame:
    """(rid, batch, rec, text) of the distinct texts of batches (rec, text) with their first record."""
    every = batches[0].withColumn("batch", F.lit(0))
    for i, b in enumerate(batches[1:], 1):
        every = every.unionByName(b.withColumn("batch", F.lit(i)))
    return every.where(F.length("text") >= SPAN).select(F.xxhash64("text").alias("rid"), "batch", "rec", "text")


def shared(batches: list[DataFrame], index: FingerprintIndex | None = None, hot: str = "first") -> tuple[DataFrame, DataFrame]:
    """Links (ra, rb, spans) between distinct texts of batches (rec, text), and members (rid, rec).

    ``rid`` is a hash of a text; each batch is merged into the index in turn.  With an
    ``index`` that holds earlier batches, only links with a text of the given ones come out.
    ``hot`` says which texts a hot window links, as in ``FingerprintIndex.add``.
    """
    spark = batches[0].sparkSession
    held = cut(classes(batches))
    texts = cut(held.groupBy("rid").agg(F.min("batch").alias("batch"), F.first("text").alias("text")))
    index = index or FingerprintIndex(spark)
    if index.texts:
        texts = cut(texts.join(index.held().select("rid"), "rid", "left_anti"))
    met = None
    for i in range(len(batches)):
        new = index.add(texts.where(F.col("batch") == i).select("rid", "text"), hot)
        met = new if met is None else met.unionByName(new)
    met = cut(met)
    index.compact()
    touched = met.select(F.explode(F.array("ra", "rb")).alias("rid")).distinct()
    links = cut(verify(met, index.held().join(touched, "rid", "left_semi")))
    return links, held.select("rid", "rec").distinct()


def grouped(batches: list[DataFrame]) -> tuple[DataFrame, DataFrame | None, DataFrame | None, DataFrame]:
    """All that distinct texts of batches (rec, text) share, without a row for each two that a hot window ties.

    Links (ra, rb, spans) by the windows that aren't hot; groups (g, rid) of texts that hold one stretch round
    a hot window, each set of texts once; the places (rid, at) of these stretches; members (rid, rec).
    Groups and places are None where no window is hot.
    """
    index = FingerprintIndex(batches[0].sparkSession)
    links, members = shared(batches, index, "apart")
    if index.apart is None:
        return links, None, None, members
    each = cut(stretches(index.apart.join(index.held(), "rid")).select("stretch", "rid", "at").distinct())
    holders = each.select("stretch", "rid").distinct()
    texts = [F.bit_xor(F.xxhash64("rid", F.lit(i))).alias(f"s{i}") for i in range(2)]  # tells a set of texts
    sets = cut(holders.groupBy("stretch").agg(F.count(F.lit(1)).alias("n"), *texts).where("n > 1"))
    groups = sets.groupBy("n", "s0", "s1").agg(F.min("stretch").alias("stretch")).select("stretch")
    places = each.join(sets, "stretch", "left_semi").select("rid", "at").distinct()
    return links, cut(holders.join(groups, "stretch").select(F.col("stretch").alias("g"), "rid")), places, members


def _blocks(rows: DataFrame, key: str, x: str) -> DataFrame:
    """(key, x, n, k, b): the n rows of a key lie in k blocks of about HOT rows; each row's block is b."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.ceil(F.col("n") / HOT).cast("int"))
    return rows.join(sizes, key).select(key, x, "n", "k", F.pmod(F.xxhash64(x), F.col("k")).cast("int").alias("b"))


def _met(left: DataFrame, right: DataFrame, cell: list[str]) -> DataFrame:
    """Rows of the same cell, each with each; cells are dealt over all tasks, few rows though they are."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(parts, *cell).join(right.repartition(parts, *cell), cell)


def among(groups: DataFrame, key: str, x: str) -> DataFrame:
    """(x, y): every two members of each group (key, x), block by block; a pair of two groups comes twice."""
    held = _blocks(groups.select(key, x), key, x).where("n > 1")
    left = held.select(key, F.col(x).alias("x"), F.col("b").alias("i"), F.explode(F.expr("sequence(b, k - 1)")).alias("j"))
    right = held.select(key, F.col(x).alias("y"), F.col("b").alias("j"), F.explode(F.expr("sequence(0, b)")).alias("i"))
    return _met(left, right, [key, "i", "j"]).where("i < j or x < y").select("x", "y")


def every_pair(links: DataFrame, groups: DataFrame | None, members: DataFrame) -> DataFrame:
    """(rec_a, rec_b), the smaller first: all pairs of records that share a stretch, by links, groups and copies."""
    held = _blocks(members, "rid", "rec")
    a, b = held.select("rid", "rec", "b").toDF("ra", "x", "i"), held.select("rid", "rec", "b").toDF("rb", "y", "j")
    blocks = held.select("rid", "k").distinct()
    pairs = cut(links.select("ra", "rb").join(blocks.toDF("ra", "ka"), "ra").join(blocks.toDF("rb", "kb"), "rb"))
    across = pairs.where("ka = 1 and kb = 1").select("ra", "rb").join(a, "ra").join(b, "rb").select("x", "y")
    cells = pairs.where("ka > 1 or kb > 1").select("ra", "rb", F.explode(F.expr("sequence(0, ka - 1)")).alias("i"), "kb")
    cells = cells.select("ra", "rb", "i", F.explode(F.expr("sequence(0, kb - 1)")).alias("j"))
    cell = ["ra", "rb", "i", "j"]
    wide = _met(cells.join(a, ["ra", "i"]).select(*cell, "x"), cells.join(b, ["rb", "j"]).select(*cell, "y"), cell).select("x", "y")
    every = across.unionByName(wide).unionByName(among(members, "rid", "rec"))
    if groups is not None:
        every = every.unionByName(among(groups.join(members, "rid").select("g", "rec").distinct(), "g", "rec"))
    return every.where("x <> y").select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b")).distinct()


def record_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(rec_a, rec_b), the smaller first: linked texts and copies as pairs of records."""
    sizes = members.groupBy("rid").agg(F.count(F.lit(1)).alias("n"), F.min("rec").alias("first"))
    several = sizes.where("n > 1")
    nth = F.row_number().over(W.partitionBy("rid").orderBy("rec"))
    copied = members.join(several, "rid")
    listed = copied.withColumn("_nth", nth).where(F.col("_nth") <= COPIES).select("rid", "rec")
    single = members.join(several, "rid", "left_anti")
    known = listed.unionByName(single.select("rid", "rec"))
    further = copied.where(F.col("n") > COPIES).join(known, ["rid", "rec"], "left_anti").select("rid", "rec", "first")
    pairs = links.select("ra", "rb")
    across = pairs.join(known.toDF("ra", "x"), "ra").join(known.toDF("rb", "y"), "rb").select("x", "y")
    among = listed.toDF("rid", "x").join(listed.toDF("rid", "y"), "rid").where("x < y").select("x", "y")
    own = further.select(F.col("first").alias("x"), F.col("rec").alias("y"))
    both = pairs.unionByName(pairs.select(F.col("rb").alias("ra"), F.col("ra").alias("rb")))
    firsts = sizes.select(F.col("rid").alias("rb"), F.col("first").alias("x"))
    beyond = further.select(F.col("rid").alias("ra"), F.col("rec").alias("y")).join(both, "ra").join(firsts, "rb").select("x", "y")
    every = across.unionByName(among).unionByName(own).unionByName(beyond)
    return every.where("x <> y").select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b")).distinct()


def memberships(members: DataFrame) -> DataFrame:
    """(rec, class): each record and the first record of its text."""
    first = members.groupBy("rid").agg(F.min("rec").alias("class"))
    return members.join(first, "rid").select("rec", "class")


def class_spans(links: DataFrame, members: DataFrame) -> DataFrame:
    """(class_a, class_b, start_a, start_b, length): the common stretches of linked texts, which are named by their first records."""
    first = members.groupBy("rid").agg(F.min("rec").alias("rec"))
    named = links.join(first.toDF("ra", "x"), "ra").join(first.toDF("rb", "y"), "rb").select("x", "y", F.inline("spans"))
    turned = F.col("x") > F.col("y")
    pick = lambda a, b, name: F.when(turned, F.col(b)).otherwise(F.col(a)).alias(name)
    return named.select(pick("x", "y", "class_a"), pick("y", "x", "class_b"), pick("a", "b", "start_a"), pick("b", "a", "start_b"), F.col("n").alias("length"))


def coverage(links: DataFrame, members: DataFrame, records: DataFrame, groups: DataFrame | None = None, places: DataFrame | None = None) -> DataFrame:
    """(rec, others, covered, share): for every record how many others share a stretch with it (copies too), and how much of it they cover.

    With the ``groups`` and ``places`` of ``grouped`` all others count; with links by the first text of
    a hot stretch, others that share nothing else are counted by the class, as their links are.
    """
    ends = links.select(F.col("ra").alias("rid"), F.explode("spans").alias("s")).select("rid", F.col("s.a").alias("lo"), (F.col("s.a") + F.col("s.n")).alias("hi"))
    ends = ends.unionByName(links.select(F.col("rb").alias("rid"), F.explode("spans").alias("s")).select("rid", F.col("s.b").alias("lo"), (F.col("s.b") + F.col("s.n")).alias("hi")))
    if places is not None:
        ends = ends.unionByName(places.select("rid", F.col("at").alias("lo"), (F.col("at") + SPAN).alias("hi")))
    spans = ends.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("reach")),
        lambda a, s: F.struct((a["sum"] + F.greatest(F.lit(0), s["hi"] - F.greatest(s["lo"], a["reach"]))).alias("sum"), F.greatest(a["reach"], s["hi"]).alias("reach")),
        lambda a: a["sum"],
    )
    copies = members.groupBy("rid").agg(F.count(F.lit(1)).alias("copies"))
    pairs = links.select("ra", "rb")
    if groups is not None:
        pairs = pairs.unionByName(among(groups, "g", "rid").toDF("ra", "rb"))
        pairs = pairs.select(F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb")).distinct()
    both = pairs.unionByName(pairs.select(F.col("rb").alias("ra"), F.col("ra").alias("rb")))
    linked = both.join(copies.toDF("rb", "_n"), "rb").groupBy(F.col("ra").alias("rid")).agg(F.sum("_n").alias("linked"))
    per = copies.join(spans.select("rid", covered.alias("covered")), "rid", "left").join(linked, "rid", "left")
    found = members.join(per, "rid").select("rec", "copies", "covered", "linked")
    sizes = records.groupBy("rec").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n"))
    joined = sizes.join(found, "rec", "left")
    full = F.when(F.col("copies") > 1, F.col("n")).otherwise(F.coalesce("covered", F.lit(0)))
    others = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("linked", F.lit(0))
    return joined.select("rec", others.alias("others"), full.alias("covered"), F.when(F.col("n") > 0, full / F.col("n")).otherwise(0.0).alias("share"))
