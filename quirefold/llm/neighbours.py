"""The most similar vectors of every vector, by a forest of random-projection trees.

Vectors are compared by direction.  A forest is fitted on the driver from a
sample of at most ``SAMPLE`` vectors (those with the smallest key hash; a bound,
not a share, so the broadcast forest does not grow): each node splits its sample
at the median of the projection on the difference of two of its points, so that
crowded regions get as many leaves as their weight.  Every vector of the table
is then put into its leaf of every tree.  A search goes down all trees at once
with one priority queue for all of them, ordered by the margin to the nearest
split not taken, until it has visited ``probes`` leaves.  Leaves are searched
with one-byte codes in blocks of matrix products; the candidates are reranked by
exact cosines.

The sample bounds the number of leaves, so leaves grow with the table.  A leaf of
more than ``SPLIT`` vectors is split again where it is searched: ``SUB_TREES`` trees
are fitted from its own vectors and searched in the same way, so that a search reads
a bounded number of vectors of each leaf, whatever the size of the table.

Exact copies are collapsed before the search: a group of copies is one vector of
the index, however many rows it holds.  Every copy has its list.  At most ``k + 1``
members of a group can stand in any list of k (equal similarities are ordered by
key), so only those are expanded as neighbours.

Defined cases: null, short or long vectors, vectors with null, NaN or infinite
values and all-zero ones are left out; of a key's states the latest holds; a
table of fewer than two sound vectors gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.session import cut
from quirefold.tables import latest

DIMS = 64
SAMPLE, TREES, PROBES, LEAF = 16_384, 6, 12, 256
ASKED_PROBES = 300
KEPT = 16
SPLIT, SUB_TREES, SUB_PROBES = 4096, 3, 12


def fit_forest(sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(normals [trees, nodes, dims], offsets [trees, nodes]) of complete trees in heap order."""
    rng = np.random.default_rng(seed)
    deepest = max(0, int(math.log2(max(1, len(sample) / 16))))
    depth = min(deepest, max(0, math.ceil(math.log2(max(1, rows / leaf)))))
    nodes = 2**depth - 1
    normals = np.zeros((trees, max(1, nodes), sample.shape[1]), dtype=np.float32)
    offsets = np.zeros((trees, max(1, nodes)), dtype=np.float32)
    for t in range(trees):
        held = {0: np.arange(len(sample))}
        for node in range(nodes):
            own = held.pop(node)
            a, b = rng.choice(own, 2, replace=False) if len(own) > 1 else (0, 0)
            normal = sample[a] - sample[b]
            if not normal.any():
                normal = rng.normal(size=sample.shape[1])
            normal = (normal / np.linalg.norm(normal)).astype(np.float32)
            along = sample[own] @ normal
            offset = np.median(along) if len(own) else 0.0
            normals[t, node], offsets[t, node] = normal, offset
            order = np.argsort(along, kind="stable")
            held[2 * node + 1], held[2 * node + 2] = own[order[: len(own) // 2]], own[order[len(own) // 2 :]]
    return normals, offsets if nodes else offsets[:, :0]


def search_forest(x: np.ndarray, normals: np.ndarray, offsets: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(own leaf in each tree, the ``probes`` leaves visited) of each row of ``x``, as cell numbers.

    All rows advance together: each holds its queue as a row of a matrix; a step
    pops every row's best entry, goes down to a leaf and pushes the siblings.  Of a
    queue only as many entries as there are steps left can ever be popped; every
    ``KEPT`` steps the others are dropped, so a step costs no more at its end.
    """
    trees, nodes = offsets.shape
    leaves, n = nodes + 1, len(x)
    depth = int(math.log2(leaves))
    probes = min(probes, trees * leaves)
    flat_n, flat_o = normals.reshape(-1, x.shape[1]), offsets.reshape(-1)
    rows = np.arange(n)
    width = max(trees, probes) + KEPT * max(1, depth)
    priority = np.full((n, width), -np.inf, dtype=np.float32)
    entry = np.zeros((n, width), dtype=np.int32)  # tree * (2 * leaves) + node
    priority[:, :trees] = np.inf
    entry[:, :trees] = np.arange(trees) * (2 * leaves)
    used = trees
    visited = np.zeros((n, probes), dtype=np.int32)
    for p in range(probes):
        if used + depth > width:
            left = np.argpartition(-priority[:, :used], probes - p - 1, axis=1)[:, : probes - p]
            kept = np.take_along_axis(priority, left, 1), np.take_along_axis(entry, left, 1)
            priority[:], used = -np.inf, left.shape[1]
            priority[:, :used], entry[:, :used] = kept
        best = priority[:, : max(used, 1)].argmax(axis=1)
        bound = priority[rows, best].copy()
        tree, node = np.divmod(entry[rows, best], 2 * leaves)
        priority[rows, best] = -np.inf
        for _ in range(depth):
            inner = node < nodes
            at = tree * max(1, nodes) + np.minimum(node, max(0, nodes - 1))
            margin = np.einsum("ij,ij->i", x, flat_n[at]) - flat_o[at]
            right = margin >= 0
            down = 2 * node + 1 + right
            other = 2 * node + 2 - right
            priority[:, used] = np.where(inner, np.minimum(bound, -np.abs(margin)), -np.inf)
            entry[:, used] = tree * (2 * leaves) + other
            used += 1
            node = np.where(inner, down, node)
        visited[:, p] = np.where(bound > -np.inf, tree * leaves + node - nodes, -1)
    return visited[:, :trees] if probes >= trees else visited, visited


def codes(unit: np.ndarray) -> list[bytes]:
    """Each vector's components in steps of 1/127 of its own largest one, a byte each, then the step."""
    step = (np.abs(unit).max(axis=1, keepdims=True) / 127).astype(np.float32)
    code = np.clip(np.rint(unit / step), -127, 127).astype(np.int8)
    return [c.tobytes() + s.tobytes() for c, s in zip(code, step)]


def decoded(code: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors as coded, 1 + a bound of the length of what coding changed in each).

    With errors of lengths d and e at most, the product of two coded unit vectors
    lies below the exact one by no more than d + e + d * e = (1 + d) * (1 + e) - 1.
    """
    raw = np.frombuffer(b"".join(code), dtype=np.uint8).reshape(len(code), -1)
    step = raw[:, -4:].copy().view(np.float32)
    return raw[:, :-4].view(np.int8) * step, 1 + step[:, 0] * np.float32(0.5001 * math.sqrt(raw.shape[1] - 4))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float32).reshape(len(column), -1)


def sound(df: DataFrame, key: str, vector: str, order: str | None, dims: int = DIMS) -> DataFrame:
    """(key, unit, print) of usable vectors; ``print`` is equal for copies in direction."""
    one = latest(df.select(key, order, vector), key, order) if order else df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(vector).alias(vector))
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1)).astype(np.float64)
            x = x.reshape(b.num_rows, dims)
            good = np.isfinite(x).all(axis=1) & x.any(axis=1)
            x = x[good]
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            unit = pa.array(x.astype(np.float32).ravel())
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, dims, dtype=np.int32), unit)
            prints = [r.tobytes() for r in np.rint(x * 1e5).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), lists, pa.array(prints, type=pa.binary())], names=[key, "unit", "print"])

    whole = one.where((F.size(vector) == dims) & ~F.exists(vector, lambda v: v.isNull())).select(key, F.col(vector).cast("array<float>").alias(vector))
    return whole.mapInArrow(run, f"`{key}` {kind}, unit array<float>, print binary").withColumn("print", F.sha1("print"))


def sampled(units: DataFrame, key: str, rows: int) -> np.ndarray:
    """At most SAMPLE of the vectors, by the hash of their keys.

    The hash first leaves about twice as many rows of the whole table, so the
    task that orders them reads a bounded number, however many partitions there are.
    """
    share = F.pmod(F.xxhash64(key), F.lit(1 << 20)) <= F.lit(math.ceil((1 << 20) * min(1.0, 2 * SAMPLE / rows)))
    column = units.where(share).orderBy(F.xxhash64(key), key).limit(SAMPLE).select("unit").toArrow().combine_chunks().column(0)
    return _matrix(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)


def leaf_blocks(ids: np.ndarray, index: np.ndarray, x: np.ndarray, size: int = 16_384) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of ``x``, rows of ``index``) that are to be compared, of one leaf.

    A leaf of at most SPLIT vectors is compared whole.  A larger one is searched by
    trees of its own, fitted from a sample of it in the order of ``ids``.
    """
    if len(ids) <= SPLIT:
        for c in range(0, len(ids), size):
            yield np.arange(len(x)), np.arange(c, min(len(ids), c + size))
        return
    dims = min(DIMS, index.shape[1])
    order, forest, members, starts = _inner_index(ids, index, dims)
    cells = starts.shape[0] - 1
    seen = search_forest(np.ascontiguousarray(x[:, :dims]), *forest, SUB_PROBES)[1]
    who, cell = np.repeat(np.arange(len(x)), seen.shape[1]), seen.ravel()
    who, cell = who[cell >= 0], cell[cell >= 0]
    by = np.argsort(cell, kind="stable")
    who, cell = who[by], cell[by]
    cuts = np.searchsorted(cell, np.arange(cells + 1))
    for j in np.flatnonzero(np.diff(cuts)):
        inside = members[starts[j] : starts[j + 1]]
        for c in range(0, len(inside), size):
            yield who[cuts[j] : cuts[j + 1]], inside[c : c + size]


_INNER: dict[tuple[int, int, int], tuple] = {}


def _inner_index(ids: np.ndarray, index: np.ndarray, dims: int) -> tuple:
    """(ids, forest, members by inner leaf, their starts); that of the leaf searched last is kept."""
    key = (id(ids), len(ids), int(ids[0]))
    if key not in _INNER:
        _INNER.clear()
        x = np.ascontiguousarray(index[:, :dims], dtype=np.float32)
        order = np.argsort(ids, kind="stable")
        sample = x[order[:: max(1, len(ids) // SAMPLE)]][:SAMPLE]
        forest = fit_forest(sample, len(ids), SUB_TREES)
        own = np.concatenate([search_forest(x[i : i + 4096], *forest, SUB_TREES)[0] for i in range(0, len(x), 4096)])
        cell = own.ravel()
        by = np.argsort(cell, kind="stable")
        members = np.repeat(np.arange(len(ids)), own.shape[1])[by]
        starts = np.searchsorted(cell[by], np.arange(SUB_TREES * (forest[1].shape[1] + 1) + 1))
        _INNER[key] = (ids, forest, members, starts)
    return _INNER[key]


def leaves(batches: Iterator[pa.RecordBatch], width: int, themselves_too: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids and vectors of a leaf, ids and vectors that search it), in blocks.

    Rows (cell, home, rid, code) come by cell, a leaf's own vectors first.  With
    ``themselves_too`` these search their leaf as well, once all of it is read.
    """
    now, own, held, whole = None, [], [], None

    def gathered() -> tuple[np.ndarray, np.ndarray]:
        return (np.concatenate(own), np.concatenate(held)) if own else (np.zeros(0, np.int64), np.zeros((0, width), np.float32))

    def themselves(leaf):
        for i in range(0, len(leaf[0]) if themselves_too else 0, 1024):
            yield (*leaf, leaf[0][i : i + 1024], leaf[1][i : i + 1024])

    for b in batches:
        cell, home, rid = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
        x = np.column_stack(decoded(b.column(3).to_pylist()))[:, :width]
        cuts = np.flatnonzero(np.diff(cell)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(cell)]):
            if cell[lo] != now:
                if now is not None and whole is None:
                    yield from themselves(gathered())
                now, own, held, whole = cell[lo], [], [], None
            mid = lo + int(home[lo:hi].sum())
            if mid > lo:
                own.append(rid[lo:mid])
                held.append(x[lo:mid])
            if mid < hi:
                if whole is None:
                    whole = gathered()
                    yield from themselves(whole)
                for i in range(mid, hi, 1024):
                    yield (*whole, rid[i : min(hi, i + 1024)], x[i : min(hi, i + 1024)])
    if now is not None and whole is None:
        yield from themselves(gathered())


def similar_pairs(units: DataFrame, key: str, floor: float, k: int, probes: int = PROBES, trees: int = TREES) -> DataFrame:
    """(a, b, cosine) for a != b: from the index, the pairs of distinct vectors with a cosine of at least ``floor``.

    At most ``k`` b's of the greatest cosine for each a and visited leaf are kept as
    candidates; each pair found stands in both directions.
    """
    spark = units.sparkSession
    kind = dict(units.dtypes)[key]
    rows = units.count()
    empty = f"a {kind}, b {kind}, cosine double"
    if rows < 2:
        return spark.createDataFrame([], empty)
    sample = sampled(units, key, rows)
    forest = spark.sparkContext.broadcast(fit_forest(sample, rows, trees))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals, offsets = forest.value
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                x = _matrix(part.column(1))
                own, seen = search_forest(x, normals, offsets, probes)
                # The queue starts with every root at equal priority, so the first leaves visited are the vector's own.
                n, extra = len(x), seen[:, own.shape[1] :]
                code = codes(x)
                cell = np.concatenate([own.ravel(), extra.ravel()])
                home = np.concatenate([np.ones(own.size, bool), np.zeros(extra.size, bool)])
                who = np.concatenate([np.repeat(np.arange(n), own.shape[1]), np.repeat(np.arange(n), extra.shape[1])])
                keep = cell >= 0
                who, take = who[keep], pa.array(who[keep])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell[keep]), pa.array(home[keep]), part.column(0).take(take), pa.array(code, type=pa.binary()).take(take)], names=["cell", "home", "rid", "code"]
                )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last column of a vector is its slack: products then hold what coding may have taken from them, and no pair is lost by it.
        least = 1 + floor - 1e-5
        for ids, index, rid, x in leaves(batches, DIMS + 1):
            for rows_, inside in leaf_blocks(ids, index, x):
                xs, held = x[rows_], index[inside]
                s = xs @ held.T
                q, n = np.nonzero(s >= least)
                if len(q) and np.bincount(q).max() > 2 * k:
                    near = s[q, n] - xs[q, -1] * held[n, -1]
                    order = np.lexsort((ids[inside][n], -near, q))
                    q, n = q[order], n[order]
                    first = np.r_[0, np.flatnonzero(np.diff(q)) + 1]
                    nth = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
                    q, n = q[nth < 2 * k + 1], n[nth < 2 * k + 1]
                a, o = rid[rows_][q], ids[inside][n]
                other = a != o
                if other.any():
                    pair = np.unique(np.stack([np.minimum(a, o)[other], np.maximum(a, o)[other]]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["ra", "rb"])

    lean = units.select(F.xxhash64(key).alias("rid"), "unit")
    cells = lean.mapInArrow(place, "cell int, home boolean, rid bigint, code binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    near = cells.repartition(parts, "cell").sortWithinPartitions("cell", F.desc("home"), "rid").mapInArrow(search, "ra bigint, rb bigint").distinct()
    full = units.select(F.xxhash64(key).alias("r"), F.col(key).alias("i"), F.col("unit").alias("u"))
    both = near.join(full.toDF("ra", "a", "ua"), "ra").join(full.toDF("rb", "b", "ub"), "rb")
    cosine = F.aggregate(F.zip_with("ua", "ub", lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    exact = both.select("a", "b", cosine.alias("cosine")).where((F.col("cosine") >= floor) & (F.col("a") != F.col("b")))
    return exact.unionByName(exact.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))


def collapsed(units: DataFrame, key: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Exact copies as one: (key, unit, print) of the first key of every group, and (print, rep, n, members) of those of several, with their first k + 1 keys.

    Only prints and keys are grouped; the vectors stay where they are.
    """
    lean = units.select("print", key)
    several = lean.groupBy("print").agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    held = cut(lean.join(several, "print"))
    nth = F.row_number().over(W.partitionBy("print").orderBy(key))
    listed = held.withColumn("_nth", nth).where(F.col("_nth") <= k + 1)
    further = held.where(F.col(key) != F.col("rep")).select(key)
    return units.join(further, key, "left_anti"), cut(listed.groupBy("print", "rep", "n").agg(F.array_sort(F.collect_list(key)).alias("members")))


def expanded(links: DataFrame, units: DataFrame, groups: DataFrame, key: str, k: int) -> DataFrame:
    """(key, other, cosine, place): lists of ``units``' keys from links (a, b, cosine) between groups' first keys.

    A key whose group has more than k members has k copies at the cosine 1, ordered by
    key, and needs nothing else; other keys have the members of their own group and
    those of the groups linked to it.
    """
    own = units.select("print", F.col(key).alias("a")).join(groups, "print")
    copies = own.select("a", F.explode("members").alias("b"), F.lit(1.0).alias("cosine")).where("a <> b")
    whose = groups.select(F.col("rep").alias("a"), "n", F.col("members").alias("_a"))
    other = groups.select(F.col("rep").alias("b"), F.col("members").alias("_b"))
    met = links.join(whose, "a", "left").where(F.coalesce(F.col("n"), F.lit(1)) <= k).join(other, "b", "left")
    met = met.select(F.explode(F.coalesce("_a", F.array("a"))).alias("a"), "b", "_b", "cosine")
    across = met.select("a", F.explode(F.coalesce("_b", F.array("b"))).alias("b"), "cosine")
    place = F.row_number().over(W.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    every = copies.unionByName(across).withColumn("place", place)
    return every.where(F.col("place") <= k).select(F.col("a").alias(key), F.col("b").alias("other"), "cosine", "place")


def nearest(units: DataFrame, asked: DataFrame, key: str, k: int, probes: int = ASKED_PROBES, trees: int = TREES) -> DataFrame:
    """(key, other, cosine, place): for a stated set of queries (rows of ``units``) their k most similar others.

    All rows are indexed, copies as one; only the queries search, with many more
    probes than a join of all rows, since no floor narrows what they look for.  Of
    each leaf a query keeps its k + 2 best by code, of all leaves its 5 k best, which
    are then ranked by exact cosine.
    """
    reps, groups = collapsed(units, key, k)
    wanted = reps.join(asked.select("print").distinct(), "print", "left_semi")
    lists = expanded(_nearest_reps(reps, wanted, key, k, probes, trees), asked, groups, key, k)
    return lists.join(asked.select(key), key, "left_semi")


def _nearest_reps(units: DataFrame, asked: DataFrame, key: str, k: int, probes: int, trees: int) -> DataFrame:
    """(a, b, cosine): the k most similar others of each of ``asked`` among ``units``, no two of which are copies."""
    spark = units.sparkSession
    kind = dict(units.dtypes)[key]
    rows = units.count()
    if rows < 2:
        return spark.createDataFrame([], f"a {kind}, b {kind}, cosine double")
    sample = sampled(units, key, rows)
    forest = spark.sparkContext.broadcast(fit_forest(sample, rows, trees))

    def place(home: bool, visits: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            normals, offsets = forest.value
            for b in batches:
                for at in range(0, b.num_rows, 512):
                    part = b.slice(at, 512)
                    x = _matrix(part.column(1))
                    cell = search_forest(x, normals, offsets, visits)[1]
                    who = np.repeat(np.arange(len(x)), cell.shape[1])
                    keep = cell.ravel() >= 0
                    take = pa.array(who[keep])
                    code = pa.array(codes(x), type=pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(cell.ravel()[keep]), pa.array(np.full(keep.sum(), home)), part.column(0).take(take), code.take(take)], names=["cell", "home", "rid", "code"])

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, index, rid, x in leaves(batches, DIMS, False):
            for rows_, inside in leaf_blocks(ids, index, x):
                q, names = rid[rows_], ids[inside]
                score = x[rows_] @ index[inside].T
                score[q[:, None] == names[None, :]] = -np.inf
                n = min(k + 2, score.shape[1])
                best = np.argpartition(-score, n - 1, axis=1)[:, :n]
                value = np.take_along_axis(score, best, 1).ravel()
                sound_ = np.isfinite(value)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, n)[sound_]), pa.array(names[best].ravel()[sound_]), pa.array(value[sound_].astype(np.float32))], names=["ra", "rb", "near"])

    lean = lambda df: df.select(F.xxhash64(key).alias("rid"), "unit")
    schema = "cell int, home boolean, rid bigint, code binary"
    cells = lean(units).mapInArrow(place(True, trees), schema).unionByName(lean(asked).mapInArrow(place(False, probes), schema))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    found = cells.repartition(parts, "cell").sortWithinPartitions("cell", F.desc("home"), "rid").mapInArrow(search, "ra bigint, rb bigint, near float")
    met = found.groupBy("ra", "rb").agg(F.max("near").alias("near"))
    first = met.withColumn("_n", F.row_number().over(W.partitionBy("ra").orderBy(F.desc("near"), "rb"))).where(F.col("_n") <= 5 * k).select("ra", "rb")
    full = units.select(F.xxhash64(key).alias("r"), F.col(key).alias("i"), F.col("unit").alias("u"))
    both = first.join(full.toDF("ra", "a", "ua"), "ra").join(full.toDF("rb", "b", "ub"), "rb")
    cosine = F.aggregate(F.zip_with("ua", "ub", lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    ranked = both.select("a", "b", cosine.alias("cosine")).where("a <> b")
    return ranked.withColumn("_n", F.row_number().over(W.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("_n") <= k).drop("_n")


def neighbours(df: DataFrame, key: str, vector: str, order: str | None, k: int, floor: float, probes: int = PROBES, trees: int = TREES) -> DataFrame:
    """(key, other, cosine, place): for every key its k most similar others with a cosine of at least ``floor``.

    Equal cosines are ordered by key, and every key has its list, copies too.
    """
    units = cut(sound(df, key, vector, order))
    reps, groups = collapsed(units, key, k)
    return expanded(similar_pairs(reps, key, floor, k, probes, trees), units, groups, key, k)


def mutual(lists: DataFrame, key: str) -> DataFrame:
    """(id_a, id_b): pairs each of which stands in the other's list, the smaller key first."""
    pair = lists.select(F.least(key, "other").alias("id_a"), F.greatest(key, "other").alias("id_b"), F.col(key).alias("_k"))
    return pair.groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")
