"""Splitting oversized items at natural boundaries, range by range.

A text is cut into ranges of a fixed number of characters (of bytes in a file).
A worker sees one range and the halo before it, never the whole, and writes the
range's *boundary table*: its length, the lengths of the runs without a boundary
at its start, at its end and at most, and for each cell of a tenth of the limit
the first and last natural boundary of each rank (line break, sentence mark,
other mark or space).  The tables of an item are stitched in order: a prefix sum
of the lengths turns offsets within ranges into offsets within the item, runs
that cross ranges are joined, and the pieces are planned from the cells alone.
A piece ends at the last line break in the second half of its window, else the
last sentence mark there, else the last boundary of any rank, else (a forced
cut) at the limit; the next begins ``overlap`` characters before that end.  The
texts of the pieces are then cut out by offset.

Giant files (``split_files``) are never gathered: a worker that reads a byte range
says how many characters it has and where, near its end, its last natural boundary
stands.  A prefix sum over these two numbers a range tells every worker the offset of
its first piece and of its last; it reads its range again with a halo of the
characters the range before leaves to it, and emits the pieces by itself.

Defined cases: whitespace at both ends does not count and is in no piece; null,
blank and short texts give no pieces; an item without any boundary is cut at
the limit; repeated rows give the result of one; an empty table an empty one.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.llm.common import code_points, map_rows

MARKS = ".!?;:,。！？；：，、｡．…"
SENTENCE = ".!?。！？｡．…"
RANGE_CHARS = 2048
CELLS = 10

_RANK = np.zeros(0x110000, dtype=np.uint8)
for _c in range(0x3001):
    if chr(_c).isspace():
        _RANK[_c] = 1
for _m in MARKS:
    _RANK[ord(_m)] = 2 if _m in SENTENCE else 1
for _c in (0x0A, 0x0D, 0x85, 0x2028, 0x2029):
    _RANK[_c] = 3
RANKS = 3

TABLE = "n int, lead int, trail int, longest int, first array<int>, last array<int>"


def range_table(points: np.ndarray, cell: int) -> tuple[int, int, int, int, list[int], list[int]]:
    """The boundary table of one range; offsets are those just after a boundary, -1 for none.

    ``first`` and ``last`` hold RANKS numbers a cell.
    """
    n = len(points)
    rank = _RANK[points]
    at = np.flatnonzero(rank)
    cells = -(-n // cell)
    first = np.full(cells * RANKS, -1, dtype=np.int32)
    last = np.full(cells * RANKS, -1, dtype=np.int32)
    if not len(at):
        return n, n, n, n, first.tolist(), last.tolist()
    gaps = np.diff(at) - 1
    lead, trail = int(at[0]), int(n - 1 - at[-1])
    longest = max(lead, trail, int(gaps.max()) if len(gaps) else 0)
    slot = (at // cell) * RANKS + (rank[at] - 1)
    last[slot] = at + 1
    first[slot[::-1]] = at[::-1] + 1
    return n, lead, trail, longest, first.tolist(), last.tolist()


def stitch(tables: list[dict], limit: int, overlap: int) -> tuple[int, list[int], list[int], list[bool]]:
    """(longest run, starts, ends, forced?) of an item's pieces from its range tables in order."""
    base, open_run, longest = 0, 0, 0
    points: list[list[int]] = [[] for _ in range(RANKS)]
    for t in tables:
        if t["lead"] == t["n"]:
            open_run += t["n"]
            longest = max(longest, open_run)
        else:
            longest = max(longest, open_run + t["lead"], t["longest"])
            open_run = t["trail"]
        for r in range(RANKS):
            for f, x in zip(t["first"][r::RANKS], t["last"][r::RANKS]):
                if f >= 0:
                    points[r].append(base + f)
                    if x != f:
                        points[r].append(base + x)
        base += t["n"]
    longest = max(longest, open_run)

    def before(r: int, low: int, high: int) -> int:
        i = bisect.bisect_right(points[r], high) - 1
        return points[r][i] if i >= 0 and points[r][i] > low else -1

    starts, ends, forced, at = [], [], [], 0
    while True:
        starts.append(at)
        if base - at <= limit:
            ends.append(base)
            forced.append(False)
            return longest, starts, ends, forced
        half, least = max(at + limit // 2, at + overlap), at + overlap
        end = before(2, half, at + limit)
        if end < 0:
            end = before(1, half, at + limit)
        if end < 0:
            end = max(before(r, least, at + limit) for r in range(RANKS))
        forced.append(end < 0)
        ends.append(end if end >= 0 else at + limit)
        at = ends[-1] - overlap


def boundary_tables(df: DataFrame, keys: list[str], text: str, limit: str, range_chars: int = RANGE_CHARS) -> DataFrame:
    """A row for each range of each text longer than the number in column ``limit``."""
    types = dict(df.dtypes)
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)
    schema = f"{head}, `{limit}` int, range int, skip int, {TABLE}"

    def rows(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in (*keys, limit, "range", "skip", "n", "lead", "trail", "longest", "first", "last")}
        for i, x in enumerate(c[text]):
            body = x.strip()
            most = c[limit][i]
            if len(body) <= most:
                continue
            skip = len(x) - len(x.lstrip())
            for no, a in enumerate(range(0, len(body), range_chars)):
                table = range_table(code_points(body[a : a + range_chars]), max(1, most // CELLS))
                for n, v in zip(out, (*[c[k][i] for k in keys], most, no, skip, *table)):
                    out[n].append(v)
        return out

    long = df.where(F.length(text) > F.col(limit)).select(*keys, text, F.col(limit).cast("int").alias(limit))
    return map_rows(long, schema, rows)


def stitched(tables: DataFrame, keys: list[str], limit: str, overlap: int) -> DataFrame:
    """(keys, limit, skip, longest, starts, ends, forced): the plan of an item's pieces."""
    types = dict(tables.dtypes)
    cols = ["range", "n", "lead", "trail", "longest", "first", "last"]
    grouped = tables.groupBy(*keys, limit).agg(F.max("skip").alias("skip"), F.array_sort(F.collect_set(F.struct(*cols))).alias("t"))
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)
    schema = f"{head}, `{limit}` int, skip int, longest int, starts array<int>, ends array<int>, forced array<boolean>"

    def rows(c: dict[str, list]) -> dict[str, list]:
        plans = [stitch(t, m, overlap) for t, m in zip(c["t"], c[limit])]
        out = {k: c[k] for k in (*keys, limit, "skip")}
        return out | dict(zip(("longest", "starts", "ends", "forced"), map(list, zip(*plans))))

    return map_rows(grouped, schema, rows)


def cut_kind(longest: Column, limit: Column) -> Column:
    """``forced`` if a run without a natural boundary is longer than the limit."""
    return F.when(longest > limit, "forced").otherwise("natural")


def pieces(df: DataFrame, keys: list[str], text: str, limit: str, overlap: int, range_chars: int = RANGE_CHARS) -> DataFrame:
    """(keys, piece, start, end, forced, text): offsets count from the start of the raw text."""
    plan = stitched(boundary_tables(df, keys, text, limit, range_chars), keys, limit, overlap)
    each = plan.select(*keys, "skip", F.posexplode(F.arrays_zip("starts", "ends", "forced")).alias("piece", "p"))
    source = df.where(F.length(text) > F.col(limit)).select(*keys, F.col(text).alias("_text")).dropDuplicates(keys)
    start, end = F.col("p.starts") + F.col("skip"), F.col("p.ends") + F.col("skip")
    return each.join(source, keys).select(
        *keys, "piece", start.alias("start"), end.alias("end"), F.col("p.forced").alias("forced"), F.substring("_text", start + 1, end - start).alias("text")
    )


def _read(path: str, start: int, length: int) -> bytes:
    """Bytes of a file on any file system pyarrow knows; a path without a scheme is local."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)
    with system.open_input_file(inner) as f:
        return f.read_at(length, start)


def _decode(path: str, start: int, length: int, halo: int = 4) -> str:
    """The characters of a UTF-8 file whose first byte lies in [start, start + length); bytes that are no UTF-8 give U+FFFD."""
    raw = _read(path, start, length + halo)
    a = 0
    while a < min(len(raw), 4) and start and raw[a] & 0xC0 == 0x80:
        a += 1
    b = min(length, len(raw))
    while b < len(raw) and raw[b] & 0xC0 == 0x80:
        b += 1
    return raw[a:b].decode("utf-8", "replace")


def last_boundary(points: np.ndarray) -> int:
    """How many characters follow the last boundary of the best rank there is; -1 without any."""
    rank = _RANK[points]
    for r in range(RANKS, 0, -1):
        at = np.flatnonzero(rank == r)
        if len(at):
            return len(points) - 1 - int(at[-1])
    return -1


def split_files(spark: SparkSession, files: list[tuple[str, int]] | DataFrame, limit: int, overlap: int, range_bytes: int = 4 << 20) -> DataFrame:
    """(path, piece, start, end, forced, text) of UTF-8 files, given as rows (path, bytes), on storage all workers see.

    No worker reads more than its range and a halo of the half limit and the overlap
    before it.  ``piece`` rises along a file: the range's number times 2^32 plus the
    place in it.  A range's last piece ends at the last natural boundary of its last
    half limit, or is forced at its end.
    """
    if range_bytes < 4 * (limit + overlap) // 2:
        raise ValueError("a range must hold more than half a piece and its overlap")
    listed = (files if isinstance(files, DataFrame) else spark.createDataFrame([(p, n) for p, n in files], "path string, size bigint")).toDF("path", "size")
    last = F.expr(f"cast(greatest(size - 1, 0) div {range_bytes} as bigint)")
    ranges = listed.where("size > 0").select("path", last.alias("_last"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("no")).repartition("path", "no")

    def scan(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("path", "no", "n", "tail", "forced")}
        for p, no, end in zip(c["path"], c["no"], c["_last"]):
            points = code_points(_decode(p, no * range_bytes, range_bytes))
            tail = 0 if no == end else last_boundary(points[-(limit // 2) :])
            for k, v in zip(out, (p, no, len(points), max(tail, 0), tail < 0)):
                out[k].append(v)
        return out

    tables = map_rows(ranges, "path string, no bigint, n bigint, tail int, forced boolean", scan)
    along = W.partitionBy("path").orderBy("no")
    placed = tables.select(
        *tables.columns,
        F.coalesce(F.sum("n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.coalesce(F.lag("tail").over(along), F.lit(0)).alias("left"),
    )

    def emit(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("path", "piece", "start", "end", "forced", "text")}
        for p, no, n, tail, edge, base, left in zip(*[c[k] for k in ("path", "no", "n", "tail", "forced", "base", "left")]):
            begin, halo = no * range_bytes, 4 * (left + overlap) + 4
            before = _decode(p, max(0, begin - halo), min(halo, begin))[-(left + overlap) :] if begin and left + overlap else ""
            body = before + _decode(p, begin, range_bytes)[: n - tail]
            if len(body) <= (len(before) - left if begin else 0):
                continue  # nothing but what the piece before it has already
            table = dict(zip(("n", "lead", "trail", "longest", "first", "last"), range_table(code_points(body), max(1, limit // CELLS))))
            _, starts, ends, forced = stitch([table], limit, overlap)
            forced[-1] = edge
            for i, (a, b, f) in enumerate(zip(starts, ends, forced)):
                off = base - len(before)
                for k, v in zip(out, (p, (no << 32) + i, off + a, off + b, f, body[a:b])):
                    out[k].append(v)
        return out

    # The table's rows are few and small; they are spread again, so that no task emits a whole file.
    return map_rows(placed.repartition("path", "no"), "path string, piece bigint, start bigint, end bigint, forced boolean, text string", emit)
