"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def map_rows(df: DataFrame, schema: str, rows: Callable[[dict[str, list]], dict[str, list]]) -> DataFrame:
    """``rows`` over Arrow batches: columns as lists in, columns as lists out.

    The function sees one batch at a time, so its memory does not follow the
    partition; it must not depend on how rows fall into batches.
    """
    struct = _parse_datatype_string(schema)
    assert isinstance(struct, StructType)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = rows({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def held_state(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, at, print) of the row of each key that holds; no text is shuffled.

    ``print`` is a 64-bit hash of the text, by which the holding row is told
    from another of the same time.
    """
    state = F.struct(F.col(order).alias("at"), F.xxhash64(text).alias("print"))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(state).alias("s")).select(key, "s.at", "s.print")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def head(df: DataFrame, n: str, tie: str, most: int) -> DataFrame:
    """At most ``most`` rows of the greatest ``n``; of those equal at the cut the ones whose ``tie`` has the least hash.

    A plain top-k would send ``most`` rows of every partition to one task.  A
    table much larger than that is first cut at the percentile of ``n`` that
    leaves about ``most`` rows, and of the rows just at that cut a share by hash
    is kept, so that the list is as full for a table of ties as for any other.
    """
    rows = df.count()
    if rows > 2 * most:
        bound = df.agg(F.percentile_approx(n, 1 - most / rows, 100_000)).first()[0]
        above, at = df.agg(F.count_if(F.col(n) > bound), F.count_if(F.col(n) == bound)).first()
        share = min(1.0, 1.2 * max(0, most - above) / max(1, at))
        hashed = F.pmod(F.xxhash64(tie), F.lit(1 << 20))
        df = df.where((F.col(n) > bound) | ((F.col(n) == bound) & (hashed < F.lit(int(share * (1 << 20))))))
    return df.orderBy(F.desc(n), F.xxhash64(tie)).limit(most)


def beyond(df: DataFrame, n: str, kept: list[int]) -> int:
    """The greatest ``n`` a row left out by ``head`` can have; 0 where ``kept`` holds the whole table."""
    if df.count() <= len(kept):
        return 0
    return min(kept) if kept else df.agg(F.max(n)).first()[0]
