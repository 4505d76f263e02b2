"""Places and neighbours within groups that may hold a third of all rows.

A window over such a group would be one task.  Here a group is first cut into
slices that follow its order; windows run within a slice, and what a slice needs
of the others (rows above it, the first row after it, the last value before it)
comes from a table of one row a slice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICES, BLOCK = 32, 50_000


def places(df: DataFrame, group: list[str], score: str, tie: str | None = None, slices: int = SLICES) -> DataFrame:
    """Adds ``place`` and ``of`` (rows of the group).

    ``place`` is 1 + the rows of the group with a greater score; with ``tie``,
    equal scores are numbered in its order.  Slices are cut by percentile
    sketches, which combine on the map side; equal scores fall into one slice,
    so the places are exact whatever the sketch says.
    """
    steps = [i / slices for i in range(1, slices)]
    cuts = df.groupBy(*group).agg(F.percentile_approx(score, steps, 1000).alias("_cuts"))
    sliced = df.join(cuts, group).withColumn("_slice", F.size(F.filter("_cuts", lambda c: c < F.col(score)))).drop("_cuts")
    counts = sliced.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    above = W.partitionBy(*group).orderBy(F.desc("_slice")).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *group, "_slice", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"), F.sum("_n").over(W.partitionBy(*group)).alias("of")
    )
    own = W.partitionBy(*group, "_slice").orderBy(F.desc(score), *([tie] if tie else []))
    within = (F.row_number() if tie else F.rank()).over(own)
    return (
        sliced.withColumn("_within", within)
        .join(offsets, [*group, "_slice"])
        .withColumn("place", F.col("_above") + F.col("_within"))
        .drop("_slice", "_within", "_above")
    )


def followers(df: DataFrame, group: str, at: str, key: str, block: int = BLOCK) -> DataFrame:
    """(key, next): each row and the next of its group by the whole number ``at``, then ``key``."""
    cut = df.select(group, at, key).withColumn("_b", F.floor(F.col(at) / block))
    w = W.partitionBy(group, "_b").orderBy(at, key)
    inner = cut.withColumn("next", F.lead(key).over(w))
    heads = cut.groupBy(group, "_b").agg(F.min(F.struct(at, key)).alias("h"))
    after = heads.select(group, "_b", F.lead("h").over(W.partitionBy(group).orderBy("_b"))[key].alias("_after"))
    return inner.join(after, [group, "_b"]).select(key, F.coalesce("next", "_after").alias("next")).where("next IS NOT NULL")


def carried(df: DataFrame, group: str, order: list[str], value: str, at: str, block: int = BLOCK) -> DataFrame:
    """``df`` with ``value`` filled from the last row of the group, in ``order`` (which begins with ``at``), that has one."""
    cut = df.withColumn("_b", F.floor(F.col(at) / block))
    before = W.partitionBy(group, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inner = cut.withColumn("_own", F.last(value, True).over(before))
    lasts = cut.where(F.col(value).isNotNull()).groupBy(group, "_b").agg(F.max(F.struct(*order, F.col(value).alias("_v")))["_v"].alias("_last"))
    blocks = cut.select(group, "_b").distinct().join(lasts, [group, "_b"], "left")
    earlier = W.partitionBy(group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    fill = blocks.select(group, "_b", F.last("_last", True).over(earlier).alias("_earlier"))
    return inner.join(fill, [group, "_b"]).withColumn(value, F.coalesce("_own", "_earlier")).drop("_b", "_own", "_earlier")


def numbered(df: DataFrame, group: list[str], at: str, key: str, block: int = BLOCK) -> DataFrame:
    """Adds ``number``: the rows of a group counted from 1 by the whole number ``at``, then ``key``; a group is counted block by block."""
    cut = df.withColumn("_b", F.floor(F.col(at) / block))
    within = F.row_number().over(W.partitionBy(*group, "_b").orderBy(at, key))
    counts = cut.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(*group, "_b", F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, "_b"]]
    met = cut.withColumn("_w", within).alias("l").join(before.alias("r"), reduce(lambda a, b: a & b, same))
    return met.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("r._before") + F.col("l._w")).alias("number"))
