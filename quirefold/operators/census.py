"""Counts, shares and pivots over pages, chunks and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conditional_counts(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """One row: how many rows each condition holds for."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in measures.items()])


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """A percentage; an empty whole counts as one."""
    return F.round(100.0 * part / F.greatest(whole, F.lit(1)), digits)


def set_counts(df: DataFrame, keys: list[str], sets: list[list[str]], unset: str = "(unset)") -> DataFrame:
    """Counts by several sets of keys in one pass; a key outside its set is null, a missing value ``unset``."""
    named = df.select(*[F.coalesce(F.col(k), F.lit(unset)).alias(k) for k in keys])
    return named.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))


def status_melt(df: DataFrame, group: str, statuses: dict[str, Column]) -> DataFrame:
    """(group, engine, status, n): a column for each engine melted into rows and counted."""
    wide = df.select(group, *[c.alias(n) for n, c in statuses.items()])
    return wide.unpivot([group], list(statuses), "engine", "status").groupBy(group, "engine", "status").agg(F.count(F.lit(1)).alias("n"))


def mean_of_means(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The mean over groups of their means, so that every group has one say."""
    return df.groupBy(*keys).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean_of_means"), F.count("m").alias("groups"))


def cut_counts(df: DataFrame, key: str, item: str, low: int, high: int) -> DataFrame:
    """(item, n): items by the number of different keys they occur with, ``low`` to ``high`` of them."""
    return df.select(key, item).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(low, high))


def gates(counts: DataFrame, rules: dict[str, tuple[str, str, float]]) -> DataFrame:
    """(gate, share, open) of stages: name -> (done column, all column, least share)."""
    rows = [
        F.struct(F.lit(n).alias("gate"), (F.col(a) / F.greatest(F.col(b), F.lit(1))).alias("share"), (F.col(a) >= F.lit(least) * F.col(b)).alias("open"))
        for n, (a, b, least) in rules.items()
    ]
    return counts.select(F.inline(F.array(*rows)))
