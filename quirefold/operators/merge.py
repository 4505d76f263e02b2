"""Writing into tables that exist: upserts, patches, deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.tables import latest


def last_change(changes: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One change a key: the one of the greatest ``order``, or without an order (and at equal ones) the greatest row."""
    if order:
        return latest(changes, keys, order)
    rest = [c for c in changes.columns if c not in keys]
    if not rest:
        return changes.select(*keys).distinct()
    held = changes.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_s"))
    return held.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in rest])


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], create_only: list[str] = (), order: str | None = None) -> DataFrame:
    """The table with changes put in: new keys added, known ones updated but for ``create_only`` columns; of a key's changes the last by ``order``."""
    held = table.withColumn("_t", F.lit(True))
    new = last_change(changes, keys, order).select(*keys, *[F.col(c).alias(f"_n_{c}") for c in changes.columns if c not in keys], F.lit(True).alias("_c"))
    joined = held.join(new, keys, "full_outer")
    out = []
    for c in table.columns:
        if c in keys or f"_n_{c}" not in new.columns:
            out.append(F.col(c))
        else:
            keep = F.col("_c").isNull() | (F.col("_t").isNotNull() if c in create_only else F.lit(False))
            out.append(F.when(keep, F.col(c)).otherwise(F.col(f"_n_{c}")).alias(c))
    return joined.select(*out)


def patch(table: DataFrame, changes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The table with the values of ``changes`` that are not null; no key is added."""
    new = last_change(changes, keys, order).select(*keys, *[F.col(c).alias(f"_n_{c}") for c in changes.columns if c not in keys])
    joined = table.join(new, keys, "left")
    return joined.select(*[F.coalesce(f"_n_{c}", c).alias(c) if f"_n_{c}" in new.columns else F.col(c) for c in table.columns])


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The table without the rows of some parents."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def pending(table: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows that no earlier run has processed."""
    return table.join(done.select(key), key, "left_anti")


def appended(table: DataFrame, batch: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """A batch added, each key once, earlier rows first."""
    new = last_change(batch, keys, order).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(new.select(*table.columns))
