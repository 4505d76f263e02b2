"""Loading the corpus tables and choosing the row of a key that holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings document_meta page "
    "fuse_outcome chunk community_result search_hit linking_gold eval_item"
).split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder ``sf_dir``."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Registers temporary views of the tables under their own names."""
    for name in names or TABLES:
        load(spark, sf_dir, name).createOrReplaceTempView(name)


def latest(df: DataFrame, keys: list[str] | str, order: str, cols: list[str] | None = None) -> DataFrame:
    """One row a key: the one with the greatest ``order``, equal times by the greatest row.

    Rows whose key is null are dropped; a null ``order`` loses to any other.
    The state is one struct a key, so the map side combines before the shuffle
    and a key that stands very often costs one row a task.
    """
    keys = [keys] if isinstance(keys, str) else keys
    cols = [c for c in (cols or df.columns) if c not in keys]
    rest = [c for c in cols if c != order]
    state = F.struct(F.col(order).alias("_at"), *[F.col(c) for c in rest])
    held = df.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.max(state).alias("_s"))
    out = [*keys, *[(F.col("_s._at") if c == order else F.col(f"_s.{c}")).alias(c) for c in cols]]
    return held.select(*out)
