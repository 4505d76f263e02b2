"""Predicates that are put together at run time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType


def given(**values: object) -> Column:
    """Equality with each value that is given; None asks for nothing."""
    tests = [F.col(k) == v for k, v in values.items() if v is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def requested(params: dict[str, object], known: dict[str, str]) -> Column:
    """The predicate of a request: ``known`` names its parameters as column and operator (``tier =``, ``year >=``, ``title contains``, ``status in``).

    Parameters that are missing, None or empty ask for nothing; an unknown one is an error.
    """
    strange = set(params) - set(known)
    if strange:
        raise ValueError(f"unknown parameters {sorted(strange)}")
    tests = []
    for name, spec in known.items():
        value = params.get(name)
        if value is None or value == "" or value == []:
            continue
        column, op = spec.rsplit(" ", 1)
        c = F.col(column)
        tests.append({"=": lambda: c == value, ">=": lambda: c >= value, "<=": lambda: c <= value, "contains": lambda: F.contains(c, F.lit(value)), "in": lambda: c.isin(list(value))}[op]())
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def due(status: str, ready: list[str], done: str, again: bool = False) -> Column:
    """Rows whose earlier stage is ready and whose own has not run, or which are to be run again."""
    return F.col(status).isin(ready) & (F.lit(again) | F.col(done).isNull())


def holds_any(x: Column, terms: Column) -> Column:
    """Whether a text holds one of an array of terms; null terms hold nothing."""
    return F.coalesce(F.exists(terms, lambda t: F.contains(x, t)), F.lit(False))


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p[:1].upper() + p[1:] for p in rest)


def camel_keys(df: DataFrame) -> DataFrame:
    """Columns, and the fields of structs within them, named in camel case."""

    def renamed(t: DataType) -> DataType:
        if isinstance(t, StructType):
            return StructType([StructField(camel(f.name), renamed(f.dataType), f.nullable) for f in t])
        return ArrayType(renamed(t.elementType), t.containsNull) if isinstance(t, ArrayType) else t

    return df.select(*[F.col(f.name).cast(renamed(f.dataType)).alias(camel(f.name)) for f in df.schema])


def uri_parts(x: Column) -> Column:
    """struct<scheme, bucket, key> of a URI, null for anything else."""
    pattern = r"^([a-z][a-z0-9+]*)://([^/]+)/(.+)$"
    part = lambda i: F.regexp_extract(x, pattern, i)
    return F.when(x.rlike(pattern), F.struct(part(1).alias("scheme"), part(2).alias("bucket"), part(3).alias("key")))


def content_type(key: Column) -> Column:
    """The type of an object by its suffix."""
    suffix = F.lower(F.regexp_extract(key, r"\.([^./]+)$", 1))
    kinds = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff", "pdf": "application/pdf", "json": "application/json", "txt": "text/plain"}
    known = F.create_map(*[F.lit(v) for kv in kinds.items() for v in kv])
    return F.coalesce(F.try_element_at(known, suffix), F.lit("application/octet-stream"))


def norms(df: DataFrame, tradition: str | None = None, most: int | None = None) -> DataFrame:
    """Norms of one tradition (or all) by tradition and scope, at most ``most`` of them."""
    rows = df.where(given(tradition=tradition)).orderBy("tradition", "scope")
    return rows if most is None else rows.limit(most)
