"""Where queries and their SQL are put down."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The rows of page and chunk that hold, for SQL.
PAGES = "page_now AS (SELECT * FROM page QUALIFY row_number() OVER (PARTITION BY id ORDER BY fusionAt DESC) = 1)"
CHUNKS = "chunk_now AS (SELECT * FROM chunk QUALIFY row_number() OVER (PARTITION BY id ORDER BY chunkingAt DESC) = 1)"
BOOKS = "book AS (SELECT id, max(tier) AS tier, max(title) AS title, max(publicationYear) AS publicationYear, max(sourcePath) AS sourcePath FROM document_meta GROUP BY id)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function as a query under its name, with the SQL that gives the same rows."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put
