import os

import pytest
from parity import agree

from quirefold.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql_agrees(name, spark, small, duck):
    agree(name, catalog, spark, small, duck)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(name, spark, small):
    assert catalog.queries()[name](spark, small).count() >= 0


def test_entry(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "chunk_id", "ribbon", "score", "nth"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_imports_llm():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "quirefold")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for f in files:
            if f.endswith(".py"):
                assert "quirefold.llm" not in open(os.path.join(folder, f)).read().replace("quirefold.llm``", "").replace("``quirefold.llm", "")
