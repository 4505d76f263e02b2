import pytest
from parity import agree

from quirefold.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql_agrees(name, spark, small, duck):
    agree(name, Q, spark, small, duck)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs_without_repeats(name, spark, small):
    df = Q.queries()[name](spark, small).toPandas()
    assert not df.astype(str).duplicated().any()


COLUMNS = {
    "p1_found": ["kind", "id_a", "id_b"], "p2_found": ["kind", "item_id", "cut_kind"], "p3_found": ["src", "page_id", "language"], "p4_found": ["page_id", "field", "defect"],
    "p5_found": ["query_id", "chunk_id"], "p6_found": ["rec_a", "rec_b"], "p7_found": ["kind", "item_id", "end_pos"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


@pytest.fixture(scope="module")
def odd(spark, small, tmp_path_factory):
    """Two folders: empty tables, and tables of nulls, repeats and further columns with common names."""
    from pyspark.sql import functions as F

    empty, messy = tmp_path_factory.mktemp("empty"), tmp_path_factory.mktemp("messy")
    for t in "document_meta page fuse_outcome chunk community_result search_hit linking_gold documents eval_item".split():
        df = spark.read.parquet(f"{small}/{t}.parquet")
        df.limit(0).write.parquet(f"{empty}/{t}.parquet")
        few = df.limit(12)
        nulls = few.limit(1).select(*[F.lit(None).cast(k).alias(c) for c, k in df.dtypes])
        more = few.unionByName(few).unionByName(nulls)
        for extra in ("title", "place", "n", "print", "range", "_at", "ids", "leaf", "key", "score_"):
            if extra not in df.columns:
                more = more.withColumn(extra, F.lit("x"))
        more.write.parquet(f"{messy}/{t}.parquet")
    return str(empty), str(messy)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_empty_and_messy_tables(name, spark, odd):
    empty, messy = odd
    q = Q.queries()[name]
    assert q(spark, empty).columns == COLUMNS[name] and q(spark, empty).count() == 0
    rows = q(spark, messy).collect()
    assert len(rows) == len({repr(r) for r in rows})


def test_long_texts_are_cut_but_no_cases(spark, odd):
    from pyspark.sql import functions as F

    _, messy = odd
    long = F.col("id").isin([r.id for r in spark.read.parquet(f"{messy}/chunk.parquet").where("length(trim(text)) > 500").select("id").distinct().collect()])
    every, cases = (Q.queries()[n](spark, messy).withColumnRenamed("item_id", "id").where("kind = 'chunk'") for n in ("p7_sentences", "p7_found"))
    assert cases.join(every, ["id", "end_pos"], "left_anti").count() == 0
    assert every.where(long).count() > 0 and cases.where(long).count() == 0


def test_the_mode_of_the_state_that_holds_counts(spark, small, tmp_path):
    """A page that was native and is scanned now has no sentences, nor has one whose newest text is null; the other way round it has those of the newer text."""
    from pyspark.sql import functions as F

    page = [("a", "native", "Old. Text.", 1), ("a", "scan", "New.", 2), ("b", "scan", "Old.", 1), ("b", "native", "One. Two.", 2), ("c", "native", "Left.", 1), ("c", None, "Left.", 2), ("d", "native", "Was.", 1), ("d", "native", None, 2)]
    spark.createDataFrame(page, "id string, mode string, textFused string, fusionAt int").write.parquet(f"{tmp_path}/page.parquet")
    spark.read.parquet(f"{small}/chunk.parquet").withColumn("chunkingAt", F.lit(1)).limit(0).write.parquet(f"{tmp_path}/chunk.parquet")
    assert sorted(tuple(r) for r in Q.p7_found(spark, str(tmp_path)).collect()) == [("page", "b", 4), ("page", "b", 9)]
    assert sorted(tuple(r) for r in Q.p7_sentences(spark, str(tmp_path)).select("item_id", "start_pos", "end_pos").collect()) == [("b", 0, 4), ("b", 4, 9)]
