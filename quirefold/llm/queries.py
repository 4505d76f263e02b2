"""The queries of the ten problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import leakage, neighbours, page_language, rank_fusion, residue, scan_repair, sentences, shared_spans, splitting, tokenize
from quirefold.llm.common import held_state
from quirefold.session import cut, scratch, spread
from quirefold.tables import latest, load

LIMITS = {"page": ("textFused", "fusionAt", 1500), "chunk": ("text", "chunkingAt", 500)}
OVERLAP = 50
FILES, FILE_RANGE = 4, 64 << 10
LEGS = ["bm25", "dense", "rerank"]


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(kind, item_id, at, text, most) of every state of every page and chunk."""
    parts = [
        load(spark, d, t).select(F.lit(t).alias("kind"), F.col("id").alias("item_id"), F.col(at).alias("at"), F.col(text).alias("text"), F.lit(most).alias("most"))
        for t, (text, at, most) in LIMITS.items()
    ]
    return parts[0].unionByName(parts[1])


def _held(spark: SparkSession, d: str) -> DataFrame:
    """(kind, item_id, print) of the states that hold."""
    parts = [held_state(load(spark, d, t), "id", at, text).select(F.lit(t).alias("kind"), F.col("id").alias("item_id"), "print") for t, (text, at, _) in LIMITS.items()]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for kind, table, key, order in (("chunk", "chunk", "id", "chunkingAt"), ("community", "community_result", "community_id", None)):
        lists = neighbours.neighbours(load(spark, d, table), key, "embedding", order, 10, 0.92)
        parts.append(neighbours.mutual(lists, key).select(F.lit(kind).alias("kind"), "id_a", "id_b"))
    return parts[0].unionByName(parts[1])


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar chunks of every chunk whose id's hash is divisible by 100, among all chunks."""
    units = cut(neighbours.sound(load(spark, d, "chunk"), "id", "embedding", "chunkingAt"))
    near = neighbours.nearest(units, units.where(F.pmod(F.xxhash64("id"), F.lit(100)) == 0), "id", 10)
    return near.select("id", "other", F.round("cosine", 6).alias("cosine"), "place")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    keys = ["kind", "item_id", "print"]
    texts = _texts(spark, d).withColumn("print", F.xxhash64("text"))
    plan = splitting.stitched(splitting.boundary_tables(texts, keys, "text", "most"), keys, "most", OVERLAP)
    return plan.join(_held(spark, d), keys).select("kind", "item_id", splitting.cut_kind(F.col("longest"), F.col("most")).alias("cut_kind"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    keys = ["kind", "item_id", "print"]
    texts = _texts(spark, d).withColumn("print", F.xxhash64("text"))
    held = _held(spark, d)
    return splitting.pieces(texts, keys, "text", "most", OVERLAP).join(held, keys, "left_semi").drop("print")


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    """The pages of all books as plain-text files in the shared folder, cut by byte ranges into pieces of at most 1,500 characters."""
    pages = latest(load(spark, d, "page"), "id", "fusionAt", ["documentId", "docPageIndex", "textFused", "fusionAt"]).where(F.length("textFused") > 0)
    folder = scratch(spark, "files")
    pages.repartition(FILES, "documentId", "docPageIndex").sortWithinPartitions("documentId", "docPageIndex", "id").select("textFused").write.text(folder)
    listed = spark.read.format("binaryFile").load(folder).select("path", "length")
    cut_ = splitting.split_files(spark, listed, LIMITS["page"][2], OVERLAP, FILE_RANGE)
    return cut_.withColumn("path", F.regexp_extract("path", "part-([0-9]+)", 1)).withColumnRenamed("path", "file")


def _languages(spark: SparkSession, d: str) -> DataFrame:
    return page_language.page_languages(load(spark, d, "page"), load(spark, d, "document_meta"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return page_language.label_cases(_languages(spark, d).where(F.col("length") <= LIMITS["page"][2]), load(spark, d, "fuse_outcome"))


def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    seen = _languages(spark, d).where("language is not null")
    return seen.select(F.col("id").alias("page_id"), F.col("language").alias("page_language"), F.col("confidence").alias("page_confidence"), F.inline("segments"))


def _scanned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return scan_repair.scanned(page_language.with_titles(spread(load(spark, d, "page").select("id", "documentId", "docPageIndex", "mode", "fusionAt", *scan_repair.FIELDS)), load(spark, d, "document_meta")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.defects(*_scanned(spark, d))


def p4_text(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.repaired(*_scanned(spark, d))


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return rank_fusion.fuse(load(spark, d, "search_hit"), LEGS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return rank_fusion.clear_winners(_fused(spark, d), LEGS).select("query_id", "chunk_id")


def p5_ranking(spark: SparkSession, d: str) -> DataFrame:
    ranked = rank_fusion.ranking(_fused(spark, d))
    return ranked.select("query_id", "chunk_id", F.round("rho", 9).alias("rho"), F.col("place").cast("bigint").alias("place"))


def _records(spark: SparkSession, d: str) -> list[DataFrame]:
    chunks = latest(load(spark, d, "chunk"), "id", "chunkingAt", ["chunkingAt", "text"]).select(F.col("id").alias("rec"), "text")
    return [chunks, load(spark, d, "linking_gold").where("pair_id is not null").select(F.col("pair_id").alias("rec"), F.col("gold_span").alias("text"))]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    links, groups, _, members = shared_spans.grouped(_records(spark, d))
    return shared_spans.every_pair(links, groups, members)


def p6_coverage(spark: SparkSession, d: str) -> DataFrame:
    batches = _records(spark, d)
    links, groups, places, members = shared_spans.grouped(batches)
    return shared_spans.coverage(links, members, batches[0].unionByName(batches[1]), groups, places)


def p6_spans(spark: SparkSession, d: str) -> DataFrame:
    """The common stretches of distinct texts, each named by its first record."""
    return shared_spans.class_spans(*shared_spans.shared(_records(spark, d), hot="each"))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each record of 64 characters or more and the first record of its text."""
    return shared_spans.memberships(shared_spans.classes(_records(spark, d)).select("rid", "rec").distinct())


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of the state of each chunk and page that holds; null where that state is no native page."""
    texts = _texts(spark, d).where("kind = 'chunk'")
    pages = load(spark, d, "page").select(F.lit("page").alias("kind"), F.col("id").alias("item_id"), F.col("fusionAt").alias("at"), F.when(F.col("mode") == "native", F.col("textFused")).alias("text"), F.lit(LIMITS["page"][2]).alias("most"))
    return latest(sentences.sentences(texts.unionByName(pages), ["kind", "item_id", "at", "most"], "text").where("item_id is not null"), ["kind", "item_id"], "at")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_rows(_sentences(spark, d).where("length <= most"), ["kind", "item_id"])


def p7_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of every chunk and native page, however long."""
    return sentences.sentence_spans(_sentences(spark, d), ["kind", "item_id"])


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(spread(load(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", f"{tokenize.FOLDER}/byte_bpe_50k.tiktoken")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaks(spread(load(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", load(spark, d, "eval_item"), "item_id", "text")
    return found.select("doc_id", "item_id")


def _mined(spark: SparkSession, d: str) -> DataFrame:
    return cut(residue.mine(spread(load(spark, d, "documents").select("doc_id", "text")), "doc_id", "text"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    mined = _mined(spark, d)
    return residue.residue(mined, residue.templates(mined), "doc_id")


def p10_templates(spark: SparkSession, d: str) -> DataFrame:
    return residue.leaf_templates(residue.templates(_mined(spark, d)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p2_pieces, p2_files, p3_found, p3_segments, p4_found, p4_text, p5_found, p5_ranking, p6_found, p6_coverage, p6_spans, p6_classes, p7_found, p7_sentences, p8_ids, p9_found, p10_found, p10_templates)}


_PLACES = """
WITH best AS (
  SELECT query_id, leg, chunk_id, max(score) AS score FROM search_hit
  WHERE score IS NOT NULL AND CAST(score AS VARCHAR) NOT IN ('nan', '-nan') AND query_id IS NOT NULL AND leg IS NOT NULL AND chunk_id IS NOT NULL
  GROUP BY ALL),
places AS (
  SELECT query_id, leg, chunk_id, rank() OVER w AS place, count(*) OVER (PARTITION BY query_id, leg) AS n
  FROM best WINDOW w AS (PARTITION BY query_id, leg ORDER BY score DESC))
"""


def oracle_sql() -> dict[str, str]:
    strip = r"'^[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$'"
    mark = r"'[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.!?;:,。！？；：，、｡．…]'"
    state = "SELECT '{t}' AS kind, id, arg_max(coalesce({x}, ''), {at}) AS body, {n} AS most FROM {t} GROUP BY id"
    good = "len({v}) = 64 AND list_bool_and(list_transform({v}, lambda x: x IS NOT NULL AND CAST(x AS VARCHAR) NOT IN ('nan', '-nan', 'inf', '-inf'))) AND list_bool_or(list_transform({v}, lambda x: x <> 0))"
    sound = "SELECT '{kind}' AS kind, {key} AS id, CAST(v AS DOUBLE[]) AS v FROM ({rows}) WHERE " + good.format(v="v")
    chunks = sound.format(kind="chunk", key="id", rows="SELECT id, arg_max(embedding, chunkingAt) AS v FROM chunk WHERE id IS NOT NULL GROUP BY id")
    communities = sound.format(kind="community", key="community_id", rows="SELECT community_id, any_value(embedding) AS v FROM community_result WHERE community_id IS NOT NULL GROUP BY community_id")
    return {
        "p1_found": f"""
WITH v AS ({chunks} UNION ALL {communities}),
near AS (
  SELECT a.kind, a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.kind, a.id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) AS place
  FROM v a JOIN v b ON a.kind = b.kind AND a.id <> b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.92)
SELECT x.kind, x.a AS id_a, x.b AS id_b FROM near x JOIN near y ON x.kind = y.kind AND x.a = y.b AND x.b = y.a
WHERE x.a < x.b AND x.place <= 10 AND y.place <= 10""",
        "p6_found": """
WITH rec AS (
  SELECT DISTINCT id AS rec, body FROM (SELECT id, arg_max(coalesce(text, ''), chunkingAt) AS body FROM chunk WHERE id IS NOT NULL GROUP BY id)
  UNION SELECT DISTINCT pair_id, gold_span FROM linking_gold WHERE pair_id IS NOT NULL),
grams AS (SELECT DISTINCT rec, substring(body, i, 64) AS g FROM (SELECT rec, body, unnest(range(1, length(body) - 62)) AS i FROM rec WHERE length(body) >= 64))
SELECT DISTINCT a.rec AS rec_a, b.rec AS rec_b FROM grams a JOIN grams b ON a.g = b.g AND a.rec < b.rec""",
        "p6_coverage": """
WITH rec AS (
  SELECT id AS rec, arg_max(coalesce(text, ''), chunkingAt) AS body FROM chunk WHERE id IS NOT NULL GROUP BY id
  UNION SELECT DISTINCT pair_id, coalesce(gold_span, '') FROM linking_gold WHERE pair_id IS NOT NULL),
grams AS (SELECT rec, i, substring(body, i, 64) AS g FROM (SELECT rec, body, unnest(range(1, length(body) - 62)) AS i FROM rec WHERE length(body) >= 64)),
often AS (SELECT g FROM grams GROUP BY g HAVING count(DISTINCT rec) > 1),
hit AS (SELECT rec, i FROM grams SEMI JOIN often USING (g)),
places AS (SELECT rec, count(DISTINCT p) AS covered FROM (SELECT rec, unnest(range(i, i + 64)) AS p FROM hit) GROUP BY rec),
pairs AS (SELECT a.rec, count(DISTINCT b.rec) AS others FROM grams a JOIN grams b ON a.g = b.g AND a.rec <> b.rec GROUP BY a.rec)
SELECT rec.rec, coalesce(others, 0) AS others, coalesce(covered, 0) AS covered,
  CASE WHEN length(body) > 0 THEN coalesce(covered, 0) / length(body) ELSE 0 END AS share
FROM rec LEFT JOIN places USING (rec) LEFT JOIN pairs USING (rec)""",
        "p6_classes": """
WITH rec AS (
  SELECT id AS rec, arg_max(coalesce(text, ''), chunkingAt) AS body FROM chunk WHERE id IS NOT NULL GROUP BY id
  UNION SELECT DISTINCT pair_id, coalesce(gold_span, '') FROM linking_gold WHERE pair_id IS NOT NULL)
SELECT rec, min(rec) OVER (PARTITION BY body) AS class FROM rec WHERE length(body) >= 64""",
        "p2_found": f"""
WITH held AS ({state.format(t='page', x='textFused', at='fusionAt', n=1500)} UNION ALL {state.format(t='chunk', x='text', at='chunkingAt', n=500)}),
long AS (SELECT kind, id, most, regexp_replace(body, {strip}, '', 'g') AS body FROM held)
SELECT kind, id AS item_id,
  CASE WHEN list_max(list_transform(string_split_regex(body, {mark}), lambda x: length(x))) > most THEN 'forced' ELSE 'natural' END AS cut_kind
FROM long WHERE length(body) > most""",
        "p5_found": _PLACES
        + """
SELECT query_id, chunk_id FROM places GROUP BY ALL
HAVING count(*) = 3 AND count(*) FILTER (place = 1) >= 2 AND max(place) <= 3""",
        "p5_ranking": _PLACES
        + """,
r AS (
  SELECT query_id, chunk_id, list_sort(list(place / n) || list_resize(CAST([] AS DOUBLE[]), 3 - count(*), 1.0)) AS r
  FROM places GROUP BY ALL),
t AS (
  SELECT query_id, chunk_id, least(1.0, 3 * least(1 - pow(1 - r[1], 3), 3 * pow(r[2], 2) * (1 - r[2]) + pow(r[2], 3), pow(r[3], 3))) AS rho FROM r)
SELECT query_id, chunk_id, round(rho, 9) AS rho, rank() OVER (PARTITION BY query_id ORDER BY round(rho, 12)) AS place FROM t""",
    }
