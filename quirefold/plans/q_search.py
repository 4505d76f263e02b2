"""Queries over hits, vectors, links and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.functions.vectors import cosine
from quirefold.operators import graphs, metrics, providers, search
from quirefold.operators.ranking import places
from quirefold.plans.q_corpus import books, chunks_now, pages_now
from quirefold.plans.registry import BOOKS, CHUNKS, PAGES, query
from quirefold.session import cut, spread
from quirefold.tables import load

_BEST = """best AS (SELECT query_id, leg, chunk_id, max(score) AS s FROM search_hit WHERE score IS NOT NULL AND CAST(score AS VARCHAR) NOT IN ('nan', '-nan') GROUP BY ALL)"""
_RRF = f"""{_BEST}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, leg ORDER BY s DESC, chunk_id) AS r FROM best),
fused AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + r)), 12) AS rrf FROM ranked GROUP BY ALL),
topped AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS place FROM fused)"""
_GRAMS = "list_concat(list_transform(range(1, length(b) - 1), lambda i: substring(b, i, 3)), list_transform(range(1, greatest(1, length(b) - 2)), lambda i: substring(b, i, 4)))"
_BLANKS = r"'[ \t\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\n\r\x{b}\x{c}\x{85}\x{2028}\x{2029}]+'"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "search_hit")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return search.rrf(_hits(spark, d), "query_id", "leg", "chunk_id", "score")


@query(f"WITH {_RRF} SELECT query_id, chunk_id, rrf, place FROM topped WHERE place <= 100")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d)


@query(f"WITH {_BEST} SELECT query_id, leg, chunk_id, round(CASE WHEN max(s) OVER w = min(s) OVER w THEN 1.0 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END, 9) AS scaled FROM best WINDOW w AS (PARTITION BY query_id, leg)")
def minmax_scores(spark: SparkSession, d: str) -> DataFrame:
    best = _hits(spark, d).where("score IS NOT NULL AND NOT isnan(score)").groupBy("query_id", "leg", "chunk_id").agg(F.max("score").alias("s"))
    return search.minmax(best, ["query_id", "leg"], "s").select("query_id", "leg", "chunk_id", F.round("scaled", 9).alias("scaled"))


@query(f"""WITH {_RRF}, {CHUNKS}, b AS (SELECT t.query_id, t.chunk_id, c.tier, rrf + CASE WHEN c.tier = 'primary' THEN 0.15 ELSE 0 END AS boosted FROM topped t JOIN chunk_now c ON c.id = t.chunk_id WHERE place <= 100)
SELECT query_id, chunk_id, tier, round(boosted, 9) AS boosted, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, chunk_id) AS place FROM b""")
def tier_boost(spark: SparkSession, d: str) -> DataFrame:
    tiers = chunks_now(spark, d, ["tier"]).select(F.col("id").alias("chunk_id"), "tier")
    up = search.boosted(_fused(spark, d).drop("place").join(tiers, "chunk_id"), "query_id", "rrf", "chunk_id", "tier", "primary")
    return up.select("query_id", "chunk_id", "tier", F.round("boosted", 9).alias("boosted"), "place")


@query(f"""WITH {_RRF}, {CHUNKS}, b AS (SELECT t.query_id, t.chunk_id, CASE WHEN c.tier IN ('primary', 'secondary') THEN c.tier ELSE 'secondary' END AS ribbon, place FROM topped t LEFT JOIN chunk_now c ON c.id = t.chunk_id WHERE place <= 100)
SELECT * FROM (SELECT query_id, chunk_id, ribbon, row_number() OVER (PARTITION BY query_id, ribbon ORDER BY place) AS nth FROM b) WHERE nth <= CASE ribbon WHEN 'primary' THEN 5 ELSE 3 END""")
def two_ribbons(spark: SparkSession, d: str) -> DataFrame:
    tiers = chunks_now(spark, d, ["tier"]).select(F.col("id").alias("chunk_id"), "tier")
    laid = search.ribbons(_fused(spark, d).join(tiers, "chunk_id", "left"), "query_id", "tier", "place", {"primary": 5, "secondary": 3}, "secondary")
    return laid.select("query_id", "chunk_id", "ribbon", "nth")


@query(f"""WITH {_BEST}, w AS (SELECT query_id, chunk_id, max(s) FILTER (leg = 'rerank') AS re, max(s) FILTER (leg = 'dense') AS de FROM best GROUP BY ALL)
SELECT query_id, chunk_id, round(0.7 * re + 0.3 * least(de, 1.0), 6) AS combined, row_number() OVER (PARTITION BY query_id ORDER BY re DESC, chunk_id) AS place FROM w WHERE re IS NOT NULL AND de IS NOT NULL AND re >= 0""")
def rerank_combined(spark: SparkSession, d: str) -> DataFrame:
    best = _hits(spark, d).where("score IS NOT NULL AND NOT isnan(score)").groupBy("query_id", "chunk_id").agg(
        F.max(F.when(F.col("leg") == "rerank", F.col("score"))).alias("re"), F.max(F.when(F.col("leg") == "dense", F.col("score"))).alias("de")
    )
    kept = best.where("re IS NOT NULL AND de IS NOT NULL AND re >= 0")
    placed = places(kept, ["query_id"], "re", "chunk_id")
    return placed.select("query_id", "chunk_id", F.round(0.7 * F.col("re") + 0.3 * F.least("de", F.lit(1.0)), 6).alias("combined"), "place")


@query(f"""WITH {CHUNKS}, l AS (SELECT DISTINCT pair_id, gold_span, CASE WHEN len(primary_chunk_ids) > 0 THEN primary_chunk_ids[1] END AS chunk_id FROM linking_gold),
n AS (SELECT pair_id, gold_span, c.text AS text, regexp_replace(gold_span, {_BLANKS}, '', 'g') AS q, regexp_replace(c.text, {_BLANKS}, '', 'g') AS b FROM l LEFT JOIN chunk_now c ON c.id = l.chunk_id)
SELECT pair_id, CASE WHEN gold_span IS NULL OR length(trim(gold_span)) = 0 THEN 'no_span' WHEN length(trim(gold_span)) < 4 THEN 'span_too_short' WHEN text IS NULL THEN 'no_text' WHEN length(q) < 4 THEN 'span_too_short'
  WHEN contains(b, q) THEN 'verified' ELSE 'span_not_found' END AS verdict FROM n""")
def verify_spans(spark: SparkSession, d: str) -> DataFrame:
    links = load(spark, d, "linking_gold").select("pair_id", "gold_span", F.get("primary_chunk_ids", F.lit(0)).alias("id")).distinct()
    joined = links.join(chunks_now(spark, d, ["text"]), "id", "left")
    return joined.select("pair_id", search.verdict(F.col("gold_span"), F.col("text")).alias("verdict"))


@query(f"""WITH {CHUNKS}, l AS (SELECT DISTINCT pair_id, gold_span, CASE WHEN len(primary_chunk_ids) > 0 THEN primary_chunk_ids[1] END AS chunk_id FROM linking_gold),
n AS (SELECT regexp_replace(gold_span, {_BLANKS}, '', 'g') AS q, regexp_replace(c.text, {_BLANKS}, '', 'g') AS b, coalesce(c.tier, '(unset)') AS tier FROM l LEFT JOIN chunk_now c ON c.id = l.chunk_id)
SELECT tier, count(*) AS n, count(*) FILTER (length(q) >= 4 AND contains(b, q)) AS passed FROM n GROUP BY 1""")
def verify_gate(spark: SparkSession, d: str) -> DataFrame:
    links = load(spark, d, "linking_gold").select("pair_id", "gold_span", F.get("primary_chunk_ids", F.lit(0)).alias("id")).distinct()
    joined = links.join(chunks_now(spark, d, ["text", "tier"]), "id", "left")
    judged = joined.select(F.coalesce("tier", F.lit("(unset)")).alias("tier"), (search.verdict(F.col("gold_span"), F.col("text")) == "verified").alias("ok"))
    return judged.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("passed"))


@query(f"""WITH {CHUNKS}, l AS (SELECT DISTINCT pair_id, secondary_chunk_id AS a, unnest(primary_chunk_ids) AS b FROM linking_gold WHERE secondary_chunk_id <> '')
SELECT DISTINCT x.id AS citing, y.id AS cited, x.documentId = y.documentId AS same_book FROM l JOIN chunk_now x ON x.id = l.a JOIN chunk_now y ON y.id = l.b""")
def cites_edges(spark: SparkSession, d: str) -> DataFrame:
    links = load(spark, d, "linking_gold").where("secondary_chunk_id <> ''").select(F.col("secondary_chunk_id").alias("citing"), F.explode("primary_chunk_ids").alias("cited")).distinct()
    c = chunks_now(spark, d, ["documentId"])
    both = links.join(c.toDF("citing", "x", *c.columns[2:]).select("citing", "x"), "citing").join(c.toDF("cited", "y", *c.columns[2:]).select("cited", "y"), "cited")
    return both.select("citing", "cited", (F.col("x") == F.col("y")).alias("same_book"))


@query("""WITH m AS (SELECT DISTINCT community_id, unnest(chunk_ids) AS chunk_id FROM community_result), s AS (SELECT community_id, max(modularity) AS score FROM community_result GROUP BY 1),
j AS (SELECT m.chunk_id, m.community_id, score FROM m JOIN s USING (community_id) WHERE score IS NOT NULL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, community_id) AS n FROM j) WHERE n = 1)
SELECT chunk_id, community_id, score FROM (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY chunk_id) AS k FROM b) WHERE k <= 50""")
def community_route(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "community_result")
    members = c.select("community_id", F.explode("chunk_ids").alias("chunk_id")).distinct()
    scored = c.groupBy("community_id").agg(F.max("modularity").alias("score")).where("score IS NOT NULL")
    return search.members_of(scored, members, "community_id", "chunk_id", 50).select("chunk_id", "community_id", "score")


@query(f"""WITH {_BEST}, {CHUNKS}, h AS (SELECT query_id, chunk_id, s AS score FROM best WHERE leg = 'dense'),
e AS (SELECT DISTINCT h.query_id, x.id AS chunk_id FROM h JOIN chunk_now c ON c.id = h.chunk_id JOIN chunk_now x ON x.pageId = c.pageId)
SELECT query_id, chunk_id, score FROM h UNION ALL SELECT query_id, chunk_id, 0.0 FROM e ANTI JOIN h USING (query_id, chunk_id)""")
def expand_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d).where("leg = 'dense' AND score IS NOT NULL AND NOT isnan(score)").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    c = chunks_now(spark, d, ["pageId"]).select("id", "pageId")
    near = hits.join(c.toDF("chunk_id", "pageId"), "chunk_id").select("query_id", "pageId").distinct().join(c.toDF("chunk_id", "pageId"), "pageId")
    return search.expanded(hits, near, "query_id", "chunk_id")


@query("""WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0), a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT query, hit, score, place FROM (SELECT q.vec_id AS query, a.vec_id AS hit, round(list_cosine_similarity(q.v, a.v), 9) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, a.v), 9) DESC, a.vec_id) AS place FROM q JOIN a ON q.vec_id <> a.vec_id) WHERE place <= 10""")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    return search.knn(e, "vec_id", "embedding", e.where("vec_id % 100 = 0"), "vec_id", 10)


@query("""WITH q AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0), a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label = 0)
SELECT query, hit, score, place FROM (SELECT q.vec_id AS query, a.vec_id AS hit, round(list_cosine_similarity(q.v, a.v), 9) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, a.v), 9) DESC, a.vec_id) AS place FROM q JOIN a ON q.vec_id <> a.vec_id) WHERE place <= 5""")
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    return search.knn(e.where("label = 0"), "vec_id", "embedding", e.where("vec_id % 100 = 0"), "vec_id", 5)


_SOUND = "len(v) = 64 AND list_bool_and(list_transform(v, lambda x: x IS NOT NULL AND CAST(x AS VARCHAR) NOT IN ('nan', '-nan'))) AND list_bool_or(list_transform(v, lambda x: x <> 0))"


@query(f"""WITH v AS (SELECT * FROM (SELECT community_id AS id, CAST(max(embedding) AS DOUBLE[]) AS v FROM community_result WHERE community_id IS NOT NULL GROUP BY 1) WHERE {_SOUND}),
p AS (SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.v, y.v), 9) AS s FROM v x JOIN v y ON x.id <> y.id)
SELECT a, b, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM p WHERE s >= 0.85) WHERE n <= 50""")
def related_edges(spark: SparkSession, d: str) -> DataFrame:
    """The up to 50 others of a cosine of 0.85 or more of every community."""
    v = load(spark, d, "community_result").where("community_id IS NOT NULL").groupBy(F.col("community_id").alias("id")).agg(F.max("embedding").alias("v"))
    near = search.knn(v, "id", "v", v, "id", 50, 0.85)
    return near.select(F.col("query").alias("a"), F.col("hit").alias("b"), F.round("score", 6).alias("score"))


@query("""WITH c AS (SELECT label, list_transform(range(1, 65), lambda i: avg_at[i]) AS v FROM (SELECT label, list(m ORDER BY i) AS avg_at FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2) GROUP BY 1))
SELECT label, round(avg(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v)), 5) AS spread, count(*) AS n FROM embeddings JOIN c USING (label) GROUP BY 1""")
def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"))
    return e.join(centre, "label").groupBy("label").agg(F.round(F.avg(cosine(F.col("embedding"), F.col("v"))), 5).alias("spread"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH doc AS (SELECT doc_id, regexp_replace(text, {_BLANKS}, '', 'g') AS b FROM documents WHERE length(text) >= 3), lens AS (SELECT doc_id, greatest(length(b) - 2, 0) + greatest(length(b) - 3, 0) AS len FROM doc),
q AS (SELECT item_id, regexp_replace(text, {_BLANKS}, '', 'g') AS b FROM eval_item), asked AS (SELECT item_id, g, count(*) AS times FROM (SELECT item_id, unnest({_GRAMS}) AS g FROM q) GROUP BY ALL),
post AS (SELECT doc_id, g, count(*) AS tf FROM (SELECT doc_id, unnest({_GRAMS}) AS g FROM doc) WHERE g IN (SELECT g FROM asked) GROUP BY ALL),
voc AS (SELECT g, ln((SELECT count(*) FROM lens) - count(DISTINCT doc_id) + 0.5) - ln(count(DISTINCT doc_id) + 0.5) AS idf FROM (SELECT doc_id, unnest({_GRAMS}) AS g FROM doc) GROUP BY g),
idf AS (SELECT g, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM voc) ELSE idf END AS idf FROM voc WHERE g IN (SELECT g FROM asked)),
s AS (SELECT item_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len) FROM lens)))), 6) AS score FROM post JOIN idf USING (g) JOIN lens USING (doc_id) JOIN asked USING (g) GROUP BY ALL)
SELECT item_id, doc_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s WHERE score > 0) WHERE place <= 5""")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    scored = search.bm25(load(spark, d, "documents"), "doc_id", "text", load(spark, d, "eval_item"), "item_id", "text", 5, 6)
    return scored.select("item_id", "doc_id", "score", "place")


_TRI = "list_distinct(list_transform(range(1, length({b}) - 1), lambda i: substring({b}, i, 3)))"
_INTENT = """CASE WHEN regexp_matches(t, '(?i)何時|何年|幾年|誰|卒|生於|\\b(when|who|where|date|year)\\b') THEN 'primary' WHEN regexp_matches(t, '(?i)考證|評|注釋|解|研究|\\b(why|how|meaning|interpret|commentary)') THEN 'secondary' END"""
_HYBRID = f"""{CHUNKS}, q AS (SELECT pair_id AS query_id, max(gold_span) AS t, max(secondary_chunk_id) AS s FROM linking_gold WHERE pair_id IS NOT NULL AND length(trim(gold_span, ' ')) >= 4 GROUP BY 1),
doc AS (SELECT id, regexp_replace(text, {_BLANKS}, '', 'g') AS b FROM chunk_now WHERE length(text) >= 3), lens AS (SELECT id, greatest(length(b) - 2, 0) + greatest(length(b) - 3, 0) AS len FROM doc),
qb AS (SELECT query_id, regexp_replace(t, {_BLANKS}, '', 'g') AS b FROM q), asked AS (SELECT query_id, g, count(*) AS times FROM (SELECT query_id, unnest({_GRAMS}) AS g FROM qb) GROUP BY ALL),
every AS (SELECT id, g, count(*) AS tf FROM (SELECT id, unnest({_GRAMS}) AS g FROM doc) GROUP BY ALL), voc AS (SELECT g, ln((SELECT count(*) FROM lens) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM every GROUP BY g),
idf AS (SELECT g, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM voc) ELSE idf END AS idf FROM voc WHERE g IN (SELECT g FROM asked)),
lex AS (SELECT query_id, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len) FROM lens)))), 6) AS s FROM every JOIN idf USING (g) JOIN lens USING (id) JOIN asked USING (g) GROUP BY ALL),
vec AS (SELECT * FROM (SELECT id, CAST(embedding AS DOUBLE[]) AS v FROM chunk_now) WHERE {_SOUND}),
den AS (SELECT q.query_id, y.id, round(list_cosine_similarity(x.v, y.v), 9) AS s FROM q JOIN vec x ON x.id = q.s JOIN vec y ON true),
legs AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM lex WHERE s > 0 UNION ALL SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM den),
fused AS (SELECT query_id, id AS chunk_id, round(sum(1.0 / (60 + r)), 12) AS rrf FROM legs WHERE r <= 100 GROUP BY ALL),
topped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS place FROM fused) WHERE place <= 100),
b AS (SELECT t.query_id, t.chunk_id, c.tier, q.t AS span, c.text, rrf + CASE WHEN c.tier = {_INTENT} THEN 0.15 ELSE 0 END AS boosted FROM topped t JOIN chunk_now c ON c.id = t.chunk_id JOIN q USING (query_id)),
n AS (SELECT *, regexp_replace(span, {_BLANKS}, '', 'g') AS sb, regexp_replace(coalesce(text, ''), {_BLANKS}, '', 'g') AS tb FROM b),
k AS (SELECT *, CASE WHEN length(sb) < 3 THEN 0 ELSE len(list_intersect({_TRI.format(b='sb')}, {_TRI.format(b='tb')})) / len({_TRI.format(b='sb')}) END AS rel, length(sb) >= 4 AND text IS NOT NULL AND contains(tb, sb) AS ok FROM n),
held AS (SELECT *, round(rel, 9) AS relevance, round(0.7 * rel + 0.3 * least(boosted, 1.0), 6) AS score, CASE WHEN tier IN ('primary', 'secondary') THEN tier ELSE 'secondary' END AS ribbon FROM k)"""


def _found(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, chunk_id, tier, span, text, boosted, verdict): the hundred best chunks of every link's span, raised by intent and verified.

    The lexical leg searches the span, the dense one the vector of the chunk it stands in.
    """
    g = load(spark, d, "linking_gold").where("pair_id IS NOT NULL AND length(trim(gold_span)) >= 4")
    q = cut(g.groupBy(F.col("pair_id").alias("query_id")).agg(F.max("gold_span").alias("span"), F.max("secondary_chunk_id").alias("source")))
    c = cut(chunks_now(spark, d, ["tier", "text", "embedding"]))
    lexical = search.bm25(c, "id", "text", q, "query_id", "span", 100, 6).select("query_id", F.col("id").alias("chunk_id"), "place")
    sources = c.select("id", "embedding").join(q.select(F.col("source").alias("id")).distinct(), "id", "left_semi")
    near = search.knn(spread(c.select("id", "embedding")), "id", "embedding", sources, "id", 100, itself=True)
    dense = near.join(q.select("query_id", F.col("source").alias("query")), "query").select("query_id", F.col("hit").alias("chunk_id"), "place")
    fused = lexical.unionByName(dense).groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (search.RRF + F.col("place"))), 12).alias("rrf"))
    best = cut(search.top(fused, ["query_id"], "rrf", "chunk_id", 100).drop("place"))
    rows = best.join(c.select(F.col("id").alias("chunk_id"), "tier", "text"), "chunk_id").join(search.small(q.select("query_id", "span", search.intent(F.col("span")).alias("intent"))), "query_id")
    up = search.raised_by_intent(F.col("rrf"), F.col("tier"), F.col("intent"))
    return rows.select("query_id", "chunk_id", "tier", "span", "text", up.alias("boosted"), search.verdict(F.col("span"), F.col("text")).alias("verdict"))


def _hybrid(found: DataFrame) -> DataFrame:
    """(query_id, chunk_id, tier, relevance, score) of found chunks, reranked."""
    ranked = providers.rerank(found, ["query_id", "chunk_id"], "span", "text").join(found, ["query_id", "chunk_id"])
    combined = 0.7 * F.col("relevance") + 0.3 * F.least("boosted", F.lit(1.0))
    return ranked.select("query_id", "chunk_id", "tier", F.round("relevance", 9).alias("relevance"), F.round(combined, 6).alias("score"))


@query(f"""WITH {_HYBRID} SELECT query_id, chunk_id, ribbon, score, nth FROM (SELECT *, row_number() OVER (PARTITION BY query_id, ribbon ORDER BY relevance DESC, score DESC, chunk_id) AS nth FROM held WHERE ok) WHERE nth <= CASE ribbon WHEN 'primary' THEN 5 ELSE 3 END""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Lexical and dense legs, fused by rank, raised by intent, verified, reranked, laid out by ribbon."""
    passed = _hybrid(cut(_found(spark, d).where("verdict = 'verified'")))
    ribbon = F.when(F.col("tier").isin("primary", "secondary"), F.col("tier")).otherwise("secondary")
    nth = F.row_number().over(W.partitionBy("query_id", "ribbon").orderBy(F.desc("relevance"), F.desc("score"), "chunk_id"))
    laid = passed.withColumn("ribbon", ribbon).withColumn("nth", nth)
    return laid.where(F.col("nth") <= F.when(F.col("ribbon") == "primary", 5).otherwise(3)).select("query_id", "chunk_id", "ribbon", "score", "nth")


@query(f"""WITH {_HYBRID}, g AS (SELECT DISTINCT pair_id AS query_id, unnest(primary_chunk_ids) AS chunk_id FROM linking_gold), m AS (SELECT query_id, max(CASE WHEN ok THEN 0 ELSE 1 END) AS missed FROM held JOIN g USING (query_id, chunk_id) GROUP BY 1),
f AS (SELECT 0.0 + coalesce(missed, 0) AS v FROM (SELECT DISTINCT query_id FROM g) JOIN q USING (query_id) LEFT JOIN m USING (query_id))
SELECT 'ungated' AS rows, round(avg(CASE WHEN ok THEN 1 ELSE 0 END), 6) AS verified, round(avg(CASE WHEN ok THEN 0 ELSE 1 END), 6) AS insufficient, (SELECT round(avg(v), 6) FROM f) AS false_negative, count(*) AS n FROM held
UNION ALL SELECT 'gated', round(avg(CASE WHEN ok THEN 1 ELSE 0 END), 6), round(avg(CASE WHEN ok THEN 0 ELSE 1 END), 6), 0.0, count(*) FROM held WHERE ok""")
def faithfulness(spark: SparkSession, d: str) -> DataFrame:
    """How many found chunks are verified, how many not, and how often a link's own chunk is found and refused: before and behind the gate."""
    rows = cut(_found(spark, d).select("query_id", "chunk_id", (F.col("verdict") == "verified").alias("ok")))
    gold = load(spark, d, "linking_gold").select(F.col("pair_id").alias("query_id"), F.explode("primary_chunk_ids").alias("chunk_id")).distinct()
    asked = load(spark, d, "linking_gold").where("pair_id IS NOT NULL AND length(trim(gold_span)) >= 4").select(F.col("pair_id").alias("query_id")).distinct()
    return metrics.faithfulness(rows, gold.join(asked, "query_id", "left_semi"), "query_id", "chunk_id", "ok")


@query(f"""WITH {CHUNKS}, q AS (SELECT pair_id AS query_id, max(gold_span) AS t FROM linking_gold WHERE pair_id IS NOT NULL GROUP BY 1), terms AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(t), '([a-z0-9]+)', 1)) AS term FROM q),
w AS (SELECT id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS word FROM chunk_now), f AS (SELECT word, count(*) AS n FROM w GROUP BY 1),
met AS (SELECT DISTINCT query_id, word, n FROM terms JOIN f ON contains(word, term)), kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, word) AS r FROM met) WHERE r <= 20),
hit AS (SELECT DISTINCT query_id, w.id AS chunk_id FROM kw JOIN w USING (word))
SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS r FROM hit) WHERE r <= 50""")
def keyword_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Up to 50 chunks that mention one of the 20 most frequent keywords holding a word of a link's span."""
    q = load(spark, d, "linking_gold").where("pair_id IS NOT NULL").groupBy(F.col("pair_id").alias("query_id")).agg(F.max("gold_span").alias("span"))
    terms = q.select("query_id", F.explode(T.latin_words(F.col("span"))).alias("term"))
    mentions = chunks_now(spark, d, ["text"]).select(F.col("id").alias("chunk_id"), F.explode(T.latin_words(F.col("text"))).alias("word"))
    return search.by_keyword(terms, mentions, "query_id", "chunk_id", "word", 20, 50)


@query("""SELECT b.id, CASE tier WHEN 'primary' THEN CASE WHEN edition = '疏議' THEN 'primary_疏議' WHEN edition IN ('校點', '校訂', '箋解') THEN 'editorial_commentary' ELSE 'primary_source' END ELSE 'scholarly_interpretation' END AS badge
FROM (SELECT id, max(tier) AS tier, max(edition) AS edition FROM document_meta WHERE id IS NOT NULL GROUP BY 1) b""")
def evidence_badges(spark: SparkSession, d: str) -> DataFrame:
    b = load(spark, d, "document_meta").where("id IS NOT NULL").groupBy("id").agg(F.max("tier").alias("tier"), F.max("edition").alias("edition"))
    return b.select("id", search.badge(F.col("tier"), F.col("edition")).alias("badge"))


@query(f"""WITH {CHUNKS}, {PAGES}, {BOOKS} SELECT c.id, md5(CASE WHEN length(concat_ws('·', nullif(b.title, ''), nullif(p.chapterId, ''))) > 0 THEN '《' || concat_ws('·', nullif(b.title, ''), nullif(p.chapterId, '')) || '》' || chr(10) ELSE '' END || coalesce(c.text, '')) AS print
FROM chunk_now c LEFT JOIN page_now p ON c.pageId = p.id LEFT JOIN book b ON p.documentId = b.id""")
def rerank_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk under the header by which a reranker sees where it stands."""
    p = pages_now(spark, d, ["documentId", "chapterId"]).select(F.col("id").alias("pageId"), "documentId", "chapterId")
    b = books(spark, d).select(F.col("id").alias("documentId"), "title")
    rows = chunks_now(spark, d, ["pageId", "text"]).join(p, "pageId", "left").join(b, "documentId", "left")
    return rows.select("id", F.md5(search.header(F.col("title"), F.col("chapterId"), F.lit(None).cast("int"), F.col("text"))).alias("print"))


@query(f"""WITH {CHUNKS}, w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS word FROM chunk_now), f AS (SELECT word FROM w GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8)
SELECT a.id AS a, b.id AS b, count(*) AS weight FROM w a JOIN w b ON a.word = b.word AND a.id < b.id WHERE a.word IN (SELECT word FROM f) GROUP BY 1, 2""")
def chunk_projection(spark: SparkSession, d: str) -> DataFrame:
    words = chunks_now(spark, d, ["text"]).select("id", F.explode(T.latin_words(F.col("text"))).alias("word"))
    return graphs.projection(words, "id", "word", 2, 8)


@query("""WITH e AS (SELECT DISTINCT least(l_suppkey, l_partkey % 100 + 1) AS a, greatest(l_suppkey, l_partkey % 100 + 1) AS b FROM lineitem WHERE l_suppkey <> l_partkey % 100 + 1),
n AS (SELECT a, b, 1 AS w, a % 7 AS la, b % 7 AS lb FROM e), g AS (SELECT l, sum(w) AS d FROM (SELECT la AS l, w FROM n UNION ALL SELECT lb, w FROM n) GROUP BY 1)
SELECT round((SELECT sum(w) FILTER (la = lb) FROM n) / (SELECT sum(w) FROM n) - (SELECT sum(CAST(d AS DOUBLE) * d) FROM g) / pow(2.0 * (SELECT sum(w) FROM n), 2), 9) AS modularity""")
def modularity(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("l_suppkey"), F.col("l_partkey") % 100 + 1
    e = load(spark, d, "lineitem").where(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct().withColumn("weight", F.lit(1))
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return graphs.modularity(e, nodes.withColumn("label", F.col("node") % 7))


@query()
def communities(spark: SparkSession, d: str) -> DataFrame:
    return graphs.communities(chunk_projection(spark, d), resolution=3.0, least=5)


@query("""WITH RECURSIVE e AS (SELECT secondary_chunk_id AS a, unnest(primary_chunk_ids) AS b FROM linking_gold WHERE secondary_chunk_id <> ''), u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
r AS (SELECT x AS node, x AS label FROM u UNION SELECT u.y, r.label FROM r JOIN u ON u.x = r.node) SELECT node, min(label) AS label FROM r GROUP BY 1""")
def link_components(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "linking_gold").where("secondary_chunk_id <> ''").select(F.col("secondary_chunk_id").alias("a"), F.explode("primary_chunk_ids").alias("b"))
    return graphs.components(e)


_IR = f"""{_RRF}, rel AS (SELECT DISTINCT query_id, chunk_id FROM best WHERE leg = 'rerank' AND s > 0), head AS (SELECT query_id, chunk_id, place FROM topped WHERE place <= 10), n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
f AS (SELECT query_id, sum(1.0 / log2(place + 1.0)) AS dcg, count(*) AS hits, min(place) AS first FROM head JOIN rel USING (query_id, chunk_id) GROUP BY 1), got AS (SELECT query_id, count(*) AS got FROM head GROUP BY 1),
m AS (SELECT query_id, round(coalesce(dcg / (SELECT sum(1.0 / log2(i + 1.0)) FROM (SELECT unnest(range(1, 1 + least(n, 10))) AS i)), 0), 6) AS ndcg, round(coalesce(hits / n, 0), 6) AS recall, round(coalesce(hits / least(10, got), 0), 6) AS precision, round(coalesce(1.0 / first, 0), 6) AS mrr
  FROM n LEFT JOIN f USING (query_id) LEFT JOIN got USING (query_id))"""


def _ir(spark: SparkSession, d: str) -> DataFrame:
    rel = _hits(spark, d).where("leg = 'rerank' AND score > 0 AND NOT isnan(score)").select("query_id", "chunk_id").distinct()
    return metrics.ir_metrics(_fused(spark, d), rel, "query_id", "chunk_id", "place", 10)


@query(f"WITH {_IR} SELECT * FROM m")
def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _ir(spark, d)


@query(f"""WITH {_IR}, q AS (SELECT query_id, max(language) AS language FROM search_hit GROUP BY 1) SELECT coalesce(language, '(all)') AS language, round(avg(ndcg), 5) AS ndcg, round(avg(mrr), 5) AS mrr, count(*) AS n FROM m JOIN q USING (query_id) GROUP BY GROUPING SETS ((language), ())""")
def ir_slices(spark: SparkSession, d: str) -> DataFrame:
    lang = _hits(spark, d).groupBy("query_id").agg(F.max("language").alias("language"))
    joined = _ir(spark, d).join(lang, "query_id")
    return joined.groupingSets([[F.col("language")], []], F.col("language")).agg(F.round(F.avg("ndcg"), 5).alias("ndcg"), F.round(F.avg("mrr"), 5).alias("mrr"), F.count(F.lit(1)).alias("n")).withColumn(
        "language", F.coalesce("language", F.lit("(all)"))
    )


@query(f"""WITH {_IR}, v AS (SELECT row_number() OVER (ORDER BY query_id, ndcg) - 1 AS i, ndcg AS v FROM m), c AS (SELECT count(*) AS n FROM v),
t AS (SELECT r, avg(v.v) AS m FROM (SELECT r, ('0x' || substr(sha1(r || ':' || j), 1, 8))::BIGINT % n AS i FROM (SELECT unnest(range(0, 500)) AS r), c, (SELECT unnest(range(0, (SELECT n FROM c))) AS j)) d JOIN v USING (i) GROUP BY 1)
SELECT (SELECT n FROM c) AS n, round((SELECT avg(v) FROM v), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM t""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bootstrap(_ir(spark, d), "query_id", "ndcg", 500)


@query(f"""WITH {CHUNKS}, g AS (SELECT DISTINCT pair_id, secondary_chunk_id AS a, unnest(primary_chunk_ids) AS b FROM linking_gold WHERE secondary_chunk_id <> ''), w AS (SELECT count(*) AS n FROM g),
f AS (SELECT count(*) AS n FROM g JOIN chunk_now x ON x.id = a JOIN chunk_now y ON y.id = b) SELECT w.n AS wanted, f.n AS found, round(CASE WHEN f.n > 0 THEN 2.0 * f.n / (f.n + w.n) ELSE 0 END, 6) AS f1 FROM w, f""")
def linking_f1(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d, "linking_gold").where("secondary_chunk_id <> ''").select("pair_id", F.col("secondary_chunk_id").alias("a"), F.explode("primary_chunk_ids").alias("b")).distinct()
    c = chunks_now(spark, d, []).select("id")
    seen = g.join(c.toDF("a").withColumn("fa", F.lit(1)), "a", "left").join(c.toDF("b").withColumn("fb", F.lit(1)), "b", "left")
    n = seen.agg(F.count(F.lit(1)).alias("wanted"), F.count_if(F.col("fa").isNotNull() & F.col("fb").isNotNull()).alias("found"))
    return n.select("wanted", "found", F.round(metrics.f1(F.col("found"), F.col("found"), F.col("wanted")), 6).alias("f1"))


@query(f"""WITH {PAGES}, {CHUNKS}, i AS (SELECT pageId AS id, count(*) AS impact FROM chunk_now GROUP BY 1), f AS (SELECT page_id AS id, max(agreement_rate) AS agreement FROM fuse_outcome GROUP BY 1),
j AS (SELECT p.id, p.tier, coalesce(impact, 0) AS impact, agreement FROM page_now p LEFT JOIN i USING (id) LEFT JOIN f USING (id) WHERE p.mode = 'scan'),
s AS (SELECT id, impact, round(0.4 * (1 - coalesce(agreement, 0)) + 0.4 * CASE WHEN max(impact) OVER () > 0 THEN impact / max(impact) OVER () ELSE 0 END + 0.2 * CASE WHEN tier = 'primary' THEN 1.0 ELSE 0.3 END, 6) AS priority FROM j)
SELECT id, impact, priority FROM s ORDER BY priority DESC, id LIMIT 100""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    impact = chunks_now(spark, d, ["pageId"]).groupBy(F.col("pageId").alias("id")).agg(F.count(F.lit(1)).alias("impact"))
    agreed = load(spark, d, "fuse_outcome").groupBy(F.col("page_id").alias("id")).agg(F.max("agreement_rate").alias("agreement"))
    rows = pages_now(spark, d, ["tier", "mode"]).where("mode = 'scan'").join(impact, "id", "left").join(agreed, "id", "left").withColumn("impact", F.coalesce("impact", F.lit(0)))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("impact").alias("most"))))  # one row
    score = metrics.priority(F.col("agreement"), F.lit(None).cast("double"), F.col("impact"), F.col("most"), F.col("tier"))
    return rows.select("id", "impact", score.alias("priority")).orderBy(F.desc("priority"), "id").limit(100)


@query(f"""WITH {_BEST}, a AS (SELECT query_id, list_sort(list(chunk_id) FILTER (leg = 'bm25')) AS x, list_sort(list(chunk_id) FILTER (leg = 'dense')) AS y FROM best GROUP BY 1)
SELECT query_id, len(list_intersect(x, y)) AS both, len(x) - len(list_intersect(x, y)) AS only_bm25 FROM a WHERE x IS NOT NULL AND y IS NOT NULL""")
def leg_overlap(spark: SparkSession, d: str) -> DataFrame:
    best = _hits(spark, d).where("score IS NOT NULL AND NOT isnan(score)").select("query_id", "leg", "chunk_id").distinct()
    x, y = (best.where(F.col("leg") == leg).select("query_id", "chunk_id") for leg in ("bm25", "dense"))
    both = x.join(y, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("both"))
    size = x.join(y.select("query_id").distinct(), "query_id", "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return size.join(both, "query_id", "left").select("query_id", F.coalesce("both", F.lit(0)).alias("both"), (F.col("n") - F.coalesce("both", F.lit(0))).alias("only_bm25"))


@query("""SELECT id, round(CASE WHEN tier = 'primary' THEN 1.0 ELSE 0.7 END * CASE WHEN contains(coalesce(edition, ''), '箋解') THEN 0.9 ELSE 1.0 END, 3) AS trust, CASE WHEN tier = 'primary' THEN 'source' WHEN tier = 'secondary' THEN 'study' ELSE 'unknown' END AS badge FROM (SELECT id, max(tier) AS tier, max(edition) AS edition FROM document_meta GROUP BY 1)""")
def trust_badges(spark: SparkSession, d: str) -> DataFrame:
    b = load(spark, d, "document_meta").where("id IS NOT NULL").groupBy("id").agg(F.max("tier").alias("tier"), F.max("edition").alias("edition"))
    badge = F.when(F.col("tier") == "primary", "source").when(F.col("tier") == "secondary", "study").otherwise("unknown")
    return b.select("id", search.trust(F.col("tier"), F.coalesce("edition", F.lit(""))).alias("trust"), badge.alias("badge"))


@query("""WITH h AS (SELECT * FROM search_hit WHERE searched_at IS NOT NULL) SELECT query_id, leg, count(*) AS n, min(searched_at) AS first, max(searched_at) AS last FROM h GROUP BY 1, 2""")
def hit_times(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d).where("searched_at IS NOT NULL")
    return h.groupBy("query_id", "leg").agg(F.count(F.lit(1)).alias("n"), F.min("searched_at").alias("first"), F.max("searched_at").alias("last"))


@query("""SELECT b.id, b.title, count(DISTINCT h.query_id) AS queries FROM (SELECT id, max(title) AS title FROM document_meta GROUP BY 1) b LEFT JOIN search_hit h ON h.document_id = b.id GROUP BY 1, 2""")
def books_hit(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d).select(F.col("document_id").alias("id"), "query_id").distinct().groupBy("id").agg(F.count("query_id").alias("queries"))
    return books(spark, d).select("id", "title").join(h, "id", "left").select("id", "title", F.coalesce("queries", F.lit(0)).alias("queries"))
