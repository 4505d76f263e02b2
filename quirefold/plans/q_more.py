"""Queries of filters, contents, checks, reports and stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import metadata, rules
from quirefold.functions import text as T
from quirefold.operators import census, filters, metrics, providers, search, spine, structure
from quirefold.plans.q_corpus import books, chunks_now, pages_now
from quirefold.plans.q_search import _IR, _ir
from quirefold.plans.registry import BOOKS, CHUNKS, PAGES, query
from quirefold.tables import load


@query(f"""WITH {PAGES} SELECT id, docPageIndex FROM page_now WHERE mode = 'scan' AND fusionStatus IN ('ok', 'single') AND docPageIndex >= 3 AND contains(textFused, 'the') ORDER BY documentId, docPageIndex, id""")
def filtered_pages(spark: SparkSession, d: str) -> DataFrame:
    """A request with some of its parameters given, in the order of the pages."""
    known = {"mode": "mode =", "tier": "tier =", "status": "fusionStatus in", "from": "docPageIndex >=", "to": "docPageIndex <=", "words": "textFused contains"}
    wanted = filters.requested({"mode": "scan", "tier": None, "status": ["ok", "single"], "from": 3, "to": "", "words": "the"}, known)
    p = pages_now(spark, d, ["documentId", "mode", "tier", "fusionStatus", "docPageIndex", "textFused"])
    return p.where(wanted & filters.given(language=None)).orderBy("documentId", "docPageIndex", "id").select("id", "docPageIndex")


@query("""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '([a-z]{6,})', 1)) AS term FROM eval_item), w AS (SELECT DISTINCT lower(p_name) AS name FROM part)
SELECT name, EXISTS (SELECT 1 FROM t WHERE contains(name, term)) AS held FROM w""")
def names_holding_terms(spark: SparkSession, d: str) -> DataFrame:
    """Names that hold any term of the held-out passages (a bounded array of terms)."""
    terms = load(spark, d, "eval_item").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"), F.lit(1))).alias("t")).agg(F.collect_set("t").alias("terms"))
    names = load(spark, d, "part").select(F.lower("p_name").alias("name")).distinct()
    return names.crossJoin(F.broadcast(terms)).select("name", filters.holds_any(F.col("name"), F.col("terms")).alias("held"))


@query(f"""WITH {PAGES}, p AS (SELECT documentId, docPageIndex AS pos, 'OEBPS/text/ch' || docPageIndex || '.xhtml' AS href FROM page_now WHERE docPageIndex IS NOT NULL AND documentId IS NOT NULL),
f AS (SELECT documentId, href, min(pos) AS pos FROM p GROUP BY 1, 2), l AS (SELECT DISTINCT documentId, CASE pos % 5 WHEN 0 THEN href WHEN 1 THEN href || '#sec' WHEN 2 THEN 'text/ch' || pos || '.xhtml' WHEN 3 THEN '../' || href ELSE 'none' || pos || '.html' END AS href FROM p),
m AS (SELECT l.*, CASE WHEN l.href = f.href THEN 'exact' WHEN split_part(l.href, '#', 1) = f.href THEN 'bare' ELSE 'end' END AS how, pos FROM l JOIN f ON l.documentId = f.documentId AND (split_part(l.href, '#', 1) = f.href OR ends_with(f.href, l.href) OR ends_with(l.href, f.href)))
SELECT documentId, href, arg_min(pos, (CASE how WHEN 'exact' THEN 0 WHEN 'bare' THEN 1 ELSE 2 END, pos)) AS "at", arg_min(how, (CASE how WHEN 'exact' THEN 0 WHEN 'bare' THEN 1 ELSE 2 END, pos)) AS how FROM m GROUP BY 1, 2""")
def href_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Links of contents, written for every page as packages write them, led back to the pages."""
    at = F.col("docPageIndex")
    p = pages_now(spark, d, ["documentId", "docPageIndex"]).where("docPageIndex IS NOT NULL AND documentId IS NOT NULL").select("documentId", at.alias("at"), F.format_string("OEBPS/text/ch%d.xhtml", at).alias("href"))
    n, a = F.col("at") % 5, F.col("at").cast("string")
    link = F.when(n == 0, F.col("href")).when(n == 1, F.concat("href", F.lit("#sec"))).when(n == 2, F.concat(F.lit("text/ch"), a, F.lit(".xhtml"))).when(n == 3, F.concat(F.lit("../"), "href")).otherwise(F.concat(F.lit("none"), a, F.lit(".html")))
    links = p.select("documentId", link.alias("href")).distinct()
    return structure.resolved(links, p, "documentId", "href", "at").select("documentId", "href", "at", "how")


@query(f"""WITH {PAGES}, e AS (SELECT documentId, CASE WHEN docPageIndex % 8 = 0 THEN 1 ELSE 2 END AS level, 'T' || docPageIndex AS title, greatest(docPageIndex - 1, 0) AS first FROM page_now WHERE docPageIndex % 4 = 0 AND documentId IS NOT NULL),
n AS (SELECT documentId, max(docPageIndex) + 1 AS n FROM page_now WHERE documentId IS NOT NULL GROUP BY 1),
o AS (SELECT e.*, n, greatest(1, sum(CASE WHEN level <= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY e.documentId ORDER BY first, level, title ROWS UNBOUNDED PRECEDING)) AS chapter_no, greatest(first, coalesce(lead(first) OVER (PARTITION BY e.documentId ORDER BY first, level, title) - 1, n - 1)) AS last FROM e JOIN n USING (documentId))
SELECT documentId, chapter_no, row_number() OVER (PARTITION BY documentId, chapter_no ORDER BY first, level, title) AS section_no, title, first, last FROM o
UNION ALL SELECT documentId, 1, 1, 'all', 0, greatest(0, n - 1) FROM n ANTI JOIN e USING (documentId)""")
def contents_outline(spark: SparkSession, d: str) -> DataFrame:
    """A table of contents, made of every fourth page, laid out as chapters and sections."""
    p = pages_now(spark, d, ["documentId", "docPageIndex"]).where("documentId IS NOT NULL")
    entries = p.where("docPageIndex % 4 = 0").select("documentId", F.when(F.col("docPageIndex") % 8 == 0, 1).otherwise(2).alias("level"), F.concat(F.lit("T"), F.col("docPageIndex").cast("string")).alias("title"), (F.col("docPageIndex") - 1).alias("at"))
    n = p.groupBy("documentId").agg((F.max("docPageIndex") + 1).alias("n"))
    return structure.outline(entries, "documentId", "level", "title", "at", n)


@query(f"""WITH {CHUNKS}, {PAGES}, {BOOKS} SELECT c.id, coalesce(p.documentId, c.documentId) AS book, b.title FROM chunk_now c LEFT JOIN page_now p ON p.id = c.pageId LEFT JOIN book b ON b.id = coalesce(p.documentId, c.documentId)""")
def alternative_paths(spark: SparkSession, d: str) -> DataFrame:
    """The book of every chunk, by its page or else by its own column."""
    p = pages_now(spark, d, ["documentId"]).select(F.col("id").alias("pageId"), F.col("documentId").alias("_p"))
    c = chunks_now(spark, d, ["pageId", "documentId"]).join(p, "pageId", "left").select("id", F.coalesce("_p", "documentId").alias("book"))
    return c.join(books(spark, d).select(F.col("id").alias("book"), "title"), "book", "left").select("id", "book", "title")


@query(f"""WITH {CHUNKS}, {PAGES}, {BOOKS} SELECT c.id, b.id AS book FROM chunk_now c JOIN page_now p ON p.id = c.pageId JOIN book b ON b.id = p.documentId WHERE b.tier = 'primary'""")
def tier_path(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of primary sources, by the whole path from chunk to book."""
    p = pages_now(spark, d, ["documentId", "sectionId", "chapterId", "docPageIndex"])
    return spine.walk(chunks_now(spark, d, ["pageId"]), p, books(spark, d)).where("bookTier = 'primary'").select("id", "book")


@query(f"""WITH {CHUNKS}, h AS (SELECT query_id, chunk_id, max(score) AS score FROM search_hit WHERE score IS NOT NULL AND CAST(score AS VARCHAR) NOT IN ('nan', '-nan') GROUP BY 1, 2) SELECT h.query_id, h.chunk_id, h.score, c.pageId, coalesce(length(c.text), 0) AS chars FROM h JOIN chunk_now c ON c.id = h.chunk_id""")
def hit_rows(spark: SparkSession, d: str) -> DataFrame:
    """Hits with the rows they stand for; hits of chunks that are gone are dropped."""
    h = load(spark, d, "search_hit").where("NOT isnan(score)").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    c = chunks_now(spark, d, ["pageId", "text"]).select(F.col("id").alias("chunk_id"), "pageId", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("chars"))
    return h.join(c, "chunk_id").select("query_id", "chunk_id", "score", "pageId", "chars")


@query(f"""WITH {CHUNKS}, {PAGES}, {BOOKS} SELECT 'chunk' AS level, count(*) AS missing FROM chunk_now WHERE pageId IS NOT NULL AND pageId NOT IN (SELECT id FROM page_now WHERE id IS NOT NULL)
UNION ALL SELECT 'page', count(*) FROM page_now WHERE documentId IS NOT NULL AND documentId NOT IN (SELECT id FROM book WHERE id IS NOT NULL)
UNION ALL SELECT 'link', count(*) FROM (SELECT DISTINCT secondary_chunk_id AS c FROM linking_gold WHERE secondary_chunk_id <> '') WHERE c NOT IN (SELECT id FROM chunk_now WHERE id IS NOT NULL)""")
def plan_check(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of each level name a parent that doesn't exist; a plan is written only where it is none."""
    c, p = chunks_now(spark, d, ["pageId"]), pages_now(spark, d, ["documentId"])
    links = load(spark, d, "linking_gold").where("secondary_chunk_id <> ''").select("secondary_chunk_id").distinct()
    levels = {"chunk": structure.orphans(c, "pageId", p, "id"), "page": structure.orphans(p, "documentId", books(spark, d), "id"), "link": structure.orphans(links, "secondary_chunk_id", c, "id")}
    counts = [df.agg(F.lit(n).alias("level"), F.count(F.lit(1)).alias("missing")) for n, df in levels.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(f"""WITH {PAGES} SELECT documentId, count(*) AS pages, round(avg(CASE WHEN docPageIndex < 20 THEN CASE WHEN mode = 'native' THEN 1.0 ELSE 0.0 END END), 4) AS native_share, round(avg(CASE WHEN docPageIndex < 20 THEN coalesce(length(textFused), 0) END), 2) AS mean_chars FROM page_now GROUP BY 1""")
def source_summary(spark: SparkSession, d: str) -> DataFrame:
    return structure.source_summary(pages_now(spark, d, ["documentId", "docPageIndex", "mode", "textFused"]), "documentId", "docPageIndex", "mode", "textFused")


@query(f"""WITH {BOOKS}, {PAGES}, f AS (SELECT b.id, coalesce(length(b.sourcePath), 0) AS size FROM book b WHERE b.id IS NOT NULL), h AS (SELECT DISTINCT documentId AS id FROM page_now WHERE docPageIndex > 60),
o AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM f ANTI JOIN h USING (id) WHERE size > 0) SELECT f.id, size, CASE WHEN h.id IS NOT NULL THEN 'skipped' WHEN size <= 0 THEN 'failed' WHEN n > 5 THEN 'beyond' ELSE 'would-ingest' END AS status FROM f LEFT JOIN h USING (id) LEFT JOIN o USING (id)""")
def ingest_plan(spark: SparkSession, d: str) -> DataFrame:
    """What a dry run would take in of all books, at most five, where long books are held already."""
    found = books(spark, d).select("id", F.coalesce(F.length("sourcePath"), F.lit(0)).alias("size"))
    held = pages_now(spark, d, ["documentId", "docPageIndex"]).where("docPageIndex > 60").select(F.col("documentId").alias("id"))
    return structure.ingest_plan(found, "id", "size", held, 5, True)


@query("""SELECT c_custkey AS "cCustkey", c_name AS "cName", c_mktsegment AS "cMktsegment" FROM customer""")
def camel_columns(spark: SparkSession, d: str) -> DataFrame:
    return filters.camel_keys(load(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"))


@query("""WITH u AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'plain.txt' ELSE 'minio://pages-' || doc_id % 3 || '/a/' || doc_id || ['.PNG', '.jpg', '.bin'][doc_id % 3 + 1] END AS uri FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN 'pages-' || doc_id % 3 END AS bucket, CASE WHEN doc_id % 4 <> 0 THEN 'a/' || doc_id || ['.PNG', '.jpg', '.bin'][doc_id % 3 + 1] END AS key, CASE WHEN doc_id % 4 = 0 THEN 'text/plain' ELSE ['image/png', 'image/jpeg', 'application/octet-stream'][doc_id % 3 + 1] END AS kind FROM u""")
def uri_parts(spark: SparkSession, d: str) -> DataFrame:
    """The parts of an object's address, written for every document."""
    n, end = F.col("doc_id").cast("string"), F.get(F.array(F.lit(".PNG"), F.lit(".jpg"), F.lit(".bin")), (F.col("doc_id") % 3).cast("int"))
    uri = F.when(F.col("doc_id") % 4 == 0, "plain.txt").otherwise(F.concat(F.lit("minio://pages-"), (F.col("doc_id") % 3).cast("string"), F.lit("/a/"), n, end))
    u = load(spark, d, "documents").select("doc_id", uri.alias("u"), filters.uri_parts(uri).alias("p"))
    return u.select("doc_id", "p.bucket", "p.key", filters.content_type(F.col("u")).alias("kind"))


_FULL = "coalesce(length(trim({c}, ' ')), 0) > 0"
_MEASURES = {
    "native": "mode = 'native'", "scan": "mode = 'scan'", "with_text": _FULL.format(c="text"), "with_fused": _FULL.format(c="textFused"), "fused_ok": "fusionStatus = 'ok'", "fused_single": "fusionStatus = 'single'", "fused_failed": "fusionStatus = 'failed'",
    "unfused": "fusionStatus IS NULL", "with_language": "language IS NOT NULL", "sure_language": "langConfidence >= 0.8", "paddle": _FULL.format(c="paddleOcrText"), "deepseek": _FULL.format(c="deepseekOcrText"), "qwen": _FULL.format(c="qwenVlOcrText"),
    "in_section": "sectionId IS NOT NULL", "in_chapter": "chapterId IS NOT NULL",
}
_CHUNK_MEASURES = {
    "with_text": _FULL.format(c="text"), "with_vector": "embedding IS NOT NULL", "embedded_ok": "embeddingStatus = 'ok'", "embedded_failed": "embeddingStatus = 'failed'", "pending": "embeddingStatus IS NULL", "with_language": "language IS NOT NULL",
    "primary": "tier = 'primary'", "secondary": "tier = 'secondary'", "sliding": "chunkStrategy = 'sliding'", "markdown": "chunkStrategy = 'markdown'", "long": "charCount > chunkSize",
}


def _measures_sql(table: str, label: str, measures: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{label}' AS label, '{n}' AS measure, count(*) FILTER ({c}) AS n, round(100.0 * count(*) FILTER ({c}) / greatest(count(*), 1), 1) AS pct FROM {table}" for n, c in measures.items())


@query(f"WITH {PAGES}, {CHUNKS} {_measures_sql('page_now', 'page', _MEASURES)} UNION ALL {_measures_sql('chunk_now', 'chunk', _CHUNK_MEASURES)}")
def corpus_audit(spark: SparkSession, d: str) -> DataFrame:
    """Fifteen measures of pages and eleven of chunks, with their shares."""
    p = pages_now(spark, d, ["mode", "text", "textFused", "fusionStatus", "language", "langConfidence", "paddleOcrText", "deepseekOcrText", "qwenVlOcrText", "sectionId", "chapterId"])
    c = chunks_now(spark, d, ["text", "embedding", "embeddingStatus", "language", "tier", "chunkStrategy", "charCount", "chunkSize"])
    plain = lambda x: x.replace(", ' ')", ")")
    out = []
    for label, df, measures in (("page", p, _MEASURES), ("chunk", c, _CHUNK_MEASURES)):
        wide = census.conditional_counts(df, {n: F.expr(plain(m)) for n, m in measures.items()})
        rows = wide.unpivot(["rows"], list(measures), "measure", "n")
        out.append(rows.select(F.lit(label).alias("label"), "measure", "n", census.percent(F.col("n"), F.col("rows")).alias("pct")))
    return out[0].unionByName(out[1])


@query(f"""WITH {CHUNKS}, w AS (SELECT id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS word FROM chunk_now), f AS (SELECT word, count(*) AS n, CASE WHEN regexp_matches(word, '^[0-9]+$') THEN 'number' WHEN regexp_matches(word, '[0-9]') THEN 'mixed' ELSE 'word' END AS kind FROM w GROUP BY 1)
SELECT 'top' AS part, word AS name, n FROM (SELECT * FROM f ORDER BY n DESC, word LIMIT 20) UNION ALL SELECT 'kind', kind, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'status', coalesce(embeddingStatus, '(unset)'), count(*) FROM chunk_now GROUP BY 2""")
def keyword_summary(spark: SparkSession, d: str) -> DataFrame:
    """The twenty keywords most often mentioned, keywords by kind, chunks by status."""
    c = chunks_now(spark, d, ["text", "embeddingStatus"])
    f = c.select(F.explode(T.latin_words(F.col("text"))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("name").rlike("^[0-9]+$"), "number").when(F.col("name").rlike("[0-9]"), "mixed").otherwise("word")
    parts = {"top": f.orderBy(F.desc("n"), "name").limit(20), "kind": f.groupBy(kind.alias("name")).agg(F.count(F.lit(1)).alias("n")), "status": c.groupBy(F.coalesce("embeddingStatus", F.lit("(unset)")).alias("name")).agg(F.count(F.lit(1)).alias("n"))}
    rows = [df.select(F.lit(p).alias("part"), "name", "n") for p, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("""WITH f AS (SELECT DISTINCT page_id, status, winner_llm, single_engine, language FROM fuse_outcome)
SELECT 'language' AS by, coalesce(language, '(unset)') AS value, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'status', coalesce(status, '(unset)'), count(*) FROM f GROUP BY 2
UNION ALL SELECT 'winner', coalesce(winner_llm, '(none)'), count(*) FROM f GROUP BY 2 UNION ALL SELECT 'single', coalesce(single_engine, '(none)'), count(*) FROM f GROUP BY 2""")
def run_report(spark: SparkSession, d: str) -> DataFrame:
    """The counters of a fusion run by language, status, winner and lone engine, in one pass."""
    f = load(spark, d, "fuse_outcome").select("page_id", "status", "winner_llm", "single_engine", "language").distinct()
    named = f.select(F.coalesce("language", F.lit("(unset)")).alias("language"), F.coalesce("status", F.lit("(unset)")).alias("status"), F.coalesce("winner_llm", F.lit("(none)")).alias("winner"), F.coalesce("single_engine", F.lit("(none)")).alias("single"))
    return named.unpivot([], ["language", "status", "winner", "single"], "by", "value").groupBy("by", "value").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PAGES}, s AS (SELECT documentId, CASE WHEN error IS NOT NULL THEN 'failed' WHEN coalesce(fused_chars, 0) > 0 THEN 'ok' ELSE 'empty' END AS st FROM (SELECT DISTINCT page_id, error, fused_chars FROM fuse_outcome) f JOIN page_now p ON p.id = f.page_id)
SELECT documentId, count(*) FILTER (st = 'ok') AS ok, count(*) FILTER (st = 'empty') AS empty, count(*) FILTER (st = 'failed') AS failed FROM s GROUP BY 1""")
def layout_counters(spark: SparkSession, d: str) -> DataFrame:
    """How many outcomes of each status every book has."""
    f = load(spark, d, "fuse_outcome").select(F.col("page_id").alias("id"), "error", "fused_chars").distinct()
    return structure.status_counts(pages_now(spark, d, ["documentId"]).join(f, "id"), "documentId", rules.layout_status(F.col("fused_chars"), F.col("error")), ["ok", "empty", "failed"])


@query(f"""WITH {PAGES}, {CHUNKS}, s(stage, done, total, seconds) AS (SELECT 'fusion', count(*) FILTER (fusionStatus IN ('ok', 'single')), count(*), 1000.0 FROM page_now UNION ALL SELECT 'language', count(*) FILTER (language IS NOT NULL), count(*), 500.0 FROM page_now
UNION ALL SELECT 'embedding', count(*) FILTER (embedding IS NOT NULL), count(*), 2000.0 FROM chunk_now UNION ALL SELECT 'links', 0, count(*), 10.0 FROM linking_gold)
SELECT stage, done, total, CASE WHEN total > 0 THEN round(100.0 * done / total, 2) ELSE 0 END AS pct, CASE WHEN done > 0 AND done < total THEN CAST(floor((total - done) / (done / seconds)) AS BIGINT) END AS eta FROM s""")
def stage_progress(spark: SparkSession, d: str) -> DataFrame:
    """How far each stage is and how many seconds it has yet to run, by the seconds it has run."""
    p, c = pages_now(spark, d, ["fusionStatus", "language"]), chunks_now(spark, d, ["embedding"])
    stage = lambda n, df, done, s: df.agg(F.lit(n).alias("stage"), F.count_if(done).alias("done"), F.count(F.lit(1)).alias("total"), F.lit(s).alias("seconds"))
    rows = stage("fusion", p, F.col("fusionStatus").isin("ok", "single"), 1000.0).unionByName(stage("language", p, F.col("language").isNotNull(), 500.0))
    rows = rows.unionByName(stage("embedding", c, F.col("embedding").isNotNull(), 2000.0)).unionByName(stage("links", load(spark, d, "linking_gold"), F.lit(False), 10.0))
    done = metrics.progress(F.col("done"), F.col("total"), F.col("seconds"))
    return rows.select("stage", "done", "total", *[x.alias(n) for n, x in done.items()])


@query(f"""WITH {_IR}, {CHUNKS}, q AS (SELECT query_id, max(language) AS language, max(c.tier) AS tier FROM search_hit h LEFT JOIN chunk_now c ON c.id = h.chunk_id GROUP BY 1),
j AS (SELECT coalesce(q.language, '(unset)') AS language, coalesce(q.tier, '(unset)') AS tier, ndcg, mrr FROM m JOIN q USING (query_id))
SELECT language, tier, round(avg(ndcg), 5) AS ndcg, round(avg(mrr), 5) AS mrr, count(*) AS n FROM j GROUP BY GROUPING SETS ((), (tier), (language))""".replace("max(language)", "max(h.language)"))
def metric_slices(spark: SparkSession, d: str) -> DataFrame:
    """Mean metrics of all queries, by tier and by language."""
    tiers = chunks_now(spark, d, ["tier"]).select(F.col("id").alias("chunk_id"), "tier")
    q = load(spark, d, "search_hit").join(tiers, "chunk_id", "left").groupBy("query_id").agg(F.max("language").alias("language"), F.max("tier").alias("tier"))
    j = _ir(spark, d).join(q, "query_id").select(F.coalesce("language", F.lit("(unset)")).alias("language"), F.coalesce("tier", F.lit("(unset)")).alias("tier"), "ndcg", "mrr")
    return j.groupingSets([[], [F.col("tier")], [F.col("language")]], F.col("language"), F.col("tier")).agg(F.round(F.avg("ndcg"), 5).alias("ndcg"), F.round(F.avg("mrr"), 5).alias("mrr"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PAGES}, {CHUNKS}, c AS (SELECT (SELECT count(*) FROM page_now) AS pages, (SELECT count(*) FILTER (fusionStatus IN ('ok', 'single')) FROM page_now) AS fused, (SELECT count(*) FILTER (language IS NOT NULL) FROM page_now) AS labelled,
  (SELECT count(*) FILTER ({_FULL.format(c='textFused')}) FROM page_now) AS texts, (SELECT count(*) FROM chunk_now) AS chunks, (SELECT count(*) FILTER (embedding IS NOT NULL) FROM chunk_now) AS embedded, (SELECT count(*) FILTER (tier = 'primary') FROM chunk_now) AS primaries)
SELECT gate, a / greatest(b, 1) AS share, a >= least * b AS open FROM c, LATERAL (VALUES ('fusion', fused, pages, 0.9), ('language', labelled, texts, 0.8), ('chunk', texts, pages, 0.5), ('embed', embedded, chunks, 0.95), ('keywords', chunks, pages, 1.0), ('translate', primaries, chunks, 0.95)) g(gate, a, b, least)""")
def pipeline_gates(spark: SparkSession, d: str) -> DataFrame:
    """Which of six stages may run, by the counts of what they need."""
    p = pages_now(spark, d, ["fusionStatus", "language", "textFused"])
    pc = p.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("fusionStatus").isin("ok", "single")).alias("fused"), F.count("language").alias("labelled"), F.count_if(F.length(F.trim("textFused")) > 0).alias("texts"))
    cc = chunks_now(spark, d, ["embedding", "tier"]).agg(F.count(F.lit(1)).alias("chunks"), F.count("embedding").alias("embedded"), F.count_if(F.col("tier") == "primary").alias("primaries"))
    rules_ = {"fusion": ("fused", "pages", 0.9), "language": ("labelled", "texts", 0.8), "chunk": ("texts", "pages", 0.5), "embed": ("embedded", "chunks", 0.95), "keywords": ("chunks", "pages", 1.0), "translate": ("primaries", "chunks", 0.95)}
    return census.gates(pc.crossJoin(cc), rules_)


@query(f"""WITH {BOOKS}, n AS (SELECT id, trim(regexp_replace(regexp_replace(regexp_extract(sourcePath, '([^/]*)$', 1), '\\.[A-Za-z0-9]{{1,5}}$', ''), '^[ _.-]+|[ _.-]+$', '', 'g'), ' ') AS stem FROM book WHERE sourcePath IS NOT NULL),
y AS (SELECT *, regexp_extract_all(stem, '(?:1[0-9]{{3}}|20[0-2][0-9])') AS ys FROM n) SELECT id, stem, CASE WHEN len(ys) > 0 THEN CAST(ys[-1] AS INTEGER) END AS year FROM y""")
def edition_names(spark: SparkSession, d: str) -> DataFrame:
    """The stem of every book's file name and the last year in it."""
    b = books(spark, d).where("sourcePath IS NOT NULL")
    return b.select("id", metadata.stem(F.col("sourcePath")).alias("stem"), metadata.year_of(metadata.stem(F.col("sourcePath"))).alias("year"))


@query()
def citation_links(spark: SparkSession, d: str) -> DataFrame:
    """Quotations of secondary chunks led to the primary chunks that hold them: exact search by vector, then reranked, from 0.85 on."""
    c = chunks_now(spark, d, ["tier", "text"])
    spans = c.where("tier = 'secondary'").select(F.col("id").alias("citing"), F.posexplode(T.quoted_spans(F.col("text"))).alias("n", "span"))
    asked = spans.select(F.concat_ws("#", "citing", "n").alias("span_id"), "citing", "span")
    held = c.where("tier = 'primary'").select("id", "text")
    near = search.knn(providers.embed(held, "id", "text"), "id", "embedding", providers.embed(asked, "span_id", "span"), "span_id", 20)
    pairs = near.select(F.col("query").alias("span_id"), F.col("hit").alias("id")).join(asked, "span_id").join(held, "id")
    scored = providers.rerank(pairs, ["span_id", "citing", "id"], "span", "text").where("relevance >= 0.85")
    return scored.groupBy("citing", F.col("id").alias("cited")).agg(F.round(F.max("relevance"), 6).alias("score"), F.count(F.lit(1)).alias("spans")).where("citing <> cited")


@query()
def keyword_relations(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of all chunks by a provider, embedded, and the up to 50 others each is related to from a cosine of 0.85 on."""
    words = providers.extract(chunks_now(spark, d, ["text"]), "id", "text").select("id", F.explode("keywords").alias("name"))
    vectors = providers.embed(words.groupBy("name").agg(F.count(F.lit(1)).alias("n")), "name", "name")
    near = search.knn(vectors, "name", "embedding", vectors, "name", 50, 0.85)
    return near.select(F.col("query").alias("a"), F.col("hit").alias("b"), F.round("score", 6).alias("score"))
