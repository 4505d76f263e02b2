"""Queries over the corpus as a whole: census, spine, chunks, merges, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import dates as D
from quirefold.functions import text as T
from quirefold.operators import census, merge, ranking, spine
from quirefold.plans.registry import BOOKS, CHUNKS, PAGES, query
from quirefold.streaming import events as E
from quirefold.tables import latest, load


def pages_now(spark: SparkSession, d: str, cols: list[str]) -> DataFrame:
    return latest(load(spark, d, "page"), "id", "fusionAt", [c for c in dict.fromkeys([*cols, "fusionAt"]) if c != "id"])


def chunks_now(spark: SparkSession, d: str, cols: list[str]) -> DataFrame:
    return latest(load(spark, d, "chunk"), "id", "chunkingAt", [c for c in dict.fromkeys([*cols, "chunkingAt"]) if c != "id"])


def books(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "document_meta").where("id IS NOT NULL").groupBy("id").agg(*[F.max(c).alias(c) for c in ("tier", "title", "publicationYear", "sourcePath")])


@query(f"""WITH {PAGES}
SELECT count(*) AS rows, count(*) FILTER (mode = 'scan') AS scans, count(*) FILTER (mode = 'native') AS natives,
  count(*) FILTER (textFused IS NOT NULL AND length(textFused) > 0) AS fused, count(*) FILTER (fusionStatus = 'ok') AS fusion_ok,
  count(*) FILTER (language IS NULL) AS unlabelled, count(*) FILTER (paddleOcrText IS NOT NULL) AS paddle,
  count(*) FILTER (deepseekOcrText IS NOT NULL) AS deepseek, count(*) FILTER (qwenVlOcrText IS NOT NULL) AS qwen FROM page_now""")
def census_pages(spark: SparkSession, d: str) -> DataFrame:
    now = pages_now(spark, d, ["mode", "textFused", "fusionStatus", "language", "paddleOcrText", "deepseekOcrText", "qwenVlOcrText"])
    c = F.col
    return census.conditional_counts(
        now,
        {
            "scans": c("mode") == "scan", "natives": c("mode") == "native", "fused": F.length("textFused") > 0, "fusion_ok": c("fusionStatus") == "ok",
            "unlabelled": c("language").isNull(), "paddle": c("paddleOcrText").isNotNull(), "deepseek": c("deepseekOcrText").isNotNull(), "qwen": c("qwenVlOcrText").isNotNull(),
        },
    )


@query(f"""WITH {CHUNKS}
SELECT count(*) AS rows, count(*) FILTER (text IS NOT NULL AND length(trim(text)) > 0) AS texts, count(*) FILTER (embedding IS NOT NULL) AS embedded,
  count(*) FILTER (len(embedding) = 64) AS whole_vectors, count(*) FILTER (embeddingStatus = 'ok') AS status_ok,
  round(100.0 * count(*) FILTER (embedding IS NOT NULL) / greatest(count(*), 1), 1) AS embedded_pct FROM chunk_now""")
def census_chunks(spark: SparkSession, d: str) -> DataFrame:
    now = chunks_now(spark, d, ["text", "embedding", "embeddingStatus"])
    c = F.col
    counts = census.conditional_counts(
        now, {"texts": F.length(F.trim("text")) > 0, "embedded": c("embedding").isNotNull(), "whole_vectors": F.size("embedding") == 64, "status_ok": c("embeddingStatus") == "ok"}
    )
    return counts.withColumn("embedded_pct", census.percent(F.col("embedded"), F.col("rows")))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean_value,
  round(100.0 * count(*) FILTER (value > 50) / greatest(count(*), 1), 1) AS over_50_pct FROM events GROUP BY event_type""")
def census_events(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    return e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean_value"),
        census.percent(F.count_if(F.col("value") > 50), F.count(F.lit(1))).alias("over_50_pct"),
    )


@query("""SELECT 'page' AS label, count(*) AS n FROM page UNION ALL SELECT 'chunk', count(*) FROM chunk UNION ALL SELECT 'document', count(*) FROM document_meta
UNION ALL SELECT 'community', count(*) FROM community_result UNION ALL SELECT 'hit', count(*) FROM search_hit UNION ALL SELECT 'link', count(*) FROM linking_gold""")
def count_by_label(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for label, table in (("page", "page"), ("chunk", "chunk"), ("document", "document_meta"), ("community", "community_result"), ("hit", "search_hit"), ("link", "linking_gold")):
        one = load(spark, d, table).agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {PAGES}, named AS (SELECT coalesce(language, '(unset)') AS language, coalesce(tier, '(unset)') AS tier, coalesce(mode, '(unset)') AS mode FROM page_now)
SELECT language, tier, mode, count(*) AS n FROM named GROUP BY GROUPING SETS ((language, tier, mode), (language), (tier), ())""")
def language_sets(spark: SparkSession, d: str) -> DataFrame:
    return census.set_counts(pages_now(spark, d, ["language", "tier", "mode"]), ["language", "tier", "mode"], [["language", "tier", "mode"], ["language"], ["tier"], []])


@query("""WITH f AS (SELECT DISTINCT page_id, coalesce(status, '(unset)') AS status, coalesce(language, '(unset)') AS language, agreement_rate, duration_seconds FROM fuse_outcome)
SELECT status, language, count(*) AS n, round(sum(agreement_rate), 4) AS agreement, max(duration_seconds) AS seconds FROM f GROUP BY 1, 2""")
def fusion_summary(spark: SparkSession, d: str) -> DataFrame:
    f = load(spark, d, "fuse_outcome").select(
        "page_id", F.coalesce("status", F.lit("(unset)")).alias("status"), F.coalesce("language", F.lit("(unset)")).alias("language"), "agreement_rate", "duration_seconds"
    ).distinct()
    return f.groupBy("status", "language").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("agreement_rate"), 4).alias("agreement"), F.max("duration_seconds").alias("seconds")
    )


@query("""WITH f AS (SELECT DISTINCT page_id, status, language, agreement_rate FROM fuse_outcome), g AS (SELECT avg(agreement_rate) AS m FROM f GROUP BY status, language)
SELECT round(avg(m), 6) AS mean_of_means, count(m) AS groups FROM g""")
def fusion_mean_of_means(spark: SparkSession, d: str) -> DataFrame:
    f = load(spark, d, "fuse_outcome").select("page_id", "status", "language", "agreement_rate").distinct()
    return census.mean_of_means(f, ["status", "language"], "agreement_rate").withColumn("mean_of_means", F.round("mean_of_means", 6))


_STATUS = "CASE WHEN {c} IS NULL THEN 'missing' WHEN length(trim({c})) = 0 THEN 'empty' ELSE 'ok' END"


@query(f"""WITH {PAGES}, s AS (SELECT tier, {_STATUS.format(c='paddleOcrText')} AS paddle, {_STATUS.format(c='deepseekOcrText')} AS deepseek, {_STATUS.format(c='qwenVlOcrText')} AS qwen FROM page_now WHERE mode = 'scan')
SELECT tier, engine, status, count(*) AS n FROM (SELECT tier, 'paddle' AS engine, paddle AS status FROM s UNION ALL SELECT tier, 'deepseek', deepseek FROM s UNION ALL SELECT tier, 'qwen', qwen FROM s) GROUP BY ALL""")
def engine_status_melt(spark: SparkSession, d: str) -> DataFrame:
    status = lambda c: F.when(F.col(c).isNull(), "missing").when(F.length(F.trim(c)) == 0, "empty").otherwise("ok")
    now = pages_now(spark, d, ["tier", "mode", "paddleOcrText", "deepseekOcrText", "qwenVlOcrText"]).where("mode = 'scan'")
    return census.status_melt(now, "tier", {"paddle": status("paddleOcrText"), "deepseek": status("deepseekOcrText"), "qwen": status("qwenVlOcrText")})


@query(f"""WITH {PAGES} SELECT coalesce(tier, '(unset)') AS tier, count(*) FILTER (mode = 'scan') AS scan, count(*) FILTER (mode = 'native') AS native,
  round(100.0 * count(*) FILTER (mode = 'scan') / greatest(count(*), 1), 1) AS scan_pct FROM page_now GROUP BY 1""")
def mode_pivot(spark: SparkSession, d: str) -> DataFrame:
    now = pages_now(spark, d, ["tier", "mode"]).select(F.coalesce("tier", F.lit("(unset)")).alias("tier"), "mode")
    wide = now.groupBy("tier").pivot("mode", ["scan", "native"]).count().na.fill(0)
    return wide.withColumn("scan_pct", census.percent(F.col("scan"), F.col("scan") + F.col("native")))


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS word FROM documents WHERE text IS NOT NULL)
SELECT word, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, word LIMIT 20""")
def top_terms(spark: SparkSession, d: str) -> DataFrame:
    w = load(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.latin_words(F.col("text")))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(20)


@query(f"""WITH {CHUNKS}, w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS word FROM chunk_now)
SELECT word, count(*) AS n FROM w GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20""")
def keyword_frequency(spark: SparkSession, d: str) -> DataFrame:
    w = chunks_now(spark, d, ["text"]).select("id", F.explode(T.latin_words(F.col("text"))).alias("word"))
    return census.cut_counts(w, "id", "word", 2, 20)


@query(f"""WITH {CHUNKS}, w AS (SELECT DISTINCT documentId, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS word FROM chunk_now)
SELECT documentId, count(*) AS words, md5(string_agg(word, ' ' ORDER BY word)) AS print FROM w GROUP BY 1""")
def keywords_of_book(spark: SparkSession, d: str) -> DataFrame:
    """The different words of every book, in order."""
    w = chunks_now(spark, d, ["documentId", "text"]).select("documentId", F.explode(T.latin_words(F.col("text"))).alias("word"))
    words = F.array_sort(F.collect_set("word"))
    return w.groupBy("documentId").agg(F.size(words).cast("bigint").alias("words"), F.md5(F.concat_ws(" ", words)).alias("print"))


@query(f"""WITH {CHUNKS}, {PAGES}, {BOOKS}
SELECT c.id, b.title, b.tier AS book_tier, p.docPageIndex, '《' || concat_ws('·', b.title, p.chapterId, p.sectionId, 'p.' || (p.docPageIndex + 1)) || '》' AS place
FROM chunk_now c JOIN page_now p ON c.pageId = p.id LEFT JOIN book b ON p.documentId = b.id""")
def spine_join(spark: SparkSession, d: str) -> DataFrame:
    p = pages_now(spark, d, ["documentId", "sectionId", "chapterId", "docPageIndex"])
    walked = spine.walk(chunks_now(spark, d, ["pageId"]), p, books(spark, d))
    return walked.select("id", "title", F.col("bookTier").alias("book_tier"), "docPageIndex", spine.citation(F.col("title"), F.col("chapterId"), F.col("sectionId"), F.col("docPageIndex")).alias("place"))


@query(f"""WITH {CHUNKS}, {PAGES}, {BOOKS}
SELECT b.id, count(DISTINCT p.id) AS pages, count(DISTINCT c.id) AS chunks FROM book b LEFT JOIN page_now p ON p.documentId = b.id LEFT JOIN chunk_now c ON c.pageId = p.id GROUP BY 1""")
def spine_counts(spark: SparkSession, d: str) -> DataFrame:
    p = pages_now(spark, d, ["documentId"]).select(F.col("id").alias("pageId"), "documentId")
    per_page = chunks_now(spark, d, ["pageId"]).groupBy("pageId").agg(F.count(F.lit(1)).alias("c"))
    counts = p.join(per_page, "pageId", "left").groupBy("documentId").agg(F.count(F.lit(1)).alias("pages"), F.sum("c").alias("chunks"))
    return books(spark, d).select(F.col("id").alias("documentId")).join(counts, "documentId", "left").select(
        F.col("documentId").alias("id"), F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("chunks", F.lit(0)).alias("chunks")
    )


@query(f"""WITH {CHUNKS} SELECT id, documentId FROM chunk_now c WHERE EXISTS (SELECT 1 FROM search_hit h WHERE h.chunk_id = c.id AND h.leg = 'dense')""")
def semi_join_hits(spark: SparkSession, d: str) -> DataFrame:
    hit = load(spark, d, "search_hit").where("leg = 'dense'").select(F.col("chunk_id").alias("id"))
    return chunks_now(spark, d, ["documentId"]).join(hit, "id", "left_semi").select("id", "documentId")


@query(f"""WITH {CHUNKS}, {PAGES} SELECT id, documentId FROM page_now p WHERE NOT EXISTS (SELECT 1 FROM chunk_now c WHERE c.pageId = p.id)""")
def anti_join_pages(spark: SparkSession, d: str) -> DataFrame:
    done = load(spark, d, "chunk").where("id IS NOT NULL").select(F.col("pageId").alias("id"))
    return merge.pending(pages_now(spark, d, ["documentId"]), done, "id").select("id", "documentId")


@query(f"""WITH {PAGES}, s AS (SELECT documentId, sectionId, min(docPageIndex) AS f FROM page_now WHERE sectionId IS NOT NULL GROUP BY 1, 2),
e AS (SELECT documentId, max(docPageIndex) AS e FROM page_now GROUP BY 1)
SELECT documentId, sectionId, f AS first, greatest(f, coalesce(lead(f) OVER (PARTITION BY documentId ORDER BY f, sectionId) - 1, e)) AS last FROM s JOIN e USING (documentId)""")
def section_ranges(spark: SparkSession, d: str) -> DataFrame:
    return spine.section_ranges(pages_now(spark, d, ["documentId", "sectionId", "docPageIndex"]))


@query(f"""WITH {PAGES}, s AS (SELECT documentId, sectionId, min(docPageIndex) AS f FROM page_now WHERE sectionId IS NOT NULL GROUP BY 1, 2),
m AS (SELECT p.id, max(s.f) AS f FROM page_now p LEFT JOIN s ON s.documentId = p.documentId AND s.f <= p.docPageIndex GROUP BY 1)
SELECT m.id, min(s.sectionId) AS section FROM m JOIN page_now p USING (id) LEFT JOIN s ON s.documentId = p.documentId AND s.f = m.f GROUP BY 1""")
def range_join_sections(spark: SparkSession, d: str) -> DataFrame:
    p = pages_now(spark, d, ["documentId", "sectionId", "docPageIndex"])
    return spine.pages_in(p, spine.section_ranges(p))


@query(f"""WITH {PAGES} SELECT * FROM (SELECT id, lead(id) OVER (PARTITION BY documentId ORDER BY docPageIndex, id) AS next FROM page_now WHERE docPageIndex IS NOT NULL AND documentId IS NOT NULL) WHERE next IS NOT NULL""")
def next_page_link(spark: SparkSession, d: str) -> DataFrame:
    return ranking.followers(pages_now(spark, d, ["documentId", "docPageIndex"]).where("docPageIndex IS NOT NULL"), "documentId", "docPageIndex", "id")


@query(f"""WITH {PAGES}, s AS (SELECT documentId, chapterId, sectionId, min(docPageIndex) AS pos FROM page_now WHERE sectionId IS NOT NULL AND chapterId IS NOT NULL GROUP BY 1, 2, 3),
c AS (SELECT *, min(pos) OVER (PARTITION BY documentId, chapterId) AS cat FROM s)
SELECT documentId, chapterId, sectionId, dense_rank() OVER (PARTITION BY documentId ORDER BY cat, chapterId) AS chapter_no, row_number() OVER (PARTITION BY documentId, chapterId ORDER BY pos, sectionId) AS section_no FROM c""")
def toc_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return spine.ordinals(pages_now(spark, d, ["documentId", "chapterId", "sectionId", "docPageIndex"]))


@query("""SELECT doc_id, no, substring(text, no * 450 + 1, 500) AS piece, CAST(trunc(length(substring(text, no * 450 + 1, 500)) / 1.5) AS INTEGER) AS tokens
FROM (SELECT doc_id, text, unnest(range(0, 1 + greatest(0, CAST(ceil((length(text) - 500) / 450.0) AS INTEGER)))) AS no FROM documents WHERE length(text) > 0)""")
def sliding_chunks(spark: SparkSession, d: str) -> DataFrame:
    each = load(spark, d, "documents").select("doc_id", F.inline(T.windows(F.col("text"))))
    return each.select("doc_id", F.col("no").cast("bigint").alias("no"), F.col("text").alias("piece"), T.token_estimate(F.col("text")).alias("tokens"))


@query("""SELECT coalesce(source, '(unset)') AS source, count(*) AS n, sum(length(text)) AS chars, max(length(text)) AS longest, round(avg(length(text)), 6) AS mean FROM documents GROUP BY 1""")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    return load(spark, d, "documents").groupBy(F.coalesce("source", F.lit("(unset)")).alias("source")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(n).alias("chars"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean")
    )


@query("""SELECT doc_id, no, length(substring(text, no * 400 + 1, 400)) AS chars
FROM (SELECT doc_id, text, unnest(range(0, 1 + greatest(0, CAST(ceil((length(text) - 400) / 400.0) AS INTEGER)))) AS no FROM documents WHERE length(text) > 0)""")
def fixed_pages(spark: SparkSession, d: str) -> DataFrame:
    each = load(spark, d, "documents").select("doc_id", F.inline(T.fixed_pages(F.col("text"), 400)))
    return each.select("doc_id", F.col("no").cast("bigint").alias("no"), F.length("text").cast("bigint").alias("chars"))


@query(f"""WITH {BOOKS} SELECT id, CASE WHEN coalesce(publicationYear, 0) = 0 THEN '' WHEN publicationYear >= 2000 THEN 'modern-zh-reprint-2000s' WHEN publicationYear >= 1980 THEN 'modern-zh-reprint-1980s-1990s'
  WHEN publicationYear >= 1949 THEN 'modern-zh-reprint-PRC' ELSE 'pre-1949-' || CAST(publicationYear // 10 * 10 AS VARCHAR) || 's' END AS period FROM book""")
def publication_period(spark: SparkSession, d: str) -> DataFrame:
    return books(spark, d).select("id", D.period(F.col("publicationYear")).alias("period"))


@query(f"""WITH {BOOKS} SELECT id, regexp_extract(sourcePath, '([^/]*)$', 1) AS leaf, len(string_split(sourcePath, '/')) AS depth, 'doc_' || substring(sha1(sourcePath), 1, 16) AS key FROM book""")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("sourcePath")
    return books(spark, d).select(
        "id", F.regexp_extract(p, "([^/]*)$", 1).alias("leaf"), F.size(F.split(p, "/")).cast("bigint").alias("depth"), F.concat(F.lit("doc_"), F.substring(F.sha1(p), 1, 16)).alias("key")
    )


@query(f"""WITH {CHUNKS} SELECT pageId, chunkIndex, pageId || '::chunk_' || lpad(CAST(chunkIndex AS VARCHAR), 4, '0') AS made, pageId || '::chunk_' || lpad(CAST(chunkIndex AS VARCHAR), 4, '0') = id AS same FROM chunk_now""")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    made = F.format_string("%s::chunk_%04d", F.col("pageId"), F.col("chunkIndex"))
    return chunks_now(spark, d, ["pageId", "chunkIndex"]).select("pageId", "chunkIndex", made.alias("made"), (made == F.col("id")).alias("same"))


@query(f"""WITH {PAGES} SELECT id, CASE WHEN fusionStatus IN ('ok', 'single') AND length(textFused) > 0 THEN textFused WHEN length(text) > 0 THEN text END AS body,
  CASE WHEN fusionStatus IN ('ok', 'single') AND length(textFused) > 0 THEN 'fused' WHEN length(text) > 0 THEN 'native' ELSE 'none' END AS strategy FROM page_now""")
def text_source_choice(spark: SparkSession, d: str) -> DataFrame:
    p = pages_now(spark, d, ["text", "textFused", "fusionStatus"])
    chosen = spine.text_choice(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("textFused"), F.col("fusionStatus"), F.col("text"))
    return p.select("id", chosen.alias("c")).select("id", F.col("c.text").alias("body"), "c.strategy")


@query("""WITH u AS (SELECT c_custkey, c_acctbal + 1 AS c_acctbal, 'changed' AS c_mktsegment FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 1000000, 5.0, 'added' FROM customer WHERE c_custkey % 7 = 0)
SELECT coalesce(c.c_custkey, u.c_custkey) AS c_custkey, coalesce(u.c_acctbal, c.c_acctbal) AS c_acctbal, coalesce(c.c_mktsegment, u.c_mktsegment) AS c_mktsegment
FROM customer c FULL JOIN u ON c.c_custkey = u.c_custkey""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    changed = c.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit("changed").alias("c_mktsegment"))
    added = c.where("c_custkey % 7 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit(5.0).alias("c_acctbal"), F.lit("added").alias("c_mktsegment"))
    return merge.upsert(c, changed.unionByName(added), ["c_custkey"], ["c_mktsegment"])


@query("""SELECT c.c_custkey, coalesce(CASE WHEN o.n > 12 THEN 'busy' END, c.c_mktsegment) AS c_mktsegment, c.c_nationkey FROM customer c
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey""")
def patch_coalesce(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.when(F.count(F.lit(1)) > 12, "busy").alias("c_mktsegment"))
    return merge.patch(c, o, ["c_custkey"])


@query(f"""WITH {CHUNKS}, {BOOKS} SELECT id FROM chunk_now WHERE documentId IS NULL OR documentId NOT IN (SELECT id FROM book WHERE tier = 'secondary')""")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = books(spark, d).where("tier = 'secondary'").select(F.col("id").alias("documentId"))
    return merge.without(chunks_now(spark, d, ["documentId"]), gone, "documentId").select("id")


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1""")
def job_latest_state(spark: SparkSession, d: str) -> DataFrame:
    return E.latest_state(load(spark, d, "events"), "user_id", "event_type")


@query("""SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50""")
def history_recent(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "event_type")


@query("""SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.tumbling(load(spark, d, "events"), "10 minutes").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""SELECT time_bucket(INTERVAL 10 MINUTE, ts) - k * INTERVAL 10 MINUTE AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1, 2""")
def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.tumbling(load(spark, d, "events"), "30 minutes", "10 minutes").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, no""")
def session_groups(spark: SparkSession, d: str) -> DataFrame:
    return E.sessions(load(spark, d, "events"), "30 minutes").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("""SELECT event_id, json_extract_string(props, '$.' || k) AS v, k FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)""")
def json_events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (text IS NOT NULL AND length(text) > 0) AS texts, count(*) FILTER (lang IS NOT NULL) AS labelled FROM documents)
SELECT 'texts' AS gate, texts / greatest(n, 1) AS share, texts >= 0.95 * n AS open FROM c UNION ALL SELECT 'labels', labelled / greatest(n, 1), labelled >= 0.99 * n FROM c""")
def stage_gates(spark: SparkSession, d: str) -> DataFrame:
    counts = load(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") > 0).alias("texts"), F.count("lang").alias("labelled"))
    return census.gates(counts, {"texts": ("texts", "n", 0.95), "labels": ("labelled", "n", 0.99)})


@query("""SELECT s_suppkey AS id, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def parents_broadcast(spark: SparkSession, d: str) -> DataFrame:
    n, r = load(spark, d, "nation"), load(spark, d, "region")
    return load(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("id"), "n_name", "r_name")


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def status_cube(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def lineitem_summary(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PAGES}, g AS (SELECT *, docPageIndex - row_number() OVER (PARTITION BY documentId, mode ORDER BY docPageIndex, id) AS k FROM page_now WHERE docPageIndex IS NOT NULL)
SELECT documentId, mode, min(docPageIndex) AS first, max(docPageIndex) AS last, count(*) AS n FROM g GROUP BY documentId, mode, k""")
def mode_islands(spark: SparkSession, d: str) -> DataFrame:
    p = pages_now(spark, d, ["documentId", "mode", "docPageIndex"]).where("docPageIndex IS NOT NULL")
    counted = ranking.numbered(p, ["documentId", "mode"], "docPageIndex", "id").withColumn("k", F.col("docPageIndex") - F.col("number"))
    return counted.groupBy("documentId", "mode", "k").agg(F.min("docPageIndex").alias("first"), F.max("docPageIndex").alias("last"), F.count(F.lit(1)).alias("n")).drop("k")
