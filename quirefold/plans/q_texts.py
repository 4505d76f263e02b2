"""Queries over single texts; replies, mark-up and paths are written from the tables' own rows, as the data hold none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import dates as D
from quirefold.functions import replies as R
from quirefold.functions import text as T
from quirefold.operators.search import lookup
from quirefold.plans.q_corpus import chunks_now, pages_now
from quirefold.plans.registry import CHUNKS, PAGES, query
from quirefold.sources import readers
from quirefold.tables import load

_HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
_KANA = r"\x{3040}-\x{30ff}"
_KUNTEN = r"\x{3190}-\x{319f}"
_BLANK = r" \t\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
_SPACE = _BLANK + r"\n\r\x{b}\x{c}\x{85}\x{2028}\x{2029}"
_ZW = "​‌‍⁠﻿"


def _count(x: str, chars: str) -> str:
    return f"(length({x}) - length(regexp_replace({x}, '[{chars}]', '', 'g')))"


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query(f"""SELECT doc_id, trim(regexp_replace(translate(text, '{_ZW}', ''), '[{_BLANK}]+', ' ', 'g'), ' ') AS tidy FROM documents""")
def whitespace_normalize(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", T.tidy_space(F.col("text")).alias("tidy"))


@query("SELECT doc_id, nfc_normalize(text) AS composed FROM documents")
def nfc_normalize(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", T.nfc(F.col("text")).alias("composed"))


@query("""SELECT year, substring('甲乙丙丁戊己庚辛壬癸', CAST((year - 4) % 10 AS INTEGER) + 1, 1) || substring('子丑寅卯辰巳午未申酉戌亥', CAST((year - 4) % 12 AS INTEGER) + 1, 1) AS name
FROM (SELECT DISTINCT publicationYear AS year FROM document_meta WHERE publicationYear IS NOT NULL)""")
def cycle_years(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "document_meta").where("publicationYear IS NOT NULL").select(F.col("publicationYear").alias("year")).distinct().select("year", D.cycle_year(F.col("year")).alias("name"))


@query("""SELECT doc_id, left(text, 300) AS head, md5(text) AS print, length(text) > 300 AS cut FROM documents WHERE text IS NOT NULL""")
def field_caps(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.substring("text", 1, 300).alias("head"), F.md5("text").alias("print"), (F.length("text") > 300).alias("cut"))


@query("""SELECT text, count(*) AS n, min(doc_id) AS first FROM documents WHERE length(trim(text, ' ')) > 0 GROUP BY 1 HAVING count(*) > 1""")
def equal_texts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").where(F.length(F.trim("text")) > 0).groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


_G = "list_transform(range(1, length(b) - {m}), lambda i: substring(b, i, {n}))"


@query(f"""WITH {CHUNKS}, b AS (SELECT id, regexp_replace(text, '[{_SPACE}]+', '', 'g') AS b FROM chunk_now WHERE text IS NOT NULL), g AS (SELECT id, list_concat({_G.format(m=1, n=3)}, {_G.format(m=2, n=4)}) AS g FROM b)
SELECT id, len(g) AS grams, len(list_distinct(g)) AS different FROM g""")
def char_ngrams(spark: SparkSession, d: str) -> DataFrame:
    g = T.char_grams(F.col("text"))
    return chunks_now(spark, d, ["text"]).where("text IS NOT NULL").select("id", F.size(g).cast("bigint").alias("grams"), F.size(F.array_distinct(g)).cast("bigint").alias("different"))


@query(f"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[{_HAN}]+')) AS run, generate_subscripts(regexp_extract_all(text, '[{_HAN}]+'), 1) AS no FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, no, n, i, substring(run, i, n) AS term FROM (SELECT *, unnest(range(1, length(run) - n + 2)) AS i FROM r, (SELECT unnest([2, 3, 4]) AS n))),
f AS (SELECT doc_id, term, min((no, n, i)) AS pos FROM g GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM f),
j AS (SELECT doc_id, string_agg(term, ' ' ORDER BY pos) AS terms FROM k WHERE r <= 30 GROUP BY 1) SELECT doc_id, coalesce(terms, '') AS terms FROM documents LEFT JOIN j USING (doc_id) WHERE text IS NOT NULL""")
def han_terms(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(T.han_terms(F.col("text")), " ").alias("terms"))


@query(f"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '([{_HAN}]{{4,}})', 1)) AS run, generate_subscripts(regexp_extract_all(text, '([{_HAN}]{{4,}})', 1), 1) AS i FROM documents),
b AS (SELECT doc_id, arg_min(run, (-length(run), i)) AS run FROM r GROUP BY 1) SELECT doc_id, run FROM documents LEFT JOIN b USING (doc_id)""")
def longest_han_run(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", T.longest_run(F.col("text")).alias("run"))


_PAIRS = ", ".join(f"regexp_extract_all(text, '(?s){a}(.+?){b}', 1)" for a, b in T.QUOTES)


@query(f"""WITH {CHUNKS}, e AS (SELECT id, text, string_split_regex(text, '[…⋯]{{1,3}}(?:省略|省)?') AS p, regexp_extract_all(text, '[…⋯]{{1,3}}(?:省略|省)?') AS m FROM chunk_now WHERE text IS NOT NULL),
a AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM e), w AS (SELECT id, text, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS pos, length(m[i]) AS n FROM a),
q AS (SELECT id, unnest(list_concat({_PAIRS})) AS s FROM e UNION ALL SELECT id, substring(text, greatest(1, pos - 99), least(pos, 100) + n + 100) FROM w), t AS (SELECT id, regexp_replace(s, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') AS span FROM q)
SELECT DISTINCT id, span FROM t WHERE length(span) BETWEEN 5 AND 300""")
def quoted_spans(spark: SparkSession, d: str) -> DataFrame:
    """All candidate quotations of every chunk (a linker takes the first ten of each)."""
    return chunks_now(spark, d, ["text"]).where("text IS NOT NULL").select("id", F.explode(T.quoted_spans(F.col("text"), most=100_000)).alias("span"))


@query(f"""WITH {PAGES}, t AS (SELECT id, lower(coalesce(language, 'zh-classical')) AS lang, textFused AS x FROM page_now),
k AS (SELECT id, lang, CASE WHEN x IS NULL OR length(regexp_replace(x, '[{_SPACE}]+', '', 'g')) = 0 THEN [] WHEN lang = 'en' THEN regexp_extract_all(x, '[A-Za-z](?:[A-Za-z''\\-]*[A-Za-z])?') WHEN lang = 'ar' THEN NULL
  ELSE string_split(regexp_replace(x, '[{_SPACE}]+', '', 'g'), '') END AS w FROM t) SELECT id, len(w) AS tokens, len(list_distinct(w)) AS different FROM k""")
def tokenize_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page's tokens by the splitter of its language."""
    w = T.tokens(F.col("textFused"), F.col("language"))
    return pages_now(spark, d, ["textFused", "language"]).select("id", F.size(w).cast("bigint").alias("tokens"), F.size(F.array_distinct(w)).cast("bigint").alias("different"))


@query()
def cer_routing(spark: SparkSession, d: str) -> DataFrame:
    """The error rate of each reading of each scanned page against the fused text, and what is to be done; no SQL, since DuckDB's distance counts bytes."""
    p = pages_now(spark, d, ["mode", "textFused", "paddleOcrText", "deepseekOcrText", "qwenVlOcrText"]).where("mode = 'scan'")
    r = p.select("id", "textFused", F.col("paddleOcrText").alias("paddle"), F.col("deepseekOcrText").alias("deepseek"), F.col("qwenVlOcrText").alias("qwen")).unpivot(["id", "textFused"], ["paddle", "deepseek", "qwen"], "engine", "reading")
    rated = r.where("reading IS NOT NULL AND textFused IS NOT NULL").withColumn("cer", T.error_rate(F.col("reading"), F.col("textFused")))
    kind = F.when(F.col("cer") < T.SURE_BELOW, "OK")  # a classifier would be asked about the others
    return rated.select("id", "engine", F.round("cer", 6).alias("cer"), F.round(T.han_validity(F.col("reading")), 6).alias("validity"), T.page_route(F.col("cer"), kind).alias("route"))


_REPLY = "'```json' || chr(10) || '[{\"name\":\" ' || p_name || '\",\"type\":\"' || t || '\",\"weight\":' || w || '},'"


@query("""WITH k AS (SELECT p_partkey, trim(p_name) AS name, ['PERSON','PLACE','WORK','OFFICE','EVENT','CONCEPT','DATE','OBJECT','LAW','OTHER','OTHER'][p_partkey % 11 + 1] AS type, greatest(0.0, least(1.0, (p_partkey % 23 - 3) / 10.0)) AS weight FROM part)
SELECT p_partkey, name, type, weight FROM k UNION ALL SELECT p_partkey, 'second', 'LAW', 0.7 FROM k WHERE p_partkey % 5 = 1""")
def json_repair(spark: SparkSession, d: str) -> DataFrame:
    """A malformed reply for every part, fenced, with trailing commas or cut off, read again."""
    kinds = F.array(*[F.lit(k) for k in ["person", "Place", "WORK", "office", "EVENT", "concept", "DATE", "object", "LAW", "other", "CITY"]])
    kind, weight = F.get(kinds, (F.col("p_partkey") % 11).cast("int")), ((F.col("p_partkey") % 23 - 3) / 10.0).cast("string")
    one = F.concat(F.lit('{"name":" '), F.col("p_name"), F.lit(' ","type":"'), kind, F.lit('","weight":'), weight)
    whole = F.concat(F.lit("Sure, here it is:\n```json\n["), one, F.lit("},]\n```"))
    second = F.concat(F.lit("["), one, F.lit('}, {"name":"second","type":"LAW"}, {"name":"  "}]'))
    broken = F.concat(F.lit("["), one, F.lit(',}, {"name":"cut of'))
    reply = F.when(F.col("p_partkey") % 5 == 0, broken).when(F.col("p_partkey") % 5 == 1, second).otherwise(whole)
    return load(spark, d, "part").select("p_partkey", F.inline(R.keywords(reply)))


@query("""SELECT doc_id, item, CASE item WHEN 1 THEN least(10.0, doc_id % 13) ELSE 0.0 END AS score, '3' AS missing FROM documents, (SELECT unnest([1, 2]) AS item)""")
def evidence_scores(spark: SparkSession, d: str) -> DataFrame:
    """A scoring reply for every document, with scores out of range, an id twice and one too many, read again."""
    reply = F.concat(F.lit('[{"id":1,"score":'), (F.col("doc_id") % 13).cast("string"), F.lit('},{"id":2,"score":-2},{"id":1,"score":9},{"id":7,"score":3},]'))
    s = R.scores(reply, 3)
    return load(spark, d, "documents").select("doc_id", F.inline(s).alias("item", "score"), F.array_join(R.missing(s, 3), " ").alias("missing"))


@query("""SELECT o_orderkey AS id, round(0.5 * (o_orderkey % 11) + 0.5 * (o_custkey % 11), 3) AS verification, round(round(0.5 * (o_orderkey % 11) + 0.5 * (o_custkey % 11), 3) / 10.0 * (o_orderkey % 7) / 7, 6) AS combined
FROM orders WHERE round(0.5 * (o_orderkey % 11) + 0.5 * (o_custkey % 11), 3) >= 3.0""")
def evidence_kept(spark: SparkSession, d: str) -> DataFrame:
    """Scored evidence: the mean of relevance and evidence, its product with the score of retrieval, kept from 3 on."""
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 11).alias("r"), (F.col("o_custkey") % 11).alias("e"), ((F.col("o_orderkey") % 7) / 7).alias("s"))
    e = R.evidence(F.col("r"), F.col("e"), F.col("s"))
    return o.select("id", *[c.alias(n) for n, c in e.items()]).where("verification >= 3.0")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'RARE_GLYPH' WHEN 2 THEN 'OK' ELSE 'ANNOTATION' END AS kind, CASE p_partkey % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 0.25 ELSE 0.5 END AS confidence,
  CASE p_partkey % 4 WHEN 0 THEN 'parse failed' WHEN 1 THEN p_name ELSE 'parse failed' END AS reason FROM part""")
def page_classes(spark: SparkSession, d: str) -> DataFrame:
    """A classifier's reply for every part, read again: unreadable, out of range, unknown and incomplete ones among them."""
    n = F.col("p_partkey") % 4
    reply = (
        F.when(n == 0, "no answer today").when(n == 1, F.concat(F.lit('```json\n{"problem_class": "rare_glyph", "confidence": 3, "reasoning": "'), F.col("p_name"), F.lit('"}\n```')))
        .when(n == 2, 'It is {"problem_class": "SOMETHING", "confidence": 0.25}').otherwise('{"problem_class": " annotation "}')
    )
    return load(spark, d, "part").select("p_partkey", R.page_class(reply).alias("c")).select("p_partkey", "c.kind", "c.confidence", "c.reason")


@query("""SELECT p_partkey, p_partkey % 4 IN (0, 3) AS ok, CASE p_partkey % 4 WHEN 1 THEN p_name ELSE '' END AS issues, CASE p_partkey % 4 WHEN 1 THEN 'better' WHEN 2 THEN 'cut here' ELSE '' END AS revised FROM part""")
def review_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """A reviewer's reply for every part, read again: sound, single-quoted, broken, and none at all."""
    n = F.col("p_partkey") % 4
    reply = (
        F.when(n == 0, '{"ok": true, "issues": [], "revised": ""}').when(n == 1, F.concat(F.lit("{'ok': false, 'issues': ['"), F.col("p_name"), F.lit("'], 'revised': 'better'}")))
        .when(n == 2, 'ok: FALSE, "revised": "cut here", and so').otherwise("nothing to say")
    )
    return load(spark, d, "part").select("p_partkey", R.review_verdict(reply).alias("v")).select("p_partkey", "v.ok", F.array_join("v.issues", " ").alias("issues"), "v.revised")


_HTML = "'<html><style>p{}</style><h1>Title</h1>' || chr(10) || '<p class=x>' || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</p><script>x()</script></html>'"
_BARE = f"regexp_replace(regexp_replace({_HTML}, '(?is)<(script|style)\\b[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<[^>]+>', chr(10), 'g')"
_TEXT = f"replace(replace(replace(replace(replace({_BARE}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' '), '&amp;', '&')"


@query(f"""SELECT doc_id, trim(regexp_replace(regexp_replace({_TEXT}, '[ \\t]*\\n[ \\t\\n]*', chr(10), 'g'), '^\\n+|\\n+$', '', 'g'), ' ') AS body FROM documents WHERE text IS NOT NULL""")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    """Every document put into a page of HTML and taken out again."""
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<html><style>p{}</style><h1>Title</h1>\n<p class=x>"), escaped, F.lit("</p><script>x()</script></html>"))
    return load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.html_text(html).alias("body"))


@query()
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    """Every document as markdown whose paragraphs are sections, cut and put together again; tested against a plain loop."""
    body = F.concat(F.lit("before\n# "), F.coalesce("source", F.lit("none")), F.lit("\n"), F.regexp_replace("text", r"\n\n+", "\n## next\n"))
    each = load(spark, d, "documents").where("length(text) > 0").select("doc_id", F.posexplode(T.heading_sections(body)).alias("no", "s"))
    return each.select("doc_id", "no", F.length("s").alias("chars"), F.md5("s").alias("print"))


@query("""WITH p AS (SELECT DISTINCT sourcePath AS path FROM document_meta WHERE sourcePath IS NOT NULL), s AS (SELECT path, lower(regexp_extract(path, '\\.([^./]+)/?$', 1)) AS x, list_filter(string_split(lower(path), '/'), lambda y: y IN ('primary', 'secondary')) AS t FROM p)
SELECT path, CASE WHEN x IN ('pdf', 'epub', 'text') THEN x WHEN x IN ('packed', 'md') THEN 'packed_md' WHEN x = 'txt' THEN 'text' WHEN x IN ('png', 'jpg', 'jpeg', 'tif', 'tiff', 'webp', 'bmp') THEN 'image' END AS format, coalesce(t[1], 'primary') AS tier FROM s""")
def format_dispatch(spark: SparkSession, d: str) -> DataFrame:
    paths = load(spark, d, "document_meta").where("sourcePath IS NOT NULL").select(F.col("sourcePath").alias("path")).distinct()
    return paths.select("path", readers.format_of(F.col("path")).alias("format"), readers.tier_of(F.col("path")).alias("tier"))


@query(f"""WITH {CHUNKS}, w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS word FROM chunk_now), t AS (SELECT DISTINCT lower(trim(p_name)) AS term FROM part),
e AS (SELECT word, term FROM w JOIN t ON w.word = t.term), f AS (SELECT word, term, row_number() OVER (PARTITION BY word ORDER BY length(term), term) AS n FROM w ANTI JOIN e USING (word) JOIN t ON contains(term, word) WHERE length(word) >= 2)
SELECT word, term, 'exact' AS how FROM e UNION ALL SELECT word, term, 'part' FROM f WHERE n <= 5 UNION ALL SELECT word, NULL, 'none' FROM w ANTI JOIN e USING (word) ANTI JOIN f USING (word)""")
def dictionary_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every word of the chunks among the terms of a dictionary: its own, else up to five that hold it, the shortest first."""
    words = chunks_now(spark, d, ["text"]).select(F.explode(T.latin_words(F.col("text"))).alias("word")).distinct()
    terms = load(spark, d, "part").select(F.lower(F.trim("p_name")).alias("term")).distinct()
    return lookup(words, "word", terms, "term")
