"""Named providers for what models do, with deterministic stand-ins, and the stages that are made of them.

A provider maps Arrow batches, so a model is loaded once a worker.  The
stand-ins need no model and give the same result everywhere: hashed n-gram
vectors, n-gram overlap, frequent words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.functions import canon, replies, rules
from quirefold.functions import text as T
from quirefold.operators.search import lookup

Embed = Callable[[list[str]], list[list[float]]]
Score = Callable[[list[tuple[str, str]]], list[float]]
Extract = Callable[[list[str]], list[list[str]]]
EMBEDDERS: dict[str, Embed] = {}
SCORERS: dict[str, Score] = {}
EXTRACTORS: dict[str, Extract] = {}
DIMS = 64


def grams(text: str, n: int = 3) -> list[str]:
    bare = "".join(text.split())
    return [bare[i : i + n] for i in range(len(bare) - n + 1)]


def hashed(texts: list[str], dims: int = DIMS) -> list[list[float]]:
    """Unit vectors of hashed n-grams with signs; an empty text has the zero vector."""
    out = []
    for t in texts:
        v = np.zeros(dims)
        for g in grams(t or ""):
            h = int.from_bytes(blake2b(g.encode(), digest_size=8).digest(), "big")
            v[h % dims] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


def overlap(pairs: list[tuple[str, str]]) -> list[float]:
    """The share of the first text's n-grams that the second has."""
    out = []
    for a, b in pairs:
        x, y = set(grams(a or "")), set(grams(b or ""))
        out.append(len(x & y) / len(x) if x else 0.0)
    return out


def frequent(texts: list[str], most: int = 8) -> list[list[str]]:
    """The most frequent longer words, equal ones in order of the alphabet."""
    out = []
    for t in texts:
        counts = Counter(w for w in re.findall(r"[a-z]{5,}|[一-鿿]{2}", (t or "").lower()))
        out.append([w for w, _ in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:most]])
    return out


EMBEDDERS["hashed"] = hashed
SCORERS["overlap"] = overlap
EXTRACTORS["frequent"] = frequent


def embed(df: DataFrame, key: str, text: str, provider: str = "hashed", dims: int = DIMS) -> DataFrame:
    """(key, embedding); a vector of another length than ``dims`` is an error."""
    f = EMBEDDERS[provider]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vectors = f(b["_text"].fillna("").tolist())
            if any(len(v) != dims for v in vectors):
                raise ValueError(f"provider {provider} gave vectors of another length than {dims}")
            yield pd.DataFrame({key: b[key], "embedding": vectors})

    return df.select(key, F.col(text).alias("_text")).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, embedding array<float>")


def rerank(df: DataFrame, keys: list[str], query: str, text: str, provider: str = "overlap") -> DataFrame:
    """(keys, relevance) of pairs of a query and a text."""
    f, types = SCORERS[provider], dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[keys].assign(relevance=f(list(zip(b[query].fillna(""), b[text].fillna("")))))

    return df.select(*keys, query, text).mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", relevance double")


def extract(df: DataFrame, key: str, text: str, provider: str = "frequent") -> DataFrame:
    """(key, keywords)."""
    f = EXTRACTORS[provider]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "keywords": f(b[text].fillna("").tolist())})

    return df.select(key, text).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, keywords array<string>")


#: Generators: kind -> name -> function over lists of inputs; kinds are recognise, classify, translate, review, summarise, title, layout.
Generate = Callable[[list[dict]], list[str | None]]
GENERATORS: dict[str, dict[str, Generate]] = {}


def register(kind: str, name: str) -> Callable[[Generate], Generate]:
    """Puts a function down as a generator: dicts of a row's inputs in, replies out; None for no answer."""

    def put(f: Generate) -> Generate:
        GENERATORS.setdefault(kind, {})[name] = f
        return f

    return put


def attempts(f: Callable, transient: tuple[type[Exception], ...], times: int = 4, wait: float = 0.5) -> Callable:
    """``f`` tried again, after waits that double, when it fails by a passing error; the last failure is raised."""
    import time

    def tried(*args):
        for n in range(times):
            try:
                return f(*args)
            except transient:
                if n == times - 1:
                    raise
                time.sleep(wait * 2**n)

    return tried


def generate(df: DataFrame, keys: list[str], inputs: list[str], kind: str, name: str) -> DataFrame:
    """(keys, reply): what a generator says to each row's inputs."""
    f, types = GENERATORS[kind][name], dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{k: (None if v is None or v != v else v) for k, v in r.items()} for r in b[inputs].to_dict("records")]
            yield b[keys].assign(reply=pd.Series(f(rows), index=b.index, dtype=object))

    return df.select(*dict.fromkeys([*keys, *inputs])).mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", reply string")


@register("recognise", "none")
@register("layout", "none")
def nothing(rows: list[dict]) -> list[str | None]:
    """No answer to anything."""
    return [None] * len(rows)


@register("classify", "by rate")
def by_rate(rows: list[dict]) -> list[str | None]:
    """A classifier's reply by the error rate alone."""
    return ['{"problem_class": "%s", "confidence": 0.5, "reasoning": "by error rate"}' % ("DEGRADATION" if (r.get("cer") or 0) >= 0.5 else "OK") for r in rows]


@register("translate", "same")
def same(rows: list[dict]) -> list[str | None]:
    """Every text as it is."""
    return [r.get("text") for r in rows]


@register("review", "accept")
def accept(rows: list[dict]) -> list[str | None]:
    return ['{"ok": true, "issues": [], "revised": ""}'] * len(rows)


@register("summarise", "first")
def first_words(rows: list[dict]) -> list[str | None]:
    """The first 200 characters."""
    return [(r.get("text") or "")[:200] or None for r in rows]


@register("title", "marked")
def marked(rows: list[dict]) -> list[str | None]:
    """A title with the language it was asked for."""
    return [f"[{r.get('lang')}] {r.get('text')}" if r.get("text") else None for r in rows]


def recognised(pages: DataFrame, key: str, image: str, name: str, traditional: Column, confidence: float = 0.85) -> DataFrame:
    """(key, text, status, confidence, error): a recogniser's readings of pages, checked; no confidence without a text."""
    read = generate(pages, [key], [image], "recognise", name).join(pages.select(key, traditional.alias("_old")), key)
    done = rules.with_validation(read, "reply", F.col("_old"))
    status = rules.recognition_status(F.col("valid_text"), F.col("error"))
    return done.select(key, F.col("valid_text").alias("text"), status.alias("status"), F.when(status == "ok", confidence).otherwise(0.0).alias("confidence"), "error")


def laid_out(pages: DataFrame, key: str, image: str, name: str, manuscript: Column) -> DataFrame:
    """(key, regions, status): regions of pages by a provider; pages of handwriting are not asked for."""
    asked = generate(pages.where(~manuscript), [key], [image], "layout", name)
    from quirefold.functions.layout import regions_of

    found = asked.select(key, regions_of("reply").alias("regions"))
    status = F.when(F.size("regions") > 0, "ok").otherwise("empty")
    spared = pages.where(manuscript).select(key, F.lit(None).cast(dict(found.dtypes)["regions"]).alias("regions"), F.lit("manuscript").alias("status"))
    return found.withColumn("status", status).unionByName(spared)


def evaluated(pages: DataFrame, key: str, reading: str, truth: str, name: str = "by rate") -> DataFrame:
    """(key, cer, validity, kind, route): pages by error rate and class; a page below 2 % is OK without being asked for."""
    rated = pages.withColumn("cer", T.error_rate(F.col(reading), F.col(truth))).withColumn("validity", T.han_validity(F.col(reading)))
    asked = generate(rated.where(F.col("cer") >= T.SURE_BELOW), [key], ["cer"], "classify", name).select(key, replies.page_class(F.col("reply"))["kind"].alias("kind"))
    joined = rated.select(key, "cer", "validity").join(asked, key, "left").withColumn("kind", F.coalesce("kind", F.lit("OK")))
    return joined.withColumn("route", T.page_route(F.col("cer"), F.col("kind")))


def word_analysis(texts: DataFrame, key: str, text: str, lang: str, era: Column, entries: DataFrame, term: str) -> DataFrame:
    """(key, n, token, term, how): texts in canonical form with loan characters resolved, their tokens, and the dictionary's entries for each."""
    each = texts.select(key, F.posexplode(T.tokens(canon.canonical(F.col(text), F.col(lang), era, loan=True), F.col(lang))).alias("n", "token"))
    known = lookup(each.select("token").distinct(), "token", entries, term)
    return each.join(known, "token").select(key, "n", "token", term, "how")


def reviewed(texts: DataFrame, key: str, source: str, draft: str, passes: list[str], rounds: int = 3) -> DataFrame:
    """(key, draft, turns): drafts led through review passes (names of reviewers), each asked again up to ``rounds`` times until it accepts."""
    now = texts.select(key, F.col(source).alias("source"), F.col(draft).alias("draft"), F.lit(0).alias("turns"), F.lit(False).alias("ok"))
    for name in passes:
        now = now.withColumn("ok", F.lit(False))
        for _ in range(rounds):
            said = generate(now.where("not ok"), [key], ["source", "draft"], "review", name).select(key, replies.review_verdict(F.col("reply")).alias("v"))
            better = F.when((F.length("v.revised") > 0) & ~F.coalesce("v.ok", F.lit(True)), F.col("v.revised")).otherwise(F.col("draft"))
            now = now.join(said, key, "left").select(key, "source", better.alias("draft"), (F.col("turns") + F.col("v").isNotNull().cast("int")).alias("turns"), (F.col("ok") | F.coalesce("v.ok", F.lit(False))).alias("ok"))
    return now.select(key, "draft", "turns")


def translated(chunks: DataFrame, key: str, text: str, tier: str, lang: str, era: Column, passes: list[str], name: str = "same") -> DataFrame:
    """(key, text, canonical, status): primary texts in canonical form, translated and reviewed; others in canonical form, with their own words."""
    held = chunks.select(key, tier, F.col(text).alias("_t"), canon.canonical(F.col(text), F.col(lang), era).alias("canonical")).where(F.length("_t") > 0)
    drafts = generate(held.where(F.col(tier) == "primary").select(key, F.col("canonical").alias("text")), [key], ["text"], "translate", name)
    made = reviewed(drafts.join(held.select(key, "canonical"), key).where("reply is not null"), key, "canonical", "reply", passes)
    joined = held.join(made.select(key, F.col("draft").alias("_d")), key, "left")
    primary = F.col(tier) == "primary"
    status = F.when(~F.coalesce(primary, F.lit(False)), "normalized").when(F.col("_d").isNotNull(), "ok").otherwise("failed")
    return joined.select(key, F.when(primary, F.col("_d")).otherwise(F.col("_t")).alias("text"), "canonical", status.alias("status"))


def translated_titles(books: DataFrame, key: str, title: str, langs: list[str], name: str = "marked") -> DataFrame:
    """(key, lang, title): titles in each of some languages, by a provider."""
    asked = books.where(F.col(title).isNotNull()).select(key, F.col(title).alias("text"), F.explode(F.array(*[F.lit(x) for x in langs])).alias("lang"))
    return generate(asked, [key, "lang"], ["text", "lang"], "title", name).select(key, "lang", F.col("reply").alias("title"))


def reranked(df: DataFrame, query: str, item: str, asked: str, text: str, retrieval: str, least: float = 0.0, most: int = 20, provider: str = "overlap") -> DataFrame:
    """(query, item, relevance, combined, place): the ``most`` candidates of a query of at least ``least`` relevance; scores are of one scale for the whole query, not of a batch."""
    rated = rerank(df, [query, item], asked, text, provider).join(df.select(query, item, retrieval), [query, item]).where(F.col("relevance") >= least)
    place = F.row_number().over(W.partitionBy(query).orderBy(F.desc("relevance"), item))
    combined = 0.7 * F.col("relevance") + 0.3 * F.least(F.col(retrieval), F.lit(1.0))
    return rated.withColumn("place", place).where(F.col("place") <= most).select(query, item, "relevance", combined.alias("combined"), "place")


def scored_evidence(df: DataFrame, query: str, item: str, relevance: Column, found: Column, score: str, least: float = 3.0) -> DataFrame:
    """(query, item, verification, combined, place): evidence of at least ``least``, the best combined score first."""
    e = replies.evidence(relevance, found, F.col(score))
    kept = df.select(query, item, *[c.alias(n) for n, c in e.items()]).where(F.col("verification") >= least)
    return kept.withColumn("place", F.row_number().over(W.partitionBy(query).orderBy(F.desc("combined"), item)))
