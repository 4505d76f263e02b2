import pytest
from pyspark.sql import functions as F

from quirefold.functions import canon, rules
from quirefold.functions import dates as D
from quirefold.functions import text as T
from quirefold.functions import vectors as V
from quirefold.operators import fusion, graphs, merge, metrics, search, spine
from quirefold.tables import latest


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_windows(spark):
    pieces = one(spark, "a" * 600, T.windows)
    assert [len(p.text) for p in pieces] == [500, 150]
    assert one(spark, "", T.windows) == []
    assert [len(p.text) for p in one(spark, "b" * 500, T.windows)] == [500]


@pytest.mark.parametrize("text", ["", "ab", "abc", "abcd", "漢字 か　な", "📜🖋️ab"])
def test_grams(spark, text):
    bare = "".join(text.split())
    assert one(spark, text, T.char_grams) == [bare[i : i + n] for n in (3, 4) for i in range(len(bare) - n + 1)]


def test_quotes(spark):
    assert one(spark, "云：「天地玄黃宇宙」又“one two three”「短」「天地玄黃宇宙」", T.quoted_spans) == ["天地玄黃宇宙", "one two three"]


def test_longest_run(spark):
    assert one(spark, "甲乙丙丁 x 天地玄黃 y 宇宙", T.longest_run) == "甲乙丙丁"
    assert one(spark, "abc", T.longest_run) is None


def test_tidy_and_variants(spark):
    assert one(spark, "a​ 　 b\n c ", T.tidy_space) == "a b\n c"
    assert T.canonical_variants([("a", "b"), ("b", "a"), ("a", "b")]) == {"a": "b"}
    assert T.canonical_variants([("a", "b"), ("b", "a")]) == {"a": "b"}


def test_error_rate(spark):
    df = spark.createDataFrame([("für", "fur", 1 / 3), ("", "", 0.0), ("abc", "abc", 0.0)], "a string, b string, want double")
    for r in df.withColumn("got", T.error_rate(F.col("a"), F.col("b"))).collect():
        assert r.got == pytest.approx(r.want)


def test_dates(spark):
    assert one(spark, 1984, D.cycle_year, "int") == "甲子"
    assert one(spark, -1, D.cycle_year, "int") == "己未"
    assert one(spark, "十一", D.han_number) == 11


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r.c for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, None]


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("a", 2, "new"), ("b", None, "x"), (None, 5, "y")], "id string, at int, v string")
    assert sorted((r.id, r.v) for r in latest(df, "id", "at").collect()) == [("a", "new"), ("b", "x")]
    assert latest(df.limit(0), "id", "at").count() == 0


def test_rrf(spark):
    df = spark.createDataFrame([("q", leg, "c", 1.0) for leg in "abc"] + [("q", "a", "d", 0.5), ("q", "a", "n", float("nan")), ("q", "b", "n", None)], "q string, leg string, c string, s double")
    got = {r.c: r.rrf for r in search.rrf(df, "q", "leg", "c", "s").collect()}
    assert got == {"c": pytest.approx(3 / 61), "d": pytest.approx(1 / 62)}


def test_verdicts(spark):
    rows = [("天地玄黃", "始天 地玄　黃也", "verified"), ("天地", "x", "span_too_short"), (None, "x", "no_span"), ("天地玄黃", None, "no_text"), ("天地玄黃", "宇宙洪荒", "span_not_found")]
    df = spark.createDataFrame(rows, "span string, body string, want string")
    for r in df.withColumn("got", search.verdict(F.col("span"), F.col("body"))).collect():
        assert r.got == r.want


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query string, item string, place int")
    rel = spark.createDataFrame([("q", "b"), ("q", "z"), ("p", "a")], "query string, item string")
    got = {r.query: r for r in metrics.ir_metrics(ranked, rel, "query", "item", "place", 2).collect()}
    assert (got["q"].recall, got["q"].precision, got["q"].mrr) == (0.5, 0.5, 0.5)
    assert got["p"].ndcg == 0.0


def test_bootstrap_of_one_and_none(spark):
    df = spark.createDataFrame([("a", 2.0)], "k string, v double")
    r = metrics.bootstrap(df, "k", "v", 20).first()
    assert (r.n, r.mean, r.low, r.high) == (1, 2.0, 2.0, 2.0)
    assert metrics.bootstrap(df.limit(0), "k", "v", 20).first().mean is None


def test_fusion(spark):
    df = spark.createDataFrame([("天地黃", "天地玄黃"), ("abc", "axc"), ("abcd", "abd"), (None, None)], "a string, b string")
    got = [r.f for r in df.select(fusion.fuse_two("a", "b").alias("f")).collect()]
    assert [(g.text, g.agreement) for g in got] == [("天地玄黃", 0.75), ("axc", 0.6667), ("abcd", 0.75), ("", 0.0)]


def test_merge(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    c = spark.createDataFrame([(2, "B", "Y"), (3, "C", "Z"), (3, "C", "Z")], "k int, v string, w string")
    assert sorted(map(tuple, merge.upsert(t, c, ["k"], ["w"]).collect())) == [(1, "a", "x"), (2, "B", "y"), (3, "C", "Z")]
    assert sorted(map(tuple, merge.patch(t, spark.createDataFrame([(1, None, "q"), (9, "n", "n")], "k int, v string, w string"), ["k"]).collect())) == [(1, "a", "q"), (2, "b", "y")]
    assert merge.appended(t, c, ["k"]).count() == 3


def test_components_and_communities(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a int, b int")
    assert {r.node: r.label for r in graphs.components(e).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    w = spark.createDataFrame([(1, 2, 5), (2, 3, 5), (1, 3, 5), (4, 5, 5), (5, 6, 5), (4, 6, 5), (3, 4, 1)], "a int, b int, weight int")
    found = {r.node: r.label for r in graphs.communities(w).collect()}
    assert len({found[1], found[2], found[3]}) == 1 and len({found[4], found[5], found[6]}) == 1


def test_slices_agree_with_windows(spark):
    from pyspark.sql import Window as W

    from quirefold.operators import ranking

    df = spark.range(900).select((F.col("id") % 3 % 2).alias("g"), (F.col("id") * 37 % 50).cast("double").alias("s"), F.col("id").alias("i"), F.when(F.col("id") % 11 == 0, F.col("id")).alias("v"))
    got = sorted((r.i, r.place, r.of) for r in ranking.places(df, ["g"], "s", slices=4).collect())
    w = W.partitionBy("g")
    assert got == sorted((r.i, r.p, r.n) for r in df.withColumn("p", F.rank().over(w.orderBy(F.desc("s")))).withColumn("n", F.count("*").over(w)).collect())
    got = sorted((r.i, r.place) for r in ranking.places(df, ["g"], "s", "i", 4).collect())
    assert got == sorted((r.i, r.p) for r in df.withColumn("p", F.row_number().over(w.orderBy(F.desc("s"), "i"))).collect())
    got = sorted((r.i, r.next) for r in ranking.followers(df, "g", "s", "i", 7).collect())
    assert got == sorted((r.i, r.n) for r in df.withColumn("n", F.lead("i").over(w.orderBy("s", "i"))).collect() if r.n is not None)
    got = sorted((r.i, r.v) for r in ranking.carried(df, "g", ["s", "i"], "v", "s", 7).collect() if r.v is not None)
    want = df.withColumn("v", F.last("v", True).over(w.orderBy("s", "i").rowsBetween(W.unboundedPreceding, 0)))
    assert got == sorted((r.i, r.v) for r in want.collect() if r.v is not None)


def test_ranges(spark):
    p = spark.createDataFrame([("p0", "b", None, 0), ("p1", "b", "s1", 1), ("p2", "b", "s1", 2), ("p3", "b", "s2", 3), ("p4", "b", None, 4)], "id string, documentId string, sectionId string, docPageIndex int")
    r = spine.section_ranges(p)
    assert sorted((x.sectionId, x.first, x.last) for x in r.collect()) == [("s1", 1, 2), ("s2", 3, 4)]
    assert {x.id: x.section for x in spine.pages_in(p, r).collect()} == {"p0": None, "p1": "s1", "p2": "s1", "p3": "s2", "p4": "s2"}


def test_era_years(spark):
    text = "貞觀十九年乙巳春，上元二年，開元二十年壬申，乾隆元年，永徽十三年。乙丑上元元年"
    df = spark.createDataFrame([(1, text), (2, None), (3, "是歲大旱"), (4, "天冊萬歲元年")], "id int, t string")
    got = [tuple(r) for r in D.era_years(df, ["id"], "t").orderBy("id", "nth").select("id", "era", "offset", "ce", "candidates", "named", "confidence").collect()]
    assert got == [
        (1, "貞觀", 19, 645, 1, "乙巳", 1.0), (1, "上元", 2, 675, 2, "乙巳", 0.6), (1, "開元", 20, 732, 1, "壬申", 1.0), (1, "永徽", 13, 662, 1, "乙丑", 0.5), (1, "上元", 1, 674, 2, "乙丑", 0.6),
        (4, "天冊萬歲", 1, 695, 1, None, 1.0),
    ]
    assert [tuple(r) for r in D.first_era(df, ["id"], "t").orderBy("id").collect()] == [(1, 645, "唐"), (4, 695, "唐")]


def test_canonical_steps(spark):
    df = spark.createDataFrame([(1, "这是 说國の ｶﾞ  泉", "ja", "Tang"), (2, "早 無泉", None, None), (3, None, "zh", "")], "id int, t string, lang string, era string")
    rows = {(r.id, r.step): r for r in df.select("id", F.inline(canon.trace(F.col("t"), F.col("lang"), F.col("era")))).collect()}
    assert rows[1, "kana"].after == "这是 說國の ガ 淵" and rows[1, "taboo"].applied and rows[1, "tsc"].after == "这是 說國の ｶﾞ 泉"
    assert rows[2, "kana"].after == "早 無泉" and not rows[2, "taboo"].applied and not rows[2, "loan"].applied
    assert rows[3, "kana"].after == "" and rows[3, "taboo"].applied and len(rows) == 21
    assert canon.loan_map()["說"] == "悅" and "早" not in canon.loan_map() and canon.loan_map(either=True)["早"] == "蚤"
    assert "代" not in canon.taboo_map("tang") and canon.taboo_map("tang", True)["代"] == "世" and canon.taboo_map("tang")["泉"] == "淵"


@pytest.mark.parametrize(
    "text, want",
    [
        (None, ("unknown", "empty", 0.0)), ("   ", ("unknown", "too-short", 0.0)), ("漢字短文", ("unknown", "too-short", 0.0)), ("有㆑朋自遠方來不亦樂乎", ("kanbun", "kunten-marks", 0.95)),
        ("これは日本語の文章です。", ("ja", "kana-density", 0.95)), ("貞觀十九年春正月，帝幸東都。", ("zh-classical", "classical-default", 0.95)), ("这个国家的学生们说话", ("zh-modern", "simplified-sniff", 0.8)),
        ("see Tang 律疏 page twelve", ("mixed", "latin-mix", 0.85)), ("only some plain words", ("unknown", "no-rule-matched", 0.0)), ("1998年出版的国书目录123", ("zh-modern", "modern-digit", 0.85)),
    ],
)
def test_language_rules(spark, text, want):
    r = rules.with_language(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (r.language, r.rule, r.confidence) == want


@pytest.mark.parametrize(
    "text, fault",
    [
        (None, None), ("（空页）", None), ("This image shows a page", "english_image_description"), ("<|ref|>字<|/ref|>", "internal_token_leakage"), ("<table><td>字</td>", "html_table_markup"), ("| 1 | 2 | 3 |", "sequential_number_table"),
        ("short", None), ("plain words only " * 10, "low_cjk_ratio:0.000"), ("一" * 80 + "天地" * 20, "repeated_char:'一'"), ("12345678天" * 15, "digit_dominated"), ("天地玄黃宇宙洪荒" * 20, None),
    ],
)
def test_recognition_faults(spark, text, fault):
    assert one(spark, text, rules.recognition_fault) == fault


def test_validation_rescues_tables_and_refuses_turned_texts(spark):
    rows = [("<table><td>天地玄黃宇宙洪荒</td>&nbsp;</table>", True), ("<table><td>x</td></table>", True), ("国会说时学", True), ("国会说时学", False), ("（空页）", True), ("天地", True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, t string, old boolean")
    got = [(r.valid_text, r.error) for r in rules.with_validation(df, "t", F.col("old")).orderBy("id").collect()]
    assert got == [("天地玄黃宇宙洪荒", None), ("", "validation_failed:html_table_markup"), ("", "validation_failed:simplified_conversion:5/5"), ("国会说时学", None), ("", None), ("天地", None)]


def test_quality_gate_and_fusion(spark):
    han, noise = "天地玄黃宇宙洪荒" * 20, "plain words " * 20
    rows = [(han, han[:-1], None), (han, noise, None), (han, None, noise), (None, None, han), (None, noise, None), ("天地", "天" * 7, None), (han, han, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a string, b string, c string")
    got = [(r.policy, r.text, r.agreement) for r in fusion.fused(df, "a", "b", "c").orderBy("id").collect()]
    assert got == [("anchor+first", han, round(159 / 160, 4)), ("anchor", han, None), ("anchor", han, None), ("second", han, None), ("none", "", None), ("anchor", "天地", None), ("anchor+first", han, 1.0)]


def test_quotations_round_an_ellipsis(spark):
    text = "天" * 130 + "……" + "地" * 50 + "…省略" + "人" * 120 + "〈卷軸田畝閘門〉"
    got = one(spark, text, T.quoted_spans)
    assert got == ["卷軸田畝閘門", "天" * 100 + "……" + "地" * 50 + "…省略" + "人" * 47, text[82:182] + "…省略" + "人" * 100]
    assert one(spark, "no mark", T.quoted_spans) == [] and one(spark, "…", T.quoted_spans) == []


def sections_by_hand(text, size, overlap):
    import re

    def slide(t):
        out, at = [], 0
        while t:
            out.append(t[at : at + size])
            if at + size >= len(t):
                break
            at += size - overlap
        return out

    marks = [m.start() for m in re.finditer(r"(?m)^#{1,6}\s", text)]
    if not marks:
        return slide(text)
    parts = [text[: marks[0]]] * (marks[0] > 0) + [text[a:b] for a, b in zip(marks, [*marks[1:], len(text)])]
    out, held = [], ""
    for p in parts:
        if len(held) + len(p) <= size:
            held = (held + "\n" + p).lstrip()
            continue
        out += [held] * bool(held)
        held = "" if len(p) > size else p
        out += slide(p) if len(p) > size else []
    return [c for c in out + [held] * bool(held) if len(c) >= 10]


@pytest.mark.parametrize("text", ["plain " * 30, "# A\nshort\n## B\n" + "x" * 95 + "\n# C\n" + "y" * 20, "before it all\n# One\n" + "word " * 40 + "\n### Two\nz", "#no heading", "# t", ""])
def test_heading_sections(spark, text):
    assert one(spark, text, lambda x: T.heading_sections(x, 60, 10, 15)) == sections_by_hand(text, 60, 15)


def test_error_rate_and_route(spark):
    def plain(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev = [i] + [0] * len(b) if False else prev
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y)))
            prev = row
        return prev[-1]

    pairs = [("官吏與民", "官史與民"), ("für dich", "fur dich!"), ("", "abc"), (" 天地 ", "天地")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.c for r in df.select(T.error_rate(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == pytest.approx([plain(a.strip(), b.strip()) / len(b.strip()) for a, b in pairs])
    routes = spark.createDataFrame([(0.01, "OK"), (0.01, "DEGRADATION"), (0.01, "HENTAIGANA"), (0.05, "OK"), (0.15, "OK"), (0.2, None), (0.04, None)], "r double, k string")
    assert [r.x for r in routes.select(T.page_route(F.col("r"), F.col("k")).alias("x")).collect()] == ["pass", "failed", "needs_review", "needs_review", "failed", "failed", "pass"]


def test_tokens(spark):
    df = spark.createDataFrame([("The well-kept clerk's  mill!", "en"), ("天地 玄", None), ("مرحبا، بالعالم.", "ar"), ("  ", "en"), (None, "ja")], "t string, l string")
    got = [r.w for r in df.select(T.tokens(F.col("t"), F.col("l")).alias("w")).collect()]
    assert got == [["The", "well-kept", "clerk's", "mill"], ["天", "地", "玄"], ["مرحبا", "بالعالم"], [], []]


def test_intent_header_badge(spark):
    df = spark.createDataFrame([("when did he die", "primary"), ("why was it so", "primary"), ("唐代制度", "secondary"), ("mill", None)], "t string, tier string")
    assert [r.i for r in df.select(search.intent(F.col("t")).alias("i")).collect()] == ["factual", "interpretive", "synthesis", "unknown"]
    rows = spark.createDataFrame([("唐律", "名例", 2, "文"), ("唐律", "名例", 0, "文"), (None, None, 1, None), ("", "名例", None, "文")], "t string, c string, o int, x string")
    assert [r.h for r in rows.select(search.header(F.col("t"), F.col("c"), F.col("o"), F.col("x")).alias("h")).collect()] == ["《唐律·卷2》\n文", "《唐律·名例》\n文", "", "《名例》\n文"]


def test_knn_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [1.0])]
    df = spark.createDataFrame(rows, "i int, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for q in range(0, 300, 7):
        s = np.round(u[q] @ u.T, 9)
        want |= {(q, int(j)) for j in sorted((j for j in range(300) if j != q), key=lambda j: (-s[j], j))[:3]}
    for size in (10_000, 10):
        monkeypatch.setattr(search, "BLOCK", size)
        assert {(r.query, r.hit) for r in search.knn(df, "i", "v", df.where("i % 7 = 0 and i < 300"), "i", 3).collect()} == want


def test_bm25_scores_do_not_hang_on_other_queries(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["abcd xyz", "abcd", "abcd qrst", "zzzz yyyy"])], "i int, t string")
    asked = spark.createDataFrame([("a", "abcd"), ("b", "zzzz yyyy qrst")], "q string, x string")
    both = {(r.q, r.i): r.score for r in search.bm25(docs, "i", "t", asked, "q", "x", 5).collect()}
    alone = {(r.q, r.i): r.score for r in search.bm25(docs, "i", "t", asked.where("q = 'a'"), "q", "x", 5).collect()}
    assert alone and alone == {k: v for k, v in both.items() if k[0] == "a"}


def test_merges_take_the_last_change(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    c = spark.createDataFrame([(1, "x", 5), (1, "y", 9), (3, "z", 1), (1, "w", 9)], "k int, v string, at int")
    assert {tuple(r) for r in merge.upsert(t, c, ["k"], order="at").select("k", "v").collect()} == {(1, "y"), (2, "b"), (3, "z")}
    assert {tuple(r) for r in merge.patch(t, c, ["k"], order="at").select("k", "v").collect()} == {(1, "y"), (2, "b")}


def test_communities_and_dense_ids(spark):
    edges = [(a, b, 5) for g in ("pqr", "xyz") for a in g for b in g if a < b] + [("r", "x", 1), ("s", "t", 1)]
    df = spark.createDataFrame(edges, "a string, b string, weight int")
    got = {r.node: r.label for r in graphs.communities(df, least=3).collect()}
    assert set(got) == set("pqrxyz") and len({got[n] for n in "pqr"}) == 1 and len({got[n] for n in "xyz"}) == 1 and got["p"] != got["x"]
    ids = sorted((r.a, r.id) for r in graphs.dense_ids(df, "a").collect())
    assert [i for _, i in ids] == list(range(len(ids)))


def test_bm25_of_many_queries_with_grams_in_common(spark):
    """1,500 queries by 4,000 texts that share most grams, copies among them: as a plain loop has it, and soon."""
    import math
    import random
    import time
    from collections import Counter

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(3, 8))) for _ in range(60)]
    texts = {f"t{i:05d}": "the " + " ".join(rng.choices(words, weights=range(60, 0, -1), k=30)) for i in range(3_600)}
    texts |= {f"u{i:05d}": texts[f"t{i % 20:05d}"] for i in range(400)}
    asked = {f"q{i:04d}": texts[f"t{i % 1400:05d}"][5:125] for i in range(1_500)}
    began = time.time()
    found: dict[str, list] = {}
    df = search.bm25(spark.createDataFrame(list(texts.items()), "i string, t string"), "i", "t", spark.createDataFrame(list(asked.items()), "q string, x string"), "q", "x", 30, 6)
    for r in df.collect():
        found.setdefault(r.q, []).append((r.place, r.i, r.score))
    assert time.time() - began < 90
    grams = {i: Counter(b[j : j + n] for b in ["".join(t.split())] for n in (3, 4) for j in range(len(b) - n + 1)) for i, t in texts.items()}
    df_ = Counter(g for x in grams.values() for g in x)
    mean = sum(sum(x.values()) for x in grams.values()) / len(grams)
    idf = {g: math.log(len(texts) - n + 0.5) - math.log(n + 0.5) for g, n in df_.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    idf = {g: low if x < 0 else x for g, x in idf.items()}
    assert len(found) == 1_500
    for q in ("q0000", "q0019", "q0700", "q1450"):
        b = "".join(asked[q].split())
        own = Counter(b[j : j + n] for n in (3, 4) for j in range(len(b) - n + 1))
        scores = {i: round(sum(m * idf[g] * x[g] * 2.5 / (x[g] + 1.5 * (0.25 + 0.75 * sum(x.values()) / mean)) for g, m in own.items() if g in x), 6) for i, x in grams.items()}
        want = sorted(((i, s) for i, s in scores.items() if s > 0), key=lambda x: (-x[1], x[0]))[:30]
        assert [(i, round(s, 5)) for _, i, s in sorted(found[q])] == [(i, round(s, 5)) for i, s in want]


def test_keywords_of_many_queries_and_items(spark):
    """A term of every query that all keywords hold, and a keyword of every item, are not multiplied by each other."""
    import time
    from collections import Counter

    n = 15_000
    terms = [(f"q{i:05d}", t) for i in range(n) for t in ("a", f"b{i % 7}")]
    mentions = [(f"i{i:05d}", w) for i in range(n) for w in ("a", f"a{i % 40}x", f"cb{i % 9}")]
    began = time.time()
    found: dict[str, list] = {}
    df = search.by_keyword(spark.createDataFrame(terms, "q string, term string"), spark.createDataFrame(mentions, "i string, w string"), "q", "i", "w", 3, 5)
    for r in df.collect():
        found.setdefault(r.q, []).append(r.i)
    assert time.time() - began < 45
    count = Counter(w for _, w in mentions)
    for q in ("q00000", "q00006", "q14999"):
        mine = [t for x, t in terms if x == q]
        chosen = sorted((w for w in count if any(t in w for t in mine)), key=lambda w: (-count[w], w))[:3]
        assert sorted(found[q]) == sorted({i for i, w in mentions if w in chosen})[:5]
    assert len(found) == n
