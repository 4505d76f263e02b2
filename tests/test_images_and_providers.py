import numpy as np
from pyspark.sql import functions as F

from quirefold.functions import layout as L
from quirefold.functions import metadata as M
from quirefold.operators import images as I
from quirefold.operators import providers
from quirefold.operators import providers as P


def test_images():
    page = np.full((100, 80), 250, np.uint8)
    page[20:80:4, 10:70] = 10
    assert not I.is_inverted(page) and I.is_inverted(255 - page)
    assert I.gray(np.zeros((2, 2, 3), np.uint8)).shape == (2, 2)
    assert abs(I.skew(np.array([1.2, 1.4, 1.3, 40.0, 91.3])) - 1.3) < 1e-6
    assert I.skew(np.array([])) == 0.0 == I.skew(np.array([0.1]))
    spread = np.concatenate([page, np.full((100, 12), 255, np.uint8), page], axis=1)
    assert abs(I.gutter(spread) - 86) <= 12 and I.gutter(page) is None
    assert I.margin_bands(page) == (20, 0) or I.margin_bands(page)[0] == 20
    assert I.smooth(np.array([1.0, 1, 1]), 3).tolist() == [1.0, 1.0, 1.0]
    assert I.stretched(page).max() == 255 and I.worth_enhancing(page)


def test_layout(spark):
    df = spark.createDataFrame([('[{"type":"title","text":"One","bbox":[0,0,4,2]},{"type":"header","text":"h","bbox":[0,0,1,1]},{"type":"text","text":"body","bbox":[0,2,4,9]},{"type":"text","text":"no box"}]', "[broken")], "r string, l string")
    got = df.select(L.markdown(L.regions_of(F.col("r"))).alias("md"), F.size(L.lines_of(F.col("l"))).alias("n"), L.box(F.array(*[F.lit(x) for x in (1, 2, 5, 9)])).alias("b")).first()
    assert got.md == "# One\n\nbody" and got.n == 0 and got.b == [1, 2, 4, 7]


def test_edition(spark):
    df = spark.createDataFrame([("/c/012_The Rolls (Book II) [Zorlinth Press] 1445.pdf",)], "p string")
    e = df.select(M.edition(F.col("p"), ["Zorlinth Press"]).alias("e")).first().e
    assert (e.title, e.publisher, e.year, e.confidence) == ("012_The Rolls 1445", "Zorlinth Press", 1445, 0.5)


def test_providers(spark):
    df = spark.createDataFrame([(1, "the harbour ledger ledger"), (2, None)], "id int, t string")
    vectors = {r.id: r.embedding for r in P.embed(df, "id", "t").collect()}
    assert len(vectors[1]) == P.DIMS and not any(vectors[2])
    assert {r.id: r.keywords for r in P.extract(df, "id", "t").collect()} == {1: ["ledger", "harbour"], 2: []}
    assert [r.relevance for r in P.rerank(df.withColumn("q", F.lit("ledger")), ["id"], "q", "t").orderBy("id").collect()] == [1.0, 0.0]


def test_editions_by_name_and_package(spark):
    names = ["唐律疏議箋解 (劉俊文 撰) (中華書局 1996).epub", "王小明_唐代制度研究.pdf", "《冊府元龜》（校訂本）.pdf", None]
    hints = "struct<creators:array<string>,publishers:array<string>,dates:array<string>>"
    df = spark.createDataFrame([(i, n, (["（五代）王定保 撰"], ["上海書局"], ["2003-01"]) if i == 2 else None) for i, n in enumerate(names)], f"i int, p string, h {hints}")
    own = M.edition(F.col("p"), ["中華書局"])
    rows = df.select("i", own.alias("e"), M.enriched(own, F.col("h"), ["中華書局"]).alias("m")).orderBy("i").collect()
    assert [(r.e.title, r.e.author, r.e.publisher, r.e.year, r.e.layers, r.e.confidence) for r in rows[:3]] == [
        ("唐律疏議箋解", "劉俊文", "中華書局", 1996, ["疏議", "箋解"], 0.7), ("唐代制度研究", "王小明", None, None, [], 0.3), ("冊府元龜", None, None, None, ["校訂"], 0.3),
    ]
    assert (rows[2].m.author, rows[2].m.publisher, rows[2].m.year, rows[2].m.confidence) == ("王定保", "上海書局", 2003, 0.45)


def test_stages_of_providers(spark):
    @providers.register("recognise", "fixed")
    def fixed(rows):
        return ["天地玄黃" if r["image"] == "a" else "This image shows nothing" if r["image"] == "b" else None for r in rows]

    @providers.register("review", "twice")
    def twice(rows):
        return ['{"ok": %s, "issues": [], "revised": "%s"}' % (("true", "") if r["draft"].endswith("!!") else ("false", r["draft"] + "!")) for r in rows]

    pages = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, image string")
    got = {r.id: (r.text, r.status, r.confidence) for r in providers.recognised(pages, "id", "image", "fixed", F.lit(True)).collect()}
    assert got == {1: ("天地玄黃", "ok", 0.85), 2: ("", "empty", 0.0), 3: (None, "empty", 0.0)}
    laid = {r.id: (r.regions, r.status) for r in providers.laid_out(pages, "id", "image", "none", F.col("id") == 3).collect()}
    assert laid == {1: ([], "empty"), 2: ([], "empty"), 3: (None, "manuscript")}
    texts = spark.createDataFrame([(1, "source", "draft"), (2, "source", "done!!")], "id int, s string, d string")
    assert {r.id: (r.draft, r.turns) for r in providers.reviewed(texts, "id", "s", "d", ["twice", "accept"]).collect()} == {1: ("draft!!", 4), 2: ("done!!", 2)}
    rated = spark.createDataFrame([(1, "天地玄黃", "天地玄黃"), (2, "天地玄", "天地玄黃"), (3, "x", "天地玄黃")], "id int, a string, b string")
    assert {r.id: (r.kind, r.route) for r in providers.evaluated(rated, "id", "a", "b").collect()} == {1: ("OK", "pass"), 2: ("OK", "failed"), 3: ("DEGRADATION", "failed")}
    assert providers.translated_titles(texts, "id", "s", ["en", "ja"]).count() == 4
    entries = spark.createDataFrame([("天",), ("天地",), ("玄黃",)], "term string")
    words = providers.word_analysis(spark.createDataFrame([(1, "天 玄", None)], "id int, t string, l string"), "id", "t", "l", F.lit(None).cast("string"), entries, "term").orderBy("n", "term").collect()
    assert [(r.token, r.term, r.how) for r in words] == [("天", "天", "exact"), ("玄", None, "none")]
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("passing")
        return x

    assert providers.attempts(flaky, (OSError,), wait=0.001)(7) == 7 and len(calls) == 3


def test_replies_and_prompts(spark):
    from quirefold.functions import replies as R

    df = spark.createDataFrame([('[{"name":"a","weight":2},{"name":"b"',), ("{'ok': true}",), (None,)], "x string")
    rows = df.select(R.keywords(F.col("x")).alias("k"), R.page_class(F.col("x")).alias("c"), R.review_verdict(F.col("x")).alias("v")).collect()
    assert [(k.name, k.weight, k.type) for k in rows[0].k] == [("a", 1.0, "OTHER")] and rows[1].v.ok and rows[2].c.kind == "OK" and rows[2].v.ok and rows[2].k == []
    assert spark.createDataFrame([(["x", None],)], "t array<string>").select(R.prompt_blocks(F.col("t")).alias("p")).first().p == "[1] x\n\n[2] "


def test_chain_of_image_steps(spark):
    page = np.full((200, 160), 245, np.uint8)
    for y in range(40, 160, 8):
        page[y : y + 2, 15:145] = 10
    slanted = I.turned(page, -2.0)
    assert abs(I.measured_skew(slanted) - 2.0) <= 0.3 and I.measured_skew(page) == 0.0 and I.measured_skew(np.full((9, 9), 255, np.uint8)) == 0.0
    shaded = np.clip(page * np.linspace(0.7, 1.0, 160), 0, 255).astype(np.uint8)
    even, measures = I.flattened(shaded)
    assert measures["applied"] and I.background(even).std() < I.background(shaded).std() / 2
    spread = np.concatenate([page, np.full((200, 24), 250, np.uint8), page], axis=1)
    rows = [("a", *page.shape, 1, page.tobytes()), ("b", *spread.shape, 1, spread.tobytes()), ("c", 9, 9, 1, b"x"), ("d", 9, 9, 1, None), ("e", *page.shape, 1, (255 - page).tobytes())]
    got: dict = {}
    for r in I.preprocess(spark.createDataFrame(rows, "id string, height int, width int, channels int, pixels binary")).collect():
        got.setdefault(r.id, {})[r.part] = r
    assert set(got["a"]) >= {"page"} and {"page", "right"} <= set(got["b"]) and set(got["c"]) == set(got["d"]) == {"failed"}
    assert '"gutterAt": null' in got["a"]["page"].provenance and '"backgroundStd"' in got["a"]["page"].provenance and '"inverted": true' in got["e"]["page"].provenance
    assert all(len(r.pixels) == r.height * r.width for parts in got.values() for r in parts.values() if r.part != "failed")


def test_translation_stage(spark):
    rows = [(1, "説国", "primary", "zh"), (2, "abc", "secondary", "en"), (3, "", "primary", "zh"), (4, "說", None, None)]
    df = spark.createDataFrame(rows, "id int, t string, tier string, lang string")
    got = {r.id: (r.text, r.status) for r in providers.translated(df, "id", "t", "tier", "lang", F.lit(None).cast("string"), ["accept"]).collect()}
    assert got == {1: ("説國", "ok"), 2: ("abc", "normalized"), 4: ("說", "normalized")}
