import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirefold.llm import languages, leakage, neighbours, page_lines, rank_fusion, residue, scan_repair, sentences, shared_spans, splitting, tokenize

ALPHABET = "ab c.。、\n　漢字"


# 1 -------------------------------------------------------------------------------------------------------------


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 64)).astype(np.float32)
    x[300:400] = x[:100] + 0.05 * rng.normal(size=(100, 64))
    x[400:420] = x[0] * 3  # copies in direction
    rows = [(f"k{i:03d}", 1, v.tolist()) for i, v in enumerate(x)]
    rows += [("bad1", 1, [0.0] * 64), ("bad2", 1, [float("nan")] * 64), ("bad3", 1, [1.0]), ("bad4", 1, None), ("k000", 0, [1.0] * 64)]
    df = spark.createDataFrame(rows, "id string, at int, v array<float>")
    u = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    c = np.round(u @ u.T, 5)
    np.fill_diagonal(c, -1)
    want = set()
    for i in range(len(x)):
        for j in sorted(np.flatnonzero(c[i] >= 0.9), key=lambda j: (-c[i, j], j))[:10]:
            want.add((f"k{i:03d}", f"k{j:03d}"))
    got = {(r.id, r.other): r.cosine for r in neighbours.neighbours(df, "id", "v", "at", 10, 0.9).collect()}
    # copies may be listed in another order where cosines agree to the last digits
    own = {p for p in want if int(p[0][1:]) not in range(400, 420) and p[0] not in ("k000", "k300")}
    assert own <= set(got)
    assert not any(k.startswith("bad") for p in got for k in p)


def test_nearest_recall(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    x[:400] += 2 * x[0]
    units = neighbours.sound(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<float>"), "id", "v", None).cache()
    got: dict = {}
    for r in neighbours.nearest(units, units.where("id % 100 = 0"), "id", 10, probes=60).collect():
        got.setdefault(r.id, set()).add(r.other)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for q in range(0, 3000, 100):
        s = u[q] @ u.T
        s[q] = -9
        hit += len(set(np.argsort(-s)[:10].tolist()) & got[q])
        total += 10
    assert hit / total >= 0.9 and all(len(v) == 10 for v in got.values())
    assert neighbours.nearest(units.limit(0), units.limit(0), "id", 10).count() == 0


def test_forest_recall():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 64)).astype(np.float32)
    x[3000:] = x[:3000] + 0.3 * rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = neighbours.fit_forest(x, len(x))
    own, seen = neighbours.search_forest(x, *forest, neighbours.PROBES)
    hit = (seen[:3000][:, :, None] == own[3000:][:, None, :]).any((1, 2))
    assert hit.mean() >= 0.95


def test_large_leaves_are_split_again():
    """A leaf over SPLIT vectors is searched by trees of its own: few comparisons, and close pairs are met."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12_000, 64)).astype(np.float32)
    x[6000:] = x[:6000] + 0.25 * rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(12_000)
    met, compared = set(), 0
    for q in range(0, 6000, 1000):
        for rows, inside in neighbours.leaf_blocks(ids, x, x[q : q + 1000]):
            compared += len(rows) * len(inside)
            met |= {(q + rows[a], inside[b]) for a, b in zip(*np.nonzero(x[q : q + 1000][rows] @ x[inside].T > 0.92))}
    close = {i for i in range(6000) if x[i] @ x[6000 + i] > 0.92}
    assert len(close) > 3000 and sum((i, 6000 + i) in met for i in close) >= 0.95 * len(close)
    assert compared < 0.35 * 6000 * 12_000


def test_every_copy_has_its_list(spark):
    rng = np.random.default_rng(4)
    one, near = rng.normal(size=64), rng.normal(size=64)
    rows = [(f"c{i:02d}", (one * (1 + i)).tolist()) for i in range(15)] + [("n1", (one + 0.05 * near).tolist()), ("z1", near.tolist()), ("z2", (2 * near).tolist())]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    got: dict = {}
    for r in neighbours.neighbours(df, "id", "v", None, 3, 0.9).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r.other)
    assert got["c14"] == ["c00", "c01", "c02"] and got["c00"] == ["c01", "c02", "c03"] and got["z1"] == ["z2"] and got["n1"] == ["c00", "c01", "c02"]
    units = neighbours.sound(df, "id", "v", None)
    asked = neighbours.nearest(units, units.where("id in ('c14', 'n1', 'z1')"), "id", 3).orderBy("id", "place").collect()
    assert [[r.other for r in asked if r.id == i] for i in ("c14", "n1")] == [["c00", "c01", "c02"], ["c00", "c01", "c02"]]
    assert [r.other for r in asked if r.id == "z1"][0] == "z2" and len([r for r in asked if r.id == "z1"]) == 3


def test_codes_keep_vectors_with_one_large_component(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 64)).astype(np.float32)
    x[:, 7] += np.repeat([30, 14, -9, 0], 30)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -1)
    df = spark.createDataFrame([(f"k{i:03d}", 1, v.tolist()) for i, v in enumerate(x)], "id string, at int, v array<float>")
    want = {(f"k{i:03d}", f"k{j:03d}") for i in range(120) for j in np.argsort(-c[i])[:10] if c[i, j] >= 0.92}
    lists = neighbours.neighbours(df, "id", "v", "at", 10, 0.92).collect()
    assert len(want) == 300 and want == {(r.id, r.other) for r in lists}
    y, slack = neighbours.decoded(neighbours.codes(u))
    assert (np.outer(slack, slack) - 1 + 1e-6 >= u @ u.T - y @ y.T).all() and np.abs(y @ y.T - u @ u.T).max() < 0.02


# 2 -------------------------------------------------------------------------------------------------------------


def pieces_of(text, limit, overlap, span):
    body = text.strip()
    tables = [dict(zip(("n", "lead", "trail", "longest", "first", "last"), splitting.range_table(splitting.code_points(body[a : a + span]), max(1, limit // 10)))) for a in range(0, len(body), span)]
    longest, starts, ends, forced = splitting.stitch(tables, limit, overlap)
    return body, longest, starts, ends, forced


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=ALPHABET, min_size=60, max_size=400), st.integers(7, 90))
def test_pieces_round_trip(text, span):
    body = text.strip()
    if len(body) <= 50:
        return
    body, longest, starts, ends, forced = pieces_of(text, 50, 8, span)
    whole = pieces_of(text, 50, 8, 10_000)
    assert longest == whole[1] == max(map(len, __import__("re").split(r"[\s.。、]", body)))
    assert starts[0] == 0 and ends[-1] == len(body) and all(b - a <= 50 for a, b in zip(starts, ends))
    assert all(s == e - 8 for s, e in zip(starts[1:], ends)) and body == body[: ends[0]] + "".join(body[e - 0 : f] for e, f in zip(ends, ends[1:]))
    for a, b, f in zip(starts, ends, forced):
        if f:
            assert not any(c in " .。、\n　" for c in body[a + 8 : b])


def test_split_files_like_texts(spark, tmp_path):
    rng = random.Random(4)
    text = "".join(rng.choice(["漢", "é", "a", ". ", "。", "\n", "word "]) for _ in range(4000)).strip()
    path = tmp_path / "big.txt"
    path.write_bytes(text.encode())
    by_file = [(r.start, r.end, r.text) for r in splitting.split_files(spark, [(str(path), path.stat().st_size)], 300, 30, 1000).orderBy("piece").collect()]
    df = spark.createDataFrame([("x", text, 300)], "id string, t string, most int")
    by_text = [(r.start, r.end, r.text) for r in splitting.pieces(df, ["id"], "t", "most", 30, 512).orderBy("piece").collect()]
    assert [t for *_, t in by_file] == [text[a:b] for a, b, _ in by_file]
    assert by_text == [(a, b, text[a:b]) for a, b, _ in by_text]
    assert by_file[-1][1] == by_text[-1][1] == len(text)
    assert all(len(t) <= 300 for *_, t in by_file) and all(b[0] == a[1] - 30 for a, b in zip(by_file, by_file[1:]))


def test_files_of_one_range_of_many_and_of_none(spark, tmp_path):
    texts = {"a.txt": "word. " * 900, "b.txt": "漢" * 2500, "c.txt": "", "d.txt": "x", "e.txt": "\ufeffé\n" * 1200}
    for n, t in texts.items():
        (tmp_path / n).write_bytes(t.encode())
    rows = [(str(tmp_path / n), len(t.encode())) for n, t in texts.items()]
    got: dict = {}
    for r in splitting.split_files(spark, rows, 100, 10, 700).orderBy("path", "piece").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert set(got) == {"a.txt", "b.txt", "d.txt", "e.txt"}
    for n, rs in got.items():
        t = texts[n]
        assert rs[0].start == 0 and rs[-1].end == len(t) and all(r.text == t[r.start : r.end] and len(r.text) <= 100 for r in rs)
        assert all(b.start == a.end - 10 for a, b in zip(rs, rs[1:])) and len(rs) > 3 * (n != "d.txt")
    assert any(r.forced for r in got["b.txt"]) and not any(r.forced for r in got["a.txt"])


def test_pages_cross_ranges(spark, small):
    """The whole tables hold texts of several ranges, so their tables are stitched by the queries too."""
    from quirefold.llm import queries

    tables = splitting.boundary_tables(queries._texts(spark, small.replace("sf0.001", "sf0.01")), ["kind", "item_id"], "text", "most")
    assert tables.where("range > 0").count() > 0


def test_forced_and_very_long(spark):
    df = spark.createDataFrame([(1, "x" * 200_000, 500), (2, "ab. " * 300, 500), (3, None, 500), (4, "  \n ", 500)], "id int, t string, most int")
    plan = splitting.stitched(splitting.boundary_tables(df, ["id"], "t", "most", 4096), ["id"], "most", 50)
    got = {r.id: (r.longest, len(r.starts)) for r in plan.collect()}
    assert got[1][0] == 200_000 and got[2][0] == 2 and set(got) == {1, 2}


# 3 -------------------------------------------------------------------------------------------------------------

SAMPLES = {
    "en": "The older customs of the harbour were collected in a ledger at the audit.",
    "ja": "沿岸の帳簿は墨跡の寺院を記録することになった。",
    "zh-modern": "我们可以整理详细的报告，这些法令是从段落中修订出来的。",
    "zh-classical": "始治鐘鼓為烽燧，掌甲兵於舟楫，豐歲有問乎。是以鄉老厚傳矣。",
    "kanbun": "車㆑馬而安理，奪㆓商賈㆒以園圃，告身所㆑廣理。",
}


@pytest.mark.parametrize("language", list(SAMPLES))
def test_languages(language):
    assert languages.detect(SAMPLES[language])[0] == language


def test_mixed_and_remarks():
    both = SAMPLES["en"] + "\n\n" + SAMPLES["zh-classical"] * 3
    name, confidence, runs, parts = languages.detect(both)
    assert name == "mixed" and set(parts) == {"en", "zh-classical"} and 0.5 < confidence <= 1
    assert "".join(both[a:b] for a, b, *_ in runs)
    assert languages.detect(SAMPLES["ja"] * 4 + "（Corbaveka）")[0] == "ja"
    assert languages.detect("") == ("und", 0.0, [], []) and languages.detect("123 。")[0] == "und"


def test_pages_of_any_length_have_a_language(spark):
    from quirefold.llm import page_language

    rows = [("a", "b", 0, "native", SAMPLES["en"] * 40, "en", 1), ("c", "b", 1, "native", SAMPLES["ja"], "en", 1), ("d", "b", 2, "scan", " ", None, 1), ("e", "b", 3, "native", None, None, 1)]
    pages = spark.createDataFrame(rows, "id string, documentId string, docPageIndex int, mode string, textFused string, language string, at int").withColumn("fusionAt", F.timestamp_seconds("at"))
    got = {r.id: r for r in page_language.page_languages(pages, spark.createDataFrame([("b", "Title")], "id string, title string")).collect()}
    assert got["a"].language == "en" and got["a"].length > 1500 and got["a"].segments[-1].end >= got["a"].length - 1 and got["a"].confidence > 0.5
    assert got["c"].language == "ja" and got["d"].language is None is got["e"].language


# 4 -------------------------------------------------------------------------------------------------------------


def test_furniture():
    page = page_lines.Furniture("A SURVEY OF THE BELL   12\nA bare number\n396\nstays.\n— 12 —", "A Survey of the Bell", 11)
    assert page.header == {0} and page.number == {0, 4} and page.body() == ["A bare number", "396", "stays."]
    assert page_lines.Furniture("xii\ntext\n13", None, 11).number == {0}
    assert page_lines.Furniture("第一八葉\n本文", None, 17).number == {0} and page_lines.Furniture("xvii\ntext", None, 316).number == {0}
    assert page_lines.Furniture("17\ntext", None, 316).number == set()
    assert page_lines.Furniture("5   陌 陌 鐘 鼓 考\n本文", "陌陌鐘鼓考", 4).header == {0}
    assert page_lines.Furniture("A Survey of\nbody line", "A Survey of the Bell", 1).header == {0}
    assert page_lines.Furniture("The bell of the survey was heavy.\nbody", "A Survey of the Bell", 1).header == set()


def test_numbers_of_a_further_volume(spark):
    """Printed numbers that restart are known by the pages around; a number no neighbour bears out is content."""
    rows = [(f"p{i:03d}", "b", i, "scan", f"{i % 60 + 1}\nbody of the page" if i % 2 else f"body of the page\n{1000 + 7 * i}") for i in range(180)]
    pages = spark.createDataFrame(rows, "id string, documentId string, docPageIndex int, mode string, textFused string").withColumn("fusionAt", F.timestamp_seconds("docPageIndex")).withColumn("title", F.lit(None).cast("string"))
    for f in scan_repair.FIELDS[1:]:
        pages = pages.withColumn(f, F.lit(None).cast("string"))
    numbered = {r.page_id for r in scan_repair.defects(*scan_repair.scanned(pages)).where("defect = 'page_number'").collect()}
    assert numbered == {f"p{i:03d}" for i in range(1, 180, 2)}


def test_rejoin():
    compounds = {"type-founder"}
    assert scan_repair.rejoin(["the con-", "fiscated title", "", "new"], compounds) == (["the confiscated title", "new"], True)
    assert scan_repair.rejoin(["a type-", "founder"], compounds) == (["a type-founder"], False)
    assert scan_repair.rejoin(["漢字", "仮名"], compounds) == (["漢字仮名"], False)
    assert scan_repair.rejoin([], compounds) == ([], False)


def test_word_repairs(spark):
    known = spark.createDataFrame([("the", 900), ("magistrate", 90), ("learned", 60), ("harbour", 50)], "token string, n bigint")
    strange = spark.createDataFrame([("tbe", 1), ("rnagistrate", 1), ("leamed", 2), ("harbours", 1), ("zebra", 1)], "token string, n bigint")
    assert {r.word: r.repair for r in scan_repair.repairs(strange, known).collect()} == {"tbe": "the", "rnagistrate": "magistrate", "leamed": "learned"}


def test_word_pairs_pick_among_repairs_and_find_misread_words(spark):
    """The words beside decide between equally near candidates, and tell a misreading that gives another word."""
    asked = spark.createDataFrame([("bead", "the", "of"), ("bead", "a", "string"), ("rnat", "", ""), ("modem", "of", "days"), ("modem", "a", "line")], "word string, before string, after string")
    found = [("bead", "head", 90, 0.3, False), ("bead", "beard", 95, 0.3, False), ("rnat", "mat", 9, 0.3, False), ("modem", "modern", 80, 0.3, True)]
    pairs = [("the head", 60), ("head of", 50), ("beard string", 9), ("a beard", 30), ("of modern", 40), ("modern days", 40), ("a modem", 30), ("modem line", 30)]
    got = scan_repair.picked(asked, spark.createDataFrame(found, "word string, repair string, m bigint, cost double, own boolean"), spark.createDataFrame(pairs, "token string, n bigint"))
    assert {tuple(r) for r in got.select("word", "before", "after", "repair").collect()} == {("bead", "the", "of", "head"), ("bead", "a", "string", "beard"), ("rnat", "", "", "mat"), ("modem", "of", "days", "modern")}
    alike = scan_repair.confusable(spark.createDataFrame([("modem", 9), ("modern", 8), ("zebra", 7)], "token string, n bigint"))
    assert {(r.word, r.repair) for r in alike.collect()} == {("modem", "modern"), ("modern", "modem")}


def test_compounds_beyond_the_broadcast_keep_their_hyphen(spark, monkeypatch):
    texts = ["the type-founder and the salt-pan came"] * 5 + ["a well-kept salt-pan stood"] * 9 + ["he saw the type-\nfounder there", "a con-\nfiscated salt-\npan stood"]
    pages = spark.createDataFrame([(f"p{i:02d}", "scan", t, None, i, i) for i, t in enumerate(texts)], "id string, mode string, textFused string, title string, docPageIndex int, at int").withColumn("fusionAt", F.timestamp_seconds("at"))
    for f in scan_repair.FIELDS[1:]:
        pages = pages.withColumn(f, F.lit(None).cast("string"))
    for bound in (120_000, 1):
        monkeypatch.setattr(scan_repair, "HEAD_WORDS", bound)
        parts = scan_repair.scanned(pages)
        assert [r.page_id for r in scan_repair.defects(*parts).where("defect = 'hyphen'").collect()] == ["p15"]
        assert [r.text for r in scan_repair.repaired(*parts).where("page_id >= 'p14' and field = 'textFused'").orderBy("page_id").collect()] == ["he saw the type-founder there", "a confiscated salt-pan stood"]


def test_the_short_list_is_full_where_most_rows_are_ties(spark):
    from quirefold.llm.common import head

    df = spark.range(20_000).select(F.col("id").cast("string").alias("t"), F.when(F.col("id") < 50, 9).otherwise(1).alias("n"))
    kept = head(df, "n", "t", 1000).collect()
    assert 900 <= len(kept) <= 1000 and sum(r.n == 9 for r in kept) == 50


def test_lookalikes():
    look = scan_repair.Lookup({"coin"}, set(), {"官吏": 900, "吏與": 400, "歷史": 80, "史稿": 90})
    assert look.wide_repairs("官史與") == [(1, "吏")] and look.wide_repairs("歷史稿") == []
    assert [look.word_kind(w) for w in ("coin", "c0in", "380r", "co□n", "42", "!nn", "unseen")] == ["sound", "misread", "sound", "misread", "sound", "misread", "unknown"]


# 5 -------------------------------------------------------------------------------------------------------------


def test_fusion_against_brute_force(spark):
    rng = random.Random(1)
    rows = [("q", leg, f"c{i}", rng.choice([1.0, 2.0, 3.0, rng.random() * 1000])) for leg in "abc" for i in range(40) if rng.random() < 0.9]
    rows += [("q", "a", "c1", float("nan")), ("q", "a", "c2", None), (None, "a", "c3", 1.0), rows[0]]
    df = spark.createDataFrame(rows, "query_id string, leg string, chunk_id string, score double")
    got = {r.chunk_id: r for r in rank_fusion.fuse(df, list("abc")).collect()}
    best = {}
    for q, leg, c, s in rows:
        if q and s is not None and s == s:
            best[leg, c] = max(s, best.get((leg, c), s))
    for leg in "abc":
        own = {c: s for (g, c), s in best.items() if g == leg}
        for c, s in own.items():
            assert got[c][f"place_{leg}"] == 1 + sum(o > s for o in own.values())
    assert all(0 < r.rho <= 1 for r in got.values())
    ranked = rank_fusion.ranking(rank_fusion.fuse(df, list("abc"))).collect()
    assert min(r.place for r in ranked) == 1
    wins = {c for c, r in got.items() for at in [sorted(r[f"place_{x}"] or 999 for x in "abc")] if at[1] == 1 and at[2] <= 3}
    assert {r.chunk_id for r in rank_fusion.clear_winners(rank_fusion.fuse(df, list("abc")), list("abc")).collect()} == wins
    scaled = df.withColumn("score", F.when(F.col("leg") == "a", F.exp(F.col("score") / 100)).otherwise(F.col("score")))
    assert {r.chunk_id: r.rho for r in rank_fusion.fuse(scaled, list("abc")).collect()} == {c: r.rho for c, r in got.items()}


def test_significance_selects_the_winners(spark):
    """Every case lies within the bound of its rho, few others do; the filter stays in the plan."""
    rng = random.Random(6)
    rows = [(f"q{q}", leg, f"c{i}", round(rng.random(), 1) if q % 3 else rng.random()) for q in range(60) for leg in "abc" for i in range(1 + q % 17) if rng.random() < 0.95]
    fused = rank_fusion.fuse(spark.createDataFrame(rows, "query_id string, leg string, chunk_id string, score double"), list("abc")).cache()
    every = fused.collect()
    wins = {(r.query_id, r.chunk_id) for r in every for at in [sorted(r[f"place_{x}"] or 999 for x in "abc")] if at[1] == 1 and at[2] <= 3}
    likely = {(r.query_id, r.chunk_id) for r in fused.where(F.col("rho") <= rank_fusion.winning_rho(list("abc")) * (1 + 1e-9)).collect()}
    found = rank_fusion.clear_winners(fused, list("abc"))
    assert wins and {(r.query_id, r.chunk_id) for r in found.collect()} == wins <= likely and len(likely) < len(every) / 2
    assert "rho" in found.select("query_id")._jdf.queryExecution().optimizedPlan().toString()


# 6 -------------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcd", min_size=0, max_size=200), min_size=2, max_size=4), st.text(alphabet="abcd", min_size=64, max_size=70), st.integers(0, 40))
def test_fingerprints_miss_nothing(texts, common, at):
    texts = [t[:at] + common + t[at:] for t in texts]
    lengths = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    no, pos, h, _ = shared_spans.fingerprints(points, lengths)
    sets = [set(h[no == i].tolist()) for i in range(len(texts))]
    assert all(sets[0] & s for s in sets[1:])
    for i, p, x in zip(no, pos, h):
        assert 0 <= p <= lengths[i] - shared_spans.GRAM


def test_shared_spans(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common, run = word(64), "x" * 300
    first = [("a", word(50) + common + word(90)), ("b", common), ("c", word(200)), ("d", common[:63] + "Z" * 40), ("e", run), ("f", run + "y"), ("g", "b" * 10), ("h", None), ("b", common)]
    second = [("i", word(10) + common), ("j", common)]
    batches = [spark.createDataFrame(b, "rec string, text string") for b in (first, second)]
    links, members = shared_spans.shared(batches)
    got = {(r.rec_a, r.rec_b) for r in shared_spans.record_pairs(links, members).collect()}
    assert got == {("a", "b"), ("a", "i"), ("a", "j"), ("b", "i"), ("b", "j"), ("i", "j"), ("e", "f")}
    share = {r.rec: r.share for r in shared_spans.coverage(links, members, batches[0].unionByName(batches[1]).distinct()).collect()}
    assert share["b"] == 1.0 and share["c"] == 0.0 and share["a"] == pytest.approx(64 / 204)


def _tied(pairs):
    """The classes that links join."""
    of: dict = {}

    def root(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for a, b in pairs:
        of[root(a)] = root(b)
    out: dict = {}
    for x in list(of):
        out.setdefault(root(x), set()).add(x)
    return {frozenset(v) for v in out.values()}


def test_hot_windows_link_by_class(spark, monkeypatch):
    """A paragraph in many texts gives a link a text, not one a pair; other links of these texts stay."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    notice, own = word(150), word(80)
    rows = [(f"r{i:03d}", word(60 + i % 7) + notice + word(40)) for i in range(40)]
    rows += [("x", word(30) + own + word(9)), ("y", own), ("z", word(90)), ("r100", word(30) + notice[:100] + own), ("r101", notice[40:110])]
    df = spark.createDataFrame(rows, "rec string, text string")
    want = {(a, b) for a, t in rows for b, u in rows if a < b and any(t[i : i + 64] in u for i in range(len(t) - 63))}
    links, members = shared_spans.shared([df])
    assert {tuple(r) for r in shared_spans.record_pairs(links, members).collect()} == want
    plain = {r.rec: (r.covered, r.others) for r in shared_spans.coverage(links, members, df).collect()}
    monkeypatch.setattr(shared_spans, "HOT", 10)
    links, members = shared_spans.shared([df])
    got = {tuple(r) for r in shared_spans.record_pairs(links, members).collect()}
    assert got <= want and len(got) < 5 * len(rows) and _tied(got) == _tied(want)
    hot = {r.rec: (r.covered, r.others) for r in shared_spans.coverage(links, members, df).collect()}
    assert {k: v[0] for k, v in hot.items()} == {k: v[0] for k, v in plain.items()}


def test_index_goes_on_with_what_stands_in_its_folder(spark, tmp_path):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common, tail, folder = word(70), word(30), str(tmp_path / "index")
    days = [[("a", word(20) + common), ("b", word(90))], [("c", common + tail), ("a2", "")], [("d", word(9) + common), ("c", common + tail)]]
    found = []
    for rows in days:
        index = shared_spans.FingerprintIndex(spark, folder)
        links, _ = shared_spans.shared([spark.createDataFrame(rows, "rec string, text string")], index)
        found.append(links.count())
        for run in index.runs:
            spark.sql(f"DROP TABLE {run}")  # as a new session would not know them
    assert found == [0, 1, 2] and len(shared_spans.FingerprintIndex(spark, folder).runs) == 3


def test_copies_beyond_the_bound_keep_their_links(spark, monkeypatch):
    monkeypatch.setattr(shared_spans, "COPIES", 3)
    text, rows = "A long enough paragraph of the harbour rolls, as it was read at the audit of spring.", []
    rows = [(f"k{i}", text) for i in range(6)] + [("m", text + " More of it."), ("s", "short"), ("n", None)]
    df = spark.createDataFrame(rows, "rec string, text string")
    links, members = shared_spans.shared([df])
    got = {tuple(r) for r in shared_spans.record_pairs(links, members).collect()}
    assert all((f"k{i}", "m") in got for i in range(6)) and all(("k0", f"k{i}") in got for i in range(1, 6)) and ("k3", "k4") not in got
    share = {r.rec: (r.others, r.covered) for r in shared_spans.coverage(links, members, df).collect()}
    assert share["k5"] == (6, len(text)) and share["m"] == (6, len(text)) and share["s"] == share["n"] == (0, 0)
    assert {tuple(r) for r in shared_spans.memberships(members).collect()} == {*((f"k{i}", "k0") for i in range(6)), ("m", "m")}
    assert [tuple(r) for r in shared_spans.class_spans(links, members).collect()] == [("k0", "m", 0, 0, len(text))]


def test_every_pair_of_hot_windows_and_many_copies(spark, monkeypatch, tmp_path):
    """Past HOT texts with one window and COPIES copies of one text the queries give what SQL gives; two texts with a window many times too."""
    from quirefold.llm import queries as Q

    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    notice, copy, beat = word(120), word(100), word(7) * 30
    texts = [(f"r{i:02d}", word(40 + i % 5) + notice[i % 3 * 10 :] + word(30)) for i in range(20)] + [(f"k{i}", copy) for i in range(9)]
    texts += [("m", copy + word(20)), ("n", copy[:80] + notice[:70]), ("twice", notice + word(50) + notice), ("s", beat), ("t", word(20) + beat), ("u", beat + word(20)), ("z", word(90)), ("o", None)]
    gold = [("g0", notice[20:90]), ("g1", word(70)), ("g2", word(9) + copy), ("g3", copy), ("g4", "short")]
    spark.createDataFrame([(k, t, 1) for k, t in texts], "id string, text string, chunkingAt int").write.parquet(f"{tmp_path}/chunk.parquet")
    spark.createDataFrame(gold, "pair_id string, gold_span string").write.parquet(f"{tmp_path}/linking_gold.parquet")
    held = {k: t or "" for k, t in texts + gold}
    at = {k: {t[i : i + 64]: i for i in range(len(t) - 63)} for k, t in held.items()}
    others = {k: {o for o in held if o != k and at[k].keys() & at[o].keys()} for k in held}
    want = {(a, b) for a in held for b in others[a] if a < b}
    plain = {tuple(r) for r in Q.p6_spans(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(shared_spans, "HOT", 6)
    monkeypatch.setattr(shared_spans, "COPIES", 3)
    pairs = [tuple(r) for r in Q.p6_found(spark, str(tmp_path)).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    for r in Q.p6_coverage(spark, str(tmp_path)).collect():
        theirs = set().union(*[at[o].keys() for o in others[r.rec]])
        t = held[r.rec]
        assert (r.rec, r.others, r.covered) == (r.rec, len(others[r.rec]), len({p for i in range(len(t) - 63) if t[i : i + 64] in theirs for p in range(i, i + 64)}))
    spans = [tuple(r) for r in Q.p6_spans(spark, str(tmp_path)).collect()]
    assert len(spans) == len(set(spans)) and set(spans) == plain


def test_repeating_texts_give_an_anchor_a_diagonal(spark, monkeypatch):
    monkeypatch.setattr(shared_spans, "HOT", 10)
    df = spark.createDataFrame([(1, ". " * 200), (2, "X" + ". " * 200)], "rid long, text string")
    met = shared_spans.FingerprintIndex(spark).add(df, "each").select("ra", "rb", (F.col("pa") - F.col("pb")).alias("d"))
    assert met.distinct().count() >= 2 * (400 - 64) // 2 + 1 and met.count() <= 2 * met.distinct().count()


def test_index_compacts(spark):
    index = shared_spans.FingerprintIndex(spark, buckets=2)
    text = "".join(random.Random(0).choice("abcdef") for _ in range(100))
    met = 0
    for i in range(shared_spans.FAN + 1):
        met = index.add(spark.createDataFrame([(i, text)], "rid bigint, text string")).select("ra", "rb").distinct().count()
    index.compact()
    assert met == shared_spans.FAN and len(index.runs) == 1


# 7 -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, want",
    [
        ("Dr. Brown came at 3.5 p. m. today. He left.", ["Dr. Brown came at 3.5 p. m. today.", "He left."]),
        ('"Is it done?" asked the clerk. Yes.', ['"Is it done?" asked the clerk.', "Yes."]),
        ("He wrote: “One. Two.” Then he left . . . at noon.", ["He wrote: “One. Two.”", "Then he left . . . at noon."]),
        ("Lords, dukes, etc. The rest (ibid., pp. 3 ff.) is lost.", ["Lords, dukes, etc.", "The rest (ibid., pp. 3 ff.) is lost."]),
        ("约占42．4%。所谓“道路！”的说法；是：“有。无。”次年。", ["约占42．4%。", "所谓“道路！”的说法；是：“有。无。”", "次年。"]),
        ("彼は「何か？」と問う。終わり", ["彼は「何か？」と問う。", "終わり"]),
        ("甲乙丙　丁戊己\n庚辛", ["甲乙丙", "丁戊己", "庚辛"]),
        ("An open “quote. Next one.", ["An open “quote.", "Next one."]),
        ("What?! No.", ["What?!", "No."]),
    ],
)
def test_sentences(text, want):
    a, got = 0, []
    for e in sentences.boundaries(text):
        got.append(text[a:e].strip())
        a = e
    assert got == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB1. ?!。，“”「」\"'()\n　漢か：", max_size=300), st.integers(3, 60))
def test_stretches_compose(text, stretch):
    assert sentences.boundaries(text, stretch) == sentences.boundaries(text, 10**6)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1. ?!。，“”「」\"'’()\n　漢か：", max_size=300), st.integers(1, 60), st.integers(3, 40))
def test_ranges_by_themselves_give_the_whole(text, size, stretch):
    if not text.strip():
        return
    parts = list(sentences.ranges(text, size))
    assert "".join(p[lead:] for _, lead, p, _ in parts) == text
    ahead = [0]
    for f in sentences.prefix_scan([sentences.range_back(p, lead) for _, lead, p, _ in reversed(parts[1:])], sentences.compose_bits):
        ahead.append(f[0])
    state, so_far, got = 0, False, []
    for (off, lead, p, last), a in zip(parts, reversed(ahead)):
        got += [off - lead + e for e in sentences.emit(p, lead, last, a, state, so_far, stretch)]
        to, none, some = sentences.range_forth(p, lead, a, stretch)
        state, so_far = to[state], some if so_far else none
    assert got == sentences.boundaries(text, 10**6)


def test_pages_compose_functions(spark, small, monkeypatch):
    """Pages over a stretch are composed of transition functions, texts over a range as rows."""
    made = []
    monkeypatch.setattr(sentences, "compose", lambda f, g: made.append(1) or [g[x] for x in f])
    pages = [r.textFused for r in spark.read.parquet(f"{small}/page.parquet").where("mode = 'native' and length(textFused) > 1200").select("textFused").collect()]
    scan = sentences.prefix_scan
    monkeypatch.setattr(sentences, "prefix_scan", lambda fs, then=None: scan(fs, then or sentences.compose))
    for p in pages:
        sentences.boundaries(p)
    assert len(pages) > 3 and len(made) >= len(pages)


def test_sentences_of_nothing():
    assert sentences.boundaries("") == [] == sentences.boundaries(" \n　")


def test_texts_of_any_length_have_sentences(spark):
    texts = ["A man came. " * 1000, "He said: “" + "One. Two. " * 900 + "Three.” Then he left.", "Short. One.", " ", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    cut = sentences.sentences(df, ["id"], "t").cache()
    got = {r.id: (r.length, r.ends) for r in cut.collect()}
    assert len(texts[0]) > sentences.STRETCH and len(got[0][1]) == 1000
    assert all(got[i] == (len(t.strip()), sentences.boundaries(t, 10**9)) for i, t in enumerate(texts[:3])) and got[3][1] is None and got[4][1] is None
    spans = sentences.sentence_spans(cut, ["id"]).where("id = 2").orderBy("place").collect()
    assert [texts[2][r.start_pos : r.end_pos] for r in spans] == ["Short.", " One."]


# 8 -------------------------------------------------------------------------------------------------------------


def test_encode_and_decode(spark, monkeypatch):
    path = f"{tokenize.FOLDER}/byte_bpe_50k.tiktoken"
    texts = ["", None, " ", "Hello  world's\n\n end ", "漢字、かな。", "<|endoftext|>", "a" * 5000, "📜🖋️👩‍🏫", "الدفتر 12", "'s 're\t\tx", "　全角　", "a\x1c\x1db \x85 c", "-" * 60 + " " + "=" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    encoded = tokenize.encode(df.unionByName(df), "doc_id", "text", path).cache()
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    assert len(ids) == len(texts) and ids[0] == [] and ids[1] == []
    for i, t in enumerate(texts):
        assert ids[i] == tokenize._encoder(path).encode_ordinary(t or "")
    monkeypatch.setattr(tokenize, "HEAD", 2)
    monkeypatch.setattr(tokenize, "HEAD_LONG", 0)
    assert {r.doc_id: r.ids for r in tokenize.encode(df.unionByName(df), "doc_id", "text", path).collect()} == ids
    back = {r.doc_id: r.text for r in tokenize.decode(encoded, "doc_id", "ids", tokenize.piece_table(spark, path)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))


# 9 -------------------------------------------------------------------------------------------------------------


def brute_leak(doc, item):
    body, want = leakage.normal(doc), leakage.normal(item)
    w = min(len(want), 40 if leakage.is_latin(item) else 12)
    marks = [False] * len(want)
    for i in range(len(want) - w + 1):
        if want[i : i + w] in body:
            marks[i : i + w] = [True] * w
    return sum(marks) >= 0.5 * len(want) and any(marks)


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    item = "".join(rng.choice("abcdefghij klmnop") for _ in range(160))
    wide = "".join(rng.choice("天地玄黃宇宙洪荒日月盈昃辰宿列張") for _ in range(48))
    items = [(1, item), (2, wide), (3, wide), (4, None), (5, "  ")]
    docs = [item.upper(), "x " + item[:90] + " y", item[:60], wide, "「" + "，".join(wide[i : i + 6] for i in range(0, 48, 6)) + "」", wide[:20], "ＡＢＣ" + wide[10:40], "", None, " ", item[:45] + "#" + item[60:120]]
    got = {
        (r.doc_id, r.item_id): r
        for r in leakage.leaks(
            spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id bigint, text string"), "item_id", "text"
        ).collect()
    }
    want = {(i, k) for i, d in enumerate(docs) for k, t in items if d and t and t.strip() and brute_leak(d, t)}
    assert set(got) == want
    assert got[1, 1].start == 2


def test_blocks_bound_the_automaton(spark, monkeypatch):
    """Items beyond a block's size are dealt into further blocks; what is found stays the same."""
    rng = random.Random(3)
    items = [(i, "".join(rng.choice("abcdefghijklmnop ") for _ in range(90))) for i in range(12)]
    docs = [(i, f"before {t[i : i + 70]} after") for i, t in items] + [(99, "nothing of it")]
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    whole = {tuple(r) for r in leakage.leaks(df, "doc_id", "text", it, "item_id", "text").collect()}
    assert {r[:2] for r in whole} == {(i, i) for i in range(12)} and len(leakage.blocks(it, "item_id", "text")) == 1
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 300)
    assert len(leakage.blocks(it, "item_id", "text")) >= 3
    assert {tuple(r) for r in leakage.leaks(df, "doc_id", "text", it, "item_id", "text").collect()} == whole


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="天地玄黃宇宙", min_size=12, max_size=40), st.lists(st.tuples(st.integers(0, 30), st.integers(3, 30)), max_size=4), st.text(alphabet="天地玄黃", max_size=9))
def test_anchors_mark_what_all_windows_mark(item, spans, between):
    doc = between.join(item[a : a + n] for a, n in spans)
    scanner = leakage.Scanner("", 0.5)
    scanner.build([(1, item)])
    assert bool(scanner.scan(doc)) == bool(doc and brute_leak(doc, item))


# 10 ------------------------------------------------------------------------------------------------------------

BAD = [
    "500 Internal Server Error", "GATEWAY TIMEOUT (504)\nPlease try again later.", "Intérnal Sérvér Error", "服務器繁忙，請稍後再試。", "ログインの期限が過ぎました。", "続行するには JavaScript を許可する必要があります。",
    "You need to enable JavaScript and cookies to continue.", "这里是占位文字，请替换。", "The bell of {{ title }} was heavy.", "By [INSERT DATE HERE]", "date: null", "text text text text text text text", "Traceback (most recent call last):\n  File \"x.py\", line 3, in page",
    "○○○○様", "dolora consec ametus tempora sitam consec dolora quisnos", "HTTP 401　お探しの資料は現在表示できません。",
]
GOOD = [
    "The keeper notes that the old server answered 404 for this leaf and that the plate was photographed again.", "In the style sheet a name in double braces marks the printer's own blank.",
    "The leaf reads {illegible} [sic] and then [two words lost] before the bookseller.", "The reader must enable the lamp to continue beyond the guild.",
    "Access to the prefect was denied to strangers, and the clerk wrote that the page was missing.", "A form of oath left the name blank: N. or M. shall swear.",
    "この写本では欠字を「○○」と記す例が構造に見られる。", "卷末〔缺二字〕□□，賦稅之數不詳。", "本书讨论了早期网页中的脚本提示和错误页面。", "=" * 200, "", None, "  ",
]


def test_residue(spark):
    df = spark.createDataFrame(list(enumerate(BAD + GOOD)), "doc_id bigint, text string")
    mined = residue.mine(df.unionByName(df), "doc_id", "text").cache()
    got = {r.doc_id for r in residue.residue(mined, residue.templates(mined), "doc_id").collect()}
    assert sorted(set(range(len(BAD))) ^ got) == []


def test_slots_beside_ideographs(spark):
    bad = ["水利を示す。 %EDITION%公の問題", "增橋梁 undefined undefined惟私無巡", "田畝不詳耳。 {0}閉孤寡無橋梁", "エラーerror 503です"]
    good = ["约占43.5%。", "{illegible} and {12 lines}", "100% of Edition%", "undefined_undefined"]
    df = spark.createDataFrame(list(enumerate(bad + good)), "doc_id bigint, text string")
    mined = residue.mine(df, "doc_id", "text").cache()
    assert sorted(r.doc_id for r in residue.residue(mined, residue.templates(mined), "doc_id").collect()) == [0, 1, 2, 3]


def test_one_verdict_a_template_whatever_stands_around_it(spark):
    """Members share one verdict; thousands of ordinary messages of the same leaf change none."""
    few = ["Access to the quarry page has been denied."]
    names = ["".join(chr(97 + i // 26**j % 26) for j in range(3)) + "ford" for i in range(600)]
    many = [f"Access to the quarry {x} has been denied." for x in names[:300]] + [f"Of the access page {x} was kept here" for x in names] + ["Of the access page lorem ipsum kept here"]
    weak = ["Loading", "Just a moment..."] + ["Click here"] * 3
    for docs, want in ((few, {0}), (many, {*range(300), 900}), (weak, {2, 3, 4})):
        mined = residue.mine(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"), "doc_id", "text").cache()
        verdicts = residue.templates(mined).cache()
        assert {r.doc_id for r in residue.residue(mined, verdicts, "doc_id").collect()} == want
        if len(docs) > 500:
            assert (300, "access to the quarry <*> has been denied.") in {(r.n, r.template) for r in residue.leaf_templates(verdicts).collect()}


def test_long_messages_are_whole():
    assert sum(len(m) for m in residue.messages("word " * 1000)) >= 1000


def test_latin_sentences_are_messages_of_their_own():
    text = "The honest mill of Ash counted the stipend. Sample paragraph. Sample paragraph. Then no. 4 of the dr. came. Éclat is lost."
    assert ["sample", "paragraph", "."] in residue.messages(text) and ["eclat", "is", "lost", "."] in residue.messages(text)
    inside = ["The pledge was kept. Oops! Something went wrong on our side. The upland mill stood.", "The pledge was kept. Page not found. The upland mill stood."]
    assert all(any(map(residue.is_residue, residue.messages(x))) for x in (text, *inside))


def test_messages_of_a_leaf_are_judged_by_themselves(spark):
    docs = ["Error 12", "Error 404", "Error 12. Error 404. Error 77", "Error 9", "sed ut aliqua quis nostrud veniam sit", *[f"Of the old mill {w} was kept here" for w in ("all", "zinc")], "Of the old mill lorem ipsum was kept here"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    mined = residue.mine(df, "doc_id", "text").cache()
    verdicts = residue.templates(mined)
    assert sorted(r.doc_id for r in residue.residue(mined, verdicts, "doc_id").collect()) == [1, 2, 4, 7]
    assert {(r.n, r.template) for r in residue.leaf_templates(verdicts).collect()} >= {(1, "error 404"), (1, "of the old mill lorem ipsum was kept here")}


def test_pairs_and_words_beyond_the_broadcast_are_joined(spark, monkeypatch):
    rows = [(f"p{i}", "scan", t, None, i, i) for i, t in enumerate(["官吏與民。the lord came"] * 40 + ["鐘鼓" * 50 + " bell" * 90] + ["官史與民。the 1ord came"])]
    pages = spark.createDataFrame(rows, "id string, mode string, textFused string, title string, docPageIndex int, at int").withColumn("fusionAt", F.timestamp_seconds("at"))
    for f in scan_repair.FIELDS[1:]:
        pages = pages.withColumn(f, F.lit(None).cast("string"))
    for bound in (300_000, 2):
        monkeypatch.setattr(scan_repair, "HEAD_PAIRS", bound)
        monkeypatch.setattr(scan_repair, "HEAD_WORDS", bound)
        parts = scan_repair.scanned(pages)
        assert [(r.page_id, r.defect) for r in scan_repair.defects(*parts).collect()] == [("p41", "misread")]
        assert "官吏與民" in scan_repair.repaired(*parts).where("page_id = 'p41' and field = 'textFused'").first().text
