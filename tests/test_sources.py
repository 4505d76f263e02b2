import zipfile

import pytest
from pyspark.sql import functions as F

from quirefold.sources import readers
from quirefold.streaming import events as E
from quirefold.tables import load


def test_files_to_pages(spark, tmp_path):
    (tmp_path / "secondary").mkdir()
    (tmp_path / "secondary" / "a.txt").write_text("x" * 4500)
    (tmp_path / "b.md").write_text("---\nk: v\n---\n# Title\n" + "word " * 60)
    (tmp_path / "c.md").write_text("short")
    (tmp_path / "d.zip").write_bytes(b"zip")
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    with zipfile.ZipFile(tmp_path / "e.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="u"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package xmlns="u"><manifest><item id="i" href="1.html"/></manifest><spine><itemref idref="i"/></spine></package>')
        z.writestr("o/1.html", "<html><body><p>" + "text " * 200 + "</p></body></html>")
    pages = readers.read_pages(spark, str(tmp_path)).collect()
    by = {}
    for p in pages:
        by.setdefault(p.path.rsplit("/", 1)[-1], []).append(p)
    assert sorted(len(p.text) for p in by["a.txt"]) == [500, 4000]
    assert by["b.md"][0].title == "Title" and "c.md" not in by
    assert by["e.epub"][0].mode == "native" and by["bad.epub"][0].role == "failed"
    found = {r.path.rsplit("/", 1)[-1]: r for r in readers.discover(spark, str(tmp_path)).collect()}
    assert found["a.txt"].tier == "secondary" and found["d.zip"].reason == "unknown format"


def test_renames(spark):
    df = spark.createDataFrame([("/a/x (1).txt",), ("/a/x .txt",), ("/a/y.txt",)], "path string")
    got = {r.path: (r.new, r.collides) for r in readers.renames(df, "path", [r" \(\d+\)", r" (?=\.)"]).collect()}
    assert got["/a/x (1).txt"] == ("/a/x.txt", True) and got["/a/y.txt"] == ("/a/y.txt", False)


def test_stream_equals_batch(spark, small, tmp_path):
    e = load(spark, small, "events")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = E.tumbling(E.read_stream(spark, str(tmp_path / "in"), e), "10 minutes", late="30 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("counts").select("start", "event_type", "n").collect()))
    assert got == sorted(map(tuple, E.tumbling(e, "10 minutes").select("start", "event_type", "n").collect()))


def test_kept_frequencies(spark, small, tmp_path):
    docs = load(spark, small, "documents").select("doc_id", "text")
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = E.read_stream(spark, str(tmp_path / "in"), docs)
    E.keep_frequencies(stream, "doc_id", "text", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r.word: r.df for r in E.frequencies(spark, str(tmp_path / "out")).where("df > 3").collect()}
    want: dict = {}
    for r in docs.where("text IS NOT NULL").collect():
        import re

        for w in set(re.findall(r"[a-z0-9]+", r.text.lower())):
            want[w] = want.get(w, 0) + 1
    assert {w: n for w, n in got.items() if w.isalpha()} == {w: n for w, n in want.items() if n > 3 and w.isalpha()}
    assert F is not None


def test_packages(spark, tmp_path):
    import zipfile

    container = '<container xmlns="urn:c"><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>'
    opf = (
        '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Rolls</dc:title><dc:creator>（唐）王某 撰</dc:creator><dc:date>1999</dc:date></metadata><manifest>'
        '<item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/><item id="c" href="c.png" properties="cover-image"/>{nav}</manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>'
    )
    navs = {
        "three.epub": ('<item id="n" href="nav.xhtml" properties="nav"/>', "nav.xhtml", '<html xmlns="urn:h"><nav><ol><li><a href="a.xhtml#x">One</a><ol><li><a href="b.xhtml"> Two  more </a></li></ol></li></ol></nav></html>'),
        "two.epub": ('<item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/>', "toc.ncx", '<ncx xmlns="urn:n"><navMap><navPoint><navLabel><text>One</text></navLabel><content src="a.xhtml#x"/><navPoint><navLabel><text>Two more</text></navLabel><content src="b.xhtml"/></navPoint></navPoint></navMap></ncx>'),
    }
    for name, (item, inner, body) in navs.items():
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("META-INF/container.xml", container)
            z.writestr("OEBPS/p.opf", opf.replace("{nav}", item))
            z.writestr("OEBPS/" + inner, body)
            z.writestr("OEBPS/a.xhtml", "<p>" + "word " * 60 + "</p>")
            z.writestr("OEBPS/b.xhtml", '<p>short</p><img src="i.png"/><img src="j.png"/>')
    (tmp_path / "broken.epub").write_bytes(b"no zip")
    got = [(r.path.rsplit("/", 1)[1], r.n, r.level, r.title, r.href) for r in readers.read_contents(spark, str(tmp_path)).orderBy("path", "n").collect()]
    assert got == [(f, *row) for f in ("three.epub", "two.epub") for row in ((0, 1, "One", "a.xhtml"), (1, 2, "Two more", "b.xhtml"))]
    hints = readers.read_hints(spark, str(tmp_path)).collect()
    assert len(hints) == 2 and hints[0].titles == ["Rolls"] and hints[0].creators == ["（唐）王某 撰"] and hints[0].publishers == [] and hints[0].dates == ["1999"]
    pages = [(r.page_index, r.role, r.mode) for r in readers.read_pages(spark, str(tmp_path)).where("path like '%two.epub'").collect()]
    assert pages == [(-1, "cover", "scan"), (0, "front", "native"), (1, "front", "scan"), (1, "image", "scan"), (1, "image", "scan")]
    assert readers.pdf_contents([(1, " One ", 1), (2, "Two", 0), (1, "", 4)]) == [(1, "One", 0), (2, "Two", 0)]


def test_packed_trees_and_seeds(spark, tmp_path):
    tree = tmp_path / "secondary" / "book.packed" / "part one"
    tree.mkdir(parents=True)
    (tree / "leaf.md").write_text("---\nx: 1\n---\n# Leaf\nsee [[Other|that]] and [[More]]\n" + "word " * 60)
    (tree / "title.md").write_text("# T")
    (tree / "short.md").write_text("too short")
    (tree / "fig.png").write_bytes(b"x")
    found = {r.path.rsplit("/", 1)[1]: r.reason for r in readers.discover(spark, str(tmp_path)).collect()}
    assert found == {"leaf.md": None, "title.md": None, "short.md": None, "fig.png": "inside a packed tree"}
    entry = readers.entries(readers.discover(spark, str(tmp_path))).collect()
    assert len(entry) == 1 and entry[0].files == 4 and entry[0].tier == "secondary"
    pages = {r.path.rsplit("/", 1)[1]: r for r in readers.read_pages(spark, str(tmp_path)).collect() if r.path.endswith(".md")}
    assert set(pages) == {"leaf.md", "title.md"} and pages["leaf.md"].links == ["Other", "More"] and "part" in pages["leaf.md"].section and pages["title.md"].role == "front"
    (tmp_path / "s.jsonl").write_text('{"term": "a"}\n{"term": "b"}\n')
    assert readers.seeds(spark, str(tmp_path / "s.jsonl")).count() == 2
    readers.write_report(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().b == "x"


def test_filters_and_structure(spark):
    from quirefold.operators import filters, structure

    df = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "a", "xy")], "i int, t string, w string")
    assert [r.i for r in df.where(filters.given(t="a", w=None)).collect()] == [1, 3]
    with pytest.raises(ValueError):
        filters.requested({"no": 1}, {"t": "t ="})
    assert [r.i for r in df.where(filters.due("t", ["a"], "w")).collect()] == [1] and df.where(filters.due("t", ["a"], "w", True)).count() == 2
    assert filters.camel_keys(spark.createDataFrame([((1,),)], "outer_one struct<inner_two:int>")).schema.simpleString() == "struct<outerOne:struct<innerTwo:int>>"
    with pytest.raises(ValueError, match="no parent"):
        structure.checked(df, "t", spark.createDataFrame([("a",)], "k string"), "k")
    links = spark.createDataFrame([("g", "x/a.html"), ("g", "a.html#s"), ("g", "../x/a.html"), ("g", "zz"), ("g", None)], "g string, href string")
    files = spark.createDataFrame([("g", "x/a.html", 4), ("g", "y/a.html", 2), ("g", "a.html", 7)], "g string, href string, at int")
    assert {(r.href, r.at, r.how) for r in structure.resolved(links, files, "g", "href", "at").collect()} == {("x/a.html", 4, "exact"), ("a.html#s", 7, "bare"), ("../x/a.html", 4, "end")}
    parts = structure.ingested(spark.createDataFrame([("d", 0, "p0"), ("d", 1, "p1")], "d string, at int, id string"), "d", "at", "id")
    assert [tuple(r) for r in parts["next"].collect()] == [("p0", "p1")] and parts["documents"].first().pages == 2


def test_first_seen_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")], "k int, ts string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = E.first_seen(spark.readStream.schema("k int, ts string").parquet(str(tmp_path / "in")), "k")
    q = stream.writeStream.format("memory").queryName("seen_once").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert sorted(r.k for r in spark.table("seen_once").collect()) == [1, 2]


def test_numbers_by_blocks(spark):
    from quirefold.operators import ranking

    df = spark.createDataFrame([("a", "m", i * 3, f"k{i:02d}") for i in range(20)] + [(None, "m", 1, "x"), (None, "m", 1, "y")], "g string, m string, at int, k string")
    got = {r.k: r.number for r in ranking.numbered(df, ["g", "m"], "at", "k", block=10).collect()}
    assert got == {f"k{i:02d}": i + 1 for i in range(20)} | {"x": 1, "y": 2}
