"""Reading files into page rows.

A page row has the columns of ``PAGE``.  Formats that need libraries this
environment lacks (PDF pages, images to text) are plug points: ``register`` a
function over file contents under the format's name.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "path string, page_index int, mode string, role string, title string, text string, images int, section string, links array<string>"
NATIVE_CHARS, FRONT_CHARS, FRONT_PAGES = 200, 600, 5
PAGE_CHARS = 4000
IMAGES = ["png", "jpg", "jpeg", "tif", "tiff", "webp", "bmp"]

Reader = Callable[[str, bytes], Iterator[dict]]
_READERS: dict[str, Reader] = {}


def register(name: str) -> Callable[[Reader], Reader]:
    """Puts a reader down for a format: (path, contents) -> dicts of PAGE without ``path``."""

    def put(f: Reader) -> Reader:
        _READERS[name] = f
        return f

    return put


def format_of(path: Column) -> Column:
    """The format of a path by its suffix, null if it is unknown."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)/?$", 1))
    return (
        F.when(suffix == "pdf", "pdf").when(suffix == "epub", "epub").when(suffix == "packed", "packed_md").when(suffix.isin(IMAGES), "image").when(suffix.isin("txt", "text"), "text").when(suffix.isin("md"), "packed_md")
    )


def tier_of(path: Column) -> Column:
    """The first directory named primary or secondary, in any case; primary without one."""
    named = F.filter(F.split(F.lower(path), "/"), lambda p: p.isin("primary", "secondary"))
    return F.coalesce(F.get(named, F.lit(0)), F.lit("primary"))


def page_mode(chars: Column, images: Column) -> Column:
    """Whether a page's own text will do, or it must be recognised."""
    return F.when((chars >= NATIVE_CHARS) & (images <= 1), "native").otherwise("scan")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, format, tier, reason): every file below a folder, by tier and path; a reason where it is not read by itself.

    Files inside a packed tree belong to it; the tree is read, its other files are not.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    known = files.withColumn("format", format_of(F.col("path"))).withColumn("tier", tier_of(F.col("path")))
    inside = F.col("path").rlike(r"(?i)\.packed/")
    reason = F.when(inside & (F.col("format") != "packed_md"), "inside a packed tree").when(F.col("format").isNull(), "unknown format").when(F.col("size") == 0, "empty file")
    return known.withColumn("reason", reason).orderBy("tier", "path")


def entries(files: DataFrame) -> DataFrame:
    """(entry, format, tier, files, size): the sources of a corpus: a packed tree is one, any other file is one by itself."""
    root = F.regexp_extract("path", r"(?i)^(.*?\.packed)/", 1)
    named = files.withColumn("entry", F.when(root != "", root).otherwise(F.col("path")))
    return named.groupBy("entry").agg(F.min("format").alias("format"), F.min("tier").alias("tier"), F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"))


def html_page(raw: str) -> tuple[str, int]:
    """(text, number of images) of a page of HTML."""
    bare = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", raw)
    images = len(re.findall(r"(?i)<(?:img|image)\b", bare))
    text = re.sub(r"(?s)<[^>]+>", "\n", bare)
    import html

    return "\n".join(x.strip() for x in html.unescape(text).split("\n") if x.strip()), images


@register("text")
def text_pages(path: str, raw: bytes) -> Iterator[dict]:
    text = raw.decode("utf-8", "replace")
    for i, a in enumerate(range(0, len(text), PAGE_CHARS)):
        yield {"page_index": i, "mode": "native", "role": "body", "title": None, "text": text[a : a + PAGE_CHARS], "images": 0}


LINKS = 30


@register("packed_md")
def markdown_pages(path: str, raw: bytes) -> Iterator[dict]:
    """A page of a packed tree: without its front matter, with its first links and the folders it stands in; short pages only if they are titles."""
    text = re.sub(r"\A---\n.*?\n---\n", "", raw.decode("utf-8", "replace"), flags=re.S)
    title = re.search(r"(?m)^#\s+(.+)$", text)
    name = path.rsplit("/", 1)[-1].lower()
    role = next((r for r, words in (("front", ("title", "cover", "front")), ("toc", ("toc", "contents", "index")), ("notes", ("note", "annot"))) if any(w in name for w in words)), "body")
    inner = re.split(r"(?i)\.packed/", path)
    section = "/".join(inner[-1].split("/")[:-1]) if len(inner) > 1 else ""
    links = [x.split("|")[0].strip() for x in re.findall(r"\[\[([^\]]+)\]\]", text)][:LINKS]
    if len(text.strip()) >= NATIVE_CHARS or role == "front":
        yield {"page_index": 0, "mode": "native", "role": role, "title": title and title.group(1).strip(), "text": text, "images": 0, "section": section, "links": links}


def _package(raw: bytes):
    import xml.etree.ElementTree as ET

    z = zipfile.ZipFile(io.BytesIO(raw))
    opf = ET.fromstring(z.read("META-INF/container.xml")).find(".//{*}rootfile").get("full-path")
    return z, opf.rsplit("/", 1)[0] + "/" if "/" in opf else "", ET.fromstring(z.read(opf))


@register("epub")
def epub_pages(path: str, raw: bytes) -> Iterator[dict]:
    """The pages of an EPUB in the order of its spine; the cover, and each image of a page that must be recognised, is a page of its own."""
    z, base, package = _package(raw)
    with z:
        items = {x.get("id"): x for x in package.iterfind(".//{*}manifest/{*}item")}
        cover = next((x for x in items.values() if "cover-image" in (x.get("properties") or "")), None)
        if cover is None:
            named = next((m.get("content") for m in package.iterfind(".//{*}meta") if m.get("name") == "cover"), None)
            cover = items.get(named)
        if cover is not None:
            yield {"page_index": -1, "mode": "scan", "role": "cover", "title": cover.get("href"), "text": None, "images": 1}
        for i, ref in enumerate(package.iterfind(".//{*}spine/{*}itemref")):
            href = items[ref.get("idref")].get("href")
            body = z.read(base + href).decode("utf-8", "replace")
            text, images = html_page(body)
            native = len(text) >= NATIVE_CHARS and images <= 1
            role = "front" if len(text) < FRONT_CHARS and i <= FRONT_PAGES else "body"
            yield {"page_index": i, "mode": "native" if native else "scan", "role": role, "title": href, "text": text, "images": images}
            if not native:
                for src in re.findall(r"(?i)<(?:img|image)\b[^>]*?(?:src|href)=[\"']([^\"']+)", body):
                    yield {"page_index": i, "mode": "scan", "role": "image", "title": src, "text": None, "images": 1}


def epub_contents(raw: bytes) -> list[tuple[int, str, str]]:
    """(level from 1, title, file without its fragment) of an EPUB's contents, nested ones after their parents."""
    z, base, package = _package(raw)
    import xml.etree.ElementTree as ET

    with z:
        items = {x.get("id"): x for x in package.iterfind(".//{*}manifest/{*}item")}
        nav = next((x for x in items.values() if "nav" in (x.get("properties") or "").split()), None)
        out: list[tuple[int, str, str]] = []

        def put(level: int, title: str | None, href: str | None) -> None:
            if title and title.strip() and href:
                out.append((level, " ".join(title.split()), href.split("#", 1)[0]))

        def lists(node, level: int) -> None:
            for li in node.findall("{*}li"):
                a = li.find("{*}a")
                if a is not None:
                    put(level, "".join(a.itertext()), a.get("href"))
                for inner in li.findall("{*}ol"):
                    lists(inner, level + 1)

        def points(node, level: int) -> None:
            for p in node.findall("{*}navPoint"):
                put(level, p.findtext("{*}navLabel/{*}text"), (p.find("{*}content") if p.find("{*}content") is not None else {}).get("src"))
                points(p, level + 1)

        if nav is not None:
            for ol in ET.fromstring(z.read(base + nav.get("href"))).iterfind(".//{*}nav/{*}ol"):
                lists(ol, 1)
                break
        else:
            ncx = next((x for x in items.values() if (x.get("media-type") or "").endswith("ncx+xml")), None)
            if ncx is not None:
                points(ET.fromstring(z.read(base + ncx.get("href"))).find("{*}navMap"), 1)
        return out


def epub_hints(raw: bytes) -> dict[str, list[str]]:
    """What a package says of its edition: titles, creators, publishers, dates."""
    z, _, package = _package(raw)
    z.close()
    texts = lambda name: [x.text.strip() for x in package.iterfind(f".//{{*}}metadata/{{*}}{name}") if x.text and x.text.strip()]
    return {"titles": texts("title"), "creators": texts("creator"), "publishers": texts("publisher"), "dates": texts("date")}


def read_contents(spark: SparkSession, root: str) -> DataFrame:
    """(path, n, level, title, href) of the contents of all EPUBs below a folder."""
    return _over_packages(spark, root, "path string, n int, level int, title string, href string", lambda path, raw: [(path, i, *row) for i, row in enumerate(epub_contents(raw))])


def read_hints(spark: SparkSession, root: str) -> DataFrame:
    """(path, titles, creators, publishers, dates) of all EPUBs below a folder."""
    kinds = ("titles", "creators", "publishers", "dates")
    return _over_packages(spark, root, "path string, " + ", ".join(f"{k} array<string>" for k in kinds), lambda path, raw: [(path, *[epub_hints(raw)[k] for k in kinds])])


def _over_packages(spark: SparkSession, root: str, schema: str, rows: Callable[[str, bytes], list[tuple]]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content").where(format_of(F.col("path")) == "epub")
    columns = [c.strip().split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in batch.itertuples(index=False):
                try:
                    found = rows(path, content)
                except (zipfile.BadZipFile, KeyError, AttributeError, SyntaxError):  # a broken package has none
                    found = []
                if found:
                    yield pd.DataFrame(found, columns=columns)

    return files.mapInPandas(run, schema)


def pdf_contents(rows: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """(level, title, place from 0) of a PDF's outline, whose pages count from 1; places before the first are 0."""
    return [(level, title.strip(), max(0, page - 1)) for level, title, page in rows if title and title.strip()]


@register("image")
def image_page(path: str, raw: bytes) -> Iterator[dict]:
    yield {"page_index": 0, "mode": "scan", "role": "body", "title": None, "text": None, "images": 1}


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """The pages of all readable files below a folder; a file that breaks gives one row with the role ``failed``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content", format_of(F.col("path")).alias("format"))
    readers = dict(_READERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in PAGE.split(", ")]
        for batch in batches:
            for path, content, kind in batch.itertuples(index=False):
                try:
                    rows = [{"path": path, "section": "", "links": []} | p for p in readers[kind](path, content)] if kind in readers else []
                except Exception as e:  # a broken file must not end the job
                    rows = [{"path": path, "page_index": -1, "mode": None, "role": "failed", "title": None, "text": str(e)[:300], "images": 0, "section": "", "links": []}]
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return files.where("format IS NOT NULL").mapInPandas(run, PAGE)


def seed_pairs(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A seed table of tab-separated values; lines from ``#`` on are comments."""
    return spark.read.option("sep", "\t").option("comment", "#").csv(path).toDF(*columns)


def seeds(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A seed file by its suffix: .tsv (with ``columns``), .jsonl, or .yaml with a list of maps, which is read on the driver."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "tsv":
        return seed_pairs(spark, path, columns or [])
    if kind in ("jsonl", "json"):
        return spark.read.json(path)
    if kind in ("yaml", "yml"):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML seeds needs the yaml library") from e
        with open(path, encoding="utf-8") as f:
            return spark.createDataFrame(yaml.safe_load(f) or [], columns and ", ".join(f"{c} string" for c in columns))
    raise ValueError(f"no reader for seeds of the kind {kind!r}")


def write_report(df: DataFrame, path: str) -> None:
    """A report of few rows as one file of JSON lines."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def renames(files: DataFrame, path: str, patterns: list[str]) -> DataFrame:
    """(path, new, collides): file names with patterns removed in order, and which targets meet."""
    name = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    for p in patterns:
        name = F.regexp_replace(name, p, "")
    new = F.concat(F.regexp_extract(F.col(path), r"^(.*/)?", 1), F.trim(name))
    planned = files.select(F.col(path).alias("path"), new.alias("new"))
    met = planned.groupBy("new").agg((F.count(F.lit(1)) > 1).alias("collides"))
    return planned.join(met, "new")
