"""Reading books: format by suffix, headings, EPUB archives, lexicon files."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.text import clean_cluster_name
from quillmill.functions.text_udf import decode_text, html_text, scrub
from quillmill.operators.sections import sections

# What a file's suffix says of its format.
FORMATS = {".pdf": "pdf", ".epub": "epub", ".md": "md", ".markdown": "md", ".txt": "txt"}

MARKDOWN_HEADING = r"^#{1,3}\s+(.+?)\s*$"
CHAPTER_HEADING = r"(?i)^\s*(第\s*[0-9一二三四五六七八九十百千零]+\s*[章节卷部篇]|Chapter\s+\d+)\s*[:：]?\s*(.*)$"


def book_format(path: Column) -> Column:
    """The format of a path; an error for a suffix that is none of FORMATS."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
    pairs = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, suffix), F.raise_error(F.concat(F.lit("no parser for "), path)).cast("string"))


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, format, content) of the files of a folder; content is only read where it is used."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", book_format(F.col("path")).alias("format"), "content")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, else GBK, else Latin-1."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(decode_text)

    return run(content)


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(F.split(F.col(text), "\r?\n", -1)).alias("pos", "line"))


def chapters_of(df: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """(key, idx, title, body): chapters of Markdown (# to ###) or plain texts (chapter lines); a text without any
    heading is one chapter with an empty title."""
    if kind == "md":
        head, title = F.col("line").rlike(MARKDOWN_HEADING), F.regexp_extract("line", MARKDOWN_HEADING, 1)
    else:
        rest, mark = F.regexp_extract("line", CHAPTER_HEADING, 2), F.regexp_extract("line", CHAPTER_HEADING, 1)
        head, title = F.col("line").rlike(CHAPTER_HEADING), F.when(F.trim(rest) != "", F.trim(rest)).otherwise(F.trim(mark))
    return sections(text_lines(df, key, text), key, "pos", "line", head, title)


def book_title(df: DataFrame, key: str, text: str, fallback: Column) -> DataFrame:
    """(key, title): the first # heading, else the fallback."""
    h1 = F.regexp_extract(F.col(text), r"(?m)^#\s+(.+?)\s*$", 1)
    return df.select(key, F.when(h1 != "", h1).otherwise(fallback).alias("title"))


_NS = {"c": "urn:oasis:names:tc:opendocument:xmlns:container", "o": "http://www.idpf.org/2007/opf"}


def epub_chapters(raw: bytes) -> list[tuple[int, str, str]]:
    """(idx, title, clean HTML) of the documents in an EPUB's reading order; navigation and empty ones are left out."""
    out: list[tuple[int, str, str]] = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("META-INF/container.xml")).find(".//c:rootfile", _NS).get("full-path")
        opf = ElementTree.fromstring(z.read(root))
        items = {i.get("id"): i for i in opf.iterfind(".//o:manifest/o:item", _NS)}
        here = posixpath.dirname(root)
        links = [i.get("href") for i in items.values() if (i.get("media-type") or "").startswith("image/")]
        images = {posixpath.normpath(posixpath.join(here, x)): f"images/{posixpath.basename(x)}" for x in links}
        for ref in opf.iterfind(".//o:spine/o:itemref", _NS):
            item = items.get(ref.get("idref"))
            if item is None or "nav" in (item.get("properties") or "").split():
                continue
            at = posixpath.normpath(posixpath.join(here, item.get("href")))
            folder = posixpath.dirname(at)
            html = z.read(at).decode("utf-8", "replace")
            body = re.search(r"(?is)<body[^>]*>(.*)</body>", html)
            clean = scrub(body[1] if body else html, images, folder)
            head = re.search(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>", clean)
            text = html_text(clean)
            if text or "<img" in clean:
                title = html_text(head[1])[:80] if head else text.split("\n")[0][:80]
                out.append((len(out) + 1, title, clean))
    return out


def make_epub(pages: list[tuple[str, str]]) -> bytes:
    """A minimal EPUB of (file name, HTML) pages in reading order."""
    names = [escape(n, {'"': "&quot;"}) for n, _ in pages]
    items = "".join(f'<item id="i{k}" href="text/{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(names))
    spine = "".join(f'<itemref idref="i{k}"/>' for k in range(len(names)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", f'<container xmlns="{_NS["c"]}"><rootfiles><rootfile full-path="book/content.opf"/></rootfiles></container>')
        z.writestr("book/content.opf", f'<package xmlns="{_NS["o"]}"><manifest>{items}</manifest><spine>{spine}</spine></package>')
        for name, html in pages:
            z.writestr(f"book/text/{name}", html)
    return out.getvalue()


def read_epub(files: DataFrame) -> DataFrame:
    """(path, idx, title, html) of EPUB files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *c) for p, raw in zip(pdf["path"], pdf["content"], strict=True) for c in epub_chapters(bytes(raw))]
            yield pd.DataFrame(rows, columns=["path", "idx", "title", "html"])

    return files.select("path", "content").mapInPandas(run, "path string, idx int, title string, html string")


def read_pdf(files: DataFrame, pages: DataFrame) -> DataFrame:
    """(path, idx, body): a chapter a page. Page texts come from elsewhere (path, idx, text): no PDF library is at hand."""
    return files.select("path").join(pages, "path").select("path", "idx", F.coalesce("text", F.lit("")).alias("body"))


# Fixed value: the mark that starts the cached part of a lexicon file.
CACHE_MARK = "系统缓存"


def read_lexicon(text: DataFrame, mark: str = CACHE_MARK) -> DataFrame:
    """(term, part, alias): a lexicon file (text: string) line by line.

    One term a line, ``canonical = alias, alias`` lines, # comments; a comment with ``mark`` starts the cached part.
    ``alias`` is null for the terms themselves.
    """
    lines = text.select(F.posexplode(F.split("text", "\r?\n", -1)).alias("pos", "raw"))
    lines = lines.select("pos", F.btrim("raw", F.lit(" \t\r﻿")).alias("line"))
    at = lines.filter(F.col("line").startswith("#") & F.contains("line", F.lit(mark))).agg(F.min("pos").alias("at"))
    rows = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#")).crossJoin(F.broadcast(at))
    part = F.when(F.col("pos") > F.col("at"), "cached").otherwise("user")
    named = F.contains("line", F.lit("="))
    term = clean_cluster_name(F.substring_index("line", "=", 1))
    terms = rows.select(term.alias("term"), F.when(named, "user").otherwise(part).alias("part"), F.lit(None).cast("string").alias("alias"))
    each = rows.filter(named).select(term.alias("term"), F.lit("user").alias("part"), F.explode(F.split(F.expr("substring(line, instr(line, '=') + 1)"), ",")).alias("a"))
    aliases = each.select("term", "part", F.lower(clean_cluster_name(F.col("a"))).alias("alias")).filter("alias <> '' and alias <> lower(term)")
    return terms.filter("term <> ''").distinct().unionByName(aliases.filter("term <> ''").distinct())


def append_to_lexicon(lexicon: DataFrame, new: DataFrame, generic: DataFrame) -> DataFrame:
    """New terms (term) for the cached part: cleaned, not there yet, not generic."""
    got = new.select(clean_cluster_name(F.col("term")).alias("term")).filter("term <> ''").distinct()
    return got.join(lexicon.select("term"), "term", "left_anti").join(generic.select("term"), "term", "left_anti")


def pages_with_fallback(chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, idx, body): a chapter's own body, else its page's text."""
    p = pages.select("doc", "idx", F.col("text").alias("_t"))
    own = F.when(F.trim("body") != "", F.col("body"))
    return chapters.join(p, ["doc", "idx"], "left").select("doc", "idx", F.coalesce(own, "_t", F.lit("")).alias("body"))


def page_status(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """(doc, pages, cached, missing) of wanted (doc, idx) and cached (doc, idx) pages."""
    got = wanted.join(cached.select("doc", "idx").distinct().withColumn("_c", F.lit(1)), ["doc", "idx"], "left")
    miss = F.array_sort(F.collect_list(F.when(F.col("_c").isNull(), F.col("idx"))))
    return got.groupBy("doc").agg(F.count(F.lit(1)).alias("pages"), F.count("_c").alias("cached"), miss.alias("missing"))


def last_positions(df: DataFrame, by: str) -> DataFrame:
    """(by, position): the next free position of each group."""
    return df.groupBy(by).agg((F.max("position") + 1).alias("position"))
