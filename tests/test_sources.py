import io
import zipfile

from pyspark.sql import functions as F

from quillmill.sources import books


def chapters(spark, text, kind):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    return [(r["title"], r["body"]) for r in books.chapters_of(df, "id", "t", kind).orderBy("idx").collect()]


def test_headings(spark):
    assert chapters(spark, "第1章 引言\n\n你好\n\n第2章 主体\n\n世界\n", "txt") == [("引言", "你好"), ("主体", "世界")]
    got = chapters(spark, "第1章\n\n正文\n\n第2章\n\n\n第3章\n\n结束\n", "txt")
    assert [t for t, _ in got] == ["第1章", "第3章"]
    assert chapters(spark, "# A\nx\n#### deep\n## B\ny", "md") == [("A", "x\n#### deep"), ("B", "y")]
    assert chapters(spark, "no heading", "md") == [("", "no heading")]


def test_formats(spark):
    df = spark.createDataFrame([("a/b.MD",), ("c.epub",)], "p string")
    assert [r[0] for r in df.select(books.book_format(F.col("p"))).collect()] == ["md", "epub"]
    bad = spark.createDataFrame([("x.doc",)], "p string").select(books.book_format(F.col("p")))
    try:
        bad.collect()
        raise AssertionError("no error")
    except Exception as e:
        assert "no parser" in str(e)


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("中文".encode("gbk"))
    (tmp_path / "b.md").write_text("# T\nx")
    got = books.read_files(spark, str(tmp_path)).select("format", books.decoded(F.col("content")).alias("t"))
    assert sorted(map(tuple, got.collect())) == [("md", "# T\nx"), ("txt", "中文")]


def epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="n" href="nav.xhtml" properties="nav"/><item id="a" href="t/a.xhtml"/><item id="e" href="t/e.xhtml"/><item id="i" href="img/p.png" media-type="image/png"/></manifest><spine><itemref idref="n"/><itemref idref="a"/><itemref idref="e"/></spine></package>')
        z.writestr("O/nav.xhtml", "<body>nav</body>")
        z.writestr("O/t/a.xhtml", '<html><body onload="x"><h1>One</h1><p>Text</p><img src="../img/p.png"/><script>x</script></body></html>')
        z.writestr("O/t/e.xhtml", "<body> </body>")
    return out.getvalue()


def test_epub(spark):
    assert books.epub_chapters(epub()) == [(1, "One", '<h1>One</h1><p>Text</p><img src="images/p.png"/>')]
    df = spark.createDataFrame([("x.epub", bytearray(epub()))], "path string, content binary")
    assert [(r["idx"], r["title"]) for r in books.read_epub(df).collect()] == [(1, "One")]


def test_epub_source(spark, tmp_path):
    """Files in groups; a broken archive is an error row; other files and columns that nobody asked for stay out."""
    from quillmill.sources.epub import EpubReader, epub_rows

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.EPUB").write_bytes(epub())
    (tmp_path / "broken.epub").write_bytes(epub()[:60])
    (tmp_path / "empty.epub").write_bytes(b"")
    (tmp_path / "note.txt").write_text("x")
    assert [len(p.paths) for p in EpubReader(str(tmp_path), ["path"], 1).partitions()] == [1] * 5
    assert [len(p.paths) for p in EpubReader(f"file://{tmp_path}", ["path"], 1 << 20).partitions()] == [5]
    df = epub_rows(spark, str(tmp_path), groupBytes="1000")
    assert df.columns == ["path", "idx", "title", "html", "error"]
    got = {r.path.split("/")[-1]: (r.idx, r.title, r.error) for r in df.collect()}
    assert all(got[f"{k}.EPUB"] == (1, "One", None) for k in range(3)) and len(got) == 5
    assert all(got[k][:2] == (None, None) and "BadZipFile" in got[k][2] for k in ("broken.epub", "empty.epub"))
    some = epub_rows(spark, f"file://{tmp_path}/in", "title string, path string")
    assert some.columns == ["title", "path"] and [r.title for r in some.collect()] == ["One"] * 3
    (tmp_path / "none").mkdir()
    assert epub_rows(spark, f"{tmp_path}/none").count() == 0


def test_lexicon(spark):
    text = "# note\n泛函\n\n机器学习 = ML, 机器 学习 \n# 系统缓存\n拓扑\n"
    got = sorted(map(str, (tuple(r) for r in books.read_lexicon(spark.createDataFrame([(text,)], "text string")).collect())))
    assert got == sorted(map(str, [("泛函", "user", None), ("机器学习", "user", None), ("拓扑", "cached", None), ("机器学习", "user", "ml")]))


def test_pages(spark):
    ch = spark.createDataFrame([(1, 1, "own"), (1, 2, " "), (1, 3, None)], "doc int, idx int, body string")
    pg = spark.createDataFrame([(1, 2, "page")], "doc int, idx int, text string")
    assert [r["body"] for r in books.pages_with_fallback(ch, pg).orderBy("idx").collect()] == ["own", "page", ""]
    got = books.page_status(ch, pg).first()
    assert (got["pages"], got["cached"], got["missing"]) == (3, 1, [1, 3])
