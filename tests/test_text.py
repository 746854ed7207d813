from pyspark.sql import functions as F

from quillmill.functions import arrays, scalar, text, text_udf


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


def test_terms(spark):
    t = F.lit("变分法研究泛函极值问题，泛函分析是基础。Theorem and definition of calculus.")
    got = one(spark, text.terms(t))
    assert "泛函" in got and "calculus" in got and "的" not in got and "and" not in got and "研究" not in got
    assert one(spark, text.raw_words(F.lit("Foo-bar baz9 été naïve x ab abc-"))) == ["foo-bar", "baz", "abc-"]
    assert one(spark, text.han_bigrams(F.lit("拓扑空间x连续"))) == ["拓扑", "扑空", "空间", "连续"]
    assert one(spark, text.query_tokens(F.lit("极值问题 of Foo_1 of 中"))) == ["极值问题", "of", "Foo_1"]


def test_cleaning(spark):
    assert one(spark, text.clean_cluster_name(F.lit("Ａｂ１ 微积分（上） 线性，代数　x-y"))) == "Ab1 微积分上线性代数 x y"
    assert one(spark, text.clean_title(F.lit("书名（作者）_v2[x]"))) == "书名  v2 "
    assert one(spark, text.strip_latex(F.lit("a \\frac{x1}{y} b"))).split() == ["a", "b"]
    keep = [w for w in "定义 任意 函数 的稳 德的 与名 Hilbert".split() if not one(spark, text.is_fragment(F.lit(w)))]
    assert keep == ["定义", "任意", "函数", "Hilbert"]
    assert set(one(spark, text.inner_bigrams(F.lit("拉格朗日x泛函")))) == {"拉格", "格朗", "朗日"}


def test_blank_pages(spark):
    cases = {"": False, "  \n--": True, "<!-- 空白页 -->": True, "Blank": True, "x" * 30 + " blank": False, "正文": False}
    for t, want in cases.items():
        assert one(spark, text.is_blank_page(F.lit(t))) == want, t


def test_citations_and_json(spark):
    said = "见【《书》第3章 第4-5段】与【第 7 页】【第x页】"
    assert [tuple(c) for c in one(spark, text.citations(F.lit(said)))] == [(3, "4-5"), (7, "页")]
    assert one(spark, text.json_block(F.lit('x ```json\n{"a": {"b": 1}}\n``` y'))) == '{"a": {"b": 1}}'
    assert one(spark, text.json_block(F.lit("none"))) is None


def test_search_words(spark):
    assert one(spark, text.search_words(F.lit("ab12-3,c.d;e:f xyz"), strict=True)) == ["xyz"]
    assert one(spark, text.search_words(F.lit('say "(ab12-3)" no: of'))) == ["say", "ab12"]
    assert one(spark, text.search_words(F.lit("aaa bbb ccc ddd eee fff ggg hhh iii"))) == "aaa bbb ccc ddd eee fff ggg hhh".split()


def test_snippets_and_marks(spark):
    assert one(spark, text.snippet(F.lit("a" * 50 + "key" + "b" * 50), "key")) == "…" + "a" * 30 + "key" + "b" * 30 + "…"
    assert one(spark, text.snippet(F.lit("abc"), "zz")) == "abc"
    assert one(spark, text.highlight(F.lit("<b>Key"), ["key"])) == "&lt;b&gt;<mark>Key</mark>"
    assert one(spark, text.mask_key(F.lit("sk-1234567890"))) == "sk-******7890" and one(spark, text.mask_key(F.lit("short"))) == "*****"
    assert one(spark, text.quote_position(F.lit("a  b\n c"), F.lit("b c"))) == 3
    assert one(spark, text.rolling_hash(F.lit("ab"), 5381, 33)) == (5381 * 33 + 97) * 33 + 98
    assert one(spark, text.rolling_hash(F.lit("é\U0001f4d6"), 0, 31)) == ((0xE9 * 31 + 0xD83D) * 31 + 0xDCD6) % 2**32  # units of UTF-16
    assert one(spark, text.rolling_hash(F.lit(""), 7, 31)) == 7 and one(spark, text.rolling_hash(F.lit(None).cast("string"), 7, 31)) is None
    ends = [one(spark, text.list_fingerprint(F.array(*map(F.lit, x)))) for x in (("ab", "c"), ("a", "bc"))]
    assert ends[0] != ends[1]
    assert one(spark, text.numbered_paragraphs(F.lit("x\n\n y "))) == "【第1段】x\n【第2段】y"


def test_arrays(spark):
    assert one(spark, arrays.clean_tags(F.array(F.lit(" a"), F.lit(""), F.lit("b"), F.lit("a ")))) == ["a", "b"]
    assert one(spark, arrays.tail(F.array(F.lit(1)), 3)) == [1]
    assert one(spark, arrays.add_maps(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3)))) == {"a": 3, "b": 3}


def test_scalars(spark):
    score, level = scalar.calibration(F.lit(12), F.lit(12), F.lit(18), F.lit(9.0))
    assert one(spark, score) >= 4.5 and one(spark, level) == "advanced"
    score, level = scalar.calibration(F.lit(0), F.lit(0), F.lit(0), F.lit(0.0))
    assert one(spark, score) == 0.0 and one(spark, level) == "beginner"
    warm, review = scalar.pace(F.lit(0.5))
    assert (one(spark, warm), one(spark, review)) == (2, 1)
    assert one(spark, scalar.knowledge_level(F.lit("进阶"))) == "intermediate"


def test_html():
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><p>A&amp;b <b>c</b></p><br>d<style>x</style></body></html>'
    assert text_udf.html_text(page) == "T\nA&b c\nd"
    dirty = '<p onclick="x()">a<script>evil()</script><!-- c --><a href="javascript:x">l</a><meta charset="u">b<img src="i.png"/></p>'
    assert text_udf.scrub(dirty, {"i.png": "images/i.png"}) == '<p>a<a>l</a>b<img src="images/i.png"/></p>'
    assert text_udf.scrub('<a title="x&quot; onerror=&quot;y">k</a>') == '<a title="x&quot; onerror=&quot;y">k</a>'
    assert text_udf.html_text(None) == "" and text_udf.scrub("") == ""
    images = {"OPS/img/a.svg": "images/a.svg", "b.png": "images/b.png"}
    page = '<img src="../img/a.svg#part"><img src="./x/../../img/a.svg"><img src="../../b.png"><a href="#here">k</a><a href="other.html#x">l</a>'
    want = '<img src="images/a.svg#part"><img src="images/a.svg"><img src="images/b.png"><a href="#here">k</a><a href="other.html#x">l</a>'
    assert text_udf.scrub(page, images, "OPS/text") == want
    assert text_udf.scrub("<iframe>a<iframe>b</iframe>c</iframe>d</iframe>e<meta>f<object>g") == "def"
    assert text_udf.html_text("a<script>b<style>c</script>d</style>e<br>f<br/>g</p>") == "ade\nf\ng"


def test_chunks():
    got = text_udf.chunks("a" * 120 + "\n\n" + "b" * 120 + "\nc c", 50)
    assert [p for p, _ in got] == ["1-1", "2-2", "3-3"] and got[0][1] == "a" * 120
    assert text_udf.chunks(" \n ") == [("-", " \n ")]
    assert text_udf.packed(["h\n" + "x" * 6 + "\n" + "y" * 6, "ab", "cd"], 10) == ["h\nxxxxxx", "h\nyyyyyy", "ab\n\ncd"]


def test_outline():
    nodes = text_udf.outline("# A\n- b\n  - c 定理\n\n## D\n- e")
    assert [(i, p) for i, p, *_ in nodes] == [(1, 0), (2, 0), (3, 2), (4, 2), (5, 0)]
    assert nodes[2][3] == "important"
    assert text_udf.outline_markdown(text_udf.outline("- a\n  - b")) == "- a\n  - b (detail)"


def test_decoding():
    assert text_udf.decode_text("中文".encode("gbk")) == "中文" and text_udf.decode_text("é".encode()) == "é"
    assert text_udf.decode_text(b"\xff\xfe\xff") == b"\xff\xfe\xff".decode("latin-1")


def test_profile_terms():
    lex, stop = frozenset(["泛函", "Hilbert"]), frozenset(["任意"])
    got = dict(text_udf.profile_terms("泛函 任意 Hilbert \\frac{a1}{b} space space 123", lex, stop, {"space": "空间"}))
    assert got["泛函"] == 3 and got["Hilbert"] == 3 and got["空间"] == 2 and "123" not in got and "任意" not in got and "frac" not in got


def test_lexicon_by_automaton(spark, monkeypatch):
    """Equal to the condition by condition join, with terms inside terms, at bounds, in any case, and Han ones."""
    import random

    from quillmill.operators import terms as O

    rng = random.Random(12)
    words = ["Graph", "graph theory", "theory", "a.b", "x-ray", "ray", "图论", "论", "Ä", "c++", "42"]
    texts = [" ".join(rng.choice([*words, "graphs", "pre-graph", "THEORY,", "(x-ray)", "图论x", "ä"]) for _ in range(6)) for _ in range(60)] + [None, "", "graph"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    lex = spark.createDataFrame([(w,) for w in [*words, "", None, "theory"]], "term string")
    got = [tuple(r) for r in O.lexicon_hits(df, "id", "text", lex).collect()]
    monkeypatch.setattr(O, "AUTOMATON", 3)
    want = [tuple(r) for r in O.lexicon_hits(df, "id", "text", lex).collect()]
    assert sorted(got) == sorted(want) and len(set(got)) == len(got) > 60


def test_a_large_lexicon(spark):
    from quillmill.operators import terms as O

    lex = spark.range(100_000).selectExpr("concat('term', id) as term")
    df = spark.createDataFrame([(1, "term7 term99999 term100000 xterm8 term5-a TERM42"), (2, None)], "id long, text string")
    got = O.lexicon_hits(df, "id", "text", lex)
    assert {tuple(r) for r in got.collect()} == {(1, "term7"), (1, "term99999"), (1, "term42")}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
