"""Queries that do the whole job, beside brute force over small tables."""

import hashlib
import re

import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """Runs a query over tables given as (rows, schema)."""

    def go(name, **tables):
        d = tmp_path_factory.mktemp("sf")
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{d}/{t}.parquet")
        return entry.queries()[name](spark, str(d)).collect()

    return go


def test_one_shared_word_is_a_hit(run):
    docs = [(1, "alpha beta beta"), (2, "beta gamma"), (3, "delta"), (4, "no")]
    items = [(2, "beta gamma"), (7, "alpha delta beta"), (8, "omega")]
    words = lambda x: set(re.findall(r"[a-z][a-z\-]{2,}", x.lower()))
    want = {(i, d, len(words(a) & words(b))) for i, a in items for d, b in docs if i != d and words(a) & words(b)}
    got = run("JN9_index_probe", documents=(docs, "doc_id long, text string"), benchmark=(items, "item_id long, text string"))
    assert {tuple(r) for r in got} == want and len(got) == len(want) == 4


def test_longer_keys_are_masked(run):
    made = [(1, "Customer#1", "BUILDING"), (2, "Customer#2", "AUTOMOBILE"), (3, "Customer#3", "MACHINERY"), (4, "Customer#4", None)]
    got = run("TX27_mask", customer=(made, "c_custkey long, c_name string, c_mktsegment string"))
    assert {r.c_custkey: r.s for r in got} == {1: "********", 2: "AUT***BILE", 3: "MAC**NERY", 4: None}


def test_all_languages_and_both_formats(run):
    docs = [(1, "<b>eins</b>", "de"), (2, "two", "en"), (3, "three", None)]
    got = run("TX38_plain_text", documents=(docs, "doc_id long, text string, lang string"), pages=([(1, "<p>one</p><script>x()</script>")], "page_id long, html string"))
    assert {(r.kind, r.id): r.text.strip() for r in got} == {("md", 1): "<b>eins</b>", ("md", 2): "two", ("md", 3): "three", ("epub", 1): "one"}


LONG = "word, " * 40


def test_whole_names_are_cleaned(run):
    made = [(1, LONG + "Ｔａｉｌ 图 论 (end)"), (2, LONG + "naïve_tail + x"), (3, "")]
    tables = {"documents": (made, "doc_id long, text string")}
    words = " ".join(["word"] * 40)
    got = {r.doc_id: r.name for r in run("TX5_cluster_name", **tables)}
    assert got == {1: f"{words} Tail 图论 end", 2: f"{words} na ve tail x", 3: ""}
    got = {r.doc_id: r.name for r in run("TX6_profile_name", **tables)}
    assert got == {k: re.sub(r"[^\w]+", " ", x).strip() for k, x in made}


def test_latex_is_stripped_behind_long_texts(run):
    made = [(1, LONG + r"\beta {c2} kept {图}")]
    want = re.sub(r"\\[A-Za-z]+", " ", re.sub(r"\{[^{}\n]*[A-Za-z0-9\\][^{}\n]*\}", " ", "\\frac{a1}{b} " + made[0][1] + r" \alpha {x{y}}"))
    got = run("TX8_strip_latex", benchmark=(made, "item_id long, text string"))
    assert [r.t for r in got] == [want] and "beta" not in want and "c2" not in want and "{图}" in want


def test_fragments_of_whole_texts(run):
    from quillmill.functions.text import FRAGMENT_CHARS, STOPWORDS_HAN

    made = [(1, LONG + "函数的定义与稳定性 of x1"), (2, LONG + "图论 图论")]
    terms = set()
    for _, x in made:
        terms |= set(re.findall("[一-鿿]+|[A-Za-z][A-Za-z0-9_]*", x))
        terms |= {r[k : k + 2] for r in re.findall("[一-鿿]+", x) for k in range(len(r) - 1)} - set(STOPWORDS_HAN)
    inner = lambda x: len({r[k : k + 2] for r in re.findall("[一-鿿]{3,}", x) for k in range(len(r) - 1)})
    want = {(x, len(x) == 2 and any(c in FRAGMENT_CHARS for c in x), inner(x)) for x in terms}
    got = run("TX10_fragments", documents=(made, "doc_id long, text string"))
    assert {tuple(r) for r in got} == want and len(got) == len(want) and any(f for _, f, _ in want) and any(n for _, _, n in want)


def test_theorem_lines_are_linked(spark):
    """Chapters in their order, theorem lines within their chapter; blank notes and titles as the rule has them."""
    from quillmill.operators import graph

    long = "Proposition " + "é" * 400
    chapters = [
        ("b", 1, " One\t", "x\r\nTheorem 1 holds\nand so on\x0b  Proof of theorem 1  \u2028Lemma\nLemma two of it", 9), ("b", 4, None, "", 0),
        ("b", 9, "", long + "\n", 1), ("c", 2, "Two", None, 3),
    ]
    notes = [("b", 1, 7, None, "a thought", "idea"), ("b", 1, 8, "a quote", "", "idea"), ("b", 1, 9, "", None, "mark"), ("b", 4, 10, None, " ", " "), ("b", 4, 11, "  ", "t", "k")]
    c = spark.createDataFrame(chapters, "doc string, chapter long, title string, text string, words int")
    n = spark.createDataFrame(notes, "doc string, chapter long, note long, quote string, text string, kind string")
    nodes = graph.inner_nodes(c, n)
    got = {(r.doc, r.level, r.chapter, r.pos, r.title, r.summary, r.importance) for r in nodes.collect()}
    want = {
        ("b", "chapter", 1, None, "One", "x\r\nTheorem 1 holds\nand so on\x0b  Proof of theorem 1  \u2028Lemma\nLemma two of it", 4), ("b", "chapter", 4, None, "Chapter 4", "", 2),
        ("b", "chapter", 9, None, "Chapter 9", long[:200], 4), ("c", "chapter", 2, None, "Two", "", 4),
        ("b", "theorem", 1, 2, "Theorem 1 holds", "Theorem 1 holds", 5), ("b", "theorem", 1, 4, "Proof of theorem 1", "Proof of theorem 1", 5),
        ("b", "theorem", 1, 6, "Lemma two of it", "Lemma two of it", 5), ("b", "theorem", 9, 1, long[:50], long[:300], 5),
        ("b", "note", 1, 7, "a thought", "a thought", 5), ("b", "note", 1, 8, "a quote", "a quote", 5), ("b", "note", 1, 9, "mark", "", 5),
    }
    assert got == want
    assert {tuple(r) for r in graph.inner_edges(nodes).collect()} == {
        ("b", "chapter", 1, 1, 4, 60), ("b", "chapter", 4, 4, 9, 60), ("b", "theorem", 1, 2, 4, 50), ("b", "theorem", 1, 4, 6, 50)
    }


def test_the_tables_have_theorem_lines_in_a_row(spark, sf_dir):
    levels = {r.level: r["count"] for r in __import__("__spark_entry__").queries()["GR20_inner_edges"](spark, sf_dir).groupBy("level").count().collect()}
    assert levels["chapter"] > 10 and levels["theorem"] > 10


@pytest.mark.parametrize("most", [200_000, 2])
def test_questions_against_texts(spark, monkeypatch, most):
    """By dictionary and by joins: own documents left out, points and entries counted up to their limits."""
    from quillmill.operators import graph

    monkeypatch.setattr(graph, "DICTIONARY", most)
    rng = __import__("random").Random(21)
    vocab = [f"w{k}" for k in range(30)]
    asks = [(f"q{k}", k % 4, x) for k in range(6) for x in rng.sample(vocab, 5)]
    texts = [(d, [sorted(set(rng.choices(vocab, k=3))) for _ in range(rng.randrange(14))]) for d in range(8)] + [(20, None), (21, [])]
    hits = [(d, e, x) for d in (1, 2, 30) for e in range(8) for x in rng.sample(vocab, 3)]
    got = graph.appears_in_texts(
        spark.createDataFrame(asks, "src string, doc long, term string"), spark.createDataFrame(texts, "doc long, points array<array<string>>"),
        spark.createDataFrame(hits, "doc long, entry long, term string"),
    )
    want = set()
    for q in {a[0] for a in asks}:
        mine, own = {x for s, _, x in asks if s == q}, next(d for s, d, _ in asks if s == q)
        for d in [t[0] for t in texts] + [30]:
            points = [set(p) & mine for t, ps in texts if t == d for p in ps or []]
            entries = {}
            for dd, e, x in hits:
                if dd == d and x in mine:
                    entries.setdefault(e, set()).add(x)
            every = set().union(*points, *entries.values())
            if every and d != own:
                want.add((q, d, len(every), tuple(sorted(every)[:6]), min(10, sum(map(bool, points))), min(5, len(entries))))
    assert {(r.src, r.doc, r.matched, tuple(r.common), r.points, r.entries) for r in got.collect()} == want


def test_entries_are_looked_up(run):
    docs = [(1, "alpha beta\nbeta gamma"), (2, "delta")]
    talk = [(1, 0, "assistant", "beta omega"), (2, 0, "user", "alpha"), (3, 0, "assistant", "alpha"), (3, 1, "assistant", "none")]
    talk += [(4, k, "assistant", "gamma ray") for k in range(7)]
    asked = [(9, "alpha beta omega gamma")]
    got = run(
        "GR21_appears_in", documents=(docs, "doc_id long, text string"), benchmark=(asked, "item_id long, text string"),
        conversations=(talk, "conv_id long, turn int, role string, text string"),
    )
    want = {(9, 1, 4, "alpha,beta,gamma,omega", 2, 1), (9, 3, 1, "alpha", 0, 1), (9, 4, 1, "gamma", 0, 5)}
    assert {(r.src, r.doc, r.matched, r.common, r.points, r.entries) for r in got} == want


def test_long_documents_are_hashed(run):
    made = [(1, "é" * 30_000), (2, "short")]
    got = run("SK9_content_hash", documents=(made, "doc_id long, text string"))
    assert {tuple(r) for r in got} == {(k, hashlib.sha256(x.encode()).hexdigest(), len(x.encode())) for k, x in made}


def test_no_cluster_is_left_out_of_a_merge(spark):
    from quillmill.operators.graph import merge_clusters

    books = spark.createDataFrame([(k, f"c{k}") for k in range(5)], "node bigint, cluster string")
    features = spark.createDataFrame([(k, f"t{k}") for k in range(5)], "node bigint, term string")
    assert {r.cluster: r.merged for r in merge_clusters(books, features).collect()} == {f"c{k}": f"c{k}" for k in range(5)}


def test_merge_of_many_clusters(spark, monkeypatch):
    """20,000 clusters that all share five terms merge in seconds, and Spark joins them without a pair of them being a row."""
    import time

    from quillmill.operators import graph

    def no_pairs(sets, least):
        assert sets.select("i").distinct().count() < 10
        return overlapping(sets, least)

    overlapping = graph.overlapping
    monkeypatch.setattr(graph, "overlapping", no_pairs)
    books = spark.range(20_000).selectExpr("id as node", "concat('c', id) as cluster")
    features = spark.range(20_000).selectExpr("id as node", "explode(array('a', 'b', 'c', 'd', 'e', concat('own', id))) as term")
    began = time.time()
    assert {r.merged for r in graph.merge_clusters(books, features).select("merged").distinct().collect()} == {"c0"}
    assert time.time() - began < 90


def test_merge_rule_in_order():
    """The first pair in order merges, then again: as the plain rule that starts again after each merge."""
    import random

    from quillmill.operators.graph import merge_in_order

    def plain(size, terms, least):
        size, has, order, end = list(size), [set(x) for x in terms], list(range(len(size))), list(range(len(size)))
        at = 0
        while at < len(order):
            a = order[at]
            b = next((x for x in order[at + 1 :] if len(has[a] & has[x]) >= least), None)
            if b is None:
                at += 1
                continue
            main, sub = (a, b) if size[a] >= size[b] else (b, a)
            has[main] |= has[sub]
            size[main] += size[sub]
            order.remove(sub)
            end, at = [main if e == sub else e for e in end], 0
        return end

    for seed in range(300):
        rng = random.Random(seed)
        n, words, least = rng.randrange(1, 40), rng.choice([15, 30, 60, 120]), rng.choice([1, 2, 3, 4])
        terms = [{rng.randrange(words) for _ in range(rng.randrange(7))} for _ in range(n)]
        size = [rng.randrange(1, 5) for _ in range(n)]
        assert merge_in_order(size, terms, least) == plain(size, terms, least)
