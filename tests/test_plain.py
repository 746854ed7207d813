"""Queries that SQL does not express, over the whole small tables, beside plain versions written another way."""

import html
import json
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillmill.operators import graph
from quillmill.operators.profile import Fold
from quillmill.plans import graphs, readers
from quillmill.tables import Tables


@pytest.fixture(scope="module")
def t(spark, sf_dir):
    return Tables(spark, sf_dir)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return lambda name: entry.queries()[name](spark, sf_dir).collect()


def plain_components(nodes, edges):
    near = {n: {n} for n in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(nodes):
        if n not in out:
            seen, todo = {n}, [n]
            while todo:
                for m in near[todo.pop()] - seen:
                    seen.add(m)
                    todo.append(m)
            out |= dict.fromkeys(seen, n)
    return out


def plain_propagation(nodes, edges, rounds=10, guard=1.05):
    label = {n: n for n in nodes}
    for _ in range(rounds):
        before = dict(label)
        for n in sorted(nodes):
            around = [(b if a == n else a, s) for a, b, s in edges if n in (a, b)]
            if not around:
                continue
            weight = {}
            for m, s in around:
                weight[label[m]] = weight.get(label[m], 0.0) + s
            best = sorted(weight, key=lambda c: (-weight[c], sum(x == c for x in label.values()), c))[0]
            if weight[best] > guard * weight.get(label[n], 0.0):
                label[n] = best
        if label == before:
            break
    least = {}
    for n in sorted(nodes):
        least.setdefault(label[n], n)
    return {n: least[label[n]] for n in nodes}


def test_label_propagation(spark, t, rows):
    edges = [tuple(r) for r in graphs.part_edges(t).collect()]
    nodes = [r[0] for r in graphs.suppliers(t).collect()]
    assert {r.node: r.cluster for r in rows("GR8_label_propagation")} == plain_propagation(nodes, edges)
    rng = __import__("random").Random(8)
    for seed in range(3):  # several communities, bridges and lone nodes
        made = sorted({(min(p), max(p)) for p in ((c * 10 + rng.randrange(10), c * 10 + rng.randrange(10)) for c in range(5) for _ in range(25)) if p[0] != p[1]} | {(3, 14), (25, 31)})
        some = [(a, b, round(rng.uniform(0.1, 1), 3)) for a, b in made]
        df = spark.createDataFrame(some, "a long, b long, sim double")
        got = graph.label_propagation(spark.range(seed, 55).toDF("node"), df.filter(f"a >= {seed}"))
        want = plain_propagation(range(seed, 55), [e for e in some if e[0] >= seed])
        assert {r.node: r.cluster for r in got.collect()} == want


def test_label_propagation_by_sweeps(spark):
    """A component beyond one task's share beside a small one; equal weights, so that nearly every choice is one of the rarest label."""
    rng = __import__("random").Random(3)
    made = sorted({(min(p), max(p)) for p in ((rng.randrange(14), rng.randrange(14)) for _ in range(24)) if p[0] != p[1]} | {(20, 21), (21, 22)})
    some = [(a, b, 0.5) for a, b in made]
    df = spark.createDataFrame(some, "a long, b long, sim double")
    got = graph.label_propagation(spark.range(24).toDF("node"), df, task_edges=5)
    assert {r.node: r.cluster for r in got.collect()} == plain_propagation(range(24), some)


def plain_fragments(member, base, edges, tau):
    count = lambda m, c: sum(x == c for x in m.values())
    now, alone = dict(member), [n for n in sorted(member) if count(member, member[n]) == 1 and count(base, base[n]) >= 2]
    for n in alone:
        if count(now, now[n]) > 1:
            continue  # another one has come
        near = sorted((-s, b if a == n else a) for a, b, s in edges if n in (a, b) and s >= 0.8 * tau)
        if near:
            now[n] = now[near[0][1]]
    return now


def test_fragments(spark, t, rows):
    as_dict = lambda df: {r.node: r.cluster for r in df.collect()}
    e = graphs.part_edges(t)
    base = graph.clusters(graphs.suppliers(t), e)
    split = graph.split_bloated(base, e, 0.08, 0.8)
    want = plain_fragments(as_dict(split), as_dict(base), [tuple(r) for r in e.collect()], 0.08)
    assert {r.node: r.cluster for r in rows("GR12_fragments")} == want
    rng = __import__("random").Random(12)
    for _ in range(3):
        edges = [(a, b, round(rng.random(), 4)) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.15]
        member = [(n, n if n % 3 else n // 10) for n in range(30)]
        old = [(n, n // 10) for n in range(30)]
        frame = lambda x: spark.createDataFrame(x, "node long, cluster long")
        got = graph.merge_fragments(frame(member), frame(old), spark.createDataFrame(edges, "a long, b long, sim double"), 0.5)
        assert as_dict(got) == plain_fragments(dict(member), dict(old), edges, 0.5)


def plain_merge(books, features, least=5):
    """books node -> cluster, features node -> terms: all clusters in one list, as the rule says it."""
    order = list(dict.fromkeys(books[n] for n in sorted(books)))
    has = {c: set().union(*(features.get(n, set()) for n in books if books[n] == c)) for c in order}
    size = {c: sum(x == c for x in books.values()) for c in order}
    end = {c: c for c in order}
    while True:
        pair = next(((a, b) for k, a in enumerate(order) for b in order[k + 1 :] if len(has[a] & has[b]) >= least), None)
        if pair is None:
            return end
        main, sub = pair if size[pair[0]] >= size[pair[1]] else pair[::-1]
        has[main], size[main] = has[main] | has[sub], size[main] + size[sub]
        order.remove(sub)
        end = {c: main if e == sub else e for c, e in end.items()}


def test_cluster_merge(spark, t, rows):
    v = graphs.vectors(t).filter("rank <= 15").select("doc", "term", F.xxhash64("doc").alias("node")).collect()
    books, features = {r.node: r.doc for r in v}, {}
    for r in v:
        features.setdefault(r.node, set()).add(r.term)
    got = {r.cluster: r.merged for r in rows("GR16_cluster_merge")}
    assert got == plain_merge(books, features) and any(a != b for a, b in got.items())
    rng = __import__("random").Random(16)
    books = {n: f"c{n % 17}" for n in range(40)}  # two vocabularies that never meet, one cluster without terms
    features = {n: {f"{'xy'[n % 17 > 8]}{rng.randrange(25)}" for _ in range(5)} for n in range(40) if n % 17 != 4}
    one = spark.createDataFrame(list(books.items()), "node long, cluster string")
    two = spark.createDataFrame([(n, x) for n, xs in features.items() for x in xs], "node long, term string")
    assert {r.cluster: r.merged for r in graph.merge_clusters(one, two, 4).collect()} == plain_merge(books, features, 4)
    # words common to all, fewer than a merge needs; chains that only meet by what others brought in
    books = {n: f"c{n:02}" for n in range(60)}
    features = {n: {"of", "and", "the"} | {f"g{n // 6}w{(n + j) % 9}" for j in range(3)} for n in range(60)}
    two = spark.createDataFrame([(n, x) for n, xs in features.items() for x in xs], "node long, term string")
    one = spark.createDataFrame(list(books.items()), "node long, cluster string")
    got = graph.merge_clusters(one, two, 5)
    want = plain_merge(books, features, 5)
    assert {r.cluster: r.merged for r in got.collect()} == want and 1 < len(set(want.values())) < 60


def test_overlap_pairs(spark):
    rng = __import__("random").Random(3)
    sets = {i: {"common", "word"} | {f"k{rng.randrange(40)}" for _ in range(rng.randrange(12))} for i in range(50)}
    df = spark.createDataFrame([(i, k) for i, ks in sets.items() for k in ks], "i long, k string")
    for least in (1, 2, 3, 5):
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least}
        got = [tuple(r) for r in graph.overlapping(df, least).collect()]
        assert set(got) == want and len(got) == len(want)


def plain_rename(wish):
    taken, out = set(wish), []
    for old in sorted(wish):
        if wish[old] not in taken:
            taken = taken - {old} | {wish[old]}
            out.append((old, wish[old]))
    return sorted(out)


def test_cluster_rename(spark, t, rows):
    terms = {}
    for r in graphs.vectors(t).select("doc", "term").distinct().collect():
        c = terms.setdefault(r.doc.split("/")[-1], {})
        c[r.term] = c.get(r.term, 0) + 1
    wish = {c: min(n, key=lambda x: (x != "eau", -n[x], x)) for c, n in terms.items()}
    assert sorted(tuple(r) for r in rows("GR17_cluster_rename")) == plain_rename(wish)
    wish = {"a": "b", "b": "c", "c": "c", "d": "z", "e": "z", "f": "d", "g": "f", "h": None, "i": "q"}
    counts = spark.createDataFrame([(c, w, 3) for c, w in wish.items() if w], "cluster string, term string, n long")
    named = spark.createDataFrame([(c,) for c in wish], "cluster string")
    got = graph.rename_clusters(named, counts, spark.createDataFrame([], "term string"))
    assert sorted(tuple(r) for r in got.collect()) == plain_rename({c: w or c for c, w in wish.items()})


def test_profile_fold(t, rows):
    """By closed forms: a theme's preference is what it stood at, summed over the archives from the threshold on."""
    f, events = Fold(), {}
    for r in readers.archives(t).collect():
        events.setdefault(r.user, []).append((r.at, r.key, r.book, list(r.terms)))
    got = {r.user: r for r in rows("PR3_profile_fold")}
    assert got.keys() == events.keys()
    for user, es in events.items():
        es.sort()
        n, themes, prefs, recent, interests = len(es), {}, {}, [], []
        for k, (_, _, book, terms) in enumerate(es, 1):
            for x in terms:
                themes[x] = themes.get(x, 0) + 1
            recent = ([b for b in recent if b != book] + [book])[-f.recent :]
            if k > f.threshold:
                recent = recent[-1:]
            if k >= f.threshold:
                top = sorted(themes, key=lambda x: (-themes[x], x))[: f.interests]
                interests += [x for x in top if x not in interests and x not in f.stop]
        for x in themes:
            at = [k for k, e in enumerate(es, 1) for y in e[3] if y == x]
            stood = sum(max(0, n - max(k, f.threshold) + 1) for k in at)
            if stood:
                prefs[x] = stood
        r = got[user]
        assert (r["count"], json.loads(r.recent), json.loads(r.themes), json.loads(r.prefs), json.loads(r.interests)) == (n, recent, themes, prefs, interests)


BLOCK = "p|div|h[1-6]|li|tr|blockquote|pre|section|article|header|footer|figure|figcaption|table|ul|ol|dl|dt|dd|hr|br"


def test_html(t, rows):
    """Pages by regular expressions: their markup is well formed."""
    unsafe = "script|iframe|object|embed|form|base|link|meta|template|noscript|applet|frame|frameset"
    text, clean = ({r.page_id: r[1] for r in rows(n)} for n in ("TX12_html_text", "TX13_scrub_html"))
    for r in t.pages.collect():
        x = re.sub(r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style)\b.*?</\1\s*>", "", r.html)
        x = re.sub(rf"(?i)</?(?:{BLOCK})\b[^>]*>", "\n", x)
        x = html.unescape(re.sub(r"<[a-zA-Z/][^>]*>", "", x))
        assert text[r.page_id] == "\n".join(y.strip() for y in x.splitlines() if y.strip())
        assert not re.search(rf"(?i)<({unsafe})\b|\son\w+=|=\"\s*javascript:|<!--", clean[r.page_id])
        kept = re.sub(rf"(?is)<!--.*?-->|<!doctype[^>]*>|<({unsafe})\b[^>]*>.*?</\1\s*>|</?(?:{unsafe})\b[^>]*>", "", r.html)
        tags = lambda s: [x.lower() for x in re.findall(r"</?([a-zA-Z][a-zA-Z0-9]*)", s)]
        assert tags(clean[r.page_id]) == tags(kept)


def test_packed_blocks(t, rows):
    """Nothing is lost, no block passes the limit but for one line, and none could have taken what the next begins with."""
    from quillmill.functions.text_udf import chunks

    got = {}
    for r in rows("TX16_packed"):
        got.setdefault(r.doc_id, {})[r.part] = r.block
    for r in t.documents.collect():
        units = [f"[{k}]\n{b}" for k, (_, b) in enumerate(chunks(r.text, 400))]
        parts = [got[r.doc_id][k] for k in range(len(got[r.doc_id]))]
        at = 0
        while at < len(units):
            u = units[at]
            if len(u) > 1000:  # cut at lines, the first one on each part
                head, *lines = u.split("\n")
                while lines:
                    mine = parts.pop(0).split("\n")
                    assert mine[0] == head and mine[1:] == lines[: len(mine) - 1] and len(mine) > 1
                    assert len("\n".join(mine)) + 1 <= 1000 or len(mine) == 2
                    lines = lines[len(mine) - 1 :]
                    assert not lines or len("\n".join([*mine, lines[0]])) + 1 > 1000
                at += 1
                continue
            n = 1
            while at + n < len(units) and len(units[at + n]) <= 1000 and sum(map(len, units[at : at + n + 1])) <= 1000:
                n += 1
            assert parts.pop(0) == "\n\n".join(units[at : at + n])
            at += n
        assert not parts


def plain_outline(text):
    found = []
    for line in (text or "").splitlines():
        if m := re.match(r"(#{1,6})\s+(.*)", line):
            depth, name = len(m[1]), m[2]
        elif m := re.match(r"(\s*)(?:[-*+]|\d+[.)])\s+(.*)", line):
            depth, name = 1 + len(m[1]) // 2, m[2]
        else:
            wide = line.replace("\t", "    ")
            depth, name = 1 + (len(wide) - len(wide.lstrip())) // 2, line
        if name.strip():
            found.append((depth, name.strip()))
    out = []
    for k, (depth, name) in enumerate(found):
        parent = max((j + 1 for j in range(k) if found[j][0] < depth), default=0)  # the nearest one above that is less deep
        kind = "important" if re.search("定理|公式|定义|结论|推论|命题|定律|公理", name) else "detail" if depth >= 2 else "outline"
        out.append((k + 1, parent, depth, kind, name))
    return out


def test_outlines(t, rows):
    got, said = {}, {r.doc_id: r.markdown for r in rows("LM6_outline_fallback")}
    for r in rows("TX25_outline"):
        got.setdefault(r.doc_id, []).append((r.id, r.parent, r.depth, r.kind, r.name))
    for d in t.documents.collect():
        want = plain_outline(d.text)
        assert sorted(got.get(d.doc_id, [])) == want
        deep = {0: -1}
        for i, parent, *_ in want:
            deep[i] = deep[parent] + 1
        lines = ["  " * deep[i] + f"- {name}" + (f" ({kind})" if kind != "outline" else "") for i, _, _, kind, name in want]
        assert said[d.doc_id] == "\n".join(lines)


def test_profile_terms(t, rows):
    """No Han text in the tables: words by one pattern, counted, the lexicon's doubled and one more."""
    from quillmill.functions import text as T
    from quillmill.functions.text_udf import LATEX_NAMES

    stop, got = {*T.STOPWORDS_ENGLISH, *T.STOPWORDS_HAN}, {}
    for r in rows("TX9_profile_terms"):
        got.setdefault(r.doc_id, []).append((r.term, r.w))
    for d in t.documents.collect():
        clean = re.sub(r"\\[A-Za-z]+", " ", re.sub(r"\{[^{}\n]*[A-Za-z0-9\\][^{}\n]*\}", " ", d.text or ""))
        found = {}
        for w in re.findall(r"[A-Za-z][A-Za-z0-9-]*", clean):
            if len(w) > 1 and w not in stop and w not in LATEX_NAMES:
                w = "du" if w.lower() == "des" else w
                found[w] = found.get(w, 0) + 1
        for x in ("tion", "eau", "ung"):
            if x in re.split(r"[^A-Za-z0-9-]+", clean.lower()):
                found[x] = 2 * found.get(x, 0) + 1
        assert got.get(d.doc_id, []) == [(w, float(n)) for w, n in sorted(found.items(), key=lambda kv: (-kv[1], kv[0]))[:10]]


def test_epub_books(t, rows):
    """Books of ten pages each: every page that shows something is a chapter, in order, its images in their new place."""
    from quillmill.functions.text_udf import html_text

    shown = {}
    for p in t.pages.orderBy("page_id").collect():
        body = re.search(r"(?is)<body[^>]*>(.*)</body>", p.html)
        text = html_text(body[1] if body else p.html)
        shown.setdefault(p.page_id // 10, []).append(text)
    got = {}
    for r in rows("SC5_epub_scan"):
        got.setdefault(int(r.path.split("/")[-1].split(".")[0]), []).append((r.idx, r.title, r.text))
    for book, texts in shown.items():
        want = [x for x in texts if x]
        mine = sorted(got.get(book, []))
        assert [i for i, _, _ in mine] == list(range(1, len(mine) + 1)) and [x for _, _, x in mine] == [f"{x}" for x in want]
        assert all(title and len(title) <= 80 for _, title, _ in mine)
