import binascii
import math

import numpy as np
from pyspark.sql import functions as F

from quillmill.llm import langid
from tests.llm.helpers import AWKWARD, docs


def test_whole_table(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in d.collect()}
    got = langid.op8_langid(spark, sf_dir).collect()
    assert len(got) == len(rows)
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == {i for i in rows if binascii.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == rows[r.doc_id].lang for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_counts_are_of_all_rows(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text")
    want = {}
    for r in d.collect():
        for g in langid.grams(langid.letters(r.text), langid.BUCKETS):
            for b in g.tolist():
                want[r.lang, b] = want.get((r.lang, b), 0) + 1
        want[r.lang, -1] = want.get((r.lang, -1), 0) + 1
    assert {(r.lang, r.bucket): r.n for r in langid.count_grams(d.repartition(7)).collect()} == want


def test_awkward_rows(spark):
    d = docs(spark, AWKWARD)
    model = langid.fit(d.filter("lang is not null").select("lang", "text"))
    got = langid.predict(d, model).collect()
    assert len(got) == len(AWKWARD) and got[0].asDict().keys() == {*d.columns, "lang_pred", "score"}
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert r.lang_pred in ("und", "de", "en")
    nothing = langid.fit(d.limit(0).select("lang", "text"))
    assert {r.lang_pred for r in langid.predict(d, nothing).collect()} == {"und"}
    assert langid.predict(d.limit(0), model).collect() == []


def test_buckets_are_a_parameter(spark, monkeypatch):
    rows = [(i, ("äöü " if i % 2 else "xyz ") * 20, f"l{i % 2}", None) for i in range(20)]
    model = langid.fit(docs(spark, rows).select("lang", "text"), buckets=4096)
    assert model.logp.shape == (4096, 2) and model.score(["äöü", "xyz"])[0] == ["l1", "l0"]


def test_blocks_of_languages_give_the_same(spark, sf_dir, monkeypatch):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.concat("lang", (F.col("doc_id") % 3).cast("string")).alias("lang"))
    whole = langid.fit(d.select("lang", "text"), buckets=4096, other=True)
    monkeypatch.setattr(langid, "MATRIX_BYTES", 8 * 4096 * 5)
    parts = langid.fit(d.select("lang", "text"), buckets=4096, other=True)
    assert isinstance(parts, langid.Blocks) and len(parts.parts) > 1 and parts.langs == whole.langs
    odd = docs(spark, AWKWARD).select("doc_id", "text", "lang").unionByName(d)
    a, b = (sorted(langid.predict(odd, m, margin="m").collect(), key=lambda r: (str(r.doc_id), str(r.text))) for m in (whole, parts))
    assert [r.lang_pred for r in a] == [r.lang_pred for r in b]
    for k in ("score", "m"):
        assert np.allclose([r[k] if r[k] is not None else -99 for r in a], [r[k] if r[k] is not None else -99 for r in b])


def test_more_than_a_thousand_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MATRIX_BYTES", 8 * 1024 * 400)
    word = lambda k: "".join(chr(97 + (k // 26**j) % 26) for j in range(3))
    rows = [(f"l{k:04}", f"{word(k)} " * 40) for k in range(1100)]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"), buckets=1024)
    assert len(model.langs) == 1100 and len(model.parts) == 3
    got = langid.predict(spark.createDataFrame(rows[::37], "lang string, text string"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.9


def test_margin_tells_gibberish_from_language(spark, sf_dir):
    """Held-out documents lie above 0, the same letters in another order and keyboard noise below, at any length."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.text]
    model = langid.fit(spark.createDataFrame([(x, t) for i, t, x in rows if i % 3 and x], "lang string, text string"), other=True)
    held = [(i, t) for i, t, _ in rows if i % 3 == 0 and len(t) > 40]
    noise = [(-1, "asdkj qwoeiu zmxnb qpwoei alskdj"), (-2, "xkq zzvw qpj " * 200)]
    mess = [(1_000_000 + i, "".join(chr(c) for c in langid.scrambled(langid.letters(t)).tolist())) for i, t in held]
    got = {r.i: r.m for r in langid.predict(spark.createDataFrame(held + noise + mess, "i bigint, text string"), model, margin="m").collect()}
    assert np.mean([got[i] > 0 for i, _ in held]) > 0.99
    assert np.mean([got[i] < 0 for i, _ in mess]) > 0.99
    assert all(got[i] < 0 for i, _ in noise)


def plain_posterior(learnt, text, smoothing=0.5, buckets=langid.BUCKETS):
    """Naive Bayes by the book: one logarithm a gram and language."""
    c = langid.letters(text).tolist()
    if not c:
        return "und", 0.0
    all_ = {}
    for lang, t in learnt:
        mine = all_.setdefault(lang, [0, {}])
        mine[0] += 1
        for g in langid.grams(langid.letters(t), buckets):
            for b in g.tolist():
                mine[1][b] = mine[1].get(b, 0) + 1
    said = {}
    for lang, (n, count) in all_.items():
        total = math.fsum(count.values()) + smoothing * buckets
        p = [math.log((count.get(b, 0) + smoothing) / total) for g in langid.grams(langid.letters(text), buckets) for b in g.tolist()]
        said[lang] = math.log(n / len(learnt)) + math.fsum(p)
    best = min(said, key=lambda x: (-said[x], x))
    return best, 1 / math.fsum(math.exp(x - said[best]) for x in said.values())


def test_posteriors_by_the_book(spark, sf_dir, monkeypatch):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    learnt = [(lang, t) for i, t, lang in rows if lang is not None and binascii.crc32(str(i).encode()) % 3 != 1]
    few = [(i, t) for i, t, _ in rows[:12]] + [(-1, None), (-2, ""), (-3, "?!"), (-4, "ab"), (-5, "der the"), (-6, "a " * 9000)]
    want = {i: plain_posterior(learnt, t) for i, t in few}
    got = {r.doc_id: r for r in langid.op8_langid(spark, sf_dir).collect()}
    model = langid.fit(spark.createDataFrame(learnt, "lang string, text string"))
    for slice_ in (langid._SLICE, 50):
        monkeypatch.setattr(langid, "_SLICE", slice_)
        langs, sure = model.score([t for _, t in few])
        for (i, _), lang, p in zip(few, langs, sure, strict=True):
            assert lang == want[i][0] and abs(p - want[i][1]) < 1e-6
            if i in got:
                assert got[i].lang_pred == lang and abs(got[i].score - p) < 1e-6


def test_slices_are_whole(monkeypatch):
    text = "Straße und Übermut " * 50
    whole = [np.concatenate([g for g in langid.grams(langid.letters(text), 1 << 16)])]
    monkeypatch.setattr(langid, "_SLICE", 37)
    parts = np.concatenate([g for g in langid.grams(langid.letters(text), 1 << 16)])
    assert np.array_equal(np.sort(whole[0]), np.sort(parts))
