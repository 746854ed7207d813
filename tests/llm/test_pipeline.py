import re

import corpus_pipeline
from quillmill.llm import bpe
from tests.llm.helpers import AWKWARD, docs
from tests.llm.test_mixing import plain_targets
from tests.llm.test_simhash import plain_fingerprint


def test_stages_over_the_table(spark, sf_dir, tmp_path):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cols = d.columns
    by = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        by[name] = (d, d := spark.read.parquet(f"{tmp_path}/{name}"))
    for name in list(by)[:-1]:
        assert by[name][1].columns == cols
    before, after = ({r.doc_id: r for r in x.collect()} for x in by["language_id"])
    assert all(before[i].lang == r.lang for i, r in after.items())
    assert {i for i, r in before.items() if re.search(r"[^\W\d_]", r.text)} - after.keys() == set()
    before, after = ({r.doc_id: r for r in x.collect()} for x in by["simhash_near_dedup"])
    fp = {i: plain_fingerprint(r.text, 5) for i, r in before.items()}
    for i in before.keys() - after.keys():  # what goes has a neighbour; what stays has none of smaller id that stays
        assert any((fp[i] ^ fp[j]).bit_count() <= 3 for j in before if j != i)
    kept = sorted(after)
    assert all((fp[a] ^ fp[b]).bit_count() > 3 for k, a in enumerate(kept) for b in kept[:k])
    before, after = ({r.doc_id: r for r in x.collect()} for x in by["secret_scan"])
    assert before.keys() == after.keys()
    assert all(r.n_chars == (before[i].n_chars if r.text == before[i].text else len(r.text)) for i, r in after.items())
    before, after = (x.collect() for x in by["source_mixing"])
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    sizes = {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    want = plain_targets(sizes)
    for s in sizes:
        got = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in after if r.source == s)
        assert abs(got - want[s]) <= 2 * max(len(r.text.split()) for r in before)
    last = by["bpe"][1]
    assert sorted(last.collect()) == sorted(bpe.digests(by["source_mixing"][1], __import__("public_tokenizers").path("word_bpe_49k.json")).collect())
    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted(run.collect()) == sorted(last.collect())


def test_awkward_rows(spark, sf_dir):
    for rows in (AWKWARD, [], AWKWARD[:1]):
        d = docs(spark, rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, sf_dir)
            assert out.columns == d.columns, name
            out.collect()
            d2 = spark.createDataFrame(out.collect(), out.schema)
            d = d2
        assert corpus_pipeline.STAGES[-1][1](spark, d, sf_dir).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_one_id_with_two_texts(spark, sf_dir):
    """No stage loses a document because another one has its id; copies of it still go."""
    a, b = (" ".join(f"{w}{k}" for k in range(60)) for w in ("the house ", "der Baum "))
    d = docs(spark, [(2, a, "en", "x"), (2, b, "de", "x"), (2, b, "de", "x"), (3, a, "en", "y")])
    out = corpus_pipeline.near_duplicates(spark, corpus_pipeline.language(spark, d, sf_dir), sf_dir)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted([(2, a), (2, b)])
    assert len(corpus_pipeline.secret_scan(spark, out, sf_dir).collect()) == 2
