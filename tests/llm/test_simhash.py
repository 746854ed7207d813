import re

import xxhash

from quillmill.llm import simhash
from tests.llm.helpers import AWKWARD, WORD, component_of, docs


def plain_fingerprint(text, width=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    s = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def check(rows, got, distance=3):
    fp = {i: plain_fingerprint(t) for i, t in rows if i is not None}
    ids = sorted(fp)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (fp[a] ^ fp[b]).bit_count() <= distance]
    comp = component_of(ids, links)
    for i, f, c in got:
        if i is not None:
            assert (f, c) == (f"{fp[i]:016x}", comp[i])


def test_whole_table(spark, sf_dir):
    got = simhash.op2_simhash(spark, sf_dir).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert len(got) == len(rows)
    check(rows, [tuple(r) for r in got])


def test_awkward_rows(spark):
    got = simhash.near_duplicates(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    check([(r[0], r[1]) for r in AWKWARD], [tuple(r) for r in got])
    # without an id, a row has its fingerprint's component, if that has one
    assert {r.component for r in got if r.id is None} == {1, None}


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


def test_blocks_are_exact():
    import itertools
    import random

    rng = random.Random(1)
    masks = simhash.block_masks(3)
    assert len(masks) == 20
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 3):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)
    assert all(bin(m).count("1") >= 31 for m in masks) and len(set(itertools.chain(masks))) == 20


def test_hot_key_is_split_and_whole(spark, monkeypatch):
    """Fingerprints that share 32 bits, more than a unit holds: a chain is found across chunks."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    import pyarrow as pa

    from quillmill.llm.common import block_units, components

    fps = [0]
    for k in range(200):  # a Gray code: each is one bit from the one before
        fps.append((k + 1) ^ ((k + 1) >> 1))
    df = spark.createDataFrame([(0, 0, f, i) for i, f in enumerate(fps)], "mask int, key bigint, fp bigint, rep bigint")
    units = block_units(df, ["mask", "key"], "fp", 16).sortWithinPartitions("mask", "key", "_i", "_j")
    names = ["mask", "key", "_i", "_j"]
    dealt = units.repartition(4, *names).sortWithinPartitions(*names)
    sizes = dealt.groupBy(*names).count().collect()
    assert len(sizes) > 10 and max(r["count"] for r in sizes) < 80
    links = dealt.mapInArrow(lambda it: simhash._linked(it, 1), "a bigint, b bigint")
    assert {tuple(r) for r in components(links).collect()} == {(f, 0) for f in fps}
    assert pa is not None


def test_rows_that_share_an_id_are_apart(spark):
    """One id with two texts: two classes, each with the other's links out of it; null ids link but name no class."""
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(2, a, None, None), (2, b, None, None), (5, b, None, None), (1, a, None, None), (None, "lone words", None, None), (None, b, None, None)]
    got = sorted(((r.id, r.component, r.fingerprint) for r in simhash.near_duplicates(docs(spark, rows)).collect()), key=str)
    fp = {t: f"{plain_fingerprint(t, 3):016x}" for t in (a, b, "lone words")}
    want = [(2, 1, fp[a]), (2, 2, fp[b]), (5, 2, fp[b]), (1, 1, fp[a]), (None, None, fp["lone words"]), (None, 2, fp[b])]
    assert got == sorted(want, key=str)


def test_representatives(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(2, a, "en", "x"), (2, b, "de", "x"), (5, b, "en", "y"), (5, b, "en", "y"), (None, a, None, None), (None, "lone words", None, None), (None, "lone words", None, None)]
    d = docs(spark, [*rows, (9, "once only", "en", "z"), (9, "once only", "en", "z"), (9, "once only", "en", "z2")])
    out = simhash.representatives(d)
    assert out.columns == d.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(2, a), (2, b), (None, "lone words"), (9, "once only")], key=str)
    assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in d.collect()}
    assert simhash.representatives(docs(spark, [])).collect() == []
