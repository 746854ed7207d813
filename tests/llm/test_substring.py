import hashlib

import pytest

from quillmill.llm import substring
from tests.llm.helpers import AWKWARD, WORD, docs


def plain(rows, window=20):
    rows = sorted((((i is None, i or 0), i, t) for i, t in ((i, t or "") for i, t in rows)), key=lambda r: (r[0], r[2]))
    first = {}
    for key, _, t in rows:
        w = WORD.findall(t)
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), (key, p))
            first[tuple(w[p : p + window])] = min(first[tuple(w[p : p + window])], (key, p))
    out = []
    for key, i, t in rows:
        w = WORD.findall(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (key, p):
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), kept))
    return sorted(out, key=str)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in substring.op5_substring(spark, sf_dir).collect()), key=str)
    want = [(i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in plain(rows)]
    assert got == sorted(want, key=str)
    assert sum(r[2] for r in got) > 0


def test_awkward_rows(spark):
    p = " ".join(f"p{k}" for k in range(25))
    rows = [*AWKWARD, (20, f"x {p} y", None, None), (21, f"{p} {p}", None, None), (22, " ".join(p.split()[:19]), None, None), (23, p, None, None)]
    got = sorted((tuple(r) for r in substring.remove_repeats(docs(spark, rows), bucket_chars=100_000).collect()), key=str)
    assert got == plain([(r[0], r[1]) for r in rows])


@pytest.mark.parametrize("window", [1, 2, 4, 9, 20, 50])
def test_windows(spark, window):
    import random

    rng = random.Random(window)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 80))), None, None) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " z " + rows[i + 1][1], None, None) for i in range(20)]
    got = sorted((tuple(r) for r in substring.remove_repeats(docs(spark, rows), window=window).collect()), key=str)
    assert got == plain([(r[0], r[1]) for r in rows], window)


def test_covers():
    for period, cover in substring.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_empty_table(spark):
    assert substring.remove_repeats(docs(spark, [])).collect() == []


def test_large_ids_beside_null_ids(spark):
    """Ids beyond 2^53 stay exact in buckets that hold null ids too; the largest id is not the null one."""
    p = " ".join(f"p{k}" for k in range(25))
    rows = [(2**60 + k, f"{p} own{k}" if k % 3 == 0 else " ".join(f"w{k}x{j}" for j in range(30)), None, None) for k in range(40)]
    rows += [(None, f"null {k} {p}" if k % 5 == 0 else f"null {k}", None, None) for k in range(40)]
    rows += [(2**63 - 1, f"last {p}", None, None), (-(2**62), f"{p} first", None, None)]
    got = sorted((tuple(r) for r in substring.remove_repeats(docs(spark, rows), bucket_chars=1_000_000).collect()), key=str)
    assert got == plain([(r[0], r[1]) for r in rows])
    assert {r[0] for r in got} >= {2**60 + k for k in range(40)}


def test_checks_tell_windows_apart(spark):
    import pandas as pd

    rng = __import__("random").Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(400)) for _ in range(20)]
    b = substring.Bucket(pd.DataFrame({"id": range(20), "none": [False] * 20, "text": texts}))
    at = [int(k) for k in range(len(b.hash)) if b.left[k] >= 20]
    words = [tuple(w) for d in range(20) for w in (texts[d].split()[p : p + 20] for p in range(381))]
    c = b.checks(20, __import__("numpy").array(at))
    assert len({*zip(words, c.tolist(), strict=True)}) == len(set(words)) and len(set(c.tolist())) > 0.99 * len(set(words))
