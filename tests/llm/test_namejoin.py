import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import namejoin
from quillmill.llm.namejoin import layout, misspelt, name_matches, near_names, op13_name_join, osa


def plain_osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def edited(rng, name, times, letters):
    x = list(name)
    for _ in range(times):
        k = rng.randrange(len(x) + 1)
        what = rng.randrange(4)
        if what == 0:
            x.insert(k, rng.choice(letters))
        elif what == 1 and k < len(x):
            del x[k]
        elif what == 2 and k < len(x):
            x[k] = rng.choice(letters)
        elif k + 1 < len(x):
            x[k], x[k + 1] = x[k + 1], x[k]
    return "".join(x)


def names(seed, letters, sizes, count):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.choice(sizes))) for _ in range(count)]
    return base, [edited(rng, rng.choice(base), rng.randrange(4), letters) for _ in range(count)]


def frame(spark, values):
    return spark.createDataFrame([(k, v, "x", 1) for k, v in enumerate(values)], "other bigint, name string, key string, i int")


def test_layout():
    for edits in (1, 2, 3):
        n = 2 * edits + 1
        for length in range(200):
            got = layout(length, edits)
            assert len(got) == (n if length >= 2 * n else 0)
            for (a, p), (b, _) in zip(got, got[1:], strict=False):
                assert a + p == b
            assert not got or got[-1][0] + got[-1][1] <= length


def test_osa_equals_the_table():
    one, two = names(3, "ab", range(0, 9), 300)
    pairs = [(a, b) for a, b in zip(one + two, two[::-1] + two, strict=True) if abs(len(a) - len(b)) <= 2]
    rows = lambda k: namejoin._codes([p[k] for p in pairs], 12)
    size = lambda k: np.array([len(p[k]) for p in pairs])
    got = osa(rows(0), size(0), rows(1), size(1), 2)
    assert got.tolist() == [min(plain_osa(a, b), 3) for a, b in pairs] and {0, 1, 2, 3} == set(got.tolist())


@pytest.mark.parametrize("letters,sizes,edits", [("abcdefgh", range(1, 30), 2), ("ab", range(1, 16), 2), ("aé日\U0001f469", range(8, 60), 1), ("abc ", range(60, 140), 3)])
def test_brute_force(spark, letters, sizes, edits):
    one, two = names(11, letters, sizes, 120)
    one += ["", None, "a", one[0]]
    got = near_names(frame(spark, one), frame(spark, two + [None, "", "a", "b", two[0]]), edits).collect()
    want = {(a, b, d) for a in set(one) - {"", None} for b in {*two, "a", "b"} - {""} if abs(len(a) - len(b)) <= edits and (d := plain_osa(a, b)) <= edits}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_large_groups_are_dealt_into_units(spark, monkeypatch):
    """Each pair of names still meets once where one chunk is common to all names."""
    monkeypatch.setattr(namejoin, "UNIT", 40)
    monkeypatch.setattr(namejoin, "COUNTED", 2)
    rng = random.Random(1)
    one = sorted({"company" + "".join(rng.choice("xyz") for _ in range(5)) for _ in range(200)})
    two = sorted({edited(rng, rng.choice(one), 2, "xyz") for _ in range(200)})
    got = near_names(frame(spark, one), frame(spark, two)).collect()
    want = {(a, b, d) for a in one for b in two if (d := plain_osa(a, b)) <= 2}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_very_long_names(spark):
    a = "".join(random.Random(2).choice("abcdef") for _ in range(20_000)) + "ab"
    two = [a[:-2] + a[-1] + a[-2], a[:9000] + "zz" + a[9000:], a[:9000] + "zzz" + a[9000:], "q" + a[1:-1], "short name here"]
    got = near_names(frame(spark, [a, "short name hree"]), frame(spark, two)).collect()
    assert sorted((two.index(r["probing"]), r["distance"]) for r in got) == [(0, 1), (1, 2), (3, 2), (4, 1)]


def brute(clients, vendors):
    out = defaultdict(lambda: [0, None, 0])
    for vid, n in {v for v in vendors if v[1]}:
        for cid, m in clients:
            if m and abs(len(m) - len(n)) <= 2 and (d := plain_osa(n, m)) <= 2:
                x = out[vid, d]
                x[0] += 1
                if cid is not None:
                    x[1] = cid if x[1] is None else min(x[1], cid)
                    x[2] += zlib.crc32(str(cid).encode())
    return {(*k, *x) for k, x in out.items()}


def swapped(vid, name):
    h = zlib.crc32(str(vid).encode()) if vid is not None else 1
    if not name or h % 2 or len(name) < 2:
        return name
    k = h % (len(name) - 1)
    return name[:k] + name[k + 1] + name[k] + name[k + 2 :]


def test_nulls_ties_repeats(spark):
    clients = [(1, "Anna Berg"), (1, "Anna Berg"), (2, "Anna Berg"), (None, "Anna Berg"), (3, None), (4, ""), (5, " "), (6, "Ana Berg"), (7, "Anna Bergström")]
    vendors = [(1, "Anna Berg"), (1, "Anna Berg"), (1, "Ana Berg"), (2, None), (3, ""), (4, "x"), (None, "Anna Bregström"), (9, "Anna Berg")]
    c = spark.createDataFrame([(*r, "e") for r in clients], "client_id bigint, name string, indexed string")
    v = spark.createDataFrame([(*r, "e") for r in vendors], "vendor_id bigint, name string, probing string")
    assert {tuple(r) for r in name_matches(c, v).collect()} == brute(clients, vendors)
    assert name_matches(c.filter("false"), v).collect() == [] and name_matches(c, v.filter("false")).collect() == []
    got = {(r[0], r[1]): r[2] for r in v.select("vendor_id", "name", misspelt(F.col("name"), F.col("vendor_id"))).collect()}
    assert got == {(i, n): swapped(i, n) for i, n in vendors}


def test_query(spark, sf_dir):
    rows = lambda t, k: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(k, "name").collect()]
    vendors = [(i, swapped(i, n)) for i, n in rows("vendors", "vendor_id")]
    assert {tuple(r) for r in op13_name_join(spark, sf_dir).collect()} == brute(rows("clients", "client_id"), vendors)
