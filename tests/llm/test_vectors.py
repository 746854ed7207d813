import duckdb
import numpy as np
import pytest

from quillmill.llm import bitcodes, multiindex, sql
from tests.llm.helpers import component_of

ROWS = "vec_id bigint, embedding array<float>, label int, cell string, rep int, n string, dim int, rank int, score string, q int"
NAN, INF = float("nan"), float("inf")
ODD = [
    (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [1.0, NAN], 0), (6, [1.0, INF], 0),
    (7, [1.0, 0.0], None), (8, [1.0, 0.0], 0), (8, [1.0, 0.0], 0), (9, [2.0, 0.0], 0), (10, [1.0, 0.001], 0),
    (11, [-1.0, 0.0], 0), (12, [1.0, 0.0], 1), (13, [1.0, 0.0, 0.0], 0), (14, [5.0], 0), (15, [3.0], 0),
    (None, [1.0, 0.0], 0), (20, [0.5, 0.5], None), (40, [1.0, 0.0], None), (60, None, 0),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", 1, "y", 2, 3, "z", 4) for i, v, l in rows], ROWS)


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def plain_links(rows, threshold=0.98):
    n = [0] * len(rows)
    links = []
    for a in range(len(rows)):
        for b in range(a):
            (i, x, k), (j, y, m) = rows[a], rows[b]
            if None in (i, j, k) or k != m or not (good(x) and good(y)) or len(x) != len(y):
                continue
            x, y = np.float32(x).astype(float), np.float32(y).astype(float)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                n[a] += 1
                n[b] += 1
                links.append((i, j))
    comp = component_of({r[0] for r in rows if r[0] is not None}, links)
    return sorted(((r[0], n[a], comp.get(r[0]), r[0] is not None and comp[r[0]] == r[0]) for a, r in enumerate(rows)), key=str)


def test_links_of_odd_rows(spark):
    got = multiindex.near_duplicates(frame(spark, ODD))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_links(ODD)
    assert multiindex.near_duplicates(frame(spark, [])).collect() == []
    assert len(multiindex.near_duplicates(frame(spark, ODD[:6])).collect()) == 6


@pytest.mark.parametrize("block", [16, 2048])
def test_links_of_crowds(spark, monkeypatch, block):
    """A hot group of near copies, larger than a unit, and a label with a third of all rows."""
    monkeypatch.setattr(multiindex, "BLOCK", block)
    rng = np.random.default_rng(block)
    center = rng.standard_normal(8)
    rows = [(i, (center + rng.standard_normal(8) * 0.09).tolist(), 0) for i in range(150)]
    rows += [(1000 + i, rng.standard_normal(8).tolist(), i % 3) for i in range(250)]
    rows += [(2000 + i, rows[0][1], 0) for i in range(40)]
    rows += [(3000 + i, rows[150 + i][1], 1) for i in range(40)]
    got = multiindex.near_duplicates(frame(spark, rows)).collect()
    want = plain_links(rows)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert max(r[1] for r in want) > 100


def same(spark, sf_dir, query, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    rel = con.sql(sql.ORACLES[name])
    got = query(spark, sf_dir)
    want = sorted(con.execute(f"select {', '.join(got.columns)} from rel").fetchall() if False else rel.project(", ".join(got.columns)).fetchall())
    assert sorted(tuple(r) for r in got.collect()) == want
    assert want


def test_links_of_whole_table(spark, sf_dir):
    same(spark, sf_dir, multiindex.op3_multi_index, "op3_multi_index")


def test_search_of_whole_table(spark, sf_dir):
    same(spark, sf_dir, bitcodes.op9_bit_codes, "op9_bit_codes")


def plain_search(rows, k, every):
    out = []
    live = [(i, np.float32(v).astype(float)) for i, v, _ in rows if i is not None and good(v)]
    for i, q in {i: q for i, q in live if i % every == 0}.items():
        near = sorted((-float(sum(a * b for a, b in zip(q, x, strict=True))), j) for j, x in live if j != i and len(x) == len(q))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near)]
    return sorted(out)


def test_search_of_odd_rows(spark):
    from pyspark.sql import functions as F

    got = bitcodes.search(frame(spark, ODD), F.col("vec_id") % 20 == 0, k=3)
    assert sorted(tuple(r) for r in got.collect()) == plain_search(ODD, 3, 20)
    assert bitcodes.search(frame(spark, []), F.col("vec_id") % 20 == 0).collect() == []


def test_search_over_many_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(bitcodes, "CANDIDATES", 64)
    monkeypatch.setattr(bitcodes, "FINEST", 32)
    monkeypatch.setattr(bitcodes, "QUERIES", 8)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(70) * rng.uniform(0.1, 9)).tolist(), 0) for i in range(400)]
    rows += [(500 + i, rows[3][1], 0) for i in range(30)]  # ties
    got = bitcodes.search(frame(spark, rows), F.col("vec_id") % 5 == 0, k=20).collect()
    want = plain_search(rows, 20, 5)
    assert [tuple(r)[:3] for r in sorted(got)] == [r[:3] for r in want]
    assert np.allclose([r.score for r in sorted(got)], [r[3] for r in want])


def test_error_bounds_hold():
    rng = np.random.default_rng(5)
    for dim in (64, 70):
        x, q = rng.standard_normal((2000, dim)) * rng.uniform(0.2, 5, (2000, 1)), rng.standard_normal((50, dim))
        codes, bits = bitcodes.encode(x), bitcodes.SPREAD * dim
        turned = np.ascontiguousarray(codes.bits.T)
        ones = np.bitwise_count(turned).sum(axis=0)
        exact = q @ x.T
        for row, one in zip(exact, bitcodes.queries_of(q), strict=True):
            est, err = bitcodes.estimate(codes, turned, ones, one, bits)
            assert np.mean(np.abs(est - row) <= err) > 0.995 and np.abs(est - row).mean() < np.abs(row).mean() / 4
            rough = bitcodes.agreement(codes, turned, one, bits)
            assert np.corrcoef(rough, row)[0, 1] > 0.9


def test_few_candidates_are_left_to_rerank():
    """On isotropic vectors, the worst case for codes: under 5% of 2,000 candidates reach the threshold's bound."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes, bits = bitcodes.encode(x), bitcodes.SPREAD * 64
    turned = np.ascontiguousarray(codes.bits.T)
    ones, left = np.bitwise_count(turned).sum(axis=0), []
    for row, q in zip(x[:100] @ x.T, bitcodes.queries_of(x[:100]), strict=True):
        est, err = bitcodes.estimate(codes, turned, ones, q, bits)
        left.append(np.mean(est + err >= np.sort(row)[-21]))
    assert np.mean(left) < 0.05


def test_traversal_is_in_order():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 10))
    x /= np.linalg.norm(x, axis=1)[:, None]
    books = multiindex.fit_codebooks(x, 5000, 0.98, 0.99)
    assert 1 <= books.visits <= len(books.first) * len(books.second)
    for n in (1, 3, 7, 20):
        books.visits = n
        a, b = multiindex._square(x[:, :5], books.first), multiindex._square(x[:, 5:], books.second)
        total = np.sort((a[:, :, None] + b[:, None, :]).reshape(len(x), -1), axis=1)[:, :n]
        cells = multiindex.visit(x, books)
        r = np.arange(len(x))[:, None]
        assert np.allclose(a[r, cells // len(books.second)] + b[r, cells % len(books.second)], total)


def test_recall_reaches_the_target():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    books = multiindex.fit_codebooks(x, 50_000, 0.98, 0.99)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(1)[:, None] * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1)[:, None]
    u, v = multiindex.visit(x, books), multiindex.visit(y, books)
    met = np.where(u[:, 0] <= v[:, 0], (u == v[:, :1]).any(1), (v == u[:, :1]).any(1))
    assert met.mean() > 0.98 and books.visits < 80
    assert np.array_equal(multiindex._cell(x, books), u[:, 0])
    a, b = (multiindex.pack(z @ multiindex.rotation(64, 1).T >= 0)[:, 0] for z in (x, y))
    assert (np.bitwise_count(a ^ b) <= multiindex.far_bits(0.98)).all() and multiindex.far_bits(0.98) < 20


def test_the_grid_grows_with_the_rows():
    assert [multiindex.centroids(n) for n in (10, 50_000, 10**6, 10**8, 10**9)] == [4, 20, 88, 884, 2795]


def test_size_of_components_does_not_matter(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [1e-200, 1e-200]), (4, [2e-200, 2e-200]), (5, [1e200, 1e200]), (6, [1e300, 0.0]), (7, [5e-324, 0.0]), (8, [1.0, -1.0]), (9, [1e-310, 1e-310])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<double>, label int")
    got = {r.id: (r.n_links, r.component) for r in multiindex.near_duplicates(df).collect()}
    assert got == {1: (2, 1), 6: (2, 1), 7: (2, 1), 2: (4, 2), 3: (4, 2), 4: (4, 2), 5: (4, 2), 9: (4, 2), 8: (0, 8)}
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    assert {r[0]: (r[1], r[2]) for r in con.execute(sql.ORACLES["op3_multi_index"]).fetchall()} == got
