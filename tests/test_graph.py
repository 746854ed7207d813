import pytest

from quillmill.operators import graph, relational, similarity


def edges(spark, rows):
    return spark.createDataFrame([(a, b, float(s)) for a, b, s in rows], "a bigint, b bigint, sim double")


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node bigint")


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["cluster"], []).append(r["node"])
    return sorted(sorted(v) for v in out.values())


def test_components(spark):
    e = edges(spark, [(1, 2, 1), (2, 3, 1), (5, 4, 1), (7, 7, 1)] + [(100 + k, 101 + k, 1) for k in range(40)])
    assert groups(graph.clusters(nodes(spark, [1, 2, 3, 4, 5, 6, 7, *range(100, 141)]), e)) == [[1, 2, 3], [4, 5], [6], [7], [*range(100, 141)]]
    assert graph.components(e.limit(0)).collect() == []


def test_label_propagation(spark):
    star = edges(spark, [(1, 2, 1), (1, 3, 1), (1, 4, 1)])
    assert groups(graph.label_propagation(nodes(spark, [1, 2, 3, 4]), star)) == [[1, 2, 3, 4]]
    assert groups(graph.label_propagation(nodes(spark, [5, 6]), edges(spark, [(5, 6, 1)]))) == [[5, 6]]
    assert groups(graph.label_propagation(nodes(spark, [7, 8]), star.limit(0))) == [[7], [8]]


@pytest.mark.parametrize(("extra", "star", "want"), [(25, 1, 0.8), (26, 1, 0.8), (26, 2, 1.2)])
def test_bloat(spark, extra, star, want):
    """A star of four has one hub in four; two hubs in four ask for more, from 30 nodes on."""
    rows = [(1, 2, 1), (1, 3, 1), (1, 4, 1)] + ([(2, 3, 1), (2, 4, 1)] if star == 2 else [])
    every = nodes(spark, [1, 2, 3, 4, *range(100, 100 + extra)])
    e = edges(spark, rows)
    got = graph.bloat_factor(graph.clusters(every, e), e).first()
    assert got["factor"] == (1.0 if star == 1 and extra == 26 else want)


def test_split_and_fragments(spark):
    e = edges(spark, [(1, 2, 0.3), (3, 4, 0.3), (2, 3, 0.11), (4, 5, 0.13)])
    base = graph.clusters(nodes(spark, range(1, 6)), e)
    split = graph.split_bloated(base, e, 0.1, 0.8 * 3)
    assert groups(split) == [[1, 2], [3, 4], [5]]
    assert groups(graph.merge_fragments(split, base, e, 0.1)) == [[1, 2], [3, 4, 5]]


def test_posterior(spark):
    b = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y"), (5, "")], "node bigint, cluster string")
    f = [(1, "a b c"), (2, "a b c d"), (3, "a b c"), (4, "p q"), (5, "z w")]
    f = spark.createDataFrame([(n, t, k) for n, ts in f for k, t in enumerate(ts.split())], "node bigint, term string, rank int")
    assert {r["node"]: r["cluster"] for r in graph.posterior(b, f).collect()} == {1: "x", 2: "x", 3: "x", 4: "y", 5: "z"}


def test_merge_and_rename(spark):
    b = spark.createDataFrame([(1, "p"), (2, "q"), (3, "q"), (4, "r")], "node bigint, cluster string")
    f = spark.createDataFrame([(n, t) for n, ts in ((1, "abcde"), (2, "abcde"), (3, "x"), (4, "abc")) for t in ts], "node bigint, term string")
    assert {r.cluster: r.merged for r in graph.merge_clusters(b, f).collect()} == {"p": "q", "q": "q", "r": "r"}
    n = spark.createDataFrame([("p", "泛函", 3), ("p", "x", 9), ("q", "p", 1)], "cluster string, term string, n int")
    got = graph.rename_clusters(b.select("cluster").filter("cluster <> 'r'").distinct(), n, spark.createDataFrame([("泛函",)], "term string"))
    assert sorted(tuple(r) for r in got.collect()) == [("p", "泛函"), ("q", "p")]


def test_best_edges(spark):
    e = spark.createDataFrame([(1, 2, 10.0), (1, 3, 20.0), (2, 3, 15.0)], "a bigint, b bigint, strength double")
    assert {(r["a"], r["b"]) for r in similarity.best_edges(e).collect()} == {(1, 3), (2, 3)}


def test_orientation(spark):
    from pyspark.sql import functions as F

    rows = [(4, 8, False, None), (13, 15, True, 13), (13, 15, True, 15), (13, 15, True, 99)]
    df = spark.createDataFrame(rows, "a int, b int, d boolean, f int")
    got = [r[0] for r in df.select(graph.orientation(F.col("d"), F.col("f"), F.col("a"), F.col("b"))).collect()]
    assert got == ["a-b", "a->b", "b->a", "a-b"]


def test_stubs_and_feedback(spark):
    rows = [(1, 2, 85.0, None, 1), (3, 4, 95.0, "ignored", 2), (5, 6, 40.0, None, 3)]
    e = spark.createDataFrame(rows, "a bigint, b bigint, strength double, feedback string, at bigint")
    got = graph.link_stubs(e, "feedback", "ignored")
    assert sorted(map(tuple, got.collect())) == [(1, 2, 85.0), (2, 1, 85.0)]
    rng = __import__("random").Random(24)  # lists as they grow, one edge after the other
    many = [(0, rng.randrange(1, 12), rng.choice([55.04, 60.0, 70.0]), None, k) for k in range(40)]
    lists, dropped = {}, set()
    for a, b, s, _, _ in many:
        for x, y in ((a, b), (b, a)):
            mine = lists.setdefault(x, [])
            if (y, round(s, 1)) in mine or (x, y, round(s, 1)) in dropped:
                continue
            mine[:] = [z for z in mine if z[0] != y] + [(y, round(s, 1))]
            dropped -= {z for z in dropped if z[:2] == (x, y)}
            dropped |= {(x, *z) for z in mine[:-6]}
            mine[:] = mine[-6:]
    got = graph.link_stubs(spark.createDataFrame(many, e.schema), "feedback", "ignored", keep=6)
    assert sorted(map(tuple, got.collect())) == sorted((x, y, s) for x, mine in lists.items() for y, s in mine)
    from pyspark.sql import functions as F

    assert [r["a"] for r in e.filter(relational.not_marked(F.col("feedback"), "ignored")).collect()] == [1, 5]


def test_fingerprint_is_order_free(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    f = lambda d: graph.fingerprint(d, ["k", "v"]).first()["fingerprint"]
    assert f(df) == f(df.orderBy("k", ascending=False).repartition(3)) != f(df.distinct())


def test_similarity_is_symmetric_and_bounded(spark, sf_dir):
    from quillmill.plans.graphs import weighted_vectors
    from quillmill.tables import Tables

    got = similarity.cosine_pairs(weighted_vectors(Tables(spark, sf_dir)), tau=0.0).collect()
    assert got and all(0 <= r["sim"] <= 1 + 1e-9 and r["a"] < r["b"] and 1 <= len(r["reasons"]) <= 5 for r in got)


@pytest.mark.parametrize("name", ["GR7_components", "GR9_inner_similarity", "GR10_bloat", "GR13_cascade", "GR22_best_edges", "GR23_strongest_edge", "GR25_top_edges"])
def test_edges_of_all_nations(name):
    """Their graph has all suppliers that share parts, whatever their nations."""
    import __spark_entry__

    assert "s_nationkey // 5" not in __spark_entry__.oracle_sql()[name]


def test_whole_edges(spark, sf_dir):
    from quillmill.plans.graphs import part_edges, whole_edges
    from quillmill.tables import Tables

    t = Tables(spark, sf_dir)
    assert {tuple(r) for r in part_edges(t).collect()} < {tuple(r) for r in whole_edges(t).collect()}


def test_local_stars(spark, monkeypatch):
    """The same components in rows that grow with the nodes: a clique's edges are a star a task, whatever is held at once."""
    rows = [(a, b, 1) for g in (0, 1000) for a in range(g, g + 40) for b in range(a + 1, g + 40)] + [(-5, 7, 1), (2**62, 2**61, 1), (3, 3, 1)]
    e = edges(spark, rows).selectExpr("greatest(a, b) as v", "least(a, b) as m").filter("v <> m").repartition(3)
    assert e.count() == 1562 and graph.local_stars(e).count() <= 3 * 82
    want = {**{n: -5 for n in range(40)}, -5: -5, **{n: 1000 for n in range(1000, 1040)}, 2**61: 2**61, 2**62: 2**61}
    assert {r["node"]: r["component"] for r in graph.components(edges(spark, rows)).collect()} == want
    monkeypatch.setattr(graph, "LINKED_AT_ONCE", 3)
    monkeypatch.setattr(graph, "LINKED_NODES", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {r["node"]: r["component"] for r in graph.components(edges(spark, rows)).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edges_inside(spark):
    """Edges are not shuffled to meet few members; those with an end elsewhere, or that is no member, are left out."""
    member = graph.clusters(nodes(spark, [1, 2, 3, 4]), edges(spark, [(1, 2, 1), (3, 9, 1)]))
    e = edges(spark, [(1, 2, 0.5), (2, 1, 0.25), (1, 3, 1), (3, 9, 1), (8, 9, 1)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = graph.edges_inside(member, e)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["a"], r["b"], r["cluster"]) for r in got.collect()) == [(1, 2, 1), (2, 1, 1)]
        assert {(r["cluster"], r["n"], r["mean"]) for r in graph.inner_similarity(member, e).collect()} == {(1, 2, 0.75), (3, 1, 1.0), (4, 1, 1.0)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_similarity_of_a_cluster_without_shuffled_edges(spark):
    """Only sums of clusters are shuffled, not edges."""
    e = edges(spark, [(a, b, 0.5) for a in range(1, 6) for b in range(a + 1, 6)] + [(7, 8, 0.25)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = graph.inner_similarity(graph.clusters(nodes(spark, range(1, 10)), e), e)
        said = got._jdf.queryExecution().executedPlan().toString()
        assert said.count("BroadcastHashJoin") >= 2 and "hashpartitioning(a#" not in said and "hashpartitioning(b#" not in said
        assert {(r["cluster"], r["n"], r["mean"]) for r in got.collect()} == {(1, 5, 0.5), (6, 1, 1.0), (7, 2, 0.25), (9, 1, 1.0)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
