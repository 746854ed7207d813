"""Pairs by shared keys, when one key is in most rows."""

import math
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.operators import relational as R
from quillmill.operators import similarity as S


def _shared(rows, least):
    of = {}
    for i, k in rows:
        if i is not None and k is not None:
            of.setdefault(i, set()).add(k)
    got = {(a, b): len(of[a] & of[b]) for a, b in combinations(sorted(of), 2)}
    return {p: n for p, n in got.items() if n >= least}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.none() | st.integers(0, 30), st.none() | st.sampled_from("aaaabcd")), max_size=60), st.sampled_from([1, 3, 2048]))
def test_meeting_is_every_pair_once(spark, rows, chunk):
    df = spark.createDataFrame(rows, "i bigint, k string").distinct()
    got = [(r.a, r.b, r.k) for r in R.meeting(df, "i", "k", chunk).select(F.col("x.i").alias("a"), F.col("y.i").alias("b"), F.col("x.k").alias("k")).collect()]
    known = {r for r in rows if None not in r}
    want = {(a, b, k) for a, k in known for b, other in known if a < b and k == other}
    assert len(got) == len(set(got)) and set(got) == want


def test_units_of_a_hot_key_are_bounded(spark):
    """3,000 rows of one key in chunks of 64: no unit joins more than about 64 rows of a side."""
    df = spark.range(3000).select(F.col("id").alias("i"), F.lit("hot").alias("k"))
    pairs = R.meeting(df, "i", "k", 64)
    assert pairs.count() == 3000 * 2999 // 2
    k = math.ceil(3000 / 64)
    most = df.groupBy(F.pmod(F.xxhash64("i"), F.lit(k))).count().agg(F.max("count")).first()[0]
    assert most <= 2 * 64


@pytest.mark.parametrize("least", [1, 2])
def test_shared_key_pairs_repeats_and_nulls(spark, least):
    rows = [(i, k) for i in range(40) for k in ("all", f"g{i % 7}", f"h{i % 5}")] + [(1, "all"), (None, "all"), (2, None)]
    got = {(r.a, r.b): r.shared for r in R.shared_key_pairs(spark.createDataFrame(rows, "i bigint, k string"), "i", "k", least).collect()}
    assert got == _shared(rows, least)


@pytest.mark.parametrize("tau", [0.0, 0.3])
def test_cosine_with_a_term_in_every_book(spark, tau):
    vec = {f"b{i:02d}": {"all": 1.0 + i % 3, f"g{i % 4}": 2.0, f"h{i % 6}": 1.5, f"own{i}": 1.0} for i in range(24)}
    vec["zero"] = {"all": 0.0, "g0": 0.0}
    norm = {d: math.sqrt(sum(x * x for x in v.values())) for d, v in vec.items()}
    rows = [(d, t, k, w, norm[d]) for d, v in vec.items() for k, (t, w) in enumerate(v.items())]
    got = {(r.a, r.b): (round(r.sim, 9), r.reasons) for r in S.cosine_pairs(spark.createDataFrame(rows, "doc string, term string, rank int, wt double, norm double"), tau=tau, reasons=2).collect()}
    want = {}
    for a, b in combinations(sorted(vec), 2):
        both = vec[a].keys() & vec[b].keys()
        n = norm[a] * norm[b]
        sim = sum(vec[a][t] * vec[b][t] for t in both) / n if n else 0.0
        if len(both) >= 2 and sim + 1e-9 >= tau:
            rank = {t: k for k, t in enumerate(vec[a])}
            best = sorted(both, key=lambda t: (-round(vec[a][t] + vec[b][t], 6), rank[t], t))[:2]
            want[a, b] = (round(sim, 9), best)
    assert got == want and got


def test_no_rows(spark):
    none = spark.createDataFrame([], "i bigint, k string")
    assert R.meeting(none, "i", "k").count() == 0 and R.shared_key_pairs(none, "i", "k").count() == 0


def test_tasks_follow_the_pairs(spark, monkeypatch):
    """300 rows of one key are few bytes, but 44,850 pairs; they meet and are counted by several tasks."""
    monkeypatch.setattr(R, "TASK_PAIRS", 1000)
    df = spark.range(300).select(F.col("id").alias("i"), F.lit("hot").alias("k"))
    for got in (R.meeting(df, "i", "k", 32), R.shared_key_pairs(df, "i", "k")):
        assert got.count() == 300 * 299 // 2 and got.rdd.getNumPartitions() >= 44


def test_part_edges_are_made_once(spark, sf_dir):
    """Queries that read the edges several times read a table, not the join that makes them."""
    from quillmill.plans.graphs import part_edges
    from quillmill.tables import Tables

    e = part_edges(Tables(spark, sf_dir))
    assert e.count() > 0 and "Join" not in e._jdf.queryExecution().optimizedPlan().toString()


def test_delta_pairs_of_a_hot_key(spark, monkeypatch):
    """New rows that are among all, and one that is not; a key of all rows is dealt over tasks."""
    monkeypatch.setattr(S, "TASK_PAIRS", 50)
    every = [(i, k) for i in range(30) for k in ("all", f"g{i % 4}")] + [(3, None)]
    new = [(i, k) for i, k in every if i in (2, 6, 9)] + [(99, "all"), (99, "g1"), (0, "g3")]
    frame = lambda x: spark.createDataFrame(x, "i bigint, k string")
    df = S.delta_pairs(frame(new), frame(every), spark.createDataFrame([(2, 6)], "a bigint, b bigint"))
    met = {(min(i, j), max(i, j), k) for i, k in new for j, other in every if k == other and i != j}
    want = {}
    for a, b, _ in met:
        want[a, b] = want.get((a, b), 0) + 1
    want.pop((2, 6))
    got = df.collect()
    assert {(r.a, r.b): r.shared for r in got} == want and len(got) == len(want)


def test_posterior_joins_no_nodes(spark):
    """Books meet clusters' terms, not each other."""
    from quillmill.operators.graph import posterior

    books = spark.createDataFrame([("p", "x"), ("q", "y"), ("r", "y"), ("s", "")], "node string, cluster string")
    rows = [(n, t, k) for n in "pqrs" for k, t in enumerate("abcd", 1)]
    got = posterior(books, spark.createDataFrame(rows, "node string, term string, rank int"))
    assert {r.node: r.cluster for r in got.collect()} == {"p": "y", "q": "y", "r": "y", "s": "x"}
    assert "NOT (node" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("near", [None, 2])
def test_shared_key_pairs_of_hot_keys_and_items(spark, monkeypatch, near):
    """Keys of several lists, items of too many pairs for a task, repeated rows and a condition on what items carry."""
    monkeypatch.setattr(R, "TASK_PAIRS", 40)
    monkeypatch.setattr(R, "CHUNK", 8)
    monkeypatch.setattr(R, "TASK_ROWS", 50)
    rows = [(i, k) for i in range(60) for k in ("all", f"g{i % 7}", f"h{i % 5}", f"j{i % 2}")] * 2 + [(None, "all"), (2, None)]
    where = None if near is None else lambda x, y: F.abs(x["n"] - y["n"]) <= near
    df = spark.createDataFrame(rows, "i bigint, k string").withColumn("n", F.col("i") % 10)
    got = [((r.a, r.b), r.shared) for r in R.shared_key_pairs(df, "i", "k", 2, where, ["n"]).collect()]
    want = {p: n for p, n in _shared(rows, 2).items() if near is None or abs(p[0] % 10 - p[1] % 10) <= near}
    assert dict(got) == want and len(got) == len(want)


def test_rows_are_told_apart_by_bounded_tasks(spark, tmp_path, monkeypatch):
    """No aggregation lies before the first exchange, where it would hold all rows of a file: tasks follow the rows."""
    monkeypatch.setattr(R, "TASK_ROWS", 100)
    plans, made = [], R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, tag: plans.append((tag, df)) or made(df, tag))
    R.shared_key_pairs(spark.range(1000).selectExpr("id % 100 as i", "id % 37 as k"), "i", "k").count()
    met = next(df for tag, df in plans if tag == "met")
    plan = met._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan[plan.index("Exchange") :] and met.rdd.getNumPartitions() >= 10
