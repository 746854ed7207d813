import datetime as dt
import json

from pyspark.sql import functions as F

from quillmill.operators import positions, profile, relational, retrieval


def test_dedup_of_logs(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, 10, 100, t(1)), (2, 10, 100, t(2)), (3, 10, 100, t(3)), (4, 10, 101, t(1)), (5, 10, None, t(1)), (6, 10, None, t(2))]
    df = spark.createDataFrame(rows, "id int, book int, chapter int, at timestamp")
    got = relational.first_rows(df, ["book", "chapter"], [F.desc("at"), F.desc("id")])
    assert sorted(r["id"] for r in got.collect()) == [3, 4, 6]


def learn(spark, days, related, confirmed):
    s = spark.createDataFrame([(1, d) for d in days], "user int, days double")
    r = spark.createDataFrame([(1, float(x)) for x in related], "user int, score double")
    c = spark.createDataFrame([(1, float(x)) for x in confirmed], "user int, score double")
    return profile.learn_thresholds(s, r, c).first()


def test_thresholds(spark):
    assert learn(spark, [None, 0.5], [50, 50, 55, 60, 70, 80], [])["strength"] == 50.0
    assert learn(spark, [None], [58, 58, 60, 65, 70, 75], [62, 62, 70, 80])["strength"] == 58.0
    got = learn(spark, [None, 0.5, 0.5, 0.5, 0.5, 0.5], [], [55, 55, 80, 90])
    assert (got["review"], got["warm"], got["strength"]) == (1, 2, 55.0)
    assert learn(spark, [None, 0.5], [], [50, 50])["warm"] is None


def test_quantiles_are_floor_indexed(spark):
    df = spark.createDataFrame([(1, v) for v in (1, 2, 3, 4)], "k int, v int")
    assert relational.lower_quantile(df, ["k"], "v", 0.5).first()["quantile"] == 3
    assert relational.lower_quantile(df, ["k"], "v", 0.25).first()["quantile"] == 2


def test_relatedness(spark):
    def run(edge, warm, cold, same, threshold):
        score, related = profile.relatedness(F.lit(edge), F.lit(warm), F.lit(cold), F.lit(same), F.lit(threshold))
        r = spark.range(1).select(score.alias("s"), related.alias("r")).first()
        return r["s"], r["r"]

    assert run(None, None, None, False, 60.0) == (0.0, False)
    assert run(82.0, 0.0, 0.0, False, 60.0) == (82.0, True)
    assert run(50.0, 0.0, 0.0, False, 60.0) == (50.0, False) and run(50.0, 0.0, 0.0, False, 45.0) == (50.0, True)
    assert run(0.0, 0.0, 0.0, True, 60.0) == (60.0, True) and run(0.0, 1.0, 1.0, False, 60.0) == (100.0, True)


def test_fold():
    f = profile.Fold(threshold=3, recent=2)
    s = f.empty()
    for book, terms in ((1, ["a", "b"]), (2, ["a"]), (3, ["c"]), (4, ["a"])):
        s = f.step(s, book, terms)
    assert s["count"] == 4 and s["recent"] == [4] and s["themes"] == {"a": 3, "b": 1, "c": 1}
    assert s["prefs"] == {"a": 2 + 3, "b": 2, "c": 2} and s["interests"] == ["a", "b", "c"]


def test_fold_in_batch(spark):
    rows = [(1, dt.datetime(2024, 1, d), d, d, ["x", f"t{d}"]) for d in range(1, 6)] + [(2, dt.datetime(2024, 1, 1), 9, 7, ["y"])]
    df = spark.createDataFrame(rows, "user bigint, at timestamp, key bigint, book bigint, terms array<string>").repartition(4)
    got = {r["user"]: r for r in profile.fold_profiles(df).collect()}
    assert got[1]["count"] == 5 and json.loads(got[1]["themes"])["x"] == 5 and json.loads(got[2]["prefs"]) == {}


def test_numbered(spark):
    df = spark.range(1000).withColumn("v", (F.col("id") * 37) % 101)
    got = positions.numbered(df, ["v", "id"], "place").collect()
    assert [r["place"] for r in sorted(got, key=lambda r: (r["v"], r["id"]))] == [*range(1, 1001)]


def test_running_budget(spark):
    df = spark.createDataFrame([(1, k, n) for k, n in enumerate((9000, 10, 10))] + [(2, k, n) for k, n in enumerate((3000, 4000, 2000, 1))], "s int, id int, n int")
    got = relational.running_budget(df, ["s"], [F.col("id")], F.col("n"), 8000, 20)
    assert sorted((r["s"], r["id"]) for r in got.collect()) == [(1, 0), (2, 0), (2, 1)]


def test_hits_or_first(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 1, 2), ("b", 0, 0), ("b", 1, 0)], "g string, pos int, score int")
    got = sorted((r["g"], r["pos"]) for r in retrieval.hits_or_first(df, "g", "score", "pos", 5).collect())
    assert got == [("a", 1), ("b", 0), ("b", 1)]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert sorted(map(str, relational.upsert(old, new, ["k"], [F.lit(0)]).collect())) == ["Row(k=1, v='a')", "Row(k=2, v=None)", "Row(k=3, v='c')"]
    assert [r["k"] for r in relational.changed_only(old, new, ["k"], ["v"]).collect()] == [3]


def test_folder_tree_with_a_cycle(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 9), (9, 4)], "node int, parent int")
    assert {r["node"]: r["depth"] for r in relational.subtree(df, 1).collect()} == {1: 0, 2: 1, 3: 2}
    assert {r["node"] for r in relational.subtree(df, 4, depth=8).collect()} == {4, 9}
