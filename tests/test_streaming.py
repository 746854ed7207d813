import pytest
from pyspark.sql import functions as F

from quillmill.operators import profile, relational, similarity
from quillmill.streaming import jobs
from quillmill.tables import Tables


@pytest.fixture()
def parts(spark, sf_dir, tmp_path):
    """Events in files by day, as a stream would bring them."""
    path = str(tmp_path / "events")
    e = Tables(spark, sf_dir).events
    e.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    return path, e


def test_windows(spark, parts, tmp_path):
    path, e = parts
    s = jobs.events_stream(spark, path, e.schema, files=10)
    got = jobs.run_to_end(jobs.windowed_counts(s, late="40 days"), "w1", "complete", str(tmp_path / "c"))
    assert sorted(map(tuple, got.select("start", "kind", "n").collect())) == sorted(map(tuple, jobs.windowed_counts(e).select("start", "kind", "n").collect()))


def test_sessions(spark, parts, tmp_path):
    path, e = parts
    s = jobs.events_stream(spark, path, e.schema, files=10)
    got = jobs.run_to_end(jobs.sessions(s, "6 hours", late="1 day"), "w2", "append", str(tmp_path / "c"))
    assert set(map(tuple, got.collect())) <= set(map(tuple, jobs.sessions(e, "6 hours").collect())) and got.count() > 0


def test_fold_of_a_stream_is_the_batch_fold(spark, parts, tmp_path):
    path, e = parts

    def archives(df):
        return df.filter("event_type = 'purchase'").select(
            F.col("user_id").alias("user"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("key"),
            F.floor("value").cast("long").alias("book"), F.array("event_type", "props").alias("terms"),
        )

    s = jobs.events_stream(spark, path, e.schema, files=10)
    q = jobs.upserting(jobs.folded(archives(s)), ["user"], str(tmp_path / "t"), str(tmp_path / "c"))
    q.awaitTermination()
    got = jobs.latest(spark, str(tmp_path / "t"))
    want = profile.fold_profiles(archives(e))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_assembled(spark, tmp_path):
    rows = [(k % 3, k, f"d{k} ") for k in range(30)]
    spark.createDataFrame(rows, "stream_key bigint, seq bigint, delta string").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("stream_key bigint, seq bigint, delta string").parquet(str(tmp_path / "in"))
    q = jobs.upserting(jobs.assembled(s), ["stream_key"], str(tmp_path / "t"), str(tmp_path / "c"))
    q.awaitTermination()
    got = {r["stream_key"]: r["text"] for r in jobs.latest(spark, str(tmp_path / "t")).collect()}
    assert got == {k: "".join(d for i, _, d in rows if i == k) for k in range(3)}


def test_growing_edges(spark, tmp_path):
    items = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "b")], "i bigint, k string")
    new = spark.createDataFrame([(4, "a"), (4, "b"), (5, "z")], "i bigint, k string")
    new.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("i bigint, k string").parquet(str(tmp_path / "in"))
    jobs.growing_edges(s, items, str(tmp_path / "g"), str(tmp_path / "c")).awaitTermination()
    got = {tuple(r) for r in jobs.latest(spark, str(tmp_path / "g/edges")).collect()}
    every = relational.shared_key_pairs(items.unionByName(new), "i", "k")
    assert got == {tuple(r) for r in every.filter("b >= 4").collect()} == {(1, 4, 2), (2, 4, 1), (3, 4, 1)}
    assert similarity.delta_pairs(new, items.unionByName(new), spark.createDataFrame([(1, 4)], "a bigint, b bigint")).count() == 2


def test_stale_generations_are_dropped(spark, tmp_path):
    """The stream, batch by batch, gives what its batch twin gives over all rows."""
    import random

    rng = random.Random(2)
    rows = [(rng.randrange(4), max(0, k // 20 - rng.randrange(3)), k) for k in range(200)]
    df = spark.createDataFrame(rows, "key long, generation long, at long")
    for k in range(4):
        df.filter(f"at div 50 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    newest, want = {}, set()
    for key, g, at in rows:
        newest[key] = max(newest.get(key, 0), g)
        if g >= newest[key]:
            want.add((key, g, at))
    from pyspark.sql import functions as F

    twin = jobs.current_only(df, "key", "generation", ["at"], F.expr("at div 30"))
    assert {tuple(r) for r in twin.collect()} == want and len(want) < len(rows)
    whole = jobs.guarded(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "key", "generation", ["at"])
    got = jobs.run_to_end(whole, "guarded", "append", f"{tmp_path}/cp")
    assert {tuple(r) for r in got.collect()} == want


def test_an_overtaken_writer_changes_nothing(spark, tmp_path):
    import pytest

    path, source = f"file://{tmp_path}/table", f"{tmp_path}/in"
    spark.range(5).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema("id long").parquet(source)
    one = jobs.claim(spark, path)
    jobs.fenced(stream(), one, path, f"{tmp_path}/cp1").awaitTermination()
    assert jobs.current(spark, path).count() == 5
    two = jobs.claim(spark, path)
    assert two > one and jobs.current(spark, path) is None
    jobs.fenced(stream(), two, path, f"{tmp_path}/cp2").awaitTermination()
    spark.range(5, 9).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="overtaken"):
        jobs.fenced(stream(), one, path, f"{tmp_path}/cp1").awaitTermination()
    assert sorted(r.id for r in jobs.current(spark, path).collect()) == [0, 1, 2, 3, 4]
    jobs.fenced(stream(), two, path, f"{tmp_path}/cp2").awaitTermination()
    assert sorted(r.id for r in jobs.current(spark, path).collect()) == [*range(9)]
