"""Tables in buckets: batches rewrite what they touch, in any order, once."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import search as X
from quillmill.streaming.buckets import Buckets, indexed, keeping

SCHEMA = "id bigint, seq bigint, op string, text string"


def _order():
    return [F.desc("seq"), F.col("op"), F.col("text")]


def _table(spark, path, **more):
    return Buckets(spark, str(path), ["id"], SCHEMA, **({"buckets": 8} | more))


def _changes(n=120, seed=5):
    r = random.Random(seed)
    return [(r.randrange(20) if r.random() > 0.05 else None, k, r.choice("IUUD"), r.choice(["abcd", "bcde", "", None, "xyz" * r.randrange(1, 5)])) for k in range(n)]


def _latest(rows):
    best = {}
    for i, seq, op, text in rows:
        if i is not None and (i not in best or seq > best[i][0]):
            best[i] = (seq, op, text)
    return {(i, *v) for i, v in best.items()}


def _rows(table):
    return [tuple(r) for r in table.rows().collect()]


def _files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_batches_in_any_order_and_again(spark, tmp_path):
    rows = _changes()
    for name, order in (("a", rows), ("b", sorted(rows, key=lambda r: -r[1]))):
        t = _table(spark, tmp_path / name)
        batches = [order[k : k + 50] for k in range(0, len(order), 50)]
        for k, b in enumerate(batches):
            assert t.merge(k, spark.createDataFrame(b, SCHEMA), _order())
            before = _files(tmp_path / name)
            assert not t.merge(k, spark.createDataFrame(b, SCHEMA), _order())  # again: nothing is written
            assert _files(tmp_path / name) == before
        got = _rows(t)
        assert len(got) == len(set(got)) and set(got) == _latest(rows)


def test_a_small_batch_writes_one_bucket_and_old_versions_go(spark, tmp_path):
    t = _table(spark, tmp_path, keep=2)
    t.merge(0, spark.range(4000).select("id", F.lit(0).cast("long").alias("seq"), F.lit("I").alias("op"), F.lit("text").alias("text")), _order())
    first = _files(tmp_path)
    t.merge(1, spark.createDataFrame([(7, 1, "U", "new")], SCHEMA), _order())
    new = _files(tmp_path) - first
    assert {os.path.basename(os.path.dirname(f)) for f in new} == {f"_bucket={t.rows().filter('id = 7').select(t._bucket()).first()[0]}"}
    assert sum(map(os.path.getsize, new)) < sum(map(os.path.getsize, first)) / 4
    assert t.rows().count() == 4000 and t.rows().filter("id = 7").first().text == "new"
    for k in range(2, 6):  # the same bucket again and again: its folders of the versions before the last two are gone
        t.merge(k, spark.createDataFrame([(7, k, "U", f"new {k}")], SCHEMA), _order())
    assert sorted(x.name for x in (tmp_path / "data").iterdir()) == ["at=000000000000", "at=000000000004", "at=000000000005"]
    assert len(list((tmp_path / "manifest").glob("commit=*"))) == 2 and t.rows().count() == 4000


def test_a_commit_that_broke_off(spark, tmp_path):
    t = _table(spark, tmp_path)
    t.merge(0, spark.createDataFrame([(1, 0, "I", "a"), (2, 0, "I", "b")], SCHEMA), _order())

    def lost(number, where):
        raise OSError("driver lost")

    t._publish = lost
    with pytest.raises(OSError):
        t.merge(1, spark.createDataFrame([(1, 1, "U", "c")], SCHEMA), _order())
    t = _table(spark, tmp_path)
    assert set(_rows(t)) == {(1, 0, "I", "a"), (2, 0, "I", "b")}
    t.merge(1, spark.createDataFrame([(1, 1, "U", "c")], SCHEMA), _order())
    assert set(_rows(t)) == {(1, 1, "U", "c"), (2, 0, "I", "b")}


def test_nulls_and_nothing(spark, tmp_path):
    t = _table(spark, tmp_path)
    assert _rows(t) == []
    assert t.merge(0, spark.createDataFrame([], SCHEMA), _order()) and _rows(t) == []
    t.merge(1, spark.createDataFrame([(None, 1, "I", "x"), (3, None, None, None)], SCHEMA), _order())
    assert _rows(t) == [(3, None, None, None)]
    t.replace(2, spark.createDataFrame([(3,)], "id bigint"), spark.createDataFrame([], SCHEMA))
    assert _rows(t) == []


def test_index_follows_the_table(spark, tmp_path):
    rows = _changes(90, 8)
    table = _table(spark, tmp_path / "t")
    index = Buckets(spark, str(tmp_path / "i"), ["id"], "id bigint, gram string", 8)
    for k in range(0, 90, 30):
        indexed(table, index, k, spark.createDataFrame(rows[k : k + 30], SCHEMA), _order(), F.col("op") != "D", lambda now: X.trigram_index(now, "id", "text"))
    want = {(i, x[k : k + 3]) for i, _, op, x in _latest(rows) if op != "D" for k in range(len(x or "") - 2)}
    got = _rows(index)
    assert len(got) == len(set(got)) and set(got) == want and want


def test_stream_of_changes(spark, tmp_path):
    rows = _changes(60, 3)
    for k in range(3):
        spark.createDataFrame(rows[k::3], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t = _table(spark, tmp_path / "t")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = keeping(source, t, _order(), str(tmp_path / "c"))
    q.awaitTermination()
    assert q.exception() is None and set(_rows(t)) == _latest(rows) and len(t._commits()) == 2
