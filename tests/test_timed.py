"""Keyed state with timers: flushes in time, state that is forgotten, caches that expire."""

import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmill.streaming.timed import PROVIDER, cached, flushed
from quillmill.tables import Tables


@pytest.fixture(autouse=True)
def _provider(spark):
    yield
    spark.conf.unset(PROVIDER)


class Sink:
    """The last row of each key, and how often it came."""

    def __init__(self, stream, checkpoint, **trigger):
        self.last, self.seen = {}, []

        def write(batch, epoch):
            for r in batch.collect():
                self.last[r[0]] = tuple(r)[1:]
                self.seen.append(tuple(r))

        self.query = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", str(checkpoint)).trigger(**trigger).start()

    def until(self, true, seconds=90):
        end = time.time() + seconds
        while not true() and time.time() < end:
            if self.query.exception():
                raise self.query.exception()
            time.sleep(0.2)
        return true()


def test_flushed_stream_is_the_batch_twin(spark, sf_dir, tmp_path):
    """SM1's texts, from deltas that come unordered and in parts."""
    t = Tables(spark, sf_dir)
    rows = t.conversations.select(F.col("conv_id").alias("stream_key"), F.col("turn").cast("long").alias("seq"), F.col("text").alias("delta")).filter("stream_key < 40")
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r.stream_key, r.seq is not None, r.seq or 0, r.delta or "")):
        n, text = want.get(r.stream_key, (0, ""))
        want[r.stream_key] = (n + 1, text + (r.delta or ""))
    rows.orderBy(F.xxhash64("seq", "delta")).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = flushed(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), flush=300)
    sink = Sink(stream, tmp_path / "c", processingTime="100 milliseconds")
    try:
        assert sink.until(lambda: sink.last == want), (len(sink.last), len(want))
        assert len(sink.seen) <= 3 * len(want)  # a flush holds all that came since the last, not one a delta
    finally:
        sink.query.stop()


def test_deltas_are_forgotten(spark, tmp_path):
    schema = "stream_key bigint, seq bigint, delta string"

    def add(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    add((1, 2, "b"), (1, 1, "a"), (1, None, None), (None, 1, "none"))
    sink = Sink(flushed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), flush=200, keep=8000), tmp_path / "c", processingTime="100 milliseconds")
    try:
        assert sink.until(lambda: sink.last == {1: (3, "ab"), None: (1, "none")}), sink.last
        time.sleep(8)
        add((1, 1, "again"))
        assert sink.until(lambda: sink.last[1] == (1, "again")), sink.last
    finally:
        sink.query.stop()
    with pytest.raises(ValueError):
        flushed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), flush=1000, keep=500)


def test_cached_stream_is_the_batch_twin(spark, sf_dir, tmp_path):
    """SM5's caches: entries of the last ten days, fifteen a user; events come in order of time, in four parts."""
    t = Tables(spark, sf_dir)
    e = t.events.select("user_id", "ts", "event_id")
    quarters = e.withColumn("p", F.ntile(4).over(Window.orderBy("ts")))
    for k in (1, 2, 3, 4):
        quarters.filter(f"p = {k}").drop("p").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)  # files are read in order of their times
    source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = Sink(cached(source, "user_id", "ts", "event_id", 10 * 86_400_000, 15), tmp_path / "c", availableNow=True)
    assert sink.query.awaitTermination(240) and sink.query.exception() is None
    rows = [r for r in e.collect() if None not in (r.user_id, r.ts, r.event_id)]
    top = max(r.ts for r in rows)
    want = {}
    for r in sorted(rows, key=lambda r: (r.ts, r.event_id), reverse=True):
        if (top - r.ts).total_seconds() < 10 * 86_400 and len(want.setdefault(r.user_id, [])) < 15:
            want[r.user_id].append(r.event_id)
    got = {k: v[0] for k, v in sink.last.items() if v[0]}
    assert got == {k: v for k, v in want.items() if v} and got
    assert any(not v[0] for v in sink.last.values()) or len(got) == len({r.user_id for r in rows})


def test_cache_capacity_ties_and_expiry(spark, tmp_path):
    schema = "k bigint, at timestamp_ntz, e bigint"
    hour = "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, {}, 0, 0)"
    parts = [
        [(1, 0, 1), (1, 0, 2), (1, 0, 2), (1, 0, 3), (2, 0, 9), (None, 0, 4), (2, 0, None)],
        [(3, 3, 7)],  # three hours on: what is of hour 0 goes
        [(1, 4, 8)],
    ]
    for p in parts:
        df = spark.createDataFrame(p, "k bigint, h int, e bigint")
        df.select("k", F.expr(hour.format("h")).alias("at"), "e").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = Sink(cached(source, "k", "at", "e", 2 * 3_600_000, 2), tmp_path / "c", availableNow=True)
    assert sink.query.awaitTermination(120) and sink.query.exception() is None
    assert (1, [3, 2]) in sink.seen and (2, [9]) in sink.seen and (2, []) in sink.seen
    assert sink.last == {1: ([8],), 2: ([],), 3: ([7],)}
