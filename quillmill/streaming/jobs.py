"""Streams: message assembly, incremental graph edges, index upkeep, profile folds, event-time windows.

Each has a batch twin that gives the same rows on the whole input; keyed state is bounded by key, and late events beyond
the watermark are dropped, which only the windowed aggregates and the fold ask for.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmill.operators.profile import FOLD_SCHEMA, Fold, fold_row
from quillmill.operators.relational import upsert
from quillmill.operators.similarity import delta_pairs


def events_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _marked(events: DataFrame, late: str) -> DataFrame:
    """Event time as an instant, with a watermark on streams."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return at.withWatermark("ts", late) if events.isStreaming else at


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(start, kind, n, total) per tumbling or sliding window."""
    marked = _marked(events, late)
    got = marked.groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("window.start").alias("start"), F.col("event_type").alias("kind"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user, start, end, n): runs of a user's events without a pause of ``gap``."""
    marked = _marked(events, late)
    got = marked.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("user_id").alias("user"), F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def assembled(deltas: DataFrame) -> DataFrame:
    """(stream_key, n, text): the deltas (stream_key, seq, delta) of each key put together in order.

    A stateful operator in update mode: a key's text so far goes out with each batch, to be upserted by key.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, text = state.get if state.exists else (0, "")
        got = pd.concat(list(batches)).sort_values("seq")
        n, text = n + len(got), text + "".join(got["delta"])
        state.update((n, text))
        yield pd.DataFrame({"stream_key": [key[0]], "n": [n], "text": [text]})

    return deltas.groupBy("stream_key").applyInPandasWithState(
        run, "stream_key bigint, n bigint, text string", "n bigint, text string", "update", GroupStateTimeout.NoTimeout
    )


def folded(events: DataFrame, fold: Fold | None = None) -> DataFrame:
    """The profile fold over a stream of archive events (user, at, key, book, terms); state is the profile itself."""
    fold = fold or Fold()

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else fold.empty()
        for r in pd.concat(list(batches)).sort_values(["at", "key"]).itertuples():
            s = fold.step(s, int(r.book), list(r.terms))
        state.update((json.dumps(s, ensure_ascii=False),))
        yield pd.DataFrame([fold_row(int(key[0]), s)], columns=[c.split()[0] for c in FOLD_SCHEMA.split(", ")])

    return events.groupBy("user").applyInPandasWithState(run, FOLD_SCHEMA, "state string", "update", GroupStateTimeout.NoTimeout)


def upserting(stream: DataFrame, key: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Keeps a Parquet table of the latest row of each key; a batch that is repeated changes nothing.

    Each batch writes a new version beside the old one and names it last, so readers never see half a table.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = latest(spark, path)
        new = batch if old is None else upsert(old, batch, key, [F.lit(0)])
        new.write.mode("overwrite").parquet(f"{path}/version={epoch:012d}")

    return stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest whole version of a table that ``upserting`` keeps."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    done = [str(s.getPath()) for s in fs.listStatus(p) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(str(s.getPath()) + "/_SUCCESS"))]
    return spark.read.parquet(max(done)) if done else None


# -- stale generations -------------------------------------------------------------------------------------------


def current_only(events: DataFrame, key: str, generation: str, order: list[str], bucket) -> DataFrame:
    """The events whose generation no earlier event of their key had overtaken, in ``order``; null generations are refused.

    ``bucket`` is a column that grows with the first of ``order``: the newest generation is carried from bucket to bucket, then
    followed inside each, so a key that has most events is not one task's.
    """
    e = events.withColumn("_bucket", bucket)
    w = W.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    per = e.groupBy(key, "_bucket").agg(F.max(generation).alias("_top"))
    before = F.max("_top").over(W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    per = per.select(F.col(key).alias("_key"), F.col("_bucket").alias("_b"), before.alias("_before"))
    got = e.withColumn("_inside", F.max(generation).over(w)).join(per, F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    return got.filter(F.col(generation) >= F.greatest("_inside", "_before")).select(*events.columns)


def guarded(events: DataFrame, key: str, generation: str, order: list[str]) -> DataFrame:
    """``current_only`` over a stream: a key's state is the newest generation seen; events of an older one are dropped."""
    names = events.columns

    def run(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(batches)).sort_values(order)
        newest = got[generation].cummax()
        if state.exists:
            newest = newest.clip(lower=state.get[0])
        if len(newest) and pd.notna(newest.max()):
            state.update((int(newest.max()),))
        yield got[got[generation] >= newest][names]

    return events.groupBy(key).applyInPandasWithState(run, events.schema, "newest bigint", "append", GroupStateTimeout.NoTimeout)


class StaleGenerationError(RuntimeError):
    """A writer found that a newer generation has taken over."""


def _listed(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def claim(spark: SparkSession, path: str) -> int:
    """Takes over a table of ``fenced``: the number of a new generation, newer than all before. Atomic, as a folder is made once."""
    g = max([int(x.partition("=")[2]) for x in _listed(spark, path) if x.startswith("generation=")], default=0)
    while True:
        g += 1
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/generation={g:09d}/claim")
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.createNewFile(p):
            return g


def fenced(stream: DataFrame, generation: int, path: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream's batches as one generation of a table. Once a newer one has been claimed, a batch is refused.

    Batches lie in their generation's folder, one folder a batch, so a repeated batch replaces itself, and readers follow the newest
    generation only: whatever an overtaken writer still writes, even between check and commit, is in no result.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        newest = max(int(x.partition("=")[2]) for x in _listed(spark, path) if x.startswith("generation="))
        if newest > generation:
            raise StaleGenerationError(f"generation {generation} of {path} was overtaken by {newest}")
        batch.write.mode("overwrite").parquet(f"{path}/generation={generation:09d}/epoch={epoch:012d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """What the newest generation of a ``fenced`` table has committed; None if nothing."""
    of = [x for x in _listed(spark, path) if x.startswith("generation=")]
    if not of:
        return None
    root = f"{path}/{of[-1]}"
    done = [f"{root}/{x}" for x in _listed(spark, root) if x.startswith("epoch=") and "_SUCCESS" in _listed(spark, f"{root}/{x}")]
    return spark.read.parquet(*done) if done else None


def growing_edges(stream: DataFrame, static: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Edges (a, b, shared) of new items (i, k) against all items so far, added batch by batch; old edges stay."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        known = latest(spark, f"{path}/items")
        every = (static if known is None else static.unionByName(known)).unionByName(batch)
        edges = latest(spark, f"{path}/edges")
        none = spark.createDataFrame([], "a bigint, b bigint")
        new = delta_pairs(batch, every, none if edges is None else edges.select("a", "b"))
        (new if edges is None else edges.unionByName(new)).write.mode("overwrite").parquet(f"{path}/edges/version={epoch:012d}")
        (batch if known is None else known.unionByName(batch)).write.mode("overwrite").parquet(f"{path}/items/version={epoch:012d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all its present input into a table in memory; for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


