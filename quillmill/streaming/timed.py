"""Keyed state with timers: texts put together and flushed in time, and a cache whose entries expire.

Both run on ``transformWithState``, which asks for the RocksDB state store; it is set where the session names none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    """Sets the RocksDB state store unless the session has chosen one."""
    if not spark.conf.get(PROVIDER, "") or spark.conf.get(PROVIDER).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKS)


class _Assembler(StatefulProcessor):
    def __init__(self, flush: int, keep: int | None):
        self.flush, self.keep = flush, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "seq bigint, delta string", self.keep)
        self.due = handle.getValueState("due", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            seq, delta = pdf["seq"].tolist(), pdf["delta"].tolist()
            self.parts.appendList([(None if pd.isna(s) else int(s), None if pd.isna(d) else d) for s, d in zip(seq, delta, strict=True)])
        if not self.due.exists():  # the first delta since the last flush starts the clock
            at = timerValues.getCurrentProcessingTimeInMs() + self.flush
            self.handle.registerTimer(at)
            self.due.update((at,))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        parts = sorted(((s is not None, s or 0, d or "") for s, d in self.parts.get()))
        if parts:  # none: they expired before their timer
            yield pd.DataFrame({"stream_key": [key[0]], "n": [len(parts)], "text": ["".join(p[2] for p in parts)]})

    def close(self) -> None:
        pass


def flushed(deltas: DataFrame, flush: int = 1500, keep: int | None = None) -> DataFrame:
    """(stream_key, n, text) of deltas (stream_key: long, seq, delta): a key's whole text so far, ``flush`` ms after the first delta that
    it did not hold yet. Update mode, to be upserted by key.

    A key's deltas are list state: a batch appends its own and a flush reads them in order of (seq, delta), so late and
    unordered ones find their place. Null deltas count as empty, null sequence numbers come first, repeated deltas stay. Deltas are
    forgotten ``keep`` ms after they came, where that is given; it must be longer than ``flush``.
    """
    if keep is not None and keep <= flush:
        raise ValueError("deltas must be kept for longer than the time to a flush")
    state_store(deltas.sparkSession)
    return deltas.select("stream_key", "seq", "delta").groupBy("stream_key").transformWithStateInPandas(
        _Assembler(flush, keep), "stream_key bigint, n bigint, text string", "Update", "ProcessingTime"
    )


class _Cache(StatefulProcessor):
    def __init__(self, ttl: int, capacity: int):
        self.ttl, self.capacity = ttl, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at bigint, entry bigint")

    def _put(self, key, entries: list[tuple[int, int]]) -> pd.DataFrame:
        if entries:
            self.held.put(entries)
        else:
            self.held.clear()
        return pd.DataFrame({"key": [key[0]], "entries": [[e for _, e in entries]]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {tuple(x) for x in self.held.get()}
        old = set(held)
        for pdf in rows:  # cut by every part, so no more than a part and a full cache are held
            held |= set(zip(pdf["at"].astype("int64"), pdf["entry"].astype("int64"), strict=True))
            held = set(sorted(held, reverse=True)[: self.capacity])
        now = timerValues.getCurrentWatermarkInMs()
        live = sorted(((int(a), int(e)) for a, e in held if a + self.ttl > now), reverse=True)
        for at in {a for a, e in live if (a, e) not in old}:
            self.handle.registerTimer(at + self.ttl)
        yield self._put(key, live)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.held.get()]
        live = [(a, e) for a, e in held if a + self.ttl > expiredTimerInfo.getExpiryTimeInMs()]
        if len(live) < len(held):  # else: what the timer was for has been pushed out
            yield self._put(key, live)

    def close(self) -> None:
        pass


def cached(events: DataFrame, key: str, at: str, entry: str, ttl: int, capacity: int, late: str = "0 seconds") -> DataFrame:
    """(key, entries) whenever a key's cache changes: its newest ``capacity`` entries, newest first, of an age under ``ttl`` ms.

    Age is event time: an entry goes when the watermark reaches its time plus ``ttl``, by a timer of its key. State is at most
    ``capacity`` entries a key. Equal times go by the larger entry, repeated entries count once; rows with a null key, time or
    entry and events behind the watermark take no part. Update mode, to be upserted by key; no entries: the key is out.
    """
    state_store(events.sparkSession)
    named = events.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("ts"), F.col(entry).alias("entry")).dropna()
    timed = named.withWatermark("ts", late).select("key", "ts", F.unix_millis("ts").alias("at"), "entry")
    return timed.groupBy("key").transformWithStateInPandas(_Cache(ttl, capacity), "key bigint, entries array<bigint>", "Update", "EventTime")
