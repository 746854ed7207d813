"""Keyed tables that batches of changes keep up to date, each batch rewriting only the buckets that it touches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmill.operators.relational import first_rows
from quillmill.storage import drop_path


class Buckets:
    """A table of ``schema`` in ``buckets`` buckets by the hash of its ``key``; a key may have many rows.

    A commit writes the touched buckets anew, in a folder of its own, and then a manifest that says in which folder each bucket
    lies; readers follow the newest manifest, so they never see half a batch. A commit has a number: one that is there
    already is left alone, so a repeated batch changes nothing, and one that broke off writes its folder again. Folders that
    none of the last ``keep`` manifests names are deleted. One writer at a time; put a fence before it where there may be two.

    Rows whose key holds a null are left out. Manifests name a folder a bucket, the only thing that reaches the driver.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], schema: str, buckets: int = 32, keep: int = 2):
        self.spark, self.path, self.key, self.schema, self.n, self.keep = spark, path.rstrip("/"), list(key), schema, buckets, keep

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[str]:
        p, fs = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _commits(self) -> list[int]:
        return [int(x.partition("=")[2]) for x in self._listed(f"{self.path}/manifest") if x.startswith("commit=")]

    def _manifest(self, commit: int) -> dict[int, int]:
        p, fs = self._fs(f"{self.path}/manifest/commit={commit:012d}")
        got = fs.open(p)
        try:
            return {int(b): at for b, at in json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(got, "UTF-8")).items()}
        finally:
            got.close()

    def _publish(self, commit: int, where: dict[int, int]) -> None:
        """Writes a manifest beside its place and renames it there, so it is whole or not there."""
        draft, fs = self._fs(f"{self.path}/manifest/draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(json.dumps(where).encode())
        out.close()
        if not fs.rename(draft, self._fs(f"{self.path}/manifest/commit={commit:012d}")[0]):
            raise FileExistsError(f"commit {commit} of {self.path} was written by another writer")

    def _folder(self, at: int) -> str:
        return f"{self.path}/data/at={at:012d}"

    def _read(self, where: dict[int, int]) -> DataFrame:
        if not where:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self._folder(at)}/_bucket={b}" for b, at in sorted(where.items())])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.n)).cast("int")

    def _known(self, df: DataFrame) -> DataFrame:
        return df.dropna(subset=self.key)

    def rows(self) -> DataFrame:
        """The table as of the newest commit; no rows before the first."""
        done = self._commits()
        return self._read(self._manifest(done[-1]) if done else {})

    def commit(self, number: int, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> bool:
        """Puts ``change(rows of the touched buckets)`` in their place; False if ``number`` or a later one is there.

        ``touched`` has the keys; what ``change`` gives must lie in the same buckets.
        """
        done = self._commits()
        if done and number <= done[-1]:
            return False
        where = self._manifest(done[-1]) if done else {}
        hit = {r[0] for r in self._known(touched).select(self._bucket()).distinct().collect()}
        if hit:
            new = self._known(change(self._read({b: at for b, at in where.items() if b in hit})))
            # a bucket that one key fills is split by adaptive execution, as rebalancing keeps no promise of one task a bucket
            new.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(self._folder(number))
            filled = {int(x.partition("=")[2]) for x in self._listed(self._folder(number)) if x.startswith("_bucket=")}
            where = {b: at for b, at in where.items() if b not in hit} | {b: number for b in filled}
        self._publish(number, where)
        self._expire()
        return True

    def _expire(self) -> None:
        done = self._commits()
        live = {at for c in done[-self.keep :] for at in self._manifest(c).values()}
        for c in done[: -self.keep]:
            drop_path(self.spark, f"{self.path}/manifest/commit={c:012d}")
        for x in self._listed(f"{self.path}/data"):
            if int(x.partition("=")[2]) not in live:
                drop_path(self.spark, f"{self.path}/data/{x}")

    def replace(self, number: int, keys: DataFrame, rows: DataFrame) -> bool:
        """All rows of ``keys`` and of the keys of ``rows`` go, ``rows`` come."""
        out = keys.select(*self.key).unionByName(rows.select(*self.key)).distinct()
        return self.commit(number, out, lambda old: old.join(out, self.key, "left_anti").unionByName(rows.select(*old.columns)))

    def merge(self, number: int, changes: DataFrame, order: Sequence[Column]) -> bool:
        """One row a key: the first in ``order`` of the present one and the ``changes``, whatever batch brings them.

        With a total order the table does not depend on how changes are dealt into batches. Deletions are rows with a mark,
        so that an older change that comes late does not bring a key back.
        """
        return self.commit(number, changes, lambda old: first_rows(old.unionByName(changes.select(*old.columns)), self.key, order))


def keeping(stream: DataFrame, table: Buckets, order: Sequence[Column], checkpoint: str) -> StreamingQuery:
    """Merges a stream of changes into ``table``, a commit a batch."""

    def write(batch: DataFrame, epoch: int) -> None:
        table.merge(epoch, batch, order)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def indexed(table: Buckets, index: Buckets, number: int, changes: DataFrame, order: Sequence[Column], live: Column, terms: Callable[[DataFrame], DataFrame]) -> None:
    """A batch of ``changes`` to ``table`` and to the ``index`` over it: entries of touched keys are made again from the table.

    The table comes first; a batch that broke off between the two is repeated whole, and the index reads what the table holds by then.
    """
    table.merge(number, changes, order)
    keys = changes.select(*table.key).distinct()
    now = table.rows().join(keys, table.key, "left_semi").filter(live)
    index.replace(number, keys, terms(now))
