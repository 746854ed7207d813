"""Shared helpers of the corpus operators: shared storage, tables, block pairing and components."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators.graph import components
from quillmill.storage import drop_materialized, drop_path, expire, fresh_path, materialize, shared_dir

__all__ = [
    "WORD", "block_units", "columns", "components", "drop_materialized", "drop_path", "expire", "fresh_path", "materialize", "packed", "release",
    "runs", "shared_dir", "shuffle_partitions", "spanning", "table", "unpacked",
]

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names hold."""
    return [F.col(f"`{c}`") for c in df.columns]


def packed(df: DataFrame, **own: Column) -> DataFrame:
    """``df`` with its rows in one struct ``row`` beside columns of our own, which so cannot clash with the input's."""
    return df.select(F.struct(*columns(df)).alias("row"), *[c.alias(k) for k, c in own.items()])


def unpacked(df: DataFrame, names: list[str], **new: Column) -> DataFrame:
    """The fields ``names`` of ``row`` as columns again, those in ``new`` replaced, others of ``new`` appended."""
    kept = [(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in names]
    return df.select(*kept, *[v.alias(k) for k, v in new.items() if k not in names])


def release() -> None:
    """Gives a worker's free memory back to the system: workers outlive their tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def block_units(df: DataFrame, keys: list[str], id_col: str, block: int) -> DataFrame:
    """Splits groups of rows that are to be compared pairwise into units of bounded size.

    Rows of a group (equal ``keys``) of at most ``block`` rows form one unit (0, 0). A larger group is dealt into
    c = ceil(rows / block) chunks by a hash of ``id_col``; every pair of chunks i <= j is a unit, so each pair of
    rows meets in exactly one unit and no task ever holds more than about 2 * block rows of a group. Groups of a
    single row are dropped. Adds the columns ``_i``, ``_j`` (the unit) and ``_c`` (the row's own chunk).
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    joined = df.join(sizes, keys).withColumn("_k", F.ceil(F.col("_n") / F.lit(block)).cast("int"))
    joined = joined.withColumn("_c", F.pmod(F.xxhash64(F.col(id_col)), F.col("_k").cast("long")).cast("int"))
    out = joined.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return out.select(
        *df.columns, "_c", F.least("_c", "_o").alias("_i"), F.greatest("_c", "_o").alias("_j")
    )


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], target: int = 1 << 15) -> Iterator[pa.Table]:
    """Regroups sorted record batches into tables that never split a run of equal ``keys``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < target:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        cut = whole.num_rows - 1
        last = [whole[k][cut].as_py() for k in keys]
        low, high = 0, cut  # the first row of the last run, by doubling back
        step = 1
        while cut - step >= 0 and [whole[k][cut - step].as_py() for k in keys] == last:
            step *= 2
        low, high = max(0, cut - step), cut
        if [whole[k][low].as_py() for k in keys] == last:
            high = low
        else:
            while high - low > 1:
                mid = (low + high) // 2
                if [whole[k][mid].as_py() for k in keys] == last:
                    high = mid
                else:
                    low = mid
        if high:
            yield whole.slice(0, high)
        held = whole.slice(high).to_batches()
        size = whole.num_rows - high
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def spanning(n: int, left, right) -> list[tuple[int, int]]:
    """The edges (left[k], right[k]) that join two parts of 0..n-1 not joined before: a spanning forest."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(left, right, strict=True):
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out
