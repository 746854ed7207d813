"""Assets that several documents share: dedup by content, merging, ownership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expand_members(df: DataFrame, owner: str, members: str) -> DataFrame:
    """One row a member of each asset; the owner is a member of its own asset."""
    return df.select(owner, F.explode(F.array_distinct(F.concat(F.array(owner), F.coalesce(members, F.array())))).alias("member"))


def first_by_content(df: DataFrame, key: str, content: Column) -> DataFrame:
    """Of rows of equal content the one of smallest key; partial aggregation, so a hot content is no hot task."""
    return df.groupBy(content.alias("h")).agg(F.min(key).alias(key))


def merge_by_content(df: DataFrame, kind: str, content: str, key: str, newest: Sequence[str]) -> DataFrame:
    """Assets of one kind and content merge: the newest is ``main``, ``members`` are all of them in order."""
    got = df.groupBy(kind, content).agg(
        F.max_by(key, F.struct(*newest)).alias("main"), F.array_sort(F.collect_list(key)).alias("members"), F.count(F.lit(1)).alias("n")
    )
    return got.filter("n > 1").select(kind, content, "main", "members", (F.col("n") - 1).alias("merged"))


def delete_owners(df: DataFrame, gone: DataFrame, content: str, key: str) -> DataFrame:
    """Who owns each asset after some documents go: the first member left; its version rises if the owner went."""
    got = df.join(gone.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    left = F.when(F.col("_gone").isNull(), F.col(key))
    got = got.groupBy(content).agg(F.min(left).alias("main"), F.count(left).alias("n"), F.min(key).alias("owner"))
    return got.filter("n > 0").select(content, "main", (F.col("n") - 1).alias("others"), (F.col("main") != F.col("owner")).cast("int").alias("version_up"))
