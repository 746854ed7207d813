"""Array and map functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tail(a: Column, n: int) -> Column:
    """The last n items, or all of fewer."""
    return F.when(F.size(a) <= n, a).otherwise(F.slice(a, -n, n))


def clean_tags(tags: Column) -> Column:
    """Stripped, without blanks, distinct in order."""
    return F.array_distinct(F.filter(F.transform(tags, lambda x: F.trim(x)), lambda x: x != ""))


def drop_at(a: Column, k: Column) -> Column:
    """Without the item at place k (from 0); unchanged where there is none."""
    return F.filter(a, lambda x, i: i != k)


def add_maps(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def top_entries(m: Column, n: int) -> Column:
    """The n entries of largest value, ties by key."""
    order = F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return F.slice(F.transform(order, lambda e: F.struct(e["k"].alias("key"), (-e["v"]).alias("value"))), 1, n)
