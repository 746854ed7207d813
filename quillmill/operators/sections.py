"""Splitting lines into sections at headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sections(lines: DataFrame, doc: str, pos: str, line: str, is_heading: Column, title: Column) -> DataFrame:
    """(doc, idx from 1, title, body): lines between headings, without empty sections.

    A heading is not in its body, bodies are stripped of white space at both ends; what stands before the first heading
    has an empty title.
    """
    w = W.partitionBy(doc).orderBy(pos)
    got = lines.withColumn("_h", is_heading).withColumn("_s", F.sum(F.col("_h").cast("int")).over(w))
    text = F.when(~F.col("_h"), F.struct(F.col(pos).alias("p"), F.col(line).alias("l")))
    parts = got.groupBy(doc, "_s").agg(F.max(F.when(F.col("_h"), title)).alias("title"), F.array_sort(F.collect_list(text)).alias("ls"))
    body = F.btrim(F.array_join(F.transform("ls", lambda s: s["l"]), "\n"), F.lit(" \t\n\r"))
    parts = parts.select(doc, "_s", F.coalesce("title", F.lit("")).alias("title"), body.alias("body")).filter("body <> ''")
    return parts.select(doc, F.row_number().over(W.partitionBy(doc).orderBy("_s")).alias("idx"), "title", "body")
