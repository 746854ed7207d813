"""Loading tables, and the views that stand in for books, chapters and reading activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations "
    "clicks sales sale_lines clients client_changes vendors items stamps"
).split()


class Tables:
    """Tables of a directory by attribute; Parquet, read lazily, columns pruned by the optimizer."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in NAMES:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        raise AttributeError(name)

    @property
    def lines(self) -> DataFrame:
        """The lines of documents: (doc_id, pos from 1, line); a line is a paragraph or chapter."""
        split = F.split(F.col("text"), "\r?\n", -1)
        return self.documents.select("doc_id", F.posexplode(split).alias("p", "line")).select(
            "doc_id", (F.col("p") + 1).alias("pos"), "line"
        )

    @property
    def books(self) -> DataFrame:
        """One 'book' for each source and language."""
        return self.documents.select(F.concat_ws("/", "source", "lang").alias("book"), "source", "lang", "doc_id", "text")

    @property
    def notes(self) -> DataFrame:
        """Chat turns of users as notes: (book = conversation, note = turn, text)."""
        return self.conversations.filter("role = 'user'").select(
            F.col("conv_id").alias("book"), F.col("turn").alias("note"), "text"
        )
