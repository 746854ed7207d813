"""The corpus pipeline over ``documents``: each stage applies one operator to all that its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of ``documents``, other
columns that ``docs`` may have, whatever their names, pass through. Null or empty texts, null ids, repeated rows and empty tables are handled as
the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import bpe, langid, mixing, secrets, simhash
from quillmill.llm.common import drop_materialized, materialize, packed, unpacked

#: How a language must explain a n-gram of a text beside scrambled letters, as the mean log ratio. Measured: held-out documents of the
#: tables lie at 0.8 in the median and nearly all above -0.35, 99 of 100 scrambled ones and keyboard noise below -0.74.
LEAST_MARGIN = -0.6
#: Near-duplicate shingles have five words.
SHINGLE = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: no letters at all, or none that explains them better than scrambled letters.

    The model is learnt from all rows with a language; a given language is kept even where the prediction differs, a
    missing one is filled in with the predicted one. Where no row has a language, nothing can be told and only documents
    without letters go. Null and empty texts go; null ids, repeated rows, empty tables and other columns are no matter.
    """
    known = docs.filter(F.col("lang").isNotNull()).select("lang", F.col("text").cast("string").alias("text"))
    model = langid.fit(known, other=True)
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    src = packed(docs, text=F.col("text"), lang=F.col("lang"))
    got = langid.predict(src, model, names=("pred", "score"), margin="margin")
    kept = got.filter((F.col("pred") != "und") & (F.col("margin") >= LEAST_MARGIN))
    return unpacked(kept, docs.columns, lang=F.coalesce("lang", "pred"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each SimHash group one row: that of smallest id, one of the rows that have it. Null ids come last.

    Rows of one id with different texts are different documents: each counts in its own group.
    """
    return simhash.representatives(docs, width=SHINGLE)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the secrets out of the texts; n_chars follows where a text changes. No document goes."""
    got = secrets.scan(packed(docs, text=F.col("text"), source=F.col("source"), n_chars=F.col("n_chars")))
    n_chars = F.when(F.size("secrets") > 0, F.length("redacted")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"])
    return unpacked(got, docs.columns, text=F.col("redacted"), n_chars=n_chars)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their target weights: each document as often as the mix takes it, none twice its size over.

    Null texts have no words and go, as do blank ones; a null source is one of its own; null ids and repeated rows are
    documents of their own; an empty table stays empty; other columns pass through.
    """
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text: (doc_id, n_tokens, ids_sha256, decoded_sha256) a row, repeated rows included.

    A null text is the empty one, a null id stays null, an empty table gives none, other columns are not looked at.
    """
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mixing", mixture),
    ("bpe", tokens),
]

#: Language models, fingerprints and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; each one's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = materialize(out, f"pipeline-{name}")
        if before is not None:
            drop_materialized(before)
        before = docs
    return docs
