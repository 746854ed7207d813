"""Steps that a language model may improve, each whole without one.

A client is any object with ``name`` and ``complete(prompts: list[str]) -> list[str | None]`` that can be pickled. It is
called once a batch on the executors; what it says is parsed tolerantly and joined back as a nullable side table, so a
missing or failing model changes nothing but that table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillmill.storage import materialize

# What directions and relation types a model may name.
DIRECTIONS = ("无", "承接", "发展", "批判")
RELATIONS = ("主题相似", "概念共现", "理论传承", "应用扩展")


class Client(Protocol):
    name: str

    def complete(self, prompts: list[str]) -> list[str | None]: ...


def first_object(text: str | None) -> dict:
    """The JSON object from the first { to the last } of a reply; empty if there is none."""
    a, b = (text or "").find("{"), (text or "").rfind("}")
    try:
        got = json.loads(text[a : b + 1]) if 0 <= a < b else {}
    except ValueError:
        got = {}
    return got if isinstance(got, dict) else {}


def replies(df: DataFrame, key: str, prompt: Column, client: Client | None) -> DataFrame:
    """(key, reply): one row a prompt that the client answers; a batch that fails has no replies, others have."""
    kind = dict(df.dtypes)[key]
    asked = df.select(key, prompt.alias("prompt"))
    if client is None:
        return asked.filter("false").select(key, F.col("prompt").alias("reply"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                said = client.complete(pdf["prompt"].tolist())
            except Exception:  # a model's failure leaves the rows as they are, whatever it is
                continue
            yield pd.DataFrame({key: pdf[key], "reply": said}).dropna()

    return asked.mapInPandas(run, f"{key} {kind}, reply string")


def score_pairs(pairs: DataFrame, client: Client | None = None, most: int = 40, reasons: int = 6) -> DataFrame:
    """The ``most`` strongest pairs (a, b, strength, reasons) with what a model says of them.

    Strength only rises; direction and relation must be known ones, reasons are at most ``reasons``. Without a model
    direction is 无, relation 概念共现, and everything else as it was.
    """
    top = pairs.orderBy(F.desc("strength"), "a", "b").limit(most).withColumn("pair", F.concat_ws("-", "a", "b"))
    prompt = F.to_json(F.struct("a", "b", "strength", "reasons"))
    said = replies(top, "pair", prompt, client)

    @F.pandas_udf("struct<strength:double,direction:string,relation:string,reasons:array<string>>")
    def parsed(s: pd.Series) -> pd.DataFrame:
        rows = []
        for o in map(first_object, s):
            n = o.get("strength")
            r = [str(x) for x in o.get("reasons") or [] if x][:reasons] if isinstance(o.get("reasons"), list) else None
            rows.append((float(n) if isinstance(n, (int, float)) else None, o.get("direction") if o.get("direction") in DIRECTIONS else None, o.get("relation") if o.get("relation") in RELATIONS else None, r or None))
        return pd.DataFrame(rows, columns=["strength", "direction", "relation", "reasons"])

    if client is None:
        got = top.withColumn("m", F.lit(None).cast("struct<strength:double,direction:string,relation:string,reasons:array<string>>"))
    else:
        got = top.join(said.select("pair", parsed("reply").alias("m")), "pair", "left")
    strength = F.round(F.greatest("strength", F.least(F.lit(100.0), F.coalesce(F.col("m.strength"), F.lit(0.0)))), 1)
    return got.select(
        "a", "b", strength.alias("strength"), F.coalesce("m.direction", F.lit(DIRECTIONS[0])).alias("direction"),
        F.coalesce("m.relation", F.lit(RELATIONS[1])).alias("relation"), F.coalesce("m.reasons", "reasons").alias("reasons"),
    )


def summaries(chunks: DataFrame, doc: str, text: str, client: Client | None = None) -> DataFrame:
    """(doc, chunks, summary): a model's summaries of a document's chunks in order; null where it gave none."""
    keyed = chunks.withColumn("_key", F.concat_ws("-", F.col(doc).cast("string"), F.col("pos").cast("string")))
    got = keyed.join(replies(keyed, "_key", F.col(text), client), "_key", "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("pos", "reply"))))
    out = got.groupBy(doc).agg(F.count(F.lit(1)).alias("chunks"), parts.alias("p"))
    return out.select(doc, "chunks", F.when(F.size("p") > 0, F.array_join(F.transform("p", lambda s: s["reply"]), "\n")).alias("summary"))


@dataclass(frozen=True)
class Echo:
    """A stand-in for a model: says the first ``size`` characters of a prompt behind ``mark``, nothing where the prompt's length is a multiple of ``skip``."""

    size: int
    skip: int = 0
    mark: str = ""
    name: str = "echo"

    def complete(self, prompts: list[str]) -> list[str | None]:
        return [None if self.skip and len(x) % self.skip == 0 else self.mark + x[: self.size] for x in prompts]


def summarised(docs: DataFrame, doc: str, text: str, client: Client | None = None, block: int = 65_536) -> DataFrame:
    """(doc, blocks, failed, summary): summaries of long texts by blocks of ``block`` characters, one document a row.

    Map: every block is a prompt of its own, spread over the tasks. Reduce: the partial summaries in order, with the numbers
    of the blocks that failed named behind them, are a prompt again where there is more than one block; if that fails the
    partial summaries stand. ``failed`` holds the numbers of the blocks without a reply. No block answered, or no text: null.
    """
    size = F.coalesce(F.length(text), F.lit(0))
    cut = docs.filter(size > 0).select(doc, F.explode(F.sequence(F.lit(0), F.floor((size - 1) / block).cast("int"))).alias("k"), text)
    cut = cut.select(doc, "k", F.substring(text, F.col("k") * block + 1, F.lit(block)).alias("part")).withColumn("_key", F.concat_ws("-", F.col(doc).cast("string"), "k"))
    got = cut.join(replies(cut, "_key", F.col("part"), client), "_key", "left")
    parts = F.array_sort(F.collect_list(F.struct("k", "reply")))  # a document's blocks: as many as its own length asks for
    got = got.groupBy(doc).agg(F.count(F.lit(1)).alias("blocks"), parts.alias("p"))
    said = F.array_join(F.transform(F.filter("p", lambda s: s["reply"].isNotNull()), lambda s: s["reply"]), "\n")
    failed = F.transform(F.filter("p", lambda s: s["reply"].isNull()), lambda s: s["k"])
    whole = F.concat(said, F.when(F.size(failed) > 0, F.concat(F.lit("\n[missing: "), F.array_join(failed.cast("array<string>"), ","), F.lit("]"))).otherwise(""))
    any_ = F.exists("p", lambda s: s["reply"].isNotNull())
    got = materialize(got.select(doc, "blocks", failed.alias("failed"), F.when(any_, whole).alias("whole"), F.when(any_, said).alias("said")), "summaries")
    last = replies(got.filter("blocks > 1 and whole is not null"), doc, F.col("whole"), client)
    out = got.join(last, doc, "left")
    out = out.select(doc, "blocks", "failed", F.when(F.col("blocks") > 1, F.coalesce("reply", "whole")).otherwise(F.col("said")).alias("summary"))
    none = docs.filter(size == 0).select(doc, F.lit(0).cast("bigint").alias("blocks"), F.array().cast("array<int>").alias("failed"), F.lit(None).cast("string").alias("summary"))
    return out.unionByName(none)


# -- transcriptions, kept by content -----------------------------------------------------------------------------


def content_key(content: Column, params: dict) -> Column:
    """What a transcription is kept under: a digest of the content and of all parameters that shape the result."""
    return F.sha2(F.concat_ws("|", F.sha2(F.coalesce(content, F.lit("")), 256), F.lit(json.dumps(params, sort_keys=True))), 256)


def cached(spark: SparkSession, path: str, kind: str = "text") -> DataFrame:
    """The transcriptions (digest, reply) of a cache, or with ``kind`` "failed" the tries that failed (digest, run)."""
    schema = "digest string, reply string" if kind == "text" else "digest string, run string"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    got = spark.read.schema(schema).parquet(f"{path}/{kind}")
    return got.groupBy("digest").agg(F.min("reply").alias("reply")) if kind == "text" else got.distinct()


def transcribe(pages: DataFrame, content: str, client: Client | None, cache: str, params: dict | None = None) -> DataFrame:
    """Adds (digest, transcript, status) to pages: their transcription by content, asked for only where the cache has none.

    The cache is two tables in a shared folder: texts by digest, and tries that failed, which are asked for again by the
    next run. Equal pages are one prompt. Runs only add files, and one digest read twice is one text, so a job that is repeated
    or runs beside another changes nothing. status: cached, new or failed (transcript null). Null contents count as empty,
    columns named digest, transcript and status are replaced.
    """
    spark, params = pages.sparkSession, {"client": getattr(client, "name", None)} | (params or {})
    keyed = pages.withColumn("digest", content_key(F.col(content), params))
    known = cached(spark, cache).select("digest", F.col("reply").alias("known"))
    wanted = keyed.select("digest", F.coalesce(F.col(content), F.lit("")).alias("content")).groupBy("digest").agg(F.first("content").alias("content"))
    wanted = materialize(wanted.join(known, "digest", "left_anti"), "wanted")
    said = materialize(replies(wanted, "digest", F.col("content"), client), "transcripts")
    lost = wanted.join(said, "digest", "left_anti").select("digest", F.lit(uuid.uuid4().hex).alias("run"))
    before = materialize(keyed.select("digest").distinct().join(known, "digest"), "known")  # as it was before this run's files
    said.write.mode("append").parquet(f"{cache}/text")
    lost.write.mode("append").parquet(f"{cache}/failed")
    got = keyed.drop("transcript", "status").join(before, "digest", "left").join(said, "digest", "left")
    status = F.when(F.col("known").isNotNull(), "cached").when(F.col("reply").isNotNull(), "new").otherwise("failed")
    return got.withColumn("transcript", F.coalesce("known", "reply")).withColumn("status", status).drop("known", "reply")
