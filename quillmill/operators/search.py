"""Full-text search: substring matching with BM25 order, and its upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import snippet

K1, B = 1.2, 0.75


def bm25(df: DataFrame, key: str, text: str, words: list[str], limit: int | None = 100) -> DataFrame:
    """(key, score) of texts that contain a word, best first, ties by key.

    A word counts its non-overlapping occurrences as a substring in any case; a text's length is its number of
    trigrams. Document frequencies and the mean length are one row of a single pass, broadcast to the scored scan.
    """
    low = F.lower(F.col(text))
    tf = [((F.length(low) - F.length(F.replace(low, F.lit(w.lower()), F.lit("")))) / len(w)).cast("double").alias(f"f{k}") for k, w in enumerate(words)]
    base = df.select(key, F.greatest(F.length(text) - 2, F.lit(0)).cast("double").alias("len"), *tf)
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"f{k}") > 0).alias(f"d{k}") for k in range(len(words))])
    got = base.filter(" or ".join(f"f{k} > 0" for k in range(len(words)))).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for k in range(len(words)):
        weight = F.log(1 + (F.col("n") - F.col(f"d{k}") + 0.5) / (F.col(f"d{k}") + 0.5))
        f = F.col(f"f{k}")
        score = score + weight * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    got = got.select(key, F.round(score, 6).alias("score"))
    return got.orderBy(F.desc("score"), key).limit(limit) if limit else got


def like_search(df: DataFrame, key: str, text: str, word: str, limit: int) -> DataFrame:
    """(key, snippet) of texts that contain a short word, in order of key."""
    got = df.filter(F.ilike(F.col(text), F.lit(f"%{word}%"))).orderBy(key).limit(limit)
    return got.select(key, snippet(F.col(text), word).alias("snippet"))


def trigram_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """(gram, key): distinct trigrams of each lower-cased text, for a persisted index partitioned by gram."""
    grams = F.regexp_extract_all(F.lower(F.col(text)), F.lit("(?s)(?=(...))"), F.lit(1))
    return df.select(key, F.explode(grams).alias("gram")).distinct()


def maintain_index(index: DataFrame, gone: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """The index after some keys are deleted or replaced and others added."""
    out = gone.select(key).unionByName(new.select(key)).distinct()
    return index.join(out, key, "left_anti").unionByName(trigram_index(new, key, text).select(*index.columns))


def search(df: DataFrame, key: str, text: str, query: str, limit: int = 30, enabled: bool = True) -> DataFrame:
    """(key, score, snippet) for a reader's query: BM25 over its words of three characters or more, else plain LIKE.

    A blank query, or a search that is switched off, finds nothing.
    """
    query = query.strip()
    none = df.filter("false").select(key, F.lit(0.0).alias("score"), F.lit("").alias("snippet"))
    if not enabled or not query:
        return none
    kept = "".join(c if c not in '"*():^~+-<>{}[]' else " " for c in query)
    words = [w for w in kept.split() if len(w) >= 3][:8] if len(query) >= 3 else []
    if not words:
        return like_search(df, key, text, query, limit).select(key, F.lit(0.0).alias("score"), "snippet")
    top = bm25(df, key, text, words, limit)
    return top.join(df.select(key, text), key).select(key, "score", snippet(F.col(text), words[0]).alias("snippet"))
