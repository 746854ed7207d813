"""Operator 8: language ID by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import materialize, packed, release, table, unpacked

#: Hash buckets of the n-grams of all orders together, by default; a power of two.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: A broadcast block of the log-probability matrix has about so many bytes at most; more languages are more blocks.
MATRIX_BYTES = 128_000_000
#: Characters hashed at once; bounds memory on very long texts.
_SLICE = 1 << 20

_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    if not _FOLD:
        low = np.full(0x110000, 32, dtype=np.uint32)
        for k in range(0x110000):
            c = chr(k)
            if c.isalpha():
                d = c.lower()
                low[k] = ord(d) if len(d) == 1 else k
        _FOLD.append(low)
    return _FOLD[0]


def letters(text: str | None) -> np.ndarray:
    """The text's letters in lower case; each run of anything else is one space. Empty without letters."""
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.concatenate([[np.uint32(32)], _fold()[raw], [np.uint32(32)]]).astype(np.uint32)
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = c[keep]
    return c if len(c) > 2 else c[:0]


def grams(c: np.ndarray, buckets: int) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams of each order, in slices."""
    top = np.uint64(64 - int(math.log2(buckets)))
    for at in range(0, len(c), _SLICE):
        part = c[at : at + _SLICE + max(ORDERS) - 1].astype(np.uint64)
        n = min(_SLICE, len(c) - at)
        h = np.zeros(len(part), dtype=np.uint64)
        for k in range(1, max(ORDERS) + 1):
            m = len(part) - k + 1
            if m <= 0:
                break
            h = (h[:m] * np.uint64(0x100000001B3) + part[k - 1 :] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            if k in ORDERS:
                yield (h[:n] >> top).astype(np.int64)


def scrambled(c: np.ndarray) -> np.ndarray:
    """The same letters in words of the same lengths, in another order: what is no language, with a language's letters."""
    out = c.copy()
    at = np.flatnonzero(c != 32)
    out[at] = c[np.random.default_rng(zlib.crc32(c.tobytes())).permutation(at)]
    return out


@dataclass
class Model:
    """langs, and log P(bucket | lang) as buckets x langs; prior is log P(lang). ``other`` is log P(bucket) of scrambled texts."""

    langs: list[str]
    prior: np.ndarray
    logp: np.ndarray
    other: np.ndarray | None = field(default=None)

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The languages and posteriors of a batch of texts; ('und', 0.0) without a letter. Ties go to the smaller name.

        Sparse scoring: a slice of the batch is a matrix of texts x buckets that holds counts, as its non-zero cells
        in order of text; one take of the log-probability rows of these cells and one sum over each text's run
        multiply it with the model. Slices hold at most _SLICE grams of an order; sums go on over slices.
        """
        langs, best, top, mass, _, _ = self.weigh(texts)
        return [langs[k] if k >= 0 else "und" for k in best.tolist()], np.where(best >= 0, np.exp(top - mass), 0.0)

    def weigh(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """langs, and for each text the best one's number (-1: none), its log probability, the log of the sum over all
        languages, the log probability under ``other``, and how many grams it has."""
        n, langs = len(texts), self.langs
        wide = self.logp if self.other is None else np.column_stack([self.logp, self.other])
        total = np.tile(self.prior if self.other is None else np.append(self.prior, 0.0), (n, 1))
        size = np.zeros(n)
        cs = [letters(t) for t in texts]
        some = np.array([len(c) > 0 for c in cs], dtype=bool) & bool(langs)
        if some.any():
            for of, g in _gram_cells([(k, cs[k]) for k in np.flatnonzero(some).tolist()], len(wide)):
                size += np.bincount(of, minlength=n)
                cell, count = np.unique(of * len(wide) + g, return_counts=True)
                step = max(1, _SLICE * 4 // wide.shape[1])
                for a in range(0, len(cell), step):
                    of, g = np.divmod(cell[a : a + step], len(wide))
                    at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                    total[of[at]] += np.add.reduceat(wide[g] * count[a : a + step, None], at, axis=0)
        if not langs:
            return langs, np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n), size
        own = total[:, : len(langs)]
        best = own.argmax(axis=1)
        top = own[np.arange(n), best]
        mass = top + np.log(np.exp(own - top[:, None]).sum(axis=1))
        return langs, np.where(some, best, -1), top, mass, total[:, -1] if self.other is not None else np.zeros(n), size


class Blocks:
    """A model of many languages: the matrix in blocks of columns, each broadcast for itself; ``langs`` are all of them."""

    def __init__(self, langs: list[str], parts: list):
        self.langs, self.parts = langs, parts


def _gram_cells(texts: list[tuple[int, np.ndarray]], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every gram of (number, letters), in slices; grams do not reach from a text into the next."""
    at = 0
    while at < len(texts):
        held, size = [], 0
        while at < len(texts) and (not held or size + len(texts[at][1]) <= _SLICE):
            held.append(texts[at])
            size += len(texts[at][1])
            at += 1
        if len(held) == 1:
            for g in grams(held[0][1], buckets):
                yield np.full(len(g), held[0][0], dtype=np.int64), g
            continue
        sizes = np.array([len(c) for _, c in held])
        of = np.repeat(np.array([k for k, _ in held], dtype=np.int64), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(size)  # letters from here to the text's end
        for k, g in zip(ORDERS, grams(np.concatenate([c for _, c in held]), buckets), strict=False):
            ok = left[: len(g)] >= k
            yield of[: len(g)][ok], g[ok]


def count_grams(labelled: DataFrame, buckets: int = BUCKETS, other: bool = False) -> DataFrame:
    """(lang, bucket, n) over all rows of (lang, text); bucket -1 counts documents. Summed in each task first.

    With ``other``, scrambled texts are counted too, under the null language.
    """

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                own = letters(text)
                for name, c in ((lang, own), (None, scrambled(own))) if other else ((lang, own),):
                    docs[name] = docs.get(name, 0) + 1
                    mine = counts.setdefault(name, np.zeros(buckets, dtype=np.int64))
                    for g in grams(c, buckets):
                        if len(g) > 4096:
                            mine += np.bincount(g, minlength=buckets)
                        else:
                            np.add.at(mine, g, 1)
                if len(counts) > 64:
                    yield from sums(counts, docs)
                    counts, docs = {}, {}
        yield from sums(counts, docs)
        release()

    def sums(counts, docs):
        for lang, mine in counts.items():
            at = np.flatnonzero(mine)
            at, n = np.r_[-1, at], np.r_[docs[lang], mine[at]]
            names = pa.repeat(pa.scalar(lang, pa.string()), len(at))
            yield pa.RecordBatch.from_arrays([names, pa.array(at.astype(np.int32)), pa.array(n)], ["lang", "bucket", "n"])

    parts = labelled.select("lang", "text").mapInArrow(run, "lang string, bucket int, n bigint")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, smoothing: float = 0.5, buckets: int = BUCKETS, other: bool = False) -> Model | Blocks:
    """Learns from all rows of (lang not null, text), and with ``other`` what scrambled texts look like.

    What reaches the driver is a number a language and bucket, a block of languages at a time: a matrix over
    MATRIX_BYTES (244 languages with the default buckets) is made, and broadcast, in blocks of columns, so the number of
    languages has no limit. Repeated rows count each; other columns do not matter; an empty table gives a model of none.
    """
    got = materialize(count_grams(labelled, buckets, other), "langid")
    per = got.filter("bucket = -1 and lang is not null").select("lang", "n").orderBy("lang").toArrow()
    langs = per["lang"].to_pylist()
    docs = per["n"].to_numpy().astype(float)
    prior = np.log(docs / docs.sum()) if langs else docs

    def logs(t: pa.Table, names: list) -> np.ndarray:
        col = {x: k for k, x in enumerate(names)}
        count = np.full((buckets, len(names)), smoothing)
        lang = np.array([col[x] for x in t["lang"].to_pylist()], dtype=np.int64)
        np.add.at(count, (t["bucket"].to_numpy(), lang), t["n"].to_numpy().astype(float))
        return np.log(count) - np.log(count.sum(axis=0))

    cells = got.filter("bucket >= 0")
    against = logs(cells.filter("lang is null").toArrow(), [None])[:, 0] if other else None
    most = max(1, MATRIX_BYTES // (8 * buckets))
    if len(langs) <= most:
        return Model(langs, prior, logs(cells.filter("lang is not null").toArrow(), langs), against)
    parts = []
    for at in range(0, len(langs), most):
        some = langs[at : at + most]
        t = cells.filter(F.col("lang").between(some[0], some[-1])).toArrow()
        block = Model(some, prior[at : at + most], logs(t, some), against)
        parts.append(labelled.sparkSession.sparkContext.broadcast(block))
    return Blocks(langs, parts)


def _weighed(docs: DataFrame, part, last: bool) -> DataFrame:
    """(row, text unless this block is the ``last``, and what is known so far) after one more block of languages: the better
    best, the sum of both sums."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    numbers = ("top", "mass", "against", "grams")
    first = "top" not in docs.columns

    def run(batches):
        for b in batches:
            langs, best, top, mass, against, size = part.value.weigh(b["text"].to_pylist())
            names = [langs[k] if k >= 0 else None for k in best.tolist()]
            if not first:
                was, was_top, was_mass = b["lang"].to_pylist(), b["top"].to_numpy(), b["mass"].to_numpy()
                names = [y if x is None or (y is not None and t > u) else x for x, y, t, u in zip(was, names, top.tolist(), was_top.tolist(), strict=True)]
                top, mass = np.maximum(top, was_top), np.logaddexp(mass, was_mass)
            yield pa.RecordBatch.from_arrays(
                [b["row"], *[b["text"]] * (not last), pa.array(names, pa.string()), *[pa.array(x, pa.float64()) for x in (top, mass, against, size)]],
                ["row", *["text"] * (not last), "lang", *numbers],
            )
        release()

    kept = [docs.schema["row"], *[StructField("text", StringType())] * (not last), StructField("lang", StringType())]
    return docs.mapInArrow(run, StructType([*kept, *[StructField(k, DoubleType()) for k in numbers]]))


def predict(
    docs: DataFrame, model: Model | Blocks, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score"), margin: str | None = None
) -> DataFrame:
    """Adds the predicted language and its posterior (0 to 1) to each row, from its whole text alone; no shuffle.

    A null text, or one without a letter, is ``und`` with score 0, as is any text where nothing was learnt. Repeated
    rows are predicted each, an empty table gives an empty table. Other columns are kept as they are, whatever their
    names; one that has a name of ``names`` is replaced, as ``withColumn`` would. The model is broadcast: a number a
    bucket and language; one of blocks is gone through block by block, with the same result.

    ``margin`` names a further column, for a model with ``other``: by how much the best language explains a gram better
    than scrambled letters do, as the mean log ratio of all grams of a text. Unlike a posterior, which long texts drive
    to 1 whatever they are, it does not grow with a text's length; it is below 0 for what no language explains. Null for ``und``.
    """
    spark = docs.sparkSession
    parts = model.parts if isinstance(model, Blocks) else [spark.sparkContext.broadcast(model)]
    got = packed(docs, text=F.col(f"`{text_col}`").cast("string"))
    for k, part in enumerate(parts):
        got = _weighed(got, part, last=k == len(parts) - 1)
    new = {names[0]: F.coalesce("lang", F.lit("und")), names[1]: F.when(F.col("lang").isNull(), 0.0).otherwise(F.exp(F.col("top") - F.col("mass")))}
    if margin is not None:
        new[margin] = F.when(F.col("lang").isNotNull(), (F.col("top") - F.col("against")) / F.col("grams"))
    return unpacked(got, docs.columns, **new)


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"))
    model = fit(docs.filter(~out & F.col("lang").isNotNull()).select("lang", F.col("text").cast("string").alias("text")))
    got = predict(docs.select("doc_id", out.alias("held_out"), "text"), model)
    return got.select("doc_id", "held_out", "lang_pred", "score")
