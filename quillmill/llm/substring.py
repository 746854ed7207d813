"""Operator 5: removal of repeated word windows, candidates by difference-cover anchors."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import shuffle_partitions, table

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xD6E8FEB86659FD93)
#: Difference covers: every residue modulo the period is a difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18)}
#: Characters of text in a bucket of documents, about.
BUCKET_CHARS = 4_000_000
#: Characters of text whose anchors one hash range receives, about (an anchor of 8 bytes for some 20 characters).
RANGE_CHARS = 64_000_000


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """(period, cover, anchor length) for a window: two equal windows share an aligned anchor within them."""
    period = max(v for v in COVERS if v == 1 or 3 * v <= 2 * window)
    return period, COVERS[period], window - period + 1


class Bucket:
    """The words of a bucket's documents, in id order (null ids last), as 64-bit hashes with their places."""

    def __init__(self, pdf: pd.DataFrame):
        # ids come as integers beside a flag: one null would make the whole column inexact floats
        key, none = pdf["id"].to_numpy(dtype=np.int64), pdf["none"].to_numpy(dtype=bool)
        self.order = np.lexsort((key, none))
        self.words = [_WORDS.findall((pdf["text"].iat[k] or "").encode()) for k in self.order]
        size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.size = size
        self.start = np.concatenate([[0], np.cumsum(size)])
        digest = xxhash.xxh64_digest
        self.hash = np.frombuffer(b"".join([digest(x) for w in self.words for x in w]), dtype=">u8").astype(np.uint64)
        self.doc = np.repeat(key[self.order], size)
        self.none = np.repeat(none[self.order], size)
        self.pos = np.arange(len(self.hash)) - np.repeat(self.start[:-1], size)
        self.left = np.repeat(size, size) - self.pos  # words from here to the document's end

    def grams(self, n: int) -> np.ndarray:
        """The hash of the n words from each place on; meaningless where fewer than n are left."""
        out = np.zeros(len(self.hash), dtype=np.uint64)
        m = max(0, len(self.hash) - n + 1)
        for k in range(n):
            out[:m] = out[:m] * _MULTIPLIER + self.hash[k : k + m]
        out ^= out >> np.uint64(32)
        return out * _MULTIPLIER

    def checks(self, n: int, at: np.ndarray) -> np.ndarray:
        """A second hash, of 32 bits and of another kind, of the n words from each of the given places on."""
        out = np.zeros(len(at), dtype=np.uint64)
        for k in range(n):
            out = (out ^ self.hash[at + k]) * _SECOND
            out ^= out >> np.uint64(29)
        return (out >> np.uint64(32)).astype(np.uint32)

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        period, cover, length = cover_for(window)
        at = np.flatnonzero(np.isin(self.pos % period, cover) & (self.left >= length))
        whole = np.repeat(self.size, self.size)[at] >= window
        at = at[whole]
        return at, self.grams(length)[at]


def _cut(h: np.ndarray, parts: int) -> np.ndarray:
    """Where sorted hashes pass from one of ``parts`` (a power of two) equal ranges to the next."""
    step = (1 << 64) // parts
    edges = np.array([k * step for k in range(1, parts)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])


def _planes(x: np.ndarray) -> bytes:
    """Integers as byte planes: high bytes are mostly zero and vanish when the shuffle compresses."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def _unplanes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def _sent(g: int, h: np.ndarray, parts: int, **columns: np.ndarray) -> pd.DataFrame:
    cut = _cut(h, parts)
    full = [p for p in range(parts) if cut[p + 1] > cut[p]]
    out = {"part": full, "g": g, "h": [h[cut[p] : cut[p + 1]].tobytes() for p in full]}
    out |= {k: [_planes(v[cut[p] : cut[p + 1]]) for p in full] for k, v in columns.items()}
    return pd.DataFrame(out, columns=["part", "g", "h", *columns])


def _received(back: pd.DataFrame) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(back["h"]), dtype=np.uint64)) if len(back) else np.zeros(0, dtype=np.uint64)


def _member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(of, x), len(of) - 1)
    return of[at] == x


def _runs(*columns: np.ndarray) -> np.ndarray:
    """For sorted rows, the place where each one's run of equal rows begins."""
    n = len(columns[0])
    new = np.ones(n, dtype=bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, dtype=np.int64)


def _returned(group: pd.DataFrame, keep: np.ndarray, **columns: np.ndarray) -> pd.DataFrame:
    """What of each row's entries is kept, packed for the bucket that sent it."""
    ends = np.cumsum([len(x) // 8 for x in group["h"]])
    out = []
    for g, a, b in zip(group["g"], [0, *ends[:-1]], ends, strict=True):
        if keep[a:b].any():
            out.append((g, *[v[a:b][keep[a:b]].tobytes() for v in columns.values()]))
    return pd.DataFrame(out, columns=["g", *columns])


def remove_repeats(
    docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", bucket_chars: int = BUCKET_CHARS
) -> DataFrame:
    """Removes each word covered by a window of ``window`` words that also starts earlier in the corpus.

    Earlier means in a document of smaller id, or at an earlier place of the same document; all is judged on the
    input. Returns (id, n_words, n_removed, kept: the other words joined by one space), one row per input row.

    Documents are dealt into buckets of bounded text by a hash of their id. (1) Each bucket hashes its words only at
    positions whose residue lies in a difference cover; any two equal windows share such an anchor at the same
    offset. A hash range finds the anchors that occur twice and tells the buckets that have them. (2) Only windows
    around those anchors are extended to their full hash; each bucket sends the first place of each, a hash range
    finds the first place of all and tells the other buckets. (3) Buckets remove what starts later. A bucket names a
    hash once, however often it holds it, so a passage that a third of all documents share is one entry per bucket;
    hash ranges are even by construction. Texts are shuffled once (the exchange is reused), hashes travel packed.

    Null and empty texts have no words. Rows with a null id come last in the order and count as one document, as do
    repeated rows: equal places of the same id do not remove each other. Ids are compared as 64-bit integers, exactly.
    Windows count as equal if two hashes of different kinds do, 96 bits in all: among 10^13 windows (about 100 TB),
    5 * 10^25 pairs, the chance that any two different ones do is below 0.001.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    total = docs.agg(F.sum(F.length(docs[text_col]))).first()[0] or 0
    least = shuffle_partitions(spark)
    buckets = max(4 * least, total // bucket_chars + 1)
    parts = 1 << max(2, (max(least, total // RANGE_CHARS) - 1).bit_length())
    period, _, length = cover_for(window)
    key = F.xxhash64(F.coalesce(docs[id_col].cast("string"), docs[text_col].cast("string")))
    base = docs.select(
        F.pmod(key, F.lit(buckets)).cast("int").alias("g"),
        F.coalesce(docs[id_col].cast("long"), F.lit(0).cast("long")).alias("id"),
        docs[id_col].isNull().alias("none"),
        docs[text_col].cast("string").alias("text"),
    )

    def anchors(k, pdf: pd.DataFrame) -> pd.DataFrame:
        _, h = Bucket(pdf).anchors(window)
        h, n = np.unique(h, return_counts=True)
        return _sent(int(k[0]), h, parts, many=(n > 1).astype(np.uint8))

    def repeated(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.frombuffer(b"".join(pdf["h"]), dtype=np.uint64)
        many = np.concatenate([_unplanes(x, np.uint8) for x in pdf["many"]]) > 0
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = np.zeros(len(s) + 1, dtype=bool)
        same[1:-1] = s[1:] == s[:-1]
        keep = np.empty(len(s), dtype=bool)
        keep[order] = same[1:] | same[:-1]
        return _returned(pdf, keep | many, h=h)

    def windows(k, pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        b = Bucket(pdf)
        at, h = b.anchors(window)
        at = at[_member(h, _received(back))]
        edge = np.zeros(len(b.hash) + 1, dtype=np.int64)
        np.add.at(edge, np.maximum(at - (period - 1), at - b.pos[at]), 1)
        np.add.at(edge, at + 1, -1)
        start = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (b.left >= window))
        h, c = b.grams(window)[start], b.checks(window, start)
        order = np.lexsort((c, h))  # stable: the first of equal ones stays first, documents stand in id order
        first = order[_runs(h[order], c[order]) == np.arange(len(order))]
        h, c, start = h[first], c[first], start[first]
        return _sent(int(k[0]), h, parts, check=c, doc=b.doc[start], none=b.none[start].astype(np.uint8), pos=b.pos[start].astype(np.int32))

    def later(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.frombuffer(b"".join(pdf["h"]), dtype=np.uint64)
        kinds = {"check": np.uint32, "doc": np.int64, "none": np.uint8, "pos": np.int32}
        c, doc, none, pos = (np.concatenate([_unplanes(x, t) for x in pdf[k]]) for k, t in kinds.items())
        order = np.lexsort((pos, doc, none, c, h))
        first = order[_runs(h[order], c[order])]
        keep = np.empty(len(h), dtype=bool)
        keep[order] = (none[order] != none[first]) | (doc[order] != doc[first]) | (pos[order] != pos[first])
        return _returned(pdf, keep, h=h, check=c)

    def remove(k, pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        b = Bucket(pdf)
        start = np.flatnonzero(b.left >= window)
        h = b.grams(window)[start]
        far = np.frombuffer(b"".join(back["h"]), dtype=np.uint64)
        far_c = np.frombuffer(b"".join(back["check"]), dtype=np.uint32)
        one, n = np.unique(h, return_counts=True)
        some = np.flatnonzero(_member(h, np.sort(far)) | _member(h, one[n > 1]))  # only these can start later than another
        start, h = start[some], h[some]
        c = b.checks(window, start)
        told = np.concatenate([np.ones(len(far), dtype=bool), np.zeros(len(h), dtype=bool)])
        both_h, both_c = np.concatenate([far, h]), np.concatenate([far_c, c])
        order = np.lexsort((~told, both_c, both_h))  # stable: what another bucket says comes first, then in order
        first = order[_runs(both_h[order], both_c[order])]
        own, lead = order[~told[order]] - len(far), first[~told[order]]
        mine = lead - len(far)
        drop = np.zeros(len(h), dtype=bool)
        here = ~told[lead]
        x, y = start[own], start[np.maximum(mine, 0)] if len(start) else start
        other = (b.none[x] != b.none[y]) | (b.doc[x] != b.doc[y]) | (b.pos[x] != b.pos[y])
        drop[own] = ~here | other
        edge = np.zeros(len(b.hash) + 1, dtype=np.int64)
        np.add.at(edge, start[drop], 1)
        np.add.at(edge, start[drop] + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        n_removed, kept = [], []
        for d, w in enumerate(b.words):
            g = gone[b.start[d] : b.start[d + 1]]
            n = int(g.sum())
            n_removed.append(n)
            kept.append(b" ".join(w if not n else [x for x, y in zip(w, g.tolist(), strict=True) if not y]).decode())
        return pd.DataFrame(
            {"id": pdf["id"].to_numpy()[b.order], "none": pdf["none"].to_numpy()[b.order], "n_words": b.size, "n_removed": n_removed, "kept": kept}
        )

    up = base.groupBy("g").applyInPandas(anchors, "part int, g int, h binary, many binary")
    twice = up.groupBy("part").applyInPandas(repeated, "g int, h binary")
    full = base.groupBy("g").cogroup(twice.groupBy("g"))
    seen = full.applyInPandas(windows, "part int, g int, h binary, check binary, doc binary, none binary, pos binary")
    foreign = seen.groupBy("part").applyInPandas(later, "g int, h binary, check binary")
    last = base.groupBy("g").cogroup(foreign.groupBy("g"))
    out = last.applyInPandas(remove, "id bigint, none boolean, n_words bigint, n_removed bigint, kept string")
    return out.select(F.when(~F.col("none"), F.col("id")).cast(kind).alias("id"), "n_words", "n_removed", "kept")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
