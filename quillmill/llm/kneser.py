"""Operator 10: scoring by an interpolated modified Kneser-Ney bigram model."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import expire, fresh_path, release, shuffle_partitions, table
from quillmill.llm.substring import _cut, _planes, _unplanes

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: Word hashes keep 56 bits, so they travel in 7 bytes; two ids outside that range mark a text's ends.
_MASK = np.uint64((1 << 56) - 1)
BEGIN, END = np.uint64(1 << 56), np.uint64((1 << 56) + 1)
#: Tokens counted in a task before they are sent; bounds memory.
FLUSH = 5_000_000
#: Tokens looked up at once.
LOOKUP = 1_000_000
#: Characters of training text whose bigrams fall into one hash range, about: some 3 million tokens, tens of MB.
RANGE_CHARS = 16_000_000


def tokens(text: str | None) -> np.ndarray:
    """The hashes of a text's lower-cased words and its end."""
    words = _WORDS.findall((text or "").encode().translate(_LOWER))
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(w) for w in words]), dtype=">u8").astype(np.uint64) & _MASK
    return np.append(h, END)


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right + np.uint64(0x632BE59BD9B4E019))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= right * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def word_key(word: np.ndarray) -> np.ndarray:
    return (word ^ (word >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)


def _narrow(x: np.ndarray) -> bytes:
    return _planes(np.ascontiguousarray(x))


def _compact(x: np.ndarray) -> bytes:
    """Word hashes as 8 byte planes; the last one is zero but for the end marks."""
    return _planes(np.ascontiguousarray(x, dtype=np.uint64))


# -- files of sorted hash arrays ---------------------------------------------------------------------------------


def _posix(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def write_arrays(uri: str, **arrays: np.ndarray) -> None:
    """Writes arrays as one raw file that can be memory-mapped; renamed into place, so a retried task may repeat it."""
    head = ";".join(f"{k},{v.dtype.str},{len(v)}" for k, v in arrays.items()).encode().ljust(248)
    data = [len(head).to_bytes(8, "little"), head, *(np.ascontiguousarray(v).tobytes() + b"\0" * (-v.nbytes % 8) for v in arrays.values())]
    path = _posix(uri)
    if path is None:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(at), recursive=True)
        part = f"{at}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            for x in data:
                f.write(x)
        store.move(part, at)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.writelines(data)
    os.replace(part, path)


_mapped: dict[str, dict[str, np.ndarray]] = {}


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """Memory-maps the arrays of a file in place; one in a remote store from a nameless copy, gone with the mapping."""
    if uri in _mapped:
        return _mapped[uri]
    if len(_mapped) > 4096:
        _mapped.clear()
    path = _posix(uri)
    if path is None:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(uri)
        with store.open_input_stream(at) as f, tempfile.TemporaryFile() as local:
            while block := f.read(1 << 22):
                local.write(block)
            local.flush()
            raw = np.memmap(local, dtype=np.uint8, mode="r")
    else:
        raw = np.memmap(path, dtype=np.uint8, mode="r")
    size = int.from_bytes(raw[:8].tobytes(), "little")
    at, out = 8 + size, {}
    for item in raw[8 : 8 + size].tobytes().decode().strip().split(";"):
        name, kind, n = item.split(",")
        nbytes = int(n) * np.dtype(kind).itemsize
        out[name] = raw[at : at + nbytes].view(kind)
        at += nbytes + (-nbytes % 8)
    _mapped[uri] = out
    return out


# -- counting ----------------------------------------------------------------------------------------------------


def _bigram_parts(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Bigram counts of a task's texts, each bigram once per FLUSH tokens, packed by hash range."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        right = np.concatenate(held)
        held.clear()
        left = np.empty_like(right)
        left[0] = BEGIN
        left[1:] = np.where(right[:-1] == END, BEGIN, right[:-1])
        key, first, count = np.unique(pair_key(left, right), return_index=True, return_counts=True)
        left, right = left[first], right[first]
        cut = _cut(key, parts)
        rows: list[tuple] = []
        for p in range(parts):
            a, b = int(cut[p]), int(cut[p + 1])
            if a == b:
                continue
            order = np.argsort(left[a:b], kind="stable")
            ctx, n = np.unique(left[a:b], return_counts=True)
            rows.append((p, _compact(ctx), _narrow(n.astype(np.uint32)), _compact(right[a:b][order]), _narrow(count[a:b][order].astype(np.uint32))))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 4], strict=True)],
            ["part", "ctx", "fan", "right", "n"],
        )

    for b in batches:
        for text in b["text"]:
            held.append(tokens(text.as_py()))
            size += len(held[-1])
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()
    release()


def _sum_by(keys: np.ndarray, **values: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, dtype=np.int64)
    return k[at], {n: np.add.reduceat(v[order], at) if len(k) else v[:0] for n, v in values.items()}


_STATS = ("raw", "cont", "total", "n1", "n2", "n3")


@dataclass
class Model:
    """Where the sorted hash arrays lie, and the numbers that hold for the whole model."""

    root: str
    parts: int
    train_tokens: int
    vocabulary: int
    bigrams: int
    high: tuple[float, float, float]  # the discounts of bigram counts 1, 2, 3 and more
    low: tuple[float, float, float]  # of continuation counts
    gamma: float  # what continuation discounts leave to the uniform distribution
    written: dict[str, np.ndarray]  # by kind, which of the ranges have a file


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams that occur 1, 2, 3 and 4 times (Chen & Goodman)."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    out = []
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if a else k * 0.5
        out.append(min(max(d, 0.0), float(k)))
    return tuple(out)


def fit(texts: DataFrame, parts: int | None = None) -> Model:
    """Counts all rows of ``texts`` (text: string) into a model in the shared folder; repeated rows count each, null texts as
    empty ones, other columns do not matter, an empty table gives a model of no texts.

    Bigrams are counted in each task, packed by hash range (even, whatever the words' frequencies; as many ranges as
    RANGE_CHARS asks for, so that a range's size does not grow with the corpus) and summed by range; each range is written as one file of sorted hashes with counts. What each range knows of each word (as
    right word: count, distinct left words; as left word: total, right words seen once, twice, more often) is
    summed by word hash range and written likewise. Only counts of counts reach the driver.
    """
    spark = texts.sparkSession
    if parts is None:
        chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
        parts = 1 << max(4, (max(shuffle_partitions(spark), chars // RANGE_CHARS) - 1).bit_length())
    root = fresh_path(spark, "kneser")

    up = texts.select("text").mapInArrow(
        lambda it: _bigram_parts(it, parts), "part int, ctx binary, fan binary, right binary, n binary"
    )

    def bigrams(k, pdf: pd.DataFrame) -> pd.DataFrame:
        fan = [_unplanes(x, np.uint32) for x in pdf["fan"]]
        left = np.concatenate([np.repeat(_unplanes(x, np.uint64), f) for x, f in zip(pdf["ctx"], fan, strict=True)])
        right = np.concatenate([_unplanes(x, np.uint64) for x in pdf["right"]])
        n = np.concatenate([_unplanes(x, np.uint32) for x in pdf["n"]]).astype(np.int64)
        key = pair_key(left, right)
        order = np.argsort(key, kind="stable")
        s = key[order]
        at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        n = np.add.reduceat(n[order], at)
        left, right, key = left[order][at], right[order][at], s[at]
        del order, s
        big = np.flatnonzero(n > 254)
        write_arrays(
            f"{root}/pair/{k[0]}", key=key, n=np.minimum(n, 255).astype(np.uint8), big_key=key[big], big_n=n[big]
        )
        zero = np.zeros(len(n), dtype=np.int64)
        one = np.ones(len(n), dtype=np.int64)
        w1, a = _sum_by(right, raw=n, cont=one)
        w2, b = _sum_by(left, total=n, n1=(n == 1).astype(np.int64), n2=(n == 2).astype(np.int64), n3=(n > 2).astype(np.int64))
        words = np.concatenate([w1, w2])
        cols = {c: np.concatenate([a.get(c, zero[: len(w1)]), b.get(c, zero[: len(w2)])]) for c in _STATS}
        words, cols = _sum_by(words, **cols)
        wk = word_key(words)
        order = np.argsort(wk, kind="stable")
        wk, words = wk[order], words[order]
        cut = _cut(wk, parts)
        rows = []
        for p in range(parts):
            x, y = int(cut[p]), int(cut[p + 1])
            if y > x:
                o = order[x:y]
                rows.append((p, wk[x:y].tobytes(), *[_narrow(cols[c][o].astype(np.uint64)) for c in _STATS], 0, 0, 0, 0))
        rows.append((-1, b"", *[b""] * 6, *[int((n == c).sum()) for c in (1, 2, 3, 4)]))
        return pd.DataFrame([(*r, k[0]) for r in rows], columns=["part", "word", *_STATS, "c1", "c2", "c3", "c4", "own"])

    schema = "part int, word binary, " + ", ".join(f"{c} binary" for c in _STATS) + ", c1 bigint, c2 bigint, c3 bigint, c4 bigint, own int"
    mid = up.groupBy("part").applyInPandas(bigrams, schema)

    def words(k, pdf: pd.DataFrame) -> pd.DataFrame:
        if k[0] < 0:
            c = [int(pdf[x].sum()) for x in ("c1", "c2", "c3", "c4")]
            return pd.DataFrame([("pair", *c, 0, 0, 0, sorted(pdf["own"].tolist()))], columns=[*names, "written"])
        key = np.frombuffer(b"".join(pdf["word"]), dtype=np.uint64)
        key, cols = _sum_by(key, **{c: np.concatenate([_unplanes(x, np.uint64) for x in pdf[c]]).astype(np.int64) for c in _STATS})
        write_arrays(f"{root}/word/{k[0]}", key=key, **cols)
        cont = cols["cont"]
        c = [int((cont == x).sum()) for x in (1, 2, 3, 4)]
        return pd.DataFrame([("word", *c, int(cols["raw"].sum()), int((cols["raw"] > 0).sum()), int(cont.sum()), [k[0]])], columns=[*names, "written"])

    names = ["level", "c1", "c2", "c3", "c4", "tokens", "types", "pairs"]
    got = mid.groupBy("part").applyInPandas(words, "level string, " + ", ".join(f"{c} bigint" for c in names[1:]) + ", written array<int>")
    every = F.flatten(F.collect_list("written")).alias("written")  # a number a range, however many texts there are
    sums = {r["level"]: r for r in got.groupBy("level").agg(*[F.sum(c).alias(c) for c in names[1:]], every).collect()}
    pair, word = sums.get("pair"), sums.get("word")
    expire(spark, root)
    counts = [[r[c] if r else 0 for c in names[1:5]] for r in (pair, word)]
    high, low = _discounts(counts[0]), _discounts(counts[1])
    v, pairs = (word["types"], word["pairs"]) if word else (0, 0)
    more = v - counts[1][0] - counts[1][1]
    gamma = (low[0] * counts[1][0] + low[1] * counts[1][1] + low[2] * more) / pairs if pairs else 1.0
    written = {}
    for kind in ("pair", "word"):
        written[kind] = np.zeros(parts, dtype=bool)
        written[kind][sums[kind]["written"] if kind in sums else []] = True
    return Model(root, parts, word["tokens"] if word else 0, v, pairs, high, low, gamma, written)


# -- scoring -----------------------------------------------------------------------------------------------------


def _look_up(model: Model, kind: str, key: np.ndarray, columns: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The values of sorted distinct keys, 0 where a key is not there; each range's file is read in key order.

    A range without a file had no n-gram; a file that was written and is gone is an error, not a count of zero.
    """
    root, parts = model.root, model.parts
    out = {c: np.zeros(len(key), dtype=np.int64) for c in columns}
    cut = _cut(key, parts)
    for p in range(parts):
        a, b = int(cut[p]), int(cut[p + 1])
        if a == b or not model.written[kind][p]:
            continue
        m = map_arrays(f"{root}/{kind}/{p}")
        at = np.minimum(np.searchsorted(m["key"], key[a:b]), len(m["key"]) - 1)
        hit = m["key"][at] == key[a:b]
        for c in columns:
            out[c][a:b] = np.where(hit, m[c][at], 0)
        if kind == "pair" and len(m["big_key"]):
            at = np.minimum(np.searchsorted(m["big_key"], key[a:b]), len(m["big_key"]) - 1)
            out["n"][a:b] = np.where(m["big_key"][at] == key[a:b], m["big_n"][at], out["n"][a:b])
    return out


def _discount(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(n - np.take(np.array([0.0, *d]), np.minimum(n, 3)), 0.0)


def score_tokens(model: Model, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of whole texts: is it known, its add-one log10 probability, its Kneser-Ney log10 probability."""
    left = np.empty_like(right)
    left[0] = BEGIN
    left[1:] = np.where(right[:-1] == END, BEGIN, right[:-1])
    wk, of = np.unique(word_key(np.append(right, BEGIN)), return_inverse=True)
    w = _look_up(model, "word", wk, _STATS)
    lk = np.searchsorted(wk, word_key(left))
    of = of[:-1]
    uniform = 1.0 / (model.vocabulary + 1)
    p1 = _discount(w["cont"], model.low) / max(model.bigrams, 1) + model.gamma * uniform
    pk, inv = np.unique(pair_key(left, right), return_inverse=True)
    n = _look_up(model, "pair", pk, ("n",))["n"][inv]
    total = w["total"][lk]
    seen = np.maximum(total, 1)
    back = (model.high[0] * w["n1"] + model.high[1] * w["n2"] + model.high[2] * w["n3"])[lk] / seen
    p = np.where(total > 0, _discount(n, model.high) / seen + back * p1[of], p1[of])
    raw = w["raw"][of]
    base = np.log10((raw + 1) / (model.train_tokens + model.vocabulary + 1))
    return raw > 0, base, np.log10(p)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score, perplexity) of every whole text, one row per input row; no shuffle.

    The end of a text is a token, so a null, empty or blank text has one. Unknown words get the mass that the
    continuation discounts leave, shared evenly by the vocabulary and one unknown word; with a model of no texts
    every token has probability 1. Workers memory-map the model's sorted hash arrays; a file of it that is lost is an
    error. Repeated rows are scored each, null ids are kept, other columns are not looked at, an empty table gives an empty
    table; a text is hashed whole, however long.
    """

    def run(batches):
        for b in batches:
            texts = b["text"].to_pylist()
            at = 0
            rows: list[tuple] = []
            while at < len(texts):
                held, size = [], 0
                while at < len(texts) and (size < LOOKUP or not held):
                    held.append(tokens(texts[at]))
                    size += len(held[-1])
                    at += 1
                known, base, p = score_tokens(model, np.concatenate(held))
                n = np.array([len(h) for h in held])
                cut = np.concatenate([[0], np.cumsum(n)[:-1]])
                sums = [np.add.reduceat(x, cut) for x in (known.astype(np.int64), base, p)]
                rows.append((n, *sums))
            if rows:
                n, known, base, p = (np.concatenate(c) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [b["id"], *map(pa.array, (n, known, base, p, 10.0 ** (-p / n)))],
                    ["id", "n_tokens", "n_known", "base_score", "score", "perplexity"],
                )
        release()

    kind = dict(docs.dtypes)[id_col]
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return src.mapInArrow(run, f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double, perplexity double")


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(F.col("doc_id"))).select(F.col("text").cast("string").alias("text")))
    out = score(docs, model)
    return out.select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
