"""Operator 2: SimHash near-duplicates, candidates by pigeonhole blocks."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import (
    block_units,
    components,
    materialize,
    packed,
    release,
    runs,
    shuffle_partitions,
    spanning,
    table,
    unpacked,
)

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_SEED = 42
#: Shingles hashed at once; bounds memory on very long texts.
_CHUNK = 1 << 15
#: Fingerprints of one key compared in one unit.
BLOCK = 4096


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a whole text over word shingles, repeats included; 0 without words."""
    words = _WORDS.findall((text or "").encode().translate(_LOWER))
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1, out=starts[1:])
    begin = starts[:n].tolist()
    end = (starts[min(width, len(words)) :][:n] - 1).tolist()
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        raw = b"".join([digest(joined[a:b], _SEED) for a, b in zip(begin[at : at + _CHUNK], end[at : at + _CHUNK], strict=True)])
        bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, key: Column | None = None) -> DataFrame:
    """(id, key, fp long: the fingerprint's bits) of every whole text; no shuffle. Null texts count as empty."""

    def run(batches):
        for b in batches:
            got = np.array([fingerprint(x, width) for x in b["text"].to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b["id"], b["key"], pa.array(got.view(np.int64))], ["id", "key", "fp"])
        release()

    kind = dict(docs.dtypes)[id_col]
    src = docs.select(docs[id_col].alias("id"), (F.lit(0) if key is None else key).cast("long").alias("key"), docs[text_col].cast("string").alias("text"))
    return src.mapInArrow(run, f"id {kind}, key bigint, fp bigint")


def block_masks(distance: int) -> list[int]:
    """Masks of which any two fingerprints within ``distance`` bits agree on at least one.

    The 64 bits are cut into 2 * distance blocks; at most ``distance`` of them can differ, so the others (half of
    them, about 32 bits) agree. There is a mask for each choice of that half: selective keys, few chance meetings.
    """
    parts = max(2, 2 * distance)
    edge = [round(64 * k / parts) for k in range(parts + 1)]
    bits = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edge)]
    keep = parts - distance
    return [sum(c) for c in itertools.combinations(bits, keep)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(fp: Column, distance: int) -> Column:
    masks = block_masks(distance)
    return F.array(
        *[F.struct(F.lit(k).alias("mask"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)]
    )


def _linked(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Per unit, the links that join its fingerprints: a spanning forest, never all pairs."""
    keys = ["mask", "key", "_i", "_j"]
    for t in runs(batches, keys):
        cols = [t[k].to_numpy() for k in keys]
        rep, chunk = t["fp"].to_numpy(), t["_c"].to_numpy()
        fp = rep.view(np.uint64)
        new = np.zeros(len(fp), dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(new).tolist()
        left: list[int] = []
        right: list[int] = []
        for a, b in zip([0, *cuts], [*cuts, len(fp)], strict=True):
            if b - a < 2:
                continue
            if b - a == 2:
                if int(fp[a] ^ fp[a + 1]).bit_count() <= distance and (cols[2][a] == cols[3][a] or chunk[a] != chunk[a + 1]):
                    left.append(a)
                    right.append(a + 1)
                continue
            own = fp[a:b]
            cross = cols[2][a] != cols[3][a]
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for r in range(0, b - a, 512):
                near = np.bitwise_count(own[r : r + 512, None] ^ own[None, :]) <= distance
                x, y = np.nonzero(near)
                x += r
                ok = x < y
                if cross:
                    ok &= chunk[a + x] != chunk[a + y]
                x, y = x[ok], y[ok]
                # what this slice adds; pairs inside parts that are joined already go at once
                forest = spanning(b - a, x.tolist(), y.tolist())
                if forest:
                    found.append(tuple(np.array(forest).T))
            if found:
                x, y = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                for p, q in spanning(b - a, x.tolist(), y.tolist()):
                    left.append(a + p)
                    right.append(a + q)
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(rep[left]), pa.array(rep[right])], ["a", "b"])


def classes(fps: DataFrame, distance: int = 3) -> DataFrame:
    """(fp, class: a fingerprint that names it, component: smallest id reachable by links) of distinct fingerprints.

    Each distinct fingerprint is sent to its pigeonhole keys; keys with two or more meet in units of bounded size
    (``block_units``), Hamming distances are verified there, and only a spanning forest of the links leaves a unit.
    Fingerprints, not ids, are the nodes that star contraction joins, so rows that share an id link nothing.
    """
    spark = fps.sparkSession
    reps = fps.groupBy("fp").agg(F.min("id").cast("long").alias("low"))
    keyed = reps.select("fp", F.explode(_keys(F.col("fp"), distance)).alias("k")).select("fp", "k.*")
    units = block_units(keyed, ["mask", "key"], "fp", BLOCK)
    names = ["mask", "key", "_i", "_j"]
    dealt = units.repartition(shuffle_partitions(spark), *names).sortWithinPartitions(*names)
    comp = components(dealt.mapInArrow(lambda it: _linked(it, distance), "a bigint, b bigint"))
    of = reps.join(comp, reps["fp"] == comp["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("class"))
    least = of.groupBy("class").agg(F.min("low").alias("component"))
    return of.select("fp", "class").join(least, "class")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3
) -> DataFrame:
    """SimHash classes: (id, fingerprint 16 hex digits, component: smallest id reachable by links), one row per row.

    Equal fingerprints are collapsed first, so thousands of copies are one node of ``classes``. Null and empty texts
    have fingerprint zero and link like any other; rows with a null id link too, but name no component (null if no
    row with an id reaches them). Rows that share an id are documents of their own. Repeated rows stay. Other columns
    are not looked at. An empty table gives none.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, width).select("id", "fp"), "simhash")
    of = classes(fps, distance).select("fp", "component")
    return fps.join(of, "fp", "left").select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component")


def representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3
) -> DataFrame:
    """One row of each SimHash class, with all columns of the input: that of smallest id, null ids last.

    Rows of that id in the class are told apart by a hash of all their columns (a map by its JSON), the smallest
    stays; equal rows are one. Rows of one id in different classes each count for their own class. Whole rows are
    shuffled once, and only what is repeated is aggregated.
    """
    kinds = dict(docs.dtypes)
    every = [F.to_json(F.col(f"`{c}`")) if "map<" in kinds[c] or kinds[c] == "variant" else F.col(f"`{c}`") for c in docs.columns]
    key = F.xxhash64(*every)
    fps = materialize(fingerprints(docs, id_col, text_col, width, key), "simhash")
    n = fps.groupBy("id", "key", "fp").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "n"))
    best = n.join(classes(fps, distance), "fp").groupBy("class").agg(first.alias("b")).select("b.id", "b.key", "b.n")
    src = packed(docs, i=F.col(f"`{id_col}`"), h=key)
    got = src.join(best, F.col("i").eqNullSafe(F.col("id")) & (F.col("h") == F.col("key"))).select("row", "i", "h", "n")
    once = got.filter("n = 1").unionByName(got.filter("n > 1").dropDuplicates(["i", "h"]))
    return unpacked(once, docs.columns)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "fingerprint", F.col("component").alias("component_id"))
