"""Operator 9: nearest neighbours by randomly rotated one-bit codes with error bounds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.llm.common import materialize, shuffle_partitions, table
from quillmill.llm.vectors import binary, matrix, pack, rotation, usable, words
from quillmill.operators.relational import small

#: Queries that a unit holds, and candidates that it streams past them, at most; where the tables are small, candidates
#: are dealt finer, so that there are some units a partition.
QUERIES, CANDIDATES, FINEST = 16_384, 262_144, 4096
#: Width of the estimate's error bound, in the standard deviations of a random rotation.
EPSILON = 3.2
#: Bits of a code for each component: that many rotations of a vector, one sign bit a component each.
SPREAD = 16
#: Bits that a component of a rotated query is rounded to.
PLANES = 4
#: Codes that one step of the popcounts takes, so that they stay in a core's cache.
STRIP = 4096


@dataclass
class Codes:
    """One-bit codes: packed signs of the rotated direction, the vector's length, and the correction scalar."""

    bits: np.ndarray  # rows x words
    norm: np.ndarray
    fit: np.ndarray  # inner product of the direction with its code, 0 < fit <= 1


def encode(x: np.ndarray) -> Codes:
    turn = rotation(x.shape[1], SPREAD)
    norm = np.linalg.norm(x, axis=1)
    y = (x / norm[:, None]) @ turn.T
    return Codes(pack(y >= 0), norm, np.abs(y).sum(1) / np.sqrt(len(turn)))


@dataclass
class Query:
    """A rotated query: its own signs, and its components rounded to PLANES bits, a packed plane each."""

    sign: np.ndarray  # words
    planes: np.ndarray  # PLANES x words
    low: float
    step: float
    total: float  # sum of the rounded components
    norm: float


def queries_of(x: np.ndarray) -> list[Query]:
    y = x @ rotation(x.shape[1], SPREAD).T
    low, high = y.min(axis=1), y.max(axis=1)
    step = np.where(high > low, (high - low) / (2**PLANES - 1), 1.0)
    u = np.rint((y - low[:, None]) / step[:, None]).astype(np.uint8)
    sign = pack(y >= 0)
    planes = np.stack([pack((u >> p) & 1 == 1) for p in range(PLANES)], axis=1)
    total = low * y.shape[1] + step * u.sum(axis=1)
    norm = np.linalg.norm(x, axis=1)
    return [Query(*z) for z in zip(sign, planes, low, step, total, norm, strict=True)]


def agreement(codes: Codes, turned: np.ndarray, q: Query, bits: int) -> np.ndarray:
    """A rough inner product from signs alone: length times (bits that agree - bits that differ)."""
    out = np.empty(len(codes.norm))
    for a in range(0, len(out), STRIP):
        far = np.bitwise_count(turned[:, a : a + STRIP] ^ q.sign[:, None]).sum(axis=0, dtype=np.int32)
        out[a : a + STRIP] = bits - 2.0 * far
    return out * codes.norm


def estimate(codes: Codes, turned: np.ndarray, ones: np.ndarray, q: Query, bits: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of a query with all codes, and bounds on their errors, from popcounts.

    The rounded query's product with a code, divided by the code's ``fit``, estimates the product with the vector's
    direction without bias. The bound is ``epsilon`` standard deviations: of the random rotations, sqrt((1 - fit^2) /
    (bits - SPREAD)), and of rounding to steps, step / sqrt(12), both divided by ``fit`` and scaled by the lengths.
    ``turned`` are the codes word by word, ``ones`` the one bits of each code.
    """
    dot = np.empty(len(ones))
    for a in range(0, len(ones), STRIP):
        part, sums = turned[:, a : a + STRIP], 0.0
        for p in range(PLANES):
            sums = sums + float(1 << p) * np.bitwise_count(part & q.planes[p][:, None]).sum(axis=0, dtype=np.int32)
        dot[a : a + STRIP] = sums
    dot = 2.0 * (q.low * ones + q.step * dot) - q.total
    scale = codes.norm / codes.fit
    spread = np.sqrt(np.maximum(1 - codes.fit**2, 0) / max(bits - SPREAD, 1) * q.norm**2 + q.step**2 / 12)
    return dot * scale / np.sqrt(bits), epsilon * spread * scale + 1e-9 * q.norm * codes.norm


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dims = b["dim"].to_numpy()
        for dim in np.unique(dims).tolist():
            for at in range(0, b.num_rows, 2048):
                where = pa.array(at + np.flatnonzero(dims[at : at + 2048] == dim))
                if not len(where):
                    continue
                c = encode(matrix(b["vec"].take(where), dim))
                yield pa.RecordBatch.from_arrays(
                    [b["id"].take(where), b["h"].take(where), b["dim"].take(where), binary(c.bits), pa.array(c.norm), pa.array(c.fit)],
                    ["id", "h", "dim", "bits", "norm", "fit"],
                )


def _search(batches: Iterator[pa.RecordBatch], k: int | None) -> Iterator[pa.RecordBatch]:
    """What of each unit's products may count: the ``k`` roughly largest a query, or all whose bound reaches its ``tau``.

    Units arrive sorted, each one's queries before its candidates; candidates are searched piece by piece.
    """
    unit, queries, q_ids, taus = None, [], [], []
    for batch in batches:
        key = list(zip(*(batch[c].to_pylist() for c in ("dim", "qb", "cb")), strict=True))
        cand = batch["cand"].to_numpy(zero_copy_only=False)
        cuts = [0, *(p for p in range(1, len(key)) if key[p] != key[p - 1] or cand[p] != cand[p - 1]), len(key)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if key[a] != unit:
                unit, queries, q_ids, taus = key[a], [], [], []
            dim = key[a][0]
            ids = batch["id"].slice(a, b - a).to_numpy()
            if not cand[a]:
                queries += queries_of(matrix(batch["vec"].slice(a, b - a), dim))
                q_ids += ids.tolist()
                taus += batch["tau"].slice(a, b - a).to_pylist()
                continue
            bits = SPREAD * dim
            codes = Codes(words(batch["bits"].slice(a, b - a), -(-bits // 64)), *(batch[c].slice(a, b - a).to_numpy() for c in ("norm", "fit")))
            turned = np.ascontiguousarray(codes.bits.T)
            ones = np.bitwise_count(turned).sum(axis=0, dtype=np.int32)
            h = batch["h"].slice(a, b - a).to_numpy()
            for part in range(0, len(queries), 256):
                said: list[tuple[int, np.ndarray, np.ndarray]] = []
                for q, q_id, tau in zip(*(x[part : part + 256] for x in (queries, q_ids, taus)), strict=True):
                    if k is None:
                        est, err = estimate(codes, turned, ones, q, bits)
                        c = np.flatnonzero((est + err >= tau) & (ids != q_id))
                        near = est[c]
                    else:
                        near = agreement(codes, turned, q, bits)
                        near[ids == q_id] = -np.inf
                        c = np.argpartition(near, -k)[-k:] if len(near) > k else np.arange(len(near))
                        c = c[ids[c] != q_id]
                        near = near[c]
                    said.append((q_id, c, near))
                at = np.concatenate([c for _, c, _ in said])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([x for x, _, _ in said], [len(c) for _, c, _ in said]).astype(np.int64)), pa.array(ids[at]), pa.array(h[at]), pa.array(np.concatenate([n for _, _, n in said]))],
                    ["query_id", "vec_id", "h", "near"],
                )


def product(a: Column, b: Column) -> Column:
    """The inner product in double precision, summed in the order of components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def search(
    rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """The k rows of largest inner product with each query: (query_id, rank from 1, vec_id, score).

    Every usable row is a candidate of every query but those of its own id. Each is encoded once, where it is read:
    packed sign bits of its rotated direction, and two scalars. Codes, not vectors, are dealt to units: candidates and
    queries by a hash of their id into blocks, each pair of blocks on some task.

    (1) Units name each query's candidates whose signs agree most, some 4 * k of all units together; the exact products
    of the 2 * k best give the query's threshold, the k-th largest, which its true k-th neighbour cannot fall below. (2) Units estimate
    all products from popcounts and name the candidates whose error bound reaches the threshold. Only these fetch
    their vectors, by id, for the exact products that rank them. A bound that is missed (EPSILON standard deviations)
    loses a neighbour near the threshold; nothing else is approximate.

    Ties go to the smaller id. Only vectors of one dimension meet. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows without id, take no part. Repeated candidate rows are ranked each; a query id that
    repeats is one query, with one of its vectors, the same on every run. Fewer candidates than k: all of them. Other
    columns are not looked at, an empty table gives none.
    """
    spark = rows.sparkSession
    vec = F.col(f"`{vec_col}`")
    base = rows.filter(F.col(f"`{id_col}`").isNotNull() & usable(vec))
    base = base.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("vec"), F.size(vec).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("q"),
        F.xxhash64(vec).alias("h"),
    )
    coded = base.select("id", "h", "dim", "vec").mapInArrow(_encoded, "id long, h long, dim int, bits binary, norm double, fit double")
    coded = materialize(coded, "bitcodes")
    one = F.min_by(F.struct("dim", "vec"), F.struct("dim", "h"))
    asked = materialize(base.filter("q").groupBy("id").agg(one.alias("v")).select("id", "v.dim", "v.vec"), "bitcodes")
    n, nq, parts = coded.count(), asked.count(), max(shuffle_partitions(spark), 1)
    q_blocks = max(1, -(-nq // QUERIES))
    c_blocks = max(1, -(-n // CANDIDATES), min(-(-n // FINEST), -(-4 * parts // q_blocks)))
    kind = dict(base.dtypes)["vec"]
    cand = coded.select(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), F.pmod(F.xxhash64("id"), F.lit(c_blocks)).cast("int").alias("cb"),
        F.lit(True).alias("cand"), "id", "h", F.lit(None).cast(kind).alias("vec"), F.lit(None).cast("double").alias("tau"), "bits", "norm", "fit",
    )
    names = ["dim", "qb", "cb"]
    found = "query_id long, vec_id long, h long, near double"

    def meet(ask: DataFrame, most: int | None) -> DataFrame:
        quer = ask.select(
            "dim", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(q_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"),
            F.lit(False).alias("cand"), "id", F.lit(0).cast("long").alias("h"), "vec", "tau",
            F.lit(None).cast("binary").alias("bits"), F.lit(None).cast("double").alias("norm"), F.lit(None).cast("double").alias("fit"),
        )
        dealt = cand.unionByName(quer).repartition(parts, *names).sortWithinPartitions(*names, "cand")
        return dealt.mapInArrow(lambda it: _search(it, most), found)

    target = asked.select(F.col("id").alias("query_id"), F.col("dim").alias("qdim"), F.col("vec").alias("qvec"))

    def scored(pairs: DataFrame) -> DataFrame:
        some = pairs.select("query_id", F.col("vec_id").alias("id"), "h").distinct()
        got = base.select("id", "h", "vec", "dim").join(some, ["id", "h"]).join(small(target), "query_id").filter("dim = qdim")
        return got.select("query_id", F.col("id").alias("vec_id"), product(F.col("qvec"), F.col("vec")).alias("score"))

    rough = meet(asked.withColumn("tau", F.lit(None).cast("double")), max(3, -(-4 * k // c_blocks)))
    best = W.partitionBy("query_id").orderBy(F.desc("near"), "vec_id", "h")
    first = scored(rough.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= 2 * k))
    kth = F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1))
    tau = first.groupBy("query_id").agg(kth.alias("t"))
    # beside the error of a sum, so that what equals the threshold is never lost
    ask = asked.join(tau, asked["id"] == tau["query_id"], "left").select(
        "id", "dim", "vec", F.coalesce(F.col("t") - 1e-9 * F.abs("t"), F.lit(float("-inf"))).alias("tau")
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = scored(meet(ask, None)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
