"""Operator 3: embedding near-duplicates through an inverted multi-index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import (
    block_units,
    components,
    materialize,
    runs,
    shuffle_partitions,
    spanning,
    table,
)
from quillmill.llm.vectors import matrix, pack, rotation, scaled, usable

#: Vectors that the codebooks are fitted on: FEWEST or PER_CENTROID for each centroid of a half, at most MOST; every vector
#: is indexed.
FEWEST, PER_CENTROID, MOST = 20_000, 16, 200_000
#: Classes in a cell of the grid, about, labels together: the grid has as many cells as that asks for.
CELL = 128
#: Codes of one cell compared in one unit, and vectors verified in one unit.
BLOCK = 1024
#: Sampled pairs at the threshold that the traversal's length is set by.
TRIALS = 4096
#: Bits of the sign codes that tell which probes of a cell may be near each other.
BITS = 64


@dataclass
class Codebooks:
    """Centroids of each vector half, and how many cells a traversal visits."""

    first: np.ndarray
    second: np.ndarray
    visits: int = 1

    @property
    def split(self) -> int:
        return self.first.shape[1]


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    x = x[np.lexsort(x.T[::-1])]
    distinct = x[np.r_[True, (x[1:] != x[:-1]).any(axis=1)]]
    k = min(k, len(distinct))
    rng = np.random.default_rng(3)
    c = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([np.argmin((c * c).sum(1) - 2 * x[a : a + 4096] @ c.T, axis=1) for a in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def centroids(rows: int) -> int:
    """Centroids per half: the grid grows with the rows, so that a cell holds about CELL of them at every size."""
    return int(min(MOST // PER_CENTROID, max(4, round((rows / CELL) ** 0.5))))


def fit_codebooks(sample: np.ndarray, rows: int, threshold: float, recall: float) -> Codebooks:
    """Independent codebooks on the halves of unit vectors, and the cells to visit for the target recall.

    The length of the traversal is set by trials: sampled vectors are turned in random directions to exactly the
    threshold's cosine, the hardest pairs that count. A pair meets if the end whose cell has the smaller number visits
    the cell of the other; the length is the least by which at least ``recall`` of these pairs do.
    """
    dim = sample.shape[1]
    split = (dim + 1) // 2
    k = centroids(rows)
    books = Codebooks(_kmeans(sample[:, :split], k), _kmeans(sample[:, split:], k) if dim > 1 else np.zeros((1, 0)))
    total = len(books.first) * len(books.second)
    if dim < 2:
        return books
    rng = np.random.default_rng(33)
    x = sample[rng.choice(len(sample), min(TRIALS, len(sample)), replace=False)]
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(1)[:, None] * x
    z /= np.maximum(np.linalg.norm(z, axis=1), 1e-300)[:, None]
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * z
    swap = (_cell(x, books) > _cell(y, books))[:, None]
    need = _place(np.where(swap, y, x), np.where(swap, x, y), books) + 1
    need.sort()
    books.visits = int(min(total, need[min(len(need) - 1, int(np.ceil(recall * len(need))))]))
    return books


def _square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0.0)


def _cell(x: np.ndarray, books: Codebooks) -> np.ndarray:
    """The number of each unit vector's own cell."""
    i, j = _square(x[:, : books.split], books.first).argmin(1), _square(x[:, books.split :], books.second).argmin(1)
    return i * len(books.second) + j


def _place(x: np.ndarray, y: np.ndarray, books: Codebooks) -> np.ndarray:
    """The place of y's own cell in x's traversal, from 0: how many pairs of centroids have a smaller sum."""
    out = np.zeros(len(x), dtype=np.int64)
    i, j = np.divmod(_cell(y, books), len(books.second))
    for at in range(0, len(x), 512):
        a, b = _square(x[at : at + 512, : books.split], books.first), _square(x[at : at + 512, books.split :], books.second)
        for r in range(len(a)):
            own = a[r, i[at + r]] + b[r, j[at + r]]
            out[at + r] = np.searchsorted(np.sort(b[r]), own - a[r], side="left").sum()
    return np.maximum(out, 0)


def _nearest(d: np.ndarray, n: int) -> np.ndarray:
    if n < d.shape[1]:
        some = np.sort(np.argpartition(d, n - 1, axis=1)[:, :n], axis=1)
        return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)
    return np.argsort(d, axis=1, kind="stable")


def visit(x: np.ndarray, books: Codebooks) -> np.ndarray:
    """The cells that each unit vector visits, its own first: rows x visits.

    Multi-sequence traversal: with both halves' cells sorted by distance, pairs of places (i, j) are taken in order
    of the sum of the two. The first n pairs all have (i + 1) * (j + 1) <= n, so only these sums are formed.
    """
    n, width = books.visits, len(books.second)
    a, b = _square(x[:, : books.split], books.first), _square(x[:, books.split :], books.second)
    ia, ib = _nearest(a, n), _nearest(b, n)
    da, db = np.take_along_axis(a, ia, 1), np.take_along_axis(b, ib, 1)
    pairs = [(i, j) for i in range(ia.shape[1]) for j in range(ib.shape[1]) if (i + 1) * (j + 1) <= n]
    i, j = (np.array(c) for c in zip(*pairs, strict=True))
    order = np.argsort(da[:, i] + db[:, j], axis=1, kind="stable")[:, :n]
    return np.take_along_axis(ia[:, i] * width + ib[:, j], order, 1)


def far_bits(threshold: float, loss: float = 1e-7) -> int:
    """In how many of BITS signs vectors at the threshold may differ, but for a chance of about ``loss``.

    Random rotations part a sign of two vectors with a chance of their angle over pi.
    """
    p = float(np.arccos(np.clip(threshold, -1, 1)) / np.pi)
    tail = 1.0
    for k in range(BITS):
        tail -= comb(BITS, k) * p**k * (1 - p) ** (BITS - k)
        if tail <= loss:
            return k
    return BITS


def _probe(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """A row for a class's own cell and each cell of larger number that it visits: number and sign code, no vector."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            b = batch.slice(at, 1024)
            dims = b["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                where = np.flatnonzero(dims == dim)
                x = scaled(matrix(b["vec"].take(pa.array(where)), dim))
                turn = rotation(dim, -(-BITS // dim))[:BITS]
                code = pack(x @ turn.T >= 0)[:, 0].view(np.int64)
                cells = visit(x / np.linalg.norm(x, axis=1)[:, None], shared.value[dim]).astype(np.int64)
                own = _cell(x / np.linalg.norm(x, axis=1)[:, None], shared.value[dim])[:, None]
                cells = np.concatenate([own, np.where(cells > own, cells, -1)], axis=1)
                r, c = np.nonzero(cells >= 0)
                row = pa.array(where[r])
                yield pa.RecordBatch.from_arrays(
                    [b["label"].take(row), b["dim"].take(row), pa.array(cells[r, c]), b["cid"].take(row), pa.array(code[r]), pa.array(c == 0)],
                    ["label", "dim", "cell", "cid", "code", "member"],
                )


_UNIT = ["label", "dim", "cell", "_i", "_j"]


def _units(batches: Iterator[pa.RecordBatch], target: int) -> Iterator[tuple[pa.Table, int, int]]:
    """The units of sorted rows, as a table and where in it each begins and ends."""
    for t in runs(batches, _UNIT, target):
        new = np.zeros(t.num_rows, dtype=bool)
        for k in _UNIT:
            c = t[k].to_numpy()
            new[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(new).tolist()
        for a, b in zip([0, *cuts], [*cuts, t.num_rows], strict=True):
            yield t, a, b


def _meet(batches: Iterator[pa.RecordBatch], far: int) -> Iterator[pa.RecordBatch]:
    """The rows of each unit whose code is near that of another one they are to be compared with."""
    for t, a, b in _units(batches, 1 << 15):
        u = t.slice(a, b - a)
        member, chunk = u["member"].to_numpy(), u["_c"].to_numpy()
        m = np.flatnonzero(member)
        if b - a < 2 or not len(m):
            continue
        code = u["code"].to_numpy().view(np.uint64)
        cross = u["_i"][0].as_py() != u["_j"][0].as_py()
        keep = np.zeros(b - a, dtype=bool)
        for r in range(0, b - a, 512):
            near = np.bitwise_count(code[r : r + 512, None] ^ code[None, m]) <= far
            if cross:
                near &= chunk[r : r + 512, None] != chunk[None, m]
            near[np.arange(r, min(r + 512, b - a))[:, None] == m[None, :]] = False
            keep[r : r + 512] |= near.any(axis=1)
            keep[m] |= near.any(axis=0)
        if keep.any():
            yield from u.filter(pa.array(keep)).select([*_UNIT, "_c", "cid", "member"]).combine_chunks().to_batches()


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Per unit: how many rows each class links with, and links that join its classes (a spanning forest)."""
    for t, a, b in _units(batches, 8192):
        u = t.slice(a, b - a)
        member, chunk, n, cid = (u[k].to_numpy() for k in ("member", "_c", "n", "cid"))
        m = np.flatnonzero(member)
        if b - a < 2 or not len(m):
            continue
        cross = u["_i"][0].as_py() != u["_j"][0].as_py()
        x = scaled(matrix(u["vec"], u["dim"][0].as_py()))
        norm = np.sqrt((x * x).sum(1))
        links = np.zeros(b - a, dtype=np.int64)
        left: list[int] = []
        right: list[int] = []
        for r in range(0, b - a, 512):
            # near in matrix products, then exact: each pair's own product decides
            near = (x[r : r + 512] @ x[m].T) >= (threshold - 1e-9) * np.outer(norm[r : r + 512], norm[m])
            p, q = np.nonzero(near)
            p, q = p + r, m[q]
            ok = (p != q) & (~member[p] | (p < q))
            if cross:
                ok &= chunk[p] != chunk[q]
            p, q = p[ok], q[ok]
            cos = np.concatenate([(x[p[s : s + 65536]] * x[q[s : s + 65536]]).sum(1) for s in range(0, len(p), 65536)]) if len(p) else np.zeros(0)
            ok = cos / (norm[p] * norm[q]) >= threshold
            p, q = p[ok], q[ok]
            np.add.at(links, p, n[q])
            np.add.at(links, q, n[p])
            for v, w in spanning(b - a, p.tolist(), q.tolist()):
                left.append(v)
                right.append(w)
        out = [(int(cid[k]), None, int(links[k])) for k in np.flatnonzero(links)]
        out += [(int(cid[v]), int(cid[w]), 0) for v, w in spanning(b - a, left, right)]
        if out:
            v, w, k = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(w, pa.int64()), pa.array(k, pa.int64())], ["a", "b", "n"])


def _books(classes: DataFrame, threshold: float, recall: float) -> dict[int, Codebooks]:
    """Codebooks by dimension, each fitted on its own bounded sample: the classes of smallest hash."""
    out = {}
    for r in classes.groupBy("dim").count().collect():
        dim, count = r["dim"], r["count"]
        most = min(MOST, max(FEWEST, PER_CENTROID * centroids(count)))
        some = classes.filter(F.col("dim") == dim).select("vec").orderBy(F.xxhash64("cid")).limit(most).toArrow()
        x = scaled(matrix(some["vec"], dim))
        out[dim] = fit_codebooks(x / np.linalg.norm(x, axis=1)[:, None], count, threshold, recall)
    return out


def near_duplicates(
    rows: DataFrame,
    threshold: float = 0.98,
    recall: float = 0.9999,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Links vectors of equal label and dimension by cosine >= threshold: (id, n_links, component, kept), row per row.

    Equal vectors of a label are one class with a count. Classes' unit vectors are indexed in the product grid of two
    codebooks fitted on a bounded sample, about CELL of them a cell at every size; each class visits the cells that
    come first in its multi-sequence traversal, as many as ``recall`` asks of pairs right at the threshold (closer
    pairs meet more surely), and of these only those of larger number than its own, so that a pair meets once. What
    travels to a cell (label, then cell) is a number and a sign code of BITS bits. Units of bounded size compare
    codes, a hot cell is many units; only classes with a near code fetch their vector, by number, and cosines are
    verified in double precision. A unit sends counts and a spanning forest of its links.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with null label or id, link
    with nothing: n_links 0, their own component. Vectors are scaled by powers of two first, so the size of components
    does not matter. Repeated rows link with each other. Other columns are not looked
    at. An empty table gives none.
    """
    spark = rows.sparkSession
    vec = F.col(f"`{vec_col}`")
    base = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), vec.alias("vec"))
    live = usable(F.col("vec")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    hashed = base.select("id", "label", "vec", *[F.when(live, F.xxhash64("vec", F.lit(k))).alias(f"h{k}") for k in (0, 1)])
    same = ["label", "h0", "h1"]
    classes = hashed.filter("h0 is not null").groupBy(*same).agg(F.min("id").cast("long").alias("low"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cid"), *same, "low", "n", "vec", F.size("vec").alias("dim")), "multiindex")
    shared = spark.sparkContext.broadcast(_books(classes, threshold, recall))
    schema = f"label {dict(classes.dtypes)['label']}, dim int, cell bigint, cid bigint, code bigint, member boolean"
    probes = classes.select("label", "dim", "cid", "vec").mapInArrow(lambda it: _probe(it, shared), schema)
    units = block_units(probes, ["label", "dim", "cell"], "cid", BLOCK)
    parts, far = shuffle_partitions(spark), far_bits(threshold)
    dealt = units.repartition(parts, *_UNIT).sortWithinPartitions(*_UNIT)
    near = dealt.mapInArrow(lambda it: _meet(it, far), f"label {dict(classes.dtypes)['label']}, dim int, cell bigint, _i int, _j int, _c int, cid bigint, member boolean")
    fetched = near.join(classes.select("cid", "n", "vec"), "cid").repartition(parts, *_UNIT).sortWithinPartitions(*_UNIT)
    found = materialize(fetched.mapInArrow(lambda it: _verify(it, threshold), "a bigint, b bigint, n bigint"), "multiindex")
    comp = components(found.filter("b is not null").select("a", "b"))
    links = found.filter("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    per = classes.select(*same, "cid", "low", "n").join(links, "cid", "left").join(comp, F.col("cid") == F.col("node"), "left")
    per = per.withColumn("class", F.coalesce("component", "cid"))
    least = per.groupBy("class").agg(F.min("low").alias("smallest"))
    per = per.join(least, "class").select(*same, (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "smallest")
    out = hashed.select("id", *same).join(per, same, "left")
    comp_ = F.coalesce(F.col("smallest"), F.col("id").cast("long"))
    return out.select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_.alias("component"),
        F.coalesce(F.col("id") == comp_, F.lit(False)).alias("kept"),
    )


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")
