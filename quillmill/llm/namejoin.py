"""Operator 13: edit-distance join of names by asymmetric q-chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import release, runs, table

#: Longest q of a chunk; longer names are chunked at their front only, which is enough to find them.
MOST_Q = 8
#: A unit compares at most about so many names of either side; larger groups are dealt into several units.
UNIT = 8192
#: One name in so many, by hash, is counted to find the groups that need dealing out. Changes where rows go, never results.
COUNTED = 16
#: Pairs are gone through in slices of about so many pairs, or characters of pairs that are compared.
SLICE = 1_000_000


def layout(length: int, edits: int) -> list[tuple[int, int]]:
    """The chunks (start, size) that a name of ``length`` is indexed by: 2 * edits + 1 disjoint ones; none for short names.

    An insertion, deletion or substitution touches one chunk, an exchange of neighbours two at most, so after ``edits`` of
    them one chunk is left as it was: the bound on shared chunks is n - 2 * edits. The chunks' q grows with the name, the
    first ones take one character more where that uses up the name.
    """
    n = 2 * edits + 1
    q = min(length // n, MOST_Q)
    if q < 2:
        return []
    more = length - n * q if length // n < MOST_Q else 0
    sizes = [q + 1] * more + [q] * (n - more)
    return [(sum(sizes[:k]), sizes[k]) for k in range(n)]


def _cap(edits: int) -> int:
    """From this length on, layouts are all the same."""
    return (2 * edits + 1) * MOST_Q


def _shifts(edits: int) -> list[tuple[int, int]]:
    """(shift of the chunk, difference of lengths) that so many edits before and behind the chunk can make."""
    e = range(-edits, edits + 1)
    return sorted((d, more) for d in e for more in e if abs(d) + abs(more - d) <= edits)


def _probes(spark: SparkSession, edits: int) -> tuple[DataFrame, DataFrame]:
    """Constant tables: by length of an indexed name its chunks and where they may lie in the other one; by length of a
    probing name its positional q-grams that some chunk may meet. Lengths from the cap on have the cap's rows."""
    cap = _cap(edits)
    index = [
        (n, k, start, size, start + d, more)
        for n in range(1, cap + 1) for k, (start, size) in enumerate(layout(n, edits)) for d, more in _shifts(edits) if start + d >= 0
    ]
    grams = set()
    for n in range(1, cap + edits + 1):
        for more in range(-edits, edits + 1):
            for start, size in layout(min(max(n - more, 0), cap), edits):
                grams |= {(n, start + d, size) for d, e in _shifts(edits) if e == more and 0 <= start + d <= n - size}
    # names beyond the cap on both sides keep the cap's layout, so the table's last length stands for all that follow
    return (
        spark.createDataFrame(index, "n int, chunk int, start int, size int, at int, more int"),
        spark.createDataFrame(sorted(grams), "n int, at int, size int"),
    )


def osa(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, edits: int) -> np.ndarray:
    """The optimal string alignment distances of pairs of code point rows, ``edits`` + 1 where it is more.

    All pairs at once, by the band of 2 * edits + 1 diagonals; |la - lb| <= edits is asked for.
    """
    far = edits + 1
    width, pairs = 2 * edits + 1, len(la)
    result = np.full(pairs, far, dtype=np.int16)
    before = np.full((width, pairs), far, dtype=np.int16)  # row i - 1: cell k is column i - 1 + k - edits
    for k in range(edits, width):
        before[k] = k - edits
    older = np.full((width, pairs), far, dtype=np.int16)
    result[la == 0] = np.minimum(lb[la == 0], far)
    pad = np.full((pairs, edits + 1), -1, dtype=b.dtype)
    wide = np.concatenate([pad, b, pad], axis=1)  # column j of b is wide[:, j + edits]
    top = int(la.max(initial=0))
    for i in range(1, top + 1):
        now = np.full((width, pairs), far, dtype=np.int16)
        x, x1 = a[:, i - 1], a[:, i - 2] if i > 1 else None
        for k in range(width):
            j = i + k - edits
            if j < 0:
                continue
            if j == 0:
                now[k] = min(i, far)
                continue
            if j + edits >= wide.shape[1]:
                continue
            y = wide[:, j + edits]
            same = x == y
            best = before[k] + np.where(same, 0, 1).astype(np.int16)
            if k + 1 < width:
                best = np.minimum(best, before[k + 1] + 1)
            if k:
                best = np.minimum(best, now[k - 1] + 1)
            if x1 is not None and j > 1:
                y1 = wide[:, j - 1 + edits]
                best = np.where((x == y1) & (x1 == y), np.minimum(best, older[k] + 1), best)
            now[k] = np.minimum(best, far)
        done = la == i
        if done.any():
            at = lb[done] - i + edits
            result[done] = now[at, np.flatnonzero(done)]
        if (now.min(axis=0) >= far).all() and (before.min(axis=0) >= far).all():
            break
        older, before = before, now
    return result


def _first_chunk(indexed: str, probing: str, edits: int) -> tuple[int, int]:
    """The first (chunk, place) by which two names meet, or (-1, -1): a pair is told in that group only."""
    more = len(probing) - len(indexed)
    for k, (start, size) in enumerate(layout(min(len(indexed), _cap(edits)), edits)):
        for d, e in _shifts(edits):
            at = start + d
            if e == more and 0 <= at <= len(probing) - size and probing[at : at + size] == indexed[start : start + size]:
                return k, at
    return -1, -1


def _codes(names: list[str], width: int) -> np.ndarray:
    return np.array(names, dtype=f"<U{max(width, 1)}").view(np.int32).reshape(len(names), -1)


def _compare(t: pa.Table, edits: int) -> Iterator[tuple[list, list, list]]:
    """The pairs within reach in whole units, rows sorted by unit and side: names of each side and their distances."""
    unit = np.stack([t.column(k).to_numpy() for k in ("key", "i", "j")])
    side = t.column("side").to_numpy()
    names = t.column("name").to_pylist()
    chunk, place = t.column("chunk").to_numpy(), t.column("at").to_numpy()
    cuts = np.flatnonzero((unit[:, 1:] != unit[:, :-1]).any(axis=0)) + 1
    starts, ends = np.r_[0, cuts], np.r_[cuts, len(names)]
    ones = np.r_[0, np.cumsum(side)]  # side 1 (probing) follows side 0 (indexed)
    probing = ones[ends] - ones[starts]
    indexed = ends - starts - probing
    live = (probing > 0) & (indexed > 0)
    starts, indexed, probing = starts[live], indexed[live], probing[live]
    if not len(starts):
        return
    length, mask = t.column("len").to_numpy(), t.column("mask").to_numpy().view(np.uint64)
    # a line is one indexed row beside the probing rows of its unit
    line = np.arange(int(indexed.sum())) + np.repeat(starts - np.r_[0, np.cumsum(indexed)[:-1]], indexed)
    first, many = np.repeat(starts + indexed, indexed), np.repeat(probing, indexed)
    total = np.cumsum(many)
    for part in np.split(np.arange(len(line)), np.flatnonzero(np.diff(total // SLICE)) + 1):
        n = many[part]
        left = np.repeat(line[part], n)
        right = np.arange(int(n.sum())) + np.repeat(first[part] - np.r_[0, np.cumsum(n)[:-1]], n)
        near = np.bitwise_count(mask[left] ^ mask[right]) <= 2 * edits
        left, right = left[near], right[near]
        near = np.abs(length[left] - length[right]) <= edits
        left, right = left[near], right[near]
        for one, two in _alike(left, right, length):
            use = np.unique(np.r_[one, two])
            codes = _codes([names[k] for k in use.tolist()], int(length[use].max()))
            a, b = np.searchsorted(use, one), np.searchsorted(use, two)
            got = osa(codes[a], length[one], codes[b], length[two], edits)
            hit = np.flatnonzero(got <= edits)
            x, y, z = [], [], []
            for h in hit.tolist():
                p, q = names[one[h]], names[two[h]]
                k = int(chunk[one[h]])
                if k < 0 or _first_chunk(p, q, edits) == (k, int(place[one[h]])):
                    x.append(p)
                    y.append(q)
                    z.append(int(got[h]))
            if x:
                yield x, y, z


def _alike(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs in parts of like length and bounded size, so that a long name does not widen the rows of short ones."""
    size = np.maximum(length[left], length[right])
    level = np.ceil(np.log2(np.maximum(size, 32))).astype(int)
    for k in np.unique(level).tolist():
        own = np.flatnonzero(level == k)
        step = max((4 * SLICE) >> k, 1)
        for at in range(0, len(own), step):
            part = own[at : at + step]
            yield left[part], right[part]


def letter_bits(name: str) -> int:
    """The letters of a name, each with the number of its occurrence, hashed to 64 bits (as a signed number).

    An insertion or deletion changes one bit at most, a substitution two, an exchange none.
    """
    seen: dict[str, int] = {}
    out = 0
    for c in name:
        k = seen.get(c, 0)
        seen[c] = k + 1
        out |= 1 << (((ord(c) * 0x9E3779B1 + k * 0x85EBCA77) & 0xFFFFFFFF) >> 26)
    return out - (1 << 64) if out >> 63 else out


def _with_bits(names: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            mask = pa.array([letter_bits(x) for x in b.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), mask], ["name", "len", "mask"])

    return names.mapInArrow(run, "name string, len int, mask bigint")


def near_names(indexed: DataFrame, probing: DataFrame, edits: int = 2) -> DataFrame:
    """All pairs of distinct names within ``edits``: (indexed string, probing string, distance int), each pair once.

    Both inputs have a string column ``name``; null and empty names take no part, repeated ones count once, other columns
    are not looked at, empty tables give no pairs. Distance is optimal string alignment over code points. Names of the
    first side are split into chunks, the second side probes with its positional q-grams; both meet in groups by
    (q-gram, place, length), where pairs whose letters differ too much are passed over and the others compared, and a pair is told in the first group that it shares. Names too short
    for 2 * edits + 1 chunks of two characters meet all names of their lengths. Names that are many in one group are
    dealt into units of bounded size, of which each pair of names meets in one. Nothing is broadcast but constant tables;
    a task holds two units' names at most and compares them in bounded slices, long names of any length included.
    """
    if edits < 1:
        raise ValueError("edits must be at least 1")
    spark = indexed.sparkSession
    cap, short = _cap(edits), 2 * (2 * edits + 1)  # names shorter than this have no chunks
    chunks, grams = _probes(spark, edits)
    own = lambda df: df.select(F.col("name").cast("string").alias("name")).filter("name <> ''").distinct().withColumn("len", F.length("name"))
    a, b = _with_bits(own(indexed)), _with_bits(own(probing))

    # the indexed side: chunks at all places and lengths where the other side may hold them; short names by length
    key = lambda gram, at, size, n: F.xxhash64(gram, at, size, n)
    met = a.filter(F.col("len") >= short).withColumn("n", F.least("len", F.lit(cap))).join(F.broadcast(chunks), "n")
    met = met.select("name", "len", "mask", "chunk", "at", key(F.substring("name", F.col("start") + 1, F.col("size")), F.col("at"), F.col("size"), F.col("len") + F.col("more")).alias("key"))
    whole = a.filter(F.col("len") < short).withColumn("other", F.explode(F.sequence(F.col("len") - edits, F.col("len") + edits)))
    whole = whole.select("name", "len", "mask", F.lit(-1).alias("chunk"), F.lit(-1).alias("at"), F.xxhash64(F.lit("short"), "other").alias("key"))
    left = met.unionByName(whole)
    # the probing side
    met = b.withColumn("n", F.least("len", F.lit(cap + edits))).join(F.broadcast(grams), "n")
    met = met.select("name", "len", "mask", key(F.substring("name", F.col("at") + 1, F.col("size")), F.col("at"), F.col("size"), F.col("len")).alias("key"))
    whole = b.filter(F.col("len") < short + edits).select("name", "len", "mask", F.xxhash64(F.lit("short"), "len").alias("key"))
    right = met.unionByName(whole)

    # where a group is large on either side, it is dealt into units; the few counts of such groups come from a share of the names
    some = F.pmod(F.xxhash64("name", F.lit(7)), F.lit(COUNTED)) == 0
    counts = left.filter(some).select("key", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.filter(some).select("key", F.lit(0).alias("l"), F.lit(1).alias("r")))
    counts = counts.groupBy("key").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    parts = lambda c: F.ceil(F.col(c) * COUNTED / UNIT).cast("int")
    large = counts.select("key", F.greatest(parts("l"), F.lit(1)).alias("l"), F.greatest(parts("r"), F.lit(1)).alias("r")).filter("l > 1 or r > 1")

    def dealt(df: DataFrame, mine: str, other: str, me: str, you: str) -> DataFrame:
        got = df.join(large, "key", "left").withColumn(me, F.pmod(F.xxhash64("name"), F.coalesce(mine, F.lit(1))).cast("int"))
        return got.withColumn(you, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))

    kept = ["key", "i", "j", "side", "name", "len", "mask", "chunk", "at"]
    rows = dealt(left, "l", "r", "i", "j").withColumn("side", F.lit(0)).select(kept).unionByName(
        dealt(right, "r", "l", "j", "i").select("key", "i", "j", F.lit(1).alias("side"), "name", "len", "mask", F.lit(-1).alias("chunk"), F.lit(-1).alias("at"))
    )
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")

    def run(batches):
        for t in runs(batches, ["key", "i", "j"]):
            for x, y, z in _compare(t, edits):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()), pa.array(y, pa.string()), pa.array(z, pa.int32())], ["indexed", "probing", "distance"])
        release()

    return rows.mapInArrow(run, "indexed string, probing string, distance int")


def misspelt(name: Column, key: Column) -> Column:
    """``name`` with two neighbouring code points exchanged where the crc32 of the decimal ``key`` is even: those from crc32 mod (length - 1) on."""
    h = F.crc32(key.cast("string").cast("binary"))
    size = F.length(name)
    at = F.pmod(h, F.greatest(size - 1, F.lit(1))).cast("int")
    swapped = F.concat(F.substring(name, F.lit(1), at), F.substring(name, at + 2, F.lit(1)), F.substring(name, at + 1, F.lit(1)), F.substring(name, at + 3, size))
    return F.when((h % 2 == 0) & (size >= 2), swapped).otherwise(name)


def name_matches(clients: DataFrame, vendors: DataFrame, edits: int = 2) -> DataFrame:
    """Per vendor and distance with a match: (vendor_id, distance int, n_clients long, first_client_id long, clients_crc long).

    ``clients`` has (client_id, name), ``vendors`` (vendor_id, name); further columns are not looked at. Rows with null or
    empty names take no part. Clients are summed up by name before they are joined: each row counts, repeated ones and those
    with a null id too (the latter are in no minimum or checksum). Equal rows of ``vendors`` are one vendor; a vendor_id
    with two names has the clients of both.
    """
    c = clients.select(F.col("client_id"), F.col("name").cast("string").alias("name")).filter("name <> ''")
    c = c.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.min("client_id").alias("first"), F.coalesce(F.sum(F.crc32(F.col("client_id").cast("string").cast("binary"))), F.lit(0)).alias("crc")
    )
    v = vendors.select("vendor_id", F.col("name").cast("string").alias("name")).filter("name <> ''").distinct()
    pairs = near_names(v, c, edits)
    sums = lambda n, first, crc: [F.sum(n).alias("n"), F.min(first).alias("first"), F.sum(crc).alias("crc")]
    told = pairs.join(c.withColumnRenamed("name", "probing"), "probing").groupBy("indexed", "distance").agg(*sums("n", "first", "crc"))
    got = v.withColumnRenamed("name", "indexed").join(told, "indexed").groupBy("vendor_id", "distance").agg(*sums("n", "first", "crc"))
    return got.select("vendor_id", "distance", F.col("n").alias("n_clients"), F.col("first").alias("first_client_id"), F.col("crc").alias("clients_crc"))


def op13_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vendors = table(spark, sf_dir, "vendors").withColumn("name", misspelt(F.col("name"), F.col("vendor_id")))
    return name_matches(table(spark, sf_dir, "clients"), vendors)
