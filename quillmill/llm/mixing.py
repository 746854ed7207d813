"""Operator 6: mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.llm.common import WORD, materialize, packed, shuffle_partitions, table, unpacked

#: Documents of a source in one window of the running sum, about.
WINDOW_ROWS = 50_000
#: What the queue of all sources is put in order by: the finish time, then what tells copies of one time apart.
ORDER = ("finish", "source", "r", "id", "k1", "k2", "copy")
#: Rows that a group of equal ones gives back at a time.
CHUNK = 1000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source.

    Sources in code point order, null last, take the weights in turn and share ``share`` of all sizes. A target
    stops at ``cap`` times its source's size and the excess is dealt again by weight until none is above. The final
    shares are weight * level below the cap, where the level solves sum(min(cap * size, weight * level)) = total;
    the level is read off the sources sorted by cap * size / weight with running sums, not by repeated passes.
    """
    # by the bytes of UTF-8, which is code point order
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    ws = F.array(*[F.lit(float(x)) for x in weights])
    s = sizes.withColumn("k", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.get(ws, F.pmod("k", F.lit(len(weights)))))
    s = s.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("at", F.col("most") / F.col("weight"))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    up = W.orderBy("at", "k")
    s = s.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
    # with the sources before this one at their caps, the level that the rest would share
    s = s.withColumn("capped", F.coalesce(F.sum("most").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(up.rowsBetween(W.currentRow, W.unboundedFollowing)))
    s = s.withColumn("try", (F.col("total") - F.col("capped")) / F.col("open"))
    s = s.withColumn("level", F.min(F.when(F.col("try") <= F.col("at"), F.struct("at", "k", "try"))).over(everything)["try"])
    target = F.least("most", F.coalesce(F.col("weight") * F.col("level"), F.col("most")))
    return s.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def row_keys(docs: DataFrame) -> tuple[Column, Column]:
    """128 bits that stand for a row with all its columns (a map or a variant by its JSON): rows that agree in them count as equal."""
    kinds = dict(docs.dtypes)
    every = [F.to_json(F.col(f"`{c}`")) if "map<" in kinds[c] or kinds[c] == "variant" else F.col(f"`{c}`") for c in docs.columns]
    return F.xxhash64(*every), F.xxhash64(F.lit(1), *reversed(every))


def turn(row_id: Column, k1: Column, number: Column, seed: int) -> Column:
    """Where a row stands in its source's queue: shuffled by id, content and number among equal rows, so that neither a
    repeated nor a null id puts many rows in one place."""
    return F.xxhash64(row_id.cast("string"), k1, number.cast("long"), F.lit(seed))


def _numbered(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """(id, source, size, k1, k2, r), a row per row: equal rows are counted by partition, and only the counts are numbered on."""
    k1, k2 = row_keys(docs)
    src = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"),
        k1.alias("k1"), k2.alias("k2"), F.spark_partition_id().alias("p"),
    )
    same = ["id", "source", "size", "k1", "k2"]
    c = src.groupBy(*same, "p").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy(*same).orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    c = c.withColumn("from", F.coalesce(F.sum("n").over(before), F.lit(0)))
    each = c.select(*same, F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1)).alias("number"))
    return each.select(*same, turn(F.col("id"), F.col("k1"), F.col("number"), seed).alias("r"))


def _queue(
    docs: DataFrame, weights: Sequence[float], share: float, cap: float, id_col: str, text_col: str, source_col: str, seed: int
) -> DataFrame:
    """``mix`` with the keys of the rows: (id, source, size, k1, k2, source_size, target, times)."""
    sized = materialize(_numbered(docs, id_col, text_col, source_col, seed), "mix")
    n = sized.count()
    width = max(1, n // WINDOW_ROWS + 1)
    width = 1 << max(4, (max(4 * width, 4 * shuffle_partitions(docs.sparkSession)) - 1).bit_length())
    sized = sized.withColumn("bucket", F.shiftrightunsigned("r", 64 - (width.bit_length() - 1)))
    per_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    goals = targets(per_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offset = per_bucket.select(
        F.col("source").alias("s2"), F.col("bucket").alias("b2"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset")
    )
    goals = goals.withColumnRenamed("source", "s3")
    offset = offset.join(goals, F.col("s2").eqNullSafe(F.col("s3")))
    inside = W.partitionBy("source", "bucket").orderBy("r", "id", "k1", "k2").rowsBetween(W.unboundedPreceding, 0)
    queue = sized.withColumn("run", F.sum("size").over(inside))
    queue = queue.join(offset, (F.col("bucket") == F.col("b2")) & F.col("source").eqNullSafe(F.col("s2")))
    queue = queue.withColumn("cum", F.col("run") + F.col("offset")).drop("s2", "b2", "s3", "offset", "run", "bucket")
    queue = materialize(queue, "mix")
    # as decimals, whose sum does not depend on the order
    budget = queue.select("source", "target").distinct().agg(F.sum(F.col("target").cast("decimal(38,9)"))).first()[0] or 0
    copies = [F.struct(F.lit(e).alias("copy"), ((F.col("cum") + F.lit(e) * F.col("source_size")) / F.col("target")).alias("finish")) for e in range(int(cap))]
    live = queue.filter("size > 0 and target > 0")
    own = ["id", "source", "r", "k1", "k2", "size"]
    each = live.select(*own, F.explode(F.array(*copies)).alias("c")).select(*own, "c.*")
    parts = shuffle_partitions(docs.sparkSession)
    line = materialize(each.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER).withColumn("part", F.spark_partition_id()), "mix")
    got, cut = 0, None
    for part, words in sorted(map(tuple, line.groupBy("part").agg(F.sum("size")).collect())):
        if got + words > budget:
            cut = part
            break
        got += words
    taken = F.lit(0)
    if cut is None:
        last, behind = None, F.lit(False)
    else:
        inside = line.filter(F.col("part") == cut)
        run = F.sum("size").over(W.orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0))
        first = inside.withColumn("words", run).filter(F.col("words") > F.lit(float(budget - got)))
        last = first.agg(F.min(F.struct(*ORDER))).first()[0]  # the first copy that is beyond the budget
    for c in copies:
        if last is not None:
            place = F.struct(c["finish"].alias("finish"), "source", "r", "id", "k1", "k2", c["copy"].alias("copy"))
            kinds = dict(line.dtypes)
            behind = place >= F.struct(*[F.lit(last[k]).cast(kinds[k]).alias(k) for k in ORDER])
        taken = taken + F.when((F.col("size") > 0) & (F.col("target") > 0) & ~behind, 1).otherwise(0)
    return queue.withColumn("times", taken.cast("int"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    cap: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 6,
) -> DataFrame:
    """How often the mix takes each document: (id, source, size, source_size, target, times, taken), a row per row.

    Weighted fair queueing. A source's documents are shuffled by a hash and queue up to ``cap`` times;
    copy e of a document finishes at virtual time (words of the source up to and with it) / target. All copies are
    taken in the order of finish time until their words reach the total budget, the sum of the targets, so each
    source's words come within a document of its target and reruns agree.

    Running sums are taken in two levels (a sum per source and hash bucket, then within a bucket), so no task holds
    a whole source, however large. The copies, as rows of numbers without texts, are range-sorted over all partitions;
    the sums of the ranges, one row a partition, tell in which one the budget ends, and a running sum inside that one
    finds the last copy that is taken. What is not behind it in the order is taken.

    Null and blank texts have size 0 and are taken 0 times; a null source is a source of its own; a source of size 0
    has target 0. Rows of one id, null or not, are documents of their own, each with its place in the queue by a hash
    of all its columns, and equal rows by their number among their likes: many rows of one id do not meet in one task.
    Columns may have any name. Empty table: empty.
    """
    out = _queue(docs, weights, share, cap, id_col, text_col, source_col, seed)
    return out.select("id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).cast("long").alias("taken"))


def mixed_rows(
    docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 6,
) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``mix`` takes it, so their words are the sum of ``taken``.

    Rows are found again by id and a hash of all their columns. Of equal rows one is kept and given as often as all of
    them are taken, in pieces of bounded size. Null ids, repeated rows, empty tables and other columns are as for ``mix``.
    """
    plan = _queue(docs, weights, share, cap, id_col, text_col, source_col, seed)
    how = plan.groupBy("id", "k1", "k2").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("rows")).filter("times > 0")
    k1, k2 = row_keys(docs)
    src = packed(docs, i=F.col(f"`{id_col}`"), x=k1, y=k2)
    got = src.join(how, F.col("i").eqNullSafe(F.col("id")) & (F.col("x") == F.col("k1")) & (F.col("y") == F.col("k2")))
    got = got.select("row", "i", "x", "y", "rows", "times")
    once = got.filter("rows = 1").select("row", "times")
    many = got.filter("rows > 1").dropDuplicates(["i", "x", "y"])
    piece = F.explode(F.sequence(F.lit(0), F.ceil(F.col("times") / CHUNK).cast("int") - 1))
    deals = how.filter("rows > 1").select(F.col("id").alias("i2"), F.col("k1").alias("x2"), F.col("k2").alias("y2"), "times", piece.alias("d"))
    deals = deals.select("i2", "x2", "y2", F.least(F.lit(CHUNK), F.col("times") - F.col("d") * CHUNK).alias("share"))
    many = many.join(deals, F.col("i").eqNullSafe(F.col("i2")) & (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2")))
    every = once.unionByName(many.select("row", F.col("share").alias("times")))
    return unpacked(every.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))), docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
