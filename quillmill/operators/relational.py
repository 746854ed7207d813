"""Filters, joins, dedup, upserts and retention: the relational core."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.storage import materialize

#: A side of at most so many bytes, as Spark estimates it, may be broadcast by hint.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a side for broadcast if the optimizer's size estimate is within ``limit``; else leaves the choice to Spark."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


# -- predicates --------------------------------------------------------------------------------------------------


def matches_any(columns: Sequence[str], query: str) -> Column:
    """Case-insensitive LIKE %query% over several columns; % and _ in the query stay wildcards."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.ilike(F.col(c), F.lit(f"%{query}%")), F.lit(False))
    return out


def not_marked(mark: Column, value) -> Column:
    """True where the mark differs from value or is null, which != alone would drop."""
    return ~mark.eqNullSafe(F.lit(value))


def touches(a: str, b: str, value) -> Column:
    return (F.col(a) == value) | (F.col(b) == value)


def where_given(df: DataFrame, **equal) -> DataFrame:
    """Adds col = value for each argument that is not None."""
    for c, v in equal.items():
        if v is not None:
            df = df.filter(F.col(c) == v)
    return df


def clip(x: Column, low, high) -> Column:
    """max(low, min(high, x)); null stays null, where greatest and least would skip it."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def apply_patch(df: DataFrame, patch: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Sets, of the patched columns, those named in patch._set; a named null is set, an unnamed value is left."""
    p = patch.select(key, F.col("_set"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    got = df.join(p, key, "left")
    new = {c: F.when(F.coalesce(F.array_contains("_set", c), F.lit(False)), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    return got.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


# -- pairs -------------------------------------------------------------------------------------------------------


def ordered_pair(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def symmetric(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each edge from both ends: node and other, with the edge's columns."""
    one = edges.withColumn("node", F.col(a)).withColumn("other", F.col(b))
    return one.unionByName(edges.withColumn("node", F.col(b)).withColumn("other", F.col(a)))


#: Rows of a key that meet as one unit; a key of more is cut into chunks, each pair of which is a unit of its own.
CHUNK = 2048


#: Pairs that a task brings together or counts, about; more pairs are more tasks, whatever the size of the rows they come from.
TASK_PAIRS = 2_000_000


def pair_tasks(sizes: DataFrame, n: str = "_n") -> int:
    """How many tasks the pairs of groups of ``n`` rows are worth."""
    pairs = sizes.agg(F.sum(F.col(n).cast("double") * (F.col(n) - 1) / 2)).first()[0]
    return int((pairs or 0) // TASK_PAIRS) + 1


def _meeting(df: DataFrame, item: str, key: str, chunk: int = CHUNK) -> tuple[DataFrame, int]:
    """All pairs of rows that share a key, as structs (x, y): each unordered pair of rows with different items once, and the number of tasks.

    A key's rows are dealt by their item's hash into chunks of about ``chunk`` rows; two chunks meet in a unit of their
    own, so a key that most rows have is many units of bounded size, over as many tasks. Keys of one row, null keys and
    null items bring nothing together. The number of tasks follows the number of pairs, which is counted first: rows are few
    bytes where their pairs are many, so adaptive execution, which sees the rows, would put too many into one task.
    """
    df = materialize(df.filter(F.col(item).isNotNull() & F.col(key).isNotNull()), "met")  # read by the sizes and by both sides
    sizes = df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("_k"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    sizes = materialize(sizes, "sizes")
    tasks = pair_tasks(sizes)
    dealt = df.join(sizes.select(key, "_k"), key).withColumn("_c", F.pmod(F.xxhash64(item), F.col("_k").cast("bigint")).cast("int"))
    row = F.struct(*df.columns)
    left = dealt.select(F.col(key).alias("_key"), row.alias("x"), F.col("_c").alias("_i"), F.explode(F.sequence("_c", F.col("_k") - 1)).alias("_j"))
    right = dealt.select(F.col(key).alias("_key"), row.alias("y"), F.explode(F.sequence(F.lit(0), F.col("_c"))).alias("_i"), F.col("_c").alias("_j"))
    x, y = F.col("x").getField(item), F.col("y").getField(item)
    unit = ["_key", "_i", "_j"]
    got = left.repartition(tasks, *unit).join(right.repartition(tasks, *unit), unit)
    return got.filter((x < y) | ((F.col("_i") < F.col("_j")) & (x != y))).select("x", "y"), tasks


def meeting(df: DataFrame, item: str, key: str, chunk: int = CHUNK) -> DataFrame:
    """All pairs of rows that share a key: structs (x, y), each unordered pair of rows with different items once, x's item the smaller."""
    x, y = F.col("x").getField(item), F.col("y").getField(item)
    got = _meeting(df, item, key, chunk)[0]
    return got.select(F.when(x < y, F.col("x")).otherwise(F.col("y")).alias("x"), F.when(x < y, F.col("y")).otherwise(F.col("x")).alias("y"))


#: Rows that a task tells apart or puts in lists, about.
TASK_ROWS = 400_000


def shared_key_pairs(df: DataFrame, item: str, key: str | Column, least: int = 1, where: Callable[[Column, Column], Column] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Pairs a < b of items that share at least ``least`` distinct keys: (a, b, shared).

    A key's items are lists of at most some CHUNK; a pair of lists is a unit. What is shuffled for the pairs is a row for an item
    and a list it meets, with the larger items in it, not a row a pair; pairs are counted at their smaller item, by as many tasks
    as their number asks for, an item of too many pairs by several. Repeated rows are told apart and lists made by tasks of
    TASK_ROWS rows, whatever the size of the files: a partial aggregation would hold all of a file's rows first. ``where`` is a
    condition on two structs of i and the ``carry`` columns (functions of the item), for pairs that count, either way round.
    """
    key = F.col(key) if isinstance(key, str) else key
    rows = df.select(F.col(item).alias("i"), key.alias("k"), *carry).filter("i is not null and k is not null")
    parts = rows.count() // TASK_ROWS + 1
    met = materialize(rows.repartition(parts, "i", "k").distinct(), "met")
    sizes = met.select("k").repartition(parts, "k").groupBy("k").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    sizes = materialize(sizes, "sizes")
    tasks = pair_tasks(sizes)
    hot = small(materialize(sizes.filter(F.col("_n") > CHUNK).select("k", F.ceil(F.col("_n") / F.lit(CHUNK)).cast("int").alias("_k")), "hot"))
    dealt = met.join(hot, "k", "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    dealt = dealt.withColumn("_c", F.pmod(F.xxhash64("i"), F.col("_k").cast("bigint")).cast("int")).repartition(parts, "k", "_c")
    lists = dealt.groupBy("k", "_c", "_k").agg(F.sort_array(F.collect_list(F.struct("i", *carry))).alias("xs"))
    lists = materialize(lists.filter((F.size("xs") > 1) | (F.col("_k") > 1)), "lists")

    met_by = lists.select(F.explode("xs.i").alias("a"), F.when(F.col("_k") == 1, F.size("xs")).otherwise(F.col("_k") * CHUNK).alias("n"))
    busy = met_by.repartition(parts, "a").groupBy("a").agg(F.sum("n").alias("n")).filter(F.col("n") > TASK_PAIRS)
    busy = small(materialize(busy.select("a", F.ceil(F.col("n") / TASK_PAIRS).cast("int").alias("_p")), "busy"))

    def after(x: Column, ys: Column) -> Column:
        """The items of a list that x is to be counted with."""
        return F.transform(ys if where is None else F.filter(ys, lambda y: where(x, y)), lambda y: y["i"])

    # a list with itself: sorted, so each item with those behind it; two lists of a key: each item with the larger ones of the other
    spread = lists.repartition(tasks, "k", "_c")  # a task of the files would write, and hold for that, the pairs of all their lists
    if where is None:
        own = spread.select(F.col("xs.i").alias("is")).select("is", F.posexplode("is").alias("_at", "a")).select("a", F.slice("is", F.col("_at") + 2, F.size("is")).alias("bs"))
    else:
        own = spread.select("xs", F.posexplode("xs").alias("_at", "x")).select("x", F.slice("xs", F.col("_at") + 2, F.size("xs")).alias("ys"))
        own = own.select(F.col("x.i").alias("a"), after(F.col("x"), F.col("ys")).alias("bs"))
    cut = lists.filter("_k > 1")
    left = cut.filter(F.col("_c") < F.col("_k") - 1).select("k", "xs", F.col("_c").alias("_i"), F.explode(F.sequence(F.col("_c") + 1, F.col("_k") - 1)).alias("_j"))
    right = cut.filter("_c > 0").select("k", F.col("xs").alias("ys"), F.explode(F.sequence(F.lit(0), F.col("_c") - 1)).alias("_i"), F.col("_c").alias("_j"))
    two = left.repartition(tasks, "k", "_i", "_j").join(right.repartition(tasks, "k", "_i", "_j"), ["k", "_i", "_j"])
    two = two.select(F.explode(F.array(F.struct("xs", "ys"), F.struct(F.col("ys").alias("xs"), F.col("xs").alias("ys")))).alias("u"))
    two = two.select(F.explode("u.xs").alias("x"), F.col("u.ys").alias("ys")).select("x", F.filter("ys", lambda y: y["i"] > F.col("x.i")).alias("ys"))
    each = own.unionByName(two.select(F.col("x.i").alias("a"), after(F.col("x"), F.col("ys")).alias("bs"))).filter(F.size("bs") > 0)
    each = each.join(busy, "a", "left").withColumn("_p", F.coalesce("_p", F.lit(1))).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)))
    part = F.filter("bs", lambda b: F.pmod(F.xxhash64(b), F.col("_p").cast("bigint")) == F.col("_s"))
    each = each.select("a", "_s", F.when(F.col("_p") == 1, F.col("bs")).otherwise(part).alias("bs")).repartition(tasks, "a", "_s")
    pairs = each.select("a", "_s", F.explode("bs").alias("b")).groupBy("a", "_s", "b").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.filter(F.col("shared") >= least).select("a", "b", "shared")


# -- rows per group ----------------------------------------------------------------------------------------------


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each group in an order; Spark limits groups before and after the shuffle."""
    w = W.partitionBy(*by).orderBy(*order) if by else W.orderBy(*order)
    got = df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n)
    return got.withColumnRenamed("_rank", rank) if rank else got.drop("_rank")


def running_budget(df: DataFrame, by: Sequence[str], order: Sequence[Column], size: Column, budget: int, rows: int) -> DataFrame:
    """At most ``rows`` rows of each group, the first always, the others while their sizes' sum is in budget."""
    w = W.partitionBy(*by).orderBy(*order)
    got = df.withColumn("_rank", F.row_number().over(w)).withColumn("_sum", F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return got.filter((F.col("_rank") <= rows) & ((F.col("_rank") == 1) | (F.col("_sum") <= budget))).drop("_rank", "_sum")


def lower_quantile(df: DataFrame, by: Sequence[str], value: str, q: float) -> DataFrame:
    """sorted[min(n - 1, floor(n * q))] of each group: floor-indexed, unlike percentile_disc."""
    w = W.partitionBy(*by).orderBy(value)
    n = F.count(value).over(W.partitionBy(*by))
    got = df.filter(F.col(value).isNotNull()).withColumn("_at", F.row_number().over(w) - 1).withColumn("_n", n)
    at = F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(q)))
    return got.filter(F.col("_at") == at).select(*by, F.col(value).alias("quantile"), F.col("_n").alias("n"))


# -- snapshots ---------------------------------------------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Latest wins: new rows replace old ones of equal key; of several new rows the first in ``order``."""
    latest = first_rows(new, key, order)
    return old.join(latest.select(*key), list(key), "left_anti").unionByName(latest)


def changed_only(old: DataFrame, new: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The rows of ``new`` that are not in ``old`` or differ there in one of ``columns``, nulls comparing equal."""
    o = old.select(*key, *[F.col(c).alias(f"_old_{c}") for c in columns], F.lit(True).alias("_there"))
    same = F.col("_there").isNotNull()
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    return new.join(o, list(key), "left").filter(~same).select(*new.columns)


def without(df: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.join(gone.select(*key).distinct(), list(key), "left_anti")


def subtree(nodes: DataFrame, root, node: str = "node", parent: str = "parent", depth: int = 64) -> DataFrame:
    """A node and its descendants with their depth, by a recursive query; ``depth`` guards against cycles."""
    spark = nodes.sparkSession
    nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent")).createOrReplaceTempView("_quillmill_tree")
    value = f"'{root}'" if isinstance(root, str) else str(root)
    return spark.sql(
        f"""
        WITH RECURSIVE walk AS (
          SELECT node, 0 AS depth FROM _quillmill_tree WHERE node = {value}
          UNION ALL
          SELECT t.node, w.depth + 1 FROM walk w JOIN _quillmill_tree t ON t.parent = w.node WHERE w.depth < {depth}
        )
        SELECT node, min(depth) AS depth FROM walk GROUP BY node
        """
    )
