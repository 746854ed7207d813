"""Label propagation in turns, as Spark rounds over a whole graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.operators.positions import numbered
from quillmill.storage import drop_materialized, materialize

#: Weights count in units of 1e-15; their sums, exact in any order, are compared rounded to UNITS of them (1e-9).
SCALE, UNITS = 15, 6

_BLOCK = 65_536


def units(sim: Column) -> Column:
    """A similarity (0 to 9,000) as a whole number of 1e-15, so that sums do not depend on their order."""
    return (sim.cast(f"decimal(30,{SCALE})") * F.lit(10**SCALE).cast("decimal(16,0)")).cast("bigint")


def _others(state: DataFrame, wanted: DataFrame) -> DataFrame:
    """(v, label, many): how many nodes hold a label when it is v's turn, for wanted (v, i, label).

    Those who held it before the sweep, and what nodes of smaller ids gained and lost since. The running sums are taken
    in two levels, over blocks of nodes and inside them, so a label that a third of the nodes hold is many tasks'.
    """
    moved = state.filter("cur <> prev")
    step = lambda label, by: moved.select(F.lit(None).cast("bigint").alias("v"), "i", F.col(label).alias("label"), F.lit(by).alias("by"))
    before = state.join(wanted.select(F.col("label").alias("prev")).distinct(), "prev", "left_semi")
    start = before.groupBy(F.col("prev").alias("label")).agg(F.count(F.lit(1)).alias("many"))
    ask = wanted.select("v", "i", "label", F.lit(0).alias("by"))
    rows = step("cur", 1).unionAll(step("prev", -1)).join(wanted.select("label").distinct(), "label", "left_semi").select("v", "i", "label", "by")
    rows = rows.unionAll(ask).withColumn("block", F.expr(f"i div {_BLOCK}"))
    sums = rows.groupBy("label", "block").agg(F.sum("by").alias("by"))
    past = F.coalesce(F.sum("by").over(W.partitionBy("label").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("label", "block", past.alias("past"))
    here = F.sum("by").over(W.partitionBy("label", "block").orderBy("i", F.col("v").isNull()))  # v's own step comes after its question
    got = rows.withColumn("here", here).filter("v is not null").join(offsets, ["label", "block"])
    got = got.join(start, "label", "left")
    return got.select("v", "label", (F.coalesce("many", F.lit(0)) + F.col("past") + F.col("here")).alias("many"))


def _turn(state: DataFrame, arcs: DataFrame, guard: float) -> DataFrame:
    """The state (node, i, prev, cur) after all nodes choose once more, seeing the smaller ones' cur and the larger ones' prev."""
    said = state.select(F.col("node").alias("u"), "prev", "cur")
    weight = (
        arcs.join(said, "u").select("v", F.when(F.col("u") < F.col("v"), F.col("cur")).otherwise(F.col("prev")).alias("label"), "unit")
        .groupBy("v", "label").agg(F.sum(F.col("unit").cast("decimal(20,0)")).alias("w"))
        .select("v", "label", F.round("w", -UNITS).alias("w"))
    )
    own = state.select(F.col("node").alias("v"), "i", F.col("prev").alias("held"))
    weight = weight.join(own, "v")
    top = weight.groupBy("v").agg(F.max("w").alias("top"), F.coalesce(F.max(F.when(F.col("label") == F.col("held"), F.col("w"))), F.lit(0)).alias("mine"))
    top = top.filter(F.col("top").cast("double") > F.lit(guard) * F.col("mine").cast("double")).select("v", "top")
    best = weight.join(top, "v").filter("w = top").select("v", "i", "label")
    several = best.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("label"))
    tied = best.join(several.filter("n > 1").select("v"), "v", "left_semi")
    rarest = _others(state, tied).groupBy("v").agg(F.min(F.struct("many", "label"))["label"].alias("label"))
    chosen = several.filter("n = 1").select("v", "label").unionAll(rarest).select(F.col("v").alias("node"), F.col("label").alias("next"))
    return state.join(chosen, "node", "left").select("node", "i", "prev", F.coalesce("next", "prev").alias("cur"), F.col("cur").alias("was"))


def by_sweeps(edges: DataFrame, rounds: int, guard: float) -> DataFrame:
    """(node, label) after weighted label propagation in order of id over edges (a, b: long, unit: long).

    In a sweep, what a node chooses depends on smaller ids' choices of that sweep and on labels from before it. So the
    choices of a sweep solve a triangular system: starting from the old labels, all nodes choose again together until
    nothing changes, and what is left is what nodes one after another would have chosen. After k steps every node is right
    whose chain of dependences is at most k long; mostly a few steps do, as most choices change nothing for others; a graph
    that is one long chain of changes takes as many steps as it is long. A step is a join and two aggregations over the
    edges that adaptive execution can split; only a count reaches the driver.
    """
    ends = edges.select(F.col("a").alias("node")).unionAll(edges.select("b")).distinct()
    first = numbered(ends, ["node"], "i")
    state = materialize(first.select("node", "i", F.col("node").alias("prev"), F.col("node").alias("cur")), "labels")
    arcs = materialize(edges.select(F.col("a").alias("v"), F.col("b").alias("u"), "unit").unionAll(edges.select("b", "a", "unit")), "arcs")
    for _ in range(rounds):
        while True:
            new = materialize(_turn(state, arcs, guard), "labels")
            drop_materialized(state)
            seen = new.agg(F.expr("count_if(cur <> was) as open"), F.expr("count_if(cur <> prev) as moved")).first()
            state = new
            if not seen["open"]:
                break
        new = materialize(state.select("node", "i", F.col("cur").alias("prev"), "cur"), "labels")
        drop_materialized(state)
        state = new
        if not seen["moved"]:
            break
    drop_materialized(arcs)
    return state.select("node", F.col("cur").alias("label"))
