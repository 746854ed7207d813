"""Components, clusters and their names; knowledge graphs inside and across documents."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.functions.text import is_theorem
from quillmill.operators.propagation import UNITS, by_sweeps, units
from quillmill.operators.relational import first_rows, small, symmetric
from quillmill.storage import drop_materialized, materialize


#: Edges that a task links at once, and nodes whose links it holds, about.
LINKED_AT_ONCE, LINKED_NODES = 500_000, 2_000_000


def linked(v: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (v, m) as stars: each node but the smallest of what hangs together here, with that smallest one."""
    node, at = np.unique(np.concatenate([v, m]), return_inverse=True)
    x, y, low = at[: len(v)], at[len(v) :], np.arange(len(node))
    while True:
        p, q = low[x], low[y]
        open_ = p != q
        if not open_.any():
            break
        x, y, p, q = x[open_], y[open_], p[open_], q[open_]
        np.minimum.at(low, np.maximum(p, q), np.minimum(p, q))
        while (low[low] != low).any():
            low = low[low]
    moved = np.flatnonzero(low != np.arange(len(node)))
    return node[moved], node[low[moved]]


def local_stars(edges: DataFrame) -> DataFrame:
    """Edges (v, m: long) with the same components: each task's own as stars, so at most a row for a node and task, however many edges."""

    def run(batches):
        held, n = [], 0
        stars = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        for b in batches:
            held.append((np.asarray(b["v"]), np.asarray(b["m"])))
            n += b.num_rows
            if n >= LINKED_AT_ONCE:
                stars = linked(*(np.concatenate(x) for x in zip(stars, *held, strict=True)))
                held, n = [], 0
                if len(stars[0]) > LINKED_NODES:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars], ["v", "m"])
                    stars = (stars[0][:0], stars[1][:0])
        stars = linked(*(np.concatenate(x) for x in zip(stars, *held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars], ["v", "m"])

    return edges.mapInArrow(run, "v bigint, m bigint")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long), as (node, component) with the smallest node of each.

    Alternating large-star and small-star steps (Kiveris et al. 2014). Each round is two partial aggregations and
    two joins that adaptive execution can split on a hot key; no group is collected and nothing but a count and a
    checksum reaches the driver. Each round's edges are written to the shared folder, which cuts the lineage. Before
    the rounds each task turns its own edges into stars, so that the rounds' rows grow with the nodes, not the edges.
    Nodes without edges are not returned.
    """
    down = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).filter("v <> m")
    cur = materialize((local_stars(down) if {k for _, k in down.dtypes} == {"bigint"} else down).distinct(), "cc")

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(v, m))")).first())

    seen = mark(cur)
    while seen[0]:
        both = cur.select(F.col("v").alias("u"), F.col("m").alias("w")).unionAll(cur.select("m", "v"))
        low = both.groupBy("u").agg(F.min("w").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = (
            both.filter("w > u").join(low, "u").select(F.col("w").alias("v"), F.col("low").alias("m")).distinct()
        )
        down = large.groupBy("v").agg(F.min("m").alias("low"))
        pairs = large.join(down, "v")
        small = pairs.select("v", F.col("low").alias("m")).unionAll(
            pairs.filter("m <> low").select(F.col("m").alias("v"), F.col("low").alias("m"))
        )
        new = materialize(small.distinct(), "cc")
        drop_materialized(cur)
        cur, before, seen = new, seen, mark(new)
        if seen == before:
            break
    roots = cur.select("v", "m")
    return roots.select(F.col("v").alias("node"), F.col("m").alias("component")).unionAll(
        roots.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct()
    )


def clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, cluster) of all nodes, those without edges in a cluster of their own; made once for all that read it."""
    comp = components(edges)
    return materialize(nodes.join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("cluster")), "clusters")


def edges_inside(member: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges whose ends are of one cluster, with it. They are not shuffled while the members, two numbers a node, may be broadcast."""
    a, b = member.select(F.col("node").alias("a"), F.col("cluster").alias("cluster")), member.select(F.col("node").alias("b"), F.col("cluster").alias("_cb"))
    return edges.join(small(a), "a").join(small(b), "b").filter("cluster = _cb").drop("_cb")


def inner_similarity(member: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster, n, mean): mean similarity over all pairs of a cluster, absent pairs 0, 1 for a single member."""
    n = member.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    inside = edges_inside(member, edges).groupBy("cluster").agg(F.sum("sim").alias("s"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    mean = F.when(F.col("n") == 1, 1.0).otherwise(F.coalesce("s", F.lit(0.0)) / pairs)
    return n.join(inside, "cluster", "left").select("cluster", "n", mean.alias("mean"))


def bloat_factor(member: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (worst, factor): the largest share of hubs among clusters of 4 or more, and the factor it asks for.

    A hub is linked to at least 0.6 of the others. Below 30 nodes the factor is 0.8; else 1.2 beyond a share of 0.3,
    1.0 beyond 0.15, 0.8 otherwise.
    """
    ends = edges_inside(member, edges).select(F.explode(F.array("a", "b")).alias("node"))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    size = member.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"))
    hubs = member.join(degree, "node", "left").join(size, "cluster").filter("m >= 4")
    hubs = hubs.groupBy("cluster").agg(F.avg((F.coalesce("d", F.lit(0)) >= 0.6 * (F.col("m") - 1)).cast("double")).alias("share"))
    worst = hubs.agg(F.coalesce(F.max("share"), F.lit(0.0)).alias("worst"))
    total = member.agg(F.count(F.lit(1)).alias("total"))
    factor = F.when(F.col("total") < 30, 0.8).when(F.col("worst") > 0.3, 1.2).when(F.col("worst") > 0.15, 1.0).otherwise(0.8)
    return worst.crossJoin(total).select("worst", factor.alias("factor"))


def split_bloated(member: DataFrame, edges: DataFrame, tau: float, factor: float) -> DataFrame:
    """Clusters of 4 or more whose mean similarity is under tau * factor fall apart at 1.5 tau, if they do."""
    loose = inner_similarity(member, edges).filter((F.col("n") >= 4) & (F.col("mean") < tau * factor)).select("cluster")
    part = member.join(loose, "cluster", "left_semi")
    keep = part.select(F.col("node").alias("a"), F.col("cluster").alias("ca"))
    other = part.select(F.col("node").alias("b"), F.col("cluster").alias("cb"))
    strong = edges.filter(F.col("sim") + 1e-9 >= 1.5 * tau).join(keep, "a").join(other, "b").filter("ca = cb").select("a", "b")
    again = clusters(part.select("node"), strong).withColumnRenamed("cluster", "new")
    return member.join(again, "node", "left").select("node", F.coalesce("new", "cluster").alias("cluster"))


def by_component(rows: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """``rows`` with the ``component`` of their ``node`` (long) under ``edges`` (a, b); nodes without edges are their own."""
    comp = components(edges).select(F.col("node").alias("_node"), "component")
    return rows.join(comp, rows[node] == comp["_node"], "left").drop("_node").withColumn("component", F.coalesce("component", F.col(node)))


def merge_fragments(member: DataFrame, base: DataFrame, edges: DataFrame, tau: float) -> DataFrame:
    """Single nodes that a split left over join the cluster of their most similar node, if that is near enough.

    In order of id, one after the other: a fragment that another one has joined is no single node any more and stays.
    Only fragments that pick each other, directly or by others, depend on that order; each such group is gone through
    by one task, which holds three numbers a fragment.
    """
    size = member.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    was = base.groupBy("cluster").agg(F.count(F.lit(1)).alias("n0")).join(base, "cluster").select("node", "n0")
    alone = member.join(size.filter("n = 1"), "cluster").join(was.filter("n0 >= 2"), "node").select("node")
    near = symmetric(edges, "a", "b").join(alone, "node").filter(F.col("sim") >= 0.8 * tau)
    best = first_rows(near, ["node"], [F.desc("sim"), F.col("other")]).select("node", "other")
    best = best.join(member.select(F.col("node").alias("other"), F.col("cluster").alias("to")), "other")
    best = materialize(best.select("node", "other", "to"), "fragments")
    linked = best.join(best.select(F.col("node").alias("other")), "other", "left_semi").select(F.col("node").alias("a"), F.col("other").alias("b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        where = dict(zip(pdf["node"], pdf["node"], strict=True))
        joined: set[int] = set()
        for node, other, to in zip(pdf["node"], pdf["other"], pdf["to"], strict=True):
            if node not in joined:
                where[node] = where.get(other, to)
                joined.add(where[node])
        return pd.DataFrame({"node": list(where), "new": list(where.values())})

    moved = by_component(best, "node", linked).groupBy("component").applyInPandas(run, "node long, new long")
    return member.join(moved, "node", "left").select("node", F.coalesce("new", "cluster").alias("cluster"))


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 10, guard: float = 1.05, task_edges: int = 500_000) -> DataFrame:
    """(node, cluster) by weighted label propagation over edges (a, b, sim); a cluster is named by its smallest node.

    Nodes take turns in order of id and see what those before them did; a node changes to the label of largest weight
    around it, of equal ones to the rarest, then the smallest, only if that beats its own label's weight by ``guard``.
    Weights are sums of similarities (0 to 9,000), exact in any order, compared to nine decimals. Components of at most
    ``task_edges`` edges are a task's each; larger ones are swept together by Spark rounds (``propagation.by_sweeps``), with the
    same result. Edges of a node to itself count for nothing, repeated ones add up, edges with nulls are left out.
    """
    e = materialize(edges.filter("a <> b and sim is not null").select("a", "b", units(F.col("sim")).alias("unit")), "weighted")
    comp = materialize(components(e), "components")
    parts = e.join(comp.withColumnRenamed("node", "a"), "a").select("component", "a", "b", "unit")
    large = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > task_edges).select("component")
    large = materialize(large, "large")
    step = 10**UNITS

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        around: dict[int, list[tuple[int, int]]] = {}
        for a, b, s in zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["unit"].tolist(), strict=True):
            around.setdefault(a, []).append((b, s))
            around.setdefault(b, []).append((a, s))
        order = sorted(around)
        label = {v: v for v in order}
        many = Counter(label.values())
        for _ in range(rounds):
            still = True
            for v in order:
                sums: dict[int, int] = {}
                for u, s in around[v]:
                    sums[label[u]] = sums.get(label[u], 0) + s
                weight = {c: (w + step // 2) // step for c, w in sums.items()}
                best = min(weight, key=lambda c: (-weight[c], many[c], c))
                if float(weight[best] * step) > guard * float(weight.get(label[v], 0) * step):
                    many[label[v]] -= 1
                    many[best] += 1
                    label[v] = best
                    still = False
            if still:
                break
        return pd.DataFrame({"node": order, "label": [label[v] for v in order]})

    got = parts.join(large, "component", "left_anti").groupBy("component").applyInPandas(run, "node bigint, label bigint")
    if not large.isEmpty():
        got = got.unionAll(by_sweeps(parts.join(large, "component", "left_semi").select("a", "b", "unit"), rounds, guard))
    least = got.groupBy("label").agg(F.min("node").alias("cluster"))
    got = got.join(least, "label").select("node", "cluster")
    return nodes.join(got, "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster"))


def name_clusters(member: DataFrame, candidates: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(cluster, name): lexicon terms first, then the term of most members, then of most weight, then by name.

    member (node, cluster), candidates (node, term, w), lexicon (term).
    """
    got = candidates.join(member, "node").groupBy("cluster", "term").agg(F.count_distinct("node").alias("cover"), F.sum("w").alias("w"))
    got = got.join(lexicon.select("term", F.lit(1).alias("known")), "term", "left")
    order = [F.coalesce("known", F.lit(0)).desc(), F.desc("cover"), F.desc(F.round("w", 6)), F.col("term")]
    return first_rows(got, ["cluster"], order).select("cluster", F.col("term").alias("name"))


def cascade(nodes: DataFrame, posted: DataFrame, tag: DataFrame, folder: DataFrame, auto: DataFrame, rest: str) -> DataFrame:
    """(node, cluster, source): a valid posted label, else the first tag, the folder, the automatic cluster, ``rest``."""
    got = nodes
    names = ("post", "tag", "folder", "pre")
    for name, df in zip(names, (posted, tag, folder, auto), strict=True):
        got = got.join(df.select("node", F.col("label").alias(name)), "node", "left")
    ok = [F.when(F.col(n) != "", F.col(n)) for n in names]
    source = F.coalesce(*[F.when(o.isNotNull(), F.lit(n)) for o, n in zip(ok, names, strict=True)], F.lit("pre"))
    return got.select("node", F.coalesce(*ok, F.lit(rest)).alias("cluster"), source.alias("source"))


def posterior(books: DataFrame, features: DataFrame, least: int = 3) -> DataFrame:
    """(node, cluster): a book stays if it shares ``least`` terms with the rest of its cluster, else goes to the other
    cluster with which it shares most, if that is ``least`` or more, else stays; without a cluster, its first term.

    books (node, cluster), features (node, term, rank). Ties between clusters go to the smaller name.
    """
    features, books = materialize(features, "features"), materialize(books, "books")  # read several times each
    f = features.select("node", "term").filter("node is not null and term is not null").distinct()
    of = f.join(books.select("node", "cluster"), "node").filter("cluster <> ''")
    # a cluster has a term of others if another node of it has the term; so many nodes a cluster and term, not all pairs of nodes
    has = of.groupBy("term", F.col("cluster").alias("c")).agg(F.count_distinct("node").alias("nodes"))
    inside = of.select("node", "term", F.col("cluster").alias("c"), F.lit(1).alias("me")).distinct()
    hit = f.join(has, "term").join(inside, ["node", "term", "c"], "left").filter(F.col("nodes") > F.coalesce("me", F.lit(0)))
    overlap = hit.groupBy("node", "c").agg(F.count(F.lit(1)).alias("n"))
    own = overlap.join(books, "node").filter("c = cluster").select("node", F.col("n").alias("own"))
    best = first_rows(overlap.join(books, "node").filter("c <> cluster and n >= " + str(least)), ["node"], [F.desc("n"), F.col("c")])
    first = first_rows(features, ["node"], [F.col("rank")]).select("node", F.col("term").alias("first"))
    got = books.join(own, "node", "left").join(best.select("node", F.col("c").alias("best"), "n"), "node", "left").join(first, "node", "left")
    stay = F.coalesce("own", F.lit(0)) >= least
    move = F.col("best").isNotNull() & (F.col("n") > F.coalesce("own", F.lit(0)))
    return got.select("node", F.when(stay, F.col("cluster")).when(move, F.col("best")).when(F.col("cluster") != "", F.col("cluster")).otherwise(F.coalesce("first", F.lit(""))).alias("cluster"))


def overlapping(sets: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of items a < b that share at least ``least`` keys; sets (i, k), each row once.

    Prefix filter: with the keys of each item from the rarest to the most common, items that share ``least`` keys also
    share one that is not among the last ``least`` - 1 of either, so the most common keys bring no pairs together.
    Candidates' whole sets are compared.
    """
    many = sets.groupBy("k").agg(F.count(F.lit(1)).alias("df"))
    own = sets.join(many, "k").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("df", "k"))).alias("ks")).filter(F.size("ks") >= least)
    own = materialize(own.select("i", F.transform("ks", lambda x: x["k"]).alias("ks")), "overlap")
    front = own.select("i", F.explode(F.slice("ks", F.lit(1), F.size("ks") - (least - 1))).alias("k"))
    a, b = front.alias("a"), front.alias("b")
    pairs = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.i") < F.col("b.i"))).select(F.col("a.i").alias("a"), F.col("b.i").alias("b")).distinct()
    both = pairs.join(own.select(F.col("i").alias("a"), F.col("ks").alias("x")), "a").join(own.select(F.col("i").alias("b"), F.col("ks").alias("y")), "b")
    return both.filter(F.size(F.array_intersect("x", "y")) >= least).select("a", "b")


#: Of the most common keys of a set so many are tried, ``least`` at a time, to join sets without meeting in pairs.
COMMON = 8


def joined_by_common(sets: DataFrame, least: int) -> DataFrame:
    """(node, component) of items that share ``least`` of their ``COMMON`` most common keys, directly or by others; sets (i, k).

    Some of the links that ``overlapping`` finds, in rows that grow with the items, not with their pairs: every choice of
    ``least`` of an item's most common keys is a row (56 for 5 of 8), and items of one choice are linked to the smallest.
    """
    many = sets.groupBy("k").agg(F.count(F.lit(1)).alias("df"))
    own = sets.join(many, "k").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("df", "k"))).alias("ks")).filter(F.size("ks") >= least)
    top = own.select("i", F.transform(F.slice("ks", F.greatest(F.lit(1), F.size("ks") - (COMMON - 1)), F.lit(COMMON)), lambda x: x["k"]).alias("ks"))
    picks = F.array(*[F.when(F.size("ks") > max(c), F.array(*[F.get("ks", F.lit(j)) for j in c])) for c in combinations(range(max(COMMON, least)), least)])
    rows = materialize(top.select("i", F.explode(picks).alias("pick")).filter("pick is not null"), "picks")
    low = rows.groupBy("pick").agg(F.min("i").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("pick", "b")
    return components(rows.join(low, "pick").select(F.col("i").alias("a"), "b").filter("a <> b").distinct())


def merge_in_order(size: list[int], terms: list[set], least: int) -> list[int]:
    """Where each cluster ends: the first two clusters, in order, that share ``least`` terms merge, then again.

    The larger of the two (the first on ties) takes the other's terms. Once a cluster has none to merge with, only clusters that
    grow can bring it one, so nothing starts again: a merged cluster is compared with all others at once, by counts over the
    clusters of its terms that are kept for the last few that grew, and that only its new terms add to.
    """
    size, has = list(size), [set(x) for x in terms]
    n, held = len(size), {}
    for c, x in enumerate(has):
        for t in x:
            held.setdefault(t, []).append(c)
    held = {t: np.array(x, dtype=np.int64) for t, x in held.items()}
    alive, end = np.ones(n, dtype=bool), list(range(n))
    kept: dict[int, np.ndarray] = {}

    def shared(c: int) -> np.ndarray:
        if c not in kept:
            counts = np.zeros(n, dtype=np.int32)
            for t in has[c]:
                counts[held[t]] += 1
            if len(kept) >= 8:
                del kept[next(iter(kept))]
            kept[c] = counts
        return kept[c]

    def partner(c: int, since: int) -> int | None:
        """The first living cluster from ``since`` on, but ``c``, that shares enough with it."""
        ok = (shared(c)[since:] >= least) & alive[since:]
        if c >= since:
            ok[c - since] = False
        k = int(ok.argmax()) if len(ok) else 0
        return since + k if len(ok) and ok[k] else None

    at = 0
    while at < n:
        other = partner(at, at + 1) if alive[at] else None
        a = at
        if other is None:
            at += 1
            continue
        while other is not None:
            main, sub = (a, other) if size[a] >= size[other] else (other, a)
            size[main] += size[sub]
            alive[sub], end[sub] = False, main
            kept.pop(sub, None)
            fresh, has[sub] = has[sub] - has[main], set()
            counts = kept.pop(main, None)
            for t in fresh:
                if counts is not None:
                    counts[held[t]] += 1
                held[t] = np.append(held[t][alive[held[t]]], main)
                for c, x in kept.items():
                    if t in has[c]:
                        x[main] += 1
            has[main] |= fresh
            if counts is not None:
                kept[main] = counts  # the last to be given up
            # those before ``at`` had none to merge with, so a pair that one of them is in now is of the one that grew
            met = partner(main, 0)
            a, other = (at, None) if met is None or min(met, main) >= at else (min(met, main), max(met, main))
    for c in reversed(range(n)):
        while end[c] != end[end[c]]:
            end[c] = end[end[c]]
    return end


def merge_clusters(books: DataFrame, features: DataFrame, least: int = 5) -> DataFrame:
    """(cluster, merged): where each cluster ends, when clusters that share ``least`` terms merge one pair at a time.

    Clusters come in order of their smallest book; the first pair in that order merges, the larger side keeps its
    name (the first on ties) and its place, with the terms of both; then again. What can ever merge is found without any
    order first: groups that share ``least`` terms are joined and their terms united, as Spark rounds, until no two groups
    share so many; the first round only joins those that share their most common terms, which takes no pairs. A cluster's
    terms, whatever it has taken in, are among its group's, so clusters of two groups never merge, and each group goes
    through the rule by itself, in a task that holds its clusters' terms; a group is those that overlaps chain together,
    not all that have a word in common. Nothing reaches the driver.
    """
    of = materialize(features.join(books, "node").select("cluster", "term").distinct(), "merge")
    heads = materialize(books.groupBy("cluster").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), "merge")
    group = heads.select("cluster", F.col("first").alias("g"))
    common = True
    while True:
        sets = of.join(group, "cluster").select(F.col("g").alias("i"), F.col("term").alias("k")).distinct()
        sets = materialize(sets, "sets")
        if common:
            comp, common = joined_by_common(sets, least), False
        else:
            pairs = materialize(overlapping(sets, least), "merge")
            if pairs.isEmpty():
                break
            comp = components(pairs)
        group = materialize(group.join(comp, F.col("g") == F.col("node"), "left").select("cluster", F.coalesce("component", "g").alias("g")), "merge")
    size = group.groupBy("g").agg(F.count(F.lit(1)).alias("m"))
    inside = heads.join(group, "cluster").join(size, "g")
    alone = inside.filter("m = 1").select("cluster", F.col("cluster").alias("merged"))
    terms = of.groupBy("cluster").agg(F.collect_list("term").alias("terms"))
    rows = inside.filter("m > 1").join(terms, "cluster", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first")
        names = pdf["cluster"].tolist()
        end = merge_in_order(pdf["n"].tolist(), [set() if t is None else set(t) for t in pdf["terms"]], least)
        return pd.DataFrame({"cluster": names, "merged": [names[c] for c in end]})

    return alone.unionByName(rows.groupBy("g").applyInPandas(run, "cluster string, merged string"))


def rename_clusters(named: DataFrame, counts: DataFrame, preferred: DataFrame) -> DataFrame:
    """(old, new) names: each cluster's most common term, preferred terms first; a name that is taken stays free.

    named (cluster), counts (cluster, term, n), preferred (term). Names are given in order of the old ones; that order
    only counts among clusters whose old and new names are joined by others', so each such group is one task's.
    """
    known = counts.join(preferred.select("term", F.lit(1).alias("k")), "term", "left")
    top = first_rows(known, ["cluster"], [F.coalesce("k", F.lit(0)).desc(), F.desc("n"), F.col("term")]).select("cluster", "term")
    wish = named.select("cluster").distinct().join(top, "cluster", "left").select(F.col("cluster").alias("old"), F.coalesce("term", "cluster").alias("new"))
    wish = materialize(wish.withColumn("node", F.xxhash64("old")), "wish")  # read by the edges, from both ends, and by the renaming
    edges = wish.select(F.col("node").alias("a"), F.xxhash64("new").alias("b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(pdf["old"]), []
        for old, new in sorted(zip(pdf["old"], pdf["new"], strict=True)):
            if new not in taken:
                taken.discard(old)
                taken.add(new)
                out.append((old, new))
        return pd.DataFrame(out, columns=["old", "new"])

    return by_component(wish, "node", edges).groupBy("component").applyInPandas(run, "old string, new string")


def orientation(directed: Column, source: Column, a: Column, b: Column) -> Column:
    """'a->b' or 'b->a' if the edge is directed and starts at one of its ends, else 'a-b'."""
    return F.when(directed & (source == a), "a->b").when(directed & (source == b), "b->a").otherwise("a-b")


#: Line ends and white space at the ends of lines, as text editors see them, beyond ASCII too.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
EDGE_SPACE = r"^[\s\u001c-\u001f\u0085   -     　]+|[\s\u001c-\u001f\u0085   -     　]+$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_SPACE, "")


def inner_nodes(chapters: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc, level, chapter, pos, title, summary, importance): chapters, theorem lines and the reader's own notes as nodes.

    chapters (doc, chapter, title, text, words), notes (doc, chapter, note, quote, text, kind). A chapter without a title is
    named by its number, one without words counts 2 instead of 4; theorem lines and notes count 5. A theorem line's position
    is its number, from 1, among its chapter's lines; a note's its id. Notes without quote, text and kind are passed over.
    """
    text = F.coalesce("text", F.lit(""))
    named = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.format_string("Chapter %s", "chapter"))
    c = chapters.select(
        "doc", F.lit("chapter").alias("level"), "chapter", F.lit(None).cast("long").alias("pos"), F.left(stripped(named), F.lit(200)).alias("title"),
        F.left(stripped(text), F.lit(200)).alias("summary"), F.when(F.col("words") > 0, 4).otherwise(2).alias("importance"),
    )
    lines = chapters.select("doc", "chapter", F.posexplode(F.split(text, LINE_END, -1)).alias("p", "line")).withColumn("line", stripped(F.col("line")))
    t = lines.filter((F.length("line") > 8) & is_theorem(F.col("line"))).select(
        "doc", F.lit("theorem").alias("level"), "chapter", (F.col("p") + 1).cast("long").alias("pos"), F.left("line", F.lit(50)).alias("title"),
        F.left("line", F.lit(300)).alias("summary"), F.lit(5).alias("importance"),
    )
    first = lambda *names: F.coalesce(*[F.when(F.col(k) != "", F.col(k)) for k in names], F.lit(""))
    n = notes.select(
        "doc", F.lit("note").alias("level"), "chapter", F.col("note").cast("long").alias("pos"), F.left(stripped(first("quote", "text", "kind")), F.lit(50)).alias("title"),
        F.left(first("text", "quote"), F.lit(300)).alias("summary"), F.lit(5).alias("importance"),
    )
    return c.unionByName(t).unionByName(n.filter("title <> ''"))


def inner_edges(nodes: DataFrame) -> DataFrame:
    """(doc, level, chapter, a, b, strength): each chapter to the next one, 60; each theorem line to the next of its chapter, 50."""
    c = nodes.filter("level = 'chapter'").withColumn("b", F.lead("chapter").over(W.partitionBy("doc").orderBy("chapter")))
    c = c.select("doc", "level", "chapter", F.col("chapter").alias("a"), "b", F.lit(60).alias("strength"))
    t = nodes.filter("level = 'theorem'").withColumn("b", F.lead("pos").over(W.partitionBy("doc", "chapter").orderBy("pos")))
    t = t.select("doc", "level", "chapter", F.col("pos").alias("a"), "b", F.lit(50).alias("strength"))
    return c.unionByName(t).filter("b is not null")


#: Questions whose terms all tasks hold as one dictionary: so many terms at most, some tens of bytes each.
DICTIONARY = 200_000


def appears_in_texts(source: DataFrame, texts: DataFrame, hits: DataFrame, most_points: int = 10, most_hits: int = 5) -> DataFrame:
    """``appears_in`` for few questions over many texts: texts (doc, points: an array of distinct terms for each point).

    A text is matched where it lies, against a dictionary of all questions' terms that is broadcast up to DICTIONARY terms;
    nothing is a row of its own but a question that a text answers. Entries, summed up by question and document first,
    come to the texts as one array a document, of a row a question at most. More questions go by equi-joins on terms.
    """
    s = source.select("src", F.col("doc").alias("own"), "term").distinct()
    found = s.limit(DICTIONARY + 1).toArrow()
    if found.num_rows > DICTIONARY:
        points = texts.select("doc", F.posexplode("points").alias("point", "terms")).select("doc", "point", F.explode("terms").alias("term"))
        return appears_in(source, points, hits, most_points, most_hits)
    table = found.to_pandas().drop_duplicates().sort_values(["src", "own", "term"])
    asks = table[["src", "own"]].drop_duplicates().reset_index(drop=True)
    asks["k"] = range(len(asks))
    terms = sorted(table["term"].unique())
    number = {t: k for k, t in enumerate(terms)}
    table = table.merge(asks, on=["src", "own"])
    table["t"] = table["term"].map(number)
    table = table.sort_values(["t", "k"])
    starts = np.searchsorted(table["t"].to_numpy(), np.arange(len(terms) + 1))
    shared = texts.sparkSession.sparkContext.broadcast((asks["src"].tolist(), asks["own"].to_numpy(), terms, starts, table["k"].to_numpy(dtype=np.int64)))

    e = hits.join(small(s), "term").filter("doc <> own").groupBy("doc", "src", "own")
    e = e.agg(F.count_distinct("entry").alias("n"), F.collect_set("term").alias("terms"))
    e = e.groupBy("doc").agg(F.collect_list(F.struct("src", "own", "n", "terms")).alias("entries"))
    both = texts.select("doc", "points").join(e, "doc", "full")
    kinds = dict(both.dtypes)
    src_kind = dict(source.dtypes)["src"]

    def run(batches):
        srcs, own, terms, starts, of = shared.value
        known = pa.array(terms, pa.string())
        ask = {x: k for k, x in enumerate(zip(srcs, own.tolist(), strict=True))}
        width, wide = max(len(terms), 1), max(len(srcs), 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                docs, points = b["doc"], pc.fill_null(b["points"], [])
                if isinstance(points, pa.ChunkedArray):
                    points = points.combine_chunks()
                lines = points.flatten()
                row = np.repeat(np.arange(b.num_rows), np.asarray(pc.list_value_length(points)))  # of each line
                line = np.repeat(np.arange(len(lines)), np.asarray(pc.list_value_length(lines).fill_null(0)))  # of each word
                got = pc.index_in(lines.flatten(), value_set=known)
                hit = np.flatnonzero(np.asarray(got.is_valid()))
                t = np.asarray(got.take(pa.array(hit))).astype(np.int64)
                many = starts[t + 1] - starts[t]
                k = of[np.arange(int(many.sum())) + np.repeat(starts[t] - np.r_[0, np.cumsum(many)[:-1]].astype(np.int64), many)] if len(t) else t
                ln, t = np.repeat(line[hit], many), np.repeat(t, many)
                r = row[ln] if len(ln) else ln
                if len(r):
                    ok = np.asarray(docs.take(pa.array(r)))[:] != own[k]
                    r, k, ln, t = r[ok], k[ok], ln[ok], t[ok]
                ask_of = r * wide + k
                point = np.unique(ask_of * max(len(lines), 1) + ln) // max(len(lines), 1)
                pk, pn = np.unique(point, return_counts=True)
                pairs, counts = [ask_of * width + t], {}
                for n, items in enumerate(b["entries"].to_pylist()):
                    for x in items or ():
                        key = n * wide + ask[x["src"], x["own"]]
                        counts[key] = x["n"]
                        pairs.append(key * width + np.array([number_of(terms, y) for y in x["terms"]], dtype=np.int64))
                pairs = np.unique(np.concatenate(pairs))
                key = pairs // width
                cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
                ends = np.r_[cuts[1:], len(key)].astype(np.int64) if len(key) else cuts
                key = key[cuts]
                if not len(key):
                    continue
                points_of = dict(zip(pk.tolist(), pn.tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([srcs[x] for x in (key % wide).tolist()]).cast(kind_of[0]), docs.take(pa.array(key // wide)), pa.array(ends - cuts, pa.int64()),
                        pa.array([[terms[y] for y in (pairs[a : min(z, a + 6)] % width).tolist()] for a, z in zip(cuts.tolist(), ends.tolist(), strict=True)], pa.list_(pa.string())),
                        pa.array([min(points_of.get(x, 0), most_points) for x in key.tolist()], pa.int64()),
                        pa.array([min(counts.get(x, 0), most_hits) for x in key.tolist()], pa.int64()),
                    ],
                    ["src", "doc", "matched", "common", "points", "entries"],
                )

    kind_of = [found.schema.field("src").type]
    return both.mapInArrow(run, f"src {src_kind}, doc {kinds['doc']}, matched bigint, common array<string>, points bigint, entries bigint")


def number_of(terms: list[str], term: str) -> int:
    return bisect_left(terms, term)


def appears_in(source: DataFrame, points: DataFrame, hits: DataFrame, most_points: int = 10, most_hits: int = 5) -> DataFrame:
    """Which other documents a knowledge point appears in.

    source (src, doc, term), points (doc, point, term) and hits (doc, entry, term) are postings; probes are equi-joins
    on the term. (src, doc, matched, common: the first six shared terms, points, entries), best first.
    """
    s = source.select("src", F.col("doc").alias("own"), "term").distinct()
    p = points.join(s, "term").filter("doc <> own").select("src", "doc", "point", "term").distinct()
    e = hits.join(s, "term").filter("doc <> own").select("src", "doc", "entry", "term").distinct()
    pp = first_rows(p.groupBy("src", "doc", "point").agg(F.count(F.lit(1)).alias("n")), ["src", "doc"], [F.desc("n"), F.col("point")], most_points)
    ee = first_rows(e.groupBy("src", "doc", "entry").agg(F.count(F.lit(1)).alias("n")), ["src", "doc"], [F.desc("n"), F.col("entry")], most_hits)
    both = p.select("src", "doc", "term").unionByName(e.select("src", "doc", "term")).distinct()
    total = both.groupBy("src", "doc").agg(F.count(F.lit(1)).alias("matched"), F.slice(F.array_sort(F.collect_list("term")), 1, 6).alias("common"))
    pc = pp.groupBy("src", "doc").agg(F.count(F.lit(1)).alias("points"))
    ec = ee.groupBy("src", "doc").agg(F.count(F.lit(1)).alias("entries"))
    got = total.join(pc, ["src", "doc"], "left").join(ec, ["src", "doc"], "left")
    return got.select("src", "doc", "matched", "common", F.coalesce("points", F.lit(0)).alias("points"), F.coalesce("entries", F.lit(0)).alias("entries"))


def link_stubs(edges: DataFrame, feedback: str, ignored: str, least: float = 50, keep: int = 20) -> DataFrame:
    """(node, other, strength): what each node's list of linked ones holds after edges (a, b, strength, at) came in order of ``at``.

    Strong edges that are not ignored are noted at both ends, with strengths of one decimal; one that comes again with the
    strength it has changes nothing, with another one it moves to the end; a list keeps its last ``keep`` entries. (One that
    had dropped out and comes again unchanged stays out.)
    """
    e = edges.filter((F.col("strength") >= least) & ~F.col(feedback).eqNullSafe(F.lit(ignored)))
    both = symmetric(e, "a", "b").withColumn("strength", F.round("strength", 1))
    before = F.lag("strength").over(W.partitionBy("node", "other").orderBy("at"))
    changed = both.withColumn("_was", before).filter(~F.col("strength").eqNullSafe(F.col("_was")))
    last = changed.groupBy("node", "other").agg(F.max(F.struct("at", "strength")).alias("x"))
    return first_rows(last.select("node", "other", "x.*"), ["node"], [F.desc("at"), F.col("other")], keep).select("node", "other", "strength")


def fingerprint(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """16 hex digits that change when a set of rows does: an order-free sum of row digests, hashed.

    A sum of row hashes aggregates partially, where one sorted list of all rows would meet in a task.
    """
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    part = [F.sum(F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]
    got = df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *part)
    text = F.concat_ws(":", F.col("n").cast("string"), *[F.col(f"s{k}").cast("string") for k in range(4)])
    return got.select(*(by or []), "n", F.left(F.sha2(text, 256), F.lit(16)).alias("fingerprint"))
