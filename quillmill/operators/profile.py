"""Reader profiles: folds over reading events, learned thresholds, relatedness, recommendations."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.functions.scalar import days_between, pace, whole_days_since
from quillmill.operators.relational import first_rows, lower_quantile, symmetric


def intervals(df: DataFrame, user: str, at: str, key: str, keep: int = 24) -> DataFrame:
    """Adds days since the user's event before (null for the first); of each user the last ``keep`` events."""
    w = W.partitionBy(user).orderBy(at, key)
    got = df.withColumn("days", F.round(days_between(F.lag(at).over(w), F.col(at)), 2))
    return first_rows(got, [user], [F.desc(at), F.desc(key)], keep)


def learn_thresholds(samples: DataFrame, related: DataFrame, confirmed: DataFrame, user: str = "user", least: int = 6, least_confirmed: int = 3) -> DataFrame:
    """(user, median, warm, review, strength): thresholds that each user's samples support, null where too few.

    samples (user, days): intervals, their upper median sets the pace. related and confirmed (user, score): the
    smaller of their lower quartiles, clipped to 45..60. Quantiles are floor-indexed.
    """
    n = samples.groupBy(user).agg(F.count(F.lit(1)).alias("samples"))
    med = lower_quantile(samples, [user], "days", 0.5).select(user, F.col("quantile").alias("median"))
    warm, review = pace(F.col("median"))
    enough = (F.col("samples") >= least) & F.col("median").isNotNull()
    got = n.join(med, user, "left").select(user, "samples", F.when(enough, F.round("median", 2)).alias("median"), F.when(enough, warm).alias("warm"), F.when(enough, review).alias("review"))
    clipped = F.round(F.greatest(F.lit(45.0), F.least(F.lit(60.0), F.col("quantile"))), 1)
    low = {}
    for name, df, m in (("s1", related, least), ("s2", confirmed, least_confirmed)):
        low[name] = lower_quantile(df, [user], "score", 0.25).filter(F.col("n") >= m).select(user, clipped.alias(name))
    got = got.join(low["s1"], user, "left").join(low["s2"], user, "left")
    return got.select(user, "median", "warm", "review", F.least("s1", "s2").alias("strength"))


def strongest_edge(edges: DataFrame, feedback: str, ignored) -> DataFrame:
    """(node, edge): the strength of each node's best edge that is not ignored."""
    e = edges.filter(~F.col(feedback).eqNullSafe(F.lit(ignored)))
    return symmetric(e, "a", "b").groupBy("node").agg(F.max("strength").alias("edge"))


def overlap_rate(docs: DataFrame, profile: DataFrame) -> DataFrame:
    """(node, rate): the share of the profile's terms that a document (node, term) has; 0 for an empty profile."""
    p = profile.select("term").distinct()
    n = p.agg(F.count(F.lit(1)).alias("n"))
    hit = docs.select("node", "term").distinct().join(p, "term", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("hits"))
    got = docs.select("node").distinct().join(hit, "node", "left").crossJoin(F.broadcast(n))
    return got.select("node", F.coalesce(F.try_divide(F.coalesce("hits", F.lit(0)), F.col("n")), F.lit(0.0)).alias("rate"))


def relatedness(edge: Column, warm: Column, cold: Column, same_cluster: Column, threshold: Column) -> tuple[Column, Column]:
    """(score 0..100, related): the better of the edge and of 50 warm + 50 cold; a shared cluster lifts to the threshold."""
    score = F.greatest(F.round(F.coalesce(edge, F.lit(0.0))), F.round(50 * F.coalesce(warm, F.lit(0.0)) + 50 * F.coalesce(cold, F.lit(0.0))))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    lifted = F.when(same_cluster, F.greatest(score, threshold)).otherwise(score)
    return lifted, same_cluster | (lifted >= threshold)


def hot_profile(events: DataFrame, user: str, at: str, key: str, book: str, kind: str, text: str) -> DataFrame:
    """(user, book, opened, highlights, questions) of each user's last run of events in one book."""
    w = W.partitionBy(user).orderBy(at, key)
    run = F.sum(F.when(F.col(book).eqNullSafe(F.lag(book).over(w)), 0).otherwise(1)).over(w)
    got = events.withColumn("_run", run).withColumn("_last", F.max("_run").over(W.partitionBy(user))).filter("_run = _last")
    some = lambda k: F.count_if(F.col(kind) == k)
    return got.groupBy(user).agg(F.max(book).alias(book), some("view").alias("opened"), some("click").alias("highlights"), some("error").alias("questions"))


class Fold:
    """A reader's warm and cold memory after each archived book; the same code serves batch and stream."""

    def __init__(self, threshold: int = 3, recent: int = 2, interests: int = 10, stop: frozenset[str] = frozenset()):
        self.threshold, self.recent, self.interests, self.stop = threshold, recent, interests, stop

    @staticmethod
    def empty() -> dict:
        return {"count": 0, "recent": [], "themes": {}, "prefs": {}, "interests": []}

    def step(self, state: dict, book, terms: list[str]) -> dict:
        state["recent"] = [b for b in state["recent"] if b != book][-(self.recent - 1) :] + [book] if self.recent > 1 else [book]
        state["count"] += 1
        for t in terms:
            state["themes"][t] = state["themes"].get(t, 0) + 1
        if state["count"] >= self.threshold:
            for t, n in state["themes"].items():  # whole themes each time, as they stand
                state["prefs"][t] = state["prefs"].get(t, 0) + n
            ranked = sorted(state["themes"], key=lambda t: (-state["themes"][t], t))
            state["interests"] += [t for t in ranked[: self.interests] if t not in state["interests"] and t not in self.stop]
        if state["count"] > self.threshold:
            state["recent"] = state["recent"][-1:]
        return state


FOLD_SCHEMA = "user bigint, count bigint, recent string, themes string, prefs string, interests string"


def fold_row(user, s: dict) -> tuple:
    dump = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True)
    return (user, s["count"], dump(s["recent"]), dump(s["themes"]), dump(s["prefs"]), dump(s["interests"]))


def fold_profiles(events: DataFrame, fold: Fold | None = None) -> DataFrame:
    """Folds archive events (user, at, key, book, terms) in order of time into one profile a user.

    The fold is sequential in a user's events, which must fit a task; users are independent.
    """
    fold = fold or Fold()

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        s = fold.empty()
        for r in pdf.sort_values(["at", "key"]).itertuples():
            s = fold.step(s, int(r.book), list(r.terms))
        return pd.DataFrame([fold_row(int(key[0]), s)], columns=[c.split()[0] for c in FOLD_SCHEMA.split(", ")])

    return events.select("user", "at", "key", "book", "terms").groupBy("user").applyInPandas(run, FOLD_SCHEMA)


def refreshed(recent: DataFrame, prefs: DataFrame, manual: DataFrame, themes_top: int = 40, interests_top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(themes (user, term, n), interests (user, term)): themes anew from recent books' terms (user, term), the top
    of the preferences (user, term, score) as interests, and manual ones (user, term) that are still preferred."""
    n = recent.groupBy("user", "term").agg(F.count(F.lit(1)).alias("n"))
    themes = first_rows(n, ["user"], [F.desc("n"), F.col("term")], themes_top)
    top = first_rows(prefs, ["user"], [F.desc("score"), F.col("term")], interests_top).select("user", "term")
    return themes, top.unionByName(manual.join(prefs, ["user", "term"], "left_semi").select("user", "term")).distinct()


def due(at: Column, now: Column, review_days: Column) -> tuple[Column, Column]:
    days = whole_days_since(at, now)
    return F.greatest(F.lit(0), days), days >= review_days


