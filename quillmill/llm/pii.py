"""Operator 7: personal data by base patterns and bootstrapped contextual extraction, in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import materialize, table
from quillmill.llm.spans import blocks, gaps_and_hits, let, located, word_left

KINDS = ("email", "ip", "card", "phone")
#: The base patterns with possessive loops, which Java's engine runs without recursion. A match can only start where
#: a run of its first characters starts, or where the last match ended, so long runs cost no more than their length.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Words with a digit or an at sign: what contextual patterns are made of, and what they may discover.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    parts = F.split(F.reverse(digits), "")
    worth = F.transform(
        F.filter(parts, lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int")),
    )
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return hit.rlike(_OCTETS)
    d = _digits(hit)
    if kind == "card":
        return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)
    return F.length(d).between(9, 15)


def _base_of(kind: str, k: int, gaps: Column, hits: Column) -> Column:
    valid = F.filter(located(gaps, hits), lambda s: _valid(kind, s["hit"]))
    return F.transform(valid, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end")))


def _count(spans: str, k: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["k"] == k)).cast("long")


def base_spans(text: Column, hits: dict[str, tuple[Column, Column]]) -> Column:
    """The valid base matches as an array of (start, k: the kind's number, end), sorted."""
    found = []
    for k, kind in enumerate(KINDS):
        found.append(_base_of(kind, k, *hits[kind]))
    return F.array_sort(F.concat(*found))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def _shape(word: Column) -> Column:
    for a, b in (("[0-9]+", "9"), (r"\p{Lu}+", "A"), (r"[\p{L}&&[^A]]+", "a")):
        word = F.regexp_replace(word, a, b)
    return word


def extract(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = 3,
    support: int = 5,
    confidence: float = 0.9,
) -> DataFrame:
    """Personal data in whole texts: (id, base, spans), arrays of (start, k, end) by start and kind, a row per row.

    ``base`` holds the valid matches of the four base patterns, in code points. They seed the bootstrap: every word
    with a digit or at sign is an instance, however short, and the whole word before it (numbers alike; empty at the
    text's start) with its own shape (digits, upper and lower case runs) is a pattern that it occurs in. Over the corpus's pattern-instance graph scores pass back and forth for
    ``rounds``: a pattern's confidence is the smoothed mean score of its distinct instances, an instance's score one
    minus the product of its patterns' doubts, seeds staying at 1. Patterns with ``support`` distinct seeds and at
    least ``confidence`` name the kind most of their seeds have; the instances they meet that no base span touches
    are added to ``spans``. Base spans always stay.

    All is DataFrame code: one pass over the texts writes spans and instances to the shared folder, the graph is
    summed from partial aggregates, joins are equi-joins that adaptive execution splits when a pattern is hot.
    Null texts count as empty. Null ids are kept, repeated rows are rows of their own (seeds count once a word).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    has = F.col("t").rlike("[0-9@]")
    gates = {"email": F.contains("t", F.lit("@")), "ip": F.col("t").rlike(r"[0-9]\.[0-9]"), "card": F.col("t").rlike("[0-9][ -]?[0-9]"), "phone": F.col("t").rlike(r"\+[0-9]")}
    cols = []
    for kind in KINDS:
        g, h = gaps_and_hits(F.col("t"), PATTERNS[kind], gates[kind])
        cols += [g.alias(f"{kind}_g"), h.alias(f"{kind}_h")]
    g, h = gaps_and_hits(F.col("t"), CANDIDATE, has)
    cut = src.select("id", *cols, g.alias("word_g"), h.alias("word_h"))
    hits = {k: (F.col(f"{k}_g"), F.col(f"{k}_h")) for k in KINDS}
    placed = cut.select("id", base_spans(F.col("t"), hits).alias("base"), located(F.col("word_g"), F.col("word_h"), word_left).alias("words"))

    trimmed = lambda w: F.regexp_replace(w, r"^[^0-9\p{L}@+]+|[^0-9\p{L}]+$", "")

    def near(block: Column, base: Column) -> Column:
        low, high = F.get(block, F.lit(0))["start"], F.element_at(block, -1)["end"]
        return F.struct(block.alias("ws"), F.filter(base, lambda s: (s["start"] < high) & (s["end"] > low)).alias("base"))

    def of_block(z: Column) -> Column:
        return F.transform(
            z["ws"],
            lambda w: F.struct(
                w["start"].alias("start"), w["end"].alias("end"), trimmed(w["hit"]).alias("word"),
                (w["start"] + F.length(F.regexp_extract(w["hit"], r"^[^0-9\p{L}@+]*", 0))).alias("from"),
                F.regexp_replace(F.lower(w["left"]), "[0-9]+", "9").alias("before"),
                F.get(F.filter(z["base"], lambda s: (s["start"] < w["end"]) & (s["end"] > w["start"])), F.lit(0))["k"].alias("k"),
            ),
        )

    def marked(z: Column) -> Column:
        return F.flatten(F.transform(F.transform(let(z["words"], blocks), lambda b: near(b, z["base"])), of_block))

    both = let(F.struct("base", "words"), lambda z: F.struct(z["base"].alias("base"), marked(z).alias("words")))
    kept = materialize(placed.select(F.monotonically_increasing_id().alias("row"), "id", both.alias("z")).select("row", "id", "z.base", "z.words"), "pii")
    each = kept.filter(F.size("words") > 0).select("row", F.explode("words").alias("w")).select("row", "w.*")
    each = each.withColumn("shape", _shape(F.col("word")))
    edges = each.groupBy("before", "shape", "word").agg(F.max("k").alias("k"))
    edges = materialize(edges, "pii")
    seeds = edges.groupBy("word").agg(F.max("k").alias("seed"))
    graph = edges.join(seeds, "word").select("before", "shape", "word", F.col("seed").alias("k"), F.when(F.col("seed").isNotNull(), 1.0).otherwise(0.0).alias("s"))
    for _ in range(rounds):
        patterns = graph.groupBy("before", "shape").agg((F.sum("s") / (F.count(F.lit(1)) + 1)).alias("c"), F.count("k").alias("seeds"))
        trusted = patterns.filter(F.col("seeds") >= support).select("before", "shape", "c")
        open_ = graph.filter("k is null").join(trusted, ["before", "shape"])
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1.0) - F.col("c"), F.lit(1e-9)))))
        scores = open_.groupBy("word").agg((F.lit(1.0) - doubt).alias("new"))
        graph = graph.join(scores, "word", "left").select("before", "shape", "word", "k", F.when(F.col("k").isNotNull(), 1.0).otherwise(F.coalesce("new", F.lit(0.0))).alias("s"))
        graph = materialize(graph, "pii")
    votes = graph.groupBy("before", "shape").agg(
        (F.sum("s") / (F.count(F.lit(1)) + 1)).alias("c"), F.count("k").alias("seeds"),
        *[F.count_if(F.col("k") == k).alias(f"k{k}") for k in range(len(KINDS))],
    )
    best = F.greatest(*[F.struct(F.col(f"k{k}").alias("n"), F.lit(-k).alias("k")) for k in range(len(KINDS))])["k"]
    sure = votes.filter((F.col("seeds") >= support) & (F.col("c") >= confidence)).select("before", "shape", (-best).alias("kind"))
    news = each.filter("k is null").join(sure, ["before", "shape"])
    span = F.struct(F.col("from").cast("int").alias("start"), F.col("kind").cast("int").alias("k"), (F.col("from") + F.length("word")).cast("int").alias("end"))
    added = news.groupBy("row").agg(F.collect_set(span).alias("added"))
    empty = F.array().cast("array<struct<start:int,k:int,end:int>>")
    out = kept.select("row", "id", "base").join(added, "row", "left")
    return out.select("id", "base", F.array_sort(F.concat("base", F.coalesce("added", empty))).alias("spans"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "documents"))
    counts = [_count("base", k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
