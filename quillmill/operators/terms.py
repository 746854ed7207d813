"""Terms and their weights."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import terms
from quillmill.operators.relational import first_rows


def term_counts(df: DataFrame, by: Sequence[str], text: str | Column, top: int = 200) -> DataFrame:
    """(by, term, n): how often each term occurs in a piece of text, the ``top`` most frequent ones, ties by term."""
    text = F.col(text) if isinstance(text, str) else text
    got = df.select(*by, F.explode(terms(text)).alias("term")).groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n"))
    return first_rows(got, by, [F.desc("n"), F.col("term")], top)


def first_seen_counts(df: DataFrame, by: Sequence[str], text: str, top: int = 200) -> DataFrame:
    """(by, term, n, seen): as ``term_counts``, but terms that are equally frequent keep the order in which they occur."""
    got = df.select(*by, F.posexplode(terms(F.col(text))).alias("p", "term")).groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("seen"))
    return first_rows(got, by, [F.desc("n"), F.col("seen")], top)


#: Words that ``row_counts`` tells apart at once, about.
WORDS = 1_000_000


def row_counts(words: Column, top: int = 200) -> Column:
    """array<(term, n)>: how often each word of a row's array occurs, the ``top`` most frequent ones, ties by term.

    Words of many rows are numbered in their order and counted as numbers, WORDS at a time; only the terms that stay become strings.
    """

    @F.arrow_udf("array<struct<term:string,n:bigint>>")
    def run(v: pa.Array) -> pa.Array:
        many = np.asarray(pc.list_value_length(v).fill_null(0)).astype(np.int64)
        end, k, got = np.cumsum(many), 0, []
        while k < len(v) or not got:
            j = max(k + 1, int(np.searchsorted(end, (end[k - 1] if k else 0) + WORDS, "right")))
            got.append(_counted(v[k:j], many[k:j], top))
            k = j
        return pa.concat_arrays(got)

    return run(words)


def _counted(v: pa.Array, many: np.ndarray, top: int) -> pa.Array:
    code = v.flatten().dictionary_encode()
    order = np.asarray(pc.sort_indices(code.dictionary)).astype(np.int64)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    key = np.repeat(np.arange(len(v)) * len(order), many) + place[np.asarray(code.indices)]
    key.sort()
    at = np.flatnonzero(np.diff(key, prepend=-1))
    n = np.diff(np.append(at, len(key)))
    terms, most = max(len(order), 1), int(n.max(initial=0)) + 1
    row, term = np.divmod(key[at], terms)
    each = np.bincount(row, minlength=len(v))
    first = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each) < top  # in a row, of those in order
    if float(len(v)) * most * terms < 2.0**62:
        best = np.sort((row * most + (most - n)) * terms + term)[first]
        n, term = most - best // terms % most, best % terms
    else:
        best = np.lexsort((term, -n, row))[first]
        n, term = n[best], term[best]
    ends = np.concatenate([[0], np.cumsum(np.minimum(each, top))])
    flat = pa.StructArray.from_arrays([code.dictionary.take(pa.array(order[term])).cast(pa.string()), pa.array(n)], ["term", "n"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def weighted_terms(pieces: DataFrame, doc: str, text: str, weight: str, top_piece: int = 200, top: int = 80) -> DataFrame:
    """(doc, term, w, rank): weighted sums over a document's pieces, each cut to its top terms before weighting.

    A row is a piece, so pieces are counted where they lie and only their top terms are shuffled, summed in part before. Null
    texts have no terms; a repeated row is a piece of its own.
    """
    counts = pieces.select(doc, weight, F.explode(row_counts(terms(F.col(text)), top_piece)).alias("c"))
    sums = counts.groupBy(doc, F.col("c.term").alias("term")).agg(F.sum(F.col("c.n") * F.col(weight)).alias("w"))
    return first_rows(sums, [doc], [F.desc("w"), F.col("term")], top, rank="rank")


def fold_aliases(df: DataFrame, by: Sequence[str], term: str, weight: str, aliases: DataFrame) -> DataFrame:
    """Weights summed by canonical term; aliases (alias in lower case, canonical) match whole terms in any case."""
    a = aliases.select(F.lower("alias").alias("_a"), F.col("canonical").alias("_c"))
    got = df.join(a, F.lower(F.col(term)) == F.col("_a"), "left")
    return got.groupBy(*by, F.coalesce("_c", term).alias(term)).agg(F.sum(weight).alias(weight))


#: A lexicon of so many terms at most is one automaton that every worker holds; some hundred bytes a term.
AUTOMATON = 1_000_000
#: What a term that is not Han may not touch.
_INSIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789-")


def lexicon_hits(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """(key, term): distinct lexicon terms in each row's text; Han terms as substrings, others at word bounds in any case.

    Each text is gone through once, by an Aho-Corasick automaton of the lexicon (term), whatever number of terms it has; bounds are
    looked at where there is a hit. Null texts and empty terms hit nothing. The lexicon is broadcast up to AUTOMATON terms and
    joined condition by condition beyond.
    """
    from quillmill.functions.text import HAN

    lex = lexicon.select("term").filter("term <> ''").distinct().select("term", F.col("term").rlike(f"[{HAN}]").alias("han"), F.lower("term").alias("low"))
    found = lex.limit(AUTOMATON + 1).toArrow()
    if found.num_rows > AUTOMATON:
        bounded = F.concat(F.lit(r"(?<![a-z0-9\-])\Q"), "low", F.lit(r"\E(?![a-z0-9\-])"))
        hit = F.when(F.col("han"), F.contains(F.col(text), F.col("term"))).otherwise(F.contains(F.lower(F.col(text)), F.col("low")) & F.rlike(F.lower(F.col(text)), bounded))
        return df.select(key, text).join(lex, hit).select(key, "term")
    shared = df.sparkSession.sparkContext.broadcast(found.to_pylist())

    def run(batches):
        import ahocorasick

        han, other = ahocorasick.Automaton(), ahocorasick.Automaton()
        for r in shared.value:
            form = r["term"] if r["han"] else r["low"]
            a = han if r["han"] else other
            a.add_word(form, (len(form), [*(a.get(form)[1] if form in a else []), r["term"]]))
        for a in (han, other):
            a.make_automaton()
        for b in batches:
            rows, terms = [], []
            for k, (x, low) in enumerate(zip(b["text"], b["low"], strict=True)):
                if (x := x.as_py()) is None:
                    continue
                got = set()
                if len(han):
                    for _, (_, own) in han.iter(x):
                        got.update(own)
                if len(other):
                    low = low.as_py()
                    for end, (size, own) in other.iter(low):
                        if (end - size < 0 or low[end - size] not in _INSIDE) and (end + 1 == len(low) or low[end + 1] not in _INSIDE):
                            got.update(own)
                rows += [k] * len(got)
                terms += sorted(got)
            yield pa.RecordBatch.from_arrays([b["key"].take(pa.array(rows, pa.int64())), pa.array(terms, pa.string())], ["key", "term"])

    src = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.lower(text).alias("low"))
    return src.mapInArrow(run, f"key {dict(src.dtypes)['key']}, term string").select(F.col("key").alias(key), "term")


def preferences(df: DataFrame, doc: str, text: str, per_doc: int = 15, top: int = 60, sink: int = 2) -> tuple[DataFrame, DataFrame]:
    """(term, score) summed over each document's top terms, and the terms that ``sink`` documents or more share."""
    per = term_counts(df, [doc], text, per_doc)
    sums = per.groupBy("term").agg(F.sum("n").alias("score"), F.count(F.lit(1)).alias("docs"))
    best = sums.orderBy(F.desc("score"), "term").limit(top)
    return best.select("term", "score"), sums.filter(F.col("docs") >= sink).select("term", "docs")
