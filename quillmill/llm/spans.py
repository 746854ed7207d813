"""Places of regular expression matches as plain SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters on each side of a match that count as its neighbourhood, where an operator's features look at it.
LEFT, RIGHT = 64, 32

_SPAN = "array<struct<start:int,end:int,hit:string,left:string,right:string>>"


def gaps_and_hits(text: Column, pattern: str, gate: Column) -> tuple[Column, Column]:
    """The texts between leftmost non-overlapping matches, and the matches; only looked for where ``gate`` holds.

    There is always one gap more than there are matches, so the two interleave to the whole text.
    """
    gaps = F.when(gate, F.split(text, pattern, -1)).otherwise(F.array(text))
    hits = F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return gaps, hits


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, wherever and however often it is used inside.

    The optimizer may put an expression in place of a column that names it, even inside a lambda, where it would be
    worked out again for each item; a lambda's variable it cannot replace.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Items handled as one block, so that long arrays cost no square of their length.
BLOCK = 512


def blocks(items: Column) -> Column:
    """An array cut into arrays of BLOCK items; an empty one has none."""
    n = F.ceil(F.size(items) / F.lit(float(BLOCK))).cast("int")
    some = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))
    return F.when(n > 0, some).otherwise(F.array())


def near_left(before: Column, gap: Column) -> Column:
    """The LEFT characters before a match, the match before it included."""
    return F.right(F.concat(F.right(before, F.lit(LEFT)), F.right(gap, F.lit(LEFT))), F.lit(LEFT))


def word_left(before: Column, gap: Column) -> Column:
    """The whole word before a match that is a word itself, however long; empty at the text's start."""
    own = F.regexp_extract(gap, r"([^\x20\x09-\x0D]++)[\x20\x09-\x0D]+$", 1)
    return F.when(own != "", own).otherwise(before)


def located(gaps: Column, hits: Column, context=near_left) -> Column:
    """The matches with start and end in code points and some context: array of (start, end, hit, left, right).

    ``left`` is ``context`` of the match before (empty for the first) and the gap between the two, ``right`` the
    first RIGHT characters of the gap behind.
    """

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["h"])
        span = F.struct(
            start.alias("start"), end.alias("end"), x["h"].alias("hit"),
            context(x["b"], x["g"]).alias("left"), F.left(x["r"], F.lit(RIGHT)).alias("right"),
        )
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    def of_block(acc: Column, block: Column) -> Column:
        none = F.array().cast(_SPAN)
        got = F.aggregate(block, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.struct(got["at"].alias("at"), F.array_append(acc["out"], got["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def whole(z: Column) -> Column:
        n = F.size(z["hits"])
        before = F.concat(F.array(F.lit("")), F.slice(z["hits"], F.lit(1), F.greatest(n - 1, F.lit(0))))
        each = F.arrays_zip(
            F.slice(z["gaps"], F.lit(1), n).alias("g"), z["hits"].alias("h"), F.slice(z["gaps"], F.lit(2), n).alias("r"),
            F.slice(before, F.lit(1), n).alias("b"),
        )
        return F.flatten(F.aggregate(let(each, blocks), zero, of_block, lambda acc: acc["out"]))

    return let(F.struct(gaps.alias("gaps"), hits.alias("hits")), whole)
