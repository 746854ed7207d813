"""Dates, scores and settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(a: Column, b: Column) -> Column:
    """Days from a to b as a fraction."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(86_400_000_000.0)


def whole_days_since(at: Column, now: Column) -> Column:
    """Full days of 24 hours that have passed, not calendar days."""
    return F.floor(days_between(at, now)).cast("long")


def typed_setting(value: Column, kind: str, default) -> Column:
    return F.coalesce(value.try_cast(kind), F.lit(default).cast(kind))


def pace(median: Column) -> tuple[Column, Column]:
    """(warm threshold 2 to 5, review days 1 to 7) of a median interval in days."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), median / 7.0))
    return F.round(2 + share * 3).cast("int"), F.round(F.greatest(F.lit(1.0), F.least(F.lit(7.0), median))).cast("int")


def calibration(archived: Column, assets: Column, interests: Column, top: Column) -> tuple[Column, Column]:
    """(score 0 to 6, level) from four signals of a reader's activity."""

    def tier(x: Column, *steps: tuple[float, float]) -> Column:
        out = F.lit(0.0)
        for least, points in steps:
            out = F.when(x >= least, F.lit(points)).otherwise(out)
        return out

    score = (
        tier(archived, (3, 0.5), (5, 1.0), (10, 2.0)) + tier(assets, (2, 0.5), (5, 1.0), (10, 2.0))
        + tier(interests, (8, 0.5), (15, 1.0)) + tier(top, (5, 0.5), (8, 1.0))
    )
    return score, F.when(score >= 4.5, "advanced").when(score >= 2.0, "intermediate").otherwise("beginner")


# What the knowledge levels are also called.
LEVELS = {
    "beginner": "beginner", "intermediate": "intermediate", "advanced": "advanced",
    "入门": "beginner", "进阶": "intermediate", "深入": "advanced",
}


def knowledge_level(name: Column) -> Column:
    """The level's name; an error for anything that is none."""
    pairs = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    return F.coalesce(pairs[F.trim(name)], F.raise_error(F.concat(F.lit("not a knowledge level: "), F.coalesce(name, F.lit("null")))).cast("string"))


def rhythm(archived: Column) -> Column:
    return F.when(archived == 0, "start").when(archived < 3, "building").otherwise("stable")


def node_size(n: Column) -> Column:
    return 16 + F.least(F.lit(24.0), 5 * F.log2(n + 1))


def edge_width(strength: Column) -> Column:
    return F.round(1 + F.greatest(F.lit(0.0), F.least(F.lit(1.0), strength / 100.0)) * 3, 2)
