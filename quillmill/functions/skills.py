"""Skill lists as models write them: strings or objects, keys in two languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_skill(raw: Column) -> Column:
    """(name, applicable, usage, sources) of a JSON string or object."""
    v = F.try_parse_json(raw)
    get = lambda key: F.try_variant_get(v, f"$['{key}']", "string")
    name = F.coalesce(F.when(F.startswith(F.trim(raw), F.lit('"')), F.try_variant_get(v, "$", "string")), get("name"), F.lit(""))
    return F.struct(
        name.alias("name"), F.coalesce(get("applicable"), get("场景"), F.lit("")).alias("applicable"), F.coalesce(get("usage"), get("用法"), F.lit("")).alias("usage"),
        F.coalesce(F.try_variant_get(v, "$.sources", "array<string>"), F.array().cast("array<string>")).alias("sources"),
    )
