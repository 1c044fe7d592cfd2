"""Values of the objects table as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def formatted(value: Column, depth: int = 5) -> Column:
    """A value as text in which kinds are told apart: ``/Name``, ``7 0 R``, ``<hex>``, strings in quotes, dates as seconds from 1970, ``[...]`` and ``{key value, ...}``; null for null.

    The expression walks the VARIANT down to ``depth`` levels of arrays and dictionaries; what lies deeper is ``...``.
    """
    entry = lambda path, kind="string": F.try_variant_get(value, path, kind)
    ref = F.concat_ws(" ", entry("$.ref"), entry("$.gen"), F.lit("R"))
    out = (F.when(value.isNull(), F.lit(None).cast("string"))
           .when(entry("$.name").isNotNull(), F.concat(F.lit("/"), entry("$.name")))
           .when(entry("$.ref").isNotNull(), ref)
           .when(entry("$.bin").isNotNull(), F.concat(F.lit("<"), F.lower(F.hex(F.unbase64(entry("$.bin")))), F.lit(">")))
           .when(entry("$.date").isNotNull(), entry("$.date")))
    kind = F.schema_of_variant(value)
    if depth:
        inner = F.array_join(F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.coalesce(formatted(x, depth - 1), F.lit("null"))), ", ")
        pairs = F.map_entries(F.try_variant_get(value, "$.dict", "map<string,variant>"))
        body = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(" "), F.coalesce(formatted(e["value"], depth - 1), F.lit("null")))), ", ")
        out = out.when(kind.startswith("ARRAY"), F.concat(F.lit("["), inner, F.lit("]"))).when(kind.startswith("OBJECT"), F.concat(F.lit("{"), body, F.lit("}")))
    else:
        out = out.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.lit("..."))
    return out.otherwise(F.to_json(value))
