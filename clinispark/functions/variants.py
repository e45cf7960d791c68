"""JSON of any shape as VARIANT: fields with their type, explicit null apart from absent, shapes of many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(raw: Column) -> Column:
    """VARIANT of a JSON text; null where it is null or no JSON."""
    return F.try_parse_json(raw)


def state(raw: Column, path: str) -> Column:
    """What a JSON text says of a path: value, null (it is there and null), absent, or malformed (no JSON at all)."""
    v = parsed(raw)
    at = F.try_variant_get(v, path, "variant")
    return F.when(v.isNull(), "malformed").when(at.isNull(), "absent").when(F.is_variant_null(at), "null").otherwise("value")


def value(raw: Column, path: str, kind: str) -> Column:
    """The path's value as that type; null where it is null, absent or of another type."""
    return F.try_variant_get(parsed(raw), path, kind)


def shapes(df: DataFrame, raw: str, *keys: str) -> DataFrame:
    """(keys, shape, n): the schema that holds all well-formed JSON texts of each key; merges, so it needs no second pass."""
    held = df.select(*keys, parsed(F.col(raw)).alias("_v")).where("_v IS NOT NULL")
    return held.groupBy(*keys).agg(F.schema_of_variant_agg("_v").alias("shape"), F.count("*").alias("n"))
