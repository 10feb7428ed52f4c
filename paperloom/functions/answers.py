"""A text model's JSON answers as variants: what is wrong in one place is lost there and nowhere else.

Numbers may come as text, keys may be missing or be more than asked for, and a branch may have another shape.  Each of these costs
its own value; an answer that is no JSON at all costs all of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(answer: Column) -> Column:
    """A variant, or null if the answer is none, no JSON, or names a key twice."""
    return F.try_parse_json(answer)


def number(value: Column, path: str) -> Column:
    """A finite number, also one told as text; null for anything else."""
    got = F.try_variant_get(value, path, "double")
    return F.when(F.abs(got) < float("inf"), got)


def text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def whole(value: Column, path: str, missing: int) -> Column:
    """A whole number; ``missing`` if the key is not there, null if what is there is none."""
    return F.when(F.try_variant_get(value, path, "variant").isNull(), F.lit(missing)).otherwise(F.try_variant_get(value, path, "int"))


def flag(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "boolean")


def objects(value: Column, path: str) -> Column:
    """The objects of a list, as variants; none if there is no list."""
    found = F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(found, lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)))
