"""Small tests on variant values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def field(value: Column, name: str, kind: str = "variant") -> Column:
    """One field of an object; null when it is absent or of another kind."""
    return F.try_variant_get(value, f'$["{name}"]', kind)


def kind_of(value: Column) -> Column:
    """Type text of a variant: STRING, BIGINT, VOID (a JSON null), OBJECT<..>; null if absent."""
    return F.schema_of_variant(value)


def is_object(kind: Column) -> Column:
    return F.coalesce(kind.startswith("OBJECT"), F.lit(False))


def is_number(kind: Column) -> Column:
    return F.coalesce(
        kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.lit(False)
    )


def first_of(*rules: Column) -> Column:
    """First rule that is broken, as its message; null when all hold."""
    return F.coalesce(*rules)
