"""Column helpers of the conformers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from workmart.functions.keys import as_column, unique_key
from workmart.functions.scalars import millis, moment, number, text

KEYS = ("tenant_id", "source_id", "unique_key")


def count(name: Column | str) -> Column:
    """A counter, NULL kept."""
    return number(name, "bigint")


def count0(name: Column | str) -> Column:
    return F.coalesce(count(name), F.lit(0).cast("bigint"))


def total0(*names: Column | str) -> Column:
    out = count0(names[0])
    for n in names[1:]:
        out = out + count0(n)
    return out


def shape(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    return df.select(*keep, *[c.alias(n) for n, c in columns.items()])


def version(df: DataFrame | None = None) -> Column:
    """Version of a row that is as old as its extraction."""
    return millis("_extracted_at")


def labels(**names: str) -> dict[str, Column]:
    return {n: F.lit(v) for n, v in names.items()}


def flat_json(**values: Column | str) -> Column:
    """A JSON object of texts; missing ones are ''."""
    return F.to_json(F.struct(*[text(v).alias(n) for n, v in values.items()]))


def truth(value: Column | str) -> Column:
    return F.coalesce(as_column(value).cast("string").try_cast("boolean"), F.lit(False))


def first_of(json_array: Column | str) -> Column:
    items = F.from_json(F.coalesce(as_column(json_array), F.lit("[]")), "array<string>")
    return F.nullif(F.try_element_at(items, F.lit(1)), F.lit(""))


__all__ = ["KEYS", "count", "count0", "total0", "shape", "version", "labels", "flat_json", "truth", "first_of",
           "unique_key", "moment", "number", "text"]
