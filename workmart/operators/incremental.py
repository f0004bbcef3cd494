"""Incremental runs (I1-I7) and upsert by key.

A mark is one scalar or one row per group. A scalar mark is read once and put
into the filter as a literal, so that Parquet skips row groups by it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from workmart.functions.keys import as_column
from workmart.operators.latest import latest_by


def scalar_mark(target: DataFrame, column: Column | str):
    """Largest value in the target, None when it is empty."""
    return target.agg(F.max(as_column(column)).alias("mark")).first()["mark"]


def after_mark(batch: DataFrame, target: DataFrame | None, column: str) -> DataFrame:
    """Rows newer than everything in the target (I1). With several sources in
    one table a slow one would be skipped; use `after_source_marks` there."""
    mark = scalar_mark(target, column) if target is not None else None
    return batch if mark is None else batch.filter(F.col(column) > F.lit(mark))


def after_source_marks(batch: DataFrame, target: DataFrame | None, column: str,
                       by: Sequence[str] = ("tenant_id", "source_id")) -> DataFrame:
    """Rows newer than the mark of their own source (I2, I6). Sources the
    target does not know come in whole."""
    if target is None:
        return batch
    names = {c: f"__of_{c}" for c in by}
    marks = target.groupBy(*[F.col(c).alias(n) for c, n in names.items()]).agg(F.max(column).alias("__mark"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    newer = F.col("__mark").isNull() | (F.col(column) > F.col("__mark"))
    return batch.join(marks, same, "left").filter(newer).select(*batch.columns)


def after_entity_marks(events: DataFrame, target: DataFrame | None, keys: Sequence[str], at: str) -> DataFrame:
    """New events per entity; events at or below the entity's mark are late
    and dropped (I6)."""
    return after_source_marks(events, target, at, keys)


def lookback(batch: DataFrame, target: DataFrame | None, day: str, days: int = 3) -> DataFrame:
    """Rows of the last days the target holds, and newer ones."""
    mark = scalar_mark(target, F.col(day).cast("date")) if target is not None else None
    return batch if mark is None else batch.filter(F.col(day) > F.date_sub(F.lit(mark), days))


def touched_days(landed: DataFrame, day: Column | str, extracted: str, days: int = 3) -> DataFrame:
    """All rows of every day that got a row in the last extraction days (I4),
    so that a day is always recomputed whole."""
    mark = scalar_mark(landed, extracted)
    if mark is None:
        return landed
    keyed = landed.withColumn("__day", as_column(day))
    fresh = keyed.filter(F.col(extracted) > F.lit(mark) - F.expr(f"interval {int(days)} days"))
    return keyed.join(fresh.select("__day").distinct(), "__day", "left_semi").select(*landed.columns)


def unknown_keys(batch: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the target does not hold."""
    return batch.join(target.select(*keys).distinct(), list(keys), "left_anti")


def upsert_by_key(target: DataFrame, batch: DataFrame, keys: Sequence[str], version: str,
                  ties: Sequence[str] = ()) -> DataFrame:
    """Replace rows by key with the newest of the batch."""
    newest = latest_by(batch, keys, [version], ties)
    kept = target.join(newest.select(*keys), list(keys), "left_anti")
    return kept.unionByName(newest, allowMissingColumns=True)
