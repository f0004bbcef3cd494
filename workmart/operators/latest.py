"""One row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from workmart.functions.keys import as_column

_RANK = "__rank"


def latest_by(df: DataFrame, keys: Sequence[str], newest: Sequence[Column | str],
              ties: Sequence[Column | str] = ()) -> DataFrame:
    """Keep the newest row of each key.

    `newest` is compared in descending order, then `ties` ascending. Spark
    turns the rank filter into a group limit that runs before the shuffle, so
    a hot key sends at most one row per input partition.
    """
    order = [as_column(c).desc_nulls_last() for c in newest] + [as_column(c).asc_nulls_last() for c in ties]
    ranked = df.withColumn(_RANK, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(_RANK) == 1).drop(_RANK)


def any_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key where versions do not exist (D4). The smallest row
    content is kept, so that repeated runs agree."""
    rest = [c for c in df.columns if c not in keys]
    return latest_by(df, keys, [], [F.to_json(F.struct(*rest))])


def collapse(df: DataFrame, keys: Sequence[str], rest: Sequence[str]) -> DataFrame:
    """Collapse repeats of a full natural key; the others take their minimum."""
    return df.groupBy(*keys).agg(*[F.min(c).alias(c) for c in rest])


def latest_values(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                  values: dict[str, Column | str]) -> DataFrame:
    """Latest value of each attribute per key (D6): one aggregation, no sort."""
    at = F.struct(*[as_column(c) for c in order])
    return df.groupBy(*keys).agg(*[F.max_by(as_column(v), at).alias(n) for n, v in values.items()])


def insert_ignore(target: DataFrame, batch: DataFrame, keys: Sequence[str],
                  order: Sequence[Column | str]) -> DataFrame:
    """Rows of `batch` to append: unknown in `target`, and one per key."""
    fresh = batch.join(target.select(*keys).distinct(), list(keys), "left_anti")
    descending_first = [as_column(c) for c in order]
    return latest_by(fresh, keys, [], descending_first)
