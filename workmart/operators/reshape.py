"""Unions, joins, pivots."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from workmart.functions.keys import as_column


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a contract, in its order and types; missing ones are
    typed NULL (P2)."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema])


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def unpivot(df: DataFrame, keep: Sequence[Column | str], values: dict[str, Column | str],
            key: str = "metric_key", value: str = "metric_value", drop_null: bool = False) -> DataFrame:
    """One row per (row, named value), in one scan."""
    pairs = F.array(*[F.struct(F.lit(k).alias(key), as_column(v).cast("double").alias(value)) for k, v in values.items()])
    if drop_null:
        pairs = F.filter(pairs, lambda p: p[value].isNotNull())
    return df.select(*keep, F.inline(pairs))


def pivot_latest(df: DataFrame, keys: Sequence[str], attribute: str, value: str, names: Sequence[str],
                 order: Sequence[str]) -> DataFrame:
    """Entity-attribute-value rows to one row per entity, latest value each."""
    at = F.struct(*order)
    return df.filter(F.col(attribute).isin(*names)).groupBy(*keys).agg(
        *[F.max_by(value, F.when(F.col(attribute) == n, at)).alias(n) for n in names])


def outer_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join with coalesced keys."""
    return left.join(right, list(keys), "outer")


def anchor_aggregate(parts: Sequence[tuple[DataFrame, dict[str, Column]]], keys: Sequence[str],
                     combine: dict[str, Column]) -> DataFrame:
    """Several tables aggregated onto the union of their keys.

    Instead of one distinct union and N left joins, the parts are stacked with
    their columns side by side and aggregated once: one shuffle.
    """
    names: list[str] = []
    for _, columns in parts:
        names += [n for n in columns if n not in names]
    stacked = union_all(
        part.select(*keys, *[columns[n].alias(n) for n in columns]) for part, columns in parts)
    return stacked.groupBy(*keys).agg(*[c.alias(n) for n, c in combine.items()])


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                 left_span: tuple[str, str], right_span: tuple[str, str],
                 span: tuple[str, str] = ("valid_from", "valid_to")) -> DataFrame:
    """Pairs of rows with equal keys whose half-open spans meet, cut to the
    common part; a NULL end is open (J8)."""
    far = F.lit("9999-12-31 23:59:59.999999").cast("timestamp")
    renamed = right
    for c in right.columns:
        if c in left.columns and c not in keys:
            raise ValueError(f"rename {c} first")
    a0, a1 = (F.col(c) for c in left_span)
    b0, b1 = (F.col(c) for c in right_span)
    pairs = left.join(renamed, list(keys)).filter((b0 < F.coalesce(a1, far)) & (F.coalesce(b1, far) > a0))
    return pairs.withColumn(span[0], F.greatest(a0, b0)).withColumn(span[1], F.least(a1, b1))


def valid_at(df: DataFrame, at: Column | None, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Rows valid at a time; without a time the open ones."""
    if at is None:
        return df.filter(F.col(end).isNull())
    return df.filter((F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at)))


def join_by_kind(facts: DataFrame, first: DataFrame, first_key: str, second: DataFrame, second_key: str,
                 use_first: Column, value: str) -> DataFrame:
    """Look a value up by one key or another, depending on the row.

    Each row looks up once: the key to use is chosen before the join.
    """
    chosen = facts.withColumn("__kind", F.when(use_first, "first").otherwise("second")).withColumn(
        "__key", F.when(use_first, F.col(first_key)).otherwise(F.col(second_key)).cast("string"))
    lookup = first.select(F.lit("first").alias("__kind"), F.col(first.columns[0]).cast("string").alias("__key"), F.col(value)).unionByName(
        second.select(F.lit("second").alias("__kind"), F.col(second.columns[0]).cast("string").alias("__key"), F.col(value)))
    return chosen.join(lookup, ["__kind", "__key"], "left").drop("__kind", "__key")
