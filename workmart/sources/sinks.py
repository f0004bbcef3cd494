"""Sinks (S4-S11)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from workmart.operators.incremental import upsert_by_key
from workmart.operators.latest import latest_by


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace the whole table."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Add rows (S5)."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions that `df` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def write_upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], version: str, path: str) -> None:
    """Write target with the batch put in by key (S6) to a new path: a job
    never overwrites the files it is reading."""
    write_table(upsert_by_key(target, batch, keys, version), path)


def view(df: DataFrame, name: str) -> DataFrame:
    """Register for SQL."""
    df.createOrReplaceTempView(name)
    return df


def ephemeral(build: Callable[..., DataFrame], *args, **kwargs) -> DataFrame:
    """A model that is only a step of others: nothing is stored."""
    return build(*args, **kwargs)


def refresh_materialized(build: Callable[[], DataFrame], path: str) -> DataFrame:
    """Recompute a stored view and read the stored rows."""
    df = build()
    write_table(df, path)
    return df.sparkSession.read.parquet(path)


def json_rows(df: DataFrame, digits: int = 4, top: int | None = None) -> DataFrame:
    """Result rows as JSON text with rounded floats."""
    rounded = [
        (F.round(f.name, digits) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)).alias(f.name)
        for f in df.schema]
    out = df.select(F.to_json(F.struct(*rounded), {"ignoreNullFields": "false"}).alias("json"))
    return out if top is None else out.limit(top)


def promote(df: DataFrame, keys: Sequence[str] = ("unique_key",), extracted: str = "_extracted_at",
            ties: Sequence[Column | str] = ()) -> DataFrame:
    """An append-only landed table reduced to the newest row per key.
    Applying it twice changes nothing."""
    plain = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return latest_by(df, keys, [extracted], list(ties) or [F.xxhash64(*plain)])
