"""Sources (S1-S3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from workmart.functions.keys import unique_key

# Load metadata written by the common landing tool, and our name for it.
EXTRACTED_COLUMNS = ("_airbyte_extracted_at",)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder, by name: `name.parquet`, or else `name` (S1). Spark looks for it, so any file system it reads will do."""
    try:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.read.parquet(f"{folder}/{name}")


def landed(df: DataFrame) -> DataFrame:
    """A landed table with the extraction time as `_extracted_at`."""
    for name in EXTRACTED_COLUMNS:
        if name in df.columns:
            df = df.withColumnRenamed(name, "_extracted_at")
    return df


def read_csv_fixture(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV rows with a header; arrays are written like ['a', 'b']."""
    plain = T.StructType([
        T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.ArrayType) else f.dataType) for f in schema])
    rows = spark.read.schema(plain).csv(path, header=True, enforceSchema=False)
    return rows.select(*[
        (F.from_json(F.translate(f.name, "'", '"'), f.dataType) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)).alias(f.name)
        for f in schema])


def with_envelope(df: DataFrame, tenant: str, source: str, data_source: str, id_column: str,
                  custom: Sequence[str] = (), collected_at: Column | None = None) -> DataFrame:
    """Add tenant, source, key and collection time to a raw record (S3).

    Custom columns are packed into one JSON string so that the table's schema
    stays stable. A record without an id gets one from its content.
    """
    reserved = {"tenant_id", "source_id", "unique_key", "data_source", "collected_at", "custom_fields"}
    kept = [c for c in df.columns if c not in reserved and c not in custom]
    content = F.concat(F.lit("nohash:"), F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256), 1, 16))
    own = F.coalesce(F.nullif(F.col(id_column).cast("string"), F.lit("")), content)
    packed = F.to_json(F.struct(*custom)) if custom else F.lit("{}")
    return df.select(
        *kept, packed.alias("custom_fields"), F.lit(tenant).alias("tenant_id"), F.lit(source).alias("source_id"),
        unique_key(F.lit(tenant), F.lit(source), own).alias("unique_key"), F.lit(data_source).alias("data_source"),
        (F.current_timestamp() if collected_at is None else collected_at).alias("collected_at"))
