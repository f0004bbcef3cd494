"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from workmart.session import store

__all__ = ["Recent", "arrow_map", "cells_for", "labelled_sample", "read", "sample_rows", "slices", "share_out", "store", "unit_interval", "with_rank"]


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unit_interval(*columns: str | Column, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the columns' values alone, so that reruns agree."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 53))


def cells_for(rows: int, per_cell: int = 20_000, least: int = 8) -> int:
    """Cells of about `per_cell` rows each: what one task orders stays the same size at every scale."""
    return max(least, -(-rows // per_cell))


def with_rank(df: DataFrame, by: list[str], order: list[str], cells: int, name: str) -> DataFrame:
    """Gapless positions from 0 within each value of `by`, without bringing a value's rows together.

    Rows are cut into `cells` by a hash of `order`; only a cell is sorted, and the counts of the cells before it
    (one small row for each value and cell) are added. The order is by cell, then by `order`.
    """
    cut = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    keys = [*by, "_cell"]
    counts = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    placed = cut.withColumn("_cell_at", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)
    return placed.join(starts, same).withColumn(name, (F.col("_start") + F.col("_cell_at")).cast("long")).drop("_cell", "_cell_at", "_start", *[f"_k{i}" for i in range(len(keys))])


def sample_rows(df: DataFrame, keys: list[str], n: int, rows: int) -> DataFrame:
    """At most `n` of the `rows` rows of `df`, by a hash of `keys`. Rows far from the first n are left out before anything is
    ordered, so that what tasks send stays about n rows together, however many tasks there are."""
    at = unit_interval(*keys, seed=3)
    share = min(1.0, (n + 6 * n**0.5 + 20) / max(1, rows))
    return df.withColumn("_at", at).filter(F.col("_at") < share).orderBy("_at", *keys).limit(n).drop("_at")


def labelled_sample(labels: DataFrame, label: str, per_class: int, keep: Column | None = None) -> tuple[DataFrame, dict[int, int]]:
    """At most `per_class` labelled ids of either class, chosen by a hash of the id, and how many there are of each class.

    Labels other than 0 and 1, null labels and null ids are left out; an id with several labels has its largest.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (F.lit(True) if keep is None else keep))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    sizes = {int(r["label"]): int(r["count"]) for r in known.groupBy("label").count().collect()}
    picked = [sample_rows(known.filter(F.col("label") == c), ["doc_id"], per_class, sizes.get(c, 0)) for c in (0, 1)]
    return picked[0].unionAll(picked[1]), sizes


#: Rows and bytes of an Arrow batch of texts at most. Spark's own 10,000 rows of long texts are held several times on their way to Python.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 512, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """`df.mapInArrow`, after which the session sends batches of at most BATCH; smaller settings stay."""
    conf = df.sparkSession.conf
    for key, most in BATCH.items():
        now = conf.get(key)
        least = int(now.lower().removesuffix("b")) if now.lower().removesuffix("b").lstrip("-").isdigit() else most + 1
        if not 0 < least <= most:
            conf.set(key, most)
    return df.mapInArrow(run, schema)


def slices(batches, rows: int = 512):
    """Arrow batches cut short, so that what is made of one stays small; at a task's end the worker gives free memory back."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU's C library has it
    if trim is not None:
        trim(0)


class Recent(dict):
    """The last `most` to twice as many results of `make`; those of keys longer than `longest` aren't kept."""

    def __init__(self, make, most: int, longest: int | None = None):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        if self.longest is not None and len(key) > self.longest:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def share_out(amount: float, weights: list[float], caps: list[float]) -> list[float]:
    """`amount` shared by weight; what is above a cap is shared again by weight among the others until none is above."""
    targets, open_, left = [0.0] * len(weights), set(range(len(weights))), float(amount)
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > caps[i]}
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = float(caps[i])
        left -= sum(caps[i] for i in over)
        open_ -= over
    return targets
