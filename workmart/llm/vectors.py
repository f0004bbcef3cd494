"""Vector tables: which rows take part, and the best results of blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from workmart.llm.common import store


def usable(df: DataFrame, zero: bool, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id long, v array<double>: rows with an id and a vector of finite numbers, with its table's most frequent length (of two, the longer)."""
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(f"`{id}`").cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(finite & (F.size("v") > 0))
    if not zero:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    rows = store(rows)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("v") == (common["d"] if common else 0))


def queries_of(rows: DataFrame, every: int) -> DataFrame:
    """Rows whose id is divisible by `every`; an id that several rows have asks once, with the smallest vector."""
    return rows.filter(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("v"))


def squared(v: str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)


def matrix(column) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best pairs of each query: largest score, then smallest id."""
    order = np.lexsort((ids, -scores, query))
    own = query[order]
    starts = np.concatenate(([True], own[1:] != own[:-1])) if len(own) else np.empty(0, dtype=bool)
    first = np.maximum.accumulate(np.where(starts, np.arange(len(own)), 0)) if len(own) else own
    return order[np.arange(len(own)) - first < k]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """found: query_id, vec_id, score. Each block has sent its k best; the best of all blocks."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
