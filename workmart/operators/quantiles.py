"""Exact quantiles per group without holding a group in one task.

`percentile_disc` keeps all values of a group in one buffer. Here equal values
are counted first. Counts are added up per value band (about 1 % wide), which
shows in which band each wanted rank lies; the values of that band are counted
again in cells of equal width between the band's own smallest and largest
value; only the values of the cell with the rank are ordered.
The result is an observed value: the smallest one whose cumulative share
reaches p, as `percentile_disc` defines it. Infinite values are ordered like
numbers, NaN comes after all others.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from workmart.functions.keys import as_column

CELLS = 4096
_LAST = 1 << 22  # beyond the band of any finite value


def _band(v: Column) -> Column:
    """Monotone in v: sign and a 1/64 octave of its size."""
    endless = F.abs(v) == float("inf")
    finite = F.when(~F.isnan(v) & ~endless & (v != 0), v)
    size = F.floor(F.log2(F.abs(finite)) * 64) + F.lit(1 << 20)
    return (F.when(F.isnan(v), F.lit(_LAST + 1)).when(endless, F.when(v > 0, F.lit(_LAST)).otherwise(F.lit(-_LAST)))
            .otherwise(F.coalesce(F.signum(finite).cast("bigint") * size, F.lit(0))).cast("bigint"))


def _with_rank(parts: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Parts of a group (count __n, in the order of `at`) that hold a wanted rank, with those ranks and the count before the part."""
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("__before", F.col("__before") + F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return _holding(placed).select(*keys, at, "__wanted", "__before", "__low", "__high")


def _holding(placed: DataFrame) -> DataFrame:
    held = F.filter("__wanted", lambda w: (w.rank > F.col("__before")) & (w.rank <= F.col("__before") + F.col("__n")))
    return placed.withColumn("__wanted", held).filter(F.size("__wanted") > 0)


def _values_in(values: DataFrame, parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The values of the parts; NULL keys are equal. Values elsewhere go before anything is ordered."""
    names = {k: f"__of_{k}" for k in keys}
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return values.join(parts.withColumnsRenamed(names), same).drop(*names.values())


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: Column | str,
                    quantiles: dict[str, float], count: Column | str | None = None) -> DataFrame:
    """`keys` + one column per quantile; NULL values are left out. Groups
    without a value do not appear. A row stands for `count` equal ones."""
    keys = list(keys)
    band, cell = [*keys, "__band"], [*keys, "__band", "__cell"]
    sums = [F.sum("__n").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high")]
    counts = (
        df.select(*keys, as_column(value).cast("double").alias("__v"), (F.lit(1) if count is None else as_column(count)).cast("bigint").alias("__n"))
        .filter("__v is not null").groupBy(*keys, "__v").agg(F.sum("__n").alias("__n"))
        .withColumn("__band", _band(F.col("__v")))
    )
    everything = F.sum("__n").over(Window.partitionBy(*keys))
    wanted = F.array(*[
        F.struct(F.lit(n).alias("name"), F.greatest(F.lit(1), F.ceil(F.lit(p) * everything)).cast("bigint").alias("rank"))
        for n, p in quantiles.items()
    ])
    bands = counts.groupBy(*band).agg(*sums).withColumn("__wanted", wanted).withColumn("__before", F.lit(0).cast("bigint"))
    near = _values_in(counts, _with_rank(bands, keys, "__band"), band)

    share = (F.col("__v") - F.col("__low")) / (F.col("__high") - F.col("__low"))
    near = near.withColumn("__cell", F.when(F.col("__low") == F.col("__high"), F.lit(0)).otherwise(F.floor(share * CELLS)).cast("int"))
    cells = near.groupBy(*cell).agg(*sums, F.first("__wanted").alias("__wanted"), F.first("__before").alias("__before"))
    near = _values_in(near.select(*cell, "__v", "__n"), _with_rank(cells, band, "__cell"), cell)

    earlier = Window.partitionBy(*cell).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    found = _holding(near.withColumn("__before", F.col("__before") + F.coalesce(F.sum("__n").over(earlier), F.lit(0))))
    found = found.select(*keys, "__v", F.explode("__wanted.name").alias("__quantile"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("__quantile") == n, F.col("__v"))).alias(n) for n in quantiles])
