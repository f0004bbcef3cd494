"""Previous / next row and running totals that stay parallel inside one key.

A window over a key puts the whole key into one task. Here every key is cut
into chunks along its order (days of a timestamp, blocks of a number). The
window runs per (key, chunk); what a chunk needs from its neighbours is one
small row per chunk, made by a pre-aggregation and placed before or after the
chunk's own rows. Results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from workmart.functions.keys import as_column

_CHUNK, _SIDE, _PREV, _NEXT, _PART = "__chunk", "__side", "__prev", "__next", "__part"
_BLOCK = 1 << 16
#: Rows of a key that one task may order in `with_near_neighbours`.
PLAIN_ROWS = 50_000


def chunk_of(df: DataFrame, column: str) -> Column:
    """A coarse value that never decreases along `column`."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.coalesce(F.date_diff(F.to_date(column), F.lit("1970-01-01").cast("date")), F.lit(-(1 << 30)))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.coalesce(F.floor(F.col(column) / _BLOCK), F.lit(-(1 << 50)))
    raise TypeError(f"{column}: give chunk= for order columns of type {kind.simpleString()}")


def _padding(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Give the boundary rows the columns of the data rows."""
    missing = [f for f in df.schema if f.name not in rows.columns]
    return rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


def with_neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                    previous: dict[str, Column | str] | None = None,
                    following: dict[str, Column | str] | None = None,
                    chunk: Column | None = None) -> DataFrame:
    """Add values of the previous and the next row of the same key."""
    previous, following = previous or {}, following or {}
    chunk = chunk_of(df, order[0]) if chunk is None else chunk
    pack = lambda values: F.struct(F.lit(True).alias("seen"), *[as_column(v).alias(n) for n, v in values.items()])
    rows = df.select("*", chunk.alias(_CHUNK), F.lit(1).alias(_SIDE),
                     pack(previous).alias(_PREV), pack(following).alias(_NEXT))

    at = F.struct(*order)
    edges = rows.groupBy(*keys, _CHUNK).agg(F.max_by(_PREV, at).alias(_PREV), F.min_by(_NEXT, at).alias(_NEXT))
    across = Window.partitionBy(*keys).orderBy(_CHUNK)
    carried = edges.select(*keys, _CHUNK, F.lag(_PREV).over(across).alias(_PREV), F.lead(_NEXT).over(across).alias(_NEXT))
    sides = carried.select(*keys, _CHUNK, F.explode(F.array(F.lit(0), F.lit(2))).alias(_SIDE), _PREV, _NEXT)

    within = Window.partitionBy(*keys, _CHUNK).orderBy(_SIDE, *order)
    out = rows.unionByName(_padding(rows, sides))
    out = out.withColumn("__p", F.lag(_PREV).over(within)).withColumn("__n", F.lead(_NEXT).over(within))
    return out.filter(F.col(_SIDE) == 1).select(
        *df.columns,
        *[F.col(f"__p.{n}").alias(n) for n in previous],
        *[F.col(f"__n.{n}").alias(n) for n in following],
    )


def with_near_neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                         previous: dict[str, Column | str] | None = None,
                         following: dict[str, Column | str] | None = None, most: int = PLAIN_ROWS) -> DataFrame:
    """`with_neighbours` for keys that mostly have few rows: those with at most
    `most` are one plain window, without the two boundary rows for each chunk.
    Only keys with more rows, found by a count, are cut into chunks. `df` is
    read twice, so it should be stored."""
    previous, following = previous or {}, following or {}
    names = {c: f"__of_{c}" for c in keys}
    long = df.groupBy(*[F.col(c).alias(n) for c, n in names.items()]).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > most)
    if long.isEmpty():
        return _plain_neighbours(df, keys, order, previous, following)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return _plain_neighbours(df.join(long, same, "left_anti"), keys, order, previous, following).unionByName(
        with_neighbours(df.join(long, same, "left_semi"), keys, order, previous, following))


def _plain_neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], previous: dict, following: dict) -> DataFrame:
    within = Window.partitionBy(*keys).orderBy(*order)
    return df.select("*", *[F.lag(as_column(v)).over(within).alias(n) for n, v in previous.items()],
                     *[F.lead(as_column(v)).over(within).alias(n) for n, v in following.items()])


def with_running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column | str,
                     name: str, chunk: Column | None = None) -> DataFrame:
    """Add the running total up to and with the current row; rows with an
    equal order share it, as with a window's default frame (W4)."""
    chunk = chunk_of(df, order[0]) if chunk is None else chunk
    rows = df.select("*", chunk.alias(_CHUNK), F.lit(1).alias(_SIDE), as_column(value).alias(_PART))
    totals = rows.groupBy(*keys, _CHUNK).agg(F.sum(_PART).alias(_PART))
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, _CHUNK, F.lit(0).alias(_SIDE), F.sum(_PART).over(before).alias(_PART))
    within = Window.partitionBy(*keys, _CHUNK).orderBy(_SIDE, *order)
    out = rows.unionByName(_padding(rows, carried)).withColumn(name, F.sum(_PART).over(within))
    return out.filter(F.col(_SIDE) == 1).select(*df.columns, name)


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position",
                  chunk: Column | None = None) -> DataFrame:
    """Number the rows of each key from 1. `order` must be total."""
    return with_running_sum(df, keys, order, F.lit(1).cast("bigint"), name, chunk)
