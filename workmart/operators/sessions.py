"""Gap sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from workmart.operators.ordered import with_neighbours, with_running_sum


def sessionize(df: DataFrame, keys: Sequence[str], ts: str, gap_seconds: int, end_ts: str | None = None,
               ties: Sequence[str] = (), name: str = "session_no", chunk: Column | None = None) -> DataFrame:
    """Number the sessions of each key. A row opens a session when it starts
    more than `gap_seconds` after the previous row's end (`end_ts`) or, without
    one, after its start. Rows with an equal `ts` share a session number."""
    order = [ts, *ties]
    # Whole seconds, as the gap is given in seconds.
    at = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    marked = with_neighbours(df, keys, order, previous={"__seen": F.lit(True), "__last": at(end_ts or ts)}, chunk=chunk)
    opens = F.col("__seen").isNull() | F.col("__last").isNull() | (at(ts) - F.col("__last") > gap_seconds)
    marked = marked.withColumn("__open", F.when(opens, 1).otherwise(0).cast("bigint")).drop("__seen", "__last")
    return with_running_sum(marked, keys, [ts], F.col("__open"), name, chunk).drop("__open")
