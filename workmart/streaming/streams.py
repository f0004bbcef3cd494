"""Continuous versions of batch operators (ST1-ST5). Each gives the batch
result once the stream has seen the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from workmart.operators.latest import latest_by
from workmart.sources.sinks import write_table


def stream_upsert(source: DataFrame, path: str, checkpoint: str, keys: Sequence[str], version: str) -> StreamingQuery:
    """Keep a table with the latest row per key (ST1).

    A micro-batch is reduced to its newest row per key and becomes one
    generation of the table; nothing written before is touched, and a retried
    batch writes the same generation again. Readers take the newest row over
    all generations, `compact` folds them into one table now and then.
    """

    def put(batch: DataFrame, n: int) -> None:
        latest_by(batch, keys, [version]).write.mode("overwrite").parquet(f"{path}/generation={n}")

    return source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(spark: SparkSession, path: str, keys: Sequence[str], version: str) -> DataFrame:
    """The table that `stream_upsert` keeps."""
    return latest_by(spark.read.parquet(path), keys, [version, "generation"]).drop("generation")


def compact(spark: SparkSession, path: str, keys: Sequence[str], version: str, into: str) -> None:
    write_table(upserted(spark, path, keys, version), into)


def stream_sessions(events: DataFrame, keys: Sequence[str], ts: str, gap: str, lateness: str) -> DataFrame:
    """Gap sessions (ST2): one row per closed session."""
    return events.withWatermark(ts, lateness).groupBy(*keys, F.session_window(ts, gap).alias("session")).agg(
        F.count(F.lit(1)).alias("events")).select(
        *keys, F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), "events")


def stream_daily(events: DataFrame, keys: Sequence[str], ts: str, counters: dict[str, str], lateness: str = "3 days") -> DataFrame:
    """Daily counters that accept rows up to three days late (ST3)."""
    sums = [F.sum(c).alias(n) for n, c in counters.items()]
    return events.withWatermark(ts, lateness).groupBy(*keys, F.window(ts, "1 day").alias("w")).agg(*sums).select(
        *keys, F.to_date("w.start").alias("day"), *counters)


def stream_dedup(events: DataFrame, ts: str, keys: Sequence[str] = ("unique_key",), lateness: str = "1 hour") -> DataFrame:
    """Drop rows that are landed again within the watermark (ST5)."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(keys))


FOLD_OUTPUT = ("source_id string, issue_id string, field_id string, event_at timestamp, event_id string, "
               "value_ids array<string>, value_displays array<string>")
FOLD_STATE = "last_at timestamp, ids array<string>, displays array<string>"


def _next(ids: list, displays: list, event) -> tuple[list, list]:
    """State after one change (the row-level rule of the batch fold)."""
    before, after = event.before, event.after
    if event.kind == "add":
        new = [v for v in after if v["id"] not in ids]
        return ids + [v["id"] for v in new], displays + [v["display"] for v in new]
    if event.kind == "remove":
        gone = {v["id"] for v in before}
        kept = [(i, d) for i, d in zip(ids, displays) if i not in gone]
        return [i for i, _ in kept], [d for _, d in kept]
    return [v["id"] for v in after], [v["display"] for v in after]


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, ids, displays = state.get if state.exists else (None, [], [])
    ids, displays = list(ids), list(displays)
    mark = last
    # A group's rows of one micro-batch; older ones are in the state.
    frame = pd.concat(list(batches)).sort_values(["event_at", "event_id"])
    out = []
    for event in frame.itertuples(index=False):
        if mark is not None and event.event_at <= mark:
            continue  # late: at or below what the field has seen before
        ids, displays = _next(ids, displays, event)
        last = event.event_at
        out.append((*key, event.event_at, event.event_id, ids, displays))
    state.update((last, ids, displays))
    yield pd.DataFrame(out, columns=["source_id", "issue_id", "field_id", "event_at", "event_id", "value_ids", "value_displays"])


def stream_field_history(deltas: DataFrame) -> DataFrame:
    """Issue field states as changes arrive (ST4).

    deltas: source_id, issue_id, field_id, event_at, event_id, kind, before,
    after (see `to_delta`). State per field is its current value and the time
    of its last change; changes at or before that time are late.
    """
    return deltas.groupBy("source_id", "issue_id", "field_id").applyInPandasWithState(
        _fold, FOLD_OUTPUT, FOLD_STATE, "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop."""
    return stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


__all__ = ["stream_upsert", "upserted", "compact", "stream_sessions", "stream_daily", "stream_dedup", "stream_field_history",
           "run_once"]
