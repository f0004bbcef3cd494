"""Cases: the streaming variants, fed with the events file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from proving.case import case
from proving.given import Given
from workmart.session import shared_folder
from workmart.streaming import streams


def _folder(g: Given) -> str:
    return f"{shared_folder(g.spark)}/workmart-stream-{uuid.uuid4().hex}"


def _events(g: Given) -> DataFrame:
    kinds = g.spark.read.parquet(f"{g.folder}/events.parquet").schema
    rows = g.spark.readStream.schema(kinds).option("pathGlobFilter", "events.parquet").parquet(g.folder)
    return rows.select("event_id", F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z"))).alias("ts"), "user_id", "event_type", "value",
                       F.expr("cast(get_json_object(props, '$.k') as bigint) as k"))


def _result(g: Given, stream: DataFrame) -> DataFrame:
    """Run a stream over what is there into a table and read it."""
    folder = _folder(g)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return g.spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@case("ST1_stream_upsert", "user_id:i event_id:i k:i", "select user_id, arg_max(event_id, ts) event_id, arg_max(k, ts) k from ev group by 1")
def st1(g: Given):
    folder = _folder(g)
    streams.stream_upsert(_events(g), f"{folder}/rows", f"{folder}/state", ["user_id"], "ts").awaitTermination()
    return streams.upserted(g.spark, f"{folder}/rows", ["user_id"], "ts")


case("ST2_stream_sessions", "user_id:i session_start:t session_end:t events:i",
     """select user_id, min(ts) session_start, max(ts) + interval 8 hour session_end, count(*) as events from (
          select *, sum(case when was is null or ts - was >= interval 8 hour then 1 else 0 end) over (partition by user_id order by ts) n from (select *, lag(ts) over (partition by user_id order by ts) was from ev))
        group by user_id, n having max(ts) + interval 8 hour <= (select max(ts) from ev) - interval 1 hour""")(
    lambda g: _result(g, streams.stream_sessions(_events(g), ["user_id"], "ts", "8 hours", "1 hour")))
case("ST3_stream_daily", "event_type:s day:d total:i", "select event_type, day, sum(k) total from ev where day + 1 <= (select max(ts) from ev) - interval 3 day group by 1, 2")(
    lambda g: _result(g, streams.stream_daily(_events(g), ["event_type"], "ts", {"total": "k"})))


def _labels(rows: DataFrame) -> DataFrame:
    """Events as label changes: most add a label, every third kind removes one."""
    value = "array(named_struct('id', event_type, 'display', event_type))"
    none = "cast(array() as array<struct<id:string,display:string>>)"
    return rows.selectExpr(
        "'src' as source_id", "cast(user_id as string) as issue_id", "'labels' as field_id", "ts as event_at", "cast(event_id as string) as event_id",
        "case when k % 3 = 0 then 'remove' else 'add' end as kind", f"case when k % 3 = 0 then {value} else {none} end as before", f"case when k % 3 = 0 then {none} else {value} end as after")


case("ST4_stream_field_history", "issue_id:s event_id:s members:s",
     """select e.user_id issue_id, e.event_id, coalesce(string_agg(t.event_type, '|' order by t.event_type) filter (
          (select arg_max(x.k % 3 <> 0, x.ts) from ev x where x.user_id = e.user_id and x.event_type = t.event_type and x.ts <= e.ts)), '') members
        from ev e cross join (select distinct event_type from ev) t group by 1, 2""")(
    lambda g: _result(g, streams.stream_field_history(_labels(_events(g)))).withColumn("members", F.array_join(F.array_sort("value_ids"), "|")))
case("ST5_stream_dedup", "event_type:s n:i", "select event_type, count(distinct (user_id, k)) n from ev group by 1")(
    lambda g: _result(g, streams.stream_dedup(_events(g), "ts", ["user_id", "event_type", "k"], "60 days").select("event_type", "event_id")).groupBy(
        "event_type").agg(F.count(F.lit(1)).alias("n")))
