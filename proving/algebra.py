"""Cases: sources, projection, keys, dedup, incremental runs, joins,
aggregation, windows, set operations, functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F, types as T

from proving.case import case
from proving.given import AS_OF, Given
from workmart.functions import scalars as S
from workmart.functions.keys import hashed_key, row_hash, stable_uuid, surrogate_id, unique_key, value_hash
from workmart.operators import incremental, latest, ordered, quantiles, reshape, rollup
from workmart.operators.sessions import sessionize
from workmart.plans.metrics import select_rows
from workmart.plans.registry import union_by_class
from workmart.plans.staging.ai import split_surfaces
from workmart.session import shared_folder
from workmart.sources.sinks import append_table, ephemeral, json_rows, promote, refresh_materialized, replace_partitions, view, write_table
from workmart.sources.tables import read_csv_fixture, with_envelope

# --- sources and sinks ---------------------------------------------------------------

case("S1_read_table", "n:i total:f", "select count(*) n, sum(o_totalprice) total from orders")(
    lambda g: g.table("orders").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")))


@case("S3_with_envelope", "c_custkey:i tenant_id:s source_id:s unique_key:s data_source:s custom_fields:s",
      """select c_custkey, 't1' tenant_id, 'src' source_id, 't1-src-' || c_name unique_key, 'crm' data_source,
         '{"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}' custom_fields from customer""")
def s3(g: Given):
    return with_envelope(g.customer, "t1", "src", "crm", "c_name", ["c_mktsegment", "c_nationkey"], g.as_of)


def _new(g: Given) -> str:
    return f"{shared_folder(g.spark)}/workmart-case-{uuid.uuid4().hex}"


@case("S2_read_csv_fixture", "n_nationkey:i n_name:s names:a", "select n_nationkey, n_name, [n_name, 'x'] names from nation")
def s2(g: Given):
    path = _new(g)
    g.table("nation").selectExpr("n_nationkey", "n_name", "concat('[\\'', n_name, '\\', \\'x\\']') as names").write.csv(path, header=True)
    kinds = T.StructType([T.StructField("n_nationkey", T.LongType()), T.StructField("n_name", T.StringType()), T.StructField("names", T.ArrayType(T.StringType()))])
    return read_csv_fixture(g.spark, path, kinds)


@case("S4_S5_write_and_append", "o_orderstatus:s n:i", "select o_orderstatus, count(*) + count(*) filter (o_totalprice > 200000) n from orders group by 1")
def s4_s5(g: Given):
    path = _new(g)
    write_table(g.orders.filter("o_orderstatus = 'P'"), path, ["o_orderstatus"])
    write_table(g.orders, path, ["o_orderstatus"])
    append_table(g.orders.filter("o_totalprice > 200000"), path, ["o_orderstatus"])
    return g.spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@case("S4_replace_partitions", "o_orderstatus:s n:i", "select o_orderstatus, case when o_orderstatus = 'F' then count(*) filter (o_totalprice > 200000) else count(*) end n from orders group by 1")
def s4_partitions(g: Given):
    path = _new(g)
    write_table(g.orders, path, ["o_orderstatus"])
    replace_partitions(g.orders.filter("o_orderstatus = 'F' and o_totalprice > 200000"), path, ["o_orderstatus"])
    return g.spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


case("S9_refresh_materialized", "k:i n:i", "select k, count(*) n from ev group by k")(
    lambda g: refresh_materialized(lambda: g.ev.groupBy("k").agg(F.count(F.lit(1)).alias("n")), _new(g)))

case("S7_view", "o_orderstatus:s n:i", "select o_orderstatus, count(*) n from orders group by 1")(
    lambda g: view(g.orders, "proving_orders").sparkSession.sql(
        "select o_orderstatus, count(*) n from proving_orders group by o_orderstatus"))

case("S8_ephemeral", "k:i n:i", "select k, count(*) n from ev group by k")(
    lambda g: ephemeral(lambda: g.ev).groupBy("k").agg(F.count(F.lit(1)).alias("n")))

case("S10_json_rows", "json:s",
     """select '{"n_nationkey":' || n_nationkey || ',"third":' || round(n_nationkey / 3.0, 4)::double || '}' json from nation""")(
    lambda g: json_rows(g.table("nation").selectExpr("n_nationkey", "n_nationkey / 3.0D as third")))


@case("S11_promote", "unique_key:s department:s", "select c_custkey unique_key, c_mktsegment department from customer")
def s11(g: Given):
    return promote(promote(g.employees))


# --- projection and predicates ----------------------------------------------------------

case("P1_project", "key:i price:f source:s", "select o_orderkey as key, o_totalprice price, 'orders' source from orders")(
    lambda g: g.orders.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"), F.lit("orders").alias("source")))


@case("P2_conform", "o_orderkey:i missing:s o_totalprice:i",
      "select o_orderkey, null missing, trunc(o_totalprice)::bigint o_totalprice from orders")
def p2(g: Given):
    kinds = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("missing", T.StringType()), T.StructField("o_totalprice", T.LongType())])
    return reshape.conform(g.orders, kinds)


@case("P3_safe_cast", "event_id:i as_number:f or_zero:i tenth:i",
      """select event_id, try_cast(event_type as double) as_number, coalesce(try_cast(case when k > 50 then k::varchar else 'x' end as bigint), 0) or_zero,
         k // 10 tenth from ev""")
def p3(g: Given):
    return g.ev.select("event_id", S.number("event_type").alias("as_number"),
                       S.number_or_zero(F.when(F.col("k") > 50, F.col("k").cast("string")).otherwise("x"), "bigint").alias("or_zero"),
                       S.whole_div(F.col("k"), 10).alias("tenth"))


@case("P4_conditional", "o_orderkey:i state:s",
      "select o_orderkey, case when o_orderstatus = 'P' then 'pending' when o_totalprice > 300000 then 'large' else lower(o_orderstatus) end state from orders")
def p4(g: Given):
    return g.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_totalprice") > 300000, "large")
                           .otherwise(F.lower("o_orderstatus")).alias("state"))


@case("P5_null_handling", "event_id:i filled:s blank:s divided:f",
      "select event_id, coalesce(nullif(event_type, 'error'), 'none') filled, nullif(trim(case when k < 10 then '  ' else event_type end), '') blank, 100.0 * value / nullif(k, 0) divided from ev")
def p5(g: Given):
    return g.ev.select("event_id", F.coalesce(F.nullif("event_type", F.lit("error")), F.lit("none")).alias("filled"),
                       S.blank_to_null(F.when(F.col("k") < 10, "  ").otherwise(F.col("event_type"))).alias("blank"),
                       S.ratio(F.col("value"), F.col("k"), 100.0).alias("divided"))


@case("P6_filters", "p_partkey:i p_name:s",
      """select p_partkey, p_name from part where p_size between 5 and 40 and p_type in ('ECONOMY','SMALL','LARGE') and p_name not like 'red%'
         and p_name ilike '%I%' and regexp_matches(p_brand, '^Brand#[1-9]') and p_retailprice is not null""")
def p6(g: Given):
    return g.table("part").filter(
        F.col("p_size").between(5, 40) & F.col("p_type").isin("ECONOMY", "SMALL", "LARGE") & ~F.col("p_name").like("red%")
        & F.col("p_name").ilike("%I%") & F.col("p_brand").rlike("^Brand#[1-9]") & F.col("p_retailprice").isNotNull())


case("P7_any_counter", "event_id:i", "select event_id from ev where k > 0 or value > 400")(
    lambda g: g.ev.filter(S.any_positive("k", F.when(F.col("value") > 400, F.col("value")))))

case("P8_except", "n_nationkey:i n_regionkey:i", "select n_nationkey, n_regionkey from nation")(lambda g: g.table("nation").drop("n_name"))


@case("P9_clamp", "event_id:i low:f pct:f hours:f",
      "select event_id, greatest(k - 50, 0) low, least(100, greatest(0, value)) pct, case when k >= 20 then k / 24.0 end as hours from ev")
def p9(g: Given):
    return g.ev.select("event_id", S.clamp(F.col("k") - 50, low=0).alias("low"), S.clamp(F.col("value"), 0, 100).alias("pct"),
                       F.when(F.col("k") >= 20, F.col("k") / 24.0).alias("hours"))


case("P10_file_category", "file_path:s file_category:s n:i",
     "select file_path, file_category, count(*) n from file_changes group by all")(
    lambda g: g.file_changes.groupBy("file_path", S.file_category("file_path").alias("file_category")).agg(F.count(F.lit(1)).alias("n")))

case("P11_seniority", "person_id:s seniority:s executive:b",
     "select person_id, seniority, job_title ilike '%vp of%' executive from people")(
    lambda g: g.people.select("person_id", S.seniority("job_title").alias("seniority"), S.executive_title("job_title").alias("executive")))

case("P12_file_extension", "file_path:s extension:s", """select distinct file_path, regexp_extract(file_path, '[.]([^.]*)$', 1) extension from file_changes""")(
    lambda g: g.file_changes.select("file_path", S.file_extension("file_path").alias("extension")).distinct())


@case("P13_split_surfaces", "event_id:i surface:s session_count:i message_count:i",
      """select event_id, 'chat' surface, null session_count, k message_count from ev where k > 0
         union all select event_id, 'excel', k % 3, k % 2 from ev where k % 3 > 0 or k % 2 > 0""")
def p13(g: Given):
    wide = g.ev.selectExpr("event_id", "k", "k % 3 as sheets", "k % 2 as cells")
    return split_surfaces(wide, {"chat": {"message_count": "k"}, "excel": {"session_count": "sheets", "message_count": "cells"}}, {})


case("P14_typed_reference", "o_orderkey:i deal:s", "select o_orderkey, case when o_orderpriority like '1%' then o_orderpriority end deal from orders")(
    lambda g: g.orders.select("o_orderkey", S.typed_reference("o_orderpriority", "1").alias("deal")))

# --- keys ----------------------------------------------------------------------------------

case("K1_unique_key", "o_orderkey:i key:s",
     "select o_orderkey, o_custkey || '-' || coalesce(nullif(o_orderstatus, 'P'), '') || '-' || (o_orderdate::date)::varchar as key from orders")(
    lambda g: g.orders.select("o_orderkey", unique_key("o_custkey", F.nullif("o_orderstatus", F.lit("P")), F.to_date("o_orderdate")).alias("key")))

case("K2_hashed_key", "o_orderkey:i key:s", "select o_orderkey, md5(o_custkey || '-' || o_orderkey) as key from orders")(
    lambda g: g.orders.select("o_orderkey", hashed_key("o_custkey", "o_orderkey").alias("key")))

case("K3_stable_uuid", "c_custkey:i id:s",
     "select c_custkey, regexp_replace(md5(c_name), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') id from customer")(
    lambda g: g.customer.select("c_custkey", stable_uuid("c_name").alias("id")))

case("K4_row_hash", "o_orderkey:i hash:s",
     "select o_orderkey, sha256(coalesce(nullif(o_orderstatus, 'P'), '__null__') || chr(31) || o_orderpriority) hash from orders")(
    lambda g: g.orders.select("o_orderkey", row_hash(F.nullif("o_orderstatus", F.lit("P")), "o_orderpriority").alias("hash")))

case("K5_surrogate_id", "c_custkey:i id:s",
     "select c_custkey, regexp_replace(md5('surrogate|' || c_name), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') id from customer")(
    lambda g: g.customer.select("c_custkey", surrogate_id("c_name").alias("id")))

case("K6_value_hash", "o_orderkey:i hash:s", "select o_orderkey, sha256(coalesce(nullif(o_orderstatus, 'P'), '')) hash from orders")(
    lambda g: g.orders.select("o_orderkey", value_hash(F.nullif("o_orderstatus", F.lit("P"))).alias("hash")))

# --- dedup -----------------------------------------------------------------------------------

_LAST_ORDER = "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) = 1"
case("D1_latest_by", "o_custkey:i o_orderkey:i o_totalprice:f", _LAST_ORDER)(
    lambda g: latest.latest_by(g.orders, ["o_custkey"], ["o_orderdate"], ["o_orderkey"]))
case("D2_limit_one_by", "user_id:i event_type:s event_id:i",
     "select user_id, event_type, event_id from ev qualify row_number() over (partition by user_id, event_type order by k desc, ts desc, event_id) = 1")(
    lambda g: latest.latest_by(g.ev, ["user_id", "event_type"], ["k", "ts"], ["event_id"]))
case("D3_qualify", "l_orderkey:i l_linenumber:i l_partkey:i",
     """select l_orderkey, l_linenumber, l_partkey from lineitem
        qualify row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey, l_suppkey, l_extendedprice) = 1""")(
    lambda g: latest.latest_by(g.lineitem, ["l_orderkey", "l_linenumber"], ["l_shipdate"], ["l_partkey", "l_suppkey", "l_extendedprice"]))
case("D4_any_per_key", "n:i", "select count(distinct c_nationkey) n from customer")(
    lambda g: latest.any_by(g.customer, ["c_nationkey"]).agg(F.count(F.lit(1)).alias("n")))
case("D5_collapse", "user_id:i event_type:s event_id:i value:f", "select user_id, event_type, min(event_id) event_id, min(value) as value from ev group by all")(
    lambda g: latest.collapse(g.ev, ["user_id", "event_type"], ["event_id", "value"]))
case("D6_latest_values", "user_id:i kind:s k:i", "select user_id, arg_max(event_type, ts) kind, arg_max(k, ts) k from ev group by 1")(
    lambda g: latest.latest_values(g.ev, ["user_id"], ["ts"], {"kind": "event_type", "k": "k"}))
case("D7_insert_ignore", "user_id:i k:i event_id:i",
     "select user_id, k, min(event_id) event_id from ev where day > date '2024-01-20' and (user_id, k) not in (select user_id, k from ev where day <= date '2024-01-20') group by 1, 2")(
    lambda g: latest.insert_ignore(g.ev.filter("day <= '2024-01-20'"), g.ev.filter("day > '2024-01-20'"), ["user_id", "k"], ["event_id"]))

# --- incremental runs: old part first, then what is new --------------------------------------------

_OLD, _NEW = "day <= '2024-01-15'", "day > '2024-01-12'"


@case("I1_after_mark", "event_id:i", "select event_id from ev where day > date '2024-01-15'")
def i1(g: Given):
    rows = g.ev.withColumn("_version", F.unix_micros("ts"))
    return incremental.after_mark(rows.filter(_NEW), rows.filter(_OLD), "_version")


_MARKS = """select e.event_id from ev e left join (select event_type, max(ts) mark from ev where day <= date '2024-01-15' and k < 90 group by 1) m using (event_type)
    where day > date '2024-01-12' and (mark is null or ts > mark)"""


@case("I2_after_source_marks", "event_id:i", _MARKS)
def i2(g: Given):
    return incremental.after_source_marks(g.ev.filter(_NEW), g.ev.filter(_OLD + " and k < 90"), "ts", ["event_type"])


case("I3_lookback", "event_id:i", "select event_id from ev where day > date '2024-01-15' - 3")(
    lambda g: incremental.lookback(g.ev, g.ev.filter(_OLD), "day", 3))


@case("I4_touched_days", "event_id:i",
      "select event_id from ev where day in (select day from ev where ts + to_hours(k::int * 3) > (select max(ts + to_hours(k::int * 3)) from ev) - interval 3 day)")
def i4(g: Given):
    rows = g.ev.withColumn("_extracted_at", F.expr("ts + make_interval(0, 0, 0, 0, cast(k * 3 as int), 0, 0)"))
    return incremental.touched_days(rows, F.col("day"), "_extracted_at", 3)


case("I5_unknown_keys", "c_custkey:i", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)")(
    lambda g: incremental.unknown_keys(g.customer, g.orders.selectExpr("o_custkey as c_custkey"), ["c_custkey"]))


@case("I6_after_entity_marks", "event_id:i",
      """select event_id from ev left join (select user_id, max(ts) mark from ev where day <= date '2024-01-15' group by 1) using (user_id)
         where day > date '2024-01-12' and (mark is null or ts > mark)""")
def i6(g: Given):
    return incremental.after_entity_marks(g.ev.filter(_NEW), g.ev.filter(_OLD), ["user_id"], "ts")


@case("I7_full_refresh_switch", "mode:s n:i",
      "select 'full' mode, count(*) n from ev union all select 'incremental', count(*) from ev where day > date '2024-01-15'")
def i7(g: Given):
    count = lambda mode, df: df.agg(F.count(F.lit(1)).alias("n")).withColumn("mode", F.lit(mode))
    return count("full", incremental.after_source_marks(g.ev, None, "ts")).unionByName(
        count("incremental", incremental.after_source_marks(g.ev, g.ev.filter(_OLD), "ts", ["event_type"]).filter("day > '2024-01-15'")))


@case("S6_upsert_by_key", "user_id:i event_id:i k:i", "select user_id, arg_max(event_id, ts) event_id, arg_max(k, ts) k from ev group by 1")
def s6(g: Given):
    rows = g.ev.select("user_id", "event_id", "k", "ts")
    old = latest.latest_by(rows.filter("ts <= '2024-01-15'"), ["user_id"], ["ts"])
    return incremental.upsert_by_key(old, rows.filter("ts > '2024-01-15'"), ["user_id"], "ts")


# --- joins -----------------------------------------------------------------------------------------------

case("J1_inner_multi_key", "commit_hash:s person:s n:i",
     "select commit_hash, c.person_key person, count(*) n from file_changes f join commits c using (tenant_id, project_key, repo_slug, commit_hash) group by all")(
    lambda g: g.file_changes.join(g.commits, ["tenant_id", "project_key", "repo_slug", "commit_hash"]).groupBy(
        "commit_hash", F.lower("author_email").alias("person")).agg(F.count(F.lit(1)).alias("n")))
case("J2_left", "person_id:s n:i", "select p.person_id, count(event_id) n from people p left join ev on lower(email) = p.person_id group by 1")(
    lambda g: g.people.select("person_id").join(g.ev.select(F.lower("email").alias("person_id"), "event_id"), "person_id", "left").groupBy(
        "person_id").agg(F.count("event_id").alias("n")))
case("J3_full_outer", "key:i orders:i events:i",
     """select coalesce(o.k, e.k) as key, o.n orders, e.n as events from (select o_custkey k, count(*) n from orders group by 1) o
        full join (select user_id k, count(*) n from ev group by 1) e on o.k = e.k""")(
    lambda g: reshape.outer_on(
        g.orders.groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("orders")),
        g.ev.groupBy(F.col("user_id").alias("key")).agg(F.count(F.lit(1)).alias("events")), ["key"]))
case("J4_left_anti", "p_partkey:i", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem)")(
    lambda g: g.table("part").join(g.lineitem.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti"))
case("J5_left_semi", "o_orderkey:i", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_discount > 0.08)")(
    lambda g: g.orders.join(g.lineitem.filter("l_discount > 0.08").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi"))
case("J6_not_exists", "c_custkey:i", "select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > c.c_acctbal * 40)")(
    lambda g: g.customer.join(g.orders, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_totalprice") > F.col("c_acctbal") * 40), "left_anti"))


@case("J7_anchor_aggregate", "key:i orders:i spent:f events:i",
      """select coalesce(o.k, e.k) as key, coalesce(o.n, 0) orders, o.s spent, coalesce(e.n, 0) as events from (select o_custkey k, count(*) n, sum(o_totalprice) s from orders group by 1) o
         full join (select user_id k, count(*) n from ev group by 1) e on o.k = e.k""")
def j7(g: Given):
    one = F.lit(1)
    return reshape.anchor_aggregate(
        [(g.orders.withColumn("key", F.col("o_custkey")), {"o": one, "s": F.col("o_totalprice")}), (g.ev.withColumn("key", F.col("user_id")), {"e": one})],
        ["key"], {"orders": F.coalesce(F.sum("o"), F.lit(0)), "spent": F.sum("s"), "events": F.coalesce(F.sum("e"), F.lit(0))})


_SPANS = """with a as (select user_id, ts s, lead(ts) over (partition by user_id order by ts) e from ev where event_type = 'view'),
    b as (select user_id, ts s, lead(ts) over (partition by user_id order by ts) e from ev where event_type = 'purchase')
    select user_id, greatest(a.s, b.s) valid_from, case when a.e is null then b.e when b.e is null then a.e else least(a.e, b.e) end valid_to
    from a join b using (user_id) where b.s < coalesce(a.e, timestamp '9999-12-31') and coalesce(b.e, timestamp '9999-12-31') > a.s"""


@case("J8_overlap_join", "user_id:i valid_from:t valid_to:t", _SPANS)
def j8(g: Given):
    spans = lambda kind, a, b: ordered.with_neighbours(
        g.ev.filter(F.col("event_type") == kind).select("user_id", F.col("ts").alias(a)), ["user_id"], [a], following={b: F.col(a)})
    return reshape.overlap_join(spans("view", "a0", "a1"), spans("purchase", "b0", "b1"), ["user_id"], ("a0", "a1"), ("b0", "b1"))


case("J9_valid_at", "user_id:i event_type:s valid_from:t",
     """select user_id, event_type, ts valid_from from (select *, lead(ts) over (partition by user_id order by ts) e from ev)
        where ts <= timestamp '2024-01-15 12:00:00' and (e is null or e > timestamp '2024-01-15 12:00:00')""")(
    lambda g: reshape.valid_at(
        ordered.with_neighbours(g.ev, ["user_id"], ["ts"], following={"valid_to": F.col("ts")}).withColumn("valid_from", F.col("ts")),
        F.lit("2024-01-15 12:00:00").cast("timestamp")))


@case("J10_join_by_kind", "event_id:i person_id:s",
      """select event_id, case when event_type = 'click' then (select lower(c_name) from customer where c_custkey = user_id)
           else (select lower(c_name) from customer where c_custkey = k) end person_id from ev""")
def j10(g: Given):
    by_key = g.customer.select(F.col("c_custkey").cast("string").alias("key"), F.lower("c_name").alias("person_id"))
    return reshape.join_by_kind(g.ev, by_key, "user_id", by_key, "k", F.col("event_type") == "click", "person_id")


case("J12_preaggregated_child", "o_orderkey:i lines:i quantity:f",
     "select o_orderkey, count(l_orderkey) as lines, sum(l_quantity) quantity from orders left join lineitem on l_orderkey = o_orderkey group by 1")(
    lambda g: g.orders.select("o_orderkey").join(
        g.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity")),
        "o_orderkey", "left").withColumn("lines", F.coalesce("lines", F.lit(0))))
case("J13_using", "n_name:s r_name:s", "select n_name, r_name from nation join region on n_regionkey = r_regionkey")(
    lambda g: g.table("nation").withColumnRenamed("n_regionkey", "r_regionkey").join(g.table("region"), "r_regionkey"))

# --- aggregation ---------------------------------------------------------------------------------------------

case("A1_aggregate", "l_returnflag:s l_linestatus:s n:i qty:f price:f disc:f first:d",
     """select l_returnflag, l_linestatus, count(*) n, sum(l_quantity) qty, sum(l_extendedprice) price, avg(l_discount) disc, min(l_shipdate) as first
        from lineitem group by 1, 2""")(
    lambda g: g.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"), F.avg("l_discount").alias("disc"),
        F.min("l_shipdate").alias("first")))
case("A2_conditional", "user_id:i clicks:i spent:f low:f",
     "select user_id, count(*) filter (event_type = 'click') clicks, sum(value) filter (event_type = 'purchase') spent, avg(k) filter (k < 10) low from ev group by 1")(
    lambda g: g.ev.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("clicks"),
                                          F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("spent"),
                                          F.avg(F.when(F.col("k") < 10, F.col("k"))).alias("low")))
case("A3_exact_distinct", "event_type:s users:i pairs:i", "select event_type, count(distinct user_id) users, count(distinct (user_id, k)) pairs from ev group by 1")(
    lambda g: g.ev.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.struct("user_id", "k")).alias("pairs")))
case("A4_any", "o_custkey:i present:b", "select o_custkey, true present from orders group by 1")(
    lambda g: g.orders.groupBy("o_custkey").agg(F.any_value("o_orderstatus", True).isNotNull().alias("present")))
case("A5_arg_max", "user_id:i last_view:i", "select user_id, arg_max(event_id, (ts, event_id)) filter (event_type = 'view') last_view from ev group by 1")(
    lambda g: g.ev.groupBy("user_id").agg(F.max_by("event_id", F.when(F.col("event_type") == "view", F.struct("ts", "event_id"))).alias("last_view")))
_QUANTILES = "select {} , quantile_disc({}, 0.25) p25, quantile_disc({}, 0.5) p50, quantile_disc({}, 0.95) p95 from {} group by 1"
case("A6_exact_quantiles", "event_type:s p25:f p50:f p95:f", _QUANTILES.format("event_type", "value", "value", "value", "ev"))(
    lambda g: quantiles.exact_quantiles(g.ev, ["event_type"], "value", {"p25": 0.25, "p50": 0.5, "p95": 0.95}))
case("A6_quantiles_signed", "c_nationkey:i p25:f p50:f p95:f", _QUANTILES.format("c_nationkey", "c_acctbal", "c_acctbal", "c_acctbal", "customer"))(
    lambda g: quantiles.exact_quantiles(g.customer, ["c_nationkey"], "c_acctbal", {"p25": 0.25, "p50": 0.5, "p95": 0.95}))
case("A7_collect", "n_regionkey:i names:a", "select n_regionkey, list_sort(list(n_name)) names from nation group by 1")(
    lambda g: g.table("nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names")))
case("A8_having", "o_custkey:i n:i", "select o_custkey, count(*) n from orders group by 1 having count(*) > 12")(
    lambda g: rollup.having(g.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), F.col("n") > 12))


@case("A9_two_stage", "c_mktsegment:s mean:f median:f",
      """select c_mktsegment, avg(s) mean, quantile_disc(s, 0.5) median from (select o_custkey, c_mktsegment, round(sum(o_totalprice), 2) s from orders
         join customer on c_custkey = o_custkey group by all) group by 1""")
def a9(g: Given):
    people = g.orders.join(g.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("o_custkey", "c_mktsegment").agg(F.round(F.sum("o_totalprice"), 2).alias("s"))
    return people.groupBy("c_mktsegment").agg(F.avg("s").alias("mean")).join(
        quantiles.exact_quantiles(people, ["c_mktsegment"], "s", {"median": 0.5}), "c_mktsegment")


_LONG = "select lower(email) person_id, event_type metric_key, k::double metric_value from ev"


def _long(g: Given):
    return g.ev.select(F.lower("email").alias("person_id"), F.col("event_type").alias("metric_key"), F.col("k").cast("double").alias("metric_value"))


case("A10_ratio_of_sums", "person_id:s share:f",
     f"""select person_id, case when sum(metric_value) filter (metric_key = 'view') > 0 then least(100, round(100 * coalesce(sum(metric_value) filter (metric_key = 'click'), 0)
         / sum(metric_value) filter (metric_key = 'view'), 1)) end share from ({_LONG}) group by 1""")(
    lambda g: _long(g).groupBy("person_id").agg(rollup.percent(rollup.total("click"), rollup.total("view"), cap=100.0).alias("share")))
case("A11_fold_accuracy", "person_id:s accuracy:f",
     f"""select person_id, case when count(*) filter (metric_key = 'view' and metric_value > 0 and metric_value <= 200) > 0 then
         greatest(0, 100 - avg(abs(100 - metric_value)) filter (metric_key = 'view' and metric_value > 0 and metric_value <= 200)) end accuracy from ({_LONG}) group by 1""")(
    lambda g: _long(g).groupBy("person_id").agg(rollup.fold_accuracy("view").alias("accuracy")))
case("A12_minimum_support", "person_id:s rate:f",
     f"""select person_id, case when coalesce(sum(v) filter (v > 0), 0) >= 5 then round(abs(coalesce(sum(v) filter (v < 0), 0)) / sum(v) filter (v > 0) * 100, 1) end rate
         from (select person_id, case when metric_key = 'view' then 1 else -1 end v from ({_LONG}) where metric_key in ('view', 'error')) group by 1""")(
    lambda g: _long(g).filter("metric_key in ('view', 'error')").selectExpr(
        "person_id", "'moves' as metric_key", "case when metric_key = 'view' then 1.0D else -1.0D end as metric_value").groupBy("person_id").agg(
        rollup.supported_ratio("moves").alias("rate")))
case("A13_by_rule", "metric_key:s person_id:s v:f",
     f"""select metric_key, person_id, case when metric_key in ('view','click') then sum(metric_value) when metric_key = 'error' then max(metric_value) else avg(metric_value) end v
         from ({_LONG}) group by 1, 2""")(
    lambda g: _long(g).groupBy("metric_key", "person_id").agg(rollup.by_rule({"sum": ("view", "click"), "max": ("error",)}).alias("v")))
case("A14_nested_aggregate", "c_nationkey:i per_customer:f",
     "select c_nationkey, avg(n) per_customer from (select c_custkey, c_nationkey, count(o_orderkey) n from customer left join orders on o_custkey = c_custkey group by all) group by 1")(
    lambda g: g.customer.join(g.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n")), "c_custkey", "left").groupBy(
        "c_nationkey").agg(F.avg(F.coalesce("n", F.lit(0))).alias("per_customer")))


@case("J11_group_distribution", "person_id:s metric_key:s value:f median:f top:f",
      f"""with v as (select person_id, metric_key, sum(metric_value) v from ({_LONG}) group by 1, 2)
          select person_id, metric_key, v as value, median, top from v join (select metric_key, quantile_disc(v, 0.5) median, max(v) top from v group by 1) using (metric_key)""")
def j11(g: Given):
    values = _long(g).groupBy("person_id", "metric_key").agg(F.sum("metric_value").alias("v"))
    ranges = rollup.cohort_range(values, rollup.Metrics(values={}), [])
    return values.join(ranges, "metric_key").selectExpr("person_id", "metric_key", "v as value", "median", "range_max as top")


# --- windows ---------------------------------------------------------------------------------------------------

case("W1_row_number", "event_id:i position:i", "select event_id, row_number() over (partition by user_id order by ts, event_id) as position from ev")(
    lambda g: ordered.with_position(g.ev, ["user_id"], ["ts", "event_id"]))
case("W2_lag", "event_id:i was:s gap:i", "select event_id, lag(event_type) over w was, k - lag(k) over w gap from ev window w as (partition by user_id order by ts, event_id)")(
    lambda g: ordered.with_neighbours(g.ev, ["user_id"], ["ts", "event_id"], previous={"was": "event_type", "k0": "k"}).withColumn("gap", F.col("k") - F.col("k0")))
case("W3_lead", "o_orderkey:i next_order:i next_date:d",
     "select o_orderkey, lead(o_orderkey) over w next_order, lead(o_orderdate) over w next_date from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")(
    lambda g: ordered.with_neighbours(g.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], following={"next_order": "o_orderkey", "next_date": "o_orderdate"}))
case("W4_running_sum", "o_orderkey:i total:f", "select o_orderkey, sum(trunc(o_totalprice)) over (partition by o_custkey order by o_orderdate) total from orders")(
    lambda g: ordered.with_running_sum(g.orders, ["o_custkey"], ["o_orderdate"], F.floor("o_totalprice"), "total"))

_SESSION = """select event_id, sum(case when last is null or date_diff('second', last, ts) > {gap} then 1 else 0 end) over (partition by user_id order by ts) session_no
    from (select *, lag({end}) over (partition by user_id order by ts, event_id) as last from (select *, ts + to_seconds(k * 60) te from ev))"""
case("W5_sessionize", "event_id:i session_no:i", _SESSION.format(gap=28800, end="ts"))(
    lambda g: sessionize(g.ev, ["user_id"], "ts", 28800, ties=["event_id"]))
case("W5_sessionize_by_end", "event_id:i session_no:i", _SESSION.format(gap=18000, end="te"))(
    lambda g: sessionize(g.ev.withColumn("te", F.expr("timestamp_micros(unix_micros(ts) + k * 60000000)")), ["user_id"], "ts", 18000, "te", ["event_id"]))

# --- order, limit, sets -------------------------------------------------------------------------------------------

case("L1_order", "o_orderkey:i o_totalprice:f", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey")(
    lambda g: select_rows(g.orders, orderby=["-o_totalprice", "o_orderkey"]))
case("L2_top_k", "o_orderkey:i o_totalprice:f", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 26")(
    lambda g: select_rows(g.orders, orderby=["-o_totalprice", "o_orderkey"], top=26))
case("L3_limit_offset", "c_custkey:i", "select c_custkey from customer order by c_acctbal, c_custkey limit 20 offset 40")(
    lambda g: select_rows(g.customer, orderby=["c_acctbal", "c_custkey"], top=20, skip=40))
case("U1_union_all", "key:i source:s", "select o_orderkey as key, 'orders' source from orders union all select event_id, 'events' from ev")(
    lambda g: reshape.union_all([g.orders.select(F.col("o_orderkey").alias("key"), F.lit("orders").alias("source")),
                                 g.ev.select(F.col("event_id").alias("key"), F.lit("events").alias("source"))]))
case("U2_union_distinct", "key:i", "select o_custkey as key from orders union select user_id from ev")(
    lambda g: g.orders.select(F.col("o_custkey").alias("key")).union(g.ev.select("user_id")).distinct())


@case("U3_union_by_class", "unique_key:s value:i source:s",
      """select unique_key, value, source from (select user_id::varchar unique_key, event_id as value, 'late' source, epoch_us(ts) _version from ev where day > date '2024-01-10'
         union all select user_id::varchar, event_id, 'early', epoch_us(ts) from ev where day <= date '2024-01-20') qualify row_number() over (partition by unique_key order by _version desc) = 1""")
def u3(g: Given):
    rows = g.ev.select(F.col("user_id").cast("string").alias("unique_key"), F.col("event_id").alias("value"), F.unix_micros("ts").alias("_version"), "day")
    early = rows.filter("day <= '2024-01-20'").withColumn("source", F.lit("early"))
    late = rows.filter("day > '2024-01-10'").withColumn("source", F.lit("late"))
    # Both sources hold the days between; the newest version is after them.
    return union_by_class(g.spark, "identity_inputs", [late, early])


@case("U4_table_and_archive", "n:i", "select count(*) n from orders")
def u4(g: Given):
    from workmart.plans.registry import Landed

    t = Landed(g.spark, {"b.orders": g.orders.filter("o_orderstatus = 'O'"), "b.orders_archived": g.orders.filter("o_orderstatus != 'O'")})
    return t.together("b.orders", "b.orders_archived", "b.orders_lost").agg(F.count(F.lit(1)).alias("n"))


case("U5_unpivot", "o_orderkey:i metric_key:s metric_value:f",
     "select o_orderkey, unnest(['price','items']) metric_key, unnest([o_totalprice, length(o_orderpriority)::double]) metric_value from orders")(
    lambda g: reshape.unpivot(g.orders, ["o_orderkey"], {"price": "o_totalprice", "items": F.length("o_orderpriority")}))
case("U5_pivot_latest", "user_id:i view:i click:i",
     "select user_id, arg_max(k, ts) filter (event_type = 'view') as view, arg_max(k, ts) filter (event_type = 'click') click from ev group by 1 having count(*) filter (event_type in ('view','click')) > 0")(
    lambda g: reshape.pivot_latest(g.ev, ["user_id"], "event_type", "k", ["view", "click"], ["ts"]))
case("U6_explode", "p_partkey:i word:s", "select p_partkey, unnest(string_split(p_name, ' ')) word from part")(
    lambda g: g.table("part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word")))

# --- scalar functions ------------------------------------------------------------------------------------------------

case("F_strings", "p_partkey:i a:s b:s c:i d:b e:s",
     "select p_partkey, lower(trim(p_brand)) || '/' || p_type a, string_split(p_name, ' ')[1] b, instr(p_name, 'e') c, starts_with(p_name, 'red') d, regexp_extract(p_brand, '(\\d+)', 1) e from part")(
    lambda g: g.table("part").select(
        "p_partkey", F.concat(S.normal_email("p_brand"), F.lit("/"), "p_type").alias("a"), F.element_at(F.split("p_name", " "), 1).alias("b"),
        F.instr("p_name", "e").alias("c"), F.col("p_name").startswith("red").alias("d"), F.regexp_extract("p_brand", r"(\d+)", 1).alias("e")))
case("F_dates", "event_id:i ms:i back:t seconds:i days:i monday:d label:s",
     f"""select event_id, epoch_us(ts) // 1000 ms, make_timestamp(epoch_us(ts) // 1000 * 1000) back, date_diff('second', ts, timestamp '{AS_OF}') as seconds, date_diff('day', ts::date, date '{AS_OF[:10]}') as days,
        date_trunc('week', ts) monday, strftime(ts, '%b %d') label from ev""")(
    lambda g: g.ev.select(
        "event_id", S.millis("ts").alias("ms"), S.from_millis(S.millis("ts")).alias("back"), S.seconds_between(F.col("ts"), g.as_of).alias("seconds"),
        F.date_diff(F.to_date(g.as_of), F.to_date("ts")).alias("days"), S.week("ts").alias("monday"), F.date_format("ts", "MMM dd").alias("label")))
case("F_parse_moment", "event_id:i at:t bad:t", "select event_id, date_trunc('second', ts) as at, null::timestamp bad from ev")(
    lambda g: g.ev.select("event_id", S.moment(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("at"), S.moment("event_type").alias("bad")))
case("F_iso_duration", "event_id:i seconds:f", "select event_id, (k % 3) * 86400 + k * 3600 + (k % 60) * 60 + k % 7 + 0.5 as seconds from ev")(
    lambda g: g.ev.select("event_id", S.iso_duration_seconds(F.expr("concat('P', k % 3, 'DT', k, 'H', k % 60, 'M', k % 7, '.5S')")).alias("seconds")))
case("F_json", "event_id:i k:f text:s missing:s size:i",
     "select event_id, k, k::varchar as text, '' missing, 2 size from ev")(
    lambda g: g.table("events").select(
        "event_id", S.json_number("props", "k").alias("k"), S.json_text("props", "k").alias("text"), S.json_text("props", "none", "deep").alias("missing"),
        F.size(S.json_items(F.to_json(F.array("event_type", "event_type")))).alias("size")))
case("F_arrays", "user_id:i n:i has_view:b first:s",
     "select user_id, len(list_distinct(list(event_type))) n, list_contains(list(event_type), 'view') has_view, list_sort(list(event_type))[1] as first from ev group by 1")(
    lambda g: g.ev.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds")).select(
        "user_id", F.size(F.array_distinct("kinds")).alias("n"), F.exists("kinds", lambda x: x == "view").alias("has_view"), S.first_item("kinds").alias("first")))
case("F_math", "event_id:i half:f low:f size:f top:i",
     "select event_id, round(value, 1) half, floor(value / 4) * 4 low, abs(value - 100) size, greatest(k, 10, least(k * 2, 50)) top from ev")(
    lambda g: g.ev.select("event_id", F.round("value", 1).alias("half"), (F.floor(F.col("value") / 4) * 4).alias("low"), F.abs(F.col("value") - 100).alias("size"),
                          F.greatest("k", F.lit(10), F.least(F.col("k") * 2, F.lit(50))).alias("top")))
