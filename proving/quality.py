"""Cases: data-quality checks, on rows that break the rules here and there."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from proving.case import case
from proving.given import Given
from workmart.operators import quality


def _faulty(g: Given) -> DataFrame:
    return g.ev.selectExpr(
        "'src' as source_id", "'jira' as data_source", "cast(user_id as string) as issue_id", "concat('T-', user_id) as id_readable", "event_type as field_id", "ts as event_at",
        "case when k < 5 then concat('initial:', user_id) when k < 8 then '7' else cast(event_id as string) end as event_id",
        "case when k % 10 = 0 then 'synthetic_initial' else 'changelog' end as event_kind", "case when k % 2 = 0 then 'single' else 'multi' end as field_cardinality",
        "element_at(array('set','add','remove','drop'), cast(k % 4 + 1 as int)) as delta_action",
        "transform(sequence(1, cast(k % 3 + 1 as int)), i -> concat('v', i % 2)) as value_ids",
        "case when k = 77 then array('a, b') else transform(sequence(1, cast(k % 3 + 1 as int)), i -> concat('v', i % 2)) end as value_displays",
        "case when k < 50 or event_type = 'view' then 'opaque_id' else 'none' end as value_id_type")


_F = """select user_id::varchar issue_id, event_type field_id, case when k < 5 then 'initial:' || user_id when k < 8 then '7' else event_id::varchar end event_id, ts event_at,
    case when k % 10 = 0 then 'synthetic_initial' else 'changelog' end event_kind, case when k % 2 = 0 then 'single' else 'multi' end card,
    (['set','add','remove','drop'])[k % 4 + 1] act, k % 3 + 1 n_ids, case when k = 77 then 1 else k % 3 + 1 end n_shown, k, value_id_type from (
      select *, case when k < 50 or event_type = 'view' then 'opaque_id' else 'none' end value_id_type from ev)"""
_ROW = "issue_id:s field_id:s event_id:s"
_PICK = f"select issue_id, field_id, event_id from ({_F}) where "

_M = "select person_key, date, event_type, 'one' data_source, audio_duration_seconds a, video_duration_seconds v, screen_share_duration_seconds s from meetings"


def _meetings(g: Given) -> DataFrame:
    """All meetings under one data source, so that sources and days meet."""
    return g.meetings.withColumn("data_source", F.lit("one")).withColumn("source_id", F.col("event_type"))


case("C1_one_source", "tenant_id:s data_source:s distinct_source_ids:i", f"select 't1' tenant_id, data_source, count(distinct event_type) distinct_source_ids from ({_M}) group by all having count(distinct event_type) > 1")(
    lambda g: quality.one_source_per_data_source(_meetings(g)))
case("C2_unique_person_day", "person_key:s date:d n:i", f"select person_key, date, count(*) n from ({_M}) group by all having count(*) > 1")(lambda g: quality.unique_person_day(_meetings(g)))
case("C3_duration_caps", "person_key:s date:d event_type:s", f"select person_key, date, event_type from ({_M}) where v > a or s > a")(lambda g: quality.duration_caps(_meetings(g)))
case("C4_kpi_bounds", "c_custkey:i", "select c_custkey from customer where c_acctbal / 90 < 0 or c_acctbal / 90 > 100 or c_nationkey - 2 < 0")(
    lambda g: quality.kpi_bounds(g.customer.selectExpr("c_custkey", "c_acctbal / 90 as focus_time_pct", "c_nationkey - 2 as tasks_closed", "0 as bugs_fixed", "cast(null as double) as ai_sessions")))
case("C5_working_hours", "c_custkey:i", "select c_custkey from customer where c_acctbal / 300 <= 0 or c_acctbal / 300 > 24")(
    lambda g: quality.working_hours_bounds(g.customer.selectExpr("c_custkey", "c_acctbal / 300 as working_hours_per_day")))
case("C6_untraced_changes", _ROW, _PICK + "event_kind = 'changelog' and (issue_id, field_id, event_id) not in (select user_id::varchar, event_type, event_id::varchar from ev where k > 20)")(
    lambda g: quality.untraced_changes(_faulty(g), g.ev.filter("k > 20").selectExpr(
        "'src' as source_id", "concat('T-', user_id) as id_readable", "cast(event_id as string) as changelog_id", "event_type as field_id")))
case("C7_action_fits_cardinality", _ROW, _PICK + "event_kind = 'changelog' and ((card = 'single' and act <> 'set') or (card = 'multi' and act not in ('set','add','remove')))")(
    lambda g: quality.action_fits_cardinality(_faulty(g)))
case("C8_kind_fits_event_id", _ROW, _PICK + "(event_kind = 'changelog') = starts_with(event_id, 'initial:')")(lambda g: quality.kind_fits_event_id(_faulty(g)))
case("C9_initial_is_earliest", "issue_id:s field_id:s first_initial:t first_changelog:t",
     f"""select issue_id, field_id, min(event_at) filter (event_kind = 'synthetic_initial') first_initial, min(event_at) filter (event_kind = 'changelog') first_changelog from ({_F}) group by 1, 2
         having min(event_at) filter (event_kind = 'synthetic_initial') > min(event_at) filter (event_kind = 'changelog') + interval 60 second""")(lambda g: quality.initial_is_earliest(_faulty(g)))
case("C10_untraced_initials", _ROW, _PICK + "event_kind = 'synthetic_initial' and issue_id not in (select c_custkey::varchar from customer where c_nationkey > 10)")(
    lambda g: quality.untraced_initials(_faulty(g), g.customer.filter("c_nationkey > 10").selectExpr("'src' as source_id", "concat('T-', c_custkey) as id_readable")))
case("C11_comma_lists", _ROW, _PICK + "card = 'multi' and k = 77")(lambda g: quality.comma_lists(_faulty(g)))
case("C12_repeated_items", _ROW, _PICK + "n_ids = 3")(lambda g: quality.repeated_items(_faulty(g)))
case("C13_repeated_rows", "id_readable:s field_id:s event_id:s n:i", f"select 'T-' || issue_id id_readable, field_id, event_id, count(*) n from ({_F}) group by all having count(*) > 1")(
    lambda g: quality.repeated_rows(_faulty(g)))
case("C14_single_values", _ROW, _PICK + "card = 'single' and n_ids > 1")(lambda g: quality.single_values(_faulty(g)))
case("C15_paired_arrays", _ROW, _PICK + "n_ids <> n_shown")(lambda g: quality.paired_arrays(_faulty(g)))
case("C16_one_id_type", "field_id:s observed_types:a", f"select field_id, list_sort(list(distinct value_id_type)) observed_types from ({_F}) group by 1 having count(distinct value_id_type) > 1")(
    lambda g: quality.one_id_type_per_field(_faulty(g)))


def _comments(g: Given, kind: str, reply: bool) -> DataFrame:
    rows = g.ev.filter(F.col("event_type") == kind)
    if not reply:
        return rows.selectExpr("'t1' as tenant_id", "'src' as source_id", "cast(k as string) as comment_id")
    return rows.selectExpr("'t1' as tenant_id", "'src' as source_id", "cast(event_id as string) as comment_id", "case when k < 10 then '' else cast(k as string) end as page_id",
                           "case when k % 5 = 0 then null else cast(user_id as string) end as parent_comment_id")


case("C17_replies_without_page", "kind:s comment_id:s", "select case event_type when 'click' then 'footer_reply' else 'inline_reply' end kind, event_id comment_id from ev where event_type in ('click','error') and k < 10")(
    lambda g: quality.replies_without_page(_comments(g, "click", True), _comments(g, "error", True)))
case("C18_replies_without_parent", "kind:s comment_id:s",
     """select 'footer_reply' kind, event_id comment_id from ev where event_type = 'click' and k % 5 <> 0 and user_id not in (select k from ev where event_type = 'view')
        union all select 'inline_reply', event_id from ev where event_type = 'error' and k % 5 <> 0 and user_id not in (select k from ev where event_type = 'purchase')""")(
    lambda g: quality.replies_without_parent(_comments(g, "click", True), _comments(g, "error", True), _comments(g, "view", False), _comments(g, "purchase", False)))
case("C19_generic", "check:s violations:i",
     """select 'not_null' as check, count(*) violations from orders where o_orderpriority = '5-LOW' union all select 'unique', count(*) from (select o_custkey from orders group by 1 having count(*) > 1)
        union all select 'accepted_values', count(*) from orders where o_orderstatus not in ('F','O')""")(
    lambda g: quality.run_checks([
        quality.Check("not_null", "crm", "validity", "bronze", quality.not_null(g.orders.withColumn("p", F.nullif("o_orderpriority", F.lit("5-LOW"))), "p")),
        quality.Check("unique", "crm", "uniqueness", "bronze", quality.unique(g.orders, "o_custkey")),
        quality.Check("accepted_values", "crm", "validity", "bronze", quality.accepted_values(g.orders, "o_orderstatus", ["F", "O"]))]))
case("L4_sample", "n:i", "select least(100, count(*)) n from orders where o_orderstatus not in ('F','O')")(
    lambda g: quality.sample(quality.accepted_values(g.orders, "o_orderstatus", ["F", "O"])).agg(F.count(F.lit(1)).alias("n")))
