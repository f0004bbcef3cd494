"""Cases: change history, issues, field history."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from proving.case import case
from proving.given import Given
from workmart.operators import history, issues
from workmart.operators.latest import latest_by
from workmart.plans.registry import Landed
from workmart.plans.staging.people import seed_aliases, seed_identity_inputs, seed_persons
from workmart.session import store

TRACKED = ["status", "priority"]


def _first_last(g: Given) -> tuple[DataFrame, DataFrame]:
    old = g.versions.filter("_tracked_at < '1998-01-01'")
    return old, latest_by(g.versions, ["unique_key"], ["_tracked_at"], ["o_orderkey"])


_NEWEST = "select * from versions qualify row_number() over (partition by id order by tracked_at desc, o_orderkey) = 1"
_HELD = "select id, arg_max(status || '/' || priority || '/' || size, tracked_at) held from versions where tracked_at < timestamp '1998-01-01' group by 1"


@case("H1_scd2_append", "id:s status:s priority:s",
      f"select id, status, priority from ({_NEWEST}) n left join ({_HELD}) h using (id) where held is null or held <> status || '/' || priority || '/' || size")
def h1(g: Given):
    old, now = _first_last(g)
    # The history as it was: all versions of before, hashed the same way.
    held = history.scd2_append(old, None, "unique_key", TRACKED, ["size"], "_tracked_at")
    return history.scd2_append(now, held, "unique_key", TRACKED, ["size"], g.as_of)


_CHANGES = """select id, field_name, old_value, new_value, tracked_at from (
      select *, unnest(['status','priority','size']) field_name, unnest([coalesce(lag(status) over w, ''), coalesce(lag(priority) over w, ''), coalesce(lag(size) over w, '')]) old_value,
        unnest([status, priority, size]) new_value from versions window w as (partition by id order by tracked_at, [status, priority, size]))
    where old_value <> new_value"""


def _changes(g: Given) -> DataFrame:
    return history.field_changes(g.versions, "unique_key", "id", TRACKED, ["size"])


case("H2_field_changes", "entity_id:s field_name:s old_value:s new_value:s updated_at:t",
     f"select id entity_id, field_name, old_value, new_value, tracked_at updated_at from ({_CHANGES})")(_changes)

_INPUTS = f"""with c as ({_CHANGES})
    select id source_account_id, 'status' value_type, new_value as value, 'UPSERT' operation_type, tracked_at from c where field_name = 'status'
    union all select id, 'rank', new_value, 'UPSERT', tracked_at from c where field_name = 'priority'
    union all select id, 'id', id, 'UPSERT', tracked_at from c
    union all select id, unnest(['status','rank','id']), '', 'DELETE', tracked_at from c where field_name = 'status' and new_value = 'P'"""


@case("H3_identity_inputs", "source_account_id:s value_type:s value:s operation_type:s _synced_at:t",
      f"select source_account_id, value_type, value, operation_type, tracked_at _synced_at from ({_INPUTS})")
def h3(g: Given):
    gone = (F.col("field_name") == "status") & (F.col("new_value") == "P")
    return history.identity_inputs(_changes(g), "crm", [("status", "status", "t.status"), ("priority", "rank", "t.priority")], gone)


def _landed(g: Given) -> Landed:
    """Customers as a landed member list with a repeated row each."""
    rows = g.customer.selectExpr(
        "cast(c_custkey as string) as id", "c_name as email", "case when c_nationkey = 3 then '' else c_name end as name", "'t1' as tenant_id",
        "case when c_nationkey < 5 then '' else c_mktsegment end as role", "c_acctbal < 0 as isRemoved",
        "inline(array(named_struct('_extracted_at', timestamp'2024-01-01 00:00:00'), named_struct('_extracted_at', timestamp'2024-01-02 00:00:00')))")
    return Landed(g.spark, {"bronze_cursor.cursor_members": rows}, g.as_of)


_NEW_FACTS = """select c_custkey::varchar source_account_id, 'email' value_type, lower(c_name) as value from customer where c_nationkey > 0
    union all select c_custkey::varchar, 'id', c_custkey::varchar from customer where c_nationkey > 0
    union all select c_custkey::varchar, 'display_name', c_name from customer where c_nationkey > 0 and c_nationkey <> 3"""
case("H4_seed_identity_inputs", "source_account_id:s value_type:s value:s", _NEW_FACTS)(
    lambda g: seed_identity_inputs(_landed(g), "cursor", seed_identity_inputs(_landed(g), "cursor").join(
        g.customer.filter("c_nationkey = 0").selectExpr("cast(c_custkey as string) as source_account_id"), "source_account_id", "left_semi")))
case("H5_seed_persons", "email:s status:s role:s display_name:s completeness_score:f",
     """select lower(c_name) email, case when c_acctbal < 0 then 'inactive' else 'active' end status, case when c_nationkey < 5 then '' else c_mktsegment end as role,
        case when c_nationkey = 3 then '' else c_name end display_name, (1 + (c_nationkey <> 3)::int + (c_nationkey >= 5)::int) / 7.0 completeness_score
        from customer where c_nationkey <> 7""")(
    lambda g: seed_persons(_landed(g), "cursor", seed_persons(_landed(g), "cursor").join(
        g.customer.filter("c_nationkey = 7").selectExpr("lower(c_name) as email"), "email", "left_semi")))
case("H6_seed_aliases", "source_account_id:s value_type:s value:s", _NEW_FACTS.replace("c_nationkey > 0", "c_nationkey >= 0"))(
    lambda g: seed_aliases(_landed(g), "cursor", seed_persons(_landed(g), "cursor")))


# --- landed issue JSON ------------------------------------------------------------------------

def _issues(g: Given) -> DataFrame:
    return g.orders.selectExpr(
        "'src' as source_id", "'t1' as tenant_id", "o_orderkey as jira_id", "concat('T-', o_orderkey) as id_readable", "cast(o_orderdate as string) as created",
        "cast(o_orderkey as string) as unique_key", "timestamp'2024-01-01 00:00:00' as _extracted_at", "'P' as project_key", "cast(null as string) as parent_id",
        "case when o_orderpriority = '5-LOW' then '' else cast(to_date(o_orderdate) as string) end as due_date",
        """to_json(named_struct('status', named_struct('id', o_orderstatus, 'name', concat('S', o_orderstatus)), 'priority', named_struct('id', substr(o_orderpriority, 1, 1), 'name', o_orderpriority),
           'reporter', named_struct('accountId', concat('u', o_custkey), 'displayName', 'R'), 'labels', array(o_orderpriority, o_orderstatus))) as custom_fields_json""")


case("H7_current_fields", "issue_id:s field_id:s ids:a shown:a",
     """select o_orderkey::varchar issue_id, 'status' field_id, [o_orderstatus] ids, ['S' || o_orderstatus] shown from orders
        union all select o_orderkey::varchar, 'priority', [substr(o_orderpriority, 1, 1)], [o_orderpriority] from orders
        union all select o_orderkey::varchar, 'reporter', ['u' || o_custkey], ['R'] from orders
        union all select o_orderkey::varchar, 'project', ['P'], ['P'] from orders
        union all select o_orderkey::varchar, 'labels', [o_orderpriority, o_orderstatus], [o_orderpriority, o_orderstatus] from orders
        union all select o_orderkey::varchar, 'due_date', case when o_orderpriority = '5-LOW' then [] else [o_orderdate::date::varchar] end,
          case when o_orderpriority = '5-LOW' then [] else [o_orderdate::date::varchar] end from orders
        union all select o_orderkey::varchar, unnest(['issuetype','resolution','assignee','parent']), [], [] from orders""")(
    lambda g: issues.current_fields(_issues(g)).selectExpr("issue_id", "field_id", "current.id as ids", "current.display as shown"))


def _log(g: Given) -> DataFrame:
    """One change log entry per order, with an item per priority change and a
    repeated item."""
    return g.orders.selectExpr(
        "'src' as source_id", "'t1' as tenant_id", "concat('T-', o_custkey) as id_readable", "o_orderkey as changelog_id", "cast(o_orderdate as string) as created_at",
        "concat('u', o_custkey) as author_account_id", "cast(o_orderkey as string) as unique_key", "timestamp'2024-01-01 00:00:00' as _extracted_at",
        """to_json(array(
             named_struct('fieldId', 'status', 'field', 'Status', 'from', '', 'fromString', 'x', 'to', o_orderstatus, 'toString', concat('S', o_orderstatus)),
             named_struct('fieldId', 'status', 'field', 'Status', 'from', '', 'fromString', 'x', 'to', o_orderstatus, 'toString', concat('S', o_orderstatus)),
             named_struct('fieldId', '', 'field', 'none', 'from', '', 'fromString', '', 'to', '', 'toString', ''),
             named_struct('fieldId', 'labels', 'field', 'Labels', 'from', if(o_orderstatus = 'F', o_orderpriority, ''), 'fromString', if(o_orderstatus = 'F', o_orderpriority, ''),
               'to', if(o_orderstatus = 'F', '', o_orderpriority), 'toString', if(o_orderstatus = 'F', '', o_orderpriority)))) as items""")


_ITEMS = """select 'T-' || o_custkey id_readable, o_orderkey::varchar changelog_id, 'status' field_id, null value_from, 'x' value_from_string, o_orderstatus value_to, 'S' || o_orderstatus value_to_string from orders
    union all select 'T-' || o_custkey, o_orderkey::varchar, 'labels', case when o_orderstatus = 'F' then o_orderpriority end, case when o_orderstatus = 'F' then o_orderpriority end,
      case when o_orderstatus <> 'F' then o_orderpriority end, case when o_orderstatus <> 'F' then o_orderpriority end from orders"""
case("H8_explode_changelog", "id_readable:s changelog_id:s field_id:s value_from:s value_from_string:s value_to:s value_to_string:s", _ITEMS)(
    lambda g: issues.explode_changelog(_log(g)))


def _deltas(g: Given) -> DataFrame:
    items = issues.explode_changelog(_log(g)).withColumn("is_multi", F.col("field_id") == "labels")
    return issues.to_delta(items)


case("H9_to_delta", "changelog_id:s field_id:s kind:s before:a after:a",
     f"""select changelog_id, field_id, case when field_id = 'status' then 'set' when value_to is not null then 'add' else 'remove' end kind,
         case when field_id = 'labels' and value_from is not null then [value_from] else [] end before, case when value_to is not null then [value_to] else [] end "after" from ({_ITEMS})""")(
    lambda g: _deltas(g).selectExpr("changelog_id", "field_id", "kind", "before.id as before", "after.id as after"))


def _meta(g: Given) -> DataFrame:
    return g.spark.createDataFrame(
        [("src", "status", "Status", False, "opaque_id"), ("src", "labels", "Labels", True, "string_literal")],
        "source_id string, field_id string, field_name string, is_multi boolean, value_id_type string")


def _fold_input(g: Given) -> tuple[DataFrame, DataFrame]:
    """Issue = customer: the log has the label changes of its orders, the
    snapshot holds the labels that are left."""
    items = issues.explode_changelog(_log(g))
    # Read for the events and for the snapshot.
    events = store(items.selectExpr(
        "source_id", "substr(id_readable, 3) as issue_id", "id_readable", "changelog_id", "created_at as event_at", "cast(changelog_id as bigint) as event_no",
        "author_account_id as author_id", "field_id", "value_from", "value_from_string", "value_to", "value_to_string"))
    # The last word on each label decides whether it is there now.
    last = events.filter("field_id = 'labels'").withColumn("label", F.coalesce("value_to", "value_from"))
    last = latest_by(last, ["source_id", "issue_id", "label"], ["event_at", "changelog_id"]).filter("value_to is not null")
    held = last.groupBy("source_id", "issue_id").agg(F.array_sort(F.collect_list(F.struct(F.col("label").alias("id"), F.col("label").alias("display")))).alias("current"))
    everyone = g.customer.selectExpr("'src' as source_id", "cast(c_custkey as string) as issue_id", "concat('T-', c_custkey) as id_readable",
                                     "timestamp'1995-01-01 00:00:00' as created_at", "concat('u', c_custkey) as reporter_id")
    labels = everyone.join(held, ["source_id", "issue_id"], "left").withColumn("field_id", F.lit("labels")).withColumn(
        "current", F.coalesce("current", F.array().cast(issues.VALUES)))
    status = everyone.withColumn("field_id", F.lit("status")).withColumn("current", F.expr("array(named_struct('id', 'now', 'display', 'Now'))"))
    return labels.unionByName(status), events


# Present labels after each event: labels whose latest change so far is an add,
# and labels never touched before that are held from the start.
_MEMBERS = f"""with l as (select o_custkey::varchar issue_id, o_orderkey::varchar changelog_id, o_orderdate at_, o_orderpriority label, o_orderstatus <> 'F' added from orders),
    labels as (select distinct label from l),
    first_change as (select issue_id, label, arg_min(added, (at_, changelog_id)) first_added from l group by 1, 2),
    start as (select issue_id, label from first_change where not first_added)"""
_INITIAL = f"""{_MEMBERS} select c_custkey::varchar issue_id, coalesce((select string_agg(label, '|' order by label) from start s where s.issue_id = c_custkey::varchar), '') members from customer"""
_AFTER = f"""{_MEMBERS}, e as (select distinct issue_id, changelog_id, at_ from l),
    latest as (select e.issue_id, e.changelog_id, labels.label, coalesce(
        (select arg_max(l.added, (l.at_, l.changelog_id)) from l where l.issue_id = e.issue_id and l.label = labels.label and (l.at_, l.changelog_id) <= (e.at_, e.changelog_id)),
        exists (select 1 from start s where s.issue_id = e.issue_id and s.label = labels.label)) present from e cross join labels)
    select changelog_id event_id, coalesce(string_agg(label, '|' order by label) filter (present), '') members from latest group by issue_id, changelog_id"""


@case("H10_apply_delta", "event_id:s members:s", _AFTER)
def h10(g: Given):
    snapshot, events = _fold_input(g)
    rows = issues.field_history(snapshot, events, _meta(g))
    return rows.filter("field_id = 'labels' and event_kind = 'changelog'").withColumn("members", F.array_join(F.array_sort("value_ids"), "|"))


@case("H11_reconstruct_initial", "issue_id:s members:s", _INITIAL)
def h11(g: Given):
    snapshot, events = _fold_input(g)
    rows = issues.field_history(snapshot, events, _meta(g))
    return rows.filter("field_id = 'labels' and event_kind = 'synthetic_initial'").withColumn("members", F.array_join(F.array_sort("value_ids"), "|"))


_HISTORY = """select c_custkey::varchar issue_id, unnest(['labels','status']) field_id, 'synthetic_initial' event_kind, 'initial:' || c_custkey event_id, unnest([0, 1]) _seq from customer
    union all select o_custkey::varchar, unnest(['labels','status']), 'changelog', o_orderkey::varchar, 0 from orders"""


@case("H12_field_history", "issue_id:s field_id:s event_kind:s event_id:s _seq:i", _HISTORY)
def h12(g: Given):
    snapshot, events = _fold_input(g)
    return issues.field_history(snapshot, events, _meta(g))


@case("H12_incremental", "issue_id:s field_id:s event_id:s members:s",
      f"""{_AFTER.split('select changelog_id event_id')[0]}
          select issue_id, 'labels' field_id, changelog_id event_id, coalesce(string_agg(label, '|' order by label) filter (present), '') members
          from latest join e using (issue_id, changelog_id) where at_ > timestamp '1998-01-01' group by 1, 3""")
def h12_incremental(g: Given):
    """The history up to 1998 is there; only later rows are made, from the
    state they find."""
    snapshot, events = _fold_input(g)
    done = store(issues.field_history(snapshot, events, _meta(g)).filter("event_at <= '1998-01-01'"))
    rows = issues.field_history(snapshot, events.filter("event_at > '1997-01-01'"), _meta(g), done)
    # Issues whose first event is after 1998 have their initial rows in `done`.
    return rows.filter("field_id = 'labels' and event_at > '1998-01-01'").withColumn("members", F.array_join(F.array_sort("value_ids"), "|"))


# --- states and intervals ----------------------------------------------------------------------------

case("H13_issue_state", "issue_id:s status_name:s assignee_account_id:s issue_type:s due_date_str:s time_estimate_seconds:f time_spent_seconds:f created_at:t final_close_at:t last_status_event_at:t",
     """select issue_id, status_name, assignee assignee_account_id, issue_type, due_date due_date_str, estimate time_estimate_seconds, spent time_spent_seconds,
        created_at, final_close_at, last_status_at last_status_event_at from state""")(lambda g: issues.issue_state(g.hist))
case("H14_status_intervals", "issue_id:s interval_start:t interval_end:t status_name:s duration_seconds:f",
     "select issue_id, interval_start, interval_end, status_name, greatest(0, date_diff('second', interval_start, interval_end)) duration_seconds from intervals")(
    lambda g: g.gold.task_status_intervals)
case("H15_dev_seconds", "assignee_email:s issue_id:s close_date:d dev_seconds:f lead_seconds:f pickup_seconds:f",
     "select assignee_email, issue_id, close_date, dev_seconds, lead_seconds, pickup_seconds from dev")(lambda g: g.gold.task_dev_seconds_per_issue)
case("H16_transitions", "kind:s assignee_email:s event_date:d n:i",
     "select 'close' kind, assignee_email, event_date, n from closes union all select 'reopen', assignee_email, event_date, n from reopens")(
    lambda g: g.gold.task_close_events_daily.selectExpr("'close' as kind", "assignee_email", "event_date", "close_count as n").unionByName(
        g.gold.task_reopen_events_daily.selectExpr("'reopen' as kind", "assignee_email", "event_date", "reopen_count as n")))
case("H17_split_by_day", "issue_id:s interval_start:t day:d seconds:f",
     """select issue_id, interval_start, day, greatest(0, date_diff('second', greatest(interval_start, day::timestamp), least(interval_end, (day + 1)::timestamp))) as seconds
        from (select *, unnest(generate_series(interval_start::date, interval_end::date, interval 1 day))::date as day from intervals)""")(
    lambda g: issues.split_by_day(g.gold.task_status_intervals, "interval_start", "interval_end"))
case("H18_worklogs", "author_email:s work_date:d worklog_seconds:f", "select person_id author_email, day work_date, seconds worklog_seconds from logged")(
    lambda g: g.gold.task_worklog_seconds_per_day)
case("H19_stale", "assignee_email:s stale_count:i", "select assignee_email, n stale_count from stale")(
    lambda g: issues.stale_in_progress(g.gold.task_issue_current_state, g.as_of))
case("H20_close_out", "event_id:i valid_from:t valid_to:t",
     "select event_id, ts valid_from, lead(ts) over (partition by user_id, event_type order by ts, event_id) valid_to from ev")(
    lambda g: history.close_out(g.ev, ["user_id", "event_type"], "ts", ["event_id"]))
case("H21_active_intervals", "user_id:i interval_start:t interval_end:t",
     """select user_id, ts interval_start, nxt interval_end from (select *, lead(ts) over (partition by user_id order by ts, event_id) nxt from (
          select *, lag(on_) over (partition by user_id order by ts, event_id) was from (select *, event_type not in ('error','purchase') on_ from ev))
        where was is null or was <> on_) where on_""")(
    lambda g: history.active_intervals(g.ev, ["user_id"], "ts", ~F.col("event_type").isin("error", "purchase"), ["event_id"]))

