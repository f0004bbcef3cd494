"""Class-shaped tables derived by Spark from the given TPC-H-like tables, so
that every operator is run on whole tables. `DERIVED` holds the same tables in
SQL, for the checks."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from workmart.plans.gold import Gold
from workmart.sources.tables import read_table

AS_OF = "2024-02-15 00:00:00"
PERIOD = ("2024-01-05", "2024-01-25")
E = F.expr


class Given:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        df = read_table(self.spark, self.folder, name)
        # Zone-less timestamps are UTC.
        zoneless = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
        return df.withColumns({c: F.to_timestamp(F.concat(F.col(c).cast("string"), F.lit("Z"))) if c != "o_orderdate" and c != "l_shipdate"
                               else F.col(c).cast("date").cast("timestamp") for c in zoneless}) if zoneless else df

    @property
    def as_of(self):
        return F.lit(AS_OF).cast("timestamp")

    @cached_property
    def customer(self) -> DataFrame:
        return self.table("customer")

    @cached_property
    def orders(self) -> DataFrame:
        return self.table("orders")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.table("lineitem")

    @cached_property
    def ev(self) -> DataFrame:
        """Events with the number in their JSON and a person's name."""
        return self.table("events").select(
            "event_id", "ts", "user_id", "event_type", "value", E("cast(get_json_object(props, '$.k') as bigint) as k"),
            E("to_date(ts) as day"), E("concat('Customer#', lpad(cast(user_id as string), 9, '0')) as email"))

    @cached_property
    def employees(self) -> DataFrame:
        both = self.customer.selectExpr(
            "c_name as displayName", "c_name as workEmail",
            "element_at(array('Senior Engineer','Junior Designer','Team Lead','Engineer','VP of Sales','Intern'), c_nationkey % 6 + 1) as jobTitle",
            "case when c_acctbal >= 0 then 'Active' else 'Inactive' end as status", "concat('Nation', c_nationkey) as supervisorEmail",
            "c_mktsegment", "cast(c_custkey as string) as unique_key",
            "inline(array(named_struct('v', 1, '_extracted_at', timestamp'2024-01-01 00:00:00'), named_struct('v', 2, '_extracted_at', timestamp'2024-02-01 00:00:00')))")
        return both.selectExpr("*", "case when v = 1 then 'Hiring' else c_mktsegment end as department").drop("c_mktsegment", "v")

    @property
    def people(self) -> DataFrame:
        return self.gold.people

    @cached_property
    def hist(self) -> DataFrame:
        """Issue field history: every event changes the status of an issue, and
        some kinds of events another field."""
        rows = self.ev.selectExpr(
            "'src' as source_id", "'jira' as data_source", "concat(user_id, '-', k % 5) as issue_id", "ts as event_at", "cast(event_id as string) as event_id",
            "unix_millis(ts) as _version", "event_type", "k", "user_id", "value", "day")
        fields = rows.selectExpr("*", """inline(filter(array(
            struct('status' as field_id, element_at(map('view','Open','signup','In Progress','click','Code Review','purchase','Closed','error','Reopened'), event_type) as shown, event_type as vid),
            case when event_type = 'view' then named_struct('field_id', 'assignee', 'shown', case when k < 90 then concat('User ', user_id) end, 'vid', case when k < 90 then concat('u', user_id) end) end,
            case when event_type = 'signup' then named_struct('field_id', 'issuetype', 'shown', case when k < 30 then 'Bug' else 'Task' end, 'vid', cast(k as string)) end,
            case when event_type = 'click' then named_struct('field_id', 'duedate', 'shown', cast(date_add(day, cast(k % 10 as int)) as string), 'vid', 'd') end,
            case when event_type = 'error' then named_struct('field_id', 'timeoriginalestimate', 'shown', cast(cast(round(value * 1000) as bigint) as string), 'vid', 'e') end,
            case when event_type = 'purchase' then named_struct('field_id', 'timespent', 'shown', cast(cast(round(value * 900) as bigint) as string), 'vid', 's') end
            ), x -> x is not null))""")
        changes = fields.selectExpr(
            "source_id", "data_source", "issue_id", "event_at", "event_id", "'changelog' as event_kind", "cast(0 as bigint) as _seq", "field_id",
            "'single' as field_cardinality", "'set' as delta_action", "case when vid is null then array() else array(vid) end as value_ids",
            "case when shown is null then array() else array(shown) end as value_displays", "_version")
        first = rows.groupBy("source_id", "data_source", "issue_id").agg(F.min("event_at").alias("at"))
        initial = first.selectExpr(
            "source_id", "data_source", "issue_id", "at - interval 1 day as event_at", "concat('initial:', issue_id) as event_id", "'synthetic_initial' as event_kind",
            "cast(0 as bigint) as _seq", "'status' as field_id", "'single' as field_cardinality", "'set' as delta_action", "array('new') as value_ids",
            "array('Open') as value_displays", "unix_millis(at - interval 1 day) as _version")
        return changes.unionByName(initial)

    @cached_property
    def users(self) -> DataFrame:
        return self.customer.selectExpr("'src' as source_id", "concat('u', c_custkey) as user_id", "c_name as email")

    @cached_property
    def worklogs(self) -> DataFrame:
        return self.ev.filter("event_type = 'purchase'").selectExpr(
            "'src' as source_id", "concat('u', user_id) as author_id", "ts as work_date", "round(value * 60) as duration_seconds")

    def _daily(self, kinds: str, *aggs: str) -> DataFrame:
        return self.ev.filter(f"event_type in ({kinds})").groupBy("email", "day", "event_type").agg(*[E(a) for a in aggs]).selectExpr(
            "*", "'t1' as tenant_id", "'src' as source_id", "lower(email) as person_key", "day as date")

    @cached_property
    def emails(self) -> DataFrame:
        return self._daily("'view'", "count(*) as sent_count", "sum(k) as received_count", "min(k) as read_count").withColumn(
            "data_source", F.lit("m365"))

    @cached_property
    def meetings(self) -> DataFrame:
        return self._daily(
            "'click','error'", "count(*) as meetings_attended", "count_if(k > 50) as calls_count",
            "cast(sum(round(value * 10)) as bigint) as audio_duration_seconds", "sum(k) as video_duration_seconds",
            "max(k) as screen_share_duration_seconds").withColumn(
            "data_source", E("case when event_type = 'click' then 'm365' else 'zoom' end"))

    @cached_property
    def chats(self) -> DataFrame:
        return self._daily("'signup','purchase'", "sum(k % 7) as total_chat_messages", "sum(k % 3) as channel_posts").withColumn(
            "data_source", E("case when event_type = 'signup' then 'm365' else 'slack' end"))

    @cached_property
    def documents(self) -> DataFrame:
        return self._daily("'purchase'", "count(*) as shared_internally_count", "sum(k % 2) as shared_externally_count",
                           "sum(k % 5) as viewed_or_edited_count").withColumn("data_source", F.lit("m365"))

    @cached_property
    def ai_dev(self) -> DataFrame:
        return self._daily(
            "'view','click','error','signup'", "sum(k) as lines_added", "cast(sum(k + round(value)) as bigint) as total_lines_added",
            "count(*) as session_count", "sum(k % 4) as tool_use_accepted", "sum(k % 4 + k % 3) as tool_use_offered",
            "count_if(k > 40) as agent_sessions", "count_if(k < 20) as chat_requests", "sum(k % 11) as cost_cents").withColumn(
            "tool", E("element_at(map('view','cursor','click','claude_code','error','codex','signup','copilot'), event_type)"))

    @cached_property
    def ai_assistant(self) -> DataFrame:
        return self._daily("'purchase'", "sum(k) as message_count").withColumn("tool", F.lit("chatgpt"))

    @cached_property
    def hours(self) -> DataFrame:
        return self.customer.selectExpr(
            "'t1' as tenant_id", "c_name as email", "cast(6 + c_nationkey % 4 as double) as working_hours_per_day",
            "timestamp'2024-01-01 00:00:00' as ingested_at", "cast(c_custkey as string) as unique_key")

    _when = "cast(date_add(date'2024-01-01', cast(datediff(o_orderdate, date'1995-01-01') % 60 as int)) as timestamp)"
    _who = "concat('Customer#', lpad(cast(o_custkey as string), 9, '0'))"
    _repo = ("'t1' as tenant_id", "'src' as source_id", "'proj' as project_key", "'repo' as repo_slug")

    @cached_property
    def commits(self) -> DataFrame:
        return self.orders.selectExpr(
            *self._repo, "concat('c', o_orderkey) as commit_hash", f"{self._who} as author_email", f"{self._who} as author_name", f"{self._when} as date",
            "cast(case when o_orderstatus = 'P' then 1 else 0 end as bigint) as is_merge_commit", "cast(floor(o_totalprice / 1000) as bigint) as lines_added",
            "cast(floor(o_totalprice / 5000) as bigint) as lines_removed", "cast(o_orderkey as string) as unique_key")

    @cached_property
    def file_changes(self) -> DataFrame:
        return self.lineitem.selectExpr(
            *self._repo, "concat('c', l_orderkey) as commit_hash",
            "coalesce(element_at(map(1,'src/app/main.py',2,'tests/unit/x.py',3,'config/app.yaml',4,'web/a.spec.ts',5,'poetry.lock'), l_linenumber), concat('src/lib/', l_partkey, '.go')) as file_path",
            "cast(l_quantity as bigint) as lines_added", "cast(l_quantity / 2 as bigint) as lines_removed")

    @cached_property
    def prs(self) -> DataFrame:
        return self.orders.selectExpr(
            *self._repo, "o_orderkey as pr_id", "element_at(map('F','MERGED','O','OPEN','P','DECLINED'), o_orderstatus) as state",
            f"case when o_custkey % 10 = 0 then '' else {self._who} end as author_email", f"{self._who} as author_name", f"{self._when} as created_on",
            f"case when o_orderstatus != 'O' then {self._when} + make_interval(0, 0, 0, 0, cast(o_orderkey % 200 as int), 0, 0) end as closed_on",
            "case when o_orderkey % 2 = 0 then concat('c', o_orderkey) else '' end as merge_commit_hash",
            "cast(floor(o_totalprice / 1000) as bigint) as lines_added", "cast(floor(o_totalprice / 5000) as bigint) as lines_removed",
            "cast(o_orderkey as string) as unique_key")

    @cached_property
    def deals(self) -> DataFrame:
        return self.orders.selectExpr(
            "cast(o_custkey as string) as owner_id", "o_orderdate as created_at",
            "case when o_orderstatus != 'O' then date_add(to_date(o_orderdate), cast(o_orderkey % 90 as int)) end as close_date",
            "cast(case when o_orderstatus = 'F' then 1 else 0 end as bigint) as is_won", "cast(case when o_orderstatus != 'O' then 1 else 0 end as bigint) as is_closed",
            "case when o_orderpriority != '5-LOW' then o_totalprice end as amount_home")

    @cached_property
    def activities(self) -> DataFrame:
        return self.ev.selectExpr(
            "element_at(map('view','email','click','call','signup','meeting','purchase','task','error','event'), event_type) as activity_type", "ts as timestamp",
            "cast(user_id as string) as owner_id", "concat('h', user_id) as created_by_user_id")

    @cached_property
    def crm_users(self) -> DataFrame:
        return self.customer.selectExpr("cast(c_custkey as string) as user_id", "concat('h', c_custkey) as hs_user_id", "c_name as email")

    @cached_property
    def class_people(self) -> DataFrame:
        return self.customer.selectExpr(
            "c_name as email", "case when c_nationkey > 0 then c_mktsegment end as department_name", "timestamp'2024-01-01 00:00:00' as ingested_at",
            "cast(c_custkey as string) as unique_key")

    @cached_property
    def gold(self) -> Gold:
        return Gold(self.spark, {
            "bronze_bamboohr.employees": self.employees, "class_task_field_history": self.hist, "class_task_users": self.users, "class_task_worklogs": self.worklogs,
            "class_collab_email_activity": self.emails, "class_collab_meeting_activity": self.meetings, "class_collab_chat_activity": self.chats,
            "class_collab_document_activity": self.documents, "class_ai_dev_usage": self.ai_dev, "class_ai_assistant_usage": self.ai_assistant,
            "class_hr_working_hours": self.hours, "class_git_commits": self.commits, "class_git_file_changes": self.file_changes,
            "class_git_pull_requests": self.prs, "class_crm_deals": self.deals, "class_crm_activities": self.activities,
            "class_crm_users": self.crm_users, "class_people": self.class_people}, self.as_of)

    @cached_property
    def versions(self) -> DataFrame:
        """Customers as versioned entities: each order is a version."""
        return self.orders.selectExpr(
            "cast(o_custkey as string) as unique_key", "cast(o_custkey as string) as id", "'t1' as tenant_id", "'src' as source_id", "o_orderstatus as status",
            "o_orderpriority as priority", "concat('{\"size\":\"', cast(cast(o_totalprice / 100000 as int) as string), '\"}') as raw_data",
            "timestamp_seconds(unix_seconds(o_orderdate) + o_orderkey % 86400) as _tracked_at", "o_orderkey")


# --- the same in SQL ------------------------------------------------------------------

_NAME = "'Customer#' || lpad({}::varchar, 9, '0')"
_WHEN = "(date '2024-01-01' + (date_diff('day', date '1995-01-01', o_orderdate::date) % 60)::int)::timestamp"
_REPO = "'t1' tenant_id, 'src' source_id, 'proj' project_key, 'repo' repo_slug"


def _daily(kinds: str, aggs: str) -> str:
    return f"""select *, 't1' tenant_id, lower(email) person_key, day as date from (
        select email, day, event_type, {aggs} from ev where event_type in ({kinds}) group by email, day, event_type)"""


DERIVED = {
    "ev": f"""select event_id, ts, user_id, event_type, value, (props->>'$.k')::bigint k, ts::date as day,
        {_NAME.format('user_id')} email from events""",
    "people": """select lower(c_name) person_id, c_name display_name, c_mktsegment org_unit_id, c_mktsegment org_unit_name,
        (['Senior','Junior','Senior','Mid','Mid','Junior'])[c_nationkey % 6 + 1] seniority,
        (['Senior Engineer','Junior Designer','Team Lead','Engineer','VP of Sales','Intern'])[c_nationkey % 6 + 1] job_title,
        case when c_acctbal >= 0 then 'Active' else 'Inactive' end status, 'nation' || c_nationkey supervisor_email from customer""",
    "issue_ev": "select user_id || '-' || (k % 5) issue_id, * from ev",
    "fields": """select issue_id, ts event_at, event_id::varchar event_id, epoch_us(ts) // 1000 _version, 'status' field_id,
          case event_type when 'view' then 'Open' when 'signup' then 'In Progress' when 'click' then 'Code Review'
            when 'purchase' then 'Closed' else 'Reopened' end shown, event_type vid from issue_ev
        union all select issue_id, ts, event_id::varchar, epoch_us(ts) // 1000, 'assignee', case when k < 90 then 'User ' || user_id end,
          case when k < 90 then 'u' || user_id end from issue_ev where event_type = 'view'
        union all select issue_id, ts, event_id::varchar, epoch_us(ts) // 1000, 'issuetype', case when k < 30 then 'Bug' else 'Task' end, k::varchar
          from issue_ev where event_type = 'signup'
        union all select issue_id, ts, event_id::varchar, epoch_us(ts) // 1000, 'duedate', (day + (k % 10)::int)::date::varchar, 'd' from issue_ev where event_type = 'click'
        union all select issue_id, ts, event_id::varchar, epoch_us(ts) // 1000, 'timeoriginalestimate', round(value * 1000)::bigint::varchar, 'e'
          from issue_ev where event_type = 'error'
        union all select issue_id, ts, event_id::varchar, epoch_us(ts) // 1000, 'timespent', round(value * 900)::bigint::varchar, 's'
          from issue_ev where event_type = 'purchase'""",
    "hist": """select *, 'changelog' event_kind from fields
        union all select issue_id, min(ts) - interval 1 day, 'initial:' || issue_id, epoch_us(min(ts) - interval 1 day) // 1000, 'status', 'Open', 'new', 'synthetic_initial'
          from issue_ev group by issue_id""",
    "users": "select 'u' || c_custkey user_id, c_name email from customer",
    "worklogs": "select 'u' || user_id author_id, ts work_date, round(value * 60) duration_seconds from ev where event_type = 'purchase'",
    "emails": _daily("'view'", "count(*) sent_count, sum(k) received_count, min(k) read_count"),
    "meetings": "select *, case when event_type = 'click' then 'm365' else 'zoom' end data_source from (" + _daily(
        "'click','error'", """count(*) meetings_attended, count(*) filter (k > 50) calls_count, sum(round(value * 10))::bigint audio_duration_seconds,
        sum(k)::bigint video_duration_seconds, max(k) screen_share_duration_seconds""") + ")",
    "chats": "select *, case when event_type = 'signup' then 'm365' else 'slack' end data_source from (" + _daily(
        "'signup','purchase'", "sum(k % 7) total_chat_messages, sum(k % 3) channel_posts") + ")",
    "files": _daily("'purchase'", "count(*) shared_internally_count, sum(k % 2) shared_externally_count, sum(k % 5) viewed_or_edited_count"),
    "ai_dev": """select *, case event_type when 'view' then 'cursor' when 'click' then 'claude_code' when 'error' then 'codex' else 'copilot' end tool from (""" + _daily(
        "'view','click','error','signup'", """sum(k)::double lines_added, sum(k + round(value)) total_lines_added, count(*) session_count,
        sum(k % 4)::double tool_use_accepted, sum(k % 4 + k % 3)::double tool_use_offered, count(*) filter (k > 40) agent_sessions,
        count(*) filter (k < 20) chat_requests, sum(k % 11)::double cost_cents""") + ")",
    "ai_assistant": _daily("'purchase'", "sum(k)::double message_count"),
    "hours": "select lower(c_name) email, (6 + c_nationkey % 4)::double plan from customer",
    "commits": f"""select {_REPO}, 'c' || o_orderkey commit_hash, {_NAME.format('o_custkey')} author_email, lower({_NAME.format('o_custkey')}) person_key,
        {_WHEN} as date, date_trunc('week', {_WHEN})::date as week, case when o_orderstatus = 'P' then 1 else 0 end is_merge_commit,
        floor(o_totalprice / 1000)::bigint lines_added, floor(o_totalprice / 5000)::bigint lines_removed from orders""",
    "file_changes": f"""select {_REPO}, 'c' || l_orderkey commit_hash, case l_linenumber when 1 then 'src/app/main.py' when 2 then 'tests/unit/x.py'
        when 3 then 'config/app.yaml' when 4 then 'web/a.spec.ts' when 5 then 'poetry.lock' else 'src/lib/' || l_partkey || '.go' end file_path,
        case l_linenumber when 2 then 'code' when 3 then 'config' when 4 then 'spec' when 5 then 'config' else 'code' end file_category,
        trunc(l_quantity)::bigint lines_added, trunc(l_quantity / 2)::bigint lines_removed from lineitem""",
    "prs": f"""select {_REPO}, o_orderkey pr_id, case o_orderstatus when 'F' then 'merged' when 'O' then 'open' else 'declined' end state_norm,
        lower({_NAME.format('o_custkey')}) person_key, {_WHEN} created_on,
        case when o_orderstatus <> 'O' then {_WHEN} + to_hours((o_orderkey % 200)::int) end closed_on,
        case when o_orderkey % 2 = 0 then 'c' || o_orderkey else '' end merge_commit_hash,
        floor(o_totalprice / 1000)::bigint lines_added, floor(o_totalprice / 5000)::bigint lines_removed from orders""",
    "deals": f"""select lower({_NAME.format('o_custkey')}) person_id, o_orderdate::date opened,
        case when o_orderstatus <> 'O' then o_orderdate::date + (o_orderkey % 90)::int end close_date, o_orderstatus = 'F' won, o_orderstatus <> 'O' done,
        case when o_orderpriority <> '5-LOW' then o_totalprice end amount_home from orders""",
    "contacts": """select lower(email) person_id, ts::date metric_date, case event_type when 'view' then 'emails' when 'click' then 'calls'
        when 'signup' then 'meetings' when 'purchase' then 'tasks' else 'event' end metric_key from ev""",
    "crm_units": "select lower(c_name) person_id, case when c_nationkey > 0 then c_mktsegment else 'Unknown' end org_unit_id from customer",
    "versions": """select o_custkey::varchar id, o_orderstatus status, o_orderpriority priority, trunc(o_totalprice / 100000)::int::varchar size,
        o_orderdate + to_seconds((o_orderkey % 86400)) tracked_at, o_orderkey from orders""",

    # results that other checks build on
    "state": f"""select 'src' source_id, issue_id,
          arg_max(shown, (event_at, _version, event_id)) filter (field_id = 'status' and shown is not null) status_name,
          (max({{'a': event_at, 'b': _version, 'c': event_id, 'v': vid}}) filter (field_id = 'assignee')).v assignee,
          arg_max(shown, (event_at, _version, event_id)) filter (field_id = 'issuetype') issue_type,
          arg_max(shown, (event_at, _version, event_id)) filter (field_id = 'duedate') due_date,
          arg_max(shown, (event_at, _version, event_id)) filter (field_id = 'timeoriginalestimate')::double estimate,
          arg_max(shown, (event_at, _version, event_id)) filter (field_id = 'timespent')::double spent,
          min(event_at) filter (event_kind = 'synthetic_initial') created_at,
          max(event_at) filter (field_id = 'status' and shown in ('Closed','Resolved','Verified')) final_close_at,
          max(event_at) filter (field_id = 'status') last_status_at
        from hist group by issue_id""",
    "owned_state": """select s.*, lower(u.email) assignee_email, p.org_unit_id from state s left join users u on u.user_id = s.assignee
        left join people p on p.person_id = lower(u.email)""",
    "intervals": f"""select * from (
          select e.issue_id, e.event_at interval_start, case when nxt is null then coalesce(final_close_at, timestamp '{AS_OF}') else nxt end interval_end,
            shown status_name, created_at
          from (select *, lead(event_at) over (partition by issue_id order by event_at, _version, event_id) nxt from hist where field_id = 'status') e
          left join state s using (issue_id))
        where interval_start >= created_at and interval_end >= interval_start and interval_end <= timestamp '{AS_OF}' + interval 1 day""",
    "active_intervals": "select * from intervals where status_name in ('In Progress','Code Review')",
    "dev": """select assignee_email, s.issue_id, final_close_at::date close_date, dev_seconds,
          greatest(0, date_diff('second', created_at, final_close_at))::double lead_seconds,
          case when first_at is not null then greatest(0, date_diff('second', created_at, first_at))::double end pickup_seconds
        from owned_state s left join (select issue_id, sum(greatest(0, date_diff('second', interval_start, interval_end)))::double dev_seconds, min(interval_start) first_at
          from active_intervals group by issue_id) i using (issue_id) where final_close_at is not null and assignee_email is not null""",
    "moves": """select t.*, assignee_email from (select *, lag(status_name) over (partition by issue_id order by interval_start, interval_end, status_name) was from intervals) t
        join owned_state s using (issue_id) where assignee_email is not null""",
    "closes": "select assignee_email, interval_start::date event_date, count(*) n from moves where status_name = 'Closed' and was is distinct from 'Closed' group by all",
    "reopens": "select assignee_email, interval_start::date event_date, count(*) n from moves where was = 'Closed' and status_name <> 'Closed' group by all",
    "logged": """select lower(email) person_id, work_date::date as day, sum(duration_seconds) as seconds from worklogs join users on user_id = author_id group by all""",
    "measured": """select assignee_email person_id, day, sum(greatest(0, date_diff('second', greatest(interval_start, day::timestamp), least(interval_end, (day + 1)::timestamp))))::double as seconds
        from (select assignee_email, interval_start, interval_end, unnest(generate_series(interval_start::date, interval_end::date, interval 1 day))::date as day
          from active_intervals join owned_state using (issue_id) where assignee_email is not null) group by all""",
    "closed": """select assignee_email person_id, final_close_at::date metric_date, count(*) tasks_closed, count(*) filter (issue_type = 'Bug') bugs_fixed,
          count(*) filter (due_date is not null and final_close_at::date <= due_date::date) on_time, count(*) filter (due_date is not null) with_due,
          avg(spent) filter (coalesce(estimate, 0) > 0) avg_spent, avg(estimate) filter (coalesce(estimate, 0) > 0) avg_estimate
        from owned_state where final_close_at is not null and assignee_email is not null and status_name = 'Closed' group by all""",
    "stale": f"""select assignee_email, count(*) n from owned_state where status_name is distinct from 'Closed' and assignee_email is not null
        and date_diff('day', last_status_at::date, date '{AS_OF[:10]}') > 14 group by all""",
    "task_rows_raw": f"""
        select person_id, metric_date, 'tasks_completed' metric_key, tasks_closed::double metric_value from closed
        union all select person_id, metric_date, 'due_date_on_time', on_time from closed
        union all select person_id, metric_date, 'due_date_with_due', with_due from closed
        union all select person_id, metric_date, 'bugs_fixed', bugs_fixed from closed
        union all select person_id, metric_date, 'estimation_accuracy', case when avg_spent > 0 and avg_estimate is not null then round(avg_estimate / avg_spent * 100, 1) end from closed
        union all select assignee_email, close_date, 'task_dev_time', case when dev_seconds <> 0 then round(dev_seconds / 3600, 2) end from dev
        union all select assignee_email, close_date, 'mean_time_to_resolution', case when lead_seconds <> 0 then round(lead_seconds / 86400, 2) end from dev
        union all select assignee_email, close_date, 'flow_efficiency_num', case when dev_seconds > 0 and lead_seconds > 0 then dev_seconds end from dev
        union all select assignee_email, close_date, 'flow_efficiency_den', case when dev_seconds > 0 and lead_seconds > 0 then lead_seconds end from dev
        union all select assignee_email, close_date, 'pickup_time', round(pickup_seconds / 86400, 2) from dev
        union all select assignee_email, event_date, 'task_reopen_rate', n from closes
        union all select assignee_email, event_date, 'task_reopen_rate', -n from reopens
        union all select coalesce(l.person_id, m.person_id), coalesce(l.day, m.day), 'worklog_seconds', case when m.seconds > 0 then coalesce(l.seconds, 0) end
          from logged l full join measured m on l.person_id = m.person_id and l.day = m.day
        union all select coalesce(l.person_id, m.person_id), coalesce(l.day, m.day), 'in_progress_seconds', case when m.seconds > 0 then m.seconds end
          from logged l full join measured m on l.person_id = m.person_id and l.day = m.day
        union all select assignee_email, date '{AS_OF[:10]}', 'stale_in_progress', n from stale""",
    "task_rows": "select r.*, org_unit_id from task_rows_raw r left join people using (person_id)",
    "quality_rows": "select person_id, metric_date, 'bugs_fixed' metric_key, bugs_fixed::double metric_value, org_unit_id from closed left join people using (person_id)",
    "git_rows": """select r.*, org_unit_id from (
          select lower(author_email) person_id, date::date metric_date, 'commits' metric_key, count(distinct commit_hash)::double metric_value from commits where is_merge_commit = 0 group by all
          union all select lower(author_email), date::date, 'loc', sum(lines_added + lines_removed)::double from commits where is_merge_commit = 0 group by all
          union all select lower(author_email), c.date::date, 'clean_loc', sum(f.lines_added)::double from file_changes f join commits c using (commit_hash)
            where is_merge_commit = 0 and file_category = 'code' group by all
          union all select person_id_, created_on::date, 'prs_created', count(*) from (select *, person_key person_id_ from prs) group by all
          union all select person_key, closed_on::date, 'prs_merged', count(*) from prs where state_norm = 'merged' and closed_on is not null group by all
          union all select person_key, created_on::date, 'pr_size', lines_added + lines_removed from prs
          union all select person_key, closed_on::date, 'pr_cycle_time_h', date_diff('second', created_on, closed_on) / 3600.0 from prs
            where state_norm = 'merged' and closed_on >= created_on) r left join people using (person_id)""",
    "collab_rows": """select r.*, org_unit_id from (
          select person_key person_id, date metric_date, 'm365_emails_sent' metric_key, sent_count::double metric_value from emails
          union all select person_key, date, 'm365_emails_received', received_count from emails
          union all select person_key, date, 'm365_emails_read', read_count from emails
          union all select person_key, date, unnest(['meeting_hours','meetings_count','teams_meeting_hours','zoom_meeting_hours','teams_meetings','zoom_meetings','meeting_free']),
            unnest([h, n, th, zh, tn, zn, free]) from (
              select person_key, date, sum(hrs) h, sum(meetings_attended)::double n, coalesce(sum(hrs) filter (data_source = 'm365'), 0) th,
                coalesce(sum(hrs) filter (data_source = 'zoom'), 0) zh, coalesce(sum(meetings_attended) filter (data_source = 'm365'), 0)::double tn,
                coalesce(sum(meetings_attended) filter (data_source = 'zoom'), 0)::double zn,
                case when sum(audio_duration_seconds + video_duration_seconds + screen_share_duration_seconds) = 0 then 1.0 else 0.0 end::double free
              from (select *, greatest(audio_duration_seconds, video_duration_seconds, screen_share_duration_seconds) / 3600.0 hrs from meetings) group by all)
          union all select person_key, date, 'm365_teams_chats', total_chat_messages from chats where data_source = 'm365'
          union all select person_key, date, 'slack_messages_sent', total_chat_messages from chats where data_source = 'slack'
          union all select person_key, date, 'slack_channel_posts', channel_posts from chats where data_source = 'slack'
          union all select person_key, date, 'slack_active_days', case when total_chat_messages > 0 then 1 else 0 end from chats where data_source = 'slack'
          union all select person_key, date, 'm365_files_shared_internal', shared_internally_count from files
          union all select person_key, date, 'm365_files_shared_external', shared_externally_count from files
          union all select person_key, date, 'm365_files_engaged', viewed_or_edited_count from files
          union all select person_key, date, 'm365_active_days', case when sum(a) > 0 then 1 else 0 end from (
            select person_key, date, sent_count a from emails union all select person_key, date, total_chat_messages from chats where data_source = 'm365'
            union all select person_key, date, shared_internally_count + shared_externally_count + viewed_or_edited_count from files) group by all
        ) r left join people using (person_id)""",
    "ai_rows": """select r.*, org_unit_id from (
          select person_key person_id, day metric_date, unnest(['active_ai_members','team_ai_loc']) metric_key, unnest([1.0::double, lines_added]) metric_value from ai_dev
          union all select person_key, day, unnest(['cursor_active','cursor_completions','cursor_agents','cursor_lines','cursor_offered','cursor_total_lines']),
            unnest([1.0::double, tool_use_accepted, agent_sessions, lines_added, tool_use_offered, total_lines_added]) from ai_dev where tool = 'cursor'
          union all select person_key, day, unnest(['cc_active','cc_sessions','cc_lines','cc_tool_accept','cc_offered','cc_cost']),
            unnest([1.0::double, session_count, lines_added, tool_use_accepted, tool_use_offered, cost_cents]) from ai_dev where tool = 'claude_code'
          union all select person_key, day, unnest(['codex_active','codex_lines','codex_sessions']), unnest([1.0::double, lines_added, session_count]) from ai_dev where tool = 'codex'
          union all select person_key, day, unnest(['chatgpt_active','chatgpt']), unnest([1.0::double, message_count]) from ai_assistant
        ) r left join people using (person_id)""",
    "crm_rows": """select r.*, coalesce(org_unit_id, 'Unknown') org_unit_id from (
          select person_id, opened metric_date, 'deals_opened' metric_key, 1.0::double metric_value from deals
          union all select person_id, close_date, 'deals_closed', 1 from deals where done
          union all select person_id, close_date, 'deals_won', 1 from deals where won
          union all select person_id, close_date, 'cycle_days', greatest(0, date_diff('day', opened, close_date)) from deals where won
          union all select person_id, close_date, 'deal_size', amount_home from deals where won and amount_home is not null
          union all select person_id, metric_date, metric_key, 1 from contacts) r left join crm_units using (person_id)""",
    "focus": """select person_key email, date as day, n meetings_count, round(h, 4) meeting_hours, coalesce(plan, 8.0) plan,
          round(greatest(0, 100 - h / coalesce(plan, 8.0) * 100), 2) focus_time_pct, round(greatest(0, coalesce(plan, 8.0) - h), 4) dev_time_h
        from (select person_key, date, sum(meetings_attended)::bigint n,
          sum(greatest(audio_duration_seconds, video_duration_seconds, screen_share_duration_seconds)) / 3600.0 h from meetings group by all) m
        left join hours on hours.email = m.person_key""",
    "git_totals": """select person_key, coalesce(prs_created, 0) prs_created, coalesce(prs_merged, 0) prs_merged, avg_h, coalesce(n, 0) commits, coalesce(loc, 0) loc, coalesce(clean, 0) clean_loc
        from (select person_key, count(*) prs_created, count(*) filter (state_norm = 'merged') prs_merged,
          avg(date_diff('second', created_on, closed_on) / 3600.0) filter (state_norm = 'merged' and closed_on >= created_on) avg_h from prs group by all) p
        full join (select person_key, count(*) n, sum(lines_added + lines_removed) loc from commits where is_merge_commit = 0 group by all) c using (person_key)
        full join (select c.person_key, sum(f.lines_added) clean from file_changes f join commits c using (commit_hash)
          where is_merge_commit = 0 and file_category = 'code' group by all) f using (person_key)""",
    "git_weekly": """select person_key, week, sum(commits)::bigint commits, sum(prs_merged)::bigint prs_merged, sum(code_loc)::bigint code_loc, sum(spec_lines)::bigint spec_lines from (
          select person_key, week, 1 commits, 0 prs_merged, 0 code_loc, 0 spec_lines from commits where is_merge_commit = 0
          union all select c.person_key, c.week, 0, 0, case when file_category = 'code' then f.lines_added else 0 end, case when file_category = 'spec' then f.lines_added else 0 end
            from file_changes f join commits c using (commit_hash) where is_merge_commit = 0
          union all select p.person_key, coalesce(m.week, date_trunc('week', closed_on)::date), 0, 1, 0, 0 from prs p left join commits m on m.commit_hash = p.merge_commit_hash
            where state_norm = 'merged' and closed_on is not null) group by all""",
    "ai_share": """select person_key person_id, day metric_date, case when total_lines_added > 0 then round(100.0 * lines_added / total_lines_added, 1) end share,
        (agent_sessions + chat_requests)::double sessions, true has_ai from ai_dev""",
    "ic_kpis": """select f.email person_id, p.org_unit_id, f.day metric_date, coalesce(t.loc, 0)::double loc, round(coalesce(a.share, 0), 1) ai_loc_share_pct,
          coalesce(t.prs_merged, 0)::double prs_merged, round(t.avg_h, 1) pr_cycle_time_h, greatest(0, least(100, round(f.focus_time_pct, 1))) focus_time_pct,
          coalesce(c.tasks_closed, 0)::double tasks_closed, coalesce(c.bugs_fixed, 0)::double bugs_fixed, coalesce(a.sessions, 0) ai_sessions
        from focus f left join people p on p.person_id = f.email left join git_totals t on t.person_key = f.email
        left join closed c on c.person_id = f.email and c.metric_date = f.day left join ai_share a on a.person_id = f.email and a.metric_date = f.day""",
    "all_rows": """select *, 'task_delivery' section from task_rows union all by name select *, 'code_quality' section from quality_rows
        union all by name select *, 'ai_adoption' section from ai_rows union all by name select *, 'collaboration' section from collab_rows
        union all by name select *, 'git_output' section from git_rows""",
}

_TABLE = re.compile(r"\b(" + "|".join(sorted(DERIVED, key=len, reverse=True)) + r")\b")


def _arguments(text: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    return [*parts, text[start:]]


def half_up(sql: str) -> str:
    """`round(x, n)` on decimals: half up after the last bits are rounded off,
    as the library does it."""
    found = re.search(r"(?<![a-z_])round\(", sql)
    if not found:
        return sql
    depth, end = 1, found.end()
    while depth:
        depth += {"(": 1, ")": -1}.get(sql[end], 0)
        end += 1
    args = [half_up(a) for a in _arguments(sql[found.end():end - 1])]
    done = f"ROUND({args[0]})" if len(args) == 1 else f"(ROUND(ROUND(({args[0]})::double, {int(args[1]) + 8})::varchar::decimal(38, 18), {int(args[1])})::double)"
    return sql[:found.start()] + done + half_up(sql[end:])


def with_derived(sql: str) -> str:
    """Prefix a query with the derived tables it reads, in order."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in _TABLE.findall(text):
            if name not in need:
                need.append(name)
                visit(DERIVED[name])

    visit(sql)
    ordered = [n for n in DERIVED if n in need]
    return half_up("WITH " + ",\n".join(f"{n} AS ({DERIVED[n]})" for n in ordered) + "\n" + sql if ordered else sql)
