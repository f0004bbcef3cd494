"""Cases: conformers, on landed-shaped tables made from orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from proving.case import case
from proving.given import Given
from workmart.plans.gold import Gold
from workmart.plans.registry import Landed, build_class
from workmart.plans.staging import ai, collab, people as directories

_AT = "timestamp'2024-02-01 00:00:00' as _airbyte_extracted_at"
_KEYS = ("'t1' as tenant_id", "'src' as source_id")


def _land(g: Given, **tables: DataFrame) -> Landed:
    """Tables by name, `__` for the dot."""
    return Landed(g.spark, {n.replace("__", "."): df for n, df in tables.items()}, g.as_of)


def _o(g: Given, *columns: str) -> DataFrame:
    return g.orders.selectExpr(*_KEYS, "cast(o_orderkey as string) as unique_key", _AT, *columns)


def _e(g: Given, *columns: str, where: str = "true") -> DataFrame:
    return g.ev.filter(where).selectExpr(*_KEYS, "cast(event_id as string) as unique_key", _AT, *columns)


def _nulls(*names: str) -> list[str]:
    return [f"cast(null as string) as {n}" for n in names]


# --- git ------------------------------------------------------------------------------

_COMMIT = "commit_hash:s project_key:s author_email:s date:d lines_added:i lines_removed:i files_changed:i is_merge_commit:i data_source:s"
_MAIL = "'Customer#' || lpad(o_custkey::varchar, 9, '0')"
_SMAIL = "concat('Customer#', lpad(cast(o_custkey as string), 9, '0'))"

case("M_github_commits", _COMMIT,
     f"""select 'c' || o_orderkey commit_hash, 'org' project_key, {_MAIL} author_email, o_orderdate::date date, trunc(o_totalprice)::bigint lines_added, 0 lines_removed, 2 files_changed,
         (o_orderstatus = 'P')::int is_merge_commit, 'github' data_source from orders""")(
    lambda g: build_class("class_git_commits", _land(g, bronze_github__commits=_o(
        g, "'org' as repo_owner", "'r' as repo_name", "concat('c', o_orderkey) as oid", f"{_SMAIL} as author_email", "cast(o_orderdate as string) as committed_date",
        "cast(o_totalprice as bigint) as additions", "cast(null as bigint) as deletions", "2 as changed_files",
        "if(o_orderstatus = 'P', array('a', 'b'), array('a')) as parent_hashes", *_nulls("branch_name", "author_name", "committer_name", "committer_email", "message")))))


def _bitbucket(g: Given) -> Landed:
    where = ("'ws' as workspace", "'r' as repo_slug")
    commits = _o(g, *where, "concat('c', o_orderkey) as hash", f"{_SMAIL} as author_email", "cast(o_orderdate as string) as date",
                 "if(o_orderstatus = 'P', '[1,2]', '[1]') as parent_hashes", *_nulls("branch_name", "author_name", "message"))
    files = g.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("q")).selectExpr(
        *_KEYS, "concat(l_orderkey, '-', l_partkey) as unique_key", _AT, *where, "concat('c', l_orderkey) as sha", "concat('src/f', l_partkey, '.go') as filename",
        "cast(q as bigint) as additions", "cast(null as bigint) as deletions", *_nulls("status", "source_type"))
    links = _o(g, *where, "o_custkey as pr_id", "concat('c', o_orderkey) as hash")
    prs = g.customer.selectExpr(
        *_KEYS, "cast(c_custkey as string) as unique_key", _AT, *where, "c_custkey as id", "element_at(array('OPEN','MERGED','SUPERSEDED'), c_nationkey % 3 + 1) as state",
        "c_name as author_display_name", "'2024-01-01T10:00:00Z' as created_on", "'2024-01-02T11:30:00Z' as updated_on",
        """to_json(array(named_struct('role', 'REVIEWER', 'uuid', concat('u', c_nationkey), 'display_name', 'R', 'state', 'approved', 'approved', c_acctbal > 0),
           named_struct('role', 'PARTICIPANT', 'uuid', 'x', 'display_name', 'X', 'state', '', 'approved', false))) as participants""",
        *_nulls("title", "description", "source_branch", "destination_branch", "merge_commit_hash"))
    return _land(g, bronze_bitbucket_cloud__commits=commits, bronze_bitbucket_cloud__file_changes=files, bronze_bitbucket_cloud__pull_request_commits=links,
                 bronze_bitbucket_cloud__pull_requests=prs)


_FILES = "(select l_orderkey, count(*) n, sum(q)::bigint added from (select l_orderkey, l_partkey, trunc(max(l_quantity)) q from lineitem group by all) group by 1)"
case("M_bitbucket_commits", _COMMIT,
     f"""select 'c' || o_orderkey commit_hash, 'ws' project_key, {_MAIL} author_email, o_orderdate::date date, coalesce(added, 0) lines_added, 0 lines_removed, coalesce(n, 0) files_changed,
         (o_orderstatus = 'P')::int is_merge_commit, 'bitbucket_cloud' data_source from orders left join {_FILES} f on l_orderkey = o_orderkey""")(
    lambda g: build_class("class_git_commits", _bitbucket(g)))
case("M_bitbucket_pull_requests", "pr_id:i state:s author_name:s created_on:t closed_on:t files_changed:i lines_added:i",
     f"""select c_custkey pr_id, (['OPEN','MERGED','DECLINED'])[c_nationkey % 3 + 1] state, c_name author_name, timestamp '2024-01-01 10:00:00' created_on,
         case when c_nationkey % 3 > 0 then timestamp '2024-01-02 11:30:00' end closed_on, coalesce(n, 0) files_changed, coalesce(added, 0) lines_added
         from customer left join (select o_custkey, sum(n) n, sum(added) added from orders join {_FILES} f on l_orderkey = o_orderkey group by 1) on o_custkey = c_custkey""")(
    lambda g: build_class("class_git_pull_requests", _bitbucket(g)))
case("M_bitbucket_reviewers", "unique_key:s reviewer_uuid:s approved:i",
     "select 't1:src:ws:r:' || c_custkey || ':u' || c_nationkey unique_key, 'u' || c_nationkey reviewer_uuid, (c_acctbal > 0)::int approved from customer")(
    lambda g: build_class("class_git_pull_requests_reviewers", _bitbucket(g)))
case("M_bitbucket_file_changes", "commit_hash:s file_path:s file_extension:s lines_added:i",
     "select 'c' || l_orderkey commit_hash, 'src/f' || l_partkey || '.go' file_path, 'go' file_extension, trunc(max(l_quantity)) lines_added from lineitem group by l_orderkey, l_partkey")(
    lambda g: build_class("class_git_file_changes", _bitbucket(g)))
case("M_github_pull_requests", "pr_id:i state:s author_email:s created_on:t lines_added:i",
     f"select o_orderkey pr_id, o_orderstatus state, {_MAIL} author_email, o_orderdate created_on, trunc(o_totalprice)::bigint lines_added from orders")(
    lambda g: build_class("class_git_pull_requests", _land(g, bronze_github__pull_requests=_o(
        g, "'org' as repo_owner", "'r' as repo_name", "o_orderkey as database_id", "1 as number", "o_orderstatus as state", f"{_SMAIL} as author_email",
        "cast(o_orderdate as string) as created_at", "cast(o_totalprice as bigint) as additions", "0 as deletions", "1 as changed_files",
        *_nulls("title", "body", "author_login", "head_ref", "base_ref", "updated_at", "closed_at", "merge_commit_sha")))))
case("M_github_reviewers", "pr_id:i status:s approved:i", "select o_orderkey pr_id, case when o_orderstatus = 'F' then 'APPROVED' else 'COMMENTED' end status, (o_orderstatus = 'F')::int approved from orders")(
    lambda g: build_class("class_git_pull_requests_reviewers", _land(g, bronze_github__pull_request_reviews=_o(
        g, "'org' as repo_owner", "'r' as repo_name", "o_orderkey as pr_database_id", "if(o_orderstatus = 'F', 'APPROVED', 'COMMENTED') as state", "7 as author_database_id",
        *_nulls("author_login", "submitted_at")))))

# --- collaboration ------------------------------------------------------------------------

_M365 = ("email as userPrincipalName", "cast(day as string) as reportRefreshDate", "'D7' as reportPeriod")


def _daily(g: Given, *aggs: str) -> DataFrame:
    return g.ev.groupBy("email", "day").agg(*[F.expr(a) for a in aggs]).selectExpr("*", *_KEYS, "concat(email, day) as unique_key", _AT)


def _teams(g: Given) -> Landed:
    rows = _daily(g, "sum(k) as privateChatMessageCount", "count(*) as teamChatMessageCount", "sum(k % 3) as callCount").selectExpr(
        "*", *_M365, "'PT1H2M3S' as audioDuration", "concat('PT', callCount, 'M') as videoDuration", "cast(null as string) as screenShareDuration", *_nulls(
            "postMessages", "replyMessages", "urgentMessages", "meetingsOrganizedCount", "meetingsAttendedCount", "adHocMeetingsOrganizedCount", "adHocMeetingsAttendedCount",
            "scheduledOneTimeMeetingsOrganizedCount", "scheduledRecurringMeetingsOrganizedCount", "scheduledOneTimeMeetingsAttendedCount", "scheduledRecurringMeetingsAttendedCount"))
    return _land(g, bronze_m365__teams_activity=rows)


case("M_m365_chats", "unique_key:s person_key:s date:d direct_messages:i total_chat_messages:i data_source:s",
     """select md5('t1-src-' || email || '-' || day) unique_key, lower(email) person_key, day date, sum(k) direct_messages, sum(k) + count(*) total_chat_messages, 'm365' data_source
        from ev group by email, day""")(lambda g: build_class("class_collab_chat_activity", _teams(g)))
case("M_m365_meetings", "person_key:s date:d calls_count:i meetings_attended:i audio_duration_seconds:i video_duration_seconds:i screen_share_duration_seconds:i",
     """select lower(email) person_key, day date, sum(k % 3) calls_count, 0 meetings_attended, 3723 audio_duration_seconds, sum(k % 3) * 60 video_duration_seconds,
        0 screen_share_duration_seconds from ev group by email, day""")(lambda g: build_class("class_collab_meeting_activity", _teams(g)))
case("M_m365_documents", "unique_key:s product:s viewed_or_edited_count:i visited_page_count:i",
     """select md5('t1-src-' || email || '-' || day || '-' || p) unique_key, p product, sum(k) viewed_or_edited_count, case when p = 'sharepoint' then count(*) end visited_page_count
        from ev cross join (values ('onedrive'), ('sharepoint')) v(p) group by email, day, p""")(
    lambda g: build_class("class_collab_document_activity", (lambda rows: _land(g, bronze_m365__onedrive_activity=rows, bronze_m365__sharepoint_activity=rows))(
        _daily(g, "sum(k) as viewedOrEditedFileCount", "count(*) as visitedPageCount").selectExpr("*", *_M365, *_nulls(
            "syncedFileCount", "sharedInternallyFileCount", "sharedExternallyFileCount")))))
case("M_m365_emails", "person_key:s date:d sent_count:i received_count:i", "select lower(email) person_key, day date, count(*) sent_count, sum(k) received_count from ev group by email, day")(
    lambda g: build_class("class_collab_email_activity", _land(g, bronze_m365__email_activity=_daily(g, "count(*) as sendCount", "sum(k) as receiveCount").selectExpr(
        "*", *_M365, *_nulls("readCount", "meetingCreatedCount", "meetingInteractedCount")))))


def _slack(g: Given) -> Landed:
    return _land(g, bronze_slack__users_details=_daily(g, "sum(k) as messages_posted_count", "sum(k % 50) + 20 as channel_messages_posted_count").selectExpr(
        "*", "lower(email) as user_id", "if(email like '%7', null, email) as email_address", "cast(day as string) as date", "false as is_guest", "true as is_billable_seat"))


case("M_slack_chats", "user_id:s person_key:s date:d direct_and_group_messages:i total_chat_messages:i channel_posts:i",
     """select lower(email) user_id, lower(email) person_key, day date, greatest(sum(k) - sum(k % 50) - 20, 0) direct_and_group_messages, sum(k) total_chat_messages, sum(k % 50) + 20 channel_posts
        from ev group by email, day""")(lambda g: build_class("class_collab_chat_activity", _slack(g)))
case("M_slack_users_latest", "user_id:s email:s unique_key:s", "select distinct lower(email) user_id, email, 't1-src-' || lower(email) unique_key from ev where email not like '%7'")(
    lambda g: collab.slack_users_latest(_slack(g)))


def _zoom(g: Given) -> Landed:
    """Meeting ids are users, their instances events; participants are the
    events of the same user."""
    meetings = _e(g, "user_id as id", "concat('m', event_id) as uuid", "cast(ts as string) as start_time", "cast(timestamp_micros(unix_micros(ts) + k * 300000000) as string) as end_time",
                  "true as has_video", "false as has_screen_share")
    joins = _e(g, "concat('m', event_id) as meeting_uuid", "'p' as participant_uuid", "email", "email as user_name", "cast(ts as string) as join_time",
               "cast(timestamp_micros(unix_micros(ts) + k * 60000000) as string) as leave_time", "if(k > 50, 'cam', '') as camera", "k > 90 as share_desktop",
               "false as share_application", "cast(null as boolean) as share_whiteboard")
    return _land(g, bronze_zoom__meetings=meetings, bronze_zoom__participants=joins)


_SESSIONS = """select event_id, user_id, k, day, email, sum(case when prev is null or date_diff('second', prev, ts) > 300 then 1 else 0 end) over (partition by user_id order by ts) n
    from (select *, lag(ts + to_seconds(k * 300)) over (partition by user_id order by ts, event_id) prev from ev)"""
case("M_zoom_sessions", "uuid:s logical_meeting_id:s", f"select 'm' || event_id uuid, user_id || '#' || n logical_meeting_id from ({_SESSIONS})")(lambda g: collab.zoom_sessions(_zoom(g)))
case("M_zoom_meetings", "person_key:s date:d meetings_attended:i audio_duration_seconds:i video_duration_seconds:i screen_share_duration_seconds:i",
     f"""select lower(email) person_key, day date, count(distinct n) meetings_attended, sum(k) * 60 audio_duration_seconds, coalesce(sum(k) filter (k > 50), 0) * 60 video_duration_seconds,
         coalesce(sum(k) filter (k > 90), 0) * 60 screen_share_duration_seconds from ({_SESSIONS}) group by email, day""")(
    lambda g: build_class("class_collab_meeting_activity", _zoom(g)))
case("M_zulip_chats", "person_key:s date:d total_chat_messages:i", "select lower(email) person_key, day date, sum(k) total_chat_messages from ev where user_id % 2 = 0 group by email, day")(
    lambda g: build_class("class_collab_chat_activity", _land(
        g, bronze_zulip_proxy__messages=_e(g, "event_id as uniq", "user_id as sender_id", "cast(ts as string) as created_at", "k as count"),
        bronze_zulip_proxy__users=g.customer.selectExpr(*_KEYS, "cast(c_custkey as string) as unique_key", _AT, "c_custkey as id", "if(c_custkey % 2 = 0, c_name, '') as email", "c_name as full_name"))))

# --- AI ----------------------------------------------------------------------------------------

_DAY = "cast(day as string) as date"
case("M_cursor_usage", "email:s day:d tool:s lines_added:i total_lines_added:i tool_use_offered:i chat_requests:i cost_cents:i",
     "select lower(email) email, day, 'cursor' tool, sum(k) lines_added, sum(k) * 2 total_lines_added, count(*) tool_use_offered, sum(k % 3) + sum(k % 2) chat_requests, null cost_cents from ev group by email, day")(
    lambda g: build_class("class_ai_dev_usage", _land(g, bronze_cursor__cursor_daily_usage=_daily(
        g, "sum(k) as acceptedLinesAdded", "sum(k) * 2 as totalLinesAdded", "count(*) as totalTabsShown", "sum(k % 3) as chatRequests", "sum(k % 2) as composerRequests").selectExpr(
        "*", "concat(' ', email) as mail", "unix_millis(cast(day as timestamp)) as date", "email as userId", "true as isActive", *_nulls(
            "acceptedLinesDeleted", "totalLinesDeleted", "totalTabsAccepted", "agentRequests")).drop("email").withColumnRenamed("mail", "email"))))
case("M_cursor_events", "unique_key:s origin:s", "select event_id unique_key, case when k > 50 then 'resync' else 'main' end origin from ev")(
    lambda g: ai.cursor_events(_land(g, bronze_cursor__cursor_usage_events=_e(g, "'a' as tokenUsage"),
                                     bronze_cursor__cursor_usage_events_daily_resync=_e(g, "'b' as tokenUsage", where="k > 50"))).selectExpr("unique_key", "_origin as origin"))
case("M_copilot_usage", "email:s day:d lines_added:i agent_sessions:i chat_requests:i",
     "select lower(email) email, day, sum(k) lines_added, case when sum(k) > 60 then 1 end agent_sessions, null chat_requests from ev where user_id % 3 > 0 group by email, day having sum(k) > 0")(
    lambda g: build_class("class_ai_dev_usage", _land(
        g, bronze_github_copilot__copilot_user_metrics=_daily(g, "sum(k) as loc_added_sum").selectExpr(
            "* except (day)", "email as user_login", "cast(day as string) as day", "loc_added_sum > 60 as used_agent", "false as used_chat", "false as used_cli", "0 as loc_deleted_sum",
            *_nulls("code_generation_activity_count", "code_acceptance_activity_count", "user_initiated_interaction_count", "collected_at")),
        bronze_github_copilot__copilot_seats=g.customer.selectExpr(*_KEYS, "cast(c_custkey as string) as unique_key", _AT, "c_name as user_login", "if(c_custkey % 3 > 0, c_name, ' ') as user_email"))))


def _enterprise(g: Given) -> Landed:
    used = [c for u in ai.SURFACES.values() for c in u.values() if c not in ("chat_message_count", "excel_session_count", "web_search_count")]
    used += ["code_lines_removed", "code_tool_rejected_count", "code_commit_count", "code_pull_request_count", "code_tool_accepted_count", "chat_metrics_json",
             "office_metrics_json", "cowork_metrics_json", "claude_code_metrics_json", "collected_at"]
    return _land(g, bronze_claude_enterprise__claude_enterprise_users=_daily(g, "sum(k) as chat_message_count", "sum(k % 2) as excel_session_count").selectExpr(
        "*", "email as user_email", "email as user_id", _DAY, "chat_message_count % 3 as web_search_count", "excel_session_count as code_session_count", "chat_message_count as code_lines_added",
        *_nulls(*used)))


case("M_claude_assistant", "unique_key:s surface:s session_count:i message_count:i search_count:i",
     """with d as (select lower(email) e, day, sum(k) s, sum(k % 2) x from ev group by email, day)
        select 't1-src-' || e || '-' || day || '-chat' unique_key, 'chat' surface, null session_count, s message_count, null search_count from d where s > 0
        union all select 't1-src-' || e || '-' || day || '-excel', 'excel', x, null, null from d where x > 0
        union all select 't1-src-' || e || '-' || day || '-cross', 'cross', null, null, s % 3 from d where s % 3 > 0""")(
    lambda g: build_class("class_ai_assistant_usage", _enterprise(g)))
case("M_claude_enterprise_code", "email:s day:d session_count:i lines_added:i tool_use_offered:i",
     "select lower(email) email, day, sum(k % 2) session_count, sum(k) lines_added, 0 tool_use_offered from ev group by email, day having sum(k) > 0")(
    lambda g: build_class("class_ai_dev_usage", _enterprise(g)))
case("M_claude_admin_code", "email:s api_key_id:s day:d session_count:i lines_added:i",
     """select case when event_type <> 'error' then lower(email) end email, case when event_type = 'error' then user_id::varchar end api_key_id, day, count(*) session_count, sum(k) lines_added
        from ev where event_type <> 'error' or user_id % 2 = 0 group by email, user_id, day, event_type = 'error', case when event_type <> 'error' then lower(email) end, case when event_type = 'error' then user_id::varchar end""")(
    lambda g: ai.claude_admin_dev_usage(_land(
        g, bronze_claude_admin__claude_admin_code_usage=_e(g, "if(event_type = 'error', 'api_actor', 'user') as actor_type", "email as actor_identifier",
                                                           _DAY, "1 as session_count", "k as lines_added", *_nulls("lines_removed", "tool_use_accepted", "tool_use_rejected", "collected_at")),
        bronze_claude_admin__claude_admin_api_keys=g.customer.filter("c_custkey % 2 = 0").selectExpr(*_KEYS, _AT, "cast(c_custkey as string) as id", "upper(c_name) as name"))))
case("M_claude_api", "unique_key:s day:d input_tokens:i cache_creation_tokens:i",
     "select 't1-src-ws:__null__-' || day || '-anthropic-api-' || event_type || '-__null__-__null__-' || event_id unique_key, day, k + 3 input_tokens, 2 cache_creation_tokens from ev")(
    lambda g: build_class("class_ai_api_usage", _land(g, bronze_claude_admin__claude_admin_messages_usage=_e(
        g, _DAY, "event_type as model", "cast(event_id as string) as context_window", "k as uncached_input_tokens", "1 as cache_read_tokens",
        "2 as cache_creation_5m_tokens", *_nulls("workspace_id", "api_key_id", "service_tier", "cache_creation_1h_tokens", "output_tokens", "collected_at")))))
case("M_openai_cost", "unique_id:s report_date:d amount_value:f", "select epoch_us(ts) // 1000000 || '|' || event_type || '|' unique_id, day report_date, value amount_value from ev")(
    lambda g: ai.openai_cost(_land(g, bronze_openai__costs=_e(g, "unix_seconds(ts) as bucket_start_time", "event_type as line_item", "cast(null as string) as project_id", "value as amount_value", "'usd' as amount_currency"))))

# --- CRM ----------------------------------------------------------------------------------------------

case("M_hubspot_deals", "deal_id:s amount:f close_date:d owner_id:s account_id:s is_closed:i is_won:i metadata:s",
     """select o_orderkey deal_id, o_totalprice amount, o_orderdate::date close_date, o_custkey owner_id, 'a' || o_custkey account_id, (o_orderstatus <> 'O')::int is_closed, (o_orderstatus = 'F')::int is_won,
        '{"pipeline":"","deal_type":"' || o_orderpriority || '","archived":"' || (o_orderstatus = 'P') || '"}' metadata from orders""")(
    lambda g: build_class("class_crm_deals", (lambda rows: _land(g, bronze_hubspot__deals=rows.filter("not archived"), bronze_hubspot__deals_archived=rows.filter("archived")))(_o(
        g, "cast(o_orderkey as string) as id", "cast(o_totalprice as string) as properties_amount", "cast(o_orderdate as string) as properties_closedate",
        "cast(o_custkey as string) as properties_hubspot_owner_id", "concat('[\"a', o_custkey, '\"]') as associations_companies", "if(o_orderstatus = 'O', null, 'true') as properties_hs_is_closed",
        "if(o_orderstatus = 'F', 'true', 'false') as properties_hs_is_closed_won", "o_orderpriority as properties_dealtype", "o_orderstatus = 'P' as archived", "o_orderdate as updatedAt",
        "o_orderdate as createdAt", "'hs' as data_source", "cast(null as timestamp) as archivedAt", *_nulls(
            "properties_dealname", "properties_hs_manual_forecast_category", "properties_dealstage", "properties_amount_in_home_currency", "properties_hs_acv", "properties_hs_tcv", "properties_hs_arr",
            "properties_hs_created_by_user_id", "properties_hs_analytics_source", "properties_hs_deal_stage_probability", "properties_closed_lost_reason", "properties_pipeline")))))


def _engagements(g: Given) -> Landed:
    base = ("cast(event_id as string) as id", "cast(user_id as string) as properties_hubspot_owner_id", "concat('h', user_id) as properties_hs_created_by_user_id",
            "'[]' as associations_contacts", "concat('[\"d', k, '\"]') as associations_deals", "null as associations_companies", "cast(ts as string) as properties_hs_timestamp",
            "ts as createdAt", "ts as updatedAt", "false as archived", "'hs' as data_source", "cast(null as timestamp) as archivedAt")
    of = lambda kind, *more: _e(g, *base, *more, where=f"event_type = '{kind}'")
    return _land(
        g, bronze_hubspot__engagements_calls=of("click", "cast(k * 1500 as string) as properties_hs_call_duration", *_nulls("properties_hs_call_disposition", "properties_hs_call_title", "properties_hs_call_direction")),
        bronze_hubspot__engagements_emails=of("view", *_nulls("properties_hs_email_status", "properties_hs_email_subject", "properties_hs_email_direction")),
        bronze_hubspot__engagements_meetings=of("signup", "cast(ts as string) as properties_hs_meeting_start_time", "cast(timestamp_micros(unix_micros(ts) + k * 1000000) as string) as properties_hs_meeting_end_time",
                                                *_nulls("properties_hs_meeting_outcome", "properties_hs_meeting_title", "properties_hs_meeting_location")),
        bronze_hubspot__engagements_tasks=of("error", *_nulls("properties_hs_task_status", "properties_hs_task_subject", "properties_hs_task_priority", "properties_hs_task_type")))


case("M_hubspot_activities", "activity_id:s activity_type:s owner_id:s deal_id:s contact_id:s duration_seconds:i timestamp:t",
     """select event_id activity_id, case event_type when 'click' then 'call' when 'view' then 'email' when 'signup' then 'meeting' else 'task' end activity_type, user_id owner_id, 'd' || k deal_id,
        null contact_id, case event_type when 'click' then k * 1500 // 1000 when 'signup' then k end duration_seconds, ts as timestamp from ev where event_type <> 'purchase'""")(
    lambda g: build_class("class_crm_activities", _engagements(g)))
case("M_salesforce_activities", "activity_id:s activity_type:s deal_id:s account_id:s duration_seconds:i",
     """select 'T' || event_id activity_id, case when event_type = 'click' then 'call' when event_type = 'view' then 'email' else 'task' end activity_type,
          case when k % 2 = 0 then '006' || k end deal_id, case when k % 2 = 1 then '001' || k end account_id, case when event_type = 'click' then k end duration_seconds from ev
        union all select 'E' || event_id, case when event_type = 'view' then 'meeting' else 'event' end, case when k % 2 = 0 then '006' || k end, case when k % 2 = 1 then '001' || k end, k * 60 from ev""")(
    lambda g: build_class("class_crm_activities", (lambda base: _land(
        g, bronze_salesforce__Task=_e(g, *base, "concat('T', event_id) as Id", "if(event_type = 'click', 'Outbound', null) as CallType", "if(event_type = 'view', 'Email', null) as TaskSubtype",
                                      "k as CallDurationInSeconds", *_nulls("Status", "Priority")).withColumn("unique_key", F.concat(F.lit("T"), "unique_key")),
        bronze_salesforce__Event=_e(g, *base, "concat('E', event_id) as Id", "if(event_type = 'view', 'Demo', if(event_type = 'click', 'Event', null)) as EventSubtype",
                                    "cast(k as string) as DurationInMinutes", *_nulls("StartDateTime", "Location", "EndDateTime"))))(
        ("cast(user_id as string) as OwnerId", "'x' as CreatedById", "'003' as WhoId", "concat(if(k % 2 = 0, '006', '001'), k) as WhatId", "cast(ts as string) as CreatedDate",
         "cast(ts as string) as SystemModstamp", "'{}' as custom_fields", "'sf' as data_source", "false as IsDeleted", *_nulls("ActivityDate", "Subject")))))

# --- people ------------------------------------------------------------------------------------------------

_DATE = "2024-01-05"


def _employees(g: Given) -> DataFrame:
    return g.customer.selectExpr(
        *_KEYS, "cast(c_custkey as string) as unique_key", _AT, "cast(c_custkey as string) as id", "c_name as displayName", "c_name as workEmail", "c_mktsegment as department",
        "if(c_acctbal < 0, 'Inactive', 'Active') as status", "if(c_nationkey = 3, 'Terminated', 'Full-Time') as employmentHistoryStatus", f"'{_DATE}' as lastChanged", *_nulls(
            "firstName", "lastName", "employeeNumber", "jobTitle", "division", "supervisorEId", "supervisorEmail", "location", "country", "city", "hireDate", "terminationDate"))


case("M_bamboohr_people", "unique_key:s email:s department_name:s status:s valid_from:t",
     f"""select c_custkey || '-{_DATE}' unique_key, c_name email, c_mktsegment department_name, case when c_acctbal >= 0 then 'active' when c_nationkey = 3 then 'terminated' else 'active' end status,
         timestamp '{_DATE}' valid_from from customer""")(lambda g: build_class("class_people", _land(g, bronze_bamboohr__employees=_employees(g))))
case("M_bamboohr_hours", "email:s working_hours_per_day:f", "select c_name email, 8.0 working_hours_per_day from customer where c_acctbal >= 0")(
    lambda g: build_class("class_hr_working_hours", _land(g, bronze_bamboohr__employees=_employees(g))))
case("M_bamboohr_identity", "source_account_id:s value_type:s value:s operation_type:s",
     """select c_custkey source_account_id, unnest(['email','display_name','department','status','id']) value_type,
          unnest([c_name, c_name, c_mktsegment, case when c_acctbal < 0 then 'Inactive' else 'Active' end, c_custkey::varchar]) as value, 'UPSERT' operation_type from customer
        union all select c_custkey, unnest(['email','employee_id','display_name','first_name','last_name','department','division','job_title','status','parent_email','parent_id','id']), '', 'DELETE'
          from customer where c_acctbal < 0""")(lambda g: build_class("identity_inputs", _land(g, bronze_bamboohr__employees=_employees(g))))
case("M_bamboohr_leave", "source_person_id:s email:s event_subtype:s start_date:d duration_amount:f",
     "select o_custkey source_person_id, c_name email, o_orderpriority event_subtype, o_orderdate::date start_date, (o_orderkey % 9)::double duration_amount from orders left join customer on c_custkey = o_custkey")(
    lambda g: build_class("class_hr_events", _land(g, bronze_bamboohr__employees=_employees(g), bronze_bamboohr__leave_requests=_o(
        g, "cast(o_custkey as string) as employeeId", "to_json(named_struct('name', o_orderpriority)) as type", "cast(o_orderdate as string) as start", "cast(o_orderdate as string) as end",
        "to_json(named_struct('amount', cast(o_orderkey % 9 as string), 'unit', 'days')) as amount", "'{}' as status", "cast(o_orderdate as string) as created"))))
case("M_directory_history", "entity_id:s field_name:s new_value:s",
     "select c_custkey entity_id, unnest(['displayName','workEmail','department','status','employmentHistoryStatus']) field_name, unnest([c_name, c_name, c_mktsegment, case when c_acctbal < 0 then 'Inactive' else 'Active' end, case when c_nationkey = 3 then 'Terminated' else 'Full-Time' end]) new_value from customer")(
    lambda g: (lambda d, t: d.changes(d.snapshot(t)))(directories.DIRECTORIES["bamboohr"], _land(g, bronze_bamboohr__employees=_employees(g))))



def _workers(g: Given) -> Landed:
    workers = g.customer.selectExpr(
        *_KEYS, "cast(c_custkey as string) as unique_key", _AT, "cast(c_custkey as string) as Employee_ID", "c_name as Display_Name", "c_name as Work_Email",
        "'Engineer' as Business_Title", "c_mktsegment as Supervisory_Organization", "cast(c_nationkey + 1 as string) as Manager_Employee_ID",
        "element_at(array('Active','On Leave','Terminated'), c_nationkey % 3 + 1) as Worker_Status", "if(c_acctbal < 0, 'Contingent Worker', 'Employee') as Worker_Type",
        f"'{_DATE}' as Last_Functionally_Updated", "cast(c_nationkey * 2 as string) as Scheduled_Weekly_Hours",
        *_nulls("First_Name", "Last_Name", "Job_Profile", "Manager_Work_Email", "Hire_Date", "Original_Hire_Date", "Termination_Date", "Location", "City", "Country"))
    return _land(g, bronze_workday__workers=workers)


case("M_workday_people", "unique_key:s email:s department_name:s status:s employment_type:s manager_person_id:s",
     f"""select c_custkey || '-{_DATE}' unique_key, c_name email, c_mktsegment department_name, case c_nationkey % 3 when 0 then 'active' when 1 then 'on_leave' else 'terminated' end status,
         case when c_acctbal < 0 then 'contractor' else 'full_time' end employment_type, c_nationkey + 1 manager_person_id from customer""")(
    lambda g: build_class("class_people", _workers(g)))
case("M_workday_hours", "email:s working_hours_per_day:f working_hours_per_week:f",
     "select c_name email, c_nationkey * 2 / 5.0 working_hours_per_day, c_nationkey * 2 working_hours_per_week from customer where c_nationkey % 3 = 0")(
    lambda g: build_class("class_hr_working_hours", _workers(g)))
case("G1_people_workday", "person_id:s org_unit_id:s job_title:s status:s supervisor_email:s",
     """select lower(c.c_name) person_id, c.c_mktsegment org_unit_id, 'Engineer' job_title, case when c.c_nationkey % 3 = 2 then 'Inactive' else 'Active' end status, lower(m.c_name) supervisor_email
        from customer c left join customer m on m.c_custkey = c.c_nationkey + 1""")(
    lambda g: Gold(g.spark, {"class_people": build_class("class_people", _workers(g))}, g.as_of, materialize=False).people)

# --- issue tracker and wikis ------------------------------------------------------------------------------------


def _jira(g: Given) -> Landed:
    from proving.history import _issues, _log

    issues = _issues(g).withColumn("_airbyte_extracted_at", F.col("_extracted_at")).drop("_extracted_at")
    log = _log(g).withColumn("id_readable", F.concat(F.lit("T-"), F.col("changelog_id"))).withColumn("_airbyte_extracted_at", F.col("_extracted_at")).drop("_extracted_at")
    fields = g.spark.createDataFrame([("status", "Status", "status", ""), ("labels", "Labels", "array", "string")], "field_id string, name string, schema_type string, schema_items string")
    return _land(g, bronze_jira__jira_issue=issues, bronze_jira__jira_issue_history=log, bronze_jira__jira_fields=fields.selectExpr("*", *_KEYS, "field_id as unique_key", _AT))


case("M_jira_field_history", "issue_id:s field_id:s event_kind:s n:i",
     """select o_orderkey issue_id, unnest(['status','priority','issuetype','resolution','assignee','reporter','project','parent','due_date','labels']) field_id, 'synthetic_initial' event_kind, 1 n from orders
        union all select o_orderkey, unnest(['status','labels']), 'changelog', 1 from orders""")(
    lambda g: build_class("class_task_field_history", _jira(g)).groupBy("issue_id", "field_id", "event_kind").agg(F.count(F.lit(1)).alias("n")))
case("M_jira_worklogs", "worklog_id:s author_id:s work_date:t duration_seconds:f", "select event_id worklog_id, 'u' || user_id author_id, ts work_date, k * 60 duration_seconds from ev")(
    lambda g: build_class("class_task_worklogs", _land(g, bronze_jira__jira_worklogs=_e(
        g, "cast(event_id as string) as worklog_id", "concat('T-', k) as id_readable", "concat('u', user_id) as author_account_id", "cast(ts as string) as started",
        "cast(k * 60 as string) as time_spent_seconds", "'note' as comment", "cast(null as string) as collected_at"))))
case("M_jira_users", "user_id:s email:s is_active:i", "select 'u' || c_custkey user_id, c_name email, (c_acctbal >= 0)::int is_active from customer")(
    lambda g: build_class("class_task_users", _land(g, bronze_jira__jira_user=g.customer.selectExpr(
        *_KEYS, "cast(c_custkey as string) as unique_key", _AT, "concat('u', c_custkey) as account_id", "c_name as email", "c_name as display_name", "'atlassian' as account_type", "c_acctbal >= 0 as active"))))

_EDITS = """select *, sum(case when prev is null or date_diff('second', prev, ts) > 1800 then 1 else 0 end) over (partition by page, user_id order by ts) n
    from (select *, k % 7 page, lag(ts) over (partition by k % 7, user_id order by ts, event_id) prev, row_number() over (partition by k % 7 order by ts, event_id) ordinal from ev)"""
_VERSION = ("concat('p', k % 7) as page_id", "cast(user_id as string) as author_id", "cast(ts as string) as created_at", "cast(null as string) as collected_at")
_WIKI = "author_id:s author_email:s day:d pages_edited:i total_edits:i pages_created:i"
case("M_confluence_activity", _WIKI,
     f"""select user_id author_id, lower(email) author_email, day, count(distinct page) pages_edited, count(distinct (page, n)) total_edits, count(*) filter (k = 1) pages_created from ({_EDITS})
         group by user_id, email, day""")(
    lambda g: build_class("class_wiki_activity", _land(
        g, bronze_confluence__wiki_page_versions=_e(g, *_VERSION, "k as version_number"),
        bronze_jira__jira_user=g.customer.selectExpr(*_KEYS, _AT, "cast(c_custkey as string) as account_id", "c_name as email"))))
case("M_outline_activity", _WIKI,
     f"""select user_id author_id, lower(email) author_email, day, count(distinct page) pages_edited, count(distinct (page, n)) total_edits, count(*) filter (ordinal = 1) pages_created from ({_EDITS})
         group by user_id, email, day""")(
    lambda g: build_class("class_wiki_activity", _land(
        g, bronze_outline__wiki_page_versions=_e(g, *_VERSION, "'' as author_email"),
        bronze_outline__wiki_users=g.customer.selectExpr(*_KEYS, "cast(c_custkey as string) as unique_key", _AT, "cast(c_custkey as string) as user_id", "c_name as email"))))
case("M_outline_engagement", "page_id:s day:d total_comments:i footer_comments:i inline_comments:i replies:i unique_commenters:i unresolved_inline_count:i",
     """select 'p' || (k % 7) page_id, day, count(*) total_comments, count(*) filter (event_type not in ('click','error')) footer_comments, count(*) filter (event_type = 'click') inline_comments,
        count(*) filter (event_type = 'error') replies, count(distinct user_id) unique_commenters, count(*) filter (event_type = 'click' and k > 50) unresolved_inline_count from ev group by 1, 2""")(
    lambda g: build_class("class_wiki_engagement", _land(g, bronze_outline__wiki_comments=_e(
        g, *_VERSION, "cast(event_id as string) as comment_id", "if(k > 50, 'open', 'done') as resolution_status", "if(event_type = 'error', 'x', '') as parent_comment_id",
        "if(event_type = 'click', 'text', null) as anchor_text"))))
case("M_outline_pages", "page_id:s space_name:s author_email:s version_count:i",
     "select p_partkey page_id, 'space ' || p_size space_name, lower(c_name) author_email, p_size version_count from part left join customer on c_custkey = p_partkey")(
    lambda g: build_class("class_wiki_pages", _land(
        g, bronze_outline__wiki_pages=g.table("part").selectExpr(
            *_KEYS, "cast(p_partkey as string) as unique_key", _AT, "cast(p_partkey as string) as page_id", "cast(p_size as string) as space_id", "p_name as title", "'published' as status",
            "cast(p_partkey as string) as author_id", "p_size as version_number", *_nulls("author_email", "last_editor_id", "last_editor_email", "parent_page_id", "created_at", "updated_at", "collected_at")),
        bronze_outline__wiki_spaces=g.table("part").selectExpr("p_size").distinct().selectExpr(*_KEYS, "cast(p_size as string) as unique_key", _AT, "cast(p_size as string) as space_id",
                                                                                           "concat('space ', p_size) as name", "'' as url"),
        bronze_outline__wiki_users=g.customer.selectExpr(*_KEYS, "cast(c_custkey as string) as unique_key", _AT, "cast(c_custkey as string) as user_id", "c_name as email"))))

