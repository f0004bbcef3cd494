"""AI tools -> class_ai_*."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from workmart.functions.keys import unique_key
from workmart.functions.scalars import any_positive, day, filled, from_millis, moment, normal_email, number, text
from workmart.operators.latest import latest_by
from workmart.operators.reshape import union_all
from workmart.plans.registry import Landed, feeds
from workmart.plans.staging.shape import count, count0, flat_json, labels, shape, total0, truth, version

MARK = "__null__"


def _mailed(df: DataFrame, mail: str, date: str) -> DataFrame:
    return df.filter(filled(F.trim(mail)) & F.col(date).isNotNull())


def _newest_daily(t: Landed, table: str, mail: str = "email") -> DataFrame:
    """One row per person and day; re-sent days replace earlier ones."""
    df = _mailed(t(table), mail, "date").withColumn("__mail", normal_email(mail))
    return latest_by(df, ["tenant_id", "source_id", "__mail", "date"], ["_extracted_at"], ["unique_key"])


def _usage(df: DataFrame, tool: str, source: str, data_source: Column | None = None, **columns: Column) -> DataFrame:
    """The columns all usage rows share."""
    return shape(df, "tenant_id", "source_id", tool=F.lit(tool), source=F.lit(source),
                 data_source=F.col("data_source") if data_source is None else data_source, _version=version(), **columns)


@feeds("class_ai_assistant_usage", "chatgpt_team", "bronze_chatgpt_team.chatgpt_team_chat_activity")
def chatgpt_chats(t: Landed) -> DataFrame:
    df = _newest_daily(t, "bronze_chatgpt_team.chatgpt_team_chat_activity")
    kinds = ["messages", "tool_messages", "connector_messages", "project_messages", "gpt_messages"]
    details = flat_json(**{k: count0(k) for k in ("gpt_messages", "tool_messages", "connector_messages", "project_messages")},
                        credits_used=F.coalesce(F.col("credits_used"), F.lit(0)), seat_type=text("seat_type"))
    return _usage(
        df.filter(any_positive(*kinds)), "chatgpt", "chatgpt_team", surface=F.lit("chat"), email=F.col("__mail"), day=F.to_date("date"),
        unique_key=unique_key("tenant_id", "source_id", "__mail", "date", F.lit("chat")), message_count=count("messages"),
        surface_metrics_json=details, collected_at=F.col("_extracted_at"))


@feeds("class_ai_dev_usage", "chatgpt_team", "bronze_chatgpt_team.chatgpt_team_codex_user_daily")
def chatgpt_codex(t: Landed) -> DataFrame:
    df = _newest_daily(t, "bronze_chatgpt_team.chatgpt_team_codex_user_daily")
    details = flat_json(credits=F.coalesce(F.col("credits"), F.lit(0)), n_turns=count0("n_turns"),
                        text_tokens=count0("text_tokens"), current_streak=count0("current_streak"))
    return _usage(
        df.filter(any_positive("credits", "n_turns", "n_threads", "lines_added")), "codex", "chatgpt_team",
        email=F.col("__mail"), day=F.to_date("date"), unique_key=unique_key("tenant_id", "source_id", "__mail", "date"),
        session_count=count0("n_threads"), lines_added=count0("lines_added"), tool_action_breakdown_json=details,
        collected_at=F.col("_extracted_at"))


@feeds("class_ai_api_usage", "claude_admin", "bronze_claude_admin.claude_admin_messages_usage")
def claude_api(t: Landed) -> DataFrame:
    df = t("bronze_claude_admin.claude_admin_messages_usage")
    date = F.to_date("date")
    or_mark = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MARK))
    key = unique_key("tenant_id", t.source_column, F.concat(F.lit("ws:"), or_mark("workspace_id")), date,
                     F.lit("anthropic-api"), *[or_mark(c) for c in ("model", "api_key_id", "service_tier", "context_window")])
    cached = ("cache_creation_5m_tokens", "cache_creation_1h_tokens")
    return shape(
        df, "tenant_id", "api_key_id", "workspace_id", source_id=F.col(t.source_column), unique_key=key, day=date,
        **labels(provider="anthropic", channel="api", source="claude_admin", data_source="claude_admin"),
        input_tokens=total0("uncached_input_tokens", "cache_read_tokens", *cached), output_tokens=count0("output_tokens"),
        cache_read_tokens=count0("cache_read_tokens"), cache_creation_tokens=total0(*cached),
        collected_at=moment("collected_at"), _version=version())


def claude_admin_dev_usage(t: Landed) -> DataFrame:
    """Coding usage from the admin API. Kept outside the class, as the
    enterprise report covers the same people."""
    raw = t("bronze_claude_admin.claude_admin_code_usage").filter(
        F.col("actor_type").isin("user", "api_actor") & filled(F.trim("actor_identifier")))
    sums = {n: F.sum(count0(c)) for n, c in (
        ("session_count", "session_count"), ("lines_added", "lines_added"), ("lines_removed", "lines_removed"),
        ("accepted", "tool_use_accepted"), ("rejected", "tool_use_rejected"))}
    used = raw.groupBy("tenant_id", F.col(t.source_column).alias("source_id"), "actor_type",
                       normal_email("actor_identifier").alias("actor"), F.to_date("date").alias("day")).agg(
        *[c.alias(n) for n, c in sums.items()], F.max(moment("collected_at")).alias("collected_at"))
    # Only API actors look their key up by name; users get a NULL name.
    keys = t("bronze_claude_admin.claude_admin_api_keys").filter(filled(F.trim("name"))).select(
        "tenant_id", F.col("id").alias("api_key_id"), normal_email("name").alias("key_name"))
    named = used.withColumn("key_name", F.when(F.col("actor_type") == "api_actor", F.col("actor")))
    df = named.join(keys, ["tenant_id", "key_name"], "left").filter(
        (F.col("actor_type") == "user") | F.col("api_key_id").isNotNull())
    return shape(
        df, "tenant_id", "source_id", "api_key_id", "day", "session_count", "lines_added", "lines_removed", "collected_at",
        unique_key=unique_key("tenant_id", "source_id", "actor_type", "actor", "day"),
        email=F.when(F.col("actor_type") == "user", F.col("actor")), tool_use_offered=F.col("accepted") + F.col("rejected"),
        tool_use_accepted=F.col("accepted"), **labels(tool="claude_code", source="claude_admin", data_source="claude_admin"),
        _version=F.coalesce(F.unix_millis("collected_at"), F.lit(0).cast("bigint")))


# Surfaces of the assistant report: counter of the class -> landed column.
SURFACES = {
    "chat": {
        "conversation_count": "chat_conversation_count", "message_count": "chat_message_count",
        "files_uploaded_count": "chat_files_uploaded_count", "artifacts_created_count": "chat_artifacts_created_count",
        "projects_created_count": "chat_projects_created_count", "projects_used_count": "chat_projects_used_count",
        "skills_used_count": "chat_skills_used_count", "connectors_used_count": "chat_connectors_used_count",
        "thinking_message_count": "chat_thinking_message_count",
    },
    "excel": {"session_count": "excel_session_count", "message_count": "excel_message_count"},
    "powerpoint": {"session_count": "powerpoint_session_count", "message_count": "powerpoint_message_count"},
    "cowork": {
        "session_count": "cowork_session_count", "message_count": "cowork_message_count",
        "action_count": "cowork_action_count", "dispatch_turn_count": "cowork_dispatch_turn_count",
        "skills_used_count": "cowork_skills_used_count",
    },
    "cross": {"search_count": "web_search_count"},
}
SURFACE_DETAILS = {"chat": "chat_metrics_json", "excel": "office_metrics_json", "powerpoint": "office_metrics_json",
                   "cowork": "cowork_metrics_json"}


def split_surfaces(df: DataFrame, surfaces: dict[str, dict[str, str]] = SURFACES,
                   details: dict[str, str] = SURFACE_DETAILS) -> DataFrame:
    """One wide row -> one row per surface that was used at all (P13), in one
    pass over the table."""
    counters = sorted({n for used in surfaces.values() for n in used})

    def surface(name: str, used: dict[str, str]) -> Column:
        row = F.struct(
            F.lit(name).alias("surface"),
            *[(count(used[n]) if n in used else F.lit(None).cast("bigint")).alias(n) for n in counters],
            (F.col(details[name]).cast("string") if name in details else F.lit(None).cast("string")).alias("surface_metrics_json"))
        return F.when(any_positive(*used.values()), row)

    rows = F.filter(F.array(*[surface(n, u) for n, u in surfaces.items()]), lambda r: r.isNotNull())
    return df.withColumn("__rows", rows).select(*df.columns, F.inline("__rows"))


def _enterprise(t: Landed) -> DataFrame:
    df = t("bronze_claude_enterprise.claude_enterprise_users").filter(filled(F.trim("user_email")))
    return latest_by(df, ["tenant_id", "source_id", "user_id", "date"], ["_extracted_at"], ["unique_key"])


@feeds("class_ai_assistant_usage", "claude_enterprise", "bronze_claude_enterprise.claude_enterprise_users")
def claude_assistant(t: Landed) -> DataFrame:
    df = split_surfaces(_enterprise(t).drop("unique_key")).withColumn("email", normal_email("user_email")).withColumn("day", F.to_date("date"))
    counters = sorted({n for used in SURFACES.values() for n in used})
    return _usage(
        df, "claude", "claude_enterprise", F.lit("claude_enterprise"), email=F.col("email"), day=F.col("day"), surface=F.col("surface"),
        unique_key=unique_key("tenant_id", "source_id", "email", "day", "surface"),
        **{n: F.col(n) for n in counters}, surface_metrics_json=F.col("surface_metrics_json"), collected_at=moment("collected_at"))


@feeds("class_ai_dev_usage", "claude_enterprise", "bronze_claude_enterprise.claude_enterprise_users")
def claude_enterprise_code(t: Landed) -> DataFrame:
    used = any_positive("code_session_count", "code_lines_added", "code_tool_accepted_count", "code_commit_count", "code_pull_request_count")
    return _usage(
        _enterprise(t).filter(F.col("date").isNotNull() & used), "claude_code", "claude_enterprise", F.lit("claude_enterprise"),
        unique_key=unique_key("tenant_id", "source_id", "user_id", "date"), email=normal_email("user_email"), day=day("date"),
        session_count=count0("code_session_count"), lines_added=count0("code_lines_added"), lines_removed=count0("code_lines_removed"),
        tool_use_offered=total0("code_tool_accepted_count", "code_tool_rejected_count"),
        tool_use_accepted=count0("code_tool_accepted_count"), commits_count=count0("code_commit_count"),
        pull_requests_count=count0("code_pull_request_count"), tool_action_breakdown_json=F.col("claude_code_metrics_json"),
        collected_at=moment("collected_at"))


@feeds("class_ai_dev_usage", "claude_team", "bronze_claude_team.claude_team_code_metrics")
def claude_team_code(t: Landed) -> DataFrame:
    df = _mailed(t("bronze_claude_team.claude_team_code_metrics"), "email", "metric_date").filter("status = 'active'")
    mail = normal_email("email")
    return _usage(
        df, "claude_code", "claude_team", unique_key=unique_key("tenant_id", "source_id", mail, "metric_date"), email=mail,
        day=F.to_date("metric_date"), session_count=count0("total_sessions"), lines_added=count0("total_lines_accepted"),
        cost_cents=F.round(number("total_cost") * 100).cast("bigint"), prs_with_cc_count=count("prs_with_cc"),
        prs_total_count=count("total_prs"), collected_at=F.col("_extracted_at"))


@feeds("class_ai_dev_usage", "cursor", "bronze_cursor.cursor_daily_usage")
def cursor_usage(t: Landed) -> DataFrame:
    df = _mailed(t("bronze_cursor.cursor_daily_usage"), "email", "date").filter(truth("isActive"))
    date = F.to_date(from_millis("date"))
    return _usage(
        df, "cursor", "cursor", F.lit("cursor"), unique_key=unique_key("tenant_id", "source_id", "userId", date),
        email=normal_email("email"), day=date, session_count=F.lit(1), lines_added=count0("acceptedLinesAdded"),
        lines_removed=count0("acceptedLinesDeleted"), total_lines_added=count0("totalLinesAdded"),
        total_lines_removed=count0("totalLinesDeleted"), tool_use_offered=count("totalTabsShown"),
        tool_use_accepted=count("totalTabsAccepted"), agent_sessions=count("agentRequests"),
        chat_requests=total0("chatRequests", "composerRequests"), collected_at=F.col("_extracted_at"))


def cursor_events(t: Landed) -> DataFrame:
    """Usage events and their daily re-sync as one table; on equal extraction
    times the re-sync counts."""
    main = t("bronze_cursor.cursor_usage_events").withColumn("_origin", F.lit("main"))
    again = t("bronze_cursor.cursor_usage_events_daily_resync").withColumn("_origin", F.lit("resync"))
    df = union_all([main, again])
    df = df.withColumn("tokenUsage", F.col("tokenUsage").cast("string"))
    return latest_by(df, ["unique_key"], ["_extracted_at", F.col("_origin") == "resync"])


@feeds("class_ai_dev_usage", "copilot", "bronze_github_copilot.copilot_user_metrics", "bronze_github_copilot.copilot_seats")
def copilot_usage(t: Landed) -> DataFrame:
    who = ["tenant_id", "source_id", "user_login"]
    seats = latest_by(t("bronze_github_copilot.copilot_seats"), who, ["_extracted_at"], ["unique_key"])
    seats = seats.filter(filled(F.trim("user_email"))).select(*who, normal_email("user_email").alias("__mail"))
    used = any_positive("code_acceptance_activity_count", "code_generation_activity_count", "loc_added_sum", "user_initiated_interaction_count")
    modes = {m: truth(m) for m in ("used_chat", "used_agent", "used_cli")}
    metrics = latest_by(t("bronze_github_copilot.copilot_user_metrics"), [*who, "day"], ["_extracted_at"], ["unique_key"])
    metrics = metrics.filter(filled(F.col("day")) & (used | modes["used_chat"] | modes["used_agent"] | modes["used_cli"]))
    df = metrics.join(seats, who)
    return _usage(
        df, "copilot", "copilot", F.lit("github_copilot"), unique_key=unique_key(*who, "day"), email=F.col("__mail"),
        day=day("day"), session_count=F.lit(1), lines_added=count0("loc_added_sum"), lines_removed=count0("loc_deleted_sum"),
        tool_use_offered=count0("code_generation_activity_count"), tool_use_accepted=count0("code_acceptance_activity_count"),
        agent_sessions=F.when(modes["used_agent"], 1), chat_requests=F.when(modes["used_chat"], 1),
        tool_action_breakdown_json=F.to_json(F.struct(*[c.alias(n) for n, c in modes.items()])), collected_at=moment("collected_at"))


@feeds("class_ai_org_usage", "copilot", "bronze_github_copilot.copilot_org_metrics")
def copilot_org(t: Landed) -> DataFrame:
    df = latest_by(t("bronze_github_copilot.copilot_org_metrics").filter(filled(F.col("day"))),
                   ["tenant_id", "source_id", "day"], ["_extracted_at"], ["unique_key"])
    plain = ("daily_active_users", "weekly_active_users", "monthly_active_users", "user_initiated_interaction_count",
             "code_generation_activity_count", "code_acceptance_activity_count", "loc_added_sum", "loc_deleted_sum")
    return shape(
        df, "tenant_id", "source_id", "organization_id", "enterprise_id", unique_key=unique_key("tenant_id", "source_id", "day"),
        day=day("day"), **{n: count0(n) for n in plain}, monthly_active_chat_users=count("monthly_active_chat_users"),
        monthly_active_agent_users=count("monthly_active_agent_users"), pull_requests_json=F.col("pull_requests"),
        **labels(source="copilot", data_source="github_copilot"), collected_at=moment("collected_at"), _version=version())


def openai_cost(t: Landed) -> DataFrame:
    """Daily cost lines of the API platform."""
    df = t("bronze_openai.costs")
    return shape(df, "tenant_id", "source_id", "line_item", "project_id", "amount_value", "amount_currency",
                 unique_id=unique_key("bucket_start_time", "line_item", "project_id", sep="|"),
                 report_date=F.to_date(F.timestamp_seconds(F.col("bucket_start_time").cast("bigint"))),
                 **labels(provider="openai", data_source="openai"))


def openai_tool_usage(t: Landed) -> DataFrame:
    """Daily completion usage per user, project and model."""
    df = t("bronze_openai.usage_completions")
    return shape(df, "tenant_id", "source_id", "user_id", "project_id", "model", "input_tokens", "output_tokens",
                 "input_cached_tokens", "input_audio_tokens", "output_audio_tokens", "num_model_requests", "service_tier",
                 unique_id=unique_key("bucket_start_time", "project_id", "model", "user_id", sep="|"),
                 report_date=F.to_date(F.timestamp_seconds(F.col("bucket_start_time").cast("bigint"))), is_batch=truth("batch"),
                 person_id=F.lit(None).cast("string"), **labels(provider="openai", client="openai_api", data_source="openai"))
