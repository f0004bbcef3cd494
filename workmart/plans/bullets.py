"""Long metric rows: person_id, org_unit_id, metric_date, metric_key,
metric_value (G16-G21).

Each section stacks its sources, already reduced to person and day where the
metric allows it, and meets the people table once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from workmart.functions.scalars import file_category, filled, person_key, rounded, seconds_between
from workmart.operators.latest import latest_values
from workmart.operators.reshape import anchor_aggregate, join_by_kind, union_all, unpivot
from workmart.plans.marts import longest_modality

ROW = ["person_id", "metric_date", "metric_key", "metric_value"]


def with_unit(rows: DataFrame, people: DataFrame) -> DataFrame:
    units = people.select("person_id", "org_unit_id")
    return rows.join(units, "person_id", "left").select("person_id", "org_unit_id", "metric_date", "metric_key", "metric_value")


def _rows(df: DataFrame, person: str | Column, day: str | Column, values: dict[str, Column]) -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return unpivot(df.withColumn("__p", col(person)).withColumn("__d", col(day)),
                   [F.col("__p").alias("person_id"), F.col("__d").alias("metric_date")], values)


def _num(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


# --- issues (G16, G17) -----------------------------------------------------------------

def task_delivery_rows(closed: DataFrame, dev: DataFrame, closes: DataFrame, reopens: DataFrame, worklogs: DataFrame,
                       in_progress: DataFrame, stale: DataFrame, people: DataFrame, as_of: Column) -> DataFrame:
    accuracy = F.when((F.coalesce("avg_time_spent", F.lit(0.0)) > 0) & F.col("avg_time_estimate").isNotNull(),
                      rounded(F.col("avg_time_estimate") / F.nullif("avg_time_spent", F.lit(0.0)) * 100, 1))
    done = _rows(closed, "person_id", "metric_date", {
        "tasks_completed": F.col("tasks_closed"), "due_date_on_time": F.col("on_time_count"),
        "due_date_with_due": F.col("has_due_date_count"), "estimation_accuracy": accuracy, "bugs_fixed": F.col("bugs_fixed")})

    work, lead = F.col("dev_seconds"), F.col("lead_seconds")
    both = (work > 0) & (lead > 0)
    flow = _rows(dev, "assignee_email", "close_date", {
        "task_dev_time": F.when(work != 0, rounded(work / 3600.0, 2)),
        "mean_time_to_resolution": F.when(lead != 0, rounded(lead / 86400.0, 2)),
        "flow_efficiency_num": F.when(both, work), "flow_efficiency_den": F.when(both, lead),
        "pickup_time": rounded(F.col("pickup_seconds") / 86400.0, 2)})
    moved = union_all([
        _rows(closes, "assignee_email", "event_date", {"task_reopen_rate": F.col("close_count")}),
        _rows(reopens, "assignee_email", "event_date", {"task_reopen_rate": -F.col("reopen_count")})])

    # Logged against measured work, per person and day: NULL unless work was
    # measured, so that the ratio has both sides.
    days = anchor_aggregate(
        [(worklogs.select(F.col("author_email").alias("person_id"), F.col("work_date").alias("metric_date"), "worklog_seconds"),
          {"logged": F.col("worklog_seconds")}),
         (in_progress.select(F.col("assignee_email").alias("person_id"), F.col("day").alias("metric_date"), "in_progress_seconds"),
          {"measured": F.col("in_progress_seconds")})],
        ["person_id", "metric_date"], {"logged": F.sum("logged"), "measured": F.sum("measured")})
    measured = F.col("measured") > 0
    logged = _rows(days, "person_id", "metric_date", {
        "worklog_seconds": F.when(measured, F.coalesce("logged", F.lit(0.0))),
        "in_progress_seconds": F.when(measured, F.col("measured"))})
    old = _rows(stale.groupBy("assignee_email").agg(F.sum("stale_count").alias("n")), "assignee_email", F.to_date(as_of),
                {"stale_in_progress": F.col("n")})
    return with_unit(union_all([done, flow, moved, logged, old]), people)


def code_quality_rows(closed: DataFrame, people: DataFrame) -> DataFrame:
    return with_unit(_rows(closed, "person_id", "metric_date", {"bugs_fixed": F.col("bugs_fixed")}), people)


# --- git (G18) -----------------------------------------------------------------------------

def git_rows(commits: DataFrame, changes: DataFrame, prs: DataFrame, people: DataFrame) -> DataFrame:
    mine = commits.filter((F.col("is_merge_commit") == 0) & filled(F.col("author_email")) & F.col("date").isNotNull()).withColumn(
        "person_id", F.lower("author_email")).withColumn("metric_date", F.to_date("date"))
    # Distinct commits in two steps: a bot's commits are reduced per hash
    # before anything is counted per person.
    per_hash = mine.groupBy("person_id", "metric_date", "commit_hash").agg(
        F.sum(F.col("lines_added") + F.col("lines_removed")).alias("lines"))
    daily = per_hash.groupBy("person_id", "metric_date").agg(F.count(F.lit(1)).alias("commits"), F.sum("lines").alias("loc"))
    output = _rows(daily, "person_id", "metric_date", {"commits": F.col("commits"), "loc": F.col("loc")})

    where = ["tenant_id", "project_key", "repo_slug", "commit_hash"]
    code = changes.filter(file_category("file_path") == "code").groupBy(*where).agg(F.sum("lines_added").alias("clean"))
    clean = mine.join(code, where).groupBy("person_id", "metric_date").agg(F.sum("clean").alias("clean_loc"))
    clean = _rows(clean, "person_id", "metric_date", {"clean_loc": F.col("clean_loc")})

    owned = prs.withColumn("person_id", person_key("author_email", "author_name")).filter(filled(F.col("person_id")))
    opened, closed = F.to_date("created_on"), F.to_date("closed_on")
    merged = (F.lower("state") == "merged") & F.col("closed_on").isNotNull()
    timed = merged & (F.col("closed_on") >= F.col("created_on"))
    entry = lambda when, day, key, value: F.when(when, F.struct(
        day.alias("metric_date"), F.lit(key).alias("metric_key"), value.cast("double").alias("metric_value")))
    # One pass over the requests; counters are added up below, sizes and
    # times stay one row per request.
    facts = owned.select("person_id", F.inline(F.filter(F.array(
        entry(F.col("created_on").isNotNull(), opened, "prs_created", F.lit(1)),
        entry(merged, closed, "prs_merged", F.lit(1)),
        entry(F.col("created_on").isNotNull(), opened, "pr_size", F.col("lines_added") + F.col("lines_removed")),
        entry(timed, closed, "pr_cycle_time_h", seconds_between(F.col("created_on"), F.col("closed_on")) / 3600.0),
    ), lambda e: e.isNotNull())))
    counted = F.col("metric_key").isin("prs_created", "prs_merged")
    counts = facts.filter(counted).groupBy("person_id", "metric_date", "metric_key").agg(F.sum("metric_value").alias("metric_value"))
    return with_unit(union_all([output, clean, counts, facts.filter(~counted)]), people)


# --- collaboration (G19) ---------------------------------------------------------------------

def _mailed(df: DataFrame) -> DataFrame:
    return df.filter(filled(F.col("email"))).withColumn("person_id", F.lower("email"))


def collab_rows(emails: DataFrame, meetings: DataFrame, chats: DataFrame, documents: DataFrame, people: DataFrame) -> DataFrame:
    m365, slack, zoom = ("m365", "slack", "zoom")
    of = lambda source: F.col("data_source") == source
    mail = _mailed(emails).filter(of(m365))
    sent = _rows(mail, "person_id", "date", {
        "m365_emails_sent": _num("sent_count"), "m365_emails_received": _num("received_count"), "m365_emails_read": _num("read_count")})

    spent, attended = longest_modality().cast("double") / 3600.0, _num("meetings_attended")
    every = _num("audio_duration_seconds") + _num("video_duration_seconds") + _num("screen_share_duration_seconds")
    only = lambda source, value: F.sum(F.when(of(source), value).otherwise(0.0))
    daily = _mailed(meetings).groupBy("person_id", F.col("date").alias("metric_date")).agg(
        F.sum(spent).alias("meeting_hours"), F.sum(attended).alias("meetings_count"),
        only(m365, spent).alias("teams_meeting_hours"), only(zoom, spent).alias("zoom_meeting_hours"),
        only(m365, attended).alias("teams_meetings"), only(zoom, attended).alias("zoom_meetings"),
        F.when(F.sum(every) == 0, 1.0).otherwise(0.0).alias("meeting_free"))
    met = _rows(daily, "person_id", "metric_date", {c: F.col(c) for c in daily.columns[2:]})

    said = _mailed(chats)
    teams = _rows(said.filter(of(m365)), "person_id", "date", {"m365_teams_chats": _num("total_chat_messages")})
    slacked = _rows(said.filter(of(slack)), "person_id", "date", {
        "slack_messages_sent": _num("total_chat_messages"), "slack_channel_posts": _num("channel_posts"),
        "slack_active_days": F.when(_num("total_chat_messages") > 0, 1.0).otherwise(0.0)})
    files = _mailed(documents).filter(of(m365))
    shared = _rows(files, "person_id", "date", {
        "m365_files_shared_internal": _num("shared_internally_count"),
        "m365_files_shared_external": _num("shared_externally_count"), "m365_files_engaged": _num("viewed_or_edited_count")})

    act = lambda df, value: df.select("person_id", F.col("date").alias("metric_date"), value.alias("activity"))
    active = union_all([
        act(mail, _num("sent_count")), act(said.filter(of(m365)), _num("total_chat_messages")),
        act(files, _num("viewed_or_edited_count") + _num("shared_internally_count") + _num("shared_externally_count"))])
    active = active.groupBy("person_id", "metric_date").agg(F.sum("activity").alias("activity"))
    active = _rows(active, "person_id", "metric_date", {"m365_active_days": F.when(F.col("activity") > 0, 1.0).otherwise(0.0)})
    return with_unit(union_all([sent, met, teams, slacked, shared, active]), people)


# --- AI (G20) ------------------------------------------------------------------------------------

def _ai_keys() -> dict[str, dict[str, Column]]:
    one = F.lit(1.0)
    return {
        "": {"active_ai_members": one, "team_ai_loc": _num("lines_added")},
        "cursor": {
            "cursor_active": one, "cursor_completions": _num("tool_use_accepted"), "cursor_agents": _num("agent_sessions"),
            "cursor_lines": _num("lines_added"), "cursor_offered": _num("tool_use_offered"),
            "cursor_total_lines": _num("total_lines_added")},
        "claude_code": {
            "cc_active": one, "cc_sessions": _num("session_count"), "cc_lines": _num("lines_added"),
            "cc_tool_accept": _num("tool_use_accepted"), "cc_offered": _num("tool_use_offered"), "cc_cost": _num("cost_cents")},
        "codex": {"codex_active": one, "codex_lines": _num("lines_added"), "codex_sessions": _num("session_count")},
    }


def ai_rows(dev: DataFrame, assistant: DataFrame, people: DataFrame) -> DataFrame:
    """Rows of each tool's own keys, in one scan of the usage table."""
    entry = lambda when, key, value: F.when(when, F.struct(F.lit(key).alias("metric_key"), value.alias("metric_value")))
    entries = [entry(F.lit(True) if tool == "" else F.col("tool") == tool, k, v)
               for tool, keys in _ai_keys().items() for k, v in keys.items()]
    used = _mailed(dev).select("person_id", F.col("day").alias("metric_date"),
                               F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))
    chat = _rows(_mailed(assistant).filter(F.col("tool") == "chatgpt"), "person_id", "day",
                 {"chatgpt_active": F.lit(1.0), "chatgpt": _num("message_count")})
    return with_unit(union_all([used, chat]), people)


# --- CRM (G21) --------------------------------------------------------------------------------------

def crm_owners(users: DataFrame) -> DataFrame:
    return users.filter(filled(F.col("email"))).select("user_id", "hs_user_id", F.lower("email").alias("person_id"))


def crm_units(people: DataFrame) -> DataFrame:
    """One unit per person; the newest HR row counts."""
    rows = people.filter(filled(F.col("email"))).withColumn("person_id", F.lower("email"))
    return latest_values(rows, ["person_id"], ["ingested_at", "unique_key"],
                         {"org_unit_id": F.coalesce("department_name", F.lit("Unknown"))})


def owned_deals(deals: DataFrame, users: DataFrame) -> DataFrame:
    owners = crm_owners(users).select(F.col("user_id").alias("owner_id"), "person_id")
    return deals.join(owners, "owner_id")


def owned_activities(activities: DataFrame, users: DataFrame) -> DataFrame:
    """Calls belong to their owner, everything else to its creator."""
    owners = crm_owners(users)
    rows = join_by_kind(
        activities.filter(F.col("timestamp").isNotNull()), owners.select("user_id", "person_id"), "owner_id",
        owners.filter(F.col("hs_user_id").isNotNull()).select("hs_user_id", "person_id"), "created_by_user_id",
        F.col("activity_type") == "call", "person_id")
    return rows.filter(filled(F.col("person_id")))


ACTIVITY_KEYS = {"call": "calls", "email": "emails", "meeting": "meetings", "task": "tasks"}


def crm_rows(deals: DataFrame, activities: DataFrame, users: DataFrame, people: DataFrame) -> DataFrame:
    opened, closed = F.to_date("created_at"), F.col("close_date")
    won, done = F.col("is_won") == 1, F.col("is_closed") == 1
    entry = lambda when, day, key, value: F.when(when & day.isNotNull(), F.struct(
        day.alias("metric_date"), F.lit(key).alias("metric_key"), value.cast("double").alias("metric_value")))
    days = F.greatest(F.lit(0), F.date_diff(closed, opened))
    facts = owned_deals(deals, users).select("person_id", F.inline(F.filter(F.array(
        entry(F.lit(True), opened, "deals_opened", F.lit(1)), entry(done, closed, "deals_closed", F.lit(1)),
        entry(won, closed, "deals_won", F.lit(1)), entry(won & F.col("created_at").isNotNull(), closed, "cycle_days", days),
        entry(won & F.col("amount_home").isNotNull(), closed, "deal_size", F.col("amount_home")),
    ), lambda e: e.isNotNull())))
    kind = F.coalesce(*[F.when(F.col("activity_type") == k, F.lit(v)) for k, v in ACTIVITY_KEYS.items()], F.col("activity_type"))
    contacts = owned_activities(activities, users).select(
        "person_id", F.to_date("timestamp").alias("metric_date"), kind.alias("metric_key"), F.lit(1.0).alias("metric_value"))
    rows = with_unit(union_all([facts, contacts]), crm_units(people))
    return rows.withColumn("org_unit_id", F.coalesce("org_unit_id", F.lit("Unknown")))


