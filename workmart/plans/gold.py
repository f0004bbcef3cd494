"""Gold views."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from workmart.functions.scalars import clamp, filled, json_number, json_text, moment, ratio, rounded, seniority, week
from workmart.operators import issues
from workmart.operators.latest import latest_values
from workmart.operators.quantiles import exact_quantiles
from workmart.operators.reshape import empty_table, union_all, unpivot
from workmart.operators.rollup import company_stats, person_period
from workmart.plans import bullets, marts
from workmart.plans.contracts import contract
from workmart.session import store

# How a metric is rolled up over a person's days.
COLLAB_SUMS = ("m365_emails_sent", "zoom_calls", "meeting_hours", "m365_teams_messages", "m365_files_shared",
               "meeting_free", "slack_thread_participation", "slack_message_engagement")
QUALITY_SUMS = ("bugs_fixed", "prs_per_dev")
AI_SUMS = ("chatgpt", "cc_lines", "cc_sessions", "cursor_agents", "cursor_lines", "claude_web", "cursor_completions",
           "team_ai_loc", "codex_lines", "codex_sessions", "cc_offered", "cc_tool_accept", "cc_cost", "prs_total",
           "prs_with_cc", "cursor_offered", "cursor_total_lines")
AI_FLAGS = ("active_ai_members", "cursor_active", "cc_active", "codex_active", "chatgpt_active")
# Flags with a head-count scale in the company statistics.
AI_STATS_FLAGS = ("active_ai_members", "cursor_active", "cc_active", "codex_active")

# Bin width of the histogram per metric.
BIN_WIDTH = {
    4: ("task_dev_time", "meeting_hours", "teams_meeting_hours", "zoom_meeting_hours"),
    1: ("mean_time_to_resolution", "pickup_time"),
    10: ("estimation_accuracy", "task_reopen_rate", "due_date_compliance", "flow_efficiency", "merge_rate",
         "build_success", "cursor_acceptance", "cc_tool_accept", "ai_loc_share2", "slack_dm_ratio"),
}

# Section -> series -> metric keys of that section's rows.
TRENDS = {
    "task_delivery": {"tasks_completed": ("tasks_completed",)},
    "git_output": {"commits": ("commits",), "prs_merged": ("prs_merged",)},
    "code_quality": {"bugs_fixed": ("bugs_fixed",), "build_success": ("build_success",), "pr_cycle_time": ("pr_cycle_time",)},
    "ai_adoption": {"cursor_lines": ("cursor_lines",), "cc_lines": ("cc_lines",)},
    "collaboration": {
        "meeting_hours": ("meeting_hours",),
        "total_messages": ("slack_messages_sent", "m365_emails_sent", "m365_teams_chats"),
    },
}

IC_DRILL = T.StructType([T.StructField(n, T.StringType()) for n in (
    "person_id", "org_unit_id", "metric_date", "drill_id", "title", "source", "src_class", "value", "filter")] + [
    T.StructField(n, T.ArrayType(T.StringType())) for n in ("columns", "rows")])
IC_TIMEOFF = T.StructType([
    T.StructField("person_id", T.StringType()), T.StructField("org_unit_id", T.StringType()),
    T.StructField("metric_date", T.StringType()), T.StructField("days", T.LongType()),
    T.StructField("date_range", T.StringType()), T.StructField("bamboo_hr_url", T.StringType())])

# What G8 reads of Jira's issues.
JIRA_ISSUE = T.StructType([T.StructField(n, T.StringType()) for n in (
    "unique_key", "id_readable", "custom_fields_json", "updated", "due_date")] + [T.StructField("_extracted_at", T.TimestampType())])


def people_view(employees: DataFrame) -> DataFrame:
    """Newest HR row per work e-mail (G1)."""
    rows = employees.filter(filled(F.col("workEmail"))).withColumn("person_id", F.lower("workEmail"))
    return latest_values(rows, ["person_id"], ["_extracted_at", "unique_key"] if "unique_key" in rows.columns else ["_extracted_at"], {
        "display_name": "displayName", "org_unit_id": "department", "org_unit_name": "department",
        "seniority": seniority("jobTitle"), "job_title": "jobTitle", "status": "status",
        "supervisor_email": F.lower("supervisorEmail")})


def people_of_class(people: DataFrame) -> DataFrame:
    """The same view from `class_people`, for a site without BambooHR (G1). A leader is named there by the directory's id, so
    the address is looked up in the same directory. People on leave count as active, as BambooHR has them."""
    known = people.filter(filled(F.col("email")))
    place = ["tenant_id", "source_id", "source"]
    leaders = latest_values(known.filter(filled(F.col("source_person_id"))), [*place, "source_person_id"], ["ingested_at", "unique_key"], {
        "leader_email": F.lower("email")}).withColumnRenamed("source_person_id", "manager_person_id")
    rows = known.withColumn("person_id", F.lower("email")).join(leaders, [*place, "manager_person_id"], "left")
    return latest_values(rows, ["person_id"], ["ingested_at", "unique_key"], {
        "display_name": "display_name", "org_unit_id": "department_name", "org_unit_name": "department_name",
        "seniority": seniority("job_title"), "job_title": "job_title",
        "status": F.when(F.col("status") == "terminated", "Inactive").otherwise("Active"), "supervisor_email": "leader_email"})


def _num(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _bounded(value: Column) -> Column:
    return clamp(rounded(value, 1), 0.0, 100.0)


@dataclass
class Gold:
    """Gold views over the classes and the two landed tables they read.

    `tables` maps class names (and `bronze_bamboohr.employees`,
    `bronze_jira.jira_issue`) to DataFrames; a class that is missing counts as
    empty, and so do Jira's issues. Without BambooHR people come from
    `class_people`. Views are lazy, except those that many others read (people, issue
    state, status intervals, the stacked sections): they are stored when first
    read.
    """

    spark: SparkSession
    tables: Mapping[str, DataFrame]
    as_of: Column = field(default_factory=F.current_timestamp)
    materialize: bool = True

    def cls(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        return empty_table(self.spark, contract(name))

    def materialized(self, df: DataFrame) -> DataFrame:
        """A view that many others read is stored once per run (S9). Turn
        `materialize` off to get it as a plain plan."""
        return store(df) if self.materialize else df

    # --- people ---------------------------------------------------------------------
    @cached_property
    def people(self) -> DataFrame:  # G1
        if "people" in self.tables:
            return self.tables["people"]
        if "bronze_bamboohr.employees" in self.tables:
            return self.materialized(people_view(self.tables["bronze_bamboohr.employees"]))
        return self.materialized(people_of_class(self.cls("class_people")))

    # --- marts ------------------------------------------------------------------------
    @cached_property
    def fct_git_commit(self) -> DataFrame:
        return marts.git_commits(self.cls("class_git_commits"))

    @cached_property
    def fct_git_file_change(self) -> DataFrame:
        return marts.git_file_changes(self.cls("class_git_file_changes"), self.fct_git_commit)

    @cached_property
    def fct_git_pr(self) -> DataFrame:
        return marts.git_pull_requests(self.cls("class_git_pull_requests"))

    @cached_property
    def fct_git_review(self) -> DataFrame:
        return marts.git_reviews(self.cls("class_git_pull_requests_reviewers"))

    @cached_property
    def git_totals(self) -> DataFrame:
        return marts.git_person_totals(self.fct_git_pr, self.fct_git_commit, self.fct_git_file_change)

    @cached_property
    def git_weekly(self) -> DataFrame:
        return marts.git_person_weekly(self.fct_git_pr, self.fct_git_commit, self.fct_git_file_change)

    @cached_property
    def focus(self) -> DataFrame:  # G37
        if "class_focus_metrics" in self.tables:
            return self.tables["class_focus_metrics"]
        return marts.focus_metrics(self.cls("class_collab_meeting_activity"), self.cls("class_hr_working_hours"))

    # --- daily views --------------------------------------------------------------------
    @cached_property
    def commits_daily(self) -> DataFrame:  # G2
        active = self.people.filter("status = 'Active'").select("person_id")
        return self.git_weekly.filter("week is not null").withColumnRenamed("person_key", "person_id").join(
            active, "person_id", "left_semi").select("person_id", F.col("week").alias("metric_date"), "commits")

    def _of(self, cls: str, source: str) -> DataFrame:
        return self.cls(cls).filter(F.col("data_source") == source)

    @cached_property
    def zoom_person_daily(self) -> DataFrame:  # G3
        rows = self._of("class_collab_meeting_activity", "zoom").filter(filled(F.col("email")))
        return rows.select(F.lower("email").alias("person_id"), F.col("date").alias("metric_date"), F.lower("email").alias("user_email"),
                           F.coalesce("calls_count", F.lit(0)).alias("zoom_calls"),
                           (_num("audio_duration_seconds") / 3600.0).alias("meeting_hours"))

    @cached_property
    def teams_person_daily(self) -> DataFrame:  # G4
        chats = self._of("class_collab_chat_activity", "m365").select(
            F.lower("email").alias("person_id"), F.col("date").alias("metric_date"), "total_chat_messages")
        meetings = self._of("class_collab_meeting_activity", "m365").select(
            F.lower("email").alias("person_id"), F.col("date").alias("metric_date"), "meetings_attended", "calls_count")
        return chats.join(meetings, ["person_id", "metric_date"], "outer").select(
            "person_id", "metric_date", _num("total_chat_messages").alias("teams_messages"),
            _num("meetings_attended").alias("teams_meetings"), _num("calls_count").alias("teams_calls"))

    @cached_property
    def files_person_daily(self) -> DataFrame:  # G5
        rows = self._of("class_collab_document_activity", "m365").filter(filled(F.col("email")))
        return rows.groupBy(F.lower("email").alias("person_id"), F.col("date").alias("metric_date")).agg(
            F.sum(_num("shared_internally_count") + _num("shared_externally_count")).alias("files_shared"))

    @cached_property
    def email_daily(self) -> DataFrame:  # G6
        return self._of("class_collab_email_activity", "m365").select(
            F.lower("person_key").alias("person_id"), F.col("date").alias("metric_date"), F.lower("person_key").alias("user_email"),
            F.col("sent_count").cast("decimal(38,9)").alias("emails_sent"), F.col("data_source").alias("source"))

    @cached_property
    def comms_daily(self) -> DataFrame:  # G7
        m365, zoom = "m365", "zoom"
        part = lambda cls, source, person, **v: self._of(cls, source).select(
            F.lower(person).alias("person_id"), F.col("date").alias("metric_date"), *[c.alias(n) for n, c in v.items()])
        rows = union_all([
            part("class_collab_email_activity", m365, "person_key", emails_sent=_num("sent_count")),
            part("class_collab_meeting_activity", zoom, "email", zoom_calls=_num("calls_count"),
                 meeting_hours=_num("audio_duration_seconds") / 3600.0),
            part("class_collab_chat_activity", m365, "email", teams_messages=_num("total_chat_messages")),
            part("class_collab_meeting_activity", m365, "email", teams_meetings=_num("meetings_attended")),
            part("class_collab_document_activity", m365, "email",
                 files_shared=_num("shared_internally_count") + _num("shared_externally_count"))])
        names = ["emails_sent", "zoom_calls", "meeting_hours", "teams_messages", "teams_meetings", "files_shared"]
        return rows.filter(filled(F.col("person_id"))).groupBy("person_id", "metric_date").agg(
            *[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names])

    @cached_property
    def jira_person_daily(self) -> DataFrame:  # G8
        landed = self.tables.get("bronze_jira.jira_issue")
        rows = (empty_table(self.spark, JIRA_ISSUE) if landed is None else landed).filter("unique_key is not null")
        now = latest_values(rows, ["unique_key"], ["_extracted_at"], {
            "doc": "custom_fields_json", "updated": "updated", "due_date": "due_date", "id_readable": "id_readable"})
        person = F.lower(json_text("doc", "assignee", "emailAddress"))
        return now.filter(person != "").select(
            person.alias("person_id"), F.to_date(moment("updated")).alias("metric_date"),
            json_text("doc", "issuetype", "name").alias("issue_type"), json_text("doc", "status", "name").alias("status_name"),
            json_text("doc", "resolution", "name").alias("resolution"), "due_date",
            json_number("doc", "timeoriginalestimate").alias("time_estimate_sec"),
            json_number("doc", "timespent").alias("time_spent_sec"), "id_readable")

    # --- issues -------------------------------------------------------------------------
    @cached_property
    def task_issue_current_state(self) -> DataFrame:  # G9
        state = issues.issue_state(self.cls("class_task_field_history"))
        return self.materialized(issues.with_assignee(state, self.cls("class_task_users"), self.people))

    @cached_property
    def task_status_intervals(self) -> DataFrame:  # G10
        return self.materialized(issues.status_intervals(
            self.cls("class_task_field_history"), self.task_issue_current_state, self.as_of))

    @cached_property
    def task_dev_seconds_per_issue(self) -> DataFrame:  # G11
        return issues.dev_seconds(self.task_issue_current_state, self.task_status_intervals)

    @cached_property
    def task_close_events_daily(self) -> DataFrame:  # G12
        return issues.status_transitions(self.task_status_intervals, self.task_issue_current_state, True, "close_count")

    @cached_property
    def task_reopen_events_daily(self) -> DataFrame:  # G12
        return issues.status_transitions(self.task_status_intervals, self.task_issue_current_state, False, "reopen_count")

    @cached_property
    def task_worklog_seconds_per_day(self) -> DataFrame:  # G13
        return issues.worklog_per_day(self.cls("class_task_worklogs"), self.cls("class_task_users"))

    @cached_property
    def task_in_progress_seconds_per_day(self) -> DataFrame:  # G14
        return issues.in_progress_per_day(self.task_status_intervals, self.task_issue_current_state)

    @cached_property
    def jira_closed_tasks(self) -> DataFrame:  # G15
        if "class_task_daily" in self.tables:
            return self.tables["class_task_daily"]
        return issues.closed_tasks(self.task_issue_current_state)

    # --- metric rows -------------------------------------------------------------------------
    @cached_property
    def task_delivery_rows(self) -> DataFrame:  # G16
        return bullets.task_delivery_rows(
            self.jira_closed_tasks, self.task_dev_seconds_per_issue, self.task_close_events_daily, self.task_reopen_events_daily,
            self.task_worklog_seconds_per_day, self.task_in_progress_seconds_per_day,
            issues.stale_in_progress(self.task_issue_current_state, self.as_of), self.people, self.as_of)

    @cached_property
    def code_quality_rows(self) -> DataFrame:  # G17
        return bullets.code_quality_rows(self.jira_closed_tasks, self.people)

    @cached_property
    def git_rows(self) -> DataFrame:  # G18
        return bullets.git_rows(self.cls("class_git_commits"), self.cls("class_git_file_changes"),
                                self.cls("class_git_pull_requests"), self.people)

    @cached_property
    def collab_rows(self) -> DataFrame:  # G19
        return bullets.collab_rows(self.cls("class_collab_email_activity"), self.cls("class_collab_meeting_activity"),
                                   self.cls("class_collab_chat_activity"), self.cls("class_collab_document_activity"), self.people)

    @cached_property
    def ai_rows(self) -> DataFrame:  # G20
        return bullets.ai_rows(self.cls("class_ai_dev_usage"), self.cls("class_ai_assistant_usage"), self.people)

    @cached_property
    def crm_rows(self) -> DataFrame:  # G21
        return bullets.crm_rows(self.cls("class_crm_deals"), self.cls("class_crm_activities"), self.cls("class_crm_users"), self.cls("class_people"))

    # --- CRM ------------------------------------------------------------------------------------
    @cached_property
    def crm_kpis(self) -> DataFrame:  # G22
        deals = bullets.owned_deals(self.cls("class_crm_deals"), self.cls("class_crm_users"))
        won = F.col("is_won") == 1
        entry = lambda when, day, opened, closed, won, value: F.when(when & day.isNotNull(), F.struct(
            day.alias("metric_date"), opened.cast("bigint").alias("opened"), closed.cast("bigint").alias("closed"),
            won.cast("bigint").alias("won"), value.cast("double").alias("value")))
        none = F.lit(0)
        facts = deals.select("person_id", F.inline(F.filter(F.array(
            entry(F.lit(True), F.to_date("created_at"), F.lit(1), none, none, none),
            entry(F.col("is_closed") == 1, F.col("close_date"), none, F.lit(1), won.cast("int"),
                  F.when(won, _num("amount_home")).otherwise(0.0))), lambda e: e.isNotNull())))
        comms = bullets.owned_activities(self.cls("class_crm_activities"), self.cls("class_crm_users")).select(
            "person_id", F.to_date("timestamp").alias("metric_date"), F.lit(1).cast("bigint").alias("comms"))
        rows = union_all([facts, comms])
        zero = lambda c, t: F.coalesce(F.sum(c), F.lit(0).cast(t))
        daily = rows.groupBy("metric_date", "person_id").agg(
            zero("opened", "bigint").alias("deals_opened"), zero("closed", "bigint").alias("deals_closed"), zero("won", "bigint").alias("deals_won"),
            zero("value", "double").alias("deals_value_closed"), zero("comms", "bigint").alias("comms_count"))
        unit = F.coalesce("org_unit_id", F.lit("Unknown"))
        return daily.join(bullets.crm_units(self.cls("class_people")), "person_id", "left").withColumn("org_unit_id", unit).withColumn(
            "org_unit_name", F.col("org_unit_id"))

    @cached_property
    def crm_pipeline_now(self) -> DataFrame:  # G23
        deals = bullets.owned_deals(self.cls("class_crm_deals"), self.cls("class_crm_users"))
        is_open = F.col("is_closed") == 0
        per_rep = deals.groupBy("person_id").agg(
            F.count_if(is_open).alias("pipeline_count"),
            rounded(F.sum(F.when(is_open, _num("amount_home")).otherwise(0.0)), 0).alias("pipeline_value"))
        return per_rep.join(bullets.crm_units(self.cls("class_people")), "person_id", "left").withColumn(
            "org_unit_id", F.coalesce("org_unit_id", F.lit("Unknown")))

    @cached_property
    def crm_chart_flow(self) -> DataFrame:  # G24
        rows = self.crm_kpis.groupBy("person_id", "org_unit_id", week("metric_date").alias("week_start")).agg(
            F.sum("deals_opened").alias("opened"), F.sum("deals_closed").alias("closed"), F.sum("deals_won").alias("won"))
        return rows.filter("opened > 0 or closed > 0").select(
            "person_id", "org_unit_id", F.date_format("week_start", "MMM dd").alias("date_bucket"),
            F.col("week_start").alias("metric_date"), "opened", "closed", "won")

    # --- person and company values ---------------------------------------------------------------
    @cached_property
    def collab_person_period(self) -> DataFrame:  # G25
        return person_period(self.collab_rows, {"sum": COLLAB_SUMS})

    @cached_property
    def code_quality_person_period(self) -> DataFrame:  # G25
        return person_period(self.code_quality_rows, {"sum": QUALITY_SUMS})

    @cached_property
    def ai_person_period(self) -> DataFrame:  # G26
        return person_period(self.ai_rows, {"sum": AI_SUMS, "max": AI_FLAGS})

    @cached_property
    def collab_company_stats(self) -> DataFrame:  # G27
        return company_stats(self.collab_person_period)

    @cached_property
    def code_quality_company_stats(self) -> DataFrame:  # G27
        return company_stats(self.code_quality_person_period)

    @cached_property
    def ai_company_stats(self) -> DataFrame:  # G27
        return company_stats(self.ai_person_period, AI_STATS_FLAGS)

    # --- cards and charts ---------------------------------------------------------------------------
    @cached_property
    def _active(self) -> DataFrame:
        return self.people.filter("status = 'Active'")

    @cached_property
    def _ai_share(self) -> DataFrame:
        share = rounded(ratio(_num("lines_added"), F.when(_num("total_lines_added") > 0, _num("total_lines_added")), 100.0), 1)
        return self.cls("class_ai_dev_usage").filter(filled(F.col("email"))).select(
            F.lower("email").alias("person_id"), F.col("day").alias("metric_date"), share.alias("ai_share"),
            (_num("agent_sessions") + _num("chat_requests")).alias("ai_sessions"), F.lit(True).alias("has_ai"))

    @cached_property
    def exec_summary(self) -> DataFrame:  # G28
        active = self._active.select("person_id", "org_unit_id", "org_unit_name")
        unit_day = ["org_unit_id", "metric_date"]
        base = self.focus.select(F.col("email").alias("person_id"), F.col("day").alias("metric_date"), "focus_time_pct").join(
            active, "person_id").groupBy(*unit_day).agg(F.max("org_unit_name").alias("org_unit_name"), F.avg("focus_time_pct").alias("focus"))
        heads = active.groupBy("org_unit_id").agg(F.count(F.lit(1)).alias("headcount"))
        closed = self.jira_closed_tasks.join(active, "person_id").groupBy(*unit_day).agg(
            F.sum("tasks_closed").alias("tasks"), F.sum("bugs_fixed").alias("bugs"))
        usage = self.cls("class_ai_dev_usage").select(
            F.lower("email").alias("person_id"), F.col("day").alias("metric_date"),
            ratio(_num("lines_added"), F.when(_num("total_lines_added") > 0, _num("total_lines_added")), 100.0).alias("share"))
        # Users are counted per unit and day in two steps.
        per_user = usage.join(active, "person_id").groupBy(*unit_day, "person_id").agg(
            F.sum("share").alias("share"), F.count("share").alias("shares"))
        ai = per_user.groupBy(*unit_day).agg(
            F.count(F.lit(1)).alias("users"), ratio(F.sum("share"), F.sum("shares")).alias("share"))
        none = F.lit(None).cast("double")
        return base.join(heads, "org_unit_id").join(closed, unit_day, "left").join(ai, unit_day, "left").select(
            "org_unit_id", "org_unit_name", "headcount", F.coalesce("tasks", F.lit(0)).alias("tasks_closed"),
            F.coalesce("bugs", F.lit(0)).alias("bugs_fixed"), none.alias("build_success_pct"), _bounded(F.col("focus")).alias("focus_time_pct"),
            rounded(F.col("users") * 100.0 / F.greatest("headcount", F.lit(1)), 1).alias("ai_adoption_pct"),
            rounded("share", 1).alias("ai_loc_share_pct"), none.alias("pr_cycle_time_h"), "metric_date")

    @cached_property
    def _closed_by_day(self) -> DataFrame:
        return self.jira_closed_tasks.groupBy("person_id", "metric_date").agg(
            F.sum("tasks_closed").alias("tasks"), F.sum("bugs_fixed").alias("bugs"))

    @cached_property
    def team_member(self) -> DataFrame:  # G29
        person_day = ["person_id", "metric_date"]
        focus = self.focus.select(F.col("email").alias("person_id"), F.col("day").alias("metric_date"), "focus_time_pct", "dev_time_h")
        rows = self._active.join(focus, "person_id").join(self._closed_by_day, person_day, "left").join(self._ai_share, person_day, "left")
        tools = F.when(F.col("has_ai"), F.array(F.lit("Cursor"))).otherwise(F.array().cast("array<string>"))
        none = F.lit(None).cast("double")
        return rows.select(
            "person_id", "display_name", "seniority", "org_unit_id", _num("tasks").alias("tasks_closed"), _num("bugs").alias("bugs_fixed"),
            clamp(rounded("dev_time_h", 1), low=0.0).alias("dev_time_h"), none.alias("prs_merged"), none.alias("build_success_pct"),
            _bounded(F.col("focus_time_pct")).alias("focus_time_pct"), tools.alias("ai_tools"),
            rounded("ai_share", 1).alias("ai_loc_share_pct"), "metric_date")

    @cached_property
    def ic_kpis(self) -> DataFrame:  # G30
        person_day = ["person_id", "metric_date"]
        base = self.focus.select(F.col("email").alias("person_id"), F.col("day").alias("metric_date"), "focus_time_pct")
        units = self.people.select("person_id", "org_unit_id")
        git = self.git_totals.select(F.col("person_key").alias("person_id"), "loc", "prs_merged", "avg_pr_cycle_time_h")
        rows = base.join(units, "person_id", "left").join(git, "person_id", "left").join(
            self._closed_by_day, person_day, "left").join(self._ai_share, person_day, "left")
        return rows.select(
            "person_id", "org_unit_id", "metric_date", _num("loc").alias("loc"), rounded(_num("ai_share"), 1).alias("ai_loc_share_pct"),
            _num("prs_merged").alias("prs_merged"), rounded("avg_pr_cycle_time_h", 1).alias("pr_cycle_time_h"),
            _bounded(F.coalesce("focus_time_pct", F.lit(100.0))).alias("focus_time_pct"), _num("tasks").alias("tasks_closed"),
            _num("bugs").alias("bugs_fixed"), F.lit(None).cast("double").alias("build_success_pct"), _num("ai_sessions").alias("ai_sessions"))

    @cached_property
    def ic_chart_loc(self) -> DataFrame:  # G31
        usage = self.cls("class_ai_dev_usage").groupBy(F.lower("email").alias("person_id"), week("day").alias("metric_date")).agg(
            F.sum(_num("lines_added")).alias("ai_loc"), (F.sum(_num("total_lines_added")) - F.sum(_num("lines_added"))).alias("code_loc"))
        spec = self.git_weekly.groupBy(F.col("person_key").alias("person_id"), F.col("week").alias("metric_date")).agg(
            F.sum("spec_lines").alias("spec"))
        return usage.join(spec, ["person_id", "metric_date"], "left").join(
            self.people.select("person_id", "org_unit_id"), "person_id", "left").select(
            "person_id", "org_unit_id", F.col("metric_date").alias("date_bucket"), "metric_date", "ai_loc", "code_loc", _num("spec").alias("spec_lines"))

    @cached_property
    def ic_chart_delivery(self) -> DataFrame:  # G32
        weekly = self.git_weekly.filter(filled(F.col("person_key")) & F.col("week").isNotNull()).select(
            F.col("person_key").alias("person_id"), F.col("week").alias("metric_date"), "commits", "prs_merged")
        done = self.jira_closed_tasks.select("person_id", week("metric_date").alias("metric_date"), F.col("tasks_closed").alias("tasks_done"))
        rows = union_all([weekly, done]).groupBy("person_id", "metric_date").agg(
            *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("commits", "prs_merged", "tasks_done")])
        return rows.join(self.people.select("person_id", "org_unit_id"), "person_id", "left").withColumn("date_bucket", F.col("metric_date"))

    # --- distributions ----------------------------------------------------------------------------------
    @cached_property
    def _sections(self) -> DataFrame:
        named = {"task_delivery": self.task_delivery_rows, "code_quality": self.code_quality_rows, "ai_adoption": self.ai_rows,
                 "collaboration": self.collab_rows, "git_output": self.git_rows}
        return self.materialized(union_all(df.withColumn("section_id", F.lit(n)) for n, df in named.items()))

    @cached_property
    def ic_histogram(self) -> DataFrame:  # G33
        return histogram(self._sections)

    @cached_property
    def peer_cohort_stats(self) -> DataFrame:  # G34
        return peer_cohorts(self._sections, self.people)

    @cached_property
    def ic_section_trend(self) -> DataFrame:  # G35
        return section_trend(self._sections)

    @cached_property
    def ic_kpi_peer_median(self) -> DataFrame:  # G36
        return kpi_rows(self.ic_kpis, self.people)

    @cached_property
    def ic_drill(self) -> DataFrame:  # G40
        return empty_table(self.spark, IC_DRILL)

    @cached_property
    def ic_timeoff(self) -> DataFrame:  # G40
        return empty_table(self.spark, IC_TIMEOFF)


def histogram(rows: DataFrame) -> DataFrame:
    """Fixed-width bins per person, day and metric."""
    step = F.coalesce(*[F.when(F.col("metric_key").isin(*keys), F.lit(width)) for width, keys in BIN_WIDTH.items()])
    low = F.floor(F.col("metric_value") / F.col("step")) * F.col("step")
    known = rows.filter("metric_value is not null").withColumn("step", step).filter("step is not null")
    return known.groupBy(
        "person_id", F.coalesce("org_unit_id", F.lit("")).alias("org_unit_id"), "metric_date", "metric_key",
        low.cast("bigint").alias("bin"), (low + F.col("step")).cast("bigint").alias("bin_end")).agg(F.count(F.lit(1)).alias("count"))


def peer_cohorts(rows: DataFrame, people: DataFrame) -> DataFrame:
    """Quartiles per supervisor and per org unit, in one pass over the rows."""
    peers = people.select("person_id", "org_unit_id", "supervisor_email")
    known = rows.filter("metric_value is not null").drop("org_unit_id")
    cohort = lambda kind, seed: F.when(filled(seed), F.struct(F.lit(kind).alias("kind"), seed.alias("cohort_seed")))
    cohorts = F.filter(F.array(cohort("ic", F.col("supervisor_email")), cohort("team", F.col("org_unit_id"))), lambda c: c.isNotNull())
    keys = ["cohort_seed", "kind", "metric_key", "metric_date"]
    # Equal values are counted before they are repeated for each cohort, and stored, as bands and cells read them.
    places = known.join(peers, "person_id").groupBy("supervisor_email", "org_unit_id", "metric_date", "metric_key", "metric_value").agg(F.count(F.lit(1)).alias("times"))
    long = places.select("metric_date", "metric_key", "metric_value", "times", F.inline(cohorts)).groupBy(*keys, "metric_value").agg(F.sum("times").alias("times"))
    quartiles = exact_quantiles(store(long), keys, "metric_value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, "times")
    # One row per person and metric first: distinct people are then a plain count. A person listed twice is in a cohort once.
    days = known.groupBy("person_id", "metric_date", "metric_key").agg(F.min("metric_value").alias("lo"), F.max("metric_value").alias("hi"))
    members = peers.select("person_id", F.inline(cohorts)).distinct()
    spread = days.join(members, "person_id").groupBy(*keys).agg(F.min("lo").alias("min"), F.max("hi").alias("max"), F.count(F.lit(1)).alias("n"))
    return quartiles.join(spread, keys)


def section_trend(rows: DataFrame) -> DataFrame:
    """Daily series of each section; one scan instead of one per series."""
    name = F.coalesce(*[
        F.when((F.col("section_id") == s) & F.col("metric_key").isin(*keys), F.lit(series))
        for s, all_series in TRENDS.items() for series, keys in all_series.items()])
    return rows.withColumn("series_key", name).filter("series_key is not null").groupBy(
        "person_id", F.coalesce("org_unit_id", F.lit("")).alias("org_unit_id"), "metric_date", "section_id", "series_key").agg(
        F.sum("metric_value").alias("value"))


def kpi_rows(kpis: DataFrame, people: DataFrame) -> DataFrame:
    led = people.filter(filled(F.col("supervisor_email"))).select("person_id", "supervisor_email")
    return unpivot(kpis.join(led, "person_id"), ["person_id", "supervisor_email", "metric_date"], {
        "bugs_fixed": "bugs_fixed", "tasks_closed": "tasks_closed", "prs_merged": _num("prs_merged"), "ai_loc_share": "ai_loc_share_pct",
        "focus_time_pct": "focus_time_pct", "pr_cycle_time_h": _num("pr_cycle_time_h"), "ai_sessions": "ai_sessions"}, "kpi_key", "value")
