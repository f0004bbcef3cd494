"""Cases: gold views and metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from proving.case import case
from proving.given import PERIOD, Given
from workmart.operators import reshape, rollup, thresholds
from workmart.plans import gold as gold_views
from workmart.plans import metrics
from workmart.plans.gold import Gold

_ROW = "person_id:s org_unit_id:s metric_date:d metric_key:s metric_value:f"
_IN = f"metric_date between date '{PERIOD[0]}' and date '{PERIOD[1]}'"

# --- gold views -----------------------------------------------------------------------

case("G1_people", "person_id:s display_name:s org_unit_id:s org_unit_name:s seniority:s job_title:s status:s supervisor_email:s", "select * from people")(
    lambda g: g.people)
case("G2_commits_daily", "person_id:s metric_date:d commits:i",
     "select w.person_key person_id, week metric_date, commits from git_weekly w join people p on p.person_id = w.person_key where status = 'Active'")(
    lambda g: g.gold.commits_daily)
case("G3_zoom_person_daily", "person_id:s metric_date:d user_email:s zoom_calls:i meeting_hours:f",
     "select person_key person_id, date metric_date, person_key user_email, calls_count zoom_calls, audio_duration_seconds / 3600.0 meeting_hours from meetings where data_source = 'zoom'")(
    lambda g: g.gold.zoom_person_daily)
case("G4_teams_person_daily", "person_id:s metric_date:d teams_messages:f teams_meetings:f teams_calls:f",
     """select coalesce(c.person_key, m.person_key) person_id, coalesce(c.date, m.date) metric_date, coalesce(total_chat_messages, 0) teams_messages, coalesce(meetings_attended, 0) teams_meetings,
        coalesce(calls_count, 0) teams_calls from (select * from chats where data_source = 'm365') c full join (select * from meetings where data_source = 'm365') m
        on c.person_key = m.person_key and c.date = m.date""")(lambda g: g.gold.teams_person_daily)
case("G5_files_person_daily", "person_id:s metric_date:d files_shared:f",
     "select person_key person_id, date metric_date, sum(shared_internally_count + shared_externally_count) files_shared from files group by all")(lambda g: g.gold.files_person_daily)
case("G6_email_daily", "person_id:s metric_date:d user_email:s emails_sent:f source:s",
     "select person_key person_id, date metric_date, person_key user_email, sent_count emails_sent, 'm365' source from emails")(lambda g: g.gold.email_daily)
case("G7_comms_daily", "person_id:s metric_date:d emails_sent:f zoom_calls:f meeting_hours:f teams_messages:f teams_meetings:f files_shared:f",
     """select person_id, metric_date, sum(a) emails_sent, sum(b) zoom_calls, sum(c) meeting_hours, sum(d) teams_messages, sum(e) teams_meetings, sum(f) files_shared from (
        select person_key person_id, date metric_date, sent_count a, 0 b, 0.0::double c, 0 d, 0 e, 0 f from emails
        union all select person_key, date, 0, calls_count, audio_duration_seconds / 3600.0, 0, 0, 0 from meetings where data_source = 'zoom'
        union all select person_key, date, 0, 0, 0, total_chat_messages, 0, 0 from chats where data_source = 'm365'
        union all select person_key, date, 0, 0, 0, 0, meetings_attended, 0 from meetings where data_source = 'm365'
        union all select person_key, date, 0, 0, 0, 0, 0, shared_internally_count + shared_externally_count from files) group by all""")(lambda g: g.gold.comms_daily)


@case("G8_jira_person_daily", "person_id:s metric_date:d issue_type:s status_name:s resolution:s due_date:s time_estimate_sec:f time_spent_sec:f id_readable:s",
      """select lower(c_name) person_id, o_orderdate metric_date, o_orderpriority issue_type, o_orderstatus status_name, '' resolution, null due_date, o_orderkey time_estimate_sec, 0 time_spent_sec,
         'T-' || o_custkey id_readable from (select * from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1) o join customer on c_custkey = o_custkey""")
def g8(g: Given):
    rows = g.orders.join(g.customer, F.col("c_custkey") == F.col("o_custkey")).selectExpr(
        "cast(o_custkey as string) as unique_key", "concat('T-', o_custkey) as id_readable", "cast(o_orderdate as string) as updated", "cast(null as string) as due_date",
        """to_json(named_struct('assignee', named_struct('emailAddress', c_name), 'issuetype', named_struct('name', o_orderpriority), 'status', named_struct('name', o_orderstatus),
           'timeoriginalestimate', o_orderkey)) as custom_fields_json""", "o_orderdate", "o_orderkey")
    rows = rows.withColumn("_extracted_at", F.expr("timestamp_micros(unix_micros(o_orderdate) + o_orderkey)"))
    return Gold(g.spark, {"bronze_jira.jira_issue": rows}, g.as_of).jira_person_daily


case("G9_task_issue_current_state", "issue_id:s status_name:s assignee_account_id:s assignee_email:s org_unit_id:s",
     "select issue_id, status_name, assignee assignee_account_id, assignee_email, org_unit_id from owned_state")(lambda g: g.gold.task_issue_current_state)
case("G10_task_status_intervals", "issue_id:s status_name:s periods:i", "select issue_id, status_name, count(*) periods from intervals group by all")(
    lambda g: g.gold.task_status_intervals.groupBy("issue_id", "status_name").agg(F.count(F.lit(1)).alias("periods")))
case("G11_task_dev_seconds", "assignee_email:s n:i dev_seconds:f", "select assignee_email, count(*) n, sum(dev_seconds) dev_seconds from dev group by 1")(
    lambda g: g.gold.task_dev_seconds_per_issue.groupBy("assignee_email").agg(F.count(F.lit(1)).alias("n"), F.sum("dev_seconds").alias("dev_seconds")))
case("G12_close_events_daily", "assignee_email:s event_date:d close_count:i", "select assignee_email, event_date, n close_count from closes")(
    lambda g: g.gold.task_close_events_daily)
case("G12_reopen_events_daily", "assignee_email:s event_date:d reopen_count:i", "select assignee_email, event_date, n reopen_count from reopens")(
    lambda g: g.gold.task_reopen_events_daily)
case("G13_worklog_seconds", "author_email:s work_date:d worklog_seconds:f", "select person_id author_email, day work_date, seconds worklog_seconds from logged")(
    lambda g: g.gold.task_worklog_seconds_per_day)
case("G14_in_progress_seconds", "assignee_email:s day:d in_progress_seconds:f", "select person_id assignee_email, day, seconds in_progress_seconds from measured")(
    lambda g: g.gold.task_in_progress_seconds_per_day)
case("G15_jira_closed_tasks", "person_id:s metric_date:d tasks_closed:i bugs_fixed:i on_time_count:i has_due_date_count:i avg_time_spent:f avg_time_estimate:f",
     "select person_id, metric_date, tasks_closed, bugs_fixed, on_time on_time_count, with_due has_due_date_count, avg_spent avg_time_spent, avg_estimate avg_time_estimate from closed")(
    lambda g: g.gold.jira_closed_tasks)
for _name, _view, _sql in (("G16_task_delivery_rows", "task_delivery_rows", "task_rows"), ("G17_code_quality_rows", "code_quality_rows", "quality_rows"),
                           ("G18_git_rows", "git_rows", "git_rows"), ("G19_collab_rows", "collab_rows", "collab_rows"), ("G20_ai_rows", "ai_rows", "ai_rows"),
                           ("G21_crm_rows", "crm_rows", "crm_rows")):
    case(_name, _ROW, f"select person_id, org_unit_id, metric_date, metric_key, metric_value from {_sql}")(lambda g, v=_view: getattr(g.gold, v))

_KPIS = """select metric_date, person_id, sum(o) deals_opened, sum(c) deals_closed, sum(w) deals_won, sum(v) deals_value_closed, sum(n) comms_count from (
      select opened metric_date, person_id, 1 o, 0 c, 0 w, 0.0::double v, 0 n from deals
      union all select close_date, person_id, 0, 1, won::int, case when won then coalesce(amount_home, 0) else 0 end, 0 from deals where done
      union all select metric_date, person_id, 0, 0, 0, 0, 1 from contacts) group by all"""
case("G22_crm_kpis", "metric_date:d person_id:s org_unit_id:s org_unit_name:s deals_opened:i deals_closed:i deals_won:i deals_value_closed:f comms_count:i",
     f"select k.*, coalesce(org_unit_id, 'Unknown') org_unit_id, coalesce(org_unit_id, 'Unknown') org_unit_name from ({_KPIS}) k left join crm_units using (person_id)")(
    lambda g: g.gold.crm_kpis)
case("G23_crm_open_deals", "person_id:s org_unit_id:s pipeline_count:i pipeline_value:f",
     """select person_id, coalesce(org_unit_id, 'Unknown') org_unit_id, n pipeline_count, v pipeline_value from (select person_id, count(*) filter (not done) n,
        round(coalesce(sum(coalesce(amount_home, 0)) filter (not done), 0), 0) v from deals group by 1) left join crm_units using (person_id)""")(lambda g: g.gold.crm_pipeline_now)
_FLOW = f"""select person_id, coalesce(org_unit_id, 'Unknown') org_unit_id, strftime(w, '%b %d') date_bucket, w::date metric_date, opened, closed, won from (
    select person_id, date_trunc('week', metric_date) w, sum(deals_opened) opened, sum(deals_closed) closed, sum(deals_won) won from ({_KPIS}) group by all) left join crm_units using (person_id)
    where opened > 0 or closed > 0"""
case("G24_crm_chart_flow", "person_id:s org_unit_id:s date_bucket:s metric_date:d opened:i closed:i won:i", _FLOW)(lambda g: g.gold.crm_chart_flow)


def _list(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_PERIOD = {
    "collab": f"select metric_key, person_id, max(org_unit_id) org_unit_id, max(metric_date) metric_date, case when metric_key in {_list(gold_views.COLLAB_SUMS)} then sum(metric_value) else avg(metric_value) end v from collab_rows group by 1, 2",
    "code_quality": f"select metric_key, person_id, max(org_unit_id) org_unit_id, max(metric_date) metric_date, sum(metric_value) v from quality_rows group by 1, 2",
    "ai": f"select metric_key, person_id, max(org_unit_id) org_unit_id, max(metric_date) metric_date, case when metric_key in {_list(gold_views.AI_SUMS)} then sum(metric_value) when metric_key in {_list(gold_views.AI_FLAGS)} then max(metric_value) else avg(metric_value) end v from ai_rows group by 1, 2",
}
for _n, _g in (("collab", "G25"), ("code_quality", "G25"), ("ai", "G26")):
    case(f"{_g}_{_n}_person_period", "metric_key:s person_id:s org_unit_id:s metric_date:d v:f", _PERIOD[_n])(lambda g, v=f"{_n}_person_period": getattr(g.gold, v))
    _flags = _list(gold_views.AI_STATS_FLAGS) if _n == "ai" else "('')"
    case(f"G27_{_n}_company_stats", "metric_key:s company_value:f company_median:f company_p5:f company_p95:f",
         f"""select metric_key, case when metric_key in {_flags} then sum(v) else avg(v) end company_value, case when metric_key in {_flags} then 0 else quantile_disc(v, 0.5) end company_median,
             case when metric_key in {_flags} then 0 else min(v) end company_p5, case when metric_key in {_flags} then count(*) else max(v) end company_p95 from ({_PERIOD[_n]}) group by 1""")(
        lambda g, v=f"{_n}_company_stats": getattr(g.gold, v))

_EXEC = """select base.org_unit_id, org_unit_name, headcount, coalesce(j.tasks, 0) tasks_closed, coalesce(j.bugs, 0) bugs_fixed, null build_success_pct, greatest(0, least(100, round(f, 1))) focus_time_pct,
      round(users * 100.0 / greatest(headcount, 1), 1) ai_adoption_pct, round(share, 1) ai_loc_share_pct, null pr_cycle_time_h, base.metric_date
    from (select org_unit_id, max(org_unit_name) org_unit_name, day metric_date, avg(focus_time_pct) f from focus join people on person_id = email and status = 'Active' group by org_unit_id, day) base
    join (select org_unit_id, count(*) headcount from people where status = 'Active' group by 1) h using (org_unit_id)
    left join (select org_unit_id, metric_date, sum(tasks_closed) tasks, sum(bugs_fixed) bugs from closed join people using (person_id) where status = 'Active' group by all) j
      on j.org_unit_id = base.org_unit_id and j.metric_date = base.metric_date
    left join (select org_unit_id, day, count(distinct person_key) users, avg(case when total_lines_added > 0 then 100.0 * lines_added / total_lines_added end) share
      from ai_dev join people on person_id = person_key where status = 'Active' group by all) a on a.org_unit_id = base.org_unit_id and a.day = base.metric_date"""
_EXEC_SPEC = "org_unit_id:s org_unit_name:s headcount:i tasks_closed:i bugs_fixed:i build_success_pct:f focus_time_pct:f ai_adoption_pct:f ai_loc_share_pct:f pr_cycle_time_h:f"
case("G28_exec_summary", _EXEC_SPEC + " metric_date:d", _EXEC)(lambda g: g.gold.exec_summary)
_MEMBER = """select p.person_id, display_name, seniority, org_unit_id, coalesce(tasks_closed, 0)::double tasks_closed, coalesce(bugs_fixed, 0)::double bugs_fixed, greatest(0, round(dev_time_h, 1)) dev_time_h,
      null::double prs_merged, null::double build_success_pct, greatest(0, least(100, round(focus_time_pct, 1))) focus_time_pct, case when has_ai then ['Cursor'] else [] end ai_tools,
      round(share, 1) ai_loc_share_pct, f.day metric_date
    from people p join focus f on f.email = p.person_id left join closed c on c.person_id = p.person_id and c.metric_date = f.day
    left join ai_share a on a.person_id = p.person_id and a.metric_date = f.day where status = 'Active'"""
case("G29_team_member", "person_id:s display_name:s seniority:s org_unit_id:s tasks_closed:f bugs_fixed:f dev_time_h:f prs_merged:f build_success_pct:f focus_time_pct:f ai_tools:a ai_loc_share_pct:f metric_date:d",
     _MEMBER)(lambda g: g.gold.team_member)
_KPI_SPEC = "loc:f ai_loc_share_pct:f prs_merged:f pr_cycle_time_h:f focus_time_pct:f tasks_closed:f bugs_fixed:f ai_sessions:f"
case("G30_ic_kpis", "person_id:s org_unit_id:s metric_date:d " + _KPI_SPEC, "select * from ic_kpis")(lambda g: g.gold.ic_kpis)
_LOC = """select u.person_id, org_unit_id, w date_bucket, w metric_date, ai_loc, u.code_loc, coalesce(spec_lines, 0) spec_lines from (
    select person_key person_id, date_trunc('week', day)::date w, sum(lines_added) ai_loc, sum(total_lines_added) - sum(lines_added) code_loc from ai_dev group by all) u
    left join git_weekly g on g.person_key = u.person_id and g.week = u.w left join people p on p.person_id = u.person_id"""
case("G31_ic_chart_loc", "person_id:s org_unit_id:s date_bucket:d metric_date:d ai_loc:f code_loc:f spec_lines:f", _LOC)(lambda g: g.gold.ic_chart_loc)
_DELIVERY = """select d.*, org_unit_id, metric_date date_bucket from (select person_id, metric_date, sum(commits) commits, sum(prs_merged) prs_merged, sum(tasks) tasks_done from (
    select person_key person_id, week metric_date, commits, prs_merged, 0 tasks from git_weekly union all select person_id, date_trunc('week', metric_date)::date, 0, 0, tasks_closed from closed) group by all) d
    left join people using (person_id)"""
case("G32_ic_chart_delivery", "person_id:s org_unit_id:s date_bucket:d metric_date:d commits:i prs_merged:i tasks_done:i", _DELIVERY)(lambda g: g.gold.ic_chart_delivery)

_STEP = "case " + " ".join(f"when metric_key in {_list(k)} then {w}" for w, k in gold_views.BIN_WIDTH.items()) + " end"
_HISTOGRAM = f"""select person_id, coalesce(org_unit_id, '') org_unit_id, metric_date, metric_key, (floor(metric_value / step) * step)::bigint bin, (floor(metric_value / step) * step + step)::bigint bin_end,
    count(*) as count from (select *, {_STEP} step from all_rows where metric_value is not null) where step is not null group by all"""
case("G33_ic_histogram", "person_id:s org_unit_id:s metric_date:d metric_key:s bin:i bin_end:i count:i", _HISTOGRAM)(lambda g: g.gold.ic_histogram)
_COHORTS = """select cohort_seed, kind, metric_key, metric_date, quantile_disc(metric_value, 0.25) p25, quantile_disc(metric_value, 0.5) p50, quantile_disc(metric_value, 0.75) p75,
      min(metric_value) as min, max(metric_value) as max, count(distinct person_id) n
    from (select person_id, metric_date, metric_key, metric_value, unnest(['ic','team']) kind, unnest([p.supervisor_email, p.org_unit_id]) cohort_seed
      from (select person_id, metric_date, metric_key, metric_value from all_rows where metric_value is not null) join people p using (person_id)) group by all"""
case("G34_peer_cohort_stats", "cohort_seed:s kind:s metric_key:s metric_date:d p25:f p50:f p75:f min:f max:f n:i", _COHORTS)(lambda g: g.gold.peer_cohort_stats)
_SERIES = "case " + " ".join(f"when section = '{s}' and metric_key in {_list(keys)} then '{series}'" for s, many in gold_views.TRENDS.items() for series, keys in many.items()) + " end"
_TREND = f"""select person_id, coalesce(org_unit_id, '') org_unit_id, metric_date, section section_id, series series_key, sum(metric_value) as value
    from (select *, {_SERIES} series from all_rows) where series is not null group by all"""
case("G35_ic_section_trend", "person_id:s org_unit_id:s metric_date:d section_id:s series_key:s value:f", _TREND)(lambda g: g.gold.ic_section_trend)
_PEERS = """select k.person_id, p.supervisor_email, k.metric_date, unnest(['bugs_fixed','tasks_closed','prs_merged','ai_loc_share','focus_time_pct','pr_cycle_time_h','ai_sessions']) kpi_key,
    unnest([k.bugs_fixed, k.tasks_closed, k.prs_merged, k.ai_loc_share_pct, k.focus_time_pct, coalesce(k.pr_cycle_time_h, 0), k.ai_sessions]) as value from ic_kpis k join people p using (person_id)"""
case("G36_ic_kpi_peer_median", "person_id:s supervisor_email:s metric_date:d kpi_key:s value:f", _PEERS)(lambda g: g.gold.ic_kpi_peer_median)
case("G37_focus_metrics", "email:s day:d meetings_count:i meeting_hours:f working_hours_per_day:f focus_time_pct:f dev_time_h:f",
     "select email, day, meetings_count, meeting_hours, plan working_hours_per_day, focus_time_pct, dev_time_h from focus")(lambda g: g.gold.focus)
case("G38_git_facts", "commit_hash:s person_key:s week:d file_category:s n:i",
     "select commit_hash, c.person_key, c.week, file_category, count(*) n from file_changes f join commits c using (commit_hash) group by all")(
    lambda g: g.gold.fct_git_file_change.groupBy("commit_hash", "person_key", "week", "file_category").agg(F.count(F.lit(1)).alias("n")))
case("G38_git_pull_requests", "pr_id:i person_key:s state_norm:s cycle_time_h:f",
     "select pr_id, person_key, state_norm, case when state_norm = 'merged' and closed_on >= created_on then date_diff('second', created_on, closed_on) / 3600.0 end cycle_time_h from prs")(
    lambda g: g.gold.fct_git_pr)
case("G39_git_person_totals", "person_key:s prs_created:i prs_merged:i avg_pr_cycle_time_h:f commits:i loc:i clean_loc:i",
     "select person_key, prs_created, prs_merged, avg_h avg_pr_cycle_time_h, commits, loc, clean_loc from git_totals")(lambda g: g.gold.git_totals)
case("G39_git_person_weekly", "person_key:s week:d commits:i prs_merged:i code_loc:i spec_lines:i", "select * from git_weekly")(lambda g: g.gold.git_weekly)
case("G40_empty_contracts", "person_id:s metric_date:s name:s",
     "select lower(c_name) person_id, null metric_date, c_name as name from customer where false union all select person_id, null, display_name from people")(
    lambda g: g.people.join(g.gold.ic_timeoff.select("person_id", "metric_date"), "person_id", "left").withColumnRenamed("display_name", "name"))


# --- metric queries ---------------------------------------------------------------------------

def _section_sql(name: str) -> tuple[str, str]:
    """Person values of a section, in SQL: one expression per metric."""
    total = lambda *k: f"coalesce(sum(metric_value) filter (metric_key in {_list(k)}), 0)"
    pct = lambda a, b, digits=True: f"case when {b} > 0 then {'round(' if digits else ''}100.0 * {a} / {b}{', 1)' if digits else ''} end"
    cap = lambda x: f"(case when ({x}) > 100 then 100.0 else ({x}) end)"
    mid = lambda k: f"quantile_disc(metric_value, 0.5) filter (metric_key = '{k}' and metric_value is not null)"
    if name == "task_delivery":
        return "task_rows", ", ".join(f"{v} as \"{k}\"" for k, v in {
            "tasks_completed": total("tasks_completed"), "stale_in_progress": total("stale_in_progress"),
            "task_dev_time": mid("task_dev_time"), "mean_time_to_resolution": mid("mean_time_to_resolution"), "pickup_time": mid("pickup_time"),
            "task_reopen_rate": """case when coalesce(sum(metric_value) filter (metric_key = 'task_reopen_rate' and metric_value > 0), 0) >= 5 then
                round(abs(coalesce(sum(metric_value) filter (metric_key = 'task_reopen_rate' and metric_value < 0), 0)) / sum(metric_value) filter (metric_key = 'task_reopen_rate' and metric_value > 0) * 100, 1) end""",
            "due_date_compliance": pct(total("due_date_on_time"), total("due_date_with_due")), "bugs_to_task_ratio": pct(total("bugs_fixed"), total("tasks_completed")),
            "flow_efficiency": cap(pct(total("flow_efficiency_num"), total("flow_efficiency_den"))),
            "worklog_logging_accuracy": cap(pct(total("worklog_seconds"), total("in_progress_seconds"))),
            "estimation_accuracy": """case when count(*) filter (metric_key = 'estimation_accuracy' and metric_value > 0 and metric_value <= 200) > 0 then
                greatest(0.0, 100 - avg(abs(100 - metric_value)) filter (metric_key = 'estimation_accuracy' and metric_value > 0 and metric_value <= 200)) end"""}.items())
    if name == "collaboration":
        sent = total("slack_messages_sent")
        return "collab_rows", ", ".join([f"{total(k)} as {k}" for k in metrics.COLLAB_COUNTERS] + [
            f"case when {total('slack_active_days')} > 0 then round({sent} / {total('slack_active_days')}, 1) end as slack_msgs_per_active_day",
            f"{pct(f'greatest(0, {sent} - ' + total('slack_channel_posts') + ')', sent)} as slack_dm_ratio"])
    if name == "ai_adoption":
        return "ai_rows", ", ".join([f"max(1.0) filter (metric_key = '{k}') as {k}" for k in metrics.AI_ACTIVE] + [f"{total(k)} as {k}" for k in metrics.AI_COUNTERS] + [
            "sum(metric_value) filter (metric_key = 'prs_with_cc') as prs_with_cc", "sum(metric_value) filter (metric_key = 'prs_total') as prs_total",
            f"{pct(total('cursor_completions'), total('cursor_offered'))} as cursor_acceptance", f"{pct(total('cc_tool_accept'), total('cc_offered'))} as cc_tool_acceptance",
            f"{pct(total('cursor_lines'), total('cursor_total_lines'))} as ai_loc_share2", "null::double as claude_web"])
    if name == "code_quality":
        return "quality_rows", f"{total('bugs_fixed')} as bugs_fixed, null::double as prs_per_dev, null::double as pr_cycle_time, null::double as build_success"
    if name == "git_output":
        return "git_rows", ", ".join([f"{total(k)} as {k}" for k in ("commits", "prs_created", "prs_merged", "clean_loc")] + [
            f"{pct(total('prs_merged'), total('prs_created'), False)} as merge_rate", f"{total('loc')} / nullif({total('commits')}, 0) as lines_per_commit",
            f"{total('commits')} / nullif(count(*) filter (metric_key = 'commits' and metric_value > 0), 0) as commits_per_active_day",
            f"{mid('pr_cycle_time_h')} as pr_cycle_time_h", f"{mid('pr_size')} as pr_size"])
    if name == "crm_quality":
        return "crm_rows", f"""{total('deals_opened')} as deals_opened, avg(metric_value) filter (metric_key = 'cycle_days') as cycle_days,
            avg(metric_value) filter (metric_key = 'deal_size') as avg_deal_size, {pct(total('deals_won'), total('deals_closed'), False)} as win_rate"""
    return "crm_rows", f"""{total('calls')} as calls, {total('emails')} as emails, {total('meetings')} as meetings,
        {total('calls', 'emails', 'meetings', 'tasks')} / nullif({total('deals_won')}, 0) as comms_per_won"""


def _values_sql(name: str) -> str:
    rows, columns = _section_sql(name)
    where = _IN if name not in ("crm_quality", "crm_activity") else "metric_date >= date '1990-01-01'"
    return f"""select person_id, org_unit_id, metric_key, v from (select person_id, max(org_unit_id) org_unit_id, {columns} from {rows} where {where} group by person_id)
        unpivot include nulls (v for metric_key in (* exclude (person_id, org_unit_id)))"""


_ACTIVE = _list(metrics.AI_ACTIVE)
_TAIL = "('task_dev_time','mean_time_to_resolution','pickup_time')"


def _range_sql(by: str) -> str:
    return f"""select {by} metric_key, case when metric_key in {_ACTIVE} then case when count(v) > 0 then 0 end else quantile_disc(v, 0.5) end median,
        case when metric_key in {_ACTIVE} then case when count(v) > 0 then 0 end else min(v) end range_min,
        case when metric_key in {_ACTIVE} then case when count(v) > 0 then count(*) end when metric_key in {_TAIL} then quantile_disc(v, 0.95) else max(v) end range_max
        from vals group by {by} metric_key"""


def _period(name: str):
    return PERIOD if name not in ("crm_quality", "crm_activity") else ("1990-01-01", "2030-01-01")


_TEAM_SPEC = "metric_key:s value:f median:f range_min:f range_max:f"
for _id, _name in (("Q7_delivery", "task_delivery"), ("Q8_collaboration", "collaboration"), ("Q9_ai", "ai_adoption"), ("Q10_code_quality", "code_quality"), ("Q11_git", "git_output"),
                   ("Q12_crm_quality", "crm_quality"), ("Q12_crm_activity", "crm_activity")):
    _unit = "MACHINERY"
    case(f"{_id}_team", _TEAM_SPEC,
         f"""with vals as ({_values_sql(_name)}) select metric_key, value, median, range_min, range_max from (
             select metric_key, case when metric_key in {_ACTIVE} then sum(v) else avg(v) end as value from vals where org_unit_id = '{_unit}' group by 1) left join ({_range_sql('')}) using (metric_key)""")(
        lambda g, n=_name: metrics.metric_query(g.gold, f"team_{n}", _period(n), {"org_unit_id": "MACHINERY"}))
    case(f"{_id}_person", "person_id:s " + _TEAM_SPEC,
         f"""with vals as ({_values_sql(_name)}) select person_id, metric_key, v as value, median, range_min, range_max from vals left join ({_range_sql('org_unit_id,')}) using (org_unit_id, metric_key)""")(
        lambda g, n=_name: metrics.metric_query(g.gold, f"person_{n}", _period(n)))

case("Q5_team_bullet_delivery", "org_unit_id:s " + _TEAM_SPEC,
     f"""with vals as ({_values_sql('task_delivery')}) select org_unit_id, metric_key, value, median, range_min, range_max from (
         select org_unit_id, metric_key, avg(v) as value from vals group by 1, 2) left join ({_range_sql('')}) using (metric_key)""")(
    lambda g: rollup.team_bullets(g.gold.task_delivery_rows, metrics.delivery_metrics(), PERIOD))


@case("Q6_person_bullet", "person_id:s " + _TEAM_SPEC,
      f"""with vals as ({_values_sql('collaboration')}) select person_id, metric_key, v as value, median, range_min, range_max from vals left join ({_range_sql('org_unit_id,')})
          using (org_unit_id, metric_key) where person_id = 'customer#000000007'""")
def q6(g: Given):
    return metrics.metric_query(g.gold, "person_collaboration", PERIOD, {"person_id": "customer#000000007"})


case("Q1_metric_query", "person_id:s focus_time_pct:f",
     f"select person_id, round(avg(focus_time_pct), 1) focus_time_pct from ic_kpis where {_IN} group by 1 order by 2 desc, 1 limit 10")(
    lambda g: metrics.metric_query(g.gold, "ic_kpis", PERIOD, select=["person_id", "focus_time_pct"], orderby=["-focus_time_pct", "person_id"], top=10))
case("Q2_period_below_aggregation", "metric_key:s people:i",
     f"select metric_key, count(v) people from ({_values_sql('collaboration')}) group by 1")(
    lambda g: rollup.person_values(rollup.in_period(g.gold.collab_rows, PERIOD), metrics.collab_metrics()).groupBy("metric_key").agg(F.count("v").alias("people")))


@case("Q3_batch", "query:s rows:i",
      f"""select 'crm' query, count(*) as rows from (select distinct person_id from ({_KPIS})) union all select 'open deals', count(distinct person_id) from deals
          union all select q, -1 from region, (values ('unknown'), ('fails as it runs')) f(q) where r_regionkey = 0""")
def q3(g: Given):
    # names aren't numbers: the last request's plan is right, and its comparison fails on the first row
    out = metrics.batch_query(g.gold, {"crm": {"name": "crm_kpis"}, "open deals": {"name": "crm_open_deals"}, "unknown": {"name": "no_such_query"},
                                       "fails as it runs": {"name": "crm_kpis", "filters": {"person_id": 7}}})
    failed = g.table("region").filter("r_regionkey = 0")
    return reshape.union_all((out[n].agg(F.count(F.lit(1)).alias("rows")) if isinstance(out[n], DataFrame) else failed.select(F.lit(-1).cast("bigint").alias("rows")))
                             .select(F.lit(n).alias("query"), "rows") for n in out)


case("Q4_tenant_scope", "o_orderkey:i o_custkey:i", "select o_orderkey, o_custkey from orders where o_orderstatus = 'F' and o_custkey in (1, 2, 3, 4, 5, 6, 7, 8, 9) order by o_orderkey desc limit 40 offset 3")(
    lambda g: metrics.select_rows(metrics.scoped(g.orders.withColumn("tenant_id", F.col("o_orderstatus")), "F"), {"o_custkey": list(range(1, 10))},
                                  ["o_orderkey", "o_custkey"], ["-o_orderkey"], 40, 3))
case("Q13_crm_kpis", "person_id:s deals_opened:i deals_closed:i deals_won:i comms_count:i deals_value_closed:f",
     f"select person_id, sum(deals_opened) deals_opened, sum(deals_closed) deals_closed, sum(deals_won) deals_won, sum(comms_count) comms_count, round(sum(deals_value_closed), 0) deals_value_closed from ({_KPIS}) group by 1")(
    lambda g: metrics.metric_query(g.gold, "crm_kpis"))
case("Q13_crm_open_deals", "person_id:s pipeline_count:i pipeline_value:f",
     "select person_id, count(*) filter (not done) pipeline_count, round(coalesce(sum(coalesce(amount_home, 0)) filter (not done), 0), 0) pipeline_value from deals group by 1")(
    lambda g: metrics.metric_query(g.gold, "crm_open_deals"))
case("Q13_crm_flow", "date_bucket:s opened:i closed:i won:i person_id:s metric_date:d", _FLOW)(lambda g: metrics.metric_query(g.gold, "crm_flow"))
case("Q14_exec_summary", _EXEC_SPEC,
     f"""select org_unit_id, max(org_unit_name) org_unit_name, max(headcount) headcount, sum(tasks_closed) tasks_closed, sum(bugs_fixed) bugs_fixed, null build_success_pct, round(avg(focus_time_pct), 1) focus_time_pct,
         round(avg(ai_adoption_pct), 1) ai_adoption_pct, round(avg(ai_loc_share_pct), 1) ai_loc_share_pct, null pr_cycle_time_h from ({_EXEC}) where {_IN} group by 1""")(
    lambda g: metrics.metric_query(g.gold, "exec_summary", PERIOD))
case("Q14_team_members", "person_id:s org_unit_id:s display_name:s seniority:s supervisor_email:s tasks_closed:f bugs_fixed:f dev_time_h:f prs_merged:f focus_time_pct:f ai_tools:a ai_loc_share_pct:f",
     f"""select m.person_id, m.org_unit_id, max(m.display_name) display_name, case when max(p.job_title) ilike '%vp of%' then 'Senior' else max(m.seniority) end seniority, max(p.supervisor_email) supervisor_email,
         sum(tasks_closed) tasks_closed, sum(bugs_fixed) bugs_fixed, round(avg(dev_time_h), 1) dev_time_h, sum(prs_merged) prs_merged, round(avg(focus_time_pct), 1) focus_time_pct,
         list_sort(list_distinct(flatten(list(ai_tools)))) ai_tools, round(avg(ai_loc_share_pct), 1) ai_loc_share_pct from ({_MEMBER}) m join people p using (person_id) where {_IN} group by 1, 2""")(
    lambda g: metrics.metric_query(g.gold, "team_members", PERIOD))
case("Q14_ic_kpis", "person_id:s " + _KPI_SPEC,
     f"""select person_id, sum(loc) loc, round(avg(ai_loc_share_pct), 1) ai_loc_share_pct, sum(prs_merged) prs_merged, avg(pr_cycle_time_h) pr_cycle_time_h, round(avg(focus_time_pct), 1) focus_time_pct,
         sum(tasks_closed) tasks_closed, sum(bugs_fixed) bugs_fixed, sum(ai_sessions) ai_sessions from ic_kpis where {_IN} group by 1""")(lambda g: metrics.metric_query(g.gold, "ic_kpis", PERIOD))
case("Q15_loc_trend", "date_bucket:d ai_loc:f code_loc:f spec_lines:f person_id:s metric_date:d", f"select * from ({_LOC}) where {_IN}")(lambda g: metrics.metric_query(g.gold, "loc_trend", PERIOD))
case("Q15_delivery_trend", "date_bucket:d commits:i prs_merged:i tasks_done:i person_id:s metric_date:d", f"select * from ({_DELIVERY}) where {_IN}")(
    lambda g: metrics.metric_query(g.gold, "delivery_trend", PERIOD))
case("Q16_histogram", "person_id:s metric_key:s bin:i bin_end:i count:i", f"select person_id, metric_key, bin, bin_end, sum(count) as count from ({_HISTOGRAM}) where {_IN} group by 1, 2, 3, 4")(
    lambda g: metrics.metric_query(g.gold, "histogram", PERIOD))
case("Q16_peer_cohort", "cohort_seed:s kind:s metric_key:s p25:f p50:f p75:f min:f max:f n:i",
     f"""select cohort_seed, kind, metric_key, quantile_disc(p25, 0.25) p25, quantile_disc(p50, 0.5) p50, quantile_disc(p75, 0.75) p75, min("min") as min, max("max") as max, max(n) n
         from ({_COHORTS}) where {_IN} group by 1, 2, 3""")(lambda g: metrics.metric_query(g.gold, "peer_cohort", PERIOD))
case("Q16_section_trend", "person_id:s section_id:s series_key:s metric_date:d value:f", f"select person_id, section_id, series_key, metric_date, sum(value) as value from ({_TREND}) where {_IN} group by 1, 2, 3, 4")(
    lambda g: metrics.metric_query(g.gold, "section_trend", PERIOD))
case("Q16_kpi_peers", "cohort_seed:s kpi_key:s p25:f p50:f p75:f n:i",
     f"""select cohort_seed, kpi_key, quantile_disc(t, 0.25) p25, quantile_disc(t, 0.5) p50, quantile_disc(t, 0.75) p75, count(*) n from (
         select supervisor_email cohort_seed, person_id, kpi_key, case when kpi_key in {_list(metrics.KPI_SUMS)} then sum(value) else avg(value) end t from ({_PEERS}) where {_IN} group by 1, 2, 3) group by 1, 2""")(
    lambda g: metrics.metric_query(g.gold, "kpi_peers", PERIOD))


# --- thresholds -------------------------------------------------------------------------------------

def _catalog(g: Given) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metrics are parts, thresholds come from line items, contexts from customers."""
    catalog = g.table("part").selectExpr("cast(p_partkey as string) as metric_key", "p_size > 3 as is_enabled")
    scopes = "array('product-default','tenant','role','team','team+role')"
    lines = g.lineitem.withColumn("r", (F.col("l_linenumber") - 1) % 5 + 1).groupBy("l_partkey", "r").agg(F.max("l_extendedprice").alias("good"), F.min("l_extendedprice").alias("warn"), F.min("l_suppkey").alias("s"))
    rows = lines.selectExpr(
        "cast(l_partkey as string) as metric_key", f"element_at({scopes}, cast(r as int)) as scope", "'t1' as tenant_id", "'dev' as role_slug", "'MACHINERY' as team_id", "good", "warn",
        "cast(null as double) as alert_trigger", "cast(null as double) as alert_bad", "s % 9 = 0 as is_locked")
    contexts = g.customer.selectExpr("case when c_nationkey < 20 then 't1' else 't2' end as tenant_id", "case when c_nationkey % 2 = 0 then 'dev' else 'ops' end as role_slug", "c_mktsegment as team_id")
    return catalog, rows, contexts


case("Q17_resolve_thresholds", "tenant_id:s role_slug:s team_id:s metric_key:s scope:s good:f warn:f bounded_by_lock:b",
     """with c as (select distinct case when c_nationkey < 20 then 't1' else 't2' end tenant_id, case when c_nationkey % 2 = 0 then 'dev' else 'ops' end role_slug, c_mktsegment team_id from customer),
        t as (select l_partkey::varchar metric_key, (l_linenumber - 1) % 5 + 1 r, max(l_extendedprice) good, min(l_extendedprice) warn, min(l_suppkey) % 9 = 0 locked from lineitem group by 1, 2),
        m as (select c.*, t.* from c join t on r = 1 or (r = 2 and tenant_id = 't1') or (r = 3 and tenant_id = 't1' and role_slug = 'dev') or (r = 4 and tenant_id = 't1' and team_id = 'MACHINERY')
          or (r = 5 and tenant_id = 't1' and role_slug = 'dev' and team_id = 'MACHINERY')),
        k as (select *, min(case when locked then r end) over (partition by tenant_id, role_slug, team_id, metric_key) as stop from m)
        select tenant_id, role_slug, team_id, metric_key, (['product-default','tenant','role','team','team+role'])[r] as scope, good, warn, stop is not null bounded_by_lock from k
        where (stop is null or r <= stop) and metric_key in (select p_partkey::varchar from part where p_size > 3)
        qualify row_number() over (partition by tenant_id, role_slug, team_id, metric_key order by r desc) = 1""")(lambda g: thresholds.resolve_thresholds(*_catalog(g)))
case("Q18_query_links", "query_id:s metric_keys:a",
     "select p_brand query_id, list_sort(list(p_partkey::varchar)) metric_keys from part where p_size > 3 group by 1")(
    lambda g: thresholds.query_links(g.table("part").selectExpr("p_brand as query_id", "cast(p_partkey as string) as metric_key"), _catalog(g)[0]))


@case("Q19_probe_schema", "column:s present:b rows:i",
      "select 'o_custkey' as column, true present, count(*) as rows from orders union all select 'metric_key', false, count(*) from orders union all select 'metric_value', false, count(*) from orders")
def q19(g: Given):
    found = thresholds.probe_schema(g.orders, ["o_custkey"], long_format=True)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(ok).alias("present")) for c, ok in found.items()])
    return g.orders.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.inline(pairs))
