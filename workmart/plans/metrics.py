"""The metric surface (Q1-Q16): named queries with period, filters, top-k."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from workmart.functions.scalars import executive_title, rounded
from workmart.operators.quantiles import exact_quantiles
from workmart.operators.reshape import unpivot
from workmart.operators.rollup import (
    Metrics, days_above_zero, fold_accuracy, in_period, mean, nothing, per, percent, person_bullet, seen,
    supported_ratio, team_bullet, total, total_if_any,
)
from workmart.plans.gold import Gold, peer_cohorts
from workmart.session import store

Period = tuple[str, str] | None

DEFAULT_TOP, MAX_TOP = 25, 200


# --- per-person definitions ------------------------------------------------------------

def delivery_metrics() -> Metrics:  # Q7
    return Metrics(
        values={
            "tasks_completed": total("tasks_completed"), "stale_in_progress": total("stale_in_progress"),
            "task_reopen_rate": supported_ratio("task_reopen_rate"),
            "due_date_compliance": percent(total("due_date_on_time"), total("due_date_with_due")),
            "bugs_to_task_ratio": percent(total("bugs_fixed"), total("tasks_completed")),
            "flow_efficiency": percent(total("flow_efficiency_num"), total("flow_efficiency_den"), cap=100.0),
            "worklog_logging_accuracy": percent(total("worklog_seconds"), total("in_progress_seconds"), cap=100.0),
            "estimation_accuracy": fold_accuracy("estimation_accuracy"),
        },
        medians={"task_dev_time": "task_dev_time", "mean_time_to_resolution": "mean_time_to_resolution", "pickup_time": "pickup_time"},
        tail=("task_dev_time", "mean_time_to_resolution", "pickup_time"))


COLLAB_COUNTERS = (
    "m365_emails_sent", "m365_emails_received", "m365_emails_read", "meeting_hours", "meetings_count",
    "teams_meeting_hours", "zoom_meeting_hours", "teams_meetings", "zoom_meetings", "meeting_free", "m365_teams_chats",
    "slack_messages_sent", "slack_channel_posts", "slack_active_days", "m365_files_shared_internal",
    "m365_files_shared_external", "m365_files_engaged", "m365_active_days",
)


def collab_metrics() -> Metrics:  # Q8
    sent = total("slack_messages_sent")
    direct = F.greatest(F.lit(0.0), sent - total("slack_channel_posts"))
    return Metrics(values={
        **{n: total(n) for n in COLLAB_COUNTERS},
        "slack_msgs_per_active_day": per(sent, total("slack_active_days"), 1),
        "slack_dm_ratio": percent(direct, sent),
    })


AI_COUNTERS = ("cursor_completions", "cursor_agents", "cursor_lines", "cc_sessions", "cc_lines", "cc_tool_accept", "cc_cost",
               "team_ai_loc", "chatgpt", "codex_lines", "codex_sessions")
AI_ACTIVE = ("active_ai_members", "cursor_active", "cc_active", "codex_active", "chatgpt_active")


def ai_metrics() -> Metrics:  # Q9
    return Metrics(
        values={
            **{n: seen(n) for n in AI_ACTIVE}, **{n: total(n) for n in AI_COUNTERS},
            "prs_with_cc": total_if_any("prs_with_cc"), "prs_total": total_if_any("prs_total"),
            "cursor_acceptance": percent(total("cursor_completions"), total("cursor_offered")),
            "cc_tool_acceptance": percent(total("cc_tool_accept"), total("cc_offered")),
            "ai_loc_share2": percent(total("cursor_lines"), total("cursor_total_lines")), "claude_web": nothing(),
        },
        active=AI_ACTIVE)


def quality_metrics() -> Metrics:  # Q10
    return Metrics(values={"bugs_fixed": total("bugs_fixed"), "prs_per_dev": nothing(), "pr_cycle_time": nothing(), "build_success": nothing()})


def git_metrics() -> Metrics:  # Q11
    commits = total("commits")
    return Metrics(
        values={
            "commits": commits, "prs_created": total("prs_created"), "prs_merged": total("prs_merged"), "clean_loc": total("clean_loc"),
            "merge_rate": percent(total("prs_merged"), total("prs_created"), digits=None),
            "lines_per_commit": per(total("loc"), commits), "commits_per_active_day": per(commits, days_above_zero("commits")),
        },
        medians={"pr_cycle_time_h": "pr_cycle_time_h", "pr_size": "pr_size"})


def crm_quality_metrics() -> Metrics:  # Q12
    return Metrics(values={
        "deals_opened": total("deals_opened"), "cycle_days": mean("cycle_days"), "avg_deal_size": mean("deal_size"),
        "win_rate": percent(total("deals_won"), total("deals_closed"), digits=None)})


def crm_activity_metrics() -> Metrics:  # Q12
    return Metrics(values={
        "calls": total("calls"), "emails": total("emails"), "meetings": total("meetings"),
        "comms_per_won": per(total("calls", "emails", "meetings", "tasks"), total("deals_won"))})


SECTIONS: dict[str, tuple[str, Callable[[], Metrics]]] = {
    "task_delivery": ("task_delivery_rows", delivery_metrics), "collaboration": ("collab_rows", collab_metrics),
    "ai_adoption": ("ai_rows", ai_metrics), "code_quality": ("code_quality_rows", quality_metrics),
    "git_output": ("git_rows", git_metrics), "crm_quality": ("crm_rows", crm_quality_metrics),
    "crm_activity": ("crm_rows", crm_activity_metrics),
}


# --- roll-ups of gold views ----------------------------------------------------------------

def exec_summary(gold: Gold, period: Period = None) -> DataFrame:  # Q14
    rows = in_period(gold.exec_summary, period)
    mean1 = lambda c: rounded(F.avg(c), 1).alias(c)
    return rows.groupBy("org_unit_id").agg(
        F.max("org_unit_name").alias("org_unit_name"), F.max("headcount").alias("headcount"), F.sum("tasks_closed").alias("tasks_closed"),
        F.sum("bugs_fixed").alias("bugs_fixed"), F.max("build_success_pct").alias("build_success_pct"), mean1("focus_time_pct"),
        mean1("ai_adoption_pct"), mean1("ai_loc_share_pct"), F.avg("pr_cycle_time_h").alias("pr_cycle_time_h"))


def team_members(gold: Gold, period: Period = None) -> DataFrame:  # Q14
    rows = in_period(gold.team_member, period)
    mean1 = lambda c: rounded(F.avg(c), 1).alias(c)
    # Tools are few: the set is gathered from their names, not from all days.
    per_person = rows.groupBy("person_id", "org_unit_id").agg(
        F.max("display_name").alias("display_name"), F.max("seniority").alias("__seniority"), F.sum("tasks_closed").alias("tasks_closed"),
        F.sum("bugs_fixed").alias("bugs_fixed"), mean1("dev_time_h"), F.sum("prs_merged").alias("prs_merged"),
        F.max("build_success_pct").alias("build_success_pct"), mean1("focus_time_pct"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("ai_tools")))).alias("ai_tools"), mean1("ai_loc_share_pct"))
    titles = gold.people.select("person_id", "job_title", "supervisor_email")
    senior = F.when(F.coalesce(executive_title("job_title"), F.lit(False)), "Senior").otherwise(F.col("__seniority"))
    return per_person.join(titles, "person_id", "left").withColumn("seniority", senior).drop("__seniority", "job_title")


def ic_kpis(gold: Gold, period: Period = None) -> DataFrame:  # Q14
    rows = in_period(gold.ic_kpis, period)
    return rows.groupBy("person_id").agg(
        *[F.sum(c).alias(c) for c in ("loc", "prs_merged", "tasks_closed", "bugs_fixed", "ai_sessions")],
        rounded(F.avg("ai_loc_share_pct"), 1).alias("ai_loc_share_pct"), F.avg("pr_cycle_time_h").alias("pr_cycle_time_h"),
        rounded(F.avg("focus_time_pct"), 1).alias("focus_time_pct"), F.max("build_success_pct").alias("build_success_pct"))


def crm_kpis(gold: Gold, period: Period = None) -> DataFrame:  # Q13
    rows = in_period(gold.crm_kpis, period)
    return rows.groupBy("person_id").agg(
        *[F.sum(c).alias(c) for c in ("deals_opened", "deals_closed", "deals_won", "comms_count")],
        rounded(F.sum("deals_value_closed"), 0).alias("deals_value_closed"))


def crm_open_deals(gold: Gold, period: Period = None) -> DataFrame:  # Q13: the state now, whatever the period
    return gold.crm_pipeline_now.select("person_id", "pipeline_count", "pipeline_value")


def crm_flow(gold: Gold, period: Period = None) -> DataFrame:  # Q13
    return in_period(gold.crm_chart_flow, period).select("date_bucket", "opened", "closed", "won", "person_id", "metric_date")


def loc_trend(gold: Gold, period: Period = None) -> DataFrame:  # Q15
    return in_period(gold.ic_chart_loc, period).select("date_bucket", "ai_loc", "code_loc", "spec_lines", "person_id", "metric_date")


def delivery_trend(gold: Gold, period: Period = None) -> DataFrame:  # Q15
    return in_period(gold.ic_chart_delivery, period).select("date_bucket", "commits", "prs_merged", "tasks_done", "person_id", "metric_date")


def histogram(gold: Gold, period: Period = None) -> DataFrame:  # Q16
    return in_period(gold.ic_histogram, period).groupBy("person_id", "metric_key", "bin", "bin_end").agg(F.sum("count").alias("count"))


def peer_cohort(gold: Gold, period: Period = None) -> DataFrame:  # Q16
    """Quartiles of the daily quartiles, as published."""
    daily = gold.materialized(in_period(gold.peer_cohort_stats, period))
    keys = ["cohort_seed", "kind", "metric_key"]
    spread = daily.groupBy(*keys).agg(F.min("min").alias("min"), F.max("max").alias("max"), F.max("n").alias("n"))
    wanted = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    # All three columns in one ranking; of each only its own quantile counts.
    long = unpivot(daily, keys, {n: n for n in wanted}, "__name", "__v")
    ranked = exact_quantiles(long, [*keys, "__name"], "__v", {f"__{n}": p for n, p in wanted.items()})
    picked = ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == n, F.col(f"__{n}"))).alias(n) for n in wanted])
    return spread.join(picked, keys, "left")


def peer_cohort_exact(rows: DataFrame, people: DataFrame, period: Period = None) -> DataFrame:
    """Quartiles of all values of the period, without the daily step."""
    return peer_cohorts(in_period(rows, period).withColumn("metric_date", F.lit(None).cast("date")), people).drop("metric_date")


def section_trend(gold: Gold, period: Period = None) -> DataFrame:  # Q16
    rows = in_period(gold.ic_section_trend, period)
    return rows.groupBy("person_id", "section_id", "series_key", "metric_date").agg(F.sum("value").alias("value"))


KPI_SUMS = ("bugs_fixed", "tasks_closed", "prs_merged", "ai_sessions")


def kpi_peers(gold: Gold, period: Period = None) -> DataFrame:  # Q16
    rows = in_period(gold.ic_kpi_peer_median, period)
    keys = ["cohort_seed", "kpi_key"]
    per_person = rows.groupBy(F.col("supervisor_email").alias("cohort_seed"), "person_id", "kpi_key").agg(
        F.sum("value").alias("__sum"), F.avg("value").alias("__avg")).withColumn(
        "person_total", F.when(F.col("kpi_key").isin(*KPI_SUMS), F.col("__sum")).otherwise(F.col("__avg")))
    counts = per_person.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return exact_quantiles(per_person, keys, "person_total", {"p25": 0.25, "p50": 0.5, "p75": 0.75}).join(counts, keys)


def _section(name: str, person: bool) -> Callable[..., DataFrame]:
    view, metrics = SECTIONS[name]

    def run(gold: Gold, period: Period = None, member: str | None = None) -> DataFrame:
        build = person_bullet if person else team_bullet
        return build(getattr(gold, view), metrics(), period, member)

    return run


QUERIES: dict[str, Callable[..., DataFrame]] = {
    "exec_summary": exec_summary, "team_members": team_members, "ic_kpis": ic_kpis, "crm_kpis": crm_kpis,
    "crm_open_deals": crm_open_deals, "crm_flow": crm_flow, "loc_trend": loc_trend, "delivery_trend": delivery_trend,
    "histogram": histogram, "peer_cohort": peer_cohort, "section_trend": section_trend, "kpi_peers": kpi_peers,
    **{f"team_{n}": _section(n, person=False) for n in SECTIONS}, **{f"person_{n}": _section(n, person=True) for n in SECTIONS},
}

# The filter a query applies inside, before its ranges are computed.
MEMBER_FILTER = {**{f"team_{n}": "org_unit_id" for n in SECTIONS}, **{f"person_{n}": "person_id" for n in SECTIONS}}


# --- running a query (Q1-Q4, L1-L3) -------------------------------------------------------

def scoped(df: DataFrame, tenant: str) -> DataFrame:
    """Only one tenant's rows (Q4)."""
    return df.filter(F.col("tenant_id") == tenant)


def select_rows(df: DataFrame, filters: Mapping[str, object] | None = None, select: Sequence[str] = (),
                orderby: Sequence[str] = (), top: int | None = None, skip: int = 0) -> DataFrame:
    """Equality filters, order ('-name' is descending), columns, offset, limit."""
    for name, value in (filters or {}).items():
        df = df.filter(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    if orderby:
        df = df.orderBy(*[F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in orderby])
    if select:
        df = df.select(*select)
    if skip:
        df = df.offset(skip)
    return df if top is None else df.limit(top)


def page_size(top: int | None) -> int:
    """Rows of a page: a request outside 1 to MAX_TOP is an error, never another number of rows."""
    if top is not None and not 1 <= top <= MAX_TOP:
        raise ValueError(f"top must be from 1 to {MAX_TOP}, not {top}")
    return DEFAULT_TOP if top is None else top


@dataclass(frozen=True)
class Page:
    rows: list
    has_next: bool


def metric_query(gold: Gold, name: str, period: Period = None, filters: Mapping[str, object] | None = None,
                 select: Sequence[str] = (), orderby: Sequence[str] = (), skip: int = 0, top: int | None = None) -> DataFrame:
    """Rows of a named metric (Q1). The period goes below all aggregations
    (Q2); a person or unit filter of a bullet picks whose value is shown and
    leaves the comparison group whole."""
    filters = dict(filters or {})
    args = {}
    if name in MEMBER_FILTER and MEMBER_FILTER[name] in filters:
        args["member"] = filters.pop(MEMBER_FILTER[name])
    return select_rows(QUERIES[name](gold, period, **args), filters, select, orderby, top, skip)


def fetch_page(gold: Gold, name: str, top: int | None = None, **request) -> Page:
    """One page and whether there is another: at most 201 rows reach the
    driver (L2)."""
    size = page_size(top)
    rows = metric_query(gold, name, top=size + 1, **request).collect()
    return Page(rows[:size], len(rows) > size)


def batch_query(gold: Gold, requests: Mapping[str, dict]) -> dict[str, DataFrame | Exception]:
    """Several queries over the same views, each stored; one that fails leaves
    the others alone, also where it fails only when it runs (Q3)."""
    out: dict[str, DataFrame | Exception] = {}
    for key, request in requests.items():
        try:
            out[key] = store(metric_query(gold, **request))
        except Exception as error:  # reported per item
            out[key] = error
    return out


