"""Facts and marts between the classes and the metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from workmart.functions import fixed
from workmart.functions.keys import unique_key
from workmart.functions.scalars import clamp, file_category, filled, person_key, rounded, seconds_between, week
from workmart.operators.latest import latest_by
from workmart.operators.reshape import anchor_aggregate

REPO = ["tenant_id", "source_id", "project_key", "repo_slug"]


# --- git (G38, G39) -----------------------------------------------------------------

def git_commits(commits: DataFrame) -> DataFrame:
    return commits.withColumn("person_key", person_key("author_email", "author_name")).withColumn("week", week("date"))


def git_file_changes(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """File changes with their commit's author and week."""
    owners = commits.select(*REPO, "commit_hash", "author_name", "author_email", "person_key",
                            F.col("date").alias("committed_at"), "week", "is_merge_commit")
    return changes.withColumn("file_category", file_category("file_path")).join(owners, [*REPO, "commit_hash"])


def git_pull_requests(prs: DataFrame) -> DataFrame:
    """Cycle time only for merged requests that close after they open."""
    state = F.lower("state")
    hours = seconds_between(F.col("created_on"), F.col("closed_on")) / F.lit(3600.0)
    valid = (state == "merged") & (F.col("closed_on") >= F.col("created_on"))
    return (
        prs.withColumn("state_norm", state).withColumn("person_key", person_key("author_email", "author_name"))
        .withColumn("cycle_time_h", F.when(valid, hours)))


def git_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.withColumn("person_key", F.lower("reviewer_name"))


def git_person_totals(prs: DataFrame, commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Everybody who opened, committed or changed code, with all counters. One
    aggregation over the stacked facts."""
    named = filled(F.col("person_key"))
    real = named & (F.col("is_merge_commit") == 0)
    one = F.lit(1).cast("bigint")
    sum0 = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
    out = anchor_aggregate(
        [
            (prs.filter(named), {"pr": one, "merged": (F.col("state_norm") == "merged").cast("bigint"), "cycle": F.col("cycle_time_h")}),
            (commits.filter(real), {"commit": one, "lines": F.col("lines_added") + F.col("lines_removed")}),
            (changes.filter(real & (F.col("file_category") == "code")), {"clean": F.col("lines_added")}),
        ],
        ["tenant_id", "person_key"],
        {
            "prs_created": sum0("pr"), "prs_merged": sum0("merged"), "avg_pr_cycle_time_h": F.avg("cycle"),
            "commits": sum0("commit"), "loc": sum0("lines"), "clean_loc": sum0("clean"),
        })
    return out.withColumn("unique_key", unique_key("tenant_id", "person_key", sep="|"))


def git_person_weekly(prs: DataFrame, commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Per person and week. A merged request counts in the week of its merge
    commit, or of its closing when that commit is unknown."""
    named = filled(F.col("person_key"))
    real = named & (F.col("is_merge_commit") == 0) & F.col("week").isNotNull()
    merge = commits.select(*REPO, F.col("commit_hash").alias("merge_commit_hash"), F.col("week").alias("merge_week"))
    merged = prs.filter(named & (F.col("state_norm") == "merged") & F.col("closed_on").isNotNull())
    merged = merged.join(merge, [*REPO, "merge_commit_hash"], "left").withColumn(
        "week", F.coalesce("merge_week", week("closed_on")))
    one = F.lit(1).cast("bigint")
    lines = lambda kind: F.when(F.col("file_category") == kind, F.col("lines_added")).otherwise(0)
    sum0 = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
    out = anchor_aggregate(
        [
            (commits.filter(real), {"commit": one}),
            (changes.filter(real), {"code": lines("code"), "spec": lines("spec")}),
            (merged, {"merged": one}),
        ],
        ["tenant_id", "person_key", "week"],
        {"commits": sum0("commit"), "prs_merged": sum0("merged"), "code_loc": sum0("code"), "spec_lines": sum0("spec")})
    return out.withColumn("unique_key", unique_key("tenant_id", "person_key", "week", sep="|"))


# --- focus time (G37) ---------------------------------------------------------------

def longest_modality() -> Column:
    """Seconds in a meeting: the longest of audio, video and screen share."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return F.greatest(zero("audio_duration_seconds"), zero("video_duration_seconds"), zero("screen_share_duration_seconds"))


def focus_metrics(meetings: DataFrame, hours: DataFrame) -> DataFrame:
    """Meeting, focus and working time per person and day. Hours are reduced
    to one row per person first, so a person never gets two rows."""
    daily = meetings.filter(filled(F.col("person_key")) & F.col("date").isNotNull()).groupBy(
        "tenant_id", F.col("person_key").alias("email"), F.col("date").alias("day")).agg(
        F.sum("meetings_attended").cast("bigint").alias("meetings_count"), (F.sum(longest_modality()) / F.lit(3600.0)).alias("__hours"))
    planned = latest_by(
        hours.select("tenant_id", F.lower("email").alias("email"), F.col("working_hours_per_day").alias("__plan"), "ingested_at", "unique_key"),
        ["tenant_id", "email"], ["ingested_at"], ["unique_key"]).drop("ingested_at", "unique_key")
    rows = daily.join(planned, ["tenant_id", "email"], "left").withColumn(
        "working_hours_per_day", F.coalesce("__plan", F.lit(fixed.DEFAULT_WORKING_HOURS)))
    spent, plan = F.col("__hours"), F.col("working_hours_per_day")
    return rows.select(
        "tenant_id", "email", "day", unique_key("tenant_id", "email", "day").alias("unique_key"), "meetings_count",
        rounded(spent, 4).alias("meeting_hours"), "working_hours_per_day",
        rounded(clamp(F.lit(100.0) - spent / F.nullif(plan, F.lit(0.0)) * 100.0, low=0.0), 2).alias("focus_time_pct"),
        rounded(clamp(plan - spent, low=0.0), 4).alias("dev_time_h"))
