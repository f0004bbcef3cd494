"""Data-quality checks (C1-C19). A check returns the violating rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from workmart.functions.scalars import filled
from workmart.operators.reshape import union_all

ISSUE_EVENT = ["source_id", "data_source", "issue_id", "field_id", "event_id"]


@dataclass(frozen=True)
class Check:
    name: str
    domain: str
    category: str
    tier: str
    violations: DataFrame


def run_checks(checks: Sequence[Check]) -> DataFrame:
    """check, domain, category, tier, violations: one row per check, one job."""
    counted = [
        c.violations.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(c.name).alias("check"), F.lit(c.domain).alias("domain"), F.lit(c.category).alias("category"),
            F.lit(c.tier).alias("tier"), "violations") for c in checks]
    return union_all(counted)


def sample(violations: DataFrame, rows: int = 100) -> DataFrame:
    """A bounded look at the violations for a report (L4)."""
    return violations.limit(rows)


# --- generic (C19) --------------------------------------------------------------

def not_null(df: DataFrame, *columns: str) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return df.filter(bad)


def unique(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def orphans(df: DataFrame, parents: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose reference does not resolve."""
    return df.join(parents.select(*on).distinct(), list(on), "left_anti")


# --- meetings and people ----------------------------------------------------------

def one_source_per_data_source(meetings: DataFrame) -> DataFrame:  # C1
    named = meetings.filter(filled(F.col("source_id")))
    return named.groupBy("tenant_id", "data_source").agg(
        F.count_distinct("source_id").alias("distinct_source_ids")).filter("distinct_source_ids > 1")


def unique_person_day(meetings: DataFrame) -> DataFrame:  # C2
    return unique(meetings.filter(filled(F.col("person_key"))), "tenant_id", "person_key", "date", "data_source")


def duration_caps(meetings: DataFrame) -> DataFrame:  # C3
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return meetings.filter((zero("video_duration_seconds") > zero("audio_duration_seconds"))
                           | (zero("screen_share_duration_seconds") > zero("audio_duration_seconds")))


def kpi_bounds(kpis: DataFrame) -> DataFrame:  # C4
    low = lambda c: F.coalesce(F.col(c) < 0, F.lit(False))
    return kpis.filter(low("focus_time_pct") | F.coalesce(F.col("focus_time_pct") > 100, F.lit(False))
                       | low("tasks_closed") | low("bugs_fixed") | low("ai_sessions"))


def working_hours_bounds(focus: DataFrame) -> DataFrame:  # C5
    return focus.filter((F.col("working_hours_per_day") <= 0) | (F.col("working_hours_per_day") > 24))


# --- issue history ------------------------------------------------------------------

def untraced_changes(history: DataFrame, items: DataFrame) -> DataFrame:  # C6
    rows = history.filter((F.col("data_source") == "jira") & (F.col("event_kind") == "changelog"))
    known = items.select("source_id", "id_readable", F.col("changelog_id").alias("event_id"), "field_id")
    return orphans(rows, known, ["source_id", "id_readable", "event_id", "field_id"])


def action_fits_cardinality(history: DataFrame) -> DataFrame:  # C7
    single, multi = F.col("field_cardinality") == "single", F.col("field_cardinality") == "multi"
    action = F.col("delta_action")
    return history.filter((F.col("event_kind") == "changelog") & (
        (single & ~action.isin("set")) | (multi & ~action.isin("set", "add", "remove"))))


def kind_fits_event_id(history: DataFrame) -> DataFrame:  # C8
    initial = F.col("event_id").startswith("initial:")
    return history.filter(((F.col("event_kind") == "synthetic_initial") & ~initial)
                          | ((F.col("event_kind") == "changelog") & initial))


def initial_is_earliest(history: DataFrame, slack_seconds: int = 60) -> DataFrame:  # C9
    first = lambda kind: F.min(F.when(F.col("event_kind") == kind, F.col("event_at")))
    per_key = history.groupBy("source_id", "data_source", "issue_id", "field_id").agg(
        first("synthetic_initial").alias("first_initial"), first("changelog").alias("first_changelog"))
    return per_key.filter(F.col("first_initial") > F.col("first_changelog") + F.expr(f"interval {int(slack_seconds)} seconds"))


def untraced_initials(history: DataFrame, issues: DataFrame) -> DataFrame:  # C10
    rows = history.filter((F.col("data_source") == "jira") & (F.col("event_kind") == "synthetic_initial"))
    return orphans(rows, issues, ["source_id", "id_readable"])


def comma_lists(history: DataFrame) -> DataFrame:  # C11
    return history.filter((F.col("field_cardinality") == "multi") & F.exists("value_displays", lambda v: v.contains(", ")))


def repeated_items(history: DataFrame) -> DataFrame:  # C12
    return history.filter(F.size("value_ids") != F.size(F.array_distinct("value_ids")))


def repeated_rows(history: DataFrame) -> DataFrame:  # C13
    return unique(history, "source_id", "data_source", "id_readable", "field_id", "event_id")


def single_values(history: DataFrame) -> DataFrame:  # C14
    return history.filter((F.col("field_cardinality") == "single") & (F.size("value_ids") > 1))


def paired_arrays(history: DataFrame) -> DataFrame:  # C15
    return history.filter(F.size("value_ids") != F.size("value_displays"))


def one_id_type_per_field(history: DataFrame) -> DataFrame:  # C16
    return history.groupBy("source_id", "data_source", "field_id").agg(
        F.array_sort(F.collect_set("value_id_type")).alias("observed_types")).filter(F.size("observed_types") > 1)


# --- wiki -----------------------------------------------------------------------------

def _replies(footer: DataFrame, inline: DataFrame) -> DataFrame:
    return footer.withColumn("kind", F.lit("footer_reply")).unionByName(
        inline.withColumn("kind", F.lit("inline_reply")), allowMissingColumns=True)


def replies_without_page(footer: DataFrame, inline: DataFrame) -> DataFrame:  # C17
    return _replies(footer, inline).filter(~F.coalesce(filled(F.col("page_id")), F.lit(False)))


def replies_without_parent(footer: DataFrame, inline: DataFrame, footer_comments: DataFrame,
                           inline_comments: DataFrame) -> DataFrame:  # C18
    replies = _replies(footer, inline).filter(filled(F.col("parent_comment_id")))
    keys = ["tenant_id", "source_id", "comment_id"]
    parents = footer_comments.select(*keys, F.lit("footer_reply").alias("kind")).unionByName(
        inline_comments.select(*keys, F.lit("inline_reply").alias("kind"))).withColumnRenamed("comment_id", "parent_comment_id")
    return orphans(replies, parents, ["tenant_id", "source_id", "parent_comment_id", "kind"])
