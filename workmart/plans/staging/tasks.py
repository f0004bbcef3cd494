"""Issue tracker -> class_task_*."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from workmart.functions.keys import unique_key
from workmart.functions.scalars import flag, millis, moment, number, text
from workmart.operators.issues import current_fields, explode_changelog, field_history, issue_ids, value_id_type
from workmart.operators.latest import latest_by
from workmart.plans.registry import Landed, feeds
from workmart.plans.staging.shape import KEYS, shape, truth, version
from workmart.session import store


def _by_record(t: Landed, table: str) -> DataFrame:
    """Drop records that were landed twice."""
    return latest_by(t(table), ["unique_key"], ["_extracted_at"])


@feeds("class_task_comments", "jira", "bronze_jira.jira_comments")
def jira_comments(t: Landed) -> DataFrame:
    return shape(_by_record(t, "bronze_jira.jira_comments"), *KEYS, "comment_id", "id_readable", "body",
                 author_id=F.col("author_account_id"), created_at=moment("created"), updated_at=moment("updated"),
                 is_deleted=F.lit(0), data_source=F.lit("jira"), _version=millis(t.as_of))


@feeds("class_task_worklogs", "jira", "bronze_jira.jira_worklogs")
def jira_worklogs(t: Landed) -> DataFrame:
    return shape(_by_record(t, "bronze_jira.jira_worklogs"), *KEYS, "worklog_id", "id_readable",
                 author_id=F.col("author_account_id"), work_date=moment("started"), duration_seconds=number("time_spent_seconds"),
                 description=F.col("comment"), collected_at=moment("collected_at"), data_source=F.lit("jira"), _version=millis(t.as_of))


@feeds("class_task_field_metadata", "jira", "bronze_jira.jira_fields")
def jira_fields(t: Landed) -> DataFrame:
    kind, items = text("schema_type"), text("schema_items")
    plain = ((kind == "array") & (items == "string")) | (kind.isin("string", "number", "date", "datetime") & (items == ""))
    return shape(t("bronze_jira.jira_fields"), *KEYS, field_id=text("field_id"), field_name=text("name"),
                 is_multi=flag(kind == "array"), field_type=kind, has_id=flag(~plain), observed_at=F.col("_extracted_at"),
                 data_source=F.lit("jira"), _version=version())


@feeds("class_task_projects", "jira", "bronze_jira.jira_projects")
def jira_projects(t: Landed) -> DataFrame:
    return shape(t("bronze_jira.jira_projects"), *KEYS, "project_key", "name", "project_type",
                 project_id=F.col("project_id").cast("string"), project_style=F.col("style"),
                 archived=flag(truth("archived")), collected_at=t.as_of, data_source=F.lit("jira"), _version=millis(t.as_of))


@feeds("class_task_sprints", "jira", "bronze_jira.jira_sprints")
def jira_sprints(t: Landed) -> DataFrame:
    return shape(t("bronze_jira.jira_sprints"), *KEYS, "sprint_name", "state", sprint_id=F.col("sprint_id").cast("string"),
                 board_id=F.col("board_id").cast("string"), start_date=moment("start_date"), end_date=moment("end_date"),
                 complete_date=moment("complete_date"), collected_at=t.as_of, data_source=F.lit("jira"), _version=millis(t.as_of))


@feeds("class_task_users", "jira", "bronze_jira.jira_user")
def jira_users(t: Landed) -> DataFrame:
    active = F.col("active").cast("string").try_cast("boolean").cast("bigint")
    return shape(t("bronze_jira.jira_user"), *KEYS, "email", "display_name", "account_type", user_id=F.col("account_id"),
                 is_active=active, collected_at=F.col("_extracted_at"), data_source=F.lit("jira"), _version=version())


def jira_field_history(t: Landed, previous: DataFrame | None = None) -> DataFrame:
    """Issue snapshot + change log + field metadata -> field history."""
    fields = latest_by(jira_fields(t), ["source_id", "field_id"], ["_version"], ["unique_key"])
    meta = fields.select("source_id", "field_id", "field_name", (F.col("is_multi") == 1).alias("is_multi"),
                         value_id_type(F.col("field_id"), F.col("has_id") == 1).alias("value_id_type"))
    snapshot = current_fields(t("bronze_jira.jira_issue"))
    items = explode_changelog(t("bronze_jira.jira_issue_history"))
    ids = issue_ids(t("bronze_jira.jira_issue"))
    events = items.join(ids, ["source_id", "id_readable"]).select(
        "source_id", "issue_id", "id_readable", "changelog_id", F.col("created_at").alias("event_at"),
        F.xxhash64("unique_key").alias("event_no"), F.col("author_account_id").alias("author_id"), "field_id",
        "value_from", "value_from_string", "value_to", "value_to_string")
    return field_history(snapshot, events, meta, previous)


@feeds("class_task_field_history", "jira", "bronze_jira.jira_issue", "bronze_jira.jira_issue_history", "bronze_jira.jira_fields")
def jira_history_class(t: Landed) -> DataFrame:
    # Stored, so that what the history shuffled is gone before its rows are, and the tenants have a known, small size.
    rows = store(jira_field_history(t))
    tenant = store(t("bronze_jira.jira_issue").groupBy("source_id").agg(F.max("tenant_id").alias("tenant_id")))
    return rows.join(tenant, "source_id", "left").select(
        "*", unique_key("source_id", "issue_id", "field_id", "event_id", "_seq").alias("unique_key"), F.lit("jira").alias("data_source"),
        t.as_of.alias("collected_at"), millis(t.as_of).alias("_version"))


