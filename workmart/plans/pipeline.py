"""The batch path: landed tables -> classes -> gold, stored as Parquet."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

import workmart.plans.staging  # noqa: F401  (registers the models)
from workmart.operators import quality
from workmart.operators.issues import explode_changelog
from workmart.plans.gold import Gold
from workmart.plans.registry import MODELS, Landed, build_class
from workmart.plans.staging.wiki import CONFLUENCE_COMMENTS
from workmart.sources.sinks import write_table

# Views read by many others: stored once per run.
STORED = ("people", "task_issue_current_state", "task_status_intervals", "git_totals", "git_weekly", "focus")


def build_classes(tables: Landed, target: str, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Write every class that has a source, and read it back."""
    done = {}
    for cls in names or MODELS:
        if any(tables.has(*m.needs) for m in MODELS[cls]):
            write_table(build_class(cls, tables), f"{target}/{cls}")
            done[cls] = tables.spark.read.parquet(f"{target}/{cls}")
    return done


def run(tables: Landed, target: str) -> Gold:
    """Classes and shared views of one run."""
    classes = build_classes(tables, f"{target}/silver")
    extra = {n: tables.newest(n) for n in ("bronze_bamboohr.employees", "bronze_jira.jira_issue") if tables.has(n)}
    gold = Gold(tables.spark, {**classes, **extra}, tables.as_of, materialize=False)
    for name in STORED:
        write_table(getattr(gold, name), f"{target}/gold/{name}")
        gold.__dict__[name] = tables.spark.read.parquet(f"{target}/gold/{name}")
    # Histogram, cohorts and trend all read the stacked sections. Without rows there is no file to take the columns from.
    sections = gold._sections
    write_table(sections, f"{target}/gold/sections", ["section_id"])
    gold.__dict__["_sections"] = tables.spark.read.schema(sections.schema).parquet(f"{target}/gold/sections")
    return gold


def checks(gold: Gold, tables: Landed | None = None) -> list[quality.Check]:
    """The checks of a run: C1-C16 without C6 and C10; these, C17 and C18 compare with landed tables and run where they are given."""
    meetings, history = gold.cls("class_collab_meeting_activity"), gold.cls("class_task_field_history")
    named = lambda name, domain, category, tier, rows: quality.Check(name, domain, category, tier, rows)
    found = [
        named("one_source_per_data_source", "collaboration", "consistency", "silver", quality.one_source_per_data_source(meetings)),
        named("unique_person_day", "collaboration", "uniqueness", "silver", quality.unique_person_day(meetings)),
        named("duration_caps", "collaboration", "validity", "silver", quality.duration_caps(meetings)),
        named("kpi_bounds", "gold", "validity", "gold", quality.kpi_bounds(gold.ic_kpis)),
        named("working_hours_bounds", "hr", "validity", "silver", quality.working_hours_bounds(gold.focus)),
        named("action_fits_cardinality", "task", "validity", "silver", quality.action_fits_cardinality(history)),
        named("kind_fits_event_id", "task", "validity", "silver", quality.kind_fits_event_id(history)),
        named("initial_is_earliest", "task", "consistency", "silver", quality.initial_is_earliest(history)),
        named("comma_lists", "task", "validity", "silver", quality.comma_lists(history)),
        named("repeated_items", "task", "uniqueness", "silver", quality.repeated_items(history)),
        named("repeated_rows", "task", "uniqueness", "silver", quality.repeated_rows(history)),
        named("single_values", "task", "validity", "silver", quality.single_values(history)),
        named("paired_arrays", "task", "consistency", "silver", quality.paired_arrays(history)),
        named("one_id_type_per_field", "task", "consistency", "silver", quality.one_id_type_per_field(history)),
    ]
    changes, snapshots = "bronze_jira.jira_issue_history", "bronze_jira.jira_issue"
    if tables and tables.has(changes, snapshots):
        found += [
            named("untraced_changes", "task", "consistency", "silver", quality.untraced_changes(history, explode_changelog(tables(changes)))),
            named("untraced_initials", "task", "consistency", "silver", quality.untraced_initials(history, tables(snapshots))),
        ]
    comments = [f"bronze_confluence.{name}" for name in CONFLUENCE_COMMENTS]
    if tables and tables.has(*comments):
        footer, footer_replies, inline, inline_replies = map(tables.newest, comments)
        found += [
            named("replies_without_page", "wiki", "validity", "bronze", quality.replies_without_page(footer_replies, inline_replies)),
            named("replies_without_parent", "wiki", "consistency", "bronze", quality.replies_without_parent(footer_replies, inline_replies, footer, inline)),
        ]
    return found
