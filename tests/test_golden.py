"""End-to-end rows with published results."""

from datetime import date, datetime

from workmart.plans import metrics
from workmart.plans.gold import Gold

EMPLOYEES = "id, status, firstName, lastName, displayName, workEmail, department, division, jobTitle, supervisorEmail, supervisor, _extracted_at timestamp"
AT = datetime(2026, 1, 1)


def _alice(**more):
    return dict(id="e001", status="Active", displayName="Alice Alpha", workEmail="alice@example.com", department="Engineering",
                jobTitle="Senior Software Engineer", supervisorEmail="bob@example.com", _extracted_at=AT) | more


def test_people(spark, table):
    employees = table(
        EMPLOYEES, _alice(displayName="Old name", _extracted_at=datetime(2025, 1, 1)), _alice(),
        _alice(id="e002", displayName="Bob Beta", workEmail="Bob@example.com", jobTitle="Engineering Manager", supervisorEmail=None),
        _alice(id="e003", displayName="Carol Gamma", workEmail="carol@example.com", department="Design", jobTitle="Junior Designer"),
        _alice(id="e004", workEmail=""))
    rows = Gold(spark, {"bronze_bamboohr.employees": employees}).people.orderBy("person_id").collect()
    assert [(r.person_id, r.display_name, r.job_title, r.status, r.seniority) for r in rows] == [
        ("alice@example.com", "Alice Alpha", "Senior Software Engineer", "Active", "Senior"),
        ("bob@example.com", "Bob Beta", "Engineering Manager", "Active", "Mid"),
        ("carol@example.com", "Carol Gamma", "Junior Designer", "Active", "Junior")]


HISTORY = ("source_id, data_source, issue_id, event_id, event_at timestamp, event_kind, _seq bigint, field_id, delta_action, value_ids array<string>, "
           "value_displays array<string>, _version bigint")


def test_tasks_closed(spark, table):
    opened, closed = datetime(2026, 1, 10), datetime(2026, 1, 15, 12)
    rows = []
    for issue in ("T-1", "T-2"):
        common = dict(source_id="jira-test", data_source="jira", issue_id=issue, _seq=0, delta_action="set", _version=1)
        initial = dict(common, event_id=f"initial:{issue}", event_at=opened, event_kind="synthetic_initial")
        rows += [dict(initial, field_id="status", value_ids=["open"], value_displays=["Open"]),
                 dict(initial, field_id="assignee", value_ids=["alice-jira-acct"], value_displays=["Alice"]),
                 dict(common, event_id="100", event_at=closed, event_kind="changelog", field_id="status", value_ids=["closed"], value_displays=["Closed"])]
    gold = Gold(spark, {
        "bronze_bamboohr.employees": table(EMPLOYEES, _alice()), "class_task_field_history": table(HISTORY, *rows),
        "class_task_users": table("source_id, user_id, email", dict(source_id="jira-test", user_id="alice-jira-acct", email="alice@example.com")),
        "class_focus_metrics": table(
            "tenant_id, email, day date, unique_key, meetings_count bigint, meeting_hours double, working_hours_per_day double, focus_time_pct double, dev_time_h double",
            dict(email="alice@example.com", day=date(2026, 1, 15), meetings_count=2, meeting_hours=1.0, working_hours_per_day=8.0, focus_time_pct=75.0, dev_time_h=6.0)),
    })
    page = metrics.fetch_page(gold, "ic_kpis", period=("2026-01-01", "2026-01-31"), filters={"person_id": "alice@example.com"})
    assert not page.has_next and len(page.rows) == 1
    got = page.rows[0].asDict()
    assert got == {
        "person_id": "alice@example.com", "tasks_closed": 2.0, "ai_loc_share_pct": 0.0, "ai_sessions": 0.0, "bugs_fixed": 0.0, "build_success_pct": None,
        "focus_time_pct": 75.0, "loc": 0.0, "pr_cycle_time_h": None, "prs_merged": 0.0}
