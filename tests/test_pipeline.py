"""Landed tables to metrics in one run, on the smallest given tables."""

import os

import pytest

from proving.given import Given
from proving.staging import _employees, _enterprise, _jira, _teams, _workers
from workmart.operators.quality import run_checks
from workmart.plans import metrics, pipeline
from workmart.plans.gold import Gold
from workmart.plans.registry import Landed

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="given tables are not here")
def test_run(spark, tmp_path):
    g = Given(spark, FOLDER)
    tables = {"bronze_bamboohr.employees": _employees(g), **_teams(g).tables, **_enterprise(g).tables}
    gold = pipeline.run(Landed(spark, tables, g.as_of), str(tmp_path))
    assert gold.people.count() == g.customer.count()
    page = metrics.fetch_page(gold, "person_collaboration", top=5, period=("2024-01-01", "2024-01-31"), orderby=["person_id", "metric_key"])
    assert len(page.rows) == 5 and page.has_next
    broken = {r["check"]: r.violations for r in run_checks(pipeline.checks(gold)).collect()}
    assert len(broken) == 14 and broken["unique_person_day"] == 0 and broken["kpi_bounds"] == 0


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="given tables are not here")
def test_run_without_bamboohr(spark, tmp_path):
    g = Given(spark, FOLDER)
    site = Landed(spark, {**_workers(g).tables, **_jira(g).tables}, g.as_of)
    gold = pipeline.run(site, str(tmp_path))
    assert gold.people.count() == g.customer.count()
    assert gold.people.filter("supervisor_email is not null").count() > 0
    broken = {r["check"]: r.violations for r in run_checks(pipeline.checks(gold, site)).collect()}
    assert len(broken) == 16 and broken["untraced_changes"] == 0 and broken["untraced_initials"] == 0


def test_no_jira_is_no_issue(spark):
    assert Gold(spark, {}, materialize=False).jira_person_daily.count() == 0


def test_page_sizes():
    assert [metrics.page_size(n) for n in (None, 7, 200)] == [25, 7, 200]
    for n in (0, 201, 999):
        with pytest.raises(ValueError):
            metrics.page_size(n)
