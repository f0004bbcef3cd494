from datetime import datetime

import pytest
from pyspark.sql import functions as F

from workmart.operators import history, identity, thresholds, tree

PERSON = ("id bigint, value_type, source_type, source_id, tenant_id, value_id, value_full_text, value_effective, person_id, author_person_id, reason, "
          "created_at timestamp")


def _day(n):
    return datetime(2024, 1, n)


def _seen(i, kind, person, day, value_id=None, text=None):
    return dict(id=i, value_type=kind, source_type="hr", source_id="s", tenant_id="t", value_id=value_id, value_full_text=text,
                value_effective=value_id or text, person_id=person, author_person_id="x", reason="", created_at=_day(day))


def test_active_intervals(table):
    log = table("k, at timestamp, on boolean", *[dict(k="a", at=_day(d), on=o) for d, o in ((1, True), (2, True), (3, False), (5, True), (6, None))],
                dict(k="b", at=_day(1), on=False))
    rows = history.active_intervals(log, ["k"], "at", F.col("on")).orderBy("interval_start").collect()
    assert [(r.k, r.interval_start, r.interval_end) for r in rows] == [("a", _day(1), _day(3)), ("a", _day(5), _day(6))]


def test_inactive_child_has_no_current_edge(table):
    persons = table(PERSON, _seen(1, "email", "boss", 1, "Boss@x"), _seen(2, "parent_email", "kid", 2, "boss@X"), _seen(3, "status", "kid", 1, text="Active"),
                    _seen(4, "status", "kid", 9, text="Terminated"), _seen(5, "parent_email", "boss", 1, "boss@x"))
    rows = {(r.child_person_id, r.parent_person_id): (r.valid_from, r.valid_to) for r in identity.org_chart(persons, "me").collect()}
    assert rows == {("kid", "boss"): (_day(2), _day(9)), ("boss", None): (_day(1), None)}


def test_group_is_case_insensitive_and_known_account_wins(table):
    account = "tenant_id, source_type, source_id, source_account_id, latest_email, is_closed boolean"
    one = lambda a, m, closed=False: dict(tenant_id="t", source_type="hr", source_id="s", source_account_id=a, latest_email=m, is_closed=closed)
    profiles = table(account, one("1", "A@x"), one("2", "a@X"), one("3", None), one("4", "gone@x", True), one("5", "b@x"), one("6", "new@x"))
    persons = table(PERSON, _seen(1, "id", "P1", 1, "2"), _seen(2, "email", "P2", 1, "B@X"), _seen(3, "id", "old", 1, "2"), _seen(4, "id", "P1", 2, "2"))
    got = {r.source_account_id: (r.outcome, r.person_id) for r in identity.resolve_persons(profiles, persons).collect()}
    assert got["1"] == got["2"] == ("reused_known", "P1")
    assert got["3"] == ("skipped_no_email", None) and got["4"] == ("skipped_closed", None) and got["5"] == ("linked_by_email", "P2")
    assert got["6"][0] == "minted" and len(got["6"][1]) == 36
    again = {r.source_account_id: r.person_id for r in identity.resolve_persons(profiles, persons).collect()}
    assert again["6"] == got["6"][1]


def test_routing_keeps_long_values(table):
    df = table("t, v", dict(t="email", v="x" * 321), dict(t="email", v="a"), dict(t="job_title", v="y" * 513), dict(t="other", v="z" * 999))
    rows = df.select("t", identity.route_value(F.col("t"), F.col("v")).alias("r")).collect()
    assert [(r.r.value_id, r.r.value_full_text, r.r.value and len(r.r.value)) for r in rows] == [("x" * 321, None, None), ("a", None, None), (None, "y" * 513, None), (None, None, 999)]


@pytest.mark.parametrize("name, first, last", [("Doe, Jane", "Jane", "Doe"), ("Jane van Doe", "Jane", "van Doe"), ("Cher", "Cher", ""), ("  ", "", "")])
def test_name_split(table, name, first, last):
    persons = table(PERSON, _seen(1, "display_name", "p", 1, text=name), _seen(2, "email", "p", 1, "p@x"))
    row = identity.assemble_persons(persons).first()
    assert (row.first_name, row.last_name) == (first, last)


EDGE = "tenant_id, source_type, source_id, child_person_id, parent_person_id, valid_from timestamp, valid_to timestamp"


def _edge(child, parent, since=1, until=None):
    return dict(tenant_id="t", source_type="hr", source_id="s", child_person_id=child, parent_person_id=parent, valid_from=_day(since), valid_to=until and _day(until))


def test_subtree_stops_at_cycles_and_times(table):
    chart = table(EDGE, _edge("a", None), _edge("b", "a"), _edge("c", "b"), _edge("a", "c"), _edge("d", "b", 1, 5), _edge("d", "a", 5))
    now = {r.person_id: (r.parent_person_id, r.depth) for r in tree.subtree(chart, "a", "t", "hr").collect()}
    assert now == {"a": (None, 0), "b": ("a", 1), "d": ("a", 1), "c": ("b", 2)}
    then = {r.person_id: r.depth for r in tree.subtree(chart, "a", "t", "hr", at=F.lit(_day(3))).collect()}
    assert then == {"a": 0, "b": 1, "c": 2, "d": 2}
    assert {r.person_id for r in tree.subtree(chart, "a", "t", "hr", max_depth=0).collect()} == {"a"}


def test_forest_shows_hidden_parents_as_roots(table):
    chart = table(EDGE, _edge("a", None), _edge("b", "a"), _edge("c", "b"), _edge("lone", None))
    grants = table("tenant_id, viewer_person_id, viewed_person_id, valid_from timestamp, valid_to timestamp",
                   dict(tenant_id="t", viewer_person_id="lone", viewed_person_id="b", valid_from=_day(1)),
                   dict(tenant_id="t", viewer_person_id="c", viewed_person_id="a", valid_from=_day(1), valid_to=_day(2)))
    everyone = table("tenant_id, person_id", *[dict(tenant_id="t", person_id=p) for p in ("a", "b", "c", "lone")])
    viewers = everyone.selectExpr("person_id as viewer_person_id")
    visible = tree.visible_set(viewers, grants, everyone, chart, "t", "hr")
    got = {(r.viewer_person_id, r.person_id, r.parent_person_id) for r in tree.forest(visible, chart, "t", "hr").collect()}
    assert got == {("lone", "b", None), ("lone", "c", "b"), ("a", "a", None), ("a", "b", "a"), ("a", "c", "b"), ("b", "b", None), ("b", "c", "b")}


def test_lock_stops_narrower_scopes(table):
    catalog = table("metric_key, is_enabled boolean", dict(metric_key="m", is_enabled=True), dict(metric_key="n", is_enabled=True), dict(metric_key="off", is_enabled=False))
    line = "metric_key, scope, tenant_id, role_slug, team_id, good double, warn double, alert_trigger double, alert_bad double, is_locked boolean"
    row = lambda m, s, good, locked=False: dict(metric_key=m, scope=s, tenant_id="t", role_slug="dev", team_id="x", good=good, is_locked=locked)
    rows = table(line, row("m", "product-default", 1.0), row("m", "tenant", 2.0, True), row("m", "team", 3.0), row("n", "product-default", 4.0), row("n", "team+role", 5.0),
                 row("off", "product-default", 6.0), row("n", "galaxy", 7.0))
    contexts = table("tenant_id, role_slug, team_id", dict(tenant_id="t", role_slug="dev", team_id="x"), dict(tenant_id="t2", role_slug="dev", team_id="x"))
    got = {(r.tenant_id, r.metric_key): (r.good, r.scope, r.bounded_by_lock) for r in thresholds.resolve_thresholds(catalog, rows, contexts).collect()}
    assert got == {("t", "m"): (2.0, "tenant", True), ("t", "n"): (5.0, "team+role", False), ("t2", "m"): (1.0, "product-default", False),
                   ("t2", "n"): (4.0, "product-default", False)}


def test_match_candidates_rules_actions_and_odd_rows(table):
    from workmart.operators import matching

    accounts = table("tenant_id, source_type, account_id, email, username, employee_id, display_name, extra",
                     {"tenant_id": "t", "source_type": "hr", "account_id": "a1", "email": "Ann.Lee+x@ACME.io "},
                     {"tenant_id": "t", "source_type": "git", "account_id": "a2", "username": "ann.lee"},
                     {"tenant_id": "t", "source_type": "hr", "account_id": "a3", "email": "bo@acme.com", "display_name": "Bo  Smith!"},
                     {"tenant_id": "t", "source_type": "hr", "account_id": "a4", "email": " ", "username": "", "display_name": "Zed Quux"},
                     {"tenant_id": "t", "source_type": "hr", "account_id": "a5", "display_name": "Bo Smyth"},
                     {"tenant_id": "t", "source_type": "hr", "account_id": "a6", "employee_id": "E1"})
    known = table("tenant_id, person_id, source_type, email, username, employee_id, display_name",
                  {"tenant_id": "t", "person_id": "p1", "source_type": "hr", "email": "ann.lee@acme.com", "employee_id": "E1"},
                  {"tenant_id": "t", "person_id": "p1", "source_type": "hr", "email": "ann.lee@acme.com", "employee_id": "E1"},
                  {"tenant_id": "t", "person_id": "p2", "source_type": "hr", "email": "bo@acme.com", "display_name": "Bo Smith"},
                  {"tenant_id": "t", "person_id": "p3", "source_type": "hr", "display_name": "bo smith"},
                  {"tenant_id": "t", "person_id": "p4", "source_type": "hr", "employee_id": "E1"})
    got = {(r.account_id, r.person_id): (r.condition_type, r.confidence, r.action) for r in matching.match_candidates(accounts, known, {"acme.io": "acme.com"}).collect()}
    assert got[("a1", "p1")] == ("email_domain_alias", 0.92, "suggest")
    assert got[("a2", "p1")] == ("email_to_username", 0.72, "suggest")
    assert got[("a3", "p2")] == ("email_exact", 1.0, "auto_link")
    assert got[("a3", "p3")] == ("name_edit", 0.75, "suggest")  # equal normal names never link by themselves
    assert got[("a4", None)] == (None, 0.0, "pending")
    assert got[("a5", "p2")] == ("name_edit", 0.75, "suggest")
    assert got[("a6", "p1")] == ("hr_id_match", 1.0, "suggest") and got[("a6", "p4")][2] == "suggest"  # two persons reach 1.0: no link
    assert len(got) == 9  # a5 is near both p2 and p3
    assert matching.match_candidates(accounts.limit(0), known).count() == 0
