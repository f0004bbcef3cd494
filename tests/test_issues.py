"""Delta rules, folds and states of issue fields."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from workmart.operators import issues

ITEM = "value_from, value_from_string, value_to, value_to_string, is_multi boolean"
T0 = datetime(2024, 1, 1)


def _delta(table, **row):
    got = issues.to_delta(table(ITEM, row)).collect()
    if not got:
        return None
    pairs = lambda values: [(v["id"], v["display"]) for v in values]
    return got[0].kind, pairs(got[0].before), pairs(got[0].after)


@pytest.mark.parametrize("row, expected", [
    (dict(value_from="1", value_from_string="To Do", value_to="3", value_to_string="Done", is_multi=False), ("set", [("1", "To Do")], [("3", "Done")])),
    (dict(value_from="a, b", value_from_string="a, b", value_to="c, d, e", value_to_string="c, d, e", is_multi=False),
     ("set", [("a, b", "a, b")], [("c, d, e", "c, d, e")])),
    (dict(value_from=None, value_to=None, is_multi=False), ("set", [], [])),
    (dict(value_to="backend", value_to_string="backend", is_multi=True), ("add", [], [("backend", "backend")])),
    (dict(value_from="urgent", value_from_string="urgent", is_multi=True), ("remove", [("urgent", "urgent")], [])),
    (dict(value_from="8066, 8363", value_from_string="A, B", value_to="8066, 8363, 8364", value_to_string="A, B, C", is_multi=True),
     ("snapshot", [("8066", "A"), ("8363", "B")], [("8066", "A"), ("8363", "B"), ("8364", "C")])),
    (dict(value_to="8066", value_to_string="HCI - 26", is_multi=True), ("add", [], [("8066", "HCI - 26")])),
    (dict(value_from_string="A, B, C", value_to_string="A, C", is_multi=True), ("snapshot", [("A", "A"), ("B", "B"), ("C", "C")], [("A", "A"), ("C", "C")])),
    (dict(value_from_string="HCI - 26, HCI - 27", is_multi=True), ("snapshot", [("HCI - 26",) * 2, ("HCI - 27",) * 2], [])),
    (dict(is_multi=True), None),
])
def test_to_delta(table, row, expected):
    assert _delta(table, **row) == expected


EVENT = ("source_id, issue_id, id_readable, changelog_id, event_at timestamp, event_no bigint, author_id, field_id, "
         "value_from, value_from_string, value_to, value_to_string")
SNAPSHOT = "source_id, issue_id, id_readable, created_at timestamp, reporter_id, field_id, current array<struct<id:string,display:string>>"
META = "source_id, field_id, field_name, is_multi boolean, value_id_type"


def _event(i, field, hours, issue="1", **sides):
    return dict(source_id="s", issue_id=issue, id_readable=f"T-{issue}", changelog_id=f"{i:05d}", event_at=T0 + timedelta(hours=hours), event_no=i, author_id="u",
                field_id=field, **sides)


def _now(field, *values, issue="1"):
    return dict(source_id="s", issue_id=issue, id_readable=f"T-{issue}", created_at=T0, reporter_id="r", field_id=field, current=[(v, v) for v in values])


@pytest.fixture(scope="module")
def meta(table):
    return table(META, dict(source_id="s", field_id="status", field_name="Status", is_multi=False, value_id_type="opaque_id"),
                 dict(source_id="s", field_id="labels", field_name="Labels", is_multi=True, value_id_type="string_literal"))


def _rows(df):
    return {(r.issue_id, r.field_id, r.event_id): r for r in df.collect()}


def test_bootstrap_shows_the_original_value(table, meta):
    snapshot = table(SNAPSHOT, _now("status", "3"), _now("labels", "x", "y"), _now("due_date"), _now("custom", "c1", "c2"))
    events = table(EVENT, _event(1, "status", 1, value_from="1", value_from_string="Open", value_to="2", value_to_string="Doing"),
                   _event(2, "status", 2, value_from="2", value_from_string="Doing", value_to="3"), _event(3, "labels", 3, value_to="y", value_to_string="y"),
                   _event(4, "unknown", 4, value_to="?"))
    rows = _rows(issues.field_history(snapshot, events, meta))
    initial = {f: rows["1", f, "initial:1"] for f in ("status", "labels", "due_date", "custom")}
    assert initial["status"].value_displays == ["Open"] and initial["labels"].value_ids == ["x"]
    assert initial["due_date"].value_ids == [] and initial["due_date"].value_id_type == "none"
    assert initial["custom"].field_cardinality == "multi" and initial["status"].field_cardinality == "single"
    assert [initial[f]._seq for f in ("custom", "due_date", "labels", "status")] == [0, 1, 2, 3]
    assert rows["1", "status", "00002"].value_displays == ["3"] and rows["1", "labels", "00003"].value_ids == ["x", "y"]
    assert ("1", "unknown", "00004") not in rows and len(rows) == 7


def test_snapshot_only_and_idempotent_add(table, meta):
    snapshot = table(SNAPSHOT, _now("labels", "a"), _now("status", "1", issue="2"))
    events = table(EVENT, _event(1, "labels", 1, value_to="a"), _event(2, "labels", 2, value_to="a"))
    rows = _rows(issues.field_history(snapshot, events, meta))
    assert rows["2", "status", "initial:2"].value_ids == ["1"]
    assert rows["1", "labels", "00002"].value_ids == ["a"] and rows["1", "labels", "initial:1"].value_ids == []


def test_incremental_equals_full_and_late_events_are_dropped(table, meta):
    snapshot = table(SNAPSHOT, _now("labels", "b", "c"), _now("status", "2"))
    first = [_event(1, "labels", 1, value_to="a"), _event(2, "labels", 2, value_to="b"), _event(3, "status", 3, value_from="1", value_to="2")]
    later = [_event(4, "labels", 4, value_from="a"), _event(5, "labels", 5, value_to="c")]
    full = _rows(issues.field_history(snapshot, table(EVENT, *first, *later), meta))
    then = table(SNAPSHOT, _now("labels", "a", "b"), _now("status", "2"))
    done = issues.field_history(then, table(EVENT, *first), meta)
    late = _event(9, "labels", 2.5, value_to="late")
    new = _rows(issues.field_history(snapshot, table(EVENT, *first, late, *later), meta, done))
    assert set(new) == {("1", "labels", "00004"), ("1", "labels", "00005")}
    for key, row in new.items():
        assert row.value_ids == full[key].value_ids


@pytest.mark.parametrize("block", [2, 3, 128])
def test_fold_against_brute_force(table, meta, monkeypatch, block):
    """Long logs are folded in blocks; the size of a block must not show."""
    monkeypatch.setattr(issues, "BLOCK", block)
    rnd = random.Random(block)
    names = "abcde"
    events, expected, start = [], {}, {}
    now_rows = []
    for issue in ("1", "2", "3"):
        state = rnd.sample(names, rnd.randrange(0, 3))
        start[issue] = list(state)
        for i in range(rnd.choice([1, 13, 29])):
            number = int(issue) * 1000 + i
            kind = rnd.choice(["add", "remove", "snapshot"])
            if kind == "snapshot":
                new = rnd.sample(names, rnd.choice([0, 2, 3]))
                old = state if len(state) > 1 or len(new) > 1 else ["p", "q"]
                events.append(_event(number, "labels", i, issue, value_from_string=", ".join(old) or None, value_to_string=", ".join(new) or None))
                if not any(", " in (events[-1].get(c) or "") for c in ("value_from_string", "value_to_string")):
                    events.pop()
                    continue
                if old is not state:
                    events.pop()
                    continue
                state = new
            elif kind == "add":
                name = rnd.choice([n for n in names if n not in state] or ["z"])
                events.append(_event(number, "labels", i, issue, value_to=name, value_to_string=name))
                state = state + [name]
            elif state:
                name = rnd.choice(state)
                events.append(_event(number, "labels", i, issue, value_from=name, value_from_string=name))
                state = [s for s in state if s != name]
            else:
                continue
            expected[issue, f"{number:05d}"] = list(state)
        now_rows.append(_now("labels", *state, issue=issue))
    rows = issues.field_history(table(SNAPSHOT, *now_rows), table(EVENT, *events), meta).collect()
    for r in rows:
        if r.event_kind == "changelog":
            assert sorted(r.value_ids) == sorted(expected[r.issue_id, r.event_id]), (r.issue_id, r.event_id)
        else:
            assert sorted(r.value_ids) == sorted(start[r.issue_id])
    assert len(rows) == len(expected) + 3


def test_day_split_keeps_all_seconds(spark):
    rows = [(i, T0 + timedelta(hours=7 * i), T0 + timedelta(hours=7 * i + 13 * (i % 5))) for i in range(20)]
    df = spark.createDataFrame(rows, "id bigint, s timestamp, e timestamp")
    split = issues.split_by_day(df, "s", "e").groupBy("id").agg(F.sum("seconds").alias("seconds"))
    assert {r.id: r.seconds for r in split.collect()} == {i: (e - s).total_seconds() for i, s, e in rows}
