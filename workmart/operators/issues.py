"""Event-sourced issue history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from workmart.functions import fixed
from workmart.functions.keys import unique_key
from workmart.functions.scalars import (
    blank_to_null, filled, first_item, json_text, moment, number, seconds_between, text,
)
from workmart.operators.latest import latest_by
from workmart.operators.ordered import with_near_neighbours, with_position
from workmart.session import store

VALUES = "array<struct<id:string,display:string>>"
ISSUE = ["source_id", "issue_id"]
FIELD = [*ISSUE, "field_id"]

# An issue field may hold any number of events. They are folded in blocks of
# this size, and blocks of blocks, so that no array grows with the log.
BLOCK = 128


# --- landed JSON -> current fields and change items -------------------------

def current_fields(issues: DataFrame) -> DataFrame:
    """Current value of ten fields of each issue, from its JSON (H7)."""
    newest = latest_by(issues, ["source_id", "jira_id"], ["_extracted_at"], ["unique_key"])
    doc = "custom_fields_json"

    def pair(field: str, id_: Column, display: Column) -> Column:
        one = F.array(F.struct(id_.alias("id"), display.alias("display")))
        return F.struct(F.lit(field).alias("field_id"),
                        F.when(filled(id_), one).otherwise(F.array().cast(VALUES)).alias("current"))

    named = [pair(f, json_text(doc, f, "id"), json_text(doc, f, "name"))
             for f in ("status", "priority", "issuetype", "resolution")]
    people = [pair(f, json_text(doc, f, "accountId"), json_text(doc, f, "displayName"))
              for f in ("assignee", "reporter")]
    plain = [pair(f, F.col(c).cast("string"), F.col(c).cast("string"))
             for f, c in (("project", "project_key"), ("parent", "parent_id"), ("due_date", "due_date"))]
    labels = F.transform(
        F.coalesce(F.from_json(F.get_json_object(doc, "$.labels"), "array<string>"), F.array().cast("array<string>")),
        lambda x: F.struct(F.coalesce(x, F.lit("")).alias("id"), F.coalesce(x, F.lit("")).alias("display")))
    many = F.struct(F.lit("labels").alias("field_id"), labels.alias("current"))
    rows = newest.select(
        text("source_id").alias("source_id"), text("jira_id").alias("issue_id"), text("id_readable").alias("id_readable"),
        F.coalesce(moment("created"), F.timestamp_seconds(F.lit(0))).alias("created_at"),
        F.nullif(json_text(doc, "reporter", "accountId"), F.lit("")).alias("reporter_id"),
        F.inline(F.array(*named, *people, *plain, many)),
    )
    return rows.withColumn("unique_key", unique_key("source_id", "issue_id", "field_id"))


def issue_ids(issues: DataFrame) -> DataFrame:
    """source_id, id_readable, issue_id of `current_fields`, without its JSON."""
    newest = latest_by(issues, ["source_id", "jira_id"], ["_extracted_at"], ["unique_key"])
    return newest.select(text("source_id").alias("source_id"), text("id_readable").alias("id_readable"),
                         text("jira_id").alias("issue_id")).distinct()


ITEM = "struct<fieldId:string,field:string,`from`:string,fromString:string,`to`:string,toString:string>"


def explode_changelog(history: DataFrame) -> DataFrame:
    """Change log entries with a JSON list of items -> one row per distinct item (H8)."""
    newest = latest_by(history, ["source_id", "changelog_id"], ["_extracted_at"], ["unique_key"])
    rows = newest.select(
        text("source_id").alias("source_id"), "tenant_id", text("id_readable").alias("id_readable"),
        text("changelog_id").alias("changelog_id"),
        F.coalesce(moment("created_at"), F.timestamp_seconds(F.lit(0))).alias("created_at"), "author_account_id",
        F.explode(F.from_json("items", f"array<{ITEM}>")).alias("item"),
    ).filter(filled(F.col("item.fieldId")))
    blank = lambda name: F.nullif(F.col(f"item.{name}"), F.lit(""))
    items = rows.select(
        "source_id", "id_readable", "changelog_id", F.col("item.fieldId").alias("field_id"),
        blank("from").alias("value_from"), blank("fromString").alias("value_from_string"),
        blank("to").alias("value_to"), blank("toString").alias("value_to_string"),
        "tenant_id", "created_at", "author_account_id", text("item.field").alias("field_name"))
    identity = items.columns[:8]
    out = items.groupBy(*identity).agg(*[F.min(c).alias(c) for c in items.columns[8:]])
    return out.withColumn("unique_key", unique_key("source_id", *identity[2:]))


# --- deltas -------------------------------------------------------------------

def _value(id_: Column, display: Column) -> Column:
    return F.struct(id_.alias("id"), F.coalesce(display, id_).alias("display"))


def _one(id_: Column, display: Column) -> Column:
    return F.when(id_.isNull(), F.array().cast(VALUES)).otherwise(F.array(_value(id_, display)))


def _parse_list(raw: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), fixed.LIST_SEPARATOR), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def _listed(ids: Column, displays: Column) -> Column:
    """Pair ids with displays by position; a missing id is its display."""
    parsed = _parse_list(ids)
    return F.transform(_parse_list(displays), lambda shown, i: F.struct(
        F.coalesce(F.get(parsed, i), shown).alias("id"), shown.alias("display")))


def to_delta(items: DataFrame) -> DataFrame:
    """Add `kind`, `before`, `after` to change items (H9). Needs `is_multi`.

    Single-value fields are set. Multi-value fields come as one added or
    removed item, or, in old logs, as whole lists split by ', '. Items of a
    multi-value field with neither side are dropped.
    """
    was, was_text = F.col("value_from"), F.col("value_from_string")
    now, now_text = F.col("value_to"), F.col("value_to_string")
    listed = F.coalesce(was_text.contains(fixed.LIST_SEPARATOR), F.lit(False)) | F.coalesce(
        now_text.contains(fixed.LIST_SEPARATOR), F.lit(False))
    kind = (
        F.when(~F.col("is_multi"), "set").when(listed, "snapshot")
        .when(now.isNotNull(), "add").when(was.isNotNull(), "remove")
    )
    empty = F.array().cast(VALUES)
    out = items.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    return out.withColumn(
        "before", F.when(F.col("kind") == "snapshot", _listed(was, was_text)).when(F.col("kind") == "add", empty)
        .otherwise(_one(was, was_text))
    ).withColumn(
        "after", F.when(F.col("kind") == "snapshot", _listed(now, now_text)).when(F.col("kind") == "remove", empty)
        .otherwise(_one(now, now_text)))


# A change of a multi-value field is (reset, gone, items): forget everything if
# `reset`, drop the ids in `gone`, then append those of `items` not yet there.
# Two changes in a row are one change again, so folds can be done in blocks.

def _change(reset: Column, gone: Column, items: Column) -> Column:
    return F.struct(reset.alias("reset"), gone.cast("array<string>").alias("gone"), items.cast(VALUES).alias("items"))


def _ids(values: Column) -> Column:
    return F.transform(values, lambda v: v.id)


def then(first: Column, second: Column) -> Column:
    """The one change that equals `first` followed by `second`."""
    kept = F.filter(first["items"], lambda v: ~F.array_contains(second["gone"], v["id"]))
    added = F.filter(second["items"], lambda v: ~F.array_contains(_ids(kept), v["id"]))
    both = _change(first["reset"], F.array_union(first["gone"], second["gone"]), F.concat(kept, added))
    return F.when(second["reset"], second).otherwise(both)


def no_change() -> Column:
    return _change(F.lit(False), F.array(), F.array())


def state_as_change(values: Column) -> Column:
    return _change(F.lit(True), F.array(), values)


def forward_change(kind: Column, before: Column, after: Column) -> Column:
    """How an event changes the state."""
    return (
        F.when(kind == "add", _change(F.lit(False), F.array(), after))
        .when(kind == "remove", _change(F.lit(False), _ids(before), F.array()))
        .otherwise(state_as_change(after)))


def reverse_change(kind: Column, before: Column, after: Column) -> Column:
    """How undoing an event changes the state."""
    return (
        F.when(kind == "add", _change(F.lit(False), _ids(after), F.array()))
        .when(kind == "remove", _change(F.lit(False), F.array(), before))
        .otherwise(state_as_change(before)))


def _fold(changes: Column, start: Column) -> Column:
    return F.aggregate(changes, start, then)


EVENT_ORDER = ["event_at", "changelog_id", "event_no"]


def _fold_multi(events: DataFrame, known: DataFrame, forward_only: bool) -> tuple[DataFrame, DataFrame]:
    """States after each event of multi-value fields, and the initial states.

    `known` holds one `current` per field: the state now, which is rolled
    back to the start, or, with `forward_only`, the state before the events.
    A field whose events fit one block is one list; only the others need
    positions, blocks of blocks and the joins between them.
    """
    deep = store(events.groupBy(*FIELD).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select(*FIELD))
    if deep.isEmpty():
        return _fold_lists(events, known, forward_only)
    short = _fold_lists(events.join(deep, FIELD, "left_anti"), known, forward_only)
    long = _fold_blocks(events.join(deep, FIELD, "left_semi"), known, forward_only)
    return short[0].unionByName(long[0]), short[1].unionByName(long[1])


def _started(folded: DataFrame, known: DataFrame, forward_only: bool) -> DataFrame:
    """Add `start`, the state before a field's first event, as a change."""
    base = folded.join(known.select(*FIELD, "current"), FIELD, "left")
    now = state_as_change(F.coalesce("current", F.array().cast(VALUES)))
    return base.withColumn("start", now if forward_only else then(now, F.col("rev")))


def _fold_lists(events: DataFrame, known: DataFrame, forward_only: bool) -> tuple[DataFrame, DataFrame]:
    """Fold fields with at most BLOCK events each; the rows travel in the list, and changes are made of them afterwards."""
    rest = [c for c in events.columns if c not in FIELD]
    entry = lambda row: F.struct(*[row[c].alias(c) for c in EVENT_ORDER], forward_change(row["kind"], row["before"], row["after"]).alias("fwd"),
                                 reverse_change(row["kind"], row["before"], row["after"]).alias("rev"), row.alias("row"))
    rows = events.groupBy(*FIELD).agg(F.collect_list(F.struct(*rest)).alias("list"))
    listed = rows.withColumn("list", F.array_sort(F.transform("list", entry)))
    base = _started(listed.withColumn("rev", _fold(F.transform(F.reverse("list"), lambda e: e["rev"]), no_change())), known, forward_only)
    row = listed.schema["list"].dataType.elementType["row"].dataType.simpleString()
    none = F.array().cast(f"array<struct<row:{row},values:{VALUES}>>")

    def step(acc: Column, e: Column) -> Column:
        state = then(acc["state"], e["fwd"])
        return F.struct(state.alias("state"), F.concat(
            acc["out"], F.array(F.struct(e["row"].alias("row"), state["items"].alias("values")))).alias("out"))

    run = F.aggregate("list", F.struct(F.col("start").alias("state"), none.alias("out")), step)
    after = base.select(*FIELD, F.inline(run["out"])).select(*[F.col(f"row.{c}").alias(c) if c in rest else c for c in events.columns], "values")
    return after, base.select(*FIELD, F.col("start.items").alias("initial"))


def _fold_blocks(events: DataFrame, known: DataFrame, forward_only: bool) -> tuple[DataFrame, DataFrame]:
    """Fold fields with any number of events, in blocks."""
    # Read by the blocks and again for the rows; placing is the dear part.
    placed = store(with_position(events, FIELD, EVENT_ORDER, "pos"))
    placed = placed.withColumn("c0", F.expr(f"(pos - 1) div {BLOCK}")).withColumn("c1", F.expr(f"c0 div {BLOCK}"))
    placed = placed.withColumn("fwd", forward_change(F.col("kind"), F.col("before"), F.col("after")))
    placed = placed.withColumn("rev", reverse_change(F.col("kind"), F.col("before"), F.col("after")))

    def block(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
        listed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "fwd", "rev"))).alias("list"))
        return listed.withColumn("fwd", _fold(F.transform("list", lambda e: e["fwd"]), no_change())).withColumn(
            "rev", _fold(F.transform(F.reverse("list"), lambda e: e["rev"]), no_change()))

    small = block(placed, [*FIELD, "c1", "c0"], "pos")
    large = block(small, [*FIELD, "c1"], "c0")
    whole = block(large, FIELD, "c1")

    base = _started(whole, known, forward_only)

    def starts(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
        """One row per list element with the state before it."""
        step = lambda acc, e: F.struct(
            then(acc["state"], e["fwd"]).alias("state"),
            F.concat(acc["out"], F.array(F.struct(e[order].alias(order), acc["state"].alias("start"),
                                                  then(acc["state"], e["fwd"])["items"].alias("values")))).alias("out"))
        none = F.array().cast("array<struct<%s:bigint,start:struct<reset:boolean,gone:array<string>,items:%s>,values:%s>>"
                              % (order, VALUES, VALUES))
        run = F.aggregate("list", F.struct(F.col("start").alias("state"), none.alias("out")), step)
        return df.select(*keys, F.inline(run["out"]))

    large_start = starts(base, FIELD, "c1").drop("values")
    small_start = starts(large.join(large_start, [*FIELD, "c1"]), [*FIELD, "c1"], "c0").drop("values")
    states = starts(small.join(small_start, [*FIELD, "c1", "c0"]), FIELD, "pos").drop("start")
    after = placed.drop("c0", "c1", "fwd", "rev").join(states, [*FIELD, "pos"]).drop("pos")
    return after, base.select(*FIELD, F.col("start.items").alias("initial"))


def field_history(snapshot: DataFrame, events: DataFrame, meta: DataFrame,
                  previous: DataFrame | None = None) -> DataFrame:
    """Full history of every issue field.

    snapshot: source_id, issue_id, id_readable, created_at, reporter_id,
      field_id, current (the value now).
    events: source_id, issue_id, id_readable, changelog_id, event_at, event_no,
      author_id, field_id, value_from, value_from_string, value_to, value_to_string.
    meta: source_id, field_id, field_name, is_multi, value_id_type.
    previous: an earlier result. Issues in it get only rows for events after
      their last event; the others get an initial row per field as well.
    """
    # A source has a few thousand fields. Stored, the table has a known size, so
    # the planner sends it to the events instead of shuffling them by field.
    meta = store(meta.select("source_id", "field_id", "field_name", "is_multi", "value_id_type"))
    # Read four times below, and mostly parsed from JSON.
    snapshot = store(snapshot)
    issues = store(snapshot.groupBy(*ISSUE).agg(
        F.min("id_readable").alias("id_readable"), F.min("created_at").alias("created_at"),
        F.min("reporter_id").alias("reporter_id")))
    # Read several times too. What this shuffles is deleted once it is stored, so the join with the issues is done here.
    known_events = to_delta(events.drop("field_name").join(meta, ["source_id", "field_id"])).drop("value_from", "value_from_string")
    known_events = store(known_events.join(issues.select(*ISSUE), ISSUE, "left_semi"))
    if previous is None:
        return _histories(snapshot.select(*FIELD, "current"), known_events, meta, issues, with_initial=True)

    marks = previous.groupBy(*ISSUE).agg(F.max("event_at").alias("__mark"))
    fresh = issues.join(marks.select(*ISSUE), ISSUE, "left_anti")
    new_issues = _histories(
        snapshot.join(fresh.select(*ISSUE), ISSUE, "left_semi").select(*FIELD, "current"),
        known_events.join(fresh.select(*ISSUE), ISSUE, "left_semi"), meta, fresh, with_initial=True)

    last = latest_by(previous, FIELD, ["event_at", "_seq", "event_id"]).select(
        *FIELD, F.arrays_zip(F.col("value_ids").alias("id"), F.col("value_displays").alias("display")).cast(VALUES).alias("current"))
    newer = known_events.join(marks, ISSUE).filter(F.col("event_at") > F.col("__mark")).drop("__mark")
    seen = issues.join(marks.select(*ISSUE), ISSUE, "left_semi")
    return new_issues.unionByName(_histories(last, newer, meta, seen, with_initial=False))


def _histories(known: DataFrame, events: DataFrame, meta: DataFrame, issues: DataFrame,
               with_initial: bool) -> DataFrame:
    """`events` are those of `issues`."""
    # A single-value field needs no fold: its state is the event's own value,
    # its initial value is what the first event replaced.
    single = events.filter(~F.col("is_multi"))
    first_before = single.groupBy(*FIELD).agg(F.min_by("before", F.struct(*EVENT_ORDER)).alias("initial"))
    # Only events of several values are folded, so only such fields' states are sent to them. They are `add`, `remove` or
    # `snapshot`, which need no `value_to`.
    several = meta.filter("is_multi").select("source_id", "field_id")
    multi, multi_initial = _fold_multi(events.filter("is_multi").drop("is_multi", "value_to", "value_to_string"),
                                       known.join(several, ["source_id", "field_id"], "left_semi"), forward_only=not with_initial)
    states = single.withColumn("values", F.col("after")).unionByName(multi.withColumn("is_multi", F.lit(True)), allowMissingColumns=True)

    shown = F.when(F.col("kind") == "remove", F.col("before")).otherwise(F.col("after"))
    action = F.when(F.col("kind") == "snapshot", "set").otherwise(F.col("kind"))
    changes = states.select(
        *ISSUE, "id_readable", F.col("changelog_id").alias("event_id"), "event_at",
        F.lit("changelog").alias("event_kind"), F.lit(0).cast("bigint").alias("_seq"), "author_id", "field_id",
        "field_name", F.when(F.col("is_multi"), "multi").otherwise("single").alias("field_cardinality"),
        action.alias("delta_action"),
        F.when(F.col("kind") == "set", F.col("value_to")).otherwise(first_item(shown)["id"]).alias("delta_value_id"),
        F.when(F.col("kind") == "set", F.col("value_to_string")).otherwise(first_item(shown)["display"]).alias("delta_value_display"),
        F.col("values.id").alias("value_ids"), F.col("values.display").alias("value_displays"), "value_id_type")
    if not with_initial:
        return changes

    changed = first_before.unionByName(multi_initial)
    empty = F.array().cast(VALUES)
    # Every field of the snapshot, and those only the log knows.
    fields = known.withColumn("initial", F.lit(None).cast(VALUES)).withColumn("rank", F.lit(0)).unionByName(
        changed.withColumn("current", F.lit(None).cast(VALUES)).withColumn("rank", F.lit(1)))
    # By issue at once: the rows of a field, the join and the numbering below are all within an issue.
    fields = fields.repartition(*ISSUE).groupBy(*FIELD).agg(
        F.max_by("initial", F.when(F.col("rank") == 1, 1)).alias("initial"), F.max("rank").alias("rank"),
        F.max_by("current", F.when(F.col("rank") == 0, 1)).alias("current"))
    fields = fields.withColumn("values", F.coalesce(
        F.when(F.col("rank") == 1, F.col("initial")).otherwise(F.col("current")), empty)).select(*FIELD, "values")
    fields = fields.join(issues, ISSUE).join(meta, ["source_id", "field_id"], "left")
    seq = F.row_number().over(Window.partitionBy(*ISSUE).orderBy("field_id")) - 1
    multi_valued = F.coalesce(F.col("is_multi"), F.size("values") > 1)
    initial = fields.select(
        *ISSUE, "id_readable", F.concat(F.lit("initial:"), "issue_id").alias("event_id"), F.col("created_at").alias("event_at"),
        F.lit("synthetic_initial").alias("event_kind"), seq.cast("bigint").alias("_seq"), F.col("reporter_id").alias("author_id"),
        "field_id", F.coalesce("field_name", "field_id").alias("field_name"),
        F.when(multi_valued, "multi").otherwise("single").alias("field_cardinality"),
        F.when(multi_valued, "add").otherwise("set").alias("delta_action"),
        first_item("values")["id"].alias("delta_value_id"), first_item("values")["display"].alias("delta_value_display"),
        F.col("values.id").alias("value_ids"), F.col("values.display").alias("value_displays"),
        F.coalesce("value_id_type", F.lit("none")).alias("value_id_type"))
    return initial.unionByName(changes)


def value_id_type(field: Column, has_id: Column) -> Column:
    """What kind of id the values of a field carry."""
    return (
        F.when(field.isin("labels", "System.Tags"), "string_literal")
        .when(field.isin("assignee", "reporter"), "account_id")
        .when(has_id, "opaque_id").otherwise("none"))


# --- state, intervals, flow -----------------------------------------------------

def issue_state(history: DataFrame) -> DataFrame:
    """Current state of each issue in one aggregation."""
    is_set = F.col("delta_action") == "set"
    at = F.struct("event_at", "_version", "event_id", "_seq")
    latest = lambda value, *fields: F.max_by(value, F.when(F.col("field_id").isin(*fields) & is_set, at))
    shown, id_ = first_item("value_displays"), first_item("value_ids")
    status_set = (F.col("field_id") == "status") & is_set
    used = ["status", "assignee", "issuetype", "priority", "duedate", "due_date", "timeoriginalestimate", "timespent"]
    relevant = history.filter(F.col("field_id").isin(used) | (F.col("event_kind") == "synthetic_initial"))
    return relevant.groupBy("source_id", "data_source", "issue_id").agg(
        latest(shown, "status").alias("status_name"),
        latest(id_, "assignee").alias("assignee_account_id"),
        latest(shown, "issuetype").alias("issue_type"),
        latest(shown, "priority").alias("priority"),
        latest(shown, "duedate", "due_date").alias("due_date_str"),
        number(latest(shown, "timeoriginalestimate")).alias("time_estimate_seconds"),
        number(latest(shown, "timespent")).alias("time_spent_seconds"),
        F.min(F.when(F.col("event_kind") == "synthetic_initial", F.col("event_at"))).alias("created_at"),
        F.max(F.when(status_set & shown.isin(*fixed.CLOSED_STATUSES), F.col("event_at"))).alias("final_close_at"),
        F.max(F.when(status_set, F.col("event_at"))).alias("last_status_event_at"),
    )


def with_assignee(state: DataFrame, users: DataFrame, people: DataFrame) -> DataFrame:
    """Add the assignee's e-mail and org unit to the issue state."""
    mails = users.select("source_id", F.col("user_id").alias("assignee_account_id"), F.lower("email").alias("assignee_email"))
    units = people.select(F.col("person_id").alias("assignee_email"), "org_unit_id")
    return state.join(mails, ["source_id", "assignee_account_id"], "left").join(units, "assignee_email", "left")


def status_intervals(history: DataFrame, state: DataFrame, as_of: Column) -> DataFrame:
    """Consecutive status periods (H14). The last one ends at the final close,
    or at `as_of`. Periods before creation, negative or future are dropped."""
    events = history.filter((F.col("field_id") == "status") & (F.col("delta_action") == "set")).select(
        *ISSUE, F.col("event_at").alias("interval_start"), "_version", "event_id",
        first_item("value_displays").alias("status_name"))
    # Read for the count and for the window; narrow, while the history may be parsed from JSON.
    events = with_near_neighbours(store(events), ISSUE, ["interval_start", "_version", "event_id"],
                                  following={"__next": F.col("interval_start"), "__more": F.lit(True)})
    joined = events.join(state.select(*ISSUE, "created_at", "final_close_at"), ISSUE, "left")
    end = F.when(F.col("__more"), F.col("__next")).otherwise(F.coalesce("final_close_at", as_of))
    start = F.col("interval_start")
    return (
        joined.withColumn("interval_end", end)
        .filter(start >= F.coalesce("created_at", F.lit("1970-01-02").cast("timestamp")))
        .filter((F.col("interval_end") >= start) & (F.col("interval_end") <= as_of + F.expr("interval 1 day")))
        .select(*ISSUE, "interval_start", "interval_end", "status_name",
                F.greatest(F.lit(0), seconds_between(start, F.col("interval_end"))).cast("double").alias("duration_seconds")))


def dev_seconds(state: DataFrame, intervals: DataFrame,
                active: Sequence[str] = fixed.ACTIVE_STATUSES) -> DataFrame:
    """Working, lead and pickup time of each closed issue (H15). The active
    periods are added up before the join."""
    work = intervals.filter(F.col("status_name").isin(*active)).groupBy(*ISSUE).agg(
        F.sum("duration_seconds").alias("dev_seconds"), F.min("interval_start").alias("__first"))
    closed = state.filter(F.col("final_close_at").isNotNull() & filled(F.col("assignee_email")))
    gap = lambda end: F.when(F.col("created_at").isNotNull() & end.isNotNull(), F.greatest(
        F.lit(0), seconds_between(F.col("created_at"), end)).cast("double"))
    return closed.join(work, ISSUE, "left").select(
        "assignee_email", *ISSUE, F.to_date("final_close_at").alias("close_date"), "dev_seconds",
        gap(F.col("final_close_at")).alias("lead_seconds"), gap(F.col("__first")).alias("pickup_seconds"))


def status_transitions(intervals: DataFrame, state: DataFrame, into: bool, name: str,
                       statuses: Sequence[str] = fixed.CLOSED_STATUSES) -> DataFrame:
    """Daily count of moves into (or out of) a set of statuses per assignee."""
    moved = with_near_neighbours(intervals, ISSUE, ["interval_start", "interval_end", "status_name"],
                                 previous={"__was": F.col("status_name")})
    was = F.coalesce(F.col("__was").isin(*statuses), F.lit(False))
    now = F.coalesce(F.col("status_name").isin(*statuses), F.lit(False))
    hit = (now & ~was) if into else (was & ~now & F.col("status_name").isNotNull())
    owners = state.filter(filled(F.col("assignee_email"))).select(*ISSUE, "assignee_email")
    return moved.filter(hit).join(owners, ISSUE).groupBy(
        "assignee_email", F.to_date("interval_start").alias("event_date")).agg(F.count(F.lit(1)).alias(name))


def split_by_day(intervals: DataFrame, start: str, end: str, day: str = "day", seconds: str = "seconds") -> DataFrame:
    """Cut each interval at midnights; one row per touched day."""
    days = intervals.withColumn(day, F.explode(F.sequence(F.to_date(start), F.to_date(end))))
    midnight = F.col(day).cast("timestamp")
    spent = seconds_between(F.greatest(F.col(start), midnight), F.least(F.col(end), midnight + F.expr("interval 1 day")))
    return days.withColumn(seconds, F.greatest(F.lit(0), spent).cast("double"))


def in_progress_per_day(intervals: DataFrame, state: DataFrame,
                        active: Sequence[str] = fixed.ACTIVE_STATUSES) -> DataFrame:
    owners = state.filter(filled(F.col("assignee_email"))).select(*ISSUE, "assignee_email")
    work = intervals.filter(F.col("status_name").isin(*active)).join(owners, ISSUE)
    return split_by_day(work, "interval_start", "interval_end").groupBy("assignee_email", "day").agg(
        F.sum("seconds").alias("in_progress_seconds"))


def worklog_per_day(worklogs: DataFrame, users: DataFrame) -> DataFrame:
    """Logged seconds per author and day."""
    mails = users.filter(filled(F.col("email"))).select("source_id", F.col("user_id").alias("author_id"), F.lower("email").alias("author_email"))
    return worklogs.join(mails, ["source_id", "author_id"]).groupBy(
        "author_email", F.to_date("work_date").alias("work_date")).agg(
        F.sum(F.coalesce("duration_seconds", F.lit(0.0))).alias("worklog_seconds"))


def stale_in_progress(state: DataFrame, as_of: Column, days: int = 14,
                      closed: Sequence[str] = fixed.CLOSED_STATUSES) -> DataFrame:
    """Open issues per assignee whose status is older than `days`."""
    still_open = F.col("status_name").isNull() | ~F.col("status_name").isin(*closed)
    old = F.date_diff(F.to_date(as_of), F.to_date("last_status_event_at")) > days
    return state.filter(still_open & filled(F.col("assignee_email")) & old).groupBy(
        "assignee_email", "org_unit_id").agg(F.count(F.lit(1)).alias("stale_count"))


def closed_tasks(state: DataFrame, closed: Sequence[str] = fixed.CLOSED_STATUSES) -> DataFrame:
    """Closed issues per assignee and close date."""
    due = filled(F.col("due_date_str"))
    on_time = due & (F.to_date("final_close_at") <= F.to_date(moment("due_date_str")))
    planned = F.coalesce("time_estimate_seconds", F.lit(0.0)) > 0
    done = state.filter(F.col("final_close_at").isNotNull() & filled(F.col("assignee_email")) & F.col("status_name").isin(*closed))
    return done.groupBy(F.col("assignee_email").alias("person_id"), F.to_date("final_close_at").alias("metric_date")).agg(
        F.count(F.lit(1)).alias("tasks_closed"), F.count_if(F.col("issue_type") == "Bug").alias("bugs_fixed"),
        F.count_if(on_time).alias("on_time_count"), F.count_if(due).alias("has_due_date_count"),
        F.avg(F.when(planned, F.col("time_spent_seconds"))).alias("avg_time_spent"),
        F.avg(F.when(planned, F.col("time_estimate_seconds"))).alias("avg_time_estimate"))
