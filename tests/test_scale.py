"""Work that must not be repeated, and tables that must not be sent whole."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from proving.case import KINDS
from workmart.functions.scalars import rounded
from workmart.operators import issues, rollup
from workmart.operators.quantiles import exact_quantiles
from workmart.plans import registry
from workmart.plans.gold import peer_cohorts
from workmart.session import store

DAY = dt.date(2024, 1, 5)


def test_a_long_table_in_a_small_file_is_not_broadcast(spark):
    people = store(spark.range(400_000).selectExpr("concat('customer#', lpad(id, 9, '0')) as person_id", "concat('unit ', id % 5) as org_unit_id"))
    rows = spark.range(1_000_000).selectExpr("concat('customer#', lpad(id, 9, '0')) as person_id", "id as v")
    plan = rows.join(people, "person_id", "left")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan


@pytest.fixture()
def history(spark, tmp_path, monkeypatch):
    """Two issues with labels set and taken away; one has more changes than a block."""
    monkeypatch.setattr(issues, "BLOCK", 3)
    at = "timestamp'2024-01-01 00:00:00'"
    spark.sql(f"""select 's' source_id, issue_id, concat('T-', issue_id) id_readable, {at} created_at, 'u' reporter_id, 'labels' field_id,
        array(named_struct('id', 'b', 'display', 'b')) current from values ('1'), ('2') t(issue_id)""").write.parquet(f"{tmp_path}/snapshot")
    snapshot = spark.read.parquet(f"{tmp_path}/snapshot")
    events = spark.sql(f"""select 's' source_id, issue_id, concat('T-', issue_id) id_readable, cast(n as string) changelog_id, {at} + make_interval(0, 0, 0, n) event_at, n event_no, 'u' author_id,
        'labels' field_id, if(off, v, null) value_from, if(off, v, null) value_from_string, if(off, null, v) value_to, if(off, null, v) value_to_string
        from values ('1', 1, 'a', false), ('1', 2, 'b', false), ('1', 3, 'a', true), ('1', 4, 'c', false), ('1', 5, 'c', true), ('2', 1, 'c', true), ('2', 2, 'b', false) t(issue_id, n, v, off)""")
    meta = spark.createDataFrame([("s", "labels", "Labels", True, "string_literal")], "source_id string, field_id string, field_name string, is_multi boolean, value_id_type string")
    return issues.field_history(snapshot, events, meta)


def test_snapshot_is_read_once_and_both_folds_agree(history):
    assert not [f for f in history.inputFiles() if f.split("?")[0].rsplit("/", 2)[-2] == "snapshot"]
    rows = {(r["issue_id"], r["event_id"]): sorted(r["value_ids"]) for r in history.collect()}
    assert rows == {("1", "initial:1"): [], ("1", "1"): ["a"], ("1", "2"): ["a", "b"], ("1", "3"): ["b"], ("1", "4"): ["b", "c"], ("1", "5"): ["b"],
                    ("2", "initial:2"): ["c"], ("2", "1"): [], ("2", "2"): ["b"]}


def test_quantiles_of_counted_values(spark):
    rows = spark.createDataFrame([("k", 1.0, 5), ("k", 2.0, 1), ("k", 9.0, 4)], "k string, v double, n int")
    assert exact_quantiles(rows, ["k"], "v", {"q": 0.5, "r": 0.6, "s": 0.7}, "n").collect()[0][1:] == (1.0, 2.0, 9.0)


def test_cohorts_with_a_person_listed_twice(spark):
    people = spark.createDataFrame([("p", "u", "boss"), ("p", "u", "boss"), ("q", "u", None)], "person_id string, org_unit_id string, supervisor_email string")
    rows = spark.createDataFrame([(p, "x", DAY, "m", v) for p, v in (("p", 1.0), ("p", 3.0), ("q", 5.0), ("q", None))],
                                 "person_id string, org_unit_id string, metric_date date, metric_key string, metric_value double")
    found = {(r["kind"], r["cohort_seed"]): (r["p25"], r["p50"], r["p75"], r["min"], r["max"], r["n"]) for r in peer_cohorts(rows, people).collect()}
    assert found == {("ic", "boss"): (1.0, 1.0, 3.0, 1.0, 3.0, 1), ("team", "u"): (1.0, 3.0, 3.0, 1.0, 5.0, 2)}


def test_status_intervals_read_the_history_once(spark, tmp_path):
    """Status events are stored, and short issues need no rows at the ends of chunks."""
    spark.sql("""select 's' source_id, issue_id, 'status' field_id, 'set' delta_action, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, n) event_at, n _version,
        cast(n as string) event_id, array(v) value_displays from values ('1', 1, 'Open'), ('1', 3, 'Closed'), ('1', 4, 'Open'), (null, 2, 'Open'), (null, 5, 'Closed') t(issue_id, n, v)""").write.parquet(f"{tmp_path}/history")
    state = spark.sql("select 's' source_id, '1' issue_id, timestamp'2024-01-01 00:00:00' created_at, timestamp'2024-01-06 00:00:00' final_close_at, 'a@x' assignee_email")
    found = store(issues.status_intervals(spark.read.parquet(f"{tmp_path}/history"), state, F.lit("2024-01-09 00:00:00").cast("timestamp")))
    moved = issues.status_transitions(found, state, False, "n")
    plan = moved._jdf.queryExecution().executedPlan().toString()
    assert "__chunk" not in plan
    days = {(r["issue_id"], r["interval_start"].day, r["interval_end"].day, r["status_name"]) for r in found.collect()}
    assert days == {("1", 2, 4, "Open"), ("1", 4, 5, "Closed"), ("1", 5, 6, "Open"), (None, 3, 6, "Open"), (None, 6, 9, "Closed")}
    assert [(r["assignee_email"], r["event_date"].day, r["n"]) for r in moved.collect()] == [("a@x", 5, 1)]


def test_rounding_of_whole_and_odd_values(spark):
    values = [None, 0.0, -0.0, 1.0, -7.0, 0.5, -0.5, 2.25, 0.1 + 0.2, 1.005, 1e15 + 0.5, 2.0**53, 1e300, -1e300, 5e-324, float("inf"), float("-inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    kind = KINDS["f"][0].format(c="v")
    found = df.select(
        *[rounded("v", d).cast("string").alias(f"a{d}") for d in (0, 1, 2)], *[F.round(F.round("v", d + 8), d).cast("string").alias(f"b{d}") for d in (0, 1, 2)],
        F.expr(f"cast({kind} as string)").alias("a4"), F.expr("cast(round(round(v, 12), 4) + 0.0D as string)").alias("b4"))
    for row in found.collect():
        assert all(row[f"a{d}"] == row[f"b{d}"] for d in (0, 1, 2, 4)), row
    assert found.select("a1").dtypes == [("a1", "string")] and df.select(rounded("v", 1).alias("r")).dtypes == [("r", "double")]


def test_rows_are_stored_before_medians(spark):
    """The rows of a period come from a file for every count of a median, not from their own plan again."""
    rows = spark.range(40).selectExpr(
        "cast(id % 4 as string) as person_id", "'u' as org_unit_id", "date'2024-01-01' as metric_date",
        "if(id % 8 < 4, 'size', 'n') as metric_key", "cast(id div 4 as double) as metric_value")
    values = rollup.person_values(rows, rollup.Metrics(values={"n": rollup.total("n")}, medians={"median": "size"}))
    assert "Range (" not in values._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.person_id, r.metric_key, r.v) for r in values.collect()) == sorted(
        x for p in "0123" for x in ((p, "median", 4.0), (p, "n", 25.0)))


def test_store_leaves_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",")
        return {f for f in found.split(",") if "/shuffle_" in f}

    before = files()
    table = store(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count())
    assert not files() - before
    assert table.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def _jira(spark, *issue_keys):
    """Issues with a status and labels, one change of each; an issue's key may be given twice."""
    at = "timestamp'2024-01-02 00:00:00' as _airbyte_extracted_at"
    ids = spark.createDataFrame([(k, i) for i, k in enumerate(issue_keys)], "id string, n int")
    return registry.Landed(spark, {
        "bronze_jira.jira_issue": ids.selectExpr("'s' source_id", "'t' tenant_id", "id jira_id", "concat('T-', id) id_readable", "'2024-01-01' created", "id unique_key", at, "'P' project_key",
            "cast(null as string) parent_id", "cast(null as string) due_date", """'{"status":{"id":"2","name":"Done"},"labels":["a","b"]}' custom_fields_json"""),
        "bronze_jira.jira_issue_history": ids.selectExpr("'s' source_id", "'t' tenant_id", "concat('T-', id) id_readable", "id changelog_id", "'2024-01-01 10:00:00' created_at", "'u' author_account_id",
            "id unique_key", at, """'[{"fieldId":"status","field":"Status","from":"1","fromString":"Open","to":"2","toString":"Done"},
            {"fieldId":"labels","field":"Labels","from":"","fromString":"","to":"b","toString":"b"}]' items"""),
        "bronze_jira.jira_fields": spark.sql(f"""select 's' source_id, 't' tenant_id, field_id unique_key, {at}, field_id, field_id name, kind schema_type, items schema_items
            from values ('status', 'status', ''), ('labels', 'array', 'string') t(field_id, kind, items)""")}, F.lit("2024-02-01").cast("timestamp"))


def test_field_history_rows_are_not_shuffled_by_key(spark):
    """What the history shuffled is gone before its rows are read, and rows whose key is theirs alone stay where they are."""
    rows = registry.build_class("class_task_field_history", _jira(spark, "1", "2", "2"))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].replace("BroadcastExchange", "")
    found = {(r.issue_id, r.field_id, r.event_id): (r.value_ids, r.delta_action, r.delta_value_id, r.tenant_id) for r in rows.collect()}
    assert len(found) == rows.count() == 24
    for issue in "12":
        assert found[issue, "status", f"initial:{issue}"] == (["1"], "set", "1", "t") and found[issue, "status", issue] == (["2"], "set", "2", "t")
        assert found[issue, "labels", f"initial:{issue}"] == (["a"], "add", "a", "t")
        assert found[issue, "labels", issue] == (["a", "b"], "add", "b", "t")


@pytest.mark.parametrize("few", [0, 100])
def test_keys_that_repeat_keep_their_newest_row(spark, monkeypatch, few):
    monkeypatch.setattr(registry, "FEW", few)
    schema = registry.contract("class_task_field_history")
    rows = registry.conform(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", None, "z"), ("b", 1, "x"), (None, 1, "p"), (None, 3, "q")], "unique_key string, _version long, issue_id string"), schema)
    found = registry.one_per_key(rows, "class_task_field_history")
    assert found.columns == schema.names
    assert sorted(((r.unique_key or "", r.issue_id) for r in found.collect())) == [("", "q"), ("a", "y"), ("b", "x")]
