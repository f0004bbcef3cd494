"""Chunked windows equal plain ones, also when one key holds most rows."""

import random
from datetime import datetime, timedelta

from pyspark.sql import Window, functions as F

from workmart.operators.ordered import with_near_neighbours, with_neighbours, with_position, with_running_sum
from workmart.operators.quantiles import exact_quantiles
from workmart.operators.sessions import sessionize


def _events(spark, n=600, seed=3):
    rnd = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", None])
        rows.append((key, start + timedelta(minutes=rnd.randrange(0, 60 * 24 * 9)), i, rnd.randrange(-5, 9)))
    return spark.createDataFrame(rows, "key string, ts timestamp, id bigint, v bigint")


def test_neighbours(spark):
    df = _events(spark)
    w = Window.partitionBy("key").orderBy("ts", "id")
    plain = df.withColumn("was", F.lag("v").over(w)).withColumn("will", F.lead("id").over(w))
    ours = with_neighbours(df, ["key"], ["ts", "id"], previous={"was": "v"}, following={"will": "id"})
    assert sorted(map(str, plain.collect())) == sorted(map(str, ours.collect()))


def test_near_neighbours_cut_only_long_keys(spark):
    df = _events(spark)
    values = {"previous": {"was": "v"}, "following": {"will": "id"}}
    want = sorted(map(str, with_neighbours(df, ["key"], ["ts", "id"], **values).collect()))
    for most, cut in ((50, True), (200, True), (600, False)):  # "hot" has more than 200 rows, "a", "b" and NULL more than 50
        found = with_near_neighbours(df, ["key"], ["ts", "id"], **values, most=most)
        assert sorted(map(str, found.collect())) == want
        assert ("__chunk" in found._jdf.queryExecution().executedPlan().toString()) is cut


def test_running_sum_and_position(spark):
    df = _events(spark)
    plain = df.withColumn("total", F.sum("v").over(Window.partitionBy("key").orderBy("ts")))
    ours = with_running_sum(df, ["key"], ["ts"], "v", "total")
    assert sorted(map(str, plain.collect())) == sorted(map(str, ours.collect()))
    numbered = with_position(df, ["key"], ["ts", "id"]).filter("key = 'hot'").select("position").collect()
    assert sorted(r.position for r in numbered) == list(range(1, len(numbered) + 1))


def test_hot_key_is_split(spark):
    """A plan must partition by key and chunk, not by the key alone."""
    plan = with_neighbours(_events(spark), ["key"], ["ts", "id"], previous={"was": "v"})._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" in plan and "__chunk" in plan.split("hashpartitioning", 1)[1]


def test_sessions(spark):
    df = _events(spark).filter("key is not null").withColumn("end_ts", F.expr("ts + make_interval(0,0,0,0,0,cast(abs(v) as int),0)"))
    got = {r.id: r.session_no for r in sessionize(df, ["key"], "ts", 1800, ties=["id"]).collect()}
    by_end = {r.id: r.session_no for r in sessionize(df, ["key"], "ts", 300, "end_ts", ["id"]).collect()}
    for key in ("hot", "a", "b"):
        rows = sorted((r.ts, r.id, r.end_ts) for r in df.filter(F.col("key") == key).collect())
        number = number_end = 0
        expected, expected_end = {}, {}
        for i, (ts, id_, end) in enumerate(rows):
            if i == 0 or (ts - rows[i - 1][0]).total_seconds() > 1800:
                number += 1
            if i == 0 or (ts - rows[i - 1][2]).total_seconds() > 300:
                number_end += 1
            expected[id_], expected_end[id_] = number, number_end
        # Rows at one instant share the largest number of that instant.
        at = {}
        for ts, id_, _ in rows:
            at.setdefault(ts, []).append(id_)
        for ids in at.values():
            assert {got[i] for i in ids} == {max(expected[i] for i in ids)}
            assert {by_end[i] for i in ids} == {max(expected_end[i] for i in ids)}


def test_exact_quantiles(spark):
    rnd = random.Random(5)
    rows = [(k, rnd.choice([0.0, -1.5, rnd.uniform(-50, 50), round(rnd.uniform(0, 100), 1)])) for k in ["x"] * 500 + ["y"] * 7 + [None] * 20]
    rows += [("x", None), ("z", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    wanted = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p100": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", wanted).collect()}
    assert set(got) == {"x", "y", None}
    plain = df.filter("v is not null").groupBy("k").agg(*[F.expr(f"percentile_disc({p}) within group (order by v)").alias(n) for n, p in wanted.items()])
    for r in plain.collect():
        assert r.asDict() == got[r.k].asDict()


def test_exact_quantiles_of_odd_and_close_values(spark):
    """Infinite values and NaN have their places; values that differ by far less than a band's width are told apart."""
    rnd = random.Random(6)
    odd = [("odd", v) for v in [float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 5e-324, 1.7e308, -1.7e308, 2.0, float("nan")]]
    close = [("close", 1.7e9 + rnd.randrange(0, 3000) / 64) for _ in range(2000)]
    df = spark.createDataFrame(odd + close, "k string, v double")
    wanted = {f"p{i}": i / 10 for i in range(1, 11)}
    got = {r.k: [str(r[n]) for n in wanted] for r in exact_quantiles(df, ["k"], "v", wanted).collect()}
    for key, rows in (("odd", odd), ("close", close)):
        ordered = sorted((v for _, v in rows), key=lambda v: (v != v, v))
        at = [str(ordered[max(1, -(-i * len(ordered) // 10)) - 1] + 0.0) for i in range(1, 11)]
        assert got[key] == at
