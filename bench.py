"""Headline queries, timed. Prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from proving import CASES  # noqa: E402
from workmart import build_session  # noqa: E402

HEADLINE = (
    "D1_latest_by", "D3_qualify", "S6_upsert_by_key", "J1_inner_multi_key", "A1_aggregate", "A6_exact_quantiles", "W5_sessionize",
    "H2_field_changes", "H10_apply_delta", "H14_status_intervals", "H17_split_by_day", "G18_git_rows", "G19_collab_rows", "G30_ic_kpis",
    "G34_peer_cohort_stats", "Q5_team_bullet_delivery", "Q8_collaboration_team", "Q11_git_person", "O2_resolve_persons", "O5_org_chart",
    "O6_subtree", "C13_repeated_rows",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    CASES["S1_read_table"].query(spark, folder).collect()  # start-up is not a query
    times = {}
    for name in HEADLINE:
        start = time.time()
        CASES[name].query(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(scale.group(1)) if scale else folder}))
    spark.stop()


if __name__ == "__main__":
    main()
