"""Compare cases with their SQL: python -m proving.check [folder] [name-part ...]"""

from __future__ import annotations

import math
import sys
import tempfile
import time

import duckdb

from proving import CASES
from workmart import build_session

# Both sides round to four places, so values must be equal to the last bit.
EXACT = True
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), v) if not isinstance(v, float) else (v is None, "f", round(v, 3)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b if EXACT else math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-4)
    return a == b


def differences(ours: list[tuple], theirs: list[tuple]) -> list[str]:
    if len(ours) != len(theirs):
        extra, lost = set(map(str, ours)) - set(map(str, theirs)), set(map(str, theirs)) - set(map(str, ours))
        return [f"{len(ours)} rows, SQL has {len(theirs)}", f"only ours {sorted(extra)[:3]}", f"only SQL {sorted(lost)[:3]}"]
    pairs = zip(sorted(ours, key=_key), sorted(theirs, key=_key))
    bad = [f"{a} != {b}" for a, b in pairs if not all(map(_same, a, b))]
    return bad[:3]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder: str, name: str) -> tuple[list[str], int, float]:
    case = CASES[name]
    start = time.time()
    df = case.query(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    sql = case.oracle()
    if sql is None:
        return ([] if rows or "G40" in name else ["no rows"]), len(rows), took
    names = [n for n, _ in case.columns()]
    if df.columns != names:
        return [f"columns {df.columns}"], len(rows), took
    return differences(rows, con.execute(sql).fetchall()), len(rows), took


def main(folder: str, parts: list[str]) -> int:
    spark = build_session("proving", "local[8]", **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="proving-"), "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in CASES:
        if parts and not any(p in name for p in parts):
            continue
        try:
            bad, n, took = compare(spark, con, folder, name)
        except Exception as error:  # shown per case
            bad, n, took = [str(error)[:400]], 0, 0.0
        failed += bool(bad)
        print(f"{'FAIL' if bad else 'ok  '} {name} rows={n} {took:.1f}s {'' if CASES[name].sql else '(rows only)'}", *bad, sep="\n      " if bad else " ", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]) else 0)
