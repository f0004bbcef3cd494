from __future__ import annotations

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from workmart import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """table('id bigint, name', row, ...): columns without a type are text;
    rows are dicts, what they leave out is NULL."""

    def make(columns: str, *rows: dict):
        names, kinds = [], []
        for part in re.split(r",(?![^<]*>)", columns):
            name, _, kind = part.strip().partition(" ")
            names.append(name)
            kinds.append(f"`{name}` {kind or 'string'}")
        unknown = {k for r in rows for k in r} - set(names)
        assert not unknown, unknown
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(kinds))

    return make
