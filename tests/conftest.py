from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidefold.session import build_session, fresh_dir  # noqa: E402
from tidefold.sinks.layout import Layout  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="2",
        spark__sql__maxMetadataStringLength="5000",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def layout(spark):
    return Layout(fresh_dir(spark, "test"))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def values(df, *order):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
