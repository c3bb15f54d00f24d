"""Driver contract and plan shape of every registered query."""

from __future__ import annotations

import pytest
from conftest import SF

import __spark_entry__ as entry
from fleetlog.plans import fixture_queries

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas")

NAMES = set(fixture_queries.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "liters_per_100km" in df.columns


def test_every_query_has_an_oracle():
    assert NAMES <= set(entry.queries()) and NAMES <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(n for n in NAMES if not n.startswith("stream_")))
def test_plans_have_no_cartesian_or_python(spark, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad}"
