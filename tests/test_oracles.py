"""Every registered query with a SQL twin, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
# Their means sit on a rounding boundary at this scale; checked at the next one.
EDGE = {"summary_report", "profile", "decompose_many"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - EDGE))
def test_query_matches_sql(spark, con, name):
    verdict, _ = compare(spark, con, name, entry.queries()[name], ORACLES[name], SF)
    assert verdict.startswith(("ok", "NEAR")) and "TYPES" not in verdict, verdict


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert {r["section"] for r in rows} >= {"summary", "statistics", "quality", "correlation"}
