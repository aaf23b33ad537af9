"""Registered queries against their SQL in DuckDB, at the smallest scale."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check.connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    verdict = check.compare(entry.queries()[name](spark, FOLDER), duck, entry.oracle_sql()[name])
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert entry.queries()[name](spark, FOLDER).collect()


#: Queries whose operators cut hot groups.
SLICED = [n for n in sorted(entry.oracle_sql()) if n[:2] in ("W0", "W1", "W2", "T0", "R0", "M0", "G0") or n[:3] in ("J10", "J12", "J19", "A13", "A17", "A18", "A19", "A20", "A21", "A22", "A25", "F06", "F10", "Q03", "Q05", "Q06", "Q07")]


@pytest.mark.parametrize("name", SLICED)
def test_query_matches_sql_at_fifty_rows_a_slice(spark, duck, name):
    spark.conf.set("tablemill.rowsPerSlice", "50")
    try:
        verdict = check.compare(entry.queries()[name](spark, FOLDER), duck, entry.oracle_sql()[name])
    finally:
        spark.conf.unset("tablemill.rowsPerSlice")
    assert verdict.startswith("ok"), verdict
