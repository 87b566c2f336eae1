"""Every query with a SQL twin gives the twin's rows; the flagship runs."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as spark_entry  # noqa: E402
from tools.check import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"
ORACLES = spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(spark_entry.queries())


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    status, _, _, detail = compare(spark, con, SF, name, spark_entry.queries()[name], ORACLES[name])
    assert status == "ok", detail or status


@pytest.mark.parametrize("name", ["t7_linear_leaderboard", "q10_degree_sweep", "d3_isolation_outliers", "e6_level0_stacking", "n7_epoch_sweep"])
def test_runs_without_twin(spark, name):
    assert spark_entry.queries()[name](spark, SF).count() > 0
