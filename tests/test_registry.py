"""Every registered query against its independent SQL, and the shape of its plan."""

import pytest

import __spark_entry__ as driver
from checking import check, connect
from registry.catalogue import ORACLES, QUERIES

UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "PythonRDD")


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_equal_checking_sql(spark, duck, sf_dir, name):
    assert name in ORACLES
    message, _, plan = check(spark, duck, QUERIES[name], ORACLES[name], sf_dir)
    assert not message, message
    assert not [operator for operator in UNWANTED if operator in plan]


def test_entry_has_rows(spark):
    rows = driver.entry(spark)
    assert rows.columns[:2] == ["database_id", "table_name"] and rows.count() > 0
