"""Every registered query against its SQL twin; those without one must give rows."""

import pytest
from oracle import connect, differences

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    build, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql:
        assert differences(spark, con, name, build, sql, SF) is None
    else:
        assert build(spark, SF).count() > 0


def test_entry(spark):
    assert {r["host_name"] for r in entry.entry(spark).collect()} == {f"host-{k}" for k in range(7)}
