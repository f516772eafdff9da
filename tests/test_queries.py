"""Every registered query with SQL gives the SQL's rows; the others give rows."""

import pytest

import __spark_entry__ as entry
from compare import duck, rows

SF = "/root/testdata/sf0.001"
OWN = entry._own()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(OWN.ORACLES))
def test_same_as_sql(spark, con, name):
    got = OWN.QUERIES[name](spark, SF)
    want = con.sql(OWN.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(OWN.QUERIES) - set(OWN.ORACLES)))
def test_runs(spark, name):
    assert OWN.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
