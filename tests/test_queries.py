"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import compare, connect
from tests.conftest import SMALL
from wardlight.checks import all_queries, all_sql

# the optional queries have tests of their own
OWN = all_queries()
SQL = all_sql()
SLOW = {"ml_05_cross_validate", "ml_11_kdd_boosting", "ml_12_fit_then_load"}  # run at the end of test_model


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    found, n, _ = compare(OWN[name](spark, SMALL), con, SQL[name])
    assert not found


@pytest.mark.parametrize("name", sorted(set(OWN) - set(SQL) - SLOW))
def test_gives_rows(spark, name):
    assert OWN[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 10


def test_entry_offers_all_queries():
    assert set(OWN) <= set(queries()) and set(SQL) <= set(oracle_sql()) <= set(queries())


FAMILIES = {
    "src": 8, "prf": 4, "can": 5, "aud": 9, "sql": 3, "kpi": 17, "met": 13, "obs": 6, "trc": 6,
    "ret": 14, "evr": 3, "ml": 13, "eve": 8, "mem": 10, "str": 3,
}


def test_every_operator_has_a_query():
    have = {"_".join(n.split("_")[:2]) for n in OWN}
    assert have == {f"{f}_{i:02d}" for f, n in FAMILIES.items() for i in range(1, n + 1)}
