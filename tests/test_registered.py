"""Every registered query gives the rows of its SQL, at the smallest scale."""

import pytest

import __spark_entry__ as entry_points
from check import checking_engine, compare
from turnout.plans import registry

SMALLEST = "/root/testdata/sf0.001"
QUERIES = {k: v for k, v in entry_points.queries().items() if k in registry.QUERIES}
TEXTS = entry_points.oracle_sql()
# queries without any row at this scale
EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def engine():
    return checking_engine(SMALLEST)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, engine, name):
    problem = compare(QUERIES[name](spark, SMALLEST), engine, TEXTS.get(name))
    assert problem == ("EMPTY" if name in EMPTY else "")


def test_entry(spark):
    assert entry_points.entry(spark).count() == 7


def test_every_query_has_sql():
    assert set(QUERIES) <= set(TEXTS)
