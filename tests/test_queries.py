"""Every core query against its SQL on the smallest tables."""

import os

import pytest

import oracle
from quernstone.plans import catalogue

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    if name in catalogue.ORACLE:
        oracle.compare(spark, catalogue.QUERIES[name], catalogue.ORACLE[name], DATA)
    else:
        catalogue.QUERIES[name](spark, DATA).count()


def test_every_query_has_sql():
    assert set(catalogue.ORACLE) == set(catalogue.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
