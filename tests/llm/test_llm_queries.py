"""The queries of the problems on the smallest tables, with their SQL where there is one."""

import os

import pytest

import oracle
from quernstone.llm.queries import ORACLE, QUERIES

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {
    "p1_found": ["key_kind", "key_value"], "p2_found": ["post_id"], "p3_found": ["post_id_a", "post_id_b"], "p4_found": ["table_name", "post_id", "pii_type"], "p6_found": ["post_id_a", "post_id_b"],
    "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name in ORACLE:
        oracle.compare(spark, QUERIES[name], ORACLE[name], DATA)
    else:
        n = df.count()
        assert name not in COLUMNS or n == df.distinct().count()
