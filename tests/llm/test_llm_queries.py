import os

import pytest

from veriplane.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
FOUND = {
    "p1_found": ["entity_id", "group_id"], "p3_found": ["record_a", "record_b"], "p4_found": ["group_id", "field_name", "record_id"], "p6_found": ["owner_pac_id", "row_id"],
    "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_a", "doc_b"],
}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(FOUND))
def test_columns_and_distinct_rows(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    assert df.columns == FOUND[name] and len(rows) == len(set(rows)) > 0
