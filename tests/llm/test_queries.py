"""Every registered query on the smallest tables, with the columns that are fixed."""

import os

import pytest

from pothi.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
COLUMNS = {
    "p1_found": ["pair_id", "field", "noise"], "p2_found": ["pair_id", "field"], "p3_found": ["pair_id", "language"], "p4_found": ["language", "subject", "class_num"],
    "p5_found": ["pair_id_a", "pair_id_b"], "p6_found": ["pair_id", "defect"], "p7_found": ["pair_id_a", "pair_id_b"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    rows = QUERIES[name](spark, FOLDER)
    assert rows.columns == COLUMNS.get(name, rows.columns)
    found = rows.collect()
    assert found
    if name in COLUMNS:
        assert len({repr(r) for r in found}) == len(found)
    if name in ("p5_found", "p7_found"):
        assert all(r["pair_id_a"] < r["pair_id_b"] for r in found)
