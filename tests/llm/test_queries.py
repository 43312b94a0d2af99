import pytest

from mnesis.llm import queries

COLUMNS = {
    "p1_found": ["id", "pii_type", "start_pos"],
    "p3_found": ["id_a", "id_b"],
    "p4_found": ["id_a", "id_b"],
    "p5_found": ["session_id", "pos", "seq", "role"],
    "p6_found": ["doc_id", "item_id"],
    "p8_found": ["doc_id", "form"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_and_have_their_columns(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.collect()
    assert rows
    if name.endswith("_found"):
        assert len(rows) == len(set(map(tuple, rows)))
