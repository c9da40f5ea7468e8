import pytest

from spanforge.llm.queries import QUERIES, SQL
from tests.oracle import connect, rows_of

COLUMNS = {
    "p1_found": "kb_lo bigint, kb_hi bigint", "p2_found": "doc_id string, sent_no bigint, start_off bigint, end_off bigint", "p3_found": "row_id bigint, group_doc bigint",
    "p5_found": "row_id bigint, entity_id bigint", "p6_ids": "doc_id bigint, ids array<int>", "p7_found": "doc_id bigint, item_id bigint", "p8_found": "doc_lo bigint, doc_hi bigint",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in COLUMNS:
        assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == COLUMNS[name]
    got = rows_of(df.toPandas())
    if name in SQL:
        assert got == rows_of(connect(sf).sql(SQL[name]).df())
