import pytest
from compare import connect, differences

from siteloom.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, data, name):
    df = Q.queries()[name](spark, data)
    if name in Q.oracle_sql():
        assert differences(df, connect(data), Q.oracle_sql()[name]) == []
    else:
        assert df.count() >= 0


COLUMNS = {"p1_found": ["item_kind", "item_id"], "p2_found": ["table_name", "row_id"], "p3_found": ["value_id_a", "value_id_b"], "p4_found": ["passage_id", "line_no"], "p5_found": ["page_id"], "p6_found": ["passage_id"], "p7_found": ["item_id", "doc_id"], "p9_found": ["doc_id", "end_char"]}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, data, name):
    df = Q.queries()[name](spark, data)
    assert df.columns == COLUMNS[name] and all(t in ("bigint", "string") for _, t in df.dtypes)
