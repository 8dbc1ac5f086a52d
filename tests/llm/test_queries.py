"""Every query for training data on the smallest tables: against its SQL where there is one, else its schema."""

import pytest

from hanmaru.llm import queries
from tests.oracle import connect, normal, rows_of_sql

COLUMNS = {
    "p1_found": ["kept_ingredient_id", "copy_ingredient_id"], "p2_found": ["ingredient_id", "field_name", "functional_ingredient_name"], "p3_found": ["base_product_id", "target_product_id", "rank_no"],
    "p4_found": ["table_name", "left_report_no", "right_report_no"], "p6_found": ["scope", "left_key", "right_key"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, small, name):
    df = queries.queries()[name](spark, small)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    got = df.collect()
    assert len(got) == len(set(got))
    assert got
    if name in queries.oracle_sql():
        assert (sorted(df.columns), sorted(tuple(normal(r[c]) for c in sorted(df.columns)) for r in got)) == rows_of_sql(connect(small), queries.oracle_sql()[name])
