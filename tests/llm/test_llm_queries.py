import pytest

from tests.oracle import assert_same, connect
from veristrata.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_or_equals_its_sql(spark, data, name):
    df = QUERIES[name](spark, data)
    if name in ORACLE:
        assert_same(df, connect(data), ORACLE[name])
    else:
        assert df.count() > 0


def test_found_columns(spark, data):
    want = {
        "p2_found": ["text_id", "cut"],
        "p3_found": ["group_id", "candidate_id"],
        "p4_found": ["item_kind", "item_id", "lang"],
        "p5_found": ["model", "revision", "text_a", "text_b"],
        "p6_ids": ["doc_id", "ids"],
        "p8_found": ["doc_id", "start_pos", "end_pos"],
    }
    assert {n: QUERIES[n](spark, data).columns for n in want} == want
