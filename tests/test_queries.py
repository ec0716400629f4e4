import pytest

from tests.oracle import assert_same, connect
from veristrata.catalog import CORE_ORACLE, CORE_QUERIES


@pytest.mark.parametrize("name", sorted(CORE_QUERIES))
def test_query_equals_its_sql(spark, data, name):
    df = CORE_QUERIES[name](spark, data)
    if name in CORE_ORACLE:
        assert_same(df, connect(data), CORE_ORACLE[name])
    else:
        assert df.columns and df.count() >= 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_does_not_import_llm():
    import pathlib

    import veristrata

    root = pathlib.Path(veristrata.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "veristrata.llm" not in path.read_text(), path
