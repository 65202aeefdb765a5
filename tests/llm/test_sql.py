import pytest

from palaver.llm.queries import oracle_sql, queries
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, name):
    assert same(spark, "/root/testdata/sf0.01", queries()[name], oracle_sql()[name]) > 0
