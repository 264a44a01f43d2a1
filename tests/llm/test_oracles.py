import pytest

from lakescribe.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, compare, name):
    compare(queries.QUERIES[name](spark, SF), queries.SQL[name], SF)
