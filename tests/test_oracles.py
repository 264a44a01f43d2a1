import pytest

from lakescribe.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, compare, name):
    compare(QUERIES[name](spark, SF), SQL[name], SF)
