"""The queries with SQL against it, on the smallest tables."""

import pytest
from oracle import SPARK_TYPES, duck_rows, duck_types, spark_rows

from tarnwright.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.SQL)
def test_query_matches_its_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert spark_rows(df) == duck_rows(queries.SQL[name], SF)
    assert sorted((c, SPARK_TYPES[t]) for c, t in df.dtypes) == duck_types(queries.SQL[name], SF)
