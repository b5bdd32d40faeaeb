import pytest
from oracle import SPARK_TYPES, duck_rows, duck_types, spark_rows

from tarnwright.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", catalog.ORACLE_SQL)
def test_query_matches_its_sql(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert spark_rows(df) == duck_rows(catalog.ORACLE_SQL[name], SF)
    assert sorted((c, SPARK_TYPES[t]) for c, t in df.dtypes) == duck_types(catalog.ORACLE_SQL[name], SF)
