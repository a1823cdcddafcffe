import pytest
import support

from tessera.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    got = support.spark_lines(queries.QUERIES[name](spark, support.DATA))
    assert got == support.duckdb_lines(support.duckdb_over(), queries.ORACLE_SQL[name])
