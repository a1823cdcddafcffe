"""Every registered query of the keyed-table engine gives the rows that its SQL gives in DuckDB."""

import pytest
import support

from tessera import queries


@pytest.fixture(scope="module")
def con():
    return support.duckdb_over()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    got = support.spark_lines(queries.QUERIES[name](spark, support.DATA))
    assert got == support.duckdb_lines(con, queries.ORACLE_SQL[name])


def test_crc32_of_texts(spark):
    import zlib

    texts = {r[0]: r[1] for r in spark.read.parquet(f"{support.DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["crc"] for r in queries.QUERIES["crc32_log"](spark, support.DATA).collect()}
    assert got == {k: zlib.crc32(t.encode()) for k, t in texts.items()}


def test_range_reads_in_key_order(spark):
    got = [r["o_orderkey"] for r in queries.QUERIES["range_number_le"](spark, support.DATA).collect()]
    assert got == sorted(got, key=lambda k: k.to_bytes(8, "little")) and len(got) > 4


def test_point_and_range_predicates_reach_the_scan(spark):
    for name in ("query_point", "range_number_be", "range_string", "prefix_scan"):
        plan = queries.QUERIES[name](spark, support.DATA)._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: []" not in plan and "PushedFilters: [IsNotNull" in plan
