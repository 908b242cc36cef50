"""The SQL of corpus queries against their rows, on the smallest tables."""

import duckdb
import pytest

from strata.llm.queries import ORACLE, QUERIES

SF001 = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op5_exact_dedup", "op8_decontamination", "op10_near_dedup"])
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS FROM '{SF001}/{table}.parquet'")
    result = con.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    got = QUERIES[name](spark, SF001)
    assert sorted(got.columns) == sorted(columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(rows, key=repr) == sorted(result.fetchall(), key=repr)
