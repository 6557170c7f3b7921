"""The registered queries on the smallest tables."""

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline")


@pytest.mark.parametrize("name", NAMES)
def test_query_runs(spark, name):
    assert __spark_entry__.queries()[name](spark, SF).count() > 0


def test_near_duplicates_oracle(spark):
    name = "op4_near_duplicates"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    got = c.execute(__spark_entry__.oracle_sql()[name])
    columns = [x[0] for x in got.description]
    assert sorted(got.fetchall()) == sorted(map(tuple, __spark_entry__.queries()[name](spark, SF).select(columns).collect()))
