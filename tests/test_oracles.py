"""Every engine query that has an oracle, against DuckDB at the smallest scale."""

import decimal

import duckdb
import pytest

from cubeloom import queries as Q
from cubeloom.functions import text

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return int(v)
    return round(v, 6) if isinstance(v, float) else v


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracle(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    got = duck.execute(Q.ORACLES[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = [tuple(plain(r[columns.index(c)]) for c in df.columns) for r in got.fetchall()]
    assert ordered([tuple(map(plain, r)) for r in df.collect()]) == ordered(want)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_rows_only(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_sizes_of_large_and_odd_keys(spark, tmp_path):
    """Keys whose sizes are past a Gb, a Tb, ... and past what a double holds."""
    keys = [None, 0, -1, -4096, -(2**55), *range(10), 4095, 4096, 4608, 5632, *range(2**22 - 2, 2**22 + 3), 2**22 + 512, 8_999_999, *range(2**32, 2**32 + 600, 37)]
    keys += [2**42, 2**42 + 1, 2**42 + 512, 2**52 + 61, 2**52 + 512, 2**53 + 1, 2**54 + 1, 2**54 + 4097, 2**55 - 1]
    c = duckdb.connect()
    c.execute("create table orders (o_orderkey bigint)")
    c.executemany("insert into orders values (?)", [(k,) for k in keys])
    c.execute(f"copy orders to '{tmp_path}/orders.parquet' (format parquet)")
    got = Q.QUERIES["fn10_format_bytes"](spark, str(tmp_path)).select("o_orderkey", "size").collect()
    want = c.execute(f"select o_orderkey, size from ({Q.ORACLES['fn10_format_bytes']})").fetchall()
    assert ordered(map(tuple, got)) == ordered(want)


def test_sizes_have_all_units(spark):
    sizes = {0: "0b", 10: "10b", 1000: "1000b", 1536: "1.50Kb", 1310720: "1.25Mb", 2**30: "1Gb", 2**40 + 2**37: "1.12Tb", -(2**50): "-1Pb", -1536: "-1.50Kb", 5 * 2**60: "5Eb", 1024**2 - 1: "1024.00Kb"}
    df = spark.createDataFrame([*sizes.items(), (None, None)], "n long, want string")
    assert all(r.want == r.got for r in df.select("want", text.format_bytes(df.n).alias("got")).collect())
    df = spark.createDataFrame([(1.015 * 2**60, "1.01Eb", "1Eb"), (1.5, "1.50b", "2b"), (2.5, "2.50b", "2b"), (1024.0, "1Kb", "1Kb")], "n double, two string, none string")
    for r in df.select("two", "none", text.format_bytes(df.n).alias("got"), text.format_bytes(df.n, 0).alias("got_none")).collect():
        assert (r.got, r.got_none) == (r.two, r.none)
