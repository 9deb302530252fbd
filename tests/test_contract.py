"""The driver contract, and every query with SQL against DuckDB at the smallest size."""

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{file}')")
    return con


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.count() > 0 and rows.columns == ["section", "n_docs", "newest", "oldest", "doc_sum"]


def test_names():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, tmp_path, name):
    QUERIES[name](spark, SF).write.parquet(str(tmp_path / "out"))
    duck.sql(f"CREATE OR REPLACE TABLE want AS {ORACLES[name]}")
    duck.sql(f"CREATE OR REPLACE TABLE got AS SELECT * FROM read_parquet('{tmp_path}/out/*.parquet')")
    columns = sorted(r[0] for r in duck.sql("DESCRIBE want").fetchall())
    assert columns == sorted(r[0] for r in duck.sql("DESCRIBE got").fetchall())
    listed = ", ".join(f'"{c}"' for c in columns)
    for a, b in (("want", "got"), ("got", "want")):
        assert duck.sql(f"SELECT {listed} FROM {a} EXCEPT ALL SELECT {listed} FROM {b} LIMIT 3").fetchall() == []
