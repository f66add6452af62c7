import duckdb
import pytest

import __spark_entry__ as entry
from compare import as_rows, connect, duck_rows, spark_rows
from workload.oracle import ORACLE
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert {"group_id", "path", "duplicate_type"} <= set(entry.entry(spark).columns)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    columns, rows = spark_rows(entry.queries()[name](spark, SF))
    assert (columns, rows) == duck_rows(con, entry.oracle_sql()[name])
    assert as_rows(columns, rows) == rows


def test_streams_take_tables_of_several_files(spark, tmp_path):
    con = duckdb.connect()
    for name in ("documents", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("stream_ingest", "stream_ext_counts", "stream_cached"):
        assert spark_rows(QUERIES[name](spark, str(tmp_path))) == duck_rows(con, ORACLE[name])
