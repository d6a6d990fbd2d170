"""The driver contract and the queries against DuckDB."""

import glob
import os

import duckdb
import pytest

from ledgerspark.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    return con


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.ORACLE) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLE[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    order = [want.columns.index(n) for n in names]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=key) == sorted((tuple(r[k] for k in order) for r in want.fetchall()), key=key)
