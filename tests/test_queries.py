"""Every driver query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

from quillweave.plans.oracles import ORACLES
from quillweave.plans.queries import QUERIES
from tools.check_oracles import as_rows

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no driver tables here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    mine = as_rows(df.columns, [tuple(r) for r in df.collect()])
    assert mine
    if name in ORACLES:
        result = con.sql(ORACLES[name])
        assert sorted(df.columns) == sorted(result.columns)
        assert mine == as_rows(result.columns, result.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
