"""Every query against its SQL twin in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.sql(f"create view {file.stem} as select * from '{file}'")
    return con


def normal(frame):
    """Columns, rows, and the kinds of columns without nulls (whole numbers with nulls come as
    floats from one side and as nullable integers from the other)."""
    columns = sorted(frame.columns)
    kinds = [None if frame[c].isna().any() else frame[c].dtype.kind for c in columns]
    values = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, kinds, sorted((tuple(r) for r in values.itertuples(index=False)), key=repr)


def test_only_known_queries_have_sql():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    mine = QUERIES[name](spark, str(DATA)).toPandas()
    if name not in SQL:
        assert len(mine) > 0
        return
    assert normal(mine) == normal(duck.sql(SQL[name]).df())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
